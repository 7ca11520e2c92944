"""Settings that reading JSON as VARIANT depends on, and this package's own settings.

A setting is looked up in this order: what a caller passes, the environment (VARSTRATA_WRAPPER_DEPTH and the like), the
session (varstrata.wrapper.depth), a TOML file named by VARSTRATA_CONFIG, the built-in default.
"""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import SparkSession

#: Name: default. Names are those of the session's settings and, in capitals with underscores, of the environment.
DEFAULTS = {"block.records": 100_000, "zstd.level": 6, "wrapper.depth": 3, "wrapper.buffer": "16M", "wrapper.debug": False, "parallel.memory.factor": 0.75}


def prepare(spark: SparkSession) -> SparkSession:
    """Of a key that an object repeats, the last value counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def setting(name: str, spark: SparkSession | None = None, passed=None):
    default = DEFAULTS[name]
    found = passed
    if found is None:
        found = os.environ.get("VARSTRATA_" + name.upper().replace(".", "_"))
    if found is None and spark is not None:
        found = spark.conf.get(f"varstrata.{name}", None)
    if found is None and (path := os.environ.get("VARSTRATA_CONFIG")):
        with open(path, "rb") as f:
            at = tomllib.load(f)
        for part in name.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        found = at
    if found is None:
        return default
    if isinstance(default, bool):
        return str(found).lower() in ("1", "true", "yes", "on")
    return type(default)(found)
