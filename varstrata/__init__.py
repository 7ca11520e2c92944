"""varstrata: an archive, reshaping and inspection engine for JSON records, built on Spark's VARIANT type."""

__version__ = "0.1.0"
