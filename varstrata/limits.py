"""Limits that decide errors."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from varstrata.errors import LimitExceeded, WrapperError

MIB = 1 << 20


@dataclass(frozen=True)
class Limits:
    records_per_block: int = 100_000
    fields_per_block: int = 4_096
    segment_bytes: int = 64 * MIB
    block_bytes: int = 256 * MIB
    dict_entries: int = 4_096
    string_bytes: int = 16 * MIB
    decimal_digits: int = 65_536
    presence_bytes: int = 32 * MIB
    tag_bytes: int = 32 * MIB

    #: What no setting may exceed.
    HARD: ClassVar[dict] = {"records_per_block": 1_000_000, "fields_per_block": 65_535, "dict_entries": 65_535}

    def __post_init__(self):
        for name, most in self.HARD.items():
            if not 0 <= getattr(self, name) <= most:
                raise LimitExceeded(f"{name} is {getattr(self, name)}; at most {most}")


@dataclass(frozen=True)
class WrapperLimits:
    depth: int = 3
    buffer_bytes: int = 16 * MIB
    pointer_chars: int = 256

    #: What no setting may exceed.
    HARD: ClassVar[dict] = {"depth": 10, "buffer_bytes": 128 * MIB, "pointer_chars": 2_048}

    def __post_init__(self):
        for name, most in self.HARD.items():
            if getattr(self, name) > most:
                raise WrapperError("ConfigurationExceedsHardLimits", f"{name} is {getattr(self, name)}; at most {most}")
