"""Errors, and their names inside plans: raise_error('<Code>: ...') is mapped back by translate()."""

from __future__ import annotations

import re


class RecordError(Exception):
    """Base of all errors of this package."""


class InvalidMagic(RecordError): ...


class UnsupportedVersion(RecordError): ...


class CorruptHeader(RecordError): ...


class CorruptBlock(RecordError): ...


class ChecksumMismatch(RecordError): ...


class UnexpectedEof(RecordError): ...


class DecompressError(RecordError): ...


class LimitExceeded(RecordError): ...


class TypeMismatch(RecordError): ...


class DictionaryError(RecordError): ...


class UnsupportedFeature(RecordError): ...


class UnsupportedCompression(RecordError): ...


class IoError(RecordError): ...


class JsonError(RecordError): ...


class InternalError(RecordError): ...


class WrapperError(InternalError):
    """A reshaping step failed; kind names the rule that was broken."""

    def __init__(self, kind: str, text: str):
        super().__init__(f"{kind}: {text}")
        self.kind = kind


WRAPPER_KINDS = (
    "ConfigurationExceedsHardLimits PointerTooLong InvalidPointer PointerTooDeep PointerNotFound PointerTargetWrongType BufferLimitExceeded "
    "RootNotObject SectionNotFound SectionNotArray SectionElementNotObject SectionLabelCollision MapNotObject MapValueNotObject MapKeyCollision "
    "MapKeyTooLong InvalidHeaderRow RootNotArray ArrayRowNotArray ArrayRowLengthMismatch PluginNotFound PluginExists PluginConfigInvalid ElementNotObject"
).split()
CODES = {c.__name__: c for c in RecordError.__subclasses__()}


def translate(error: Exception) -> Exception:
    """The package's error that a Spark exception carries, else the exception itself."""
    text = str(error)
    if m := re.search(r"\b(" + "|".join(WRAPPER_KINDS) + r"): ([^\n]*)", text):
        return WrapperError(m[1], m[2])
    if m := re.search(r"\b(" + "|".join(CODES) + r"): ([^\n]*)", text):
        return CODES[m[1]](m[2])
    if "MALFORMED_RECORD_IN_PARSING" in text or "MALFORMED_VARIANT" in text:
        return JsonError(text.split("\n")[0])
    return error
