"""The binary interchange format: a file of self-contained blocks of columns.

A file is a header, blocks, and an index with a pointer to it at the end. A block is a header with a directory of its
fields, one compressed segment for each field, and a checksum. A segment holds which records have the field, the tag of
each value, a dictionary if it pays, and the values by kind.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import zstandard

from varstrata import errors
from varstrata.limits import Limits

# Fixed values of the format.
FILE_MAGIC = b"JAC\x01"
BLOCK_MAGIC = b"BLK1"
INDEX_MAGIC = b"IDX1"
NONE, ZSTD = 0, 1
COMPRESSORS = {0: "none", 1: "zstd", 2: "brotli", 3: "deflate"}
CANONICAL_KEYS, CANONICAL_NUMBERS, NESTED_OPAQUE = 1, 2, 4
HINTS = ("unknown", "ndjson", "json_array")
DICTIONARY, DELTA = 1, 2
NULL, BOOL, INT, DECIMAL, STRING, OBJECT, ARRAY = range(7)
CRC_POLYNOMIAL = 0x82F63B78
SEGMENT_KEY = "segment_max_bytes"

INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CRC_POLYNOMIAL), t >> 1)
    return t


_CRC = _crc_table()


def _advance(state: np.ndarray, data: np.ndarray) -> np.ndarray:
    """state after each column of data's rows, one byte a row at a time."""
    for row in data:
        state = (state >> np.uint32(8)) ^ _CRC[(state ^ row) & np.uint32(0xFF)]
    return state


def crc32c(data: bytes) -> int:
    """Castagnoli's CRC. Long inputs are cut into columns that advance together and are then joined: the state is linear
    in its start, so a column's zero bytes map the 32 unit states once for all."""
    state, tail = 0xFFFFFFFF, data
    if len(data) >= 4096:
        columns = 1 << max(4, (len(data).bit_length() - 1) // 2)
        rows = len(data) // columns
        body = np.frombuffer(data, np.uint8, columns * rows).reshape(columns, rows).T.astype(np.uint32)
        own = _advance(np.zeros(columns, np.uint32), body).tolist()
        units = _advance(np.uint32(1) << np.arange(32, dtype=np.uint32), np.zeros((rows, 1), np.uint32))
        bits = np.arange(256)[:, None] >> np.arange(8) & 1
        tables = [np.bitwise_xor.reduce(np.where(bits, units[8 * k : 8 * k + 8], 0), axis=1).tolist() for k in range(4)]
        for x in own:
            state = tables[0][state & 255] ^ tables[1][state >> 8 & 255] ^ tables[2][state >> 16 & 255] ^ tables[3][state >> 24] ^ x
        tail = data[columns * rows :]
    table = _CRC.tolist()
    for byte in tail:
        state = state >> 8 ^ table[(state ^ byte) & 255]
    return state ^ 0xFFFFFFFF


def uleb(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def zig(v: int) -> int:
    return (v << 1 ^ v >> 63) & (1 << 64) - 1


def zag(u: int) -> int:
    return u >> 1 ^ -(u & 1)


class Cursor:
    """Reads a buffer from front to back; an end that comes too early is an error of the kind given."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None, error=errors.UnexpectedEof):
        self.data, self.at, self.end, self.error = data, at, len(data) if end is None else end, error

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise self.error("the data end too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        out = shift = 0
        while True:
            byte = self.take(1)[0]
            if shift == 63 and byte > 1:
                raise errors.CorruptBlock("a number has more than 64 bits")
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    def text(self, most: int, what: str = "string") -> str:
        n = self.number()
        if n > most:
            raise errors.LimitExceeded(f"a {what} of {n} bytes; at most {most}")
        try:
            return self.take(n).decode()
        except UnicodeDecodeError as e:
            raise errors.CorruptBlock(f"a {what} isn't UTF-8") from e


@dataclass
class FileHeader:
    flags: int = NESTED_OPAQUE
    compressor: int = ZSTD
    level: int = 6
    block_hint: int = 0
    metadata: bytes = b""

    @property
    def hint(self) -> str:
        code = self.flags >> 3 & 3
        if code == 3:
            raise errors.UnsupportedFeature("the container hint 3 is reserved")
        return HINTS[code]

    def with_hint(self, hint: str) -> FileHeader:
        self.flags = self.flags & ~24 | HINTS.index(hint) << 3
        return self

    @property
    def segment_bytes(self) -> int | None:
        """The limit that the writer used, if its metadata say so; what can't be read is ignored."""
        try:
            found = json.loads(self.metadata)[SEGMENT_KEY]
            return found if isinstance(found, int) and found > 0 else None
        except (ValueError, KeyError, TypeError):
            return None

    def encode(self) -> bytes:
        return FILE_MAGIC + struct.pack("<IBB", self.flags, self.compressor, self.level) + uleb(self.block_hint) + uleb(len(self.metadata)) + self.metadata

    @classmethod
    def decode(cls, data: bytes) -> tuple[FileHeader, int]:
        c = Cursor(data)
        magic = c.take(4)
        if magic[:3] != FILE_MAGIC[:3]:
            raise errors.InvalidMagic("not an archive")
        if magic[3] != FILE_MAGIC[3]:
            raise errors.UnsupportedVersion(f"version {magic[3]}")
        out = cls(*struct.unpack("<IBB", c.take(6)), c.number())
        out.metadata = c.take(c.number())
        out.hint  # noqa: B018  a reserved hint is an error
        return out, c.at


@dataclass
class Segment:
    """An entry of a block's directory."""

    name: str
    compressor: int
    level: int
    presence_bytes: int
    tag_bytes: int
    present: int
    flags: int
    entries: int
    raw: int
    packed: int
    offset: int

    def encode(self) -> bytes:
        name = self.name.encode()
        numbers = (self.presence_bytes, self.tag_bytes, self.present, self.flags, self.entries, self.raw, self.packed, self.offset)
        return uleb(len(name)) + name + bytes((self.compressor, self.level)) + b"".join(map(uleb, numbers))


@dataclass
class BlockHeader:
    records: int
    segments: list[Segment] = field(default_factory=list)

    def encode(self) -> bytes:
        body = uleb(self.records) + uleb(len(self.segments)) + b"".join(s.encode() for s in self.segments)
        return BLOCK_MAGIC + uleb(len(body)) + body

    @property
    def packed(self) -> int:
        return sum(s.packed for s in self.segments)

    @classmethod
    def decode(cls, data: bytes, at: int = 0, limits: Limits = Limits()) -> tuple[BlockHeader, int]:
        """The header at a place, and where its segments begin."""
        c = Cursor(data, at)
        if c.take(4) != BLOCK_MAGIC:
            raise errors.CorruptBlock("no block begins here")
        size = c.number()
        body = Cursor(data, c.at, c.at + size) if c.at + size <= len(data) else c.take(size)
        records, count = body.number(), body.number()
        for what, n, most in (("records", records, limits.records_per_block), ("fields", count, limits.fields_per_block)):
            if n > most:
                raise errors.LimitExceeded(f"a block of {n} {what}; at most {most}")
        out = cls(records)
        for _ in range(count):
            name = body.text(limits.string_bytes, "field name")
            compressor, level = body.take(2)
            s = Segment(name, compressor, level, *(body.number() for _ in range(8)))
            for what, n, most in (("presence", s.presence_bytes, limits.presence_bytes), ("tag", s.tag_bytes, limits.tag_bytes), ("segment", s.raw, limits.segment_bytes), ("dictionary", s.entries, limits.dict_entries)):
                if n > most:
                    raise errors.LimitExceeded(f"{what} size {n} of {name!r}; at most {most}")
            if s.present > records:
                raise errors.CorruptBlock(f"{name!r} is present more often than there are records")
            out.segments.append(s)
        if body.at != c.at + size:
            raise errors.CorruptBlock("the header is longer than its directory")
        if sum(s.raw for s in out.segments) > limits.block_bytes:
            raise errors.LimitExceeded("the block is larger than the limit")
        expected = 0
        for s in out.segments:
            if s.offset != expected:
                raise errors.CorruptBlock("segments don't follow each other")
            expected += s.packed
        return out, c.at + size


def encode_index(blocks: list[tuple[int, int, int]]) -> bytes:
    """(offset, size, records) of each block; without the pointer that comes after it."""
    body = uleb(len(blocks)) + b"".join(uleb(n) for b in blocks for n in b)
    whole = INDEX_MAGIC + uleb(len(body)) + body
    return whole + struct.pack("<I", crc32c(whole))


def decode_index(data: bytes) -> list[tuple[int, int, int]]:
    c = Cursor(data)
    if c.take(4) != INDEX_MAGIC:
        raise errors.InvalidMagic("no index begins here")
    size = c.number()
    body = Cursor(data, c.at, min(c.at + size, len(data)))
    out = [(body.number(), body.number(), body.number()) for _ in range(body.number())]
    if body.at != c.at + size:
        raise errors.CorruptHeader("the index is longer than its entries")
    if struct.unpack("<I", body.data[body.at : body.at + 4])[0] != crc32c(data[: body.at]):
        raise errors.ChecksumMismatch("of the index")
    return out


# Numbers -------------------------------------------------------------------------------------------------------------


def decimal_parts(text: str, trim: bool = False) -> tuple[bool, str, int]:
    """(negative, digits, exponent) of a JSON number; zero has no sign. trim drops zeros at the end of the digits."""
    try:
        d = Decimal(text)
    except ArithmeticError as e:
        raise errors.TypeMismatch(f"not a number: {text[:40]!r}") from e
    if not d.is_finite():
        raise errors.TypeMismatch(f"not a number: {text[:40]!r}")
    sign, digits, exponent = d.as_tuple()
    s = "".join(map(str, digits)).lstrip("0")
    if not s:
        return False, "0", 0
    if trim:
        cut = s.rstrip("0")
        s, exponent = cut, exponent + len(s) - len(cut)
    return bool(sign), s, exponent


def decimal_text(negative: bool, digits: str, exponent: int) -> str:
    """Plain for exponents of -6 to 6, else with an e."""
    digits = digits.lstrip("0")
    if not digits:
        return "0"
    sign = "-" * negative
    if abs(exponent) > 6:
        power = exponent + len(digits) - 1
        return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if power >= 0 else '-'}{abs(power)}"
    if exponent >= 0:
        return sign + digits + "0" * exponent
    padded = digits.rjust(1 - exponent, "0")
    return f"{sign}{padded[:exponent]}.{padded[exponent:]}"


def minified(value) -> str:
    """JSON without white space, keys in order; decimals as they were spelled."""
    if isinstance(value, Number):
        return value.text
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{minified(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(minified, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


@dataclass(frozen=True)
class Number:
    """A number that isn't an integer of 64 bits, by its spelling."""

    text: str


def loads(text: str):
    return json.loads(text, parse_float=Number, parse_int=lambda s: v if INT_MIN <= (v := int(s)) <= INT_MAX else Number(s), parse_constant=lambda s: (_ for _ in ()).throw(errors.JsonError(s)))


# Columns -------------------------------------------------------------------------------------------------------------


def use_delta(ints: list[int]) -> bool:
    if len(ints) < 2:
        return False
    steps = [b - a for a, b in zip(ints, ints[1:], strict=False)]
    span = ints[-1] - ints[0]
    return min(steps) > 0 and 2 * (max(steps) - min(steps)) < span <= INT_MAX


def use_dictionary(strings: list[str], limit: int) -> bool:
    return bool(strings) and limit > 0 and len(set(strings)) <= min(limit, max(2, len(strings) // 8))


def _sized(texts) -> bytes:
    return b"".join(uleb(len(b)) + b for b in (t.encode() for t in texts))


def _tag_bits(tags: np.ndarray) -> bytes:
    return np.packbits((tags[:, None] >> np.arange(3) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


_ABSENT = object()


def encode_column(values: list, limits: Limits = Limits(), trim: bool = False) -> tuple[bytes, int, int, int, int, int]:
    """(payload, presence bytes, tag bytes, present, flags, entries) of one field of a block's records."""
    present = [v for v in values if v is not _ABSENT]
    tags, by_kind = [], [[] for _ in range(7)]
    for v in present:
        kind = NULL if v is None else BOOL if isinstance(v, bool) else INT if isinstance(v, int) else DECIMAL if isinstance(v, Number) else STRING if isinstance(v, str) else OBJECT if isinstance(v, dict) else ARRAY
        tags.append(kind)
        by_kind[kind].append(v)
    for s in by_kind[STRING]:
        if len(s.encode()) > limits.string_bytes:
            raise errors.LimitExceeded(f"a string is longer than {limits.string_bytes} bytes")
    flags, words = 0, []
    if use_dictionary(by_kind[STRING], limits.dict_entries):
        flags, words = DICTIONARY, list(dict.fromkeys(by_kind[STRING]))
    ints = by_kind[INT]
    if use_delta(ints):
        flags |= DELTA
        ints = [ints[0], *(b - a for a, b in zip(ints, ints[1:], strict=False))]
    presence = np.packbits(np.array([v is not _ABSENT for v in values], np.uint8), bitorder="little").tobytes()
    tag_bytes = _tag_bits(np.array(tags, np.uint8)) if tags else b""
    number = {w: uleb(k) for k, w in enumerate(words)}
    decimals = [decimal_parts(d.text, trim) for d in by_kind[DECIMAL]]
    if any(len(d[1]) > limits.decimal_digits for d in decimals):
        raise errors.LimitExceeded(f"a number has more than {limits.decimal_digits} digits")
    payload = b"".join((
        presence,
        tag_bytes,
        _sized(words),
        np.packbits(np.array(by_kind[BOOL], np.uint8), bitorder="little").tobytes() if by_kind[BOOL] else b"",
        b"".join(uleb(zig(v)) for v in ints),
        b"".join(bytes((sign,)) + uleb(len(digits)) + digits.encode() + uleb(zig(exponent)) for sign, digits, exponent in decimals),
        b"".join(number[s] for s in by_kind[STRING]) if words else _sized(by_kind[STRING]),
        _sized(map(minified, by_kind[OBJECT])),
        _sized(map(minified, by_kind[ARRAY])),
    ))
    return payload, len(presence), len(tag_bytes), len(present), flags, len(words)


def decode_column(payload: bytes, s: Segment, records: int, limits: Limits = Limits()) -> list[str | None]:
    """The field's values as JSON text, None where it is absent."""
    if s.flags & ~(DICTIONARY | DELTA):
        raise errors.UnsupportedFeature(f"encoding flags {s.flags}")
    if s.presence_bytes != -(-records // 8) or s.tag_bytes != (3 * s.present + 7) // 8:
        raise errors.CorruptBlock(f"{s.name!r} has presence or tags of a wrong size")
    if bool(s.flags & DICTIONARY) != bool(s.entries):
        raise errors.DictionaryError(f"{s.name!r} has {s.entries} entries and flags {s.flags}")
    c = Cursor(payload, error=errors.CorruptBlock)
    there = np.unpackbits(np.frombuffer(c.take(s.presence_bytes), np.uint8), bitorder="little")
    if there.sum() != s.present or there[records:].any():
        raise errors.CorruptBlock(f"the presence of {s.name!r} doesn't add up")
    bits = np.unpackbits(np.frombuffer(c.take(s.tag_bytes), np.uint8), bitorder="little")[: 3 * s.present].reshape(-1, 3)
    tags = (bits << np.arange(3, dtype=np.uint8)).sum(1)
    if (tags == 7).any():
        raise errors.UnsupportedFeature("tag 7 is reserved")
    count = np.bincount(tags.astype(int), minlength=8)
    words = [c.text(limits.string_bytes, "dictionary entry") for _ in range(s.entries)]
    flags = np.unpackbits(np.frombuffer(c.take(-(-int(count[BOOL]) // 8)), np.uint8), bitorder="little")
    ints = [zag(c.number()) for _ in range(count[INT])]
    if s.flags & DELTA:
        for k in range(1, len(ints)):
            ints[k] += ints[k - 1]
    if any(not INT_MIN <= v <= INT_MAX for v in ints):
        raise errors.CorruptBlock("an integer leaves 64 bits")
    decimals = []
    for _ in range(count[DECIMAL]):
        sign, n = c.take(1)[0], c.number()
        if sign > 1 or not 0 < n <= limits.decimal_digits:
            raise errors.CorruptBlock("a decimal is broken")
        digits, exponent = c.take(n), zag(c.number())
        if not digits.isdigit() or not -(1 << 31) <= exponent < 1 << 31:
            raise errors.CorruptBlock("a decimal is broken")
        decimals.append(decimal_text(bool(sign), digits.decode(), exponent))
    strings = []
    for _ in range(count[STRING]):
        if not words:
            strings.append(c.text(limits.string_bytes))
        elif (k := c.number()) < len(words):
            strings.append(words[k])
        else:
            raise errors.DictionaryError(f"entry {k} of {len(words)}")
    nested = [[c.text(limits.segment_bytes, "document") for _ in range(count[k])] for k in (OBJECT, ARRAY)]
    if c.at != len(payload):
        raise errors.CorruptBlock(f"the segment of {s.name!r} has bytes left")
    parts = [None, iter(["true" if b else "false" for b in flags]), map(str, ints), iter(decimals), (json.dumps(x, ensure_ascii=False) for x in strings), *map(iter, nested)]
    tokens = iter("null" if t == NULL else next(parts[t]) for t in tags.tolist())
    return [next(tokens) if p else None for p in there[:records]]


# Blocks --------------------------------------------------------------------------------------------------------------


def packed(payload: bytes, compressor: int, level: int) -> bytes:
    if compressor == NONE:
        return payload
    if compressor == ZSTD:
        return zstandard.ZstdCompressor(level=level).compress(payload)
    raise errors.UnsupportedCompression(f"{compressor} ({COMPRESSORS.get(compressor, 'unknown')})")


def unpacked(data: bytes, compressor: int, size: int) -> bytes:
    if compressor == NONE:
        out = data
    elif compressor == ZSTD:
        try:
            out = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
        except zstandard.ZstdError as e:
            raise errors.DecompressError(str(e)) from e
    else:
        raise errors.UnsupportedCompression(f"{compressor} ({COMPRESSORS.get(compressor, 'unknown')})")
    if len(out) != size:
        raise errors.CorruptBlock("a segment unpacks to another size")
    return out


def encode_block(records: list[dict], compressor: int = ZSTD, level: int = 6, sort_keys: bool = False, trim: bool = False, limits: Limits = Limits()) -> bytes:
    """Records are dictionaries as loads() gives them."""
    if len(records) > limits.records_per_block:
        raise errors.LimitExceeded(f"a block of {len(records)} records; at most {limits.records_per_block}")
    names = list(dict.fromkeys(k for r in records for k in r))
    if len(names) > limits.fields_per_block:
        raise errors.LimitExceeded(f"a block of {len(names)} fields; at most {limits.fields_per_block}")
    header, segments, offset, total = BlockHeader(len(records)), [], 0, 0
    for name in sorted(names) if sort_keys else names:
        payload, presence, tags, present, flags, entries = encode_column([r.get(name, _ABSENT) for r in records], limits, trim)
        total += len(payload)
        if len(payload) > limits.segment_bytes or total > limits.block_bytes:
            raise errors.LimitExceeded(f"the segment of {name!r} or its block is too large")
        data = packed(payload, compressor, level)
        header.segments.append(Segment(name, compressor, level, presence, tags, present, flags, entries, len(payload), len(data), offset))
        segments.append(data)
        offset += len(data)
    whole = header.encode() + b"".join(segments)
    return whole + struct.pack("<I", crc32c(whole))


def open_block(data: bytes, verify: bool = True, limits: Limits = Limits()) -> tuple[BlockHeader, int]:
    """The header of a whole block's bytes, and where its segments begin."""
    header, at = BlockHeader.decode(data, 0, limits)
    if at + header.packed + 4 != len(data):
        raise errors.CorruptBlock("the block's size doesn't fit its segments")
    if verify and struct.unpack("<I", data[-4:])[0] != crc32c(data[:-4]):
        raise errors.ChecksumMismatch("of a block")
    return header, at


def decode_block(data: bytes, fields: list[str] | None = None, verify: bool = True, limits: Limits = Limits()) -> list[str]:
    """Records as JSON text, keys in order. With fields, only their segments are unpacked."""
    header, at = open_block(data, verify, limits)
    columns = []
    for s in sorted(header.segments, key=lambda s: s.name):
        if fields is None or s.name in fields:
            body = data[at + s.offset : at + s.offset + s.packed]
            columns.append((json.dumps(s.name, ensure_ascii=False), decode_column(unpacked(body, s.compressor, s.raw), s, header.records, limits)))
    return ["{" + ",".join(f"{name}:{v[k]}" for name, v in columns if v[k] is not None) + "}" for k in range(header.records)]
