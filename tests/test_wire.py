"""The interchange format: bytes, limits, errors, decisions."""

import json
import re
import struct
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from varstrata import errors
from varstrata.limits import Limits
from varstrata.sources import wire

#: The four records of the format's own example.
GOLDEN = ['{"ts":1623000000,"level":"INFO","msg":"Started","user":"alice"}', '{"ts":1623000005,"level":"INFO","msg":"Step1","user":"alice"}', '{"ts":1623000010,"level":"WARN","msg":"Low disk","user":"bob"}', '{"ts":1623000020,"user":"carol","error":"Disk failure"}']
scalars = st.one_of(st.none(), st.booleans(), st.integers(-(1 << 70), 1 << 70), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=20))
values = st.recursive(scalars, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=5), x, max_size=3)), max_leaves=6)
records = st.lists(st.dictionaries(st.sampled_from(["a", "b", "é", 'q"']), values, max_size=4), max_size=30)


def exact(x):
    return json.loads(x, parse_float=Decimal, parse_int=Decimal) if isinstance(x, str) else json.loads(json.dumps(x), parse_float=Decimal, parse_int=Decimal)


@settings(max_examples=120, deadline=None)
@given(records, st.sampled_from([wire.NONE, wire.ZSTD]), st.booleans(), st.booleans())
def test_round_trip(rows, compressor, keys, trim):
    block = wire.encode_block([wire.loads(json.dumps(r)) for r in rows], compressor, 3, keys, trim)
    assert [exact(x) for x in wire.decode_block(block)] == [exact(r) for r in rows]
    some = wire.decode_block(block, ["a"])
    assert [exact(x) for x in some] == [exact({k: v for k, v in r.items() if k == "a"}) for r in rows]


def test_golden_block():
    header, _ = wire.open_block(wire.encode_block([wire.loads(x) for x in GOLDEN]))
    s = {x.name: x for x in header.segments}
    assert s["ts"].flags == wire.DELTA and (s["level"].flags, s["level"].entries, s["level"].present) == (wire.DICTIONARY, 2, 3)
    assert (s["error"].present, s["error"].flags, s["error"].entries) == (1, wire.DICTIONARY, 1) and s["user"].flags == 0
    assert [json.loads(x)["user"] for x in wire.decode_block(wire.encode_block([wire.loads(x) for x in GOLDEN]), ["user"])] == ["alice", "alice", "bob", "carol"]


def test_payload_bytes():
    """presence 1011, tags int null string, the integer -1 as 1, one dictionary entry, its number."""
    payload, *rest = wire.encode_column([-1, wire._ABSENT, None, "hi"])
    assert payload == bytes([0b1101, 0b00000010 | 4 << 6 & 0xFF, 4 >> 2]) + b"\x02hi" + b"\x01" + b"\x00" and rest == [1, 2, 3, wire.DICTIONARY, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("pqrstuvwxyz"), max_size=60), st.integers(1, 20), st.integers(0, 12))
def test_dictionary(letters, spread, limit):
    """A dictionary pays where each entry stands for eight strings, or where there are one or two entries."""
    strings = [x * (1 + k % spread) for k, x in enumerate(letters)]
    entries = len(set(strings))
    assert wire.use_dictionary(strings, limit) == (0 < entries <= limit and (entries < 3 or 8 * entries <= len(strings)))


@settings(max_examples=300, deadline=None)
@given(st.integers(wire.INT_MIN, wire.INT_MAX), st.lists(st.one_of(st.integers(90, 110), st.integers(-3, 400), st.integers(1, 1 << 62)), max_size=12))
def test_delta(first, steps):
    """Ascending numbers whose steps are much alike, over a distance that is a number of 64 bits itself."""
    ints = [first]
    for x in steps:
        ints.append(ints[-1] + x)
    alike = bool(steps) and min(steps) >= 1 and 2 * (max(steps) - min(steps)) < sum(steps) < 1 << 63
    assert wire.use_delta(ints) == alike


NUMBER = re.compile(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?")


@settings(max_examples=300, deadline=None)
@given(st.text("0123.eE+-", max_size=9), st.booleans())
def test_decimals(text, trim):
    """What is a number keeps its value; what isn't is an error."""
    if not NUMBER.fullmatch(text):
        with pytest.raises(errors.TypeMismatch):
            wire.decimal_parts(text)
        return
    mantissa, _, power = text.lower().partition("e")
    whole, _, part = mantissa.lstrip("+-").partition(".")
    if abs(int(power or 0)) > 500:
        return
    value = Fraction(int(whole + part), 10 ** len(part)) * Fraction(10) ** int(power or 0)
    negative, digits, exponent = wire.decimal_parts(text, trim)
    assert Fraction(int(digits)) * Fraction(10) ** exponent == value and negative == (text[0] == "-" and value != 0)
    assert digits == "0" and exponent == 0 if value == 0 else digits[0] != "0" and not (trim and digits[-1] == "0")


def test_canonical_numbers_keep_values():
    assert wire.decimal_parts("70.500", trim=True) == (False, "705", -1)
    assert wire.decimal_text(*wire.decimal_parts("0.00314159265000", trim=True)) == "3.14159265e-3"
    assert [wire.loads(str(x)) for x in (wire.INT_MAX, wire.INT_MAX + 1)] == [wire.INT_MAX, wire.Number("9223372036854775808")]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, (1 << 64) - 1))
def test_varints(n):
    assert wire.Cursor(wire.uleb(n)).number() == n and wire.zig(wire.zag(n)) == n


def test_checksum():
    # Fixed value: the polynomial's check vector.
    assert wire.crc32c(b"123456789") == 0xE3069283
    data = bytes(k * 7 & 255 for k in range(70_001))
    state = 0xFFFFFFFF
    for b in data:
        state = state >> 8 ^ int(wire._CRC[(state ^ b) & 255])
    assert wire.crc32c(data) == state ^ 0xFFFFFFFF


def broken(change):
    data = bytearray(wire.encode_block([wire.loads(x) for x in GOLDEN], wire.NONE))
    change(data)
    return bytes(data)


def test_damage_is_found():
    with pytest.raises(errors.ChecksumMismatch):
        wire.decode_block(broken(lambda d: d.__setitem__(-1, d[-1] ^ 1)))
    assert len(wire.decode_block(broken(lambda d: d.__setitem__(-1, d[-1] ^ 1)), verify=False)) == 4
    with pytest.raises(errors.CorruptBlock):
        wire.decode_block(broken(lambda d: d.__setitem__(0, 0)))
    with pytest.raises(errors.RecordError):
        wire.decode_block(broken(lambda d: d.__setitem__(slice(-40, None), b"")))


@pytest.mark.parametrize(("data", "error"), [(b"", errors.UnexpectedEof), (b"XXXX" + b"\0" * 8, errors.InvalidMagic), (wire.FILE_MAGIC[:3] + b"\x02" + b"\0" * 8, errors.UnsupportedVersion), (wire.FILE_MAGIC + struct.pack("<IBB", 24, 1, 3) + b"\0\0", errors.UnsupportedFeature)])
def test_file_headers(data, error):
    with pytest.raises(error):
        wire.FileHeader.decode(data)


def test_header_and_index():
    h = wire.FileHeader(metadata=json.dumps({wire.SEGMENT_KEY: 99}).encode()).with_hint("json_array")
    got, size = wire.FileHeader.decode(h.encode() + b"rest")
    assert (got.hint, got.segment_bytes, size) == ("json_array", 99, len(h.encode()))
    assert wire.FileHeader(metadata=b"{bad").segment_bytes is None
    index = [(10, 300, 5), (310, 7, 1)]
    data = wire.encode_index(index)
    assert wire.decode_index(data) == index
    with pytest.raises(errors.ChecksumMismatch):
        wire.decode_index(data[:-1] + bytes([data[-1] ^ 1]))


def test_limits():
    with pytest.raises(errors.LimitExceeded):
        wire.encode_block([{"a": "x" * 50}], limits=Limits(segment_bytes=16))
    with pytest.raises(errors.LimitExceeded):
        wire.encode_block([{"a": 1}] * 3, limits=Limits(records_per_block=2))
    block = wire.encode_block([{"a": 1}] * 3)
    with pytest.raises(errors.LimitExceeded):
        wire.decode_block(block, limits=Limits(records_per_block=2))
    with pytest.raises(errors.LimitExceeded):
        Limits(records_per_block=1_000_001)
    with pytest.raises(errors.UnsupportedCompression):
        wire.packed(b"", 2, 1)
