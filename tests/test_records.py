"""Sources, reshaping, blocks, encoding decisions, projection, inspection, archives, streams, command line."""

import io
import json

import pytest
from pyspark.sql import functions as F

from varstrata import api, cli, errors, model
from varstrata.functions import scalars, tags
from varstrata.limits import Limits, WrapperLimits
from varstrata.operators import blocks, encoding, inspect, project, wrappers
from varstrata.plans import catalogue
from varstrata.session import setting
from varstrata.sources import archive, text, wire, wire_source
from varstrata.streaming import ingest


def docs(spark, *values):
    return spark.createDataFrame([(str(k), v) for k, v in enumerate(values)], "src string, value string")


def recs(spark, *values):
    rows = [(k, json.dumps(v) if not isinstance(v, str) else v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "record_idx long, j string").select(F.lit("t").alias("src"), "record_idx", F.parse_json("j").alias("rec"))


def out(df):
    return [json.loads(r[0]) for r in df.orderBy("src", "record_idx").select(F.to_json("rec")).collect()]


def fails(df, kind):
    with pytest.raises(Exception) as e:  # noqa: PT011
        df.collect()
    found = errors.translate(e.value)
    assert getattr(found, "kind", type(found).__name__) == kind, str(found)[:300]


# Sources


def test_ndjson(spark, tmp_path):
    (tmp_path / "a.ndjson").write_bytes(b'\xef\xbb\xbf{"a":1}\r\n\n{"b":2,"b":3}\n   \n\xef\xbb\xbf{"c":null}')
    got = text.read_ndjson(spark, str(tmp_path / "a.ndjson"))
    assert out(got) == [{"a": 1}, {"b": 3}, {"c": None}]
    assert sorted(r[0] for r in got.select("record_idx").collect()) == [0, 1, 2]
    (tmp_path / "bad.ndjson").write_text('{"a":1}\n[1]\n{oops\n')
    fails(text.read_ndjson(spark, str(tmp_path / "bad.ndjson")), "JsonError")
    assert out(text.read_ndjson(spark, str(tmp_path / "bad.ndjson"), lenient=True)) == [{"a": 1}]


def test_numbers_over_many_splits(spark, tmp_path):
    (tmp_path / "big.ndjson").write_text("".join(f'{{"k":{k}}}\n' + "\n" * (k % 3) for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = text.read_ndjson(spark, str(tmp_path / "big.ndjson"))
        assert got.rdd.getNumPartitions() > 1
        assert all(a == b for a, b in got.select("record_idx", F.variant_get("rec", "$.k", "long")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(("value", "want"), [("[]", []), (' [{"a":1},{"b":[2]}] ', [{"a": 1}, {"b": [2]}]), ('{"a":{}}', [{"a": {}}]), ("3", "TypeMismatch"), ("", "UnexpectedEof"), ("[1]", "JsonError"), ("[{},]", "JsonError")])
def test_arrays(spark, value, want):
    got = text.array_records(docs(spark, value))
    if isinstance(want, str):
        fails(got, want)
    else:
        assert out(got) == want


def test_containers(spark, tmp_path):
    for name, body, hint, n in (("a.json", '[{"x":1}]', "json_array", 1), ("b.json", '{"x":1}', "json_array", 1), ("c.jsonl", '{"x":1}\n{"x":2}', "ndjson", 2), ("d.json", '{"x":1}\n{"x":2}\n', "ndjson", 2)):
        (tmp_path / name).write_text(body)
        got, found = text.read_auto(spark, str(tmp_path / name))
        assert (found, got.count()) == (hint, n)
    with pytest.raises(errors.TypeMismatch):
        text.read_auto(spark, str(tmp_path), ndjson=True, array=True)


def test_rows_become_records(spark):
    df = spark.createDataFrame([(3, None), (1, "a"), (2, "b")], "k int, s string")
    assert out(model.from_rows(df, "t", order=["k"])) == [{"k": 1, "s": "a"}, {"k": 2, "s": "b"}, {"k": 3, "s": None}]
    assert out(model.from_rows(df, "t", F.col("k"), drop_null=True))[2] == {"k": 3}
    assert model.from_rows(df.where("false"), "t", order=["k"]).count() == 0


# Reshaping


@pytest.mark.parametrize(("doc", "at", "want"), [
    ({"data": [{"id": 1, "name": "alice"}, {"id": 2, "name": "bob"}]}, "/data", [{"id": 1, "name": "alice"}, {"id": 2, "name": "bob"}]),
    ({"a": {"b": {"id": 1}}}, "/a/b", [{"id": 1}]), ({"a": []}, "/a", []), ({"id": 1}, "", [{"id": 1}]), ({"a/b": {"~": [{"id": 1}]}}, "/a~1b/~0", [{"id": 1}]),
    ({"a": [{"id": 1}, {"id": 2}]}, "/a/1", [{"id": 2}]), ({"0": {"id": 7}}, "/0", [{"id": 7}]),
    ({"a": 1}, "/b", "PointerNotFound"), ({"a": None}, "/a", "PointerTargetWrongType"), ({"a": "x"}, "/a", "PointerTargetWrongType"), ({"a": [1]}, "/a", "ElementNotObject"),
])
def test_pointer(spark, doc, at, want):
    got = wrappers.pointer(docs(spark, json.dumps(doc)), at)
    if isinstance(want, str):
        fails(got, want)
    else:
        assert out(got) == want


@pytest.mark.parametrize(("at", "kind"), [("a", "InvalidPointer"), ("/a~2", "InvalidPointer"), ("/" + "a" * 300, "PointerTooLong"), ("/a/b/c/d", "PointerTooDeep")])
def test_bad_pointers(at, kind):
    with pytest.raises(errors.WrapperError) as e:
        wrappers.parse_pointer(at, WrapperLimits())
    assert e.value.kind == kind


def test_sections(spark):
    doc = docs(spark, json.dumps({"users": [{"n": "alice"}, {"n": "bob"}], "guests": [{"n": "charlie"}], "x": {"y": [{"n": 0}]}}))
    assert [(r["n"], r["_section"]) for r in out(wrappers.sections(doc, ["users", "guests"]))] == [("alice", "users"), ("bob", "users"), ("charlie", "guests")]
    assert [r["source"] for r in out(wrappers.sections(doc, [wrappers.Section("guests", label="g"), "d=/x/y"], label_field="source"))] == ["g", "d"]
    assert out(wrappers.sections(doc, ["none", "guests"], label_field=None)) == [{"n": "charlie"}]
    fails(wrappers.sections(doc, ["none"], required=True), "SectionNotFound")
    fails(wrappers.sections(docs(spark, '{"a":[{"_section":1}]}'), ["a"]), "SectionLabelCollision")
    fails(wrappers.sections(docs(spark, '{"a":[3]}'), ["a"]), "SectionElementNotObject")
    fails(wrappers.sections(docs(spark, '{"a":3}'), ["a"]), "SectionNotArray")
    fails(wrappers.sections(docs(spark, "[]"), ["a"]), "RootNotObject")
    assert {r["section"]: r["records"] for r in wrappers.metrics(wrappers.sections(doc, ["users", "guests"])).collect()} == {"users": 2, "guests": 1}


def test_keyed_map(spark):
    assert out(wrappers.keyed_map(docs(spark, '{"b":{"age":1},"a":{}}'))) == [{"_key": "a"}, {"_key": "b", "age": 1}]
    assert out(wrappers.keyed_map(docs(spark, '{"m":{"a":{"k":1}}}'), "/m", "k", overwrite=True)) == [{"k": "a"}]
    assert out(wrappers.keyed_map(docs(spark, "{}"))) == []
    fails(wrappers.keyed_map(docs(spark, '{"a":{"_key":1}}')), "MapKeyCollision")
    fails(wrappers.keyed_map(docs(spark, '{"a":1}')), "MapValueNotObject")
    fails(wrappers.keyed_map(docs(spark, "[]")), "MapNotObject")


def test_array_headers(spark):
    assert out(wrappers.array_headers(docs(spark, '[["id","name"],[1,"Alice"],[2,null]]'))) == [{"id": 1, "name": "Alice"}, {"id": 2, "name": None}]
    assert out(wrappers.array_headers(docs(spark, '[["a","a"],[1,2]]'))) == [{"a": 2}]
    assert out(wrappers.array_headers(docs(spark, '[["a"]]'))) == []
    for doc, kind in (('[["a",1],[1,2]]', "InvalidHeaderRow"), ("[]", "InvalidHeaderRow"), ('[["a"],[1,2]]', "ArrayRowLengthMismatch"), ('[["a"],3]', "ArrayRowNotArray"), ("{}", "RootNotArray")):
        fails(wrappers.array_headers(docs(spark, doc)), kind)


def test_plugins_and_choice(spark):
    def check(config):
        if "n" not in config:
            raise ValueError("n is missing")

    wrappers.register(wrappers.Plugin("twice", lambda d, c, _: wrappers.pointer(d, "").unionAll(wrappers.pointer(d, "")).limit(c["n"]), validate=check))
    try:
        assert wrappers.plugin(docs(spark, "{}"), "twice", {"n": 2}).count() == 2
        for f, kind in ((lambda: wrappers.plugin(docs(spark, "{}"), "twice", {}), "PluginConfigInvalid"), (lambda: wrappers.register(wrappers.plugins()[0]), "PluginExists"), (lambda: wrappers.plugin(docs(spark, "{}"), "no"), "PluginNotFound")):
            with pytest.raises(errors.WrapperError) as e:
                f()
            assert e.value.kind == kind
    finally:
        assert wrappers.unregister("twice") and not wrappers.unregister("twice")
    with pytest.raises(ValueError, match="exactly one"):
        wrappers.apply(docs(spark, "{}"), pointer_at="", headers=True)
    fails(wrappers.pointer(docs(spark, '{"a": "' + "x" * 200 + '"}'), "", WrapperLimits(buffer_bytes=100)), "BufferLimitExceeded")
    with pytest.raises(errors.WrapperError):
        WrapperLimits(depth=11)
    assert wrappers.as_jq("/a/b~1c/0") == '.a["b/c"][0]' and wrappers.suggested_size(1 << 20) == "1.5M"


# Tags, blocks, encoding


def test_tags(spark):
    row = recs(spark, {"n": None, "b": True, "i": 2**63 - 1, "d": 2**63, "f": 1.5, "s": "", "o": {}, "a": []})
    got = {r["field"]: (r["t"], r["c"]) for r in model.cells(row).select("field", tags.tag(F.col("value")).alias("t"), tags.tag_code(F.col("value")).alias("c")).collect()}
    assert got == {"n": ("null", 0), "b": ("bool", 1), "i": ("int", 2), "d": ("decimal", 3), "f": ("decimal", 3), "s": ("string", 4), "o": ("object", 5), "a": ("array", 6)}


def test_blocks(spark):
    rows = recs(spark, {"s": "x" * 40}, {"s": "y" * 40}, {"s": "z"})
    cut = blocks.greedy(rows, 100, Limits(segment_bytes=70)).orderBy("record_idx").collect()
    assert [(r["block_idx"], r["cut_by"]) for r in cut] == [(0, None), (1, "s"), (1, None)]
    assert [tuple(r) for r in blocks.flush_metrics(blocks.greedy(rows, 100, Limits(segment_bytes=70))).collect()] == [("s", 1, 0)]
    assert [tuple(r) for r in blocks.flush_metrics(blocks.greedy(rows, 100, Limits(segment_bytes=16))).collect()] == [("s", 0, 2)]
    assert "LimitExceeded" in blocks.greedy(rows, 100, Limits(segment_bytes=16)).orderBy("record_idx").first()["error"]
    assert [r["block_idx"] for r in blocks.by_count(rows, 2).orderBy("record_idx").collect()] == [0, 0, 1]
    c = blocks.Cutter(10, Limits(segment_bytes=70))
    assert [c.add([("s", 41, False)], 41) for _ in range(2)] == [0, 1] and (c.flushes, c.rejected) == ({"s": 1}, {})
    sized = lambda text: spark.range(1).select(blocks.memory(F.parse_json(F.lit(text)))).first()[0]
    assert sized('{"a":[1,"xy"],"b":null}') == 1 + 8 + 1 + 2 + 1
    assert sized('{"q,{":"[1, \\"é\\"\\n]\\u0001","t":true,"o":{"d":-12.5,"e":[]}}') == (3 + 11) + (1 + 1) + (1 + 8) + (1 + 5) + (1 + 8)


def test_stretches_are_cut_as_records_are():
    """Run over stretches of any length does what Cutter does record by record."""
    import random

    import numpy as np
    import pyarrow as pa

    r = random.Random(1)
    for _ in range(300):
        rows = [([(k, r.choice((0, 1, 5, 9, 40)), r.random() < 0.3) for k in r.sample("abcd", r.randint(0, 4))], r.choice((0, 3, 30))) for _ in range(r.randint(1, 60))]
        target, limits = r.choice((1, 3, 7, 1000)), Limits(segment_bytes=r.choice((1, 12, 45, 100)), block_bytes=r.choice((1, 50, 10**6)))
        cutter, want = blocks.Cutter(target, limits), []
        for fields, weight in rows:
            got = cutter.add(fields, weight)
            want.append((got if isinstance(got, int) else -1, cutter.reason, None if isinstance(got, int) else got))
        run, out, at = blocks.Run(target, limits), [], 0
        while at < len(rows):
            some = rows[at : at + r.randint(1, 20)]
            at += len(some)
            flat = [f for fields, _ in some for f in fields]
            found, reasons, refused = run.cut(np.array([w for _, w in some]), np.cumsum([0, *(len(f) for f, _ in some)]), pa.array([f[0] for f in flat], pa.string()), np.array([f[1] for f in flat], np.int64), np.array([f[2] for f in flat], bool))
            out += [(b, reasons.get(i), refused.get(i)) for i, b in enumerate(found.tolist())]
        assert out == want


def test_sources_are_cut_over_many_ranges(spark):
    """A source that many ranges hold is cut as one, whatever stands before and after it, and no task sorts it."""
    rows = spark.range(3000).select(F.when(F.col("id") < 40, "a").when(F.col("id") < 2900, "b").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("src"), F.col("id").alias("record_idx"), F.parse_json(F.concat(F.lit('{"s":"'), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")), F.lit('"}'))).alias("rec"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(blocks, "RANGE", 300)
        cut = blocks.greedy(rows, 50, Limits(segment_bytes=120))
    assert cut.rdd.getNumPartitions() >= 8 and "Sort" not in cut._jdf.queryExecution().executedPlan().toString()
    got = {(r["src"], r["record_idx"]): (r["block_idx"], r["cut_by"]) for r in cut.collect()}
    cutters, want = {}, {}
    for k in range(3000):
        src = "a" if k < 40 else "b" if k < 2900 else f"c{k}"
        c = cutters.setdefault(src, blocks.Cutter(50, Limits(segment_bytes=120)))
        want[src, k] = (c.add([("s", 1 + k % 7, False)], k % 7 + 1), c.reason)
    assert got == want


def test_encoding(spark):
    ints = spark.createDataFrame([("up", k, 1000 + k) for k in range(5)] + [("big", 0, -(2**63)), ("big", 1, 2**63 - 1), ("one", 0, 5)], "f string, record_idx int, v long")
    assert {r["f"]: r["use_delta"] for r in encoding.delta_decision(ints, ["f"]).collect()} == {"up": True, "big": False, "one": False}
    strings = spark.createDataFrame([("on", k, "ab"[k % 2]) for k in range(8)] + [("off", k, str(k)) for k in range(9)], "f string, record_idx int, v string")
    assert {r["f"]: r["use_dict"] for r in encoding.dictionary_decision(strings, ["f"]).collect()} == {"on": True, "off": False}
    assert not any(r["use_dict"] for r in encoding.dictionary_decision(strings, ["f"], most=0).collect())
    assert sorted((r["v"], r["entry"]) for r in encoding.dictionary(strings.where("f = 'on'"), ["f"]).collect()) == [("a", 0), ("b", 1)]


@pytest.mark.parametrize("v", [0, -1, 1, 2**63 - 1, -(2**63), 300])
def test_zigzag(spark, v):
    z, back, n = spark.range(1).select(scalars.zigzag(F.lit(v).cast("long")).alias("z")).select("z", scalars.unzigzag(F.col("z")), scalars.uleb_length(F.col("z"))).first()
    assert z % 2**64 == wire.zig(v) and back == v and n == len(wire.uleb(wire.zig(v)))


def test_plain_functions():
    assert scalars.parse_size("1.5K") == 1536 and scalars.parse_size("16M") == 16 << 20 and scalars.parse_size("7") == 7
    with pytest.raises(ValueError):
        scalars.parse_size("x")
    assert [scalars.normal_factor(x) for x in (float("nan"), 0, 0.5, 3)] == [0.75, 0.75, 0.5, 1.0]
    assert scalars.recommended_block_size(0, 5, 5) == 1000 and scalars.recommended_block_size(10_000, 100, 50) == 18_000
    assert scalars.advised_tasks(8, 1 << 40, 1 << 20) == 1 and scalars.advised_tasks(64, 1 << 40, 1 << 30) == 16 and scalars.advised_tasks(8, 1 << 30, 1 << 30) == 1


def test_settings(spark, monkeypatch, tmp_path):
    (tmp_path / "c.toml").write_text("[wrapper]\ndepth = 4\n")
    assert setting("wrapper.depth") == 3
    monkeypatch.setenv("VARSTRATA_CONFIG", str(tmp_path / "c.toml"))
    assert setting("wrapper.depth") == 4
    spark.conf.set("varstrata.wrapper.depth", "5")
    assert setting("wrapper.depth", spark) == 5
    monkeypatch.setenv("VARSTRATA_WRAPPER_DEPTH", "6")
    assert setting("wrapper.depth", spark) == 6 and setting("wrapper.depth", spark, 3) == 3
    spark.conf.unset("varstrata.wrapper.depth")


# Projection, inspection


def test_projection(spark):
    rows = recs(spark, {"user": "alice", "active": True}, {"user": "bob"}, {"user": "carol", "active": None}, {"x": "a,\"b\"\nc\r"})
    assert out(project.project(rows, ["active"])) == [{"active": True}, {}, {"active": None}, {}]
    assert [r["line"] for r in project.csv_lines(rows, ["user", "active", "x"]).orderBy("record_idx").collect()] == ["alice,true,", "bob,,", "carol,,", ',,"a,""b""\nc\r"']
    assert [r["v"] for r in project.values(rows, "active").orderBy("record_idx").select(project.value_text(F.col("value")).alias("v")).collect()] == ["true", "null"]
    with pytest.raises(errors.InternalError):
        project.project(rows, [])
    assert project.resolve_format("auto", "json_array") == "json_array" and project.resolve_format("auto", "unknown") == "ndjson" and project.resolve_format("ndjson", "json_array") == "ndjson"
    buffer = io.StringIO()
    assert project.write_stream(project.ndjson_lines(rows.limit(0)), buffer, "json_array") == 0 and buffer.getvalue() == "[]"


def test_stats(spark):
    rows = blocks.by_count(recs(spark, {"user": "a", "v": 1}, {"user": "b", "v": None}, {"user": "c", "v": "x"}, {"w": 1.5}), 2)
    got = {r["field"]: r for r in inspect.field_stats(rows).collect()}
    assert (got["v"]["present"], got["v"]["absent"], got["v"]["null_count"], got["v"]["n_int"], got["v"]["n_string"], got["v"]["sampled"]) == (3, 1, 1, 1, 1, False)
    one = {r["field"]: r for r in inspect.field_stats(rows, 1).collect()}
    assert (one["v"]["sample_size"], one["v"]["sampled"], one["v"]["null_count"], one["v"]["present"]) == (1, True, 0, 3) and not one["w"]["sampled"]
    assert inspect.most_populated(inspect.field_stats(rows)) == "v"
    with pytest.raises(errors.InternalError, match="user, v, w"):
        inspect.require_field(inspect.fields(rows), "nope")
    with pytest.raises(errors.InternalError):
        inspect.field_stats(rows, 0)
    shown = json.loads(inspect.render(inspect.blocks(rows), inspect.field_stats(rows), "json", verbose=True, directory=inspect.field_directory(rows)))
    assert shown["fields"] == ["user", "v", "w"] and [b["record_count"] for b in shown["blocks"]] == [2, 2]


@pytest.mark.parametrize(("spec", "want"), [("2", (2, 2)), ("2-3", (2, 3)), ("2-", (2, 5)), ("-2", (1, 2)), ("0", None), ("3-2", None), ("6", None), ("x", None), ("-", None), ("", None)])
def test_ranges(spec, want):
    if want:
        assert inspect.parse_range(spec, 5) == want
    else:
        with pytest.raises(errors.InternalError):
            inspect.parse_range(spec, 5)


# Archives


@pytest.fixture
def orders(spark, small):
    rows = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    return blocks.by_count(model.from_rows(rows, "orders", order=["o_orderkey"]), 400)


def test_native_archive_prunes(spark, orders, tmp_path):
    path = str(tmp_path / "native")
    archive.write(orders, path, hint="ndjson")
    got = archive.read(spark, path)
    assert out(got) == out(orders) and archive.container_hint(spark, path) == "ndjson"
    assert [r["record_count"] for r in archive.manifest(spark, path).orderBy("block_idx").collect()] == [400, 400, 400, 300]
    plan = got.where("block_idx = 1").select(model.field(F.col("rec"), "o_custkey").cast("long"))._jdf.queryExecution().toString()
    assert "struct<0:" in plan and "PushedFilters: [IsNotNull(block_idx), EqualTo(block_idx,1)]" in plan


def test_wire_file(spark, orders, tmp_path):
    path = str(tmp_path / "x.arc")
    wire_source.write(orders, path, hint="json_array")
    got = wire_source.read(spark, path)
    assert out(got) == out(orders) and wire_source.read(spark, path, firstBlock=1, lastBlock=2).count() == 800
    assert out(wire_source.read(spark, path, ["o_custkey"])) == [{"o_custkey": r["o_custkey"]} for r in out(orders)]
    one = open(path, "rb").read()
    wire_source.write(orders.repartition(3), path, hint="json_array")
    assert open(path, "rb").read() == one  # the bytes don't depend on how rows were dealt
    with wire_source.File(path) as f:
        assert f.header()[0].hint == "json_array" and len(f.index()) == 4
        index = f.index()
    made = {r["field"]: r for r in wire_source.writer_metrics(spark, path).collect()}
    assert made["o_custkey"]["blocks"] == 4 and made["o_custkey"]["records"] == made["o_custkey"]["present"] == 1500
    wire_source.write(orders, str(tmp_path / "noindex.arc"), index=False)
    assert out(wire_source.read(spark, str(tmp_path / "noindex.arc"))) == out(orders)
    with pytest.raises(Exception, match="exists"):
        wire_source.write(orders, path, mode="append")
    # A broken header is an error, or its block is left out.
    damaged = bytearray(one[: index[-1][0] + index[-1][1]])
    damaged[index[1][0] : index[1][0] + 4] = b"\0\0\0\0"
    (tmp_path / "bad.arc").write_bytes(damaged)
    with pytest.raises(Exception, match="no block begins here"):
        wire_source.read(spark, str(tmp_path / "bad.arc")).count()
    assert wire_source.read(spark, str(tmp_path / "bad.arc"), mode="PERMISSIVE").count() == 1100
    flipped = bytearray(one)
    flipped[index[0][0] + index[0][1] - 1] ^= 1
    (tmp_path / "crc.arc").write_bytes(flipped)
    with pytest.raises(Exception, match="ChecksumMismatch"):
        wire_source.read(spark, str(tmp_path / "crc.arc")).count()
    assert wire_source.read(spark, str(tmp_path / "crc.arc"), verifyChecksums=False).count() == 1500


def test_blocks_share_partitions(spark, orders, tmp_path):
    """A file of many small blocks isn't a task for each of them."""
    path = str(tmp_path / "x.arc")
    wire_source.write(blocks.by_count(orders, 10), path)
    with wire_source.File(path) as f:
        index = f.index()
    got = wire_source.read(spark, path)
    assert len(index) == 150 and got.rdd.getNumPartitions() <= 8 and out(got) == out(orders)
    some = wire_source.read(spark, path, partitionBytes=3 * max(size for _, size, _ in index), firstBlock=7)
    assert 40 <= some.rdd.getNumPartitions() <= 50 and out(some) == out(orders)[70:]
    assert [r[0] for r in some.select("record_idx").orderBy("record_idx").collect()] == list(range(70, 1500))
    assert wire_source.read(spark, path, partitionBytes=1).rdd.getNumPartitions() == 150
    assert wire_source.read(spark, f"{path},{path}").count() == 3000


def test_whole_jobs(spark, tmp_path):
    (tmp_path / "in.json").write_text('[{"a":1,"b":"x,y"},{"b":null}]')
    for target in (str(tmp_path / "t.arc"), str(tmp_path / "native")):
        api.compress(spark, str(tmp_path / "in.json"), target)
        assert out(api.decompress(spark, target)) == [{"a": 1, "b": "x,y"}, {"b": None}] and api.container(spark, target) == "json_array"
        for style, want in (("auto", '[{"b":"x,y"},{"b":null}]'), ("ndjson", '{"b":"x,y"}\n{"b":null}\n'), ("csv", 'b\n"x,y"\n\n')):
            buffer = io.StringIO()
            assert api.extract(spark, target, ["b"], buffer, style) == 2 and buffer.getvalue() == want


def test_empty_wire_file(spark, orders, tmp_path):
    wire_source.write(orders.where("false"), str(tmp_path / "e.arc"))
    assert wire_source.read(spark, str(tmp_path / "e.arc")).count() == 0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(([1, 2, 3], [4])):
        (tmp_path / "in" / f"{n}.ndjson").write_text("".join(f'{{"a":{k}}}\n' for k in rows))
        for _ in range(2):
            ingest.into_archive(ingest.lines(spark, str(tmp_path / "in")), str(tmp_path / "arc"), str(tmp_path / "cp"), target=2).awaitTermination(60)
    got = archive.read(spark, str(tmp_path / "arc"))
    assert sorted(r["a"] for r in out(got)) == [1, 2, 3, 4]
    assert sorted(r["record_count"] for r in archive.manifest(spark, str(tmp_path / "arc")).collect()) == [1, 1, 2]


def test_command_line(spark, tmp_path, capsys):
    source = tmp_path / "in.ndjson"
    source.write_text('{"user":"alice","level":"a,b"}\n{"user":"bob","level":null}\n{"user":"carol"}\n')
    for target in (tmp_path / "x.arc", tmp_path / "native"):
        assert cli.main(["pack", str(source), "-o", str(target), "--block-records", "2"]) == 0
        assert cli.main(["unpack", str(target), "-o", str(tmp_path / "back")]) == 0
        assert [json.loads(x) for x in (tmp_path / "back").read_text().splitlines()] == [json.loads(x) for x in source.read_text().splitlines()]
        capsys.readouterr()
        assert cli.main(["cat", str(target), "--field", "level", "--format", "csv", "--blocks", "-1"]) == 0
        assert capsys.readouterr().out == "a,b\nnull\n"
        assert cli.main(["ls", str(target), "--format", "json", "--stats", "--stats-sample", "1"]) == 0
        assert json.loads(capsys.readouterr().out)["stats"][0]["sampled"] is True
        assert cli.main(["cat", str(target), "--field", "nope"]) == 1
        assert "level, user" in capsys.readouterr().err


# Strict scans and lossless sinks


TRAILING = ['{"k":1} trailing garbage', '{"k":2}{"k":3}', '{"k":1},{"k":2}', '{"k":1}] x [', '{"k":1}} {', '{"k":1} 5']


@pytest.mark.parametrize("line", TRAILING)
def test_text_after_a_value_is_an_error(spark, tmp_path, line):
    (tmp_path / "a.ndjson").write_text(f'{{"k":0}}\n{line}\n{{"k":9}}\n')
    fails(text.read_ndjson(spark, str(tmp_path / "a.ndjson")), "JsonError")
    assert out(text.read_ndjson(spark, str(tmp_path / "a.ndjson"), lenient=True)) == [{"k": 0}, {"k": 9}]
    (tmp_path / "b.json").write_text(line)
    fails(text.read_json_array(spark, str(tmp_path / "b.json")), "JsonError")
    (tmp_path / "c.json").write_text(f"[{{}}] {line}")
    fails(text.read_json_array(spark, str(tmp_path / "c.json")), "JsonError")
    fails(text.array_records(docs(spark, f"[{line}] [1]")), "JsonError")
    fails(wrappers.pointer(docs(spark, f'{{"a":[]}} {line}'), "/a"), "JsonError")


def test_blanks_around_values_are_none(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿ \n[ {"k":1} ,\n {"k":2}\t] \n')
    assert out(text.read_json_array(spark, str(tmp_path / "a.json"))) == [{"k": 1}, {"k": 2}]
    (tmp_path / "b.json").write_text(" {}\n")
    assert out(text.read_json_array(spark, str(tmp_path / "b.json"))) == [{}]


@pytest.mark.parametrize(("body", "kind"), [(" \n", "UnexpectedEof"), ('[{"a":1}', "UnexpectedEof"), ("[{},]", "JsonError"), ("[,{}]", "JsonError"), ("[{} {}]", "JsonError"), ("[1]", "JsonError"), ("5", "JsonError"), ("[{}}", "JsonError")])
def test_bad_arrays(spark, tmp_path, body, kind):
    (tmp_path / "a.json").write_text(body)
    with pytest.raises(Exception) as e:  # noqa: PT011
        text.read_json_array(spark, str(tmp_path / "a.json")).collect()
    assert kind in str(e.value) or type(errors.translate(e.value)).__name__ == kind


def test_array_splits_anywhere():
    """However a file is cut into chunks, its elements are the same."""
    import io as _io

    rows = [{"a": 'q"\\ [,]{}'}, {"b": [1, [2, {"c": "\\\\"}]]}, {}, {"é": "漢\\u0022,"}]
    whole = json.dumps(rows, ensure_ascii=False).encode()
    for size in (1, 2, 3, 7, 64, 4096):
        got = [json.loads(x) for x in text.values_of(_io.BytesIO(b"\n" + whole + b" "), size)]
        assert got == rows, size
    assert list(text.values_of(_io.BytesIO(b" [ \n] "), 2)) == []


def test_one_array_is_cut_by_many_tasks(spark, tmp_path, monkeypatch):
    """However a file is cut into stretches, its elements, their numbers and its errors are the same."""
    import io as _io

    rows = [{"a": 'q"\\ [,]{}'}, {"b": [1, [2, {"c": "\\\\"}]]}, {}, {"é": "漢\\u0022,"}, {"t": "\\" * 9 + '"'}]

    def read(data, size, chunk):
        f = _io.BytesIO(data)
        found = [(k, min(k + size, len(data)), text.Part.summary(f, k, min(k + size, len(data)))) for k in range(0, len(data), size)]
        out = []
        for _, begin, end, inside, depth, state, first in text.Part.chained("x", len(data), found):
            got = list(text.Part.values(f, len(data), begin, end, inside, depth, state, chunk))
            assert not got or first == len(out)
            out += got
        return [json.loads(x) for x in out]

    for body in (json.dumps(rows, ensure_ascii=False), json.dumps(rows, indent=2), "\ufeff " + json.dumps(rows) + " " * 50, "[ ]", "[{}]", '{"a":[{},"]"]}'):
        want = json.loads(body.removeprefix("\ufeff"))
        for size in (1, 2, 3, 7, 40, 4096)[4 * body.startswith("\ufeff") :]:
            for chunk in (1, 5, 4096)[body.startswith("\ufeff") :]:
                assert read(body.encode(), size, chunk) == (want if isinstance(want, list) else [want]), (body, size, chunk)
    for body in ("[{},]", "[{}] x", "[{}", "[,{}]", "[{}}", "   ", '[{"a":1},{"b":[}', "[{}]" + " " * 20 + "[1,2]"):
        with pytest.raises((errors.JsonError, errors.UnexpectedEof)) as whole:
            list(text.values_of(_io.BytesIO(body.encode())))
        for size in (1, 2, 3, 7):
            with pytest.raises(whole.type):
                read(body.encode(), size, 2)
    many = [{"k": k, "s": '",[' * (k % 5)} for k in range(2000)]
    (tmp_path / "a.json").write_text(json.dumps(many))
    got = text.read_json_array(spark, str(tmp_path / "a.json"), chunk=100, part=5000)
    assert got.rdd.getNumPartitions() > 5 and out(got) == many
    assert [r[0] for r in got.select("record_idx").orderBy("record_idx").collect()] == list(range(2000))


def test_numbering_sorts_nothing(spark, tmp_path, small):
    """Neither the file's writer nor its reader gathers all lines in one task."""
    (tmp_path / "a.ndjson").write_text('{"k":1}\n{"k":2}\n')
    plan = text.read_ndjson(spark, str(tmp_path / "a.ndjson"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    for name in ("ndjson_scan", "ndjson_strict"):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(type(spark.range(1)), "repartition", lambda *_: pytest.fail("one task would get all lines"))
            assert catalogue.queries()[name](spark, small).count() > 0


def test_one_file_from_many_tasks(spark, tmp_path):
    """Lines of equal numbers don't meet in one task, and one file comes of all."""
    lines = spark.range(4000).select(F.lit("s").alias("src"), F.lit(0).alias("record_idx"), F.concat(F.lit('{"k":'), F.col("id").cast("string"), F.lit("}")).alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert max(project._ordered(lines).rdd.glom().map(len).collect()) < 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    project.write_file(lines, str(tmp_path / "a.json"), array=True)
    assert sorted(r["k"] for r in json.loads((tmp_path / "a.json").read_text())) == list(range(4000))
    project.write_file(lines.where("false"), str(tmp_path / "e.json"), array=True)
    assert json.loads((tmp_path / "e.json").read_text()) == []
    numbered = lines.withColumn("record_idx", F.get_json_object("line", "$.k").cast("long")).repartition(5)
    project.write_file(numbered, str(tmp_path / "a.ndjson"))
    assert [json.loads(x)["k"] for x in (tmp_path / "a.ndjson").read_text().splitlines()] == list(range(4000))


def test_lines_in_a_file_called_json(spark, tmp_path):
    rows = [{"k": k, "pad": "x" * 9000} for k in range(3)]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    got, hint = text.read_auto(spark, str(tmp_path / "a.json"))
    assert hint == "ndjson" and out(got) == rows
    (tmp_path / "b.json").write_text(json.dumps(rows[0], indent=1))
    got, hint = text.read_auto(spark, str(tmp_path / "b.json"))
    assert hint == "json_array" and out(got) == rows[:1]


def test_files_keep_every_byte(spark, tmp_path):
    lines = ["  a,b  ", '"q",c', "", "x\ty", " "]
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(lines)], "src string, record_idx long, line string").repartition(3)
    project.write_lines(df, str(tmp_path / "plain"))
    project.write_lines(df.coalesce(1), str(tmp_path / "headed"), header=" h ")
    read = lambda p: ["".join(f.read_text() for f in sorted((tmp_path / p).glob("part-*")))]
    assert read("plain")[0].split("\n")[:-1] == lines
    files = [f.read_text() for f in sorted((tmp_path / "headed").glob("part-*")) if f.stat().st_size]
    assert all(f.startswith(" h \n") for f in files) and "".join(f.removeprefix(" h \n") for f in files).split("\n")[:-1] == lines
    objects = [{"k": k} for k in range(20)]
    project.write_arrays(project.ndjson_lines(recs(spark, *objects)), str(tmp_path / "arrays"))
    parts = [json.loads(f.read_text()) for f in sorted((tmp_path / "arrays").glob("part-*")) if f.stat().st_size]
    assert [x for p in parts for x in p] == objects


def test_append_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "arc")
    one, two = (blocks.by_count(recs(spark, *({"k": k} for k in range(n))), 2) for n in (3, 5))
    for df in (one, two, two):
        archive.append(df, path, "batch-1", hint="ndjson")
    archive.append(one, path, "batch-2")
    archive.append(one.where("false"), path, "batch-3")
    assert archive.read(spark, path).count() == 8
    assert archive.manifest(spark, path).agg(F.sum("record_count")).first()[0] == 8
    archive.write(one, path)
    assert archive.read(spark, path).count() == 3 and archive.manifest(spark, path).count() == 2
    archive.write(one.where("false"), path)
    assert archive.read(spark, path).count() == 0 and archive.manifest(spark, path).count() == 0


def test_listing_reads_headers_alone(spark, tmp_path, capsys, monkeypatch):
    path = str(tmp_path / "a.arc")
    wire_source.write(blocks.by_count(recs(spark, *({"k": k, "s": "x"} if k % 2 else {"k": k} for k in range(10))), 4), path)
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setattr(wire_source, "read", None)
    assert cli.main(["ls", path, "--format", "json", "--verbose"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["fields"] == ["k", "s"] and [b["record_count"] for b in got["blocks"]] == [4, 4, 2]
    monkeypatch.undo()
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["cat", path, "--field", "k", "--blocks", "2"]) == 0
    assert capsys.readouterr().out.split() == ["4", "5", "6", "7"]


# Remedies, metrics, exact doubles


def test_errors_say_what_to_do(spark):
    small = WrapperLimits(buffer_bytes=100)
    with pytest.raises(Exception, match="PointerNotFound") as e:
        wrappers.pointer(docs(spark, '{"a":{"c":1}}'), "/a/b~1d").collect()
    assert '.a["b/d"]' in str(e.value) and "keys: c" in str(e.value)
    with pytest.raises(Exception, match="BufferLimitExceeded") as e:
        wrappers.keyed_map(docs(spark, "{" + " " * 200 + "}"), limits=small).collect()
    assert "303B" in str(e.value)
    assert out(wrappers.pointer(docs(spark, '{"a":[{"k":1}]}' + "\n" * 300), "/a", small)) == [{"k": 1}]


def test_reshaping_metrics(spark):
    doc = docs(spark, '{"users":[{"n":1},{"n":2}],"guests":[{"n":3}]}', '{"users":[],"guests":[{"n":4}]}')
    got = wrappers.run_metrics(doc, section_specs=["users", "guests"]).first()
    assert (got["mode"], got["documents"], got["records"], got["sections"]) == ("sections", 2, 4, {"users": 2, "guests": 2}) and got["peak_buffer"] == 46
    got = wrappers.run_metrics(docs(spark, '[["a","b"],[1,2]]'), headers=True).first()
    assert (got["mode"], got["records"], got["header_fields"]) == ("array_headers", 1, 2)
    got = wrappers.run_metrics(docs(spark, '{"m":{"x":{},"y":{}}}'), map_at="/m").first()
    assert (got["mode"], got["pointer"], got["records"]) == ("map", "/m", 2)


@pytest.mark.parametrize(("s", "want"), [("0.5", 0.5), ("0.1", None), ("1e3", 1000.0), ("-2.25", -2.25), ("1e300", None), ("9007199254740993", None), ("9007199254740992", 2.0**53), ("1e400", None), ("0", 0.0)])
def test_exact_doubles(spark, s, want):
    assert scalars.double_if_exact(s) == want
    assert spark.range(1).select(scalars.exact_double(F.lit(s))).first()[0] == want
    if want is not None:
        assert float(scalars.decimal_if_exact(want)) == want


def test_doubles_without_a_decimal():
    assert [scalars.decimal_if_exact(x) for x in (0.1, float("nan"), float("inf"), -0.0, 0.75)] == [None, None, None, None, "0.75"]


def test_flushes_of_a_write(spark, tmp_path):
    rows = recs(spark, *({"s": "x" * 40, "k": k} for k in range(6)))
    cut = blocks.greedy(rows, 100, Limits(segment_bytes=100))
    path = str(tmp_path / "a.arc")
    wire_source.write(rows.join(cut.drop("cut_by", "error"), ["src", "record_idx"]), path, segmentBytes=100)
    got = {r["field"]: r.asDict() for r in wire_source.writer_metrics(spark, path, cut).collect()}
    assert (got["s"]["blocks"], got["s"]["records"], got["s"]["flushes"], got["s"]["rejections"]) == (3, 6, 2, 0) and got["k"]["flushes"] == 0


def test_commands_say_what_they_did(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "in.ndjson").write_text('{"a":1}\n{"a":2}\n')
    assert cli.main(["pack", str(tmp_path / "in.ndjson"), "-o", str(tmp_path / "x.arc"), "--verbose"]) == 0
    said = capsys.readouterr().err
    assert "as ndjson" in said and "2 records" in said and "MiB/s" in said
    assert cli.main(["unpack", str(tmp_path / "x.arc"), "-o", str(tmp_path / "back"), "--verbose"]) == 0
    assert "2 records" in capsys.readouterr().err and (tmp_path / "back").read_text() == '{"a":1}\n{"a":2}\n'
    assert cli.main(["unpack", str(tmp_path / "x.arc")]) == 0
    captured = capsys.readouterr()
    assert captured.out == '{"a":1}\n{"a":2}\n' and captured.err == ""
