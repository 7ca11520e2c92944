"""The queries of the driver contract and their SQL: one for each operator, over records made from the given tables.

Tables become records by fixed rules, so that SQL can say what must come out: DRIFT gives events a field v that is
absent, null, or of each of the other kinds in turn; SOME gives customers a field that is absent or null for some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varstrata.files import place
from varstrata.functions import scalars, tags
from varstrata.limits import Limits
from varstrata.model import cells, field, from_rows
from varstrata.operators import blocks, encoding, inspect, project, wrappers
from varstrata.scratch import scratch
from varstrata.session import prepare
from varstrata.sources import archive, text, wire_source

#: The value of v by event_id % 8, as JSON; 0 is absent.
DRIFT = """CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'null' WHEN 2 THEN CASE WHEN event_id % 16 = 2 THEN 'true' ELSE 'false' END
  WHEN 3 THEN CAST(event_id AS {s}) WHEN 4 THEN concat(CAST(event_id AS {s}), '.5') WHEN 5 THEN concat('"', event_type, '"')
  WHEN 6 THEN concat('{{"k":', CAST(user_id AS {s}), '}}') ELSE concat('[', CAST(user_id AS {s}), ',null]') END"""
DRIFT_TAG = "CASE event_id % 8 WHEN 1 THEN 'null' WHEN 2 THEN 'bool' WHEN 3 THEN 'int' WHEN 4 THEN 'decimal' WHEN 5 THEN 'string' WHEN 6 THEN 'object' WHEN 7 THEN 'array' END"
BLOCK = 1000

_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of event_id, user_id and v; record_idx is event_id."""
    v = F.expr(DRIFT.format(s="string"))
    made = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"user_id":'), F.col("user_id").cast("string"), F.when(v.isNotNull(), F.concat(F.lit(',"v":'), v)).otherwise(""), F.lit("}"))
    return t(spark, sf_dir, "events").select(F.lit("events").alias("src"), F.col("event_id").alias("record_idx"), F.parse_json(made).alias("rec"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records in blocks; record_idx is o_orderkey."""
    rows = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))
    return blocks.by_count(from_rows(rows, "orders", F.col("o_orderkey")), BLOCK)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, ',"seg":null').otherwise(F.concat(F.lit(',"seg":"'), "c_mktsegment", F.lit('"')))
    made = F.concat(F.lit('{"id":'), F.col("c_custkey").cast("string"), seg, F.lit("}"))
    return t(spark, sf_dir, "customer").select(F.lit("customer").alias("src"), F.col("c_custkey").alias("record_idx"), F.parse_json(made).alias("rec"))


def long(name: str):
    return field(F.col("rec"), name).cast("long").alias(name)


def string(name: str):
    return F.variant_get("rec", f'$["{name}"]', "string").alias(name)


# Projection and output -----------------------------------------------------------------------------------------------


@query("SELECT event_id AS record_idx, user_id, event_type FROM events")
def project_two_fields(spark, sf_dir):
    recs = from_rows(t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), "events", F.col("event_id"))
    return project.project(recs, ["user_id", "event_type"]).select("record_idx", long("user_id"), string("event_type"))


@query(f"SELECT event_id AS record_idx, concat('{{\"user_id\":', user_id::VARCHAR, CASE WHEN v IS NULL THEN '' ELSE concat(',\"v\":', v) END, '}}') AS json FROM (SELECT *, {DRIFT.format(s='VARCHAR')} AS v FROM events)")
def project_json(spark, sf_dir):
    return project.project(drifted(spark, sf_dir), ["v", "user_id", "none"]).select("record_idx", F.to_json("rec").alias("json"))


@query("SELECT event_id AS record_idx, '{}' AS json FROM events")
def project_nothing_there(spark, sf_dir):
    return project.project(drifted(spark, sf_dir), ["none"]).select("record_idx", F.to_json("rec").alias("json"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice::DECIMAL(18,2) AS o_totalprice FROM orders")
def roundtrip_full(spark, sf_dir):
    return orders(spark, sf_dir).select(long("o_orderkey"), long("o_custkey"), string("o_orderstatus"), string("o_orderpriority"), field(F.col("rec"), "o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))


@query("SELECT event_id AS record_idx, CASE event_id % 8 WHEN 0 THEN 'absent' WHEN 1 THEN 'null' ELSE 'value' END AS state FROM events")
def absent_vs_null(spark, sf_dir):
    v = field(F.col("rec"), "v")
    return drifted(spark, sf_dir).select("record_idx", F.when(v.isNull(), "absent").when(F.is_variant_null(v), "null").otherwise("value").alias("state"))


_CELL = "CASE WHEN regexp_matches({c}, '[,\"\\n]') THEN concat('\"', replace({c}, '\"', '\"\"'), '\"') ELSE {c} END"


@query(f"SELECT doc_id AS record_idx, concat({_CELL.format(c='text')}, ',', {_CELL.format(c='source')}, ',', n_chars::VARCHAR, ',') AS line FROM documents")
def csv_cells(spark, sf_dir):
    recs = from_rows(t(spark, sf_dir, "documents").select("text", "source", "n_chars", "doc_id"), "documents", F.col("doc_id"))
    return project.csv_lines(recs, ["text", "source", "n_chars", "none"]).select("record_idx", "line")


@query("SELECT c_custkey AS record_idx, CASE WHEN c_custkey % 3 = 1 THEN 'null' ELSE c_mktsegment END AS line FROM customer WHERE c_custkey % 3 <> 0")
def cat_field(spark, sf_dir):
    return project.values(customers(spark, sf_dir), "seg").select("record_idx", project.value_text(F.col("value"), "csv").alias("line"))


@query(f"SELECT o_orderkey AS record_idx, o_orderstatus AS line FROM orders WHERE o_orderkey // {BLOCK} BETWEEN 1 AND 2")
def cat_block_range(spark, sf_dir):
    low, high = inspect.parse_range("2-3", 10**9)
    return project.values(inspect.block_range(orders(spark, sf_dir), low, high), "o_orderstatus").select("record_idx", project.value_text(F.col("value"), "csv").alias("line"))


@query("SELECT c_custkey AS record_idx, concat('{\"id\":', c_custkey::VARCHAR, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ',\"seg\":null' ELSE concat(',\"seg\":\"', c_mktsegment, '\"') END, '}') AS line FROM customer")
def ndjson_lines(spark, sf_dir):
    return project.ndjson_lines(customers(spark, sf_dir)).select("record_idx", "line")


@query("""SELECT concat('[', string_agg(concat('{"r_name":"', r_name, '","r_regionkey":', r_regionkey::VARCHAR, '}'), ',' ORDER BY r_regionkey), ']') AS json FROM region""")
def json_array_sink(spark, sf_dir):
    recs = from_rows(t(spark, sf_dir, "region"), "region", F.col("r_regionkey"))
    return spark.createDataFrame([("".join(project.json_array_text(project.ndjson_lines(recs))),)], "json string")


# Blocks and inspection -----------------------------------------------------------------------------------------------


@query(f"SELECT i // {BLOCK} AS block_idx, count(*) AS n, min(i) AS first, max(i) AS last FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem) GROUP BY 1")
def block_assign(spark, sf_dir):
    recs = from_rows(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "lineitem", order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return blocks.by_count(recs, BLOCK).groupBy("block_idx").agg(F.count("*").alias("n"), F.min("record_idx").alias("first"), F.max("record_idx").alias("last"))


#: Of the columns of block_greedy, o_orderpriority grows fastest, so that its segment is full first; SEGMENT holds fewer
#: records than FEW where priorities are long, and more where they are short.
SEGMENT, FEW = 4096, 420


@query(f"""WITH RECURSIVE o AS (SELECT i, o_orderkey, sum(n) OVER (ORDER BY i) AS s FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_orderkey, 1 + strlen(o_orderpriority) AS n FROM orders)),
ends AS (SELECT a.i AS first, max(b.i) AS last FROM (SELECT i, o_orderkey, lag(s, 1, 0) OVER (ORDER BY i) AS base FROM o) a JOIN o b ON b.i >= a.i AND b.i < a.i + {FEW}
  AND b.s - a.base + (b.i - a.i + 8) // 8 + (3 * (b.i - a.i + 1) + 7) // 8 <= {SEGMENT} GROUP BY a.i),
cut(block_idx, first, last, by_field) AS (SELECT 0::BIGINT, first, last, false FROM ends WHERE first = 1
  UNION ALL SELECT block_idx + 1, ends.first, ends.last, cut.last - cut.first + 1 < {FEW} FROM cut JOIN ends ON ends.first = cut.last + 1)
SELECT block_idx, last - first + 1 AS n, o_orderkey AS first, CASE WHEN by_field THEN 'o_orderpriority' END AS cut_by FROM cut JOIN o ON o.i = cut.first""")
def block_greedy(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    cut = blocks.greedy(from_rows(rows, "orders", F.col("o_orderkey")), FEW, Limits(segment_bytes=SEGMENT))
    return cut.groupBy("block_idx").agg(F.count("*").alias("n"), F.min("record_idx").alias("first"), F.max("cut_by").alias("cut_by"))


@query(f"SELECT event_id // {BLOCK} + 1 AS block, count(*) AS record_count, (2 + max((event_id % 8 <> 0)::INT))::BIGINT AS field_count FROM events GROUP BY 1")
def ls_blocks(spark, sf_dir):
    return inspect.blocks(blocks.by_count(drifted(spark, sf_dir), BLOCK))


@query(f"SELECT event_id // {BLOCK} + 1 AS block, field, count(*) AS present_count FROM events, (VALUES ('event_id'), ('user_id'), ('v')) f(field) WHERE field <> 'v' OR event_id % 8 <> 0 GROUP BY 1, 2")
def ls_field_directory(spark, sf_dir):
    return inspect.field_directory(blocks.by_count(drifted(spark, sf_dir), BLOCK))


#: A row for each field that an event's record has, with its tag.
_EVENT_CELLS = f"""SELECT event_id, field, tag FROM (SELECT event_id, unnest(['event_id', 'user_id', 'v']) AS field, unnest(['int', 'int', {DRIFT_TAG}]) AS tag FROM events) WHERE tag IS NOT NULL"""


@query(f"SELECT DISTINCT field FROM ({_EVENT_CELLS})")
def fields_only(spark, sf_dir):
    return inspect.fields(drifted(spark, sf_dir))


def _stats(sample: int | None) -> str:
    keep = "true" if sample is None else f"rn <= {sample}"
    kinds = ", ".join(f"count(*) FILTER ({keep} AND tag = '{k}') AS {'null_count' if k == 'null' else 'n_' + k}" for k in tags.TAGS)
    return f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY event_id) AS rn FROM ({_EVENT_CELLS}))
SELECT field, (SELECT count(*) FROM events) AS total_records, count(*) AS present, (SELECT count(*) FROM events) - count(*) AS absent, {kinds},
  count(*) FILTER ({keep}) AS sample_size, count(*) FILTER ({keep}) < count(*) AS sampled FROM c GROUP BY field"""


@query(_stats(None))
def field_stats(spark, sf_dir):
    return inspect.field_stats(drifted(spark, sf_dir))


@query(_stats(5003))
def field_stats_sampled(spark, sf_dir):
    return inspect.field_stats(drifted(spark, sf_dir), 5003)


@query(f"SELECT field FROM ({_EVENT_CELLS}) GROUP BY field ORDER BY count(*) DESC, field DESC LIMIT 1")
def most_populated(spark, sf_dir):
    return spark.createDataFrame([(inspect.most_populated(inspect.field_stats(drifted(spark, sf_dir))),)], "field string")


@query(f"SELECT event_id AS record_idx, {DRIFT_TAG} AS tag, CASE event_id % 8 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 5 WHEN 7 THEN 6 END AS code, CASE event_id % 8 WHEN 1 THEN 'null' WHEN 2 THEN 'boolean' WHEN 3 THEN 'number' WHEN 4 THEN 'number' WHEN 5 THEN 'string' WHEN 6 THEN 'object' WHEN 7 THEN 'array' END AS name FROM events")
def type_tags(spark, sf_dir):
    v = field(F.col("rec"), "v")
    return drifted(spark, sf_dir).select("record_idx", tags.tag(v).alias("tag"), tags.tag_code(v).alias("code"), tags.json_type(v).alias("name"))


# Encoding decisions --------------------------------------------------------------------------------------------------


def _order_strings(spark, sf_dir):
    rows = cells(orders(spark, sf_dir), ["block_idx", "record_idx"])
    return rows.where(tags.tag(F.col("value")) == "string").select("block_idx", "record_idx", "field", F.col("value").cast("string").alias("v"))


def _order_ints(spark, sf_dir):
    rows = cells(orders(spark, sf_dir), ["block_idx", "record_idx"])
    return rows.where(F.col("field").isin("o_orderkey", "o_custkey")).select("block_idx", "record_idx", "field", F.col("value").cast("long").alias("v"))


_STRINGS = f"(SELECT o_orderkey // {BLOCK} AS block_idx, o_orderkey AS record_idx, field, v FROM (UNPIVOT (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders) ON o_orderstatus, o_orderpriority INTO NAME field VALUE v))"
_INTS = f"(SELECT o_orderkey // {BLOCK} AS block_idx, o_orderkey AS record_idx, 'o_orderkey' AS field, o_orderkey AS v FROM orders UNION ALL SELECT o_orderkey // {BLOCK}, o_orderkey, 'o_custkey', o_custkey FROM orders)"


@query(f"SELECT block_idx, field, count(*) AS n, count(DISTINCT v) AS \"distinct\", count(DISTINCT v) <= least(4096, greatest(2, count(*) // 8)) AS use_dict FROM {_STRINGS} GROUP BY 1, 2")
def dict_decision(spark, sf_dir):
    return encoding.dictionary_decision(_order_strings(spark, sf_dir), ["block_idx", "field"])


@query(f"SELECT block_idx, field, v, row_number() OVER (PARTITION BY block_idx, field ORDER BY first) - 1 AS entry FROM (SELECT block_idx, field, v, min(record_idx) AS first FROM {_STRINGS} GROUP BY ALL)")
def dict_entries(spark, sf_dir):
    return encoding.dictionary(_order_strings(spark, sf_dir), ["block_idx", "field"])


@query(f"""SELECT block_idx, field, count(*) AS n, count(*) >= 2 AND coalesce(min(d) > 0, false) AND coalesce(2 * (max(d) - min(d)) < max(v) - min(v), false) AS use_delta
FROM (SELECT *, v - lag(v) OVER (PARTITION BY block_idx, field ORDER BY record_idx) AS d FROM {_INTS}) GROUP BY 1, 2""")
def delta_decision(spark, sf_dir):
    return encoding.delta_decision(_order_ints(spark, sf_dir), ["block_idx", "field"])


@query(f"SELECT block_idx, record_idx, field, v - coalesce(lag(v) OVER (PARTITION BY block_idx, field ORDER BY record_idx), 0) AS delta FROM {_INTS}")
def delta_values(spark, sf_dir):
    return encoding.deltas(_order_ints(spark, sf_dir), ["block_idx", "field"]).select("block_idx", "record_idx", "field", F.col("delta").cast("long").alias("delta"))


@query("SELECT l_orderkey, l_linenumber, v, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS z, v AS back FROM (SELECT l_orderkey, l_linenumber, l_partkey - l_suppkey * 7 AS v FROM lineitem)")
def zigzag(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") - F.col("l_suppkey") * 7).alias("v"))
    return rows.withColumn("z", scalars.zigzag(F.col("v"))).withColumn("back", scalars.unzigzag(F.col("z")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, greatest(1, (length(bin(u)) + 6) // 7)::INTEGER AS n FROM (SELECT *, l_partkey * l_partkey * 1000 AS u FROM lineitem)")
def uleb_len(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.uleb_length(F.col("l_partkey") * F.col("l_partkey") * 1000).alias("n"))


def _uleb(x: str) -> str:
    return f"greatest(1, (length(bin({x})) + 6) // 7)"


@query(f"""WITH c AS (SELECT o_orderkey // {BLOCK} AS block_idx, o_orderkey, o_custkey, o_orderstatus, o_orderpriority, count(*) OVER (PARTITION BY o_orderkey // {BLOCK}) AS r FROM orders),
s AS (SELECT block_idx, 'o_orderkey' AS field, {_uleb('2 * o_orderkey')} AS n, r FROM c UNION ALL SELECT block_idx, 'o_custkey', {_uleb('2 * o_custkey')}, r FROM c
UNION ALL SELECT block_idx, 'o_orderstatus', 1 + strlen(o_orderstatus), r FROM c UNION ALL SELECT block_idx, 'o_orderpriority', 1 + strlen(o_orderpriority), r FROM c)
SELECT block_idx, field, ((max(r) + 7) // 8 + (3 * count(*) + 7) // 8 + sum(n))::BIGINT AS size FROM s GROUP BY 1, 2""")
def segment_estimate(spark, sf_dir):
    recs = orders(spark, sf_dir)
    recs = recs.withColumn("rec", F.to_variant_object(F.map_filter(F.col("rec").cast("map<string,variant>"), lambda k, _: k != "o_totalprice")))
    n = recs.groupBy("block_idx").agg(F.count("*").alias("records_in_block"))
    return blocks.segment_sizes(recs.join(n, "block_idx"), ["block_idx"])


@query("SELECT event_id AS record_idx, concat('{\"a\":[1,', user_id::VARCHAR, '],\"p\":', props, '}') AS json FROM (SELECT event_id, user_id, replace(props, ' ', '') AS props FROM events)")
def minify_nested(spark, sf_dir):
    made = F.concat(F.lit('{ "p" : '), "props", F.lit(' ,\n "a" : [ 1 , '), F.col("user_id").cast("string"), F.lit(" ] }"))
    return t(spark, sf_dir, "events").select(F.col("event_id").alias("record_idx"), tags.minified(F.parse_json(made)).alias("json"))


@query("SELECT event_id AS record_idx, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def nested_path(spark, sf_dir):
    return t(spark, sf_dir, "events").select(F.col("event_id").alias("record_idx"), F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


@query("SELECT p_partkey, CASE WHEN contains(s, '.') THEN rtrim(rtrim(s, '0'), '.') ELSE s END AS canonical FROM (SELECT p_partkey, (p_retailprice::DECIMAL(18,4))::VARCHAR AS s FROM part)")
def decimal_canonical(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", scalars.plain_decimal(F.col("p_retailprice").cast("decimal(18,4)").cast("string")).alias("canonical"))


@query("SELECT * FROM (VALUES (0::BIGINT, 5::BIGINT, 1000::BIGINT), (10000, 0, 1000), (10000, 67108864, 9000), (1000000, 6710886, 9000001), (500, 671088640, 1000)) t(records, largest, size)")
def recommended_block_size(spark, sf_dir):
    rows = [(n, m, scalars.recommended_block_size(n, 64 << 20, m)) for n, m in ((0, 5), (10_000, 0), (10_000, 64 << 20), (1_000_000, 6_710_886), (500, 671_088_640))]
    return spark.createDataFrame(rows, "records long, largest long, size long")


# Reshaping -----------------------------------------------------------------------------------------------------------


def per_region(spark, sf_dir, before: str, after: str, item=None, sep: str = ",") -> DataFrame:
    """(src, value): a document for each region around its nations, in the order of their keys."""
    item = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))) if item is None else item
    rows = t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", item.alias("j")))).alias("a"))
    body = F.array_join(F.transform("a", lambda x: x["j"]), sep)
    return rows.select(F.col("n_regionkey").cast("string").alias("src"), F.concat(F.lit(before), body, F.lit(after)).alias("value"))


_NATIONS = "SELECT n_regionkey::VARCHAR AS src, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS record_idx, n_nationkey::BIGINT AS id, n_name AS name FROM nation"


@query(_NATIONS)
def pointer_extract(spark, sf_dir):
    return wrappers.pointer(per_region(spark, sf_dir, '{"data":{"items":[', ']},"page":1}'), "/data/items").select("src", "record_idx", long("id"), string("name"))


@query(_NATIONS)
def pointer_escaped(spark, sf_dir):
    return wrappers.pointer(per_region(spark, sf_dir, '{"a/b":{"c~d":[', "]}}"), "/a~1b/c~0d").select("src", "record_idx", long("id"), string("name"))


@query(f"SELECT src, 0::BIGINT AS record_idx, id, name FROM ({_NATIONS}) WHERE record_idx = 0")
def pointer_object(spark, sf_dir):
    return wrappers.pointer(per_region(spark, sf_dir, '{"list":[', "]}"), "/list/0").select("src", "record_idx", long("id"), string("name"))


@query(f"SELECT src, 0::BIGINT AS record_idx, id, name FROM ({_NATIONS}) WHERE record_idx = 1")
def pointer_index(spark, sf_dir):
    return wrappers.pointer(per_region(spark, sf_dir, "[", "]"), "/1").select("src", "record_idx", long("id"), string("name"))


_SECTIONS = f"SELECT src, id, name, '{{label}}' AS section FROM ({_NATIONS}) WHERE record_idx {{op}} 2"


def _two_sections(spark, sf_dir):
    rows = t(spark, sf_dir, "nation").withColumn("r", F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")))
    item = F.struct("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("j"))
    part = lambda c, a: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, item))), lambda x: x["j"]), ",").alias(a)
    rows = rows.groupBy("n_regionkey").agg(part(F.col("r") <= 2, "x"), part(F.col("r") > 2, "y"))
    return rows.select(F.col("n_regionkey").cast("string").alias("src"), F.concat(F.lit('{"old":['), "x", F.lit('],"deep":{"new":['), "y", F.lit("]}}")).alias("value"))


@query(f"{_SECTIONS.format(label='old', op='<')} UNION ALL {_SECTIONS.format(label='new', op='>=')}")
def sections_concat(spark, sf_dir):
    return wrappers.sections(_two_sections(spark, sf_dir), ["old", "new=/deep/new"]).select("src", long("id"), string("name"), string("_section").alias("section"))


@query(f"SELECT src, record_idx, id, name, 'first' AS origin FROM ({_NATIONS}) WHERE record_idx < 2")
def sections_missing_skip(spark, sf_dir):
    specs = [wrappers.Section("none"), wrappers.Section("old", label="first")]
    return wrappers.sections(_two_sections(spark, sf_dir), specs, label_field="origin").select("src", "record_idx", long("id"), string("name"), string("origin"))


@query("SELECT section, count(*) AS records FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) <= 2 THEN 'old' ELSE 'new' END AS section FROM nation) GROUP BY 1")
def section_counts(spark, sf_dir):
    return wrappers.metrics(wrappers.sections(_two_sections(spark, sf_dir), ["old", "new=/deep/new"]))


_BY_NAME = "SELECT n_regionkey::VARCHAR AS src, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS record_idx, n_name AS \"_key\", n_nationkey::BIGINT AS id{more} FROM nation"


@query(_BY_NAME.format(more=""))
def keyed_map(spark, sf_dir):
    item = F.concat(F.lit('"'), "n_name", F.lit('":{"id":'), F.col("n_nationkey").cast("string"), F.lit("}"))
    return wrappers.keyed_map(per_region(spark, sf_dir, "{", "}", item)).select("src", "record_idx", string("_key"), long("id"))


@query(_BY_NAME.format(more=""))
def keyed_map_overwrite(spark, sf_dir):
    item = F.concat(F.lit('"'), "n_name", F.lit('":{"_key":0,"id":'), F.col("n_nationkey").cast("string"), F.lit("}"))
    return wrappers.keyed_map(per_region(spark, sf_dir, '{"m":{', "}}", item), "/m", overwrite=True).select("src", "record_idx", string("_key"), long("id"))


@query(_NATIONS)
def array_headers(spark, sf_dir):
    item = F.concat(F.lit("["), F.col("n_nationkey").cast("string"), F.lit(',"'), "n_name", F.lit('"]'))
    return wrappers.array_headers(per_region(spark, sf_dir, '[["id","name"],', "]", item)).select("src", "record_idx", long("id"), string("name"))


def _turns(docs: DataFrame, config: dict, limits) -> DataFrame:
    rec = F.to_json(F.struct(F.col("src").alias("conversation"), F.upper("value").alias(config["field"])))
    return docs.select("src", F.lit(0).cast("long").alias("record_idx"), F.parse_json(rec).alias("rec"))


@query("SELECT conv_id::VARCHAR AS conversation, upper(role) AS who FROM conversations")
def plugin_wrapper(spark, sf_dir):
    name = "shout"
    if name not in {p.name for p in wrappers.plugins()}:
        wrappers.register(wrappers.Plugin(name, _turns))
    docs = t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("src"), F.col("role").alias("value"))
    return wrappers.plugin(docs, name, {"field": "who"}).select(string("conversation"), string("who"))


# Scans, archives -----------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('[1]', 'a.json', 'json_array'), (' [', 'a.ndjson', 'json_array'), ('{', 'a.json', 'json_array'), ('{', 'a.jsonl', 'ndjson'), ('{', 'a.txt', 'ndjson'), ('x', 'a.json', 'ndjson')) t(head, name, hint)")
def container_hint(spark, sf_dir):
    rows = spark.createDataFrame([("[1]", "a.json"), (" [", "a.ndjson"), ("{", "a.json"), ("{", "a.jsonl"), ("{", "a.txt"), ("x", "a.json")], "head string, name string")
    return rows.withColumn("hint", text.container_hint(F.col("head"), F.col("name")))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS record_idx FROM orders")
def ndjson_scan(spark, sf_dir):
    path = scratch(spark, "ndjson", ".ndjson")
    project.write_file(t(spark, sf_dir, "orders").select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("record_idx"), F.to_json(F.struct("o_orderkey", "o_custkey")).alias("line")), path)
    return text.read_ndjson(spark, path).select(long("o_orderkey"), long("o_custkey"), "record_idx")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def json_array_scan(spark, sf_dir):
    path = scratch(spark, "array")
    per_region(spark, sf_dir, "[", "]").select("value").write.option("lineSep", "\x00").text(path)
    docs = text.read_whole(spark, path).select("src", F.explode(F.split("value", "\x00")).alias("value")).where("value <> ''")
    return text.array_records(docs).select(long("id"), string("name"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice::DECIMAL(18,2) AS o_totalprice FROM orders")
def archive_roundtrip(spark, sf_dir):
    path = scratch(spark, "archive")
    archive.write(orders(spark, sf_dir), path, hint="ndjson")
    return archive.read(spark, path).select(long("o_orderkey"), long("o_custkey"), string("o_orderstatus"), field(F.col("rec"), "o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))


@query(f"SELECT o_orderkey // {BLOCK} AS block_idx, count(*) AS record_count, min(o_orderkey) AS first_idx, 'ndjson' AS container_format FROM orders GROUP BY 1")
def archive_manifest(spark, sf_dir):
    path = scratch(spark, "archive")
    archive.write(orders(spark, sf_dir), path, hint="ndjson")
    return archive.manifest(spark, path).select("block_idx", "record_count", "first_idx", "container_format")


@query(f"SELECT o_orderkey // {BLOCK} AS block_idx, row_number() OVER (ORDER BY o_orderkey) - 1 AS record_idx, o_orderkey, o_custkey, o_orderpriority, o_totalprice::DECIMAL(18,2) AS o_totalprice FROM orders")
def wire_roundtrip(spark, sf_dir):
    path = scratch(spark, "wire", ".arc")
    wire_source.write(orders(spark, sf_dir), path, hint="ndjson", canonicalNumbers=True)
    return wire_source.read(spark, path).select("block_idx", "record_idx", long("o_orderkey"), long("o_custkey"), string("o_orderpriority"), field(F.col("rec"), "o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))


@query(f"""WITH c AS (SELECT block_idx + 1 AS block, field, v FROM {_STRINGS})
SELECT block, field, count(*) AS present_count, CASE WHEN count(DISTINCT v) <= greatest(2, count(*) // 8) THEN count(DISTINCT v) ELSE 0 END AS dict_entries FROM c GROUP BY 1, 2
UNION ALL SELECT o_orderkey // {BLOCK} + 1, field, count(*), 0 FROM orders, (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice')) f(field) GROUP BY 1, 2""")
def wire_directory(spark, sf_dir):
    path = scratch(spark, "wire", ".arc")
    wire_source.write(orders(spark, sf_dir), path)
    return wire_source.describe(spark, path).select("block", "field", "present_count", "dict_entries")


@query(f"SELECT o_orderkey // {BLOCK} AS block_idx, o_custkey FROM orders WHERE o_orderkey // {BLOCK} = 1")
def wire_projection(spark, sf_dir):
    path = scratch(spark, "wire", ".arc")
    wire_source.write(orders(spark, sf_dir), path)
    return wire_source.read(spark, path, ["o_custkey"], firstBlock=1, lastBlock=1).select("block_idx", long("o_custkey"))


@query(f"SELECT field, count(*) AS blocks, sum(n)::BIGINT AS records FROM (SELECT o_orderkey // {BLOCK} AS b, count(*) AS n FROM orders GROUP BY 1), (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_orderpriority'), ('o_totalprice')) f(field) GROUP BY field")
def writer_metrics(spark, sf_dir):
    path = scratch(spark, "wire", ".arc")
    wire_source.write(orders(spark, sf_dir), path)
    return wire_source.writer_metrics(spark, path).select("field", "blocks", "records")


@query(f"""SELECT event_id AS record_idx, {_CELL.format(c="v")} AS line FROM (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 5 THEN event_type ELSE {DRIFT.format(s="VARCHAR")} END AS v FROM events)""")
def csv_of_every_kind(spark, sf_dir):
    return project.csv_lines(drifted(spark, sf_dir), ["v"]).select("record_idx", "line")


# Strict scans, files, and the interchange format over fields that are absent, null or of any kind ---------------------


@query("SELECT record_idx, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS record_idx FROM orders) WHERE o_orderkey % 7 > 3")
def ndjson_strict(spark, sf_dir):
    """Of seven lines, one has text after its object, one holds two objects, one no object, one ends early."""
    path, one, k = scratch(spark, "strict", ".ndjson"), F.to_json(F.struct("o_orderkey")), F.col("o_orderkey") % 7
    bad = F.when(k == 0, F.concat(one, F.lit(" trailing"))).when(k == 1, F.concat(one, one)).when(k == 2, F.concat(F.lit("["), one, F.lit("]"))).when(k == 3, F.expr("left(to_json(struct(o_orderkey)), 9)"))
    project.write_file(t(spark, sf_dir, "orders").select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("record_idx"), F.coalesce(bad, one).alias("line")), path)
    return text.read_ndjson(spark, path, lenient=True).select("record_idx", long("o_orderkey"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_returnflag FROM lineitem)")
def json_array_large(spark, sf_dir):
    """One file with one array, split in chunks that cut elements anywhere."""
    path = scratch(spark, "large", ".json")
    rows = t(spark, sf_dir, "lineitem").select(F.lit("s").alias("src"), F.lit(0).alias("record_idx"), F.to_json(F.struct("l_orderkey", "l_linenumber", "l_returnflag")).alias("line"))
    project.write_file(rows, path, array=True)
    return text.read_json_array(spark, path, chunk=1000).select(long("l_orderkey"), long("l_linenumber"), string("l_returnflag"))


@query(f"""SELECT concat({_CELL.format(c="name")}, ',', c_custkey::VARCHAR) AS line FROM (SELECT c_custkey, concat(c_name, ', "', c_mktsegment, '"') AS name FROM customer)""")
def csv_file_sink(spark, sf_dir):
    path = scratch(spark, "csv")
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("name"))
    project.write_lines(project.csv_lines(from_rows(rows, "customer", F.col("c_custkey")), ["name", "c_custkey"]), path, header="name,c_custkey")
    return spark.read.text(path).where("value <> 'name,c_custkey'").withColumnRenamed("value", "line")


@query(f"SELECT event_id // {BLOCK} AS block_idx, concat('{{\"event_id\":', event_id::VARCHAR, ',\"user_id\":', user_id::VARCHAR, CASE WHEN v IS NULL THEN '' ELSE concat(',\"v\":', v) END, '}}') AS json FROM (SELECT *, {DRIFT.format(s='VARCHAR')} AS v FROM events)")
def wire_every_kind(spark, sf_dir):
    path = scratch(spark, "wire", ".arc")
    wire_source.write(blocks.by_count(drifted(spark, sf_dir), BLOCK), path, hint="ndjson")
    return wire_source.read(spark, path).select("block_idx", F.to_json("rec").alias("json"))


@query(f"""SELECT event_id // {BLOCK} + 1 AS block, field, count(*) AS present_count, any_value(r) AS records,
  CASE WHEN field = 'v' AND count(DISTINCT s) > 0 AND count(DISTINCT s) <= greatest(2, count(s) // 8) THEN count(DISTINCT s) ELSE 0 END AS dict_entries
FROM (SELECT c.event_id, field, CASE WHEN tag = 'string' THEN event_type END AS s, count(DISTINCT c.event_id) OVER (PARTITION BY c.event_id // {BLOCK}) AS r FROM ({_EVENT_CELLS}) c JOIN events USING (event_id)) GROUP BY 1, 2""")
def wire_every_kind_directory(spark, sf_dir):
    path = scratch(spark, "wire", ".arc")
    wire_source.write(blocks.by_count(drifted(spark, sf_dir), BLOCK), path)
    return wire_source.describe(spark, path).select("block", "field", "present_count", "records", "dict_entries")


@query(f"SELECT event_id AS record_idx, {DRIFT.format(s='VARCHAR')} AS line FROM events WHERE event_id % 8 <> 0 AND event_id // 250 BETWEEN 1 AND 2")
def wire_cat_blocks(spark, sf_dir):
    """One field of two blocks, without unpacking the others."""
    path = scratch(spark, "wire", ".arc")
    wire_source.write(blocks.by_count(drifted(spark, sf_dir), 250), path)
    rows = wire_source.read(spark, path, ["v"], firstBlock=1, lastBlock=2)
    start = t(spark, sf_dir, "events").agg(F.min("event_id").alias("start"))
    return project.values(rows, "v").join(F.broadcast(start)).select((F.col("record_idx") + F.col("start")).alias("record_idx"), project.value_text(F.col("value")).alias("line"))


@query("SELECT n_regionkey::VARCHAR AS region, count(*) AS nations, min(n_name) AS first FROM nation GROUP BY 1")
def single_object_scan(spark, sf_dir):
    """Files that hold one object each, over several lines."""
    path = scratch(spark, "objects")
    docs = per_region(spark, sf_dir, "[\n", "\n]", sep=",\n")
    docs.select(F.concat(F.lit('{"region":"'), "src", F.lit('",\n "items":'), "value", F.lit("}\n")).alias("value")).repartition(5, "value").write.option("maxRecordsPerFile", 1).text(path)
    items = F.variant_get("rec", "$.items", "array<struct<id bigint, name string>>")
    return text.read_json_array(spark, path).select(string("region"), F.size(items).cast("long").alias("nations"), F.array_min(F.transform(items, lambda x: x["name"])).alias("first"))


_WIRED = f"SELECT o_orderkey // {BLOCK} AS block_idx, o_orderkey, o_custkey, o_orderpriority FROM orders"


@query(_WIRED)
def wire_sequential(spark, sf_dir):
    """Without an index, blocks are walked one after the other."""
    path = scratch(spark, "wire", ".arc")
    wire_source.write(orders(spark, sf_dir), path, index=False)
    return wire_source.read(spark, path).select("block_idx", long("o_orderkey"), long("o_custkey"), string("o_orderpriority"))


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey // {BLOCK} <> 1")
def wire_resync(spark, sf_dir):
    """The second block's header is broken; a permissive reader goes on at the third."""
    path = scratch(spark, "wire", ".arc")
    wire_source.write(orders(spark, sf_dir), path, index=False)
    at = wire_source.block_table(path)[1][0]
    broken = scratch(spark, "wire", ".arc")
    (fs, name), (_, target) = place(path), place(broken)
    with fs.open_input_file(name) as f, fs.open_output_stream(target) as out:
        for low, high in ((0, at), (at + 4, f.size())):
            f.seek(low)
            while low < high and (data := f.read(min(wire_source.COPIED, high - low))):
                out.write(data)
                low += len(data)
            out.write(bytes(4) * (high == at))
    return wire_source.read(spark, broken, mode="PERMISSIVE").select(long("o_orderkey"), long("o_custkey"))


@query("SELECT p_partkey, CASE WHEN cents % 25 = 0 THEN p_retailprice END AS exact FROM (SELECT p_partkey, p_retailprice, (p_retailprice::DECIMAL(18,2) * 100)::BIGINT AS cents FROM part)")
def exact_doubles(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", scalars.exact_double(F.col("p_retailprice").cast("decimal(18,2)").cast("string")).alias("exact"))


@query("SELECT event_id, replace(replace(concat(event_type, '/~', user_id::VARCHAR), '~', '~0'), '/', '~1') AS escaped, concat(event_type, '/~', user_id::VARCHAR) AS back FROM events")
def escaped_tokens(spark, sf_dir):
    raw = F.concat("event_type", F.lit("/~"), F.col("user_id").cast("string"))
    return t(spark, sf_dir, "events").select("event_id", scalars.escape_token(raw).alias("escaped"), scalars.unescape_token(scalars.escape_token(raw)).alias("back"))


@query("SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN printf('%.1fG', n / 1073741824) WHEN n >= 1048576 THEN printf('%.1fM', n / 1048576) WHEN n >= 1024 THEN printf('%.1fK', n / 1024) ELSE concat(n::VARCHAR, 'B') END AS size FROM (SELECT o_orderkey, o_custkey * o_custkey * 4 AS n FROM orders)")
def sizes_as_text(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", scalars.size_text(F.col("o_custkey") * F.col("o_custkey") * 4).alias("size"))


@query("""SELECT event_id AS record_idx, 15 + length(event_id::VARCHAR) + length(user_id::VARCHAR) + CASE event_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 + length(event_id::VARCHAR)
  WHEN 4 THEN 3 + length(event_id::VARCHAR) WHEN 5 THEN 1 + strlen(event_type) WHEN 6 THEN 10 + length(user_id::VARCHAR) ELSE 9 + length(user_id::VARCHAR) END AS bytes FROM events""")
def record_memory(spark, sf_dir):
    return drifted(spark, sf_dir).select("record_idx", blocks.memory(F.col("rec")).alias("bytes"))


@query("SELECT 'sections' AS mode, 5::BIGINT AS documents, 25::BIGINT AS records, section, n FROM (SELECT section, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) <= 2 THEN 'old' ELSE 'new' END AS section FROM nation) GROUP BY 1)")
def reshaping_metrics(spark, sf_dir):
    got = wrappers.run_metrics(_two_sections(spark, sf_dir), section_specs=["old", "new=/deep/new"])
    return got.select("mode", "documents", "records", F.explode("sections").alias("section", "n"))


@query("SELECT * FROM (VALUES ('auto', 'json_array', 'json_array'), ('auto', 'ndjson', 'ndjson'), ('auto', 'unknown', 'ndjson'), ('ndjson', 'json_array', 'ndjson'), ('json_array', 'ndjson', 'json_array')) t(asked, hint, style)")
def auto_format(spark, sf_dir):
    """The format of output, with the hint that an archive of events was given."""
    rows = []
    for asked, hint in (("auto", "json_array"), ("auto", "ndjson"), ("auto", "unknown"), ("ndjson", "json_array"), ("json_array", "ndjson")):
        path = scratch(spark, "wire", ".arc")
        wire_source.write(blocks.by_count(customers(spark, sf_dir), BLOCK), path, hint=hint)
        with wire_source.File(path) as f:
            rows.append((asked, hint, project.resolve_format(asked, f.header()[0].hint)))
    return spark.createDataFrame(rows, "asked string, hint string, style string")
