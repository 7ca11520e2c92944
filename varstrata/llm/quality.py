"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

A sketch is a histogram over integer buckets of bounded relative width (values below 64 exactly, above that six
significant bits), so sketches merge by adding counts, do not depend on the order of rows or on partitions, and hold
at most some hundred buckets per metric however many rows they cover. Each document is measured once; the narrow
measurements are sketched per (lang, source) with map-side partial counts. To each group's sketch those of its language
and of the whole table are added with the weight of PRIOR rows each: a group of one row has nearly its language's
fences, a large one its own, and none is treated apart. Fences follow from the quantiles of the blend alone and are
joined back to the measurements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrata.llm.common import let, small_join, stash, words_of

SYMBOLS = "#*$%&|<>"
#: Metrics, and the per cent at which their outer quantiles are read off a blended sketch: (lower or None without a lower
#: fence, upper). What sound texts hardly ever have is read nearer to the middle, so that more rows of a group may be bad.
#: Shares are per mille of the characters in words (of the words for repeat_share); word_len is in tenths of a character.
METRICS: dict[str, tuple[int | None, int]] = {"symbol_share": (None, 85), "upper_share": (None, 90), "bang_share": (None, 85), "repeat_share": (None, 93), "word_len": (10, 90)}
#: A fence lies SPREADS times the distance from the median to the outer quantile beyond the outer quantile, and one
#: bucket beyond it at least.
MIDDLE, SPREADS = 50, 8
#: Rows that the sketches of the language and of the whole table count for in a group's blend.
PRIOR = 100
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _count(text: Column, chars: str) -> Column:
    """How many characters of a class of characters text holds: what is left when runs of all others are cut out."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _repeated(words: Column) -> Column:
    """Words that lie in a three-word window which occurs twice or more. Most texts have windows of distinct hashes alone,
    and none. In the others windows are sorted by hash, neighbours with equal hashes are compared word by word, and the
    positions that they cover are counted."""

    def same(s: Column, j: Column) -> Column:
        a, b = s[j - 1], s[j]
        return (a["h"] == b["h"]) & (words[a["i"]] == words[b["i"]]) & (words[a["i"] + 1] == words[b["i"] + 1]) & (words[a["i"] + 2] == words[b["i"] + 2])

    def covered(hashes: Column) -> Column:
        windows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(windows, lambda s: F.flatten(F.transform(F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda j: same(s, j)), lambda j: F.array(*[s[j - k]["i"] + d for k in (0, 1) for d in (0, 1, 2)]))))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.size(F.array_distinct(covered(h)))))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(count)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column m of counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (base) and
    n_upper, n_bangs. Null text counts as empty."""
    t = F.coalesce(docs[text], F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return docs.withColumn(
        "m",
        let(
            words_of(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _count(t, SYMBOLS).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                _repeated(w).cast("long").alias("n_repeat_words"),
                _count(t, "A-Z").cast("long").alias("n_upper"),
                (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
            ),
        ),
    )


def metrics_of(m: Column) -> dict[str, Column]:
    """The integer metrics of METRICS from the counts; a document without words measures 0 everywhere."""
    chars, words = F.greatest(m["word_chars"], F.lit(1)), F.greatest(m["n_words"], F.lit(1))
    share = lambda n, of: F.floor(1000 * m[n] / of).cast("long")
    return {
        "symbol_share": share("n_symbols", chars),
        "upper_share": share("n_upper", chars),
        "bang_share": share("n_bangs", chars),
        "repeat_share": share("n_repeat_words", words),
        "word_len": F.floor(10 * m["word_chars"] / words).cast("long"),
    }


def bucket(v: Column) -> Column:
    """The lower end of v's bucket."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, bucket, n): one mergeable sketch per key and metric. rows carries the metrics as columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(F.col(k)).alias("bucket")) for k in METRICS]))
    return rows.select(*keys, pairs.alias("p")).groupBy(*keys, "p.metric", "p.bucket").agg(F.count("*").alias("n"))


def width(b: Column) -> Column:
    """How many values the bucket with lower end b holds."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(b)) - 6, F.lit(0)))


def _packed(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, rows, part): a row per sketch, its buckets as an array of (bucket, n)."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    return merged.groupBy(*keys, "metric").agg(F.sum("n").alias("rows"), F.collect_list(F.struct("bucket", "n")).alias("part"))


def _weighted(part: Column, rows: Column | None, prior: int) -> Column:
    """Counts in thousandths of a row: as they are, or scaled to prior rows in all."""
    n = (lambda x: x["n"] * 1000) if rows is None else (lambda x: F.call_function("div", x["n"] * (1000 * prior), rows))
    return F.transform(part, lambda x: F.struct(x["bucket"].alias("bucket"), n(x).alias("n")))


def _reached(blend: Column, total: Column, percent: Column) -> Column:
    """The first bucket of an ordered blend at which the cumulated count is percent of the total."""

    def step(acc: Column, x: Column) -> Column:
        below = acc["below"] + x["n"]
        return F.struct(below.alias("below"), F.coalesce(acc["at"], F.when(100 * below >= percent * total, x["bucket"])).alias("at"))

    return F.aggregate(blend, F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("at")), step)["at"]


def fence_rows(rows: DataFrame, spreads: int = SPREADS, prior: int = PRIOR) -> DataFrame:
    """(lang, source, metric, low, mid, high, lo, hi, floored): quantiles of each group's blend and its fences, null keys
    included; floored is whether the upper fence is as near as a bucket's width
    allows. low and lo are null without a lower fence."""
    own = stash(sketches(rows, ["lang", "source"]), "sketches")
    la = _packed(own, ["lang"]).select(F.col("lang").alias("la_lang"), F.col("metric").alias("la_metric"), F.col("rows").alias("la_rows"), F.col("part").alias("la_part"))
    al = _packed(own, []).select(F.col("metric").alias("al_metric"), F.col("rows").alias("al_rows"), F.col("part").alias("al_part"))
    joined = _packed(own, ["lang", "source"]).join(la, F.col("lang").eqNullSafe(F.col("la_lang")) & (F.col("metric") == F.col("la_metric"))).join(F.broadcast(al), F.col("metric") == F.col("al_metric"))
    parts = F.concat(_weighted(F.col("part"), None, prior), _weighted(F.col("la_part"), F.col("la_rows"), prior), _weighted(F.col("al_part"), F.col("al_rows"), prior))
    blend = joined.select("lang", "source", "metric", F.sort_array(parts).alias("blend"))
    blend = blend.withColumn("total", F.aggregate("blend", F.lit(0).cast("long"), lambda s, x: s + x["n"]))
    spec = F.create_map(*[x for k, (low, high) in METRICS.items() for x in (F.lit(k), F.array(F.lit(low).cast("int"), F.lit(MIDDLE), F.lit(high)))])
    blend = blend.withColumn("percent", spec[F.col("metric")])
    at = blend.select("lang", "source", "metric", *[_reached(F.col("blend"), F.col("total"), F.col("percent")[k]).alias(name) for k, name in enumerate(("low", "mid", "high"))])
    up, down = spreads * (F.col("high") - F.col("mid")), spreads * (F.col("mid") - F.col("low"))
    return at.select(
        "lang",
        "source",
        "metric",
        "low",
        "mid",
        "high",
        F.when(F.col("low").isNotNull(), F.col("low") - F.greatest(down, width(F.col("low")))).alias("lo"),
        (F.col("high") + F.greatest(up, width(F.col("high")))).alias("hi"),
        (up <= width(F.col("high"))).alias("floored"),
    )


def fences(rows: DataFrame, spreads: int = SPREADS, prior: int = PRIOR) -> DataFrame:
    """(lang, source, lo_<metric>, hi_<metric>): one row per group of rows."""
    fenced = fence_rows(rows, spreads, prior)
    return fenced.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == k, F.col(end))).alias(f"{end}_{k}") for k in METRICS for end in ("lo", "hi")])


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def within(values: dict[str, Column], fence) -> Column:
    """True if every metric lies within its fences."""
    ok = F.lit(True)
    for k, v in values.items():
        ok = ok & (v <= fence(f"hi_{k}"))
        if METRICS[k][0] is not None:
            ok = ok & (v >= fence(f"lo_{k}"))
    return ok


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, the metrics, base_failed and kept.

    docs needs doc_id, text, lang and source; other columns are ignored, whatever their names. Null or empty text has no
    words and fails the base. Null languages and sources form groups of their own. Repeated rows are judged alike. An
    empty table gives an empty result.
    """
    rows = measured(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "m")
    rows = stash(rows.select("doc_id", "lang", "source", "m.*", *[v.alias(k) for k, v in metrics_of(F.col("m")).items()]), "measured")
    # Documents that fail the base aren't what a group usually looks like, and don't count towards its sketch.
    m = {c: F.col(c) for c in rows.columns}
    cut = stash(fences(rows.where(~base_failed(m))), "fences").withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    on = F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    out = small_join(rows, cut, on).withColumn("base_failed", base_failed(m))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(within({k: F.col(k) for k in METRICS}, F.col), F.lit(True)))
    return out.withColumn("kept", kept).drop("f_lang", "f_source", *[f"{e}_{k}" for k in METRICS for e in ("lo", "hi")])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all columns of docs. Fences come from docs itself.

    The rows are written once beside their measurements, so that no text is measured twice: sketches and the filter read
    the narrow columns.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "lang", "source", "text")
    rows = stash(measured(packed).select("_row", "lang", "source", "m"), "measured")
    m = F.col("m")
    values = rows.where(~base_failed(m)).select("lang", "source", *[v.alias(k) for k, v in metrics_of(m).items()])
    cut = stash(fences(values), "fences").select(F.col("lang").alias("_f_lang"), F.col("source").alias("_f_source"), F.struct(*[f"{e}_{k}" for k in METRICS for e in ("lo", "hi")]).alias("_f"))
    on = F.col("lang").eqNullSafe(F.col("_f_lang")) & F.col("source").eqNullSafe(F.col("_f_source"))
    judged = small_join(rows.where(~base_failed(m)), cut, on)
    good = F.coalesce(within(metrics_of(m), lambda k: F.col("_f")[k]), F.lit(True))
    return judged.where(good).select("_row.*")
