import re
from collections import Counter

from varstrata.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = list(zip(w, w[1:], w[2:]))
    twice = {k for k, n in Counter(win).items() if n > 1}
    covered = {p for i, x in enumerate(win) if x in twice for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, odd, small):
    for docs in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        texts = {}
        for r in docs.collect():
            texts.setdefault(r["doc_id"], r["text"])
        for r in quality.judge(docs).collect():
            want = brute(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r["kept"] and r["base_failed"])


def test_fences_take_junk_and_leave_the_rest(spark, small):
    sf = small.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.2 * n[0, False]


def test_filter_agrees_with_judge(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == kept


def test_fences_follow_their_group(spark):
    """Where a group's texts change, its fences move, and other groups' hardly do; few fences are a bucket's width."""
    def rows(shift):
        return [(lang, src, (k % 40) * (1 + shift * (src == "a")), 10 + k % 9, 0, k % 60, 45 + k % 11) for lang in ("x", None) for src in ("a", "b") for k in range(400)]

    def cuts(shift):
        df = spark.createDataFrame(rows(shift), "lang string, source string, symbol_share long, upper_share long, bang_share long, repeat_share long, word_len long")
        return {(r["lang"], r["source"], r["metric"]): r for r in quality.fence_rows(df).collect()}

    before, after = cuts(0), cuts(9)
    for lang in ("x", None):
        assert after[lang, "a", "symbol_share"]["hi"] > 5 * before[lang, "a", "symbol_share"]["hi"]
        assert after[lang, "b", "symbol_share"]["hi"] < 2 * before[lang, "b", "symbol_share"]["hi"]
        assert after[lang, "a", "word_len"] == before[lang, "a", "word_len"] and before[lang, "a", "word_len"]["lo"] < 45
        assert before[lang, "a", "bang_share"]["floored"] and before[lang, "a", "symbol_share"]["lo"] is None
    assert {k[2] for k, r in before.items() if r["floored"]} == {"bang_share"}


def test_small_groups_blend_in(spark):
    """One row more or less never changes a group's fences at a stroke."""
    base = [("x", "big", 0, 10 + k % 9, 0, k % 30, 45 + k % 11) for k in range(2000)]
    hi = []
    for n in range(60, 140, 8):
        df = spark.createDataFrame(base + [("x", "small", 0, 100 + k % 9, 0, 0, 50) for k in range(n)], "lang string, source string, symbol_share long, upper_share long, bang_share long, repeat_share long, word_len long")
        hi.append(next(r["hi"] for r in quality.fence_rows(df).collect() if r["source"] == "small" and r["metric"] == "word_len"))
    assert max(hi) - min(hi) <= 20
