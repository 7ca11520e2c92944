"""The pipeline against plain versions of its stages, on whole small tables."""

import os
import sys

import duckdb
import public_tokenizers as P

sys.path.insert(0, os.path.dirname(__file__))
import corpus_pipeline
from test_pairs import components
from test_texts import check_packing

from varstrata.llm import langid, oracle, pii


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    # Language: prediction text by text, without Spark.
    model = langid.train(docs)
    told = {k: (langid.LETTER.search(r["text"] or ""), *(x[0] for x in model.predict(langid.features(r["text"] or "")[None]))) for k, r in rows.items()}
    rows = {k: r for k, r in rows.items() if told[k][0] and told[k][2] >= corpus_pipeline.LEAST_SCORE}
    # Quality: the SQL of the rules over what is left.
    import pandas as pd

    docs_left = pd.DataFrame(rows.values())
    c = duckdb.connect()
    c.register("docs_left", docs_left)
    kept = c.execute(f"WITH {oracle.quality_metrics('docs_left')}, {oracle.quality_cuts()} SELECT doc_id FROM judged WHERE kept").fetchall()
    rows = {k: rows[k] for (k,) in kept}
    # Near copies: all pairs.
    groups = components({k: r["text"] for k, r in rows.items()}, 5, 80)
    rows = {k: r for k, r in rows.items() if groups[k][1] == k}
    # Personal data: spans cut out of the text.
    left = spark.createDataFrame([(k, r["text"]) for k, r in rows.items()], "doc_id long, text string")
    texts = {}
    for r in pii.find(left).collect():
        text, end, out = rows[r["doc_id"]]["text"], 0, []
        for s in sorted(r["found"], key=lambda s: (s["s"], s["e"])):
            if s["s"] >= end:
                out += [text[end : s["s"]], f"[{pii.KINDS[s['kind']].upper()}]"]
            end = max(end, s["e"])
        texts[r["doc_id"]] = "".join(out) + text[end:]
    got = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    used, total = check_packing(got, texts)
    assert used <= -(-total // 2048) * 1.05 + 1
    assert [name for name, _ in corpus_pipeline.STAGES] and P.path("byte_bpe_50k.json")


def test_stages_take_odd_rows(spark, odd, empty):
    """Nulls in any column, empty and long texts, repeated rows, clashing names: columns stay as they are."""
    extra = odd.selectExpr("*", "'mine' AS score_", "7 AS lang_pred_")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, None)
        assert out.columns == extra.columns, name
        rows = out.collect()
        assert all(r["score_"] == "mine" and r["lang_pred_"] == 7 and r["score"] == 1 for r in rows), name
        assert len(rows) <= extra.count()
        assert stage(spark, empty, None).collect() == []
    packed = corpus_pipeline.best_fit_packing(spark, odd, None)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in odd.select("doc_id").collect()}
    assert corpus_pipeline.best_fit_packing(spark, empty, None).collect() == []


def test_run_takes_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for k, docs in enumerate((odd, empty)):
        docs.write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / str(k))).collect()}
        assert ids <= {r["doc_id"] for r in docs.collect()}
