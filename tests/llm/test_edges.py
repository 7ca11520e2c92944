"""Every operator takes odd texts, nulls, repeated rows, clashing columns and empty tables."""

import public_tokenizers as P
import pytest

from varstrata.llm import bpe, jaccard, langid, licenses, packing, pii, quality, sharding
from varstrata.llm.common import release

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ROWS = {
    "quality": quality.judge,
    "pii": lambda d: pii.digest(pii.find(d)),
    "licenses": licenses.scan,
    "bpe": lambda d: bpe.encode_decode(d, RANKS, P.PATTERN),
    "langid": lambda d: langid.identify(d, langid.train(d)),
    "jaccard": jaccard.jaccard_components,
    "sharding": lambda d: sharding.assign(d, "doc_id"),
}
FILTERS = {"quality": quality.keep_good, "pii": pii.redact, "jaccard": jaccard.first_of_each}


@pytest.mark.parametrize("name", ROWS)
def test_one_row_for_each(name, odd, empty):
    got = ROWS[name](odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.select("doc_id").collect())
    assert ROWS[name](empty).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(name, odd, empty):
    out = FILTERS[name](odd)
    assert out.columns == odd.columns
    assert out.count() <= odd.count()
    assert FILTERS[name](empty).collect() == []


def test_repeated_rows_stay_once(odd):
    left = [r["doc_id"] for r in jaccard.first_of_each(odd).collect()]
    assert left.count(5) == 1 and left.count(None) == 1


def test_packing_of_odd_texts(odd, empty):
    got = packing.pack(odd, JSON).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in odd.collect()}
    assert packing.pack(empty, JSON).collect() == []
    assert [r["length"] for r in got if r["doc_id"] in (0, 1)] == [1, 1]


def test_unknown_language(odd):
    got = {r["doc_id"]: r for r in langid.identify(odd, langid.train(odd)).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (0, 1, 2, 3, 7, 15))


def test_scratch_tables_go(odd):
    release()
