import pytest

#: Texts that any operator must take: null, empty, blanks, long runs, other scripts, lone marks.
ODD = [None, "", " ", "\n\t \x0b", "a", "word " * 3, "x" * 60_000, "1" * 30_000, "a " * 30_000, "1 " * 20_000, "é" * 5_000, "日本語 🎉🎉 テキスト", "\x00\x01 \x85\xa0 b", "  two  blanks  ", "a.b@c.de", "!!! *** ###", "The same line\n" * 50]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with null and repeated ids, nulls in every column, and columns whose names clash with results."""
    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, None) for k, t in enumerate(ODD)]
    rows += [(None, "no id here " * 20, None, None, 3), (5, "word " * 3, "en", "s", 15), (5, "word " * 3, "en", "s", 15)]
    names = "m q n set sig kept score slot found base labels rid piece lang_pred _row _text"
    return spark.createDataFrame([r + (1,) * len(names.split()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in names.split()))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
