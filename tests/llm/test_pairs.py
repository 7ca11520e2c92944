"""Embedding near-dedup, the n-gram join and components, against all pairs."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varstrata.llm import embeddings, jaccard
from varstrata.llm.components import connected_components


class Sets:
    def __init__(self):
        self.up = {}

    def top(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(7, 7)]
    want = Sets()
    for a, b in links:
        want.join(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: want.top(x) for x in want.up if any(x in p and p[0] != p[1] for p in links)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def tokens(text, n=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return set(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else {tuple(w)} if w else set()


def components(texts, n, percent):
    out, s = Sets(), {k: tokens(t, n) for k, t in texts.items()}
    for k in texts:
        out.top(k)
    for a, b in itertools.combinations(texts, 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
            out.join(a, b)
    return {k: (len(s[k]), out.top(k)) for k in texts}


def corpus(seed, frequent):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts, k = {}, 0
    for _ in range(40):
        base = rnd.choices(words, k=rnd.choice([3, 9, 10, 12, 30, 60, 200]))
        for _ in range(rnd.choice([1, 2, 6, frequent])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                w[rnd.randrange(len(w))] = rnd.choice(words + ["Zed"])
            texts[k] = " ".join(w) + rnd.choice(["", " \n"])
            k += 1
    return texts | {k: "", k + 1: "one", k + 2: "ONE", k + 3: "one two", k + 4: None}


@pytest.mark.parametrize(("n", "percent", "least"), [(3, 90, 32), (3, 90, 2), (5, 80, 2)])
def test_jaccard_against_all_pairs(spark, monkeypatch, n, percent, least):
    """With a low threshold, tokens of a few rows count as frequent: signatures are pairs and triples then."""
    monkeypatch.setattr(jaccard, "LEAST", least)
    monkeypatch.setattr(jaccard, "DEVIATIONS", 0.0)
    monkeypatch.setattr(jaccard, "MANY", least)
    texts = corpus(n + least, 25)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, n, percent).collect()}
    assert got == components(texts, n, percent)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([80, 90]), st.integers(1, 300), st.integers(0, 40))
def test_signatures_lose_no_link(seed, percent, size, changes):
    """Two linked sets share a signature, whatever classes their tokens are in."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    a, b = base[rng.random(size) > changes / 400], np.append(base, rng.integers(0, 1 << 63, changes // 4, dtype=np.uint64))
    a, b = np.unique(a), np.unique(b)
    if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)) or np.array_equal(a, b) or not len(a):
        return
    share = rng.random(3)
    kind = lambda s: np.array([int(int(t) % 100 > 100 * share[0]) + int(int(t) % 97 > 97 * share[1]) * int(int(t) % 100 > 100 * share[0]) for t in s], np.uint8)
    x, y = (jaccard.signatures(s, kind(s), percent)[0] for s in (a, b))
    assert set(x) & set(y)


def test_parities_bound_differences(spark, monkeypatch):
    """Folded or not, parities never differ more than the sets do, and tell unrelated sets apart."""
    monkeypatch.setattr(jaccard, "BITS", (64, 128, 512))
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (48, 49, 190, 205, 900)]
    sets = [*base, base[1][:-1], np.append(base[1], np.uint64(5)), np.append(base[2], rng.integers(0, 1 << 63, 12, dtype=np.uint64)), np.append(base[3], np.uint64(7))]
    reps = spark.createDataFrame([(k, len(s), jaccard.parities(s, 90)) for k, s in enumerate(sets)], "q long, n long, bits array<long>")
    pairs = spark.createDataFrame(list(itertools.combinations(range(len(sets)), 2)), "q long, pivot long")
    got = {tuple(r) for r in jaccard.similar(pairs, reps, 90).select("q", "pivot").collect()}
    assert got >= {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(np.setxor1d(sets[a], sets[b])) * 190 <= 10 * (len(sets[a]) + len(sets[b]))}


def test_tokens_match_words():
    texts = ["A b  c\td", "a B c", "a b", "A  b", "", "x", "é É", "a b c a b c"]
    got = [set(s.tolist()) for s in jaccard.sets_of_texts(texts, 3)]
    assert [len(g) for g in got] == [2, 1, 1, 1, 0, 1, 1, 3]
    assert got[2] == got[3] and got[1] <= got[0] and got[1] <= got[7] and got[2].isdisjoint(got[1])


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for c in range(60):
        center = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 2, 5, 120 if c == 0 else 1]))):
            rows.append((k, (center + rng.normal(size=16) * 0.05).tolist(), c % 3))
            k += 1
    rows += [(k, rows[0][1], 0), (k + 1, rows[0][1], 0), (k + 2, rows[0][1], None), (k + 3, None, 0), (k + 4, [0.0] * 16, 0), (k + 5, [float("nan")] + [1.0] * 15, 0), (k + 6, [float("inf")] + [1.0] * 15, 0), (k + 7, [None] + [1.0] * 15, 0), (k + 8, [], 0), (k + 9, [1.0, 2.0], 0), (k + 10, [1e300] * 16, 1), (k + 11, [1e-300] * 16, 1), (None, rows[0][1], 0)]
    return rows


def unit_rows(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute_links(rows):
    """(links by id, components) of sound rows (id, vector, label)."""
    sound = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    unit = {r[0]: (np.array(r[1]) / np.abs(r[1]).max()) / np.linalg.norm(np.array(r[1]) / np.abs(r[1]).max()) for r in sound}
    links, comps = {}, Sets()
    for a, b in itertools.combinations(sound, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]) and unit[a[0]] @ unit[b[0]] >= 0.93:
            comps.join(a[0], b[0])
            for x in (a[0], b[0]):
                links[x] = links.get(x, 0) + 1
    return links, comps


@pytest.mark.parametrize("codes", [None, 3])
def test_vectors_against_all_pairs(spark, codes):
    rows = vectors(3)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep int, cell string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.vector_links(df, recall=1.0, codes=codes, block=16).collect() if r["vec_id"] is not None}
    links, comps = brute_links(rows)
    assert got == {k: (links.get(k, 0), comps.top(k), comps.top(k) == k) for k in (r[0] for r in rows) if k is not None}
    assert embeddings.vector_links(df.where("false")).collect() == []
    assert embeddings.vector_links(df.where("embedding is null")).count() == 1


def test_many_lengths(spark):
    """Vectors of any number of lengths, each compared with its like."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(150):
        x = rng.normal(size=k + 1)
        rows += [(3 * k, x.tolist(), 0), (3 * k + 1, (x * 2 + 1e-3).tolist(), 0), (3 * k + 2, (-x).tolist(), 0)]
    links, comps = brute_links(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {k: (links.get(k, 0), comps.top(k)) for k in range(450)}


def test_traversal_is_by_distance():
    rng = np.random.default_rng(0)
    x = unit_rows(rng.normal(size=(500, 8)))
    index = embeddings.MultiIndex(x, np.zeros(500, int), 0.5, codes=4)
    y = x[:40]
    first, second = index.bounds(y)
    for k in range(len(y)):
        cells = index.visits(first[k], second[k])
        far = [first[k, i] ** 2 + second[k, j] ** 2 for i, j in cells]
        assert far[0] == 0 and far == sorted(far)
        assert sorted(cells) == [(i, j) for i in range(4) for j in range(4) if index.visited(y[k : k + 1], i)[0, j]]
        assert set(index.lists(y)[k].tolist()) == {i for i, _ in cells}


def test_bounds_are_never_too_large():
    """No vector in another cell is nearer than its bound; so a radius of the chord loses nothing."""
    rng = np.random.default_rng(1)
    x = unit_rows(rng.normal(size=(300, 6)))
    index = embeddings.MultiIndex(x, np.zeros(300, int), 0.9, codes=5, recall=1.0)
    first, second = index.bounds(x)
    a, b = index.codes(x)
    far = np.sqrt(first[:, a] ** 2 + second[:, b] ** 2)
    assert (far <= np.sqrt(np.maximum(2 - 2 * x @ x.T, 0)) + 1e-6).all()


@pytest.mark.parametrize("noise", [0.12, 0.3])
def test_recall_of_probes(spark, monkeypatch, noise):
    """Every id that 20 divides against all rows, by brute force: links are found whatever share of the vectors is one
    group of near copies, with a sample far smaller than the table and codebooks that grow with it."""
    monkeypatch.setattr(embeddings, "PER_CODE", 8)
    rng = np.random.default_rng(7)
    group = rng.normal(size=64) + rng.normal(size=(1500, 64)) * 0.02
    first = rng.normal(size=(2000, 64))
    x = np.concatenate([group, first, first + rng.normal(size=first.shape) * noise])
    unit = unit_rows(x)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    index, n = embeddings.trained(df.selectExpr("vec_id rep", "label", "embedding", "64 width"), 0.93, embeddings.RECALL)
    assert len(index[64].words[0]) == 27 and n == len(x) > 2 * 8 * 64 and index[64].radius < 0.6 * index[64].chord
    visits = np.mean([len(index[64].visits(*v)) for v in zip(*index[64].bounds(unit[1500:1600]), strict=True)])
    assert visits < 0.12 * 27 * 27
    got = {r["vec_id"]: r for r in embeddings.vector_links(df).collect()}
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    want = linked.sum(1)
    assert all(got[k]["n_links"] <= want[k] for k in range(len(x)))
    for probes in (range(0, 1500, 20), range(1500, len(x), 20)):
        assert sum(got[k]["n_links"] for k in probes) >= 0.97 * sum(want[k] for k in probes) > 0
    assert len({got[k]["component_id"] for k in range(1500)}) == 1


def test_one_id_with_two_texts(spark):
    """Rows are judged by their own text, not by an id that they share with another one."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (7, a), (7, b), (8, b + " x"), (9, c), (9, c + " x"), (9, c), (10, c + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect())
    assert got == [(1, 1), (7, 1), (7, 7), (8, 7), (9, 9), (9, 9), (9, 9), (10, 9)]
    left = sorted((r["doc_id"], r["text"]) for r in jaccard.first_of_each(docs).collect())
    assert left[:2] == [(1, a), (7, b)] and len(left) == 3 and left[2] in [(9, c), (9, c + " x")]
    assert left == sorted((r["doc_id"], r["text"]) for r in jaccard.first_of_each(docs.repartition(7)).collect())


def test_long_words_and_texts_hash_alike(monkeypatch):
    """However bytes are cut into pieces, n-grams are the same."""
    texts = ["x" * 10_000 + " y " + "z" * 300, "", "a b c " * 700, "\x0b é" * 50, "x" * 10_000 + " y " + "z" * 301]
    want = jaccard.token_lists(texts, 3)
    for piece, at_once in ((1, 1), (7, 20), (300, 299), (1 << 20, 1 << 20)):
        monkeypatch.setattr(jaccard, "PIECE", piece)
        monkeypatch.setattr(jaccard, "AT_ONCE", at_once)
        got = jaccard.token_lists(texts, 3)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert want[0][0] != want[0][-1]


@pytest.mark.parametrize("percent", [76, 80, 90, 97, 100])
def test_linked_sizes_lie_in_neighbouring_bands(spark, percent):
    pairs = [(n, m) for n in (1, 2, 9, 10, 81, 90, 729, 1000, 99_999, 10**9) for m in (-(-percent * n // 100), n, 100 * n // percent)]
    got = spark.createDataFrame(pairs, "n long, m long").select(jaccard.band(F.col("n"), percent) - jaccard.band(F.col("m"), percent)).collect()
    assert all(abs(r[0]) <= 1 for r in got)


def test_low_percents_are_refused(spark):
    with pytest.raises(ValueError, match="percent"):
        jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), percent=75)
