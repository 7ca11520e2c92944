"""Near-duplicate vectors by an inverted multi-index.

The halves of the normalised vectors have independent codebooks, trained on a bounded sample; a vector's cell in the
product grid is its pair of nearest words. How far a vector is from another cell is bounded from below, in each half, by
its distance from the plane between its own word and the other one. A multi-sequence traversal of both halves' words, by
these distances, visits the cells around a vector in order, up to the radius at which the target recall is reached.

The radius is found on the sample, for the weakest links there are: partners at exactly the least cosine, in directions
drawn evenly and in directions of differences between vectors, and what links the sample itself holds, every vector
counting once. So it depends neither on how many links there are nor on large groups of copies. A target of 1 takes the
radius beyond which no two vectors link.

Codebooks grow with the root of a label's vectors, so that a vector meets few of them. Vectors travel to the lists (words
of the first half) that they visit, and within a list they are compared, in double precision, with the members of the
cells that they visit. Lists and their visitors are cut into blocks by hash, so that neither a hot label nor a cell of
thousands of near copies meets in one task; only counts and spanning links leave. A pair is looked for from its smaller
id. Equal vectors of a label are one class and are counted, not compared.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varstrata.llm.arrow import mapped, sliced
from varstrata.llm.common import small_join, stash
from varstrata.llm.components import connected_components

#: Share of the links that the traversal must reach.
RECALL = 0.99
#: A codebook has the root of a label's vectors over PER_CELL words, MOST_CODES at most; up to ONE_CELL vectors need none.
PER_CELL, MOST_CODES, ONE_CELL = 8, 1024, 256
#: Vectors in the training sample, for each word of a codebook; probes for the radius.
PER_CODE, PROBES = 64, 4096
#: A list and its visitors are cut into blocks of a PARTS-th of all vectors, but not less than FEWEST or more than MOST.
PARTS, FEWEST, MOST = 64, 256, 16384
#: Vectors that are compared at once.
TILE = 512
#: What rounding may add to a distance.
SLACK = 1e-6


def codebook(x: np.ndarray, codes: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's algorithm from evenly chosen rows; the same for the same rows in the same order."""
    words = x[np.linspace(0, len(x) - 1, min(codes, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, words)
        sums, n = np.zeros_like(words), np.bincount(near, minlength=len(words))
        np.add.at(sums, near, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2 * (x @ words.T)).argmin(1)


class MultiIndex:
    """Codebooks of both halves, and the radius up to which cells are visited."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, least: float, codes: int, recall: float = RECALL, seed: int = 0):
        """sample: normalised vectors, rows in a fixed order."""
        self.half = sample.shape[1] // 2
        self.words = [codebook(p, codes) if p.shape[1] else np.zeros((1, 0)) for p in self.parts(sample)]
        self.between = [np.sqrt(np.maximum((w**2).sum(1)[:, None] + (w**2).sum(1) - 2 * w @ w.T, 0)) for w in self.words]
        #: Distance of two vectors of length 1 whose cosine is least: no linked ones are farther apart.
        self.chord = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK
        self.radius = self.chord if recall >= 1 or codes <= 1 else min(self.chord, self._reached(sample, labels, least, recall, np.random.default_rng(seed)) + SLACK)

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest words of both halves."""
        return tuple(nearest(p, w) for p, w in zip(self.parts(x), self.words, strict=True))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each half: how far a row is, at least, from any vector whose word is another one."""
        out = []
        for p, w, between in zip(self.parts(x), self.words, self.between, strict=True):
            d = (p * p).sum(1)[:, None] + (w * w).sum(1) - 2 * p @ w.T
            own = d.argmin(1)
            apart = (d - d.min(1, keepdims=True)) / (2 * np.maximum(between[own], 1e-12))
            apart[np.arange(len(p)), own] = 0
            out.append(apart)
        return out[0], out[1]

    def _reached(self, sample: np.ndarray, labels: np.ndarray, least: float, recall: float, rng: np.random.Generator) -> float:
        """The radius at which recall of the weakest links, and of the sample's own, is reached."""
        x = sample[np.linspace(0, len(sample) - 1, min(PROBES, len(sample))).astype(int)]
        first, second = self.bounds(x)

        def far(y: np.ndarray) -> np.ndarray:
            a, b = self.codes(y)
            at = np.arange(len(x))
            return np.sqrt(first[at, a] ** 2 + second[at, b] ** 2)

        found = []
        for aside in (rng.normal(size=x.shape), sample[rng.integers(0, len(sample), len(x))] - sample[rng.integers(0, len(sample), len(x))]):
            aside = aside - (aside * x).sum(1, keepdims=True) * x
            size = np.sqrt((aside**2).sum(1, keepdims=True))
            y = least * x + math.sqrt(1 - least**2) * aside / np.maximum(size, 1e-12)
            found.append(np.quantile(far(y)[size[:, 0] > 1e-9], recall) if (size > 1e-9).any() else 0.0)
        # Of each vector the links that the sample holds, at their own recall; of the vectors, the same share.
        held = []
        all_first, all_second = self.bounds(sample)
        a, b = self.codes(sample)
        for at in range(0, len(sample), TILE):
            rows = slice(at, at + TILE)
            linked = (sample[rows] @ sample.T >= least) & (labels[rows, None] == labels[None])
            linked[np.arange(linked.shape[0]), np.arange(at, at + linked.shape[0])] = False
            for i in np.flatnonzero(linked.any(1)):
                j = np.flatnonzero(linked[i])
                held.append(np.quantile(np.sqrt(all_first[at + i, a[j]] ** 2 + all_second[at + i, b[j]] ** 2), recall))
        return float(max([*found, *([np.quantile(held, recall)] if held else [])]))

    def visits(self, first: np.ndarray, second: np.ndarray, radius: float | None = None) -> list[tuple[int, int]]:
        """Cells by distance from a vector with these bounds, up to the radius: multi-sequence traversal of the two sorted
        lists of words."""
        radius = self.radius if radius is None else radius
        rows = first, second
        order = [np.argsort(r, kind="stable") for r in rows]
        far = lambda i, j: float(rows[0][order[0][i]] ** 2 + rows[1][order[1][j]] ** 2)
        heap, seen, out = [(far(0, 0), 0, 0)], {(0, 0)}, []
        while heap:
            d, i, j = heapq.heappop(heap)
            if d > radius**2:
                break
            out.append((int(order[0][i]), int(order[1][j])))
            for i2, j2 in ((i + 1, j), (i, j + 1)):
                if i2 < len(order[0]) and j2 < len(order[1]) and (i2, j2) not in seen:
                    seen.add((i2, j2))
                    heapq.heappush(heap, (far(i2, j2), i2, j2))
        return out

    def lists(self, x: np.ndarray) -> list[np.ndarray]:
        """The first halves' words of the cells that each row visits."""
        return [np.flatnonzero(r) for r in self.bounds(x)[0] <= self.radius]

    def visited(self, x: np.ndarray, word: int) -> np.ndarray:
        """For each row and word of the second half, whether the row visits its cell in the list of the first half's word:
        what visits() finds, for many rows at once."""
        first, second = self.bounds(x)
        return first[:, word, None] ** 2 + second**2 <= self.radius**2


def normal(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of lists of doubles, scaled to length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, width or 0))
    x = x / np.abs(x).max(1, keepdims=True)  # so that the squares of very large or small numbers stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spanning(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Links that keep the components of a symmetric matrix of links: each row and the smallest id it reaches."""
    low = np.arange(len(ids))
    near = linked | np.eye(len(ids), dtype=bool)
    while True:
        new = np.where(near, low[None], len(ids)).min(1)
        new = new[new]
        if (new == low).all():
            return [(int(ids[i]), int(ids[k])) for i, k in enumerate(low) if i != k]
        low = new


def vector_links(vectors: DataFrame, least: float = 0.93, recall: float = RECALL, codes: int | None = None, block: int | None = None) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id and kept.

    Vectors link if their labels are equal and not null and their cosine is least or more. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing, nor do vectors of different lengths, or rows without
    a vec_id. Repeated rows link with each other as copies do; a cosine of exactly least links. Other columns are
    ignored; an empty table gives an empty result. Of the links, the share recall is found, and no false one.
    """
    e = F.col("embedding")
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", F.when(sound & F.coalesce(finite, F.lit(False)), e).alias("embedding"))
    classes = stash(rows.where(F.col("embedding").isNotNull()).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("width", F.size("embedding")), "vectors")
    found = stash(_verified(classes, least, recall, codes, block), "verified")
    counts = found.groupBy("rep").agg(F.sum("others").alias("others"))
    components = connected_components(found.where("to is not null").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    told = classes.join(counts, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    told = told.select(F.col("label").alias("l"), F.col("embedding").alias("v"), "rep", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    told = stash(told.where("links > 0"), "linked-vectors")
    out = rows.join(told, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("v")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def trained(classes: DataFrame, least: float, recall: float, codes: int | None = None) -> tuple[dict[int, MultiIndex], int]:
    """An index for each length of vectors whose largest label has more than ONE_CELL, by length; how many vectors there
    are. Samples are the vectors with the smallest hashes of their ids, whatever the order of rows."""
    sizes = classes.groupBy("width", "label").agg(F.count("*").alias("n")).groupBy("width").agg(F.max("n").alias("most"), F.sum("n").alias("n")).orderBy("width").collect()
    out = {}
    for r in sizes:
        k = codes or (1 if r["most"] <= ONE_CELL else min(MOST_CODES, math.ceil(math.sqrt(r["most"] / PER_CELL))))
        if k > 1:
            some = classes.where(F.col("width") == r["width"]).select("label", "embedding", "rep").orderBy(F.xxhash64("rep"), "rep").limit(PER_CODE * max(k, 64)).toArrow()
            labels = np.unique(np.array(some["label"].to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
            out[r["width"]] = MultiIndex(normal(some["embedding"].combine_chunks()), labels, least, k, recall)
    return out, sum(r["n"] for r in sizes)


def _verified(classes: DataFrame, least: float, recall: float, codes: int | None, block: int | None) -> DataFrame:
    """(rep, others, to): how many vectors of other classes a class links with, in parts; links (rep, to) that span the
    components."""
    indexes, total = trained(classes, least, recall, codes)
    size = block or min(MOST, max(FEWEST, total // PARTS))

    def place(batches):
        for b in sliced(batches, 4096):
            widths = b.column("width").to_numpy()
            code, lists = [np.zeros(b.num_rows, np.int32) for _ in range(2)], [[0]] * b.num_rows
            for w in np.unique(widths).tolist():
                if w in indexes:
                    at = np.flatnonzero(widths == w)
                    x = normal(b.column("embedding").take(pa.array(at)))
                    for c, found in zip(code, indexes[w].codes(x), strict=True):
                        c[at] = found
                    for i, found in zip(at.tolist(), indexes[w].lists(x), strict=True):
                        lists[i] = found
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, code), pa.array(lists, pa.list_(pa.int32()))], names=[*b.schema.names, "c1", "c2", "lists"])

    fields = classes.select("label", "width", "embedding", "rep", "copies")
    kind = {f.name: f.dataType.simpleString() for f in fields.schema.fields}
    placed = stash(mapped(fields, place, f"label {kind['label']}, width int, embedding {kind['embedding']}, rep long, copies long, c1 int, c2 int, lists array<int>"), "cells")

    # A list's members and its visitors are dealt to blocks by hash; every block of one meets every block of the other.
    keys = ["label", "width", "list"]
    home, away = F.col("c1").alias("list"), F.explode("lists").alias("list")
    members = placed.select("label", "width", home).groupBy(*keys).agg(F.count("*").alias("n_m"))
    visitors = placed.select("label", "width", away).groupBy(*keys).agg(F.count("*").alias("n_v"))
    lists = stash(members.join(visitors, keys).where("n_v > 1").select(*keys, F.ceil(F.col("n_m") / size).cast("int").alias("m"), F.ceil(F.col("n_v") / size).cast("int").alias("v")), "lists")
    hashed = F.xxhash64("rep")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inner = small_join(placed.select("label", "width", home, "embedding", "rep", "copies", "c2"), lists, keys, "inner")
    inner = inner.select(*keys, F.lit(True).alias("home"), F.pmod(hashed, F.col("m")).cast("int").alias("mb"), every("v").alias("vb"), "c2", "rep", "copies", "embedding")
    outer = small_join(placed.select("label", "width", away, "embedding", "rep", "copies", "c2"), lists, keys, "inner")
    outer = outer.select(*keys, F.lit(False).alias("home"), every("m").alias("mb"), F.pmod(hashed, F.col("v")).cast("int").alias("vb"), "c2", "rep", "copies", "embedding")
    schema = pa.schema([("rep", pa.int64()), ("others", pa.int64()), ("to", pa.int64())])

    def meet(key, table):
        width, word = key[1].as_py(), key[2].as_py()
        is_home = table["home"].to_numpy()
        out: list[tuple] = []
        if is_home.any() and not is_home.all():
            out = compared(Side(table.filter(table["home"])), Side(table.filter(pa.array(~is_home))), indexes.get(width), word, least)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], []))], schema=schema)

    return inner.unionByName(outer).groupBy(*keys, "mb", "vb").applyInArrow(meet, "rep long, others long, to long")


class Side:
    """Members or visitors of a list, by cell and id."""

    def __init__(self, table: pa.Table):
        t = table.sort_by([("c2", "ascending"), ("rep", "ascending")]).combine_chunks()
        self.rep, self.copies, self.c2 = (t[c].to_numpy() for c in ("rep", "copies", "c2"))
        self.x = normal(t["embedding"].combine_chunks())


def compared(members: Side, visitors: Side, index: MultiIndex | None, word: int, least: float) -> list[tuple[int, int, int | None]]:
    """(rep, vectors of other classes that it links with here, a rep on the way to the smallest linked one) of the rows
    that link, a pair being looked for from its smaller rep."""
    seen = None if index is None else index.visited(visitors.x, word)
    out: list[tuple[int, int, int | None]] = []
    starts = np.flatnonzero(np.diff(members.c2, prepend=members.c2[0] - 1))
    for first, last in zip(starts, np.append(starts[1:], len(members.rep)), strict=True):
        come = np.arange(len(visitors.rep)) if seen is None else np.flatnonzero(seen[:, members.c2[first]])
        for i in range(0, len(come), TILE):
            v = come[i : i + TILE]
            for j in range(first, last, TILE):
                m = slice(j, min(j + TILE, last))
                linked = (visitors.x[v] @ members.x[m].T >= least) & (visitors.rep[v][:, None] < members.rep[m][None])
                if not linked.any():
                    continue
                # Only rows that link at all enter the matrix of both sides.
                p, q = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
                some = linked[np.ix_(p, q)]
                ids = np.concatenate([visitors.rep[v][p], members.rep[m][q]])
                n = np.concatenate([some @ members.copies[m][q], visitors.copies[v][p] @ some])
                out += [(int(r), int(k), None) for r, k in zip(ids, n, strict=True)]
                both = np.zeros((len(ids),) * 2, bool)
                both[: len(p), len(p) :] = some
                out += [(a, 0, b) for a, b in spanning(both | both.T, ids)]
    return out
