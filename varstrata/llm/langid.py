"""Hierarchical language identification: linear machines choose the family, then one-versus-one linear support vector
machines choose among the languages of that family.

Features are hashed byte trigrams of the lower-cased whole text, in which everything but letters is a space. Training
takes SAMPLE labelled rows, dealt evenly among the languages, at most PER_LANG and at least one of each: those with the
smallest hashes of their ids. Their feature vectors, at most DIM numbers each, are gathered on the driver, where all
machines are trained side by side on the vectors themselves. Prediction is one pass over the texts, without a shuffle.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from varstrata.llm.arrow import mapped, mapper
from varstrata.llm.common import small_join, stash

DIM, PER_LANG, SAMPLE = 8192, 300, 6000
UNKNOWN = "und"
#: ISO 639-1 codes by family; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "indic": "hi mr ne bn pa gu ur",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "malayic": "id ms jv su tl",
}
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that aren't letters become a space.
SPACED = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs.split()), lang)


def features(text: str, dim: int = DIM) -> np.ndarray:
    """Root of each slot's trigram count, scaled to length 1; zeros if there is no trigram."""
    raw = b" ".join((b"", *text.lower().encode("utf-8", "replace").translate(SPACED).split(), b""))
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(dim, np.float32)
    slot = ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(7)) % np.uint32(dim)
    x = np.sqrt(np.bincount(slot, minlength=dim).astype(np.float32))
    return x / np.float32(np.linalg.norm(x))


def machines(x: np.ndarray, signs: np.ndarray, cost: float = 1.0, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Linear support vector machines with squared hinge loss, one for each column of signs: 1, -1, or 0 for a row that
    plays no part. Weights (a row for each machine) and biases.

    Accelerated gradient steps on all machines at once; the bias is the weight of a feature that is always 1. Memory is
    that of x and of a number for each row and machine, time is in proportion to their product.
    """
    signs = signs.astype(np.float32)
    # The largest eigenvalue of x'x (with the constant feature) bounds the steps.
    v, top = np.ones(x.shape[1] + 1), 1.0
    for _ in range(12):
        y = x @ v[:-1] + v[-1]
        v = np.append(y @ x, y.sum())
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    step = 1 / (1 + 2.2 * cost * top)
    w, b = np.zeros((signs.shape[1], x.shape[1]), np.float32), np.zeros(signs.shape[1], np.float32)
    w_at, b_at, pace = w, b, 1.0
    for _ in range(rounds):
        short = np.maximum(0, 1 - signs * (x @ w_at.T + b_at)) * signs
        new_w = w_at - step * (w_at - 2 * cost * (short.T @ x))
        new_b = b_at - step * (b_at - 2 * cost * short.sum(0))
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        lead = np.float32((pace - 1) / next_pace)
        w_at, b_at = new_w + lead * (new_w - w), new_b + lead * (new_b - b)
        w, b, pace = new_w, new_b, next_pace
    return w, b


@dataclass
class Model:
    """families: names; of: languages by family; rows of weights: one machine per family (if there are several), then
    one for each pair of languages within a family."""

    families: list[str] = field(default_factory=list)
    of: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def predict(self, x: np.ndarray) -> tuple[list[str], list[float]]:
        """x: a row of features per text. Scores are products of the family's and the language's share."""
        if not self.families:
            return [UNKNOWN] * len(x), [0.0] * len(x)
        margin = 1 / (1 + np.exp(-4 * np.clip((x @ self.weights.T).astype(np.float64) + self.bias, -20, 20)))
        many = len(self.families) if len(self.families) > 1 else 0
        family = margin[:, :many].argmax(1) if many else np.zeros(len(x), int)
        share = margin[np.arange(len(x)), family] if many else np.ones(len(x))
        duels: dict[str, list[tuple[int, str, str]]] = {}
        for j, (g, a, b) in enumerate(self.pairs, many):
            duels.setdefault(g, []).append((j, a, b))
        langs, scores = [], []
        for i, f in enumerate(family):
            name = self.families[f]
            votes = dict.fromkeys(self.of[name], 0.0)
            for j, a, b in duels.get(name, ()):
                votes[a] += margin[i, j]
                votes[b] += 1 - margin[i, j]
            best = max(votes, key=lambda k: (votes[k], k))
            langs.append(best)
            scores.append(float(share[i] * (votes[best] / (len(votes) - 1) if len(votes) > 1 else 1.0)))
        return langs, scores


def fit(langs: list[str], x: np.ndarray) -> Model:
    if not langs:
        return Model()
    y, fam = np.array(langs), np.array([family_of(v) for v in langs])
    m = Model(sorted(set(fam)), {f: sorted(set(y[fam == f])) for f in set(fam)})
    signs = [np.where(fam == f, 1, -1) for f in m.families] if len(m.families) > 1 else []
    for f in m.families:
        for i, a in enumerate(m.of[f]):
            for b in m.of[f][i + 1 :]:
                m.pairs.append((f, a, b))
                signs.append((y == a).astype(int) - (y == b))
    if signs:
        m.weights, m.bias = machines(x, np.array(signs).T)
    else:
        m.weights, m.bias = np.zeros((0, x.shape[1]), np.float32), np.zeros(0, np.float32)
    return m


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is a multiple of 5, or the id is null: rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


#: Rows that are taken from each part of a language; parts are ranked apart from each other.
PER_PART = 5


def train(docs: DataFrame, per_lang: int = PER_LANG, dim: int = DIM, sample: int = SAMPLE) -> Model:
    """Learns from text and lang of rows that aren't held out and whose text has a letter: about sample rows in all, dealt
    evenly among the languages, with at most per_lang and at least one row of each, so that no language is left out.

    A language's rows are dealt to parts by the hash of their id, and of each part those with the smallest hashes are
    taken, so that no task ranks a whole language. Repeated rows count as often as they occur; which of equal rows is
    taken makes no difference. With no such row the model knows no language.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    langs = rows.select("lang").distinct().count()
    if not langs:
        return Model()
    each = max(1, min(per_lang, sample // langs))
    parts = max(1, each // PER_PART)
    h = F.xxhash64("doc_id")
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumns({"h": h, "part": F.pmod(h, F.lit(parts))})
    by, order, most = W.partitionBy("lang", "part"), [F.col("h"), F.col("doc_id")], -(-each // parts)
    best = rows.select("lang", "part", "doc_id", "h").withColumn("r", F.row_number().over(by.orderBy(*order))).where(F.col("r") <= most)
    top = stash(best.groupBy("lang", "part").agg(F.max("h").alias("top")), "top")
    near = small_join(rows.select("doc_id", "lang", "text", "h", "part"), top, ["lang", "part"], "inner").where("h <= top")
    taken = near.withColumn("r", F.row_number().over(by.orderBy(*order, F.xxhash64("text")))).where(F.col("r") <= most).select("doc_id", "lang", "text")

    def vectors(b: pa.RecordBatch) -> list:
        x = [features(t, dim) for t in b.column("text").to_pylist()]
        at = [np.flatnonzero(v) for v in x]
        return [b.column("doc_id"), b.column("lang"), [i.astype("<u4").tobytes() for i in at], [v[i].astype("<f4").tobytes() for v, i in zip(x, at, strict=True)]]

    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("v", pa.binary())])
    got = mapped(taken, mapper(vectors, schema), "doc_id long, lang string, at binary, v binary").collect()
    kept = sorted((r for r in got if len(r["at"])), key=lambda r: (r["lang"], r["doc_id"], bytes(r["at"]), bytes(r["v"])))
    x = np.zeros((len(kept), dim), np.float32)
    for row, r in zip(x, kept, strict=True):
        row[np.frombuffer(r["at"], "<u4")] = np.frombuffer(r["v"], "<f4")
    return fit([r["lang"] for r in kept], x)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns keep of docs (doc_id alone if none are given), with lang_pred and score, or what names calls them.

    Null texts and texts without a letter get UNKNOWN with score 0, as does everything if nothing was learned. lang,
    source and doc_id play no part in a prediction, so that repeated texts get one answer; of languages with equal votes
    the last by name wins. The new columns replace columns of docs with these names.
    """
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in names]
    packed = pickle.dumps(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else ["text"]))
    fields = rows.select(*[f"`{c}`" for c in keep]).schema

    def run(batches):
        m = pickle.loads(packed)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column("text").to_pylist()
                lettered = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if lettered:
                    for i, lang, score in zip(lettered, *m.predict(np.stack([features(texts[i], m.weights.shape[1]) for i in lettered])), strict=True):
                        langs[i], scores[i] = lang, score
                arrays = [*b.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return mapped(rows, run, StructType([*fields.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))
