"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the hashes (64 bits) of its distinct word n-grams. Equal sets form one class with one
representative, so copies are never paired. Tokens have a global order: rare ones first, then frequent ones, very
frequent ones last, by hash within each. With at most t = n - ceil(p n) tokens missing from any partner, a set's prefix
is extended until its tokens promise t + 1 signatures: a rare token counts at once and is a signature itself; frequent
tokens are dealt to subclasses, and only the second (very frequent: the third) of a subclass and each further one
counts, while every pair (triple) within the subclass is a signature. If two sets miss at most t tokens each, then one
class of the shorter prefix holds as many shared tokens as make one signature, and both sets have it: no link is lost.

Which tokens are frequent is read off a table of hashed counts over all documents, which grows with the texts up to a
size that the driver can hold. A wrong guess there costs time, not links.

Candidates are found around pivots: of the sets with a signature in common, the one with the fewest rare tokens is
compared to all others, and what is in one component by then isn't compared any more. Rounds go on as long as they find
links; what still shares a signature across components is then compared pair by pair, within bands of sizes so that only
sets which may link by their sizes meet at all. So a group of thousands of near
copies costs about as many comparisons as it has members, and no link between components is missed.
"""

from __future__ import annotations

import hashlib
import math
import struct
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from varstrata.llm.arrow import mapped, mapper, sliced, texts_of
from varstrata.llm.common import drop, small_join, stash
from varstrata.llm.components import connected_components

#: The table of counts has a slot for every so many bytes of text, within these powers of two.
PER_SLOT, LEAST_SLOTS, MOST_SLOTS = 16384, 18, 22
#: A slot is frequent above its expected count plus the first number of standard deviations and the second of rows,
#: very frequent above sixteen times that excess.
DEVIATIONS, LEAST = 6.0, 32
#: Representatives whose sizes, parities and labels are broadcast, eight numbers each; more are joined by a shuffle.
LOOKS = 300_000
#: Members of a signature beyond which they meet in bands of sizes.
MANY = 64
#: Tasks that the rows of one set are dealt to.
SALTS = 32
#: Bits of a set's parities: the first that are four times the tokens in which a linked set may differ, else the last.
#: Unrelated sets then differ in about half of their bits, twice what is allowed.
BITS = (512, 2048, 8192, 32768)
#: 64-bit numbers to which parities are folded for a first look.
FOLDED = 4
#: Below this similarity, small sets may run out of tokens before they have the signatures that they owe.
LEAST_PERCENT = 76
#: Tokens that make a signature: of rare, frequent and very frequent tokens.
TAKEN = (1, 2, 3)


#: Bytes of a word that are summed together; bytes of words that are gone through at once.
PIECE, AT_ONCE = 4096, 1 << 20
#: Multiplier of a word's bytes, and of its hash by place in the n-gram: odd 64-bit numbers.
BASE, FIRST, SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def mixed_bits(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * FIRST
    h = (h ^ (h >> np.uint64(33))) * SECOND
    return h ^ (h >> np.uint64(33))


def word_hashes(b: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each word of the bytes b, which begin at start and have these sizes.

    A word is cut into pieces of PIECE bytes, whose sums are lifted by the power of their place, and pieces are gone
    through AT_ONCE bytes at a time: numbers of eight bytes for every byte are held for these alone.
    """
    long = int(size.max()) > PIECE
    if long:
        parts = -(-size // PIECE)
        first = np.cumsum(parts) - parts
        word = np.repeat(np.arange(len(size)), parts)
        k = np.arange(len(word)) - first[word]
        at, n = start[word] + PIECE * k, np.minimum(PIECE, size[word] - PIECE * k)
    else:
        at, n = start, size
    power = np.cumprod(np.full(min(PIECE, int(size.max())), BASE, np.uint64))
    sums, ends = np.empty(len(n), np.uint64), np.cumsum(n)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + AT_ONCE, side="right")))
        some, begin = n[i:j], ends[i:j] - n[i:j] - (ends[i - 1] if i else 0)
        within = np.arange(int(ends[j - 1] - (ends[i - 1] if i else 0))) - np.repeat(begin, some)
        sums[i:j] = np.add.reduceat((b[np.repeat(at[i:j], some) + within].astype(np.uint64) + np.uint64(1)) * power[within], begin)
        i = j
    if long:
        lift = np.cumprod(np.append(np.uint64(1), np.full(int(k.max()), power[-1], np.uint64)))
        sums = np.add.reduceat(sums * lift[k], first)
    return mixed_bits(sums + size.astype(np.uint64))


def token_lists(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words of all texts, in order and with repeats, and how many each text has. A text with
    fewer than n words has one hash, of all its words; one without words none. Memory is some twenty times the texts'."""
    raw = [t.encode("utf-8", "replace").lower() for t in texts]
    b = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    white = (b == 32) | (b - np.uint8(9) < 5)
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    begin = np.cumsum([0, *(len(x) + 1 for x in raw)])
    each = np.bincount(np.searchsorted(begin, start, side="right") - 1, minlength=len(texts))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    word = word_hashes(b, start, end - start)
    gram, count = np.zeros(len(word), np.uint64), np.minimum(each, n)
    last = np.cumsum(each)
    left = np.repeat(last, each) - np.arange(len(word))  # words from this one to the end of its text
    for k in range(n):
        gram = np.where(left > k, mixed_bits(gram + np.roll(word, -k) * BASE + np.uint64(k + 1)), gram)
    # Where a text has fewer than n words, its first word's gram is the whole sequence.
    grams = np.where(each >= n, each - n + 1, (each > 0).astype(np.int64))
    keep = np.arange(len(word)) - np.repeat(last - each, each) < np.repeat(grams, each)
    return gram[keep], grams


def sets_of_texts(texts: list[str], n: int) -> list[np.ndarray]:
    """The ascending distinct tokens of each text."""
    flat, count = token_lists(texts, n)
    ends = np.cumsum(count).tolist()
    return [np.unique(flat[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


def slots_for(docs: DataFrame) -> int:
    """Slots of the table of counts: a power of two that grows with the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << min(MOST_SLOTS, max(LEAST_SLOTS, (total // PER_SLOT).bit_length()))


def hashed_counts(docs: DataFrame, n: int, slots: int) -> np.ndarray:
    """How often the tokens of each slot occur in all texts."""
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(slots, np.int64)
        for b in sliced(batches):
            tokens, _ = token_lists(texts_of(b), n)
            total += np.bincount((tokens & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], schema=schema)

    got = mapped(docs.select("text"), count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(slots, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def classes_of(counts: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for each slot: rare, frequent, very frequent."""
    usual = float(np.median(counts))
    excess = DEVIATIONS * np.sqrt(usual) + LEAST
    return (counts > usual + excess).astype(np.uint8) + (counts > usual + 16 * excess)


def missing(n: int, percent: int) -> int:
    """How many of n tokens a partner may lack."""
    return n - -(-percent * n // 100)


def scales(n: int, percent: int) -> set[int]:
    """The powers of four that n and any partner's size fall under."""
    return {(k.bit_length() - 1) // 2 for k in (-(-percent * n // 100), n, 100 * n // percent)}


def mixed(scale: int, tokens: tuple[int, ...]) -> int:
    """A signed 64-bit hash of a combination of tokens."""
    h = scale + 1
    for t in tokens:
        h = (h ^ t) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h - (1 << 64) if h >> 63 else h


def signatures(tokens: np.ndarray, kinds: np.ndarray, percent: int) -> tuple[list[int], int]:
    """Signatures of a set, rare tokens first, and how many rare tokens there are among them.

    tokens ascend; kinds holds their classes.
    """
    n = len(tokens)
    need = missing(n, percent) + 1
    if need == 1 and 100 * n // percent == n:
        return [], 0  # only an equal set can be a partner
    rare = tokens[kinds == 0][:need].view(np.int64).tolist()
    combos: set[int] = set()
    if len(rare) < need:
        rest = [(k, t) for k in (1, 2) for t in tokens[kinds == k].tolist()]
        for scale in scales(n, percent):
            parts, left, members = max(1, 4**scale // 16), need - len(rare), {}
            for k, t in rest:
                group = members.setdefault((k, (t >> 24) % parts), [])
                group.append(t)
                left -= len(group) >= TAKEN[k]
                if not left:
                    break
            for (k, _), group in members.items():
                combos.update(mixed(scale, c) for c in combinations(group, TAKEN[k]))
    return rare + sorted(combos), len(rare)


def key_of(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    return struct.unpack("<qq", hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())


def parities(tokens: np.ndarray, percent: int) -> list[int]:
    """One bit for each of many hash classes of tokens: whether the set has an odd number of them. Where two sets' bits
    differ, at least one token is in one set alone. Larger sets have more classes."""
    bits = next((b for b in BITS if b * (100 + percent) >= 8 * len(tokens) * (100 - percent)), BITS[-1])
    odd = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def folded(bits: Column) -> list[Column]:
    """FOLDED numbers of parities, alike for sets of all sizes: classes that are equal modulo 64 * FOLDED meet."""
    return [F.aggregate(_every(bits, k), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)) for k in range(FOLDED)]


def _every(bits: Column, k: int) -> Column:
    return F.filter(bits, lambda _, i: i % FOLDED == k)


def signed(docs: DataFrame, classes: np.ndarray, n: int, percent: int) -> DataFrame:
    """(doc_id, n, k1, k2, rare, sigs, bits) of each row of docs: n is the size of its set, k1 and k2 its key."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n", "k1", "k2")), ("rare", pa.int32()), ("sigs", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
    slots = np.uint64(len(classes) - 1)

    def body(b: pa.RecordBatch) -> list:
        sets = sets_of_texts(texts_of(b), n)
        keys = [key_of(s) for s in sets]
        sigs = [signatures(s, classes[(s & slots).astype(np.int64)], percent) for s in sets]
        return [b.column("doc_id"), [len(s) for s in sets], *([k[i] for k in keys] for i in (0, 1)), *([x[i] for x in sigs] for i in (1, 0)), [parities(s, percent) for s in sets]]

    return mapped(docs.select("doc_id", "text"), mapper(body, schema), "doc_id long, n long, k1 long, k2 long, rare int, sigs array<long>, bits array<long>")


def held_sets(docs: DataFrame, wanted: DataFrame, n: int, rows: int = 100_000) -> DataFrame:
    """(q, rep, n, set) of the representatives in wanted (q, rep, k1, k2): their texts are read once more. The ids are
    broadcast if they were counted to be few, else texts and ids are joined by a shuffle."""
    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if wanted.count() <= rows else ids, "doc_id", "left_semi")
    schema = pa.schema([("rep", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("set", pa.list_(pa.int64()))])

    def body(b: pa.RecordBatch) -> list:
        sets = sets_of_texts(texts_of(b), n)
        keys = [key_of(s) for s in sets]
        return [b.column("doc_id"), *([k[i] for k in keys] for i in (0, 1)), [s.view(np.int64) for s in sets]]

    sets = mapped(texts, mapper(body, schema), "rep long, k1 long, k2 long, set array<long>").dropDuplicates(["rep", "k1", "k2"])
    return sets.join(wanted, ["rep", "k1", "k2"]).select("q", "rep", F.size("set").cast("long").alias("n"), "set")


def apart(a: str, b: str, looks: list[str]) -> Column:
    """In how many classes the folded parities of two columns' sets differ."""
    return sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in looks), F.lit(0))


def near(a: str, b: str, looks: list[str], percent: int) -> Column:
    """Whether sets can link: their sizes are close, and their folded parities don't differ in more classes than linked
    sets may differ in tokens, (100 - p) / (100 + p) of the sum of their sizes."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * apart(a, b, looks) <= (100 - percent) * (n + m))


def band(n: Column, percent: int) -> Column:
    """Number of the band of a size. A set and its partners lie in the same band or in neighbours; bands are a trifle wider
    than the ratio of linked sizes, so that rounding moves none out of them."""
    return F.floor(F.log(n) / max(math.log(100 / percent) * (1 + 1e-9), 1e-9)).cast("long")


def similar(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (q, pivot) whose parities differ in no more bits than linked sets may differ in tokens. Where one side
    has more bits than the other, they are folded."""
    low, high = (reps.select(F.col("q").alias(to), F.col("bits").alias(f"{to}_bits"), F.col("n").alias(f"{to}_n")) for to in ("q", "pivot"))
    size = F.least(F.size("q_bits"), F.size("pivot_bits"))

    def fold(bits: str) -> Column:
        one = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.aggregate(F.filter(bits, lambda _, i: i % size == k), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))
        return F.when(F.size(bits) == size, F.col(bits)).otherwise(one)

    differ = F.aggregate(F.zip_with(fold("q_bits"), fold("pivot_bits"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    ok = (100 + percent) * differ <= (100 - percent) * (F.col("q_n") + F.col("pivot_n"))
    return pairs.join(low, "q").join(high, "pivot").where(ok).select("q", "pivot")


def shared_by(reps: DataFrame) -> DataFrame:
    """(sig, q, low, several, many): members of signatures that two sets or more have; low is the smallest, several is
    whether there are three or more, many whether there are more than MANY.

    No rare token has many members, by how rare is told: those are dealt once by signature, and counted and met within
    one exchange. Combinations may have a hot signature: they are counted with partial sums, and then joined, so that
    Spark can split what is hot.
    """
    every = reps.select("q", "rare", F.posexplode("sigs").alias("k", "sig"))
    out = None
    for rows in (every.where("k < rare").select("sig", "q").repartition("sig"), every.where("k >= rare").select("sig", "q")):
        low = rows.groupBy("sig").agg(F.min("q").alias("low"), F.max("q").alias("high"), F.count("*").alias("c")).where("low < high")
        part = rows.join(low.select("sig", "low", (F.col("c") > 2).alias("several"), (F.col("c") > MANY).alias("many")), "sig")
        out = part if out is None else out.unionByName(part)
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs (q, pivot) whose sets reach the threshold. The pivots, which have
    the most pairs, are joined to narrow rows first, so that they are met by rows of a few bytes."""
    low = sets.select(F.col("q").alias("pivot"), F.col("n").alias("m"), F.col("set").alias("other"))
    high = sets
    shared = F.size(F.array_intersect("set", "other"))
    return pairs.join(low, "pivot").join(high, "q").where((100 + percent) * shared >= percent * (F.col("n") + F.col("m"))).select(F.col("q").alias("a"), F.col("pivot").alias("b"))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Two documents link if 100 * intersection >= percent * union of their sets of word n-grams. Documents without words
    or text have an empty set and are components of their own. Rows without a
    doc_id get no component and link with nothing. Where a doc_id is repeated with other texts, each row gets the
    component of its own text. Other columns are ignored. Repeated rows are in one component; an empty table gives an
    empty result.
    """
    return _told(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def _told(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of jaccard_components with the key (k1, k2) of the row's set, and whether doc_id and key are the
    smallest of the component."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must lie between {LEAST_PERCENT} and 100")
    classes = classes_of(hashed_counts(docs, n, slots_for(docs)))
    wide = stash(signed(docs, classes, n, percent), "signed")
    rows = stash(wide.select("doc_id", "n", "k1", "k2"), "keys")
    # q orders the members of a signature: fewest rare tokens first, then by hash.
    q = F.call_function("shiftleft", F.least("rare", F.lit(127)).cast("long"), F.lit(56)) + F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 56))
    linked = wide.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    one = linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "rare", "sigs", "bits")])
    reps = stash(one.withColumn("q", q), "representatives")
    drop(wide)
    looks = [f"f{k}" for k in range(FOLDED)]
    known = stash(reps.select("q", F.struct("n", *[f.alias(x) for f, x in zip(folded(F.col("bits")), looks, strict=True)]).alias("look")), "looks")

    def ends(pairs: DataFrame) -> DataFrame:
        return reps.select("q", "rep", "k1", "k2").join(pairs.select("q").unionByName(pairs.select(F.col("pivot").alias("q"))).distinct(), "q")

    # Every member of a signature against the lowest one.
    members = stash(shared_by(reps), "members")
    first = members.where("q != low").select("q", F.col("low").alias("pivot")).distinct()
    first = small_join(first, known, "q", "inner", LOOKS).withColumnRenamed("look", "x")
    first = small_join(first, known.select(F.col("q").alias("pivot"), F.col("look").alias("y")), "pivot", "inner", LOOKS).where(near("x", "y", looks, percent))
    tried = stash(similar(first.select("q", "pivot"), reps, percent), "around-pivots")
    sets = stash(held_sets(docs, stash(ends(tried), "wanted"), n), "sets")
    links = stash(verified(tried, sets, percent), "links-of-pivots")
    found = connected_components(links)

    # The other pairs of a signature, where components differ: members outside of the lowest one's, against all others.
    label = found.select(F.col("node").alias("q"), "component")
    part = F.when(F.col("component").isNotNull(), F.struct(F.lit(0).alias("own"), F.col("component").alias("id"))).otherwise(F.struct(F.lit(1).alias("own"), F.col("q").alias("id")))
    parts = stash(known.join(label, "q", "left").select("q", "look", part.alias("part")), "parts")
    told = small_join(members.where("several and q != low").drop("several"), parts, "q", "inner", LOOKS)
    told = small_join(told, parts.select(F.col("q").alias("low"), F.col("part").alias("main")), "low", "inner", LOOKS)
    told = stash(told.select("sig", "many", "q", "look", "part", (F.col("part") == F.col("main")).alias("inside")), "told")
    # Members of a signature that many sets have meet in bands of sizes; for few that would be more rows than it saves.
    own = F.when(F.col("many"), band(F.col("look.n"), percent)).otherwise(F.lit(0).cast("long"))
    near_by = F.when(F.col("many"), F.array(own - 1, own, own + 1)).otherwise(F.array(own))
    outside = told.where("not inside").select("sig", F.explode(near_by).alias("band"), "q", F.col("look").alias("x"), "part")
    others = told.select("sig", own.alias("band"), F.col("q").alias("pivot"), F.col("look").alias("y"), F.col("part").alias("other"), "inside")
    # All conditions belong to the join: what can't link never is a row.
    met = outside.join(others, ["sig", "band"]).where((F.col("part") != F.col("other")) & (F.col("inside") | (F.col("q") < F.col("pivot"))) & near("x", "y", looks, percent))
    pairs = met.select(F.least("q", "pivot").alias("q"), F.greatest("q", "pivot").alias("pivot")).distinct()
    done = tried.select(F.least("q", "pivot").alias("q"), F.greatest("q", "pivot").alias("pivot"))
    across = stash(similar(pairs, reps, percent).join(done, ["q", "pivot"], "left_anti"), "across")
    if across.take(1):
        new = ends(across).join(sets.select("q"), "q", "left_anti")
        more = stash(held_sets(docs, stash(new, "wanted"), n), "sets")
        found = connected_components(links.unionByName(verified(across, sets.unionByName(more), percent)))

    # Components are of sets, not of ids, as an id may be repeated with other texts.
    named = reps.select("q", "rep", "k1", "k2", "copies").join(found, F.col("q") == F.col("node"), "left").withColumn("component", F.coalesce("component", "q"))
    named = stash(named.where("node is not null or copies > 1"), "components")
    least = stash(named.groupBy("component").agg(F.min(F.struct("rep", "k1", "k2")).alias("least")), "least")
    several = stash(small_join(named, least, "component", "inner", LOOKS).select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "least"), "classes")
    # Equal sets share their key: where classes are too many to broadcast, the rows of a key are dealt to several tasks.
    whole, parts = rows.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2"), F.lit(1 if several.count() <= LOOKS else SALTS)
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    same = (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")) & (F.pmod(F.xxhash64("doc_id"), parts) == F.col("salt"))
    whole = small_join(whole, several, same, "left", LOOKS)
    named_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.rep", "doc_id"))
    first = F.coalesce((F.col("doc_id") == F.col("least.rep")) & (F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2")), F.lit(True))
    return whole.select("doc_id", "n_shingles", named_id.alias("component_id"), "k1", "k2", first.alias("first"))


def keyed(docs: DataFrame, n: int) -> DataFrame:
    """docs with the size n and the key (k1, k2) of each text's set, in a struct _set."""
    fields = StructType([*docs.schema.fields, StructField("_set", StructType([StructField(c, LongType()) for c in ("n", "k1", "k2")]))])
    keys = pa.struct([(c, pa.int64()) for c in ("n", "k1", "k2")])

    def run(batches):
        for b in sliced(batches):
            sets = sets_of_texts(texts_of(b), n)
            found = [dict(zip(("n", "k1", "k2"), (len(s), *key_of(s)), strict=True)) for s in sets]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, keys)], names=[*b.schema.names, "_set"])

    return mapped(docs, run, fields)


def first_of_each(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of docs that are the first of their component, by doc_id and then by key of the set; all columns of
    docs. Rows without a doc_id, and without words, stay. Of rows with the same doc_id and set (without words: text)
    one stays, the smallest by all columns."""
    out = stash(_told(docs, n, percent).where("doc_id is not null and not first").select("doc_id", "k1", "k2").distinct(), "copies")
    again = docs.select("doc_id").where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.take(1):
        # The ids that go are broadcast if they were counted to be few, so that texts needn't be dealt.
        return small_join(docs, out.select("doc_id"), "doc_id", "left_anti", LOOKS).select(*docs.columns)
    again = stash(again, "repeated")
    once = small_join(small_join(docs, out.join(again, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_anti", LOOKS), again, "doc_id", "left_anti", LOOKS)
    more = keyed(small_join(docs, again, "doc_id", "left_semi", LOOKS).select(*docs.columns), n)
    gone = out.select(F.col("doc_id").alias("_id"), "k1", "k2")
    more = more.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("_set.k1") == gone["k1"]) & (F.col("_set.k2") == gone["k2"]), "left_anti")
    by = F.col("doc_id"), F.col("_set"), F.when(F.col("_set.n") == 0, F.col("text"))
    least = more.groupBy(*by).agg(F.min(F.struct(*docs.columns)).alias("_least")).select("_least.*")
    return once.select(*docs.columns).unionByName(least)
