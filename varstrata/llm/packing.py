"""Best-fit packing of tokenized documents into sequences of fixed length.

Three steps. Documents are tokenized and cut in one pass without a shuffle, and the pieces are stashed with their ids.
Their numbers and lengths alone are then dealt evenly to partitions of about PIECES_PER_TASK, and each partition packs its
stream online: at most OPEN bins are open, bins are found through a bitset with a bit for each free space that an open bin
has, a piece goes to the fullest bin that takes it, and when a new bin is needed and none may be opened, the fullest
closes. The stream is looked ahead by LOOK_AHEAD pieces, and the longest of these come first. The bins left open at the end
of a partition are the only loss that partitions cause. Places are joined to the pieces last, so that ids are read and
moved only where a query asks for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varstrata.llm.arrow import mapped, sliced, texts_of
from varstrata.llm.bpe import Words
from varstrata.llm.common import stash

#: LOOK_AHEAD: pieces of a stream that are placed together, the longest first.
LENGTH, OPEN, PIECES_PER_TASK, LOOK_AHEAD, END = 2048, 1024, 250_000, 2048, 0
LAST = END.to_bytes(4, "little")
#: Texts with other characters are tokenized as a whole, so that the library alone decides what is a letter.
PLAIN = regex.compile("[\\x00-ɏ‐-‧€]*")


class BestFit:
    """Bounded-space online best fit."""

    def __init__(self, capacity: int = LENGTH, open_bins: int = OPEN):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.most = capacity, open_bins
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free, self.open, self.used = 0, 0, 0

    def _take(self, space: int) -> int:
        at = self.bins[space].pop()
        if not self.bins[space]:
            self.free ^= 1 << space
        return at

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of this length."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} doesn't fit into {self.capacity}")
        if fits := self.free >> length:
            space = length + (fits & -fits).bit_length() - 1
            at = self._take(space)
        else:
            at, space = self.used, self.capacity
            self.used += 1
            self.open += 1
        rest = space - length
        if not rest:
            self.open -= 1
        else:
            if self.open > self.most:
                # The fullest of all closes, be it an open bin or the one that this piece has begun.
                fullest = (self.free & -self.free).bit_length() - 1
                self.open -= 1
                if rest <= fullest:
                    return at, self.capacity - space
                self._take(fullest)
            self.bins[rest].append(at)
            self.free |= 1 << rest
        return at, self.capacity - space


_loaded: dict[str, tuple] = {}


def loaded(path: str) -> tuple:
    """The tokenizer and its word memory: one copy for each Python worker."""
    if path not in _loaded:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True

        def whole(text: str) -> np.ndarray:
            return np.array(t.encode(text, add_special_tokens=False).ids, np.int64)

        # Tokens that begin with a blank: in a row of words, where a word begins.
        begins = np.array([(t.id_to_token(k) or "").startswith("Ġ") for k in range(t.get_vocab_size())])

        def encode(words: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            got = t.encode_batch_fast(["".join(" " + w for w in words), *texts], add_special_tokens=False)
            first = np.array(got[0].ids, np.int64)
            n = np.append(np.bincount(np.cumsum(begins[first]) - 1, minlength=len(words)), [len(x) for x in got[1:]]).astype(np.int64)
            return np.concatenate([first, *(np.array(x.ids, np.int64) for x in got[1:])]), n

        _loaded[path] = whole, Words(encode)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32): each text's ids and a final END, cut from the end into pieces of
    length, so that the first may be shorter. ids are bytes, little-endian unsigned numbers of 32 bits, as a file of
    sequences holds them. Null text counts as empty and has the one id END."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, words = loaded(path)
        for b in sliced(batches, 256):
            texts = texts_of(b)
            plain = [PLAIN.fullmatch(t) is not None for t in texts]
            cut = words.batch([t if p else "" for t, p in zip(texts, plain, strict=True)])
            out: list[tuple] = []
            for doc, text, p, (ids, _) in zip(b.column("doc_id").to_pylist(), texts, plain, cut, strict=True):
                raw = (ids if p else whole(text)).astype("<u4").tobytes() + LAST
                n = len(raw) // 4
                first = n % length or length
                for k, end in enumerate(range(first, n + 1, length)):
                    begin = max(0, end - length) if k else 0
                    out.append((doc, k, begin, end - begin, raw[4 * begin : 4 * end]))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    cut = mapped(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids binary")
    return cut.withColumn("ids_crc32", F.crc32("ids"))


def numbers(ids: bytes) -> list[int]:
    """The ids of a piece or a sequence."""
    return np.frombuffer(ids, "<u4").tolist()


def pack(docs: DataFrame, path: str, length: int = LENGTH, open_bins: int = OPEN, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """The pieces of docs, with their ids, sequence_id and offset: sequences() puts them together.

    Repeated rows are packed as often as they occur. Other columns are ignored; an empty table gives an empty result.
    """
    cut = stash(pieces(docs, path, length).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # Dealt and ordered by hash, so that the lengths come mixed and a task that runs again packs alike.
    dealt = cut.select("_row", "doc_id", "piece", "length").repartition(max(1, -(-cut.count() // per_task)), F.xxhash64("doc_id", "piece")).sortWithinPartitions(F.xxhash64("piece", "doc_id"), "doc_id", "piece", "_row")
    schema = pa.schema([("_row", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = BestFit(length, open_bins), TaskContext.get().partitionId() << 40

        def placed(rows: pa.Table) -> pa.RecordBatch:
            lengths = rows.column("length").to_numpy()
            at = np.empty((2, len(lengths)), np.int64)
            for k in np.argsort(-lengths, kind="stable").tolist():
                at[:, k] = bins.place(int(lengths[k]))
            return pa.RecordBatch.from_arrays([rows.column("_row").combine_chunks(), pa.array(first + at[0]), pa.array(at[1])], schema=schema)

        # Windows have LOOK_AHEAD rows whatever the size of Arrow's batches, so that packing doesn't depend on it.
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b.select(["_row", "length"]))
            if sum(x.num_rows for x in held) >= LOOK_AHEAD:
                rows = pa.Table.from_batches(held)
                whole = rows.num_rows - rows.num_rows % LOOK_AHEAD
                for k in range(0, whole, LOOK_AHEAD):
                    yield placed(rows.slice(k, LOOK_AHEAD))
                held = rows.slice(whole).to_batches()
        if sum(x.num_rows for x in held):
            yield placed(pa.Table.from_batches(held))

    return cut.join(mapped(dealt, run, "_row long, sequence_id long, offset long"), "_row").drop("_row")


def places(packed: DataFrame) -> DataFrame:
    """The rows of pack() without their ids, which ids_crc32 stands for."""
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences of pack()'s rows, with their pieces in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
