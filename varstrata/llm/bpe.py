"""Byte-level BPE: encoding with segment trees, decoding by table.

A word's bytes are the leaves of a segment tree. A leaf holds the rank of the pair that begins at its byte, joined with
its position, so that the root is the leftmost pair of minimum rank. A merge changes three leaves, the merged token's,
its left neighbour's and the one that is gone, and each change climbs one path. A word of n bytes takes O(n log n).
Short words are encoded together, one tree per row of an array; long ones alone.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varstrata.llm.arrow import mapped, mapper, texts_of

#: Words of up to this many bytes are encoded together.
TOGETHER = 64
#: Stretches of text that a worker remembers with their ids.
REMEMBERED = 300_000
#: Bytes of a key in its table: the stretch, and a last byte for its length and whether a blank stands before it.
WIDE = 24
KEEP = np.where(np.arange(WIDE)[None] < np.arange(WIDE)[:, None], 0xFF, 0).astype(np.uint8).view(np.uint64)
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: ASCII white space (as str.isspace has it), letters, and marks that may follow a word; by byte.
WHITE, LETTER, MARK = (np.array([f(i) for i in range(256)]) for f in (lambda i: i < 128 and chr(i).isspace(), lambda i: i < 128 and chr(i).isalpha(), lambda i: chr(i) in ".,;:!?"))
ODD_WHITE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
NONE = np.iinfo(np.int64).max


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """Which pairs of ids merge, and the bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [i for i in range(256) if bytes([i]) not in ranks]:
            raise ValueError(f"the ranks lack the bytes {missing[:5]}")
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left, right] = rank
        self.top = max(ranks.values()) + 1
        keys = np.array([a * self.top + b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        self.merged = np.append(np.array(list(self.pairs.values()), np.int64)[order], NONE)
        tokens = [b""] * self.top
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where a side is missing (negative) or the pair doesn't merge."""
        key = np.where((left < 0) | (right < 0), NONE, left * self.top + right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def encode_word(self, word: bytes) -> list[int]:
        n, pairs = len(word), self.pairs
        size = 1 << max(0, n - 1).bit_length()
        ids = [int(self.byte[c]) for c in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree: list[tuple[int, int]] = [(NONE, NONE)] * (2 * size)
        for i in range(n - 1):
            if (r := pairs.get((ids[i], ids[i + 1]))) is not None:
                tree[size + i] = (r, i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int) -> None:
            j = after[i]
            r = pairs.get((ids[i], ids[j])) if j < n and ids[i] >= 0 else None
            k = size + i
            tree[k] = (NONE, NONE) if r is None else (r, i)
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while n > 1 and tree[1][0] != NONE:
            r, i = tree[1]
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (j, i, before[i]):
                if k >= 0:
                    put(k)
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            groups.setdefault(1 << max(1, (len(w) - 1).bit_length()) if len(w) <= TOGETHER else 0, []).append(k)
        for size, members in groups.items():
            if not size:
                for k in members:
                    out[k] = self.encode_word(words[k])
                continue
            for at in range(0, len(members), 8192):
                part = members[at : at + 8192]
                for k, ids in zip(part, self._together([words[k] for k in part], size), strict=True):
                    out[k] = ids
        return out

    def _together(self, words: list[bytes], size: int) -> list[list[int]]:
        count = len(words)
        length = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(count, size)
        live = np.arange(size) < length[:, None]
        # One more column at either side: neighbours that don't exist have id -1.
        ids = np.full((count, size + 2), -1, np.int64)
        ids[:, 1:-1] = np.where(live, self.byte[raw], -1)
        after = np.tile(np.arange(1, size + 3), (count, 1))
        before = np.tile(np.arange(-1, size + 1), (count, 1))
        tree = np.full((count, 2 * size), NONE, np.int64)
        place = np.arange(size)
        rank = self.rank(ids[:, 1:-1], ids[:, 2:])
        tree[:, size:] = np.where(rank == NONE, NONE, rank * size + place)
        for k in range(size.bit_length() - 2, -1, -1):
            row = tree[:, 2 << k : 4 << k]
            tree[:, 1 << k : 2 << k] = np.minimum(row[:, ::2], row[:, 1::2])
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            best = tree[rows, 1]
            i, r = best % size + 1, best // size
            j = after[rows, i]
            nxt, prv = after[rows, j], before[rows, i]
            ids[rows, i], ids[rows, j], after[rows, i] = r, -1, nxt
            before[rows, nxt] = i
            gone = np.full(len(rows), NONE)
            for leaf, value in ((j, gone), (i, self.rank(r, ids[rows, nxt])), (prv, self.rank(ids[rows, prv], r))):
                # A left neighbour at the margin, 0, has no leaf: its update lands on the leaf of i, unchanged.
                inside = leaf > 0
                k = size + np.where(inside, leaf, i) - 1
                new = np.where(value == NONE, NONE, value * size + leaf - 1)
                tree[rows, k] = np.where(inside, new, tree[rows, k])
                while k[0] > 1:
                    k = k >> 1
                    tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
            rows = rows[tree[rows, 1] != NONE]
        return [[x for x in row if x >= 0] for row in ids[:, 1:-1].tolist()]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a row of ids."""
        if not len(ids):
            return b""
        n = self.length[ids]
        end = np.cumsum(n)
        return self.flat[np.repeat(self.start[ids] - (end - n), n) + np.arange(end[-1])].tobytes()


def rows_at(starts: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """The indices starts[0], ..., starts[0] + length[0] - 1, starts[1], ...; size is their number."""
    end = np.cumsum(length)
    return np.repeat(starts - (end - length), length) + np.arange(size)


class Words:
    """Cuts texts at single blanks and remembers the ids of the stretches between them, each with the blank before it.

    The pattern's matches never reach over a single blank, so a stretch always has the same ids. Around other white
    space that doesn't hold; texts with such places are encoded as a whole. A mark after a word is a stretch of its own,
    since no match holds letters and marks. Stretches of up to WIDE - 1 bytes are found by their bytes in an open hash
    table of three 64-bit numbers a row, for a whole batch at once; longer ones in a dictionary. When more than `most`
    are known, those that were seen again since the last time are kept, so memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str], list[str]], tuple[np.ndarray, np.ndarray]], spell: bool = False, most: int = REMEMBERED):
        """encode: all ids of words (with a blank before each, which isn't given) and of texts that stand alone, and how
        many ids each has. spell: also keep the ids of a stretch as decimal text."""
        self.encode, self.spell, self.most = encode, spell, most
        self.bits = max(4, (2 * most).bit_length())
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.seen, self.keys = np.zeros(0, np.int32), np.zeros((0, 3), np.uint64)
        self.spelled: list[str] = []
        self._clear()

    def _clear(self) -> None:
        self.table, self.at = np.zeros((1 << self.bits, 3), np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.long: dict[bytes, int] = {}

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = (keys * SPREAD).sum(1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(32))) * SPREAD[0]
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it isn't known."""
        slot, left, out = self._slots(keys), np.arange(len(keys)), np.full(len(keys), -1, np.int64)
        while len(left):
            got = self.at[slot]
            here = (self.table[slot] == keys[left]).all(1) & (got >= 0)
            out[left[here]] = got[here]
            on = (got >= 0) & ~here
            left, slot = left[on], slot[on] + 1 & (1 << self.bits) - 1
        return out

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Keys must differ from each other and from those known."""
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            take = first & (self.at[slot] < 0)
            self.at[slot[take]], self.table[slot[take]] = numbers[left[take]], keys[left[take]]
            left, slot = left[~take], slot[~take] + 1 & (1 << self.bits) - 1

    def _learn(self, names: list[bytes], keys: np.ndarray) -> np.ndarray:
        """names: a mark (1: after a blank, 0: not) and the stretch; keys: of the first of them, the others are long."""
        words, texts = ([k for k, x in enumerate(names) if x[0] == y] for y in (1, 0))
        flat, n = self.encode([names[k][1:].decode() for k in words], [names[k][1:].decode() for k in texts])
        base = len(self.start)
        number = np.empty(len(names), np.int64)
        number[words + texts] = base + np.arange(len(names))
        self.start = np.append(self.start, len(self.flat) + np.cumsum(n) - n)
        self.length, self.flat = np.append(self.length, n), np.append(self.flat, flat.astype(np.int32))
        if self.spell:
            ids, ends = flat.tolist(), np.cumsum(n).tolist()
            self.spelled += [" ".join(map(str, ids[i:j])) for i, j in zip([0, *ends], ends, strict=False)]
        own = np.zeros((len(names), 3), np.uint64)
        own[number[: len(keys)] - base] = keys
        self.seen, self.keys = np.append(self.seen, np.zeros(len(names), np.int32)), np.append(self.keys, own, axis=0)
        if len(self.start) > 1 << (self.bits - 1):
            self.bits = (2 * len(self.start)).bit_length()
            long = self.long
            old = np.setdiff1d(np.arange(base), np.fromiter(long.values(), np.int64, len(long)))
            self._clear()
            self.long = long
            self._put(self.keys[old], old)
        self._put(keys, number[: len(keys)])
        self.long.update(zip(names[len(keys) :], number[len(keys) :].tolist(), strict=True))
        return number

    def _shrink(self) -> None:
        long = {k: name for name, k in self.long.items()}
        keep = np.flatnonzero(self.seen > 1)
        keep = keep[np.sort(np.argsort(-self.seen[keep], kind="stable")[: self.most // 2])]
        n = self.length[keep]
        self.flat = self.flat[rows_at(self.start[keep], n, int(n.sum()))]
        self.start, self.length, self.keys, self.seen = np.cumsum(n) - n, n, self.keys[keep], np.zeros(len(keep), np.int32)
        self.spelled = [self.spelled[k] for k in keep.tolist()] if self.spell else []
        self._clear()
        self.long = {long[k]: i for i, k in enumerate(keep.tolist()) if k in long}
        short = np.setdiff1d(np.arange(len(keep)), np.fromiter(self.long.values(), np.int64, len(self.long)))
        self._put(self.keys[short], short)

    def batch(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """The ids of each text, and their decimal text if they are spelled."""
        if len(self.start) > self.most:
            self._shrink()
        raw = [t.encode("utf-8", "replace") for t in texts]
        b = np.frombuffer(b" " + b" ".join(raw) + b" " + b"\0" * WIDE, np.uint8)
        begin = np.cumsum([0, *(len(x) + 1 for x in raw)])  # of each text, at the blank before it
        body = b[: begin[-1] + 1]
        white, blank = WHITE[body], body == 32
        apart = np.flatnonzero(white[:-1] & white[1:] & (blank[:-1] | blank[1:]))
        whole = np.array([ODD_WHITE.search(t) is not None for t in texts], bool)
        whole[np.searchsorted(begin, apart, side="right") - 1] = True
        at = np.flatnonzero(blank)
        owner = np.searchsorted(begin, at[:-1], side="right") - 1
        ok = ~whole[owner]
        start, size, owner = at[:-1][ok] + 1, (np.diff(at) - 1)[ok], owner[ok]
        alone = start - 1 == begin[owner]  # a text's first stretch has no blank before it
        last, prior, third = b[start + size - 1], b[np.maximum(start + size - 2, 0)], b[np.maximum(start + size - 3, 0)]
        marked = (size > 1) & MARK[last] & (LETTER[prior] | (size > 2) & (third == 0xC3) & (prior != 0x97) & (prior != 0xB7) & (prior >= 0x80))
        # Marks follow their words in the row of stretches.
        times = 1 + marked
        place = np.cumsum(times) - times
        count = int(times.sum())
        s, n, o, f = (np.empty(count, np.int64) for _ in range(4))
        s[place], n[place], o[place], f[place] = start, size - marked, owner, ~alone
        tail = place[marked] + 1
        s[tail], n[tail], o[tail], f[tail] = start[marked] + size[marked] - 1, 1, owner[marked], 0
        number = np.empty(count, np.int64)
        wide = n >= WIDE
        short = np.flatnonzero(~wide)
        keys = np.lib.stride_tricks.as_strided(b, (len(b) - WIDE + 1, WIDE), (1, 1))[s[short]].view(np.uint64) & KEEP[n[short]]
        keys[:, 2] |= (n[short] | f[short] << 7).astype(np.uint64) << np.uint64(56)
        number[short] = found = self._find(keys)
        missing = np.flatnonzero(found < 0)
        names: dict[bytes, int] = {}
        data = body.tobytes()
        spell = lambda k: (b"\1" if f[k] else b"\0") + data[s[k] : s[k] + n[k]]
        new = [names.setdefault(spell(k), i) for i, k in zip(missing.tolist(), short[missing].tolist(), strict=True)]
        lasting = np.fromiter(names.values(), np.int64, len(names))
        far = np.flatnonzero(wide).tolist()
        rest = [spell(k) for k in far]
        names_long = list(dict.fromkeys(x for x in rest if x not in self.long))
        if names or names_long:
            got = self._learn([*names, *names_long], keys[lasting])
            to = np.zeros(len(keys), np.int64)
            to[lasting] = got[: len(lasting)]
            number[short[missing]] = to[new]
        if far:
            number[far] = [self.long[x] for x in rest]
        self.seen += np.minimum(np.bincount(number, minlength=len(self.seen)), 1 << 20).astype(np.int32)
        each = self.length[number]
        ids = self.flat[rows_at(self.start[number], each, int(each.sum()))]
        ends = np.cumsum(np.bincount(o, weights=each, minlength=len(texts))).astype(np.int64).tolist()
        stretch = np.cumsum(np.bincount(o, minlength=len(texts))).tolist()
        names_of = number.tolist() if self.spell else []
        out = []
        for k, t in enumerate(texts):
            if whole[k]:
                own = self.encode([], [t])[0]
                out.append((own, " ".join(map(str, own.tolist())) if self.spell else ""))
            else:
                i, j = (stretch[k - 1] if k else 0), stretch[k]
                out.append((ids[ends[k - 1] if k else 0 : ends[k]], " ".join(filter(None, map(self.spelled.__getitem__, names_of[i:j]))) if self.spell else ""))
        return out


def by_pattern(pattern: str, merges: Merges) -> Callable[[list[str], list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encodes words and texts: every match of pattern by itself, equal matches once."""
    cut = regex.compile(pattern).findall

    def encode(words: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = cut("".join(" " + w for w in words))
        # Matches that begin with a blank are where a word begins: no word has another one.
        owner = np.cumsum(np.fromiter((m[0] == " " for m in found), np.int64, len(found))) - 1
        owners = [owner]
        for k, t in enumerate(texts, len(words)):
            more = cut(t)
            found += more
            owners.append(np.full(len(more), k))
        number = {m: k for k, m in enumerate(dict.fromkeys(found))}
        ids = merges.encode_words([m.encode("utf-8", "replace") for m in number])
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.array([i for x in ids for i in x], np.int64)
        use = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        n = size[use]
        end, first = np.cumsum(n), np.cumsum(size) - size
        out = flat[np.repeat(first[use] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        return out, np.bincount(np.concatenate(owners), weights=n, minlength=len(words) + len(texts)).astype(np.int64)

    return encode


class Whole:
    """Encodes every text by itself."""

    def __init__(self, encode: Callable[[list[str], list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode

    def batch(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        return [(self.encode([], [t])[0], "") for t in texts]


_loaded: dict[tuple[str, str], tuple[Merges, Words | Whole]] = {}


def loaded(path: str, pattern: str) -> tuple[Merges, Words | Whole]:
    """One copy for each Python worker, whatever the number of its tasks."""
    if (path, pattern) not in _loaded:
        merges = Merges(read_ranks(path))
        # Words knows where matches of this one pattern begin; texts are cut by any other one as a whole.
        kind = Words if pattern == public_tokenizers.PATTERN else Whole
        _loaded[path, pattern] = merges, kind(by_pattern(pattern, merges))
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of docs: doc_id, ids and decoded, the text that comes back from the ids.

    The ids are those of the ranks in the file at path, which must be at the same place on every executor. Null text
    counts as empty: no tokens and an empty text. Special tokens don't exist. Other columns are ignored, repeated rows
    give repeated results, an empty table gives none.
    """

    def body(b: pa.RecordBatch) -> list:
        merges, words = loaded(path, pattern)
        ids = [x for x, _ in words.batch(texts_of(b))]
        return [b.column("doc_id"), [x.astype(np.int32) for x in ids], [merges.decode(x) for x in ids]]

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    return mapped(docs.select("doc_id", "text"), mapper(body, schema), "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as decimal numbers between blanks) and decoded_sha256 of encode's rows."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The digests of encode's rows."""
    return digests(encode(docs, path, pattern))
