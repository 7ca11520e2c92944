"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line of a text, or any window of its words, across lines, that is a quarter longer than the template. A
template matches a block if at least CONTAINMENT of the template's distinct words occur in it. Words have one global
order, by document frequency in the whole corpus, rarest first (ties by spelling), and both sides are sorted by it; a
block's words that no template holds are left out. Their first shared word then stands within the first |T| - need + 1
words of the template and the first |B| - need + 1 of the block (prefix filter, both sides), blocks of fewer than need
words match nothing (length filter), and a pair is dropped unless enough words are left on both sides from that word on
(positional filter). What remains is verified exactly. Windows are looked at only for templates that the whole text's
words match. The templates are a fixed small table, so the index lives in each task and nothing is shuffled but the
counts of the templates' words.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varstrata.llm.arrow import mapped, mapper, sliced, texts_of

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Phrase: label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: (label, text) of the templates; one label may have several.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("reserved", "no part of this publication may be reproduced distributed or transmitted without prior written permission"),
]
#: Per cent of a template's distinct words that a block must hold.
CONTAINMENT = 90


def words(text: str) -> list[bytes]:
    """Words after lower-casing A to Z, as UTF-8."""
    return WORD.findall(text.encode("utf-8", "replace").lower())


def phrase_places(found: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand one after the other."""
    line, out = b" " + b" ".join(found) + b" ", []
    for phrase, label in phrases.items():
        seek, at = f" {phrase} ".encode(), -1
        while (at := line.find(seek, at + 1)) >= 0:
            out.append((at, label))
    out.sort()
    places, seen, before = [], 0, 0
    for at, label in out:
        before += line.count(b" ", seen, at)
        seen = at
        places.append((before, label))
    return places


def corpus_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> Counter:
    """In how many texts of docs each word of the vocabulary occurs; at most one row per word reaches the driver."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        total: Counter = Counter()
        for b in sliced(batches):
            for t in texts_of(b):
                total.update(vocabulary.intersection(words(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], schema=schema)

    rows = mapped(docs.select("text"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return Counter({bytes(r["word"]): r["n"] for r in rows})


class Index:
    """The prefixes of the templates under a global order of words."""

    def __init__(self, templates: list[tuple[str, str]], frequency: Counter, percent: int = CONTAINMENT):
        self.sets, self.spans = [], []
        vocabulary = sorted({w for _, t in templates for w in words(t)}, key=lambda w: (frequency.get(w, 0), w))
        self.place = {w: k for k, w in enumerate(vocabulary)}
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for label, text in templates:
            ordered = sorted(self.place[w] for w in set(words(text)))
            need = -(-percent * len(ordered) // 100)
            if not ordered or not need:
                raise ValueError("templates need words, the threshold must be positive")
            for at, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.prefix.setdefault(w, []).append((len(self.sets), at))
            self.sets.append((label, frozenset(vocabulary[w] for w in ordered), need))
            self.spans.append(-(-5 * len(words(text)) // 4))
        self.least = min(need for *_, need in self.sets) if self.sets else 1
        self.rare = frozenset(vocabulary[w] for w in self.prefix)

    def candidates(self, block: set[bytes]) -> list[int]:
        """Numbers of the templates that prefixes, lengths and positions don't rule out."""
        ordered = sorted(self.place[w] for w in block if w in self.place)
        n, first = len(ordered), {}
        for at, w in enumerate(ordered[: max(0, n - self.least + 1)]):
            for k, i in self.prefix.get(w, ()):
                if k not in first:
                    _, tokens, need = self.sets[k]
                    first[k] = min(len(tokens) - i, n - at) >= need
        return [k for k, possible in first.items() if possible]

    def matched(self, block: set[bytes]) -> list[tuple[int, int]]:
        """(number, shared words) of the templates that block matches."""
        shared = ((k, len(self.sets[k][1] & block)) for k in self.candidates(block))
        return [(k, n) for k, n in shared if n >= self.sets[k][2]]

    def within(self, found: list[bytes], k: int) -> int:
        """The most words of template k that any window of found shares; 0 if no window matches."""
        _, tokens, need = self.sets[k]
        at = [i for i, w in enumerate(found) if w in tokens]
        held: Counter = Counter()
        best, first = 0, 0
        for i in at:
            held[found[i]] += 1
            while at[first] <= i - self.spans[k]:
                held[found[at[first]]] -= 1
                if not held[found[at[first]]]:
                    del held[found[at[first]]]
                first += 1
            best = max(best, len(held))
        return best if best >= need else 0


def scan(docs: DataFrame, phrases=None, templates=None, percent: int = CONTAINMENT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    n_blocks, the number of lines that match a template and of templates that match across lines alone.

    score is 1 where a phrase stands, else the largest containment of a matched template, else 0. Null text counts as
    empty: no words, no labels, score 0. Other columns are ignored; repeated rows give repeated results.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    index = Index(templates, corpus_frequencies(docs, {w for _, t in templates for w in words(t)}), percent)

    def one(text: str) -> tuple:
        found = words(text)
        places = phrase_places(found, phrases)
        base = sorted({label for _, label in places})
        labels, best, blocks = set(base), 1.0 if places else 0.0, 0
        if not index.rare.isdisjoint(found):
            lined: set[int] = set()
            for line in text.split("\n"):
                hits = index.matched(set(words(line)))
                blocks += bool(hits)
                lined.update(k for k, _ in hits)
                for k, shared in hits:
                    labels.add(index.sets[k][0])
                    best = max(best, shared / len(index.sets[k][1]))
            for k, _ in index.matched(set(found)):
                if shared := index.within(found, k):
                    blocks += k not in lined
                    labels.add(index.sets[k][0])
                    best = max(best, shared / len(index.sets[k][1]))
        at = [p for p, _ in places] or [None]
        return len(found), len(places), at[0], at[-1], ",".join(base), ",".join(sorted(labels)), best, blocks

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_blocks", pa.int64())])

    def body(b: pa.RecordBatch) -> list:
        return [b.column("doc_id"), *map(list, zip(*map(one, texts_of(b)), strict=True))] if b.num_rows else [[]] * len(schema)

    return mapped(docs.select("doc_id", "text"), mapper(body, schema), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long")
