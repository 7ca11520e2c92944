"""Personal data by weak supervision.

Base spans come from four patterns with checks. Beside them, wider patterns give candidates: what a base pattern found,
also where its check failed, addresses written with [at], version 6 addresses, national phone numbers, shorter card
numbers, and long keys. Three kinds of labelers vote on every candidate, for (1), against (-1) or not at all (0): one
regular expression (format) and one on its borders (shape), a gazetteer (known endings, issuers, country codes, names of
keys) and the words around it (context). Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is for each kind, without any labelled row, and how likely each pattern is personal data; a
logistic regression on votes and length, fitted to these, decides. Candidates that it accepts and that overlap no base
span are added.

Every document is scanned by expressions alone, in a time that grows little faster than its matches (see common.scan). What reaches the driver are the counts of distinct vote patterns, at
most len(KINDS) * 3**4 * LENGTHS rows; what goes back are the weights, as literals.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrata.llm.common import RUN, let, runs, scan, stash

#: The first four are the base's; the order is that of results.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
LABELERS = ("format", "shape", "gazetteer", "context")
LENGTHS, AROUND = 4, 40
#: Kinds whose format is an exact check.
CHECKED = (IP, CARD)

#: Patterns with possessive quantifiers and look-behinds find the same leftmost matches as the plain ones, without
#: recursion and in linear time on long runs.
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "[A-Za-z0-9-]++"
BASE = {
    EMAIL: rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@{_LABEL}(?:\.{_LABEL})++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"(?<![0-9])(?<![0-9][ -])(?=(?:[0-9][ -]?){13})[0-9]++(?:[ -][0-9]++)*+",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDER = {
    EMAIL: rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?(?:\[at\]|\(at\)|\{{at\}}) ?{_LABEL}(?: ?(?:\.|\[dot\]|\(dot\)) ?{_LABEL})++",
    IP: r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    PHONE: r"(?<![\w.+(-])\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])",
    SECRET: r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{20,}+",
}
#: What a text must hold for a scan to be worth it.
HINT = {EMAIL: "@", IP: r"[0-9]\.[0-9]", CARD: r"(?:[0-9][ -]?){13}", PHONE: r"\+[0-9]"}
WIDER_HINT = {EMAIL: r"[\[({]at[\])}]", IP: r"[0-9A-Fa-f]:[0-9A-Fa-f]", PHONE: r"[0-9]\)?[ .-]{1,2}[0-9]{3}", SECRET: "[A-Za-z0-9_/+-]{20}"}

#: Gazetteers and cue words, per kind.
ENDINGS = "com org net edu gov int info io co uk de fr es it nl eu ch at be us ca au jp br ru pl se no fi dk pt ie".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|62|64|65)"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
KEY_NAMES = r"(?i)(?:token|key|secret|password|passwd|pwd|auth|bearer|credential|api)[\w]*\W{0,4}$"
CUES = {
    EMAIL: "mail|contact|write|courriel|correo|kontakt|schreib|reply|address",
    IP: "ip|host|server|login|addr|adresse|client|visitor|connect",
    CARD: "card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment|cvv",
    PHONE: "phone|call|tel|mobile|fax|cell|whatsapp|telefon|anruf|appel|llam",
    SECRET: "token|key|secret|passw|pwd|auth|bearer|credential|api",
}
COUNTER = "version|isbn|issn|doi|page|seite|figure|chapter|order|invoice|article|commit|sha|md5|checksum|uuid|http|www"


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, b: a + b) % 10 == 0


def base_ok(kind: int, t: Column) -> Column:
    if kind == IP:
        return F.forall(F.split(t, r"\."), lambda x: let(F.regexp_replace(x, "^0+(?=[0-9])", ""), lambda y: (F.length(y) <= 3) & (F.substring(y, 1, 3).cast("int") <= 255)))
    if kind == CARD:
        return let(_digits(t), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == PHONE:
        return F.length(_digits(t)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 where yes, -1 where no (everywhere else, if no is None), 0 otherwise."""
    v = F.when(yes, F.lit(1))
    return (v.otherwise(-1) if no is None else v.when(no, F.lit(-1)).otherwise(0)).cast("tinyint")


def votes(kind: int, wider: bool, ok: Column, t: Column, before: Column, after: Column) -> dict[str, Column]:
    if kind == SECRET:
        form = _vote(t.rlike("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|(?:ghp|gho|sk|pk|xox[abp])[_-].*|AKIA.*)$"), t.rlike("^[0-9-]+$|[_/-]{2}|^[a-z]+(?:[-_/][a-z]+)+[-_/]?[0-9]*$"))
    elif kind == CARD:
        form = _vote(ok, ~let(_digits(t), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))))
    elif wider:
        form = _vote(t.rlike("^(?:[^:]*:){7}[^:]*$|@|\\[at\\]|\\(at\\)|^\\([0-9]{3}\\) ?[0-9]{3}-[0-9]{4}$"), F.lit(False))
    else:
        form = _vote(ok)
    known = {
        EMAIL: _vote(F.lower(F.regexp_extract(t, "([A-Za-z0-9-]+)$", 1)).isin(*ENDINGS)),
        IP: _vote(F.lit(False), t.rlike(r"^(?:0+|127|255)\.")),
        CARD: _vote(_digits(t).rlike(ISSUERS)),
        PHONE: _vote(t.rlike(COUNTRIES), t.startswith("+")),
        SECRET: _vote(F.regexp_replace(before, "[\"'`]$", "").rlike(KEY_NAMES)),
    }[kind]
    around = F.lower(F.concat(before, F.lit(" "), after))
    return {
        "format": form,
        "shape": _vote(~before.rlike(r"[\w.]$") & ~after.rlike(r"^(?:[A-Za-z0-9_@]|[.,-][0-9])")),
        "gazetteer": known,
        "context": _vote(around.rlike(CUES[kind]), around.rlike(COUNTER)),
    }


FIELDS = "array<struct<s:int,e:int,kind:tinyint,base:boolean," + ",".join(f"{x}:tinyint" for x in LABELERS) + ",size:tinyint>>"


def found(text: Column, kind: int, pattern: str, hint: str, wider: bool = False) -> Column:
    """Candidates of one pattern, leftmost and without overlaps: start, end (code points, end exclusive), kind, whether
    the base has it, the votes and the length's class. Places follow from the lengths of matches and of what is between."""
    empty = F.array().cast(FIELDS)

    def candidate(z: Column, i: Column, start: Column) -> Column:
        t, before, after = z["m"][i], F.right(z["p"][i], F.lit(AROUND)), F.left(z["p"][i + 1], F.lit(AROUND))
        ok = F.lit(False) if wider or kind not in BASE else base_ok(kind, t)
        v = votes(kind, wider, ok, t, before, after)
        n = F.length(t)
        size = F.when(n < 10, 0).when(n < 16, 1).when(n < 24, 2).otherwise(3).cast("tinyint")
        return F.struct(start.alias("s"), (start + n).alias("e"), F.lit(kind).cast("tinyint").alias("kind"), ok.alias("base"), *[v[x].alias(x) for x in LABELERS], size.alias("size"))

    def places(z: Column) -> Column:
        steps = F.transform(z["m"], lambda m, i: F.length(z["p"][i]) + F.length(m))
        at = scan(steps, 0, lambda a, b: a + b)
        made = let(at, lambda starts: F.transform(starts, lambda x, i: candidate(z, i, x.cast("int") + F.length(z["p"][i]))))
        return F.when(F.size(z["m"]) == 0, empty).otherwise(made.cast(FIELDS))

    cut = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"))
    return F.when(text.rlike(hint), let(cut, places)).otherwise(empty)


#: Beyond every place in a text.
FAR = (1 << 31) - 1


def outside_of_base(c: Column) -> Column:
    """Candidates in order of their starts, without those that overlap a base span: one that begins before ends after
    them, or one that begins later begins within them."""
    ends = scan(F.transform(c, lambda x: F.when(x["base"], x["e"]).otherwise(0)), 0, F.greatest)
    starts = F.reverse(scan(F.reverse(F.transform(c, lambda x: F.when(x["base"], x["s"]).otherwise(FAR))), FAR, F.least))
    return let(F.struct(ends.alias("ends"), starts.alias("starts")), lambda z: F.filter(c, lambda x, i: x["base"] | ((z["ends"][i] <= x["s"]) & (z["starts"][i] >= x["e"]))))


def candidates(text: Column) -> Column:
    """All candidates of a text, by start, without those that overlap a base span and aren't base spans."""
    t = F.coalesce(text, F.lit(""))
    plain = F.concat(*[found(t, k, p, HINT[k]) for k, p in BASE.items()])
    wide = F.concat(*[found(t, k, p, WIDER_HINT[k], wider=True) for k, p in WIDER.items()])
    both = let(F.sort_array(F.concat(plain, wide)), lambda c: F.when(F.size(c) > 1, outside_of_base(c)).otherwise(c))
    return F.when(t.rlike("[0-9@]|[\\[({]at[\\])}]"), both).otherwise(F.array().cast(FIELDS))


def expectation_maximisation(counts: list[tuple[tuple[int, ...], int]], rounds: int = 40) -> dict[tuple[int, ...], float]:
    """How likely each (kind, votes..., size) is personal data, from the counts of such patterns.

    For each kind, labelers are taken as independent given the truth; their rates of votes are estimated with a prior
    that holds each to be better than chance.
    """
    prior = {1: {1: 6.0, 0: 3.0, -1: 1.0}, 0: {1: 1.0, 0: 3.0, -1: 6.0}}
    out: dict[tuple[int, ...], float] = {}
    for kind in sorted({p[0] for p, _ in counts}):
        rows = [(p, n) for p, n in counts if p[0] == kind]
        post = {p: 1 / (1 + math.exp(-1.5 * sum(p[1:-1]))) for p, _ in rows}
        for _ in range(rounds):
            share = {1: 2.0, 0: 2.0}
            rate = {y: [dict(prior[y]) for _ in LABELERS] for y in (0, 1)}
            for p, n in rows:
                for y, w in ((1, post[p]), (0, 1 - post[p])):
                    share[y] += w * n
                    for k, v in enumerate(p[1:-1]):
                        rate[y][k][v] += w * n
            log = {y: [{v: math.log(c / sum(r.values())) for v, c in r.items()} for r in rate[y]] for y in (0, 1)}
            for p, _ in rows:
                z = {y: math.log(share[y]) + sum(log[y][k][v] for k, v in enumerate(p[1:-1])) for y in (0, 1)}
                post[p] = 1 / (1 + math.exp(min(50.0, max(-50.0, z[0] - z[1]))))
        out |= post
    return out


def _inputs(p: tuple[int, ...]) -> list[float]:
    """Bias, votes, and the length's class as an indicator."""
    return [1.0, *map(float, p[1:-1]), *[float(p[-1] == k) for k in range(LENGTHS)]]


def train(counts: list[tuple[tuple[int, ...], int]], steps: int = 400) -> dict[int, list[float]]:
    """Weights of the span classifier of each kind, fitted to the estimates. Counts enter by their root's share, so that
    a pattern that is all over the corpus doesn't drown the others."""
    post = expectation_maximisation(counts)
    out = {}
    for kind in sorted({p[0] for p, _ in counts}):
        rows = [(_inputs(p), post[p], math.sqrt(n)) for p, n in sorted(counts) if p[0] == kind]
        total, w = sum(n for *_, n in rows), [0.0, *[0.5] * len(LABELERS), *[0.0] * LENGTHS]
        for _ in range(steps):
            grad = [0.002 * x for x in w]
            for x, y, n in rows:
                off = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - y
                for k, v in enumerate(x):
                    grad[k] += off * v * n / total
            w = [a - 0.8 * g for a, g in zip(w, grad, strict=True)]
        out[kind] = w
    return out


def counts_of(spans: DataFrame, column: str = "candidates") -> list[tuple[tuple[int, ...], int]]:
    """(pattern, count) of all candidates: bounded by the number of distinct patterns."""
    keys = ["kind", *LABELERS, "size"]
    rows = spans.select(F.explode(column).alias("c")).groupBy(*[F.col("c")[k].alias(k) for k in keys]).agg(F.count("*").alias("n")).collect()
    return sorted((tuple(int(r[k]) for k in keys), r["n"]) for r in rows)


SPANS = "array<struct<kind:tinyint,s:int,e:int,base:boolean>>"


def _span(c: Column) -> Column:
    return F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), c["base"].alias("base"))


def apart(spans: Column) -> Column:
    """Of ordered spans each that begins after the end of the last one taken."""

    def sweep(acc: Column, c: Column) -> Column:
        free = c["s"] >= acc["end"]
        return F.struct(F.when(free, c["e"]).otherwise(acc["end"]).alias("end"), F.when(free, F.concat(acc["out"], F.array(c))).otherwise(acc["out"]).cast(SPANS).alias("out"))

    def run(acc: Column, r: Column) -> Column:
        part = F.aggregate(r, F.struct(acc["end"].alias("end"), F.array().cast(SPANS).alias("out")), sweep)
        return let(part, lambda x: F.struct(x["end"].alias("end"), F.concat(acc["out"], F.array(x["out"])).cast(f"array<{SPANS}>").alias("out")))

    return F.flatten(F.aggregate(runs(spans), F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{SPANS}>").alias("out")), run)["out"])


def accepted(cands: Column, weights: dict[int, list[float]]) -> Column:
    """The candidates that are base spans or that the classifier takes, by kind and start; of overlapping added ones the
    first stays. An array of (kind, s, e, base). Candidates come in order of their starts.

    What fails an exact check, an address part above 255 or a card's check digit, is never added, whatever the classifier
    says: format votes against it.
    """
    if not weights:
        return F.sort_array(F.transform(cands, _span))

    def takes(c: Column) -> Column:
        said = F.lit(False)
        for kind, w in weights.items():
            z = F.lit(w[0])
            for k, name in enumerate(LABELERS, 1):
                z = z + w[k] * c[name].cast("double")
            for k in range(LENGTHS):
                z = z + F.when(c["size"] == k, w[1 + len(LABELERS) + k]).otherwise(0.0)
            said = F.when(c["kind"] == kind, (z > 0) & (c["format"] >= 0) if kind in CHECKED else z > 0).otherwise(said)
        return said

    added = apart(F.transform(F.filter(cands, lambda c: ~c["base"] & takes(c)), _span).cast(SPANS))
    plain = F.transform(F.filter(cands, lambda c: c["base"]), _span).cast(SPANS)
    return F.sort_array(F.concat(plain, added))


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"].cast("int")], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, found (all spans), base (base spans).

    Null text counts as empty and has no spans. Other columns are ignored; repeated rows give repeated results. With no
    candidate in the whole table there is nothing to learn, and nothing is added.
    """
    held = stash(docs.select("doc_id", candidates(F.col("text")).alias("candidates")), "candidates")
    out = held.select("doc_id", accepted(F.col("candidates"), train(counts_of(held))).alias("found"))
    return out.withColumn("base", F.filter("found", lambda x: x["base"]))


def digest(spans: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return spans.select("doc_id", *[count(k) for k in (EMAIL, IP, CARD, PHONE)], F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))


def masked(text: Column, spans: Column, label: Callable[[Column], Column] | None = None) -> Column:
    """text with every span replaced by its kind in brackets; overlapping spans are replaced once, by the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].cast("int").alias("kind"))))
    name = (lambda k: names[k]) if label is None else label

    def merged(x: Column) -> Column:
        """The first of each row of spans that overlap, up to the end of them all."""
        reach = scan(F.transform(x, lambda v: v["e"]), 0, F.greatest)
        first = let(reach, lambda r: F.filter(F.transform(x, lambda v, i: F.struct(i.alias("i"), r[i].cast("int").alias("reach"), v.alias("v"))), lambda v: v["v"]["s"] >= v["reach"]))
        last = F.array_max(F.transform(x, lambda v: v["e"]))
        return let(first, lambda f: F.transform(f, lambda v, k: F.struct(v["v"]["s"].alias("s"), F.coalesce(F.get(f, k + 1)["reach"], last).alias("e"), v["v"]["kind"].alias("kind"))))

    def rebuilt(m: Column) -> Column:
        """Runs of spans are cut out of the text, then the spans out of their run, so that no cut goes far."""

        def one(r: Column, k: Column) -> Column:
            begin = F.when(k == 0, F.lit(0)).otherwise(m[k * RUN - 1]["e"])
            part = F.struct(begin.alias("at"), F.substring(text, begin + 1, F.element_at(r, -1)["e"] - begin).alias("text"))
            cut = lambda z, i: F.substring(z["text"], F.when(i == 0, z["at"]).otherwise(r[i - 1]["e"]) - z["at"] + 1, r[i]["s"] - F.when(i == 0, z["at"]).otherwise(r[i - 1]["e"]))
            return let(part, lambda z: F.array_join(F.transform(r, lambda x, i: F.concat(cut(z, i), name(x["kind"]))), ""))

        return F.concat(F.array_join(F.transform(runs(m), one), ""), F.substring(text, F.element_at(m, -1)["e"] + 1, F.length(text)))

    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(let(let(by_start, merged), rebuilt))


def redact(docs: DataFrame) -> DataFrame:
    """docs with all personal data in text masked; other columns as they were, except that n_chars, where there is
    one, counts the new text. Rows are written once beside their candidates, so that no text is scanned twice."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), candidates(F.col("text")).alias("candidates"))
    held = stash(packed, "candidates")
    spans = held.select("_row", accepted(F.col("candidates"), train(counts_of(held))).alias("_found")).withColumn("_text", masked(F.col("_row.text"), F.col("_found")))
    new = {"text": F.col("_text"), "n_chars": F.when(F.size("_found") > 0, F.length("_text").cast("long")).otherwise(F.col("_row")["n_chars"]) if "n_chars" in docs.columns else None}
    return spans.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])
