"""URL filters: fixed rules by host and path first, else a logistic regression on hashed character trigrams of host and
path, trained from a small labelled table. Scoring is one expression per row: no shuffle, no broadcast beyond a literal
array of weights."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrata.llm.common import let, lower_ascii

#: (verdict, host, path prefix). A rule holds for its host and all subdomains.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Names and paths that the labelled table is made of. They are common subjects of unwanted and of wanted sites, and come
#: from no table of pages.
_UNWANTED = (
    "casino poker slots betting jackpot roulette lottery gambling viagra cialis pills steroids xanax porn xxx sex nude escort camgirls hookup adult payday loans cash "
    "forex doubler replica rolex fake counterfeit spam malware phishing keygen crack warez torrent botnet clickbait adware popunder doorway backlinks linkfarm cheap miracle prizes bets ads"
).split()
_WANTED = (
    "library museum university school college institute journal news weather wiki encyclopedia dictionary archive history science physics biology chemistry mathematics geography "
    "astronomy medicine hospital health government parliament council recipes cooking gardening travel hotel railway music orchestra theatre film books poetry literature philosophy "
    "language software docs developer forum blog photography painting sports football cycling running family education children charity church market bakery cafe bicycle "
    "furniture energy climate engineering architecture"
).split()
_BAD_PATHS = "/casino-bonus /free-spins /xxx-videos /buy-viagra /cheap-pills /nude-pics /win-prizes /payday-loans /crack-download /hot-bets /click-ads /adult-cams".split()
_GOOD_PATHS = "/about /wiki/history /docs/install /news/2021/05 /articles/science /recipes/bread /history/rome /guide/start /questions/how /blog/travel /library/books /contact".split()
#: What both kinds of hosts have around their names, so that the names decide.
_FRAMES = ["{}.com", "www.{}.net", "{}-online.org", "my-{}.info", "{}hub.com", "the{}.example.com", "{}-shop.net", "best-{}.co", "{}.example.net"]
_NEUTRAL = "site page home server portal domain".split()
#: Names that say nothing; they are wanted, so that what isn't known is allowed.
_PLAIN = "acme globex initech northwind contoso hooli vandelay wonka anderson brown schmidt martin garcia rossi kowalski nakamura lindqvist dubois oliveira novak".split()


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, label) of the labelled table: 1 unwanted, 0 wanted. Every name stands in three frames with a path that
    says nothing, and every path on hosts that say nothing."""
    rows, plain = [], ["/", "/index.html", "/en/12", "/item", "/de/853/", "/page/2", "/fr/474.html"]
    for names, label in ((_UNWANTED, 1), (_WANTED, 0), (_PLAIN, 0)):
        rows += [(_FRAMES[(k + 4 * j) % len(_FRAMES)].format(name), plain[(k + j) % len(plain)], label) for k, name in enumerate(names) for j in range(3)]
    for paths, label in ((_BAD_PATHS, 1), (_GOOD_PATHS, 0)):
        rows += [(_FRAMES[(k + j) % len(_FRAMES)].format(host), path, label) for k, path in enumerate(paths) for j, host in enumerate(_NEUTRAL)]
    return rows


LABELLED = tuple(labelled_urls())
DIM, EPOCHS, RATE, SPEED, L2, SCALE = 4096, 120, 0.5, 1000, 1e-5, 1 << 20
#: Spread of the trigram hash, and what sets host and path apart.
MIX, HOST_SALT, PATH_SALT = 40503, 17, 7919


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(after)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null. At equal length the one given first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def gram_slots(text: str, salt: int, dim: int = DIM) -> list[int]:
    """Slots of the trigrams of text between marks; the same integers as slots()."""
    c = [ord(x) for x in f"^{text}$"]
    return [((a * 961 + b * 31 + d + salt) * MIX // 16) % dim for a, b, d in zip(c, c[1:], c[2:], strict=False)]


def slots(text: Column, salt: int, dim: int = DIM) -> Column:
    codes = F.transform(F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit("(?s)."), 0), lambda ch: F.ascii(ch).cast("long"))
    slot = lambda c, i: F.expr(f"{MIX}L") * (c[i] * 961 + c[i + 1] * 31 + c[i + 2] + salt)
    return let(codes, lambda c: F.when(F.size(c) < 3, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.pmod(F.call_function("shiftright", slot(c, i), F.lit(4)), F.lit(dim).cast("long")))))


@functools.lru_cache(maxsize=4)
def train(labelled: tuple[tuple[str, str, int], ...] = LABELLED, dim: int = DIM, epochs: int = EPOCHS) -> tuple[list[int], int]:
    """Weights and bias in fixed point (SCALE to 1), so that sums don't depend on their order. The labelled table is
    small and part of the module; full-batch steps over it run on the driver, without a job."""
    if len(labelled) > 10_000:
        raise ValueError("the labelled table is meant to be small: at most 10,000 rows")
    rows = [(gram_slots(h, HOST_SALT, dim) + gram_slots(p, PATH_SALT, dim), y) for h, p, y in labelled]
    w, bias = [0.0] * dim, 0.0
    for _ in range(epochs):
        step, lift = {}, 0.0
        for f, y in rows:
            z = bias + sum(w[k] for k in f) / len(f)
            off = y - 1 / (1 + math.exp(-z))
            lift += off
            for k in f:
                step[k] = step.get(k, 0.0) + off / len(f)
        bias += RATE * lift / len(rows)
        for k, g in step.items():
            w[k] += RATE * SPEED * (g / len(rows) - L2 * w[k])
    return [round(x * SCALE) for x in w], round(bias * SCALE)


def filter_urls(pages: DataFrame, rules=None, labelled=LABELLED, url: str = "url", key: str = "page_id") -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict (allow or block) and the model's margin.

    A null url or one without "://" has an empty host and path, and is judged by the model's bias and marks alone.
    Repeated rows are judged alike, a margin of 0 is allowed; other columns are ignored; an empty table gives none.
    """
    weights, bias = train(tuple(labelled))
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<long>")
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    name, said = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    used = F.concat(slots(F.col("host"), HOST_SALT), slots(F.col("path"), PATH_SALT))
    total = let(table, lambda w: let(used, lambda f: F.aggregate(f, F.lit(0).cast("long"), lambda s, k: s + w[k.cast("int")]) + bias * F.size(f).cast("long")))
    return rows.withColumn("margin", total.cast("long")).select(key, "host", "path", name.alias("rule"), F.coalesce(said, F.when(F.col("margin") > 0, "block").otherwise("allow")).alias("verdict"), "margin")
