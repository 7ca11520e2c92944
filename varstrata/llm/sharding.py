"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own, (offset + k * skip) mod size. Shards take
turns claiming their next free slot until the table is full. A key's shard is then one lookup; a shard more or less
moves about its own share of the keys. The table has a fixed size, whatever the data: it is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:03d}" for i in range(32))
#: Slots per shard at least; with 100, shares differ by about a hundredth.
SLOTS_PER_SHARD = 100
MAX_SLOTS = 1 << 20


def prime_from(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def lookup(shards=SHARDS, per_shard: int = SLOTS_PER_SHARD) -> list[int]:
    """Slot to index of its shard. Depends on the names alone, not on their number's history."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, at least one")
    size = prime_from(len(shards) * per_shard)
    if size > MAX_SLOTS:
        raise ValueError(f"the table would have {size} slots; it is broadcast and may have {MAX_SLOTS}")
    digest = lambda s, salt: int(hashlib.md5(f"{salt}:{s}".encode()).hexdigest()[:15], 16)
    at = [digest(s, "offset") % size for s in shards]
    skip = [digest(s, "skip") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    out, left = [-1] * size, size
    while left:
        for k in range(len(shards)):
            while out[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            out[at[k]] = k
            left -= 1
            if not left:
                break
    return out


def slot_of(key: Column, size: int) -> Column:
    """The first 8 hexadecimal digits of the key's MD5, modulo size; a null key counts as empty text."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(size).cast("long")).cast("int")


def table_of(spark: SparkSession, shards=SHARDS, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """(slot, shard): the lookup table as a DataFrame of literal text, MAX_SLOTS rows at most."""
    slots = F.split(F.lit(",".join(map(str, lookup(shards, per_shard)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(1).select(F.posexplode(slots).alias("slot", "k")).select("slot", names[F.col("k").cast("int")].alias("shard"))


def assign(rows: DataFrame, key: str, shards=SHARDS, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """rows with the columns slot and shard, which replace columns of these names. Repeated keys go to one shard, null
    ones count as empty text. An empty table gives an empty result.
    """
    size = len(lookup(shards, per_shard))
    kept = [c for c in rows.columns if c not in ("slot", "shard")]
    placed = rows.select(*[F.col(f"`{c}`") for c in kept], slot_of(F.col(key), size).alias("slot"))
    return placed.join(F.broadcast(table_of(rows.sparkSession, shards, per_shard)), "slot", "left").select(*[F.col(f"`{c}`") for c in kept], "slot", "shard")
