"""Placement on shards by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own: an offset and
a stride from two hashes of its name visit every slot once. Shards take turns; in a turn a
shard claims its next preferred slot that is free, and a shard of weight w takes w turns in
a round. So slots are shared almost evenly, and losing a shard moves few other slots. The
table has a fixed number of slots, whatever the data, and goes to the tasks by broadcast: a
row's slot is a hash of its key, its shard one lookup, and no row is shuffled.

Defined results: a null key is placed as an empty one; equal keys share a shard; an empty
table gives an empty result. All columns pass through; result columns replace input
columns of the same name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
# Hex digits of the key's MD5 that make its slot; 15 fit a bigint.
_DIGITS = 15


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{text}".encode()).hexdigest()[:_DIGITS], 16)


def lookup_table(shards: dict[str, int], slots: int = SLOTS) -> list[int]:
    """For every slot, the position of its shard in `shards` (name to weight)."""
    if not shards or min(shards.values()) < 1:
        raise ValueError("at least one shard, and whole weights from 1")
    if not _is_prime(slots) or slots < sum(shards.values()):
        raise ValueError("the number of slots must be prime and no less than the shards' weights")
    claims = [(_hash(name, "offset") % slots, _hash(name, "stride") % (slots - 1) + 1 if slots > 2 else 1) for name in shards]
    turns = [i for i, weight in enumerate(shards.values()) for _ in range(weight)]
    after = [0] * len(claims)
    table = [-1] * slots
    left = slots
    while True:
        for shard in turns:
            offset, stride = claims[shard]
            slot = (offset + after[shard] * stride) % slots
            while table[slot] >= 0:
                after[shard] += 1
                slot = (offset + after[shard] * stride) % slots
            table[slot] = shard
            after[shard] += 1
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key's text form."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, _DIGITS)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: dict[str, int], slots: int = SLOTS) -> DataFrame:
    """Add slot and shard to every row."""
    spark = df.sparkSession
    names = list(shards)
    owners = [(i, names[s]) for i, s in enumerate(lookup_table(shards, slots))]
    table = spark.createDataFrame(owners, "slot int, shard string")
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard") or c == key]
    placed = df.select(*kept, slot_of(F.col(key), slots).alias("__slot"))
    if key.lower() in ("slot", "shard"):
        placed = placed.drop(key)
    # As many rows as the table has slots, whatever the data.
    return placed.join(F.broadcast(table.withColumnRenamed("slot", "__slot")), "__slot").withColumnRenamed("__slot", "slot")
