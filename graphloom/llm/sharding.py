"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a table of prime size in an order of its own (start and step from hashes of its
name).  In turns, each claims its next free slot until the table is full.  A key belongs to the shard in the slot of
its hash.  Shards hold equal shares of the slots to within one, and taking one shard away moves few other keys.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh

SLOTS, SHARDS = 8209, 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, isqrt(n) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Which shard each slot belongs to.  slots: a prime, a hundred times the shards for shares equal to one per cent."""
    if not is_prime(slots) or not shards or slots < len(shards) or len(set(shards)) < len(shards):
        raise ValueError("the table needs a prime size, no less than the number of shards, and shards of different names")

    def number(name: str, salt: str) -> int:
        return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")

    at = [number(s, "start") % slots for s in shards]
    step = [number(s, "step") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: 60 bits of the md5 of its text, null as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def assign_shards(df: DataFrame, key_cols: list[str], shards: list[str] | None = None, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with the slot and the number of the shard of each row; columns of those names are replaced.

    The table travels with the plan as a constant of 4 bytes a slot: no join, no shuffle, constant time per row.
    Rows with equal keys share a shard; null keys are the empty text; keys may be of any length, as only their md5 counts.
    Key columns are joined by a zero byte.  An empty table gives an empty table with both columns.
    """
    shards = shards or shard_names()
    table = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",").cast("array<int>")
    key = col(key_cols[0]).cast("string") if len(key_cols) == 1 else F.concat_ws("\0", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in key_cols])
    kept = [col(c) for c in df.columns if c.lower() not in (slot_col.lower(), shard_col.lower())]
    out = df.select(*kept, slot_of(key, slots).alias(slot_col))
    return out.select("*", F.get(table, F.col(slot_col)).alias(shard_col))


def spread_hot_keys(df: DataFrame, key_cols: list[str], shards: list[str] | None = None, slots: int = SLOTS, ways: int = 16, row_key: str | None = None) -> DataFrame:
    """assign_shards() for sinks in which one key may hold a large share of the rows: a key's rows go to up to ``ways`` shards.

    Which one is told by row_key, or by the whole row without it, so a task that runs again deals alike; equal rows stay together.
    """
    by = [col(row_key)] if row_key else [col(c) for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    salt = fresh(df, "gl_salt")
    salted = df.select(*[col(c) for c in df.columns], F.pmod(F.xxhash64(*by), F.lit(ways)).cast("string").alias(salt))
    return assign_shards(salted, [*key_cols, salt], shards or shard_names(), slots).drop(salt)
