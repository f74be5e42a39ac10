"""Operator 2: sharding by a permutation-filled lookup table. DataFrame and SQL functions only.

Each shard ranks all slots of a prime-sized table by a permutation drawn from its name; the shards take turns and each claims
the first free slot of its ranking until the table is full. A row goes to the shard that owns slot md5(key) mod size. Shards
get equal numbers of slots within one, and removing a shard moves few rows of the others. The table has a fixed number of
slots, so its broadcast has a proven bound (`MOST_SLOTS`), and placement is one hash and one lookup, without a shuffle.

A null key is placed like an empty one; equal keys, repeated rows included, always go to one shard; an empty table gives an
empty result. `place` returns only the keys and its own columns, so other columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SHARDS, SLOTS, MOST_SLOTS = 32, 4099, 1 << 20


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def lookup_table(names: Sequence[str], size: int) -> list[int]:
    """The owner of every slot, as an index into names."""
    if size < len(names) or size > MOST_SLOTS or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table needs a prime size of at least {len(names)} and at most {MOST_SLOTS}, not {size}")
    at = [digest(f"{x}/offset") % size for x in names]
    skip = [digest(f"{x}/skip") % (size - 1) + 1 for x in names]
    owner, taken = [-1] * size, 0
    while True:
        for i in range(len(names)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            taken += 1
            if taken == size:
                return owner


def slot_of(key: F.Column, size: int) -> F.Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: int = SHARDS, size: int = SLOTS) -> DataFrame:
    """(key, slot, shard) of every row."""
    owners = ",".join(map(str, lookup_table(shard_names(shards), size)))
    slots = df.sparkSession.sql(f"SELECT pos AS slot, CAST(col AS int) AS shard FROM (SELECT posexplode(split('{owners}', ',')))")
    return df.select(F.col(key), slot_of(F.col(key), size).alias("slot")).join(F.broadcast(slots), "slot").select(key, "slot", "shard")


def write_shards(df: DataFrame, key: str, path: str, shards: int = SHARDS, size: int = SLOTS, files_per_shard: int = 1) -> None:
    """Writes the rows, all columns, as Parquet in a folder for each shard (column `shard_`).

    A shard's rows are dealt to `files_per_shard` tasks in turn, copies too, since a key that a third of the rows hold makes its shard large."""
    owners = ",".join(map(str, lookup_table(shard_names(shards), size)))
    slots = df.sparkSession.sql(f"SELECT pos AS slot_, CAST(col AS int) AS shard_ FROM (SELECT posexplode(split('{owners}', ',')))")
    dealt = df.withColumn("slot_", slot_of(F.col(key), size)).join(F.broadcast(slots), "slot_").drop("slot_")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(files_per_shard))
    dealt.repartition(shards * files_per_shard, "shard_", salt).write.partitionBy("shard_").parquet(path)
