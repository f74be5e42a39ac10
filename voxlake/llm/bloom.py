"""Blocked Bloom filters over uniform 64-bit hashes: built by Spark, probed in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Lanes of 32 bits in a block of a Bloom filter, keys a block, and the most blocks that are broadcast (32 MB). Beyond, there is
#: no filter, and the joins that follow it see all rows.
LANES, KEYS_A_BLOCK, MOST_BLOCKS = 8, 16, 1 << 20


def bloom(keys: DataFrame, column: str) -> np.ndarray | None:
    """Lanes of a blocked Bloom filter over a column of uniform 64-bit hashes, None where there are too many keys for one.

    The number of blocks follows the number of keys; MOST_BLOCKS rows at most reach the driver."""
    n = keys.count()
    if n > MOST_BLOCKS * KEYS_A_BLOCK:
        return None
    blocks = 1 << max(8, int(n // KEYS_A_BLOCK).bit_length())
    c = F.col(column)
    rows = (
        keys.select(c.bitwiseAND(blocks - 1).cast("int").alias("block"), *[F.shiftrightunsigned(c, 22 + 5 * i).bitwiseAND(31).cast("int").alias(f"b{i}") for i in range(LANES)])
        .groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(1, b{i})")).alias(f"l{i}") for i in range(LANES)])
    ).toPandas()
    lanes = np.zeros((blocks, LANES), np.int32)
    lanes[rows.block.to_numpy()] = rows[[f"l{i}" for i in range(LANES)]].to_numpy(np.int32)
    return lanes


def maybe(lanes: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    if lanes is None:
        return out
    u = keys.view(np.uint64)
    block = (u & np.uint64(len(lanes) - 1)).astype(np.int64)
    for i in range(LANES):
        bit = (u >> np.uint64(22 + 5 * i) & np.uint64(31)).astype(np.int32)
        out &= (lanes[block, i] >> bit & 1) == 1
    return out
