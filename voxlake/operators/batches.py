"""Whole regions in batches: voxels are dealt by region once and stream through numpy, many regions at a time.

A task holds one batch (about ROWS voxels, or one region that is larger), whatever the input; the number of tasks grows with
the tables that are read. Neighbours are looked up by packed places, so no pair of voxels is ever a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Voxels of a batch, bytes of tables that a task deals with, and slices of a slab.
ROWS, TASK_BYTES, SLAB = 60_000, 8 << 20, 32
TYPES = {"int": (np.int32, pa.int32()), "bigint": (np.int64, pa.int64()), "double": (np.float64, pa.float64()), "boolean": (bool, pa.bool_()), "string": (object, pa.string())}


def tasks(df: DataFrame) -> int:
    """Tasks for an exchange of df: as set, or more where the tables below it are large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    told = sum(s for s in sizes if s < 1 << 50)  # frames made from rows have no size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), told // TASK_BYTES)


def in_slabs(df: DataFrame, z: str, ahead: int) -> DataFrame:
    """df with its rows in every slab from that of slice z to that of `ahead` slices on, as columns slab and slab_ (a key)."""
    slabs = F.sequence(*[F.floor((F.col(z) + more) / SLAB).cast("int") for more in (0, ahead)])
    return df.withColumn("slab", F.explode(slabs)).withColumn("slab_", F.col("slab"))


class Places:
    """Places of voxels, g the number of their region (sorted), in the order of region, z, y, x, with a margin around each region."""

    def __init__(self, g: np.ndarray, xyz: Sequence[np.ndarray], reach: int = 1):
        first = np.flatnonzero(np.diff(g, prepend=-1))
        which = np.cumsum(np.diff(g, prepend=-1) > 0) - 1
        self.lows = [np.minimum.reduceat(a, first)[which].astype(np.int64) if len(a) else a for a in xyz]
        x, y, z = (a - low + reach for a, low in zip(xyz, self.lows, strict=True))
        far = [int(a.max(initial=0)) + reach + 1 for a in (x, y, z)]
        self.stride = (1, far[0], far[0] * far[1])
        self.whole = far[0] * far[1] * far[2]
        key = x + y * self.stride[1] + z * self.stride[2] + g * self.whole
        self.order = np.argsort(key, kind="stable")
        self.key, self.g, self.z = key[self.order], g[self.order], z[self.order] - reach
        total = self.whole * (int(g.max(initial=0)) + 1)
        self.table = None
        if total <= 64 * len(key) + (1 << 20):
            self.table = np.full(total, -1, np.int32)
            self.table[self.key] = np.arange(len(key), dtype=np.int32)

    def step(self, offset: Sequence[int]) -> int:
        return sum(a * s for a, s in zip(offset, self.stride, strict=True))

    def at(self, key: np.ndarray) -> np.ndarray:
        """Numbers of the voxels at packed places, -1 where none is."""
        if self.table is not None:
            return self.table[key]
        found = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        return np.where(self.key[found] == key, found, -1) if len(self.key) else np.full(len(key), -1)

    def pairs(self, offset: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the voxels with a neighbour at an offset, and of these neighbours."""
        near = self.at(self.key + self.step(offset))
        here = np.flatnonzero(near >= 0)
        return here, near[here]


def tally(columns: Sequence[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of whole numbers from 0 up, sorted, with their counts or the sums of n."""
    sizes = [int(c.max(initial=0)) + 1 for c in columns]
    key = np.zeros(len(columns[0]), np.int64)
    for c, s in zip(columns, sizes, strict=True):
        key = key * s + c
    size = int(np.prod([float(s) for s in sizes]))
    if size <= 4 * len(key) + 1024:
        here = np.bincount(key, minlength=size)
        rows = np.flatnonzero(here)
        total = here[rows] if n is None else np.bincount(key, n, size)[rows]
    elif n is None:
        rows, total = np.unique(key, return_counts=True)
    else:
        rows, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, n, len(rows))
    out, rest = [], rows
    for s in reversed(sizes):
        rest, last = np.divmod(rest, s)
        out.append(last)
    return out[::-1], total if n is None or n.dtype.kind == "f" else np.rint(total).astype(np.int64)


def streamed(df: DataFrame, keys: Sequence[str], work: Callable[[np.ndarray, dict[str, np.ndarray]], Iterator[dict[str, np.ndarray]]], schema: str) -> DataFrame:
    """(keys, columns of schema). work gets the group's number of every row and the other columns of df, for some whole groups,
    and yields columns, among them `group` with the groups' numbers. Columns other than keys must not be null."""
    kinds = dict(df.dtypes)
    fields = [f.split() for f in schema.split(", ")]
    values = [c for c in df.columns if c not in keys]
    dealt = df.select(*keys, *values).repartition(tasks(df), *keys).sortWithinPartitions(*keys)

    def made(table: pa.Table, g: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        for out in work(g, {c: table.column(c).to_numpy() for c in values}):
            rows = pa.array(first[out["group"]])
            if len(rows):
                columns = [table.column(k).combine_chunks().take(rows) for k in keys]
                for name, kind in fields:
                    dtype, arrow = TYPES[kind]
                    columns.append(pa.array(np.asarray(out[name]).astype(dtype), arrow, from_pandas=True))
                yield pa.RecordBatch.from_arrays(columns, [*keys, *[f[0] for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, wanted = [], 0, ROWS
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < wanted:
                continue
            table = pa.Table.from_batches(held)
            g, first = numbered(table)
            if len(first) > 1:
                yield from made(table.slice(0, first[-1]), g[: first[-1]], first[:-1])
            table = table.slice(first[-1])
            held, rows = table.combine_chunks().to_batches(), table.num_rows
            wanted = max(ROWS, 2 * rows)
        if rows:
            table = pa.Table.from_batches(held)
            g, first = numbered(table)
            yield from made(table, g, first)

    def numbered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            code = pc.fill_null(table.column(k).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.cumsum(new) - 1, np.flatnonzero(new)

    return dealt.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"`{n}` {kind}" for n, kind in fields]]))
