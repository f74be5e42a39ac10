"""Texture matrices as sparse relations, and their features.

A matrix is a relation of counts n by (image_id, roi, mode, unit, i, k). Voxels are dealt by region once and stream through numpy
in batches of whole regions (see `batches`): neighbours, runs and zones are found there, counted and, for features, summed up, so
what leaves a task is a matrix or a row of features. All modes are re-aggregations of the same counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voxlake.operators.batches import Places, streamed, tally

ROI = ["image_id", "roi"]
UNIT = [*ROI, "mode", "unit"]
#: Thirteen directions, the first component that is not 0 is 1; the four in a slice come first.
DIRECTIONS = [(1, -1, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)] + [
    (a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 1) if a or b == 1 or (b == 0 and c == 1)
]
MODES6 = ("2D_avg", "2D_comb", "2_5D_avg", "2_5D_comb", "3D_avg", "3D_comb")
MODES3 = ("2D", "2_5D", "3D")


#: Stands for a missing level among whole numbers.
NONE = -(1 << 31)
Columns = dict[str, np.ndarray]
#: A matrix: the region and the unit of every row, levels i, second index k, counts n.
Cells = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def entropy(p: Column) -> Column:
    return F.coalesce(-F.sum(F.when(p > 0, p * F.log2(p))), F.lit(0.0))


def by_region(q: DataFrame, work: Callable[[Mask], Iterator[Columns]], schema: str) -> DataFrame:
    """(image_id, roi, columns of schema) of whole regions; see `streamed`."""
    rows = q.select(*ROI, "x", "y", "z", F.coalesce("level", F.lit(NONE)).alias("level"))
    return streamed(rows, ROI, lambda g, c: work(Mask(g, c)), schema)


class Mask:
    """The voxels of some regions; those with a level in the order of their places."""

    def __init__(self, g: np.ndarray, c: Columns):
        self.g, self.xyz, self.regions = g, [c[a] for a in "xyz"], int(g.max(initial=-1)) + 1
        self.z = c["z"] - np.minimum.reduceat(c["z"], np.flatnonzero(np.diff(g, prepend=-1)))[g]
        self.known = np.flatnonzero(c["level"] != NONE)
        self.places = Places(g[self.known], [a[self.known] for a in self.xyz])
        self.known = self.known[self.places.order]
        self.level = c["level"][self.known].astype(np.int64)
        # Levels are numbered from 0 up on the way through a table of counts.
        self.least = int(self.level.min(initial=0))

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Region and slice of the voxels with a level."""
        return self.g[self.known], self.z[self.known]

    def same(self, offset: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Voxels with a neighbour of their own level at an offset, and these neighbours."""
        a, b = self.places.pairs(offset)
        equal = self.level[a] == self.level[b]
        return a[equal], b[equal]


def units(modes: Sequence[str], z: np.ndarray, d: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each mode the rows of counts by slice and direction that belong to it, and their units."""
    flat, everywhere = np.flatnonzero(d < 4), np.arange(len(d))
    for mode in modes:
        rows = everywhere if mode.startswith("3D") else flat
        unit = {"2D_avg": z * 4 + d, "2D_comb": z, "2_5D_avg": d, "3D_avg": d}.get(mode, np.zeros(len(d), np.int64))
        yield mode, rows, unit[rows]


def directions(modes: Sequence[str]) -> list[tuple[int, int, int]]:
    return DIRECTIONS if any(m.startswith("3D") for m in modes) else DIRECTIONS[:4]


def numbered(region: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of every row's unit (region, unit); the units' regions; how many there are."""
    width = int(unit.max(initial=0)) + 1
    which, at = np.unique(region * width + unit, return_inverse=True)
    return at, which // width, len(which)


def means(metrics: Columns, region: np.ndarray, regions: int, over: np.ndarray | None = None) -> Columns:
    """Means over the units of each region, or sums over `over`; of regions with a unit."""
    count = np.bincount(region, minlength=regions)
    group = np.flatnonzero(count)
    divisor = (count if over is None else over)[group]
    out = {"group": group}
    for name, v in metrics.items():
        gone = np.isnan(v)
        if gone.any():
            some = np.bincount(region[~gone], minlength=regions)[group]
            out[name] = np.where(some > 0, np.bincount(region[~gone], v[~gone], regions)[group] / np.maximum(some, 1), np.nan)
        else:
            out[name] = np.bincount(region, v, regions)[group] / divisor
    return out


def told(mode: str, columns: Columns) -> Columns:
    return columns | {"mode": np.full(len(columns["group"]), mode, object)}


def schema_of(names: Sequence[str]) -> str:
    return ", ".join(["mode string", *[f"{n} double" for n in names]])


CELLS = "mode string, unit int, i int, {} int, n bigint"


def emitted(mode: str, cells: Cells, second: str) -> Columns:
    group, unit, i, k, n = cells
    return told(mode, {"group": group, "unit": unit, "i": i, second: k, "n": n})


# --- co-occurrence ----------------------------------------------------------------------------------------------------

def pair_cells(m: Mask, modes: Sequence[str]) -> Iterator[tuple[str, Cells]]:
    """Symmetric co-occurrence counts at distance 1."""
    found = []
    g, z = m.own()
    for d, offset in enumerate(directions(modes)):
        a, b = m.places.pairs(offset)
        i, j = m.level[a] - m.least, m.level[b] - m.least
        # A pair counts in both orders; slices only matter for the directions within them.
        found.append((g[a], z[a] if d < 4 else np.zeros(len(a), np.int64), np.full(len(a), d), np.minimum(i, j), np.maximum(i, j)))
    (g, z, d, i, j), n = tally([np.concatenate(c) for c in zip(*found, strict=True)])
    for mode, rows, unit in units(modes, z, d):
        (r, u, lo, hi), total = tally([g[rows], unit, i[rows], j[rows]], n[rows])
        twice, other = np.where(lo == hi, 2 * total, total), lo != hi
        yield mode, tuple(np.concatenate(c) for c in ((r, r[other]), (u, u[other]), (lo + m.least, hi[other] + m.least), (hi + m.least, lo[other] + m.least), (twice, total[other])))


def cooccurrence(q: DataFrame, modes: Sequence[str] = MODES6) -> DataFrame:
    """(image_id, roi, mode, unit, i, j, n): symmetric co-occurrence counts at distance 1."""
    return by_region(q, lambda m: (emitted(mode, cells, "j") for mode, cells in pair_cells(m, modes)), CELLS.format("j"))


def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n)


def bits(at: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Entropies of the distributions p of n units."""
    return np.bincount(at, -p * np.log2(p), n)


def cooccurrence_features(q: DataFrame, modes: Sequence[str] = MODES6) -> DataFrame:
    """(image_id, roi, mode, 25 metrics), means over the units of a mode."""

    def work(m: Mask) -> Iterator[Columns]:
        # Levels run from 1 to ng, populated or not; slices of the region's box.
        ng = np.zeros(m.regions, np.int64)
        np.maximum.at(ng, m.own()[0], m.level)
        slices = np.zeros(m.regions, np.int64)
        np.maximum.at(slices, m.g, m.z + 1)
        for mode, (g, unit, i, j, n) in pair_cells(m, modes):
            at, region, count = numbered(g, unit)
            # Slices without a pair count as zero matrices in 2D_comb and are left out of every other mean.
            yield told(mode, means(pair_metrics(at, i, j, n, ng[region], count), region, m.regions, slices if mode == "2D_comb" else None))

    return by_region(q, work, schema_of(GLCM))


def pair_metrics(at: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, ng: np.ndarray, units_: int) -> Columns:
    """25 metrics of every unit from its cells."""
    total = summed(at, n, units_)
    p = n / total[at]

    def margin(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least = int(values.min(initial=0))
        (u, v), sums = tally([at, values - least], n)
        return u, v + least, sums / total[u]

    (ux, x, px), (us, s, ps), (ud, d, pd_) = margin(i), margin(i + j), margin(np.abs(i - j))
    mu, dm = summed(ux, x * px, units_), summed(ud, d * pd_, units_)
    gap, far = np.abs(i - j), np.where(ng > 1, ng - 1, 1)[at]
    clust, dx, ds, dd = i + j - 2 * mu[at], x - mu[ux], s - 2 * mu[us], d - dm[ud]
    most = np.zeros(units_)
    np.maximum.at(most, at, p)
    c = lambda v: summed(at, v, units_)
    joint_var, joint_entr, hx, cov = summed(ux, dx * dx * px, units_), bits(at, p, units_), bits(ux, px, units_), c((i - mu[at]) * (j - mu[at]) * p)
    # Both cross entropies of the pair (i, j) are the sum of the entropies of its two equal margins.
    spread = joint_entr - 2 * hx
    clust2 = clust * clust
    return {
        "joint_max": most, "joint_avg": mu, "joint_var": joint_var, "joint_entr": joint_entr, "diff_avg": dm, "diff_var": summed(ud, dd * dd * pd_, units_),
        "diff_entr": bits(ud, pd_, units_), "sum_avg": summed(us, s * ps, units_), "sum_var": summed(us, ds * ds * ps, units_), "sum_entr": bits(us, ps, units_),
        "energy": c(p * p), "contrast": c(gap * gap * p), "dissimilarity": c(gap * p), "inv_diff": c(p / (1 + gap)), "inv_diff_norm": c(p / (1 + gap / far)),
        "inv_diff_mom": c(p / (1 + gap * gap)), "inv_diff_mom_norm": c(p / (1 + gap * gap / (far * far))), "inv_var": c(np.where(i < j, 2 * p / np.maximum(gap * gap, 1), 0.0)),
        "corr": np.where(joint_var > 0, cov / np.where(joint_var > 0, joint_var, 1), 0.0), "auto_corr": c(i * j * p), "clust_tend": c(clust2 * p),
        "clust_shade": c(clust2 * clust * p), "clust_prom": c(clust2 * clust2 * p), "info_corr1": spread / np.where(hx > 0, hx, 1),
        "info_corr2": np.where(spread < 0, np.sqrt(1 - np.exp(2 * np.minimum(spread, 0))), 0.0),
    }


GLCM = (
    "joint_max", "joint_avg", "joint_var", "joint_entr", "diff_avg", "diff_var", "diff_entr", "sum_avg", "sum_var", "sum_entr",
    "energy", "contrast", "dissimilarity", "inv_diff", "inv_diff_norm", "inv_diff_mom", "inv_diff_mom_norm", "inv_var", "corr",
    "auto_corr", "clust_tend", "clust_shade", "clust_prom", "info_corr1", "info_corr2",
)

# --- run lengths, zones, distance zones, dependence --------------------------------------------------------------------

#: Output names of: sum n/k^2, n k^2, n/i^2, n i^2, n/(i k)^2, n i^2/k^2, n k^2/i^2, n (i k)^2, then the others.
PLAIN = ("k_short", "k_long", "i_low", "i_high", "short_low", "short_high", "long_low", "long_high", "glnu", "glnu_norm", "knu", "knu_norm", "perc", "gl_var", "k_var", "k_entr", "energy")
NAMES = {
    "glrlm": ("sre", "lre", "lgre", "hgre", "srlge", "srhge", "lrlge", "lrhge", "glnu", "glnu_norm", "rlnu", "rlnu_norm", "r_perc", "gl_var", "rl_var", "rl_entropy"),
    "szm": ("sze", "lze", "lgze", "hgze", "sdlge", "sdhge", "ldlge", "ldhge", "glnu", "glnu_norm", "zsnu", "zsnu_norm", "z_perc", "gl_var", "zs_var", "zs_entr"),
    "dzm": ("sde", "lde", "lgze", "hgze", "sdlge", "sdhge", "ldlge", "ldhge", "glnu", "glnu_norm", "zdnu", "zdnu_norm", "z_perc", "gl_var", "zd_var", "zd_entr"),
    "ngl": ("lde", "hde", "lgce", "hgce", "ldlge", "ldhge", "hdlge", "hdhge", "glnu", "glnu_norm", "dcnu", "dcnu_norm", "dcperc", "gl_var", "dc_var", "dc_entr", "dc_energy"),
}


def emphasis(at: np.ndarray, i: np.ndarray, k: np.ndarray, n: np.ndarray, nv: np.ndarray, units_: int) -> Columns:
    """Metrics of every unit of a matrix; nv, voxels of the unit, gives the percentage."""
    ns = summed(at, n, units_)
    p = n / ns[at]

    def margin(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least = int(values.min(initial=0))
        (u, v), sums = tally([at, values - least], n)
        return u, v + least, sums

    def variance(u: np.ndarray, v: np.ndarray, p: np.ndarray) -> np.ndarray:
        d = v - summed(u, v * p, units_)[u]
        return summed(u, d * d * p, units_)

    (ui, vi, ni), (uk, vk, nk) = margin(i), margin(k)
    pi, pk = ni / ns[ui], nk / ns[uk]
    i2, k2 = i.astype(float) * i, k.astype(float) * k
    c = lambda v: summed(at, v, units_)
    values = (
        c(p / k2), c(p * k2), c(p / i2), c(p * i2), c(p / (i2 * k2)), c(p * i2 / k2), c(p * k2 / i2), c(p * i2 * k2), summed(ui, ni.astype(float) * ni, units_) / ns, summed(ui, pi * pi, units_),
        summed(uk, nk.astype(float) * nk, units_) / ns, summed(uk, pk * pk, units_), ns / nv, variance(ui, vi, pi), variance(uk, vk, pk), bits(at, p, units_), c(p * p),
    )
    return dict(zip(PLAIN, values, strict=True))


def averaged(metrics: Columns, family: str, region: np.ndarray, regions: int) -> Columns:
    """Means over the units of each region, under the family's names."""
    return means({new: metrics[old] for old, new in zip(PLAIN, NAMES[family], strict=False)}, region, regions)


def run_counts(m: Mask, modes: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """(region, slice, direction, level, length) of maximal runs of equal level, and how many there are of each."""
    g, z = m.own()
    found = []
    for d, offset in enumerate(directions(modes)):
        a, b = m.same(offset)
        follows = np.full(len(g), -1)
        follows[a] = b
        starts = np.ones(len(g), bool)
        starts[b] = False
        starts = np.flatnonzero(starts)
        length, live, last = np.ones(len(starts), np.int64), np.arange(len(starts)), follows[starts]
        while len(live := live[last >= 0]):
            last = last[last >= 0]
            length[live] += 1
            last = follows[last]
        found.append((g[starts], z[starts] if d < 4 else np.zeros(len(starts), np.int64), np.full(len(starts), d), m.level[starts] - m.least, length))
    return tally([np.concatenate(c) for c in zip(*found, strict=True)])


def run_cells(m: Mask, modes: Sequence[str]) -> Iterator[tuple[str, Cells, Cells]]:
    """For each mode its matrix, and (region, slice, direction) with the number of runs of each row."""
    (g, z, d, i, k), n = run_counts(m, modes)
    for mode, rows, unit in units(modes, z, d):
        (r, u, level, length), total = tally([g[rows], unit, i[rows], k[rows]], n[rows])
        yield mode, (r, u, level + m.least, length, total), (g[rows], z[rows], d[rows], n[rows], n[rows])


def run_matrix(q: DataFrame, modes: Sequence[str] = MODES6) -> DataFrame:
    return by_region(q, lambda m: (emitted(mode, cells, "k") for mode, cells, _ in run_cells(m, modes)), CELLS.format("k"))


def run_features(q: DataFrame, modes: Sequence[str] = MODES6) -> DataFrame:
    """(image_id, roi, mode, 16 metrics). The percentage counts runs per direction over the voxels of the mask."""

    def work(m: Mask) -> Iterator[Columns]:
        whole, high = np.bincount(m.g, minlength=m.regions), int(m.z.max(initial=0)) + 1
        part = np.bincount(m.g * high + m.z, minlength=m.regions * high)
        for mode, (g, unit, i, k, n), (rg, rz, rd, rn, _) in run_cells(m, modes):
            at, region, count = numbered(g, unit)
            out = averaged(emphasis(at, i, k, n, np.ones(count), count), "glrlm", region, m.regions)
            # 2D_comb is the mean over slices and directions like 2D_avg, 3D_comb like 3D_avg; 2_5D_comb adds its four directions up.
            (r, s, _), runs = tally([rg, rz if mode.startswith("2D") else np.zeros(len(rg), np.int64), rd], rn)
            share = runs / (part[r * high + s] if mode.startswith("2D") else whole[r])
            many = np.ones(m.regions) if mode == "2_5D_comb" else np.bincount(r, minlength=m.regions)
            out["r_perc"] = (np.bincount(r, share, m.regions) / np.maximum(many, 1))[out["group"]]
            yield told(mode, out)

    return by_region(q, work, schema_of(NAMES["glrlm"]))


def least_labels(key: np.ndarray, stride: Sequence[int]) -> np.ndarray:
    """Component numbers of sorted packed places (distinct, with margins) whose neighbours lie at the given distances."""
    edges = []
    for s in stride:
        at = np.minimum(np.searchsorted(key, key + s), max(0, len(key) - 1))
        hit = np.flatnonzero(key[at] == key + s)
        edges.append((hit, at[hit]))
    return joined(len(key), *(np.concatenate(x) for x in zip(*edges, strict=True)))


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of n can reach along the edges between a and b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def packed(pdf: pd.DataFrame, *more: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Places of an image as numbers with a margin of one on every side; `more` tells groups apart that must not touch."""
    x, y, z = (pdf[a].to_numpy(np.int64) - int(pdf[a].min()) + 1 for a in "xyz")
    sy, sz = int(x.max()) + 2, (int(x.max()) + 2) * (int(y.max()) + 2)
    key, size = x + y * sy + z * sz, sz * (int(z.max()) + 2)
    for m in more:
        key = key + np.unique(m, return_inverse=True)[1] * size
        size *= len(np.unique(m))
    return key, (1, sy, sz)


def depths(p: Places, axes: Sequence[int]) -> np.ndarray:
    """Taxicab distance of every voxel to the nearest place outside the mask; 1 at the border."""
    steps = [tuple(side * (k == axis) for k in range(3)) for axis in axes for side in (1, -1)]
    near = [p.at(p.key + p.step(s)) for s in steps]
    depth = np.zeros(len(p.key), np.int64)
    border = np.zeros(len(p.key), bool)
    for n in near:
        border |= n < 0
    # Within the mask every voxel at distance d + 1 has a neighbour at d.
    front, d = np.flatnonzero(border), 1
    while len(front):
        depth[front] = d
        beside = np.unique(np.concatenate([n[front] for n in near]))
        front, d = beside[(beside >= 0) & (depth[beside] == 0)], d + 1
    return depth


def zone_parts(m: Mask, flat: bool, distances: bool = True) -> tuple[np.ndarray, ...]:
    """(region, slice, level, size, distance) of zones of equal level, 8-connected in slices (flat) or 26-connected in space."""
    g, z = m.own()
    edges = [m.same(offset) for offset in (DIRECTIONS[:4] if flat else DIRECTIONS)]
    label = joined(len(g), *(np.concatenate(x) for x in zip(*edges, strict=True)))
    zone, at, size = np.unique(label, return_inverse=True, return_counts=True)
    least = np.zeros(len(zone), np.int64)
    if distances:
        mask = Places(m.g, m.xyz)
        depth = np.zeros(len(m.g), np.int64)
        depth[mask.order] = depths(mask, (0, 1) if flat else (0, 1, 2))
        least += 1 << 30
        np.minimum.at(least, at, depth[m.known])
    return g[zone], z[zone] if flat else np.zeros(len(zone), np.int64), m.level[zone], size, least


def zones(q: DataFrame) -> DataFrame:
    """(image_id, roi, flat, z, i, size, distance): zones of equal level, 8-connected in slices (flat) and 26-connected in
    space, with the least distance of their voxels to the outside of the mask; z counts from the region's first slice."""

    def work(m: Mask) -> Iterator[Columns]:
        for flat in (True, False):
            g, z, i, size, distance = zone_parts(m, flat)
            yield {"group": g, "flat": np.full(len(g), flat), "z": z, "i": i, "size": size, "distance": distance}

    return by_region(q, work, "flat boolean, z int, i int, size int, distance int")


def sliced(m: Mask, modes: Sequence[str], parts: Callable[[bool], tuple[np.ndarray, ...]]) -> Iterator[tuple[str, Cells, np.ndarray]]:
    """Matrices of the modes 2D, 2_5D and 3D from (region, slice, level, k) of a slice (flat) or of space, and the voxels of the
    mask with a level for each row."""
    g, z = m.own()
    high = int(z.max(initial=0)) + 1
    whole, part = np.bincount(g, minlength=m.regions), np.bincount(g * high + z, minlength=m.regions * high)
    for flat in sorted({mode != "3D" for mode in modes}):
        r, s, i, k = parts(flat)
        for mode in modes:
            if (mode != "3D") == flat:
                (group, unit, level, second), n = tally([r, s if mode == "2D" else np.zeros(len(r), np.int64), i - m.least, k])
                yield mode, (group, unit, level + m.least, second, n), part[group * high + unit] if mode == "2D" else whole[group]


def sliced_features(q: DataFrame, family: str, modes: Sequence[str], parts: Callable[[Mask, bool], tuple[np.ndarray, ...]]) -> DataFrame:
    def work(m: Mask) -> Iterator[Columns]:
        for mode, (g, unit, i, k, n), nv in sliced(m, modes, lambda flat: parts(m, flat)):
            at, region, count = numbered(g, unit)
            voxels = np.zeros(count)
            voxels[at] = nv
            yield told(mode, averaged(emphasis(at, i, k, n, voxels, count), family, region, m.regions))

    return by_region(q, work, schema_of(NAMES[family]))


def zone_features(q: DataFrame, by: str = "size", modes: Sequence[str] = MODES3) -> DataFrame:
    def parts(m: Mask, flat: bool) -> tuple[np.ndarray, ...]:
        g, z, i, size, distance = zone_parts(m, flat, by == "distance")
        return g, z, i, size if by == "size" else distance

    return sliced_features(q, "szm" if by == "size" else "dzm", modes, parts)


AROUND = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]


def surroundings(m: Mask, flat: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every voxel with a level its neighbours in the slice (flat) or in space, those of equal level, and the sum of their levels."""
    near, equal, total = np.zeros((3, len(m.level)), np.int64)
    for offset in DIRECTIONS[:4] if flat else DIRECTIONS:
        a, b = m.places.pairs(offset)
        same = m.level[a] == m.level[b]
        for here, there in ((a, b), (b, a)):  # at one offset no voxel comes twice on either side
            near[here] += 1
            equal[here] += same
            total[here] += m.level[there]
    return near, equal, total


def dependence_parts(m: Mask, flat: bool) -> tuple[np.ndarray, ...]:
    """k = 1 + the number of neighbours with an equal level."""
    g, z = m.own()
    return g, z, m.level, surroundings(m, flat)[1] + 1


def dependence_matrix(q: DataFrame, modes: Sequence[str] = MODES3) -> DataFrame:
    work = lambda m: (emitted(mode, cells, "k") for mode, cells, _ in sliced(m, modes, lambda flat: dependence_parts(m, flat)))
    return by_region(q, work, CELLS.format("k"))


def dependence_features(q: DataFrame, modes: Sequence[str] = MODES3) -> DataFrame:
    return sliced_features(q, "ngl", modes, dependence_parts)


NGTDM = ("coarseness", "contrast", "busyness", "complexity", "strength")
#: Pairs of levels that are looked at together.
PAIRS = 1 << 20


def tone_features(q: DataFrame, modes: Sequence[str] = MODES3) -> DataFrame:
    """(image_id, roi, mode, 5 metrics): voxels with a neighbour by level, and the sum of their distances from their neighbours' mean level."""

    def work(m: Mask) -> Iterator[Columns]:
        g, z = m.own()
        for flat in sorted({mode != "3D" for mode in modes}):
            near, _, total = surroundings(m, flat)
            rows = np.flatnonzero(near)
            gap = np.abs(m.level[rows] - total[rows] / near[rows])
            for mode in modes:
                if (mode != "3D") == flat and len(rows):
                    columns = [g[rows], z[rows] if mode == "2D" else np.zeros(len(rows), np.int64), m.level[rows] - m.least]
                    (r, unit, i), n = tally(columns)
                    s = tally(columns, gap)[1]
                    at, region, count = numbered(r, unit)
                    yield told(mode, means(tone_metrics(at, i + m.least, n, s, count), region, m.regions))

    return by_region(q, work, schema_of(NGTDM))


def tone_metrics(at: np.ndarray, i: np.ndarray, n: np.ndarray, s: np.ndarray, units_: int) -> Columns:
    """5 metrics of every unit from its levels; rows are sorted by unit."""
    nv = summed(at, n, units_)
    p = n / nv[at]
    ps, ss, ngp = summed(at, p * s, units_), summed(at, s, units_), np.bincount(at, minlength=units_)
    start = np.cumsum(ngp) - ngp
    contrast, busy, complexity, strength = np.zeros((4, units_))
    # Every level meets every level of its unit; pairs are made for some rows at a time.
    reach = np.cumsum(ngp[at])
    cuts = np.searchsorted(reach, np.arange(PAIRS, int(reach[-1]) + PAIRS, PAIRS))
    for low, high in zip([0, *cuts[:-1]], [*cuts[:-1], len(at)], strict=True):
        many = ngp[at[low:high]]
        a = np.repeat(np.arange(low, high), many)
        b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + start[at[a]]
        u, apart = at[a], (i[a] - i[b]).astype(float)
        contrast += summed(u, p[a] * p[b] * apart * apart, units_)
        busy += summed(u, np.abs(i[a] * p[a] - i[b] * p[b]), units_)
        complexity += summed(u, np.abs(apart) * (p[a] * s[a] + p[b] * s[b]) / (p[a] + p[b]), units_)
        strength += summed(u, (p[a] + p[b]) * apart * apart, units_)
    several = ngp > 1
    # Without a distance coarseness and strength have no value, and their means leave the unit out.
    return {
        "coarseness": np.where(ps > 0, np.minimum(1 / np.where(ps > 0, ps, 1), 1e6), np.nan),
        "contrast": np.where(several, contrast / np.maximum(ngp * (ngp - 1), 1) * ss / nv, 0.0), "busyness": np.where(several & (busy != 0), ps / np.where(busy != 0, busy, 1), 0.0),
        "complexity": complexity / nv, "strength": np.where(ss > 0, strength / np.where(ss > 0, ss, 1), np.nan),
    }
