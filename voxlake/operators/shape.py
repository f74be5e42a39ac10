"""Morphology: mesh area and volume by cube configurations, principal axes, boxes, hull, diameter, autocorrelation."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from voxlake.operators.batches import SLAB, Places, in_slabs, streamed
from voxlake.operators.texture import DIRECTIONS, ROI

CORNERS = [(k & 1, k >> 1 & 1, k >> 2) for k in range(8)]


@functools.lru_cache(maxsize=1)
def surface_pieces() -> list[list[np.ndarray]]:
    """Triangles (in cell units, normals outwards) for each of the 256 configurations of a cell's eight corners.

    Cut edges are midpoints. On every face the cut points pair up around the set corners, so neighbouring cells agree; the
    pairs close to polygons, which are fanned into triangles."""
    corner = [np.array(c, float) for c in CORNERS]
    edges = [(a, b) for a in range(8) for b in range(a + 1, 8) if sum(CORNERS[a][i] != CORNERS[b][i] for i in range(3)) == 1]
    middle = {e: (corner[e[0]] + corner[e[1]]) / 2 for e in edges}
    faces = []
    for axis, side in product(range(3), (0, 1)):
        u, v = [i for i in range(3) if i != axis]
        ring = []
        for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)):
            c = [0, 0, 0]
            c[axis], c[u], c[v] = side, a, b
            ring.append(CORNERS.index(tuple(c)))
        normal = np.cross(corner[ring[1]] - corner[ring[0]], corner[ring[2]] - corner[ring[1]])
        outward = np.eye(3)[axis] * (1 if side else -1)
        faces.append(ring if normal @ outward > 0 else ring[::-1])
    out = []
    for code in range(256):
        inside = [code >> k & 1 for k in range(8)]
        follow = {}
        for ring in faces:
            # Walking around the face as seen from outside: a cut that leaves the set corners starts a segment, which ends
            # at the cut where that run of set corners began.
            for k in range(4):
                a, b = ring[k], ring[(k + 1) % 4]
                if inside[a] and not inside[b]:
                    j = k
                    while inside[ring[(j - 1) % 4]]:
                        j -= 1
                    follow[tuple(sorted((ring[(j - 1) % 4], ring[j % 4])))] = tuple(sorted((a, b)))
        triangles, left = [], dict(follow)
        while left:
            start = next(iter(left))
            loop, at = [], start
            while at in left:
                loop.append(middle[at])
                at = left.pop(at)
            triangles += [np.array([loop[0], loop[k], loop[k + 1]]) for k in range(1, len(loop) - 1)]
        out.append(triangles)
    return out


def cell_table(spacing: Sequence[float]) -> list[tuple[float, float, float, float, float]]:
    """Per configuration: area, its part of the divergence sum at the cell's origin, and the summed area vector."""
    scale, out = np.array(spacing, float), []
    for triangles in surface_pieces():
        area, inner, vector = 0.0, 0.0, np.zeros(3)
        for t in triangles:
            a, b, c = t * scale
            cross = np.cross(b - a, c - a) / 2
            area += float(np.linalg.norm(cross))
            vector += cross
            inner += float(a @ cross) / 3
        out.append((area, inner, *(vector / 3).tolist()))
    return out


def mesh(vox: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """(image_id, roi, area, volume) of the surface at one half of the 0/1 mask.

    Each voxel gives one bit to the eight cells around it; a table of 256 rows holds each configuration's area and divergence sum.
    Slabs of a region are summed up apart, so a tall one is the work of many tasks."""
    table = np.array(cell_table(spacing))

    def work(g: np.ndarray, c: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        p = Places(g, [c[a] for a in "xyz"])
        steps = [p.step([-k for k in corner]) for corner in CORNERS]
        # Cells lie at packed places like voxels do; all that a voxel touches are looked at once.
        cells = np.unique(np.concatenate([p.key + s for s in steps]))
        code = np.zeros(len(cells), np.int64)
        for k, s in enumerate(steps):
            code += (p.at(cells - s) >= 0).astype(np.int64) << k
        region, place = np.divmod(cells, p.whole)
        low = np.zeros((3, int(g.max()) + 1))
        for a in range(3):
            low[a, p.g] = p.lows[a][p.order]
        z, rest = np.divmod(place, p.stride[2])
        y, x = np.divmod(rest, p.stride[1])
        at = [v - 1 + low[a, region] for a, v in enumerate((x, y, z))]
        slab = np.zeros(low.shape[1], np.int64)
        slab[g] = c["slab"]
        own = (at[2] + 1) // SLAB == slab[region]  # a cell lies in the slab of its upper slice, where both its slices are
        region, code, at = region[own], code[own], [v[own] * s for v, s in zip(at, spacing, strict=True)]
        area, flux = table[code, 0], table[code, 1] + at[0] * table[code, 2] + at[1] * table[code, 3] + at[2] * table[code, 4]
        some = np.unique(region)
        yield {"group": some, "area": np.bincount(region, area)[some], "flux": np.bincount(region, flux)[some]}

    parts = streamed(in_slabs(vox.select(*ROI, "x", "y", "z"), "z", 1), [*ROI, "slab_"], work, "area double, flux double")
    return parts.groupBy(*ROI).agg(F.sum("area").alias("area"), F.abs(F.sum("flux")).alias("volume"))


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix in falling order, closed form, not below 0."""
    q = (xx + yy + zz) / 3
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)
    p = F.sqrt(p2 / 6)
    safe = F.when(p > 1e-12, p)
    a, b, c, d, e, f = (xx - q) / safe, (yy - q) / safe, (zz - q) / safe, xy / safe, xz / safe, yz / safe
    r = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3
    first = F.coalesce(q + 2 * p * F.cos(phi), q)
    third = F.coalesce(q + 2 * p * F.cos(phi + 2.0943951023931953), q)
    return [F.greatest(v, F.lit(0.0)) for v in (first, 3 * q - first - third, third)]


def principal_axes(vox: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Axis lengths, elongation, flatness, centre-of-mass shift, count volume, box extents and mean intensity."""
    x, y, z = (F.col(a) * s for a, s in zip("xyz", spacing, strict=True))
    v = F.col("intensity")
    cov = {n: F.covar_samp(a, b) for n, (a, b) in {"xx": (x, x), "yy": (y, y), "zz": (z, z), "xy": (x, y), "xz": (x, z), "yz": (y, z)}.items()}
    s = vox.groupBy(*ROI).agg(
        F.count("*").alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in cov.items()], F.avg(v).alias("mean"),
        *[(F.sum(F.when(v.isNotNull(), c * v)) / F.nullif(F.sum(v), F.lit(0.0)) - F.avg(c)).alias(f"d{a}") for a, c in zip("xyz", (x, y, z), strict=True)],
        *[((F.max(a) - F.min(a) + 1) * float(d)).alias(f"e{a}") for a, d in zip("xyz", spacing, strict=True)],
    )
    l1, l2, l3 = eigenvalues(*[F.col(k) for k in cov])
    s = s.withColumns({"l1": l1, "l2": l2, "l3": l3})
    long = F.when(F.col("l1") > 1e-12, F.col("l1"))
    return s.select(
        *ROI, (F.col("n") * float(np.prod(spacing))).alias("morph_volume_count"), F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2).alias("morph_com_shift"),
        (4 * F.sqrt("l1")).alias("morph_major_axis_length"), (4 * F.sqrt("l2")).alias("morph_minor_axis_length"), (4 * F.sqrt("l3")).alias("morph_least_axis_length"),
        F.sqrt(F.col("l2") / long).alias("morph_elongation"), F.sqrt(F.col("l3") / long).alias("morph_flatness"),
        F.sqrt("l1").alias("s1"), F.sqrt("l2").alias("s2"), F.sqrt("l3").alias("s3"), "ex", "ey", "ez", "mean",
    )


def ellipsoid_area(a: Column, b: Column, c: Column, order: int = 20) -> Column:
    """Area of an ellipsoid with semi-axes a >= b >= c by the series of order 20, whose Legendre terms are all 1."""
    safe = F.when(a > 0, a)
    ab = F.sqrt(1 - (b * b) / (safe * safe)) * F.sqrt(1 - (c * c) / (safe * safe))
    total = F.lit(0.0)
    for k in range(order + 1):
        total = total + F.pow(ab, F.lit(float(k))) / (1 - 4 * k * k)
    return F.when(c > 0, 4 * float(np.pi) * a * b * total)


def shape_features(vox: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """All morphology columns that aggregates can express: 24 of 29."""
    m = mesh(vox, spacing).join(principal_axes(vox, spacing), ROI)
    a, v = F.col("area"), F.col("volume")
    vol = F.when(v > 0, v)
    pi = float(np.pi)
    box_v = F.col("ex") * F.col("ey") * F.col("ez")
    box_a = 2 * (F.col("ex") * F.col("ey") + F.col("ex") * F.col("ez") + F.col("ey") * F.col("ez"))
    s1, s2, s3 = (2 * F.col(f"s{k}") for k in (1, 2, 3))
    ell_v = 4 / 3 * pi * s1 * s2 * s3
    values = {
        "volume_mesh": v, "surface_area": a, "sv_ratio": a / vol, "compactness1": v / (F.sqrt(F.lit(pi)) * F.pow(a, F.lit(1.5))),
        "compactness2": 36 * pi * v * v / (a * a * a), "spherical_disproportion": a / F.cbrt(36 * pi * vol * vol), "sphericity": F.cbrt(36 * pi * v * v) / a,
        "asphericity": F.cbrt(a * a * a / (36 * pi * vol * vol)) - 1, "volume_density_aabb": v / box_v, "area_density_aabb": a / box_a,
        "volume_density_ombb": v / box_v, "area_density_ombb": a / box_a, "volume_density_aee": v / F.when(ell_v > 0, ell_v),
        "area_density_aee": a / ellipsoid_area(s1, s2, s3), "volume_density_mvee": v / F.when(ell_v > 0, ell_v), "area_density_mvee": a / ellipsoid_area(s1, s2, s3),
        "integrated_intensity": F.col("mean") * v,
    }
    own = ("volume_count", "com_shift", "major_axis_length", "minor_axis_length", "least_axis_length", "elongation", "flatness")
    return m.select(*ROI, *[c.alias(f"morph_{k}") for k, c in values.items()], *[f"morph_{k}" for k in own])


#: Voxels of a region whose pairs are the work of one task, and pairs that are looked at together.
OWN, PAIRS = 16_384, 1 << 20


def autocorrelation(vox: DataFrame, spacing: Sequence[float], own: int = OWN) -> DataFrame:
    """Moran's I and Geary's C over all pairs of a region's voxels, weights 1 / distance, exact at any size.

    Pairs are summed where they are made and never are rows. A region of over `own` voxels is the work of several tasks: each gets
    all its voxels, and meets a share of them with all."""
    known = vox.where("intensity IS NOT NULL").select(*ROI, "x", "y", "z", F.col("intensity").cast("double").alias("intensity"))
    sizes = known.groupBy(*ROI).agg(F.ceil(F.count("*") / own).cast("int").alias("blocks_")).where("blocks_ > 1")
    blocks = F.explode(F.sequence(F.lit(0), F.coalesce("blocks_", F.lit(1)) - 1))
    rows = known.join(F.broadcast(sizes), ROI, "left").select(*ROI, blocks.alias("block_"), F.coalesce("blocks_", F.lit(1)).alias("blocks"), "x", "y", "z", "intensity", F.col("intensity").alias("v"))
    rows = rows.select(*ROI, "block_", F.col("block_").alias("block"), "blocks", "x", "y", "z", "v")

    def work(g: np.ndarray, c: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        first = np.flatnonzero(np.diff(g, prepend=-1))
        out = np.zeros((5, len(first)))
        for k, (low, high) in enumerate(zip(first, [*first[1:], len(g)], strict=True)):
            at = np.lexsort([c[a][low:high] for a in "xyz"]) + low
            place = [c[a][at] * float(s) for a, s in zip("xyz", spacing, strict=True)]
            n, v = len(at), c["v"][at]
            dev = v - v.mean() if v.min() < v.max() else np.zeros(n)
            share = np.arange(c["block"][low], n, c["blocks"][low])
            both = np.stack([np.ones(n), dev], 1)
            for start in range(0, len(share), max(1, PAIRS // n)):
                mine = share[start : start + max(1, PAIRS // n)]
                squared = np.zeros((len(mine), n))
                for axis in place:
                    gap = axis[mine, None] - axis
                    gap *= gap
                    squared += gap
                squared[np.arange(len(mine)), mine] = np.inf
                weight, near = (1 / np.sqrt(squared) @ both).T
                out[2:, k] += weight.sum(), (dev[mine] * near).sum(), (dev[mine] * dev[mine] * weight).sum()
            out[:2, k] = n, (dev * dev).sum()
        yield {"group": np.arange(len(first)), **dict(zip(("n", "ss", "w", "cross", "own"), out, strict=True))}

    parts = streamed(rows, [*ROI, "block_"], work, "n double, ss double, w double, cross double, own double")
    s = parts.groupBy(*ROI).agg(F.max("n").alias("n"), F.max("ss").alias("ss"), *[F.sum(c).alias(c) for c in ("w", "cross", "own")]).where("n > 1")
    ok = F.when(F.col("ss") > 0, F.col("ss"))
    # Each pair counts in both orders, so the squared gaps are twice the own squares less twice the products.
    gaps = 2 * (F.col("own") - F.col("cross"))
    return s.select(
        *ROI, F.coalesce(F.col("n") / F.col("w") * F.col("cross") / ok, F.lit(1.0)).alias("morph_moran_i"),
        F.coalesce((F.col("n") - 1) / (2 * F.col("w")) * gaps / ok, F.lit(1.0)).alias("morph_geary_c"),
    )


def hull_faces(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of the convex hull of integer points, normals outwards; empty when the points are flat.

    Each point waits at one face that sees it, and the farthest of a face goes in next; only the points of the faces that it hides
    are dealt out again. Whole numbers throughout, so what is coplanar is told exactly."""
    p = np.asarray(points, np.int64)
    p = p - p[0]
    second = int(np.argmax((p * p).sum(1)))
    normals = np.cross(p[second], p)
    third = int(np.argmax((normals.astype(float) ** 2).sum(1)))
    heights = p @ normals[third]
    fourth = int(np.argmax(np.abs(heights)))
    if not heights[fourth]:
        return []
    base = [0, third, second, fourth] if heights[fourth] > 0 else [0, second, third, fourth]
    place = p.tolist()
    corners, planes, waiting, edges = {}, {}, {}, {}

    def add(i: int, j: int, k: int) -> int:
        number = len(planes)
        (px, py, pz), (qx, qy, qz), (rx, ry, rz) = place[i], place[j], place[k]
        ax, ay, az, bx, by, bz = qx - px, qy - py, qz - pz, rx - px, ry - py, rz - pz
        nx, ny, nz = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
        planes[number], corners[number] = (nx, ny, nz, nx * px + ny * py + nz * pz), (i, j, k)
        edges[i, j] = edges[j, k] = edges[k, i] = number
        return number

    def deal(rows: list[int], numbers: list[int]) -> None:
        """Every row to the first face that sees it, the farthest one of a face to the end; rows that none sees are inside."""
        if len(rows) > 256:
            left = np.array(rows)
            for number in numbers:
                *normal, level = planes[number]
                above = p[left] @ np.array(normal) - level
                seen = above > 0
                if seen.any():
                    own = left[seen].tolist()
                    own.append(own.pop(int(np.argmax(above[seen]))))
                    waiting[number] = own
                    left = left[~seen]
            return
        known = [(number, *planes[number]) for number in numbers]
        most = {}
        for row in rows:
            x, y, z = place[row]
            for number, nx, ny, nz, level in known:
                above = nx * x + ny * y + nz * z - level
                if above > 0:
                    own = waiting.setdefault(number, [])
                    if above > most.get(number, 0):
                        most[number] = above
                        own.append(row)
                    else:
                        own.insert(0, row)
                    break

    a, b, c, d = base
    first = [add(a, b, c), add(a, d, b), add(b, d, c), add(c, d, a)]
    deal([k for k in range(len(p)) if k not in base], first)
    while waiting:
        start = next(iter(waiting))
        k = waiting[start].pop()
        x, y, z = place[k]
        hidden, rim, open_ = {start}, [], [start]
        while open_:
            i, j, m = corners[open_.pop()]
            for e, f in ((i, j), (j, m), (m, i)):
                number = edges[f, e]
                if number not in hidden:
                    nx, ny, nz, level = planes[number]
                    if nx * x + ny * y + nz * z > level:
                        hidden.add(number)
                        open_.append(number)
                    else:
                        rim.append((e, f))
        rows = []
        for number in hidden:
            i, j, m = corners.pop(number)
            del edges[i, j], edges[j, m], edges[m, i]
            rows += waiting.pop(number, [])
        deal(rows, [add(e, f, k) for e, f in rim])
    return list(corners.values())


def ends(g: np.ndarray, xyz: Sequence[np.ndarray]) -> np.ndarray:
    """Voxels that are the first or the last of their line in each of the 13 directions; corners of the hull are among them."""
    rows = np.arange(len(g))
    for offset in DIRECTIONS:
        axis = next(k for k in range(3) if offset[k])
        pos = xyz[axis][rows]
        line = [xyz[k][rows] - pos * offset[k] for k in range(3) if k != axis]
        key = g[rows]
        for c in line:
            c = c - c.min(initial=0)
            key = key * (int(c.max(initial=0)) + 1) + c
        order = np.lexsort((pos, key))
        key = key[order]
        new = np.diff(key, prepend=-1) != 0
        edge = new | np.append(new[1:], True)
        rows = np.sort(rows[order[edge]])
    return rows


def hull_features(vox: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """(image_id, roi, hull_volume, hull_area, morph_max_3d_diameter) of the mesh vertices, half a voxel out along each axis.

    They are the sums of a voxel and half a step, so corners of their hull belong to corners of the voxels' hull. Only the ends of
    every line along x can be such corners, so a region sends few points."""
    scale = np.array(spacing, float) / 2
    step = np.concatenate([np.eye(3, dtype=np.int64), -np.eye(3, dtype=np.int64)])
    lines = vox.groupBy(*ROI, "y", "z").agg(F.array_distinct(F.array(F.min("x"), F.max("x"))).alias("x"))

    def work(g: np.ndarray, c: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        rows = ends(g, [c[a].astype(np.int64) for a in "xyz"])
        place, g = np.stack([2 * c[a][rows].astype(np.int64) for a in "xyz"], 1), g[rows]
        cuts = np.flatnonzero(np.diff(g, prepend=-1))
        out = np.zeros((3, len(cuts)))
        for k, own in enumerate(np.split(place, cuts[1:])):
            inner = {i for f in hull_faces(own) for i in f}
            corners = own[sorted(inner)] if inner else own  # a flat region keeps all
            low = corners.min(0) - 1
            points = (corners[:, None] - low + step).reshape(-1, 3)
            size = points.max(0) + 1
            points = np.stack(np.unravel_index(np.unique(np.ravel_multi_index(points.T, size)), size), 1) + low
            faces = np.array(hull_faces(points))
            mm = points * scale
            a, b, d = (mm[faces[:, i]] for i in range(3))
            cross = np.cross(b - a, d - a)
            at = mm[np.unique(faces)]
            far = max((((at - v) ** 2).sum(1).max() for v in at), default=0.0)
            out[:, k] = abs((a * cross).sum() / 6), np.sqrt((cross**2).sum(1)).sum() / 2, np.sqrt(far)
        yield {"group": g[cuts], "hull_volume": out[0], "hull_area": out[1], "morph_max_3d_diameter": out[2]}

    rows = lines.select(*ROI, F.explode("x").alias("x"), "y", "z")
    return streamed(rows, ROI, work, "hull_volume double, hull_area double, morph_max_3d_diameter double")


def all_features(vox: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """The 29 morphology columns."""
    out = shape_features(vox, spacing).join(hull_features(vox, spacing), ROI).join(autocorrelation(vox, spacing), ROI)
    return out.withColumns({
        "morph_solidity": F.col("morph_volume_mesh") / F.nullif(F.col("hull_volume"), F.lit(0.0)),
        "morph_area_density_convex_hull": F.col("morph_surface_area") / F.nullif(F.col("hull_area"), F.lit(0.0)),
    }).drop("hull_volume", "hull_area")
