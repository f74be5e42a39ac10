"""SQL that an independent engine can run to check the registered queries, each over whole tables."""

from __future__ import annotations

from voxlake.operators.firstorder import IH, IVH, STAT, sphere
from voxlake.operators.texture import AROUND, DIRECTIONS, GLCM, NAMES, NGTDM

ORACLES: dict[str, str] = {}

VOX = """vox AS (SELECT CAST(l_suppkey AS INT) image_id, CAST(l_partkey % 16 AS INT) x, CAST(l_orderkey % 16 AS INT) y,
 CAST(l_linenumber - 1 AS INT) z, CAST(MAX(l_quantity) AS INT) intensity,
 CAST(MAX(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END) AS INT) AS "label" FROM lineitem GROUP BY 1, 2, 3, 4)"""
R = VOX + """, r AS (SELECT image_id, 'label_' || "label" roi, x, y, z, CAST(intensity AS DOUBLE) v FROM vox)"""
Q = R + ", q AS (SELECT image_id, roi, x, y, z, v, CAST(GREATEST(FLOOR((v - 1) / 8) + 1, 1) AS INT) lev FROM r)"


def rounded(sql: str, names: list[str], keys: str = "image_id, roi") -> str:
    """The statement with its doubles to six decimals."""
    head, _, body = sql.rpartition("\nSELECT ")
    return f"{head}\nSELECT {keys}, " + ", ".join(f"ROUND({n}, 6) + 0.0 AS {n}" for n in names) + f" FROM (SELECT {body})"


ORACLES["scan_voxelize"] = f"WITH {VOX} SELECT * FROM vox"
ORACLES["mask_labels_distinct"] = f'WITH {VOX} SELECT DISTINCT image_id, "label" FROM vox'
ORACLES["roi_volume_count"] = f'WITH {VOX} SELECT image_id, "label", COUNT(*) volume FROM vox GROUP BY 1, 2'

# --- connected components: the least place of a component spreads from voxel to voxel ------------------------------------
AROUND_SQL = "(VALUES " + ",".join(f"({a},{b},{c})" for a, b, c in AROUND) + ") o(dx, dy, dz)"
COMPS = f"""WITH RECURSIVE {VOX}, n AS (SELECT *, x + 32 * y + 1024 * z p FROM vox),
 e AS MATERIALIZED (SELECT a.image_id, a."label", a.p, b.p w FROM (SELECT * FROM n, {AROUND_SQL}) a JOIN n b ON b.image_id = a.image_id
  AND b."label" = a."label" AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz),
 comp(image_id, "label", p, root) USING KEY (image_id, "label", p) AS (SELECT image_id, "label", p, p FROM n UNION
  SELECT e.image_id, e."label", e.w, MIN(c.root) FROM comp c JOIN e ON e.image_id = c.image_id AND e."label" = c."label" AND e.p = c.p
  JOIN recurring.comp old ON old.image_id = e.image_id AND old."label" = e."label" AND old.p = e.w WHERE c.root < old.root GROUP BY 1, 2, 3),
 vol AS (SELECT image_id, "label", root, COUNT(*) volume FROM comp GROUP BY 1, 2, 3)"""
ORACLES["roi_components_26"] = COMPS + ' SELECT image_id, "label", COUNT(*) n_components, MAX(volume) largest, CAST(SUM(volume * volume) AS BIGINT) sum_squares FROM vol GROUP BY 1, 2'
ORACLES["roi_min_volume_filter"] = COMPS + ' SELECT image_id, "label", COUNT(*) n, CAST(SUM(volume) AS BIGINT) volume FROM vol WHERE volume >= 10 GROUP BY 1, 2'
for _name, _keys in (("image", "image_id"), ("region", 'image_id, "label"')):
    ORACLES[f"roi_topn_per_{_name}"] = COMPS + f' SELECT image_id, "label", volume FROM vol QUALIFY ROW_NUMBER() OVER (PARTITION BY {_keys} ORDER BY volume DESC, "label", root) <= 5'
LESION = COMPS + """, big AS (SELECT * FROM vol WHERE volume >= 5),
 les AS (SELECT n.image_id, n."label", big.root, COUNT(*) w, AVG(intensity) stat_mean, MAX(intensity) stat_max,
  CAST(COUNT(*) AS DOUBLE) morph_volume_count, MIN(intensity) low, MIN(n.p) first FROM n JOIN comp USING (image_id, "label", p)
  JOIN big ON big.image_id = comp.image_id AND big."label" = comp."label" AND big.root = comp.root GROUP BY 1, 2, 3)"""
_LESIONS = "ROUND(SUM(stat_mean * w) / SUM(w), 6) stat_mean, ROUND(SUM(stat_max * w) / SUM(w), 6) stat_max, ROUND(SUM(morph_volume_count), 6) morph_volume_count, CAST(ARG_MIN(low, first) AS DOUBLE) int_mask_min_int_init_roi"
ORACLES["agg_lesion_per_img"] = LESION + f" SELECT image_id, {_LESIONS} FROM les GROUP BY 1"
ORACLES["agg_lesion_per_region"] = LESION + f""" SELECT image_id, 'label_' || "label" roi, {_LESIONS} FROM les GROUP BY 1, 2"""
ORACLES["agg_lesion_deep_mean"] = 'SELECT "label" image_id, ' + ", ".join(f"ROUND(AVG(CAST(embedding[{k + 1}] AS DOUBLE)), 6) + 0.0 deep_feature_{k}" for k in range(8)) + " FROM embeddings GROUP BY 1"
ORACLES["agg_lesion_deep_mean_whole"] = 'SELECT "label" image_id, ' + ", ".join(f"ROUND(AVG(CAST(embedding[{k + 1}] AS DOUBLE)), 6) + 0.0 deep_feature_{k}" for k in range(64)) + " FROM embeddings GROUP BY 1"

# --- preparation ------------------------------------------------------------------------------------------------------------
_CELL = "image_id, roi, x, y, z, v intensity"
_OVER = "OVER (PARTITION BY image_id, roi)"
ORACLES["disc_fbs"] = f"WITH {R} SELECT {_CELL}, CAST(GREATEST(FLOOR((v - MIN(v) {_OVER}) / 8) + 1, 1) AS INT) AS level FROM r"
ORACLES["disc_fbs_pet_anchor"] = f"WITH {R} SELECT {_CELL}, CAST(GREATEST(FLOOR(v / 8) + 1, 1) AS INT) AS level FROM r"
_FBN = "CAST(CASE WHEN {hi} > {lo} THEN LEAST(GREATEST(FLOOR({n} * (v - {lo}) / ({hi} - {lo})) + 1, 1), {n}) ELSE 1 END AS INT) AS level"
ORACLES["disc_fbn"] = f"WITH {R} SELECT {_CELL}, {_FBN.format(hi=f'MAX(v) {_OVER}', lo=f'MIN(v) {_OVER}', n=8)} FROM r"
ORACLES["disc_fbn_reals"] = (
    "WITH e AS (SELECT CAST(vec_id AS INT) image_id, UNNEST(embedding) v, UNNEST(range(64)) pos FROM embeddings), f AS (SELECT image_id, pos, CAST(v AS DOUBLE) v FROM e) "
    f"SELECT image_id, CAST(pos % 8 AS INT) x, CAST(pos // 8 AS INT) y, {_FBN.format(hi='MAX(v) OVER (PARTITION BY image_id)', lo='MIN(v) OVER (PARTITION BY image_id)', n=32)} FROM f"
)
ORACLES["reseg_range"] = f"WITH {R} SELECT image_id, roi, x, y, z, CASE WHEN v >= 5 AND v <= 40 THEN v END intensity FROM r"
ORACLES["outlier_3sigma"] = f"WITH {R} SELECT image_id, roi, x, y, z, CASE WHEN ABS(v - AVG(v) {_OVER}) <= 1.5 * STDDEV_POP(v) {_OVER} THEN v END intensity FROM r"
ORACLES["round_gl"] = f"WITH {R} SELECT image_id, roi, x, y, z, ROUND_EVEN(v / 4, 0) intensity FROM r"


def grid() -> str:
    out = "size AS (SELECT image_id, MAX(x) + 1 nx, MAX(y) + 1 ny, MAX(z) + 1 nz FROM vox GROUP BY 1), "
    out += ", ".join(f"g{a} AS (SELECT image_id, CAST(UNNEST(range(CAST(CEIL(n{a} * {s} / {t}) AS BIGINT))) AS INT) {a}, CAST(CEIL(n{a} * {s} / {t}) AS BIGINT) m{a}, n{a} FROM size)" for a, t, s in (("x", 2.0, 1.0), ("y", 2.0, 1.0), ("z", 2.0, 3.0)))
    place = ", ".join(f"GREATEST(0.0, LEAST(({a} - (m{a} - 1) / 2.0) * ({t} / {s}) + (n{a} - 1) / 2.0, n{a} - 1.0)) s{a}" for a, t, s in (("x", "2.0::DOUBLE", "1.0::DOUBLE"), ("y", "2.0::DOUBLE", "1.0::DOUBLE"), ("z", "2.0::DOUBLE", "3.0::DOUBLE")))
    return out + f", grid AS (SELECT image_id, x, y, z, {place} FROM gx JOIN gy USING (image_id) JOIN gz USING (image_id))"


ORACLES["resample_nearest"] = f"WITH {VOX}, {grid()} SELECT g.image_id, g.x, g.y, g.z, intensity FROM grid g JOIN vox v ON v.image_id = g.image_id AND v.x = FLOOR(sx + 0.5) AND v.y = FLOOR(sy + 0.5) AND v.z = FLOOR(sz + 0.5)"
_CORNER = "(VALUES " + ",".join(f"({k & 1},{k >> 1 & 1},{k >> 2})" for k in range(8)) + ") o(a, b, c)"
_WEIGHT = " * ".join(f"(CASE WHEN {b} = 1 THEN s{a} - FLOOR(s{a}) ELSE 1 - (s{a} - FLOOR(s{a})) END)" for a, b in zip("xyz", "abc", strict=True))
_LINEAR = "WITH {vox}, {grid}, c AS (SELECT *, {w} w FROM grid, {corner}), lin AS (SELECT c.image_id, c.x, c.y, c.z, SUM(w * COALESCE({value}, 0.0)) s FROM c LEFT JOIN vox v ON v.image_id = c.image_id AND v.x = FLOOR(sx) + a AND v.y = FLOOR(sy) + b AND v.z = FLOOR(sz) + c.c WHERE w > 0 GROUP BY 1, 2, 3, 4)"
ORACLES["resample_linear"] = _LINEAR.format(vox=VOX, grid=grid(), w=_WEIGHT, corner=_CORNER, value="intensity") + " SELECT image_id, x, y, z, ROUND(s, 6) intensity FROM lin"
ORACLES["pv_threshold"] = _LINEAR.format(vox=VOX, grid=grid(), w=_WEIGHT, corner=_CORNER, value='CASE WHEN "label" = 1 THEN 1.0 ELSE 0.0 END') + " SELECT image_id, x, y, z FROM lin WHERE s >= 0.5"

# --- first-order features ---------------------------------------------------------------------------------------------------
STATS = f"""WITH {R}, s AS (SELECT image_id, roi, QUANTILE_CONT(v, [0.1, 0.25, 0.5, 0.75, 0.9]) q, AVG(v) mu FROM r GROUP BY 1, 2),
 t AS (SELECT r.*, q, mu, AVG(CASE WHEN v BETWEEN q[1] AND q[5] THEN v END) OVER (PARTITION BY r.image_id, r.roi) rmu FROM r JOIN s ON s.image_id = r.image_id AND s.roi = r.roi),
 u AS (SELECT image_id, roi, ANY_VALUE(q) q, ANY_VALUE(mu) mean, AVG((v - mu) ** 2) var, AVG((v - mu) ** 3) m3, AVG((v - mu) ** 4) m4, MIN(v) lo, MAX(v) hi,
  AVG(ABS(v - mu)) mad, AVG(CASE WHEN v BETWEEN q[1] AND q[5] THEN ABS(v - rmu) END) rmad, AVG(ABS(v - q[3])) medad, SUM(v * v) energy, SQRT(AVG(v * v)) rms FROM t GROUP BY 1, 2)
SELECT image_id, roi, mean stat_mean, var stat_var, CASE WHEN var > 0 THEN m3 / var ** 1.5 ELSE 0 END stat_skew, CASE WHEN var > 0 THEN m4 / (var * var) - 3 ELSE 0 END stat_kurt,
 q[3] stat_median, lo stat_min, q[1] stat_p10, q[5] stat_p90, hi stat_max, q[4] - q[2] stat_iqr, hi - lo stat_range, mad stat_mad, rmad stat_rmad, medad stat_medad,
 CASE WHEN var > 0 AND mean <> 0 THEN SQRT(var) / mean ELSE 0 END stat_cov, (TRUNC(q[4]) - TRUNC(q[2])) / (CASE WHEN TRUNC(q[4]) + TRUNC(q[2]) = 0 THEN 2.220446049250313e-16 ELSE TRUNC(q[4]) + TRUNC(q[2]) END) stat_qcod,
 energy stat_energy, rms stat_rms FROM u"""
ORACLES["stat_features"] = rounded(STATS, [f"stat_{m}" for m in STAT])
HIST = f"""WITH {Q}, k AS (SELECT image_id, roi, lev g, COUNT(*) n FROM q GROUP BY 1, 2, 3),
 d AS (SELECT image_id, roi, UNNEST(range(1, MAX(g) + 1)) g FROM k GROUP BY 1, 2),
 h AS (SELECT d.image_id, d.roi, CAST(d.g AS INT) g, COALESCE(n, 0) n, COALESCE(n, 0) / SUM(n) OVER w p, SUM(COALESCE(n, 0)) OVER up / SUM(n) OVER w cum,
  LAG(COALESCE(n, 0)) OVER up AS bef, LEAD(COALESCE(n, 0)) OVER up AS aft FROM d LEFT JOIN k ON k.image_id = d.image_id AND k.roi = d.roi AND k.g = d.g
  WINDOW w AS (PARTITION BY d.image_id, d.roi), up AS (PARTITION BY d.image_id, d.roi ORDER BY d.g)),
 m AS (SELECT *, SUM(g * p) OVER w mu, MIN(CASE WHEN cum >= 0.1 THEN g END) OVER w q10, MIN(CASE WHEN cum >= 0.25 THEN g END) OVER w q25, MIN(CASE WHEN cum >= 0.5 THEN g END) OVER w q50,
  MIN(CASE WHEN cum >= 0.75 THEN g END) OVER w q75, MIN(CASE WHEN cum >= 0.9 THEN g END) OVER w q90,
  CASE WHEN bef IS NULL AND aft IS NULL THEN 0.0 WHEN bef IS NULL THEN aft - n WHEN aft IS NULL THEN n - bef ELSE (aft - bef) / 2 END grad
  FROM h WINDOW w AS (PARTITION BY image_id, roi)),
 o AS (SELECT *, SUM(CASE WHEN g BETWEEN q10 AND q90 THEN g * p END) OVER w / SUM(CASE WHEN g BETWEEN q10 AND q90 THEN p END) OVER w rmu FROM m WINDOW w AS (PARTITION BY image_id, roi)),
 s AS (SELECT image_id, roi, ANY_VALUE(mu) mean, SUM(p * (g - mu) ** 2) var, SUM(p * (g - mu) ** 3) m3, SUM(p * (g - mu) ** 4) m4, ANY_VALUE(q10) q10, ANY_VALUE(q25) q25, ANY_VALUE(q50) q50,
  ANY_VALUE(q75) q75, ANY_VALUE(q90) q90, MIN(CASE WHEN n > 0 THEN g END) lo, MAX(g) hi, FIRST(g ORDER BY n DESC, ABS(g - mu), g) AS "mode", SUM(p * ABS(g - mu)) mad,
  SUM(CASE WHEN g BETWEEN q10 AND q90 THEN p * ABS(g - rmu) END) / SUM(CASE WHEN g BETWEEN q10 AND q90 THEN p END) rmad, SUM(p * ABS(g - q50)) medad,
  -SUM(CASE WHEN p > 0 THEN p * LOG2(p) END) entropy, SUM(p * p) uniformity, MAX(grad) xg, MIN(grad) ng, FIRST(g ORDER BY grad DESC, g) xgg, FIRST(g ORDER BY grad, g) ngg FROM o GROUP BY 1, 2)
SELECT image_id, roi, mean ih_mean, var ih_var, CASE WHEN var > 0 THEN m3 / var ** 1.5 ELSE 0 END ih_skew, CASE WHEN var > 0 THEN m4 / (var * var) - 3 ELSE 0 END ih_kurt,
 CAST(q50 AS DOUBLE) ih_median, CAST(lo AS DOUBLE) ih_min, CAST(q10 AS DOUBLE) ih_p10, CAST(q90 AS DOUBLE) ih_p90, CAST(hi AS DOUBLE) ih_max, CAST("mode" AS DOUBLE) ih_mode,
 CAST(q75 - q25 AS DOUBLE) ih_iqr, CAST(hi - lo AS DOUBLE) ih_range, mad ih_mad, rmad ih_rmad, medad ih_medad, CASE WHEN var > 0 AND mean <> 0 THEN SQRT(var) / mean ELSE 0 END ih_cov,
 (q75 - q25) / (q75 + q25) ih_qcod, entropy ih_entropy, uniformity ih_uniformity, CAST(xg AS DOUBLE) ih_max_grad, CAST(xgg AS DOUBLE) ih_max_grad_g, CAST(ng AS DOUBLE) ih_min_grad, CAST(ngg AS DOUBLE) ih_min_grad_g FROM s"""
_GRADS = [f"ih_{m}" for m in IH if "grad" in m]
ORACLES["ih_features"] = rounded(HIST, [f"ih_{m}" for m in IH if "grad" not in m])
ORACLES["ih_gradients"] = rounded(HIST, _GRADS)
ORACLES["select_category_dimension"] = (
    f"SELECT image_id, roi, stat_mean, stat_median, ih_mean, ih_entropy FROM ({ORACLES['stat_features']}) JOIN ({ORACLES['ih_features']}) USING (image_id, roi)"
)
IVHS = f"""WITH {R}, s AS (SELECT image_id, roi, FLOOR(MIN(v)) t0, CEIL(MAX(v)) t1, COUNT(*) total FROM r GROUP BY 1, 2),
 g AS (SELECT *, UNNEST(range(CAST(t1 - t0 AS BIGINT) + 1)) b FROM s),
 c AS (SELECT g.image_id, g.roi, b, t0 + b t, COUNT(r.v) / ANY_VALUE(total) frac FROM g LEFT JOIN r ON r.image_id = g.image_id AND r.roi = g.roi AND r.v >= t0 + b GROUP BY 1, 2, 3, 4),
 d AS (SELECT *, COALESCE((t - MIN(t) OVER w) / NULLIF(MAX(t) OVER w - MIN(t) OVER w, 0), 0) norm FROM c WINDOW w AS (PARTITION BY image_id, roi)),
 e AS (SELECT *, (LEAD(norm) OVER up - norm) * (LEAD(frac) OVER up + frac) / 2 area FROM d WINDOW up AS (PARTITION BY image_id, roi ORDER BY b)),
 f AS (SELECT image_id, roi, COALESCE(ARG_MIN(frac, b) FILTER (norm >= 0.1), ARG_MAX(frac, b)) v10, COALESCE(ARG_MIN(frac, b) FILTER (norm >= 0.9), ARG_MAX(frac, b)) v90,
  MIN(CASE WHEN frac <= 0.1 THEN t END) i10, MIN(CASE WHEN frac <= 0.9 THEN t END) i90, COALESCE(SUM(area), 0) auc FROM e GROUP BY 1, 2)
SELECT image_id, roi, v10 ivh_v10, v90 ivh_v90, i10 ivh_i10, i90 ivh_i90, v10 - v90 ivh_diff_v10_v90, i10 - i90 ivh_diff_i10_i90, auc ivh_auc FROM f"""
ORACLES["ivh_features"] = rounded(IVHS, [f"ivh_{m}" for m in IVH])
_BALL = "(VALUES " + ",".join(f"({a},{b},{c})" for a, b, c in sphere((3.0, 3.0, 3.0))) + ") o(dx, dy, dz)"
PEAK = f"""WITH {R}, b AS (SELECT c.image_id, c.roi, c.x, c.y, c.z, c.v, AVG(i.intensity) ball FROM (SELECT * FROM r, {_BALL}) c
 JOIN vox i ON i.image_id = c.image_id AND i.x = c.x + dx AND i.y = c.y + dy AND i.z = c.z + dz GROUP BY 1, 2, 3, 4, 5, 6), t AS (SELECT *, MAX(v) {_OVER} top FROM b)
SELECT image_id, roi, MAX(CASE WHEN v = top THEN ball END) loc_peak_loc, MAX(ball) loc_peak_glob FROM t GROUP BY 1, 2"""
ORACLES["peak_features"] = rounded(PEAK, ["loc_peak_loc", "loc_peak_glob"])

# --- texture ----------------------------------------------------------------------------------------------------------------
_DIRS = "(VALUES " + ",".join(f"({k},{a},{b},{c})" for k, (a, b, c) in enumerate(DIRECTIONS)) + ") o(d, dx, dy, dz)"
#: mode: (unit of a matrix, whether only the four directions in a slice count)
_MODES = {"2D_avg": ("z * 4 + d", True), "2D_comb": ("z", True), "2_5D_avg": ("d", True), "2_5D_comb": ("0", True), "3D_avg": ("d", False), "3D_comb": ("0", False)}


def key_of(mode: str) -> str:
    return mode.lower().replace("2_5d", "25d")


def glcm_cells(mode: str) -> str:
    unit, flat = _MODES[mode]
    return f"""{Q}, nb AS (SELECT a.image_id, a.roi, a.z, a.d, a.lev i, b.lev j FROM (SELECT * FROM q, {_DIRS}{' WHERE d < 4' if flat else ''}) a
 JOIN q b ON b.image_id = a.image_id AND b.roi = a.roi AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz),
 sides AS (SELECT image_id, roi, {unit} u, i, j FROM nb UNION ALL SELECT image_id, roi, {unit} u, j, i FROM nb),
 cell AS (SELECT image_id, roi, u, i, j, COUNT(*) n FROM sides GROUP BY ALL)"""


ORACLES["glcm_matrix_3d"] = f"WITH {glcm_cells('3D_comb')} SELECT image_id, roi, i, j, n FROM cell"
for _mode in _MODES:
    _mean = (lambda m: f"SUM({m}) / ANY_VALUE(slices)") if _mode == "2D_comb" else (lambda m: f"AVG({m})")
    _sql = f"""WITH {glcm_cells(_mode)}, lv AS (SELECT image_id, roi, MAX(lev) ng, MAX(z) - MIN(z) + 1 slices FROM q GROUP BY 1, 2),
 p AS (SELECT c.*, n / SUM(n) OVER w p, SUM(i * n) OVER w / SUM(n) OVER w mu, GREATEST(ng - 1, 1) far, slices FROM cell c JOIN lv ON lv.image_id = c.image_id AND lv.roi = c.roi
  WINDOW w AS (PARTITION BY c.image_id, c.roi, u)),
 px AS (SELECT image_id, roi, u, i, ANY_VALUE(mu) mu, SUM(p) p FROM p GROUP BY 1, 2, 3, 4),
 ps AS (SELECT image_id, roi, u, i + j s, ANY_VALUE(mu) mu, SUM(p) p FROM p GROUP BY 1, 2, 3, 4),
 pd AS (SELECT image_id, roi, u, ABS(i - j) d, SUM(p) p FROM p GROUP BY 1, 2, 3, 4),
 x AS (SELECT image_id, roi, u, SUM(i * p) joint_avg, SUM((i - mu) ** 2 * p) joint_var, -SUM(p * LOG2(p)) hx FROM px GROUP BY 1, 2, 3),
 s AS (SELECT image_id, roi, u, SUM(s * p) sum_avg, SUM((s - 2 * mu) ** 2 * p) sum_var, -SUM(p * LOG2(p)) sum_entr FROM ps GROUP BY 1, 2, 3),
 d AS (SELECT image_id, roi, u, SUM(d * p) diff_avg, SUM(d * d * p) - SUM(d * p) ** 2 diff_var, -SUM(p * LOG2(p)) diff_entr FROM pd GROUP BY 1, 2, 3),
 c AS (SELECT image_id, roi, u, ANY_VALUE(slices) slices, MAX(p) joint_max, -SUM(p * LOG2(p)) joint_entr, SUM(p * p) energy, SUM((i - j) ** 2 * p) contrast, SUM(ABS(i - j) * p) dissimilarity,
  SUM(p / (1 + ABS(i - j))) inv_diff, SUM(p / (1 + ABS(i - j) / far)) inv_diff_norm, SUM(p / (1 + (i - j) ** 2)) inv_diff_mom, SUM(p / (1 + (i - j) ** 2 / (far * far))) inv_diff_mom_norm,
  COALESCE(SUM(CASE WHEN i < j THEN 2 * p / (i - j) ** 2 END), 0) inv_var, SUM((i - mu) * (j - mu) * p) cov, SUM(i * j * p) auto_corr, SUM((i + j - 2 * mu) ** 2 * p) clust_tend,
  SUM((i + j - 2 * mu) ** 3 * p) clust_shade, SUM((i + j - 2 * mu) ** 4 * p) clust_prom FROM p GROUP BY 1, 2, 3),
 f AS (SELECT *, CASE WHEN joint_var > 0 THEN cov / joint_var ELSE 0 END corr, (joint_entr - 2 * hx) / (CASE WHEN hx > 0 THEN hx ELSE 1 END) info_corr1,
  CASE WHEN joint_entr - 2 * hx < 0 THEN SQRT(1 - EXP(2 * (joint_entr - 2 * hx))) ELSE 0 END info_corr2 FROM c JOIN x USING (image_id, roi, u) JOIN s USING (image_id, roi, u) JOIN d USING (image_id, roi, u))
SELECT image_id, roi, {', '.join(f'{_mean(m)} {m}' for m in GLCM)} FROM f GROUP BY 1, 2"""
    ORACLES[f"glcm_{key_of(_mode)}"] = rounded(_sql, list(GLCM))


def emphasis(family: str, names: tuple[str, ...]) -> str:
    """Closing steps from cell (image_id, roi, u, i, k, n, nv) to the means over units."""
    old = ("a1", "a2", "a3", "a4", "a5", "a6", "a7", "a8", "glnu", "glnu_norm", "knu", "knu_norm", "perc", "gl_var", "k_var", "entr", "energy")
    return f""", m AS (SELECT *, SUM(n) OVER (PARTITION BY image_id, roi, u) ns, n / SUM(n) OVER (PARTITION BY image_id, roi, u) p FROM cell),
 gi AS (SELECT image_id, roi, u, i, SUM(n) n, ANY_VALUE(ns) ns FROM m GROUP BY 1, 2, 3, 4), gk AS (SELECT image_id, roi, u, k, SUM(n) n, ANY_VALUE(ns) ns FROM m GROUP BY 1, 2, 3, 4),
 ai AS (SELECT image_id, roi, u, SUM(n * n) / ANY_VALUE(ns) glnu, SUM((n / ns) ** 2) glnu_norm, SUM(i * i * n / ns) - SUM(i * n / ns) ** 2 gl_var FROM gi GROUP BY 1, 2, 3),
 ak AS (SELECT image_id, roi, u, SUM(n * n) / ANY_VALUE(ns) knu, SUM((n / ns) ** 2) knu_norm, SUM(k * k * n / ns) - SUM(k * n / ns) ** 2 k_var FROM gk GROUP BY 1, 2, 3),
 a AS (SELECT image_id, roi, u, SUM(p / (k * k)) a1, SUM(p * k * k) a2, SUM(p / (i * i)) a3, SUM(p * i * i) a4, SUM(p / (i * i * k * k)) a5, SUM(p * i * i / (k * k)) a6, SUM(p * k * k / (i * i)) a7,
  SUM(p * i * i * k * k) a8, ANY_VALUE(ns) / ANY_VALUE(nv) perc, -SUM(p * LOG2(p)) entr, SUM(p * p) energy FROM m GROUP BY 1, 2, 3),
 f AS (SELECT * FROM a JOIN ai USING (image_id, roi, u) JOIN ak USING (image_id, roi, u))
SELECT image_id, roi, {', '.join(f'AVG({o}) {n}' for o, n in zip(old, names, strict=False))} FROM f GROUP BY 1, 2"""


_LINE = "CASE WHEN dx <> 0 THEN x WHEN dy <> 0 THEN y ELSE z END"
RUNS = f"""{Q}, ln AS (SELECT image_id, roi, d, lev i, {_LINE} pos, x - {_LINE} * dx lx, y - {_LINE} * dy ly, z - {_LINE} * dz lz FROM q, {_DIRS}),
 isl AS (SELECT *, pos - ROW_NUMBER() OVER (PARTITION BY image_id, roi, d, lx, ly, lz, i ORDER BY pos) grp FROM ln),
 rl AS (SELECT image_id, roi, d, lz z, i, COUNT(*) k FROM isl GROUP BY image_id, roi, d, lx, ly, lz, i, grp)"""
ORACLES["glrlm_matrix_3d"] = f"WITH {RUNS} SELECT image_id, roi, i, CAST(k AS INT) l, COUNT(*) n FROM rl GROUP BY 1, 2, 3, 4"
for _mode, (_unit, _flat) in _MODES.items():
    _cut = " WHERE d < 4" if _flat else ""
    _cells = f"WITH {RUNS}, cell AS (SELECT image_id, roi, {_unit} u, i, k, COUNT(*) n, 1 nv FROM rl{_cut} GROUP BY 1, 2, 3, 4, 5)"
    if _mode.startswith("2D"):
        _perc = f"sl AS (SELECT image_id, roi, z, COUNT(*) part FROM q GROUP BY 1, 2, 3), pr AS (SELECT image_id, roi, z, d, COUNT(*) n FROM rl{_cut} GROUP BY 1, 2, 3, 4), pc AS (SELECT image_id, roi, AVG(n / part) r_perc FROM pr JOIN sl USING (image_id, roi, z) GROUP BY 1, 2)"
    else:
        _perc = f"wh AS (SELECT image_id, roi, COUNT(*) whole FROM q GROUP BY 1, 2), pr AS (SELECT image_id, roi, d, COUNT(*) n FROM rl{_cut} GROUP BY 1, 2, 3), pc AS (SELECT image_id, roi, {'SUM' if _mode == '2_5D_comb' else 'AVG'}(n / whole) r_perc FROM pr JOIN wh USING (image_id, roi) GROUP BY 1, 2)"
    _head, _, _tail = (_cells + emphasis("glrlm", tuple(n if n != "r_perc" else "unused" for n in NAMES["glrlm"]))).rpartition("\nSELECT ")
    _sql = f"{_head}, {_perc}\nSELECT * FROM (SELECT {_tail}) JOIN pc USING (image_id, roi)"
    ORACLES[f"glrlm_{key_of(_mode)}"] = rounded(_sql, list(NAMES["glrlm"]))

_M3 = {"2D": ("z", True), "2_5D": ("0", True), "3D": ("0", False)}
for _mode, (_unit, _flat) in _M3.items():
    _near = f"""nb AS (SELECT a.image_id, a.roi, a.x, a.y, a.z, COUNT(*) m, COUNT(*) FILTER (b.lev = a.lev) e, SUM(b.lev) s FROM (SELECT * FROM q, {AROUND_SQL}{' WHERE dz = 0' if _flat else ''}) a
 JOIN q b ON b.image_id = a.image_id AND b.roi = a.roi AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3, 4, 5)"""
    _size = "PARTITION BY image_id, roi, z" if _mode == "2D" else "PARTITION BY image_id, roi"
    _sql = f"""WITH {Q}, {_near}, al AS (SELECT q.*, COUNT(*) OVER ({_size}) nv FROM q), cell AS (SELECT al.image_id, al.roi, {'al.z' if _unit == 'z' else '0'} u, lev i, COALESCE(e, 0) + 1 k, COUNT(*) n, ANY_VALUE(nv) nv
 FROM al LEFT JOIN nb ON nb.image_id = al.image_id AND nb.roi = al.roi AND nb.x = al.x AND nb.y = al.y AND nb.z = al.z GROUP BY 1, 2, 3, 4, 5)""" + emphasis("ngl", NAMES["ngl"])
    ORACLES[f"ngldm_{key_of(_mode)}"] = rounded(_sql, list(NAMES["ngl"]))
    _sql = f"""WITH {Q}, {_near}, cell AS (SELECT q.image_id, q.roi, {'q.z' if _unit == 'z' else '0'} u, lev i, COUNT(*) n, SUM(ABS(lev - s / m)) s FROM q JOIN nb USING (image_id, roi, x, y, z) GROUP BY 1, 2, 3, 4),
 p AS (SELECT *, n / SUM(n) OVER w p, SUM(n) OVER w nv FROM cell WINDOW w AS (PARTITION BY image_id, roi, u)),
 one AS (SELECT image_id, roi, u, SUM(p * s) ps, SUM(s) ss, COUNT(*) ngp, ANY_VALUE(nv) nv FROM p GROUP BY 1, 2, 3),
 two AS (SELECT a.image_id, a.roi, a.u, SUM(a.p * b.p * (a.i - b.i) ** 2) con, SUM(ABS(a.i * a.p - b.i * b.p)) busy, SUM(ABS(a.i - b.i) * (a.p * a.s + b.p * b.s) / (a.p + b.p)) com,
  SUM((a.p + b.p) * (a.i - b.i) ** 2) str FROM p a JOIN p b ON b.image_id = a.image_id AND b.roi = a.roi AND b.u = a.u GROUP BY 1, 2, 3),
 f AS (SELECT image_id, roi, CASE WHEN ps > 0 THEN LEAST(1 / ps, 1e6) END coarseness, CASE WHEN ngp < 2 THEN 0 ELSE con / (ngp * (ngp - 1)) * ss / nv END contrast,
  CASE WHEN ngp < 2 OR busy = 0 THEN 0 ELSE ps / busy END busyness, com / nv complexity, CASE WHEN ss > 0 THEN str / ss END strength FROM one JOIN two USING (image_id, roi, u))
SELECT image_id, roi, {', '.join(f'AVG({m}) {m}' for m in NGTDM)} FROM f GROUP BY 1, 2"""
    ORACLES[f"ngtdm_{key_of(_mode)}"] = rounded(_sql, list(NGTDM))

# --- zones: components of equal level, in slices and in space; the distance to the outside by eroding the mask step by step ----
_STEPS = {True: "(VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0)) o(dx, dy, dz)", False: "(VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dx, dy, dz)"}


def zone_cells(flat: bool) -> str:
    """Recursive steps up to zone (image_id, roi, z, i, size, distance)."""
    eroded = ", ".join(f"""e{k + 1} AS MATERIALIZED (SELECT a.image_id, a.roi, a.x, a.y, a.z FROM (SELECT * FROM e{k}, {_STEPS[flat]}) a JOIN e{k} b ON b.image_id = a.image_id AND b.roi = a.roi
  AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3, 4, 5 HAVING COUNT(*) = {4 if flat else 6})""" for k in range(1, 9))
    deep = " UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(1, 10))
    return f"""WITH RECURSIVE {Q}, n AS (SELECT *, x + 32 * y + 1024 * z p FROM q),
 w AS MATERIALIZED (SELECT a.image_id, a.roi, a.p, b.p t FROM (SELECT * FROM n, {AROUND_SQL}{' WHERE dz = 0' if flat else ''}) a JOIN n b ON b.image_id = a.image_id AND b.roi = a.roi
  AND b.lev = a.lev AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz),
 comp(image_id, roi, p, root) USING KEY (image_id, roi, p) AS (SELECT image_id, roi, p, p FROM n UNION SELECT w.image_id, w.roi, w.t, MIN(c.root) FROM comp c
  JOIN w ON w.image_id = c.image_id AND w.roi = c.roi AND w.p = c.p JOIN recurring.comp old ON old.image_id = w.image_id AND old.roi = w.roi AND old.p = w.t WHERE c.root < old.root GROUP BY 1, 2, 3),
 e1 AS (SELECT image_id, roi, x, y, z FROM r), {eroded}, dist AS (SELECT image_id, roi, x + 32 * y + 1024 * z p, COUNT(*) d FROM ({deep}) GROUP BY 1, 2, 3),
 zone AS (SELECT image_id, roi, MIN(z) z, MIN(lev) i, COUNT(*) size, MIN(d) distance FROM comp JOIN n USING (image_id, roi, p) JOIN dist USING (image_id, roi, p) GROUP BY image_id, roi, root)"""


for _mode, (_unit, _flat) in _M3.items():
    _nv = "SELECT image_id, roi, z u, COUNT(*) nv FROM q GROUP BY 1, 2, 3" if _unit == "z" else "SELECT image_id, roi, 0 u, COUNT(*) nv FROM q GROUP BY 1, 2"
    for _family, _names, _by in (("glszm", NAMES["szm"], "size"), ("gldzm", NAMES["dzm"], "distance")):
        _sql = f"""{zone_cells(_flat)}, nv AS ({_nv}), cell AS (SELECT zone.image_id, zone.roi, nv.u, i, {_by} k, COUNT(*) n, ANY_VALUE(nv) nv FROM zone
 JOIN nv ON nv.image_id = zone.image_id AND nv.roi = zone.roi AND nv.u = {'zone.z' if _unit == 'z' else '0'} GROUP BY 1, 2, 3, 4, 5)""" + emphasis(_family, _names)
        ORACLES[f"{_family}_{key_of(_mode)}"] = rounded(_sql, list(_names))

# --- moments, diagnostics, axes, autocorrelation -----------------------------------------------------------------------------
_THIRD = [(a, b, c) for a in range(4) for b in range(4) for c in range(4) if a + b + c in (2, 3)]
_MOMENTS = f"""WITH {R}, s AS (SELECT *, MIN(v) {_OVER} lo, AVG(v) {_OVER} mean FROM r),
 f AS (SELECT image_id, roi, x, y, z, 'intensity' fld, CASE WHEN mean > lo THEN (v - lo) / (mean - lo) ELSE 0 END m FROM s UNION ALL SELECT image_id, roi, x, y, z, 'shape', 1.0 FROM s),
 g AS (SELECT image_id, roi, fld, SUM(m) mass, SUM(x * m) / NULLIF(SUM(m), 0) gx, SUM(y * m) / NULLIF(SUM(m), 0) gy, SUM(z * m) / NULLIF(SUM(m), 0) gz FROM f GROUP BY 1, 2, 3),
 e AS (SELECT f.image_id, f.roi, f.fld, {', '.join(f"SUM(m * (x - gx) ** {a} * (y - gy) ** {b} * (z - gz) ** {c}) / ANY_VALUE(mass) ** ({'5.0 / 3' if a + b + c == 2 else '2.0'}) n{a}{b}{c}" for a, b, c in _THIRD)}
  FROM f JOIN g ON g.image_id = f.image_id AND g.roi = f.roi AND g.fld = f.fld WHERE mass <> 0 GROUP BY 1, 2, 3),
 t AS (SELECT image_id, roi, fld, n200 + n020 + n002 i1, n200 ** 2 + n020 ** 2 + n002 ** 2 + 2 * (n110 ** 2 + n101 ** 2 + n011 ** 2) f2,
  n200 * n020 + n200 * n002 + n020 * n002 - n110 ** 2 - n101 ** 2 - n011 ** 2 i2, n200 * n020 * n002 + 2 * n110 * n101 * n011 - n200 * n011 ** 2 - n020 * n101 ** 2 - n002 * n110 ** 2 i3,
  n300 ** 2 + n030 ** 2 + n003 ** 2 + 3 * (n210 ** 2 + n201 ** 2 + n120 ** 2 + n021 ** 2 + n102 ** 2 + n012 ** 2) + 6 * n111 ** 2 f3 FROM e)
SELECT g.image_id, g.roi, {', '.join(f"MAX(CASE WHEN t.fld = '{w}' THEN {k} END) moment_{k}_{w}" for w in ('intensity', 'shape') for k in ('i1', 'f2', 'i2', 'i3', 'f3'))}
 FROM g LEFT JOIN t ON t.image_id = g.image_id AND t.roi = g.roi AND t.fld = g.fld GROUP BY 1, 2"""
ORACLES["moment_invariants"] = rounded(_MOMENTS, [f"moment_{k}_{w}" for w in ("intensity", "shape") for k in ("i1", "f2", "i2", "i3", "f3")])

_BOX = ", ".join(f"CAST(MAX({a}) - MIN({a}) + 1 AS INT) b_{a}" for a in "xyz")
_DIAG = ["c.image_id", "c.roi"]
for _tag in ("init", "interp"):
    _DIAG += [f"i{a} img_dim_{a}_{_tag}_img" for a in "xyz"] + [f"CAST({d} AS DOUBLE) vox_dim_{a}_{_tag}_img" for a, d in zip("xyz", (1, 1, 3), strict=True)]
    _DIAG += [f"ROUND(i{n}, 3) {n}_int_{_tag}_img" for n in ("mean", "min", "max")]
for _tag in ("init", "interp", "reseg"):
    _DIAG += [f"i{a} int_mask_dim_{a}_{_tag}_roi" for a in "xyz"] + [f"b_{a} {m}_mask_bb_dim_{a}_{_tag}_roi" for m in ("int", "morph") for a in "xyz"]
    _part = "kept" if _tag == "reseg" else "n"
    _DIAG += [f"{_part} int_mask_vox_count_{_tag}_roi", f"n morph_mask_vox_count_{_tag}_roi"] + [f"ROUND({'k' if _tag == 'reseg' else 'r'}{n}, 3) int_mask_{n}_int_{_tag}_roi" for n in ("mean", "min", "max")]
ORACLES["diag_features"] = f"""WITH {R}, i AS (SELECT image_id, {', '.join(f'CAST(MAX({a}) + 1 AS INT) i{a}' for a in 'xyz')}, AVG(intensity) imean, MIN(intensity) imin, MAX(intensity) imax FROM vox GROUP BY 1),
 c AS (SELECT image_id, roi, {_BOX}, COUNT(*) n, AVG(v) rmean, MIN(v) rmin, MAX(v) rmax, COUNT(*) FILTER (v BETWEEN 5 AND 40) kept, AVG(v) FILTER (v BETWEEN 5 AND 40) kmean,
  MIN(v) FILTER (v BETWEEN 5 AND 40) kmin, MAX(v) FILTER (v BETWEEN 5 AND 40) kmax FROM r GROUP BY 1, 2) SELECT {', '.join(_DIAG)} FROM c JOIN i ON i.image_id = c.image_id"""

_AXES = f"""WITH {R}, s AS (SELECT image_id, roi, COUNT(*) * 3.0 vol, COALESCE(COVAR_SAMP(x, x), 0) xx, COALESCE(COVAR_SAMP(y, y), 0) yy, COALESCE(COVAR_SAMP(3 * z, 3 * z), 0) zz, COALESCE(COVAR_SAMP(x, y), 0) xy,
  COALESCE(COVAR_SAMP(x, 3 * z), 0) xz, COALESCE(COVAR_SAMP(y, 3 * z), 0) yz, SUM(x * v) / NULLIF(SUM(v), 0) - AVG(x) dx, SUM(y * v) / NULLIF(SUM(v), 0) - AVG(y) dy, SUM(3 * z * v) / NULLIF(SUM(v), 0) - AVG(3 * z) dz FROM r GROUP BY 1, 2),
 q AS (SELECT *, (xx + yy + zz) / 3 q, xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz c1, xx * yy * zz + 2 * xy * xz * yz - xx * yz * yz - yy * xz * xz - zz * xy * xy c0 FROM s),
 h AS (SELECT *, SQRT(GREATEST(q * q - c1 / 3, 0)) h, q * q * q - q * c1 / 2 + c0 / 2 g FROM q),
 a AS (SELECT *, CASE WHEN h > 1e-9 THEN ACOS(GREATEST(-1, LEAST(1, g / (h * h * h)))) / 3 ELSE 0 END a FROM h),
 l AS (SELECT *, GREATEST(q + 2 * h * COS(a), 0) l1, GREATEST(q + 2 * h * COS(a - 2.0943951023931953), 0) l2, GREATEST(q + 2 * h * COS(a + 2.0943951023931953), 0) l3 FROM a)
SELECT image_id, roi, vol morph_volume_count, SQRT(dx * dx + dy * dy + dz * dz) morph_com_shift, 4 * SQRT(l1) morph_major_axis_length, 4 * SQRT(l2) morph_minor_axis_length, 4 * SQRT(l3) morph_least_axis_length,
 CASE WHEN l1 > 1e-12 THEN SQRT(l2 / l1) END morph_elongation, CASE WHEN l1 > 1e-12 THEN SQRT(l3 / l1) END morph_flatness FROM l"""
ORACLES["morph_count_pca_com"] = rounded(_AXES, [f"morph_{m}" for m in ("volume_count", "com_shift", "major_axis_length", "minor_axis_length", "least_axis_length", "elongation", "flatness")])
_AUTO = f"""WITH {R}, d AS (SELECT *, v - AVG(v) {_OVER} dev FROM r), t AS (SELECT image_id, roi, COUNT(*) n, SUM(dev * dev) ss FROM d GROUP BY 1, 2),
 p AS (SELECT a.image_id, a.roi, a.dev d1, b.dev d2, 1 / SQRT((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + 9 * (a.z - b.z) ** 2) w FROM d a JOIN d b ON b.image_id = a.image_id AND b.roi = a.roi AND (b.x <> a.x OR b.y <> a.y OR b.z <> a.z)),
 s AS (SELECT image_id, roi, SUM(w) w, SUM(w * d1 * d2) c, SUM(w * (d1 - d2) ** 2) g FROM p GROUP BY 1, 2)
SELECT image_id, roi, CASE WHEN ss > 0 THEN n / w * c / ss ELSE 1 END morph_moran_i, CASE WHEN ss > 0 THEN (n - 1) / (2 * w) * g / ss ELSE 1 END morph_geary_c FROM t JOIN s USING (image_id, roi)"""
ORACLES["morph_autocorr"] = rounded(_AUTO, ["morph_moran_i", "morph_geary_c"])

# --- pairing, union, reports --------------------------------------------------------------------------------------------------
_FILES = """im AS (SELECT p_partkey k, '/img/case_' || p_partkey || ['.nii.gz', '.nrrd', '.dcm'][p_partkey % 3 + 1] path FROM part),
 ms AS (SELECT p_partkey k, '/seg/case_' || p_partkey || '.nii.gz' path FROM part WHERE p_size <= 25)"""
ORACLES["pair_join_inner"] = f"WITH {_FILES} SELECT 'case_' || k AS \"key\", im.path image, ms.path mask FROM im JOIN ms USING (k)"
ORACLES["pair_unmatched_anti"] = f"WITH {_FILES} SELECT 'case_' || k AS \"key\", path image FROM im WHERE k NOT IN (SELECT k FROM ms)"
ORACLES["pair_broadcast_one_to_many"] = f"WITH {_FILES} SELECT (SELECT MIN(path) FROM im) image, path mask FROM ms"
ORACLES["pair_positional_zip"] = f"WITH {_FILES} SELECT a.p AS position, image, mask FROM (SELECT path image, ROW_NUMBER() OVER (ORDER BY path) p FROM im) a JOIN (SELECT path mask, ROW_NUMBER() OVER (ORDER BY path) p FROM ms) b ON a.p = b.p"
ORACLES["format_by_extension"] = f"WITH {_FILES} SELECT path, ['nifti', 'nrrd', 'dicom'][k % 3 + 1] format, 'case_' || k id FROM im"
ORACLES["feature_union_by_name"] = f"WITH {R} SELECT image_id, roi, ROUND(AVG(v), 6) stat_mean, NULL::DOUBLE stat_max FROM r GROUP BY 1, 2 UNION ALL SELECT image_id, roi, NULL, MAX(v) FROM r WHERE roi = 'label_1' GROUP BY 1, 2"
ORACLES["feature_pivot_wide"] = f"WITH {R} SELECT image_id, roi, ROUND(AVG(v), 6) stat_mean, MAX(v) stat_max FROM r GROUP BY 1, 2"
ORACLES["deep_prep_best_slice"] = f"""WITH {R}, a AS (SELECT image_id, roi, z, COUNT(*) n FROM r GROUP BY 1, 2, 3), b AS (SELECT image_id, roi, z FROM a QUALIFY ROW_NUMBER() OVER (PARTITION BY image_id, roi ORDER BY n DESC, z) = 1),
 s AS (SELECT *, MIN(v) {_OVER} lo, MAX(v) {_OVER} hi FROM r) SELECT image_id, roi, x, y, z, ROUND(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS value FROM s JOIN b USING (image_id, roi, z)"""
ORACLES["report_parse"] = """SELECT 'case_' || conv_id image_id, 'label_1_lesion_' || turn roi, ['INFO', 'WARNING', 'ERROR'][turn % 3 + 1] AS level,
 'failed on ROI ''label_1_lesion_' || turn || ''' again' message FROM conversations"""
ORACLES["nearest_slice_join"] = """WITH e AS (SELECT event_id, user_id, event_type, EPOCH_US(ts) / 1e6 pos FROM events), k AS (SELECT DISTINCT event_type FROM events),
 l AS (SELECT * FROM e WHERE event_type = (SELECT MIN(event_type) FROM k)),
 r AS (SELECT user_id, pos, MIN(event_id) event_id FROM e WHERE event_type = (SELECT event_type FROM k ORDER BY 1 LIMIT 1 OFFSET 1) GROUP BY 1, 2)
 SELECT l.event_id, r.event_id near_event_id, ROUND(ABS(l.pos - r.pos), 6) gap FROM l JOIN r ON l.user_id = r.user_id AND ABS(l.pos - r.pos) < 86400
 QUALIFY ROW_NUMBER() OVER (PARTITION BY l.event_id ORDER BY ABS(l.pos - r.pos), r.pos) = 1"""
