"""Names of all feature columns, and the selection by category and dimension."""

from __future__ import annotations

from voxlake.operators.firstorder import IH, IVH, STAT
from voxlake.operators.texture import GLCM, MODES3, MODES6, NAMES, NGTDM

MORPH = (
    "volume_mesh", "volume_count", "surface_area", "sv_ratio", "compactness1", "compactness2", "spherical_disproportion", "sphericity", "asphericity",
    "com_shift", "max_3d_diameter", "major_axis_length", "minor_axis_length", "least_axis_length", "elongation", "flatness", "volume_density_aabb",
    "area_density_aabb", "volume_density_ombb", "area_density_ombb", "volume_density_aee", "area_density_aee", "volume_density_mvee",
    "area_density_mvee", "solidity", "area_density_convex_hull", "integrated_intensity", "moran_i", "geary_c",
)


def _diagnostics() -> tuple[str, ...]:
    out = []
    for tag in ("init", "interp"):
        out += [f"{kind}_dim_{a}_{tag}_img" for kind in ("img", "vox") for a in "xyz"] + [f"{n}_int_{tag}_img" for n in ("mean", "min", "max")]
    for tag in ("init", "interp", "reseg"):
        out += [f"int_mask_dim_{a}_{tag}_roi" for a in "xyz"] + [f"{m}_mask_bb_dim_{a}_{tag}_roi" for m in ("int", "morph") for a in "xyz"]
        out += [f"{m}_mask_vox_count_{tag}_roi" for m in ("int", "morph")] + [f"int_mask_{n}_int_{tag}_roi" for n in ("mean", "min", "max")]
    return tuple(out)


#: category: (dimension: columns)
FAMILIES: dict[str, dict[str, tuple[str, ...]]] = {
    "diag": {"": _diagnostics()},
    "morph": {"1st": tuple(f"morph_{m}" for m in MORPH)},
    "ip": {"1st": ("loc_peak_loc", "loc_peak_glob")},
    "stat": {"1st": tuple(f"stat_{m}" for m in STAT)},
    "ih": {"1st": tuple(f"ih_{m}" for m in IH)},
    "ivh": {"1st": tuple(f"ivh_{m}" for m in IVH)},
}
DIMENSIONS = ("1st", "2d", "2_5d", "3d")
for _category, _prefix, _metrics, _modes in (
    ("glcm", "glcm", GLCM, MODES6), ("glrlm", "glrlm", NAMES["glrlm"], MODES6), ("glszm", "szm", NAMES["szm"], MODES3),
    ("gldzm", "dzm", NAMES["dzm"], MODES3), ("ngtdm", "ngtdm", NGTDM, MODES3), ("ngldm", "ngl", NAMES["ngl"], MODES3),
):
    FAMILIES[_category] = {
        dim: tuple(f"{_prefix}_{m}_{mode}" for m in _metrics for mode in _modes if mode.removesuffix("_avg").removesuffix("_comb").lower() == dim)
        for dim in DIMENSIONS[1:]
    }
FAMILIES["mi"] = {"": tuple(f"moment_{k}_{f}" for f in ("intensity", "shape") for k in ("i1", "f2", "i2", "i3", "f3"))}
CATEGORIES = tuple(FAMILIES)


def parse(text: str, allowed: tuple[str, ...], what: str) -> tuple[str, ...]:
    names = [t.strip().lower() for t in text.split(",") if t.strip()]
    if "all" in names:
        return allowed
    if wrong := [n for n in names if n not in allowed]:
        raise ValueError(f"unknown {what}: {', '.join(wrong)}; known: {', '.join(allowed)}, all")
    return tuple(n for n in allowed if n in names)


def select_columns(categories: str = "all", dimensions: str = "all") -> list[str]:
    """Feature columns of the selected categories and dimensions; diagnostics and moments have no dimension."""
    dims = {"", *parse(dimensions, DIMENSIONS, "dimension")}
    return [c for cat in parse(categories, CATEGORIES, "category") for dim, cols in FAMILIES[cat].items() if dim in dims for c in cols]
