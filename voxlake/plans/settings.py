"""Parameters of a run: names and defaults (fixed values), checks of their ranges, and overrides from a JSON file or mapping."""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace

from voxlake.plans.registry import CATEGORIES, DIMENSIONS, parse

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    DataType: str = "OTHER"
    DiscType: str = "FBS"
    BinSize: float = 25
    isScale: int = 0
    VoxInterp: str = "Nearest"
    ROIInterp: str = "Nearest"
    isotVoxSize: float = 2
    isotVoxSize2D: float = 2
    isIsot2D: int = 0
    isGLround: int = 0
    isReSegRng: int = 0
    isOutliers: int = 0
    isQuntzStat: int = 1
    ReSegIntrvl01: float | None = -1000
    ReSegIntrvl02: float | None = 400
    ROI_PV: float = 0.5
    qntz: str = "Uniform"
    IVH_Type: int = 3
    IVH_DiscCont: int = 1
    IVH_binSize: float = 2
    roi_num: int = 10
    roi_selection_mode: str = "per_img"
    feature_value_mode: str = "REAL_VALUE"
    categories: str = "diag,morph,glcm,glrlm,glszm,ngtdm,ngldm"
    dimensions: str = "1st,2d"
    report: str = "all"
    min_roi_volume: int = 10
    apply_preprocessing: bool = False
    aggregation_lesion: bool = False
    extraction_mode: str = "handcrafted_feature"

    def __post_init__(self):
        one_of = {
            "DiscType": ("FBS", "FBN"), "VoxInterp": ("Nearest", "linear", "cubic"), "ROIInterp": ("Nearest", "linear", "cubic"), "qntz": ("Uniform", "Lloyd"),
            "roi_selection_mode": ("per_img", "per_region"), "feature_value_mode": ("REAL_VALUE", "APPROXIMATE_VALUE"), "report": ("all", "info", "warning", "error", "none"),
            "extraction_mode": ("handcrafted_feature",),
        }
        for name, allowed in one_of.items():
            if str(getattr(self, name)).lower() not in [a.lower() for a in allowed]:
                raise ValueError(f"{name} is {getattr(self, name)!r}; known: {', '.join(allowed)}")
        for name, low, high in (("BinSize", 1, 1000), ("min_roi_volume", 1, 1_000_000), ("roi_num", 1, 1000), ("ROI_PV", 0, 1)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} is {getattr(self, name)!r}; it lies between {low} and {high}")
        for name in ("isScale", "isIsot2D", "isGLround", "isReSegRng", "isOutliers", "isQuntzStat"):
            if getattr(self, name) not in (0, 1):
                raise ValueError(f"{name} is {getattr(self, name)!r}; it is 0 or 1")
        if min(self.isotVoxSize, self.isotVoxSize2D, self.IVH_binSize) <= 0:
            raise ValueError("voxel and bin sizes are above 0")
        if self.isReSegRng and self.ReSegIntrvl01 is None and self.ReSegIntrvl02 is None:
            raise ValueError("re-segmentation needs a lower or an upper bound")
        parse(self.categories, CATEGORIES, "category")
        parse(self.dimensions, DIMENSIONS, "dimension")

    def anchor(self) -> float | None:
        """Where bins of fixed size begin: the range's lower bound, else the modality's fixed value, else each region's minimum.

        Fixed bins of arbitrary units without a range are not comparable between images; that is logged."""
        if self.isReSegRng and self.ReSegIntrvl01 is not None:
            return float(self.ReSegIntrvl01)
        kind = self.DataType.upper()
        if kind.startswith("CT"):
            return -1000.0
        if kind.startswith("PET"):
            return 0.0
        log.warning("fixed bins of arbitrary units begin at each region's minimum; set a re-segmentation range or use FBN")
        return None


def settings(overrides: Mapping | str | None = None, **more) -> Settings:
    """Defaults with overrides by name, with or without the prefix radiomics_, from a mapping or a JSON file; unknown names are
    logged and left out."""
    if isinstance(overrides, str):
        with open(overrides, encoding="utf-8") as f:
            overrides = json.load(f)
    known = {f.name for f in fields(Settings)}
    chosen = {}
    for key, value in {**(overrides or {}), **more}.items():
        name = key.removeprefix("radiomics_")
        if name in known:
            chosen[name] = value
        else:
            log.warning("unknown parameter %s", key)
    return replace(Settings(), **chosen)


def rows(s: Settings) -> list[tuple[str, str]]:
    """(name, value) of every parameter, for the parameter sheet."""
    return [(name, str(value)) for name, value in asdict(s).items()]
