"""Image and mask files as relations of voxels: NIfTI, NRRD, NPY, PNG and uncompressed DICOM, by public header layouts.

Files are listed and read by Spark (`binaryFile`), so any store it reaches will do; a file is parsed in the task that holds it
and leaves it slice by slice. Files of an unknown kind, and ones that can't be parsed, give no voxels and a header row with the
reason. Axes are x, y, z: the first index of a voxel is its column.
"""

from __future__ import annotations

import gzip
import io
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxlake.operators import pairing

#: Fixed values of the file formats: NIfTI data types, NRRD type names.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
NRRD_TYPES = {
    "signed char": "i1", "int8": "i1", "int8_t": "i1", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "uint8_t": "u1", "short": "i2", "int16": "i2", "int16_t": "i2",
    "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "uint16_t": "u2", "int": "i4", "int32": "i4", "int32_t": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4",
    "uint32_t": "u4", "longlong": "i8", "int64": "i8", "int64_t": "i8", "ulonglong": "u8", "uint64": "u8", "uint64_t": "u8", "float": "f4", "double": "f8",
}


@dataclass
class Volume:
    """Values indexed [x, y, z], and where they lie."""

    values: np.ndarray
    format: str
    spacing: tuple[float, ...] = (1.0, 1.0, 1.0)
    origin: tuple[float, ...] = (0.0, 0.0, 0.0)
    direction: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    more: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.values.ndim == 2:
            self.values = self.values[:, :, None]
        while self.values.ndim > 3 and self.values.shape[-1] == 1:
            self.values = self.values[..., 0]
        if self.values.ndim != 3:
            raise ValueError(f"a volume has 3 dimensions, not {self.values.ndim}")


def nifti(data: bytes) -> Volume:
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if struct.unpack_from(order + "i", data)[0] != 348:
        raise ValueError("no NIfTI-1 header")
    dims = struct.unpack_from(order + "8h", data, 40)
    kind = NIFTI_TYPES.get(struct.unpack_from(order + "h", data, 70)[0])
    if kind is None:
        raise ValueError("unknown NIfTI data type")
    zooms = struct.unpack_from(order + "8f", data, 76)
    offset, slope, shift = struct.unpack_from(order + "3f", data, 108)
    shape = [max(1, n) for n in dims[1 : dims[0] + 1]]
    values = np.frombuffer(data, np.dtype(kind).newbyteorder(order), int(np.prod(shape)), int(offset)).reshape(shape, order="F")
    if slope and (slope, shift) != (1, 0):
        values = values * slope + shift
    sform = struct.unpack_from(order + "12f", data, 280)
    origin = (sform[3], sform[7], sform[11]) if struct.unpack_from(order + "h", data, 254)[0] > 0 else struct.unpack_from(order + "3f", data, 268)
    # The format's first two axes point to the other side than the patient axes that other formats use.
    return Volume(values, "nifti", tuple(map(float, zooms[1:4])), (-origin[0], -origin[1], origin[2]))


def nrrd(data: bytes) -> Volume:
    head, _, body = data.partition(b"\n\n")
    lines = head.decode("ascii", "replace").replace("\r", "").split("\n")
    if not lines[0].startswith("NRRD"):
        raise ValueError("no NRRD header")
    fields = {m[1].strip().lower(): m[2].strip() for x in lines[1:] if not x.startswith("#") and (m := re.match(r"([^:]+):=?\s*(.*)", x))}
    if "data file" in fields or "datafile" in fields:
        raise ValueError("detached NRRD data is in another file")
    coding = fields.get("encoding", "raw").lower()
    shape = [int(x) for x in fields["sizes"].split()]
    kind = np.dtype(NRRD_TYPES[fields["type"].lower()]).newbyteorder(">" if fields.get("endian", "little").lower() == "big" else "<")
    if coding in ("ascii", "text", "txt"):
        values = np.array(body.split(), float).astype(kind)
    elif coding in ("raw", "gzip", "gz"):
        values = np.frombuffer(gzip.decompress(body) if coding != "raw" else body, kind, int(np.prod(shape)))
    else:
        raise ValueError(f"unknown NRRD encoding {coding}")
    vectors = [[float(c) for c in v.split(",")] for v in re.findall(r"\(([^)]*)\)", fields.get("space directions", ""))]
    spacing = [float(np.linalg.norm(v)) for v in vectors] or [float(x) for x in fields.get("spacings", "1 1 1").split()]
    origin = [float(c) for c in re.sub(r"[()]", "", fields.get("space origin", "0,0,0")).split(",")]
    direction = np.array([np.array(v) / s for v, s in zip(vectors, spacing, strict=True)]).T.ravel().tolist() if len(vectors) == 3 else list(Volume.direction)
    return Volume(values.reshape(shape, order="F"), "nrrd", tuple((*spacing, 1.0, 1.0)[:3]), tuple(origin), tuple(direction))


def npy(data: bytes) -> Volume:
    return Volume(np.load(io.BytesIO(data), allow_pickle=False), "npy")


def png(data: bytes) -> Volume:
    """Grey levels of an image of 8 or 16 bits a sample, not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG signature")
    at, packed, palette = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += part
        at += 12 + n
    if interlace or depth not in (8, 16):
        raise ValueError("interlaced or packed PNG samples")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    rows, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.int64)
    for y in range(height):
        rule, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if rule == 1:
            line = np.cumsum(line.reshape(width, step), axis=0).ravel()
        elif rule == 2:
            line = line + above
        elif rule in (3, 4):
            for k in range(len(line)):
                left, up = (line[k - step] if k >= step else 0), above[k]
                if rule == 3:
                    guess = (left + up) // 2
                else:
                    corner = above[k - step] if k >= step else 0
                    guess = min((left, up, corner), key=lambda v, p=left + up - corner: abs(p - v))
                line[k] = (line[k] + guess) & 255
        above = line & 255
        rows[y] = above
    samples = rows.view(">u2") if depth == 16 else rows
    pixels = samples.reshape(height, width, channels).astype(float)
    if colour == 3:
        pixels = palette[rows.reshape(height, width)].astype(float)
    grey = pixels[..., 0] if pixels.shape[2] < 3 else np.rint(pixels[..., :3] @ [0.299, 0.587, 0.114])
    return Volume(grey.T, "raster")


#: Fixed values of the DICOM standard: explicit value representations with a four-byte length, and the tags that are read.
LONG_VR = frozenset({b"OB", b"OD", b"OF", b"OL", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT"})
TAGS = {
    (0x0002, 0x0010): "syntax", (0x0008, 0x0060): "modality", (0x0020, 0x000E): "series", (0x0020, 0x0032): "position", (0x0020, 0x0037): "orientation",
    (0x0020, 0x0013): "instance", (0x0018, 0x0050): "thickness", (0x0028, 0x0010): "rows", (0x0028, 0x0011): "columns", (0x0028, 0x0030): "pixel_spacing",
    (0x0028, 0x0100): "bits", (0x0028, 0x0103): "signed", (0x0028, 0x0008): "frames", (0x0028, 0x1052): "intercept", (0x0028, 0x1053): "slope", (0x7FE0, 0x0010): "pixels",
}


def dicom_fields(data: bytes) -> dict[str, bytes]:
    """The raw values of the tags above in a little-endian file; sequences are skipped."""
    at = 132 if data[128:132] == b"DICM" else 0
    out: dict[str, bytes] = {}
    explicit = True
    while at + 8 <= len(data):
        group, element = struct.unpack_from("<HH", data, at)
        if group != 2 and "syntax" in out:
            explicit = out["syntax"].strip(b"\0 ") != b"1.2.840.10008.1.2"
        elif not out and at == 0:
            explicit = data[4:6].isalpha()
        if group == 0xFFFE:
            at += 8
            continue
        if explicit or group == 2:
            vr = data[at + 4 : at + 6]
            size, start = (struct.unpack_from("<I", data, at + 8)[0], at + 12) if vr in LONG_VR else (struct.unpack_from("<H", data, at + 6)[0], at + 8)
        else:
            vr, (size,), start = b"", struct.unpack_from("<I", data, at + 4), at + 8
        if size == 0xFFFFFFFF:
            if (group, element) == (0x7FE0, 0x0010):
                raise ValueError("compressed DICOM pixels")
            at = start  # a sequence of undefined length: its items are walked through
            continue
        if name := TAGS.get((group, element)):
            out.setdefault(name, data[start : start + size])
        at = start + size
    return out


def dicom(data: bytes) -> Volume:
    f = dicom_fields(data)
    if "pixels" not in f:
        raise ValueError("no DICOM pixels")
    number = lambda k, d=0: struct.unpack("<H", f[k][:2])[0] if k in f else d
    reals = lambda k, d: tuple(float(x) for x in f[k].decode("ascii").strip("\0 ").split("\\")) if f.get(k, b"").strip(b"\0 ") else d
    kind = ("i" if number("signed") else "u") + str(number("bits", 16) // 8)
    frames = int(reals("frames", (1.0,))[0])
    values = np.frombuffer(f["pixels"], "<" + kind, frames * number("rows") * number("columns")).reshape(frames, number("rows"), number("columns"))
    values = values.astype(np.float64) * reals("slope", (1.0,))[0] + reals("intercept", (0.0,))[0]
    side = reals("pixel_spacing", (1.0, 1.0))
    axes = np.array(reals("orientation", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))).reshape(2, 3)
    normal, origin = np.cross(*axes), reals("position", (0.0, 0.0, 0.0))
    text = lambda k: f.get(k, b"").decode("ascii", "replace").strip("\0 ")
    more = {"series": text("series"), "modality": text("modality"), "along": float(normal @ origin), "instance": int(reals("instance", (0.0,))[0])}
    return Volume(values.transpose(2, 1, 0), "dicom", (side[1], side[0], reals("thickness", (1.0,))[0]), origin, tuple(np.stack([*axes, normal]).T.ravel().tolist()), more)


READERS = {"nifti": nifti, "nrrd": nrrd, "npy": npy, "raster": png, "dicom": dicom}
HEADER = (
    "path string, image_id string, format string, shape array<int>, spacing array<double>, origin array<double>, direction array<double>, "
    "series string, modality string, along double, error string"
)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, kind): files under a path, folders within it too; the kind by extension, else by the first bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content", F.coalesce(pairing.format_of(F.col("path")), pairing.format_by_content(F.col("content"))).alias("kind"))


def headers(found: DataFrame) -> DataFrame:
    """A row for each file: its geometry, or the reason why it can't be read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, name, kind, content in zip(pdf.path, pdf.image_id, pdf.kind, pdf.content, strict=True):
                try:
                    v = READERS[kind](bytes(content))
                    rows.append((path, name, kind, list(v.values.shape), list(v.spacing), list(v.origin), list(v.direction), v.more.get("series"), v.more.get("modality"), v.more.get("along"), None))
                except Exception as e:  # noqa: BLE001  a file of any content is told of, not fatal
                    rows.append((path, name, kind, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER.split(", ")])

    return found.select("path", pairing.stem(F.col("path")).alias("image_id"), "kind", "content").mapInPandas(read, HEADER)


def voxels(found: DataFrame, zero: bool = True) -> DataFrame:
    """(path, image_id, x, y, z, intensity) of all files that can be read, without zeros if so asked."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, name, kind, content in zip(pdf.path, pdf.image_id, pdf.kind, pdf.content, strict=True):
                try:
                    values = READERS[kind](bytes(content)).values
                except Exception:  # noqa: BLE001, S112  `headers` tells of it
                    continue
                for z in range(values.shape[2]):
                    x, y = np.indices(values.shape[:2]).reshape(2, -1) if zero else np.nonzero(values[:, :, z])
                    yield pd.DataFrame({"path": path, "image_id": name, "x": x.astype(np.int32), "y": y.astype(np.int32), "z": np.int32(z), "intensity": values[x, y, z].astype(np.float32).astype(float)})

    rows = found.select("path", pairing.stem(F.col("path")).alias("image_id"), "kind", "content").mapInPandas(read, "path string, image_id string, x int, y int, z int, intensity double")
    return rows.withColumn("intensity", F.nullif("intensity", F.lit(float("nan"))))


def series_voxels(found: DataFrame) -> DataFrame:
    """(image_id, x, y, z, intensity): each folder's DICOM series with the most slices, stacked along its normal; image_id is the folder."""
    slices = headers(found.where("kind = 'dicom'")).where("error IS NULL").withColumn("dir", F.regexp_replace("path", r"[/\\][^/\\]+$", ""))
    largest = pairing.largest_series(slices.select("dir", F.col("series").alias("series_id"))).select("dir", F.col("series_id").alias("series"))
    kept = slices.join(largest, ["dir", "series"]).withColumn("slice", F.row_number().over(Window.partitionBy("dir").orderBy("along", "path")) - 1)
    inside = voxels(found.where("kind = 'dicom'")).join(kept.select("path", "dir", "slice"), "path")
    return inside.select(pairing.base_name(F.col("dir")).alias("image_id"), "x", "y", F.col("slice").cast("int").alias("z"), "intensity")


def masks(found: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, x, y, z, label): labels other than 0, halves to even. `images` are headers of the images; a mask whose shape is
    the image's in reverse is turned round. Masks are told by the stem of their name."""
    shapes = headers(found).select("path", F.col("shape").alias("own"))
    rows = voxels(found, zero=False).join(shapes, "path").join(images.where("error IS NULL").select("image_id", "shape"), "image_id")
    turned = (F.col("own") != F.col("shape")) & (F.reverse("own") == F.col("shape"))
    x, z = F.when(turned, F.col("z")).otherwise(F.col("x")), F.when(turned, F.col("x")).otherwise(F.col("z"))
    return rows.select("image_id", x.alias("x"), "y", z.alias("z"), F.rint("intensity").cast("int").alias("label")).where("label <> 0")
