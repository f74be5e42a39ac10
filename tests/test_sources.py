"""Readers of image files against files written here byte by byte, preparation as one plan, and a whole run."""

import gzip
import io
import struct
import zlib

import numpy as np
import pytest

from voxlake.plans import batch, settings
from voxlake.sources import volumes

RNG = np.random.default_rng(2)


def nifti_bytes(a, spacing=(1.0, 1.0, 1.0), order="<", slope=0.0, shift=0.0, code=4, kind="i2"):
    head = bytearray(352)
    struct.pack_into(order + "i", head, 0, 348)
    struct.pack_into(order + "8h", head, 40, a.ndim, *a.shape, *[1] * (7 - a.ndim))
    struct.pack_into(order + "2h", head, 70, code, 8 * np.dtype(kind).itemsize)
    struct.pack_into(order + "8f", head, 76, 1.0, *spacing, *[0.0] * 4)
    struct.pack_into(order + "3f", head, 108, 352.0, slope, shift)
    head[344:348] = b"n+1\0"
    return bytes(head) + a.astype(np.dtype(kind).newbyteorder(order)).tobytes(order="F")


def dicom_bytes(rows, z, series=b"1.2.3", explicit=True):
    def element(group, number, vr, value):
        value += b"\0" * (len(value) % 2)
        if not explicit and group != 2:
            return struct.pack("<HHI", group, number, len(value)) + value
        if vr in volumes.LONG_VR:
            return struct.pack("<HH2sHI", group, number, vr, 0, len(value)) + value
        return struct.pack("<HH2sH", group, number, vr, len(value)) + value

    syntax = b"1.2.840.10008.1.2.1" if explicit else b"1.2.840.10008.1.2"
    short = lambda n: struct.pack("<H", n)
    body = element(2, 0x10, b"UI", syntax) + element(8, 0x60, b"CS", b"CT") + element(0x20, 0xE, b"UI", series) + element(0x20, 0x32, b"DS", b"0\\0\\%d" % z)
    body += element(0x28, 0x10, b"US", short(rows.shape[0])) + element(0x28, 0x11, b"US", short(rows.shape[1])) + element(0x28, 0x30, b"DS", b"0.5\\0.25")
    body += element(0x28, 0x100, b"US", short(16)) + element(0x28, 0x103, b"US", short(1)) + element(0x28, 0x1052, b"DS", b"-10") + element(0x28, 0x1053, b"DS", b"2")
    return b"\0" * 128 + b"DICM" + body + element(0x7FE0, 0x10, b"OW", rows.astype("<i2").tobytes())


def png_bytes(a):
    height, width = a.shape
    raw = b""
    for y in range(height):  # every filter in turn
        rule = y % 5
        line, above = a[y].astype(int), a[y - 1].astype(int) if y else np.zeros(width, int)
        left, corner = np.append(0, line[:-1]), np.append(0, above[:-1])
        p = left + above - corner
        paeth = [min((q, r, s), key=lambda v, t=t: abs(t - v)) for q, r, s, t in zip(left, above, corner, p, strict=True)]
        raw += bytes([rule]) + ((line - [0 * line, left, above, (left + above) // 2, np.array(paeth)][rule]) & 255).astype(np.uint8).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


A = RNG.integers(-50, 50, (4, 3, 2))


@pytest.mark.parametrize("data", [
    nifti_bytes(A), nifti_bytes(A, order=">"), gzip.compress(nifti_bytes(A)), nifti_bytes(A, code=16, kind="f4"),
])
def test_nifti(data):
    assert np.array_equal(volumes.nifti(data).values, A)


def test_nifti_scale_and_spacing():
    v = volumes.nifti(nifti_bytes(A, (0.5, 0.75, 3.0), slope=2.0, shift=-1.0))
    assert np.array_equal(v.values, A * 2.0 - 1) and v.spacing == (0.5, 0.75, 3.0)


@pytest.mark.parametrize("coding", ["raw", "gzip", "ascii"])
def test_nrrd(coding):
    body = A.astype("<i4").tobytes(order="F")
    body = {"raw": body, "gzip": gzip.compress(body), "ascii": " ".join(map(str, A.ravel(order="F"))).encode()}[coding]
    head = f"NRRD0004\n# comment\ntype: int\ndimension: 3\nsizes: 4 3 2\nencoding: {coding}\nendian: little\nspace directions: (2,0,0) (0,3,0) (0,0,4)\nspace origin: (1,2,3)\n\n"
    v = volumes.nrrd(head.encode() + body)
    assert np.array_equal(v.values, A) and v.spacing == (2, 3, 4) and v.origin == (1, 2, 3)


def test_npy_png_and_two_dimensions():
    out = io.BytesIO()
    np.save(out, A[:, :, 0])
    assert volumes.npy(out.getvalue()).values.shape == (4, 3, 1)
    a = RNG.integers(0, 256, (11, 7))
    assert np.array_equal(volumes.png(png_bytes(a)).values[:, :, 0], a.T)


@pytest.mark.parametrize("explicit", [True, False])
def test_dicom(explicit):
    rows = RNG.integers(-100, 100, (3, 4))
    v = volumes.dicom(dicom_bytes(rows, 7, explicit=explicit))
    assert np.array_equal(v.values[:, :, 0], rows.T * 2 - 10) and v.spacing == (0.25, 0.5, 1.0) and (v.more["series"], v.more["along"]) == ("1.2.3", 7.0)


def test_series_of_a_folder(spark, tmp_path):
    (tmp_path / "case").mkdir()
    slices = RNG.integers(0, 9, (3, 2, 2))
    for k, z in enumerate((5, 1, 3)):
        (tmp_path / "case" / f"s{k}.dcm").write_bytes(dicom_bytes(slices[k], z))
    (tmp_path / "case" / "other.dcm").write_bytes(dicom_bytes(slices[0], 0, b"9"))
    got = {(r.x, r.y, r.z): r.intensity for r in volumes.series_voxels(volumes.files(spark, str(tmp_path))).collect()}
    assert got == {(x, y, z): slices[k, y, x] * 2 - 10 for z, k in enumerate((1, 2, 0)) for x in range(2) for y in range(2)}


def test_broken_files_are_told_of(spark, tmp_path):
    (tmp_path / "a.nii").write_bytes(b"short")
    (tmp_path / "b.txt").write_bytes(b"words")
    (tmp_path / "c.npy").write_bytes(b"\x93NUMPY?")
    found = volumes.files(spark, str(tmp_path))
    assert all(r.error for r in volumes.headers(found).collect()) and volumes.headers(found).count() == 3 and volumes.voxels(found).count() == 0


def test_settings():
    assert settings.settings({"radiomics_BinSize": 8, "nonsense": 1}, dimensions="3d").BinSize == 8
    for wrong in ({"BinSize": 0}, {"DiscType": "x"}, {"categories": "x"}, {"isScale": 2}, {"isReSegRng": 1, "ReSegIntrvl01": None, "ReSegIntrvl02": None}):
        with pytest.raises(ValueError):
            settings.settings(wrong)
    assert settings.settings(DataType="CT").anchor() == -1000 and settings.settings(DataType="PET").anchor() == 0
    assert settings.settings(isReSegRng=1, ReSegIntrvl01=-5).anchor() == -5 and settings.settings().anchor() is None


def test_files_to_sheets(spark, tmp_path):
    images, masks = tmp_path / "images", tmp_path / "masks"
    images.mkdir(), masks.mkdir()
    for name, shape in (("p1", (8, 8, 4)), ("p2", (6, 7, 5))):
        a = RNG.integers(0, 100, shape)
        m = np.zeros(shape, int)
        m[1:5, 1:5, 1:4] = 1
        m[5, 5, 0] = 2
        (images / f"{name}.nii").write_bytes(nifti_bytes(a, (1.0, 1.0, 2.0)))
        (masks / f"{name}.nii").write_bytes(nifti_bytes(m, (1.0, 1.0, 2.0)))
    (images / "alone.npy").write_bytes(b"broken")
    out = str(tmp_path / "out")
    told = batch.process_batch(spark, str(images), str(masks), out, categories="diag,stat,ih", dimensions="1st", isScale=1, isotVoxSize=1, VoxInterp="linear", ROIInterp="linear", min_roi_volume=5, BinSize=10)
    assert told["error"] is None and told["success"] and told["processed_files"] == 2
    rows = {(r.PatientID, r.ROI): r for r in spark.read.parquet(out + "/features").collect()}
    assert set(rows) == {("p1", "label_1_lesion_1"), ("p2", "label_1_lesion_1")}
    r = rows["p1", "label_1_lesion_1"]
    assert (r.vox_dim_z_init_img, r.vox_dim_z_interp_img, r.img_dim_z_interp_img, r.int_mask_vox_count_init_roi) == (2.0, 1.0, 8, 48) and r.stat_min < r.stat_mean < r.stat_max
    assert spark.read.parquet(out + "/report").count() == 1 and spark.read.parquet(out + "/parameters").where("name = 'BinSize' AND value = '10'").count() == 1
    told = batch.process_batch(spark, str(images), str(masks), out, categories="stat", dimensions="1st", min_roi_volume=1, aggregation_lesion=True)
    assert told["error"] is None and spark.read.parquet(out + "/features").count() == 2
