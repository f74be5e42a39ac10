"""Operator 6: media columns as progressive JPEG.

`store` writes a byte payload losslessly into the quantised coefficients of a progressive JPEG (the unit of that format: the
transform and its rounding come after them), with spectral selection and successive approximation. `read` accumulates the
scans of the stored bytes into coefficient arrays, takes the payload back from these, and transforms them into the
full-resolution RGB tensor. The registered query keeps figures of the tensor; `tensors` returns it.

A null text is an empty one; an empty payload is one unit of 576 bytes 255. Equal texts give equal rows, since all arithmetic
is in exact integers. Repeated rows each give a row, an empty table gives an empty result. Only doc_id and text are read, so
other columns never clash. Media are written to the shared folder and read back.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from voxlake.llm import jpeg
from voxlake.llm.common import bounded, stored, text_bytes

UNIT = 576


def payload(data: bytes) -> bytes:
    return data + b"\xff" * (UNIT if not data else -len(data) % UNIT)


def to_media(data: bytes) -> bytes:
    full = payload(data)
    return jpeg.encode(np.frombuffer(full, np.uint8), len(full).to_bytes(8, "big"))


def from_media(media: bytes) -> tuple[bytes, np.ndarray]:
    image = jpeg.read_coefficients(media)
    n = int.from_bytes(image["comment"], "big")
    return jpeg.units(image)[:n].tobytes(), jpeg.rgb(image)


def feature(tensor: np.ndarray) -> str:
    """Size, channel sums and checksum of an RGB tensor."""
    h, w, _ = tensor.shape
    r, g, b = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{h}x{w} r={r} g={g} b={b} crc={zlib.crc32(tensor.tobytes()):08x}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media), in the shared folder."""

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                data = [text_bytes(t) for t in pdf.text[a : a + 500]]
                yield pd.DataFrame({"doc_id": pdf.doc_id[a : a + 500].array, "n_bytes": [len(d) for d in data], "media": [to_media(d) for d in data]})

    bounded(docs.sparkSession)
    return stored(docs.select("doc_id", "text").mapInPandas(encoded, "doc_id long, n_bytes long, media binary"), "media")


def read(media: DataFrame) -> DataFrame:
    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, n, m in zip(pdf.doc_id, pdf.n_bytes, pdf.media, strict=True):
                data, tensor = from_media(bytes(m))
                out.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(tensor)))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInPandas(
        decoded, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def tensors(media: DataFrame) -> DataFrame:
    """(doc_id, height, width, rgb): full-resolution tensors, three bytes a pixel, row by row."""

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, m in zip(pdf.doc_id, pdf.media, strict=True):
                tensor = from_media(bytes(m))[1]
                yield pd.DataFrame({"doc_id": [doc], "height": tensor.shape[0], "width": tensor.shape[1], "rgb": [tensor.tobytes()]})

    return media.mapInPandas(decoded, "doc_id long, height int, width int, rgb binary")
