"""Texts as progressive JPEG files, and such files as RGB tensors.

A text's UTF-8 bytes, filled with spaces to a positive multiple of 192, are quantised coefficients: byte b
is the coefficient 256 + b, 64 to a block in zigzag order, so each 384 bytes are the four luma blocks and
the two chroma blocks of one 16 x 16 group.  Quantisers are 1, hence nothing is lost; the format's unit is
the coefficient.  A nearly square frame is filled up with spaces, and a comment holds the payload's length.

``to_media`` makes the files, ``from_media`` reads such progressive 4:2:0 or 4:4:4 files back: scans add up
in coefficient arrays, an inverse transform in numpy gives planes, chroma is brought to full resolution,
and the RGB tensor is stored as bytes with its shape.  Both work row by row; rows never meet.

Defined cases: null and empty texts are 192 spaces; equal texts give equal files; a null id or repeated row
is converted like any other; other columns are not read.  ``from_media`` gives no pixels for a null file, and
nulls for bytes that are no such file (``jpeg.decode`` lists what it does not read).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwise.llm import jpeg
from poolwise.llm.staging import ship

UNIT, GROUP, OFFSET = 192, 384, 256


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the bytes that are stored."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def to_file(payload: bytes) -> bytes:
    groups = -(-len(payload) // GROUP)
    wide = int(np.ceil(np.sqrt(groups)))
    high = -(-groups // wide)
    cells = np.frombuffer(payload.ljust(wide * high * GROUP, b" "), np.uint8).astype(np.int16).reshape(high, wide, 6, 64) + OFFSET
    luma = cells[:, :, :4].reshape(high, wide, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    coefs = [np.ascontiguousarray(luma), cells[:, :, 4].reshape(-1, 64), cells[:, :, 5].reshape(-1, 64)]
    return jpeg.encode(coefs, wide, high, comment=b"payload=%d" % len(payload))


def from_coefficients(coefs: list[np.ndarray], frame: dict) -> bytes:
    """The payload of a file of ``to_file``."""
    wide, high = frame["wide"], frame["high"]
    cells = np.empty((high, wide, 6, 64), np.int16)
    cells[:, :, :4] = coefs[0].reshape(high, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(high, wide, 4, 64)
    cells[:, :, 4], cells[:, :, 5] = (c.reshape(high, wide, 64) for c in coefs[1:])
    return (cells - OFFSET).astype(np.uint8).tobytes()[: int(frame["comment"].removeprefix(b"payload="))]


def feature(pixels: np.ndarray, coefs: list[np.ndarray]) -> str:
    """Size, mean of each colour in hundredths, an eight-part histogram of green, and sums of low and high coefficients."""
    means = (pixels.reshape(-1, 3).sum(0, dtype=np.int64) * 100 // (pixels.size // 3)).tolist()
    parts = np.bincount(pixels[..., 1].ravel() >> 5, minlength=8).tolist()
    low, high = (sum(int(c[:, s].sum(dtype=np.int64)) for c in coefs) for s in (slice(0, 6), slice(6, 64)))
    return f"{pixels.shape[0]}x{pixels.shape[1]};rgb={','.join(map(str, means))};hist={','.join(map(str, parts))};low={low};high={high}"


def _to_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            made = [(n, to_file(p)) for n, p in (payload_of(t.as_py()) for t in part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], ["id", "n_bytes", "media"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes`` of the text, and ``media``, the file."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_to_media, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                pixels = jpeg.rgb(*jpeg.decode(data)) if data is not None else np.zeros((0, 0, 3), np.uint8)
                height, width, rgb = *pixels.shape[:2], pixels.tobytes()
            except ValueError:
                height = width = rgb = None
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([height], pa.int32()), pa.array([width], pa.int32()), pa.array([rgb], pa.binary())], ["id", "height", "width", "rgb"])


def from_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per input row: id, ``height``, ``width`` and ``rgb`` (rows of three bytes a pixel); null where the file is not read."""
    ship(media.sparkSession)
    return media.select(F.col(id_col).cast("long").alias("id"), media_col).mapInArrow(_tensors, "id long, height int, width int, rgb binary").withColumnRenamed("id", id_col)


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            coefs, frame = jpeg.decode(data)
            back = from_coefficients(coefs, frame)
            rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(jpeg.rgb(coefs, frame), coefs)))
        names = [x.split()[0] for x in _DIGEST.split(", ")]
        kinds = [pa.int64() if x.endswith("long") else pa.string() for x in _DIGEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names)


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")).mapInArrow(_digest, _DIGEST)
