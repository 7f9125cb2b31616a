"""Media columns: texts as baseline JPEG files in a binary column, and features read back from those files.

Nulls: a null text is an empty one. Empty texts give one MCU of spaces. Any other column of the input is ignored, also
one with a clashing name. Rows are treated one by one: repeated rows give repeated results, an empty table none.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import jpeg
from textloom.llm.common import table

MEDIA = "doc_id long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumbnail_hash string, feature string"
#: Bytes that are coded together.
TOGETHER = 3 << 20


def _grouped(column: pa.Array):
    """Index ranges of about TOGETHER bytes."""
    begin = size = 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        size += (n or 0) + 400
        if size > TOGETHER:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(column):
        yield begin, len(column)


def _store(batches):
    for b in batches:
        ids, texts = b.column(0), b.column(1).cast(pa.binary())
        for i, j in _grouped(texts):
            raw = [x or b"" for x in texts[i:j].to_pylist()]
            full = [x + b" " * (-len(x) % jpeg.MCU or (0 if x else jpeg.MCU)) for x in raw]
            yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(jpeg.encode(full, [len(x) for x in raw]), pa.binary())], ["doc_id", "media"])


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: which of 8 x 8 points of the thumbnail are above their mean; and the CRC of all its pixels."""
    h, w = pixels.shape
    grid = pixels[np.ix_(np.arange(8) * h // 8, np.arange(8) * w // 8)].ravel()
    return f"{int.from_bytes(np.packbits(grid > grid.mean()).tobytes()):016x}{zlib.crc32(pixels.tobytes()):08x}"


def _features(doc_id: int, media: bytes, picture: jpeg.Picture, coefficients: np.ndarray) -> tuple:
    full, n_bytes = jpeg.payload(picture, coefficients)
    pixels = jpeg.thumbnail(picture, coefficients)
    mark = thumbnail_hash(pixels)
    sha = hashlib.sha256(full).hexdigest()
    return doc_id, n_bytes, len(full), sha, zlib.crc32(full[-16:]), len(media), hashlib.sha256(media).hexdigest(), picture.width, picture.height, mark, f"{picture.width}x{picture.height}:{pixels.shape[1]}x{pixels.shape[0]}:{mark}"


def _read(batches):
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = [x.split()[0] for x in READ.split(", ")]
    for b in batches:
        for i, j in _grouped(b.column(1)):
            ids, files = b.column(0)[i:j].to_pylist(), b.column(1)[i:j].to_pylist()
            rows = [_features(d, f, *x) for d, f, x in zip(ids, files, jpeg.read(files), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def store_media(documents: DataFrame) -> DataFrame:
    """doc_id and the JPEG file that holds the text's UTF-8 bytes, filled with spaces to a positive multiple of 192."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store, MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """What the stored files say: payload digests, dimensions, the hash of the luminance thumbnail."""
    return media.select("doc_id", "media").mapInArrow(_read, READ)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_media(table(spark, sf_dir, "documents")))
