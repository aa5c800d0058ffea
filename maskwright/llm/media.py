"""Media columns: texts as lossless WebP images, and images as pixel arrays.

``stored`` turns each text's UTF-8 bytes, padded with zero bytes to a positive
multiple of 64, into an image with a byte a pixel, or two; ``read_back`` decodes media
and computes features of the pixels; ``pixel_arrays`` decodes any lossless WebP column.
Rows are independent: there is no shuffle, and a task holds a batch of rows.

Images are written with prefix codes fitted to their pixels, and by their bytes alone:

* of at most 16 values: a palette, which puts several pixels into one;
* of which half or more equal the byte before or the byte a row above: that predictor;
* long and without long repeats: two bytes a pixel, and a colour cache that pairs which
  occur again are read from;
* all others: one byte a pixel.

All but the third have back-references for stretches that occur again, the last from
4 kB on. Reading takes
the general decoder. Cross-colour never shortens images of one or two channels, so it
is for images that others made.

A null or empty text is 64 zero bytes. Media that are null, damaged or not lossless WebP
give null pixels and features rather than an error. A text may have up to 2**28 bytes.
Repeated rows give equal values. Columns other than those named are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import webp
from maskwright.llm.common import documents_of

BLOCK = 64
#: The chunk that holds the payload's length where the last row is padded.
LENGTH_CHUNK = b"PLEN"
#: The chunk that says that a pixel is two bytes.
PAIRS_CHUNK = b"PAIR"
#: Bytes from which pairs of bytes are tried, and bits of their colour cache.
PAIRS_FROM, PAIR_CACHE = 1 << 14, 10
#: Bytes from which what occurs again is worth the distances' code.
COPIES_FROM = 1 << 12
_OPAQUE = np.uint32(0xFF000000)


def options_of(data: np.ndarray) -> tuple[webp.Options, int]:
    """How to write these bytes, and how many of them are a pixel."""
    if np.count_nonzero(np.bincount(data, minlength=256)) <= 16:
        return webp.Options(palette=True, copies=True), 1
    for mode, back in ((2, BLOCK), (1, 1)):
        if 2 * np.count_nonzero(data[back:] == data[:-back]) >= len(data):
            return webp.Options(predictor=mode, copies=True), 1
    if len(data) >= PAIRS_FROM and sum(x[1] for x in webp.found_copies(data[: PAIRS_FROM].astype(np.uint32))) < PAIRS_FROM // 16:
        return webp.Options(cache_bits=PAIR_CACHE), 2
    return webp.Options(copies=len(data) >= COPIES_FROM), 1


def media_of(payload: bytes) -> bytes:
    """A WebP file of a payload of a positive multiple of 64 bytes."""
    data = np.frombuffer(payload, np.uint8)
    options, each = options_of(data)
    width = BLOCK // each * -(-len(data) // (BLOCK * webp.LONGEST_SIDE))
    height = -(-len(data) // (each * width))
    pixels = np.zeros((height * width, each), np.uint32)
    pixels.reshape(-1)[: len(data)] = data
    # the last byte of a pixel is its green, the one before its red
    argb = _OPAQUE | pixels[:, -1] << np.uint32(8)
    if each == 2:
        argb |= pixels[:, 0] << np.uint32(16)
    file = webp.encode(argb.reshape(height, width), options)
    if each * width * height != len(data):
        file = webp.with_chunk(file, LENGTH_CHUNK, len(data).to_bytes(8, "little"))
    return file if each == 1 else webp.with_chunk(file, PAIRS_CHUNK, b"")


def payload_of(file: bytes, pixels: np.ndarray) -> bytes:
    chunks = dict(webp.chunks(file))
    flat = pixels.reshape(-1)
    data = (flat >> np.uint32(8)).astype(np.uint8)
    if PAIRS_CHUNK in chunks:
        data = np.stack([(flat >> np.uint32(16)).astype(np.uint8), data], axis=1).reshape(-1)
    length = int.from_bytes(chunks[LENGTH_CHUNK], "little") if LENGTH_CHUNK in chunks else len(data)
    return data[:length].tobytes()


def feature(pixels: np.ndarray) -> str:
    """Size, mean of each channel, and a 64-bit difference hash of the mean samples.

    The hash compares neighbours among 72 equal runs of the image, 9 in a row.
    """
    samples = np.ascontiguousarray(pixels).view(np.uint8).reshape(-1, 4)
    means = samples.mean(axis=0)
    light = samples.sum(axis=1, dtype=np.int64)
    sums = np.concatenate([[0], np.cumsum(light)])
    edges = np.arange(73) * len(light) // 72
    ends = np.maximum(edges[1:], edges[:-1] + 1)
    runs = ((sums[np.minimum(ends, len(light))] - sums[np.minimum(edges[:-1], len(light) - 1)]) / (ends - edges[:-1])).reshape(8, 9)
    bits = (runs[:, 1:] > runs[:, :-1]).ravel()
    height, width = pixels.shape
    return f"{width}x{height};" + ",".join(f"{m:.2f}" for m in means) + f";{int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, media = [], []
        for text in batch.column(1).cast(pa.large_binary()):
            data = text.as_py() or b""
            sizes.append(len(data))
            media.append(media_of(data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0")))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded bytes as a WebP file."""
    docs = documents_of(docs, id_col, text_col)
    return docs.mapInArrow(_stored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def _decoded(file: bytes | None) -> np.ndarray | None:
    try:
        return webp.decode(file) if file is not None else None
    except ValueError:
        return None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for cell in batch.column(2):
            file = cell.as_py()
            pixels = _decoded(file)
            if pixels is None:
                rows.append((None,) * 6)
                continue
            payload = payload_of(file, pixels)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(file), hashlib.sha256(file).hexdigest(), feature(pixels)))
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read_back(media: DataFrame) -> DataFrame:
    """Digests and features of the stored form of ``stored``'s rows, decoded."""
    id_type = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, schema)


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, cell in zip(batch.column(0), batch.column(1), strict=True):
            pixels = _decoded(cell.as_py())
            shape = (None, None) if pixels is None else pixels.shape
            flat = None if pixels is None else pixels.ravel().view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key.as_py()], batch.column(0).type), pa.array([shape[1]], pa.int32()), pa.array([shape[0]], pa.int32()), pa.array([flat], pa.list_(pa.int32()))],
                names=["id", "width", "height", "argb"],
            )


def pixel_arrays(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, width, height, argb): the pixels of each lossless WebP file, by rows."""
    source = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return source.mapInArrow(_pixels, f"id {source.schema['id'].dataType.simpleString()}, width int, height int, argb array<int>")
