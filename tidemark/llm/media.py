"""Media columns (operator 4): texts stored as progressive JPEG files and read back as tensors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import progressive_jpeg as jpeg

UNIT = 576
#: Images are inverse-transformed together up to about so many coefficients.
TOGETHER = 1 << 19
#: Texts that are stored in one Arrow batch.
ROWS = 256


def padded(text: bytes) -> bytes:
    """The bytes, then 255 up to a positive multiple of ``UNIT``."""
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def feature(tensor: np.ndarray) -> str:
    """Size, each channel's mean in thousandths, and its share of saturated pixels in thousandths."""
    h, w, _ = tensor.shape
    means = tensor.sum(axis=(0, 1), dtype=np.int64) * 1000 // (h * w)
    full = ((tensor == 0) | (tensor == 255)).sum(axis=(0, 1), dtype=np.int64) * 1000 // (h * w)
    return f"{w}x{h} mean {','.join(map(str, means))} saturated {','.join(map(str, full))}"


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of every row: its text, null as empty, as a progressive JPEG file."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                texts = _texts(part.column("text"))
                files = [jpeg.encode(padded(x)) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(store, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _together(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of files that are decoded together, by their sizes; a larger one alone."""
    first = weight = 0
    for i, size in enumerate(sizes):
        if i > first and weight + size > TOGETHER:
            yield first, i
            first, weight = i, 0
        weight += size + UNIT
    if len(sizes) > first:
        yield first, len(sizes)


def read_media(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """``stored``, all columns, with what its progressive JPEG files hold: (payload, width, height, tensor).

    ``payload`` is the AC coefficients' magnitudes, a byte each, ``tensor`` full-resolution RGB, three bytes
    a pixel, by rows.  A null file gives nulls; bytes that are no progressive JPEG file raise an error.
    Columns of those names are replaced.
    """
    kept = stored.select([c for c in stored.columns if c not in ("payload", "width", "height", "tensor")])
    index = kept.columns.index(media_col)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(index).to_pylist()
            for a, b in _together([len(m) if m is not None else 0 for m in media]):
                images = [jpeg.decode(m) for m in media[a:b] if m is not None]
                found = iter(zip(images, jpeg.tensors(images), strict=True))
                rows: list[tuple] = []
                for m in media[a:b]:
                    if m is None:
                        rows.append((None, None, None, None))
                        continue
                    image, tensor = next(found)
                    rows.append((jpeg.payload(image), tensor.shape[1], tensor.shape[0], tensor.tobytes()))
                columns = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *columns], [*batch.schema.names, "payload", "width", "height", "tensor"])

    added = T.StructType().add("payload", "binary").add("width", "integer").add("height", "integer").add("tensor", "binary")
    return kept.mapInArrow(load, T.StructType([*kept.schema.fields, *added.fields]))


def with_features(loaded: DataFrame) -> DataFrame:
    """``loaded``, without its tensor, with ``feature`` of it (see ``feature``); null without a tensor."""
    names = [c for c in loaded.columns if c not in ("tensor", "feature")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)
            tensors = zip(batch.column("tensor"), shapes, strict=True)
            features = [feature(np.frombuffer(t.as_buffer(), np.uint8).reshape(h, w, 3)) if t.is_valid else None for t, (h, w) in tensors]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(features, pa.string())], [*names, "feature"])

    schema = T.StructType([*loaded.select(names).schema.fields, T.StructField("feature", T.StringType())])
    return loaded.select(*names, "tensor").mapInArrow(digest, schema)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text through ``store_media`` and ``read_media``: digests of the payload read back, the file and its tensor.

    The payload is the text's UTF-8 (null: empty) and bytes 255 up to a positive multiple of 576.
    It is stored losslessly in the format's unit, the coefficient, one byte each; the pixels
    are what the inverse transform makes of them.  Columns: id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature.  Equal texts give equal
    values; repeated rows are kept, other columns ignored, an empty table gives none.
    """
    stored = store_media(docs, id_col, text_col)
    loaded = read_media(stored).withColumns({
        "media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256), "payload_bytes": F.octet_length("payload").cast("long"),
        "payload_sha256": F.sha2("payload", 256), "tail_crc32": F.crc32(F.substring("payload", -32, 32)),
    })
    featured = with_features(loaded.drop("media", "payload"))
    return featured.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
