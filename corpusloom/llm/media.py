"""Media columns: GIF bytes in a binary column, their timed frames and colour histograms."""

from __future__ import annotations

from collections.abc import Iterator
from struct import error as struct_error

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, slices, slim
from .gif import ALL_PIXELS, read_gif, write_gif

UNIT = 64
#: Bytes that a batch of results holds, or one row.
CHUNK = 1 << 23
FRAME = "struct<start_ms:long,delay_ms:long,left:int,top:int,width:int,height:int,disposal:int,transparent:int,samples:binary,histogram:array<long>>"
_FRAME_ARROW = pa.struct(
    [("start_ms", pa.int64()), ("delay_ms", pa.int64()), *((x, pa.int32()) for x in ("left", "top", "width", "height", "disposal", "transparent")), ("samples", pa.binary()), ("histogram", pa.list_(pa.int64()))]
)


def encode_text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as UTF-8, zero-padded to a positive multiple of 64, as samples of a GIF.

    A null or empty text has no byte and one row of padding; texts of any
    length are stored whole, in as many frames as it takes. Repeated rows and
    null ids stay; equal texts give equal media. An empty table gives an empty
    result. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lo, held, sizes, media = 0, 0, [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                media.append(write_gif(raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))))
                sizes.append(len(raw))
                held += len(media[-1])
                if held > CHUNK or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0)[lo : i + 1], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])
                    lo, held, sizes, media = i + 1, 0, [], []

    kind = docs.schema[id_col].dataType.simpleString()
    return slim(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def colour_histogram(canvas: np.ndarray) -> list[int]:
    """Pixels in each of 4 x 4 x 4 cells of red, green and blue, and last those not painted."""
    rgb = canvas[..., :3].reshape(-1, 3) >> 6
    seen = canvas[..., 3].ravel() > 0
    cell = (rgb[:, 0].astype(np.int64) << 4) | (rgb[:, 1] << 2) | rgb[:, 2]
    return [*np.bincount(cell[seen], minlength=64).tolist(), int((~seen).sum())]


def decode_media(rows: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = (), all_pixels: int | None = ALL_PIXELS) -> DataFrame:
    """(id, keep..., media, frames): the timed frames of each GIF, with samples and colour histograms.

    Null media, bytes that are no GIF, and a GIF that declares more pixels
    than the limits of `gif` have null frames; a GIF without images has an
    empty list. all_pixels limits all frames of a GIF together; None is for
    media that this library wrote, which hold as many frames as their texts need. Repeated rows and null ids are rows each; an empty table gives
    an empty result; of other columns only `keep` are passed on.
    """
    fixed = [id_col, *keep, media_col]
    picked = slim(rows, *fixed)

    def frames(data: bytes | None) -> list[dict] | None:
        try:
            return None if data is None else [{n: getattr(f, n) for n in ("start_ms", "delay_ms", "left", "top", "width", "height", "disposal", "transparent", "samples")} | {"histogram": colour_histogram(f.canvas)} for f in read_gif(data, all_pixels=all_pixels)]
        except (ValueError, IndexError, struct_error):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, held, out = 0, 0, []
            for i, data in enumerate(b.column(len(fixed) - 1).to_pylist()):
                out.append(frames(data))
                held += sum(len(f["samples"]) for f in out[-1] or [])
                if held > CHUNK or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(c[lo : i + 1] for c in b.columns), pa.array(out, pa.list_(_FRAME_ARROW))], [*fixed, "frames"])
                    lo, held, out = i + 1, 0, []

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields) + f", frames array<{FRAME}>"
    return picked.mapInArrow(run, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = encode_text_media(load(spark, sf_dir, "documents"))
    read = decode_media(stored, keep=("n_bytes",), all_pixels=None)  # written above
    payload = read.withColumn("payload", F.expr("aggregate(frames, cast('' as binary), (a, f) -> concat(a, f.samples))"))
    total = F.expr("transform(sequence(0, 64), i -> aggregate(frames, 0L, (a, f) -> a + element_at(f.histogram, int(i) + 1)))")
    return payload.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("frames"), F.expr("aggregate(frames, 0L, (a, f) -> a + f.delay_ms)"), F.array_join(total.cast("array<string>"), ",")).alias("feature"),
        F.size("frames").alias("n_frames"),
    )
