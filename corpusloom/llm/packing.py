"""Packing: documents of token ids into fixed-length sequences, shortest pack first over the length histogram.

Each document is cut into pieces of at most `window` ids. The pieces' lengths
make a histogram of at most `window` bins, whatever the number of documents;
only that histogram reaches the driver. From the longest length down, all
pieces of a length go to the packs that are shortest so far (while they fit),
else open new packs; equal packs are kept as one pattern with a count. The
patterns then go back to the pieces by rank: the r-th piece of a length takes
the slot that the patterns' counts assign to rank r.

Ranks are dealt in two levels, by length and a hash bucket of id, start,
content and place in the stored file, so that neither a length which a large
part of all pieces share, nor rows repeated that often, are ever ordered
within one task. Pieces that agree in all but the place are equal rows, which
may change places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, materialize, partitions, slices, slim
from .tokens import default_path, encoded

WINDOW = 2048
END_ID = 1


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): each text's ids and the end id, cut at multiples of the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(end_id).to_bytes(4, "little")
        step = 4 * window
        for b in slices(batches):
            rows = b.column(0)
            texts = [t or "" for t in b.column(1).to_pylist()]
            at, start, length, crc, total, ids, held = [], [], [], [], [], [], 0

            def out():
                cols = [rows.take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                if keep_ids:
                    cols.append(pa.array(ids, pa.binary()))
                return pa.RecordBatch.from_arrays(cols, [id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids])

            for i, payload in encoded(texts, tokenizer):
                payload += end
                for lo in range(0, len(payload), step):
                    piece = payload[lo : lo + step]
                    at.append(i), start.append(lo // 4), length.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(len(payload) // 4)
                    if keep_ids:
                        ids.append(piece)
                        held += len(piece)
                if held > 1 << 25:
                    yield out()
                    at, start, length, crc, total, ids, held = [], [], [], [], [], [], 0
            yield out()

    kind = docs.schema[id_col].dataType.simpleString()
    return slim(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)


def shortest_pack_first(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths in order) that hold each length of the histogram as often as it says."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_packs, default=0)
            if room < length:  # fresh packs; equal lengths placed in turn fill one after another
                per = window // length
                full, rest = divmod(left, per)
                opened = [(full, per), (1, rest)]
                for count, n in opened:
                    if count and n:
                        open_packs.setdefault(window - n * length, []).append((count, (length,) * n))
                break
            for count, held in open_packs.pop(room):
                used = min(count, left)
                left -= used
                if used:
                    open_packs.setdefault(room - length, []).append((used, (*held, length)))
                if count > used:
                    open_packs.setdefault(room, []).append((count - used, held))
    return [(count, held) for packs in open_packs.values() for count, held in packs]


class Plan:
    """Where the r-th piece of each length goes: sorted rank intervals, with the sequence and offset of each."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]]) -> None:
        slots: dict[int, list[tuple[int, int, int]]] = {}
        given: dict[int, int] = {}
        first = 0
        for count, held in patterns:
            offset = 0
            for length in held:
                rank = given.get(length, 0)
                slots.setdefault(length, []).append((rank, first, offset))
                given[length] = rank + count
                offset += length
            first += count
        self.sequences = first
        self.slots = {k: np.array(v, np.int64) for k, v in slots.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.concatenate([[0], np.nonzero(np.diff(length[order]))[0] + 1, [len(order)]]) if len(order) else np.zeros(1, int)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[lo:hi]
            s = self.slots[int(length[rows[0]])]
            k = np.searchsorted(s[:, 0], rank[rows], side="right") - 1
            sequence[rows] = s[k, 1] + rank[rows] - s[k, 0]
            offset[rows] = s[k, 2]
        return sequence, offset


def assign(cut: DataFrame, id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (id, start, length, ...) as read from Parquet files."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    plan = Plan(shortest_pack_first(histogram, window))
    buckets = 8 * partitions(spark)
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64(id_col, "start", "ids_crc32", "_metadata.row_index"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(id_col, "start", "ids_crc32")) - 1
    ranked = keyed.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own")).drop("bucket", "own", "before")
    names = ranked.columns
    out = [f for f in ranked.schema.fields if f.name != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = dict(zip(names, b.columns, strict=True))
            sequence, offset = plan.place(col["length"].to_numpy(), col["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*(col[f.name] for f in out), pa.array(sequence), pa.array(offset)], [*(f.name for f in out), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset.

    A null or empty text is one piece with the end id alone. Repeated rows and
    repeated or null ids are documents of their own. An empty table gives an
    empty result. Texts of any length are cut, each id lies in one piece.
    Extra columns are ignored. keep_ids adds each piece's ids, as
    little-endian unsigned 32-bit bytes.
    """
    cut = materialize(pieces(docs, tokenizer, id_col, text_col, window, end_id, keep_ids), "pieces")
    order = [id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids, "sequence_id", "offset"]
    return assign(cut, id_col, window).select(*order)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return pack(docs, default_path()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
