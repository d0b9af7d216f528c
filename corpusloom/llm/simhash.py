"""Near-duplicate detection: SimHash fingerprints, Golay-code fuzzy keys, verified links, components.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ
in at most two bits agree on one whole segment while the segment after it (in
a cycle) differs in at most one bit; whichever way the errors fall, one of the
three (exact, fuzzy) pairs has this. The fuzzy segment is decoded to the
Golay codewords near it, and each codeword index together with the exact
segment is a key of about 34 bits. Fingerprints that share a key are
candidates; each link is verified by its Hamming distance.

Equal fingerprints collapse before any key is made, so a group of exact
copies costs one fingerprint. Within a bucket no pairs are emitted: a bucket
yields one edge a member at most, found by exact pairwise distances in small
buckets and through one-bit-flip neighbours in larger ones (two values are
within two bits exactly if they share a value that is within one bit of
both), which is linear in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golay
from .common import load, materialize, release, slices, slim

SEGMENTS = ((0, 22), (22, 21), (43, 21))
RADIUS = 2
#: Buckets up to this size compare all pairs in memory, larger ones use flips.
PAIRWISE = 256
#: Buckets above this size leave the task: their members go through a shuffle on flip neighbours.
IN_MEMORY = 65_536
#: Edges up to which components are found in one task.
IN_TASK = 1 << 20


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles (repeats included) under XXH64; no word: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 15):
        hi = min(n, lo + (1 << 15))
        part = words[lo : hi + shingle - 1]
        if len(part) < shingle:
            grams = [b" ".join(part)]
        else:
            grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        h = np.array([digest(g, seed) for g in grams], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t or "", shingle, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return slim(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index into fp): the fuzzy keys of each fingerprint."""
    v = fp.view(np.uint64)
    seg = [((v >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    keys, owner = [], []
    for p in range(3):
        near = golay.nearby_indices(seg[(p + 1) % 3].astype(np.int32)).astype(np.int64)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(new)
        keys.append((np.int64(p) << 34) | (seg[p][row] << 12) | near[row, col])
        owner.append(row)
    return np.concatenate(keys), np.concatenate(owner)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of n nodes under the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        nxt = root.copy()
        np.minimum.at(nxt, a, low)
        np.minimum.at(nxt, b, low)
        np.minimum.at(nxt, root[a], low)
        np.minimum.at(nxt, root[b], low)
        nxt = nxt[nxt]
        if (nxt == root).all():
            return root
        root = nxt


def bucket_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, representative) of distinct fingerprints of one bucket that verified links join."""
    n = len(fp)
    v = fp.view(np.uint64)
    if n <= PAIRWISE:
        a, b = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= RADIUS, 1))
    else:
        flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
        near = (v[:, None] ^ flips[None, :]).ravel()
        who = np.repeat(np.arange(n), 65)
        order = np.argsort(near, kind="stable")
        near, who = near[order], who[order]
        same = near[1:] == near[:-1]
        a, b = who[:-1][same], who[1:][same]
    if not len(a):
        return fp[:0], fp[:0]
    root = _roots(n, a, b)
    moved = root != np.arange(n)
    return fp[moved], fp[root[moved]]


def _scan_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by both; yields (a, b) edges, or (a, null) for members of buckets too large for a task."""
    names = ["a", "b"]
    held_key, held, large = None, [], False

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)

    def nulls(a):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64())], names)

    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        cuts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
        parts_a, parts_b = [], []
        sizes = np.diff(cuts)
        last = len(sizes) - 1
        for i in np.nonzero((sizes > 1) | (np.arange(last + 1) == 0) | (np.arange(last + 1) == last))[0]:
            k, members = key[cuts[i]], fp[cuts[i] : cuts[i + 1]]
            if held_key is not None and k != held_key:
                if not large and sum(map(len, held)) > 1:
                    a, b = bucket_links(np.concatenate(held))
                    parts_a.append(a), parts_b.append(b)
                held_key, held, large = None, [], False
            if i in (0, last):
                held_key = k
                held.append(members)
                if large or sum(map(len, held)) > IN_MEMORY:
                    large = True
                    yield nulls(np.concatenate(held))
                    held = []
            else:
                a, b = bucket_links(members) if len(members) <= IN_MEMORY else (members[:0], members[:0])
                if len(members) > IN_MEMORY:
                    yield nulls(members)
                parts_a.append(a), parts_b.append(b)
        if parts_a:
            yield out(np.concatenate(parts_a), np.concatenate(parts_b))
    if held and not large and sum(map(len, held)) > 1:
        yield out(*bucket_links(np.concatenate(held)))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): verified links between distinct fingerprints (column fp) whose components are those of all links."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(fp), 1 << 14):
                part = np.ascontiguousarray(fp[lo : lo + (1 << 14)])
                k, row = golay_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[row])], ["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(keys, "key long, fp long")
    found = materialize(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_scan_buckets, "a long, b long"), "links")
    edges = found.where("b is not null").distinct()
    marked = found.where("b is null").select("a").distinct()
    if marked.isEmpty():
        return edges
    flips = F.array(F.col("a"), *(F.col("a").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    near = materialize(marked.select("a", F.explode(flips).alias("near")), "flips")
    lowest = near.groupBy("near").agg(F.min("a").alias("b"))
    return edges.union(near.join(lowest, "near").where("a <> b").select("a", "b")).distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (a, b) of one task."""
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    a, b = (np.concatenate([x[i] for x in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
    node, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _roots(len(node), of[: len(a)], of[len(a) :])
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest reachable node for every node of the undirected edges (a, b).

    Up to IN_TASK edges, of sixteen bytes each, are united in one task.
    Beyond that, labels travel over the edges and are then shortened by
    following the label of the label; each round is written to the shared
    folder. The result is the same.
    """
    if edges.count() <= IN_TASK:
        return materialize(edges.select("a", "b").coalesce(1).mapInArrow(_united, "node long, root long"), "labels")
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        step = materialize(step.join(up, "root").select("node", "old", F.least("root", "further").alias("root")), "labels")
        release(labels)
        labels = step
        if step.where("old <> root").isEmpty():
            release(both)
            return step.select("node", "root")


def skewed_join(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """rows joined to their class by a key that one class has once and rows may have very often.

    The keys of a thousandth of all rows and more, a thousand at most, are
    joined by broadcast; the others by a shuffle in which no key is large.
    """
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n__"))
    total = counted.agg(F.coalesce(F.sum("n__"), F.lit(0)).alias("n")).first().n
    hot = counted.where(F.col("n__") * 1000 >= max(1000, total)).select(key)
    hot_classes = classes.join(hot, key, "left_semi")
    few = F.broadcast(hot.withColumn("hot__", F.lit(True)))  # a thousand keys at most
    split = rows.join(few, key, "left")
    often = split.where("hot__").drop("hot__").join(F.broadcast(hot_classes), key)  # a thousand rows at most
    return often.unionByName(split.where("hot__ is null").drop("hot__").join(classes, key))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fingerprint, component_id, copies): one row for each row of docs.

    A null or blank text has the fingerprint zero and links like any other; a
    null id counts as larger than all others and is a component id only if a
    component has no other. Repeated rows and ties stay, with equal values;
    texts of any length count whole. An empty table gives an empty result.
    Extra columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, seed).withColumnRenamed(id_col, "id__"), "fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("id__").alias("low"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(distinct))
    of = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    of = materialize(of, "rooted")
    totals = of.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("copies"))
    classes = materialize(skewed_join(of.select("fp", "root"), totals, "root").select("fp", "component_id", "copies"), "classes")
    return skewed_join(fps, classes, "fp").select(F.col("id__").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "copies")
