"""Near-dedup by similarity: groups of texts whose word shingles overlap by a given share.

Candidates come from two sources. SimHash fingerprints within two bits of each other,
found by Golay-code keys (`simhash`), make pairs of nearly equal texts. For the
rest there are minima of the shingle sets under many hash functions: two
sets have the same minimum as often as their Jaccard similarity says, however
the texts differ (words here and there, or blocks cut off, put in or replaced).
A band is a few minima together; texts that share one band at least meet in
its bucket. One byte of each minimum is the text's signature, and a pair is a
candidate if enough bytes agree. Bands and bytes follow from the similarity
and a target recall.

Equal word sequences collapse first. In each bucket a text is then joined to
the nearest one before it, so that groups form from fewer edges than a bucket
has members, never from all its pairs. Each edge is verified by the exact
Jaccard similarity of the whole texts' shingle sets. Where a bucket still
holds more than one group and pairs that have not been tried, the sets of its
members meet: every text outside the bucket's largest group is compared
exactly with all others, and only edges that join groups leave the task. So
each pair of candidates is verified or lies in one group. Buckets of any size
are dealt in parts of bounded bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, partitions, release, slices, slim
from .mph import mix
from .simhash import components, skewed_join

#: Share of the pairs of the least similarity that become candidates, minima of a band.
RECALL, ROWS = 0.997, 5
#: Members of a bucket that are compared at once, and shingles of one side of a part in which sets meet.
BLOCK, PART = 512, 1 << 20
SHINGLE, SIMILARITY = 5, 0.8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def text_key(words: list[bytes]) -> int:
    """A signed 64-bit hash of the word sequence."""
    h = xxhash.xxh64_intdigest(b" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def plan(similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """(bands, agreeing bytes) for which pairs of that similarity become candidates as often as the recall asks; each may miss half of the rest."""
    miss, agree = (1 - recall) / 2, min(max(similarity, 0.01), 0.999)
    bands = math.ceil(math.log(miss) / math.log(1 - agree**ROWS))
    same, n, below, least = agree + (1 - agree) / 256, ROWS * bands, 0.0, 0
    while below + (p := math.comb(n, least) * same**least * (1 - same) ** (n - least)) <= miss:
        below, least = below + p, least + 1
    return bands, least


def sketch(shingles: np.ndarray, bands: int) -> tuple[bytes, np.ndarray]:
    """(signature, keys): a byte of each minimum of the shingle set, and a hash of each band of minima."""
    n = ROWS * bands
    least = np.full(n, 0xFFFFFFFF, np.uint64)
    scale, shift = mix(np.arange(n), 1) | np.uint64(1), mix(np.arange(n), 2)
    with np.errstate(over="ignore"):
        for lo in range(0, len(shingles), 1 << 9):
            moved = shingles[lo : lo + (1 << 9)][None, :] * scale[:, None]
            moved += shift[:, None]
            np.minimum(least, moved.min(axis=1) >> np.uint64(32), out=least)
        keys = np.arange(bands, dtype=np.uint64)
        for k in range(ROWS):
            keys = mix(keys ^ least[k::ROWS], k)
    return (least & np.uint64(255)).astype(np.uint8).tobytes(), keys.view(np.int64)


def shingle_set(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g)) for g in zip(*(words[i:] for i in range(shingle)), strict=False)), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes agree, for each pair of rows of two arrays of signatures."""
    out = np.empty((len(a), len(b)), np.int16)
    step = max(1, (1 << 22) // max(1, a.size))
    for lo in range(0, len(b), step):
        out[:, lo : lo + step] = (a[:, None, :] == b[None, lo : lo + step, :]).sum(axis=2, dtype=np.int16)
    return out


def nearest_before(sig: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, neighbour, again): each member of a bucket with the nearest one before it, if enough bytes agree.

    Worked off in blocks; members before a block are met through those that
    had no neighbour of their own. `again` marks the members of candidate
    pairs where not all of these became edges.
    """
    n, leaders, a, b = len(sig), np.zeros(0, np.int64), [], []
    again = np.full(n, n > BLOCK)
    for lo in range(0, n, BLOCK):
        rows = np.arange(lo, min(n, lo + BLOCK))
        before = np.concatenate([leaders, rows])
        same = agreeing(sig[rows], sig[before])
        same[before[None, :] >= rows[:, None]] = -1
        at = same.argmax(axis=1)
        near = same[np.arange(len(rows)), at] >= least
        if n <= BLOCK:
            met = same >= least
            if (met.sum(axis=1) > 1).any():
                again = met.any(axis=0) | met.any(axis=1)
        a.append(rows[near])
        b.append(before[at[near]])
        leaders = np.concatenate([leaders, rows[~near]])
    return np.concatenate(a), np.concatenate(b), again


def overlaps(asking: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """The exact number of common shingles of each pair of two lists of sets."""
    left, right = np.concatenate(asking), np.concatenate(others)
    who_l, who_r = np.repeat(np.arange(len(asking)), list(map(len, asking))), np.repeat(np.arange(len(others)), list(map(len, others)))
    order = np.argsort(right, kind="stable")
    right, who_r = right[order], who_r[order]
    lo, hi = np.searchsorted(right, left, side="left"), np.searchsorted(right, left, side="right")
    n, out = hi - lo, np.zeros(len(asking) * len(others), np.int64)
    ends, at = np.cumsum(n), 0
    while at < len(left):  # a few million common shingles at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 22), side="right")))
        k = n[at:to]
        place = np.repeat(lo[at:to] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        out += np.bincount(np.repeat(who_l[at:to], k) * len(others) + who_r[place], minlength=len(out))
        at = to
    return out.reshape(len(asking), len(others))


def joining(asking: list[np.ndarray], ask_root: np.ndarray, others: list[np.ndarray], root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of roots that exact similarities join: a forest of them, however many pairs are similar."""
    names = np.unique(np.concatenate([ask_root, root]))
    at, up = np.searchsorted(names, root), np.arange(len(names))
    ask_at, sizes, found = np.searchsorted(names, ask_root), np.array(list(map(len, others))), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    step = max(1, (1 << 20) // max(1, len(others)))
    for lo in range(0, len(asking), step):
        part = asking[lo : lo + step]
        n = np.array(list(map(len, part)))
        fits = (np.minimum(n[:, None], sizes[None, :]) >= similarity * np.maximum(n[:, None], sizes[None, :])).any(axis=0)
        some = np.nonzero(fits)[0]
        if not len(some):
            continue
        both = overlaps(part, [others[i] for i in some.tolist()])
        whole = n[:, None] + sizes[some][None, :] - both
        rows, cols = np.nonzero((both >= similarity * whole) & (ask_at[lo : lo + step][:, None] != at[some][None, :]))
        for x, y in set(zip(ask_at[lo + rows].tolist(), at[some[cols]].tolist(), strict=True)):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                found.append((int(names[x]), int(names[y])))
    return found


def _sketches(texts: DataFrame, bands: int, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, signatures, keys = [], [], []
            for t in batch.column(2).to_pylist():
                words = words_of(t)
                hashes.append(text_key(words))
                sig, of = sketch(shingle_set(words, shingle), bands)
                signatures.append(sig)
                keys.append(of)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.int64()), pa.array(signatures, pa.binary()), lists], ["id", "r", "h", "sig", "keys"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, r long, h long, sig binary, keys array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, h) sorted by key, those whose key another row has too."""
    held, known = None, False  # the last row so far, and whether its key was shared by the row before
    for batch in batches:
        key, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        if held is not None:
            key, h = np.concatenate([held[0], key]), np.concatenate([held[1], h])
        same = np.concatenate([[known], key[1:] == key[:-1]])
        kept = same[:-1] | same[1:]  # the last row waits for the next batch
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][kept]), pa.array(h[:-1][kept])], ["key", "h"])
        held, known = (key[-1:], h[-1:]), bool(same[-1])
    if known:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["key", "h"])


def _candidates(batches: Iterator[pa.RecordBatch], least: int, width: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of rows (key, h, sig) sorted by key, and the members to look at again as (h, null, key).

    Buckets that span batches are carried over, their members without a
    neighbour alone, and are looked at again.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(key), width)
        fresh = 0
        if held is not None and held[0] == key[0]:
            fresh = len(held[1])
            key, h, sig = np.concatenate([np.full(fresh, held[0]), key]), np.concatenate([held[1], h]), np.concatenate([held[2], sig])
        cuts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
        a, b, last, open_rows = [], [], None, np.zeros(len(key), bool)
        for i in np.nonzero(np.diff(cuts) > 1)[0]:
            lo, hi = cuts[i], cuts[i + 1]
            member, other, open_rows[lo:hi] = nearest_before(sig[lo:hi], least)
            a.append(h[lo:hi][member])
            b.append(h[lo:hi][other])
            if hi == len(key):
                last = np.setdiff1d(np.arange(hi - lo), member)
        lo = cuts[-2]
        keep = np.arange(lo, len(key)) if last is None else lo + last
        held = (key[-1], h[keep], sig[keep])
        open_rows[lo:] = True
        if fresh:
            open_rows[: cuts[1]] = True
        if a:
            x, y = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1)[x != y], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.nulls(len(pairs), pa.int64())], ["a", "b", "key"])
        yield pa.RecordBatch.from_arrays([pa.array(h[open_rows]), pa.nulls(int(open_rows.sum()), pa.int64()), pa.array(key[open_rows])], ["a", "b", "key"])


def _shingle_sets(texts: DataFrame, distinct: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(h, n, s): the shingle set of each wanted text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys, sizes, out = [], [], []
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(t)
                if text_key(words) == h:  # the hash of a text may come with another text
                    s = shingle_set(words, shingle)
                    keys.append(h), sizes.append(len(s)), out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["h", "n", "s"])

    of = distinct.join(wanted, "h", "left_semi").select("h", F.col("row.id").alias("of"), F.col("row.r").alias("of_r"))
    held = texts.join(of, texts["id"].eqNullSafe(of["of"]) & (texts["r"] == of["of_r"])).select("h", "text")
    return held.mapInArrow(sets, "h long, n long, s binary").dropDuplicates(["h"])


def _fingerprint_links(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b): candidates by SimHash. Texts of one fingerprint meet its first text; first texts meet where Golay keys link their fingerprints (`simhash.links`)."""
    one = texts.join(distinct.select("h", F.col("row.id").alias("of"), F.col("row.r").alias("of_r")), texts["id"].eqNullSafe(F.col("of")) & (texts["r"] == F.col("of_r"))).select("h", "text")
    marks = materialize(simhash.fingerprints(one, "h", "text").groupBy("h").agg(F.min("fp").alias("fp")), "fingerprints")
    first = materialize(marks.groupBy("fp").agg(F.min("h").alias("first")), "first-texts")
    end = lambda x: first.select(F.col("fp").alias(x), F.col("first").alias(f"h{x}"))
    near = simhash.links(first.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.greatest("ha", "hb").alias("a"), F.least("ha", "hb").alias("b"))
    same = marks.join(first, "fp").where("h <> first").select(F.col("h").alias("a"), F.col("first").alias("b"))
    out = materialize(near.union(same), "fingerprint-links")
    release(marks, first)
    return out


def _verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges whose texts' shingle sets overlap enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    one = lambda end, s: sets.select(F.col("h").alias(end), F.col("n").alias(f"n{s}"), F.col("s").alias(s))
    sized = edges.join(sets.select(F.col("h").alias("a"), F.col("n").alias("na")), "a").join(sets.select(F.col("h").alias("b"), F.col("n").alias("nb")), "b")
    fitting = sized.where(F.least("na", "nb") >= similarity * F.greatest("na", "nb")).select("a", "b")  # sizes alone rule the others out
    both = fitting.join(one("a", "x"), "a").join(one("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(check, "a long, b long")


def _across(opened: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): roots of groups that exact similarities between members of one bucket join."""
    rows = opened.join(roots, opened.h == roots.node, "left").select("key", "h", F.coalesce("root", "h").alias("root"))
    sized = rows.join(sets.select("h", "n"), "h")
    groups = sized.groupBy("key", "root").agg(F.sum("n").alias("n"))
    per = groups.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    per = per.select("key", F.col("most.root").alias("largest"), F.ceil(F.col("n") / PART).cast("long").alias("parts"), F.ceil((F.col("n") - F.col("most.n")) / PART).cast("long").alias("asks"))
    met = rows.join(per, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n), F.lit(1)) - 1))
    own = lambda n: F.pmod(F.xxhash64("h"), F.greatest(F.col(n), F.lit(1)))
    others = met.select("key", own("parts").alias("i"), every("asks").alias("j"), F.lit(False).alias("asks"), "root", "h")
    asking = met.where("root <> largest").select("key", own("asks").alias("j"), every("parts").alias("i"), F.lit(True).alias("asks"), "root", "h")
    both = others.unionByName(asking).join(sets.select("h", "s"), "h").select("key", "i", "j", "asks", "root", "s")

    def meet(table: pa.Table) -> pa.Table:
        asks, root = table.column("asks").to_numpy(), table.column("root").to_numpy()
        held = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
        split = [([held[i] for i in np.nonzero(m)[0].tolist()], root[m]) for m in (asks, ~asks)]
        found = joining(*split[0], *split[1], similarity) if split[0][0] and split[1][0] else []
        return pa.table({"a": pa.array([max(p) for p in found], pa.int64()), "b": pa.array([min(p) for p in found], pa.int64())})

    # few bytes, but work: not to be merged into few tasks
    return both.repartition(partitions(opened.sparkSession), "key", "i", "j").groupBy("key", "i", "j").applyInArrow(meet, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """(id, component_id): one row for each row of docs; component_id is the smallest id of its group.

    Texts are linked if they have the same words in the same order (case
    aside), or if they are candidates and the Jaccard similarity of their
    shingle sets is at least `similarity`. A null text counts as empty; texts
    without words are one group. A null id counts as larger than all others.
    Repeated rows and ids are rows each; texts of any length count whole. An
    empty table gives an empty result; extra columns are ignored.
    """
    sketched, of = _rooted(docs, id_col, text_col, similarity, shingle, recall)
    classes = of.join(_lowest(of), "root").select("h", F.col("low.id").alias("component_id"))
    return skewed_join(sketched.select("id", "h"), classes, "h").select(F.col("id").alias(id_col), "component_id")


def _lowest(of: DataFrame) -> DataFrame:
    """(root, low): the first row of each group."""
    return of.groupBy("root").agg(F.min("row").alias("low"))


def _rooted(docs: DataFrame, id_col: str, text_col: str, similarity: float, shingle: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """The rows (id, r, h), r being a hash of the text as written, and the groups (h, row, root), row being the first (bare, id, r) of h.

    Rows without an id come after all others.
    """
    texts = slim(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("r"), F.col(text_col).alias("text"))
    bands, least = plan(similarity, recall)
    sketched = materialize(_sketches(texts, bands, shingle), "sketches")
    row = F.struct(F.col("id").isNull().alias("bare"), "id", "r")
    distinct = materialize(sketched.groupBy("h").agg(F.min(row).alias("row"), F.first("sig").alias("sig"), F.first("keys").alias("keys")), "distinct-texts")
    keyed = distinct.select(F.explode("keys").alias("key"), "h")
    shared = materialize(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, h long"), "shared-keys")
    signed = shared.join(distinct.select("h", "sig"), "h").select("key", "h", "sig")
    found = signed.repartition("key").sortWithinPartitions("key", "h").mapInArrow(lambda batches: _candidates(batches, least, ROWS * bands), "a long, b long, key long")
    found = materialize(found.distinct(), "candidates")
    release(shared)
    marked, opened = _fingerprint_links(texts, distinct), found.where("key is not null").select("key", F.col("a").alias("h"))
    edges = materialize(found.where("key is null").select("a", "b").union(marked).distinct(), "candidate-edges")
    release(marked)
    wanted = edges.select(F.explode(F.array("a", "b")).alias("h")).union(opened.select("h")).distinct()
    sets = materialize(_shingle_sets(texts, distinct, wanted, shingle), "shingle-sets")
    verified = materialize(_verified(edges, sets, similarity), "verified")
    roots = components(verified)
    merged = materialize(_across(opened, roots, sets, similarity), "merged")
    release(verified, found, edges, sets)
    tops = components(merged)
    of = distinct.select("h", "row").join(roots, F.col("h") == roots.node, "left").select("h", "row", F.coalesce("root", "h").alias("near"))
    tops = tops.select(F.col("node").alias("near"), F.col("root").alias("top"))
    of = materialize(of.join(tops, "near", "left").select("h", "row", F.coalesce("top", "near").alias("root")), "rooted-texts")
    release(distinct, merged)
    return sketched, of


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents without their near duplicates, with all columns: of each group one row, that of the smallest id.

    Rows are told apart by id and text, so null and repeated ids lose nothing
    but near duplicates. A row without an id is kept only where its group has
    no other. Null and empty texts are one group; texts of any length count
    whole; an empty table stays empty.
    """
    sketched, of = _rooted(docs, id_col, text_col, similarity, SHINGLE, RECALL)
    lowest = _lowest(of).select(F.col("low.id").alias("low_id__"), F.col("low.r").alias("low_r__"), F.lit(True).alias("low__"))
    rows = sketched.groupBy("id", "r").agg(F.count(F.lit(1)).alias("n"))
    marked = rows.join(lowest, rows["id"].eqNullSafe(lowest["low_id__"]) & (rows["r"] == lowest["low_r__"]), "left")
    odd = materialize(marked.where("low__ is null or n > 1").select(F.col("id").alias("odd_id__"), F.col("r").alias("odd_r__"), F.col("low__").isNotNull().alias("low__")), "dropped")
    keyed = docs.withColumn("row_key__", F.xxhash64(text_col))
    here = keyed[id_col].eqNullSafe(odd["odd_id__"]) & (keyed["row_key__"] == odd["odd_r__"])
    kept = keyed.join(odd, here, "left_anti")
    repeated = odd.where("low__")  # rows that stay, but once
    if not repeated.isEmpty():
        once = keyed.join(repeated, keyed[id_col].eqNullSafe(repeated["odd_id__"]) & (keyed["row_key__"] == repeated["odd_r__"]), "left_semi")
        kept = kept.union(once.dropDuplicates([id_col, "row_key__"]))
    return kept.drop("row_key__")
