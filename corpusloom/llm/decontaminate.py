"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of words (lower case, punctuation stripped); words that no
item has are one common sign. The CGK embedding walks along a sequence: at
each step it puts out the word it stands on and moves on by one or none, as a
random bit for that step and word says. Sequences of small edit distance have
embeddings of small Hamming distance. Each repetition has its own random bits
and samples a few coordinates of the embedding; windows and items that agree
on all of them are candidates. Repetitions, each with a walk of its own, are
added until the recall of edited copies of the items, measured on them, reaches
the target. Where the walks don't suffice (long items), items are cut into one
segment more than edits are allowed: one of them at least is in any copy as it
is, and every place of it is a candidate, so none is lost. Each candidate is
verified by its exact edit distance, in words.

Items are grouped by length; a document's windows of that length begin at
every word. A window whose words are too rarely words of items can't be within
the edits allowed, and is left out before it is walked (this loses nothing).
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, slices, slim
from .toxicity import PUNCTUATION

#: Edits allowed for each word of an item, target recall, coordinates a repetition, most repetitions, edited copies that recall is measured on.
EDITS, RECALL, COORDINATES, REPETITIONS, COPIES = 0.1, 0.98, 3, 16, 1024
#: Items held at once; a larger benchmark is worked off in several passes.
BLOCK, BLOCK_CHARS = 20_000, 1 << 24
REMEMBER = 200_000
CHUNK_WORDS = 1 << 19
OTHER, EDGE, FIRST = 0, 1, 2


def words_of(text: str | None) -> list[str]:
    return [w for x in (text or "").lower().split() if (w := x.strip(PUNCTUATION))]


def edits_within(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(edits, end): the fewest word edits that turn the pattern into a stretch of the text, and where the first such stretch ends.

    Bit-parallel, one step a word of the text, over integers of any length.
    """
    n = len(pattern)
    mask, high = (1 << n) - 1, 1 << (n - 1)
    eq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    plus, minus, score, best = mask, 0, n, (n, 0)
    for j, w in enumerate(text):
        e = eq.get(w, 0)
        x = e | minus
        d = (((x & plus) + plus) ^ plus) | x
        up, down = minus | (~(d | plus) & mask), plus & d
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & mask, (down << 1) & mask
        plus, minus = down | (~(d | up) & mask), up & d
        if score < best[0]:
            best = (score, j + 1)
    return best


class _Class:
    """Items of similar length, with their repetitions."""

    def __init__(self, items: list[tuple[int, list[int]]], hashes: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> None:
        self.items = items
        self.least = min(len(w) for _, w in items)
        self.most = max(len(w) for _, w in items)
        self.edits = max(allowed(len(w)) for _, w in items)
        self.needed = max(1, self.least - 2 * self.edits)
        steps = max(1, 2 * self.least - 1)
        padded = np.full((len(items), self.most + steps + 2), EDGE, np.int64)
        for r, (_, w) in enumerate(items):
            padded[r, : len(w)] = w
        self.repetitions, self.segments = [], []
        copies = self._copies(padded, rng)
        met = np.zeros(len(copies) // 2, bool)
        for k in range(len(draws)):
            at = np.sort(rng.choice(steps, min(COORDINATES, steps), replace=False))
            seen = walk(padded, np.arange(len(items)) * padded.shape[1], hashes, draws[k], at)
            key = mix_key(seen)
            order = np.argsort(key, kind="stable")
            first = np.zeros(len(hashes), bool)
            first[seen[:, 0]] = True
            self.repetitions.append((k, at, first, key[order], order))
            both = walk(copies, np.arange(len(copies)) * copies.shape[1], hashes, draws[k], at)
            met |= (both[::2] == both[1::2]).all(axis=1)
            if k and met.mean() - 2 * math.sqrt(RECALL * (1 - RECALL) / len(met)) >= RECALL:  # its lower bound
                break
        else:
            self.repetitions, self.segments = [], self._segments(len(hashes))

    def _copies(self, padded: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Pairs of rows: an item and a copy of it with all the edits allowed."""
        width = 2 * padded.shape[1]
        count = min(COPIES, max(16, (1 << 21) // width))
        out = np.full((2 * count, width), EDGE, np.int64)
        for n, r in enumerate(rng.integers(0, len(padded), count)):
            w = list(self.items[r][1])
            copy = list(w)
            for _ in range(allowed(len(w))):
                p, kind = int(rng.integers(0, len(copy))), int(rng.integers(0, 3))
                copy[p : p + (kind != 1)] = [] if kind == 0 else [OTHER]
            out[2 * n, : len(w)], out[2 * n + 1, : len(copy)] = w, copy
        return out

    def _segments(self, signs: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(words of a segment, first words, sorted keys, items, offsets) for each length of segment."""
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, (_, w) in enumerate(self.items):
            parts = allowed(len(w)) + 1
            groups.setdefault(len(w) // parts, []).extend((i, k * len(w) // parts) for k in range(parts))
        out = []
        for n, places in groups.items():
            seen = np.array([self.items[i][1][o : o + n] for i, o in places], np.int64)
            key, first = mix_key(seen), np.zeros(signs, bool)
            first[seen[:, 0]] = True
            order = np.argsort(key, kind="stable")
            at = np.array(places)[order]
            out.append((n, first, key[order], at[:, 0], at[:, 1]))
        return out


def allowed(n: int) -> int:
    return int(EDITS * n)


def walk(words: np.ndarray, start: np.ndarray, hashes: np.ndarray, draws: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words at the coordinates `at` of the embeddings that begin at the given places.

    The bit of a step and word is the top bit of the step's odd factor times
    the word's hash, so bits need no table.
    """
    flat, pos, out = words.ravel(), start.copy(), []
    hashed = hashes[flat]
    with np.errstate(over="ignore"):
        for j in range(int(at[-1]) + 1):
            if j in at:
                out.append(flat[pos])
            pos += ((hashed[pos] * draws[j]) >> np.uint64(63)).astype(np.int64)
    return np.stack(out, axis=1)


def mix_key(seen: np.ndarray) -> np.ndarray:
    key = np.zeros(len(seen), np.uint64)
    with np.errstate(over="ignore"):
        for c in range(seen.shape[1]):
            key = (key ^ seen[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key


class Index:
    """The items of one block: vocabulary, length classes, repetitions. Built anew from the items wherever it is needed."""

    def __init__(self, items: list[tuple[int, str | None]], seed: int = 11) -> None:
        self.vocabulary: dict[str, int] = {}
        known = []
        for item, text in items:
            w = [self.vocabulary.setdefault(x, FIRST + len(self.vocabulary)) for x in words_of(text)]
            if w:
                known.append((item, w))
        self.known = known
        groups: dict[int, list[tuple[int, list[int]]]] = {}
        for item, w in known:
            groups.setdefault(math.floor(2 * math.log2(len(w))), []).append((item, w))
        rng = np.random.default_rng(seed)
        longest = max((len(w) for _, w in known), default=1)
        self.hashes = rng.integers(0, 1 << 64, FIRST + len(self.vocabulary), np.uint64)
        self.draws = rng.integers(0, 1 << 64, (REPETITIONS, 2 * longest), np.uint64) | np.uint64(1)
        self.classes = [_Class(g, self.hashes, self.draws, rng) for _, g in sorted(groups.items())]
        self.longest = longest
        self.memory = _Words(self.vocabulary)

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, edits, words of the item, end of the stretch in words) of each item within its edits in a text, where it fits best."""
        if not self.classes:
            return
        if len(self.memory) > REMEMBER:
            self.memory.clear()
        get = self.memory.__getitem__
        parts, bounds, size = [], [0], 0
        for t in texts:
            ids = np.array(list(map(get, t.split())), np.int64)
            ids = ids[ids >= 0]
            parts += [ids, np.full(1, EDGE)]
            size += len(ids) + 1
            bounds.append(size)
        flat, bounds = np.concatenate([*parts, np.full(3 * self.longest + 8, EDGE)]), np.array(bounds)
        known, hashed = np.concatenate([[0], np.cumsum(flat >= FIRST)]), self.hashes[flat]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for c in self.classes:
            begin = np.nonzero(known[c.least : c.least + size] - known[:size] >= c.needed)[0]
            pairs: set[tuple[int, int]] = set()
            for k, at, first, keys, order in c.repetitions:
                place, pos, j = begin, begin.copy(), 0
                seen: list[np.ndarray] = []
                for step in range(int(at[-1]) + 1):
                    if step == at[j]:
                        w = flat[pos]
                        seen.append(w)
                        j += 1
                        if j == 1:
                            keep = first[w]
                            place, pos, seen = place[keep], pos[keep], [w[keep]]
                        if j == len(at):
                            break
                    pos += ((hashed[pos] * self.draws[k][step]) >> np.uint64(63)).astype(np.int64)
                if not len(place):
                    continue
                key = mix_key(np.stack(seen, axis=1))
                lo, hi = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
                hit = np.nonzero(hi > lo)[0]
                for h in hit.tolist():
                    pairs.update((int(place[h]), int(i)) for i in order[lo[h] : hi[h]])
            for n, first, keys, who, offset in c.segments:
                place = np.nonzero(first[flat[:size]])[0]
                place = place[known[place + n] - known[place] == n]
                if not len(place):
                    continue
                key = mix_key(np.stack([flat[place + k] for k in range(n)], axis=1))
                lo, hi = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
                for h in np.nonzero(hi > lo)[0].tolist():
                    begins = int(bounds[np.searchsorted(bounds, place[h], side="right") - 1])
                    pairs.update((max(begins, int(place[h] - offset[x])), int(who[x])) for x in range(lo[h], hi[h]))
            places: dict[tuple[int, int], list[int]] = {}
            for p, i in sorted(pairs):
                places.setdefault((i, int(np.searchsorted(bounds, p, side="right")) - 1), []).append(p)
            for (i, d), held in places.items():
                item, w = c.items[i]
                k, at = allowed(len(w)), 0
                while at < len(held) and best.get((d, item), (1,))[0]:
                    to = bisect.bisect_right(held, held[at] + k, at)  # places within the edits of one another are one stretch
                    lo, hi = max(int(bounds[d]), held[at] - k), min(int(bounds[d + 1]) - 1, held[to - 1] + len(w) + k)
                    at = to
                    if known[hi] - known[lo] < len(w) - k:
                        continue
                    edits, end = edits_within(w, flat[lo:hi].tolist())
                    if edits <= k:
                        found = (edits, lo + end - int(bounds[d]), len(w))
                        best[d, item] = min(best.get((d, item), found), found)
        for (d, item), (edits, end, n) in sorted(best.items()):
            yield d, item, edits, n, end


class _Words(dict):
    """The number of a word as written; -1 for punctuation alone."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        w = raw.lower().strip(PUNCTUATION)
        out = self[raw] = self.vocabulary.get(w, OTHER) if w else -1
        return out


_INDEX: dict[str, Index] = {}


def _index(items: list[tuple[int, str | None]]) -> Index:
    """One a worker process, for the items last used."""
    name = xxhash.xxh64_hexdigest(repr(items))
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Index(items)
    return _INDEX[name]


def forget() -> None:
    """Workers are used again: what this one remembers of words goes, the index stays."""
    for index in _INDEX.values():
        index.memory.clear()


def item_blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items (id, text) in blocks of about BLOCK items and BLOCK_CHARS characters, dealt by a hash; an item longer than that is as long as it is."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, math.ceil(size.n / BLOCK), math.ceil(size.chars / BLOCK_CHARS))
    for n in range(blocks):
        yield sorted(((r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == n).collect()), key=repr)  # one block


def _searched(texts: list[str], held: list[tuple[int | None, str | None]]) -> Iterator[tuple[int, int, int, int, int]]:
    """What Index.search gives, for texts taken in groups of about CHUNK_WORDS words."""
    index, lo, size = _index([(i, t) for i, (_, t) in enumerate(held)]), 0, 0
    for i, t in enumerate(texts):
        size += len(t) // 5
        if size >= CHUNK_WORDS or i == len(texts) - 1:
            for text, *rest in index.search(texts[lo : i + 1]):
                yield lo + text, *rest
            lo, size = i + 1, 0


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, edits, item_words, end_word): each item found in each document, where it fits best.

    Texts and items that are null or have no word have no match. Items within
    a tenth of their words in edits count as found. Repeated rows match each;
    repeated items each; of places where an item fits equally well the first
    counts; an item without an id keeps its null; documents and items of any
    length count whole; empty tables give an empty result; extra columns are
    ignored. The benchmark is taken in blocks of about BLOCK items and
    BLOCK_CHARS characters, each against all documents.
    """
    kind, out = docs.schema[id_col].dataType.simpleString(), None
    for held in item_blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                rows = list(_searched([t or "" for t in b.column(1).to_pylist()], shared.value))
                cols = [pa.array([shared.value[r[1]][0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *cols], [id_col, "item_id", "edits", "item_words", "end_word"])
            forget()

        found = slim(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, item_id long, edits long, item_words long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no item is found, whole and as they are; a null text has no match and stays."""
    at, out = docs.columns.index(text_col), docs
    for held in item_blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                kept = np.ones(b.num_rows, bool)
                kept[[r[0] for r in _searched([t or "" for t in b.column(at).to_pylist()], shared.value)]] = False
                yield b.filter(pa.array(kept))
            forget()

        out = out.mapInArrow(run, docs.schema)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
