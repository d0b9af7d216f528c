"""Language-model scores: a hierarchical Pitman-Yor model with a context restaurant for every known word.

Three parts make one probability of a text. (1) Which sign follows a word: a
sign is a frequent word, the end, or "another word". Every word of the
training texts, and the start of a text, is a context with a restaurant of its
own; all of them share one parent, the restaurant of signs without a context.
Restaurants are distributed by their word, and grow with the corpus. (2) Which
other word it is: with c of the C other words that followed the word before,
it has (c + strength * p) / (C + strength). So a context tells all words apart,
not the signs alone; the two strengths, of contexts that are signs and of the
others, are those of the greatest leave-one-out likelihood. Here p, without
context, comes from one restaurant over all other words of the training texts.
(3) Its base is half uniform over them and half spells the word by a
hierarchical Pitman-Yor trigram model of the bytes of all distinct words. What the base has left is the probability of the event "a word that
training has not seen", one event as in the base score. So after any word the
probabilities of all known words, the end and that event sum to one, and a
score is the log10 probability of the whole text.

Seating is sampled by Gibbs (`pitman_yor`): given the parent's measure, the
context restaurants are independent, so each bucket of words seats its own,
and the sums of their tables by sign seat the parent. The sampled numbers are
hashes of words and steps: partitions change nothing. Predictive
probabilities are averaged over the kept sweeps.

Counts are merged within a task before they are shuffled, packed by a hash
bucket of the word they follow. To score, a task packs its texts' words by
bucket in the same way, each distinct word once, with the texts that have it
and the signs after it; a bucket meets the restaurants of its words, and sums
come back to the texts. Counts of pairs lie with the second word, so that p is at
hand there; what C takes from p is a factor that lies with the first. Which sign
follows a frequent word or the start never travels. A word of which a third of
all tokens consist is one row of at most as many counts as there are signs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, load, materialize, partitions, release, slim, tidy
from .mph import mix
from .pitman_yor import STRENGTH, PitmanYor, Restaurants, draw_tables, estimated_discount, gamma, uniform

#: Words that are signs of their own: the most frequent ones, ties by hash. It bounds the signs, neither the contexts nor what they tell apart.
FREQUENT = 1024
#: Rounds of seating contexts and parent in turn before the kept sweeps; sweeps over the contexts in a round; kept sweeps.
ROUNDS, SWEEPS, SAMPLES = 2, 1, 3
CHUNK_WORDS, CHUNK_ROWS = 3 << 18, 1 << 15
#: Tokens for each bucket of words, about.
BUCKET_TOKENS = 1 << 21
#: Occurrences in one stored pair; a word that a text has more often takes several pairs.
MOST = (1 << 16) - 1
UNIFORM = 0.5
#: Strengths of contexts over the other words, of which the likeliest are taken.
STRENGTHS = 2.0 ** np.arange(22)
#: Byte classes of the spelling table: at most the 256 bytes.
BYTES = 256
WORD, END = 0, 1


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _Ids(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


#: The start of a text as a context: the hash of the empty word, which no text has.
START = int(hashes([b""])[0])


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[bytes]]]:
    """Slices of the batches of about CHUNK_WORDS words: the rows, the numbers of each text's words, the distinct words by number."""
    for b in batches:
        lo, size, arrays, ids = 0, 0, [], _Ids()
        for i, t in enumerate(b.column(column)):
            words = split(t.as_py())
            arrays.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
            size += len(words) + 1
            if size >= CHUNK_WORDS or i + 1 - lo >= CHUNK_ROWS or i == b.num_rows - 1:
                yield b.slice(lo, i + 1 - lo), arrays, list(ids)
                lo, size, arrays, ids = i + 1, 0, [], _Ids()
    tidy()


def spelling_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, word) of the byte trigrams of words, each ended by a blank, two blanks before it."""
    flat = np.frombuffer(b"  " + b"  ".join(words) + b" ", np.uint8).astype(np.int64)
    key = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
    inner = (key & 0xFFFF) != 0x2020
    starts = (flat[:-2] == 32) & (flat[1:-1] == 32) & (flat[2:] != 32)
    return key[inner], (np.cumsum(starts) - 1)[inner]


class Spelling:
    """log10 probabilities of byte strings that end in a blank, from a table over the classes of bytes that occur.

    Bytes that never occur share one class, each with the model's probability of an unseen byte.
    """

    def __init__(self, key: np.ndarray, count: np.ndarray) -> None:
        model, seen = PitmanYor(key, count, BYTES, 3), np.unique(np.concatenate([key >> 16, key >> 8 & 255, key & 255]))
        unseen = np.setdiff1d(np.arange(BYTES), seen)
        stand_in = np.append(seen, unseen[:1])
        self.classes = np.full(BYTES, len(seen), np.int64)
        self.classes[seen] = np.arange(len(seen))
        self.size = len(stand_in)
        self.table = np.empty(self.size**3, np.float32)
        for i, a in enumerate(stand_in):
            grid = (a << 16) + (stand_in[:, None] << 8) + stand_in[None, :]
            self.table[i * self.size**2 : (i + 1) * self.size**2] = np.log10(model.probability(grid.ravel()))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        key, word = spelling_keys(words)
        at = (self.classes[key >> 16] * self.size + self.classes[key >> 8 & 255]) * self.size + self.classes[key & 255]
        return np.bincount(word, self.table[at].astype(np.float64), len(words))


@dataclass
class Model:
    lexicon: DataFrame | None  # (bucket, h, word, c, signs, counts, signs_before, times_before, others_before, others_times), a row a known word and one for the start
    buckets: int
    tokens: int
    types: int
    ends: int
    frequent: np.ndarray  # hashes, sorted
    frequent_count: np.ndarray
    spelling: Spelling | None
    rare_tokens: int
    rare_types: int
    context_discount: float
    rare_discount: float
    measures: list[np.ndarray]  # of the signs: one for burning in, then one for each kept sweep
    rare_y: list[float]
    log_next: np.ndarray | None  # log10 P(sign | frequent word or start), float32
    free: float = STRENGTH  # the mean weight that the restaurant of other words leaves to its base
    unseen: float = 1.0  # the base's probability of a word that training has not seen
    pairs: tuple[float, float] | None = None  # strength over the other words of a context that is one of them, and of a sign or the start; None: contexts tell signs apart alone

    def light(self) -> Model:
        """What tasks need: of fixed size, without the distributed restaurants."""
        return Model(**(self.__dict__ | {"lexicon": None}))

    @property
    def alphabet(self) -> int:
        return len(self.frequent) + 2

    def signs(self, h: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
        return np.where(self.frequent[at] == h, at, len(self.frequent))

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.types + 1))

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """Probabilities of the words by spelling; 257 equal symbols where nothing was learnt."""
        if self.spelling is None:
            return np.array([257.0 ** -(len(w) + 1) for w in words])
        return 10.0 ** self.spelling(words)


def _flat(arrays: list[np.ndarray], first: int, sign_of: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, number of the word before, sign) of all tokens of the texts in order; `first` stands before each text, the end closes it."""
    size = np.array([len(a) + 1 for a in arrays], np.int64)
    ends, flat = np.cumsum(size), np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    inner = np.ones(int(size.sum()), bool)
    before, sign = np.full(len(inner), first, np.int64), np.full(len(inner), end, np.int64)
    inner[ends - size] = False
    before[inner] = flat
    inner[:] = True
    inner[ends - 1] = False
    sign[inner] = sign_of[flat]
    return size, before, sign


def _packed(*arrays: np.ndarray) -> bytes:
    """The arrays as bytes, compressed: most hold small numbers."""
    data = b"".join(len(a).to_bytes(4, "little") + a.tobytes() for a in arrays)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    data, out, at = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), [], 0
    for kind in kinds:
        n, at = int.from_bytes(data[at : at + 4], "little"), at + 4
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


#: The parts of packed counts, of a packed bucket of texts, of packed sums, and of a chunk's own sums.
FOLLOW = ["<i8", "<u4", "<u1", "<u2", "<u2", "<u4", "<u2", "<u2", "<u4", "<u4", "<i8", "<u4"]
BUCKET = ["<i8", "<u4", "<u2", "<u2", "<u2", "<u2", "<u4", "<i8", "<u2"]
SUMS = ["<u2", "<i8", "<f8", "<f8"]
OWN = ["<i8", "<i8", "<f8", "<f8"]


def fit(docs: DataFrame, text_col: str = "text", frequent: int | None = None) -> Model:
    """The model of all texts of docs. A null text is empty; without any row all probability is spelling's.

    frequent: the caller's own limit on the words that a context tells apart; None: it tells all apart.
    """
    texts, signs = slim(docs, text_col), FREQUENT if frequent is None else frequent

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, arrays, words in chunks(batches, 0):
            h, c = hashes(words), np.bincount(np.concatenate(arrays), minlength=len(words))
            kind = np.repeat(np.array([WORD, END], np.int32), [len(h), 1])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.append(h, 0)), pa.array(np.append(c, rows.num_rows))], ["kind", "h", "c"])

    counts = materialize(texts.mapInArrow(count, "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c")), "word-counts")
    words = counts.where(f"kind = {WORD}").select("h", "c")
    ends = counts.where(f"kind = {END}").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first().n
    tokens, types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = sorted(map(tuple, words.orderBy(F.desc("c"), "h").limit(signs).collect()))  # `signs` rows
    model = Model(
        lexicon=None, buckets=max(partitions(docs.sparkSession), -(-(tokens + ends) // BUCKET_TOKENS)), tokens=tokens + ends, types=types + (ends > 0), ends=ends,
        frequent=np.array([h for h, _ in top], np.int64), frequent_count=np.array([c for _, c in top], np.int64), spelling=None,
        rare_tokens=tokens - sum(c for _, c in top), rare_types=types - len(top), context_discount=0.5, rare_discount=0.5, measures=[], rare_y=[], log_next=None,
        pairs=(1.0, 1.0) if frequent is None else None,
    )
    model.lexicon = materialize(_lexicon(texts, model), "lexicon")
    _seat(model)
    release(counts)  # and what was shuffled for the lexicon, which by now nothing refers to
    return model


def _lexicon(texts: DataFrame, model: Model) -> DataFrame:
    """For each word, and the start, how often which sign follows it (signs, counts); for each other word how often it follows which sign or the start, and which other word."""
    shared, buckets, size = texts.sparkSession.sparkContext.broadcast(model.light()), model.buckets, model.alphabet  # of fixed size

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, arrays, words in chunks(batches, 0):
            words.append(b"")
            h = hashes(words)
            sign_of = shared.value.signs(h)
            _, before, sign = _flat(arrays, len(words) - 1, sign_of, size - 1)
            sort = np.lexsort((h, h % buckets))  # by bucket, by hash within it; as pmod
            place = np.empty(len(h), np.int64)
            place[sort] = np.arange(len(h))
            h, first = h[sort], place[before]
            sign_of[-1] = size - 1  # of the start before a text
            other, second = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if shared.value.pairs:
                other, flat = np.nonzero(sign == size - 2)[0], np.concatenate(arrays)
                second = place[flat[sign_of[flat] == size - 2]]
            sign_before = sign_of[before[other]]
            by_sign = sign_before != size - 2
            near, c_near = np.unique(second[by_sign] * size + sign_before[by_sign], return_counts=True)
            far, c_far = np.unique(second[~by_sign] * len(h) + first[other[~by_sign]], return_counts=True)
            near_owner, far_owner = near // size, far // len(h)
            near, far = (near % size).astype("<u2"), h[far % len(h)]
            each_near, each_far = np.bincount(near_owner, minlength=len(h)).astype("<u2"), np.bincount(far_owner, minlength=len(h)).astype("<u4")
            pair, c = np.unique(first * size + sign, return_counts=True)
            owner, sign = pair // size, (pair % size).astype("<u2")
            each = np.bincount(owner, minlength=len(h)).astype("<u2")
            held = [words[i] for i in sort.tolist()]
            long_words = np.array(list(map(len, held)), "<u4")
            of = h % buckets
            cuts = np.concatenate([[0], np.nonzero(np.diff(of))[0] + 1, [len(of)]])
            ends = np.array([np.searchsorted(x, cuts) for x in (owner, near_owner, far_owner)])
            rows = []
            for lo, hi, (at, n_at, f_at), (to, n_to, f_to) in zip(cuts[:-1], cuts[1:], ends.T[:-1], ends.T[1:], strict=True):
                follows = h[lo:hi].astype("<i8"), long_words[lo:hi], np.frombuffer(b"".join(held[lo:hi]), "<u1"), each[lo:hi], sign[at:to], c[at:to].astype("<u4")
                precede = each_near[lo:hi], near[n_at:n_to], c_near[n_at:n_to].astype("<u4"), each_far[lo:hi], far[f_at:f_to].astype("<i8"), c_far[f_at:f_to].astype("<u4")
                rows.append((int(of[lo]), _packed(*follows, *precede)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])

    def merge(table: pa.Table) -> pa.Table:
        parts = [_unpacked(p.as_py(), FOLLOW) for p in table.column("payload")]
        h = np.concatenate([p[0] for p in parts])
        long_words, each = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 3))
        letters = np.concatenate([p[2] for p in parts]).tobytes()
        sign, c = np.concatenate([p[4] for p in parts]).astype(np.int64), np.concatenate([p[5] for p in parts]).astype(np.int64)
        known, first, of = np.unique(h, return_index=True, return_inverse=True)
        pair, at = np.unique(np.repeat(of, each) * size + sign, return_inverse=True)
        n = np.bincount(at, c, len(pair)).astype("<i8")
        owner = pair // size
        starts = np.cumsum(long_words) - long_words
        signs, counts = (pair % size).astype("<u2").tobytes(), n.tobytes()
        words = [letters[a : a + k] for a, k in zip(starts[first].tolist(), long_words[first].tolist(), strict=True)]
        bounds = lambda owner: itertools.pairwise(np.searchsorted(owner, np.arange(len(known) + 1)).tolist())
        near, far, c_near, c_far = (np.concatenate([p[i] for p in parts]) for i in (7, 10, 8, 11))
        near, at = np.unique(np.repeat(of, np.concatenate([p[6] for p in parts])) * size + near, return_inverse=True)
        near_owner, near, c_near = near // size, (near % size).astype("<u2").tobytes(), np.bincount(at, c_near, len(near)).astype("<u4").tobytes()
        far_owner = np.repeat(of, np.concatenate([p[9] for p in parts]))
        sort = np.lexsort((far, far_owner))
        far_owner, far = far_owner[sort], far[sort]
        new = np.nonzero(np.append(True, (np.diff(far_owner) != 0) | (np.diff(far) != 0))[: len(far)])[0]
        c_far = (np.add.reduceat(c_far[sort], new) if len(new) else c_far).astype("<u4").tobytes()
        far_owner, far = far_owner[new], far[new].tobytes()
        parted = lambda data, owner, width: pa.array([data[width * a : width * z] for a, z in bounds(owner)], pa.binary())
        out = pa.table({
            "bucket": pa.array(np.full(len(known), table.column("bucket")[0].as_py(), np.int32)), "h": pa.array(known), "word": pa.array(words, pa.binary()), "c": pa.array(np.bincount(owner, n, len(known)).astype(np.int64)),
            "signs": parted(signs, owner, 2), "counts": parted(counts, owner, 8),
            "signs_before": parted(near, near_owner, 2), "times_before": parted(c_near, near_owner, 4), "others_before": parted(far, far_owner, 8), "others_times": parted(c_far, far_owner, 4),
        })
        tidy()
        return out

    packed = texts.mapInArrow(follow, "bucket int, payload binary")
    return packed.groupBy("bucket").applyInArrow(merge, "bucket int, h long, word binary, c long, signs binary, counts binary, signs_before binary, times_before binary, others_before binary, others_times binary")


def _lists(column: pa.ChunkedArray | pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the packed lists of a column."""
    held = column.to_pylist()
    return np.repeat(np.arange(len(held)), np.array(list(map(len, held)), np.int64) // np.dtype(kind).itemsize), np.frombuffer(b"".join(held), kind)


def _left_out(rows: pa.RecordBatch, model: Model, contexts: _Contexts) -> np.ndarray:
    """What the rows add to the leave-one-out log likelihood of the other words, by each of STRENGTHS: of contexts that are other words, then of signs and the start."""
    out, c, sign = np.zeros((2, len(STRENGTHS))), rows.column("c").to_numpy(), len(model.frequent)
    strength = STRENGTHS[:, None]
    for kind, column in enumerate(("others_times", "times_before")):
        row, n = _lists(rows.column(column), "<u4")
        many = n > 1  # of the others, log p does not depend on the strength
        out[kind] += (len(n) - many.sum()) * np.log(STRENGTHS)
        p, n = c[row[many]] / model.rare_tokens, n[many].astype(float)
        for lo in range(0, len(n), 1 << 16):
            out[kind] += np.log(n[lo : lo + (1 << 16)] - 1 + strength * p[lo : lo + (1 << 16)]) @ n[lo : lo + (1 << 16)]
    before = contexts.sign == sign
    is_sign = ((model.signs(contexts.h) < sign) | (contexts.h == START))[contexts.of[before]]
    for kind in (0, 1):
        n = contexts.seats.c[before][is_sign == kind]
        for lo in range(0, len(n), 1 << 16):
            out[kind] -= np.log(n[lo : lo + (1 << 16)] - 1 + strength) @ n[lo : lo + (1 << 16)]
    return out.ravel()


class _Others:
    """Some of the other words, in memory: dishes of the one restaurant that all of them share."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, model: Model) -> None:
        h = rows.column("h").to_numpy()
        self.model, self.at = model, np.nonzero((model.signs(h) == len(model.frequent)) & (h != START))[0]
        self.words, self.c, self.h = rows.column("word"), rows.column("c").to_numpy()[self.at], h.view(np.uint64)[self.at]
        self.many = np.nonzero(self.c > 1)[0]  # the others have one table each

    def base(self, which: np.ndarray) -> np.ndarray:
        words = self.words.take(pa.array(self.at[which])).to_pylist()
        return UNIFORM / (self.model.rare_types + 1) + (1 - UNIFORM) * self.model.spelled(words)

    def several_tables(self, ys: list[float], steps: list[int]) -> np.ndarray:
        """The mean tables of the dishes with several customers, over draws with the given y and step."""
        d, key = self.model.rare_discount, mix(self.h[self.many], 9)
        log_base = np.log(d * self.base(self.many))
        return np.mean([draw_tables(self.c[self.many], log_base + math.log(y), d, uniform(key, 1000 * k)) for y, k in zip(ys, steps, strict=True)], axis=0)

    def tables(self, y: float, step: int) -> float:
        """All tables, in one draw."""
        return float(len(self.c) - len(self.many) + self.several_tables([y], [step]).sum())

    def mean_tables(self) -> np.ndarray:
        """Each dish's mean tables over the kept draws."""
        out = np.ones(len(self.c))
        out[self.many] = self.several_tables(self.model.rare_y, [200 + s for s in range(SAMPLES)])
        return out


class _Contexts:
    """The context restaurants of some rows of the lexicon, in memory."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, model: Model) -> None:
        self.model, self.h = model, rows.column("h").to_numpy()
        signs = rows.column("signs").to_pylist()
        self.sign = np.frombuffer(b"".join(signs), "<u2").astype(np.int64)
        n = np.frombuffer(b"".join(rows.column("counts").to_pylist()), "<i8")
        self.of = np.repeat(np.arange(len(self.h)), np.array(list(map(len, signs)), np.int64) // 2)
        name = self.h.view(np.uint64)
        self.seats = Restaurants(self.of, n, mix(name[self.of] ^ mix(self.sign, 5), 6), mix(name, 4), model.context_discount)

    def sweep(self, measure: np.ndarray, step: int) -> None:
        self.seats.sweep(measure[self.sign], step)

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """(each pair's own mean weight, each context's weight left to each kept measure) of the kept sweeps."""
        for k in range(SWEEPS):
            self.sweep(self.model.measures[0], 100 + k)
        own, left = np.zeros(len(self.of)), np.zeros((len(self.h), SAMPLES))
        for s in range(SAMPLES):
            self.sweep(self.model.measures[s + 1], 200 + s)
            weight, rest = self.seats.weights()
            own += weight / SAMPLES
            left[:, s] = rest / SAMPLES
        return own, left

    def left_to_others(self, strength: float) -> np.ndarray:
        """What each context leaves to the probability of other words without a context."""
        other = self.sign == len(self.model.frequent)
        return strength / (strength + np.bincount(self.of[other], self.seats.c[other], len(self.h)))


def _sums(model: Model, columns: list[str], step: Callable[[pa.RecordBatch, Model], dict[str, tuple[np.ndarray, np.ndarray]]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sums over the lexicon of what `step` gives for each batch of it: keys and numbers by kind.

    Keys are signs, byte trigrams (at most 2^24, tens of thousands in practice) and a few totals.
    """
    shared = model.lexicon.sparkSession.sparkContext.broadcast(model.light())  # of fixed size: signs, measures and byte trigrams

    def merged(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(key, return_inverse=True)
        return key, np.bincount(at, n, len(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            if b.num_rows:
                for kind, (key, n) in step(b, shared.value).items():
                    held = total.get(kind, (np.zeros(0, np.int64), np.zeros(0)))
                    total[kind] = merged(np.concatenate([held[0], key]), np.concatenate([held[1], n]))
        for kind, (key, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n.astype(np.float64))], ["kind", "key", "n"])
        tidy()

    summed = model.lexicon.select(*columns).mapInArrow(run, "kind string, key long, n double")
    rows = sorted(map(tuple, summed.groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()))
    return {kind: (np.array([r[1] for r in held]), np.array([r[2] for r in held])) for kind, group in itertools.groupby(rows, key=lambda r: r[0]) for held in [list(group)]}


def _seat(model: Model) -> None:
    """Rounds of seating the contexts given the parent's measure, and the parent given their tables; then the kept measures."""
    size, whole = model.alphabet, ["h", "word", "c", "signs", "counts"]
    if not model.tokens:
        model.measures, model.log_next = [np.full(size, 1 / size)] * (SAMPLES + 1), np.full((size, size), -math.log10(size), np.float32)
        return

    def survey(b: pa.RecordBatch, m: Model) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        contexts, others = _Contexts(b, m), _Others(b, m)
        words = [w for w, h in zip(b.column("word").to_pylist(), contexts.h.tolist(), strict=True) if h != START]
        spelled, sign = spelling_keys(words)[0] if words else np.zeros(0, np.int64), contexts.sign
        few = lambda x: (np.minimum(x, 3).astype(np.int64), np.ones(len(x)))
        likely = {"pairs": (np.arange(2 * len(STRENGTHS)), _left_out(b, m, contexts))} if m.pairs else {}
        return {"spelling": (spelled, np.ones(len(spelled))), "signs": (sign, np.ones(len(sign))), "contexts": few(contexts.seats.c), "others": few(others.c)} | likely

    found = _sums(model, [*whole, "times_before", "others_times"], survey)
    dense = lambda kind, n: np.bincount(*found[kind], n) if kind in found else np.zeros(n)
    if model.pairs:
        model.pairs = tuple(STRENGTHS[np.argmax(dense("pairs", 2 * len(STRENGTHS)).reshape(2, -1), axis=1)].tolist())
    if "spelling" in found:
        model.spelling = Spelling(*found["spelling"])
    once, rarely = dense("contexts", 4), dense("others", 4)
    model.context_discount, model.rare_discount = estimated_discount(once[1], once[2]), estimated_discount(rarely[1], rarely[2])
    customers, tables, rare = dense("signs", size), np.ones(size), rarely.sum()
    names, equal = mix(np.arange(size), 12), np.full(size, 1 / size)

    def measure(c: np.ndarray, step: int) -> np.ndarray:
        """Of the signs, drawn from the parent, seated anew with the contexts' tables as customers."""
        nonlocal tables
        parent = Restaurants(np.zeros(size, np.int64), np.maximum(c, 1e-9), names, names[:1], 0.5)
        parent.t = np.minimum(tables, parent.c)
        parent.sweep(equal, step)
        tables = parent.t
        return parent.measure(equal, step)

    def others_y(tables: float, step: int) -> float:
        return float(gamma(np.array([STRENGTH / model.rare_discount + tables]), np.array([step], np.uint64), 77)[0])

    for turn in range(1, ROUNDS + 1):
        now, y = measure(customers, turn), others_y(rare, turn)

        def seat(b: pa.RecordBatch, m: Model, now: np.ndarray = now, y: float = y, turn: int = turn) -> dict[str, tuple[np.ndarray, np.ndarray]]:
            contexts = _Contexts(b, m)
            for k in range(SWEEPS):
                contexts.sweep(now, 10 * turn + k)
            return {"signs": (contexts.sign, contexts.seats.t), "others": (np.zeros(1, np.int64), np.array([_Others(b, m).tables(y, 10 * turn)]))}

        found = _sums(model, whole, seat)
        customers, rare = dense("signs", size), float(dense("others", 1)[0])
    model.measures = [measure(customers, 50 + s) for s in range(SAMPLES + 1)]
    model.rare_y = [others_y(rare, 60 + s) for s in range(SAMPLES)]

    def settle(b: pa.RecordBatch, m: Model) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        others = _Others(b, m)
        return {"others": (np.arange(2), np.array([others.mean_tables().sum(), others.base(np.arange(len(others.c))).sum()]))}

    found = _sums(model, ["h", "word", "c"], settle)
    total, base = dense("others", 2)
    model.free, model.unseen = STRENGTH + model.rare_discount * float(total), max(1e-12, 1 - float(base))
    top = model.lexicon.where(F.col("h").isin([*model.frequent.tolist(), START])).select(*whole).toArrow()  # the frequent words and the start: at most (frequent + 2) squared counts
    contexts = _Contexts(top, model)
    own, left = contexts.settle()
    p = left @ np.array(model.measures[1:])
    p[contexts.of, contexts.sign] += own
    if model.pairs:
        p[:, -2] *= contexts.left_to_others(model.pairs[1])
    table = np.tile(np.mean(model.measures[1:], axis=0), (size, 1))  # a context that training has not seen
    table[np.where(contexts.h == START, size - 1, model.signs(contexts.h))] = p
    model.log_next = np.log10(table).astype(np.float32)


def _counts(keys: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The n of the sorted key that each wanted one equals; 0 where none does."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, n[at], 0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row of docs.

    n_tokens counts the words and one end; n_known those seen in training;
    base_score is the sum of log10((c+1)/(N+V+1)); score is the model's log10
    probability of the whole text, perplexity being 10 ** (-score /
    n_tokens). A null text is empty and has its end alone; texts of any length
    are scored whole. Repeated rows, ties and null ids are scored each; an
    empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    each_doc = model.tokens / max(1, model.ends)
    buckets = max(model.buckets, math.ceil(docs.count() * each_doc / BUCKET_TOKENS))
    shared = spark.sparkContext.broadcast(model.light())  # of fixed size: the frequent words' table, measures and byte trigrams
    field = docs.schema[id_col]
    kind = field.dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rare_sign, end = len(m.frequent), len(m.frequent) + 1
        known = np.concatenate([m.frequent_count, [0], [m.ends]])
        base = np.where(np.arange(end + 1) == rare_sign, 0.0, m.log_base(known))
        part = TaskContext.get().partitionId() << 32
        for number, (rows, arrays, words) in enumerate(chunks(batches, 1)):
            chunk, h = part | number, hashes(words)
            sign_of = m.signs(h)
            size, first, sign = _flat(arrays, len(words), sign_of, end)
            before = np.append(sign_of, end)[first]
            doc = np.repeat(np.arange(len(arrays)), size)
            here = np.where(before == rare_sign, 0.0, m.log_next[before, sign])
            own = _packed(size.astype("<i8"), np.bincount(doc, known[sign] > 0, len(size)).astype("<i8"), np.bincount(doc, base[sign], len(size)), np.bincount(doc, here, len(size)))
            out = [(-1 - chunk % buckets, rows.column(0).to_pylist(), own)]
            is_rare = sign == rare_sign
            if is_rare.any():
                after, flat = np.append(sign[1:], 0)[is_rare], np.concatenate(arrays)
                before, first = before[is_rare], first[is_rare]
                rare = np.nonzero(sign_of == rare_sign)[0]
                sort = rare[np.lexsort((h[rare], h[rare] % buckets))]  # by bucket, by hash within it
                place = np.zeros(len(h), np.int64)
                place[sort] = np.arange(len(sort))
                h, every, word = h[sort], h, place[flat[sign_of[flat] == rare_sign]]
                far = np.nonzero(before == rare_sign)[0] if m.pairs else np.zeros(0, np.int64)
                far = far[np.argsort(word[far], kind="stable")]
                far_word, far_text, far = word[far], doc[is_rare][far].astype("<u2"), every[first[far]].astype("<i8")
                each_far = np.bincount(far_word, minlength=len(h)).astype("<u4")
                if not m.pairs:
                    before = np.full(len(before), end)
                pair, n = np.unique(((word * len(size) + doc[is_rare]) * (end + 1) + after) * (end + 1) + before, return_counts=True)
                while (n > MOST).any():
                    more = n > MOST
                    pair, n = np.concatenate([pair, pair[more]]), np.concatenate([np.minimum(n, MOST), n[more] - MOST])
                    again = np.argsort(pair, kind="stable")
                    pair, n = pair[again], n[again]
                pair, before, n = pair // (end + 1), (pair % (end + 1)).astype("<u2"), n.astype("<u2")
                pair, after = pair // (end + 1), (pair % (end + 1)).astype("<u2")
                word, text = pair // len(size), (pair % len(size)).astype("<u2")
                each = np.bincount(word, minlength=len(h)).astype("<u4")
                of = h % buckets
                cuts = np.concatenate([[0], np.nonzero(np.diff(of))[0] + 1, [len(of)]])
                ends = np.array([np.searchsorted(x, cuts) for x in (word, far_word)])
                for lo, hi, (at, f_at), (to, f_to) in zip(cuts[:-1], cuts[1:], ends.T[:-1], ends.T[1:], strict=True):
                    out.append((int(of[lo]), None, _packed(h[lo:hi].astype("<i8"), each[lo:hi], text[at:to], after[at:to], n[at:to], before[at:to], each_far[lo:hi], far[f_at:f_to], far_text[f_at:f_to])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(rows.schema.field(0).type)), pa.array([x[2] for x in out], pa.binary())],
                ["chunk", "bucket", "ids", "payload"],
            )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or left.column("bucket")[0].as_py() < 0:
            return left.select(["chunk", "ids", "payload"])
        m = shared.value
        rows, size, total, measures = right.sort_by("h"), m.alphabet, STRENGTH + m.rare_tokens, np.array(m.measures[1:])
        seats, others = _Contexts(rows, m), _Others(rows, m)
        own, rest = seats.settle() if len(seats.h) else (np.zeros(0), np.zeros((0, SAMPLES)))
        # the last row stands for words that training has not seen
        known = np.append((others.c - m.rare_discount * others.mean_tables() + m.free * others.base(np.arange(len(others.c)))) / total if len(seats.h) else np.zeros(0), m.free * m.unseen / total)
        count, rest = np.append(others.c, 0).astype(float), np.vstack([rest, np.full((1, SAMPLES), 1 / SAMPLES)])
        pair = seats.of * size + seats.sign
        parts = [_unpacked(x.as_py(), BUCKET) for x in left.column("payload")]
        words, each, text, after, n, before, each_far, far, far_text = (np.concatenate([p[i] for p in parts]) for i in range(9))
        row = np.minimum(np.searchsorted(seats.h, words), max(0, len(seats.h) - 1))
        row = np.where(seats.h[row] == words, row, len(seats.h)) if len(seats.h) else np.zeros(len(words), np.int64)
        seen, p_word, b_word = row < len(seats.h), np.log10(known)[row], m.log_base(count[row])
        per = np.repeat(np.arange(len(words)), each)
        own = np.append(own, 0.0)
        key = row[per] * size + after
        at = np.minimum(np.searchsorted(pair, key), max(0, len(pair) - 1))
        hit = pair[at] == key if len(pair) else np.zeros(len(key), bool)
        follows = np.where(hit, own[at], 0.0) + np.einsum("ij,ji->i", rest[row[per]], measures[:, after])
        value, n = np.log10(follows), n.astype(float)
        whose = np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts]) << 16 | text
        whose, of = np.unique(whose, return_inverse=True)
        far_value = np.zeros(0)
        if m.pairs:
            log_left = np.log10(np.append(seats.left_to_others(m.pairs[0]), 1.0))
            value += np.where(after == size - 2, log_left[row[per]], 0.0)
            owner, sign = _lists(rows.column("signs_before"), "<u2")
            times = _counts(owner * size + sign, _lists(rows.column("times_before"), "<u4")[1], row[per] * size + before)
            value += np.where(before == size - 2, 0.0, np.log10(known[row[per]] + times / m.pairs[1]))  # where an other word comes before, see below
            owner, first = _lists(rows.column("others_before"), "<i8")
            far_row, name = np.repeat(row, each_far), np.append(seats.h, 0).view(np.uint64)
            of_pair = lambda row, first: mix(name[row] ^ mix(first.view(np.uint64), 5), 6)
            held, stored = of_pair(owner, first), _lists(rows.column("others_times"), "<u4")[1]
            sort = np.argsort(held)
            times = np.where(far_row < len(seats.h), _counts(held[sort], stored[sort], of_pair(far_row, far)), 0)
            far_value = np.log10(known[far_row] + times / m.pairs[0])
        else:
            value += p_word[per]
        far_of = np.searchsorted(whose, np.repeat(np.arange(len(parts)), [len(p[8]) for p in parts]) << 16 | far_text)
        sums = [np.bincount(of, seen[per] * n, len(whose)).astype("<i8"), np.bincount(of, b_word[per] * n, len(whose)), np.bincount(of, value * n, len(whose)) + np.bincount(far_of, far_value, len(whose))]
        cuts = np.searchsorted(whose >> 16, np.arange(len(parts) + 1))
        text = (whose & 0xFFFF).astype("<u2")
        payload = [_packed(text[lo:hi], *(x[lo:hi] for x in sums)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        out = pa.table({"chunk": left.column("chunk"), "ids": pa.nulls(len(parts), left.schema.field("ids").type), "payload": pa.array(payload, pa.binary())})
        tidy()
        return out

    packed = slim(docs, id_col, text_col).mapInArrow(local, f"chunk long, bucket long, ids array<{kind}>, payload binary")
    lexicon = model.lexicon.where(~F.col("h").isin([*model.frequent.tolist(), START])).select(F.pmod("h", F.lit(buckets)).cast("long").alias("bucket"), *model.lexicon.columns[1:])
    back = packed.groupBy("bucket").cogroup(lexicon.groupBy("bucket")).applyInArrow(meet, f"chunk long, ids array<{kind}>, payload binary")

    def join(table: pa.Table) -> pa.Table:
        own = table.filter(pa.compute.is_valid(table.column("ids")))
        ids = own.column("ids").combine_chunks().flatten()
        size, known, base, value = (x.copy() for x in _unpacked(own.column("payload")[0].as_py(), OWN))
        for data in table.filter(pa.compute.is_null(table.column("ids"))).column("payload").to_pylist():
            text, n, b, s = _unpacked(data, SUMS)
            known[text] += n
            base[text] += b
            value[text] += s
        return pa.table([ids, pa.array(size), pa.array(known), pa.array(base), pa.array(value)], [id_col, "n_tokens", "n_known", "base_score", "score"])

    return back.groupBy("chunk").applyInArrow(join, f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 7) != 2))
    scored = score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
