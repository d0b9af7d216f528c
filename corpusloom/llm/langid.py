"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Texts become hashed counts of letter n-grams (one to three letters, with word
edges), square-rooted and normalised. A linear SVM for each family, one
against the rest, chooses the family; within it a linear SVM for each pair of
languages casts a vote, margins breaking ties. The machines are trained here,
on a bounded sample of documents of each language. How far the deciding
machines are from a toss-up is the score; what score a document must have to
count as identified is learnt from a part of the sample that the machines at
that point have not seen.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, load, slim

DIM = 4096
#: Documents of each language, about, that the machines are trained on.
SAMPLE = 1_500
#: Documents of all languages together, about; of more than thirty languages each has its part of these.
SAMPLE_OF_ALL = 45_000
#: Characters of a text that are hashed at once.
CHUNK = 1 << 20
#: Share of known documents that may fall under the least score, the highest that it may be, and letters from which it holds in full.
LOST, HIGHEST, LETTERS = 0.002, 0.3, 100
UNDETERMINED = "und"

#: Families of languages by ISO 639-1 code. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
}


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _codes(text: str) -> Iterator[np.ndarray]:
    """The text's letters in lower case, and single blanks for all else, in parts of about CHUNK characters."""
    letters = _letters()
    for lo in range(0, len(text), CHUNK):
        u = np.frombuffer(text[lo : lo + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        yield np.where(letters[u], u, 32).astype(np.uint32)


def ngrams(text: str) -> np.ndarray | None:
    """Unit vector of the hashed n-grams of a whole text; None if it has no letter.

    Long texts are hashed in parts, the last two characters of a part going
    before the next, so that each n-gram counts once as in one piece.
    """
    counts, held, any_letter = np.zeros(DIM, np.int64), np.array([32], np.uint32), False
    first = True
    for part in itertools.chain(_codes(text), [np.array([32], np.uint32)]):
        c = np.concatenate([held, part])
        blank = c == 32
        c = c[~(blank & np.concatenate([[False], blank[:-1]]))]
        any_letter |= bool((c != 32).any())
        old = 0 if first else len(held)  # n-grams wholly within the held characters are counted already
        two, three = c[1:] + c[:-1] * np.uint32(0x9E3779B1), c[2:] + c[1:-1] * np.uint32(0x9E3779B1) + c[:-2] * np.uint32(0x85EBCA77)
        one = c[old:]
        for g in (one[one != 32] * np.uint32(0xC2B2AE3D), two[max(0, old - 1) :] * np.uint32(0x27D4EB2F), three[max(0, old - 2) :] * np.uint32(0x165667B1)):
            counts += np.bincount(((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=DIM)
        held, first = c[-2:], False
    if not any_letter:
        return None
    x = np.sqrt(counts.astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9)


class Sparse:
    """Vectors of `ngrams` by their coordinates that aren't zero; a few rows at a time become dense, with a one for the bias."""

    def __init__(self, at: list[np.ndarray], values: list[np.ndarray]) -> None:
        self.at, self.values = at, values

    def __len__(self) -> int:
        return len(self.at)

    def rows(self, which: np.ndarray) -> Sparse:
        return Sparse([self.at[i] for i in which.tolist()], [self.values[i] for i in which.tolist()])

    def dense(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), DIM + 1), np.float32)
        for r, i in enumerate(which.tolist()):
            out[r, self.at[i]] = self.values[i]
        out[:, DIM] = 1
        return out


def linear_svm(x: Sparse, y: np.ndarray, penalty: float = 1e-4, epochs: int = 12, seed: int = 5) -> np.ndarray:
    """Weights (bias last) of a linear SVM for y in {-1, 1}: averaged stochastic subgradients of the hinge loss, classes weighted alike."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * len(y)
    rng, w = np.random.default_rng(seed), np.zeros(DIM + 1, np.float32)
    mean, step, t0 = np.zeros_like(w), 0, 20.0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), 32):
            i = order[lo : lo + 32]
            some = x.dense(i)
            wrong = y[i] * (some @ w) < 1
            rate = 1 / (penalty * 1e3 * (t0 + step))
            w *= 1 - rate * penalty
            w += rate * ((share[i] * y[i] * wrong) @ some) / len(i)
            step += 1
            if epoch >= epochs // 2:
                mean += w
    return mean / max(1, step - step // epochs * (epochs // 2))


class Identifier:
    """The trained machines; predicts from vectors of `ngrams`."""

    least = 0.0  # the score from which a document counts as identified

    def __init__(self, x: Sparse, lang: list[str]) -> None:
        self.langs = sorted(set(lang))
        names = np.array(lang)
        of = {k: family(k) for k in self.langs}
        self.families = sorted(set(of.values()))
        fam = np.array([of[k] for k in lang])
        self.members = {f: [k for k in self.langs if of[k] == f] for f in self.families}
        self.family_w = np.array([linear_svm(x, np.where(fam == f, 1, -1).astype(np.float32)) for f in self.families]) if len(self.families) > 1 else None
        self.pair_w = {}
        for members in self.members.values():
            for a, b in itertools.combinations(members, 2):
                rows = np.nonzero((names == a) | (names == b))[0]
                self.pair_w[a, b] = linear_svm(x.rows(rows), np.where(names[rows] == a, 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) for each vector; the score is 0 for a toss-up in either step and nears 1 with the smaller of the two deciding margins."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        if self.family_w is None:
            at, sure = np.zeros(len(x), int), np.full(len(x), np.inf)
        else:
            margin = x @ self.family_w.T
            at = margin.argmax(axis=1)
            best = np.sort(margin, axis=1)
            sure = (best[:, -1] - best[:, -2]) / 2
        votes = {f: np.zeros((len(x), len(m))) for f, m in self.members.items()}
        least = {f: np.full((len(x), len(m)), np.inf) for f, m in self.members.items()}
        for (a, b), w in self.pair_w.items():
            f, m = family(a), x @ w
            i, j = self.members[f].index(a), self.members[f].index(b)
            votes[f][:, i] += (m >= 0) + 1e-3 * np.tanh(m)
            votes[f][:, j] += (m < 0) - 1e-3 * np.tanh(m)
            least[f][:, i], least[f][:, j] = np.minimum(least[f][:, i], m), np.minimum(least[f][:, j], -m)
        out = []
        for r, k in enumerate(at):
            f = self.families[k]
            best = int(votes[f][r].argmax())
            out.append((self.members[f][best], float(np.tanh(2 * max(0.0, min(sure[r], least[f][r, best]))))))
        return out


def least_score(x: Sparse, lang: list[str]) -> float:
    """The score that all but LOST of the documents have whose language machines trained on the others tell, HIGHEST at most."""
    held = np.arange(len(x)) % 5 == 0
    names = np.array(lang)
    if not held.any() or held.all():
        return 0.0
    machines, test = Identifier(x.rows(np.nonzero(~held)[0]), names[~held].tolist()), np.nonzero(held)[0]
    found = [r for lo in range(0, len(test), 2048) for r in machines.predict(x.dense(test[lo : lo + 2048])[:, :DIM])]
    right = [score for (k, score), true in zip(found, names[held].tolist(), strict=True) if k == true]
    return min(HIGHEST, 0.9 * float(np.quantile(right, LOST))) if right else 0.0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Identifier | None:
    """An identifier from a sample of about `sample` documents of each language, SAMPLE_OF_ALL at most, chosen by a hash of the id; None without any."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    span, sample = 1 << 30, min(sample, SAMPLE_OF_ALL // len(sizes))
    limit = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(span, int(span * sample / n)))) for k, n in sizes.items()))
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(span)) < limit).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, x) for k, t in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True) if (x := ngrams(t)) is not None]
            at = [np.nonzero(x)[0].astype(np.int16) for _, x in rows]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([x[a].tobytes() for (_, x), a in zip(rows, at, strict=True)], pa.binary())], ["lang", "at", "x"])

    rows = drawn.mapInArrow(run, "lang string, at binary, x binary").collect()  # about `sample` rows a language, SAMPLE_OF_ALL in all, each of a few thousand bytes
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    if not rows:
        return None
    x = Sparse([np.frombuffer(r["at"], np.int16) for r in rows], [np.frombuffer(r["x"], np.float32) for r in rows])
    lang = [r["lang"] for r in rows]
    model = Identifier(x, lang)
    model.least = least_score(x, lang)
    return model


def identify(docs: DataFrame, model: Identifier | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., lang_pred, score) for every row of docs.

    A text that is null or has no letter is `und` with score 0; so is every
    text if there was nothing to learn from. Texts of any length count whole.
    Languages that tie in votes and margins go by their order. Repeated rows
    and null ids are predicted each; an empty table gives an empty result;
    extra columns are ignored.
    """
    fixed = list(dict.fromkeys([id_col, *keep, text_col]))
    passed = [c for c in fixed if c in (id_col, *keep)]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # weights of a fixed size for each pair of languages
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                lang, score = [UNDETERMINED] * b.num_rows, [0.0] * b.num_rows
                vectors = [(i, x) for i, t in enumerate(b.column(fixed.index(text_col)).to_pylist()) if m and t and (x := ngrams(t)) is not None]
                if vectors:
                    for (i, _), (k, s) in zip(vectors, m.predict(np.array([x for _, x in vectors])), strict=True):
                        lang[i], score[i] = k, s
                yield pa.RecordBatch.from_arrays([*(b.column(fixed.index(c)) for c in passed), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*passed, "lang_pred", "score"])

    return slim(docs, *fixed).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in passed) + ", lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Identifier | None, text_col: str = "text", least: float | None = None) -> DataFrame:
    """The rows of docs whose text has letters and a language of at least the least score, whole and as they are.

    The least score is the model's own unless given; a text of fewer than
    LETTERS letters needs its part of it, as it has less to tell by. So texts
    half in one language and half in another, of unknown languages, or of
    random letters go, and null texts and those without a letter. Repeated
    rows stay or go each; an empty table stays empty. Without a model, which
    is to say without any known language to learn from, all rows with a letter
    stay.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)  # weights of a fixed size for each pair of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        floor = 0.0 if m is None else m.least if least is None else least
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                kept, texts = np.zeros(b.num_rows, bool), b.column(at).to_pylist()
                vectors = [(i, x) for i, t in enumerate(texts) if t and (x := ngrams(t)) is not None]
                if vectors:
                    letters = [sum(1 for _ in islice(filter(str.isalpha, texts[i]), LETTERS)) / LETTERS for i, _ in vectors]  # wherever in the text they are
                    kept[[i for i, _ in vectors]] = [s >= floor * k for (_, s), k in zip(m.predict(np.array([x for _, x in vectors])), letters, strict=True)] if m else True
                yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 3) != 1))
    return identify(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
