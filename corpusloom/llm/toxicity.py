"""Toxicity scores: a learned lexicon, misspellings by Levenshtein automata, context windows, logistic regression.

The lexicon comes from labelled documents: every beginning of a word is a trie
node, and nodes that stand out in toxic documents by their log-likelihood
ratio become terms, the strongest of each branch alone. A word that is a term,
begins with one, or is within the term's edits of one is a hit. Each hit is
seen in its context window. Only what stands inside quotation marks, or in a
line that begins with the mark of a quoted reply, is a quotation, and wholly
one if a word of reporting is in the window too; such hits count apart and
little. A word of reporting alone excuses nothing ("I said you are an ...").
Hits that stand close together add up in the window's score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import LexiconAutomaton
from .common import fold, load, slices, slim

#: Labelled documents at most that lexicon and weights are learned from, chosen by a hash of their ids.
SAMPLE = 20_000
TERMS = 400
#: A node becomes a term from this log-likelihood ratio (about one false term in ten thousand nodes and rarer) and number of toxic documents on.
LEAST_RATIO, LEAST_DOCS = 16.0, 3
STEM = (4, 10)
WINDOW = 6
#: What a hit still counts in its window's score inside quotation marks, and there beside a word of reporting.
QUOTED, REPORTED = 0.5, 0.25
REMEMBER = 200_000

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’‚…–—¡¿|"
OPENING, CLOSING, STRAIGHT = "“„«", "”»", '"'
#: Words of reporting, in the languages at hand; a default that callers may replace.
REPORTING = frozenset("said says saying called calls wrote writes quote quoted quotes reported term word dit disait écrit appelé sagte sagt schrieb nannte wort zitat dijo dice llamó escribió palabra".split())
NAMES = ("direct", "direct_rate", "quoted", "near", "near_rate", "begun", "begun_rate", "kinds", "window", "ratio", "log_words")


def nodes(text: str) -> Counter:
    """Occurrences of each trie node in a text: beginnings of words, and short words whole."""
    out: Counter = Counter()
    for word, n in Counter(w.strip(PUNCTUATION) for w in text.lower().split()).items():
        if 2 <= len(word) < STEM[0]:
            out[word + "$"] += n
        for k in range(STEM[0], min(len(word), STEM[1]) + 1):
            out[word[:k]] += n
    return out


def learn_lexicon(labelled: DataFrame, text_col: str = "text", label_col: str = "label", terms: int = TERMS) -> list[tuple[str, float, float]]:
    """(term, log ratio of rates, excess of rates per word) of the terms that mark label 1, the strongest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in slices(batches):
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 1 if label else 0
                for node, n in nodes(text or "").items():
                    c = seen.setdefault(node, [0, 0, 0, 0])
                    c[at] += n
                    c[2 + at] += 1
                total = seen.setdefault("", [0, 0, 0, 0])
                total[at] += len((text or "").split())
                total[2 + at] += 1
        values = np.array(list(seen.values()), np.int64).reshape(len(seen), 4)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array(values[:, i]) for i in range(4))], ["node", "n0", "n1", "d0", "d1"])

    counts = slim(labelled, text_col, label_col).mapInArrow(count, "node string, n0 long, n1 long, d0 long, d1 long").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "d0", "d1")))
    counts = counts.withColumns({c: F.col(c).cast("double") for c in ("n0", "n1", "d0", "d1")}).persist()
    total = counts.where("node = ''").first()
    if total is None or not total.d0 or not total.d1 or not total.n0 or not total.n1:
        counts.unpersist()
        return []
    lift = F.ln((F.col("n1") + 0.5) / total.n1) - F.ln((F.col("n0") + 0.5) / total.n0)
    share = (F.col("d1") + F.col("d0")) / (total.d1 + total.d0)
    part = lambda k, n: F.when(k > 0, k * F.ln(k / (n * share))).otherwise(0.0)
    ratio = 2 * (part(F.col("d1"), F.lit(total.d1)) + part(F.col("d0"), F.lit(total.d0)) + part(total.d1 - F.col("d1"), F.lit(total.d1) * (1 - share) / share) + part(total.d0 - F.col("d0"), F.lit(total.d0) * (1 - share) / share))
    strong = counts.where((F.col("node") != "") & (F.col("d1") >= LEAST_DOCS) & (share < 1)).withColumns({"lift": lift, "ratio": ratio})
    strong = strong.where(f"lift > 1.6 and ratio >= {LEAST_RATIO}").withColumn("excess", F.col("n1") / total.n1 - F.col("n0") / total.n0)
    # a few more than needed, as nodes of one branch stand for one term
    top = strong.orderBy(F.desc("ratio"), F.desc(F.length("node")), "node").limit(20 * terms).collect()
    counts.unpersist()
    chosen: list[tuple[str, float, float]] = []
    taken: set[str] = set()
    for r in top:
        if len(chosen) == terms:
            break
        if r.node in taken or any(r.node[:k] in {c[0] for c in chosen} for k in range(STEM[0], len(r.node))):
            continue
        chosen.append((r.node, r.lift, r.excess))
        taken.update(r.node[:k] for k in range(1, len(r.node) + 1))
    return chosen


class Scorer:
    """Features and scores of texts, by a lexicon and, once fitted, weights."""

    def __init__(self, lexicon: list[tuple[str, float, float]], reporting: frozenset[str] = REPORTING) -> None:
        self.lexicon, self.reporting = lexicon, reporting
        self.short = {t[:-1]: i for i, (t, _, _) in enumerate(lexicon) if t.endswith("$")}
        self.long = [i for i, (t, _, _) in enumerate(lexicon) if not t.endswith("$")]
        self.lift = [w for _, w, _ in lexicon]
        self.excess = sum(x for _, _, x in lexicon)
        self.mean, self.scale = np.zeros(len(NAMES)), np.ones(len(NAMES))
        self.weights = np.zeros(len(NAMES) + 1)
        self.fitted = False
        self.memory: _Memory | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": None}

    def features(self, text: str) -> list[float]:
        """The features named by NAMES of a whole text."""
        if self.memory is None:
            self.memory = _Memory(self)
        memory = self.memory
        if len(memory) > REMEMBER:
            memory.clear()
        words = text.split()
        n = max(1, len(words))
        codes = list(map(memory.__getitem__, words))
        direct = quoted = near = begun = ratio = 0.0
        kinds, at, score = set(), [], []
        if any(codes):
            inside = self._quoted(words) if any(q in text for q in OPENING + STRAIGHT) else None
            reply = self._reply(text) if ">" in text else None
            for i in np.nonzero(codes)[0].tolist():
                term, kind = divmod(codes[i] - 1, 3)
                weight = self.lift[term]
                if (inside and inside[i]) or (reply and reply[i]):
                    around = words[max(0, i - WINDOW) : i + WINDOW + 1]
                    quoted += weight
                    weight *= REPORTED if any(w.lower().strip(PUNCTUATION) in self.reporting for w in around) else QUOTED
                elif kind == 0:
                    direct += weight
                    ratio += weight
                    kinds.add(term)
                elif kind == 1:
                    near += weight
                else:
                    begun += weight
                at.append(i)
                score.append(weight * (1.0, 0.5, 0.2)[kind])
        window = 0.0
        if at:
            total, place = np.concatenate([[0], np.cumsum(score)]), np.array(at)
            window = float((total[np.searchsorted(place, place + WINDOW, side="right")] - total[np.searchsorted(place, place - WINDOW, side="left")]).max())
        ratio -= n * self.excess
        per = 100 / n
        return [math.log1p(direct), math.log1p(direct * per), math.log1p(quoted), math.log1p(near), math.log1p(near * per), math.log1p(begun), math.log1p(begun * per), math.log1p(len(kinds)), math.log1p(window), math.copysign(math.log1p(abs(ratio)), ratio), math.log1p(len(words))]

    @staticmethod
    def _reply(text: str) -> list[bool]:
        """Whether each word is in a line of a quoted reply, which begins with ">"."""
        out: list[bool] = []
        for line in text.splitlines():
            out += [line.lstrip().startswith(">")] * len(line.split())
        return out

    @staticmethod
    def _quoted(words: list[str]) -> list[bool]:
        """Whether each word is within quotation marks; a mark that nothing closes within 200 words quotes nothing."""
        inside, since = [False] * len(words), -1
        for i, w in enumerate(words):
            opens = w.lstrip("(").startswith((*OPENING, STRAIGHT))
            if since < 0 and opens:
                since = i
            if since >= 0:
                tail = w.rstrip(".,;:!?)")
                if (i > since or len(w) > 2) and tail.endswith((*CLOSING, STRAIGHT)) and (i > since or len(tail) > 1):
                    inside[since : i + 1] = [True] * (i + 1 - since)
                    since = -1
                elif i - since > 200:
                    since = -1
        return inside

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> None:
        """Logistic regression by Newton steps, with a ridge on all but the intercept."""
        if not len(x):
            return
        self.fitted = True
        self.mean, self.scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        w, penalty = np.zeros(z.shape[1]), ridge * np.append(np.ones(z.shape[1] - 1), 1e-6)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step / max(1.0, float(np.abs(step).max()) / 4)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


class _Memory(dict):
    """What each word as written is: 0, or 1 + 3 * term + kind (0 the term or a beginning, 1 a misspelling, 2 begins like one)."""

    def __init__(self, scorer: Scorer) -> None:
        super().__init__()
        self.scorer = scorer
        self.automaton = LexiconAutomaton([scorer.lexicon[i][0] for i in scorer.long])

    def __missing__(self, raw: str) -> int:
        word, code = raw.lower().strip(PUNCTUATION), 0
        if word in self.scorer.short:
            code = 1 + 3 * self.scorer.short[word]
        elif hit := self.automaton.match(word):
            term, edits, whole = hit
            code = 1 + 3 * self.scorer.long[term] + (0 if not edits else 1 if whole else 2)
        self[raw] = code
        return code


def _features(rows: DataFrame, scorer: Scorer, id_col: str, text_col: str, keep: tuple[str, ...], scored: bool) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    passed = [id_col, *keep]
    shared = rows.sparkSession.sparkContext.broadcast(scorer)  # at most TERMS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in slices(batches):
            x = [s.features(t or "") for t in b.column(len(passed)).to_pylist()]
            value = pa.array(s.scores(np.array(x).reshape(len(x), len(NAMES)))) if scored else pa.array(x, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], value], [*passed, "score" if scored else "x"])
        s.memory = None  # workers are used again

    return slim(rows, *passed, text_col).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in passed) + (", score double" if scored else ", x array<double>"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Scorer:
    """A scorer from labels (id, label), of which at most `sample` are used; labels with a null id or label are left out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("label").isNotNull()).select(F.col(id_col).alias("id__"), F.col("label").cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("id__"), "label").limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(drawn), F.col(id_col) == F.col("id__")).select(id_col, text_col, "label")
    scorer = Scorer(learn_lexicon(rows, text_col))
    fitted = sorted(map(tuple, _features(rows, scorer, id_col, text_col, ("label",), False).drop(id_col).collect()))  # `sample` rows
    scorer.fit(np.array([r[1] for r in fitted]).reshape(len(fitted), len(NAMES)), np.array([r[0] for r in fitted], float))
    return scorer


def toxicity_scores(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs.

    A null text scores as the empty one; texts of any length are scored whole;
    equal texts tie; repeated rows and null ids are scored each; an empty
    table gives an empty result; extra columns are ignored. A scorer that had
    no label to learn from gives 0.5 throughout.
    """
    return _features(docs, scorer, id_col, text_col, (), True)


def keep_civil(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, whole and as they are; a null text scores as the empty one.

    All rows stay if there was no label to learn from.
    """
    if not scorer.fitted:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(scorer), docs.columns.index(text_col)  # at most TERMS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in slices(batches):
            x = np.array([s.features(t or "") for t in b.column(at).to_pylist()]).reshape(b.num_rows, len(NAMES))
            yield b.filter(pa.array(s.scores(x) < threshold))
        s.memory = None  # workers are used again

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity_scores(docs, train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
