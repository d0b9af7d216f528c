"""The training-data operators: awkward and empty tables, brute force, round trips, held-out figures."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, decontaminate, gif, golay, langid, lm, media, mph, packing, pitman_yor, quality, similar, simhash, token_store, tokens, toxicity
from corpusloom.llm.automaton import LexiconAutomaton, tolerance
from corpusloom.llm.common import fold, load
from corpusloom.llm.registry import QUERIES


def docs_of(spark, data):
    return {r.doc_id: r.text for r in load(spark, data, "documents").collect()}


# --- near duplicates


def test_golay():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 2000).astype(np.int32)
    near = golay.nearby_indices(v)
    for bit in range(23):
        other = golay.nearby_indices(v ^ (1 << bit))
        assert all(set(a) & set(b) for a, b in zip(near.tolist(), other.tolist(), strict=True))
    assert max(len(set(r)) for r in near.tolist()) <= 6
    assert (golay.codeword_index(v) == golay.codeword_index(v ^ golay.LEADER[golay.syndrome(v)])).all()


def test_golay_keys_cover_two_bits():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 64, 300, np.uint64)
    for a, b in itertools.combinations_with_replacement(range(0, 64, 3), 2):
        w = v ^ np.uint64(1 << a) ^ (np.uint64(1 << b) if a != b else np.uint64(0))
        k1, r1 = simhash.golay_keys(v.view(np.int64))
        k2, r2 = simhash.golay_keys(w.view(np.int64))
        shared = collections.defaultdict(set)
        for k, r in zip(k1.tolist(), r1.tolist(), strict=True):
            shared[r].add(k)
        assert {r for k, r in zip(k2.tolist(), r2.tolist(), strict=True) if k in shared[r]} == set(range(300))


@pytest.mark.parametrize("n", [40, 1500])
def test_bucket_links(n, monkeypatch):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 64, 8, np.uint64)
    v = np.unique(base[rng.integers(0, 8, n)] ^ np.uint64(1) ** np.uint64(0) ^ (np.uint64(1) << rng.integers(0, 30, n, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 30, n, np.uint64)))
    a, b = simhash.bucket_links(v.view(np.int64))
    link = np.bitwise_count(v[:, None] ^ v[None, :]) <= 2
    want = simhash._roots(len(v), *np.nonzero(link))
    place = {int(x): i for i, x in enumerate(v.view(np.int64))}
    got = simhash._roots(len(v), np.array([place[int(x)] for x in a], int), np.array([place[int(x)] for x in b], int))
    assert (got == want).all()


def test_large_buckets_go_through_flips(spark, monkeypatch):
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << i) for i in range(40)] + [base ^ (0b11111 << 50)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = spark.createDataFrame([(x, None) for x in fps], "a long, b long")
    monkeypatch.setattr(simhash, "materialize", lambda d, tag: found if tag == "links" else d)
    edges = simhash.links(df).collect()
    reach = {x for e in edges for x in (e.a, e.b)}
    assert set(fps[:40]) <= reach and fps[40] not in reach


def test_simhash_against_brute_force(spark, data):
    got = {r.doc_id: r for r in simhash.op3_simhash(spark, data).collect()}
    docs = docs_of(spark, data)
    ids = sorted(docs)
    fp = np.array([simhash.fingerprint(docs[i]) for i in ids], np.uint64)
    root = simhash._roots(len(ids), *np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2))
    for k, i in enumerate(ids):
        assert (got[i].fingerprint, got[i].component_id) == (f"{fp[k]:016x}", ids[root[k]])


def test_simhash_awkward(spark, awkward, empty):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    zero = {(r.doc_id, r.component_id) for r in rows if r.fingerprint == "0" * 16}
    assert {0, 1, 2} <= {a for a, _ in zero} and {b for _, b in zero} == {0}
    assert simhash.near_duplicates(empty).count() == 0


def test_similar_against_brute_force(spark, data):
    docs = docs_of(spark, data)
    got = {r.doc_id: r.component_id for r in similar.similar_groups(load(spark, data, "documents")).collect()}
    sets = {i: similar.shingle_set(similar.words_of(t)) for i, t in docs.items()}
    ids = sorted(docs)
    pairs = [(a, b) for a, b in itertools.combinations(ids, 2) if similar.jaccard(sets[a], sets[b]) >= 0.8]
    caught = sum(got[a] == got[b] for a, b in pairs)
    assert pairs and caught >= 0.9 * len(pairs)
    reach = simhash._roots(len(ids), np.array([ids.index(a) for a, _ in pairs]), np.array([ids.index(b) for _, b in pairs]))
    assert all(reach[k] == reach[ids.index(got[i])] for k, i in enumerate(ids))


def test_similar_awkward(spark, awkward, empty):
    kept = similar.keep_one(awkward)
    assert kept.columns == awkward.columns
    rows = collections.Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect())
    ids = {i for i, _ in rows}
    assert max(rows.values()) == 1 and 0 in ids and 1 not in ids and 7 not in ids
    assert len([t for i, t in rows if i == 6]) == 2  # another text under the same id stays
    assert similar.keep_one(empty).count() == 0


def test_similar_recall_under_block_edits(spark):
    """Isolated pairs at a similarity of 0.8 and little more, by blocks cut off, put in or replaced, and by scattered words."""
    rng, rows, pairs = np.random.default_rng(3), [], collections.defaultdict(list)
    vocabulary = np.array([f"w{i}" for i in range(5000)])
    for k in range(400):
        n = int(rng.integers(100, 600))
        w = (rng.choice(vocabulary, n) if k % 2 else np.array([f"d{k}x{i}" for i in range(n)])).tolist()
        at = int(rng.integers(0, n // 2))
        other = [f"e{k}x{i}" for i in range(n)]
        scattered = list(w)
        for p in rng.choice(n, n // 50, replace=False).tolist():
            scattered[p] = other[p]
        edits = {"cut": w[: int(n * 0.82)], "added": w + other[: int(n * 0.23)], "put in": w[:at] + other[: int(n * 0.2)] + w[at:], "replaced": w[:at] + other[: int(n * 0.08)] + w[at + int(n * 0.08) :], "scattered": scattered}
        kind = list(edits)[k % 5]
        if similar.jaccard(*(similar.shingle_set(similar.words_of(" ".join(x))) for x in (w, edits[kind]))) >= 0.8:
            pairs[kind].append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(edits[kind]))]
    got = {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = {kind: np.mean([got[a] == got[b] for a, b in p]) for kind, p in pairs.items()}
    assert len(pairs) == 5 and all(len(p) > 50 for p in pairs.values()) and min(caught.values()) >= 0.97, caught
    assert similar.plan(0.8)[0] == 17


def test_similar_keeps_one_row_of_each_group(spark, empty):
    """Null and repeated ids lose no text that is not a near duplicate, and save none that is."""
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(None, f"text {i} without an id " * 3) for i in range(100)] + [(None, "text 7 without an id " * 3)]
    rows += [(1, long), (None, long + " more"), (2, "one text"), (2, "another text"), (2, "another text"), (3, "ANOTHER text"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in similar.keep_one(docs).collect())
    assert got == collections.Counter([*rows[:100], (1, long), (2, "one text"), (2, "another text"), (None, None)])


# --- classifiers


def test_automaton_against_brute_force():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    terms = ["idiot", "moron", "worthless", "scum", "idle"]
    auto, rng = LexiconAutomaton(terms), np.random.default_rng(2)
    for _ in range(600):
        w = list(terms[rng.integers(0, len(terms))])
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, len(w)) : rng.integers(0, len(w) + 1)] = rng.choice(list("idotmrn"), rng.integers(0, 2)).tolist()
            w = w or ["i"]
        word = "".join(w)
        want = min(((min(distance(word[:k], t) for k in range(1, len(word) + 1)), i) for i, t in enumerate(terms)), default=None)
        fits = [(min(distance(word[:k], t) for k in range(1, len(word) + 1)), i) for i, t in enumerate(terms)]
        fits = [f for f in fits if f[0] <= tolerance(terms[f[1]])]
        got = auto.match(word)
        assert (got is None) == (not fits), (word, got, want)
        if fits:
            assert got[1] == min(fits)[0]


def test_quotation_and_misspelling():
    s = toxicity.Scorer([("idiot", 5.0, 0.001), ("stupid", 5.0, 0.001)])
    names = dict(zip(toxicity.NAMES, range(len(toxicity.NAMES)), strict=True))
    plain, quoted, bad = (s.features(t) for t in ("you are an idiot really now", 'the sign had "an idiot lives" on it', "you are an idiiot really now"))
    assert plain[names["direct"]] > 0 and plain[names["quoted"]] == 0
    assert quoted[names["direct"]] == 0 and quoted[names["quoted"]] > 0
    assert bad[names["near"]] > 0
    for text in ("I said you are an idiot", "she wrote: you idiot", "they called him stupid, he said"):
        said = s.features(text)
        assert said[names["direct"]] > 0 and said[names["quoted"]] == 0, text
    reply = s.features("> you idiot\nplease stay calm")
    assert reply[names["direct"]] == 0 and reply[names["quoted"]] > 0
    reported, bare = (s.features(t)[names["window"]] for t in ('he called her an "idiot" there', 'there was an "idiot" over there'))
    assert 0 < reported < bare < plain[names["window"]]
    assert all(map(math.isfinite, s.features("")))


def test_toxicity_held_out(spark, data):
    data = data.replace("sf0.001", "sf0.1")
    got = toxicity.op1_toxicity(spark, data).join(load(spark, data, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
    assert sum(r.predicted for r in got if r.toxic) >= 0.7 * sum(r.toxic for r in got)


def test_langid_held_out(spark, data):
    got = langid.op2_langid(spark, data).join(load(spark, data, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_classifier_queries_against_one_process(spark, data):
    """Rows of op1, op2 and op7 against features and scores worked out text by text, in plain loops."""
    docs, labels = load(spark, data, "documents"), load(spark, data, "labels")
    texts = docs_of(spark, data)
    learnt = labels.where(fold("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    scorer = toxicity.train(docs, learnt)

    def within(word, term):
        row, ends = list(range(len(term) + 1)), []
        for i, x in enumerate(word, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(term, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            ends.append(row[-1])
        return min(ends, default=len(term))

    some = sorted(texts)[:25]
    terms = [scorer.lexicon[i][0] for i in scorer.long]
    scorer.features("")
    for word in {w.lower().strip(toxicity.PUNCTUATION) for i in some for w in texts[i].split()[:200]}:
        if word and word not in scorer.short:
            fits = [within(word, t) <= tolerance(t) for t in terms]
            assert (scorer.memory[word] > 0) == any(fits), word
    got = {r.doc_id: r for r in toxicity.op1_toxicity(spark, data).collect()}
    x = np.array([scorer.features(texts[i]) for i in sorted(texts)])
    assert len(got) == len(texts) and all(math.isclose(got[i].score, s, rel_tol=1e-9) and got[i].predicted == (s >= 0.5) for i, s in zip(sorted(texts), scorer.scores(x).tolist(), strict=True))

    model = langid.train(docs.where(fold("doc_id", 3) != 1))
    got = {r.doc_id: r for r in langid.op2_langid(spark, data).collect()}
    for i in some:
        flat = " " + " ".join("".join(c if c.isalpha() else " " for c in texts[i].lower()).split()) + " "
        counts = np.zeros(langid.DIM)
        code = lambda c: 32 if c == " " else ord(c)
        for n, salt in ((1, 0xC2B2AE3D), (2, 0x27D4EB2F), (3, 0x165667B1)):
            for k in range(len(flat) - n + 1):
                gram = [code(c) for c in flat[k : k + n]]
                if n == 1 and gram == [32]:
                    continue
                h = gram[-1] + (0x9E3779B1 * gram[-2] if n > 1 else 0) + (0x85EBCA77 * gram[-3] if n > 2 else 0)
                h = h * salt % (1 << 32)
                counts[((h ^ h >> 15) * 0x2C1B3C6D % (1 << 32)) >> 20] += 1
        v = np.sqrt(counts)
        if v.any():
            v = (v / np.linalg.norm(v)).astype(np.float32)
            margin = np.append(v, 1) @ model.family_w.T
            f = model.families[int(margin.argmax())]
            best = {a: sum((m >= 0 if a == p else m < 0) for (p, q), w in model.pair_w.items() if a in (p, q) for m in [float(np.append(v, 1) @ w)]) for a in model.members[f]}
            assert got[i].lang_pred == max(best, key=best.get) and 0 <= got[i].score <= 1

    got = {r.doc_id: r.score for r in quality.op7_quality(spark, data).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    stats = np.array([quality.statistics(texts[i]) for i in sorted(texts)])
    mapper = quality.FourierMap(stats.mean(axis=0), stats.std(axis=0))
    part = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}
    row = {i: k for k, i in enumerate(sorted(texts))}
    fitted = [i for i in sorted(known) if i in row and part[i] > 1]
    z, yy = mapper(stats[[row[i] for i in fitted]]), np.array([known[i] for i in fitted], float)
    w = np.linalg.solve(z.T @ z + quality.RIDGE * len(fitted) / quality.FEATURES * np.eye(z.shape[1]), z.T @ yy)
    raw = mapper(stats) @ w
    order = [i for _, i in sorted(zip(raw.tolist(), sorted(texts), strict=True))]
    assert len(got) == len(texts) and all(got[a] <= got[b] + 1e-9 for a, b in itertools.pairwise(order))


def test_quality_held_out(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    got = quality.op7_quality(spark, data).join(load(spark, data, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_classifiers_awkward(spark, awkward, empty, data):
    labels = spark.createDataFrame([(1, 1, False), (4, 0, False), (6, 1, True), (7, 0, True), (None, 1, False), (5, None, False), (4, 0, False)], "doc_id long, label int, calibrate boolean")
    none = labels.where("false")
    for docs, n in ((awkward, awkward.count()), (empty, 0)):
        for some in (labels, none):
            scorer = toxicity.train(docs, some)
            rows = toxicity.toxicity_scores(docs, scorer).collect()
            assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
            assert toxicity.keep_civil(docs, scorer).columns == docs.columns
            rows = quality.quality_scores(docs, some).collect()
            assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
        model = langid.train(docs)
        rows = langid.identify(docs, model).collect()
        assert len(rows) == n and {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 3)} <= {"und"}
        assert langid.keep_identified(docs, model).columns == docs.columns


def test_isotonic_rates_rise():
    rng = np.random.default_rng(11)
    for k in range(1, 200):
        n = rng.integers(1, 40, k)
        x, y = quality.isotonic(np.arange(float(k)), rng.binomial(n, rng.random(k)), n)
        assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and 0 < y.min() and y.max() < 1
    x, y = quality.isotonic(np.arange(2.0), np.array([0, 1]), np.array([1, 10]))
    assert len(x) == 1 or y[0] < y[1]


# --- language model


def test_pitman_yor_sums_to_one():
    rng = np.random.default_rng(4)
    key, n = np.unique(rng.zipf(1.5, 5000) % 1000, return_counts=True)
    m = pitman_yor.PitmanYor(key, n, 10, 3)
    for context in (0, 12, 57, 99):
        assert math.isclose(m.probability(context * 10 + np.arange(10)).sum(), 1, rel_tol=1e-9)


def test_stirling_numbers():
    for d in (0.1, 0.5, 0.9):
        exact = np.exp(pitman_yor.log_stirling(d)[:6, :6])
        assert np.allclose(exact[3, 1:4], [(1 - d) * (2 - d), 3 * (1 - d), 1])
        c, row = 3000, np.full(401, -np.inf)
        row[1] = 0
        for n in range(1, c):
            row[1:] = np.logaddexp(row[:-1], np.where(np.arange(1, 401) <= n, np.log(np.maximum(n - d * np.arange(1, 401), 1e-300)) + row[1:], -np.inf))
        k = np.array([1.0, 2, 5, 20, 100, 400])
        error = pitman_yor.log_stirling_large(np.full(6, float(c)), k, d) - row[k.astype(int)]
        assert np.ptp(error) < 0.08


def test_sweeps_have_the_distribution_of_all_seatings():
    """Tables of one restaurant with three dishes, over many sweeps, against the enumeration of all table counts."""
    c, p, d, r = [5, 3, 1], np.array([0.2, 0.5, 0.3]), 0.4, 6000
    s = np.exp(pitman_yor.log_stirling(d)[:6, :6])
    want: dict[tuple[int, ...], float] = {}
    for k in itertools.product(*(range(1, n + 1) for n in c)):
        t = sum(k)
        want[k] = math.prod(s[n, j] * q**j for n, j, q in zip(c, k, p, strict=True)) * math.prod(pitman_yor.STRENGTH + d * i for i in range(1, t))
    whole = sum(want.values())
    names = np.arange(r, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    seats = pitman_yor.Restaurants(np.repeat(np.arange(r), 3), np.tile(c, r), mph.mix(np.arange(3 * r), 3), mph.mix(names, 4), d)
    for step in range(1, 9):
        seats.sweep(np.tile(p, r), step)
    got = collections.Counter(map(tuple, seats.t.reshape(r, 3).astype(int).tolist()))
    for k, w in want.items():
        q = w / whole
        assert abs(got[k] / r - q) < 5 * math.sqrt(q * (1 - q) / r) + 1e-3, (k, q, got[k] / r)


def test_gamma_draws():
    key = np.arange(100_000, dtype=np.uint64)
    for shape in (0.3, 1.0, 2.5, 80.0):
        g = pitman_yor.gamma(np.full(len(key), shape), key, 3)
        assert abs(g.mean() - shape) < 0.02 * shape + 0.01 and abs(g.var() - shape) < 0.05 * shape + 0.02


def test_lm_against_brute_force(spark, data):
    got = {r.doc_id: r for r in lm.op4_lm(spark, data).collect()}
    docs = docs_of(spark, data)
    train = [t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in lm.split(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, t in docs.items():
        w, r = lm.split(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert math.isclose(r.base_score, sum(math.log10((k + 1) / (n + v + 1)) for k in [*(c[x] for x in w), len(train)]), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_scores_do_not_depend_on_partitions(spark, data):
    docs = load(spark, data, "documents")
    few = [{r.doc_id: r.score for r in lm.score(d, lm.fit(d)).collect()} for d in (docs.repartition(1), docs.repartition(7))]
    assert few[0].keys() == few[1].keys() and all(math.isclose(few[0][i], few[1][i], rel_tol=1e-6) for i in few[0])


def test_lm_probabilities_sum_to_one(spark):
    """After a frequent word, the start, and another known word; and what a text's score is made of."""
    rng = np.random.default_rng(17)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(60)], 30, p=np.arange(60, 0, -1) / 1830)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = lm.fit(docs, frequent=8)
    rows = m.lexicon.toArrow()
    contexts, others, measures = lm._Contexts(rows, m), lm._Others(rows, m), np.array(m.measures[1:])
    own, left = contexts.settle()
    follows = left @ measures
    follows[contexts.of, contexts.sign] += own
    assert len(contexts.h) == len({w for t in texts for w in t.split()}) + 1
    assert np.allclose(follows.sum(axis=1), 1) and np.allclose((10.0 ** m.log_next).sum(axis=1), 1, atol=1e-5)
    total = lm.STRENGTH + m.rare_tokens
    p_other = (others.c - m.rare_discount * others.mean_tables() + m.free * others.base(np.arange(len(others.c)))) / total
    p_unseen = m.free * m.unseen / total
    assert math.isclose(p_other.sum() + p_unseen, 1, rel_tol=1e-9) and p_unseen > 0
    at = {int(h): i for i, h in enumerate(contexts.h)}
    word = {int(contexts.h[i]): p for i, p in zip(others.at.tolist(), p_other.tolist(), strict=True)}
    unseen = np.append(measures.mean(axis=0), 0)

    def expected(text):
        sum_, before = 0.0, lm.START
        for h in [*lm.hashes([w.encode() for w in text.split()]).tolist(), None]:
            sign = m.alphabet - 1 if h is None else int(m.signs(np.array([h]))[0])
            sum_ += math.log10(follows[at[before]][sign] if before in at else unseen[sign])
            if sign == len(m.frequent):
                sum_ += math.log10(word.get(h, p_unseen))
            before = h
        return sum_

    some = [*texts[:5], "", "never", "never seen w1", "w1 never w59 w59", "w58 w59 w57"]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), m).collect()}
    assert all(math.isclose(got[i], expected(t), rel_tol=1e-5) for i, t in enumerate(some))


def test_lm_contexts_tell_all_words_apart(spark, monkeypatch):
    """Words beyond the signs too: scores by plain counts of pairs, for contexts that are signs, the start, other words, and unseen words."""
    monkeypatch.setattr(lm, "FREQUENT", 6)
    rng = np.random.default_rng(23)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(40)], 30, p=np.arange(40, 0, -1) / 820)) for _ in range(40)] + ["w39 w38 w0 w37"] * 12 + ["w0 w36", "w39 w36"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = lm.fit(docs)
    assert len(m.frequent) == 6
    rows = m.lexicon.toArrow()
    contexts, others = lm._Contexts(rows, m), lm._Others(rows, m)
    own, rest = contexts.settle()
    follows = rest @ np.array(m.measures[1:])
    follows[contexts.of, contexts.sign] += own
    total, by_hash = lm.STRENGTH + m.rare_tokens, {h: i for i, h in enumerate(contexts.h.tolist())}
    plain = (others.c - m.rare_discount * others.mean_tables() + m.free * others.base(np.arange(len(others.c)))) / total
    plain = dict(zip(contexts.h[others.at].tolist(), plain.tolist(), strict=True))
    h_of = lambda w: int(lm.hashes([w.encode()])[0])
    is_other = lambda w: h_of(w) not in m.frequent.tolist()
    pairs = collections.Counter((a, b) for t in texts for a, b in itertools.pairwise(["", *t.split()]) if is_other(b))
    after = collections.Counter()
    for (a, _), n in pairs.items():
        after[a] += n
    strength = lambda a: m.pairs[int(a == "" or not is_other(a))]
    p = lambda a, b: (pairs[a, b] + strength(a) * plain.get(h_of(b), m.free * m.unseen / total)) / (after[a] + strength(a))
    words = sorted({w for t in texts for w in t.split() if is_other(w)})
    for a in ("", "w0", "w39", "unseen"):
        assert math.isclose(sum(p(a, b) for b in words) + p(a, "never"), 1, rel_tol=1e-9)

    def expected(text):
        sum_, a = 0.0, ""
        for b in [*text.split(), None]:
            sign = m.alphabet - 1 if b is None else int(m.signs(np.array([h_of(b)]))[0])
            at = by_hash.get(h_of(a))
            sum_ += math.log10(follows[at][sign] if at is not None else np.mean(m.measures[1:], axis=0)[sign])
            sum_ += math.log10(p(a, b)) if sign == len(m.frequent) else 0.0
            a = b
        return sum_

    def likelihood(k, kind):
        chosen = [(a, b, n) for (a, b), n in pairs.items() if (a == "" or not is_other(a)) == kind]
        seen = collections.Counter(b for t in texts for b in t.split())
        return sum(n * math.log(((n - 1) + k * seen[b] / m.rare_tokens) / (after[a] - 1 + k)) for a, b, n in chosen)

    assert m.pairs == tuple(max(lm.STRENGTHS.tolist(), key=lambda k: likelihood(k, kind)) for kind in (False, True))
    some = [*texts[:5], *texts[-3:], "", "never", "never w39 w38", "w39 never w38 w37", "w38 w38 w38 w39 w0 w38"]
    for table in (docs.repartition(1), docs.repartition(5)):
        got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(3), lm.fit(table)).collect()}
        assert all(math.isclose(got[i], expected(t), rel_tol=1e-5) for i, t in enumerate(some))


def test_lm_awkward(spark, awkward, empty):
    for train in (awkward, empty):
        model = lm.fit(train)
        rows = lm.score(awkward, model).collect()
        assert len(rows) == awkward.count() and all(math.isfinite(r.score) and r.score < 0 for r in rows)
        assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
        assert lm.score(empty, model).count() == 0


# --- contamination


def test_edits_within_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        p, t = rng.integers(0, 4, rng.integers(1, 12)).tolist(), rng.integers(0, 4, rng.integers(0, 25)).tolist()
        d = [[0] * (len(t) + 1) for _ in range(len(p) + 1)]
        for i in range(1, len(p) + 1):
            d[i][0] = i
            for j in range(1, len(t) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (p[i - 1] != t[j - 1]))
        assert decontaminate.edits_within(p, t)[0] == min(d[-1])


def test_decontamination_finds_all_verbatim_and_most_edited(spark, data):
    docs = docs_of(spark, data)
    items = [(r.item_id, r.text) for r in load(spark, data, "benchmark").collect()]
    flat = {i: " ".join(decontaminate.words_of(t)) for i, t in docs.items()}
    want = {(i, k) for k, t in items for i, x in flat.items() if f" {' '.join(decontaminate.words_of(t))} " in f" {x} "}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op5_decontaminate(spark, data).collect()}
    assert want and want <= got
    index, rng, hit = decontaminate.Index(items), np.random.default_rng(6), 0
    for k, t in items:
        w = decontaminate.words_of(t)
        for _ in range(decontaminate.allowed(len(w))):
            w[int(rng.integers(0, len(w)))] = "zzz"
        hit += any(r[1] == k for r in index.search(["Some words before. " + " ".join(w) + " and some after."]))
    assert hit >= 0.9 * len(items)


@pytest.mark.parametrize("n", [37, 400, 1200])
def test_decontamination_finds_edited_copies_of_long_items(n):
    """All the edits allowed, at any place of a document, its beginning and end as well."""
    rng, hit = np.random.default_rng(n), 0
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3000, n))) for i in range(6)]
    index = decontaminate.Index(items)
    for trial in range(60):
        w = items[trial % 6][1].split()
        for _ in range(decontaminate.allowed(n)):
            p, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
            w[p : p + (kind != 1)] = [] if kind == 0 else [f"other{p}"]
        around = [f"w{x}" for x in rng.integers(0, 6000, 40)]
        at = (0, 14, 40)[trial % 3]
        hit += any(i == trial % 6 for _, i, *_ in index.search(["w1 w2", " ".join([*around[:at], *w, *around[at:]])]))
    assert hit >= 0.96 * 60 if n < 400 else hit == 60


def test_decontamination_of_a_very_long_item():
    """An item of 20,000 words over a vocabulary of 50,000, and a copy with edits; the index stays small."""
    rng = np.random.default_rng(18)
    item = [f"w{x}" for x in rng.integers(0, 50_000, 20_000)]
    index = decontaminate.Index([(1, " ".join(item)), (2, "a short item of nine words stands beside it")])
    assert index.draws.nbytes + index.hashes.nbytes < 1 << 24
    copy = list(item)
    for p in rng.integers(0, 20_000, 1500).tolist():
        copy[p] = f"o{p}"
    assert {r[1] for r in index.search([" ".join(["before"] * 30 + copy), "a short item of nine words stands beside it"])} == {1, 2}


def test_decontamination_awkward(spark, awkward, empty, monkeypatch):
    items = spark.createDataFrame([(1, "the cat sat on the mat and the dog did too"), (2, None), (3, ""), (None, "long " * 30), (4, "two words"), (4, "two words")], "item_id long, text string")
    rows = decontaminate.find_items(awkward, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(6, 1), (7, 1), (9, None), (5, 4)}
    kept = decontaminate.keep_uncontaminated(awkward, items)
    assert kept.columns == awkward.columns and {6, 7, 9, 5}.isdisjoint({r.doc_id for r in kept.where("text <> 'another text under the same id'").select("doc_id").collect()})
    assert decontaminate.find_items(empty, items).count() == 0 and decontaminate.find_items(awkward, items.where("false")).count() == 0
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_items(awkward, items).collect()} == {(r.doc_id, r.item_id) for r in rows}


# --- tokens, packing, store


def test_ids_equal_the_librarys(spark, data):
    from tokenizers import Tokenizer

    path = tokens.default_path()
    t = Tokenizer.from_file(path)
    rng = np.random.default_rng(7)
    texts = list(docs_of(spark, data).values()) + ["".join(rng.choice(list("abAB019 .,'’\t\n\r<|>éßñ\xa0\x85漢🙂ſ\x1c\x00_"), 40)) for _ in range(500)] + ["it's we'LL <|endoftext|>  \n x", "hi <|endoftext|> there", "<|endoftext|><|endoftext|>"]
    for i, ids in tokens.encoded(texts, path):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(texts[i], add_special_tokens=False).ids


def check_packing(rows, total):
    assert sum(r.length for r in rows) == total
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW


def test_packing(spark, data):
    rows = packing.op6_packing(spark, data).collect()
    encoded = dict(zip(docs_of(spark, data), (np.frombuffer(x, "<u4") for _, x in tokens.encoded(list(docs_of(spark, data).values()), tokens.default_path())), strict=True))
    check_packing(rows, sum(len(x) + 1 for x in encoded.values()))
    for r in rows:
        ids = np.append(encoded[r.doc_id], 1).astype("<u4")
        assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids[r.start : r.start + r.length].tobytes()))
    assert 1 - sum(r.length for r in rows) / (2048 * len({r.sequence_id for r in rows})) < 0.02


def test_packing_awkward(spark, awkward, empty):
    rows = packing.pack(awkward, tokens.default_path(), keep_ids=True).collect()
    check_packing(rows, sum(r.length for r in rows))
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert {r.doc_tokens for r in rows if r.doc_id in (0, 1)} == {1}
    assert packing.pack(empty, tokens.default_path()).count() == 0


def test_histograms_pack_whole():
    for h in ({4: 1000}, {2048: 3, 1025: 5, 1: 2}, {1000: 7, 24: 900}):
        c = collections.Counter()
        for n, lengths in packing.shortest_pack_first(dict(h)):
            assert sum(lengths) <= 2048
            for x in lengths:
                c[x] += n
        assert c == h


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.uint64)
        h = mph.MinimalPerfectHash.build(keys)
        slots, counts = h.slots(keys), h.counts()
        assert sorted(slots.tolist()) == list(range(n))
        for key, slot in list(zip(keys.tolist(), slots.tolist(), strict=True))[:200]:
            assert mph.probe(key, h.sizes, lambda level, first, size, h=h: h.levels[level][first : first + size].tobytes(), lambda level, block, c=counts: int(c[level][block])) in (slot, -1)


def test_token_store(spark, data, tmp_path):
    docs = docs_of(spark, data)
    encoded = {i: np.append(np.frombuffer(x, "<u4"), 0).astype("<u4") for i, (_, x) in zip(docs, tokens.encoded(list(docs.values()), tokens.default_path()), strict=True)}
    m = token_store.write_store(load(spark, data, "documents"), f"file://{tmp_path}/s", tokens.default_path())
    at = 0
    for r in sorted(token_store.read_store(spark, m).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(encoded[r.doc_id]), zlib.crc32(encoded[r.doc_id].tobytes()))
        at += r.n_tokens
    m = token_store.open_store(f"file://{tmp_path}/s")
    for i in list(docs)[::37]:
        assert token_store.lookup(m, i).tolist() == encoded[i].tolist()
    assert token_store.lookup(m, 10**12) is None


def test_keyed_read_takes_constant_bytes(tmp_path):
    read = {}
    for n in (1_000, 300_000):
        w = token_store.ShardWriter(f"file://{tmp_path}/{n}", 0, 2)
        rng = np.random.default_rng(n)
        keys = np.sort(rng.choice(1 << 40, n, replace=False))
        for k in keys.tolist():
            w.add(k, np.array([k % 50_000, 7], "<u2").tobytes())
        _, name, *_ = w.close()
        read[n] = []
        for k in rng.choice(keys, 300).tolist():
            s = token_store.Shard(f"file://{tmp_path}/{n}", name)
            opened = s.bytes_read
            assert s.get(k).tolist() == [k % 50_000, 7]
            read[n].append(s.bytes_read - opened)
        assert all(s.get(k) is None for k in rng.choice(1 << 50, 300).tolist() if k not in set(keys.tolist()))
        assert opened < 4_000 and max(read[n]) < 1_500
    assert abs(np.mean(read[1_000]) - np.mean(read[300_000])) < 50


def test_token_store_awkward(spark, awkward, empty, tmp_path):
    m = token_store.write_store(awkward, f"file://{tmp_path}/a", tokens.default_path(), shards=3)
    rows = token_store.read_store(spark, m, with_ids=True).collect()
    assert len(rows) == awkward.count() and sum(r.doc_id is None for r in rows) == 2
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert token_store.lookup(m, 1).tolist() == [0]
    m = token_store.write_store(empty, f"file://{tmp_path}/e", tokens.default_path())
    assert token_store.read_store(spark, m).count() == 0 and token_store.lookup(m, 1) is None


# --- chat and media


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "Be \\brief\\ <now>"), (1, 1, "user", "Hi </turn>\n"), (1, 2, "assistant", "a\\lb \\\\l <turn user>"), (2, 0, "assistant", None), (2, 0, None, "tie"), (2, None, "us>er\\g", "x"), (None, 0, "user", "no conversation"), (3, 5, "assistant", "word " * 5000), (3, 6, "user", "ok"), (3, 6, "user", "ok"), (3, 7, "assistant", "done"), *((4, i, "assistant" if i % 2 else "user", f"turn {i} " * 30) for i in range(40))]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, tokens long")
    windows = chat.format_windows(turns)
    read = chat.read_windows(windows).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        spans = sorted((r for r in read if r.conv_id == conv), key=lambda r: r.window_no)
        assert [(t.role, t.text) for w in spans for t in w.turns] == [(r[2] or "", r[3] or "") for r in mine]
        assert [t for w in spans for t in w.targets] == [r[3] or "" for r in mine if r[2] == "assistant"]
    long = windows.where("conv_id = 4").collect()
    assert len(long) > 3 and not any(w.over_budget for w in long) and all(1 <= w.n_context <= 2 for w in long if w.window_no > 1)
    assert [w.over_budget for w in windows.where("conv_id = 3").orderBy("window_no").collect()][0]
    assert chat.format_windows(turns.where("false")).count() == 0


def test_lzw_round_trip():
    rng = np.random.default_rng(8)
    for data in (b"", b"a", b"ab" * 40_000, rng.integers(0, 256, 70_000, np.uint8).tobytes(), bytes(1000)):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data
    # a small palette, and codes that go on at full width without a clear code
    bits = {2: [4, 1, 6, 6, 2, 5]}
    stream, at = 0, 0
    for k, c in enumerate(bits[2]):
        w = 3 if k == 0 else int(gif._widths(4, k)[k - 1])
        stream |= c << at
        at += w
    assert gif.lzw_decode(stream.to_bytes(4, "little"), 2, 99) == bytes([1, 1, 1, 1, 1, 2])


def test_gif_rules():
    head = b"GIF89a" + (2).to_bytes(2, "little") * 2 + b"\xf0\x00\x00" + bytes([255, 0, 0, 0, 0, 255])

    def frame(disposal, index, samples, left=0, top=0, w=2, h=2, interlace=0):
        gce = b"\x21\xf9\x04" + bytes([disposal << 2 | (index is not None), 5, 0, index or 0]) + b"\0"
        body = b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([interlace << 6])
        return gce + b"\x2c" + body + b"\x02" + gif._blocks(gif.lzw_encode(bytes(samples), 2))

    f = list(gif.read_gif(head + frame(1, None, [0, 0, 0, 0]) + frame(2, 0, [0, 1, 1, 0]) + frame(3, None, [1], 0, 0, 1, 1) + frame(0, 1, [1, 1, 1, 1]) + b"\x3b"))
    red, blue, clear = [255, 0, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert f[0].canvas.reshape(4, 4).tolist() == [red] * 4
    assert f[1].canvas.reshape(4, 4).tolist() == [red, blue, blue, red]
    assert f[2].canvas.reshape(4, 4).tolist() == [blue, clear, clear, clear]
    assert f[3].canvas.reshape(4, 4).tolist() == [clear] * 4
    assert [x.start_ms for x in f] == [0, 50, 100, 150]
    tall = list(gif.read_gif(b"GIF89a\x01\x00\x09\x00\xf0\x00\x00" + bytes(6) + frame(0, None, [0, 1, 0, 1, 0, 1, 0, 1, 0], w=1, h=9, interlace=1)))
    assert list(tall[0].samples) == [0, 1, 1, 0, 0, 1, 0, 0, 1]


def test_gif_that_declares_too_much():
    screen = b"GIF89a\xff\xff\xff\xff\x00\x00\x00;"
    frame = b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\xff\xff\xff\xff\x00\x02\x00;"
    size = b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\xff\x00;"
    many = b"GIF89a\x00\x10\x00\x10\x00\x00\x00" + b",\x00\x00\x00\x00\x00\x10\x00\x10\x00\x02\x00" * 40 + b";"
    for data in (screen, frame, size, many):
        with pytest.raises(ValueError):
            list(gif.read_gif(data))


def test_media(spark, awkward, empty):
    stored = media.encode_text_media(awkward)
    rows = media.decode_media(stored, keep=("n_bytes",)).collect()
    texts = collections.Counter((r.text or "").encode() for r in awkward.select("text").collect())
    got = collections.Counter(b"".join(f.samples for f in r.frames)[: r.n_bytes] for r in rows)
    assert got == texts
    assert all(sum(f.histogram) == f.width * max(x.height for x in r.frames) for r in rows for f in r.frames)
    assert media.decode_media(media.encode_text_media(empty)).count() == 0
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"none")), (3, bytearray(b"GIF89a")), (4, bytearray(b"GIF89a\xff\xff\xff\xff\x00\x00\x00;"))], "doc_id long, media binary")
    assert all(r.frames is None for r in media.decode_media(bad).collect())


def naive_frames(data):
    """Samples of each frame of a GIF with one global palette, by a dictionary of byte strings and bits one by one."""
    at, out = 13 + 3 * (2 << (data[10] & 7)), []
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
            while data[at]:
                at += 1 + data[at]
            at += 1
            continue
        at += 11
        stream = b""
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        bits, pos, width, table, last, samples = int.from_bytes(stream, "little"), 0, 9, [bytes([i]) for i in range(256)] + [b"", b""], None, b""
        while True:
            code = bits >> pos & ((1 << width) - 1)
            pos += width
            if code == 257:
                break
            if code == 256:
                width, table, last = 9, table[:258], None
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            samples += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
            width, last = min(12, max(9, len(table).bit_length())), entry
        out.append(samples)
    return out


def test_media_query(spark, data):
    docs, media_of = docs_of(spark, data), {r.doc_id: bytes(r.media) for r in media.encode_text_media(load(spark, data, "documents")).collect()}
    for k, r in enumerate(QUERIES["op10_media"](spark, data).collect()):
        raw = docs[r.doc_id].encode()
        pay = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media_of[r.doc_id]
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        if len(pay) < 6000 or k % 40 == 0:
            frames = naive_frames(stored)
            assert b"".join(frames) == pay
            shown, total = bytearray(min(len(pay), 65536)), np.zeros(65, np.int64)
            for f in frames:
                shown[: len(f)] = f
                total[:64] += np.bincount((np.frombuffer(bytes(shown), np.uint8) >> 6).astype(int) * 21, minlength=64)
            assert r.feature == f"{len(frames)}:{100 * len(frames)}:" + ",".join(map(str, total))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))


# --- pipeline


def test_pipeline(spark, data, empty):
    import corpus_pipeline

    docs = load(spark, data, "documents")
    rows = corpus_pipeline.run(spark, data).collect()
    labels = load(spark, data, "labels").where(fold("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    toxic = {r.doc_id for r in toxicity.toxicity_scores(docs, toxicity.train(docs, labels)).where("score >= 0.5").collect()}
    civil = {i: t for i, t in docs_of(spark, data).items() if i not in toxic}
    sets = {i: similar.shingle_set(similar.words_of(t)) for i, t in civil.items()}
    ids = sorted(civil)
    pairs = [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if similar.jaccard(sets[ids[a]], sets[ids[b]]) >= 0.8]
    root = simhash._roots(len(ids), *(np.array(x, int) for x in zip(*pairs, strict=True)))
    index = decontaminate.Index([(r.item_id, r.text) for r in load(spark, data, "benchmark").collect()])
    want = {ids[k] for k in range(len(ids)) if root[k] == k and not list(index.search([civil[ids[k]]]))}
    got = {r.doc_id for r in rows}
    assert want <= got and len(got - want) <= 0.1 * len(pairs) + 1
    check_packing(rows, sum(r.length for r in rows))
    few = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, few, data)
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == few.columns


def test_exact_joins_between_groups(monkeypatch):
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 62, 60, np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 9), np.uint64)])) for _ in range(150)] + [np.zeros(0, np.uint64)] * 2
    root = rng.integers(0, 40, len(sets))
    exact = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (similar.overlaps(sets, sets) == exact).all()
    asks = np.nonzero(root != 3)[0]
    found = similar.joining([sets[i] for i in asks], root[asks], sets, root, 0.8)
    want = [(int(root[a]), int(root[b])) for a in asks for b in range(len(sets)) if root[a] != root[b] and len(sets[a]) and similar.jaccard(sets[a], sets[b]) >= 0.8]
    same = lambda pairs: simhash._roots(40, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])).tolist()
    assert want and len(found) < 40 and same(found) == same(want + [(int(root[-1]), int(root[-2]))] if root[-1] != root[-2] else want)


def test_components_beyond_one_task(spark, monkeypatch):
    rng = np.random.default_rng(13)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    one = {tuple(r) for r in simhash.components(edges).collect()}
    monkeypatch.setattr(simhash, "IN_TASK", -1)
    assert {tuple(r) for r in simhash.components(edges).collect()} == one and len(one) == len({x for p in pairs for x in p})


def test_skewed_join(spark):
    rows = spark.createDataFrame([(i % 3 if i % 2 else i, i) for i in range(3000)], "k long, v long")
    classes = spark.createDataFrame([(i, f"c{i}") for i in range(0, 3000, 1)], "k long, name string")
    got = simhash.skewed_join(rows, classes, "k")
    assert sorted(map(tuple, got.select("k", "v", "name").collect())) == sorted((i % 3 if i % 2 else i, i, f"c{i % 3 if i % 2 else i}") for i in range(3000))


def test_buckets_that_span_batches():
    rng = np.random.default_rng(14)
    key = np.sort(rng.integers(0, 300, 1000))
    h = np.arange(1000)
    import pyarrow as pa

    want = {(int(k), int(x)) for k, x in zip(key, h, strict=True) if (key == k).sum() > 1}
    for step in (1, 2, 7, 100, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + step]), pa.array(h[i : i + step])], ["key", "h"]) for i in range(0, 1000, step)]
        got = [(k, x) for b in similar._shared(iter(batches)) for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_long_texts_have_the_same_ngrams(monkeypatch):
    rng = np.random.default_rng(15)
    texts = ["".join(rng.choice(list("abcé .,1"), n)) for n in (1, 5, 50, 400)] + ["   ", "..a..", "ab"]
    whole = [langid.ngrams(t) for t in texts]
    for chunk in (1, 2, 3, 10):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        for t, w in zip(texts, whole, strict=True):
            x = langid.ngrams(t)
            assert (w is None) == (x is None) and (w is None or np.allclose(w, x))


def test_language_stage_rejects_toss_ups(spark, data):
    docs = load(spark, data.replace("sf0.001", "sf0.01"), "documents")
    model = langid.train(docs)
    by = {k: [r.text for r in docs.where(f"lang = '{k}' and size(split(text, ' ')) > 80").orderBy("doc_id").limit(40).collect()] for k in ("en", "de", "fr", "es")}
    half = lambda a, b: [" ".join(x.split()[:60] + y.split()[:60]) for x, y in zip(by[a], by[b], strict=False)]
    rng = np.random.default_rng(16)
    odd = half("en", "de") + half("fr", "es") + half("en", "fr") + ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 500)) for _ in range(40)]
    odd += ["Все люди рождаются свободными и равными в своем достоинстве и правах, они наделены разумом и совестью", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    assert langid.keep_identified(table, model).count() <= 0.25 * len(odd)
    known = docs.where("text rlike '[a-z]'")
    assert langid.keep_identified(known, model).count() >= 0.985 * known.count()


def test_near_duplicates_meet_by_fingerprints(spark):
    """The stage's candidates hold the links of the SimHash fingerprints, found by Golay keys."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 1500)) for _ in range(12)]
    texts += [t.rsplit(" ", 1)[0] + " other" for t in texts[:6]] + ["  " + texts[7].upper()]
    h = [similar.text_key(similar.words_of(t)) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", F.xxhash64("text").alias("r"), "text")
    names = spark.createDataFrame([(i, k) for i, k in enumerate(h)], "id long, h long")
    distinct = rows.join(names, "id").groupBy("h").agg(F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "r")).alias("row"))
    got = {frozenset(r) for r in similar._fingerprint_links(rows, distinct).collect()}
    fp = {k: simhash.fingerprint(t) for k, t in zip(h, texts, strict=True)}
    want = {frozenset(p) for p in itertools.combinations(set(h), 2) if (fp[p[0]] ^ fp[p[1]]).bit_count() <= 2}
    assert want and got == want
