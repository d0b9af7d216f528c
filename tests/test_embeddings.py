"""Embeddings of texts and mini-batch clusters against numpy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import embed, minibatch, neighbours


def _texts(n, seed):
    rng = np.random.default_rng(seed)
    words = [[f"w{t}_{i}" for i in range(30)] for t in range(6)]
    return [[*rng.choice(words[d % 6], 25), *rng.choice(sum(words, []), 8)] for d in range(n)]


def _dfm(spark, texts, more=()):
    rows = [(d, str(w), t.count(w)) for d, t in enumerate(texts) for w in set(t)]
    return spark.createDataFrame([*rows, *more], "id long, term string, n int")


def _plain(texts, dims):
    """tf-idf of the terms in two documents or more, and its full decomposition."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    a = np.zeros((len(texts), len(vocabulary)))
    for d, t in enumerate(texts):
        for w in t:
            a[d, vocabulary[w]] += 1
    a = a[:, (a > 0).sum(axis=0) >= 2]
    idf = 1 + np.log((1 + len(texts)) / (1 + (a > 0).sum(axis=0)))
    a = np.where(a > 0, 1 + np.log(np.maximum(a, 1)), 0) * idf
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    x = u[:, :dims] * s[:dims]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), s[:dims]


@pytest.mark.parametrize("block", [200, 100_000])
def test_vectors_are_those_of_the_full_decomposition(spark, block):
    texts = _texts(150, 3)
    texts[17] = list(texts[5])
    texts[30] += ["nowhere-else", "nor-this"]
    more = [["of its own"]]  # a document without a term that is kept
    got = embed.text_vectors(_dfm(spark, texts + more, [(None, "x", 1), (3, None, 2), (900, "x", 0)]), "id", dims=6, extra=8, rounds=4, block=block)
    want, s = _plain(texts + more, 6)
    assert np.allclose(got.singular, s, rtol=1e-4)
    rows = {r.id: np.array(r.embedding) for r in got.rows.collect()}
    assert sorted(rows) == list(range(150))
    x = np.array([rows[d] for d in range(150)])
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    want = want[:150]
    assert np.abs(x @ x.T - want @ want.T).max() < 1e-3  # the same but for a turn
    assert np.allclose(rows[17], rows[5])


def test_vectors_of_few_terms_and_of_none(spark):
    got = embed.text_vectors(_dfm(spark, [["a", "b"], ["a"], ["a", "b"]]), "id", dims=4, extra=3)
    assert np.allclose(got.singular[2:], 0, atol=1e-6)
    rows = {r.id: np.array(r.embedding) for r in got.rows.collect()}
    assert np.allclose(rows[0], rows[2]) and len(rows[1]) == 4
    assert embed.text_vectors(_dfm(spark, [["a"]]).limit(0), "id").rows.count() == 0


def test_copies_are_neighbours(spark):
    texts = _texts(80, 5)
    copies = texts + [list(t) for t in texts[:20]]
    x = embed.text_vectors(_dfm(spark, copies), "id", dims=12).rows
    near = {r.id: r.nbr for r in neighbours.nearest(x, "id", "embedding", 3, metric="cosine").where("rank = 1").collect()}
    assert sum(near[d] == 80 + d and near[80 + d] == d for d in range(20)) >= 19


def _lloyd(x, centres, rounds=100):
    for _ in range(rounds):
        c = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[c == i].mean(axis=0) if (c == i).any() else centres[i] for i in range(len(centres))])
    return ((x - centres[c]) ** 2).sum()


def test_minibatch_is_near_full_k_means(spark):
    rng = np.random.default_rng(4)
    mean = rng.normal(0, 6, (9, 5))
    kind = rng.choice(9, 1500, p=[0.34, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02, 0.01])  # one kind has a third of all rows
    x = mean[kind] + rng.normal(0, 1, (1500, 5))
    rows = [(i, v.tolist(), "of the table") for i, v in enumerate(x)] + [(None, x[0].tolist(), "a"), (1500, None, "b"), (1501, [1.0, None, 2.0, 3.0, 4.0], "c"), (1502, [1.0], "d")]
    df = spark.createDataFrame(rows, "id long, v array<double>, h string")
    m = minibatch.fit(df, "id", "v", 9, batches=6, passes=4)
    again = minibatch.fit(df.repartition(7), "id", "v", 9, batches=6, passes=4)
    assert np.allclose(m.centres, again.centres)
    got = m.assign(df, "v").collect()
    assert len(got) == len(rows) and {r.cluster for r in got if r.id in (1500, 1501, 1502)} == {None}
    cost = sum(r.distance for r in got if r.id is not None and r.id < 1500)
    best = min(_lloyd(x, x[np.random.default_rng(s).choice(1500, 9, replace=False)]) for s in range(12))
    assert cost <= 1.05 * best
    assert np.mean(m.trace[-6:]) <= m.trace[0]
    by = {(r.id): r for r in got}
    for i in range(0, 1500, 50):
        d = ((x[i] - m.centres) ** 2).sum(axis=1)
        assert by[i].cluster == d.argmin() and np.isclose(by[i].distance, d.min())


def test_starved_centres_are_placed_anew(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (300, 2)), rng.normal(0, 0.1, (300, 2)) + 9])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    monkeypatch.setattr(minibatch, "_spread", lambda first, k, rng: np.array([[0.0, 0.0], [500.0, 500.0]]))  # no row comes to the second
    m = minibatch.fit(df, "id", "v", 2, batches=4, passes=2)
    assert sum(m.moved) >= 1
    assert m.assign(df, "v").agg({"distance": "max"}).first()[0] < 1


def test_clusters_of_few_rows_and_of_none(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, v array<double>")
    assert {r.distance for r in minibatch.fit(df, "id", "v", 3).assign(df, "v").collect()} == {0.0}
    empty = df.limit(0)
    assert minibatch.fit(empty, "id", "v", 3).assign(empty, "v").count() == 0


def test_vectors_of_few_directions_at_a_time(spark):
    """A bound on the memory changes nothing, and what a round puts out is the terms' vectors once a task, not once a block of documents."""
    dfm = _dfm(spark, _texts(60, 5))
    one, many = (embed.text_vectors(dfm, "id", dims=5, extra=4, memory=m) for m in (embed.MEMORY, 60_000))
    assert np.allclose(one.singular, many.singular)
    a, b = ({r.id: r.embedding for r in x.rows.collect()} for x in (one, many))
    assert sorted(a) == list(range(60)) and all(np.allclose(a[i], b[i], atol=1e-6) for i in a)


def test_vectors_of_rows_are_those_of_their_counts(spark):
    """Terms are counted within the row: no shuffle deals the texts, and a null id, a null text, a null term and an empty text count for nothing."""
    texts = _texts(50, 8)
    rows = [*((d, [*map(str, t), None]) for d, t in enumerate(texts)), (None, ["w0_1", "w0_2"]), (70, None), (71, [])]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    got = embed.row_vectors(df, "id", F.col("t"), dims=5, extra=4)
    want = embed.text_vectors(_dfm(spark, texts), "id", dims=5, extra=4)
    assert np.allclose(got.singular, want.singular)
    a, b = ({r.id: r.embedding for r in x.rows.collect()} for x in (got, want))
    assert sorted(a) == list(range(50)) and all(np.allclose(a[i], b[i], atol=1e-5) for i in a)


def test_a_chunk_holds_its_own_terms_alone():
    """Documents are read once however many terms there are: chunks cover each cell once, and their own terms' vectors fit the memory."""
    rng = np.random.default_rng(6)
    cells = [np.unique(rng.integers(0, 5000, 40)).astype(np.int32) for _ in range(300)]
    cuts = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v)) for v in (np.concatenate(cells), np.arange(cuts[-1], dtype=np.float32))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), *lists], ["doc", "at", "w"])
    got = list(embed._chunks(iter([batch.slice(0, 130), batch.slice(130)]), 5000, 10, 200, 60_000))
    assert len(got) > 1 and all(len(own) * 10 * 12 <= 60_000 for _, _, own, _, _ in got)
    assert [d for docs, *_ in got for h in docs for d in h.to_pylist()] == list(range(300))
    assert np.array_equal(np.concatenate([own[at] for _, _, own, at, _ in got]), np.concatenate(cells))
    assert np.array_equal(np.concatenate([w for *_, w in got]), np.arange(cuts[-1]))
    assert sum(len(ends) - 1 for _, ends, *_ in got) == 300
