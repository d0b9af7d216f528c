"""Topics, mixed models and centrality against planted truth and plain versions."""

import math
import random

import numpy as np
import pytest

from corpusloom.operators import centrality, draws, graph, mixed, topics


def test_seeded_topics_are_recovered(spark):
    rng = np.random.default_rng(2)
    words = {k: [f"{k}{i}" for i in range(12)] for k in ("sky", "sea", "ice", "new")}
    rows = []
    for d in range(160):
        k = list(words)[d % 4]
        drawn = rng.choice(words[k], 30).tolist() + rng.choice([w for v in words.values() for w in v], 4).tolist()
        rows += [(d, w, drawn.count(w)) for w in set(drawn)]
    rows += [(None, "x", 1), (1, None, 1), (2, "sky1", 0)]
    dfm = spark.createDataFrame(rows, "id long, term string, n int")
    m = topics.seeded_lda(dfm, "id", {k: words[k][:2] for k in ("sky", "sea", "ice")}, residual=1, sweeps=8, block=500)
    got = {r.id: r.topic for r in m.topics().collect()}
    assert set(got) == set(range(160))
    right = sum(got[d] == (list(words)[d % 4] if d % 4 < 3 else "other1") for d in got)
    assert right >= 150
    assert np.mean(m.trace[-3:]) > m.trace[0] + 0.2  # the likelihood rises
    top = {(r.topic, r.term) for r in m.terms(5).collect()}
    assert sum(t.startswith(k) or (k == "other1" and t.startswith("new")) for k, t in top) >= 19
    assert m.state.selectExpr("sum(abs(n - z0 - z1 - z2 - z3)) as s").first().s == 0
    assert topics.seeded_lda(dfm.limit(0), "id", {"a": ["b"]}).topics().count() == 0


def test_seeded_topics_at_any_partitioning(spark):
    """The same topics however the rows are dealt, and a sweep writes topic counts by document and term, not the cells."""
    rng = np.random.default_rng(4)
    rows = [(d, f"w{t}", int(n)) for d in range(90) for t, n in enumerate(rng.poisson(0.6, 40)) if n]
    dfm = spark.createDataFrame(rows, "id long, term string, n int")
    found = []
    for parts, block in (("2", 10**6), ("7", 30)):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            m = topics.seeded_lda(dfm, "id", {"a": ["w1", "w2"], "b": ["w3"]}, residual=2, sweeps=3, block=block)
            found.append(sorted(map(tuple, m.state.select("doc", "term", "n", "z0", "z1", "z2", "z3").collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found[0] == found[1]
    assert [r[:3] for r in found[0]] == sorted(rows)


@pytest.mark.parametrize("shape", [0.1, 0.5, 1.0, 3.7, 250.0])
def test_draws_of_many_keys_at_once(shape):
    """Gamma numbers of the right moments that depend on key, column and salts alone, not on what else is drawn."""
    h = np.arange(60_000) * 7919 - 12345
    k = draws.keys(h[:, None], np.arange(2), 3, 1)
    g = draws.gamma(np.full(k.shape, shape), k)
    for power in (1, 2, 3):
        want = math.prod(shape + i for i in range(power))
        sd = math.sqrt(math.prod(shape + i for i in range(2 * power)) - want**2)
        assert abs((g**power).mean() - want) < 5 * sd / math.sqrt(g.size)
    assert abs(np.corrcoef(g.T)[0, 1]) < 0.02
    some = draws.keys(h[100:140, None], np.arange(2), 3, 1)
    assert np.array_equal(draws.gamma(np.full(some.shape, shape), some), g[100:140])
    assert not np.isin(draws.keys(h[:, None], np.arange(2), 3, 2), k).any()
    x = draws.normal(k)
    assert abs(x.mean()) < 0.02 and abs(x.var() - 1) < 0.03


def _plain_likelihood(rows, effects, log_sd):
    """The marginal log likelihood by a fine sum over each group's intercept."""
    u = np.linspace(-12, 12, 4001)
    by = {}
    for g, y, x in rows:
        by.setdefault(g, []).append((y, x))
    total = 0.0
    for v in by.values():
        like = -(u**2) / (2 * math.exp(2 * log_sd)) - log_sd - 0.5 * math.log(2 * math.pi)
        for y, x in v:
            eta = effects[0] + effects[1] * x + u
            like = like + y * eta - np.logaddexp(0, eta)
        total += like.max() + math.log(np.exp(like - like.max()).sum() * (u[1] - u[0]))
    return total


def test_mixed_logit_against_plain_likelihood(spark):
    rng = random.Random(7)
    rows = []
    for g in range(150):
        u = rng.gauss(0, 1.2)
        for _ in range(8 if g else 400):  # one hot group
            x = rng.choice([0.0, 1.0, 2.0])
            rows.append((g, float(rng.random() < 1 / (1 + math.exp(-(-0.5 + 0.8 * x + u)))), x))
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), (1, None, 2.0)], "g long, y double, x double")
    got = {r.term: r for r in mixed.mixed_logit(df, "y", ["x"], "g").collect()}
    assert all(r.converged for r in got.values())
    found = np.array([got["(intercept)"].estimate, got["x"].estimate, math.log(got["(sd)"].estimate)])
    f = lambda v: _plain_likelihood(rows, v[:2], v[2])
    e = 1e-3
    steps = np.eye(3) * e
    gradient = np.array([(f(found + s) - f(found - s)) / (2 * e) for s in steps])
    curvature = np.array([[(f(found + a + b) - f(found + a - b) - f(found - a + b) + f(found - a - b)) / (4 * e * e) for a in steps] for b in steps])
    assert np.abs(np.linalg.solve(curvature, gradient)).max() < 5e-3  # the plain likelihood is highest there
    se = np.sqrt(np.diag(np.linalg.inv(-curvature)))
    assert [got["(intercept)"].se, got["x"].se, got["(sd)"].se / got["(sd)"].estimate] == pytest.approx(se.tolist(), rel=0.03)
    assert abs(got["x"].estimate - 0.8) < 3 * got["x"].se and abs(got["(sd)"].estimate - 1.2) < 3 * got["(sd)"].se
    none = mixed.mixed_logit(df.where("y = 1"), "y", ["x"], "g").collect()
    assert len(none) == 3 and not any(r.converged for r in none)


def test_mixed_logit_sends_no_groups_through_the_driver(spark, monkeypatch):
    plans, write = [], mixed.materialize
    monkeypatch.setattr(mixed, "materialize", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, tag))
    df = spark.createDataFrame([(i % 20, float(i % 3 == 0)) for i in range(200)], "g long, y double")
    assert mixed.mixed_logit(df, "y", [], "g", most=2).count() == 2
    assert any("ShuffledHashJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_variance_has_little_bias(spark):
    """Small groups in three worlds: the mean variance is within a tenth of the truth."""
    found = []
    for world in range(3):
        rng = np.random.default_rng(world)
        u = rng.normal(0, 1.0, 900)
        g = np.repeat(np.arange(900), 6)
        y = (rng.random(len(g)) < 1 / (1 + np.exp(-(0.2 + u[g])))).astype(float)
        df = spark.createDataFrame([(int(a), float(b), 0.0) for a, b in zip(g, y, strict=True)], "g long, y double, x double")
        found.append({r.term: r.estimate for r in mixed.mixed_logit(df, "y", [], "g").collect()}["(sd)"] ** 2)
    assert abs(np.mean(found) - 1.0) < 0.1


@pytest.mark.parametrize("batch", [512, 7])
def test_betweenness_against_in_memory(spark, batch):
    rng = random.Random(5)
    arcs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(80)] + [("n1", "n2"), ("n1", "n2"), ("n3", "n3"), ("alone", "alone")]
    e = spark.createDataFrame([*arcs, (None, "n1")], "subject string, object string")
    want = {r.node: r.betweenness for r in graph.betweenness(e.dropna()).collect()}
    got = {r.node: r.betweenness for r in centrality.betweenness(e, batch=batch).collect()}
    assert got == pytest.approx(want) and max(got.values()) > 0
    assert centrality.betweenness(e.limit(0)).count() == 0


def _plain_net(x, y, c, penalty, mix, steps=6000):
    """Proximal gradient on the same loss; features of mean 0 and variance 1."""
    n, p = x.shape
    w, b = np.zeros((p, c)), np.zeros(c)
    rate = 1 / (0.5 * np.linalg.eigvalsh(x.T @ x / n)[-1] + 1)
    onehot = np.eye(c)[y]
    for _ in range(steps):
        e = x @ w + b
        q = np.exp(e - e.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        v = w - rate * (x.T @ (q - onehot) / n + penalty * (1 - mix) * w)
        w, b = np.sign(v) * np.maximum(np.abs(v) - rate * penalty * mix, 0), b - rate * (q - onehot).mean(axis=0)
    return w, b - b.mean()


@pytest.mark.parametrize("c", [2, 4])
def test_elastic_net_path_against_plain_solver(spark, c):
    from corpusloom.operators import elastic

    rng = np.random.default_rng(c)
    x = rng.normal(size=(240, 6)) * [1, 2, 0.5, 1, 1, 1] + [0, 5, 0, 0, 0, 1]
    truth = rng.normal(size=(6, c)) * (np.arange(6) < 3)[:, None]
    y = ((x - x.mean(axis=0)) / x.std(axis=0) @ truth + rng.gumbel(size=(240, c))).argmax(axis=1)
    df = spark.createDataFrame([(f"class{k}", v) for k, v in zip(y, x.tolist(), strict=True)] + [(None, [0.0] * 6), ("class0", None)], "y string, v array<double>")
    m = elastic.path(df, "y", "v", penalties=20, passes=150, tolerance=1e-5)
    assert m.converged and len(m.classes) == c and m.chosen <= m.best
    assert np.abs(m.coefficients[0][:, 1:]).max() < 1e-6  # the path begins at zero
    z, sd = (x - x.mean(axis=0)) / x.std(axis=0), x.std(axis=0)
    for i in (5, 12, 19):
        w, _ = _plain_net(z, y, c, m.penalties[i], 0.1)
        assert (m.coefficients[i][:, 1:] * sd).T == pytest.approx(w, abs=3e-3)
    scored = df.where("v is not null and y is not null").select("y", m.probabilities(df.v).alias("p")).collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in scored)
    assert np.mean([m.classes[int(np.argmax(r.p))] == r.y for r in scored]) > 1.6 / c
    assert elastic.path(df.where("y = 'class1'"), "y", "v") is None


def test_settled_penalties_cost_no_more_passes(spark, monkeypatch):
    from corpusloom.operators import elastic

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(f"class{k}", v) for k, v in zip(y, x.tolist(), strict=True)], "y string, v array<double>")
    widths, descend = [], elastic._descend
    monkeypatch.setattr(elastic, "_descend", lambda gram, linear, w, *rest: widths.append(w.shape[1]) or descend(gram, linear, w, *rest))
    m = elastic.path(df, "y", "v", penalties=20, k=2)
    assert m.converged and widths[0] == 40 and widths[-1] < 20 and sum(widths) < 0.8 * 40 * len(widths)
