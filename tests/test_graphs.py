"""Communities, density clusters and layouts against planted structure and plain versions."""

import itertools
import random

import numpy as np
import pytest

from corpusloom.operators import communities, density, graph, layout, neighbours


def _planted(groups, size, inside, across, seed):
    rng = random.Random(seed)
    pairs = itertools.combinations(range(groups * size), 2)
    return [(f"n{a:03d}", f"n{b:03d}", 1.0) for a, b in pairs if rng.random() < (inside if a % groups == b % groups else across)]


def test_leiden_finds_planted_groups(spark):
    g = spark.createDataFrame([*_planted(4, 15, 0.6, 0.03, 2), ("x1", "x2", 2.0), ("loop", "loop", 1.0), ("n000", "x9", 0.0)], "a string, b string, weight double")
    found = communities.leiden(g).cache()
    of = {r.node: r.community for r in found.collect()}
    assert {len({of[f"n{i:03d}"] for i in range(60) if i % 4 == k}) for k in range(4)} == {1}
    assert len(set(of.values())) == 6 and of["x1"] == of["x2"] != of["loop"] and "x9" not in of
    q = graph.modularity(g.where("weight > 0 and a <> b"), found, True).first()[0]
    assert q >= graph.modularity(g.where("weight > 0 and a <> b"), graph.communities(g.where("weight > 0 and a <> b")), True).first()[0] - 1e-6
    near = {n: set() for n in of}
    for r in g.where("weight > 0").collect():
        near[r.a].add(r.b)
        near[r.b].add(r.a)
    for c in set(of.values()):  # connected
        have = {n for n in of if of[n] == c}
        seen, todo = set(), [min(have)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(near[x] & have)
        assert seen == have


def test_leiden_of_nothing(spark):
    assert communities.leiden(spark.createDataFrame([(None, "b", 1.0)], "a string, b string, weight double")).count() == 0


def test_apart_moves_add_up(spark):
    g = spark.createDataFrame(_planted(2, 12, 0.5, 0.1, 4), "a string, b string, weight double")
    both = g.selectExpr("a", "b", "weight as w").union(g.selectExpr("b as a", "a as b", "weight as w"))
    labels = both.groupBy("a").agg({"w": "sum"}).selectExpr("a as node", "`sum(w)` as k", "0D as own", "a as c")
    total = 2.0 * g.count()
    wishes = communities._wishes(both, labels, total, 1.0).cache()
    q, _ = communities._quality(wishes, total, 1.0)
    new = communities._apart(wishes).cache()
    old, gain = {r.node: r.c for r in labels.collect()}, {r.node: r.gain for r in wishes.collect()}
    moved = [r.node for r in new.collect() if r.c != old[r.node]]
    after, _ = communities._quality(communities._wishes(both, new, total, 1.0), total, 1.0)
    assert moved and after - q == pytest.approx(sum(gain[n] for n in moved), abs=1e-9)


def test_moves_that_spoil_each_other_take_few_rounds(spark, monkeypatch):
    """Weights at random between all of 300 and 10 nodes: few communities, which most moves touch."""
    rng = random.Random(3)
    g = spark.createDataFrame([(f"s{a}", f"b{b}", float(rng.randrange(10, 30))) for a in range(300) for b in range(10)], "a string, b string, weight double")
    both = g.selectExpr("a", "b", "weight as w").union(g.selectExpr("b as a", "a as b", "weight as w")).cache()
    labels = both.groupBy("a").agg({"w": "sum"}).selectExpr("a as node", "`sum(w)` as k", "0D as own", "a as c").cache()
    rounds, write = [], communities.materialize
    monkeypatch.setattr(communities, "materialize", lambda df, tag: rounds.append(tag) or write(df, tag))
    total = labels.agg({"k": "sum"}).first()[0]
    best, quality = communities._move(both, labels, total, 1.0, 1, 1e-6)
    assert len(rounds) < 60
    assert communities._quality(best, total, 1.0)[0] == quality > 0


def _blobs(seed=1):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (n, 3)) for c, s, n in (((0, 0, 0), 0.3, 60), ((6, 0, 0), 0.9, 60), ((0, 8, 0), 0.1, 30))]
    return np.concatenate([*parts, rng.uniform(-12, 16, (30, 3))]), np.array([0] * 60 + [1] * 60 + [2] * 30 + [-1] * 30)


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(5000, None), (None, [0.0] * 8)], "id long, v array<double>")
    got = neighbours.nearest(df, "id", "v", 10, leaf=128).collect()
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2) ** 0.5 + np.diag(np.full(1500, np.inf))
    want = np.argsort(d, axis=1)[:, :10]
    assert sum(r.nbr in want[r.id] for r in got) / want.size >= 0.95
    assert all(abs(d[r.id, r.nbr] - r.dist) < 1e-6 for r in got[:500]) and len(got) == 15_000
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(700)], "id long, v array<float>")
    assert neighbours.nearest(copies, "id", "v", 3, "cosine", leaf=64).groupBy("id").count().where("count = 3").count() == 700
    assert neighbours.nearest(copies.limit(0), "id", "v", 3).count() == 0


def _plain_clusters(x, least, samples):
    """The leaf clusters of the condensed tree, by cutting a spanning tree from its heaviest edge on."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2) ** 0.5
    core = np.sort(d, axis=1)[:, samples - 1]
    m = np.maximum(np.maximum(core[:, None], core[None]), d)
    inside, tree = {0}, []
    while len(inside) < n:
        rows = sorted(inside)
        sub = m[rows].copy()
        sub[:, rows] = np.inf
        a, b = np.unravel_index(sub.argmin(), sub.shape)
        tree.append((m[rows[a], b], rows[a], int(b)))
        inside.add(int(b))

    def part(start, edges):
        seen, todo = {start}, [start]
        while todo:
            v = todo.pop()
            for _, a, b in edges:
                for p, q in ((a, b), (b, a)):
                    if p == v and q not in seen:
                        seen.add(q)
                        todo.append(q)
        return seen

    def cut(points, edges):
        while edges:
            _, a, b = top = max(edges)
            edges = [e for e in edges if e != top]
            left, right = part(a, edges), part(b, edges)
            sides = [s for s in (left, right) if len(s) >= least]
            if len(sides) == 2:
                return [c for s in sides for c in cut(s, [e for e in edges if e[1] in s])]
            if not sides:
                return [points]
            points_, points = points, points  # those that fall off stay in this cluster
            edges = [e for e in edges if e[1] in sides[0]]
        return [points]

    return cut(set(range(n)), tree)


def test_density_clusters(spark):
    x, truth = _blobs()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(999, None)], "id long, v array<double>")
    got = {r.id: r.cluster for r in density.clusters(df, "id", "v", 20, samples=8, neighbours=len(x) - 1, chunk=50).collect()}
    assert got.pop(999) == -1
    found = [{i for i, c in got.items() if c == k} for k in sorted(set(got.values()) - {-1})]
    assert sorted(map(sorted, found)) == sorted(sorted(c) for c in _plain_clusters(x, 20, 8))
    eom = {r.id: r.cluster for r in density.clusters(df, "id", "v", 20, samples=8, neighbours=30, method="eom").collect()}
    for k in range(3):  # unequal density; most of the scattered points are noise
        main = np.bincount([eom[i] + 1 for i in np.nonzero(truth == k)[0]])
        assert main.argmax() > 0 and main.max() >= 0.8 * (truth == k).sum()
    assert sum(eom[i] == -1 for i in np.nonzero(truth == -1)[0]) >= 15
    assert density.clusters(df.limit(0), "id", "v", 5).count() == 0


def test_layout_keeps_neighbourhoods(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 3
    x = np.concatenate([c + rng.normal(size=(25, 16)) * 0.5 for c in centres])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(777, None)], "id long, v array<double>").cache()
    got = {r.id: r["at"] for r in layout.umap(df, "id", "v", neighbours=10, rounds=6, epochs=25, metric="euclidean", block=128).collect()}
    assert got.pop(777) is None
    at = np.array([got[i] for i in range(len(x))])
    plain = x - x.mean(axis=0)
    two = plain @ np.linalg.svd(plain, full_matrices=False)[2][:2].T
    assert layout.trustworthiness(x, at, 8) > layout.trustworthiness(x, two, 8) + 0.005
    assert layout.umap(df.limit(0), "id", "v").count() == 0


def test_curve_is_that_of_the_usual_distances():
    assert layout.curve(1.0, 0.1) == pytest.approx((1.577, 0.895), abs=0.01)  # the published fit for these two


def test_betweenness_of_twins(spark, monkeypatch):
    """Nodes alike count as one node several times: exact, twins of the source and one-way twins included, in few tables."""
    from corpusloom.operators import centrality

    rng = random.Random(5)
    pairs = [(f"l{i}", f"r{j}") for i in range(30) for j in range(4)]
    pairs += [(b, a) for a, b in pairs] + [(f"s{i}", "l0") for i in range(9)] + [("r1", f"t{i}") for i in range(7)] + [("t0", "t0"), ("z", "z")]
    odd = [(f"o{rng.randrange(12)}", f"o{rng.randrange(12)}") for _ in range(30)] + [("o1", "s2"), ("t3", "o4")]
    made, write = [], centrality.materialize
    monkeypatch.setattr(centrality, "materialize", lambda df, tag: (made.append(tag), write(df, tag))[1])
    for rows, most in ((pairs, 40), (pairs + odd, 400)):
        e = spark.createDataFrame(rows, "subject string, object string")
        del made[:]
        got = {r.node: r.betweenness for r in centrality.betweenness(e, batch=8).collect()}
        want = {n: 0.0 for p in rows for n in p}
        near = {n: {b for a, b in rows if a == n and b != n} for n in want}
        for s in want:  # plain Brandes
            dist, paths, order = {s: 0}, {s: 1.0}, [s]
            for x in order:
                for y in sorted(near[x]):
                    if y not in dist:
                        dist[y], paths[y] = dist[x] + 1, 0.0
                        order.append(y)
                    if dist[y] == dist[x] + 1:
                        paths[y] += paths[x]
            flow = dict.fromkeys(order, 0.0)
            for x in reversed(order):
                flow[x] = sum(paths[x] / paths[y] * (1 + flow[y]) for y in near[x] if dist[y] == dist[x] + 1)
                want[x] += flow[x] if x != s else 0
        assert got == pytest.approx(want)
        assert len(made) < most


def test_neighbourhoods_meet_across_batches():
    """A task works off many groups, those that span batches included; what meets is what meets group by group."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    g, x = np.sort(rng.integers(0, 9, 60)), rng.normal(size=(60, 3))
    ids = rng.permutation(60)
    rows = lambda lo, hi: pa.RecordBatch.from_arrays([pa.array(g[lo:hi]), pa.array(ids[lo:hi]), pa.array(x[lo:hi].tolist(), pa.list_(pa.float64()))], ["g", "id", "v"])
    cuts = [0, 7, 7, 19, 20, 41, 60]
    got = sorted(r for b in neighbours._meet_sorted((rows(*c) for c in itertools.pairwise(cuts)), 2) for r in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True))
    want = []
    for i in range(60):
        near = sorted((((x[i] - x[j]) ** 2).sum(), int(ids[j])) for j in range(60) if j != i and g[j] == g[i])[:2]
        want += [(int(ids[i]), n) for _, n in near]
    assert got == sorted(want)
