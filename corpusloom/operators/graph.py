"""Graph operators: entity names, signed edges, degree, core, betweenness, communities, modularity, groundedness."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Entity rules in order (a later match wins), words that stay small in titles, aliases, stop words of the grounding check.
ENTITY_RULES = [
    ("ChatGPT", r"^(chat ?gpt|gpt[- ]?[0-9.]*[a-z]*|4o|o[0-9]|openai's model.*)$"),
    ("OpenAI", r"^(open ?ai|openai inc.*)$"),
    ("Claude", r"^(claude.*)$"),
    ("Anthropic", r"^(anthropic.*)$"),
    ("Gemini", r"^(gemini.*|bard)$"),
    ("Google", r"^(google|alphabet|deepmind|google deepmind)$"),
    ("DeepSeek", r"^(deep ?seek.*)$"),
    ("Llama", r"^(llama.*|meta ai)$"),
    ("Meta", r"^(meta|facebook)$"),
    ("Grok", r"^(grok.*)$"),
    ("Sam Altman", r"^(sam altman|altman)$"),
    ("Elon Musk", r"^(elon musk|musk|elon)$"),
    ("Midjourney", r"^(midjourney.*)$"),
    ("AI (general)", r"^(ai|a\.i\.|artificial intelligence|generative ai|gen ?ai|llms?|large language models?|ai models?)$"),
]
SMALL_WORDS = "a an and are as at be but by en for if in is nor not of on or per so the to v v. via vs from into than that with".split()
ALIASES = {
    "chatgpt": ["chatgpt", "chat gpt", "gpt", "4o", "openai's model"],
    "openai": ["openai", "open ai"],
    "claude": ["claude"],
    "gemini": ["gemini", "bard"],
    "google": ["google", "alphabet", "deepmind"],
    "anthropic": ["anthropic"],
    "grok": ["grok"],
    "deepseek": ["deepseek", "deep seek"],
    "ai (general)": ["ai", "a.i.", "artificial intelligence", "llm", "llms", "generative ai", "genai", "large language model"],
}
GROUNDING_STOP = ["the", "and", "for", "with", "of", "a", "an", "to", "in", "on", "its"]
EDGE_KEY = ["subject", "subject_type", "relation", "object", "object_type"]


def title_case(c: Column) -> Column:
    """Words with a capital, small words inside a title without."""
    words = F.split(c, " ")
    cased = F.transform(words, lambda w, i: F.when((i > 0) & w.isin(SMALL_WORDS), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100_000))))
    return F.array_join(cased, " ")


def canonical_entity(c: Column) -> Column:
    """An entity's name by the rules, else itself in title case, without trailing punctuation."""
    v = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\p{Punct}+$", ""))), r"\s+", " ")
    named = reduce(lambda w, r: w.when(v.rlike(r[1]), F.lit(r[0])), ENTITY_RULES[-2::-1], F.when(v.rlike(ENTITY_RULES[-1][1]), F.lit(ENTITY_RULES[-1][0])))
    return named.otherwise(title_case(v))


def clean_triples(triples: DataFrame) -> DataFrame:
    """Canonical endpoints; empty ones and self-loops dropped."""
    t = triples.withColumns({"subject": canonical_entity(F.col("subject")), "object": canonical_entity(F.col("object"))})
    return t.where("length(subject) > 0 and length(object) > 0 and subject <> object")


def edges(triples: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key..., weight, trusting, distrusting, sign): triples summed by their five parts."""
    g = triples.groupBy(*(key or EDGE_KEY)).agg(F.count(F.lit(1)).alias("weight"), F.count_if(F.col("valence") == "trusting").alias("trusting"), F.count_if(F.col("valence") == "distrusting").alias("distrusting"))
    return g.withColumn("sign", F.signum(F.col("trusting") - F.col("distrusting")).cast("int"))


def degree(edge: DataFrame, src: str = "subject", dst: str = "object") -> DataFrame:
    """(node, degree): in and out, parallel edges counted."""
    return edge.select(F.explode(F.array(src, dst)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def undirected(edge: DataFrame, src: str = "subject", dst: str = "object", weight: str = "weight") -> DataFrame:
    """(a, b, weight): direction and parallel edges collapsed."""
    return edge.where(F.col(src) != F.col(dst)).groupBy(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).agg(F.sum(weight).alias("weight"))


def core(edge: DataFrame, least: int, src: str = "subject", dst: str = "object") -> DataFrame:
    """The edges between nodes of at least that degree."""
    keep = degree(edge, src, dst).where(F.col("degree") >= least).select("node")
    return edge.join(keep.withColumnRenamed("node", src), src, "left_semi").join(keep.withColumnRenamed("node", dst), dst, "left_semi")


def node_types(edge: DataFrame) -> DataFrame:
    """(node, type): the type at a node's heaviest edge, as subject before object."""
    sides = edge.select(F.col("subject").alias("node"), F.col("subject_type").alias("type"), "weight", F.lit(0).alias("side")).unionByName(edge.select(F.col("object").alias("node"), F.col("object_type").alias("type"), "weight", F.lit(1).alias("side")))
    w = Window.partitionBy("node").orderBy("side", F.desc("weight"), "type")
    return sides.withColumn("r", F.row_number().over(w)).where("r = 1").select("node", "type")


def entity_valence(triples: DataFrame) -> DataFrame:
    """(node, trusting, distrusting, net): valences of all triples that a node is an end of."""
    return triples.select(F.explode(F.array("subject", "object")).alias("node"), "valence").groupBy("node").agg(
        F.count_if(F.col("valence") == "trusting").alias("trusting"), F.count_if(F.col("valence") == "distrusting").alias("distrusting")
    ).withColumn("net", F.col("trusting") - F.col("distrusting"))


def members(nodes: DataFrame, group: str, top: int) -> DataFrame:
    """(group, n, members): the names of each group's nodes of highest degree, joined."""
    w = Window.partitionBy(group).orderBy(F.desc("degree"), "node")
    ranked = nodes.withColumns({"r": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy(group))}).where(F.col("r") <= top)
    return ranked.groupBy(group).agg(F.max("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "node"))), lambda x: x["node"].cast("string")), ", ").alias("members"))


def _small(edge: DataFrame, most: int, *columns: str) -> list[tuple]:
    rows = [tuple(r) for r in edge.select(*columns).distinct().limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"this algorithm holds the graph in memory: more than {most} edges")
    return rows


def betweenness(edge: DataFrame, src: str = "subject", dst: str = "object", most: int = 2_000_000) -> DataFrame:
    """(node, betweenness): directed, unweighted, not normalised; exact. Sources are spread over the cluster.

    Each task holds the adjacency, which is refused above `most` edges; the
    graph of entities is small by construction.
    """
    spark, pairs = edge.sparkSession, _small(edge, most, src, dst)
    names = sorted({x for p in pairs for x in p})
    number = {n: i for i, n in enumerate(names)}
    out: list[list[int]] = [[] for _ in names]
    for a, b in pairs:
        if a != b:
            out[number[a]].append(number[b])
    shared = spark.sparkContext.broadcast(out)  # at most `most` edges

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nxt, total = shared.value, defaultdict(float)
        for part in parts:
            for s in part["id"]:
                dist, paths, before, order = {s: 0}, {s: 1.0}, defaultdict(list), []
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in nxt[v]:
                        if w not in dist:
                            dist[w], paths[w] = dist[v] + 1, 0.0
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                flow = defaultdict(float)
                for w in reversed(order):
                    for v in before[w]:
                        flow[v] += paths[v] / paths[w] * (1 + flow[w])
                    if w != s:
                        total[w] += flow[w]
        yield pd.DataFrame({"i": list(total), "b": list(total.values())}, dtype=None).astype({"i": "int64", "b": "float64"})

    scores = spark.range(len(names)).mapInPandas(run, "i long, b double").groupBy("i").agg(F.sum("b").alias("betweenness"))
    nodes = spark.createDataFrame(list(enumerate(names)), "i long, node string" if not names or isinstance(names[0], str) else "i long, node long")
    return nodes.join(scores, "i", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def communities(graph: DataFrame, most: int = 2_000_000, seed: int = 1) -> DataFrame:
    """(node, community) of an undirected graph (a, b, weight): weighted modularity, moved node by node and aggregated, parts kept connected.

    Runs on the driver for graphs up to `most` edges, as entity graphs are.
    """
    import random

    rows = _small(graph, most, "a", "b", "weight")
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    at = {n: i for i, n in enumerate(names)}
    adjacency: list[dict[int, float]] = [defaultdict(float) for _ in names]
    for a, b, w in rows:
        adjacency[at[a]][at[b]] += float(w)
        adjacency[at[b]][at[a]] += float(w)
    rng, label = random.Random(seed), list(range(len(names)))
    total = sum(sum(x.values()) for x in adjacency) or 1.0
    level, own = adjacency, [0.0] * len(names)
    while True:
        n = len(level)
        strength = [sum(x.values()) + 2 * own[i] for i, x in enumerate(level)]
        part, weight = list(range(n)), list(strength)
        moved, order = True, list(range(n))
        any_moved = False
        while moved:
            moved = False
            rng.shuffle(order)
            for v in order:
                links = defaultdict(float)
                for u, w in level[v].items():
                    if u != v:
                        links[part[u]] += w
                weight[part[v]] -= strength[v]
                gain = lambda c: links.get(c, 0.0) - weight[c] * strength[v] / total  # noqa: B023, E731
                best = max(sorted({part[v], *links}), key=lambda c: (gain(c), c == part[v]))
                if best != part[v] and gain(best) > gain(part[v]) + 1e-12:
                    part[v], moved, any_moved = best, True, True
                weight[part[v]] += strength[v]
        if not any_moved:
            break
        # a part that fell apart becomes as many parts as it has connected pieces
        piece, fresh = [-1] * n, 0
        for v in range(n):
            if piece[v] < 0:
                queue, piece[v] = deque([v]), fresh
                while queue:
                    u = queue.popleft()
                    for x in level[u]:
                        if piece[x] < 0 and part[x] == part[v]:
                            piece[x] = fresh
                            queue.append(x)
                fresh += 1
        label = [piece[c] for c in label]
        merged: list[dict[int, float]] = [defaultdict(float) for _ in range(fresh)]
        inner = [0.0] * fresh
        for v in range(n):
            inner[piece[v]] += own[v]
            for u, w in level[v].items():
                if piece[u] == piece[v]:
                    inner[piece[v]] += w / 2
                else:
                    merged[piece[v]][piece[u]] += w
        if fresh == n:
            break
        level, own = merged, inner
    sizes = defaultdict(int)
    for c in label:
        sizes[c] += 1
    rank = {c: i for i, c in enumerate(sorted(sizes, key=lambda c: (-sizes[c], c)), 1)}
    kind = "string" if not names or isinstance(names[0], str) else "long"
    return graph.sparkSession.createDataFrame([(n, rank[c]) for n, c in zip(names, label, strict=True)], f"node {kind}, community long")


def label_propagation(graph: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, community) for graphs too large for one machine: each node takes the label its neighbours' weight favours, the smaller of equals."""
    both = graph.select("a", "b", "weight").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("m")).select(F.col("a").alias("node"), F.col("m.community").alias("community"))
        labels = materialize(best, "labels")
    return labels


def modularity(graph: DataFrame, labels: DataFrame, weighted: bool = False) -> DataFrame:
    """(modularity) of a partition (node, community) of an undirected graph (a, b, weight)."""
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    e = graph.select("a", "b", w.alias("w"))
    e = e.join(labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    ends = e.select(F.explode(F.array("ca", "cb")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("k"))
    total = e.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    squares = ends.agg(F.sum(F.col("k") * F.col("k")).alias("s"))
    return total.crossJoin(squares).select((F.col("inside") / F.col("m") - F.col("s") / (4 * F.col("m") * F.col("m"))).alias("modularity"))  # one row each


def grounded(entity: Column, text: Column) -> Column:
    """Whether an alias of the entity, or a word of its name, occurs in the text."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " ")
    padded = F.concat(F.lit(" "), F.regexp_replace(norm(text), " +", " "), F.lit(" "))
    words = F.split(F.trim(norm(entity)), " +")
    strong = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(GROUNDING_STOP))
    used = F.when(F.size(strong) > 0, strong).otherwise(F.filter(words, lambda w: F.length(w) > 0))
    by_word = F.exists(used, lambda w: padded.contains(F.concat(F.lit(" "), w)))
    by_alias = reduce(lambda a, b: a | b, [(F.lower(F.trim(entity)) == k) & reduce(lambda p, q: p | q, [padded.contains(f" {norm_alias(a)} ") for a in v]) for k, v in ALIASES.items()])
    return by_alias | by_word


def whole_word(entity: Column, text: Column) -> Column:
    """Whether the entity's name occurs in the text as whole words."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.concat(F.lit(" "), norm(text), F.lit(" ")).contains(F.concat(F.lit(" "), norm(entity), F.lit(" ")))


def grounded_shares(checked: DataFrame, subject: str, obj: str) -> DataFrame:
    """(n, subject_share, object_share, both_share) of triples whose ends occur in their texts."""
    share = lambda c: F.avg(c.cast("double"))
    return checked.agg(F.count(F.lit(1)).alias("n"), share(F.col(subject)).alias("subject_share"), share(F.col(obj)).alias("object_share"), share(F.col(subject) & F.col(obj)).alias("both_share"))


def norm_alias(alias: str) -> str:
    import re

    return re.sub(" +", " ", re.sub("[^a-z0-9 ]+", " ", alias)).strip()
