"""Queries of graphs, clusters, layouts, models and dictionaries that take rounds over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import centrality, communities, corpus, density, dictionaries, elastic, embed, graph, layout, minibatch, mixed, neighbours, topics
from ..session import materialize
from .adapters import TRIPLES, comments, replies, table, triples, units
from .catalogue import _SEEDS, TOK, _counted, _dfm, in_list, lexicon, query

# --- graph


@query()
def kg_leiden(spark, d):
    return communities.leiden(graph.undirected(graph.edges(triples(spark, d))))


@query()
def kg_betweenness(spark, d):
    return centrality.betweenness(graph.edges(triples(spark, d)))


#: Suppliers and brands with at least so many lines in common, in both directions: paths of several steps.
_STRONG = 2
_BOTH = f"""arcs AS (SELECT subject AS a, object AS b FROM edges WHERE weight >= {_STRONG} GROUP BY ALL UNION SELECT object, subject FROM edges WHERE weight >= {_STRONG} GROUP BY ALL)"""
_STEPS = ", ".join(f"w{k} AS (SELECT l.a, r.b, sum(l.n) AS n FROM w{k - 1} l JOIN arcs r ON l.b = r.a GROUP BY ALL)" for k in range(2, 7))


@query(f"""WITH {TRIPLES}, {_BOTH}, w1 AS (SELECT a, b, 1::DOUBLE AS n FROM arcs), {_STEPS},
p AS (SELECT a, b, k, n FROM ({" UNION ALL ".join(f"SELECT a, b, {k} AS k, n FROM w{k}" for k in range(1, 7))}) WHERE a <> b QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY k) = 1),
s AS (SELECT x.b AS node, sum(x.n * y.n / z.n) AS s FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b AND z.k = x.k + y.k GROUP BY 1)
SELECT node, round(coalesce(s, 0), 4) + 0.0::DOUBLE AS betweenness FROM (SELECT DISTINCT a AS node FROM arcs) LEFT JOIN s USING (node)""")
def kg_betweenness_both(spark, d):
    """Walks of up to six steps hold every shortest path of this graph in SQL; the operator has no such bound."""
    e = graph.edges(triples(spark, d)).where(F.col("weight") >= _STRONG).select("subject", "object")
    both = e.unionByName(e.select(F.col("object").alias("subject"), F.col("subject").alias("object")))
    return centrality.betweenness(both).select("node", F.round("betweenness", 4).alias("betweenness"))


# --- clusters and layouts


@query()
def density_clusters(spark, d):
    return density.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 15, samples=5, method="leaf", metric="cosine")


@query()
def umap_layout(spark, d):
    x = layout.umap(table(spark, d, "embeddings"), "vec_id", "embedding", dims=2)
    return x.select("vec_id", F.col("at")[0].alias("x"), F.col("at")[1].alias("y"))


# --- embeddings of texts, and clusters of them


def _text_vectors(spark, d) -> DataFrame:
    """Of texts of unique ids, terms are counted within the row; else the texts are dealt by id."""
    c = comments(spark, d)
    if lexicon.ids_are_unique(c, "id"):
        return embed.row_vectors(c.select("id", T.without(T.tokens(F.col("body")), T.STOPWORDS).alias("t")), "id", F.col("t")).rows
    return embed.text_vectors(_dfm(spark, d)[1], "id").rows


@query()
def text_embeddings(spark, d):
    """Latent semantic vectors of whole documents; a document without a word has none."""
    return comments(spark, d).select("id").join(_text_vectors(spark, d), "id", "left")


@query()
def text_neighbours(spark, d):
    """The five documents nearest to each in meaning."""
    x = neighbours.nearest(_text_vectors(spark, d), "id", "embedding", 5, metric="cosine")
    return x.select("id", "nbr", "rank", "dist")


@query()
def minibatch_clusters(spark, d):
    """Fourteen clusters of the documents' vectors; none for a document without a word."""
    x = materialize(text_embeddings(spark, d), "text-vectors")
    return minibatch.fit(x, "id", "embedding", 14).assign(x, "embedding").select("id", "cluster", "distance")


# --- models


def _topic_model(spark, d):
    return topics.seeded_lda(lexicon.trim(_counted(spark, d), "id", 20, 10, 0.4, 3), "id", _SEEDS, residual=4)


@query()
def seeded_topics(spark, d):
    return _topic_model(spark, d).topics()


@query()
def topic_terms(spark, d):
    return _topic_model(spark, d).terms(15)


@query()
def mixed_logit(spark, d):
    c = replies(spark, d).select("link_id", (F.length("body") % 3 == 0).cast("double").alias("y"), F.log1p(F.length("body")).alias("log_length"), (F.col("author") == "assistant").cast("double").alias("assistant"))
    return mixed.mixed_logit(c, "y", ["log_length", "assistant"], "link_id")


@query()
def cascade_logit(spark, d):
    r = replies(spark, d).select("id", "parent_id", "link_id", (F.length("body") % 3 == 0).cast("double").alias("y"))
    p = r.select(F.concat(F.lit("t1_"), "id").alias("parent_id"), F.col("y").alias("parent_y"))
    return mixed.mixed_logit(r.join(p, "parent_id"), "y", ["parent_y"], "link_id")


SURFACE = ["n_words", "caps_ratio", "n_question", "n_exclaim", "n_2ndperson", "n_links", "depth"]


def _surface(spark, d) -> DataFrame:
    """Turns of conversations with the seven surface features; the number of words as log1p, an unknown depth as -1."""
    r = replies(spark, d).select("id", "body", F.coalesce(F.col("turn").cast("double"), F.lit(-1.0)).alias("depth"))
    x = corpus.text_features(r, "body")
    return x.select("id", F.log1p("n_words").alias("n_words"), *(F.col(c).cast("double").alias(c) for c in SURFACE[1:5]), T.link_count(F.col("body")).cast("double").alias("n_links"), "depth")


_Z = ", ".join(f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_samp({c}) OVER (), 0), 1), 5) + 0.0::DOUBLE AS {c}" for c in SURFACE)


@query(rf"""WITH t AS (SELECT conv_id || '-' || turn AS id, coalesce(text, '') AS x, turn FROM conversations),
f AS (SELECT id, ln(1 + len(regexp_extract_all(x, '\S+'))) AS n_words, len(regexp_extract_all(x, '[A-Z]')) / greatest(1, len(regexp_extract_all(x, '[A-Za-z]')))::DOUBLE AS caps_ratio, (length(x) - length(replace(x, '?', '')))::DOUBLE AS n_question,
  (length(x) - length(replace(x, '!', '')))::DOUBLE AS n_exclaim, len(list_filter({TOK.format('x')}, lambda w: w IN {in_list(T.SECOND_PERSON)}))::DOUBLE AS n_2ndperson, len(regexp_extract_all(x, 'https?://'))::DOUBLE AS n_links, coalesce(turn::DOUBLE, -1) AS depth FROM t)
SELECT id, {_Z} FROM f""")
def surface_seven(spark, d):
    """All seven, scaled by means and deviations of the whole corpus; a constant feature is divided by one."""
    x = _surface(spark, d)
    scale = x.agg(*(F.avg(c).alias(f"m_{c}") for c in SURFACE), *(F.stddev_samp(c).alias(f"s_{c}") for c in SURFACE))
    scaled = x.crossJoin(F.broadcast(scale))  # one row
    return scaled.select("id", *(F.round((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0), 5).alias(c) for c in SURFACE))


def _documents(spark, d) -> DataFrame:
    """Documents with the label of four levels, surface features, shares of frequent words, and whether the id is held out."""
    frequent = T.FUNCTION_WORDS[:24]
    c = corpus.text_features(comments(spark, d), "body").withColumn("toks", T.tokens(F.col("body")))
    share = [T.ratio(T.tokens_in(F.col("toks"), [w]), F.size("toks")) for w in frequent]
    x = c.select("id", F.array(F.log1p("n_words"), "caps_ratio", *(F.log1p(v) for v in SURFACE[2:5]), F.log1p(T.link_count(F.col("body"))), *share).alias("x"))
    truth = units(spark, d).select("id", "truth")
    return x.join(truth, "id").withColumn("test", F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) == 0)


def _trained(x: DataFrame) -> elastic.Path | None:
    return elastic.path(x.where("not test"), "truth", "x", key="id")


@query()
def elastic_net_path(spark, d):
    """The path of the classifier of four classes: penalties, held-out deviance, coefficients in use."""
    m = _trained(_documents(spark, d))
    rows = [] if m is None else [(i, float(p), float(v), float(e), int((abs(c[:, 1:]) > 0).any(axis=0).sum()), i == m.best, i == m.chosen, m.converged) for i, (p, v, e, c) in enumerate(zip(m.penalties, m.deviance, m.error, m.coefficients, strict=True))]
    return spark.createDataFrame(rows, "step int, penalty double, deviance double, se double, features int, best boolean, chosen boolean, converged boolean")


@query()
def distilled_held_out(spark, d):
    """Precision, recall and F1 of the trained classifier by class, on ids it has not seen."""
    x = _documents(spark, d)
    m = _trained(x)
    if m is None:
        return spark.createDataFrame([], "class string, n long, precision double, recall double, f1 double, accuracy double")
    names = F.array(*map(F.lit, m.classes))
    p = m.probabilities(F.col("x"))
    scored = x.where("test and truth is not null").select("truth", p.alias("p")).select("truth", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("pred"))
    cells = scored.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    by = cells.select(F.explode(names).alias("class"), "truth", "pred", "n").groupBy("class").agg(
        F.sum(F.when(F.col("truth") == F.col("class"), F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when((F.col("truth") == F.col("class")) & (F.col("pred") == F.col("class")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("pred") == F.col("class"), F.col("n")).otherwise(0)).alias("said"),
    )
    total = Window.partitionBy()  # a row a class
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return by.select("class", "n", rate(F.col("tp"), F.col("said")).alias("precision"), rate(F.col("tp"), F.col("n")).alias("recall"), rate(2 * F.col("tp"), F.col("n") + F.col("said")).alias("f1"), (F.sum("tp").over(total) / F.sum("n").over(total)).alias("accuracy"))


# --- dictionaries

_TONE = {"positive": ["with", "for", "that*"], "negative": ["from", "was", "by"], "neg_positive": ["not with", "not for", "not that*", "not at all with"], "neg_negative": ["not from", "not was", "not by", "never * from"]}
_POS = "(w = 'with' OR w = 'for' OR starts_with(w, 'that'))"
_NEG = "w IN ('from', 'was', 'by')"


@query(rf"""WITH x AS (SELECT doc_id AS id, {TOK.format("text")} AS t FROM documents),
u AS (SELECT id, len(t) AS k, i, t[i] AS w, coalesce(t[i - 1], '') AS p, coalesce(t[i - 2], '') AS p2, coalesce(t[i - 3], '') AS p3 FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM x)),
h AS (SELECT id, w, i > 1 AND p = 'not' AS n1, i > 2 AND p2 = 'never' AS n2, i > 3 AND p3 = 'not' AND p2 = 'at' AND p = 'all' AS n3, lead(w, 1, '') OVER (PARTITION BY id ORDER BY i) AS f, lead(i > 2 AND p2 = 'never' AND w = 'from', 1, false) OVER (PARTITION BY id ORDER BY i) AS covered,
  lead(i > 2 AND p2 = 'never' AND w = 'from', 2, false) OVER (PARTITION BY id ORDER BY i) AS c2 FROM u),
g AS (SELECT id, count(*) FILTER ({_POS} AND NOT n1 AND NOT (n3 AND w = 'with') AND NOT covered) AS positive, count(*) FILTER ({_NEG} AND NOT n1 AND NOT (n2 AND w = 'from') AND NOT covered) AS negative,
  count(*) FILTER ({_POS} AND n1) + count(*) FILTER (n3 AND w = 'with') AS neg_positive, count(*) FILTER ({_NEG} AND n1 AND NOT (n2 AND w = 'from')) + count(*) FILTER (n2 AND w = 'from') AS neg_negative FROM h GROUP BY id)
SELECT x.id, (coalesce(positive, 0) + coalesce(neg_negative, 0))::BIGINT AS pos, (coalesce(negative, 0) + coalesce(neg_positive, 0))::BIGINT AS neg,
  round((coalesce(positive, 0) + coalesce(neg_negative, 0) - coalesce(negative, 0) - coalesce(neg_positive, 0)) / greatest(1, coalesce(len(t), 0))::DOUBLE, 6) + 0.0::DOUBLE AS tone,
  CASE WHEN coalesce(positive, 0) + coalesce(neg_negative, 0) > coalesce(negative, 0) + coalesce(neg_positive, 0) THEN 'trust' WHEN coalesce(positive, 0) + coalesce(neg_negative, 0) < coalesce(negative, 0) + coalesce(neg_positive, 0) THEN 'distrust' ELSE 'non_evaluative' END AS label
FROM x LEFT JOIN g USING (id)""")
def phrase_tone(spark, d):
    """Net tone with negation by phrases of up to four words."""
    c = comments(spark, d).select("id", T.tokens(F.col("body")).alias("t"))
    x = c.select("id", dictionaries.tone(F.col("t"), _TONE).alias("x"))
    return x.select("id", "x.pos", "x.neg", F.round("x.tone", 6).alias("tone"), "x.label")


@query(rf"""WITH b AS (SELECT {TOK.format("text")} AS t FROM benchmark WHERE text IS NOT NULL),
words AS (SELECT DISTINCT w FROM (SELECT unnest(t) AS w FROM b) WHERE length(w) >= 5), pairs AS (SELECT DISTINCT t[i] AS w, t[i + 1] AS n FROM (SELECT t, unnest(range(1, len(t))) AS i FROM b)),
x AS (SELECT doc_id AS id, {TOK.format("text")} AS t FROM documents),
u AS (SELECT id, i, t[i] AS w, t[i + 1] AS n FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM x)),
m AS (SELECT u.*, pairs.w IS NOT NULL AS pair FROM u LEFT JOIN pairs ON u.w = pairs.w AND u.n = pairs.n),
f AS (SELECT m.id, pair, words.w IS NOT NULL AND NOT pair AND NOT lag(pair, 1, false) OVER (PARTITION BY id ORDER BY i) AS word FROM m LEFT JOIN words ON m.w = words.w)
SELECT x.id, count(*) FILTER (word) AS word, count(*) FILTER (pair) AS pair FROM x LEFT JOIN f USING (id) GROUP BY x.id""")
def large_dictionary(spark, d):
    """A dictionary of the benchmark's longer words and its pairs of words, some thousands of entries; a word within a pair does not count."""
    b = table(spark, d, "benchmark").select(T.tokens(F.col("text")).alias("t"))
    words = b.select(F.explode("t").alias("e")).where(F.length("e") >= 5)
    pairs = b.where(F.size("t") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.get("t", i - 1), F.get("t", i)))).alias("e"))
    held = {"word": dictionaries.entries_of(words, "e"), "pair": dictionaries.entries_of(pairs, "e")}
    c = comments(spark, d).select("id", T.tokens(F.col("body")).alias("t"))
    return c.select("id", dictionaries.counts(F.col("t"), held).alias("k")).select("id", "k.*")


_URL = r"(?i)\b(?:https?://|ftp://|www\.)\S+"


@query(rf"""WITH x AS (SELECT page_id AS id, list_filter(regexp_extract_all(lower(regexp_replace(html, '{_URL}', ' ', 'g')), '[\p{{L}}\p{{N}}\p{{M}}]+(?:[''’\-][\p{{L}}\p{{N}}\p{{M}}]+)*'), lambda t: regexp_matches(t, '\p{{L}}')) AS t FROM pages)
SELECT id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS n_types, md5(array_to_string(t, ' ')) AS words_md5 FROM x""")
def plain_words(spark, d):
    """Tokens of raw pages without addresses, numbers, punctuation and symbols."""
    x = table(spark, d, "pages").select(F.col("page_id").alias("id"), dictionaries.plain_tokens(F.col("html")).alias("t"))
    return x.select("id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_types"), F.md5(F.array_join("t", " ")).alias("words_md5"))
