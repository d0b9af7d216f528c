"""Queries of samples, annotators and instruments: designs, reliability, scores by split and variant, association tables, checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codebook
from ..operators import agreement, annotate, corpus, estimate, graph, learn, report, sampling
from .adapters import FRAME, TRIPLES, UNITS, comments, frame, table, triples, units
from .catalogue import _TAIL, CELLS, CROSS, SYS, in_list, long_labels, picked, query

LEVELS = codebook.LEVELS["stance"]


# --- samples


@query(SYS + " SELECT p.id, p.stratum, f.venue FROM picked p JOIN frame f ON f.id = p.id AND f.stratum = p.stratum")
def composite_merge(spark, d):
    f, s = picked(spark, d)
    return s.select("id", "stratum").join(f.select("id", "stratum", "venue"), on=["id", "stratum"])


@query(SYS + """, p AS (SELECT venue, count(*) AS n FROM frame GROUP BY 1), s AS (SELECT venue, count(*) AS m, sum(pop_n / alloc_n::DOUBLE) AS w FROM picked GROUP BY 1)
SELECT venue, round(n / (sum(n) OVER ())::DOUBLE, 6) AS population_share, round(coalesce(m, 0) / (sum(m) OVER ())::DOUBLE, 6) AS sample_share, round(coalesce(w, 0) / sum(w) OVER (), 6) AS weighted_share FROM p LEFT JOIN s USING (venue)""")
def sample_composition(spark, d):
    f, s = picked(spark, d)
    x = sampling.composition(f, s.withColumn("w", F.col("pop_n") / F.col("alloc_n")), "venue", "w")
    return x.select("venue", *(F.round(c, 6).alias(c) for c in ("population_share", "sample_share", "weighted_share")))


@query(SYS + """, p AS (SELECT strftime(created, '%Y-%m') AS ym, count(*) AS n FROM frame GROUP BY 1), s AS (SELECT strftime(created, '%Y-%m') AS ym, count(*) AS m, sum(pop_n / alloc_n::DOUBLE) AS w FROM picked GROUP BY 1)
SELECT ym, round(n / (sum(n) OVER ())::DOUBLE, 6) AS population_share, round(coalesce(w, 0) / sum(w) OVER (), 6) AS weighted_share FROM p LEFT JOIN s USING (ym)""")
def month_balance(spark, d):
    f, s = picked(spark, d)
    ym = F.date_format("created", "yyyy-MM")
    x = sampling.composition(f.withColumn("ym", ym), s.withColumns({"ym": ym, "w": F.col("pop_n") / F.col("alloc_n")}), "ym", "w")
    return x.select("ym", F.round("population_share", 6).alias("population_share"), F.round("weighted_share", 6).alias("weighted_share"))


_GOLD = SYS + ", g AS (SELECT id, stratum, user_id, alloc_n / pop_n::DOUBLE AS pi FROM picked QUALIFY row_number() OVER (ORDER BY md5('gold:' || id), id) <= 200)"


@query(_GOLD + ", m AS (SELECT (SELECT count(*) FROM g) AS drawn, (SELECT count(*) FROM g WHERE user_id % 17 <> 0) AS eligible, (SELECT count(*) FROM picked) AS annotated) SELECT id, round(pi * drawn / annotated, 8) AS pi_drawn, round(pi * eligible / annotated, 8) AS pi_eligible FROM g, m WHERE user_id % 17 <> 0")
def two_stage_probability(spark, d):
    """Both variants of the second stage: units drawn for it, and units still eligible."""
    s = picked(spark, d)[1].withColumn("pi", F.col("alloc_n") / F.col("pop_n"))
    gold = sampling.simple_random(s, 200, "gold", "id")
    counts = s.agg(F.count(F.lit(1)).alias("annotated")).crossJoin(gold.agg(F.count(F.lit(1)).alias("drawn"), F.count_if(F.col("user_id") % 17 != 0).alias("eligible")))
    x = gold.where(F.col("user_id") % 17 != 0).crossJoin(F.broadcast(counts))  # one row
    return x.select("id", *(F.round(sampling.two_stage_probability(F.col("pi"), F.col(c), F.col("annotated")), 8).alias(f"pi_{c}") for c in ("drawn", "eligible")))


@query(SYS + """, n AS (SELECT stratum, count(*) AS new_n FROM frame WHERE user_id % 17 <> 0 GROUP BY 1), k AS (SELECT stratum, count(*) AS m FROM picked WHERE user_id % 17 <> 0 GROUP BY 1)
SELECT round(100 * avg(abs(new_n / m::DOUBLE - pop_n / alloc_n::DOUBLE)) / avg(pop_n / alloc_n::DOUBLE), 6) AS mean_change_pct FROM picked JOIN n USING (stratum) JOIN k USING (stratum) WHERE user_id % 17 <> 0""")
def weight_change(spark, d):
    f, s = picked(spark, d)
    s = s.withColumns({"incl_prob": F.col("alloc_n") / F.col("pop_n"), "old_weight": F.col("pop_n") / F.col("alloc_n")})
    out = sampling.correct_frame(s, f.where(F.col("user_id") % 17 != 0), "id", "stratum")
    return sampling.weight_change(out.where("eligible"), "old_weight", "design_weight").select(F.round("mean_change_pct", 6).alias("mean_change_pct"))


@query(f"WITH {FRAME}, g AS (SELECT count(DISTINCT venue) AS k FROM frame) SELECT id, venue FROM frame, g QUALIFY row_number() OVER (PARTITION BY venue ORDER BY md5('even:' || id), id) <= ceil(600 / k::DOUBLE)")
def even_sample(spark, d):
    """600 rows shared out evenly: at most ceil(600 / groups) of each group."""
    f = frame(spark, d).select("id", "venue")
    groups = f.agg(F.count_distinct("venue")).first()[0]
    return sampling.capped_by_group(f, "venue", -(-600 // max(1, groups)), "even", "id")


@query(f"WITH {TRIPLES} SELECT subject, relation, object, weight FROM edges ORDER BY md5('precision:' || subject || ':' || relation || ':' || object), subject, relation, object LIMIT 100")
def precision_sample(spark, d):
    e = graph.edges(triples(spark, d)).select("subject", "relation", "object", "weight")
    return e.orderBy(sampling.hash_order("precision", "subject", "relation", "object"), "subject", "relation", "object").limit(100)


@query(f"WITH {TRIPLES} SELECT node, count(*) AS degree FROM (SELECT unnest([subject, object]) AS node FROM edges) GROUP BY 1 ORDER BY degree DESC, node LIMIT 40")
def kg_central(spark, d):
    return graph.degree(graph.edges(triples(spark, d))).orderBy(F.desc("degree"), "node").limit(40)


# --- reliability


@query(f"""WITH {UNITS}, l AS (SELECT 'stance' AS variable, a, b FROM u WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), CAST(n_words % 2 AS VARCHAR) FROM u WHERE toxic IS NOT NULL),
c AS (SELECT variable, count(*) AS n, count(*) FILTER (a = b) AS same, avg(((a IN ('trust', '1'))::INT + (b IN ('trust', '1'))::INT) / 2.0::DOUBLE) AS prevalence FROM l GROUP BY 1), v AS (SELECT variable, v, count(*) AS m FROM (SELECT variable, unnest([a, b]) AS v FROM l) GROUP BY ALL), s AS (SELECT variable, sum(m::DOUBLE * m) AS sq, count(*) AS k FROM v GROUP BY 1),
r AS (SELECT variable, n, CASE WHEN k > 1 THEN 1 - (1 - same / n::DOUBLE) / ((1 - sq / (4.0::DOUBLE * n * n)) * 2 * n / (2 * n - 1)) END AS alpha, prevalence FROM c JOIN s USING (variable))
SELECT variable, n, round(alpha, 6) AS alpha, round(prevalence, 6) AS prevalence, alpha < 0.667 AS low FROM r""")
def reliability_table(spark, d):
    u = units(spark, d).withColumn("odd", F.col("n_words") % 2)
    pairs = agreement.long_pairs(u, {"stance": ("a", "b"), "toxic": ("toxic", "odd")})
    x = agreement.reliability(pairs, {"stance": "trust", "toxic": "1"})
    return x.select("variable", "n", F.round("alpha", 6).alias("alpha"), F.round("prevalence", 6).alias("prevalence"), "low")


@query(f"WITH {UNITS} SELECT id, coalesce(truth, a) AS label, CASE WHEN truth IS NOT NULL THEN 'adjudicated' WHEN a IS NOT NULL THEN 'provisional' END AS standard FROM u")
def provisional_standard(spark, d):
    return agreement.provisional(units(spark, d), "truth", "a").select("id", F.col("label__").alias("label"), F.col("standard__").alias("standard"))


@query(f"WITH {UNITS} SELECT id, CASE WHEN toxic IS NULL THEN NULL ELSE toxic = 1 AND n_words % 2 = 1 END AS flag, CASE WHEN toxic IS NULL THEN NULL ELSE (toxic = 1) <> (n_words % 2 = 1) END AS flag_disputed FROM u")
def adjudicate_flags(spark, d):
    u = units(spark, d).withColumns({"x": F.col("toxic") == 1, "y": F.col("n_words") % 2 == 1})
    return agreement.adjudicate_flag(u, "flag", "x", "y").select("id", "flag", "flag_disputed")


@query(f"WITH {UNITS} SELECT id, a, b FROM u WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b")
def disagreements(spark, d):
    return agreement.disagreements(units(spark, d), "a", "b").select("id", "a", "b")


@query(f"""WITH {UNITS}, v AS (SELECT id, unnest([a, b, truth]) AS s FROM u), n AS (SELECT id, s, count(*) AS n FROM v WHERE s IS NOT NULL GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY id) AS most FROM n),
w AS (SELECT id, max(most) AS votes_for, count(*) FILTER (n = most) > 1 AS tie FROM m GROUP BY id) SELECT votes_for, tie, count(*) AS units FROM w GROUP BY ALL""")
def vote_summary(spark, d):
    v = units(spark, d).select("id", F.explode(F.array("a", "b", "truth")).alias("s"))
    return agreement.majority_vote(v, "id", "s").groupBy("votes_for", "tie").agg(F.count(F.lit(1)).alias("units"))


# --- scores


def _f(cells: str, by: str) -> str:
    """Classes and their F1 from cells (by..., truth, pred, n)."""
    return f"""sides AS (SELECT {by}, truth AS class, n AS t, 0 AS p, CASE WHEN truth = pred THEN n ELSE 0 END AS hit FROM {cells} UNION ALL SELECT {by}, pred, 0, n, 0 FROM {cells}),
f AS (SELECT {by}, class, sum(t) AS n, coalesce(2.0::DOUBLE * sum(hit) / nullif(sum(t) + sum(p), 0), 0) AS f1 FROM sides GROUP BY ALL)"""


_SPLIT = "CASE WHEN id % 3 = 0 THEN 'dev' ELSE 'test' END"
_PASSES = f"""WITH {UNITS}, l AS (SELECT 'A' AS pass, {_SPLIT} AS split, truth, a AS pred FROM u UNION ALL SELECT 'B', {_SPLIT}, truth, b FROM u), every AS (SELECT * FROM l UNION ALL SELECT pass, 'all', truth, pred FROM l),
cells AS (SELECT pass, split, truth, pred, count(*) AS n FROM every WHERE truth IS NOT NULL AND pred IS NOT NULL GROUP BY ALL), {_f('cells', 'pass, split')},
m AS (SELECT pass, split, avg(f1) FILTER (n > 0) AS macro_f1 FROM f GROUP BY ALL), c AS (SELECT pass, split, sum(n)::BIGINT AS n, sum(n) FILTER (truth = pred) / sum(n)::DOUBLE AS accuracy FROM cells GROUP BY ALL),
g AS (SELECT p.pass, s.split FROM (SELECT unnest(['A', 'B', 'C']) AS pass) p, (SELECT unnest(['test', 'dev', 'all']) AS split) s)
SELECT pass, split, coalesce(n, 0) AS n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM g LEFT JOIN c USING (pass, split) LEFT JOIN m USING (pass, split)"""


@query(_PASSES)
def pass_scores(spark, d):
    """Passes by split; pass C has no rows and is listed with none."""
    u = units(spark, d).withColumn("split", F.when(F.col("id") % 3 == 0, "dev").otherwise("test"))
    rows = u.select("split", "truth", F.inline(F.array(*(F.struct(F.lit(k).alias("pass"), F.col(c).alias("pred")) for k, c in (("A", "a"), ("B", "b"))))))
    x = agreement.pass_scores(rows, ["A", "B", "C"], ["test", "dev", "all"])
    return x.select("pass", "split", "n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


_VARIANTS = f"""WITH {UNITS}, l AS (SELECT v.variant, x.variable, x.truth, x.pred FROM u, (SELECT unnest(['full', 'compact']) AS variant) v, LATERAL (SELECT unnest([{{'variable': 'stance', 'truth': truth, 'pred': CASE WHEN v.variant = 'full' THEN a ELSE b END}}, {{'variable': 'toxic', 'truth': CAST(toxic AS VARCHAR), 'pred': CAST(CASE WHEN v.variant = 'full' THEN n_words % 2 ELSE n_chars % 2 END AS VARCHAR)}}, {{'variable': 'quality', 'truth': CAST(quality AS VARCHAR), 'pred': CAST(CASE WHEN v.variant = 'full' THEN n_chars % 2 ELSE n_words % 2 END AS VARCHAR)}}], recursive := true)) x),
cells AS (SELECT variant, variable, truth, pred, count(*) AS n FROM l WHERE truth IS NOT NULL AND pred IS NOT NULL GROUP BY ALL), {_f('cells', 'variant, variable')}, m AS (SELECT variant, variable, avg(f1) FILTER (n > 0) AS macro FROM f GROUP BY ALL)
SELECT variant, round(max(macro) FILTER (variable = 'stance'), 6) AS stance, round(max(macro) FILTER (variable = 'toxic'), 6) AS toxic, round(max(macro) FILTER (variable = 'quality'), 6) AS quality, round(avg(macro), 6) AS mean_f1 FROM m GROUP BY 1"""


@query(_VARIANTS)
def variant_table(spark, d):
    odd = lambda c: (F.col(c) % 2).cast("string")
    row = lambda variant, variable, truth, pred: F.struct(F.lit(variant).alias("variant"), F.lit(variable).alias("variable"), truth.cast("string").alias("truth"), pred.alias("pred"))
    t, q, s = F.col("toxic"), F.col("quality"), F.col("truth")
    rows = [row("full", "stance", s, F.col("a")), row("compact", "stance", s, F.col("b")), row("full", "toxic", t, odd("n_words")), row("compact", "toxic", t, odd("n_chars")), row("full", "quality", q, odd("n_chars")), row("compact", "quality", q, odd("n_words"))]
    x = agreement.variant_table(units(spark, d).select(F.inline(F.array(*rows))), ["stance", "toxic", "quality"])
    return x.select("variant", *(F.round(c, 6).alias(c) for c in ("stance", "toxic", "quality", "mean_f1")))


_HELD = f"""WITH {UNITS}, t AS (SELECT doc_id AS id FROM labels WHERE doc_id % 5 = 0), tr AS (SELECT id FROM u WHERE a IS NOT NULL AND id NOT IN (SELECT id FROM t)), te AS (SELECT truth, a AS pred FROM u WHERE id IN (SELECT id FROM t) AND truth IS NOT NULL AND a IS NOT NULL),
cells AS (SELECT 1 AS one, truth, pred, count(*) AS n FROM te GROUP BY ALL), {_f('cells', 'one')}
SELECT (SELECT count(*) FROM tr) AS n_train, (SELECT count(*) FROM te) AS n_test, round((SELECT sum(n) FILTER (truth = pred) / sum(n)::DOUBLE FROM cells), 6) AS accuracy, round((SELECT avg(f1) FILTER (n > 0) FROM f), 6) AS macro_f1"""


@query(_HELD)
def held_out_scores(spark, d):
    """Machine labels to train on without the human test ids, and the labels' scores on those."""
    u = units(spark, d)
    test = table(spark, d, "labels").where(F.col("doc_id") % 5 == 0).select(F.col("doc_id").alias("id"))
    train = learn.training_rows(u, "a", test, "id")
    x = agreement.held_out(u.join(test, "id", "left_semi"), "truth", "a").crossJoin(train.agg(F.count(F.lit(1)).alias("n_train")))  # one row each
    return x.select("n_train", F.col("n").alias("n_test"), F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query(f"WITH {UNITS}, m AS (SELECT avg(ln(1 + n_words)) AS m1, stddev_samp(ln(1 + n_words)) AS s1, avg(n_chars / greatest(1, n_words)::DOUBLE) AS m2, stddev_samp(n_chars / greatest(1, n_words)::DOUBLE) AS s2 FROM u) SELECT id, round((ln(1 + n_words) - m1) / s1, 5) AS log_words, round((n_chars / greatest(1, n_words)::DOUBLE - m2) / s2, 5) AS chars_per_word FROM u, m")
def surface_features(spark, d):
    u = units(spark, d).select("id", F.log1p("n_words").alias("log_words"), (F.col("n_chars") / F.greatest(F.lit(1), "n_words")).alias("chars_per_word"))
    return estimate.zscore(u, ["log_words", "chars_per_word"]).select("id", F.round("log_words", 5).alias("log_words"), F.round("chars_per_word", 5).alias("chars_per_word"))


# --- estimates


@query(f"""WITH {UNITS} SELECT venue AS topic, venue < 'src5' AS seeded, count(*) AS n, {', '.join(f"round(avg((a = '{v}')::INT::DOUBLE), 6) AS {v}" for v in LEVELS)} FROM u WHERE a IS NOT NULL GROUP BY ALL""")
def topic_outcome(spark, d):
    u = units(spark, d).where("a is not null").withColumn("seeded", F.col("venue") < "src5")
    g = report.outcome_table(u, ["venue", "seeded"], "a", LEVELS)
    return g.select(F.col("venue").alias("topic"), "seeded", "n", *(F.round(v, 6).alias(v) for v in LEVELS))


@query(CROSS + """, e AS (SELECT *, (sum(n) OVER (PARTITION BY a))::DOUBLE * (sum(n) OVER (PARTITION BY b)) / (sum(n) OVER ()) AS e FROM c), g AS (SELECT sum((n - e) * (n - e) / e) / 2 AS x, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) / 2.0::DOUBLE AS h FROM e)
SELECT CAST(2 * h AS BIGINT) AS df, round(2 * x, 5) AS chi2, round(1 - list_sum(list_transform(range(0, 2000), lambda i: exp((h + i) * ln(x) - x - lgamma(h + i + 1)))), 6) + 0.0::DOUBLE AS p FROM g""")
def chi2_test(spark, d):
    x = estimate.chi_square(estimate.crosstab(units(spark, d), "a", "b"), "a", "b")

    @F.pandas_udf("double")
    def tail(chi2: pd.Series, df: pd.Series) -> pd.Series:  # one row
        return pd.Series([estimate.chi_square_p(c, int(k)) for c, k in zip(chi2, df, strict=True)])

    return x.select("df", F.round("chi2", 5).alias("chi2"), F.round(tail(F.col("chi2"), F.col("df").cast("long")), 6).alias("p"))


@query(f"""WITH t AS (SELECT p_brand AS term, (avg(p_retailprice) - (SELECT avg(p_retailprice) FROM part)) / 20 AS estimate, 0.5::DOUBLE + count(*) / 1000.0::DOUBLE AS se FROM part GROUP BY 1),
z AS (SELECT term, estimate / se AS z FROM t), u AS (SELECT term, z, abs(z) / sqrt(2.0::DOUBLE) AS u FROM z), p AS (SELECT term, z, {_TAIL} AS p FROM u),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, term) AS raw FROM p) SELECT term, round(z, 4) AS z, round(p, 5) AS p, round(least(1.0::DOUBLE, min(raw) OVER (ORDER BY p DESC, term DESC ROWS UNBOUNDED PRECEDING)), 5) AS p_adj FROM r""")
def wald_adjusted(spark, d):
    part = table(spark, d, "part")
    mean = part.agg(F.avg("p_retailprice").alias("m"))
    t = part.groupBy(F.col("p_brand").alias("term")).agg(F.avg("p_retailprice").alias("b"), (F.lit(0.5) + F.count(F.lit(1)) / 1000.0).alias("se")).crossJoin(F.broadcast(mean))  # one row
    w = estimate.wald_table(t.withColumn("estimate", (F.col("b") - F.col("m")) / 20), "estimate", "se").withColumn("p", estimate.normal_tail(F.col("z")))
    return estimate.bh_adjust(w, "p", "term").select("term", F.round("z", 4).alias("z"), F.round("p", 5).alias("p"), F.round("p_adj", 5).alias("p_adj"))


@query(f"WITH {UNITS}, n AS (SELECT venue, a, count(*) AS n FROM u WHERE a IS NOT NULL GROUP BY ALL) SELECT venue, " + ", ".join(f"coalesce(sum(n) FILTER (a = '{v}'), 0)::BIGINT AS {v}" for v in LEVELS) + " FROM n GROUP BY 1")
def alignment_matrix(spark, d):
    """Two partitions of the same units against each other."""
    return report.alignment(units(spark, d), "venue", "a", LEVELS)


@query("WITH n AS (SELECT strftime(ts, '%Y-%m') AS ym, event_type AS topic, count(*) AS n FROM events GROUP BY ALL) SELECT ym, topic, n, round(n / (sum(n) OVER (PARTITION BY ym))::DOUBLE, 6) AS share FROM n")
def topic_by_month(spark, d):
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM").alias("ym"), F.col("event_type").alias("topic"))
    return corpus.share_within(e, ["ym", "topic"], ["ym"]).withColumn("share", F.round("share", 6))


# --- checks and listings

#: What a figure is derived by from the joined units, and what the tables state by themselves.
_HEADLINES = {
    "documents": ("count(*)", "(SELECT count(DISTINCT doc_id) FROM documents)"),
    "labelled": ("count(quality)", "(SELECT count(quality) FROM labels)"),
    "good": ("sum(quality)", "(SELECT sum(quality) FROM labels)"),
    "toxic": ("sum(toxic)", "(SELECT sum(toxic) FROM labels)"),
    "share_toxic": ("round(avg(toxic), 6)", "(SELECT round(avg(toxic), 6) FROM labels)"),
    "characters": ("sum(n_chars)", "(SELECT sum(n_chars) FROM documents)"),
    "longest": ("max(n_chars)", "(SELECT max(n_chars) FROM documents)"),
    "mean_characters": ("round(avg(n_chars), 6)", "(SELECT round(avg(n_chars), 6) FROM documents)"),
    "sources": ("count(DISTINCT venue)", "(SELECT count(DISTINCT source) FROM documents)"),
    "languages": ("count(DISTINCT lang)", "(SELECT count(DISTINCT lang) FROM documents)"),
}


@query(f"WITH {UNITS}, r AS (" + " UNION ALL ".join(f"SELECT '{k}' AS headline, ({e})::DOUBLE AS derived, {t}::DOUBLE AS stated FROM u" for k, (e, t) in _HEADLINES.items()) + ") SELECT headline, derived, stated, abs(derived - stated) <= 0.001::DOUBLE * abs(stated) AS holds FROM r")
def headline_checks(spark, d):
    """Figures derived from texts and joined labels, against those that the tables state by themselves."""
    values = {
        "documents": F.count(F.lit(1)),
        "labelled": F.count("quality"),
        "good": F.sum("quality"),
        "toxic": F.sum("toxic"),
        "share_toxic": F.round(F.avg("toxic"), 6),
        "characters": F.sum("n_chars"),
        "longest": F.max("n_chars"),
        "mean_characters": F.round(F.avg("n_chars"), 6),
        "sources": F.count_distinct("venue"),
        "languages": F.count_distinct("lang"),
    }
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    of_docs = {"documents": F.count_distinct("doc_id"), "characters": F.sum("n_chars"), "longest": F.max("n_chars"), "mean_characters": F.round(F.avg("n_chars"), 6), "sources": F.count_distinct("source"), "languages": F.count_distinct("lang")}
    of_labels = {"labelled": F.count("quality"), "good": F.sum("quality"), "toxic": F.sum("toxic"), "share_toxic": F.round(F.avg("toxic"), 6)}
    return report.headline_checks(units(spark, d), values, report.key_values(docs, of_docs).unionByName(report.key_values(labels, of_labels)), 0.001)


@query(f"WITH {UNITS}, r AS (SELECT venue, row_number() OVER (PARTITION BY venue ORDER BY n_words DESC, id) AS rank, id, n_words FROM u) SELECT venue, rank, id, n_words, venue || ' #' || rank || ': document ' || id || ', ' || format('{{:,}}', n_words) || ' words' AS line FROM r WHERE rank <= 3")
def listing_longest(spark, d):
    x = report.top_rows(units(spark, d).select("venue", "id", "n_words"), "venue", "n_words", "id", 3)
    line = F.concat(F.col("venue"), F.lit(" #"), F.col("rank").cast("string"), F.lit(": document "), F.col("id").cast("string"), F.lit(", "), F.format_number("n_words", 0), F.lit(" words"))
    return x.select("venue", "rank", "id", "n_words", line.alias("line"))


_INSTRUMENTS = ["LLM ensemble", "llm pass A", "Distilled elastic net", "Dictionary tone", "wordlist flags", "human"]


@query(f"SELECT name, CASE WHEN regexp_matches(name, 'ensemble', 'i') THEN 'ensemble' WHEN regexp_matches(name, '^llm', 'i') THEN 'model' WHEN regexp_matches(name, 'distill', 'i') THEN 'distilled' WHEN regexp_matches(name, 'dictionary|wordlist|lexical', 'i') THEN 'lexical' ELSE 'other' END AS family, count(*) AS n FROM (SELECT {_INSTRUMENTS!r}[doc_id % {len(_INSTRUMENTS)} + 1] AS name FROM documents) GROUP BY ALL")
def instrument_families(spark, d):
    name = F.element_at(F.array(*(F.lit(x) for x in _INSTRUMENTS)), (F.col("id") % len(_INSTRUMENTS) + 1).cast("int"))
    return comments(spark, d).select(name.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("family", report.family(F.col("name")))


@query(CELLS + ", s AS (SELECT instrument, class, n, f1 FROM f) SELECT 'instrument_f1' AS figure, instrument AS series, class AS x, round(f1, 6) AS y FROM s UNION ALL SELECT 'class_share', instrument, class, round(n / (sum(n) OVER (PARTITION BY instrument))::DOUBLE, 6) FROM s")
def figure_inputs(spark, d):
    """What the figures of instruments are drawn from, one below the other: (figure, series, x, y)."""
    x = agreement.per_class(agreement.confusion(long_labels(spark, d), ["instrument"]), ["instrument"])
    share = F.col("n") / F.sum("n").over(Window.partitionBy("instrument"))
    return report.figure_inputs({"instrument_f1": x.select(F.col("instrument").alias("series"), F.col("class").alias("x"), F.round("f1", 6).alias("y")), "class_share": x.select(F.col("instrument").alias("series"), F.col("class").alias("x"), F.round(share, 6).alias("y"))})


# --- annotation

_BATCHES = """WITH x AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, text FROM documents), n AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, CAST(ceil(i / 8.0) AS BIGINT) AS batch, (i - 1) % 8 AS pos, len(regexp_extract_all(text, '\\S+')) AS words, length(text) // 4 + 20 AS used FROM x),
k AS (SELECT batch, md5('m|v1|A|' || string_agg(id, ',' ORDER BY doc_id)) AS cache_key, count(*) AS wanted FROM n GROUP BY 1), c AS (SELECT *, sum(used) OVER (PARTITION BY batch ORDER BY pos) AS spent FROM n JOIN k USING (batch))"""
_RESULT = "c.spent <= 9600"


def _annotated(spark, d):
    """Batches of eight through the offline annotator, their results parsed."""
    b = corpus.batches(comments(spark, d), "id", 8, "m", "v1", "A")
    body = comments(spark, d).select(F.col("id").cast("string").alias("id"), "body")
    t = b.select("cache_key", F.posexplode("ids").alias("i", "id")).join(body, "id").groupBy("cache_key").agg(F.array_sort(F.collect_list(F.struct("i", "id", "body"))).alias("x"))
    t = t.select("cache_key", F.transform("x", lambda x: x["id"]).alias("ids"), F.transform("x", lambda x: x["body"]).alias("texts"))
    return annotate.annotate(t, annotate.keyword_annotator).withColumn("results", F.transform("results", lambda r: F.from_json(r, "id string, relevance string, stance string")))


@query(_BATCHES + f" SELECT cache_key, CAST(pos AS BIGINT) AS position, id, CASE WHEN words % 2 = 0 THEN {LEVELS!r}[words % 4 + 1] ELSE 'non_evaluative' END AS stance FROM c WHERE {_RESULT}")
def annotate_cache(spark, d):
    return annotate.repair_ids(_annotated(spark, d)).select("cache_key", "position", "id", F.col("result.stance").alias("stance"))


@query(_BATCHES + f", r AS (SELECT cache_key, max(wanted) AS wanted, count(*) FILTER ({_RESULT}) AS returned FROM c GROUP BY 1) SELECT returned, returned < wanted AS incomplete, count(*) AS n_batches, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share FROM r GROUP BY ALL")
def batch_completeness(spark, d):
    return agreement.batch_completeness(_annotated(spark, d), "ids", "results").withColumn("share", F.round("share", 6))


@query(_BATCHES + f" SELECT CAST(pos AS BIGINT) AS position, count(*) AS asked, count(*) FILTER ({_RESULT}) AS answered, round(avg(({_RESULT})::INT::DOUBLE), 6) AS yield FROM c GROUP BY 1")
def batch_yield(spark, d):
    return agreement.positional_yield(_annotated(spark, d), "ids", "results").withColumn("yield", F.round("yield", 6))


@query(_BATCHES + f" SELECT cache_key, max(wanted) AS wanted, count(*) FILTER ({_RESULT}) AS returned, count(*) FILTER ({_RESULT}) < max(wanted) AS purge FROM c GROUP BY 1")
def purge_plan(spark, d):
    return annotate.purge_plan(_annotated(spark, d))


@query(_BATCHES + f", m AS (SELECT doc_id, id, row_number() OVER (ORDER BY doc_id) AS i FROM c WHERE NOT ({_RESULT})) SELECT CAST(ceil(i / 8.0) AS BIGINT) AS batch, md5('m|v1|repair|' || string_agg(id, ',' ORDER BY doc_id)) AS cache_key, count(*) AS n FROM m GROUP BY 1")
def rebatch_missing(spark, d):
    """What no batch has brought, in batches of its own."""
    done = annotate.repair_ids(_annotated(spark, d)).select(F.col("id").cast("long").alias("id"))
    left = annotate.missing_ids(comments(spark, d).select("id"), done, "id")
    return corpus.batches(left, "id", 8, "m", "v1", "repair").select("batch", "cache_key", F.size("ids").cast("long").alias("n"))


@query(f"SELECT doc_id AS id, md5('{codebook.prompt_block(['relevance', 'stance'], True)}' || chr(10) || chr(10) || substring(text, 1, 1500)) AS compact, md5('{codebook.prompt_block(['stance'], False)}' || chr(10) || chr(10) || substring(text, 1, 1500)) AS whole FROM documents")
def prompts(spark, d):
    body = F.col("body")
    return comments(spark, d).select("id", F.md5(annotate.prompt(body, ["relevance", "stance"])).alias("compact"), F.md5(annotate.prompt(body, ["stance"], compact=False)).alias("whole"))


@query("SELECT doc_id % 7 AS shard, count(*) AS n FROM documents GROUP BY 1")
def work_shards(spark, d):
    return annotate.shards(comments(spark, d).select("id"), "id", 7).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {UNITS} SELECT id, CASE WHEN NOT coalesce(a IN {in_list(LEVELS)}, false) THEN 'stance not in the codebook' WHEN toxic IS NULL THEN 'threat missing' WHEN NOT coalesce(p BETWEEN 0 AND 1, false) THEN 'confidence out of range' END AS fault FROM u")
def label_contract(spark, d):
    rules = annotate.label_rules({"stance": F.col("a")}, {"threat": F.col("toxic")}, F.col("p"))
    return units(spark, d).select("id", annotate.first_fault(rules).alias("fault"))
