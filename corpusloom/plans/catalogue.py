"""The query catalogue: each operator over the tables at hand, with the SQL that an independent engine answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import agreement, annotate, corpus, estimate, graph, learn, lexicon, report, sampling
from .adapters import DESIGN, FRAME, LEAST, SHARES, TOTAL, TRIPLES, UNITS, comments, frame, replies, table, triples, units

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def in_list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
FW = in_list(T.FUNCTION_WORDS)
DOCS = "docs AS (SELECT doc_id AS id, text AS body, source AS venue, lang FROM documents)"


# --- corpus -----------------------------------------------------------------------------------


def _steps() -> list:
    body, n, toks = F.col("body"), F.col("n_words"), F.col("toks")
    return [("not_empty", body.isNotNull() & ~body.isin(T.TOMBSTONES)), ("venue_kept", F.col("venue") != "src0"), ("four_words", n >= 4), ("language", T.is_english(body, n, toks)), ("flagged", T.token_flag(toks, ["that", "with", "from"]))]


_FUNNEL = rf"""WITH {DOCS}, x AS (
  SELECT body IS NOT NULL AND body NOT IN ('[deleted]', '[removed]', '[unavailable]', '') AS a, venue <> 'src0' AS b, len(regexp_extract_all(body, '\S+')) >= 4 AS c,
    len(list_filter({TOK.format("body")}, lambda t: t IN {FW})) / greatest(1, len(regexp_extract_all(body, '\S+'))) >= 0.08 AND len(regexp_extract_all(body, '[A-Za-z]')) / greatest(1, length(body)) >= 0.45 AS d,
    list_has_any({TOK.format("body")}, ['that', 'with', 'from']) AS e
  FROM docs),
n AS (SELECT count(*) AS c0, count(*) FILTER (a) AS c1, count(*) FILTER (a AND b) AS c2, count(*) FILTER (a AND b AND c) AS c3, count(*) FILTER (a AND b AND c AND d) AS c4, count(*) FILTER (a AND b AND c AND d AND e) AS c5 FROM x)
SELECT CAST(i AS BIGINT) AS step_no, s AS step, c AS n, p - c AS dropped, round(100.0::DOUBLE * c / c0, 4) AS pct FROM (
  SELECT 0 AS i, 'raw' AS s, c0 AS c, c0 AS p, c0 FROM n UNION ALL SELECT 1, 'not_empty', c1, c0, c0 FROM n UNION ALL SELECT 2, 'venue_kept', c2, c1, c0 FROM n
  UNION ALL SELECT 3, 'four_words', c3, c2, c0 FROM n UNION ALL SELECT 4, 'language', c4, c3, c0 FROM n UNION ALL SELECT 5, 'flagged', c5, c4, c0 FROM n)"""


@query(_FUNNEL)
def funnel(spark, d):
    c = comments(spark, d).select("body", "venue", F.regexp_count("body", F.lit(r"\S+")).alias("n_words"), T.tokens(F.col("body")).alias("toks"))  # the text is cut once
    return corpus.funnel(c, _steps())


@query(r"""SELECT event_type AS venue, count(*) AS n, count(DISTINCT user_id) AS authors, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS high_share, round(median(value), 6) AS median_value, round(stddev_samp(value), 5) AS sd_value FROM events GROUP BY 1""")
def corpus_describe(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "venue")
    return corpus.describe(e, "venue", n=F.count(F.lit(1)), authors=F.count_distinct("user_id"), high_share=F.round(F.avg((F.col("value") > 50).cast("double")), 6), median_value=F.round(F.median("value"), 6), sd_value=F.round(F.stddev_samp("value"), 5))


@query("SELECT event_type AS venue, strftime(ts, '%Y-%m') AS ym, count(*) AS n FROM events GROUP BY ALL")
def venue_by_month(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("venue"), F.date_format("ts", "yyyy-MM").alias("ym")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""SELECT doc_id AS id, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words, CAST(length(text) - length(replace(text, '?', '')) AS BIGINT) AS n_question,
  CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclaim, CAST(len(list_filter({TOK.format("text")}, lambda t: t IN {in_list(T.SECOND_PERSON)})) AS BIGINT) AS n_2ndperson,
  round(len(regexp_extract_all(text, '[A-Z]')) / greatest(1, len(regexp_extract_all(text, '[A-Za-z]'))), 6) AS caps_ratio FROM documents""")
def text_features(spark, d):
    x = corpus.text_features(comments(spark, d), "body")
    return x.select("id", F.length("body").cast("long").alias("n_chars"), "n_words", "n_question", "n_exclaim", "n_2ndperson", F.round("caps_ratio", 6).alias("caps_ratio"))


def normal_sql(c: str) -> str:
    for a, b in T.ENTITIES:
        c = f"replace({c}, '{a}', {repr(b) if b != chr(39) else repr(chr(39) * 2)[1:-1].join(chr(39) * 2)})"
    for p, r in T.CLEANING:
        c = f"regexp_replace({c}, '{p}', '{r.replace('$1', chr(92) + '1')}', 'g')"
    return f"trim({c})"


@query(rf"""SELECT id, md5(t) AS digest, CAST(len(regexp_extract_all(t, '\S+')) AS BIGINT) AS n_words FROM (SELECT doc_id AS id, {normal_sql("text")} AS t FROM documents)""")
def text_normalise(spark, d):
    x = comments(spark, d).select("id", T.normalise(F.col("body")).alias("t"))
    return x.select("id", F.md5("t").alias("digest"), T.word_count(F.col("t")).alias("n_words"))


@query(rf"""SELECT page_id AS id, md5({normal_sql("html")}) AS digest FROM pages""")
def page_normalise(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.md5(T.normalise(F.col("html"))).alias("digest"))


@query(rf"""SELECT doc_id AS id, CAST(len(list_filter({TOK.format("text")}, lambda t: t IN {FW})) AS BIGINT) AS fw_hits, round(len(regexp_extract_all(text, '[A-Za-z]')) / greatest(1, length(text)), 6) AS latin_ratio,
  len(list_filter({TOK.format("text")}, lambda t: t IN {FW})) / greatest(1, len(regexp_extract_all(text, '\S+'))) >= 0.08 AND len(regexp_extract_all(text, '[A-Za-z]')) / greatest(1, length(text)) >= 0.45 AS is_en FROM documents""")
def language_gate(spark, d):
    body = F.col("body")
    return comments(spark, d).select("id", T.tokens_in(T.tokens(body), T.FUNCTION_WORDS).alias("fw_hits"), F.round(T.latin_ratio(body), 6).alias("latin_ratio"), T.is_english(body, T.word_count(body)).alias("is_en"))


_FLAGS = {"vulgarity": T.VULGARITY, "name_calling": T.NAME_CALLING, "lying": T.LYING}
_FLAG_SQL = {k: f"list_has_any(t, [{', '.join(repr(w) for w in v if w.isalpha())}])" for k, v in _FLAGS.items()}


@query(f"""SELECT id, {', '.join(f'{s} AS {k}' for k, s in _FLAG_SQL.items())}, {' OR '.join(_FLAG_SQL.values())} AS any_incivility FROM (SELECT doc_id AS id, {TOK.format("text")} AS t FROM documents)""")
def lexical_flags(spark, d):
    t = comments(spark, d).select("id", T.tokens(F.col("body")).alias("t"))
    t = t.select("id", *(T.token_flag(F.col("t"), v).alias(k) for k, v in _FLAGS.items()))
    return t.withColumn("any_incivility", L.any_of([F.col(k) for k in _FLAGS]))


@query("""SELECT c.conv_id || '-' || c.turn AS id, CAST(length(c.text) AS BIGINT) AS n, md5(p.text) AS parent_digest, p.role AS parent_author FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def parent_text_join(spark, d):
    r = replies(spark, d).withColumn("parent_cid", F.when(~F.col("parent_id").startswith("t3_"), F.substring("parent_id", 4, 1000)))
    r = corpus.with_parents(r, "id", "parent_cid", {"body": "parent_text", "author": "parent_author"})
    return r.select("id", F.length("body").cast("long").alias("n"), F.md5("parent_text").alias("parent_digest"), "parent_author")


@query("""WITH t AS (SELECT conv_id, turn, length(text) % 3 = 0 AS y FROM conversations)
SELECT p.y AS parent_y, count(*) AS n, round(avg(CASE WHEN c.y THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS rate FROM t c JOIN t p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 GROUP BY 1""")
def reply_pairs_rates(spark, d):
    r = replies(spark, d).select("id", "parent_id", (F.length("body") % 3 == 0).alias("y"))
    p = r.select(F.concat(F.lit("t1_"), "id").alias("parent_id"), F.col("y").alias("parent_y"))
    return r.join(p, "parent_id").groupBy("parent_y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("y").cast("double")), 6).alias("rate"))


@query("SELECT conv_id || '-' || turn AS id, turn AS depth FROM conversations")
def reply_depth(spark, d):
    return corpus.reply_depth(replies(spark, d))


@query("SELECT doc_id AS id, source AS venue FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_gold(spark, d):
    return comments(spark, d).join(table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", "venue")


@query("SELECT doc_id AS id, source AS venue FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_join_missing(spark, d):
    return annotate.missing_ids(comments(spark, d).select("id", "venue"), table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id")


@query("SELECT c_custkey, o_orderkey, l_linenumber, n_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey WHERE l_discount > 0.09 AND o_orderstatus = 'F'")
def three_way_join(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").where("l_discount > 0.09").select("l_orderkey", "l_linenumber")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "l_linenumber", "n_name")


@query(r"""WITH x AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id FROM documents), b AS (SELECT CAST(ceil(i / 8.0) AS BIGINT) AS batch, list(CAST(doc_id AS VARCHAR) ORDER BY doc_id) AS ids FROM x GROUP BY 1)
SELECT batch, md5('m|v1|A|' || array_to_string(ids, ',')) AS cache_key, CAST(len(ids) AS BIGINT) AS n FROM b""")
def batching_md5(spark, d):
    return corpus.batches(comments(spark, d), "id", 8, "m", "v1", "A").select("batch", "cache_key", F.size("ids").cast("long").alias("n"))


# --- sampling ---------------------------------------------------------------------------------


def _design(spark, d):
    f = frame(spark, d)
    sizes = f.groupBy("stratum", "flag").agg(F.count(F.lit(1)).alias("pop_n"))
    return f, sampling.allocate(sizes, "flag", TOTAL, SHARES, LEAST)


@query(f"WITH {FRAME} SELECT stratum, count(*) AS pop_n FROM frame GROUP BY 1")
def strata(spark, d):
    return frame(spark, d).groupBy("stratum").agg(F.count(F.lit(1)).alias("pop_n"))


@query(f"WITH {FRAME}, {DESIGN} SELECT stratum, pop_n, alloc_n, round(alloc_n / pop_n::DOUBLE, 6) AS incl_prob, round(pop_n / alloc_n::DOUBLE, 6) AS design_weight FROM design")
def allocation(spark, d):
    return _design(spark, d)[1].select("stratum", "pop_n", "alloc_n", F.round("incl_prob", 6).alias("incl_prob"), F.round("design_weight", 6).alias("design_weight"))


SYS = f"""WITH {FRAME}, {DESIGN}, r AS (SELECT f.*, row_number() OVER (PARTITION BY f.stratum ORDER BY created, id) AS rk FROM frame f),
picked AS (SELECT r.*, pop_n, alloc_n FROM r JOIN design USING (stratum) WHERE (rk - 1)::DOUBLE % (pop_n / alloc_n::DOUBLE) < 1 AND floor((rk - 1) / (pop_n / alloc_n::DOUBLE)) < alloc_n)"""


def picked(spark, d):
    f, design = _design(spark, d)
    return f, sampling.systematic(f, design.drop("flag"), "stratum", "created", "id")


@query(SYS + " SELECT id, stratum, alloc_n FROM picked")
def systematic_sample(spark, d):
    return picked(spark, d)[1].select("id", "stratum", "alloc_n")


@query(SYS + """, g AS (SELECT id, row_number() OVER (ORDER BY md5('gold:' || id), id) AS i FROM picked QUALIFY i <= 200), s AS (SELECT id, row_number() OVER (ORDER BY md5('split:' || id), id) AS j FROM g)
SELECT id, CASE WHEN j <= 80 THEN 'dev' ELSE 'test' END AS gold_split FROM s""")
def srs_gold_split(spark, d):
    gold = sampling.simple_random(picked(spark, d)[1].select("id"), 200, "gold", "id")
    dev = sampling.simple_random(gold, 80, "split", "id").withColumn("dev", F.lit(True))
    return gold.join(dev, "id", "left").select("id", F.when(F.col("dev"), "dev").otherwise("test").alias("gold_split"))


@query(SYS + """, now AS (SELECT * FROM frame WHERE user_id % 17 <> 0), sz AS (SELECT stratum, count(*) AS new_n FROM now GROUP BY 1),
m AS (SELECT p.id, p.stratum, p.pop_n AS pop_n_old, coalesce(sz.new_n, 0) AS pop_n, p.user_id % 17 <> 0 AS eligible FROM picked p LEFT JOIN sz USING (stratum))
SELECT id, eligible, pop_n_old, pop_n, round(CASE WHEN eligible THEN count(*) FILTER (eligible) OVER (PARTITION BY stratum) / pop_n::DOUBLE END, 6) AS incl_prob FROM m""")
def frame_correction(spark, d):
    f, s = picked(spark, d)
    s = s.withColumn("incl_prob", F.col("alloc_n") / F.col("pop_n"))
    out = sampling.correct_frame(s, f.where(F.col("user_id") % 17 != 0), "id", "stratum")
    return out.select("id", "eligible", "pop_n_old", "pop_n", F.round("incl_prob", 6).alias("incl_prob"))


@query(SYS + """, p AS (SELECT avg(value) AS a, stddev_samp(value) AS s, avg((user_id % 10)::DOUBLE) AS a2, stddev_samp((user_id % 10)::DOUBLE) AS s2 FROM frame),
w AS (SELECT sum(pop_n / alloc_n::DOUBLE * value) / sum(pop_n / alloc_n::DOUBLE) AS a, sum(pop_n / alloc_n::DOUBLE * (user_id % 10)) / sum(pop_n / alloc_n::DOUBLE) AS a2 FROM picked)
SELECT 'value' AS variable, round(p.a, 5) AS population, round(w.a, 5) AS weighted_sample, round(abs(w.a - p.a), 5) AS abs_diff, round((w.a - p.a) / p.s, 5) AS std_diff FROM p, w
UNION ALL SELECT 'digit', round(p.a2, 5), round(w.a2, 5), round(abs(w.a2 - p.a2), 5), round((w.a2 - p.a2) / p.s2, 5) FROM p, w""")
def sampling_balance(spark, d):
    f, s = picked(spark, d)
    digit = (F.col("user_id") % 10).cast("double")
    s = s.withColumns({"w": F.col("pop_n") / F.col("alloc_n"), "digit": digit})
    out = sampling.balance(f.withColumn("digit", digit), s, "w", ["value", "digit"])
    return out.select("variable", *(F.round(c, 5).alias(c) for c in ("population", "weighted_sample", "abs_diff", "std_diff")))


_U = "('0x' || substr(md5('{}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_DRAWS = f"""WITH {FRAME}, {DESIGN}, r AS (SELECT stratum, value, row_number() OVER (PARTITION BY stratum ORDER BY created, id) AS rk FROM frame), o AS (SELECT draw, stratum, pop_n, alloc_n, pop_n / alloc_n::DOUBLE AS k, {_U.format("r:' || draw || ':' || stratum || '")} * (pop_n / alloc_n::DOUBLE) AS off FROM design, (SELECT unnest(range(500)) AS draw)),
t AS (SELECT draw, stratum, k, least(ceil(off + i * k), pop_n - 1)::BIGINT + 1 AS rk FROM (SELECT *, unnest(range(alloc_n)) AS i FROM o)), m AS (SELECT draw, sum(k * value) / sum(k) AS mean FROM t JOIN r USING (stratum, rk) GROUP BY 1)"""


def _reference(spark, d):
    f, design = _design(spark, d)
    return sampling.randomisation_reference(f, design, "stratum", ["created", "id"], "value", 500, "r")


@query(_DRAWS + " SELECT draw, round(mean, 7) AS mean FROM m")
def randomisation_reference(spark, d):
    return _reference(spark, d).select("draw", F.round("mean", 7).alias("mean"))


@query(_DRAWS + """, f AS (SELECT frame.*, row_number() OVER (PARTITION BY stratum ORDER BY created, id) AS rk FROM frame), picked AS (SELECT f.*, pop_n, alloc_n FROM f JOIN design USING (stratum) WHERE (rk - 1)::DOUBLE % (pop_n / alloc_n::DOUBLE) < 1 AND floor((rk - 1) / (pop_n / alloc_n::DOUBLE)) < alloc_n),
w AS (SELECT sum(pop_n / alloc_n::DOUBLE * value) / sum(pop_n / alloc_n::DOUBLE) AS point FROM picked) SELECT round(point, 5) AS point, round(avg((mean <= point)::INT::DOUBLE), 4) AS percentile FROM m, w GROUP BY point""")
def realised_percentile(spark, d):
    """Where the sample's weighted mean stands among those of random starts."""
    w = F.col("pop_n") / F.col("alloc_n")
    point = picked(spark, d)[1].agg((F.sum(w * F.col("value")) / F.sum(w)).alias("point"))
    x = sampling.percentile_of(_reference(spark, d), "mean", point, "point")
    return x.select(F.round("point", 5).alias("point"), F.round("percentile", 4).alias("percentile"))


@query(f"""WITH {FRAME}, {DESIGN}, r AS (SELECT f.id, f.stratum, pop_n, alloc_n, pop_n / alloc_n::DOUBLE AS k, row_number() OVER (PARTITION BY f.stratum ORDER BY created, id) - 1 - {_U.format("start:' || f.stratum || '")} * (pop_n / alloc_n::DOUBLE) AS j FROM frame f JOIN design USING (stratum))
SELECT id, stratum FROM r WHERE j >= 0 AND j % k < 1 AND floor(j / k) < alloc_n""")
def systematic_offset(spark, d):
    f, design = _design(spark, d)
    return sampling.systematic(f, design.drop("flag"), "stratum", "created", "id", offset=sampling.random_offset("start", "stratum")).select("id", "stratum")


@query(f"WITH {FRAME} SELECT id, venue FROM frame QUALIFY row_number() OVER (PARTITION BY venue ORDER BY md5('cap:' || id), id) <= 40")
def stratified_cap_sample(spark, d):
    return sampling.capped_by_group(frame(spark, d).select("id", "venue"), "venue", 40, "cap", "id")


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations), k AS (SELECT conv_id FROM c ORDER BY md5('thread:' || conv_id), conv_id LIMIT 30), r AS (SELECT conv_id || '-' || turn AS id, conv_id AS link_id FROM conversations WHERE conv_id IN (SELECT conv_id FROM k))
SELECT id, link_id FROM r ORDER BY md5('thread-rows:' || id), id LIMIT 100""")
def cluster_sample(spark, d):
    return sampling.cluster_sample(replies(spark, d).select("id", "link_id"), "link_id", 30, 100, "thread", "id")


@query(f"WITH {FRAME} SELECT id FROM frame ORDER BY CASE WHEN flag = 'flag' THEN 0 ELSE 1 END, md5('budget:' || id), id LIMIT 500")
def budget_subset(spark, d):
    return sampling.flagged_first(frame(spark, d), F.col("flag") == "flag", 500, "budget", "id").select("id")


# --- agreement --------------------------------------------------------------------------------

_ALPHA = """WITH {U}, l AS (SELECT 'stance' AS variable, a, b FROM u WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), CAST(n_words % 2 AS VARCHAR) FROM u WHERE toxic IS NOT NULL),
c AS (SELECT variable, count(*) AS n, count(*) FILTER (a = b) AS same FROM l GROUP BY 1), v AS (SELECT variable, v, count(*) AS m FROM (SELECT variable, unnest([a, b]) AS v FROM l) GROUP BY ALL), s AS (SELECT variable, sum(m::DOUBLE * m) AS sq, count(*) AS k FROM v GROUP BY 1)
SELECT variable, n, round(CASE WHEN k > 1 THEN 1 - (1 - same / n::DOUBLE) / ((1 - sq / (4.0::DOUBLE * n * n)) * 2 * n / (2 * n - 1)) END, 6) AS alpha, round(same / n::DOUBLE, 6) AS pct_agree FROM c JOIN s USING (variable)""".replace("{U}", UNITS)


@query(_ALPHA)
def krippendorff(spark, d):
    u = units(spark, d).withColumn("odd", F.col("n_words") % 2)
    x = agreement.krippendorff(agreement.long_pairs(u, {"stance": ("a", "b"), "toxic": ("toxic", "odd")}))
    return x.select("variable", "n", F.round("alpha", 6).alias("alpha"), F.round("pct_agree", 6).alias("pct_agree"))


@query(f"WITH {UNITS} SELECT id, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = b THEN a ELSE 'non_evaluative' END AS stance, a <> b AS stance_disputed FROM u")
def adjudicate(spark, d):
    return agreement.adjudicate(units(spark, d), "stance", "a", "b", "non_evaluative").select("id", "stance", "stance_disputed")


CELLS = f"""WITH {UNITS}, long AS (SELECT 'A' AS instrument, truth, a AS pred FROM u UNION ALL SELECT 'B', truth, b FROM u), cells AS (SELECT instrument, truth, pred, count(*) AS n FROM long WHERE truth IS NOT NULL AND pred IS NOT NULL GROUP BY ALL),
sides AS (SELECT instrument, truth AS class, n AS t, 0 AS p, CASE WHEN truth = pred THEN n ELSE 0 END AS hit FROM cells UNION ALL SELECT instrument, pred, 0, n, 0 FROM cells),
cls AS (SELECT instrument, class, CAST(sum(t) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_pred, sum(hit) AS hit FROM sides GROUP BY ALL),
f AS (SELECT *, CASE WHEN n_pred > 0 THEN hit::DOUBLE / n_pred END AS precision, CASE WHEN n > 0 THEN hit::DOUBLE / n END AS recall, coalesce(2.0::DOUBLE * hit / nullif(n + n_pred, 0), 0) AS f1 FROM cls)"""


def long_labels(spark, d):
    u = units(spark, d)
    return u.select(F.inline(F.array(*(F.struct(F.lit(k).alias("instrument"), F.col("truth"), F.col(c).alias("pred")) for k, c in (("A", "a"), ("B", "b"))))))


@query(CELLS + ' SELECT instrument, class, n, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f')
def prf_by_class(spark, d):
    x = agreement.per_class(agreement.confusion(long_labels(spark, d), ["instrument"]), ["instrument"])
    return x.select("instrument", "class", "n", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(CELLS + """ SELECT instrument, 'truth' AS labels, round(avg(f1) FILTER (n > 0), 6) AS macro_f1 FROM f GROUP BY 1 UNION ALL SELECT instrument, 'union', round(avg(f1), 6) FROM f GROUP BY 1 UNION ALL SELECT instrument, 'codebook', round(sum(f1) / 4, 6) FROM f GROUP BY 1""")
def macro_f1_modes(spark, d):
    x = agreement.per_class(agreement.confusion(long_labels(spark, d), ["instrument"]), ["instrument"])
    modes = [agreement.macro_f1(x, ["instrument"], m, 4).withColumn("labels", F.lit(m)) for m in ("truth", "union", "codebook")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2]).select("instrument", "labels", F.round("macro_f1", 6).alias("macro_f1"))


_KAPPA = CELLS + ", k AS (SELECT instrument, sum(n)::DOUBLE AS n, sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS hit FROM cells GROUP BY 1), x AS (SELECT instrument, sum(n::DOUBLE * n_pred) AS cr FROM cls GROUP BY 1)"


@query(_KAPPA + " SELECT instrument, CAST(n AS BIGINT) AS n, round(hit / n, 6) AS accuracy, round((hit / n - cr / (n * n)) / (1 - cr / (n * n)), 6) AS kappa FROM k JOIN x USING (instrument)")
def cohen_kappa(spark, d):
    x = agreement.cohen_kappa(agreement.confusion(long_labels(spark, d), ["instrument"]), ["instrument"])
    return x.select("instrument", "n", F.round("accuracy", 6).alias("accuracy"), F.round("kappa", 6).alias("kappa"))


@query(_KAPPA + ", m AS (SELECT instrument, avg(f1) FILTER (n > 0) AS macro_f1 FROM f GROUP BY 1) SELECT instrument, CAST(n AS BIGINT) AS n, round(hit / n, 6) AS accuracy, round((hit / n - cr / (n * n)) / (1 - cr / (n * n)), 6) AS kappa, round(macro_f1, 6) AS macro_f1 FROM k JOIN x USING (instrument) JOIN m USING (instrument)")
def scoreboard(spark, d):
    x = agreement.scoreboard(long_labels(spark, d), ["instrument"])
    return x.select("instrument", "n", *(F.round(c, 6).alias(c) for c in ("accuracy", "kappa", "macro_f1")))


@query(f"WITH {UNITS} SELECT truth, " + ", ".join(f"count(*) FILTER (a = '{v}') AS {v}" for v in ("trust", "distrust", "ambivalent", "non_evaluative")) + " FROM u WHERE truth IS NOT NULL AND a IS NOT NULL GROUP BY 1")
def confusion(spark, d):
    x = agreement.confusion(units(spark, d).withColumnRenamed("a", "pred"), [])
    levels = ["trust", "distrust", "ambivalent", "non_evaluative"]
    return x.groupBy("truth").pivot("pred", levels).agg(F.sum("n")).fillna(0)


@query(f"WITH {UNITS} SELECT id, coalesce(CASE WHEN a = b THEN a END, truth) AS label, toxic = 1 AND n_words % 2 = 1 AS flag FROM u")
def ensemble(spark, d):
    return units(spark, d).select("id", agreement.ensemble(F.col("a"), F.col("b"), F.col("truth")).alias("label"), ((F.col("toxic") == 1) & (F.col("n_words") % 2 == 1)).alias("flag"))


@query(f"""WITH {UNITS}, v AS (SELECT id, unnest([a, b, truth]) AS s FROM u), n AS (SELECT id, s, count(*) AS n FROM v WHERE s IS NOT NULL GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY id) AS most, sum(n) OVER (PARTITION BY id) AS draws FROM n)
SELECT id, CASE WHEN count(*) FILTER (n = most) = 1 THEN max(s) FILTER (n = most) END AS winner, max(most) AS votes_for, CAST(max(draws) AS BIGINT) AS n_draws, count(*) FILTER (n = most) > 1 AS tie FROM m GROUP BY id""")
def majority_vote(spark, d):
    v = units(spark, d).select("id", F.explode(F.array("a", "b", "truth")).alias("s"))
    return agreement.majority_vote(v, "id", "s")


@query(f"""WITH {UNITS}, g AS (SELECT CAST(greatest(1, ceil(p * 10)) AS BIGINT) AS bin, count(*) AS n, avg(p) AS m, avg(toxic::DOUBLE) AS o FROM u WHERE toxic IS NOT NULL GROUP BY 1)
SELECT bin, n, round(m, 6) AS mean_pred, round(o, 6) AS observed, round(n / sum(n) OVER () * abs(m - o), 6) AS ece_contrib FROM g""")
def calibration_ece(spark, d):
    x = agreement.calibration(units(spark, d), "p", "toxic")
    return x.select("bin", "n", *(F.round(c, 6).alias(c) for c in ("mean_pred", "observed", "ece_contrib")))


@query(f"WITH {UNITS} SELECT id, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce((a = truth)::INT, 0) + coalesce((b = truth)::INT, 0)) / nullif((a = truth IS NOT NULL)::INT + (b = truth IS NOT NULL)::INT, 0)::DOUBLE END AS mean_hit FROM u")
def rowwise_mean(spark, d):
    return units(spark, d).select("id", L.mean_of([(F.col("a") == F.col("truth")).cast("int"), (F.col("b") == F.col("truth")).cast("int")]).alias("mean_hit"))


# --- estimation -------------------------------------------------------------------------------

_DSL = f"WITH {UNITS}, s AS (SELECT *, quality IS NOT NULL AS coded, avg((quality IS NOT NULL)::INT::DOUBLE) OVER () AS pi FROM u), e AS (SELECT *, CASE WHEN coded THEN p + (toxic - p) / pi ELSE p END AS y FROM s)"


def _dsl(spark, d):
    u = units(spark, d).withColumns({"coded": F.col("quality").isNotNull(), "y": F.col("toxic").cast("double")})
    pi = u.agg(F.avg(F.col("coded").cast("double")).alias("pi"), F.count(F.lit(1)).alias("total"))
    return u.crossJoin(F.broadcast(pi))  # one row


@query(_DSL + ", g AS (SELECT count(*) AS n, avg(p) AS naive, avg(y) AS corrected, count(*) FILTER (coded) AS m, var_samp(CASE WHEN coded THEN (toxic - p) / pi END) AS v FROM e) SELECT n, round(naive, 6) AS naive, round(corrected, 6) AS corrected, round(100 * (corrected - naive), 5) AS shift_pp, m, round(sqrt(m * v) / n * sqrt(1 - m / n::DOUBLE), 6) AS se FROM g")
def dsl_pooled(spark, d):
    u = _dsl(spark, d)
    x = estimate.corrected_prevalence(u, [], "p", "y", "coded", "pi").crossJoin(estimate.analytic_se(u, "p", "y", "coded", "pi", "total"))  # one row each
    return x.select("n", F.round("naive", 6).alias("naive"), F.round("corrected", 6).alias("corrected"), F.round("shift_pp", 5).alias("shift_pp"), "m", F.round("se", 6).alias("se"))


@query(_DSL + " SELECT venue, count(*) AS n, round(avg(p), 6) AS naive, round(avg(y), 6) AS corrected, round(100 * (avg(y) - avg(p)), 5) AS shift_pp FROM e GROUP BY 1")
def dsl_by_venue(spark, d):
    x = estimate.corrected_prevalence(_dsl(spark, d), ["venue"], "p", "y", "coded", "pi")
    return x.select("venue", "n", *(F.round(c, k).alias(c) for c, k in (("naive", 6), ("corrected", 6), ("shift_pp", 5))))


@query(_DSL + """, c AS (SELECT unnest(['trust', 'distrust', 'ambivalent', 'non_evaluative']) AS category), x AS (SELECT category, CASE WHEN a = category THEN 0.7::DOUBLE ELSE 0.1::DOUBLE END AS f, (truth = category)::INT AS y, coded, pi FROM e, c),
g AS (SELECT category, avg(f) AS naive, avg(CASE WHEN coded THEN f + (y - f) / pi ELSE f END) AS corrected FROM x GROUP BY 1)
SELECT category, round(naive, 6) AS naive, round(corrected, 6) AS corrected, CASE WHEN category <> 'non_evaluative' THEN round(corrected / sum(CASE WHEN category <> 'non_evaluative' THEN corrected END) OVER (), 5) END AS share_of_evaluative FROM g""")
def dsl_by_category(spark, d):
    levels = ["trust", "distrust", "ambivalent", "non_evaluative"]
    rows = F.array(*(F.struct(F.lit(v).alias("category"), F.when(F.col("a") == v, 0.7).otherwise(0.1).alias("f"), (F.col("truth") == v).cast("double").alias("hit")) for v in levels))
    x = _dsl(spark, d).select("coded", "pi", F.inline(rows))
    g = estimate.corrected_prevalence(x, ["category"], "f", "hit", "coded", "pi")
    real = F.when(F.col("category") != "non_evaluative", F.col("corrected"))
    return g.select("category", F.round("naive", 6).alias("naive"), F.round("corrected", 6).alias("corrected"), F.round(real / F.sum(real).over(Window.partitionBy()), 5).alias("share_of_evaluative"))


_WEIGHT = " + ".join(f"(u >= {t!r}::DOUBLE)::INT" for t in estimate.POISSON)
_BOOT = f"""{_DSL}, k AS (SELECT id, venue, (toxic - p) / pi AS e, count(*) OVER () AS m, count(*) OVER (PARTITION BY venue) AS mv FROM s WHERE coded AND toxic IS NOT NULL), nt AS (SELECT count(*) AS total FROM u),
w AS (SELECT draw, venue, e, m, mv, {_WEIGHT} AS w FROM (SELECT k.*, draw, ('0x' || substr(md5('boot:' || draw || ':' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM k, (SELECT unnest(range(400)) AS draw)))"""


def _coded(spark, d):
    u = _dsl(spark, d)
    return u.where("coded").select("id", ((F.col("y") - F.col("p")) / F.col("pi")).alias("e"), "venue"), u.count()


@query(_BOOT + " SELECT draw, round(max(m) * sum(w * e) / sum(w) / max(total), 8) AS correction FROM w, nt GROUP BY draw")
def dsl_bootstrap(spark, d):
    e, total = _coded(spark, d)
    return estimate.bootstrap(e, "e", "id", total, 400).withColumn("correction", F.round("correction", 8))


_VARIANCE = _BOOT + """, b AS (SELECT draw, max(m) * sum(w * e) / sum(w) / max(total) AS c FROM w, nt GROUP BY draw),
h AS (SELECT draw, venue, max(mv) * coalesce(sum(w * e) / nullif(sum(w), 0), 0) / max(total) AS c FROM w, nt GROUP BY ALL), hb AS (SELECT draw, sum(c) AS c FROM h GROUP BY 1),
a AS (SELECT sqrt(count(*) * var_samp(e)) / max(total) * sqrt(1 - count(*) / max(total)::DOUBLE) AS se FROM k, nt), n AS (SELECT avg(p) AS naive FROM s),
o AS (SELECT stddev_samp(c) AS boot, quantile_cont(c, 0.025) AS lo, quantile_cont(c, 0.975) AS hi FROM b), st AS (SELECT stddev_samp(c) AS strat FROM hb)
SELECT round(naive + lo, 6) AS low, round(naive + hi, 6) AS high, round(boot, 6) AS boot_se, round(strat, 6) AS stratified_se, round(se, 6) AS analytic_se, round(boot / se, 4) AS ratio FROM o, st, a, n"""


@query(_VARIANCE)
def variance_check(spark, d):
    """The bootstrap's interval and standard errors, plain and within strata, against the analytic one."""
    u = _dsl(spark, d)
    e, total = _coded(spark, d)
    naive = u.agg(F.avg("p").alias("naive"))
    plain = estimate.interval(estimate.bootstrap(e, "e", "id", total, 400).crossJoin(F.broadcast(naive)), "correction", F.max("naive"))  # one row
    strata = estimate.bootstrap(e, "e", "id", total, 400, stratum="venue").agg(F.stddev_samp("correction").alias("stratified_se"))
    x = estimate.variance_table(plain, strata, estimate.analytic_se(u, "p", "y", "coded", "pi", "total"))
    return x.select(*(F.round(c, 6).alias(c) for c in ("low", "high", "boot_se", "stratified_se", "analytic_se")), F.round("ratio", 4).alias("ratio"))


CROSS = f"WITH {UNITS}, n AS (SELECT a, b, count(*) AS n FROM u WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL), la AS (SELECT DISTINCT a FROM n), lb AS (SELECT DISTINCT b FROM n), c AS (SELECT la.a, lb.b, coalesce(n.n, 0) AS n FROM la CROSS JOIN lb LEFT JOIN n ON n.a = la.a AND n.b = lb.b)"


@query(CROSS + """, e AS (SELECT *, (sum(n) OVER (PARTITION BY a))::DOUBLE * (sum(n) OVER (PARTITION BY b)) / (sum(n) OVER ()) AS e, sum(n) OVER () AS t FROM c),
g AS (SELECT max(t)::BIGINT AS n, sum((n - e) * (n - e) / e) AS chi2, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb, avg((e < 5)::INT::DOUBLE) AS few, min(e) AS least FROM e)
SELECT n, round(chi2, 5) AS chi2, (ka - 1) * (kb - 1) AS df, round(sqrt(chi2 / (n * (least(ka, kb) - 1))), 6) AS cramers_v, few <= 0.2 AND least >= 1 AS cochran_ok FROM g""")
def chi2_cramers_v(spark, d):
    x = estimate.chi_square(estimate.crosstab(units(spark, d), "a", "b"), "a", "b")
    return x.select("n", F.round("chi2", 5).alias("chi2"), "df", F.round("cramers_v", 6).alias("cramers_v"), "cochran_ok")


@query(CROSS + """, p AS (SELECT n / (sum(n) OVER ())::DOUBLE AS p, sum(n) OVER (PARTITION BY a) / (sum(n) OVER ())::DOUBLE AS pa, sum(n) OVER (PARTITION BY b) / (sum(n) OVER ())::DOUBLE AS pb, n, sum(n) OVER () AS t FROM c)
SELECT max(t)::BIGINT AS n, round(sum(p * ln(p / (pa * pb))) / sqrt(sum(-p * ln(pa)) * sum(-p * ln(pb))), 6) AS nmi FROM p WHERE n > 0""")
def nmi_alignment(spark, d):
    x = estimate.normalised_mutual_information(estimate.crosstab(units(spark, d), "a", "b"), "a", "b")
    return x.select("n", F.round("nmi", 6).alias("nmi"))


@query(f"WITH {UNITS} SELECT venue, count(*) AS n, round(avg((a IS NULL)::INT::DOUBLE), 6) AS removed, round(avg(p), 6) AS observed, round(avg(p) * (1 - avg((a IS NULL)::INT::DOUBLE)) + avg((a IS NULL)::INT::DOUBLE), 6) AS worst_case FROM u GROUP BY 1")
def removal_bound(spark, d):
    g = units(spark, d).groupBy("venue").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("a").isNull().cast("double")).alias("removed"), F.avg("p").alias("observed"))
    return g.select("venue", "n", F.round("removed", 6).alias("removed"), F.round("observed", 6).alias("observed"), F.round(estimate.removal_bound(F.col("observed"), F.col("removed")), 6).alias("worst_case"))


@query("""WITH t AS (SELECT p_brand AS term, exp(-avg(p_size) / 5) AS p FROM part GROUP BY 1), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, term) AS raw FROM t)
SELECT term, round(p, 8) AS p, round(least(1.0::DOUBLE, min(raw) OVER (ORDER BY p DESC, term DESC ROWS UNBOUNDED PRECEDING)), 8) AS p_adj FROM r""")
def bh_adjust(spark, d):
    t = table(spark, d, "part").groupBy(F.col("p_brand").alias("term")).agg(F.exp(-F.avg("p_size") / 5).alias("p"))
    return estimate.bh_adjust(t, "p", "term").select("term", F.round("p", 8).alias("p"), F.round("p_adj", 8).alias("p_adj"))


@query(f"""WITH {UNITS}, m AS (SELECT avg(n_chars) AS m1, stddev_samp(n_chars) AS s1, avg(ln(1 + n_words)) AS m2, stddev_samp(ln(1 + n_words)) AS s2 FROM u) SELECT id, round((n_chars - m1) / s1, 5) AS z_chars, round((ln(1 + n_words) - m2) / s2, 5) AS z_words FROM u, m""")
def zscore_features(spark, d):
    u = units(spark, d).select("id", F.col("n_chars").cast("double").alias("z_chars"), F.log1p("n_words").alias("z_words"))
    return estimate.zscore(u, ["z_chars", "z_words"]).select("id", F.round("z_chars", 5).alias("z_chars"), F.round("z_words", 5).alias("z_words"))


@query("SELECT event_type AS venue, " + ", ".join(f"round(quantile_cont(value, {q}), 5) AS q{int(1000 * q)}" for q in (0.025, 0.25, 0.5, 0.75, 0.975)) + " FROM events GROUP BY 1")
def quantiles(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("venue")).agg(*(F.round(F.percentile("value", q), 5).alias(f"q{int(1000 * q)}") for q in (0.025, 0.25, 0.5, 0.75, 0.975)))


@query("""WITH t AS (SELECT p_brand AS term, avg(p_retailprice) / 1000 - 1 AS estimate, 0.05::DOUBLE + count(*) / 1000.0::DOUBLE AS se FROM part GROUP BY 1) SELECT term, round(estimate / se, 5) AS z, round(exp(estimate), 5) AS odds_ratio, round(exp(estimate - 1.96 * se), 5) AS or_low, round(exp(estimate + 1.96 * se), 5) AS or_high FROM t""")
def wald_table(spark, d):
    t = table(spark, d, "part").groupBy(F.col("p_brand").alias("term")).agg((F.avg("p_retailprice") / 1000 - 1).alias("estimate"), (F.lit(0.05) + F.count(F.lit(1)) / 1000.0).alias("se"))
    return estimate.wald_table(t, "estimate", "se").select("term", *(F.round(c, 5).alias(c) for c in ("z", "odds_ratio", "or_low", "or_high")))


# --- text and topics --------------------------------------------------------------------------

_STOP = in_list(T.STOPWORDS)
_DFM = rf"""toks AS (SELECT doc_id AS id, source AS venue, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: t NOT IN {_STOP}) AS t FROM documents),
dfm AS (SELECT id, venue, term, count(*) AS n FROM (SELECT id, venue, unnest(t) AS term FROM toks) GROUP BY ALL)"""


def _dfm(spark, d, longest: int = 1):
    """(comments with tokens, their terms): dealt by id as texts, so that counts by id and term, and sums by id, shuffle no more."""
    c = comments(spark, d).repartition("id").select("id", "venue", T.without(T.tokens(F.col("body")), T.STOPWORDS).alias("t"))
    return c, lexicon.document_terms(c.select("id", T.ngrams(F.col("t"), longest).alias("t")) if longest > 1 else c.select("id", "t"), "id", F.col("t"))


def _counted(spark, d, terms=lambda t: t):
    """(id, term, n) of terms of the tokens: within the rows, or, if an id comes twice, with the texts dealt by id."""
    c = comments(spark, d)
    t = lambda c: c.select("id", T.without(T.tokens(F.col("body")), T.STOPWORDS).alias("t"))
    if lexicon.ids_are_unique(c, "id"):
        return lexicon.row_terms(t(c), "id", terms(F.col("t")))
    return lexicon.document_terms(t(c.repartition("id")), "id", terms(F.col("t")))


def _venue_terms(spark, d):
    """(venue, term, n): no document id travels."""
    return lexicon.document_terms(comments(spark, d).select("venue", T.without(T.tokens(F.col("body")), T.STOPWORDS).alias("t")), "venue", F.col("t"))


@query(f"""WITH {_DFM}, s AS (SELECT term FROM dfm GROUP BY 1 HAVING sum(n) >= 20 AND count(*) >= 10), k AS (SELECT term, count(*) AS df FROM dfm GROUP BY 1), nd AS (SELECT count(DISTINCT id) AS docs FROM dfm),
x AS (SELECT dfm.* FROM dfm JOIN s USING (term) JOIN k USING (term), nd WHERE df <= 0.4 * docs), y AS (SELECT *, sum(n) OVER (PARTITION BY id) AS tot FROM x) SELECT id, term, n FROM y WHERE tot >= 3""")
def dfm_trim(spark, d):
    return lexicon.trim(_counted(spark, d), "id", 20, 10, 0.4, 3)


@query(f"""WITH {_DFM} SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM dfm GROUP BY 1 HAVING count(*) >= 2 ORDER BY tf DESC, term LIMIT 5000""")
def vocabulary_top(spark, d):
    return lexicon.vocabulary(_counted(spark, d), 2, 5000)


@query(f"""WITH {_DFM}, g AS (SELECT id, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS b FROM toks), u AS (SELECT id, unnest(b) AS term FROM g) SELECT term, count(*) AS n, count(DISTINCT id) AS docs FROM u GROUP BY 1 HAVING count(DISTINCT id) >= 3""")
def bigram_counts(spark, d):
    b = _counted(spark, d, T.bigrams)
    return b.groupBy("term").agg(F.sum("n").alias("n"), F.count("id").alias("docs")).where("docs >= 3")


@query(f"""WITH {_DFM}, c AS (SELECT venue, term, sum(n) AS n FROM dfm GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY venue) AS total, count(*) OVER (PARTITION BY term) AS df FROM c), k AS (SELECT count(DISTINCT venue) AS k FROM dfm),
s AS (SELECT venue, term, n / total::DOUBLE * ln(1 + k / df::DOUBLE) AS score FROM x, k), r AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY round(score, 12) DESC, term) AS rk FROM s) SELECT venue, CAST(rk AS BIGINT) AS rank, term, round(score, 8) AS score FROM r WHERE rk <= 15""")
def ctfidf_top(spark, d):
    x = lexicon.class_tfidf(_venue_terms(spark, d), "venue", 15)
    return x.select("venue", "rank", "term", F.round("score", 8).alias("score"))


_TERMS = rf"""terms AS (SELECT venue, term, count(*) AS n FROM (SELECT source AS venue, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: t NOT IN {_STOP})) AS term FROM documents) GROUP BY ALL)"""
#: The two-sided tail for u, the deviate over the root of two, apart from how the operator does it: Simpson's rule for the middle, Craig's integral by 64 midpoints beyond 2.
_TAIL = """CASE WHEN u < 2 THEN 1 - 2 / sqrt(pi()) * u / 384 * list_sum(list_transform(range(0, 64), lambda k: exp(-((u * k / 64) ** 2)) + 4 * exp(-((u * (k + 0.5::DOUBLE) / 64) ** 2)) + exp(-((u * (k + 1) / 64) ** 2))))
  ELSE list_sum(list_transform(range(0, 64), lambda k: exp(-u * u / (sin((k + 0.5::DOUBLE) * pi() / 128) ** 2)))) / 64 END"""


@query(f"""WITH {_TERMS}, g AS (SELECT term, coalesce(sum(n) FILTER (venue < 'src5'), 0)::DOUBLE AS a, coalesce(sum(n) FILTER (NOT venue < 'src5'), 0)::DOUBLE AS b FROM terms GROUP BY 1), t AS (SELECT sum(a) AS t1, sum(b) AS t0 FROM g), x AS (SELECT *, t1 - a AS c, t0 - b AS d, t1 + t0 AS n FROM g, t WHERE a + b >= 5),
y AS (SELECT term, a, b, 2 * (if(a > 0, a * ln(a * n / ((a + b) * t1)), 0) + if(b > 0, b * ln(b * n / ((a + b) * t0)), 0) + if(c > 0, c * ln(c * n / ((c + d) * t1)), 0) + if(d > 0, d * ln(d * n / ((c + d) * t0)), 0)) AS g, if(a / t1 >= b / t0, 1.0::DOUBLE, -1.0::DOUBLE) AS s FROM x),
z AS (SELECT *, sqrt(abs(g)) / sqrt(2.0::DOUBLE) AS u FROM y) SELECT term, a::BIGINT AS n_target, b::BIGINT AS n_reference, round(s * g, 2) + 0.0::DOUBLE AS g2, round({_TAIL}, 5) + 0.0::DOUBLE AS p FROM z""")
def keyness_g2(spark, d):
    x = lexicon.keyness(_venue_terms(spark, d), F.col("venue") < "src5")
    return x.where("n_target + n_reference >= 5").select("term", "n_target", "n_reference", F.round("g2", 2).alias("g2"), F.round("p", 5).alias("p"))


_POS, _NEG = ["with", "for", "that"], ["from", "was", "by"]
_NT = rf"""t AS (SELECT doc_id AS id, {TOK.format("text")} AS t FROM documents), z AS (SELECT id, greatest(1, len(t)) AS k, list_transform(range(1, len(t) + 1), lambda i: struct_pack(w := t[i], g := i > 1 AND t[greatest(i - 1, 1)] IN {in_list(lexicon.NEGATORS)})) AS p FROM t),
c AS (SELECT id, k, len(list_filter(p, lambda x: (x.w IN {in_list(_POS)} AND NOT x.g) OR (x.w IN {in_list(_NEG)} AND x.g))) AS pos, len(list_filter(p, lambda x: (x.w IN {in_list(_NEG)} AND NOT x.g) OR (x.w IN {in_list(_POS)} AND x.g))) AS neg FROM z)"""


@query(f"WITH {_NT} SELECT id, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, round((pos - neg) / k::DOUBLE, 6) AS tone, CASE WHEN pos > neg THEN 'trust' WHEN neg > pos THEN 'distrust' ELSE 'non_evaluative' END AS label FROM c")
def net_tone(spark, d):
    t = comments(spark, d).select("id", T.tokens(F.col("body")).alias("t"))
    x = lexicon.net_tone(F.col("t"), _POS, _NEG)
    return t.select("id", x["pos"].alias("pos"), x["neg"].alias("neg"), F.round(x["tone"], 6).alias("tone"), x["label"].alias("label"))


@query(f"""WITH {UNITS}, x AS (SELECT venue, a FROM u WHERE a IS NOT NULL) SELECT venue, """ + ", ".join(f"round(avg((a = '{v}')::INT::DOUBLE), 6) AS {v}" for v in ("trust", "distrust", "ambivalent", "non_evaluative")) + ", round(avg((a = 'distrust')::INT::DOUBLE) / greatest(0.01::DOUBLE, avg((a = 'trust')::INT::DOUBLE)), 5) AS distrust_ratio FROM x GROUP BY 1")
def topic_share_pivot(spark, d):
    levels = ["trust", "distrust", "ambivalent", "non_evaluative"]
    x = report.pivot_share(units(spark, d), "venue", "a", levels)
    return x.select("venue", *(F.round(c, 6).alias(c) for c in levels), F.round(F.col("distrust") / F.greatest(F.lit(0.01), F.col("trust")), 5).alias("distrust_ratio"))


@query(f"WITH {UNITS}, n AS (SELECT venue, lang, count(*) AS n FROM u GROUP BY ALL) SELECT venue, lang, n, round(n / (sum(n) OVER (PARTITION BY venue))::DOUBLE, 6) AS share FROM n")
def share_within(spark, d):
    return corpus.share_within(units(spark, d), ["venue", "lang"], ["venue"]).withColumn("share", F.round("share", 6))


@query(f"WITH {UNITS} SELECT id, 'n_chars' AS measure, n_chars AS value FROM u UNION ALL SELECT id, 'n_words', n_words FROM u")
def unpivotlong_labels(spark, d):
    return units(spark, d).select("id", "n_chars", "n_words").unpivot("id", ["n_chars", "n_words"], "measure", "value")


@query("""(SELECT o_orderkey AS id, o_totalprice AS value, 'top' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) UNION ALL (SELECT o_orderkey, o_totalprice, 'bottom' FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20)""")
def topk_bottomk(spark, d):
    return corpus.ends(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")), "value", "id", 20)


@query(f"WITH {UNITS}, x AS (SELECT id, (n_chars % 4)::DOUBLE AS p1, (n_words % 4)::DOUBLE AS p2, (n_chars % 3)::DOUBLE AS p3 FROM u) SELECT id, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 'trust' WHEN p2 >= p3 THEN 'distrust' ELSE 'ambivalent' END AS label FROM x")
def argmax_label(spark, d):
    u = units(spark, d)
    return u.select("id", L.argmax_label({"trust": F.col("n_chars") % 4, "distrust": F.col("n_words") % 4, "ambivalent": F.col("n_chars") % 3}).alias("label"))


@query(f"""WITH {UNITS} SELECT CASE WHEN n_words > 50 THEN 'long' WHEN n_words > 15 THEN 'medium' WHEN n_words > 3 THEN 'short' END AS band, CAST(greatest(1, ceil(p * 10)) AS BIGINT) AS decile, count(*) AS n, round(avg(ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p)) / (1 - greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p))))), 5) AS mean_logit FROM u GROUP BY ALL""")
def bins_and_logit(spark, d):
    u = units(spark, d)
    return u.groupBy(L.length_band(F.col("n_words")).alias("band"), L.decile(F.col("p")).alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(L.logit(F.col("p"))), 5).alias("mean_logit"))


@query("""WITH x AS (SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, value FROM events), y AS (SELECT *, CASE WHEN k IS NULL THEN 'k missing' WHEN NOT (k BETWEEN 0 AND 90) THEN 'k out of range' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'type' END AS reason FROM x) SELECT id, k, reason FROM y""")
def json_records_validate(spark, d):
    e = table(spark, d, "events").withColumn("r", annotate.json_from(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), "k long"))
    rules = [("k missing", F.col("r.k").isNotNull()), ("k out of range", F.col("r.k").between(0, 90)), ("type", F.col("event_type").isin("click", "view", "purchase"))]
    return e.select(F.col("event_id").alias("id"), F.col("r.k").alias("k"), annotate.first_fault(rules).alias("reason"))


def _alias_sql() -> str:
    """Whether an alias of entity t is in the padded text s, as SQL."""
    squash = "trim(regexp_replace(regexp_replace('{}', '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
    held = lambda a: "contains(s, ' ' || " + squash.format(a.replace("'", "''")) + " || ' ')"
    return " OR ".join(f"(lower(trim(t)) = '{k}' AND ({' OR '.join(held(a) for a in v)}))" for k, v in graph.ALIASES.items())


@query(rf"""WITH x AS (SELECT i.item_id AS id, i.text AS t, ' ' || regexp_replace(regexp_replace(lower(d.text), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g') || ' ' AS s FROM benchmark i JOIN documents d ON d.doc_id = i.item_id),
y AS (SELECT *, list_filter(string_split(regexp_replace(lower(t), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda w: length(w) > 0) AS words FROM x), z AS (SELECT *, list_filter(words, lambda w: length(w) >= 3 AND w NOT IN {in_list(graph.GROUNDING_STOP)}) AS strong FROM y)
SELECT id, {_alias_sql()} OR coalesce(list_bool_or(list_transform(if(len(strong) > 0, strong, words), lambda w: contains(s, ' ' || w))), false) AS grounded FROM z""")
def groundedness(spark, d):
    """Whether a word of an item's whole text, or an alias of it, begins in the document of its id."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("entity"))
    x = b.join(comments(spark, d).select("id", "body"), "id")
    return x.select("id", graph.grounded(F.col("entity"), F.col("body")).alias("grounded"))


# --- graph ------------------------------------------------------------------------------------


@query(f"WITH {TRIPLES} SELECT subject, relation, object, weight, trusting, distrusting, CASE WHEN distrusting > trusting THEN -1 WHEN trusting > distrusting THEN 1 ELSE 0 END AS sign FROM edges")
def kg_edges(spark, d):
    return graph.edges(triples(spark, d)).select("subject", "relation", "object", "weight", "trusting", "distrusting", "sign")


@query(f"WITH {TRIPLES} SELECT node, count(*) AS degree FROM (SELECT unnest([subject, object]) AS node FROM edges) GROUP BY 1")
def kg_degree(spark, d):
    return graph.degree(graph.edges(triples(spark, d)))


@query(f"WITH {TRIPLES}, g AS (SELECT node, count(*) AS k FROM (SELECT unnest([subject, object]) AS node FROM edges) GROUP BY 1), c AS (SELECT node FROM g WHERE k >= (SELECT quantile_disc(k, 0.5) FROM g)) SELECT subject, relation, object, weight FROM edges WHERE subject IN (SELECT node FROM c) AND object IN (SELECT node FROM c)")
def kg_core(spark, d):
    e = graph.edges(triples(spark, d))
    least = graph.degree(e).agg(F.expr("percentile_disc(0.5) within group (order by degree)")).first()[0] or 0
    return graph.core(e, int(least)).select("subject", "relation", "object", "weight")


@query(f"WITH {TRIPLES} SELECT node, count(*) FILTER (valence = 'trusting') AS trusting, count(*) FILTER (valence = 'distrusting') AS distrusting, count(*) FILTER (valence = 'trusting') - count(*) FILTER (valence = 'distrusting') AS net FROM (SELECT unnest([subject, object]) AS node, valence FROM triples) GROUP BY 1")
def kg_entity_valence(spark, d):
    return graph.entity_valence(triples(spark, d))


@query(f"WITH {TRIPLES}, g AS (SELECT node, count(*) AS degree, substring(node, 1, 6) AS community FROM (SELECT unnest([subject, object]) AS node FROM edges) GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS r, count(*) OVER (PARTITION BY community) AS n FROM g) SELECT community, max(n) AS n, string_agg(node, ', ' ORDER BY r) AS members FROM r WHERE r <= 8 GROUP BY 1")
def kg_communities_topn(spark, d):
    n = graph.degree(graph.edges(triples(spark, d))).withColumn("community", F.substring("node", 1, 6))
    return graph.members(n, "community", 8)


@query(f"WITH {TRIPLES} SELECT least(subject, object) AS a, greatest(subject, object) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM edges WHERE subject <> object GROUP BY ALL")
def kg_undirected(spark, d):
    return graph.undirected(graph.edges(triples(spark, d)))


@query(f"WITH {TRIPLES}, s AS (SELECT subject AS node, subject_type AS type, weight, 0 AS side FROM edges UNION ALL SELECT object, object_type, weight, 1 FROM edges) SELECT node, type FROM s QUALIFY row_number() OVER (PARTITION BY node ORDER BY side, weight DESC, type) = 1")
def kg_node_types(spark, d):
    return graph.node_types(graph.edges(triples(spark, d)))


@query(f"""WITH {TRIPLES}, e AS (SELECT least(subject, object) AS a, greatest(subject, object) AS b, CAST(sum(weight) AS DOUBLE) AS w FROM edges WHERE subject <> object GROUP BY ALL), k AS (SELECT c, sum(w) AS k FROM (SELECT unnest([substring(a, 1, 7), substring(b, 1, 7)]) AS c, w FROM e) GROUP BY 1), t AS (SELECT sum(w) AS m, sum(CASE WHEN substring(a, 1, 7) = substring(b, 1, 7) THEN w ELSE 0 END) AS i FROM e)
SELECT round(max(i) / max(m) - sum(k * k) / (4 * max(m) * max(m)), 6) AS modularity FROM k, t""")
def kg_modularity(spark, d):
    u = graph.undirected(graph.edges(triples(spark, d)))
    labels = u.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.substring("node", 1, 7))
    return graph.modularity(u, labels, weighted=True).select(F.round("modularity", 6).alias("modularity"))


@query(f"""WITH {TRIPLES}, e AS (SELECT least(subject, object) AS a, greatest(subject, object) AS b FROM edges WHERE subject <> object GROUP BY ALL), k AS (SELECT c, count(*) AS k FROM (SELECT unnest([substring(a, 1, 7), substring(b, 1, 7)]) AS c FROM e) GROUP BY 1), t AS (SELECT count(*) AS m, count(*) FILTER (substring(a, 1, 7) = substring(b, 1, 7)) AS i FROM e)
SELECT round(max(i) / max(m)::DOUBLE - sum(k * k) / (4.0::DOUBLE * max(m) * max(m)), 6) AS modularity FROM k, t""")
def kg_modularity_unweighted(spark, d):
    u = graph.undirected(graph.edges(triples(spark, d)))
    labels = u.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.substring("node", 1, 7))
    return graph.modularity(u, labels).select(F.round("modularity", 6).alias("modularity"))


# --- learning and annotation ------------------------------------------------------------------


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("y"), (F.col("vec_id") % 7).cast("double").alias("s1"))


@query()
def distill_scores(spark, d):
    from pyspark.ml.functions import vector_to_array

    v = learn.features(_vectors(spark, d), "embedding", ["s1"]).withColumn("y", (F.col("y") % 2).cast("double"))
    test = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    known = F.col("y").isNotNull()
    model = learn.elastic_net(v.where(known & ~test), "y")
    scored = model.transform(v).withColumn("p", vector_to_array("probability")[1])  # the whole corpus
    slope, intercept = learn.platt(scored.where(known & test), "p", "y")
    return scored.select("id", "p", learn.calibrated(F.col("p"), slope, intercept).alias("p_calibrated"), (F.col("p") > 0.5).alias("pred"))


@query()
def kmeans_pca(spark, d):
    return learn.cluster(_vectors(spark, d), "embedding", 14, 50).select("id", "cluster")


_SEEDS = {f"topic{i}": words for i, words in enumerate((["that", "with"], ["des", "les"], ["der", "die"], ["para", "por"], ["from", "have"], ["est", "dans"], ["und", "nicht"], ["los", "una"], ["this", "not"], ["pour", "qui"]), 1)}


@query(f"""WITH {UNITS} SELECT 'units' AS quantity, CAST(count(*) AS DOUBLE) AS value FROM u UNION ALL SELECT 'labelled', CAST(count(quality) AS DOUBLE) FROM u UNION ALL SELECT 'mean_words', round(avg(n_words), 6) FROM u""")
def key_value_report(spark, d):
    return report.key_values(units(spark, d), {"units": F.count(F.lit(1)), "labelled": F.count("quality"), "mean_words": F.round(F.avg("n_words"), 6)})
