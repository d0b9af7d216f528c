"""The engine's logical tables over the tables at hand, each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as comments: id, body, venue, lang."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("source").alias("venue"), "lang")


def _label(n: str, modulus: int, first: int) -> F.Column:
    c = F.col(n) % modulus
    return F.when(c < first, "trust").when(c == first, "distrust").when(c == first + 1, "ambivalent").otherwise("non_evaluative")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the human label (truth, from labels), two machine labels (rules on lengths) and a machine probability."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("venue"), "lang", F.length("text").cast("long").alias("n_chars"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n_words"))
    u = d.join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id"), "id", "left")
    truth = F.when(F.col("quality").isNull(), None).when((F.col("quality") == 1) & (F.col("toxic") == 0), "trust").when((F.col("quality") == 0) & (F.col("toxic") == 1), "distrust").when(F.col("quality") == 1, "ambivalent").otherwise("non_evaluative")
    return u.withColumns(
        {
            "truth": truth,
            "a": F.when(F.col("n_chars") % 11 != 0, _label("n_chars", 7, 3)),
            "b": F.when(F.col("n_words") % 13 != 0, _label("n_words", 5, 2)),
            "p": (F.col("n_chars") % 101) / F.lit(100.0),
        }
    )


UNITS = r"""units AS (
  SELECT d.doc_id AS id, d.source AS venue, d.lang, CAST(length(d.text) AS BIGINT) AS n_chars, CAST(len(regexp_extract_all(d.text, '\S+')) AS BIGINT) AS n_words, l.quality, l.toxic,
    CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 1 AND l.toxic = 0 THEN 'trust' WHEN l.quality = 0 AND l.toxic = 1 THEN 'distrust' WHEN l.quality = 1 THEN 'ambivalent' ELSE 'non_evaluative' END AS truth
  FROM documents d LEFT JOIN labels l USING (doc_id)),
u AS (
  SELECT *, CASE WHEN n_chars % 11 = 0 THEN NULL WHEN n_chars % 7 < 3 THEN 'trust' WHEN n_chars % 7 = 3 THEN 'distrust' WHEN n_chars % 7 = 4 THEN 'ambivalent' ELSE 'non_evaluative' END AS a,
    CASE WHEN n_words % 13 = 0 THEN NULL WHEN n_words % 5 < 2 THEN 'trust' WHEN n_words % 5 = 2 THEN 'distrust' WHEN n_words % 5 = 3 THEN 'ambivalent' ELSE 'non_evaluative' END AS b,
    CAST(n_chars % 101 AS DOUBLE) / 100 AS p
  FROM units)"""


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a sampling frame: id, created (order), stratum = type | flag | band, value."""
    e = table(spark, sf_dir, "events")
    from ..functions.labels import length_band

    band = length_band(F.col("event_id") % 60 + 4)
    flag = F.when(F.col("user_id") % 3 == 0, "flag").otherwise("plain")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("created"), F.col("event_type").alias("venue"), flag.alias("flag"), F.concat_ws("|", "event_type", flag, band).alias("stratum"), "value", "user_id")


FRAME = """frame AS (
  SELECT event_id AS id, ts AS created, event_type AS venue, CASE WHEN user_id % 3 = 0 THEN 'flag' ELSE 'plain' END AS flag, value, user_id,
    event_type || '|' || CASE WHEN user_id % 3 = 0 THEN 'flag' ELSE 'plain' END || '|' || CASE WHEN event_id % 60 + 4 > 50 THEN 'long' WHEN event_id % 60 + 4 > 15 THEN 'medium' ELSE 'short' END AS stratum
  FROM events)"""

#: The allocation that the sampling queries use: units in all, and the part of each group.
TOTAL, SHARES, LEAST = 1000, {"flag": 0.7, "plain": 0.3}, 20

DESIGN = f"""sizes AS (SELECT stratum, any_value(flag) AS flag, count(*) AS pop_n FROM frame GROUP BY stratum),
design AS (
  SELECT *, CAST(least(greatest(round_even({TOTAL} * CASE flag WHEN 'flag' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * sqrt(pop_n::DOUBLE) / sum(sqrt(pop_n::DOUBLE)) OVER (PARTITION BY flag), 0), {LEAST}), pop_n) AS BIGINT) AS alloc_n FROM sizes)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads: each turn answers the one before; the first answers a submission."""
    c = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    parent = F.when(F.col("turn") == 0, F.concat(F.lit("t3_"), F.col("conv_id").cast("string"))).otherwise(F.concat(F.lit("t1_"), name(F.col("turn") - 1)))
    return c.select(name(F.col("turn")).alias("id"), parent.alias("parent_id"), F.col("conv_id").alias("link_id"), "turn", F.col("role").alias("author"), F.col("text").alias("body"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as relations: supplier, return flag, part brand, with a valence from the line's status and discount."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size"), "l_partkey")
    valence = F.when(F.col("l_discount") > 0.06, "distrusting").when(F.col("l_linestatus") == "F", "trusting").otherwise("neutral")
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("subject"), F.lit("actor").alias("subject_type"), F.col("l_returnflag").alias("relation"), F.col("p_brand").alias("object"), F.lit("model").alias("object_type"), valence.alias("valence"))


TRIPLES = """triples AS (
  SELECT 's' || CAST(l_suppkey AS VARCHAR) AS subject, 'actor' AS subject_type, l_returnflag AS relation, p_brand AS object, 'model' AS object_type,
    CASE WHEN l_discount > 0.06 THEN 'distrusting' WHEN l_linestatus = 'F' THEN 'trusting' ELSE 'neutral' END AS valence
  FROM lineitem JOIN part ON l_partkey = p_partkey),
edges AS (
  SELECT subject, subject_type, relation, object, object_type, count(*) AS weight, count(*) FILTER (valence = 'trusting') AS trusting, count(*) FILTER (valence = 'distrusting') AS distrusting
  FROM triples GROUP BY ALL)"""


#: Start and end of the window of the raw comments that the cleaning queries keep.
WINDOW = ("2026-01-02 00:00:00", "2026-02-20 00:00:00")


def raw_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw comments: created_utc, author, distinguished, stickied, permalink, parent_id, body with tombstones among them."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    author = F.when(i % 41 == 0, None).when(i % 37 == 0, "AutoModerator").when(i % 31 == 0, "helper_bot7").when(i % 29 == 0, "RemindMeBot").when(i % 23 == 0, "src_modteam").otherwise(F.concat(F.lit("user"), (i % 997).cast("string")))
    return d.select(
        i.alias("id"),
        (F.lit(1767225600) + F.pmod(i * 7919, F.lit(5_184_000))).cast("long").alias("created_utc"),
        author.alias("author"),
        F.when(i % 43 == 0, "moderator").when(i % 2 == 0, "").alias("distinguished"),
        F.when(i % 3 != 0, i % 47 == 0).alias("stickied"),
        F.concat(F.lit("/r/"), "source", F.lit("/comments/x"), i.cast("string"), F.lit("/a_thread_about_"), "source", F.lit("/")).alias("permalink"),
        F.concat(F.when(i % 5 == 0, "t3_").when(i % 5 == 1, "t3x").otherwise("t1_"), (i % 91).cast("string")).alias("parent_id"),
        F.when(i % 19 == 0, "[deleted]").when(i % 53 == 0, "[removed]").otherwise(F.col("text")).alias("body"),
    )


RAW = """raw AS (
  SELECT doc_id AS id, 1767225600 + (doc_id * 7919) % 5184000 AS created_utc,
    CASE WHEN doc_id % 41 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN 'AutoModerator' WHEN doc_id % 31 = 0 THEN 'helper_bot7' WHEN doc_id % 29 = 0 THEN 'RemindMeBot' WHEN doc_id % 23 = 0 THEN 'src_modteam' ELSE 'user' || (doc_id % 997) END AS author,
    CASE WHEN doc_id % 43 = 0 THEN 'moderator' WHEN doc_id % 2 = 0 THEN '' END AS distinguished, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 47 = 0 END AS stickied,
    '/r/' || source || '/comments/x' || doc_id || '/a_thread_about_' || source || '/' AS permalink, CASE doc_id % 5 WHEN 0 THEN 't3_' WHEN 1 THEN 't3x' ELSE 't1_' END || (doc_id % 91) AS parent_id,
    CASE WHEN doc_id % 19 = 0 THEN '[deleted]' WHEN doc_id % 53 = 0 THEN '[removed]' ELSE text END AS body
  FROM documents)"""

#: Names as annotators write them, one for each remainder of a document's id; the queries canonicalise them.
NAMES = [
    "Chat GPT", "gpt-4o", "OpenAI.", "open ai", "Claude 3", "anthropic", "bard", "google deepmind", "Deep Seek v3", "llama 3", "meta ai", "Meta", "grok", "Altman", "elon", "midjourney v6", "LLMs", "a.i.",
    "bosses and ceos", "the  future of work", "Google v. Oracle", "man vs machine", "", "...", "O3", "openai's models", "Facebook", "artists", "right to repair!!", "an end in itself",
]


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two names as written: subject and object."""
    names = F.array(*(F.lit(n) for n in NAMES))
    pick = lambda step: F.element_at(names, (F.pmod(F.col("doc_id") * step, F.lit(len(NAMES))) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("venue"), F.col("text").alias("body"), pick(1).alias("subject"), pick(7).alias("object"))


NAMED = f"""named AS (SELECT doc_id AS id, source AS venue, text AS body, n[doc_id % {len(NAMES)} + 1] AS subject, n[(doc_id * 7) % {len(NAMES)} + 1] AS object
  FROM documents, (SELECT [{", ".join("'" + n.replace("'", "''") + "'" for n in NAMES)}] AS n))"""
