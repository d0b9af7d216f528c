"""Queries of raw records: sources, the comment funnel, flags, dictionaries, names, readers of typed cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..functions.codebook import LEVELS, TRUTHY
from ..operators import annotate, corpus, graph, lexicon
from ..sources import readers
from .adapters import NAMED, RAW, WINDOW, comments, named, raw_comments, replies, table, units
from .catalogue import FW, TOK, in_list, normal_sql, query

# --- sources


@query("SELECT o_orderkey AS id, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F'")
def sql_over_parquet(spark, d):
    return spark.sql(f"SELECT o_orderkey AS id, o_totalprice AS value FROM parquet.`{d}/orders.parquet` WHERE o_orderstatus = 'F'")


@query("SELECT doc_id AS id, lang FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def point_lookup(spark, d):
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    return readers.lookup(comments(spark, d).select("id", "lang"), ids, "id")


@query("SELECT count(*) AS n FROM lineitem")
def metadata_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RAW} SELECT id, strftime(make_timestamp(created_utc * 1000000), '%Y-%m') AS ym, replace(split_part(permalink, '/', 6), '_', ' ') AS thread_slug, parent_id LIKE 't3_%' AS is_top_level, CAST(length(body) AS BIGINT) AS n_chars FROM raw")
def ingest(spark, d):
    return readers.ingest_comments(raw_comments(spark, d)).select("id", "ym", "thread_slug", "is_top_level", "n_chars")


@query("SELECT id, md5(text || chr(65533)) AS digest FROM (SELECT doc_id AS id, text FROM documents)")
def utf8_repair(spark, d):
    broken = F.concat(F.encode("body", "UTF-8"), F.unhex(F.lit("FF"))).cast("string")
    return comments(spark, d).select("id", F.md5(T.valid_utf8(broken)).alias("digest"))


# --- the funnel of raw comments

_BOTS = in_list(T.BOT_NAMES)
_WORDS = r"len(regexp_extract_all(b, '\S+'))"
_STEPS = [
    ("window", f"created_utc >= epoch(TIMESTAMP '{WINDOW[0]}') AND created_utc < epoch(TIMESTAMP '{WINDOW[1]}')"),
    ("tombstones", "body IS NOT NULL AND body NOT IN ('[deleted]', '[removed]', '[unavailable]', '')"),
    ("bots", f"NOT (regexp_matches(author, '{T.BOT_PATTERN}') OR author IN {_BOTS})"),
    ("stickied", "NOT coalesce(stickied, false)"),
    ("moderation", f"NOT (coalesce(distinguished, '') = 'moderator' OR regexp_matches(author, '{T.MODERATOR_PATTERN}'))"),
    ("four_words", f"{_WORDS} >= 4"),
    ("language", rf"len(list_filter({TOK.format('b')}, lambda t: t IN {FW})) / greatest(1, {_WORDS}) >= 0.08 AND len(regexp_extract_all(b, '[A-Za-z]')) / greatest(1, length(b)) >= 0.45"),
]
_FUNNEL = (
    f"WITH {RAW}, x AS (SELECT *, {normal_sql('body')} AS b FROM raw), f AS (SELECT "
    + ", ".join(f"coalesce({sql}, false) AS s{i}" for i, (_, sql) in enumerate(_STEPS, 1))
    + " FROM x), n AS (SELECT count(*) AS c0, "
    + ", ".join(f"count(*) FILTER ({' AND '.join(f's{j}' for j in range(1, i + 1))}) AS c{i}" for i in range(1, len(_STEPS) + 1))
    + " FROM f) "
    + " UNION ALL ".join(f"SELECT {i}::BIGINT AS step_no, '{name}' AS step, c{i} AS n, c{max(0, i - 1)} - c{i} AS dropped, round(100.0::DOUBLE * c{i} / c0, 4) AS pct FROM n" for i, name in enumerate(["raw", *(s for s, _ in _STEPS)]))
)


@query(_FUNNEL)
def comment_funnel(spark, d):
    raw = raw_comments(spark, d).withColumn("created_ts", F.timestamp_seconds("created_utc"))
    return corpus.funnel(*corpus.comment_steps(raw, *WINDOW))


@query(f"WITH {RAW} SELECT id, author, coalesce(distinguished, '') = 'moderator' OR regexp_matches(author, '{T.MODERATOR_PATTERN}') AS moderation, regexp_matches(author, '{T.BOT_PATTERN}') OR author IN {_BOTS} AS bot FROM raw")
def author_flags(spark, d):
    return raw_comments(spark, d).select("id", "author", T.is_moderation(F.col("author"), F.col("distinguished")).alias("moderation"), T.is_bot(F.col("author")).alias("bot"))


@query(f"WITH {RAW} SELECT split_part(permalink, '/', 3) AS venue, count(*) AS n, round(avg((body IN ('[deleted]', '[removed]', '[unavailable]', ''))::INT::DOUBLE), 6) AS removed FROM raw GROUP BY 1")
def removed_share(spark, d):
    gone = F.col("body").isin(T.TOMBSTONES).cast("double")
    return raw_comments(spark, d).groupBy(F.split_part("permalink", F.lit("/"), F.lit(3)).alias("venue")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(gone), 6).alias("removed"))


# --- flags by pattern; \b is Unicode's, which the SQL spells out


def _bounded(pattern: str) -> str:
    return r"(^|[^\p{L}\p{N}_\p{M}])(" + pattern.replace("'", "''") + r")($|[^\p{L}\p{N}_\p{M}])"


@query(rf"SELECT doc_id AS id, regexp_matches(text, '{_bounded(T.RELEVANCE_PATTERN[2:-2])}', 'i') AS relevant FROM documents")
def relevance_flags(spark, d):
    return comments(spark, d).select("id", T.relevance_flag(F.col("body")).alias("relevant"))


_LISTS = {"vulgarity": T.VULGARITY, "name_calling": T.NAME_CALLING, "lying": T.LYING}
_LIST_SQL = {k: f"regexp_matches(text, '{_bounded('|'.join(v))}', 'i')" for k, v in _LISTS.items()}


@query(f"SELECT doc_id AS id, {', '.join(f'{s} AS {k}' for k, s in _LIST_SQL.items())}, {' OR '.join(_LIST_SQL.values())} AS any_incivility FROM documents")
def incivility_flags(spark, d):
    flags = comments(spark, d).select("id", *(T.word_flag(F.col("body"), v).alias(k) for k, v in _LISTS.items()))
    return flags.withColumn("any_incivility", L.any_of([F.col(k) for k in _LISTS], nulls="false"))


_DICTIONARY = {"positive": ["with", "for", "that*"], "negative": ["from", "was", "by"], "neg_positive": ["not with", "not for", "not that*"], "pair": ["the *"]}
_POSITIVE = "(e.w = 'with' OR e.w = 'for' OR starts_with(e.w, 'that'))"
_DICTIONARY_SQL = rf"""WITH x AS (SELECT doc_id AS id, {TOK.format("text")} AS t FROM documents),
z AS (SELECT id, list_transform(range(1, len(t) + 1), lambda i: struct_pack(p := CASE WHEN i > 1 THEN t[greatest(i - 1, 1)] ELSE '' END, w := t[i], n := coalesce(t[i + 1], ''))) AS z FROM x)
SELECT id, len(list_filter(z, lambda e: {_POSITIVE} AND e.p <> 'not' AND e.p <> 'the'))::BIGINT AS positive, len(list_filter(z, lambda e: e.w IN ('from', 'was', 'by') AND e.p <> 'the'))::BIGINT AS negative,
  len(list_filter(z, lambda e: e.w = 'not' AND (e.n = 'with' OR e.n = 'for' OR starts_with(e.n, 'that'))))::BIGINT AS neg_positive, len(list_filter(z, lambda e: e.w = 'the' AND e.n <> ''))::BIGINT AS pair FROM z"""


@query(_DICTIONARY_SQL)
def dictionary_scope(spark, d):
    c = comments(spark, d).select("id", T.tokens(F.col("body")).alias("t"))
    return c.select("id", lexicon.dictionary_counts(F.col("t"), _DICTIONARY).alias("k")).select("id", "k.*")


# --- names

_SMALL = in_list(graph.SMALL_WORDS)
_RULES = " ".join(f"WHEN regexp_matches(v, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in reversed(graph.ENTITY_RULES))


def _canonical(c: str) -> str:
    v = rf"regexp_replace(lower(trim(regexp_replace({c}, '[[:punct:]]+$', ''))), '\s+', ' ', 'g')"
    title = f"array_to_string(list_transform(string_split(v, ' '), lambda w, i: CASE WHEN i > 1 AND w IN {_SMALL} THEN w ELSE upper(substring(w, 1, 1)) || substring(w, 2) END), ' ')"
    return f"(SELECT CASE {_RULES} ELSE {title} END FROM (SELECT {v} AS v))"


_ENDS = f"{NAMED}, ends AS (SELECT id, venue, body, {_canonical('subject')} AS subject, {_canonical('object')} AS object, subject AS raw_subject FROM named)"


@query(f"WITH {_ENDS} SELECT id, subject AS name FROM ends")
def canonical_names(spark, d):
    return named(spark, d).select("id", graph.canonical_entity(F.col("subject")).alias("name"))


@query(f"""WITH {_ENDS} SELECT subject, object, count(*) AS weight, count(*) FILTER (venue < 'src5') AS trusting FROM ends WHERE length(subject) > 0 AND length(object) > 0 AND subject <> object GROUP BY ALL""")
def triples_assembled(spark, d):
    """From cached answers, as JSON lists of triples, to canonical edges."""
    one = F.struct("subject", F.lit("actor").alias("subject_type"), F.lit("trusted_for").alias("relation"), "object", F.lit("model").alias("object_type"), F.when(F.col("venue") < "src5", "trusting").otherwise("neutral").alias("valence"))
    cache = named(spark, d).select("id", F.to_json(F.struct(F.array(one).alias("triples"))).alias("answer"))
    e = graph.edges(graph.clean_triples(annotate.triples_from(cache, "id", "answer")))
    return e.select("subject", "object", "weight", "trusting")


@query(f"WITH {NAMED} SELECT count(*) AS n, round(avg((contains(b, s))::INT::DOUBLE), 6) AS subject_share, round(avg((contains(b, o))::INT::DOUBLE), 6) AS object_share, round(avg((contains(b, s) AND contains(b, o))::INT::DOUBLE), 6) AS both_share FROM (SELECT ' ' || trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')) || ' ' AS b, ' ' || ['the', 'and', 'der', 'les', 'que'][id % 5 + 1] || ' ' AS s, ' ' || ['of', 'des', 'und', 'para', 'with'][id % 5 + 1] || ' ' AS o FROM named)")
def grounded_shares(spark, d):
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 5 + 1).cast("int"))
    t = named(spark, d).select("body", pick(["the", "and", "der", "les", "que"]).alias("subject"), pick(["of", "des", "und", "para", "with"]).alias("object"))
    x = graph.grounded_shares(t.select("body", graph.whole_word(F.col("subject"), F.col("body")).alias("s"), graph.whole_word(F.col("object"), F.col("body")).alias("o")), "s", "o")
    return x.select("n", *(F.round(c, 6).alias(c) for c in ("subject_share", "object_share", "both_share")))


# --- typed cells

_CELLS = ["1", "Trust.", "dis", "ambi", "NON EVALUATIVE", "9", "", "t", " 3 ", "trust;", "no idea", None]


def _cell():
    return F.element_at(F.array(*(F.lit(c) for c in _CELLS)), (F.col("id") % len(_CELLS) + 1).cast("int"))


_STANCE = LEVELS["stance"]
_CELL_SQL = "[" + ", ".join("NULL" if c is None else f"'{c}'" for c in _CELLS) + f"][doc_id % {len(_CELLS)} + 1]"


@query(rf"""WITH x AS (SELECT doc_id AS id, {_CELL_SQL} AS cell FROM documents), y AS (SELECT *, regexp_replace(regexp_replace(lower(trim(cell)), '[.,;]+$', ''), '\s+', '_', 'g') AS v FROM x), l AS (SELECT {_STANCE!r} AS levels),
z AS (SELECT id, cell, v, levels, list_filter(levels, lambda k: starts_with(k, v)) AS fits FROM y, l)
SELECT id, CASE WHEN list_contains(levels, v) THEN v WHEN regexp_matches(v, '^[0-9]{{1,4}}$') AND CAST(v AS INT) BETWEEN 1 AND 4 THEN levels[CAST(v AS INT)] WHEN length(v) > 0 AND len(fits) = 1 THEN fits[1] END AS label, coalesce(lower(trim(cell)) IN {in_list(TRUTHY)}, false) AS ticked FROM z""".replace("CAST(v AS INT)", "TRY_CAST(v AS INT)"))
def typed_cells(spark, d):
    c = comments(spark, d).select("id", _cell().alias("cell"))
    return c.select("id", L.read_label(F.col("cell"), _STANCE).alias("label"), L.read_flag(F.col("cell")).alias("ticked"))


@query(f"WITH x AS (SELECT doc_id AS id, {_CELL_SQL} AS cell, lang FROM documents) SELECT count(*) AS n, count(*) FILTER (cell IS NULL) AS cell_missing, count(*) FILTER (cell = '') AS cell_empty, count(*) FILTER (lang IS NULL) AS lang_missing FROM x")
def missing_cells(spark, d):
    c = comments(spark, d).select(_cell().alias("cell"), "lang")
    x = corpus.missing_cells(c, ["cell", "lang"])
    return x.select("n", "cell_missing", "cell_empty", "lang_missing")


@query("SELECT format('{:,}', n_chars) AS shown, regexp_replace(label, '^other([0-9])$', 'Other \\1') AS label, id FROM (SELECT doc_id AS id, length(text) AS n_chars, CASE WHEN doc_id % 3 = 0 THEN 'other' || (doc_id % 12) ELSE 'topic' || (doc_id % 12) END AS label FROM documents)")
def display_values(spark, d):
    label = F.concat(F.when(F.col("id") % 3 == 0, "other").otherwise("topic"), (F.col("id") % 12).cast("string"))
    return comments(spark, d).select("id", F.format_number(F.length("body"), 0).alias("shown"), F.regexp_replace(label, "^other([0-9])$", "Other $1").alias("label"))


@query("SELECT event_id AS id, CAST(regexp_extract(m, 'Limit ([0-9]+)', 1) AS BIGINT) AS limit_tokens, CAST(regexp_extract(m, 'Used ([0-9]+)', 1) AS BIGINT) AS used_tokens, CASE WHEN regexp_matches(m, 'per[- ]day') THEN 'day' WHEN regexp_matches(m, 'per[- ]minute') THEN 'minute' END AS window FROM (SELECT event_id, 'Rate limit reached on tokens ' || CASE event_id % 3 WHEN 0 THEN 'per day' WHEN 1 THEN 'per minute' ELSE 'today' END || ': Limit ' || (user_id * 100) || ', Used ' || event_id || '.' AS m FROM events)")
def quota_messages(spark, d):
    span = F.when(F.col("event_id") % 3 == 0, "per day").when(F.col("event_id") % 3 == 1, "per minute").otherwise("today")
    m = F.concat(F.lit("Rate limit reached on tokens "), span, F.lit(": Limit "), (F.col("user_id") * 100).cast("string"), F.lit(", Used "), F.col("event_id").cast("string"), F.lit("."))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), m.alias("m")).select("id", *annotate.quota(F.col("m")))


# --- small shapes


@query("SELECT conv_id || '-' || turn AS id, CASE WHEN turn % 4 = 3 THEN -1 ELSE turn END AS depth FROM conversations")
def depth_sentinel(spark, d):
    return replies(spark, d).select("id", corpus.or_sentinel(F.when(F.col("turn") % 4 != 3, F.col("turn"))).cast("long").alias("depth"))


@query("SELECT event_id AS id, value FROM events WHERE strftime(ts, '%Y-%m') <= (SELECT strftime(max(ts), '%Y-%m') FROM events) AND isfinite(ln(value / 10)) AND regexp_matches(event_type, '^(click|view)')")
def row_filters(spark, d):
    e = table(spark, d, "events")
    ym = F.date_format("ts", "yyyy-MM")
    last = e.agg(F.max(ym).alias("last"))
    x = F.ln(F.col("value") / 10)
    return e.crossJoin(F.broadcast(last)).where((ym <= F.col("last")) & corpus.is_finite(x) & F.col("event_type").rlike("^(click|view)")).select(F.col("event_id").alias("id"), "value")  # one row


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m') AS ym FROM orders WHERE strftime(o_orderdate, '%Y-%m') <= (SELECT strftime(max(o_orderdate) - INTERVAL 1 YEAR, '%Y-%m') FROM orders)")
def month_bound(spark, d):
    """Orders up to the month a year before the last one, by the month as text."""
    o = table(spark, d, "orders")
    last = o.agg(F.date_format(F.add_months(F.max("o_orderdate").cast("date"), -12), "yyyy-MM").alias("last"))
    ym = F.date_format("o_orderdate", "yyyy-MM")
    return o.crossJoin(F.broadcast(last)).where(ym <= F.col("last")).select(F.col("o_orderkey").alias("id"), ym.alias("ym"))  # one row


@query("SELECT doc_id AS id FROM documents WHERE length(text) >= 80")
def length_filter(spark, d):
    return comments(spark, d).where(F.length("body") >= 80).select("id")


@query("SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' END AS language, (lang = 'de')::INT AS is_de, (lang = 'fr')::INT AS is_fr, (lang = 'es')::INT AS is_es FROM documents")
def mapped_levels(spark, d):
    c = comments(spark, d)
    dummies = L.dummies(F.col("lang"), ["en", "de", "fr", "es"], "is")
    return c.select("id", L.mapped(F.col("lang"), {"en": "English", "de": "German", "fr": "French"}).alias("language"), *dummies)


@query("SELECT doc_id AS id, lang, NULL::BIGINT AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def union_filled(spark, d):
    return comments(spark, d).select("id", "lang").unionByName(table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("quality")), allowMissingColumns=True)


@query("SELECT o_orderstatus AS venue, min(o_totalprice) AS least, max(o_totalprice) AS most, round(max(o_totalprice) / min(o_totalprice), 6) AS ratio, min(o_orderpriority) AS first_priority FROM orders GROUP BY 1")
def value_range(spark, d):
    o = table(spark, d, "orders")
    return corpus.describe(o, "o_orderstatus", least=F.min("o_totalprice"), most=F.max("o_totalprice"), ratio=F.round(F.max("o_totalprice") / F.min("o_totalprice"), 6), first_priority=F.min("o_orderpriority")).withColumnRenamed("o_orderstatus", "venue")
