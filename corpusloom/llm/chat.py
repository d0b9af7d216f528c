"""Chat formatting: conversations as budgeted, turn-aligned training windows, in DataFrame operations alone.

Every turn becomes `<turn ROLE>TEXT</turn>` and a line end. Inside texts and
roles the backslash, "<" and ">" are written as escapes, so no control string
can occur in them, and reading undoes it exactly.

Running sums of the turns' tokens within a conversation choose the spans: a
turn belongs to the window in whose share of the running sum it ends. With
shares of half of what the system turn and the history leave of the budget,
a window whose turns are each no longer than a share fits the budget; a longer
turn stays whole, and its window is marked over_budget. Each later window
repeats the leading system turn and up to two turns before its span, and its
loss spans cover the assistant texts of its own span alone, so that each
assistant text is a target once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load

BUDGET = 512
HISTORY = BUDGET // 4
#: What the marks of a turn count for, and what counts as a token: a run of letters, a digit, or another sign that isn't blank.
MARK_TOKENS = 4
TOKEN = r"[A-Za-zÀ-ɏ]+|[0-9]|[^A-Za-zÀ-ɏ0-9 \t\r\n]"
END = "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    """Doubled backslashes part the text, from the left; within the parts each backslash begins an escape."""
    parts = F.split(c, r"\\\\", -1)
    plain = F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.array_join(plain, "\\")


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, target: str = "assistant") -> DataFrame:
    """(conv_id, window_no, formatted, n_context, n_turns, tokens, over_budget, loss_spans): one row a window.

    turns: conv_id, turn, role, text. Null roles and texts are empty, null
    turns come first, ties go by role and text, a null conv_id is a
    conversation of its own, repeated rows are turns of their own. An empty
    table gives an empty result; extra columns are ignored. loss_spans are
    (start, length) in code points of `formatted`.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)).cast("long") + MARK_TOKENS)
    t = t.withColumn("head", F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">"))).withColumn("body", escape(F.col("text")))
    t = t.select("conv_id", "turn", "role", "text", "tokens", F.concat("head", "body", F.lit(END)).alias("piece"), F.length("head").alias("at"), F.length("body").alias("long"))
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("i", F.row_number().over(conv))
    t = t.withColumn("is_system", (F.col("i") == 1) & (F.col("role") == "system"))
    order = Window.partitionBy("conv_id").orderBy("i")
    system_tokens = F.first(F.when(F.col("is_system"), F.col("tokens")).otherwise(F.lit(0))).over(order)
    before = F.struct("piece", "tokens")
    earlier = [F.lag(F.when(~F.col("is_system"), before), k).over(order) for k in (1, 2)]
    t = t.withColumns({"system_tokens": system_tokens, "sum": F.sum(F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))).over(order), "one": earlier[0], "two": earlier[1]})
    share = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("system_tokens")) / 2))
    t = t.withColumn("share", F.floor((F.greatest(F.col("sum"), F.lit(1)) - 1) / share))
    t = t.withColumn("new", F.coalesce((F.col("share") != F.lag("share").over(order)).cast("int"), F.lit(1)))
    # a system turn opens the window of the turn that follows it
    t = t.withColumn("window_no", F.greatest(F.lit(1), F.sum(F.when((F.col("i") == 2) & F.lag("is_system").over(order), 0).otherwise(F.col("new"))).over(order)))
    own = Window.partitionBy("conv_id", "window_no").orderBy("i")
    t = t.withColumn("start", F.sum(F.length("piece")).over(own) - F.length("piece") + F.col("at"))
    grouped = t.groupBy("conv_id", "window_no").agg(
        F.array_sort(F.collect_list(F.struct("i", "role", "piece", F.col("start").cast("long").alias("start"), F.col("long").cast("long").alias("length")))).alias("span"),
        F.min_by(F.struct("one", "two"), "i").alias("past"),
        F.min_by(F.when(F.col("is_system"), before), "i").alias("system"),
        F.sum("tokens").alias("own_tokens"),
    )
    of = Window.partitionBy("conv_id").orderBy("window_no")
    late = F.col("window_no") > 1
    one, two = F.col("past.one"), F.col("past.two")
    none = F.lit(None).cast("struct<piece:string,tokens:bigint>")
    system = F.when(late, F.first("system").over(of)).otherwise(none)
    one = F.when(late & (one.tokens <= history), one).otherwise(none)
    two = F.when(one.isNotNull() & (one.tokens + two.tokens <= history), two).otherwise(none)
    context = F.filter(F.array(system, two, one), lambda x: x.isNotNull())
    out = grouped.withColumn("context", context)
    out = out.withColumn("opening", F.array_join(F.transform("context", lambda x: x.piece), ""))
    opening = F.length("opening").cast("long")
    targets = F.filter("span", lambda x: x.role == target)
    tokens = F.col("own_tokens") + F.aggregate("context", F.lit(0).cast("long"), lambda a, x: a + x.tokens)
    return out.select(
        "conv_id",
        F.col("window_no").cast("long").alias("window_no"),
        F.concat("opening", F.array_join(F.transform("span", lambda x: x.piece), "")).alias("formatted"),
        F.size("context").cast("long").alias("n_context"),
        F.size("span").cast("long").alias("n_turns"),
        tokens.alias("tokens"),
        (tokens > budget).alias("over_budget"),
        F.transform(targets, lambda x: F.struct((x.start + opening).alias("start"), x.length.alias("length"))).alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, window_no, turns, targets): roles and texts of each window's own span and its target texts, as they were."""
    pieces = F.slice(F.split("formatted", END, -1), F.col("n_context").cast("int") + 1, F.col("n_turns").cast("int"))
    turn = lambda x: F.struct(unescape(F.substring_index(F.substring(x, 7, 2**31 - 1), ">", 1)).alias("role"), unescape(F.substring_index(x, ">", -1)).alias("text"))
    target = lambda s: unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")))
    return windows.select("conv_id", "window_no", "formatted", F.transform(pieces, turn).alias("turns"), F.transform("loss_spans", target).alias("targets"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.col("id").alias("turn"))
    more = more.select(F.lit(-7).cast("long").alias("conv_id"), "turn", F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = read_windows(format_windows(turns)).select(
        "conv_id",
        "window_no",
        F.size("turns").cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
        F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("loss"),
    )
    joined = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window_no", "said", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    loss = F.array_join(F.transform("w", lambda x: x.loss), "")
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("w", lambda x: x.said), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


_ESC = "replace(replace(replace({}, chr(92), chr(92) || chr(92)), '<', chr(92) || 'l'), '>', chr(92) || 'g')"
OP9_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
a AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    len(regexp_extract_all(text, '{TOKEN}')) + {MARK_TOKENS} AS tokens,
    length({_ESC.format("role")}) + length({_ESC.format("text")}) + 15 AS chars
  FROM turns),
b AS (SELECT *, i = 1 AND role = 'system' AS is_system FROM a),
c AS (
  SELECT *, first_value(CASE WHEN is_system THEN tokens ELSE 0 END) OVER w AS system_tokens,
    first_value(CASE WHEN is_system THEN chars ELSE 0 END) OVER w AS system_chars,
    sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER w AS total,
    lag(CASE WHEN NOT is_system THEN tokens END, 1) OVER w AS t1, lag(CASE WHEN NOT is_system THEN tokens END, 2) OVER w AS t2,
    lag(chars, 1) OVER w AS c1, lag(chars, 2) OVER w AS c2
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
d AS (SELECT *, floor((greatest(total, 1) - 1) / greatest(1, floor(({BUDGET - HISTORY} - system_tokens) / 2))) AS share FROM c),
e AS (
  SELECT *, CASE WHEN i = 2 AND lag(is_system) OVER w THEN 0 WHEN share IS DISTINCT FROM lag(share) OVER w THEN 1 ELSE 0 END AS new
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
f AS (SELECT *, greatest(1, sum(new) OVER (PARTITION BY conv_id ORDER BY i)) AS window_no FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, window_no ORDER BY i) = 1 AND window_no > 1 AS repeats FROM f)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN repeats THEN system_chars + CASE WHEN t1 <= {HISTORY} THEN c1 + CASE WHEN t1 + t2 <= {HISTORY} THEN c2 ELSE 0 END ELSE 0 END ELSE 0 END) AS BIGINT) AS formatted_chars,
  CAST(count(DISTINCT window_no) AS BIGINT) AS n_windows
FROM g GROUP BY conv_id"""
