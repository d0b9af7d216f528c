"""Corpus operators: the audited funnel, features, parents, reply depth, descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from .sampling import ranked


def with_default(df: DataFrame, name: str, value: object, kind: str) -> DataFrame:
    """df with the column, added with a default where it is absent."""
    return df if name in df.columns else df.withColumn(name, F.lit(value).cast(kind))


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank__", F.row_number().over(w)).where("rank__ = 1").drop("rank__")


def funnel(df: DataFrame, steps: list[tuple[str, Column]], first: str = "raw") -> DataFrame:
    """(step_no, step, n, dropped, pct): rows that pass each step and all before it, counted in one pass.

    A step whose condition is null drops the row, as a filter does.
    """
    passed, sums = F.lit(True), [F.count(F.lit(1)).alias("c0")]
    for i, (_, condition) in enumerate(steps, 1):
        passed = passed & F.coalesce(condition, F.lit(False))
        sums.append(F.count_if(passed).alias(f"c{i}"))
    one = df.agg(*sums)
    rows = [F.struct(F.lit(i).cast("long").alias("step_no"), F.lit(name).alias("step"), F.col(f"c{i}").alias("n"), (F.col(f"c{i - 1}") - F.col(f"c{i}") if i else F.lit(0).cast("long")).alias("dropped"), F.col("c0")) for i, name in enumerate([first, *(n for n, _ in steps)])]
    out = one.select(F.inline(F.array(*rows)))
    return out.select("step_no", "step", "n", "dropped", F.round(100 * F.try_divide("n", "c0"), 4).alias("pct"))


def passing(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """The rows that pass all steps, in the given order of tests, cheap ones first."""
    return reduce(lambda d, s: d.where(s[1]), steps, df)


def comment_steps(df: DataFrame, start: str, end: str) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """The funnel of comments: df with its texts cleaned and cut once, and the steps: window, tombstones, bots, stickied, moderation, four words, language."""
    body, author = F.col("body"), F.col("author")
    clean = df.withColumn("clean__", T.normalise(body))
    cut = clean.withColumns({"words__": T.word_count(F.col("clean__")), "toks__": T.tokens(F.col("clean__"))})
    return cut, [
        ("window", (F.col("created_ts") >= F.lit(start).cast("timestamp")) & (F.col("created_ts") < F.lit(end).cast("timestamp"))),
        ("tombstones", body.isNotNull() & ~body.isin(T.TOMBSTONES)),
        ("bots", ~T.is_bot(author)),
        ("stickied", ~F.coalesce(F.col("stickied"), F.lit(False))),
        ("moderation", ~T.is_moderation(author, F.col("distinguished"))),
        ("four_words", F.col("words__") >= 4),
        ("language", T.is_english(F.col("clean__"), F.col("words__"), F.col("toks__"))),
    ]


def missing_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n, and for each column how many cells are null (c_missing) and empty (c_empty)."""
    counts = [x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}_missing"), F.count_if(F.col(c) == "").alias(f"{c}_empty"))]
    return df.agg(F.count(F.lit(1)).alias("n"), *counts)


def or_sentinel(c: Column, sentinel: int = -1) -> Column:
    """The number, or the sentinel where it is null."""
    return F.coalesce(c, F.lit(sentinel))


def is_finite(c: Column) -> Column:
    """Whether a number is neither null nor infinite nor undefined."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def text_features(df: DataFrame, text: str) -> DataFrame:
    """Adds counts of words, questions, exclamations and second persons, and the share of capitals."""
    c = F.col(text)
    return df.withColumns(
        {"n_words": T.word_count(c), "n_question": T.char_count(c, "?"), "n_exclaim": T.char_count(c, "!"), "n_2ndperson": T.tokens_in(T.tokens(c), T.SECOND_PERSON), "caps_ratio": T.caps_ratio(c)}
    )


def with_parents(df: DataFrame, key: str, parent: str, values: dict[str, str]) -> DataFrame:
    """Adds values of each row's parent under new names; one row for a parent key even if it repeats."""
    up = latest_by(df.where(F.col(key).isNotNull()), [key], *(F.col(c) for c in values)).select(F.col(key).alias(parent), *(F.col(c).alias(n) for c, n in values.items()))
    return df.join(up, parent, "left")


def reply_depth(df: DataFrame, key: str = "id", parent: str = "parent_id", root_prefix: str = "t3_", prefix_length: int = 3, deepest: int = 500) -> DataFrame:
    """(key, depth): 0 where the parent is a submission, the parent's plus one below; null for broken, cyclic or too long chains.

    Pointers double each round, so a chain of 500 takes nine, each written to
    the shared folder; an id's last row
    by its parent stands for repeated ids. Only ids travel.
    """
    own = latest_by(df.where(F.col(key).isNotNull()).select(key, parent), [key], F.desc(parent))
    top = F.coalesce(F.col(parent).startswith(root_prefix), F.lit(False))
    step = own.select(
        F.col(key).alias("node"),
        F.when(~top & (F.length(parent) > prefix_length), F.substring(F.col(parent), prefix_length + 1, 1000)).alias("up"),
        F.when(top, F.lit(0)).alias("depth"),
        F.lit(1).alias("hops"),
    )
    for _ in range(max(1, deepest.bit_length())):
        above = step.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("hops").alias("h2"))
        step = step.join(above, "up", "left").select(
            "node",
            F.when(F.col("depth").isNull() & F.col("d2").isNull(), F.col("up2")).alias("up"),
            F.coalesce("depth", F.col("d2") + F.col("hops")).alias("depth"),
            F.when(F.col("h2").isNotNull(), F.col("hops") + F.col("h2")).otherwise(F.col("hops")).alias("hops"),
        )
        step = materialize(step, "depth")
        if step.where("depth is null and up is not null").isEmpty():
            break
    return step.select(F.col("node").alias(key), F.when(F.col("depth") <= deepest, F.col("depth")).cast("long").alias("depth"))


def describe(df: DataFrame, by: str, **aggregates: Column) -> DataFrame:
    return df.groupBy(by).agg(*(c.alias(n) for n, c in aggregates.items()))


def share_within(df: DataFrame, by: list[str], parent: list[str], name: str = "share") -> DataFrame:
    """Counts by group, with their share of the parent group."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*parent)))


def ends(df: DataFrame, order: str, tie: str, k: int) -> DataFrame:
    """The k largest and the k smallest rows by a value, marked by side."""
    top = df.orderBy(F.desc(order), tie).limit(k).withColumn("side", F.lit("top"))
    return top.unionByName(df.orderBy(F.asc(order), tie).limit(k).withColumn("side", F.lit("bottom")))


def batches(df: DataFrame, key: str, size: int, model: str, version: str, run: str) -> DataFrame:
    """(batch, cache_key, ids): rows in order of the key in batches of a size, each under the md5 of its settings and ids.

    The global order is numbered in two levels, by ranges of the key and
    within them, so no task sees all rows.
    """
    numbered = ranked(df.select(F.lit(1).alias("all__"), key), "all__", key, name="i__")
    batch = F.ceil(F.col("i__") / size).cast("long")
    grouped = numbered.groupBy(batch.alias("batch")).agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")).alias("ids"))
    return grouped.select("batch", F.md5(F.concat_ws("|", F.lit(model), F.lit(version), F.lit(run), F.array_join("ids", ","))).alias("cache_key"), "ids")
