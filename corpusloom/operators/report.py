"""Reports: funnel percentages, key-value tables, label families, formatted listings."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_values(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(quantity, value): one row an aggregate, from one pass."""
    one = df.agg(*(c.cast("double").alias(f"v{i}") for i, c in enumerate(values.values())))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("quantity"), F.col(f"v{i}").alias("value")) for i, k in enumerate(values)))))


def family(name: Column) -> Column:
    """The family of an instrument by its name."""
    return F.when(name.rlike("(?i)ensemble"), "ensemble").when(name.rlike("(?i)^llm"), "model").when(name.rlike("(?i)distill"), "distilled").when(name.rlike("(?i)dictionary|wordlist|lexical"), "lexical").otherwise("other")


def pivot_share(df: DataFrame, row: str, column: str, levels: list[str]) -> DataFrame:
    """(row, level...): the share of each level among a row's known levels, 0 where absent."""
    n = df.where(F.col(column).isNotNull()).groupBy(row).agg(*(F.avg((F.col(column) == v).cast("double")).alias(v) for v in levels))
    return n


def listing(df: DataFrame, title: str, rows: int = 40) -> str:
    """A small result as text under a title."""
    kept = df.limit(rows).toPandas()
    return f"== {title}\n{kept.to_string(index=False)}\n"


def outcome_table(df: DataFrame, by: list[str], outcome: str, levels: list[str]) -> DataFrame:
    """(by..., n, level...): how many rows, and the share of each outcome among them."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg((F.col(outcome) == v).cast("double")).alias(v) for v in levels))


def alignment(df: DataFrame, row: str, column: str, levels: list[str]) -> DataFrame:
    """(row, level...): how many units of each row's class are in each column's class."""
    return df.where(F.col(column).isNotNull()).groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(v) for v in levels))


def headline_checks(df: DataFrame, values: dict[str, Column], stated: DataFrame, tolerance: float) -> DataFrame:
    """(headline, derived, stated, holds): figures derived in one pass, against a table (quantity, value) of stated ones, within a share of these.

    A figure that nothing states, or that the rows do not give, has a null and holds not.
    """
    told = stated.select(F.col("quantity").alias("headline"), F.col("value").alias("stated"))
    x = key_values(df, values).select(F.col("quantity").alias("headline"), F.col("value").alias("derived")).join(told, "headline", "left")
    return x.withColumn("holds", F.coalesce(F.abs(F.col("derived") - F.col("stated")) <= tolerance * F.abs("stated"), F.lit(False)))


def top_rows(df: DataFrame, group: str, value: str, tie: str, k: int) -> DataFrame:
    """The k rows of each group with the largest values, with their rank."""
    w = Window.partitionBy(group).orderBy(F.desc(value), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def figure_inputs(tables: dict[str, DataFrame]) -> DataFrame:
    """(figure, series, x, y): the tables that figures are drawn from, one below the other."""
    parts = [t.select(F.lit(name).alias("figure"), "series", "x", "y") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def throughput(df: DataFrame, rows: int, corpus: int) -> dict[str, float]:
    """Rows per second of `rows` rows (the table has at least as many) worked off whole, and the hours that a corpus of that many rows would take at that rate."""
    began = time.monotonic()
    df.limit(rows).write.format("noop").mode("overwrite").save()
    done = rows
    seconds = max(1e-9, time.monotonic() - began)
    return {"rows": float(done), "rows_per_second": done / seconds, "projected_hours": corpus * seconds / max(1, done) / 3600}
