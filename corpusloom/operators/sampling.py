"""Survey sampling: strata, allocation, systematic and simple random selection, frame correction, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def hash_order(seed: str, *keys: str) -> Column:
    """A reproducible random order: the md5 of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys)))


def allocate(sizes: DataFrame, group: str, total: int, share: dict[str, float], least: int = 20) -> DataFrame:
    """Adds alloc_n, incl_prob and design_weight to strata (group, pop_n): shares of the total by group, square-root allocation within.

    Rounded half to even, at least `least`, at most the stratum.
    """
    part = F.coalesce(*(F.when(F.col(group) == k, F.lit(v)) for k, v in share.items()), F.lit(0.0))
    root = F.sqrt(F.col("pop_n").cast("double"))
    raw = F.bround(total * part * root / F.sum(root).over(Window.partitionBy(group)))
    n = F.least(F.greatest(raw, F.lit(least)), F.col("pop_n")).cast("long")
    return sizes.withColumn("alloc_n", n).withColumns({"incl_prob": F.col("alloc_n") / F.col("pop_n"), "design_weight": F.col("pop_n") / F.col("alloc_n")})


def ranked(df: DataFrame, by: str, *order: str, name: str = "rank__") -> DataFrame:
    """df with each row's place, from 1, within its group in the given order.

    Numbered in two levels, so that no task sees a whole group: ranges of
    (group, order) are sorted apart, and the rows of a range go on from where
    their group stood before it.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(ranges, by, *order).sortWithinPartitions(by, *order)
    placed = materialize(sorted_.withColumn("at__", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at__", 33)  # the partition's number stands above the row's
    runs = placed.groupBy(F.col(by).alias("by__"), part.alias("part__")).agg(F.min("at__").alias("first__"), F.count(F.lit(1)).alias("n__"))
    before = F.sum("n__").over(Window.partitionBy("by__").orderBy("part__").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("before__", F.coalesce(before, F.lit(0)))
    joined = placed.join(runs, placed[by].eqNullSafe(runs["by__"]) & (part == runs["part__"]))
    return joined.withColumn(name, F.col("at__") - F.col("first__") + F.col("before__") + 1).select(*df.columns, name)


def systematic(df: DataFrame, design: DataFrame, stratum: str, *order: str, offset: Column | None = None) -> DataFrame:
    """The rows that a one-in-k walk with fractional k = pop_n / alloc_n takes of each stratum, in the given order.

    design: stratum, pop_n, alloc_n; one row a stratum. Without an offset the
    walk starts at the first row.
    """
    joined = ranked(df, stratum, *order).join(F.broadcast(design), stratum)  # a row a stratum
    k = F.col("pop_n") / F.col("alloc_n")
    j = (F.col("rank__") - 1).cast("double") - (offset if offset is not None else F.lit(0.0))
    return joined.where((j >= 0) & (F.pmod(j, k) < 1) & (F.floor(j / k) < F.col("alloc_n"))).drop("rank__")


def random_offset(seed: str, stratum: str) -> Column:
    """A start in [0, k) for each stratum, by a hash of seed and stratum."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(stratum).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return u * F.col("pop_n") / F.col("alloc_n")


def simple_random(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """Exactly n rows, or all there are, by hash order."""
    return df.orderBy(hash_order(seed, key), key).limit(n)


def capped_by_group(df: DataFrame, group: str, cap: int, seed: str, key: str) -> DataFrame:
    """At most `cap` rows of each group, by hash order: a sampling operator."""
    w = Window.partitionBy(group).orderBy(hash_order(seed, key), key)
    return df.withColumn("rank__", F.row_number().over(w)).where(F.col("rank__") <= cap).drop("rank__")


def cluster_sample(df: DataFrame, cluster: str, clusters: int, rows: int, seed: str, key: str) -> DataFrame:
    """A random sample of clusters, then of their rows."""
    chosen = simple_random(df.select(cluster).distinct(), clusters, seed, cluster)
    return simple_random(df.join(chosen, cluster, "left_semi"), rows, seed + "-rows", key)


def flagged_first(df: DataFrame, flag: Column, budget: int, seed: str, key: str) -> DataFrame:
    """A budget of rows: the flagged ones first, all if they fit, filled up with others, each by hash order."""
    return df.orderBy(F.when(flag, 0).otherwise(1), hash_order(seed, key), key).limit(budget)


def correct_frame(sample: DataFrame, frame: DataFrame, key: str, stratum: str) -> DataFrame:
    """The sample with eligible flags and with sizes, probabilities and weights of the frame as it is now; old values kept."""
    sizes = frame.groupBy(stratum).agg(F.count(F.lit(1)).alias("new_n"))
    alive = frame.select(key).distinct().withColumn("alive__", F.lit(True))
    out = sample.join(alive, key, "left").join(F.broadcast(sizes), stratum, "left")  # a row a stratum
    out = out.withColumns({"eligible": F.coalesce("alive__", F.lit(False)), "pop_n_old": F.col("pop_n"), "incl_prob_old": F.col("incl_prob")})
    out = out.withColumn("pop_n", F.coalesce("new_n", F.lit(0)))
    drawn = F.count_if("eligible").over(Window.partitionBy(stratum))
    out = out.withColumn("incl_prob", F.when(F.col("eligible"), F.try_divide(drawn, F.col("pop_n"))))
    return out.withColumn("design_weight", F.try_divide(F.lit(1.0), F.col("incl_prob"))).drop("alive__", "new_n")


def balance(population: DataFrame, sample: DataFrame, weight: str, variables: list[str]) -> DataFrame:
    """(variable, population, weighted_sample, abs_diff, std_diff): means of the frame and weighted means of the sample."""
    p = population.agg(*(F.avg(v).alias(f"m_{v}") for v in variables), *(F.stddev_samp(v).alias(f"s_{v}") for v in variables))
    s = sample.agg(*(F.try_divide(F.sum(F.col(weight) * F.col(v)), F.sum(weight)).alias(f"w_{v}") for v in variables))
    rows = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(f"m_{v}").cast("double").alias("population"), F.col(f"w_{v}").cast("double").alias("weighted_sample"), F.when(F.col(f"s_{v}") > 0, F.col(f"s_{v}")).otherwise(1.0).alias("sd")) for v in variables))
    out = p.crossJoin(s).select(F.inline(rows))  # one row each
    diff = F.col("weighted_sample") - F.col("population")
    return out.select("variable", "population", "weighted_sample", F.abs(diff).alias("abs_diff"), (diff / F.col("sd")).alias("std_diff"))


def randomisation_reference(df: DataFrame, design: DataFrame, stratum: str, order: list[str], value: str, draws: int, seed: str) -> DataFrame:
    """(draw, mean): weighted means under random starts. Each draw's rows are found by arithmetic on the ranks.

    A row's rank meets only the draws that take it: with interval k one draw
    in about k, so draws x sample rows arise, not draws x population.
    """
    rows = ranked(df.select(stratum, *order, value), stratum, *order)
    starts = df.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(design.select(stratum, "pop_n", "alloc_n"))  # draws x strata
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("draw").cast("string"), F.col(stratum).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    k = F.col("pop_n") / F.col("alloc_n")
    taken = starts.withColumn("off", u * k).select("draw", stratum, k.alias("k"), F.explode(F.transform(F.sequence(F.lit(0), F.col("alloc_n") - 1), lambda i: F.least(F.ceil(F.col("off") + i * k), F.col("pop_n") - 1) + 1)).alias("rank__"))
    return taken.join(rows, [stratum, "rank__"]).groupBy("draw").agg((F.sum(F.col("k") * F.col(value)) / F.sum("k")).alias("mean"))


def percentile_of(draws: DataFrame, value: str, realised: DataFrame, point: str) -> DataFrame:
    """(point, percentile): where one realised value stands among draws; the share of draws at or below it."""
    both = draws.crossJoin(F.broadcast(realised.select(point)))  # one row
    return both.groupBy(point).agg(F.avg((F.col(value) <= F.col(point)).cast("double")).alias("percentile"))


def two_stage_probability(first: Column, second: Column, annotated: Column) -> Column:
    """First-stage probability times the second stage's: units drawn for it (or, in the older variant, those still eligible) over units annotated."""
    return first * second / annotated


def composition(population: DataFrame, sample: DataFrame, by: str, weight: str) -> DataFrame:
    """(by, population_share, sample_share, weighted_share) of each group."""
    p = population.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    s = sample.groupBy(by).agg(F.count(F.lit(1)).alias("m"), F.sum(weight).alias("w"))
    part = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.sum(c).over(Window.partitionBy())
    return p.join(s, by, "left").select(by, part("n").alias("population_share"), part("m").alias("sample_share"), part("w").alias("weighted_share"))


def weight_change(sample: DataFrame, old: str, new: str) -> DataFrame:
    """(mean_change_pct): the mean absolute change of weights over the mean old weight, in per cent."""
    known = sample.where(F.col(old).isNotNull() & F.col(new).isNotNull())
    return known.agg((100 * F.avg(F.abs(F.col(new) - F.col(old))) / F.avg(old)).alias("mean_change_pct"))
