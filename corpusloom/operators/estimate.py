"""Estimation: design-based correction of classifier prevalences, bootstrap, tests of association, bounds, adjusted p-values."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pseudo_outcome(f: Column, y: Column, coded: Column, probability: Column) -> Column:
    """The prediction, plus for coded units its error over the probability of being coded."""
    return F.when(coded & y.isNotNull(), f + (y - f) / probability).otherwise(f)


def corrected_prevalence(df: DataFrame, by: list[str], f: str, y: str, coded: str, probability: str) -> DataFrame:
    """(by..., n, naive, corrected, shift_pp)."""
    s = pseudo_outcome(F.col(f), F.col(y), F.col(coded), F.col(probability))
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(f).alias("naive"), F.avg(s).alias("corrected"))
    return g.withColumn("shift_pp", 100 * (F.col("corrected") - F.col("naive")))


def analytic_se(df: DataFrame, f: str, y: str, coded: str, probability: str, population: str) -> DataFrame:
    """(m, se): the standard error of the corrected mean from the m coded units' weighted errors, with the finite-population factor.

    population: a column with the size of the frame that the coded units were drawn from.
    """
    known = F.col(coded) & F.col(y).isNotNull()
    e = F.when(known, (F.col(y) - F.col(f)) / F.col(probability))
    g = df.agg(F.count(F.lit(1)).alias("total"), F.count(e).alias("m"), F.var_samp(e).alias("v"), F.max(population).alias("frame"))
    return g.select("m", (F.sqrt(F.col("m") * F.col("v")) / F.col("total") * F.sqrt(1 - F.col("m") / F.col("frame"))).alias("se"))


def variance_table(plain: DataFrame, stratified: DataFrame, analytic: DataFrame) -> DataFrame:
    """(low, high, boot_se, stratified_se, analytic_se, ratio): bootstrap against analytic standard error; one row each."""
    a = analytic.select(F.col("se").alias("analytic_se"))
    x = plain.withColumnRenamed("se", "boot_se").crossJoin(stratified).crossJoin(a)  # one row each
    return x.select("low", "high", "boot_se", "stratified_se", "analytic_se", F.try_divide("boot_se", "analytic_se").alias("ratio"))


#: The distribution of a Poisson variable of mean one: how many of these a uniform number has reached is such a variable.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(10)]


def bootstrap_weight(seed: str, draw: Column, key: Column) -> Column:
    """How often a draw takes a unit: a Poisson variable of mean one by the hash of seed, draw and key."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), draw.cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return reduce(lambda a, b: a + b, [(u >= t).cast("long") for t in POISSON])


def bootstrap(errors: DataFrame, error: str, key: str, total: int, draws: int = 400, seed: str = "boot", stratum: str | None = None) -> DataFrame:
    """(draw, correction): the corrections of the mean when the coded units are drawn again.

    Each unit has Poisson weights of its own, so units are never gathered
    and sums are merged before they are shuffled. The sum of a draw is scaled
    to the number of units, within each stratum if there is one. A draw that
    takes no unit of a stratum has nothing of it.
    """
    by = [] if stratum is None else [stratum]
    rows = errors.where(F.col(error).isNotNull()).select(error, key, *by, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    w = bootstrap_weight(seed, F.col("draw"), F.col(key))
    g = rows.withColumn("w__", w).groupBy("draw", *by).agg(F.sum("w__").alias("w"), F.sum(F.col("w__") * F.col(error)).alias("we"), F.count(F.lit(1)).alias("m"))
    part = F.coalesce(F.try_divide(F.col("m") * F.col("we"), F.col("w")), F.lit(0.0))
    return g.groupBy(F.col("draw").cast("long").alias("draw")).agg((F.sum(part) / F.lit(float(total))).alias("correction"))


def interval(draws: DataFrame, value: str, naive: Column, level: float = 0.95) -> DataFrame:
    """(low, high, se): the percentile interval and the standard error of naive + value over the draws."""
    edge = (1 - level) / 2
    return draws.agg((naive + F.percentile(value, edge)).alias("low"), (naive + F.percentile(value, 1 - edge)).alias("high"), F.stddev_samp(value).alias("se"))


def crosstab(df: DataFrame, a: str, b: str, weight: Column | None = None) -> DataFrame:
    """(a, b, n) with every combination of the levels of a and b, absent ones as 0."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    levels = n.select(a).distinct().crossJoin(n.select(b).distinct())  # levels, a few
    return levels.join(n, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def chi_square(cells: DataFrame, a: str, b: str) -> DataFrame:
    """(n, chi2, df, cramers_v, cochran_ok) of a crosstab with its zero cells."""
    r, c, t = (F.sum("n").over(Window.partitionBy(*k)) for k in ([a], [b], []))
    e = cells.withColumns({"r": r, "c": c, "t": t}).withColumn("e", F.col("r") * F.col("c") / F.col("t"))
    g = e.agg(F.max("t").alias("n"), F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e")).alias("chi2"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"), F.avg((F.col("e") < 5).cast("double")).alias("few"), F.min("e").alias("least"))
    k = F.least(F.col("ka"), F.col("kb")) - 1
    return g.select("n", "chi2", ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df"), F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * k)).alias("cramers_v"), ((F.col("few") <= 0.2) & (F.col("least") >= 1)).alias("cochran_ok"))


def chi_square_p(chi2: float, df: int) -> float:
    """The upper tail of the chi-square distribution, by the regularised incomplete gamma function."""
    a, x = df / 2, chi2 / 2
    if x <= 0 or df <= 0:
        return 1.0
    if x < a + 1:  # series
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, d = x + 1 - a, 1 / (x + 1 - a)  # continued fraction
    c, h = 1e300, d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def normalised_mutual_information(cells: DataFrame, a: str, b: str) -> DataFrame:
    """(n, nmi) of two partitions from their cells, over the root of the entropies' product."""
    p = cells.where("n > 0").withColumns({"r": F.sum("n").over(Window.partitionBy(a)), "c": F.sum("n").over(Window.partitionBy(b)), "t": F.sum("n").over(Window.partitionBy())})
    mi = F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("r") * F.col("c"))))
    # a cell's part of its margin's entropy
    hr, hc = (-F.sum(F.col("n") / F.col("t") * F.ln(F.col(m) / F.col("t"))) for m in ("r", "c"))
    return p.agg(F.max("t").alias("n"), F.try_divide(mi, F.sqrt(hr * hc)).alias("nmi"))


def normal_tail(z: Column) -> Column:
    """The two-sided tail of the standard normal distribution, to a relative error below 1e-10 however small it is (the least doubles apart).

    A power series near zero, a continued fraction beyond. A null stays null.
    """
    x = F.abs(z) / math.sqrt(2)
    down = F.sequence(F.lit(60), F.lit(1))
    series = F.aggregate(down, F.lit(1.0), lambda s, k: 1 + 2 * x * x / (2 * k + 1) * s)
    fraction = F.aggregate(down, F.lit(0.0), lambda s, k: k / 2 / (x + s))
    bell = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x < 2, 1 - 2 * x * bell * series).otherwise(bell / (x + fraction))


def removal_bound(observed: Column, removed: Column) -> Column:
    """The worst case when all that was removed counts."""
    return observed * (1 - removed) + removed


def bh_adjust(df: DataFrame, p: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """Adds p_adj, the step-up adjusted p-value within each family."""
    keys = by or []
    n, rank = F.count(p).over(Window.partitionBy(*keys)), F.row_number().over(Window.partitionBy(*keys).orderBy(p, tie))
    ranked = df.withColumn("raw__", F.col(p) * n / rank)
    down = Window.partitionBy(*keys).orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("p_adj", F.least(F.lit(1.0), F.min("raw__").over(down))).drop("raw__")


def wald_table(df: DataFrame, estimate: str, se: str) -> DataFrame:
    """Adds z, odds_ratio and its 95 % limits."""
    b, s = F.col(estimate), F.col(se)
    return df.withColumns({"z": F.try_divide(b, s), "odds_ratio": F.exp(b), "or_low": F.exp(b - 1.96 * s), "or_high": F.exp(b + 1.96 * s)})


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces columns by their z-scores over all rows; a constant column becomes 0. Moments come from one aggregate row."""
    m = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"s_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(m))  # one row
    scaled = {c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in columns}
    return out.withColumns(scaled).drop(*(f"{k}_{c}" for k in "ms" for c in columns))
