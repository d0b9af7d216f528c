"""Agreement and validation: Krippendorff's alpha, kappa, precision and recall, scoreboards, ensembles, votes, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import agree_or, decile, mean_of


def long_pairs(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(variable, a, b): two raters' values of several variables, one below the other, both sides present."""
    rows = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for v, (a, b) in pairs.items()))
    return df.select(F.inline(rows)).where("a is not null and b is not null")


def krippendorff(long: DataFrame, by: str = "variable") -> DataFrame:
    """(by, n, alpha, pct_agree): nominal alpha of two raters; null below two categories."""
    cells = long.groupBy(by, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    values = cells.select(by, F.explode(F.array("a", "b")).alias("v"), "n").groupBy(by, "v").agg(F.sum("n").alias("m"))
    spread = values.groupBy(by).agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("squares"), F.count(F.lit(1)).alias("k"))
    both = cells.groupBy(by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same")).join(spread, by)
    two = 2.0 * F.col("n")
    expected = (1 - F.col("squares") / (two * two)) * two / (two - 1)
    observed = 1 - F.col("same") / F.col("n")
    return both.select(by, "n", F.when(F.col("k") > 1, 1 - F.try_divide(observed, expected)).alias("alpha"), (F.col("same") / F.col("n")).alias("pct_agree"))


def reliability(long: DataFrame, positive: dict[str, str], least: float = 0.667, by: str = "variable") -> DataFrame:
    """(by, n, alpha, pct_agree, prevalence, low): alpha with the share of the positive value over both raters, marked where below the least."""
    value = F.coalesce(*(F.when(F.col(by) == k, F.lit(v)) for k, v in positive.items()))
    share = F.avg(((F.col("a") == value).cast("int") + (F.col("b") == value).cast("int")) / 2)
    return krippendorff(long, by).join(long.groupBy(by).agg(share.alias("prevalence")), by).withColumn("low", F.col("alpha") < least)


def provisional(df: DataFrame, adjudicated: str, first: str) -> DataFrame:
    """Adds label__ and standard__: the adjudicated label, else one coder's, marked "provisional"."""
    return df.withColumns({"label__": F.coalesce(adjudicated, first), "standard__": F.when(F.col(adjudicated).isNotNull(), "adjudicated").when(F.col(first).isNotNull(), "provisional")})


def disagreements(df: DataFrame, a: str, b: str) -> DataFrame:
    """The rows that both raters labelled, and differently."""
    return df.where(F.col(a) != F.col(b))


def pass_scores(long: DataFrame, passes: list[str], splits: list[str]) -> DataFrame:
    """(pass, split, n, macro_f1, accuracy, kappa) of rows (pass, split, truth, pred); "all" is every split, and an empty pass has n = 0 and no scores."""
    everything = long.withColumn("split", F.explode(F.array("split", F.lit("all"))))
    wanted = long.sparkSession.createDataFrame([(p, s) for p in passes for s in splits], "pass string, split string")
    found = scoreboard(everything, ["pass", "split"])
    return wanted.join(found, ["pass", "split"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def variant_table(long: DataFrame, variables: list[str]) -> DataFrame:
    """(variant, variables..., mean_f1): macro-F1 of each variable, and their mean, of rows (variant, variable, truth, pred)."""
    by = ["variant", "variable"]
    scores = macro_f1(per_class(confusion(long, by), by), by)
    wide = scores.groupBy("variant").pivot("variable", variables).agg(F.first("macro_f1"))
    return wide.withColumn("mean_f1", mean_of([F.col(v) for v in variables]))


def held_out(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(n, accuracy, kappa, macro_f1) of one instrument on the rows at hand."""
    cells = confusion(df.select(F.col(truth).alias("truth"), F.col(pred).alias("pred")), [])
    return cohen_kappa(cells, []).crossJoin(macro_f1(per_class(cells, []), []))  # one row each


def confusion(long: DataFrame, by: list[str]) -> DataFrame:
    """(by..., truth, pred, n) of rows where both are known."""
    return long.where("truth is not null and pred is not null").groupBy(*by, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def per_class(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by..., class, n, n_pred, precision, recall, f1): classes of truth or prediction; an undefined f1 is 0."""
    sides = cells.select(*by, F.inline(F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("hit")),
    )))
    g = sides.groupBy(*by, "class").agg(F.sum("t").alias("n"), F.sum("p").alias("n_pred"), F.sum("hit").alias("hit"))
    g = g.withColumns({"precision": F.try_divide(F.col("hit").cast("double"), "n_pred"), "recall": F.try_divide(F.col("hit").cast("double"), "n")})
    return g.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("n") + F.col("n_pred")), F.lit(0.0))).drop("hit")


def macro_f1(classes: DataFrame, by: list[str], labels: str = "truth", codebook: int | None = None) -> DataFrame:
    """(by..., macro_f1): the mean over classes in the truth, in truth or prediction ("union"), or over all of the codebook's many."""
    if labels == "codebook":
        return classes.groupBy(*by).agg((F.sum("f1") / F.lit(codebook)).alias("macro_f1"))
    return (classes.where("n > 0") if labels == "truth" else classes).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def cohen_kappa(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, accuracy, kappa)."""
    total = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    chance = per_class(cells, by).groupBy(*by).agg(F.sum(F.col("n").cast("double") * F.col("n_pred")).alias("cross"))
    both = total.join(chance, by) if by else total.crossJoin(chance)  # one row each
    po, pe = F.col("hit") / F.col("n"), F.col("cross") / (F.col("n").cast("double") * F.col("n"))
    return both.select(*by, "n", po.alias("accuracy"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def scoreboard(long: DataFrame, by: list[str], labels: str = "truth") -> DataFrame:
    """(by..., n, macro_f1, accuracy, kappa) from long rows (by..., truth, pred): one grouped job for all instruments."""
    cells = confusion(long, by)
    return cohen_kappa(cells, by).join(macro_f1(per_class(cells, by), by, labels), by)


def adjudicate(df: DataFrame, variable: str, a: str, b: str, conservative: str) -> DataFrame:
    """Adds the agreed or conservative label and whether it was disputed; a null code leaves both null."""
    return df.withColumns({variable: agree_or(F.col(a), F.col(b), F.lit(conservative)), f"{variable}_disputed": F.col(a) != F.col(b)})


def adjudicate_flag(df: DataFrame, variable: str, a: str, b: str) -> DataFrame:
    """Adds whether both raters ticked the flag, and whether they differ; a null tick leaves both null."""
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a) & F.col(b))
    return df.withColumns({variable: both, f"{variable}_disputed": F.col(a) != F.col(b)})


def ensemble(a: Column, b: Column, fill: Column | None = None) -> Column:
    """The label both gave, else what a third source says, else null."""
    both = F.when(a == b, a)
    return both if fill is None else F.coalesce(both, fill)


def majority_vote(votes: DataFrame, key: str, label: str) -> DataFrame:
    """(key, winner, votes_for, n_draws, tie): the most frequent label of each key; null on a tie."""
    n = votes.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    n = n.withColumns({"most": F.max("n").over(w), "draws": F.sum("n").over(w)})
    g = n.groupBy(key).agg(F.count_if(F.col("n") == F.col("most")).alias("winners"), F.max(F.when(F.col("n") == F.col("most"), F.col(label))).alias("w"), F.max("most").alias("votes_for"), F.max("draws").alias("n_draws"))
    return g.select(key, F.when(F.col("winners") == 1, F.col("w")).alias("winner"), "votes_for", "n_draws", (F.col("winners") > 1).alias("tie"))


def calibration(df: DataFrame, p: str, y: str) -> DataFrame:
    """(bin, n, mean_pred, observed, ece_contrib): reliability by decile; the contributions sum to the calibration error."""
    g = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(decile(F.col(p)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("observed"))
    return g.withColumn("ece_contrib", F.col("n") / F.sum("n").over(Window.partitionBy()) * F.abs(F.col("mean_pred") - F.col("observed")))


def batch_completeness(batches: DataFrame, ids: str, results: str) -> DataFrame:
    """(returned, n_batches, share, incomplete): how many results batches brought."""
    g = batches.groupBy(F.size(results).cast("long").alias("returned"), (F.size(results) < F.size(ids)).alias("incomplete")).agg(F.count(F.lit(1)).alias("n_batches"))
    return g.withColumn("share", F.col("n_batches") / F.sum("n_batches").over(Window.partitionBy()))


def positional_yield(batches: DataFrame, ids: str, results: str) -> DataFrame:
    """(position, asked, answered, yield): how often the item at each position of a batch came back."""
    rows = batches.select(F.posexplode(ids).alias("position", "id"), F.size(results).alias("n"))
    g = rows.groupBy(F.col("position").cast("long").alias("position")).agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("position") < F.col("n")).alias("answered"))
    return g.withColumn("yield", F.col("answered") / F.col("asked"))
