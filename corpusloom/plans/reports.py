"""Tables that figures are drawn from, and listings, out of the results of other queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cleaning, learned, scoring  # noqa: F401 - they register the queries that are read here
from .catalogue import QUERIES, SQL, query

#: figure: (query, series and value for each line of the figure, place on the axis). Expressions of both engines; values are aggregates by series and place.
_DESIGN = {
    "funnel": ("comment_funnel", {"'kept'": "max(n)", "'dropped'": "max(dropped)"}, "step"),
    "volume": ("venue_by_month", {"venue": "sum(n)"}, "ym"),
    "strata": ("allocation", {"'population'": "max(pop_n)", "'allocated'": "max(alloc_n)", "'weight'": "max(design_weight)"}, "stratum"),
    "balance": ("sampling_balance", {"'std_diff'": "max(std_diff)"}, "variable"),
    "months": ("month_balance", {"'population'": "max(population_share)", "'sample'": "max(weighted_share)"}, "ym"),
    "composition": ("sample_composition", {"'population'": "max(population_share)", "'sample'": "max(sample_share)", "'weighted'": "max(weighted_share)"}, "venue"),
    "bounds": ("removal_bound", {"'observed'": "max(observed)", "'worst_case'": "max(worst_case)"}, "venue"),
    "removed": ("removed_share", {"'removed'": "max(removed)"}, "venue"),
}
_INSTRUMENTS = {
    "alpha": ("krippendorff", {"'alpha'": "max(alpha)", "'agreement'": "max(pct_agree)"}, "variable"),
    "class_f1": ("prf_by_class", {"instrument": "max(f1)"}, "class"),
    "scores": ("scoreboard", {"'accuracy'": "max(accuracy)", "'kappa'": "max(kappa)", "'macro_f1'": "max(macro_f1)"}, "instrument"),
    "variants": ("variant_table", {"'mean_f1'": "max(mean_f1)"}, "variant"),
    "calibration": ("calibration_ece", {"'predicted'": "max(mean_pred)", "'observed'": "max(observed)", "'n'": "max(n)"}, "CAST(bin AS STRING)"),
    "votes": ("vote_summary", {"CAST(tie AS STRING)": "sum(units)"}, "CAST(votes_for AS STRING)"),
    "prevalence": ("dsl_by_category", {"'naive'": "max(naive)", "'corrected'": "max(corrected)"}, "category"),
    "shift": ("dsl_by_venue", {"'naive'": "max(naive)", "'corrected'": "max(corrected)"}, "venue"),
}
_CONTENT = {
    "topics": ("topic_by_month", {"topic": "max(share)"}, "ym"),
    "stances": ("topic_share_pivot", {f"'{v}'": f"max({v})" for v in ("trust", "distrust", "ambivalent", "non_evaluative")}, "venue"),
    "outcomes": ("topic_outcome", {f"'{v}'": f"max({v})" for v in ("trust", "distrust", "ambivalent", "non_evaluative")}, "topic"),
    "odds": ("wald_table", {"'odds_ratio'": "max(odds_ratio)", "'low'": "max(or_low)", "'high'": "max(or_high)"}, "term"),
    "tone": ("net_tone", {"'documents'": "count(*)"}, "label"),
    "terms": ("ctfidf_top", {"venue": "max(score)"}, "term"),
    "depth": ("reply_depth", {"'turns'": "count(*)"}, "CAST(depth AS STRING)"),
    "cascade": ("reply_pairs_rates", {"'rate'": "max(rate)"}, "CAST(parent_y AS STRING)"),
    "relations": ("kg_edges", {"relation": "sum(weight)"}, "CAST(sign AS STRING)"),
    "central": ("kg_central", {"'degree'": "max(degree)"}, "node"),
    "valence": ("kg_entity_valence", {"'nodes'": "count(*)"}, "CAST(net AS STRING)"),
}

#: listing: (query, items and their values, each an aggregate of all rows).
_LISTINGS = {
    "design": ("allocation", {"strata": "count(*)", "allocated": "sum(alloc_n)", "frame": "sum(pop_n)", "least probability": "min(incl_prob)", "largest probability": "max(incl_prob)", "ratio": "max(incl_prob) / min(incl_prob)", "least weight": "min(design_weight)", "largest weight": "max(design_weight)", "largest stratum": "max(pop_n)", "smallest stratum": "min(pop_n)"}),
    "sample": ("frame_correction", {"drawn": "count(*)", "eligible": "sum(CASE WHEN eligible THEN 1 ELSE 0 END)"}),
    "splits": ("srs_gold_split", {"coded": "count(*)", "development": "sum(CASE WHEN gold_split = 'dev' THEN 1 ELSE 0 END)", "test": "sum(CASE WHEN gold_split = 'test' THEN 1 ELSE 0 END)"}),
    "agreement": ("krippendorff", {"variables": "count(*)", "least alpha": "min(alpha)", "mean agreement": "avg(pct_agree)", "pairs": "sum(n)"}),
    "metrics": ("scoreboard", {"instruments": "count(*)", "best macro f1": "max(macro_f1)", "best accuracy": "max(accuracy)", "best kappa": "max(kappa)"}),
    "calibration": ("calibration_ece", {"expected error": "sum(ece_contrib)", "scored": "sum(n)"}),
    "topics": ("topic_outcome", {"topics": "count(*)", "seeded": "sum(CASE WHEN seeded THEN 1 ELSE 0 END)", "documents": "sum(n)", "residual share": "sum(CASE WHEN seeded THEN 0 ELSE n END) / CAST(sum(n) AS DOUBLE)"}),
    "alignment": ("nmi_alignment", {"nmi": "max(nmi)", "units": "max(n)"}),
    "model": ("wald_table", {"terms": "count(*)", "largest odds ratio": "max(odds_ratio)", "least odds ratio": "min(odds_ratio)", "above nothing": "sum(CASE WHEN or_low > 1 THEN 1 ELSE 0 END)"}),
}


def _figures_sql(figures: dict) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS figure, {series} AS series, {x} AS x, round(CAST({y} AS DOUBLE), 6) + 0.0::DOUBLE AS y FROM ({SQL[source]}) GROUP BY ALL" for name, (source, lines, x) in figures.items() for series, y in lines.items())


def _figures(figures: dict, spark, d) -> DataFrame:
    """(figure, series, x, y); each query is read once, whatever the lines of its figure."""

    def one(name: str, source: str, lines: dict[str, str], x: str) -> DataFrame:
        rows = QUERIES[source](spark, d)
        fixed = all(s.startswith("'") for s in lines)
        by = [F.expr(x).alias("x__")] + ([] if fixed else [F.expr(s).alias("s__") for s in lines])
        made = rows.groupBy(*by).agg(*(F.expr(f"CAST({y} AS DOUBLE)").alias(f"y{i}__") for i, y in enumerate(lines.values())))
        points = F.inline(F.array(*(F.struct((F.expr(s) if fixed else F.col("s__")).alias("series"), F.round(f"y{i}__", 6).alias("y")) for i, s in enumerate(lines))))
        return made.select(F.lit(name).alias("figure"), F.col("x__").alias("x"), points).select("figure", "series", "x", "y")

    return reduce(DataFrame.unionByName, [one(name, *spec) for name, spec in figures.items()])


@query(_figures_sql(_DESIGN))
def figure_design(spark, d):
    """Funnel, volume, strata, balance, months, composition, bounds and removed shares."""
    return _figures(_DESIGN, spark, d)


@query(_figures_sql(_INSTRUMENTS))
def figure_instruments(spark, d):
    """Agreement, scores by class and instrument, variants, calibration, votes, prevalences."""
    return _figures(_INSTRUMENTS, spark, d)


@query(_figures_sql(_CONTENT))
def figure_content(spark, d):
    """Topics, stances, outcomes, odds, tone, terms, depth, cascades, and the graph's relations, centres and valences."""
    return _figures(_CONTENT, spark, d)


@query(" UNION ALL ".join(f"SELECT '{name}' AS listing, '{item}' AS item, round(CAST({v} AS DOUBLE), 5) + 0.0::DOUBLE AS value FROM ({SQL[source]})" for name, (source, items) in _LISTINGS.items() for item, v in items.items()))
def listings(spark, d):
    """The listings' figures, one a row: design, sample, splits, agreement, metrics, calibration, topics, alignment, model."""

    def one(name: str, source: str, items: dict[str, str]) -> DataFrame:
        made = QUERIES[source](spark, d).agg(*(F.expr(f"CAST({v} AS DOUBLE)").alias(f"v{i}") for i, v in enumerate(items.values())))
        rows = F.inline(F.array(*(F.struct(F.lit(item).alias("item"), F.round(f"v{i}", 5).alias("value")) for i, item in enumerate(items))))
        return made.select(F.lit(name).alias("listing"), rows)

    return reduce(DataFrame.unionByName, [one(name, *spec) for name, spec in _LISTINGS.items()])
