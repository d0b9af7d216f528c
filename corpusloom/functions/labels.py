"""Label functions: forgiving readers of coded fields, thresholds, bins, argmax."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codebook import TRUTHY


def read_label(c: Column, levels: list[str]) -> Column:
    """A coded value as a level: by number, by name, by a beginning that one level alone has; else null."""
    v = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c.cast("string"))), "[.,;]+$", ""), r"\s+", "_")
    known = F.array(*(F.lit(x) for x in levels))
    number = F.when(v.rlike("^[0-9]{1,4}$"), v.cast("int"))
    fits = F.filter(known, lambda x: x.startswith(v))
    return (
        F.when(F.array_contains(known, v), v)
        .when(number.between(1, len(levels)), F.try_element_at(known, number))
        .when((F.length(v) > 0) & (F.size(fits) == 1), F.try_element_at(fits, F.lit(1)))
    )


def read_flag(c: Column) -> Column:
    """True for the usual ways to tick a box; null and all else are false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(TRUTHY), F.lit(False))


def any_of(columns: list[Column], nulls: str = "propagate") -> Column:
    """Whether any is true. A null makes the answer null ("propagate") or counts as false ("false")."""
    filled = [F.coalesce(c, F.lit(False)) for c in columns]
    either = reduce(lambda a, b: a | b, filled)
    if nulls == "false":
        return either
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in columns]), either)


def mean_of(columns: list[Column]) -> Column:
    """Mean over the columns that aren't null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])
    return F.try_divide(total, reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns]))


def argmax_label(probabilities: dict[str, Column]) -> Column:
    """The label of the largest probability, the first of equals; nulls don't count."""
    best = F.greatest(*probabilities.values()) if len(probabilities) > 1 else next(iter(probabilities.values()))
    return reduce(lambda w, kv: w.when(kv[1] == best, F.lit(kv[0])), list(probabilities.items())[1:], F.when(next(iter(probabilities.values())) == best, F.lit(next(iter(probabilities)))))


def length_band(n: Column) -> Column:
    """(3, 15] short, (15, 50] medium, above 50 long; null below."""
    return F.when(n > 50, "long").when(n > 15, "medium").when(n > 3, "short")


def decile(p: Column) -> Column:
    """1 to 10, right-closed, the first closed on both sides."""
    return F.greatest(F.lit(1), F.ceil(p * 10)).cast("long")


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.ln(q / (1 - q))


def agree_or(a: Column, b: Column, fallback: Column) -> Column:
    """The label both gave, or the fallback; null if either is null."""
    return F.when(a.isNull() | b.isNull(), None).when(a == b, a).otherwise(fallback)


def mapped(c: Column, names: dict[str, str]) -> Column:
    """The value under each key of a small dictionary; null for keys that it lacks."""
    return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), list(names.items())[1:], F.when(c == next(iter(names)), next(iter(names.values()))))


def dummies(c: Column, levels: list[str], prefix: str) -> list[Column]:
    """A 0/1 column for each level but the first, which is the reference level."""
    return [(c == v).cast("int").alias(f"{prefix}_{v}") for v in levels[1:]]
