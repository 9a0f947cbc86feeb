"""Percentiles by three definitions, and summaries of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cells import ordered_values


def percentiles(rows: DataFrame, group: str, value: str, at: list[float], span: float = 1.0) -> DataFrame:
    """Per group n and, for each p of `at` in percent: linear{p} at (n - 1) p, nearest{p} at ceil(p n), exclusive{p} at p (n + 1) as Python's quantiles.

    Exact, with no group held whole: `span` is the width of the cells that values are counted in.
    """
    n, wanted, places = F.col("n"), {}, {}
    for p in at:
        q, name = p / 100, f"{p:g}"
        linear = (n - 1) * q
        # Positions of the exclusive definition stay between the first and the last pair of values.
        exclusive = F.greatest(F.lit(1.0), F.least((n + 1) * q, n - F.lit(1e-9)))
        for kind, place in (("linear", linear + 1), ("exclusive", exclusive)):
            places[kind + name] = place - F.floor(place)
            wanted[f"{kind}{name}_a"] = F.floor(place)
            wanted[f"{kind}{name}_b"] = F.least(n, F.floor(place) + 1)
        wanted[f"nearest{name}"] = F.greatest(F.lit(1), F.ceil(F.round(n * q, 9)))
    out = ordered_values(rows, group, value, wanted, span)
    between = [(F.col(f"{k}_a") + f * (F.col(f"{k}_b") - F.col(f"{k}_a"))).alias(k) for k, f in places.items()]
    return out.select(group, "n", *between, *[F.col(k) for k in wanted if k.startswith("nearest")])


def upper_median(rows: DataFrame, group: str, value: str, span: float = 64.0) -> DataFrame:
    """(group, n, least, median, most); the median of an even number of values is the upper one."""
    n = F.col("n")
    return ordered_values(rows, group, value, {"least": F.lit(1), "median": F.floor(n / 2) + 1, "most": n}, span)


def throughput(items: Column, seconds: Column) -> Column:
    """Items per second of all measurements together; null without any time."""
    return F.sum(items) / F.nullif(F.sum(seconds), F.lit(0))


def summary(rows: DataFrame, group: str, seconds: str, items: str) -> DataFrame:
    """Per group mean (nulls skipped), least, items, seconds and throughput."""
    s, i = F.col(seconds), F.col(items)
    return rows.groupBy(group).agg(F.avg(s).alias("mean"), F.min(s).alias("least"), F.sum(i).alias("items"), F.sum(s).alias("seconds"), throughput(i, s).alias("per_second"))


def norm_error(norm: Column) -> Column:
    """Largest distance of norms from 1."""
    return F.max(F.abs(norm - 1))
