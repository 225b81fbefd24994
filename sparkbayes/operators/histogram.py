"""Observations compressed to bins with counts, and likelihoods weighted by them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks(values: DataFrame, column: str, n: int = 256) -> DataFrame:
    """``values`` with ``_p``: the number of the range that a value lies in, of about evenly filled ones in ascending order."""
    edges = values.agg(F.percentile_approx(column, F.array(*[F.lit(i / n) for i in range(1, n)]), 10 * n).alias("e")).head()[0] or []
    if not edges:
        return values.withColumn("_p", F.lit(0))
    splits = [float("-inf"), *sorted({float(e) for e in edges}), float("inf")]
    as_double = values.withColumn("_v", F.col(column).cast("double"))
    return Bucketizer(splits=splits, inputCol="_v", outputCol="_p").transform(as_double).withColumn("_p", F.col("_p").cast("int")).drop("_v")


def exact_quantiles(values: DataFrame, at: list[float]) -> list[float]:
    """Percentiles of ``v``, interpolated between neighbouring ranks.

    Different values are counted, ranges of them are ranked apart, and the totals of the ranges (some hundred numbers)
    say in which ones the ranks lie; of those the rows at the ranks come to the driver.
    """
    counts = blocks(values.groupBy("v").agg(F.count(F.lit(1)).alias("c")), "v")
    totals = sorted((r[0], r[1]) for r in counts.groupBy("_p").agg(F.sum("c")).collect())
    n = sum(c for _, c in totals)
    if not n:
        return []
    before, start = {}, 0
    for part, c in totals:
        before[part], start = start, start + c
    places = [q * (n - 1) for q in at]
    ranks = sorted({x for p in places for x in (math.floor(p), math.ceil(p))})
    ahead = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_p")]
    upto = ahead + F.sum("c").over(Window.partitionBy("_p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_hi", upto).withColumn("_lo", F.col("_hi") - F.col("c"))
    wanted = F.filter(F.array(*[F.lit(x).cast("long") for x in ranks]), lambda x: (x >= F.col("_lo")) & (x < F.col("_hi")))
    found = {r[1]: r[0] for r in placed.select("v", F.explode(wanted).alias("rank")).collect()}
    return [found[lo] + (p - lo) * (found[hi] - found[lo]) for p in places for lo, hi in [(math.floor(p), math.ceil(p))]]


def quantile_edges(df: DataFrame, columns: list[str], n_quantiles: int, *, positive: bool = False, accuracy: int | None = None) -> list[float]:
    """Edges shared by all columns: evenly spaced percentiles of all their values; exact, or with ``accuracy`` from a sketch of bounded size."""
    values = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("v")) if len(columns) > 1 else df.select(F.col(columns[0]).cast("double").alias("v"))
    values = values.where(F.col("v").isNotNull() & (F.col("v") > 0)) if positive else values.where(F.col("v").isNotNull())
    at = [i / (n_quantiles - 1) for i in range(n_quantiles)]
    if accuracy is None:
        return exact_quantiles(values, at)
    found = values.agg(F.percentile_approx("v", F.array(*map(F.lit, at)), accuracy).alias("e")).head()[0]
    return [] if found is None else list(found)


def quantile_histogram(df: DataFrame, columns: str | list[str], n_quantiles: int = 1000, *, zero_inflation: bool = False, accuracy: int | None = None) -> DataFrame:
    """(column, bin, lower, upper, mid, count): n_quantiles - 1 bins, the last one closed; with zero inflation bin 0 is [0, 0] and edges are of positive values.

    The edges are literals of the plan; values find their bin by binary search in one pass and counts combine before the shuffle.
    """
    columns = [columns] if isinstance(columns, str) else columns
    edges = quantile_edges(df, columns, n_quantiles, positive=zero_inflation, accuracy=accuracy)
    distinct = sorted({*edges})
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    if zero_inflation:
        zeros = values.where("v = 0").groupBy("column").agg(F.count(F.lit(1)).alias("count")).select("column", F.lit(0).cast("long").alias("bin"), F.lit(0.0).alias("lower"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("mid"), "count")
        values = values.where("v > 0")
    if len(distinct) < 2:
        return zeros if zero_inflation else values.limit(0).select("column", F.lit(0).cast("long").alias("bin"), F.col("v").alias("lower"), F.col("v").alias("upper"), F.col("v").alias("mid"), F.lit(0).cast("long").alias("count"))
    # Equal neighbouring edges enclose nothing: the bins between different edges carry their place among all edges.
    place = [max(i for i, e in enumerate(edges) if e == d) for d in distinct[:-1]]
    found = Bucketizer(splits=distinct, inputCol="v", outputCol="_b", handleInvalid="skip").transform(values)
    counts = found.groupBy("column", F.col("_b").cast("int").alias("_b")).agg(F.count(F.lit(1)).alias("count"))
    lower, upper = (F.get(F.array(*[F.lit(e) for e in x]), F.col("_b")) for x in (distinct[:-1], distinct[1:]))
    shift = 1 if zero_inflation else 0
    out = counts.select("column", (F.get(F.array(*[F.lit(i + shift) for i in place]), F.col("_b"))).cast("long").alias("bin"), lower.alias("lower"), upper.alias("upper"), ((lower + upper) / 2).alias("mid"), "count")
    return zeros.unionByName(out) if zero_inflation else out


def discrete_histogram(df: DataFrame, column: str, min_count: int | None = None) -> DataFrame:
    """(mid, count): values of at least ``min_count`` rows; a rarer value counts for the next kept one below it, and below the smallest kept one for none."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("mid")).agg(F.count(F.lit(1)).alias("count"))
    if min_count is None:
        return counts
    # One row for each different value; ranges of them by themselves, then what the range before one ends with.
    parted = blocks(counts, "mid")
    kept = F.when(F.col("count") >= min_count, F.col("mid"))
    order = Window.partitionBy("_p").orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    ends = parted.groupBy("_p").agg(F.max(kept).alias("_last"))
    ends = ends.select("_p", F.last("_last", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row a range
    to = parted.withColumn("to", F.last(kept, ignorenulls=True).over(order)).join(ends, "_p").withColumn("to", F.coalesce("to", "_before"))
    return to.where("to is not null").groupBy(F.col("to").alias("mid")).agg(F.sum("count").alias("count"))


def histogram_logp(bins: DataFrame, logp: Callable[[Column], Column]) -> Column:
    """The weighted log likelihood of bins, for use in ``agg``."""
    return F.sum(logp(F.col("mid").cast("double")) * F.col("count"))


def histogram_approximation(df: DataFrame, column: str, logp: Callable[[Column], Column], *, n_quantiles: int = 1000, zero_inflation: bool = False, min_count: int | None = None) -> DataFrame:
    """(logp): the approximate log likelihood of a column; whole numbers by values, others by quantiles."""
    whole = dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint")
    bins = discrete_histogram(df, column, min_count) if whole else quantile_histogram(df, column, n_quantiles, zero_inflation=zero_inflation)
    return bins.agg(histogram_logp(bins, logp).alias("logp"))
