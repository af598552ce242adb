"""Descriptive statistics: frequencies, exact quantiles, histograms, densities, collinearity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .running import running


def frequencies(df: DataFrame, col: str) -> DataFrame:
    """Counts per value, null included, with the share of all rows."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).withColumn("pct", 100.0 * F.col("n") / F.col("_all")).drop("_all")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-way counts in long form, null included, with the percentage of the whole table."""
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).withColumn("pct", 100.0 * F.col("n") / F.col("_all")).drop("_all")


def quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics (R type 7).

    Counts per distinct value are summed along the order; only the two rows around each
    wanted position are kept. No reducer holds all values of a column.
    """
    by = list(by)
    counts = settle(
        df.filter(F.col(col).isNotNull())
        .groupBy(*by, F.col(col).cast("double").alias("_x"))
        .agg(F.count("*").alias("_n"))
    )
    run = running(counts, "_x", sums={"_n": "_cum"}, by=by, settled=True)
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    if by:
        totals = totals.select(*[F.col(k).alias(f"_t_{k}") for k in by], "_all")
        run = run.join(totals, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in by])
    else:
        run = run.join(F.broadcast(totals))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    spots = run.select(*by, "_x", (F.col("_cum") - F.col("_n")).alias("_prev"), "_cum", "_all", wanted)
    pos = F.col("prob") * (F.col("_all") - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    at_lo = (F.col("_prev") <= lo) & (lo < F.col("_cum"))
    at_hi = (F.col("_prev") <= hi) & (hi < F.col("_cum"))
    return (
        spots.filter(at_lo | at_hi)
        .groupBy(*by, "prob", (pos - lo).alias("_frac"))
        .agg(F.max(F.when(at_lo, F.col("_x"))).alias("_lo"), F.max(F.when(at_hi, F.col("_x"))).alias("_hi"))
        .select(*by, "prob", (F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo"))).alias("value"))
    )


def median_value(df: DataFrame, col: str) -> float:
    row = quantiles(df, col, [0.5]).first()
    return None if row is None else row["value"]


def column_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Min, quartiles, mean, max and null count of several columns, one row per column."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols])
    )
    long = df.select(pairs.alias("p")).select("p.*")
    plain = long.groupBy("variable").agg(
        F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
    )
    quart = quantiles(long, "value", [0.25, 0.5, 0.75], by=["variable"]).groupBy("variable").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
          for p, n in [(0.25, "q1"), (0.5, "median"), (0.75, "q3")]]
    )
    return plain.join(quart, "variable", "left")


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the range of the whole column; count and density per bin and group."""
    by = list(by)
    values = df.filter(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_x"))
    span = values.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    spot = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("_x") - F.col("_lo"), width)))
    ).cast("int")
    counts = (
        values.join(F.broadcast(span))
        .groupBy(*by, spot.alias("bin"), F.col("_lo"), width.alias("_w"))
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("density", F.try_divide(F.col("n"), total * F.col("_w"))).select(
        *by, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left_edge"), "n", "density"
    )


def kernel_density(df: DataFrame, col: str, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Gaussian kernel density on a fixed grid, per group, from distinct values with counts.

    Bandwidth: 0.9 * min(sd, IQR/1.34) * n^(-1/5).
    """
    by = list(by)
    counts = settle(
        df.filter(F.col(col).isNotNull())
        .groupBy(*by, F.col(col).cast("double").alias("_x"))
        .agg(F.count("*").alias("_n"))
    )
    x, n = F.col("_x"), F.col("_n")
    mean = F.sum(x * n) / F.sum(n)
    moments = counts.groupBy(*by).agg(F.sum(n).alias("_all"), mean.alias("_mean"))
    join_on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by] or F.lit(True)

    def with_groups(left: DataFrame, right: DataFrame) -> DataFrame:
        keep = [F.col(f"b.{c}") for c in right.columns if c not in by]
        return left.alias("a").join(right.alias("b"), join_on).select("a.*", *keep)

    spread = with_groups(counts, moments).groupBy(*by, "_all").agg(
        F.sqrt(F.sum(n * (x - F.col("_mean")) ** 2) / (F.col("_all") - 1)).alias("_sd")
    )
    quart = quantiles(df, col, [0.25, 0.75], by=by).groupBy(*by).agg(
        (F.max(F.when(F.col("prob") == 0.75, F.col("value")))
         - F.max(F.when(F.col("prob") == 0.25, F.col("value")))).alias("_iqr")
    )
    width = with_groups(spread, quart)
    narrow = F.least(F.col("_sd"), F.col("_iqr") / 1.34)
    width = width.withColumn(
        "_bw", 0.9 * F.when(narrow > 0, narrow).otherwise(F.col("_sd")) * F.col("_all") ** F.lit(-0.2)
    )
    points = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("x")
    z = (F.col("x") - x) / F.col("_bw")
    return (
        with_groups(counts, width).select("*", points)
        .groupBy(*by, "x")
        .agg(F.sum(n * F.exp(-0.5 * z * z) / (F.col("_all") * F.col("_bw") * 2.5066282746310002)).alias("density"))
    )
