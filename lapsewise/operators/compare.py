"""Comparison of two samples: Kolmogorov-Smirnov, Kullback-Leibler by neighbours, smoothed quantiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import beta_cdf, kolmogorov_upper
from ..session import settle
from .pairs import join_groups
from .running import range_bounds, range_index, running
from .split import bootstrap_rows

TASK_VALUES = 500_000


def _two_counts(df: DataFrame, col: str, second: Column) -> DataFrame:
    """Distinct values with their count in the first and in the second sample."""
    return df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("x")).agg(
        F.count_if(~second).alias("n1"), F.count_if(second).alias("n2"))


def ks_two_sample(df: DataFrame, col: str, second: Column, alternative: str = "two_sided") -> DataFrame:
    """Largest distance of the two distribution functions, with its asymptotic p value.

    ``less`` looks at the second function above the first.
    """
    if alternative not in ("two_sided", "less"):
        raise ValueError("alternative must be two_sided or less")
    counts = settle(_two_counts(df, col, second))
    sizes = counts.agg(F.sum("n1").alias("_a"), F.sum("n2").alias("_b"))
    gap = F.col("c2") / F.col("_b") - F.col("c1") / F.col("_a")
    run = running(counts, "x", sums={"n1": "c1", "n2": "c2"}, settled=True).join(F.broadcast(sizes))
    row = run.groupBy("_a", "_b").agg(F.max(F.abs(gap) if alternative == "two_sided" else gap).alias("d")).first()
    if row is None:
        raise ValueError("both samples are empty")
    d = max(row["d"], 0.0)
    z = d * math.sqrt(row["_a"] * row["_b"] / (row["_a"] + row["_b"]))
    p = kolmogorov_upper(z) if alternative == "two_sided" else math.exp(-2 * z * z)
    return df.sparkSession.createDataFrame(
        [(float(d), float(p), row["_a"], row["_b"])], "statistic double, p_value double, n_first long, n_second long")


def _kth_distances(points: np.ndarray, values: np.ndarray, counts: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Distances from each point to its 1st..k-th neighbour among sorted values with counts.

    No more than ``k + 1`` copies of a value can be among ``k`` neighbours, so counts are cut there.
    """
    a = np.repeat(values, np.minimum(counts, k + 1).astype(int))
    left, right = np.searchsorted(a, points, "left"), np.searchsorted(a, points, "right")
    same = right - left - (1 if own else 0)
    steps = np.arange(1, k + 1)
    padded = np.r_[np.full(k, -np.inf), a, np.full(k, np.inf)]
    lower = points[:, None] - padded[left[:, None] + k - steps]
    upper = padded[right[:, None] + k + steps - 1] - points[:, None]
    equal = np.where(steps <= same[:, None], 0.0, np.inf)
    return np.sort(np.concatenate([equal, lower, upper], axis=1), axis=1)[:, :k]


def _kl_sums(pdf: pd.DataFrame, k: int, halo: pd.DataFrame) -> pd.DataFrame:
    around = pd.concat([pdf[["x", "n1", "n2"]], halo]).sort_values("x")
    points = pdf[pdf["n1"] > 0]
    x, n = points["x"].to_numpy(), points["n1"].to_numpy()
    first, second = around[around["n1"] > 0], around[around["n2"] > 0]
    rho = _kth_distances(x, first["x"].to_numpy(), first["n1"].to_numpy(), k, own=True)
    nu = _kth_distances(x, second["x"].to_numpy(), second["n2"].to_numpy(), k, own=False)
    open_ = (rho > 0) & (nu > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(open_, np.log(nu / rho), 0.0)
    return pd.DataFrame({"k": np.arange(1, k + 1), "total": n @ ratio, "zero": (n[:, None] * ~open_).sum(0)})


def kl_divergence(df: DataFrame, col: str, second: Column, k: int = 5, task_values: int = TASK_VALUES) -> DataFrame:
    """Divergence of the first sample from the second by the 1st..k-th neighbour, in one dimension.

    Values are cut into ranges; each range also gets the ``k + 1`` nearest values of each sample
    on both sides, so its distances are exact. A range asks for them by their place in the order of the sample, which is a join,
    also where the ranges next to it hold too few. ``n_zero`` counts points with a zero distance, whose term is
    not finite; then ``divergence`` is null.
    """
    counts = settle(_two_counts(df, col, second))
    sizes = counts.agg(F.sum("n1"), F.sum("n2"), F.count("*")).first()
    n, m, distinct = sizes
    if min(n or 0, m or 0) <= k:
        raise ValueError("each sample needs more than k values")
    bounds = range_bounds(counts, "x", max(1, -(-distinct // task_values)))
    own = counts.withColumn("b", range_index(F.col("x"), bounds))
    both = own.select("b", "x", "n1", "n2", F.lit(True).alias("own"))
    if bounds:
        held = own.withColumns({f"i{s}": (F.col(f"n{s}") > 0).cast("long") for s in (1, 2)})
        placed = settle(running(held, "x", sums={"i1": "q1", "i2": "q2"}, at_most=distinct))
        spans = placed.groupBy("b").agg(*[f for s in (1, 2) for f in (F.min(F.col(f"q{s}") - F.col(f"i{s}")).alias(f"before{s}"), F.max(f"q{s}").alias(f"upto{s}"))])
        asked = [F.struct(F.lit(s).alias("sample"), place.cast("long").alias("place")) for s in (1, 2) for j in range(k + 1)
                 for place in (F.col(f"before{s}") - j, F.col(f"upto{s}") + 1 + j)]
        asked = spans.select("b", F.inline(F.array(*asked)))
        points = placed.select("x", "n1", "n2", F.inline(F.filter(F.array(*[F.struct(F.lit(s).alias("_s"), F.when(F.col(f"i{s}") == 1, F.col(f"q{s}")).alias("_q")) for s in (1, 2)]),
                                                                  lambda p: p["_q"].isNotNull())))
        halo = asked.join(points, (F.col("sample") == F.col("_s")) & (F.col("place") == F.col("_q"))).select("b", "x", "n1", "n2").distinct()
        both = both.unionByName(halo.withColumn("own", F.lit(False)))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        return _kl_sums(pdf[pdf["own"]], k, pdf.loc[~pdf["own"], ["x", "n1", "n2"]])

    parts = both.groupBy("b").applyInPandas(sums, "k long, total double, zero long")
    return parts.groupBy("k").agg(F.sum("total").alias("_t"), F.sum("zero").alias("n_zero")).select(
        F.col("k").cast("int").alias("k"),
        F.when(F.col("n_zero") == 0, F.col("_t") / n + F.lit(math.log(m / n))).alias("divergence"), "n_zero")


def smoothed_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                       weight: Column | None = None) -> DataFrame:
    """Harrell-Davis quantiles per group: order statistics weighted by a beta distribution over the ranks.

    A value with ranks (a, b] takes the beta mass of (a/n, b/n], so counts per distinct value suffice.
    """
    by = list(by)
    size = F.count("*") if weight is None else F.sum(weight).cast("long")
    counts = settle(df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_x")).agg(size.alias("_n")))
    run = running(counts, "_x", sums={"_n": "_cum"}, by=by, settled=True)
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    rows = join_groups(run, totals, by, small=True).select(*by, "_x", (F.col("_cum") - F.col("_n")).alias("_lo"), "_cum", "_all")

    @F.pandas_udf("array<double>")
    def weights(lo: pd.Series, hi: pd.Series, n: pd.Series) -> pd.Series:
        out = np.zeros((len(lo), len(probs)))
        for total in n.unique():
            at = (n == total).to_numpy()
            for j, q in enumerate(probs):
                a, b = (total + 1) * q, (total + 1) * (1 - q)
                out[at, j] = beta_cdf(hi[at].to_numpy() / total, a, b) - beta_cdf(lo[at].to_numpy() / total, a, b)
        return pd.Series(list(out))

    weighted = rows.withColumn("_w", weights.asNondeterministic()("_lo", "_cum", "_all"))
    sums = weighted.groupBy(*by).agg(*[F.sum(F.col("_x") * F.col("_w")[j]).alias(f"_q{j}") for j in range(len(probs))])
    pairs = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("prob"), F.col(f"_q{j}").alias("value"))
                                for j, q in enumerate(probs)]))
    return sums.select(*by, pairs.alias("_p")).select(*by, "_p.prob", "_p.value")


def compare_quantiles(df: DataFrame, col: str, second: Column, probs: Sequence[float] = (0.1, 0.3, 0.5, 0.7, 0.9),
                      key: str | None = None, replicates: int = 0, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Smoothed quantiles of both samples and their difference; with ``replicates`` also a bootstrap interval."""
    marked = df.withColumn("_second", second.cast("int"))

    def differences(rows: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
        q = smoothed_quantiles(rows, col, probs, [*by, "_second"], weight)
        pick = lambda s: F.max(F.when(F.col("_second") == s, F.col("value")))
        return q.groupBy(*by, "prob").agg(pick(0).alias("first"), pick(1).alias("second")).withColumn(
            "difference", F.col("first") - F.col("second"))

    out = differences(marked, [])
    if replicates:
        if key is None:
            raise ValueError("a bootstrap needs the row key")
        again = differences(bootstrap_rows(marked, key, replicates, seed), ["replicate"], F.col("weight"))
        tail = (1 - level) / 2
        # One difference per replicate and probability, so the exact percentile holds few values.
        spans = again.groupBy("prob").agg(F.percentile("difference", F.array(F.lit(tail), F.lit(1 - tail))).alias("_s"))
        out = out.join(spans, "prob").select(*out.columns, F.col("_s")[0].alias("low"), F.col("_s")[1].alias("high"))
    return out
