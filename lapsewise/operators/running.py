"""Running totals along an order, without putting an unbounded order into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, shuffle_width

# Up to this many rows a single window task is proven cheap; beyond it the order is cut in ranges.
ONE_TASK_ROWS = 1_000_000


def range_bounds(df: DataFrame, order: str, pieces: int) -> list[float]:
    """Inner bounds that cut ``order`` into at most ``pieces`` ranges of similar row count."""
    probs = [i / pieces for i in range(1, pieces)]
    return sorted(set(df.approxQuantile(order, probs, 0.1 / pieces))) if probs else []


def range_index(value: Column, bounds: Sequence[float]) -> Column:
    """Number of bounds below ``value``: equal values always share a range."""
    if not bounds:
        return F.lit(0)
    if len(bounds) <= 32:
        return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < value)).cast("int")
    cuts = np.asarray(bounds, dtype=float)

    @F.arrow_udf("int")
    def find(values: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, values.to_numpy(zero_copy_only=False), side="left").astype(np.int32))

    return find(value.cast("double"))


def running(
    df: DataFrame,
    order: str,
    sums: Mapping[str, str] = (),
    mins: Mapping[str, str] = (),
    by: Sequence[str] = (),
    settled: bool = False,
    at_most: int | None = None,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Add running sums and minima (``{input: output}``) in ascending ``order`` inside each ``by`` group.

    ``df`` holds one row per (``by``, ``order``), so it is already aggregated. A short table takes
    one window task. A long one is cut into ranges: totals inside the ranges, then offsets per range.
    ``at_most`` is a row count the caller has already established.
    """
    sums, mins, by = dict(sums), dict(mins), list(by)
    known = at_most is not None and at_most <= one_task_rows
    base = df if settled or known else settle(df)
    rows = at_most if known else base.count()
    if rows <= one_task_rows:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = base
        for src, dst in sums.items():
            out = out.withColumn(dst, F.sum(src).over(w))
        for src, dst in mins.items():
            out = out.withColumn(dst, F.min(src).over(w))
        return out

    # one bound per million rows comes to the driver, and one total per range meets in the window over offsets
    pieces = max(shuffle_width(df.sparkSession), 2 + rows // one_task_rows)
    bounds = range_bounds(base, order, pieces)
    keys = [*by, "_range"]
    cut = base.withColumn("_range", range_index(F.col(order).cast("double"), bounds))
    inner = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut
    for src, dst in sums.items():
        out = out.withColumn(dst, F.sum(src).over(inner))
    for src, dst in mins.items():
        out = out.withColumn(dst, F.min(src).over(inner))

    aggs = [F.sum(s).alias(f"_s_{d}") for s, d in sums.items()]
    aggs += [F.min(s).alias(f"_m_{d}") for s, d in mins.items()]
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*keys).agg(*aggs)
    for d in sums.values():
        offsets = offsets.withColumn(f"_s_{d}", F.sum(f"_s_{d}").over(before))
    for d in mins.values():
        offsets = offsets.withColumn(f"_m_{d}", F.min(f"_m_{d}").over(before))
    offsets = offsets.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[c for c in offsets.columns if c not in keys],
    )
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    out = out.join(offsets, match, "left")
    for d in sums.values():
        out = out.withColumn(d, F.col(d) + F.coalesce(F.col(f"_s_{d}"), F.lit(0)))
    for d in mins.values():
        out = out.withColumn(d, F.least(F.col(d), F.col(f"_m_{d}")))
    return out.select(*df.columns, *sums.values(), *mins.values())
