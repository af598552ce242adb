"""Survival responses and the Kaplan-Meier estimator."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .running import running


@dataclass(frozen=True)
class SurvSpec:
    """Names of the response columns; with ``start`` a row is at risk for ``start < t <= time``."""

    time: str = "sale_time"
    event: str = "event"
    start: str | None = None


def kaplan_meier(
    df: DataFrame, surv: SurvSpec = SurvSpec(), by: Sequence[str] = (), censoring: bool = False
) -> DataFrame:
    """Product-limit curve: ``time, n_risk, n_event, n_censor, surv`` per distinct time.

    With ``censoring`` the indicator is flipped on the same risk set, which gives the
    distribution of the censoring times. With a ``start`` column rows enter late.
    """
    by = list(by)
    event = F.col(surv.event)
    ends = df.select(
        *by, F.col(surv.time).cast("double").alias("time"), event.cast("long").alias("_d"),
        (1 - event).cast("long").alias("_c"), F.lit(1).cast("long").alias("_out"), F.lit(0).cast("long").alias("_in"),
    )
    if surv.start is not None:
        ends = ends.unionByName(
            df.select(
                *by, F.col(surv.start).cast("double").alias("time"),
                *[F.lit(0).cast("long").alias(c) for c in ("_d", "_c", "_out")], F.lit(1).cast("long").alias("_in"),
            )
        )
    per_time = settle(
        ends.filter(F.col("time").isNotNull()).groupBy(*by, "time").agg(
            F.sum("_d").alias("_d"), F.sum("_c").alias("_c"), F.sum("_out").alias("_out"), F.sum("_in").alias("_in")
        )
    )
    rows = per_time.count()
    run = running(per_time, "time", sums={"_out": "_gone", "_in": "_entered"}, by=by, settled=True, at_most=rows)
    if surv.start is None:
        size = per_time.groupBy(*by).agg(F.sum("_out").alias("_all"))
        run = _with_groups(run, size, by)
        at_risk = F.col("_all") - (F.col("_gone") - F.col("_out"))
    else:
        at_risk = (F.col("_entered") - F.col("_in")) - (F.col("_gone") - F.col("_out"))
    hits = F.col("_c") if censoring else F.col("_d")
    steps = run.filter("_out > 0").select(
        *by, "time", at_risk.alias("n_risk"), F.col("_d").alias("n_event"), F.col("_c").alias("n_censor"),
        F.when(hits < at_risk, F.log(1 - hits / at_risk)).otherwise(F.lit(0.0)).alias("_log"),
        F.when(hits < at_risk, 0).otherwise(1).alias("_zero"),
    )
    curve = running(steps, "time", sums={"_log": "_cum", "_zero": "_dead"}, by=by, at_most=rows)
    return curve.select(
        *by, "time", "n_risk", "n_event", "n_censor",
        F.when(F.col("_dead") > 0, F.lit(0.0)).otherwise(F.exp("_cum")).alias("surv"),
    )


def _with_groups(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        return df.join(F.broadcast(groups))
    right = groups.select(*[F.col(k).alias(f"_g_{k}") for k in by], *[c for c in groups.columns if c not in by])
    return df.join(right, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in by]).drop(*[f"_g_{k}" for k in by])


def step_lookup(points: DataFrame, at: str, curve: DataFrame, value: str = "surv", before: float = 1.0) -> DataFrame:
    """Value of a falling step curve at each distinct point: last step at or before it.

    Both sides are tables of distinct times. They are laid on one axis and the running
    minimum is read off, which for a falling curve is the last value.
    """
    steps = curve.select(F.col("time").alias("_t"), F.col(value).alias("_v"), F.lit(None).cast("int").alias("_want"))
    wanted = points.select(F.col(at).cast("double").alias("_t")).distinct().select(
        "_t", F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_want")
    )
    axis = steps.unionByName(wanted).groupBy("_t").agg(F.min("_v").alias("_v"), F.max("_want").alias("_want"))
    return running(axis, "_t", mins={"_v": "_low"}).filter("_want = 1").select(
        F.col("_t").alias(at), F.coalesce(F.col("_low"), F.lit(before)).alias(value)
    )


def separation(df: DataFrame, cols: Sequence[str], event: str = "event") -> DataFrame:
    """Levels whose rows are all events or all censored."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols])
    )
    return (
        df.select(pairs.alias("p"), F.col(event).alias("_e"))
        .groupBy("p.variable", "p.level")
        .agg(F.count("*").alias("n"), F.sum("_e").cast("long").alias("n_event"))
        .filter((F.col("n_event") == 0) | (F.col("n_event") == F.col("n")))
    )
