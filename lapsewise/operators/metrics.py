"""Held-out scores of a survival model: concordance, Brier, time-dependent AUC.

Higher ``lp`` means higher risk. ``G`` is the Kaplan-Meier curve of the censoring times of the
training set: the event indicator is flipped on the same risk set.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle, small_side
from .blocks import numbers
from .cox import baseline_hazard
from .cox import fit as cox_fit
from .levels import Panels, rates
from .linalg import DesignColumn
from .pairs import cells_of, join_groups, node_counts
from .running import range_bounds, range_index, running
from .split import bootstrap_rows
from .stats import median_value
from .survival import SurvSpec, kaplan_meier, step_lookup


# --- concordance ----------------------------------------------------------------------------

def concordance(df: DataFrame, lp: str = "lp", surv: SurvSpec = SurvSpec(), by: Sequence[str] = (),
                weight: Column | None = None, with_se: bool = True, **kw) -> DataFrame:
    """Harrell C: pairs where the earlier time is an event, tied scores count half; with the pair counts,
    the standard error from per-row influences, and ``dxy = 2 * (C - 1/2)``."""
    by = list(by)
    nodes = node_counts(cells_of(df, surv.time, surv.event, lp, by, weight), by, **kw)
    if with_se:
        nodes = settle(nodes)  # read for the totals and again for the influences
    case = F.col("case")
    totals = nodes.groupBy(*by).agg(
        F.sum(case * F.col("later_low")).alias("concordant"), F.sum(case * F.col("later_high")).alias("discordant"),
        F.sum(case * F.col("later_same")).alias("tied"))
    totals = with_c_index(totals)
    dxy = (2 * (F.col("c_index") - 0.5)).alias("dxy")
    if not with_se:
        return totals.select(*by, "concordant", "discordant", "tied", "c_index", dxy)
    # Only an event opens a pair with later rows; every row can close one with an earlier event.
    good = F.col("kind") * (F.col("later_low") + 0.5 * F.col("later_same")) + F.col("early_high") + 0.5 * F.col("early_same")
    every = F.col("kind") * (F.col("later_low") + F.col("later_high") + F.col("later_same")) + (
        F.col("early_low") + F.col("early_high") + F.col("early_same"))
    influence = F.try_divide(good - F.col("c_index") * every, F.col("_n"))
    totals = settle(totals)
    se = join_groups(nodes, totals, by, small=True).groupBy(*by).agg(F.sqrt(F.sum(F.col("mass") * influence * influence)).alias("se"))
    return join_groups(totals, se, by).select(
        *by, "concordant", "discordant", "tied", "c_index", "se", dxy)


def with_c_index(totals: DataFrame) -> DataFrame:
    """Add the number of pairs ``_n`` and ``c_index`` to pair counts."""
    pairs_ = F.col("concordant") + F.col("discordant") + F.col("tied")
    return totals.withColumn("_n", pairs_).withColumn(
        "c_index", F.try_divide(F.col("concordant") + 0.5 * F.col("tied"), F.col("_n")))


def c_from_dxy(dxy: float) -> float:
    return dxy / 2 + 0.5


def censoring_curve(train: DataFrame, surv: SurvSpec = SurvSpec()) -> DataFrame:
    """``time, surv`` steps of G."""
    return settle(kaplan_meier(train, surv, censoring=True).select("time", "surv"))


def _with_g(df: DataFrame, curve: DataFrame, time: str) -> DataFrame:
    at = step_lookup(df.select(time), time, curve).select(F.col(time).cast("double").alias("_gt"), F.col("surv").alias("_g"))
    return df.join(small_side(at), F.col(time).cast("double") == F.col("_gt"), "left").drop("_gt")


def uno_c(test: DataFrame, curve: DataFrame, lp: str = "lp", surv: SurvSpec = SurvSpec(), tau: float | None = None,
          **kw) -> DataFrame:
    """Uno C: pairs with a strictly earlier event, weighted by ``1/G(t)^2``, events before ``tau`` only.

    Without ``tau`` all events with ``G > 0`` count.
    """
    cells = settle(cells_of(test, surv.time, surv.event, lp))
    g = _with_g(cells, curve, "t")
    use = (F.col("_g") > 0) & (F.lit(True) if tau is None else F.col("t") < tau)
    weighted = g.withColumn("w", F.when(use, F.col("d") / (F.col("_g") * F.col("_g"))).otherwise(0.0)).drop("_g")
    nodes = node_counts(weighted, strict=True, **kw)
    case = F.col("case")
    return nodes.agg(
        F.sum(case * (F.col("later_low") + 0.5 * F.col("later_same"))).alias("_a"),
        F.sum(case * (F.col("later_low") + F.col("later_same") + F.col("later_high"))).alias("_b"),
    ).select(F.try_divide("_a", "_b").alias("c_uno"))


def optimism_corrected(df: DataFrame, key: str, columns: Sequence[DesignColumn], x: str = "x", replicates: int = 20,
                       seed: int = 1, surv: SurvSpec = SurvSpec(), ties: str = "efron") -> DataFrame:
    """Concordance of a Cox model less its optimism: ``replicate, c_sample, c_original, c_corrected``.

    A model is fitted on every bootstrap sample and scored on that sample and on the original rows; the mean
    difference is the optimism, taken off the concordance of the model of all rows. A row drawn twice enters its
    fit twice. All samples are scored in one pass, and all models on the original rows in another. Only rows with a
    key, complete times, events and covariates are drawn or scored.
    """
    whole = (F.col(x).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")))
             & F.col(key).isNotNull() & F.col(surv.event).isNotNull() & F.col(surv.time).isNotNull())
    base = settle(df.filter(whole).select(key, *[c for c in (surv.start, surv.time, surv.event) if c], x))
    drawn = settle(bootstrap_rows(base, key, replicates, seed))
    samples = original = None
    for r in range(replicates + 1):  # one model a replicate; rows stay on the executors
        own = drawn.filter(F.col("replicate") == r) if r else base.withColumn("replicate", F.lit(0)).withColumn("weight", F.lit(1))
        rows = own.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("weight")))).drop("_copy") if r else own
        model = cox_fit(rows, columns, x, surv, ties)
        scored = model.linear_predictor(own.select("replicate", "weight", surv.time, surv.event, x))
        tested = model.linear_predictor(base.select(F.lit(r).alias("replicate"), surv.time, surv.event, x))
        samples = scored if samples is None else samples.unionByName(scored)
        original = tested if original is None else original.unionByName(tested)
    kept = ["replicate", "weight", surv.time, surv.event, F.round("lp", 12).alias("lp")]  # equal rows tie
    inside = concordance(samples.select(*kept), surv=surv, by=["replicate"], weight=F.col("weight"), with_se=False)
    outside = concordance(original.select(kept[0], *kept[2:]), surv=surv, by=["replicate"], with_se=False)
    both = settle(inside.select("replicate", F.col("c_index").alias("c_sample")).join(
        outside.select("replicate", F.col("c_index").alias("c_original")), "replicate"))
    # One row per replicate; replicate 0 is the model of all rows.
    total = both.agg(F.max(F.when(F.col("replicate") == 0, F.col("c_original"))).alias("_c"),
                     F.avg(F.when(F.col("replicate") > 0, F.col("c_sample") - F.col("c_original"))).alias("_o"))
    return both.filter("replicate > 0").join(F.broadcast(total)).select(
        "replicate", "c_sample", "c_original", (F.col("_c") - F.col("_o")).alias("c_corrected"))


# --- AUC ------------------------------------------------------------------------------------

def event_times(df: DataFrame, surv: SurvSpec = SurvSpec()) -> DataFrame:
    """Distinct times at which an event happens."""
    return df.filter(F.col(surv.event) == 1).select(F.col(surv.time).cast("double").alias("time")).distinct()


def auc_uno(test: DataFrame, curve: DataFrame, lp: str = "lp", surv: SurvSpec = SurvSpec(), **kw) -> DataFrame:
    """Cumulative/dynamic AUC with inverse censoring weights ``1/G(T)`` at every distinct time: ``time, auc``.

    A pair of a case at T_i and a later row at T_j counts for T_i <= t < T_j. So the numerator at t is the
    running sum of what cases bring at their own time, less what rows take away when they leave.
    """
    cells = settle(cells_of(test, surv.time, surv.event, lp))
    g = _with_g(cells, curve, "t")
    weighted = g.withColumn("w", F.when(F.col("_g") > 0, F.col("d") / F.col("_g")).otherwise(0.0)).drop("_g")
    nodes = node_counts(weighted, strict=True, **kw)
    brought = F.col("case") * (F.col("later_low") + 0.5 * F.col("later_same"))
    taken = F.col("mass") * (F.col("early_high") + 0.5 * F.col("early_same"))
    per_time = settle(nodes.groupBy(F.col("t").alias("time")).agg(
        (F.sum(brought) - F.sum(taken)).alias("_x"), F.sum("case").alias("_w"), F.sum("mass").alias("_m")))
    run = running(per_time, "time", sums={"_x": "_num", "_w": "_cases", "_m": "_gone"}, settled=True)
    total = per_time.agg(F.sum("_m").alias("_all"))
    below = F.col("_cases") * (F.col("_all") - F.col("_gone"))
    return run.join(F.broadcast(total)).select(
        "time", F.when(below > 0, F.col("_num") / below).alias("auc"))


def auc_at(curve: DataFrame, time: float) -> float | None:
    """AUC at the last distinct time at or before ``time``."""
    row = curve.filter(F.col("time") <= time).agg(F.max_by("auc", "time")).first()
    return row[0]


def _times(spark: SparkSession, times: DataFrame | Sequence[float]) -> DataFrame:
    """Distinct evaluation times as a table."""
    if not isinstance(times, DataFrame):
        times = spark.createDataFrame([(float(t),) for t in times], "time double")
    return times.select(F.col("time").cast("double").alias("time")).distinct()


def _levels(times: DataFrame, hazard: DataFrame) -> DataFrame:
    """``time, level``: the cumulative hazard at each time."""
    falling = hazard.select("time", (-F.col("cumulative")).alias("surv"))
    return step_lookup(times, "time", falling, before=0.0).select("time", (-F.col("surv")).alias("level"))


def _range_sums(at: np.ndarray, least: float, kind: str):
    """For one score range: case mass, control mass, and the mass of its own ordered pairs, per node.

    Survival is taken relative to the smallest rate, and cumulative cases relative to the level; both factors leave
    the AUC as it is and keep its sums away from zero.
    """

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lp")
        rate, mass = rates(pdf["lp"].to_numpy()), pdf["n"].to_numpy()
        case, ctrl, inside = (np.zeros(len(at)) for _ in range(3))
        for s in range(0, len(at), 256):
            k = slice(s, s + 256)
            for i in range(0, len(rate), 4096):
                r, n = rate[i:i + 4096], mass[i:i + 4096]
                control = np.exp(-np.outer(at[k], r - least)) * n
                cases = -np.expm1(-np.outer(at[k], r)) * n / at[k, None] if kind == "cumulative" else r * control
                lower = ctrl[k, None] + control.cumsum(1) - 0.5 * control
                inside[k] += (cases * lower).sum(1)
                case[k] += cases.sum(1)
                ctrl[k] += control.sum(1)
        return pd.DataFrame({"b": pdf["b"].iloc[0], "node": np.arange(len(at)), "case": case, "ctrl": ctrl, "inside": inside})

    return sums


def model_auc(test: DataFrame, hazard: DataFrame, times: DataFrame | Sequence[float], kind: str, lp: str = "lp",
              pieces: int | None = None) -> DataFrame:
    """AUC(t) from the model's own survival ``S_i(t) = exp(-L(t) exp(lp_i))``: ``time, auc``.

    ``cumulative``: case weight ``1 - S_i(t)``; ``incident``: case weight ``exp(lp_i) S_i(t)``;
    control weight ``S_i(t)`` in both. ``times`` is a table with a column ``time``, or a few numbers. Rows are merged
    by score and cut into score ranges. A task sums the pairs of its range at the nodes of the hazard levels; pairs
    across ranges need only the range totals. Times read their value off the nodes, where they lie. Rows without a
    score take no part; without cases or controls the AUC is null.
    """
    if kind not in ("cumulative", "incident"):
        raise ValueError("kind must be cumulative or incident")
    score = F.col(lp).cast("double")
    scores = settle(test.filter(score.isNotNull() & ~F.isnan(score)).groupBy(score.alias("lp")).agg(
        F.count("*").cast("double").alias("n")))
    level = settle(_levels(_times(test.sparkSession, times), hazard))
    count, low, high = scores.agg(F.count("*"), F.min("lp"), F.max("lp")).first()
    top = level.agg(F.max("level")).first()[0]
    if not count or top is None:
        return level.select("time", F.lit(None).cast("double").alias("auc"))
    least, most = rates(np.array([low, high]))
    panels = Panels.over(top, 2 * most)
    bounds = range_bounds(scores, "lp", pieces or max(1, -(-count // 20_000)))
    cut = scores.withColumn("b", range_index(F.col("lp"), bounds))
    ranges = cut.groupBy("b").applyInPandas(
        _range_sums(panels.at, least, kind), "b int, node int, case double, ctrl double, inside double")
    # One row per range of 20,000 scores and node, so this window is short.
    below = F.sum("ctrl").over(Window.partitionBy("node").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    nodes = ranges.withColumn("_below", F.coalesce(below, F.lit(0.0))).groupBy("node").agg(
        F.sum(F.col("inside") + F.col("case") * F.col("_below")), F.sum("case"), F.sum("ctrl"))
    # As many rows as nodes, whatever the number of times and scores.
    pairs, case, ctrl = np.array(sorted(tuple(r) for r in nodes.collect()), dtype=float)[:, 1:].T

    @F.arrow_udf("double")
    def read(levels: pa.Array) -> pa.Array:
        x = numbers(levels)
        whole = panels.read(x, case) * panels.read(x, ctrl)
        known = (whole > 0) & ((x > 0) | (kind == "incident"))
        return pa.array(panels.read(x, pairs) / np.where(known, whole, 1.0), mask=~known)

    return level.select("time", read(F.col("level")).alias("auc"))


def integrated_auc(auc: DataFrame, curve: DataFrame) -> DataFrame:
    """AUC(t) weighted by the event mass of a Kaplan-Meier curve (``time, surv``) at each time."""
    shifted = running(
        curve.select("time", "surv").withColumn("_one", F.lit(1).cast("long")), "time", sums={"_one": "_i"})
    mass = shifted.alias("a").join(
        shifted.select((F.col("_i") + 1).alias("_j"), F.col("surv").alias("_prev")).alias("b"),
        F.col("a._i") == F.col("b._j"), "left",
    ).select("time", (F.coalesce("_prev", F.lit(1.0)) - F.col("surv")).alias("_m"))
    both = auc.filter("auc is not null").join(mass, "time").filter("_m > 0")
    return both.agg(F.try_divide(F.sum(F.col("auc") * F.col("_m")), F.sum("_m")).alias("iauc"))


# --- Brier ----------------------------------------------------------------------------------

def _sweep(panels: Panels):
    """Sums over the cells of one range at each of its times, and over all of them at each node."""

    def sums(cells: pd.DataFrame, times: pd.DataFrame) -> pd.DataFrame:
        times = times.sort_values("time")
        t = times["time"].to_numpy()
        place = np.searchsorted(t, cells["t"].to_numpy(), side="left")  # the first time at or after the cell's own
        order = np.argsort(place, kind="stable")
        place, rate = place[order], rates(cells["lp"].to_numpy()[order])
        n, w = cells["n"].to_numpy()[order], cells["w"].to_numpy()[order]
        past, later = np.zeros((len(t) + 1, len(panels.at))), np.zeros((len(t) + 1, len(panels.at)))
        for i in range(0, len(rate), 2048):
            k = slice(i, i + 2048)
            alive = np.exp(-np.outer(rate[k], panels.at))
            at, first = np.unique(place[k], return_index=True)
            past[at] += np.add.reduceat(alive**2 * w[k, None], first, axis=0)
            later[at] += np.add.reduceat((1 - alive) ** 2 * n[k, None], first, axis=0)
        whole = {"b": (times if len(t) else cells)["b"].iloc[0], "all_past": past.sum(0), "all_later": later.sum(0)}
        past, later = past.cumsum(0)[:-1], later[::-1].cumsum(0)[::-1][1:]
        level = times["level"].to_numpy()
        own = {"b": times["b"], "time": t, "past": panels.read(level, past) if len(t) else [],
               "later": panels.read(level, later) if len(t) else [], "all_past": None, "all_later": None}
        rows = pd.DataFrame(own).to_dict("records") + [whole | dict.fromkeys(("time", "past", "later"))]
        return pd.DataFrame(rows, columns=["b", "time", "past", "later", "all_past", "all_later"])

    return sums


def _offsets(panels: Panels):
    """What earlier and later ranges add at the times of one range."""

    def add(times: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
        level = times["level"].to_numpy()
        before, after = np.zeros(len(panels.at)), np.zeros(len(panels.at))
        at = ranges["node"].to_numpy()
        before[at], after[at] = ranges["before"], ranges["after"]
        return pd.DataFrame({"time": times["time"], "inverse": times["inverse"], "past": panels.read(level, before),
                             "later": panels.read(level, after)})

    return add


def brier(test: DataFrame, hazard: DataFrame, curve: DataFrame, times: DataFrame | Sequence[float], lp: str = "lp",
          surv: SurvSpec = SurvSpec(), pieces: int | None = None) -> DataFrame:
    """``time, brier``: mean of ``S^2 1(T<=t, event)/G(T) + (1-S)^2 1(T>t)/G(t)``.

    ``times`` is a table with a column ``time``, or a few numbers. Rows are merged by (score, time, event) and swept
    along the time axis in ranges: a range sums its cells at the nodes of the hazard levels and reads them off at its
    own times, and earlier and later ranges come in by their totals. Cells of a hot time are dealt into parts. So the
    work is rows plus times, times the nodes, not rows times times. Where ``G`` is zero nothing is known and the term
    is zero. Rows without a score or time take no part; without rows the score is null.
    """
    score, own, count_ = F.col(lp).cast("double"), F.col(surv.time).cast("double"), F.count("*").cast("double")
    cells = test.filter(score.isNotNull() & ~F.isnan(score) & own.isNotNull()).groupBy(
        score.alias("lp"), own.alias("t"), F.col(surv.event).cast("int").alias("e")).agg(count_.alias("n"))
    weight = F.when((F.col("_g") > 0) & (F.col("e") == 1), F.col("n") / F.col("_g")).otherwise(0.0)
    rows = settle(_with_g(settle(cells), curve, "t").select("lp", "t", "n", weight.alias("w")))
    wanted = settle(_times(test.sparkSession, times))
    known = step_lookup(wanted, "time", curve).select(F.col("time").alias("_t"), F.col("surv").alias("_g"))
    level = settle(_levels(wanted, hazard).join(known, F.col("time") == F.col("_t")).select(
        "time", "level", F.when(F.col("_g") > 0, 1 / F.col("_g")).otherwise(0.0).alias("inverse")))
    size, mass, high = rows.agg(F.count("*"), F.sum("n"), F.max("lp")).first()
    top = level.agg(F.max("level")).first()[0]
    if not size or top is None:
        return level.select("time", F.lit(None).cast("double").alias("brier"))
    panels = Panels.over(top, 2 * float(rates(np.array([high]))[0]))
    part = max(1000, 500_000 // len(panels.at))  # cells of a task, so that its sums take a few megabytes
    bounds = range_bounds(rows, "t", pieces or max(1, -(-size // part)))
    ranged = rows.withColumn("b", range_index(F.col("t"), bounds))
    # A time that many cells share is a range of its own at most; parts split it.
    parts = small_side(ranged.groupBy("b").agg(F.ceil(F.count("*") / F.lit(2.0 * part)).cast("int").alias("k")))
    ranged = ranged.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("lp", "t"), F.col("k")).cast("int"))
    grid = level.withColumn("b", range_index(F.col("time"), bounds))
    dealt = grid.join(parts, "b", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("k"), F.lit(1)) - 1)))
    swept = settle(ranged.select("b", "part", "lp", "t", "n", "w").groupBy("b", "part").cogroup(
        dealt.select("b", "part", "time", "level").groupBy("b", "part")).applyInPandas(
        _sweep(panels), "b int, time double, past double, later double, all_past array<double>, all_later array<double>"))
    # One row per range and node.
    totals = swept.filter("time is null").select("b", F.posexplode(F.arrays_zip("all_past", "all_later")).alias("node", "v"))
    totals = totals.groupBy("b", "node").agg(F.sum("v.all_past").alias("p"), F.sum("v.all_later").alias("l"))
    along = Window.partitionBy("node").orderBy("b")
    around = totals.select(
        "b", "node", F.coalesce(F.sum("p").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.coalesce(F.sum("l").over(along.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)).alias("after"))
    outside = grid.groupBy("b").cogroup(around.groupBy("b")).applyInPandas(
        _offsets(panels), "time double, inverse double, past double, later double")
    inside = swept.filter("time is not null").select("time", F.lit(None).cast("double").alias("inverse"), "past", "later")
    return outside.unionByName(inside).groupBy("time").agg(
        ((F.sum("past") + F.sum("later") * F.max("inverse")) / F.lit(float(mass))).alias("brier"))


def integrated_brier(scores: DataFrame) -> DataFrame:
    """Trapezoid over the time range, divided by its length."""
    order = running(scores.withColumn("_one", F.lit(1).cast("long")), "time", sums={"_one": "_i"})
    nxt = order.select((F.col("_i") - 1).alias("_j"), F.col("time").alias("_t"), F.col("brier").alias("_b"))
    both = order.join(nxt, F.col("_i") == F.col("_j"))
    area = F.sum((F.col("_t") - F.col("time")) * (F.col("brier") + F.col("_b")) / 2)
    return both.agg(F.try_divide(area, F.max("_t") - F.min("time")).alias("ibs"))


# --- bundle ---------------------------------------------------------------------------------

SCORES = ("brier_med", "integrated_brier", "c_uno", "c_index", "c_se", "auc_median_cd", "auc_median_sh",
          "auc_median_uno", "iauc_cd", "iauc_sh", "iauc_uno", "median_time")


def score(train: DataFrame, test: DataFrame, lp: str = "lp", surv: SurvSpec = SurvSpec(),
          times: DataFrame | Sequence[float] | None = None, wanted: Sequence[str] = SCORES) -> dict[str, float]:
    """Scores of one model from the linear predictor on the training and the held-out rows."""
    cols = [F.col(surv.time).cast("double").alias(surv.time), F.col(surv.event).cast("int").alias(surv.event), F.col(lp)]
    train, test = settle(train.select(*cols)), settle(test.select(*cols))
    middle = median_value(train, surv.time)
    out: dict[str, float] = {"median_time": middle}
    need = lambda *names: any(n in wanted for n in names)
    if need("c_index", "c_se"):
        c = concordance(test, lp, surv).first()
        out["c_index"], out["c_se"] = c["c_index"], c["se"]
    g = censoring_curve(train, surv)
    if need("c_uno"):
        out["c_uno"] = uno_c(test, g, lp, surv).first()[0]
    if need("brier_med", "integrated_brier", *[f"{k}_{m}" for k in ("auc_median", "iauc") for m in ("cd", "sh", "uno")]):
        among = settle(event_times(test, surv) if times is None else _times(test.sparkSession, times))
        hazard = settle(baseline_hazard(train, lp, surv))
        km = settle(kaplan_meier(test, surv).select("time", "surv"))
        grid = settle(among.unionByName(_times(test.sparkSession, [middle])).distinct())
    if need("brier_med", "integrated_brier"):
        errors = brier(test, hazard, g, grid, lp, surv)
        out["brier_med"] = errors.filter(F.col("time") == middle).first()["brier"]
        out["integrated_brier"] = integrated_brier(errors.join(among, "time")).first()[0]
    for name, kind in (("cd", "cumulative"), ("sh", "incident")):
        if need(f"auc_median_{name}", f"iauc_{name}"):
            curve = settle(model_auc(test, hazard, grid, kind, lp))
            out[f"auc_median_{name}"] = curve.filter(F.col("time") == middle).first()["auc"]
            out[f"iauc_{name}"] = integrated_auc(curve.join(among, "time"), km).first()[0]
    if need("auc_median_uno", "iauc_uno"):
        curve = settle(auc_uno(test, g, lp, surv))
        out["auc_median_uno"] = auc_at(curve, middle)
        out["iauc_uno"] = integrated_auc(curve.join(among, "time"), km).first()[0]
    return {k: out[k] for k in SCORES if k in wanted}
