"""Cox partial-likelihood fits by distributed sums.

Rows never move: every task adds up its own rows per event time (``risk pass``) and its own weighted
cross product (``curvature pass``); only those sums travel. The driver solves systems of the size
of the covariate list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import digamma, lgamma, normal_two_sided, trigamma
from ..session import settle, small_side
from .blocks import matrix, numbers, tree_sum
from .linalg import DesignColumn
from .survival import SurvSpec

# Sums per event time that one pass may hold, in doubles; more event times are worked off in blocks.
PASS_CELLS = 8_000_000
# Bytes of rows that are worth a task of their own.
TASK_BYTES = 32 << 20
# Ties up to this size are summed term by term, larger ones by digamma differences.
DIRECT_TIES = 4096


# --- data -----------------------------------------------------------------------------------

class CoxRows:
    """The prepared rows of a fit: ``t, s, e, f, x``, kept in memory or on local disk while in use.

    Rows with a null or not-a-number time, event or covariate take no part; ``left_out`` counts them.
    """

    def __init__(self, df: DataFrame, x: str, width: int, surv: SurvSpec = SurvSpec(), fold: str | None = None):
        self.p = width
        self.late_entry = surv.start is not None
        cols = [
            F.col(surv.time).cast("double").alias("t"),
            (F.col(surv.start).cast("double") if self.late_entry else F.lit(float("-inf"))).alias("s"),
            F.col(surv.event).cast("int").alias("e"),
            (F.col(fold).cast("int") if fold else F.lit(-1)).alias("f"),
            F.col(x).cast("array<double>").alias("x"),
        ]
        bad = F.exists("x", lambda v: v.isNull() | F.isnan(v)) | F.isnan("t") | F.isnan("s")
        whole = F.col("t").isNotNull() & F.col("s").isNotNull() & F.col("e").isNotNull() & F.col("x").isNotNull() & ~bad
        every = df.select(*cols)
        self.df = every.where(whole).persist(StorageLevel.MEMORY_AND_DISK)
        self._every = every
        p = self.p

        def moments(batches):
            out = np.zeros(3 + p)
            out[-1] = 1.0
            for b in batches:
                m = matrix(b.column(4), p)
                out[0] += len(m)
                out[1] += numbers(b.column(2)).sum()
                out[2:2 + p] += m.sum(0)
            return out

        sums = tree_sum(self.df, moments)
        if sums is None or sums[0] == 0:
            raise ValueError("no rows to fit")
        self.n, self.n_event = sums[0], sums[1]
        self.mean = sums[2:2 + p] / self.n
        self.tasks = int(sums[-1])
        # Few tasks mean little data: deal it out once, so that every pass uses all cores.
        cores = df.sparkSession.sparkContext.defaultParallelism
        if sums[-1] < cores and self.n > 256 * cores:
            few, self.df = self.df, self.df.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
            self.df.count()
            self.tasks = cores
            few.unpersist()
        self._kept = self.df
        # Every task brings its sums per event time, however few its rows are: more tasks than the rows need only bring more of them.
        enough = max(cores, -(-int(self.n) * (p + 4) * 8 // TASK_BYTES))
        if self.tasks > enough:
            self.df, self.tasks = self.df.coalesce(enough), enough
        mean = self.mean

        def spread(batches):
            out = np.zeros(p)
            for b in batches:
                out += ((matrix(b.column(4), p) - mean) ** 2).sum(0)
            return out

        sd = np.sqrt(tree_sum(self.df, spread, self.tasks) / self.n)
        self.sd = np.where(sd > 1e-12, sd, 1.0)
        self.flat = sd <= 1e-12
        self._times = settle(self.df.filter("e = 1").select("t").distinct())
        self.n_times = self._times.count()

    def fold_counts(self) -> dict[int, tuple[int, int]]:
        rows = self.df.groupBy("f").agg(F.count("*").alias("n"), F.sum("e").alias("d")).collect()
        return {r["f"]: (r["n"], r["d"]) for r in rows}

    def time_blocks(self, lanes: int) -> Iterator[np.ndarray]:
        """Sorted event times, in blocks small enough for one pass (nearly always a single one)."""
        cap = max(PASS_CELLS // (2 * lanes * (self.p + 1)), 64)
        if self.n_times <= cap:
            yield np.sort(np.array([r["t"] for r in self._times.collect()]))
            return
        pieces = -(-self.n_times // cap) * 2
        cuts = sorted(set(self._times.approxQuantile("t", [i / pieces for i in range(1, pieces)], 0.1 / pieces)))
        for lo, hi in zip([float("-inf"), *cuts], [*cuts, float("inf")]):
            part = self._times.filter((F.col("t") > lo) & (F.col("t") <= hi)).collect()
            if part:
                yield np.sort(np.array([r["t"] for r in part]))

    def left_out(self) -> int:
        """Rows that take no part, by one more count of the input."""
        return int(self._every.count() - self.n)

    def release(self) -> None:
        self._kept.unpersist()


@dataclass(frozen=True)
class Lane:
    """One coefficient vector on the standardised scale; rows of fold ``skip`` do not take part."""

    beta: np.ndarray
    skip: int = -2


def _into(out: np.ndarray, slot: np.ndarray, values: np.ndarray) -> None:
    """Add rows of ``values`` to ``out[slot]``."""
    if not len(slot):
        return
    order = np.argsort(slot, kind="stable")
    sorted_ = slot[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    out[sorted_[starts]] += np.add.reduceat(values[order], starts, axis=0)


@dataclass
class Risk:
    """Sums per event time of one lane: at risk (``s0, s1``), events (``d, e0, e1``), and event totals."""

    s0: np.ndarray
    s1: np.ndarray
    d: np.ndarray
    e0: np.ndarray
    e1: np.ndarray
    lp: float
    x: np.ndarray


def _risk_pass(rows: CoxRows, lanes: Sequence[Lane], times: np.ndarray) -> list[Risk]:
    p, k, mean, sd, late = rows.p, len(times), rows.mean, rows.sd, rows.late_entry
    size = (k + 1) * (p + 1) + k * (p + 2) + 1 + p

    betas = np.stack([lane.beta for lane in lanes])
    skips = np.array([lane.skip for lane in lanes])

    def kernel(batches):
        out = np.zeros((len(lanes), size))
        cut = (k + 1) * (p + 1)
        risk = out[:, :cut].reshape(len(lanes), k + 1, p + 1)
        hit = out[:, cut:cut + k * (p + 2)].reshape(len(lanes), k, p + 2)
        for b in batches:
            t = numbers(b.column(0))
            if not len(t):
                continue
            order = np.argsort(t, kind="stable")  # one sort serves all lanes
            t, s, e, f = t[order], *(numbers(b.column(i))[order] for i in (1, 2, 3))
            z = ((matrix(b.column(4), p) - mean) / sd)[order]
            stop = np.searchsorted(times, t, side="right")
            ev = np.flatnonzero((e == 1) & (stop > 0) & (times[np.maximum(stop - 1, 0)] == t))
            on = f[:, None] != skips[None, :]
            lp = z @ betas.T
            r = np.exp(lp) * on
            entry = np.searchsorted(times, s, side="right") if late else None
            slots, starts = np.unique(stop, return_index=True)
            ev_slots, ev_starts = np.unique(stop[ev] - 1, return_index=True)
            for j in range(len(lanes)):
                cells = np.column_stack([r[:, j], r[:, j, None] * z])
                risk[j, slots] += np.add.reduceat(cells, starts, axis=0)
                if late:
                    _into(risk[j], entry, -cells)
                if len(ev):
                    here = on[ev, j].astype(float)
                    hit[j, ev_slots] += np.add.reduceat(np.column_stack([here, cells[ev]]), ev_starts, axis=0)
                    out[j, -p - 1] += lp[ev, j] @ here
                    out[j, -p:] += here @ z[ev]
        return out.ravel()

    flat = tree_sum(rows.df, kernel, rows.tasks, len(lanes) * size).reshape(len(lanes), size)
    found = []
    for row in flat:
        cut = (k + 1) * (p + 1)
        risk = row[:cut].reshape(k + 1, p + 1)
        hit = row[cut:cut + k * (p + 2)].reshape(k, p + 2)
        # At risk at time k: rows whose stop slot lies above k, less those that enter above it.
        later = risk[::-1].cumsum(0)[::-1][1:]
        found.append(Risk(later[:, 0], later[:, 1:], hit[:, 0], hit[:, 1], hit[:, 2:], row[-p - 1], row[-p:]))
    return found


@dataclass
class TieSums:
    """Per event time, sums over its tie steps of powers of ``c/D`` and ``1/D``, and of ``log D``."""

    log: np.ndarray
    u: np.ndarray
    v: np.ndarray
    w0: np.ndarray
    w1: np.ndarray
    w2: np.ndarray


def tie_sums(s0: np.ndarray, e0: np.ndarray, d: np.ndarray, ties: str) -> TieSums:
    """With ``D = s0 - c*e0`` and ``c = l/d`` for ``l < d`` (Efron); ``c = 0`` throughout for Breslow."""
    k = len(d)
    zero = np.zeros(k)
    live = d > 0
    if ties == "breslow":
        safe = np.where(live, s0, 1.0)
        return TieSums(np.where(live, d * np.log(safe), 0), np.where(live, d / safe, 0), zero,
                       np.where(live, d / safe**2, 0), zero, zero)
    out = TieSums(*(zero.copy() for _ in range(6)))
    few = live & (d <= DIRECT_TIES)
    if few.any():
        which = np.flatnonzero(few)
        reps = d[which].astype(int)
        at = np.repeat(which, reps)
        c = (np.arange(reps.sum()) - np.repeat(reps.cumsum() - reps, reps)) / np.repeat(reps, reps)
        den = s0[at] - c * e0[at]
        for name, value in (("log", np.log(den)), ("u", 1 / den), ("v", c / den),
                            ("w0", den**-2.0), ("w1", c / den**2), ("w2", c * c / den**2)):
            setattr(out, name, np.bincount(at, value, minlength=k))
    many = np.flatnonzero(live & ~few)
    if many.size:
        dd, s, e = d[many], s0[many], e0[many]
        y = dd * s / e
        scale = dd / e
        out.log[many] = dd * np.log(e / dd) + lgamma(y + 1) - lgamma(y - dd + 1)
        out.u[many] = scale * (digamma(y + 1) - digamma(y - dd + 1))
        out.w0[many] = scale**2 * (trigamma(y - dd + 1) - trigamma(y + 1))
        out.v[many] = (s * out.u[many] - dd) / e
        out.w1[many] = (s * out.w0[many] - out.u[many]) / e
        out.w2[many] = (s * s * out.w0[many] - 2 * s * out.u[many] + dd) / e**2
    return out


@dataclass
class Step:
    """Log likelihood and gradient of a lane, plus what the curvature pass needs per time block."""

    loglik: float
    gradient: np.ndarray
    blocks: list = field(default_factory=list)


def likelihood(rows: CoxRows, lanes: Sequence[Lane], ties: str = "efron") -> list[Step]:
    """Log partial likelihood and its gradient for several lanes in one scan per time block."""
    steps = [Step(0.0, np.zeros(rows.p)) for _ in lanes]
    for times in rows.time_blocks(len(lanes)):
        for step, r in zip(steps, _risk_pass(rows, lanes, times)):
            sums = tie_sums(r.s0, r.e0, r.d, ties)
            step.loglik += r.lp - sums.log.sum()
            step.gradient += r.x - (sums.u @ r.s1 - sums.v @ r.e1)
            outer = r.s1.T @ (sums.w0[:, None] * r.s1)
            if ties != "breslow":
                cross = r.s1.T @ (sums.w1[:, None] * r.e1)
                outer += r.e1.T @ (sums.w2[:, None] * r.e1) - cross - cross.T
            step.blocks.append((times, sums.u, sums.v, outer))
    return steps


def information(rows: CoxRows, lanes: Sequence[Lane], steps: Sequence[Step]) -> list[np.ndarray]:
    """Observed information per lane: one weighted cross product of the rows, less the sums per time."""
    p, mean, sd, late = rows.p, rows.mean, rows.sd, rows.late_entry
    total = np.zeros((len(lanes), p, p))
    for block in range(len(steps[0].blocks)):
        times = steps[0].blocks[block][0]
        ups = [np.r_[0.0, s.blocks[block][1].cumsum()] for s in steps]
        downs = [s.blocks[block][2] for s in steps]

        def kernel(batches, times=times, ups=ups, downs=downs):
            out = np.zeros((len(lanes), p, p))
            for b in batches:
                t, s, e, f = (numbers(b.column(i)) for i in range(4))
                z = (matrix(b.column(4), p) - mean) / sd
                stop = np.searchsorted(times, t, side="right")
                entry = np.searchsorted(times, s, side="right") if late else 0
                own = np.maximum(stop - 1, 0)
                hit = (e == 1) & (stop > 0) & (times[own] == t)
                for j, lane in enumerate(lanes):
                    w = ups[j][stop] - ups[j][entry] - np.where(hit, downs[j][own], 0.0)
                    w = w * np.exp(z @ lane.beta) * (f != lane.skip)
                    out[j] += z.T @ (w[:, None] * z)
            return out.ravel()

        total += tree_sum(rows.df, kernel, rows.tasks, total.size).reshape(total.shape)
        for j, s in enumerate(steps):
            total[j] -= s.blocks[block][3]
    return list(total)


# --- fit ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class CoxModel:
    columns: tuple[DesignColumn, ...]
    beta: np.ndarray
    variance: np.ndarray
    mean: np.ndarray
    loglik_null: float
    loglik: float
    n: int
    n_event: int
    iterations: int
    converged: bool
    x: str
    surv: SurvSpec
    ties: str

    def coefficients(self, spark: SparkSession) -> DataFrame:
        se = np.sqrt(np.clip(np.diag(self.variance), 0, None))
        rows = [(c.name, c.variable, c.role, float(b), float(s), float(b / s) if s > 0 else None,
                 normal_two_sided(b / s) if s > 0 else None) for c, b, s in zip(self.columns, self.beta, se)]
        return spark.createDataFrame(
            rows, "term string, variable string, role string, beta double, se double, z double, p double")

    def status(self, spark: SparkSession) -> DataFrame:
        """How the fit ended: ``converged, iterations, loglik, n, n_event``."""
        return spark.createDataFrame([(self.converged, self.iterations, float(self.loglik), self.n, self.n_event)],
                                     "converged boolean, iterations int, loglik double, n long, n_event long")

    def linear_predictor(self, df: DataFrame, name: str = "lp") -> DataFrame:
        """Add ``(x - training means) . beta``."""
        beta, mean, p = self.beta, self.mean, len(self.beta)

        @F.arrow_udf("double")
        def run(x: pa.Array) -> pa.Array:
            return pa.array((matrix(x, p) - mean) @ beta)

        return df.withColumn(name, run.asNondeterministic()(F.col(self.x).cast("array<double>")))

    @property
    def df(self) -> int:
        return int((np.diag(self.variance) > 0).sum())

    def information_criteria(self) -> dict[str, float]:
        """AIC, BIC with the number of events, and R squared scaled by its maximum."""
        ne = self.n_event
        top = 1 - np.exp(2 / ne * (self.loglik_null - self.loglik))
        return {
            "loglik_null": self.loglik_null, "loglik": self.loglik, "df": float(self.df),
            "aic": -2 * self.loglik + 2 * self.df, "bic": -2 * self.loglik + np.log(ne) * self.df,
            "r2_scaled": float(top / (1 - np.exp(2 / ne * self.loglik_null))),
        }


def fit(df: DataFrame, columns: Sequence[DesignColumn], x: str = "x", surv: SurvSpec = SurvSpec(),
        ties: str = "efron", max_iter: int = 20, tol: float = 1e-9, rows: CoxRows | None = None) -> CoxModel:
    """Newton's method with step halving on the complete rows.

    A trial that is worse or not finite is never taken; ``converged`` and ``iterations`` of the model, and its
    ``status`` table, tell how the fit ended.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError("ties must be efron or breslow")
    own = rows is None
    rows = rows or CoxRows(df, x, len(columns), surv)
    beta = np.zeros(rows.p)
    step = likelihood(rows, [Lane(beta)], ties)[0]
    null = step.loglik
    done, n_iter = rows.n_times == 0, 0
    while not done and n_iter < max_iter:
        n_iter += 1
        info = information(rows, [Lane(beta)], [step])[0]
        move = np.linalg.lstsq(info, step.gradient, rcond=1e-12)[0]
        for _ in range(30):
            trial = beta + move
            with np.errstate(over="ignore", invalid="ignore"):
                nxt = likelihood(rows, [Lane(trial)], ties)[0]
            if np.isfinite(nxt.loglik) and nxt.loglik >= step.loglik - 1e-10 * abs(step.loglik):
                break
            move = move / 2
        else:
            break  # no step improves the fit: keep the last one, not converged
        change = nxt.loglik - step.loglik
        beta, step = trial, nxt
        done = abs(change) <= tol * (abs(step.loglik) + tol)
    info = information(rows, [Lane(beta)], [step])[0]
    cov = np.linalg.pinv(info, rcond=1e-12) / np.outer(rows.sd, rows.sd)
    model = CoxModel(
        tuple(columns), np.where(rows.flat, 0.0, beta / rows.sd), cov, rows.mean, null, step.loglik, int(rows.n),
        int(rows.n_event), n_iter, bool(done), x, surv, ties)
    if own:
        rows.release()
    return model


def baseline_hazard(df: DataFrame, lp: str = "lp", surv: SurvSpec = SurvSpec()) -> DataFrame:
    """``time, hazard, cumulative`` at event times: events over the sum of ``exp(lp)`` at risk."""
    from .running import running

    r = F.exp(F.col(lp))
    ends = df.select(F.col(surv.time).cast("double").alias("time"), F.col(surv.event).cast("long").alias("_d"),
                     r.alias("_out"), F.lit(0.0).alias("_in"))
    if surv.start is not None:
        ends = ends.unionByName(df.select(F.col(surv.start).cast("double").alias("time"), F.lit(0).cast("long").alias("_d"),
                                          F.lit(0.0).alias("_out"), r.alias("_in")))
    per_time = settle(ends.groupBy("time").agg(F.sum("_d").alias("_d"), F.sum("_out").alias("_out"), F.sum("_in").alias("_in")))
    # Sums run from the last time down, so small risk sets are not differences of large numbers.
    rows = per_time.count()
    flipped = per_time.withColumn("_back", -F.col("time"))
    run = running(flipped, "_back", sums={"_out": "_left", "_in": "_enter"}, settled=True, at_most=rows)
    at_risk = F.col("_left") - F.col("_enter")
    steps = run.filter("_d > 0").select("time", (F.col("_d") / at_risk).alias("hazard"))
    return running(steps, "time", sums={"hazard": "cumulative"}, at_most=rows)


def with_hazard(df: DataFrame, hazard: DataFrame, surv: SurvSpec = SurvSpec(), name: str = "cumhaz") -> DataFrame:
    """Add the cumulative baseline hazard at each row's own time."""
    from .survival import step_lookup

    falling = hazard.select("time", (-F.col("cumulative")).alias("surv"))
    at = step_lookup(df.select(surv.time), surv.time, falling, before=0.0)
    at = at.select(F.col(surv.time).alias("_ht"), (-F.col("surv")).alias(name))
    return df.join(small_side(at), F.col(surv.time).cast("double") == F.col("_ht"), "left").drop("_ht")


def deviance_residuals(df: DataFrame, hazard: DataFrame, lp: str = "lp", surv: SurvSpec = SurvSpec()) -> DataFrame:
    """Add martingale and deviance residuals."""
    out = with_hazard(df, hazard, surv)
    e = F.col(surv.event)
    m = e - F.col("cumhaz") * F.exp(F.col(lp))
    inside = m + F.when(e == 1, F.log(e - m)).otherwise(0.0)
    return out.withColumn("martingale", m).withColumn(
        "deviance", F.signum(m) * F.sqrt(F.greatest(F.lit(0.0), -2 * inside))).drop("cumhaz")


def coefficient_change(a: pd.DataFrame | DataFrame, b: DataFrame) -> DataFrame:
    """Percent difference of two coefficient tables by ``(lambda, term)``."""
    keys = ["lambda", "term"]
    return a.select(*keys, F.col("beta").alias("_a")).join(b.select(*keys, F.col("beta").alias("_b")), keys, "full").select(
        *keys, F.col("_a").alias("beta_a"), F.col("_b").alias("beta_b"),
        (100 * F.try_divide(F.col("_a") - F.col("_b"), F.col("_b"))).alias("pct"))
