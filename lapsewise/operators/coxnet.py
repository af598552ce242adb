"""Elastic-net Cox paths, cross-validation, selection and refit.

Objective on standardised columns: ``-(2/n) loglik + lambda * (alpha * |b|_1 + (1 - alpha)/2 * |b|_2^2)``.
All folds, and as many lambdas as fit, run side by side: one scan gives the gradients of all their own
coefficients, another their curvature; the penalised quadratic problems are solved on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_side
from . import cox, metrics, pairs
from .blocks import matrix, numbers, tree_sum
from .cox import CoxRows, Lane, tie_sums
from .linalg import DesignColumn
from .survival import SurvSpec


# --- penalised quadratic --------------------------------------------------------------------

def coordinate_descent(q: np.ndarray, g: np.ndarray, beta: np.ndarray, lam: float, alpha: float,
                       frozen: np.ndarray, tol: float = 1e-9, sweeps: int = 500) -> np.ndarray:
    """Minimise ``1/2 d'qd - g'd + penalty(beta + d)`` over the new ``beta + d``."""
    b, diag = beta.copy(), np.diag(q)
    slope = g.copy()  # gradient of the smooth part at the current b
    l1, l2 = lam * alpha, lam * (1 - alpha)
    every = np.flatnonzero(~frozen & (diag > 1e-14))
    active = every
    for _ in range(sweeps):
        most = 0.0
        for j in active:
            z = slope[j] + diag[j] * b[j]
            new = np.sign(z) * max(abs(z) - l1, 0.0) / (diag[j] + l2)
            move = new - b[j]
            if move != 0.0:
                slope -= q[:, j] * move
                b[j] = new
                most = max(most, diag[j] * move * move)
        if most < tol:
            if active is every:
                break
            active = every
        else:
            active = every[b[every] != 0] if active is every else active
    return b


# --- path -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class CrossValidation:
    measure: str
    mean: np.ndarray
    se: np.ndarray
    lambda_min: float
    lambda_1se: float


@dataclass(frozen=True)
class CoxPath:
    columns: tuple[DesignColumn, ...]
    lambdas: np.ndarray
    betas: np.ndarray
    status: tuple[str, ...]
    alpha: float
    x: str
    surv: SurvSpec
    cv: CrossValidation | None = None

    def resolve(self, lam: float | str) -> float:
        if isinstance(lam, str):
            if self.cv is None:
                raise ValueError("this path has no cross-validation")
            return {"lambda.min": self.cv.lambda_min, "lambda.1se": self.cv.lambda_1se}[lam]
        return float(lam)

    def beta_at(self, lam: float | str) -> np.ndarray:
        """Coefficients at a grid value, or between two by linear interpolation."""
        at = self.resolve(lam)
        order = np.argsort(self.lambdas)
        return np.array([np.interp(at, self.lambdas[order], self.betas[order, j]) for j in range(self.betas.shape[1])])

    def coefficients(self, spark: SparkSession, lam: float | str | None = None) -> DataFrame:
        grid = [(float(v), b) for v, b in zip(self.lambdas, self.betas)] if lam is None else [
            (self.resolve(lam), self.beta_at(lam))]
        rows = [(v, c.name, c.variable, c.level, c.role, float(x)) for v, b in grid for c, x in zip(self.columns, b)]
        return spark.createDataFrame(
            rows, "lambda double, term string, variable string, level string, role string, beta double")

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per lambda: non-zero count, status, and the cross-validated score when there is one."""
        cv = self.cv
        rows = [(float(v), int((b != 0).sum()), s, float(cv.mean[i]) if cv else None, float(cv.se[i]) if cv else None)
                for i, (v, b, s) in enumerate(zip(self.lambdas, self.betas, self.status))]
        return spark.createDataFrame(rows, "lambda double, n_nonzero int, status string, cv_mean double, cv_se double")


def lambda_grid(top: float, n: int, p: int, n_lambda: int, min_ratio: float | None) -> np.ndarray:
    ratio = min_ratio if min_ratio is not None else (1e-4 if n > p else 1e-2)
    return top * ratio ** (np.arange(n_lambda) / max(n_lambda - 1, 1))


@dataclass
class _Fit:
    """One lane at one lambda: its rows, its likelihood at the current coefficients, a curvature near them."""

    lane: Lane
    n: float
    step: cox.Step
    curve: np.ndarray
    lam: float = 0.0
    done: bool = False

    def objective(self, step: cox.Step, beta: np.ndarray, alpha: float) -> float:
        return -2 / self.n * step.loglik + self.lam * (alpha * np.abs(beta).sum() + (1 - alpha) / 2 * (beta @ beta))


def _solve(rows: CoxRows, fits: list[_Fit], alpha: float, ties: str, max_iter: int, tol: float) -> None:
    """Bring all fits to their optimum together: one scan serves the folds of every lambda in the block."""
    active = fits
    for turn in range(max_iter):
        if turn % 2 == 1:
            for f, c in zip(active, cox.information(rows, [f.lane for f in active], [f.step for f in active])):
                f.curve = c
        moved = {}
        for i, f in enumerate(active):
            q = 2 / f.n * f.curve
            b = coordinate_descent(q, 2 / f.n * f.step.gradient, f.lane.beta, f.lam, alpha, rows.flat, min(1e-9, tol / 100))
            f.done = float((np.diag(q) * (b - f.lane.beta) ** 2).max()) < tol
            if not f.done:
                moved[i] = b
        active, trials = [active[i] for i in moved], list(moved.values())
        if not active:
            return
        for _ in range(20):
            with np.errstate(over="ignore", invalid="ignore"):
                steps = cox.likelihood(rows, [replace(f.lane, beta=b) for f, b in zip(active, trials)], ties)
            worse = [not np.isfinite(s.loglik) or f.objective(s, b, alpha) > f.objective(f.step, f.lane.beta, alpha) + 1e-10
                     for f, s, b in zip(active, steps, trials)]
            if not any(worse):
                break
            trials = [(b + f.lane.beta) / 2 if w else b for f, b, w in zip(active, trials, worse)]
        for f, s, b in zip(active, steps, trials):
            f.lane, f.step = replace(f.lane, beta=b), s


def path(
    df: DataFrame, columns: Sequence[DesignColumn], x: str = "x", surv: SurvSpec = SurvSpec(), alpha: float = 0.95,
    lambdas: Sequence[float] | None = None, n_lambda: int = 100, min_ratio: float | None = None, max_iter: int = 25,
    fold: str | None = None, measure: str | None = None, ties: str = "breslow", tol: float = 1e-7,
) -> CoxPath:
    """Fit the path; with a ``fold`` column and a ``measure`` (``C`` or ``loglik``) also cross-validate it."""
    return paths(df, columns, (measure,), x, surv, alpha, lambdas, n_lambda, min_ratio, max_iter, fold, ties, tol)[0]


def paths(
    df: DataFrame, columns: Sequence[DesignColumn], measures: Sequence[str | None], x: str = "x", surv: SurvSpec = SurvSpec(), alpha: float = 0.95,
    lambdas: Sequence[float] | None = None, n_lambda: int = 100, min_ratio: float | None = None, max_iter: int = 25,
    fold: str | None = None, ties: str = "breslow", tol: float = 1e-7,
) -> list[CoxPath]:
    """The path cross-validated by each measure. The fits of a path and of its folds know nothing of the measure, so they are made once."""
    for measure in measures:
        if measure not in (None, "C", "loglik") or (measure and fold is None):
            raise ValueError("measure must be C or loglik, and needs a fold column")
    measure = next((m for m in measures if m), None)
    rows = CoxRows(df, x, len(columns), surv, fold if measure else None)
    counts = rows.fold_counts() if measure else {}
    skips = [-2, *sorted(counts)]
    sizes = np.array([rows.n, *[rows.n - counts[k][0] for k in sorted(counts)]], dtype=float)
    lanes = [Lane(np.zeros(rows.p), s) for s in skips]
    steps = cox.likelihood(rows, lanes, ties)
    if lambdas is None:
        top = np.abs(2 / rows.n * steps[0].gradient[~rows.flat]).max() / max(alpha, 1e-3)
        lambdas = lambda_grid(top, rows.n, rows.p, n_lambda, min_ratio)
    else:
        lambdas = np.sort(np.asarray(lambdas, dtype=float))[::-1]
    fits = [_Fit(lane, n, step, curve)
            for lane, n, step, curve in zip(lanes, sizes, steps, cox.information(rows, lanes, steps))]
    # a lane brings sums per event time and a cross product
    cells = max(2 * max(rows.n_times, 1) * (rows.p + 1), rows.p * rows.p)
    width = max(1, cox.PASS_CELLS // (len(fits) * cells))
    kept, status = [], []
    for start in range(0, len(lambdas), width):
        block = [[replace(f, lam=float(lam)) for f in fits] for lam in lambdas[start:start + width]]
        _solve(rows, [f for group in block for f in group], alpha, ties, max_iter, tol)
        for group in block:
            kept.append([f.lane.beta for f in group])
            status.append("converged" if all(f.done for f in group) else "max_iter")
        fits = [replace(f, done=False) for f in block[-1]]
    betas = np.array(kept)  # lambda x lane x column, standardised
    out = CoxPath(tuple(columns), np.asarray(lambdas), betas[:, 0] / rows.sd, tuple(status), alpha, x, surv)
    found = []
    for measure in measures:
        if measure:
            folds = sorted(counts)
            score = _cv_loglik if measure == "loglik" else _cv_concordance
            raw, weights = score(rows, betas[:, 1:], folds, counts, ties)
            found.append(replace(out, cv=_choose(np.asarray(lambdas), raw, weights, measure)))
        else:
            found.append(out)
    rows.release()
    return found


# --- cross-validation -----------------------------------------------------------------------

def _choose(lambdas: np.ndarray, raw: np.ndarray, weights: np.ndarray, measure: str) -> CrossValidation:
    """Weighted mean and standard error over folds; best lambda, and the largest within one error of it.

    A fold whose score is not a number counts in neither; a lambda without any is never chosen.
    """
    known = ~np.isnan(raw)
    w = known * weights
    w = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
    filled = np.where(known, raw, 0.0)
    mean = np.where(known.any(axis=1), (filled * w).sum(axis=1), np.nan)
    se = np.sqrt((np.where(known, filled - mean[:, None], 0.0) ** 2 * w).sum(axis=1) / np.maximum(known.sum(axis=1) - 1, 1))
    better = np.nan_to_num(-mean if measure == "C" else mean, nan=np.inf)
    best = int(np.lexsort((-lambdas, better))[0])
    near = better <= better[best] + se[best]
    return CrossValidation(measure, mean, se, float(lambdas[best]), float(lambdas[near].max()))


def _cv_loglik(rows: CoxRows, betas: np.ndarray, folds, counts, ties):
    """Deviance per held-out event: full log likelihood less that of the training folds, at the fold's coefficients."""
    n_lambda, k, p = betas.shape
    flat = betas.transpose(1, 0, 2).reshape(k * n_lambda, p)
    fold_of = np.repeat(folds, n_lambda)
    diff = (loglik_only(rows, flat, np.full(len(flat), -2), ties) - loglik_only(rows, flat, fold_of, ties))
    events = np.array([counts[f][1] for f in folds], dtype=float)
    raw = -2 * diff.reshape(k, n_lambda).T / np.maximum(events, 1)
    return raw, events


def loglik_only(rows: CoxRows, betas: np.ndarray, skip: np.ndarray, ties: str) -> np.ndarray:
    """Log partial likelihood of many coefficient vectors in one scan; rows of fold ``skip`` are left out."""
    m, mean, sd, p, late = len(betas), rows.mean, rows.sd, rows.p, rows.late_entry
    out = np.zeros(m)
    for times in rows.time_blocks(max(1, 3 * m // (2 * (p + 1)) + 1)):
        k = len(times)

        def kernel(batches, times=times, k=k):
            risk, hit, ties_, lp_sum = np.zeros((k + 1, m)), np.zeros((k, m)), np.zeros((k, m)), np.zeros(m)
            for b in batches:
                t, s, e, f = (numbers(b.column(i)) for i in range(4))
                lp = ((matrix(b.column(4), p) - mean) / sd) @ betas.T
                on = f[:, None] != skip[None, :]
                r = np.exp(lp) * on
                stop = np.searchsorted(times, t, side="right")
                cox._into(risk, stop, r)
                if late:
                    cox._into(risk, np.searchsorted(times, s, side="right"), -r)
                ev = (e == 1) & (stop > 0) & (times[np.maximum(stop - 1, 0)] == t)
                cox._into(hit, stop[ev] - 1, r[ev])
                cox._into(ties_, stop[ev] - 1, on[ev].astype(float))
                lp_sum += (lp[ev] * on[ev]).sum(0)
            return np.concatenate([risk.ravel(), hit.ravel(), ties_.ravel(), lp_sum])

        flat = tree_sum(rows.df, kernel, rows.tasks, (3 * k + 2) * m)
        risk = flat[:(k + 1) * m].reshape(k + 1, m)[::-1].cumsum(0)[::-1][1:]
        hit, d = (flat[(k + 1) * m + i * k * m:(k + 1) * m + (i + 1) * k * m].reshape(k, m) for i in (0, 1))
        for j in range(m):
            out[j] += flat[-m + j] - tie_sums(risk[:, j], hit[:, j], d[:, j], ties).log.sum()
    return out


def _cv_concordance(rows: CoxRows, betas: np.ndarray, folds, counts, ties):
    """Concordance of each held-out fold at each lambda, all in one grouped count."""
    n_lambda, k, p = betas.shape
    mean, sd = rows.mean, rows.sd
    place = {f: i for i, f in enumerate(folds)}

    def scores(f: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = (x - mean) / sd
        out = np.empty((len(z), n_lambda))
        for g in np.unique(f):
            at = f == g
            out[at] = z[at] @ betas[:, place[g]].T
        return out

    if rows.n_times <= pairs.PACK_TIMES:
        times = np.sort(np.array([r["t"] for r in rows._times.collect()], dtype=float))
        totals = pairs.score_totals(rows.df.select("t", "e", "f", "x"), lambda b: scores(numbers(b.column(2), int), matrix(b.column(3), p)),
                                    times, {g: int(n) for g, (n, _) in counts.items()})
        c = metrics.with_c_index(totals).select("f", "i", "c_index").collect()
    else:
        @F.pandas_udf("array<double>")
        def scored(x: pd.Series, f: pd.Series) -> pd.Series:
            return pd.Series(list(scores(f.to_numpy(), np.stack(x.to_numpy()))))

        held = rows.df.select("t", "e", "f", scored.asNondeterministic()("x", "f").alias("lp"))
        long = held.select("t", "e", "f", F.posexplode("lp").alias("i", "lp"))
        c = metrics.concordance(long, "lp", SurvSpec("t", "e"), by=["f", "i"], with_se=False).select("f", "i", "c_index").collect()
    raw = np.full((n_lambda, k), np.nan)  # a fold without a usable pair says nothing
    for r in c:
        if r["c_index"] is not None:
            raw[r["i"], place[r["f"]]] = r["c_index"]
    return raw, np.array([counts[f][0] for f in folds], dtype=float)


# --- selection and refit --------------------------------------------------------------------

@dataclass(frozen=True)
class Selection:
    """What a path keeps at one lambda: columns, factor levels that fall to the reference, lost variables."""

    places: tuple[int, ...]
    columns: tuple[DesignColumn, ...]
    merged: Mapping[str, tuple[str, ...]]
    dropped: tuple[str, ...]

    def counts(self) -> dict[str, int]:
        """Kept coefficients by role."""
        text = sum(c.role == "text" for c in self.columns)
        return {"non_text": len(self.columns) - text, "text": text}


def select(path_: CoxPath, lam: float | str = "lambda.1se") -> Selection:
    beta = path_.beta_at(lam)
    kept = [i for i, b in enumerate(beta) if b != 0]
    variables = {path_.columns[i].variable for i in kept}
    merged: dict[str, list[str]] = {}
    for c, b in zip(path_.columns, beta):
        if c.level is not None and b == 0:
            merged.setdefault(c.variable, []).append(c.level)
    lost = tuple(dict.fromkeys(c.variable for c in path_.columns if c.variable not in variables))
    return Selection(tuple(kept), tuple(path_.columns[i] for i in kept), {k: tuple(v) for k, v in merged.items()}, lost)


def zero_nonzero(path_: CoxPath, spark: SparkSession, lam: float | str = "lambda.1se") -> DataFrame:
    return path_.coefficients(spark, lam).withColumn("kept", F.col("beta") != 0)


def merge_levels(df: DataFrame, merged: Mapping[str, Sequence[str]], reference: Mapping[str, str]) -> DataFrame:
    """Levels with a zero coefficient become the reference level, by exact name; use on training and test rows alike."""
    return df.withColumns({
        v: F.when(F.col(v).isin(list(levels)), F.lit(reference[v])).otherwise(F.col(v)) for v, levels in merged.items()
    }) if merged else df


def selection_table(path_: CoxPath, spark: SparkSession, reference: Mapping[str, str], lam: float | str = "lambda.1se") -> DataFrame:
    """What a path decides about factor levels: ``variable, level, target, kept``, one row per dummy; a level that is not kept goes to the reference."""
    rows = [(c.variable, c.level, c.level if b != 0 else reference[c.variable], bool(b != 0))
            for c, b in zip(path_.columns, path_.beta_at(lam)) if c.level is not None]
    return spark.createDataFrame(rows, "variable string, level string, target string, kept boolean")


def recode_selected(df: DataFrame, selection: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Give each factor the targets of a selection, by a join per factor; levels that it does not name stay."""
    for f in factors:
        own = selection.where(F.col("variable") == f).select(F.col("level").alias("_level"), F.col("target").alias("_target"))
        df = df.join(small_side(own), F.col(f) == F.col("_level"), "left").withColumn(f, F.coalesce("_target", f)).drop("_level", "_target")
    return df


def drop_constant_factors(df: DataFrame, factors: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Drop the factors of which a single level, or none, is left, and name them."""
    counts = df.agg(*[F.count_distinct(f).alias(f) for f in factors]).first() if factors else {}
    gone = [f for f in factors if counts[f] <= 1]
    return df.drop(*gone), gone


def keep_columns(df: DataFrame, x: str, width: int, places: Sequence[int], name: str = "x_kept") -> DataFrame:
    """The chosen places of a design array. Dropping a dummy is the same as merging its level into the reference."""
    at = np.array(places, dtype=int)

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        out = matrix(v, width)[:, at]
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, len(at), dtype=np.int32), out.ravel())

    return df.withColumn(name, run.asNondeterministic()(F.col(x).cast("array<double>")))


def refit(path_: CoxPath, train: DataFrame, lam: float | str = "lambda.1se", ties: str = "efron"):
    """Unpenalised Cox model on what the path keeps: ``(model or None, selection)``."""
    chosen = select(path_, lam)
    if not chosen.places:
        return None, chosen
    kept = keep_columns(train, path_.x, len(path_.columns), chosen.places)
    return cox.fit(kept, chosen.columns, "x_kept", path_.surv, ties), chosen


def predict(path_: CoxPath, model: cox.CoxModel | None, chosen: Selection, df: DataFrame, name: str = "lp") -> DataFrame:
    if model is None:
        return df.withColumn(name, F.lit(0.0))
    kept = keep_columns(df, path_.x, len(path_.columns), chosen.places)
    return model.linear_predictor(kept, name).drop("x_kept")


def select_refit_score(path_: CoxPath, train: DataFrame, test: DataFrame, lam: float | str = "lambda.1se",
                       wanted: Sequence[str] = metrics.SCORES):
    """Refit at ``lam``, score on ``test``, and count the kept variables by role."""
    model, chosen = refit(path_, train, lam)
    found = metrics.score(predict(path_, model, chosen, train), predict(path_, model, chosen, test),
                          surv=path_.surv, wanted=wanted)
    return model, found, chosen.counts()


def cv_table(spark: SparkSession, paths: Mapping[str, CoxPath]) -> DataFrame:
    """Cross-validated mean and error at the two chosen lambdas, per model."""
    rows = []
    for name, p in paths.items():
        for which in ("lambda.min", "lambda.1se"):
            lam = p.resolve(which)
            i = int(np.argmin(np.abs(p.lambdas - lam)))
            rows.append((name, which, lam, float(p.cv.mean[i]), float(p.cv.se[i]), int((p.betas[i] != 0).sum())))
    return spark.createDataFrame(rows, "model string, rule string, lambda double, cv_mean double, cv_se double, n_nonzero int")
