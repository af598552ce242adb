"""Sparse designs and Cox fits over them.

A row holds its non-zero entries only, as sorted places and values. A fit keeps a few numbers per distinct time, in arrays or with very many
times in a Spark table, and one number per column on the driver: risk masses are running sums over the times, and the gradient is a sum of
residuals over non-zero entries. Nothing has the size of rows x columns or times x columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import SMALL_BYTES, settle, small_side
from .blocks import numbers, tree_sum
from .cox import tie_sums
from .linalg import DesignColumn
from .running import running
from .survival import SurvSpec


# --- designs --------------------------------------------------------------------------------

class DesignColumns(Sequence[DesignColumn]):
    """The columns of a design whose last ones are the terms of a Spark table ``_term, place``.

    ``table`` stays distributed; the terms come to the driver only when a column is asked for.
    """

    def __init__(self, first: Sequence[DesignColumn], terms: DataFrame, n_terms: int):
        self.first, self.terms, self.n_terms = list(first), terms, n_terms
        self._all: list[DesignColumn] | None = None

    def __len__(self) -> int:
        return len(self.first) + self.n_terms

    def __getitem__(self, i):
        if self._all is None:
            self._all = self.first + [DesignColumn(r["_term"], r["_term"], None, "text") for r in self.terms.orderBy("place").collect()]
        return self._all[i]

    def table(self) -> DataFrame:
        """``_place, column`` of every column."""
        names = self.terms.select(F.col("place").alias("_place"), F.col("_term").alias("column"))
        return _names(names.sparkSession, self.first).unionByName(names) if self.first else names


def _names(spark: SparkSession, columns: Sequence[DesignColumn]) -> DataFrame:
    return spark.createDataFrame([(i, c.name) for i, c in enumerate(columns)], "_place int, column string")


def _numbered(terms: DataFrame, first: int) -> tuple[DataFrame, int]:
    """The distinct terms with their place in sorted order, counted from ``first``: a range sort, then one offset per partition."""
    ordered = settle(settle(terms.select("term").distinct()).orderBy("term"))
    ids = ordered.select(F.col("term").alias("_term"), F.monotonically_increasing_id().alias("_id"))
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = ids.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    starts = np.cumsum([first, *[r["count"] for r in sizes]])
    offsets = terms.sparkSession.createDataFrame([(r["_part"], int(at)) for r, at in zip(sizes, starts)], "_part long, _start long")
    placed = ids.join(F.broadcast(offsets), part == F.col("_part")).select("_term", (F.col("_start") + within).cast("int").alias("place"))
    return placed, int(starts[-1]) - first


def sparse_design(
    df: DataFrame, numeric: Sequence[str] = (), factors: Mapping[str, Sequence[str]] | None = None,
    terms: DataFrame | None = None, key: str | None = None, name: str = "x",
) -> tuple[DataFrame, Sequence[DesignColumn]]:
    """Add a column of non-zero entries, ``array<struct<place, value>>`` sorted by place, and list the design's columns.

    Numeric columns come first, then dummies of all levels but the first, then one column per distinct term of ``terms`` (``key, term,
    value``), in sorted order; rows without terms have none. A null covariate stays as a null entry. An unknown level has no dummy, like the
    reference. The terms' vocabulary is numbered in Spark and stays there: with ``terms`` the columns are ``DesignColumns``.
    """
    columns, cells = [], []
    cell = lambda place, value: F.struct(place.cast("int").alias("place"), value.cast("double").alias("value"))
    for c in numeric:
        cells.append(cell(F.lit(len(columns)), F.col(c)))
        columns.append(DesignColumn(c, c))
    for f, levels in (factors or {}).items():
        places = {level: len(columns) + i for i, level in enumerate(levels[1:])}
        columns += [DesignColumn(f"{f}={level}", f, level) for level in levels[1:]]
        if places:
            at = F.try_element_at(F.create_map(*[F.lit(v) for pair in places.items() for v in pair]), F.col(f))
            cells.append(F.when(F.col(f).isNull(), cell(F.lit(min(places.values())), F.lit(None))).otherwise(cell(at, F.lit(1.0))))
    entries = F.filter(F.array(*cells), lambda e: e["place"].isNotNull() & (e["value"].isNull() | (e["value"] != 0))) if cells else F.array().cast("array<struct<place:int,value:double>>")
    if terms is None:
        return df.withColumn(name, entries), columns
    placed, n_terms = _numbered(terms, len(columns))
    numbered = small_side(placed)
    value = next(c for c in terms.columns if c not in (key, "term"))
    own = (
        terms.where(F.col(value) != 0).join(numbered, F.col("term") == F.col("_term"))
        .groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(cell(F.col("place"), F.col(value)))).alias("_terms"))
    )
    joined = df.join(own, F.col(key) == F.col("_key"), "left")
    none = F.array().cast("array<struct<place:int,value:double>>")
    return joined.withColumn(name, F.concat(entries, F.coalesce("_terms", none))).drop("_key", "_terms"), DesignColumns(columns, numbered, n_terms)


def sparse_entries(df: DataFrame, key: str, columns: Sequence[DesignColumn], x: str = "x") -> DataFrame:
    """The design as a table of coordinates: ``key, column, value``, one row per non-zero entry."""
    names = columns.table() if isinstance(columns, DesignColumns) else _names(df.sparkSession, columns)
    flat = df.select(key, F.inline(x))
    return flat.join(small_side(names), F.col("place") == F.col("_place")).select(key, "column", "value")


# --- rows of a fit --------------------------------------------------------------------------

def _flat(entries: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of each entry of a batch."""
    flat = entries.flatten()
    row = np.repeat(np.arange(len(entries)), np.diff(entries.offsets.to_numpy()))
    return row, flat.field("place").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False)


def _scores(entries: pa.Array, weights: np.ndarray) -> np.ndarray:
    row, place, value = _flat(entries)
    return np.bincount(row, value * weights[place], minlength=len(entries))


def score_column(x: str, weights: np.ndarray) -> Column:
    """``x . weights`` over the non-zero entries of a row."""
    @F.arrow_udf("double")
    def run(entries: pa.Array) -> pa.Array:
        return pa.array(_scores(entries, weights))

    return run.asNondeterministic()(F.col(x))


# Up to this many distinct times a task adds up its rows per time in arrays; beyond, the times are a Spark table.
DENSE_TIMES = 1 << 16
PACKED = "n int, t binary, s binary, e binary, size binary, place binary, value binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``t, s, e, x`` as one row of plain arrays each, so that later passes convert nothing row by row."""
    for b in batches:
        _, place, value = _flat(b.column(3))
        arrays = (numbers(b.column(0)), numbers(b.column(1)), numbers(b.column(2)), np.diff(b.column(3).offsets.to_numpy()).astype(np.int32),
                  place.astype(np.int32, copy=False), value.astype(float, copy=False))
        cells = [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), *cells], names=[f.split()[0] for f in PACKED.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """``t, s, e`` of the rows of each packed block, then row, place and value of its entries."""
    for b in batches:
        for i in range(b.num_rows):
            t, s, e, size, place, value = (np.frombuffer(b.column(k)[i].as_buffer(), dtype)
                                           for k, dtype in enumerate((float, float, float, np.int32, np.int32, float), 1))
            yield t, s, e, np.repeat(np.arange(len(t)), size), place, value


class SparseRows:
    """The complete rows of a fit, ``t, s, e, x``; rows with a null or not-a-number time, event or entry take no part.

    They are kept as packed blocks. Only with more than ``DENSE_TIMES`` distinct times are they kept as rows, ``df``, which are joined with a table
    of times.
    """

    def __init__(self, df: DataFrame, x: str, width: int, surv: SurvSpec = SurvSpec()):
        self.p, self.late = width, surv.start is not None
        rows = df.select(
            F.col(surv.time).cast("double").alias("t"), (F.col(surv.start).cast("double") if self.late else F.lit(0.0)).alias("s"),
            F.col(surv.event).cast("int").alias("e"), F.col(x).alias("x"))
        bad = F.isnan("t") | F.isnan("s") | F.exists("x", lambda c: c["value"].isNull() | F.isnan(c["value"]))
        self.df = rows.where(F.col("t").isNotNull() & F.col("s").isNotNull() & F.col("e").isNotNull() & F.col("x").isNotNull() & ~bad)
        self.blocks = self.df.mapInArrow(_pack, PACKED).persist(StorageLevel.MEMORY_AND_DISK)
        p, late = width, self.late

        def moments(batches):
            out = np.zeros(3 + 2 * p)
            out[-1] = 1.0
            for t, _, e, _, place, value in _blocks(batches):
                out[0] += len(t)
                out[1] += e.sum()
                out[2:2 + p] += np.bincount(place, value, minlength=p)
                out[2 + p:-1] += np.bincount(place, value * value, minlength=p)
            return out

        sums = tree_sum(self.blocks, moments, cells=3 + 2 * p)
        if sums is None or sums[0] == 0:
            raise ValueError("no rows to fit")
        self.n, self.n_event, self.tasks = int(sums[0]), int(sums[1]), int(sums[-1])
        sd = np.sqrt(np.maximum(sums[2 + p:-1] / self.n - (sums[2:2 + p] / self.n) ** 2, 0))
        self.flat = sd <= 1e-12
        self.sd = np.where(self.flat, 1.0, sd)

        def marks(batches):
            for t, s, *_ in _blocks(batches):
                yield pa.RecordBatch.from_pydict({"t": np.unique(np.concatenate([t, s]) if late else t)})

        times = settle(self.blocks.mapInArrow(marks, "t double").distinct())
        self.n_times = times.count()
        self.times = np.sort(times.toArrow()["t"].to_numpy()) if self.n_times <= DENSE_TIMES else None
        if self.times is None:
            self.blocks.unpersist()
            self.df = self.df.persist(StorageLevel.MEMORY_AND_DISK)

    def _dense_likelihood(self, weights: np.ndarray, ties: str) -> tuple[float, np.ndarray]:
        """Value and gradient by two passes over the blocks, with sums per time in arrays."""
        times, p, late, k = self.times, self.p, self.late, len(self.times)

        def masses(batches):
            out = np.zeros((4, k))
            elp = 0.0
            for t, s, e, row, place, value in _blocks(batches):
                lp = np.bincount(row, value * weights[place], minlength=len(t))
                r, at = np.exp(lp), np.searchsorted(times, t)
                elp += e @ lp
                for i, w in enumerate((e, r, e * r)):
                    out[i] += np.bincount(at, w, minlength=k)
                if late:
                    out[3] += np.bincount(np.searchsorted(times, s), r, minlength=k)
            return np.r_[out.ravel(), elp]

        flat = tree_sum(self.blocks, masses, self.tasks, 4 * k + 1)
        d, out, e0, into = flat[:-1].reshape(4, k)
        sums = tie_sums((out[::-1].cumsum() - into[::-1].cumsum())[::-1], e0, d, ties)
        upto, v = sums.u.cumsum(), sums.v

        def kernel(batches):
            total = np.zeros(p)
            for t, s, e, row, place, value in _blocks(batches):
                mass, at = np.exp(np.bincount(row, value * weights[place], minlength=len(t))), np.searchsorted(times, t)
                w = upto[at] - e * v[at] - (upto[np.searchsorted(times, s)] if late else 0.0)
                total += np.bincount(place, value * (e - mass * w)[row], minlength=p)
            return total

        return float(flat[-1] - sums.log.sum()), tree_sum(self.blocks, kernel, self.tasks, p)

    def likelihood(self, beta: np.ndarray, ties: str = "efron") -> tuple[float, np.ndarray]:
        """Log partial likelihood and gradient at coefficients on unit scale, by a fixed number of passes.

        With ``U`` the running sum over event times of one over the mass at risk, the gradient is the sum of ``(e - exp(lp) (U(t) - U(s) - e v)) x``, where
        ``v`` is the share that ties at the own time give back.
        """
        weights = np.where(self.flat, 0.0, beta / self.sd)
        if self.times is not None:
            value, gradient = self._dense_likelihood(weights, ties)
            return value, np.where(self.flat, 0.0, gradient / self.sd)
        r, e = F.col("r"), F.col("e").cast("double")
        scored = self.df.withColumn("lp", score_column("x", weights)).select("t", "s", "e", "lp", F.exp("lp").alias("r"))
        zero = F.lit(0.0)
        if self.late:
            scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
        ends = scored.select(F.col("t").alias("time"), e.alias("d"), r.alias("out"), (e * r).alias("e0"), (e * F.col("lp")).alias("elp"), zero.alias("in"))
        if self.late:
            ends = ends.unionByName(scored.select(F.col("s").alias("time"), zero.alias("d"), zero.alias("out"), zero.alias("e0"), zero.alias("elp"), r.alias("in")))
        at = ends.groupBy("time").agg(*[F.sum(c).alias(c) for c in ("d", "out", "e0", "elp", "in")]).withColumn("_back", -F.col("time"))
        at = running(at, "_back", sums={"out": "left", "in": "entered"}, at_most=self.n_times)

        @F.pandas_udf("array<double>")
        def shares(s0: pd.Series, e0: pd.Series, d: pd.Series) -> pd.Series:
            sums = tie_sums(s0.to_numpy(), e0.to_numpy(), d.to_numpy(), ties)
            return pd.Series(list(np.stack([sums.log, sums.u, sums.v], axis=1)))

        at = at.withColumn("sums", shares.asNondeterministic()(F.col("left") - F.col("entered"), "e0", "d"))
        at = at.select("time", "elp", F.col("sums")[0].alias("log"), F.col("sums")[1].alias("u"), F.col("sums")[2].alias("v"))
        at = settle(running(at, "time", sums={"u": "upto"}, at_most=self.n_times))
        value = at.agg(F.sum("elp") - F.sum("log")).first()[0]
        table = at.select("time", "upto", "v")
        table = F.broadcast(table) if 64 * self.n_times <= SMALL_BYTES else table  # the times are counted, a row takes less
        joined = self.df.join(table, F.col("t") == F.col("time")).select("e", "x", "v", "upto", *(["s"] if self.late else []))
        if self.late:
            joined = joined.join(table.select(F.col("time").alias("_s"), F.col("upto").alias("before")), F.col("s") == F.col("_s")).select("e", "x", "v", "upto", "before")
        p, late = self.p, self.late

        def kernel(batches):
            out = np.zeros(p)
            for b in batches:
                hit, v, upto = (numbers(b.column(i)) for i in (0, 2, 3))
                row, place, entry = _flat(b.column(1))
                mass = np.exp(np.bincount(row, entry * weights[place], minlength=b.num_rows))
                w = upto - hit * v - (numbers(b.column(4)) if late else 0.0)
                out += np.bincount(place, entry * (hit - mass * w)[row], minlength=p)
            return out

        gradient = tree_sum(joined, kernel, cells=p)
        if self.late:
            scored.unpersist()
        return float(value), np.where(self.flat, 0.0, gradient / self.sd)

    def release(self) -> None:
        self.blocks.unpersist()
        self.df.unpersist()


# --- fit ------------------------------------------------------------------------------------

def minimise(value_of: Callable[[np.ndarray], tuple[float, np.ndarray]], width: int, l1: float = 0.0, max_iter: int = 100,
             tol: float = 1e-7, memory: int = 10) -> tuple[np.ndarray, float, int, bool]:
    """Least of a smooth convex function plus ``l1`` times the absolute sum: limited-memory quasi-Newton steps inside an orthant.

    Only vectors of the given width are kept. Converged means that no coordinate of the (pseudo) gradient is above ``tol``.
    """
    x = np.zeros(width)
    f, g = value_of(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []

    def pseudo(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        at_zero = np.where(g + l1 < 0, g + l1, np.where(g - l1 > 0, g - l1, 0.0))
        return np.where(x != 0, g + l1 * np.sign(x), at_zero)

    total, pg = f + l1 * np.abs(x).sum(), pseudo(x, g)
    for it in range(max_iter):
        if np.abs(pg).max(initial=0.0) <= tol:
            return x, f, it, True
        q, back = pg.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (y @ s)
            back.append(a)
            q -= a * y
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(np.linalg.norm(pg), 1.0)
        for (s, y), a in zip(steps, reversed(back)):
            q += s * (a - (y @ q) / (y @ s))
        move = -np.where(q * pg > 0, q, 0.0) if l1 else -q
        if move @ pg >= 0:
            move, steps = -pg, []
        side = np.where(x != 0, np.sign(x), -np.sign(pg))
        for half in range(30):
            trial = x + move * 0.5**half
            trial = np.where(trial * side > 0, trial, 0.0) if l1 else trial
            with np.errstate(over="ignore", invalid="ignore"):
                f2, g2 = value_of(trial)
            total2 = f2 + l1 * np.abs(trial).sum()
            if np.isfinite(total2) and total2 <= total + 1e-4 * (pg @ (trial - x)):
                break
        else:
            return x, f, it, False
        s, y = trial - x, g2 - g
        if s @ y > 1e-12 * (s @ s):
            steps = [*steps[-memory + 1:], (s, y)]
        x, f, g, total = trial, f2, g2, total2
        pg = pseudo(x, g)
    return x, f, max_iter, bool(np.abs(pg).max(initial=0.0) <= tol)


@dataclass(frozen=True)
class SparseCox:
    columns: tuple[DesignColumn, ...]
    beta: np.ndarray
    loglik_null: float
    loglik: float
    n: int
    n_event: int
    iterations: int
    converged: bool
    x: str

    def coefficients(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.name, c.variable, c.role, float(b)) for c, b in zip(self.columns, self.beta)],
                                     "term string, variable string, role string, beta double")

    def linear_predictor(self, df: DataFrame, name: str = "lp") -> DataFrame:
        """Add ``x . beta``; a shift of all rows changes no score."""
        return df.withColumn(name, score_column(self.x, self.beta))


def fit_sparse(df: DataFrame, columns: Sequence[DesignColumn], x: str = "x", surv: SurvSpec = SurvSpec(), lam: float = 0.0,
               alpha: float = 0.0, ties: str = "efron", max_iter: int = 100, tol: float = 1e-7) -> SparseCox:
    """Cox model over a sparse design: the greatest ``2 / n`` of the log partial likelihood less
    ``lam (alpha |b| + (1 - alpha) b^2 / 2)``, coefficients on unit scale. Columns without spread get 0."""
    if ties not in ("efron", "breslow"):
        raise ValueError("ties must be efron or breslow")
    rows = SparseRows(df, x, len(columns), surv)
    ridge = lam * (1 - alpha)
    seen: list[float] = []

    def value_of(beta: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = rows.likelihood(beta, ties)
        seen.append(value)
        return -2 / rows.n * value + ridge * (beta @ beta) / 2, -2 / rows.n * gradient + ridge * beta

    try:
        beta, least, n_iter, done = minimise(value_of, rows.p, lam * alpha, max_iter, tol)
    finally:
        rows.release()
    loglik = -(least - ridge * (beta @ beta) / 2) * rows.n / 2
    return SparseCox(tuple(columns), np.where(rows.flat, 0.0, beta / rows.sd), seen[0], loglik, rows.n, rows.n_event, n_iter, done, x)
