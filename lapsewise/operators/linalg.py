"""PCA, design matrices, least squares and collinearity from one-pass Gram sums; exact neighbours by blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import matrix, tree_sum

VECTOR = T.ArrayType(T.DoubleType())


# --- Gram sums ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Gram:
    n: float
    total: np.ndarray
    product: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    def covariance(self, ddof: int = 0) -> np.ndarray:
        c = self.product - np.outer(self.total, self.total) / self.n
        return c / (self.n - ddof)

    def correlation(self) -> np.ndarray:
        c = self.covariance()
        s = np.sqrt(np.diag(c))
        return c / np.outer(s, s)


def width_of(df: DataFrame, col: str) -> int:
    return len(df.select(col).filter(F.col(col).isNotNull()).first()[0])


def gram(df: DataFrame, col: str, width: int | None = None) -> Gram:
    """Row count, column sums and cross products of an array column, in one scan."""
    p = width or width_of(df, col)
    rows = df.select(F.col(col).cast("array<double>").alias("_x")).filter(F.col("_x").isNotNull())

    def kernel(batches):
        n, s, g = 0.0, np.zeros(p), np.zeros((p, p))
        for b in batches:
            x = matrix(b.column(0), p)
            n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        return np.concatenate([[n], s, g.ravel()])

    out = tree_sum(rows, kernel, cells=1 + p + p * p)
    return Gram(out[0], out[1:p + 1], out[p + 1:].reshape(p, p))


def covariance_table(df: DataFrame, col: str, ddof: int = 0) -> DataFrame:
    c = gram(df, col).covariance(ddof)
    i, j = np.indices(c.shape)
    return df.sparkSession.createDataFrame(
        pd.DataFrame({"i": i.ravel() + 1, "j": j.ravel() + 1, "value": c.ravel()}), "i int, j int, value double"
    )


# --- PCA ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Pca:
    """``center`` and ``scale`` of the inputs, eigenvalues, and loadings with the largest entry positive."""

    center: np.ndarray
    scale: np.ndarray
    values: np.ndarray
    loadings: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        share = 100 * self.values / self.values.sum()
        return spark.createDataFrame(
            pd.DataFrame({"component": np.arange(1, len(share) + 1), "eigenvalue": self.values,
                          "percent": share, "cumulative": share.cumsum()}),
            "component int, eigenvalue double, percent double, cumulative double",
        )

    def components_for(self, percent: float = 80.0) -> int:
        share = 100 * self.values / self.values.sum()
        return int((share.cumsum() <= percent).sum()) + 1


def pca(df: DataFrame, col: str, scaled: bool = False, gram_sums: Gram | None = None) -> Pca:
    """Principal components of centred data; ``scaled`` divides by the population deviation first."""
    g = gram_sums or gram(df, col)
    c = g.covariance()
    scale = np.sqrt(np.diag(c)) if scaled else np.ones(len(c))
    scale = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(c / np.outer(scale, scale))
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    top = np.abs(vectors).argmax(0)
    vectors = vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])
    return Pca(g.mean, scale, values, vectors)


def project(df: DataFrame, col: str, model: Pca, k: int, name: str = "pc") -> DataFrame:
    """Add the first ``k`` coordinates of each row; rows stay in their partitions."""
    weights = model.loadings[:, :k] / model.scale[:, None]
    shift = model.center @ weights
    p = len(model.center)

    @F.arrow_udf(VECTOR)
    def run(x: pa.Array) -> pa.Array:
        out = matrix(x, p) @ weights - shift
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, k, dtype=np.int32), out.ravel())

    return df.withColumn(name, run.asNondeterministic()(F.col(col).cast("array<double>")))


# --- design matrices ------------------------------------------------------------------------

@dataclass(frozen=True)
class DesignColumn:
    """One column of a design: its variable, the level it marks (factors only), and its role."""

    name: str
    variable: str
    level: str | None = None
    role: str = "structured"


def levels_of(df: DataFrame, factors: Sequence[str]) -> dict[str, list[str]]:
    """Sorted levels per factor; the first is the reference level."""
    from .clean import level_table

    if not factors:
        return {}
    out: dict[str, list[str]] = {f: [] for f in factors}
    for row in level_table(df, factors).orderBy("variable", "rank").collect():
        out[row["variable"]].append(row["level"])
    return out


def design(
    df: DataFrame, numeric: Sequence[str] = (), factors: Mapping[str, Sequence[str]] | None = None,
    vectors: Mapping[str, int] | None = None, name: str = "x",
) -> tuple[DataFrame, list[DesignColumn]]:
    """Add one array column: numeric columns, dummies of all levels but the first, then vector columns."""
    columns, cells = [], []
    for c in numeric:
        columns.append(DesignColumn(c, c))
        cells.append(F.col(c).cast("double"))
    for f, levels in (factors or {}).items():
        for level in levels[1:]:
            columns.append(DesignColumn(f"{f}={level}", f, level))
            cells.append(F.when(F.col(f) == level, 1.0).otherwise(0.0))
    parts: list[Column] = [F.array(*cells)] if cells else []
    for v, size in (vectors or {}).items():
        columns += [DesignColumn(f"{v}.{i}", f"{v}.{i}", None, "text") for i in range(1, size + 1)]
        parts.append(F.col(v).cast("array<double>"))
    if not parts:
        raise ValueError("a design needs at least one column")
    return df.withColumn(name, F.concat(*parts) if len(parts) > 1 else parts[0]), columns


# --- least squares and collinearity ---------------------------------------------------------

def least_squares(df: DataFrame, target: str, cols: Sequence[str]) -> dict[str, float]:
    """Coefficients with intercept from the normal equations."""
    x = df.select(F.array(*[F.col(c).cast("double") for c in [target, *cols]]).alias("_x"))
    g = gram(x, "_x", len(cols) + 1)
    c = g.covariance()
    beta = np.linalg.lstsq(c[1:, 1:], c[1:, 0], rcond=None)[0]
    out = {"(Intercept)": float(g.mean[0] - g.mean[1:] @ beta)}
    return out | {c_: float(b) for c_, b in zip(cols, beta)}


def collinearity(df: DataFrame, x: str, columns: Sequence[DesignColumn]) -> DataFrame:
    """Variance inflation and tolerance per design column."""
    inflation = np.diag(np.linalg.inv(gram(df, x, len(columns)).correlation()))
    return df.sparkSession.createDataFrame(
        pd.DataFrame({"variable": [c.name for c in columns], "vif": inflation, "tolerance": 1 / inflation}),
        "variable string, vif double, tolerance double",
    )


def condition_indices(df: DataFrame, x: str, columns: Sequence[DesignColumn]) -> DataFrame:
    """Condition indices of the column-scaled, uncentred cross product with intercept."""
    g = gram(df, x, len(columns))
    full = np.block([[np.array([[g.n]]), g.total[None, :]], [g.total[:, None], g.product]])
    s = np.sqrt(np.diag(full))
    values = np.clip(np.linalg.eigvalsh(full / np.outer(s, s))[::-1], 1e-300, None)
    return df.sparkSession.createDataFrame(
        pd.DataFrame({"dimension": np.arange(1, len(values) + 1), "eigenvalue": values,
                      "condition_index": np.sqrt(values[0] / values)}),
        "dimension int, eigenvalue double, condition_index double",
    )


# --- nearest neighbours ---------------------------------------------------------------------

# Blocks of rows on either side of a task, rows and columns of distances that it holds at a time.
SIDE_BLOCKS = 4
TILE = (256, 2048)


def _closest(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, k: int, metric: str, own_side: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, distance and neighbour of the ``k`` nearest rows of ``y`` for each row of ``x``; ``others`` ascends.

    Distances come tile by tile from a matrix product. Only those that can still be among the best of their row are looked at again, rounded and sorted.
    """
    found = []
    yy = (y * y).sum(1)
    most = yy[np.isfinite(yy)].max(initial=0.0)
    # One product gives the distances: 1 - xy, or xx + yy - 2 xy.
    one, wide = np.ones((len(y), 1)), metric != "cosine"
    right = np.hstack([-2 * y, one, yy[:, None]] if wide else [-y, one]).T
    for s in range(0, len(x), TILE[0]):
        part, own = x[s:s + TILE[0]], ids[s:s + TILE[0]]
        xx = (part * part).sum(1)
        ones = np.ones((len(part), 1))
        left = np.hstack([part, xx[:, None], ones] if wide else [part, ones])
        bound, kept = np.full(len(part), np.inf), (np.zeros(0, np.int64), np.zeros(0), others[:0])
        for c in range(0, len(y), TILE[1]):
            cols = slice(c, c + TILE[1])
            gap = left @ right[:, cols]
            top = bound
            if wide:  # squares; their last digits are lost for close rows, so the screen is a little wider and the few left are taken anew
                loose = 1e-12 * (xx + most)
                top = bound * bound + loose
            if own_side:
                gap[own[:, None] == others[None, cols]] = np.inf
            if c == 0:
                near = np.partition(gap, min(k, gap.shape[1]) - 1, axis=1)[:, min(k, gap.shape[1]) - 1]
                top = near + 2e-9 if not wide else (np.sqrt(np.clip(near, 0, None) + loose) + 2e-9) ** 2 + loose
                top = np.where(np.isnan(top), np.inf, top)
            r, at = np.nonzero(gap <= top[:, None])
            known = np.isfinite(gap[r, at])
            r, at = r[known], at[known]
            if not len(r):
                continue
            d = gap[r, at] if not wide else np.sqrt(np.concatenate(
                [((part[r[i:i + 65536]] - y[c + at[i:i + 65536]]) ** 2).sum(1) for i in range(0, len(r), 65536)]))
            r, d, o = (np.concatenate(v) for v in zip(kept, (r, np.round(d, 9), others[c + at])))
            order = np.lexsort((o, d, r))
            r, d, o = r[order], d[order], o[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r, side="left")
            kept = tuple(v[rank < k] for v in (r, d, o))
            full = rank == k - 1
            bound[r[full]] = d[full]
        found.append((s + kept[0], *kept[1:]))
    return tuple(np.concatenate(v) for v in zip(*found))


def nearest_neighbours(
    df: DataFrame, key: str, col: str, k: int, metric: str = "cosine", block_rows: int = 8192
) -> DataFrame:
    """Exact ``k`` nearest other rows of each row: ``(key, rank, neighbour, distance)``.

    Rows are dealt into sides of a few blocks by hash, so copies of one vector spread evenly. Each pair of sides is one task that keeps
    only the best ``k`` per row, for the rows of both sides; the best of the bests are then merged.
    Equal distances (to nine places) rank by key. A zero vector has cosine distance 1 to every other row, as if
    at a right angle, so every row with a vector has ``min(k, n - 1)`` neighbours; rows without one are left out.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError("metric must be cosine or euclidean")
    base = df.select(F.col(key).cast("long").alias("id"), F.col(col).cast("array<double>").alias("v")).where("v is not null")
    sides = max(1, -(-base.count() // (SIDE_BLOCKS * block_rows)))
    dealt = base.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(sides)).cast("int"))
    left = dealt.select("id", "v", F.col("b").alias("q"), F.explode(F.sequence("b", F.lit(sides - 1))).alias("r"))
    right = dealt.select("id", "v", F.explode(F.sequence(F.lit(0), "b")).alias("q"), F.col("b").alias("r"))

    def best(pair: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "d": [], "other": []})
        sorted_ = [z.sort_values("id") for z in ((a,) if pair[0] == pair[1] else (a, b))]
        ids = [z["id"].to_numpy() for z in sorted_]
        x = [np.stack(z["v"].to_numpy()) for z in sorted_]
        if metric == "cosine":
            x = [z / np.where(norm > 0, norm, 1.0) for z in x for norm in [np.linalg.norm(z, axis=1, keepdims=True)]]
        out = []
        for i, j in ((0, 0),) if len(x) == 1 else ((0, 1), (1, 0)):
            at, d, other = _closest(x[i], ids[i], x[j], ids[j], k, metric, i == j)
            out.append(pd.DataFrame({"id": ids[i][at], "d": d, "other": other}))
        return pd.concat(out)

    pairs = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInPandas(best, "id long, d double, other long")
    merged = pairs.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "other"))), 1, k).alias("n"))
    return merged.select(F.col("id").alias(key), F.posexplode("n").alias("_p", "_n")).select(
        key, (F.col("_p") + 1).cast("int").alias("rank"), F.col("_n.other").alias("neighbour"),
        F.col("_n.d").alias("distance"),
    )
