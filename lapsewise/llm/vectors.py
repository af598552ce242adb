"""Embedding near-dedup: an epsilon grid order join on cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.session import settle

from .common import components, table, tidy

AXES = 12        # leading principal dimensions that carry the grid and the boxes
SCREEN = 23      # leading dimensions that screen pairs, with the length of the rest as one more
SAMPLE = 4096    # vectors, in expectation, that the dimensions are fitted on; they steer the cost, never the result
BLOCK = 4096     # vectors in a sequence interval, which is one row; up to four times as many where there are many intervals
LEAF = 512       # intervals are halved down to this many vectors
SLACK = 1e-5     # far above the rounding of a screened cosine in single precision
SHARE = 8        # intervals that meet those of another share in one task


def _usable(vector: Column) -> Column:
    """Neither null, empty nor zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above all in Spark
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True).astype(np.float64)  # no overflow in the squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _padded(vectors: pa.Array, width: int) -> np.ndarray:
    sizes, flat = vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _whole(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _ordered(axes: np.ndarray, eps: float):
    """Cells on the leading dimensions, as a key that sorts like the tuple of cells. Equal vectors of a batch become one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = np.stack([_whole(batch.column(c)) for c in ("h1", "h2")], axis=1)
            _, first, group = np.unique(hashes, axis=0, return_index=True, return_inverse=True)
            ids = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(ids, group.ravel(), _whole(batch.column("id")))
            few = batch.take(pa.array(first))
            unit = _unit(_padded(few.column("vector"), len(axes)))
            at = np.zeros((len(unit), axes.shape[1]))
            for j, axis in enumerate(axes):  # place by place, so that equal vectors of other batches get this very cell
                at += unit[:, j:j + 1] * axis
            key = (np.floor(at / eps).astype(np.int64) + (1 << 15)).astype(">u2")
            yield pa.RecordBatch.from_arrays(
                [few.column("h1"), few.column("h2"), pa.array(ids), pa.array(np.bincount(group.ravel(), minlength=len(first))), few.column("vector"),
                 pa.array([k.tobytes() for k in key], pa.binary())], names=["h1", "h2", "id", "copies", "vector", "cell"])

    return run


def _blocks(axes: np.ndarray, block: int):
    """Consecutive vectors of a sorted partition as rows of at most ``block``, with their box on the leading dimensions. Equal vectors, which lie side
    by side, are one with a count."""
    width = axes.shape[0]

    def row(ids: np.ndarray, copies: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        at = _unit(raw) @ axes
        return pa.RecordBatch.from_arrays(
            [*(pa.array([x.tobytes()], pa.binary()) for x in (ids, copies, raw)),
             pa.array([at.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([at.max(axis=0).tolist()], pa.list_(pa.float64()))],
            names=["ids", "copies", "raw", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            more = [*(_whole(batch.column(c)) for c in ("h1", "h2", "id", "copies")), _padded(batch.column("vector"), width)]
            held = more if held is None else [np.concatenate(x) for x in zip(held, more)]
            h1, h2, ids, copies, raw = held
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            held = [h1[starts], h2[starts], np.minimum.reduceat(ids, starts), np.add.reduceat(copies, starts), raw[starts]]
            while len(held[0]) > block:  # the last one may go on in the next batch
                yield row(*(x[:block] for x in held[2:]))
                held = [x[block:] for x in held]
        if held is not None:
            yield row(*held[2:])

    return run


def _roots(links: np.ndarray, n: int) -> np.ndarray:
    """Smallest place of each component of n places under rows of ``links``."""
    label = np.arange(n)
    while len(links):
        low = np.minimum(label[links[:, 0]], label[links[:, 1]])
        np.minimum.at(label, links[:, 0], low)
        np.minimum.at(label, links[:, 1], low)
        label = label[label]
        if (label[links[:, 0]] == label[links[:, 1]]).all():
            break
    return label


class _Side:
    """A sequence interval: its unit vectors, their places on the leading dimensions, and what screens their pairs.

    The leading dimensions of two unit vectors and the lengths of what is left of them, multiplied out, are never below their cosine.
    """

    def __init__(self, ids: np.ndarray, copies: np.ndarray, raw: np.ndarray, axes: np.ndarray):
        self.ids, self.copies, self.raw, self.unit = ids, copies, raw, _unit(raw)
        at = self.unit @ axes
        rest = np.sqrt(np.maximum(1 - (at * at).sum(axis=1, keepdims=True), 0))
        self.screen = np.concatenate([at, rest], axis=1).astype(np.float32)
        self.at = np.ascontiguousarray(at[:, :AXES])
        self.boxes: dict = {}

    def box(self, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        if span not in self.boxes:
            at = self.at[span[0]:span[1]]
            self.boxes[span] = at.min(axis=0), at.max(axis=0)
        return self.boxes[span]


class _Join:
    """Join of two sequence intervals by halving; intervals whose boxes lie apart are skipped."""

    def __init__(self, left: _Side, right: _Side | None, least: float, eps: float):
        self.least, self.eps = least, eps * (1 + 1e-9)
        self.left, self.right, self.alone = left, right or left, right is None
        sides = [left] if self.alone else [left, right]
        self.ids, self.copies = (np.concatenate([getattr(s, k) for s in sides]) for k in ("ids", "copies"))
        self.links = np.zeros(len(self.ids), dtype=np.int64)
        self.kept: list[np.ndarray] = []
        self.visit((0, len(left.ids)), (0, len(self.right.ids)))

    def visit(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        (a_low, a_high), (b_low, b_high) = self.left.box(a), self.right.box(b)
        apart = np.maximum(0.0, np.maximum(a_low - b_high, b_low - a_high))
        if (apart * apart).sum() > self.eps ** 2:
            return
        if max(a[1] - a[0], b[1] - b[0]) <= LEAF:
            return self.leaf(a, b)
        halves = [[s] if s[1] - s[0] <= LEAF else [(s[0], sum(s) // 2), (sum(s) // 2, s[1])] for s in (a, b)]
        for x in halves[0]:
            for y in halves[1]:
                if not self.alone or a != b or x <= y:  # within one interval each pair of halves once
                    self.visit(x, y)

    def near(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the linked pairs, decided in double precision; the screen only says which pairs cannot be."""
        bound = self.left.screen[a[0]:a[1]] @ self.right.screen[b[0]:b[1]].T
        if bound.max() < self.least - SLACK:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        r, c = np.nonzero(bound >= self.least - SLACK)
        if 16 * len(r) > bound.size:
            cos = (self.left.unit[a[0]:a[1]] @ self.right.unit[b[0]:b[1]].T)[r, c]
        else:
            cos = np.einsum("ij,ij->i", self.left.unit[a[0] + r], self.right.unit[b[0] + c])
        linked = cos >= self.least
        for i in np.flatnonzero(np.abs(cos - self.least) < 1e-9):  # at the edge by the plain formula
            x, y = self.left.raw[a[0] + r[i]].astype(np.float64), self.right.raw[b[0] + c[i]].astype(np.float64)
            linked[i] = x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= self.least
        if self.alone and a == b:
            linked &= r < c
        return r[linked] + a[0], c[linked] + b[0]

    def leaf(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        r, c = self.near(a, b)
        if not len(r):
            return
        c = c if self.alone else c + len(self.left.ids)
        np.add.at(self.links, r, self.copies[c])
        np.add.at(self.links, c, self.copies[r])
        nodes, pos = np.unique(np.concatenate([r, c]), return_inverse=True)
        root = _roots(np.stack([pos[:len(r)], pos[len(r):]], axis=1), len(nodes))
        self.kept.append(np.stack([nodes, nodes[root]], axis=1))

    def rows(self) -> pa.RecordBatch:
        """Links of each vector and the smallest id it is tied to in these two intervals."""
        root = _roots(np.concatenate(self.kept) if self.kept else np.zeros((0, 2), dtype=np.int64), len(self.ids))
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, self.ids)
        has = self.links > 0
        return pa.RecordBatch.from_arrays([pa.array(self.ids[has]), pa.array(self.links[has]), pa.array(least[root][has])], names=["id", "links", "near"])


def _join(axes: np.ndarray, least: float, eps: float, kind: str):
    width = axes.shape[0]

    def side(batch: pa.RecordBatch, i: int, k: str) -> _Side:
        ids, copies, raw = (np.frombuffer(batch.column(c + k)[i].as_buffer(), dtype=t) for c, t in (("ids", np.int64), ("copies", np.int64), ("raw", kind)))
        return _Side(ids, copies, raw.reshape(-1, width), axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].as_py() for c in ("block_a", "block_b"))
                if a != at:  # it meets one after the other
                    at, left = a, side(batch, i, "_a")
                yield _Join(left, None if a == b else side(batch, i, "_b"), least, eps).rows()

    return run


def link_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 9) -> DataFrame:
    """Links by cosine and their components: ``vec_id, n_links, component_id, kept``, one row per input row.

    Unit vectors at cosine c lie sqrt(2 - 2c) apart, the side of the grid. Vectors are sorted by their cells on the leading principal
    dimensions (ties by hash) and cut into sequence intervals, which are stored once. Pairs of intervals whose boxes are near are
    joined by recursive halving with the same test; leaves are screened in single precision and compared in double precision. Tasks read the
    two shares of intervals they join from where these are stored, so no interval is copied for its pairs. A pair
    returns a count and a nearest root per vector, never its links. Equal vectors are one vector with a count until the end, so
    a group of copies costs nothing. Vectors that are null, zero or hold null or non-finite components,
    and rows without an id, link with nothing (their component is their own id); shorter vectors are padded with zeros; repeated rows
    link as copies do. An empty table gives an empty result.
    """
    eps = float(np.sqrt(2 - 2 * least))
    kind = "float" if vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    # -0.0 and 0.0 are one value for a hash of doubles in Spark, so copies meet whatever the sign of their zeros
    wide = F.col("vector").cast("array<double>")
    keyed = rows.where(F.col("id").isNotNull() & _usable(F.col("vector"))).withColumn("h1", F.xxhash64(wide)).withColumn("h2", F.xxhash64(F.lit(seed), wide))
    # vectors themselves travel once, to their intervals
    single = settle(keyed.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max(F.size("vector")).alias("width")))
    n, width = single.agg(F.count("*"), F.max("width")).first()
    if not n:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    drawn = keyed.where(F.pmod(F.xxhash64("h1", F.lit(seed)), F.lit(max(1, -(-n // SAMPLE)))) == 0).dropDuplicates(["h1", "h2"]).select(wide.alias("vector")).collect()
    unit = _unit(_padded(pa.array([r.vector for r in drawn], pa.list_(pa.float64())), width)) if drawn else np.eye(width)
    centred = unit - unit.mean(axis=0)
    screen = np.ascontiguousarray(np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :SCREEN])
    axes = np.ascontiguousarray(screen[:, :AXES])

    cells = keyed.mapInArrow(_ordered(axes, eps), f"h1 long, h2 long, id long, copies long, vector array<{kind}>, cell binary")
    block = min(max(n // 64, BLOCK), 4 * BLOCK)
    parts = -(-n // block)
    blocks = settle(
        cells.repartitionByRange(parts, "cell", "h1", "h2").sortWithinPartitions("cell", "h1", "h2").coalesce(parts)
        .mapInArrow(_blocks(axes, block), "ids binary, copies binary, raw binary, low array<double>, high array<double>")
        .withColumn("block", F.monotonically_increasing_id()))
    tidy(vectors.sparkSession)
    # pairs of intervals: their boxes are near
    shares = blocks.coalesce(max(min(parts, SHARE), -(-parts // SHARE)))
    named = lambda k: shares.select(*[F.col(c).alias(c + k) for c in ("block", "ids", "copies", "raw", "low", "high")])
    gaps = F.zip_with(F.arrays_zip("low_a", "high_a"), F.arrays_zip("low_b", "high_b"), lambda p, q: F.greatest(F.lit(0.0), p["low_a"] - q["high_b"], q["low_b"] - p["high_a"]))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    near = (F.col("block_a") <= F.col("block_b")) & (apart <= eps * eps * (1 + 1e-9))
    found = settle(named("_a").join(named("_b").hint("shuffle_replicate_nl"), near).select("block_a", "ids_a", "copies_a", "raw_a", "block_b", "ids_b", "copies_b", "raw_b")
                   .mapInArrow(_join(screen, least, eps, "f4" if kind == "float" else "f8"), "id long, links long, near long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("near").alias("b")))
    solved = (
        single.join(links, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    )
    linked = keyed.select("id", "h1", "h2").join(solved, ["h1", "h2"]).groupBy(F.col("id").alias("known")).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return rows.select("id", F.col("vector").alias("_v")).join(linked, F.col("id") == F.col("known"), "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


SQL_OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(low.c, vec_id) AS component_id, coalesce(low.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
"""
