"""Centroid clustering over Hilbert-ordered blocks with min/max boxes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, FloatType

from lapsewise.operators.blocks import tree_sum
from lapsewise.session import settle

from .common import table

SCALE = 1024
WIDE = 1 << 27      # scaled components from here on have no exact 64-bit distance
EXACT = 1 << 53     # whole numbers up to here are exact in doubles
BLOCK = 256         # vectors in a block
AXES, BITS = 8, 8   # dimensions of the curve, bits of each; together 64


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of cell numbers (rows x axes, below ``2 ** bits``) on the Hilbert curve, as unsigned numbers.

    Bit planes from the top: each plane's Gray code is undone, then the lower planes are reflected and exchanged as the curve turns.
    """
    x = cells.astype(np.uint64).copy()
    axes = x.shape[1]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(axes):
            on = (x[:, i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(on, x[:, 0] ^ low, x[:, 0] ^ swap)
            if i:
                x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), dtype=np.uint64)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        flip ^= np.where((x[:, -1] & q) != 0, q - one, np.uint64(0))
    x ^= flip[:, None]
    key = np.zeros(len(x), dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << one) | ((x[:, i] >> np.uint64(b)) & one)
    return key


def _moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
    """Count, sums and cross products of vectors, for the principal axes."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _vectors(batch).astype(float)
            part = np.concatenate([[[len(x)] + [0] * (x.shape[1] - 1)], [x.sum(axis=0)], x.T @ x])
            total = part if total is None else total + part
    return total


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(batch.num_rows, -1)


def _place(mean: np.ndarray, axes: np.ndarray, spread: np.ndarray):
    """Add the place on the curve; axes are cut into equal cells over four deviations to each side, the outer cells are open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = (_vectors(batch) - mean) @ axes
            cells = np.clip(np.floor((side / spread + 4) / 8 * (1 << BITS)), 0, (1 << BITS) - 1)
            key = (hilbert_keys(cells) ^ np.uint64(1 << 63)).view(np.int64)  # signed numbers in the same order
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=[*batch.schema.names, "curve"])

    return run


def _cut(size: int):
    """Blocks of consecutive rows of a sorted partition, with box and sum."""
    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = np.concatenate([_vectors(b) for b in rows])
        ids = pa.concat_arrays([b.column("vec_id") for b in rows])
        lists = [pa.ListArray.from_arrays(pa.array([0, x.shape[1]], pa.int32()), pa.array(v)) for v in (x.min(axis=0), x.max(axis=0), x.sum(axis=0))]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x.astype("<i4").tobytes()], pa.binary()), *lists],
            names=["ids", "data", "lo", "hi", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == size:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return run


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector inside a box: none whose least distance is above another's greatest."""
    near = np.maximum(np.maximum(lo - centroids, centroids - hi), 0)
    far = np.maximum(np.abs(centroids - lo), np.abs(centroids - hi))
    least, most = (near * near).sum(axis=1), (far * far).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows x centroids. Matrix products in doubles where every term is a whole number below 2 ** 53."""
    top = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * top * top * max(x.shape[1], 1) < EXACT:
        a, c = x.astype(float), centroids.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], centroids: np.ndarray):
    """Per block: batch, row, candidates, and a function that opens its vectors."""
    for batch in batches:
        lo, hi, total = (_whole(batch.column(c), centroids.shape[1]) for c in ("lo", "hi", "total"))
        data = batch.column("data")
        for k in range(batch.num_rows):
            yield batch, k, candidates(lo[k], hi[k], centroids), total[k], lambda k=k, data=data: np.frombuffer(data[k].as_buffer(), dtype="<i4").reshape(-1, centroids.shape[1]).astype(np.int64)


def _whole(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def _sums(centroids: np.ndarray):
    """Count and sums per cluster of a task. A block with one candidate adds its stored sum and stays closed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * len(centroids)
        sums = np.zeros(centroids.shape, dtype=object)
        opened = blocks = 0
        for batch, k, near, total, vectors in _blocks(batches, centroids):
            blocks += 1
            if len(near) == 1:
                n[near[0]] += len(batch.column("ids")[k])
                sums[near[0]] += total
                continue
            opened += 1
            x = vectors()
            own = near[distances(x, centroids[near]).argmin(axis=1)]
            for c in near:
                n[c] += int((own == c).sum())
                sums[c] += x[own == c].sum(axis=0)
        rows = [(c, d, n[c], str(int(sums[c, d]))) for c in range(len(centroids)) if n[c] for d in range(centroids.shape[1])]
        rows.append((-1, opened, blocks, "0"))
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
                                         names=["cluster", "dim", "n", "total"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, near, _, vectors in _blocks(batches, centroids):
            far = distances(vectors(), centroids[near])
            best = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids")[k].values, pa.array(near[best].astype(np.int32)), pa.array(far[np.arange(len(best)), best])], names=["vec_id", "cluster", "distance"])

    return run


def scaled_vectors(vectors: DataFrame, width: int = 64, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: the vectors with exactly ``width`` components, none null or non-finite, as whole numbers ``floor(scale * x)``."""
    kind = vectors.schema[vector_col].dataType
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, (FloatType, DoubleType, DecimalType)) and kind.elementType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{vector_col} must be an array of numbers")
    v = F.col("v")
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < WIDE / scale - 1))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where((F.size(v) == width) & plain)
    return rows.select("vec_id", F.transform(v, lambda x: F.floor(x * scale).cast("int")).alias("v"))


def curve_blocks(rows: DataFrame, width: int, size: int = BLOCK) -> DataFrame:
    """Vectors in Hilbert order, cut into blocks: ``ids, data, lo, hi, total``, one row of at most ``size`` vectors each.

    The curve runs over the leading principal axes, found from sums over all vectors. Range partitions cut it by
    samples of (place, hash), so equal vectors, however many, spread over partitions.
    """
    schema = f"ids array<{rows.schema['vec_id'].dataType.simpleString()}>, data binary, lo array<bigint>, hi array<bigint>, total array<bigint>"
    sums = tree_sum(rows.select("v"), _moments)
    if sums is None:
        return rows.limit(0).mapInArrow(_cut(size), schema)
    sums = sums.reshape(width + 2, width)
    n = sums[0, 0]
    mean = sums[1] / n
    values, axes = np.linalg.eigh(sums[2:] / n - np.outer(mean, mean))
    top = np.argsort(values)[::-1][:AXES]
    spread = np.sqrt(np.maximum(values[top], 1e-12))
    placed = rows.mapInArrow(_place(mean, axes[:, top], spread), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, v array<int>, curve long")
    tie = F.xxhash64("vec_id", "v")
    return placed.withColumn("tie", tie).repartitionByRange("curve", "tie").sortWithinPartitions("curve", "tie").select("vec_id", "v").mapInArrow(_cut(size), schema)


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest digests of seed and id, in that order; equal ids follow by their components, null ids are not taken."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in rows.where("vec_id IS NOT NULL").select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def step(blocks: DataFrame, centroids: Sequence[Sequence[int]]) -> tuple[list[list[int]], int, int]:
    """One round: the new centroids (exact floors of the means, empty clusters stay), blocks that had to be opened, all blocks.

    Tasks send one row per cluster and dimension, Spark adds these up; the driver sees clusters x dimensions.
    """
    sums = blocks.mapInArrow(_sums(np.array(centroids, dtype=np.int64)), "cluster int, dim int, n long, total string")
    found = sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out = [list(c) for c in centroids]
    opened = of = 0
    for r in found:
        if r["cluster"] < 0:
            opened, of = opened + r["dim"], of + r["n"]
        else:
            out[r["cluster"]][r["dim"]] = int(r["total"]) // r["n"]
    return out, opened, of


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: int = SCALE,
            id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """Nearest-centroid clusters in exact whole numbers; returns rows and the final centroids.

    Rows: ``vec_id, cluster, distance``, one per vector that ``scaled_vectors`` keeps. The vectors are stored once, as blocks along the
    curve. A round reads them with the centroids in the task: box bounds leave each block its candidates; a block with one
    candidate adds its stored sum, the others are compared with their candidates exactly, ties to the smaller number. Vectors of another length,
    null vectors and those with null, non-finite or very large components (131,071 and more at scale 1,024, whose distances
    exceed a long) are left out. Repeated rows count as often as they occur; a null id is clustered but never
    a first centroid. With fewer than ``k`` ids there are fewer clusters; without any the result is empty.
    """
    rows = scaled_vectors(vectors, width, scale, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    blocks = settle(curve_blocks(rows, width, block))
    for _ in range(rounds):
        centroids, _, _ = step(blocks, centroids)
    return blocks.mapInArrow(_assign(np.array(centroids, dtype=np.int64)), f"vec_id {kind}, cluster int, distance long"), centroids


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    rows = settle(rows)
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    named = spark.createDataFrame([(c, int(s), int(sum(sums.values())), digest[c]) for c, s in sums.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds one after the other, vectors as one row per component."""
    parts = [
        """kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, sha256('3:' || vec_id) AS h FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "x AS MATERIALIZED (SELECT vec_id, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM kept)",
        f"""c0 AS MATERIALIZED (SELECT cluster, generate_subscripts(v, 1) AS dim, unnest(v) AS c FROM
    (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v FROM kept) WHERE cluster < {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, arg_min(cluster, distance * {k} + cluster) AS cluster, min(distance) AS distance FROM
    (SELECT vec_id, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM x JOIN c{i} USING (dim) GROUP BY vec_id, cluster) GROUP BY vec_id)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT cluster, dim, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{i} LEFT JOIN
    (SELECT cluster, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{i} USING (vec_id) GROUP BY cluster, dim) USING (cluster, dim))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster) USING (cluster)"""


SQL_OP13 = _sql()
