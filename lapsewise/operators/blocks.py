"""Sums of numpy arrays over the tasks of a DataFrame, combined in a tree on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import shuffle_width

FAN_IN = 64
# Numbers that the driver may get as partial arrays; larger ones are added up piece by piece on the executors first.
DRIVER_CELLS = 1 << 20
PIECE = 1 << 17


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a dense matrix, without copying row by row."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, width)


def numbers(column: pa.Array, dtype=float) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def tree_sum(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], np.ndarray],
             tasks: int | None = None, cells: int = 0) -> np.ndarray | None:
    """Sum of ``kernel(batches)`` over all tasks. Only arrays of one fixed size travel, never rows.

    The partial arrays are summed on executors until few are left for the driver, unless ``tasks``, the number
    of tasks where it is known, is small already. Where it is unknown one merge always runs. ``cells`` is the size of an array where it may
    be large: the driver then gets every piece of it once, already summed.
    """
    width = tasks or max(shuffle_width(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism, FAN_IN + 1)

    def pieces(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at, part in totals.items():
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "part": [part.tobytes()]})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = kernel(batches)
        if total is not None:
            flat = np.ascontiguousarray(total, dtype=float).ravel()
            yield from pieces({i: flat[i * PIECE:(i + 1) * PIECE] for i in range(max(-(-len(flat) // PIECE), 1))})

    def added(rows: Iterator[tuple[int, bytes]], totals: dict[int, np.ndarray]) -> None:
        for at, raw in rows:
            part = np.frombuffer(raw)
            if at in totals:
                totals[at] += part
            else:
                totals[at] = part.copy()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            added(((at.as_py(), raw.as_buffer()) for at, raw in zip(b.column(0), b.column(1))), totals)
        yield from pieces(totals)

    parts = df.mapInArrow(partial, "at int, part binary")
    while width > FAN_IN:
        width = int(np.ceil(np.sqrt(width)))
        parts = parts.repartition(width).mapInArrow(merge, "at int, part binary")
    if width * cells > DRIVER_CELLS:
        parts = parts.repartition(min(-(-cells // PIECE), shuffle_width(df.sparkSession)), "at").mapInArrow(merge, "at int, part binary")
    totals: dict[int, np.ndarray] = {}
    added(((row["at"], bytes(row["part"])) for row in parts.collect()), totals)
    return np.concatenate([totals[i] for i in range(len(totals))]) if totals else None
