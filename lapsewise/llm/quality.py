"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 14   # hashed words
RANK = 4            # length of a feature's factor
SAMPLE = 20_000     # labelled rows that a model is fitted on, in expectation; drawn by hash
EPOCHS = 12
TEXT_STATS = ("words", "word_length", "longest", "distinct", "capitals", "digits", "punctuation", "symbols", "wide", "lines", "dup_lines", "top_word")


def _structure(raw: bytes, words: list[bytes]) -> list[float]:
    n, size = max(len(words), 1), max(len(raw), 1)
    codes = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) if raw else np.zeros(256, dtype=np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = [len(w) for w in words[:1]] and np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    share = lambda a, b: float(codes[a:b].sum()) / size
    symbols = float(codes[[ord(c) for c in "#*$%&|<>"]].sum())
    return [np.log1p(len(words)) / 5, (float(lengths.mean()) if len(words) else 0.0) / 5, np.log1p(float(lengths.max()) if len(words) else 0.0) / 3,
            len(seen) / n, share(65, 91) * 4, share(48, 58) * 4, (share(33, 48) + share(58, 65) + share(91, 97) + share(123, 127)) * 4,
            min(symbols / n, 2.0), share(128, 256) * 2, min(len(lines) / n * 5, 2.0),
            (len(lines) - len(set(lines))) / max(len(lines), 1), max(seen.values(), default=0) / n]


class Features:
    """Flat sparse rows: ``[bias-free] words | statistics | metadata`` with the row of each entry."""

    def __init__(self, n_meta: int):
        self.n_meta, self.width = n_meta, BUCKETS + len(TEXT_STATS) + 2 * n_meta
        self.bucket: dict[bytes, int] = {}

    def of(self, texts: list[str | None], meta: Sequence[Sequence]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, at, values = [], [], []
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            words = raw.split()
            own = set(words)
            if len(self.bucket) > 200_000:  # a cache only
                self.bucket = {}
            codes = np.fromiter((self._hash(w) for w in own), dtype=np.int64, count=len(own))
            b, n = np.unique(codes, return_counts=True)
            if len(b):
                at.append(b)
                values.append(n / np.sqrt((n * n).sum()))
            stats = _structure(raw, words)
            extra = []
            for column in meta:  # a null is a feature of its own
                extra += [0.0, 1.0] if column[i] is None else [float(np.log1p(max(float(column[i]), 0.0))) / 8, 0.0]
            at.append(np.arange(BUCKETS, self.width))
            values.append(np.array(stats + extra))
            rows.append(len(b) + self.width - BUCKETS)
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        return np.repeat(np.arange(len(rows)), rows), np.concatenate(at), np.concatenate(values)

    def _hash(self, w: bytes) -> int:
        h = self.bucket.get(w)
        if h is None:
            h = self.bucket[w] = zlib.crc32(w) % BUCKETS
        return h


class Machine:
    """w0 + sum w x + sum over factors of ((sum v x)^2 - sum v^2 x^2) / 2, linear in the entries of a row."""

    def __init__(self, width: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(width), rng.normal(0, 0.02, (width, RANK))

    def logits(self, row: np.ndarray, at: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros((n, RANK))
        out = self.bias + np.bincount(row, weights=self.w[at] * x, minlength=n)
        for f in range(RANK):
            vx = self.v[at, f] * x
            sums[:, f] = np.bincount(row, weights=vx, minlength=n)
            out += 0.5 * (sums[:, f] ** 2 - np.bincount(row, weights=vx * vx, minlength=n))
        return out, sums

    def fit(self, row: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, rate: float = 0.1, decay: float = 1e-5, batch: int = 256) -> None:
        """Adaptive gradient steps on the logistic loss over shuffled batches."""
        n = len(y)
        ends = np.searchsorted(row, np.arange(n + 1))
        g_w, g_v, g_b = np.full(len(self.w), 1e-3), np.full(self.v.shape, 1e-3), 1e-3
        rng = np.random.default_rng(5)
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                own = order[i:i + batch]
                spans = [np.arange(ends[r], ends[r + 1]) for r in own]
                pick = np.concatenate(spans)
                r = np.repeat(np.arange(len(own)), [len(s) for s in spans])
                a, v = at[pick], x[pick]
                z, sums = self.logits(r, a, v, len(own))
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
                used, pos = np.unique(a, return_inverse=True)
                dx = d[r] * v
                gw = np.bincount(pos, weights=dx) + decay * self.w[used]
                g_w[used] += gw * gw
                old = self.v[a]
                self.w[used] -= rate * gw / np.sqrt(g_w[used])
                for f in range(RANK):
                    gv = np.bincount(pos, weights=dx * (sums[r, f] - old[:, f] * v)) + decay * self.v[used, f]
                    g_v[used, f] += gv * gv
                    self.v[used, f] -= rate * gv / np.sqrt(g_v[used, f])
                gb = d.sum()
                g_b += gb * gb
                self.bias -= rate * gb / np.sqrt(g_b)


def _train(n_meta: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, parts, labels, done = Features(n_meta), [], [], 0
        for batch in batches:
            row, at, x = features.of(batch.column("text").to_pylist(), [batch.column(f"m{k}").to_pylist() for k in range(n_meta)])
            parts.append((row + done, at.astype(np.int32), x.astype(np.float32)))
            labels += batch.column("y").to_pylist()
            done += batch.num_rows
        if not done:
            return
        machine = Machine(features.width)
        machine.fit(*[np.concatenate(c) for c in zip(*parts)], np.array(labels, dtype=float))
        yield pa.RecordBatch.from_arrays([pa.array([machine.bias]), pa.array([machine.w.tobytes()]), pa.array([machine.v.tobytes()])], names=["bias", "w", "v"])

    return run


def _score(n_meta: int, machine: Machine, least: float | None = None):
    """Add the score of each row; with ``least``, pass on only the rows that reach it, without the inputs of the score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, inputs = Features(n_meta), {"text", *[f"m{k}" for k in range(n_meta)]}
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                row, at, x = features.of(part.column("text").to_pylist(), [part.column(f"m{k}").to_pylist() for k in range(n_meta)])
                z, _ = machine.logits(row, at, x, part.num_rows)
                out[i:i + 500] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            kept = [c for c in batch.schema.names if c not in inputs]
            scored = pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out)], names=[*kept, "score"])
            yield scored if least is None else scored.filter(pa.array(out >= least))

    return run


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = ("n_chars",), sample: int = SAMPLE,
                id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine:
    """A model of about ``sample`` labelled rows outside the held-out third, drawn by hash; its size is fixed."""
    rows = _inputs(docs, metadata, id_col, text_col)
    known = (labels.where(F.col(label_col).isNotNull() & ~held_out(id_col) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("y")))
    n = known.count()
    part = sample / n if n > sample else 1.0
    draw = F.shiftrightunsigned(F.xxhash64("_id", F.lit(17)), 11).cast("double") / float(1 << 53)
    learnt = rows.join(known.where(draw < part), F.col("doc_id") == F.col("_id")).drop("doc_id")
    # one task sees the sample, whose size is bounded by the parameter, in an order that the rows alone fix: sums of doubles depend on it
    order = [F.xxhash64("_id", F.lit(23)), F.col("_id"), F.xxhash64("text")]
    found = learnt.repartition(1).sortWithinPartitions(*order).drop("_id").mapInArrow(_train(len(metadata)), "bias double, w binary, v binary").collect()
    machine = Machine(Features(len(metadata)).width)
    machine.v[:] = 0
    for w in found:  # none without a labelled row
        machine.bias, machine.w, machine.v = w.bias, np.frombuffer(w.w), np.frombuffer(w.v).reshape(-1, RANK)
    return machine


def _inputs(docs: DataFrame, metadata: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(metadata)])


def quality_scores(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = ("n_chars",), sample: int = SAMPLE,
                   id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Score every text: ``doc_id, held_out, score, predicted``, one row per input row.

    The model goes to the tasks, which read whole texts. Inputs are hashed words, statistics of the
    text and numeric ``metadata`` columns; ids, languages, sources and labels are not. A null or
    empty text has no words; a null in metadata is a feature of its own; rows without a label or an id are only
    scored; without any label every score is 0.5. Repeated rows get equal scores. ``docs`` must have the columns of ``metadata``,
    by default ``n_chars``; pass an empty list where there are none.
    """
    machine = fit_quality(docs, labels, metadata, sample, id_col, text_col, label_col)
    rows = _inputs(docs, metadata, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_score(len(metadata), machine), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = ("n_chars",), least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns and without a shuffle."""
    machine = fit_quality(docs, labels, metadata, **options)
    text = options.get("text_col", "text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"), *[F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(metadata)])
    kept = rows.mapInArrow(_score(len(metadata), machine, least), f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return kept.select("row.*")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
