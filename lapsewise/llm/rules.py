"""Quality rules: base limits, then robust outliers by minimum-covariance-determinant estimates per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapsewise.session import settle, small_side

from .common import table

SYMBOLS = b"#*$%&|<>"
# Transformed statistics and the least spread that each is given. A language of one source whose texts agree in a
# statistic would otherwise reject a text for the smallest deviation.
STATS = {
    "word_length": 0.20,   # log of mean code points per word
    "symbols": 0.60,       # log of 1 + symbols per 100 words
    "dup_lines": 0.12,     # root of the share of lines that repeat an earlier one
    "repeats": 0.12,       # root of the share of words in repeated windows
    "capitals": 0.12,      # root of the share of A-Z among the bytes
}
P = len(STATS)
KEEP = 0.5      # share of a group's rows, besides P + 1 rows, that an estimate covers; junk may be almost as much
WEIGHT = 0.975  # share of regular rows, under a normal law, that the last estimate takes in
TAIL = 1e-6     # share of regular rows that the cut would reject under a normal law
STEPS = 8       # concentration steps
BINS = 16       # bins per octave of squared distance

_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{c} double" for c in STATS)
_SPACE, _SYMBOL = b"\t\n\x0b\x0c\r ", bytes(set(range(256)) - set(SYMBOLS))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words covered by windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    window, span = ids[:n], len(seen)
    for k in range(1, width):  # name the windows of k + 1 words by ranks, which stay below n
        window = window * span + ids[k:k + n]
        if k == width - 1 or int(window.max()) > (1 << 62) // span:
            window = np.unique(window, return_inverse=True)[1]
    twice = (np.bincount(window) > 1)[window]
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += twice
    edge[width:] -= twice
    return int((edge[:-1].cumsum() > 0).sum())


def statistics(text: str | None) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw.translate(None, _SYMBOL))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    codes = np.frombuffer(raw, dtype=np.uint8)
    capitals = int(((codes >= 65) & (codes <= 90)).sum())
    m = max(n, 1)
    return (n, chars, symbols, dup, repeats, math.log(max(chars, 1) / m), math.log1p(100 * symbols / m),
            math.sqrt(dup / max(len(lines), 1)), math.sqrt(repeats / m), math.sqrt(capitals / max(len(raw), 1)))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    for batch in batches:
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        cols = list(zip(*rows)) or [[]] * len(names)
        types = [pa.int64()] * 5 + [pa.float64()] * P
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *[pa.array(c, t) for c, t in zip(cols, types)]], names=[*rest, *names])


def chi2_cdf(x: float, p: int) -> float:
    """Chi-squared distribution function by the power series of the incomplete gamma function."""
    a, y = p / 2, x / 2
    if y <= 0:
        return 0.0
    term = total = 1 / a
    for k in range(1, 10_000):
        term *= y / (a + k)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(a * math.log(y) - y - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 1.0
    while chi2_cdf(hi, p) < q:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return hi


_CROSS = [(i, j) for i in range(P) for j in range(i, P)]


def _fit(share: float):
    """Sums of rows to centre, inverse covariance (upper triangle) and log determinant."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _fits(batches, share)

    return run


def _fits(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    spread = np.diag(np.array(list(STATS.values())) ** 2)
    # an estimate from the inner share of a normal cloud is too narrow by this factor
    wide = share / chi2_cdf(chi2_quantile(share, P), P + 2)
    for batch in batches:
        n = np.asarray(batch.column("n").to_pylist(), dtype=float)
        sums = np.array(batch.column("sums").to_pylist(), dtype=float).reshape(-1, P)
        cross = np.array(batch.column("cross").to_pylist(), dtype=float).reshape(-1, len(_CROSS))
        mean = sums / n[:, None]
        cov = np.zeros((len(n), P, P))
        for k, (i, j) in enumerate(_CROSS):
            cov[:, i, j] = cov[:, j, i] = cross[:, k] / n - mean[:, i] * mean[:, j]
        cov = cov * wide + spread
        inverse = np.linalg.inv(cov)
        yield pa.RecordBatch.from_arrays(
            [batch.column("g"), batch.column("start"), pa.array(mean.tolist(), pa.list_(pa.float64())),
             pa.array([[m[i][j] for i, j in _CROSS] for m in inverse.tolist()], pa.list_(pa.float64())), pa.array(np.linalg.slogdet(cov)[1])],
            names=["g", "start", "mean", "inverse", "logdet"])


def _distance() -> Column:
    """Squared Mahalanobis distance of a row from the joined centre."""
    d = [F.col(c) - F.col("mean")[i] for i, c in enumerate(STATS)]
    return F.greatest(F.lit(0.0), sum(((1 if i == j else 2) * d[i] * d[j] * F.col("inverse")[k] for k, (i, j) in enumerate(_CROSS)), F.lit(0.0)))


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    cols = list(STATS)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array(*[F.sum(c) for c in cols]).alias("sums"),
        F.array(*[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in _CROSS]).alias("cross"))


def _fitted(sums: DataFrame, share: float = KEEP) -> DataFrame:
    """A few rows per group; they go to every task while they are small."""
    return small_side(sums.select("g", "start", "n", "sums", "cross").mapInArrow(
        _fit(share), "g long, start int, mean array<double>, inverse array<double>, logdet double"))


def _mcd(rows: DataFrame) -> DataFrame:
    """Per group ``g``: centre and inverse covariance of the rows with the least covariance determinant.

    Three starts: all rows, the rows around the coordinate-wise medians, and half of the rows by hash. A
    concentration step keeps the rows next to the last centre until half of the group is covered and fits
    these. Instead of sorting a group, the step sums moments per bin of squared distance (16 bins an octave) and takes
    whole bins, so a group of any size meets only in sums. The start with the least determinant wins. A last fit takes in all rows
    that its distances leave inside ``WEIGHT`` of a normal cloud.
    """
    medians = rows.groupBy("g").agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"m_{c}") for c in STATS])
    near = sum((F.pow((F.col(c) - F.col(f"m_{c}")) / F.lit(s), F.lit(2)) for c, s in STATS.items()), F.lit(0.0))
    centre = rows.join(small_side(medians), "g").withColumn("near", near)
    inner = small_side(centre.groupBy("g").agg(F.percentile_approx("near", 0.5, 1000).alias("half")))
    starts = (
        _sums(rows.withColumn("start", F.lit(0)), "g", "start")
        .unionByName(_sums(centre.join(inner, "g").where("near <= half").withColumn("start", F.lit(1)), "g", "start"))
        .unionByName(_sums(rows.where(F.pmod("_draw", F.lit(2)) == 0).withColumn("start", F.lit(2)), "g", "start"))
    )
    fits = _fitted(starts)
    upto = Window.partitionBy("g", "start").orderBy("bin")
    for _ in range(STEPS):
        bins = _sums(rows.join(fits, "g").withColumn("bin", F.floor(F.lit(BINS) * F.log2(_distance() + 1e-6)).cast("int")), "g", "start", "bin")
        bins = (
            bins.withColumn("before", F.sum("n").over(upto) - F.col("n"))
            .withColumn("all", F.sum("n").over(Window.partitionBy("g", "start"))).where(F.col("before") < F.ceil((F.col("all") + P + 1) * KEEP))
        )
        total = bins.groupBy("g", "start").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(P)]).alias("sums"),
            F.array(*[F.sum(F.col("cross")[k]) for k in range(len(_CROSS))]).alias("cross"))
        fits = _fitted(total)
    best = small_side(fits.groupBy("g").agg(F.min_by(F.struct("mean", "inverse"), F.struct("logdet", "start")).alias("fit")).select("g", "fit.mean", "fit.inverse"))
    inside = rows.join(best, "g").where(_distance() <= chi2_quantile(WEIGHT, P))
    return _fitted(_sums(inside.withColumn("start", F.lit(0)), "g", "start"), WEIGHT).select("g", "mean", "inverse")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base statistics, base verdict and outlier verdict per document, one row per input row.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, cut,
    kept``. Null and empty texts have no words and fail. Texts that pass the base limits are compared with the centre of
    their language and source (null is a value of its own) by squared Mahalanobis distance of the
    transformed statistics; ``cut`` is a chi-squared quantile. Each statistic has a least spread, so a group of one
    or of equal rows rejects nothing by itself. Repeated rows count as often as they occur.
    """
    columns = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.struct(F.col(lang_col).alias("l"), F.col(source_col).alias("s")),
                          F.col(lang_col).isNull(), F.col(source_col).isNull()).alias("g"),
                          F.xxhash64(F.col(id_col), F.lit(5)).alias("_draw"), F.col(text_col).alias("text"))
    kind = columns.schema["doc_id"].dataType.simpleString()
    rows = columns.mapInArrow(_measure, f"doc_id {kind}, g long, _draw long, {_SCHEMA}")
    rows = settle(rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))
    fits = _mcd(rows.where("NOT base_failed"))
    cut = chi2_quantile(1 - TAIL, P)
    judged = rows.join(small_side(fits), "g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
                         F.lit(cut).alias("cut"), (~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))).alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))
