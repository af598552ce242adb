"""Allow and block lists for URLs, and a character language-model ratio for the URLs no rule decides."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapsewise.session import settle

from .common import table

ORDER = 5  # longest context in bytes
NGRAM_BITS, CONTEXT_BITS = 19, 17  # counters of UrlModels
SYMBOL = 9  # bits of a symbol in a literal key
UNIT = float(1 << 32)  # log ratios are added as whole numbers, so that sums do not depend on their order
HOT = 4096  # grams that are sent to every task, at most
PRIOR = 2.0  # weight of the next shorter context
PIECE = 1 << 21  # bytes scored at once
BIN = 0.01  # nats per byte, for the calibration

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a URL without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return _ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits as a struct ``rule, verdict``; null if none does.

    Of rules of equal length a blocking one goes first. The rules are a configured list.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _slots(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counter slots per byte and order (contexts, continuations), and the row of each byte."""
    flat = np.frombuffer(b"".join(b"\0" * ORDER + u for u in urls), dtype=np.uint8).astype(np.uint64)
    lengths = np.array([len(u) for u in urls])
    row = np.repeat(np.arange(len(urls)), lengths)
    at = np.arange(len(row)) + (row + 1) * ORDER
    context = np.zeros(len(at), dtype=np.uint64)
    contexts, grams = np.empty((ORDER + 1, len(at)), dtype=np.int32), np.empty((ORDER + 1, len(at)), dtype=np.int32)
    for k in range(ORDER + 1):
        if k:
            context = context + (flat[at - k] + np.uint64(1)) * _MIX[k]
        seed = (context + np.uint64(k + 1)) * _MIX[0]
        seed ^= seed >> np.uint64(29)
        contexts[k] = ((seed * _MIX[1]) >> np.uint64(64 - CONTEXT_BITS)).astype(np.int32)
        grams[k] = (((seed + flat[at] * _MIX[2]) * _MIX[3]) >> np.uint64(64 - NGRAM_BITS)).astype(np.int32)
    return contexts, grams, row


def _pieces(urls: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, u in enumerate(urls):
        if size and size + len(u) > PIECE:
            yield start, i
            start, size = i, 0
        size += len(u) + ORDER
    if start < len(urls):
        yield start, len(urls)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if u is None else u.encode() for u in column.to_pylist()]


def _grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ``ORDER`` bytes before each byte and the byte itself as one literal key, and the row of each byte.

    A symbol is nine bits, a byte plus one; 0 stands before the start of a URL.
    """
    flat = np.frombuffer(b"".join(urls), dtype=np.uint8).astype(np.int64) + 1
    lengths = np.array([len(u) for u in urls], dtype=np.int64)
    row = np.repeat(np.arange(len(urls)), lengths)
    place = np.arange(len(flat)) - (np.cumsum(lengths) - lengths)[row]
    gram = flat.copy()
    for k in range(1, ORDER + 1):
        gram[k:] += np.where(place[k:] >= k, flat[:-k], 0) << (SYMBOL * k)
    return gram, row


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of distinct URLs: rows (gram, n of each class and fold, n of all URLs), added up per piece."""
    for batch in batches:
        urls = _bytes(batch.column("url"))
        kinds, times = np.array(batch.column("kind").to_pylist(), dtype=np.int64), np.array(batch.column("m").to_pylist(), dtype=np.int64)
        for a, b in _pieces(urls):
            grams, row = _grams(urls[a:b])
            gram, at = np.unique(grams, return_inverse=True)
            n = np.zeros((5, len(gram)), dtype=np.int64)
            for kind in range(4):
                of = kinds[a:b][row] == kind
                np.add.at(n[kind], at[of], times[a:b][row[of]])
            n[4] = np.bincount(at, minlength=len(gram))
            for i in range(0, len(gram), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 50_000]) for x in (gram, *n)], names=["gram", "n0", "n1", "n2", "n3", "n"])


def _ratios(counts: DataFrame) -> DataFrame:
    """Log likelihood ratio of each gram under the counts of both folds (``s``), fold 0 (``s0``) and fold 1 (``s1``), in ``1 / UNIT``.

    Counts of shorter grams and of contexts are sums of those of longer ones. A gram extends to at most 257 longer
    ones on either side, so no group of a sum, a window or a join is larger than that.
    """
    by_order = [counts.select("gram", "n0", "n1", "n2", "n3")]
    for k in range(ORDER, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (SYMBOL * k)) - 1))
        by_order.append(settle(by_order[-1].groupBy(shorter.alias("gram")).agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(4)])))
    models = {"a": ("n0", "n2"), "r": ("n1", "n3"), "a0": ("n0",), "r0": ("n1",), "a1": ("n2",), "r1": ("n3",)}
    lean = None
    for k, held in enumerate(reversed(by_order)):
        context = Window.partitionBy(F.shiftright("gram", SYMBOL))
        seen = {m: sum((F.col(c) for c in cs[1:]), F.col(cs[0])) for m, cs in models.items()}
        held = held.select("gram", *[seen[m].alias(f"g_{m}") for m in models], *[F.sum(seen[m]).over(context).alias(f"c_{m}") for m in models])
        if k:
            lean = lean.select(F.col("gram").alias("end"), *[F.col(m).alias(f"p_{m}") for m in models])
            held = held.join(lean, F.col("gram").bitwiseAND(F.lit((1 << (SYMBOL * k)) - 1)) == F.col("end"))
        lean = held.select("gram", *[((F.col(f"g_{m}") + PRIOR * (F.col(f"p_{m}") if k else F.lit(1 / 256))) / (F.col(f"c_{m}") + PRIOR)).alias(m) for m in models])
    unit = lambda x, y: F.round((F.log(x) - F.log(y)) * UNIT).cast("long")
    return lean.select("gram", unit("a", "r").alias("s"), unit("a0", "r0").alias("s0"), unit("a1", "r1").alias("s1"))


def _spread(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (h1, h2, gram, n) of the distinct grams of a URL that are not hot."""
    for batch in batches:
        urls = _bytes(batch.column("url"))
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        for a, b in _pieces(urls):
            gram, row = _grams(urls[a:b])
            cold = ~np.isin(gram, hot)
            row, gram = row[cold], gram[cold]
            order = np.lexsort((gram, row))
            row, gram = row[order], gram[order]
            start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])])[:len(row)])
            n = np.diff(np.append(start, len(row)))
            for i in range(0, len(start), 50_000):
                at = start[i:i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[a:b][row[at]], h2[a:b][row[at]], gram[at], n[i:i + 50_000])], names=["h1", "h2", "gram", "n"])


def _sum_hot(batches: Iterator[pa.RecordBatch], hot: np.ndarray, ratios: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row (h1, h2, s, s0, s1) per URL: the sums over its hot grams."""
    for batch in batches:
        urls = _bytes(batch.column("url"))
        out = np.zeros((3, len(urls)), dtype=np.int64)
        for a, b in _pieces(urls):
            gram, row = _grams(urls[a:b])
            at = np.searchsorted(hot, gram)
            known = np.flatnonzero(at < len(hot))
            known = known[hot[at[known]] == gram[known]]
            for k in range(3):
                np.add.at(out[k], a + row[known], ratios[k][at[known]])
        yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), *[pa.array(x) for x in out]], names=["h1", "h2", "s", "s0", "s1"])


def score_urls(urls: DataFrame) -> DataFrame:
    """``h1, h2, s, s0, s1`` for distinct URLs (h1, h2, url, kind, m): sums of the log ratios of their bytes, in ``1 / UNIT``.

    Counts are rows under literal keys and grow with the corpus. Grams that stand at one place in ``HOT`` or more are at
    most ``HOT`` and go to every task; the others are joined, and none of them has more than that share of the rows.
    """
    spark = urls.sparkSession
    counts = settle(urls.mapInArrow(_count, "gram long, n0 long, n1 long, n2 long, n3 long, n long").groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "n2", "n3", "n")]))
    total = counts.agg(F.sum("n")).first()[0] or 0
    ratios = settle(_ratios(counts))
    common = ratios.join(counts.where(F.col("n") * HOT >= total).select("gram"), "gram").orderBy("gram").toArrow()
    hot, of_hot = common.column("gram").to_numpy(), np.array([common.column(c).to_numpy() for c in ("s", "s0", "s1")])
    cold = (
        urls.select("h1", "h2", "url").mapInArrow(lambda batches: _spread(batches, hot), "h1 long, h2 long, gram long, n long")
        .join(ratios, "gram").select("h1", "h2", *[(F.col("n") * F.col(c)).alias(c) for c in ("s", "s0", "s1")])
    )
    warm = urls.select("h1", "h2", "url").mapInArrow(lambda batches: _sum_hot(batches, hot, of_hot), "h1 long, h2 long, s long, s0 long, s1 long")
    return cold.unionByName(warm).groupBy("h1", "h2").agg(*[F.sum(c).alias(c) for c in ("s", "s0", "s1")])


class UrlModels:
    """Two smoothed variable-order Markov models as hashed counter tables of fixed size, for lists of URLs on one machine.

    ``judge_urls`` does not use them: its counts are rows under literal keys.
    """

    def __init__(self, accepted: np.ndarray, rejected: np.ndarray):
        self.tables = accepted.astype(np.float32), rejected.astype(np.float32)

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """Log likelihood under the accepted minus under the rejected model, per byte; 0 for an empty URL."""
        out = np.zeros(len(urls))
        for a, b in _pieces(urls):
            contexts, grams, row = _slots(urls[a:b])
            logs = np.zeros(len(row))
            for sign, counts in zip((1, -1), self.tables):
                p = np.full(len(row), 1 / 256)
                for k in range(ORDER + 1):  # each order leans on the next shorter one
                    p = (counts[grams[k]] + PRIOR * p) / (counts[(1 << NGRAM_BITS) + contexts[k]] + PRIOR)
                logs += sign * np.log(p)
            lengths = np.bincount(row, minlength=b - a)
            out[a:b] = np.bincount(row, weights=logs, minlength=b - a) / np.maximum(lengths, 1)
        return out


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict for every URL: ``page_id, host, path, rule, verdict, score, threshold``, one row per input row.

    URLs that a rule decides are the accepted and rejected training texts, all of them. Counts of contexts and
    continuations of order 0 to 5 are rows under literal keys that grow with the input; distinct URLs are scored by
    joining their bytes with them. Each of two folds is scored by the counts of the other; the
    threshold is where the balanced accuracy of these scores is best. The rest of the URLs is allowed from that
    threshold on. A null URL counts as empty; an empty one scores 0. Without URLs of both kinds nothing is
    blocked by the model. Repeated rows get equal rows.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                         F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    parts = parts.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).select(
        "page_id", "url", "host", "path", F.col("rule.rule").alias("rule"), F.col("rule.verdict").alias("given"))
    parts = settle(parts)
    key = [F.xxhash64("url").alias("h1"), F.xxhash64(F.lit(1), "url").alias("h2")]
    kind = F.when(F.col("given").isNull(), -1).otherwise(2 * F.pmod(F.crc32(F.encode("url", "UTF-8")), F.lit(2)) + (F.col("given") == "block").cast("int")).cast("int")
    urls = settle(parts.groupBy("url", "given").agg(F.count("*").alias("m")).select(*key, "url", kind.alias("kind"), "m"))
    size = F.greatest(F.octet_length("url"), F.lit(1)) * UNIT
    scores = settle(urls.select("h1", "h2", "kind", "m", size.alias("size")).join(score_urls(urls), ["h1", "h2"]).select(
        F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "kind", "m", (F.col("s") / F.col("size")).alias("score"),
        (F.when(F.col("kind") < 2, F.col("s1")).otherwise(F.col("s0")) / F.col("size")).alias("held")))  # held: by the fold that did not see the URL
    threshold = float("-inf")
    learnt = scores.where("kind >= 0").groupBy(F.floor(F.col("held") / BIN).alias("bin"), (F.col("kind") % 2).alias("bad")).agg(F.sum("m").alias("m")).collect()
    if len({r.bad for r in learnt}) == 2:
        threshold = _best_cut([(r.bin, r.bad, r.m) for r in learnt]) * BIN
    scored = parts.withColumns({"h1": key[0], "h2": key[1]}).join(scores.select("_h1", "_h2", "score"), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"),
                         "score", F.lit(threshold).alias("threshold"))


def _best_cut(bins: list[tuple[int, int, int]]) -> int:
    """The bin from which on URLs are allowed, by balanced accuracy; the middle one of equally good bins, empty ones included."""
    good = sum(n for _, bad, n in bins if not bad) or 1
    poor = sum(n for _, bad, n in bins if bad) or 1
    kept, passed, found = good, poor, []
    by: dict[int, list[int]] = {}
    for b, bad, n in bins:
        by.setdefault(b, [0, 0])[bad] += n
    after = min(by)
    for b in sorted(by) + [max(by) + 1]:
        found.append((kept / good - passed / poor, after, b))
        after = b + 1
        kept -= by.get(b, [0, 0])[0]
        passed -= by.get(b, [0, 0])[1]
    best = max(x for x, *_ in found)
    level = [(a, b) for x, a, b in found if x == best]
    skip = sum(b - a + 1 for a, b in level) // 2
    for a, b in level:
        if skip <= b - a:
            return a + skip
        skip -= b - a + 1
    raise AssertionError("no bin")


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)
