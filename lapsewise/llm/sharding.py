"""Cut a table into output shards of near equal size by sampled splitters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lapsewise.session import settle

from .common import number_rows, table, text_size

SAMPLE = 8192  # expected splitter candidates per round, over all ranges
HEAVY = 64  # a group above 1/HEAVY of a shard is placed by itself; there are at most HEAVY * shards of those
EVEN = 1024  # a cut may be off by 1/EVEN of a shard


def _splitters(sample: list[tuple[int, float]], pieces: int) -> list[int]:
    """Keys at the size-weighted quantiles of a sample; ranges are (previous, key]."""
    mass, goal, out = sum(w for _, w in sample), 1, []
    run = 0.0
    for key, w in sample:
        run += w
        while goal < pieces and run >= mass * goal / pieces:
            if not out or out[-1] != key:
                out.append(key)
            goal += 1
    return out


def _range_of(bounds: list[int]):
    """Number of the range of a key; the bounds are few, a comparison tree stays in generated code."""
    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("key") <= F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds)).cast(IntegerType())


def _cuts(light: DataFrame, total: int, goals: list[float], slack: float, seed: int) -> list[int]:
    """A key for each goal such that the groups up to it weigh the goal, within ``slack`` or one group.

    Keys are drawn with chance proportional to size and splitters taken at their weighted quantiles. The exact
    sizes of the ranges between splitters place each goal in one range. A range that holds a goal and is still
    overfull for the slack is subdivided by a fresh sample of its own; each round halves it at the least.
    """
    low, high = -(1 << 63), (1 << 63) - 1
    spans = [(low, high, 0.0, float(total), list(range(len(goals))))]  # after, up to, size before, size, goals inside
    cuts = [high] * len(goals)
    for step in range(64):
        edges = sorted({e for s in spans for e in s[:2]} - {low, high})
        inside = {i: s for s in spans for i in range(len(edges) + 1) if (i == 0 or edges[i - 1] >= s[0]) and (edges[i] if i < len(edges) else high) <= s[1]}
        at = light.withColumn("span", _range_of(edges)).where(F.col("span").isin(list(inside)))
        rate = F.lit(0.0)
        for i, s in inside.items():
            rate = F.when(F.col("span") == i, F.lit(SAMPLE / len(inside) / max(s[3], 1.0))).otherwise(rate)
        draw = F.shiftrightunsigned(F.xxhash64("key", F.lit(seed + step)), 11).cast("double") / float(1 << 53)
        drawn = (at.withColumn("p", F.least(F.lit(1.0), F.col("size") * rate)).where(draw < F.col("p"))
                 .select("span", "key", (F.col("size") / F.col("p")).alias("w")).collect())
        bounds = set(edges)
        for i, (after, upto, *_) in inside.items():
            new = _splitters(sorted((r.key, r.w) for r in drawn if r.span == i), max(2, 512 // len(inside)))
            bounds |= {b for b in new if after < b < upto} or {(after + upto) // 2}
        bounds = sorted(bounds)
        sizes = {r.range: (r.size, r.n) for r in at.groupBy(_range_of(bounds).alias("range"))
                 .agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
        fresh = {}
        for after, upto, run, _, held in spans:
            ends = []
            for i, b in enumerate([*bounds, high]):
                a = bounds[i - 1] if i else low
                if after <= a and b <= upto:
                    size, n = sizes.get(i, (0, 0))
                    ends.append((a, b, run, run + size, n))
                    run += size
            for g in held:
                a, b, start, end, n = next((e for e in ends if e[3] >= goals[g]), ends[-1])
                if min(abs(end - goals[g]), abs(start - goals[g])) <= slack or n <= 1:
                    cuts[g] = b if abs(end - goals[g]) <= abs(start - goals[g]) else a
                else:
                    fresh.setdefault((a, b), (a, b, start, end - start, []))[4].append(g)
        spans = list(fresh.values())
        if not spans:
            return cuts
    raise RuntimeError("the key ranges could not be subdivided to the goals")


def shard_by_size(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal size; equal texts share a shard.

    Returns ``doc_id, size, text_crc32, shard, slot``, one row per input row. ``size`` is the UTF-8 bytes of the
    text plus 1. The key is a hash of the text. Splitters are drawn by size, ranges that hold a shard's end and
    weigh too much are subdivided by new samples, so cuts are exact to 1/1024 of a shard or one group.
    Groups of equal texts above 1/64 of a shard (a number bounded by the shards) are placed one by one where
    room is left; only a group above a whole shard is divided, by a hash of its ids. Null texts weigh 1 and
    are one group, as are empty ones. Repeated rows go together. Slots follow a hash of the row, so a shard is also shuffled; slots of
    fully equal rows are interchangeable. An empty table gives an empty result.
    """
    rows = settle(docs.select(
        F.col(id_col).alias("doc_id"),
        (text_size(F.col(text_col)) + 1).alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")).alias("text_crc32"),
        F.when(F.col(text_col).isNull(), F.xxhash64(F.lit("null"), F.lit(1))).otherwise(F.xxhash64(F.col(text_col))).alias("key"),
    ))
    groups = settle(rows.groupBy("key").agg(F.sum("size").alias("size")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    heavy = sorted(((r.size, r.key) for r in groups.where(F.col("size") > share / HEAVY).select("key", "size").collect()), reverse=True)
    light = groups.where(F.col("size") <= share / HEAVY)

    # groups above a shard: pieces by a hash of the id, each at most a quarter shard on average
    split = {key: -(-4 * size // max(int(share), 1)) for size, key in heavy if size > share}
    piece = F.lit(0)
    for key, n in split.items():
        piece = F.when(F.col("key") == F.lit(key), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(int(n)))).otherwise(piece)
    rows = rows.withColumn("piece", piece.cast("int"))
    parts = [(size, key, 0) for size, key in heavy if key not in split]
    if split:
        cut = rows.where(F.col("key").isin(list(split))).groupBy("key", "piece").agg(F.sum("size").alias("size")).collect()
        parts += [(r.size, r.key, r.piece) for r in cut]
    load, home = [0] * shards, {}
    for size, key, p in sorted(parts, reverse=True):
        s = min(range(shards), key=lambda i: (load[i], i))
        load[s] += size
        home[key, p] = s

    # the light groups fill what is left of each shard, in key order
    rest = total - sum(load)
    level = _fill_level(load, rest)
    room = [max(0.0, level - x) for x in load]
    goals = [sum(room[: i + 1]) for i in range(shards - 1)]
    cuts = _cuts(light, rest, goals, share / EVEN, seed) if rest else []
    shard = _range_of(cuts) if cuts else F.lit(0)
    named = docs.sparkSession.createDataFrame(
        [(k, p, s) for (k, p), s in home.items()], "key long, piece int, home int")
    placed = (
        rows.join(F.broadcast(named), ["key", "piece"], "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("home", shard).cast("int").alias("shard"))
    )
    return number_rows(placed, "shard", F.xxhash64("doc_id", "text_crc32", "size", F.lit(seed)), "slot")


def _fill_level(load: list[int], rest: float) -> float:
    """The level up to which ``rest`` fills shards that already hold ``load``."""
    up = sorted(load)
    for n in range(1, len(up) + 1):
        level = (rest + sum(up[:n])) / n
        if n == len(up) or level <= up[n]:
            return level
    return 0.0


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_size(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
