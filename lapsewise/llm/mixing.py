"""Mix sources to target weights with a multivariate-hypergeometric splitting tree over blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapsewise.session import settle

from .common import number_rows, table, word_count

BLOCKS = 1024  # blocks per source, whatever its size; a block is the unit that is dealt to shards
LIST = 10_000  # a source list up to this length is broadcast


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Split ``share`` of all sizes by weight; none above ``cap`` times its size, the excess reshared by weight."""
    budget, free, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        mass = sum(weights[i] for i in free)
        over = {i for i in free if budget * weights[i] / mass > cap * sizes[i]} if mass > 0 else set()
        if not over:
            for i in free:
                out[i] = budget * weights[i] / mass if mass > 0 else 0.0
            return out
        for i in over:
            out[i] = float(cap * sizes[i])
            budget -= out[i]
        free -= over
    return out


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources), exact in both directions.

    A node of the tree halves its shards; the left half gets its share of the node's blocks, drawn without
    replacement, so the counts per source follow the multivariate hypergeometric law.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def node(have: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = have
            return
        mid = (first + last) // 2
        take = int(have.sum()) * (mid - first) // (last - first)
        rng = np.random.default_rng([seed, first, last])
        left = np.zeros_like(have)
        rest = int(have.sum())
        for i, n in enumerate(have):  # conditional draws, one source after the other
            rest -= int(n)
            left[i] = rng.hypergeometric(int(n), rest, take) if n and take and rest else min(int(n), take)
            take -= int(left[i])
        node(left, first, mid)
        node(have - left, mid, last)

    node(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def mix(docs: DataFrame, weight_of: Callable[[int], float], share: float = 1.5, cap: float = 2.0, shards: int = 8, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Decide for every document how often the mix takes it, and into which shards.

    Returns ``doc_id, source, size, source_size, target, shards, key``, one row per input row; ``shards`` has one entry per
    copy. The source with place ``i`` in code point order (null last) has weight ``weight_of(i)``. Documents fall
    into 1024 blocks per source by hash. A target takes the source whole as often as it fits; the
    remainder takes whole blocks in the order of a permutation, documents of one more block in hashed
    order, and the one document that fits best. The splitting tree gives each shard its exact number of blocks
    per source, and runs of the permuted blocks fill them, so no block copy is used twice. The same input gives the
    same mix. The driver sees one row per source, the list that carries the weights. Null texts have size 0, empty
    sources target 0; fully equal rows are treated alike; an empty table gives an empty result.
    """
    rows = settle(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("key"),
    ).withColumn("block", F.pmod("key", F.lit(BLOCKS)).cast("int")))
    blocks = settle(rows.groupBy("source", "block").agg(F.sum("size").alias("words")))
    sums = {r.source: (r.words, r.n) for r in blocks.groupBy("source").agg(F.sum("words").alias("words"), F.count("*").alias("n")).collect()}
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    sizes = [sums[s][0] for s in names]
    goal = targets(sizes, [weight_of(i) for i in range(len(names))], share, cap)
    whole = [min(int(t // n), int(cap)) if n else 0 for t, n in zip(goal, sizes)]
    plan = docs.sparkSession.createDataFrame(
        [(s, i, n, t, w, t - w * n, sums[s][1]) for i, (s, n, t, w) in enumerate(zip(names, sizes, goal, whole))],
        "name string, src int, source_size long, target double, whole int, rest double, n_blocks long")
    plan = F.broadcast(plan) if len(names) <= LIST else plan
    blocks = blocks.join(plan, F.col("source").eqNullSafe(F.col("name")))

    # the remainder: blocks in permuted order while they fit, and the one that no longer does
    order = Window.partitionBy("src").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block")
    upto = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    blocks = settle(
        blocks.withColumn("before", upto - F.col("words"))
        .withColumn("state", F.when((F.col("rest") <= 0) | (F.col("before") >= F.col("rest")), 0)
                    .when(F.col("before") + F.col("words") <= F.col("rest"), 2).otherwise(1))
        .withColumn("place", F.row_number().over(order) - 1)
    )
    quota = {r.src: r.n for r in blocks.groupBy("src").agg(F.sum(F.col("whole") + (F.col("state") > 0).cast("int")).alias("n")).collect()}
    dealt = split_quotas([quota[i] for i in range(len(names))], shards, seed).cumsum(axis=0)
    ends = docs.sparkSession.createDataFrame(
        [(i, [int(x) for x in dealt[:, i]]) for i in range(len(names))], "src int, ends array<long>")
    # slot of a block copy: copy after copy, each in a permutation of its own; the remainder comes last
    copies = blocks.select("src", "block", F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("copy"),
                           "whole", "state", "place", "n_blocks").where("copy < whole OR state > 0")
    own = Window.partitionBy("src", "copy").orderBy(F.xxhash64("block", "copy", F.lit(seed + 2)), "block")
    slots = (
        copies.withColumn("slot", F.col("copy") * F.col("n_blocks")
                          + F.when(F.col("copy") < F.col("whole"), F.row_number().over(own) - 1).otherwise(F.col("place")))
        .join(F.broadcast(ends) if len(names) <= LIST else ends, "src")
        .groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct(
            "copy", F.size(F.filter("ends", lambda e: e <= F.col("slot"))).alias("shard")))).alias("copies"))
    )
    blocks = blocks.join(slots, ["src", "block"], "left").select(
        "src", F.col("source").alias("_source"), F.col("block").alias("_block"), "source_size", "target", "whole", "rest", "before", "state",
        F.coalesce(F.transform("copies", lambda c: c["shard"]), F.array().cast("array<int>")).alias("deal"))
    rows = settle(rows.join(blocks, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))).drop("_source", "_block"))

    # inside the one partial block of a source: documents in hashed order while they fit
    inner = Window.partitionBy("src").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    partial = rows.where("state = 1").withColumn("took", (F.col("before") + F.sum("size").over(inner) <= F.col("rest")).cast("int"))
    rows = settle(partial.unionByName(rows.where("state <> 1").withColumn("took", (F.col("state") == 2).cast("int"))))
    gap = rows.groupBy("src").agg((F.first("rest") - F.sum(F.col("size") * F.col("took"))).alias("gap")).where("gap > 0")
    gap = F.broadcast(gap) if len(names) <= LIST else gap
    best = (
        rows.where("took = 0 AND size > 0").join(gap, "src")
        .groupBy("src").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "key", "doc_id")).alias("m"), F.first("gap").alias("gap"))
        .where("m.off < gap").select(F.col("src").alias("_src"), F.col("m.key").alias("_key"), F.col("m.doc_id").alias("_id"))
    )
    best = F.broadcast(best) if len(names) <= LIST else best
    return (
        rows.join(best, (F.col("src") == F.col("_src")) & (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        .withColumn("took", F.greatest("took", F.col("_src").isNotNull().cast("int")))
        .withColumn("n", F.col("whole") + F.col("took"))
        # the best fitting document goes to a shard of its block, or by hash if its block has no copy there
        .withColumn("shards", F.when(F.size("deal") >= F.col("n"), F.slice("deal", 1, F.col("n")))
                    .otherwise(F.concat("deal", F.array(F.pmod("key", F.lit(shards)).cast("int")))))
        .select("doc_id", "source", "size", "source_size", "target", "shards", "key")
    )


def mixed_rows(plan: DataFrame, seed: int = 7) -> DataFrame:
    """One row per copy of a ``mix`` plan: ``doc_id, copy, shard, slot``; the slots shuffle each shard."""
    spread = plan.select("doc_id", "key", F.posexplode("shards").alias("copy", "shard"))
    return number_rows(spread, "shard", F.xxhash64("key", "copy", F.lit(seed + 3)), "slot").drop("key")


def mixed_documents(docs: DataFrame, weight_of: Callable[[int], float], share: float = 1.5, cap: float = 2.0, shards: int = 8, seed: int = 7,
                    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of a mix, one row per copy with the columns of ``docs``, dealt to shards and shuffled inside them."""
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    plan = mix(docs, weight_of, share, cap, shards, seed, id_col, text_col, source_col).groupBy(F.col("key").alias("_key")).agg(F.first("shards").alias("_shards"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("_k"))
    copies = rows.join(plan, F.col("_k") == F.col("_key")).select("row", "_k", F.posexplode("_shards").alias("_copy", "_shard"))
    order = F.xxhash64("_k", "_copy", F.lit(seed + 3))
    return copies.repartition("_shard", F.shiftright(order, 57)).sortWithinPartitions("_shard", order).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents"), lambda i: (5, 2, 1)[i % 3])
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards")
