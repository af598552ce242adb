"""Pieces that several operators share: narrow inputs, gapless numbering, connected components."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapsewise.session import settle

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def number_rows(df: DataFrame, group: str, key: Column, out: str, bits: int = 12) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order of a 64-bit hash ``key``.

    The leading ``bits`` of the hash cut a group into slices; a window numbers each slice and the slice
    totals, at most ``2 ** bits`` per group, shift it. No group is sorted in one task.
    """
    sliced = df.withColumn("_key", key).withColumn("_slice", F.shiftright(F.col("_key"), 64 - bits))
    ahead = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(F.col(group).alias("_g"), F.col("_slice").alias("_s")).agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    )
    inside = Window.partitionBy(group, "_slice").orderBy("_key", *[c for c in df.columns if c != group])
    return (
        sliced.withColumn("_r", F.row_number().over(inside) - 1)
        .join(starts, (F.col(group) == F.col("_g")) & (F.col("_slice") == F.col("_s")))
        .withColumn(out, F.col("_start") + F.col("_r"))
        .drop("_key", "_slice", "_g", "_s", "_start", "_r")
    )


def tidy(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints of steps that nothing refers to any more.

    It does so when the driver collects its garbage, which a driver with little work seldom does by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


EDGES = 250_000  # rows of the edge table that a task of a round takes


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest member of each connected component: columns ``node`` and ``root``.

    ``edges`` has columns ``a`` and ``b`` (any order, repeats allowed). Alternating star contraction: each
    node hands the smallest of its neighbours to its larger, then to its smaller neighbours, until every edge
    points at a root. The steps of a round run in as many tasks as the edges fill, so a small table does not
    leave a file per shuffle partition behind. Only sums of the edge table come to the driver. Raises if it has not settled
    after ``max_rounds``; the number of rounds grows with the logarithm of the longest path.
    """
    pairs = settle(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct())
    mark, tasks = None, -(-2 * pairs.count() // EDGES) or 1
    for _ in range(max_rounds):
        pairs = pairs.coalesce(tasks)
        both = pairs.unionByName(pairs.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("n"), F.least("m", "hi").alias("m"))
        # large star: larger neighbours of n go to n's least neighbour (n itself included)
        large = (
            both.where("lo > hi").select(F.col("hi").alias("n"), F.col("lo").alias("far")).join(least, "n")
            .select(F.col("far").alias("hi"), F.col("m").alias("lo")).where("hi != lo").coalesce(tasks)
        )
        # small star: n and its smaller neighbours go to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "n")
        small = large.join(low, large["hi"] == low["n"]).select(
            F.explode(F.array(F.struct(F.col("lo").alias("x"), F.col("m")), F.struct(F.col("hi").alias("x"), F.col("m")))).alias("e")
        )
        pairs = settle(small.select(F.col("e.x").alias("hi"), F.col("e.m").alias("lo")).where("hi != lo").coalesce(tasks).distinct().coalesce(tasks))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark:
            roots = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        mark = now
        del both, least, large, low, small
        tidy(edges.sparkSession)
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
