"""Seeded splits, folds and bootstrap weights that depend on row keys alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, small_side

NAMES = ("train", "valid", "test")


def key_hash(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))


def hash_number(hashed: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("bigint")


def _check(p: Sequence[float]) -> None:
    if len(p) != 3 or abs(sum(p) - 1) > 1e-9:
        raise ValueError("three proportions that sum to 1 are needed")


def stratified_split(df: DataFrame, key: str, strata: str, p: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 1,
                     name: str = "split") -> DataFrame:
    """Exact proportions inside each stratum: rows by order of a seeded hash of the key, cut at the shares.

    A stratum may hold most rows, so it is never sorted whole. Rows are counted by hash prefix,
    only the prefix that holds a cut is ranked to find the hash at the cut, and each row is
    then labelled by comparing its own hash.
    """
    _check(p)
    h = key_hash(seed, key)
    hashed = df.select(F.col(strata).alias("_s"), h.alias("_h"))
    counts = settle(hashed.groupBy("_s", F.substring("_h", 1, 4).alias("_b")).agg(F.count("*").alias("_n")))
    w = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_n").over(Window.partitionBy("_s"))
    spots = counts.select("_s", "_b", "_n", F.sum("_n").over(w).alias("_cum"), total.alias("_all")).select(
        "*", F.explode(F.array(F.struct(F.lit(1).alias("c"), F.round(p[0] * F.col("_all")).cast("long").alias("at")),
                               F.struct(F.lit(2).alias("c"), F.round((p[0] + p[1]) * F.col("_all")).cast("long").alias("at"))
                               )).alias("_cut"))
    spots = spots.filter((F.col("_cum") - F.col("_n") < F.col("_cut.at")) & (F.col("_cut.at") <= F.col("_cum"))).select(
        F.col("_s").alias("_s2"), F.col("_b").alias("_b2"), F.col("_cut.c").alias("_c"),
        (F.col("_cut.at") - (F.col("_cum") - F.col("_n"))).alias("_rank"))
    near = hashed.join(small_side(spots), F.col("_s").eqNullSafe(F.col("_s2")) & (F.substring("_h", 1, 4) == F.col("_b2")))
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_c").orderBy("_h")))
    cuts = ranked.filter("_r = _rank").groupBy(F.col("_s").alias("_s3")).agg(
        F.max(F.when(F.col("_c") == 1, F.col("_h"))).alias("_c1"), F.max(F.when(F.col("_c") == 2, F.col("_h"))).alias("_c2"))
    label = (F.when(h <= F.coalesce("_c1", F.lit("")), NAMES[0])
             .when(h <= F.coalesce("_c2", F.lit("")), NAMES[1]).otherwise(NAMES[2]))
    return df.join(small_side(cuts), F.col(strata).eqNullSafe(F.col("_s3")), "left").select(*df.columns, label.alias(name))


def grouped_split(df: DataFrame, group: str, p: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 1,
                  name: str = "split") -> DataFrame:
    """Whole groups go to one side, by a seeded hash of the group key; no shuffle."""
    _check(p)
    u = hash_number(key_hash(seed, group)) / F.lit(4294967296.0)
    return df.withColumn(name, F.when(u < p[0], NAMES[0]).when(u < p[0] + p[1], NAMES[1]).otherwise(NAMES[2]))


def split_shares(df: DataFrame, strata: str, name: str = "split") -> DataFrame:
    """Rows and share of the stratum per split."""
    counts = df.groupBy(strata, name).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(strata)))


def merge_splits(df: DataFrame, merged: Sequence[str] = ("valid", "test"), to: str = "test", name: str = "split") -> DataFrame:
    return df.withColumn(name, F.when(F.col(name).isin(list(merged)), to).otherwise(F.col(name)))


def fold_of(key: str, k: int = 5, seed: int = 1) -> Column:
    return (hash_number(key_hash(seed, key)) % k).cast("int")


def bootstrap_rows(df: DataFrame, key: str, replicates: int, seed: int = 1) -> DataFrame:
    """Poisson(1) resampling weights: ``replicate`` and ``weight`` per kept row, from a seeded hash."""
    rows = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    u = hash_number(F.md5(F.concat_ws("|", F.lit(str(seed)), "replicate", key))) / F.lit(4294967296.0)
    weight, total, mass, step = F.lit(0), 0.36787944117144233, 0.36787944117144233, 0
    while step < 12:  # P(more than 12) is below the resolution of the hash
        weight = weight + F.when(u >= total, 1).otherwise(0)
        step += 1
        mass /= step
        total += mass
    return rows.withColumn("weight", weight).filter("weight > 0")
