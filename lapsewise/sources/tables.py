"""Readers and writers: listing CSV files, Parquet feature tables, score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TEXT_COLUMNS = (
    "listed_date", "sold_date", "listed_price", "sold_price", "year_built", "bath", "bed", "living_area",
    "lot_area", "heating", "cooling", "parking", "outdoor", "pool", "type", "subtype", "restaurants",
    "groceries", "nightlife", "description", "description_cased",
)

# Everything is read as text; the cleaning verbs cast, so a bad cell becomes null instead of a lost row.
LISTING_SCHEMA = T.StructType(
    [T.StructField("X", T.StringType())] + [T.StructField(c, T.StringType()) for c in _TEXT_COLUMNS]
)


def read_listing_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Listing files that share a schema, with a header row; quoted text may span lines."""
    return (
        spark.read.schema(LISTING_SCHEMA)
        .option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "NA")
        .csv(list(paths))
    )


def write_listing_csv(df: DataFrame, path: str) -> None:
    """Listing rows as ``read_listing_csv`` takes them; null becomes ``NA``."""
    df.select(*LISTING_SCHEMA.names).write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "NA").csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_features(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """One directory per representation; a degradation level is a partition column."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """A feature table in the session's warehouse, bucketed and sorted by key; tables with equal buckets join without a shuffle.

    Rows are dealt by key first, so each bucket is one file.
    """
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def write_scores(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """The long score table, as Parquet or CSV."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a scan out by key when it has fewer splits than the session has cores.

    Such a scan is small by that very fact, so the extra shuffle is too; a large scan is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
