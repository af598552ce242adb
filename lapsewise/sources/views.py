"""Listing-shaped and corpus-shaped views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean
from .tables import spread, table

HORIZON = 20.0


def listing(spark: SparkSession, folder: str, dims: bool = False) -> DataFrame:
    """One row per line item as a home on sale; ``dims`` also joins customer and part."""
    items = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    df = items.join(orders, items.l_orderkey == orders.o_orderkey)
    cols = [
        F.md5(F.concat_ws(
            "|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.col("l_shipdate").cast("date"),
        )).alias("obs"),
        F.col("o_orderdate").cast("date").alias("listed_date"),
        F.col("l_shipdate").cast("date").alias("sold_date"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("event"),
        F.col("l_extendedprice").alias("listed_price"),
        F.col("o_totalprice").alias("sold_price"),
        F.col("l_quantity").alias("lot_area"),
        F.col("l_linenumber").cast("double").alias("bed"),
        F.col("o_orderpriority").alias("heating"),
        F.col("l_returnflag").alias("outdoor"),
    ]
    if dims:
        customer, part = table(spark, folder, "customer"), table(spark, folder, "part")
        df = df.join(customer, df.o_custkey == customer.c_custkey).join(part, df.l_partkey == part.p_partkey)
        cols += [
            F.col("p_size").cast("double").alias("bath"),
            F.col("p_retailprice").alias("living_area"),
            F.col("c_mktsegment").alias("parking"),
            F.col("p_type").alias("type"),
        ]
    return df.select(*cols)


def survival(spark: SparkSession, folder: str, dims: bool = False) -> DataFrame:
    """Listings with a positive interval, duration in months, censored at the horizon."""
    df = clean.positive_intervals(listing(spark, folder, dims), "listed_date", "sold_date")
    df = df.withColumn("sale_time", clean.months_between("listed_date", "sold_date"))
    df = clean.scale_units(df, {"listed_price": 100000})
    return clean.censor_at(df, "sale_time", "event", HORIZON)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"), "doc_id")


def text_survival(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as homes: length as time, the quality label as event."""
    docs = spread(table(spark, folder, "documents"), "doc_id")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "text", "lang", "source",
        (F.col("n_chars") / 1000.0).alias("time"),
        F.coalesce(F.col("quality"), F.lit(0)).cast("int").alias("event"),
    )


# The same views for the comparison SQL.
LISTING_SQL = """listing AS (
  SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
             CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_shipdate AS DATE))) AS obs,
         CAST(o_orderdate AS DATE) AS listed_date, CAST(l_shipdate AS DATE) AS sold_date,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS event,
         l_extendedprice AS listed_price, o_totalprice AS sold_price, l_quantity AS lot_area,
         CAST(l_linenumber AS DOUBLE) AS bed, o_orderpriority AS heating, l_returnflag AS outdoor,
         CAST(p_size AS DOUBLE) AS bath, p_retailprice AS living_area, c_mktsegment AS parking, p_type AS type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""

SURVIVAL_SQL = LISTING_SQL + """, timed AS (
  SELECT *, CAST(sold_date - listed_date AS BIGINT) / 30.4375 AS months FROM listing WHERE listed_date < sold_date),
survival AS (
  SELECT obs, listed_date, sold_date, listed_price / 100000.0 AS listed_price, sold_price, lot_area, bed, bath,
         living_area, heating, outdoor, parking, type,
         CASE WHEN months > 20 THEN 1 ELSE 0 END AS to_modify,
         CASE WHEN months > 20 THEN 0 ELSE event END AS event,
         CASE WHEN months > 20 THEN CAST(20 AS DOUBLE) ELSE CAST(months AS DOUBLE) END AS sale_time FROM timed)"""

TEXT_SURVIVAL_SQL = """text_survival AS (
  SELECT d.doc_id, d.text, d.lang, d.source, n_chars / CAST(1000 AS DOUBLE) AS time,
         CAST(coalesce(quality, 0) AS INTEGER) AS event
  FROM documents d LEFT JOIN labels USING (doc_id))"""
