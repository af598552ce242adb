"""Queries over the listing view: cleaning, joins, sets, statistics, Kaplan-Meier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, metrics, stats, survival
from ..session import shuffle_width
from ..sources import tables, views
from ..sources.tables import table
from ..sources.views import LISTING_SQL, SURVIVAL_SQL
from .registry import query

L = "WITH " + LISTING_SQL
S = "WITH " + SURVIVAL_SQL


def _r(col: str, n: int = 6, name: str | None = None):
    return F.round(F.col(col), n).alias(name or col)


# --- cleaning -------------------------------------------------------------------------------

@query("clean_listing", S + """
SELECT obs, CAST(listed_price AS DOUBLE) AS listed_price, sale_time, event, to_modify, lot_area / 1000 AS lot_area,
       bed AS num_bed, bath AS num_bath, CASE WHEN heating = '4-NOT SPECIFIED' THEN 'No_Info' ELSE heating END AS I_heating,
       CASE WHEN parking IN ('BUILDING', 'MACHINERY') THEN parking ELSE 'Yes' END AS I_parking,
       outdoor AS I_outdoor, type AS I_type FROM survival""")
def clean_listing(spark, sf):
    df = views.survival(spark, sf, dims=True)
    df = clean.fill_sentinel(df, ["heating", "parking"], also="4-NOT SPECIFIED")
    df = clean.collapse_levels(df, ["parking"], keep=["BUILDING", "MACHINERY"])
    df = clean.scale_units(df, {"lot_area": 1000})
    df = clean.rename_roles(df, {"bed": "num_bed", "bath": "num_bath", "heating": "I_heating",
                                 "parking": "I_parking", "outdoor": "I_outdoor", "type": "I_type"})
    df = clean.recode_exact(df, ["I_heating", "I_parking"], {"No Info": "No_Info"})
    return df.select("obs", "listed_price", "sale_time", "event", "to_modify", "lot_area", "num_bed", "num_bath",
                     "I_heating", "I_parking", "I_outdoor", "I_type")


@query("cast_columns", """
SELECT l_orderkey, l_partkey, l_linenumber, TRY_CAST(l_returnflag AS DOUBLE) AS flag_number,
       TRY_CAST(CAST(l_linenumber AS VARCHAR) AS DOUBLE) AS line_number,
       CAST(l_shipdate AS DATE) AS shipped, datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))::INTEGER AS shipped_day
FROM lineitem""")
def cast_columns(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.col("l_returnflag").alias("flag_number"),
        F.col("l_linenumber").cast("string").alias("line_number"), F.col("l_shipdate").alias("shipped"),
    )
    df = clean.to_dates(clean.to_numeric(df, ["flag_number", "line_number"]), ["shipped"])
    return df.withColumn("shipped_day", F.unix_date("shipped"))


@query("null_sentinel", """
SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'No Info' ELSE CAST(quality AS VARCHAR) END AS quality,
       CASE WHEN toxic IS NULL OR toxic = 0 THEN 'No Info' ELSE CAST(toxic AS VARCHAR) END AS toxic
FROM documents d LEFT JOIN labels USING (doc_id)""")
def null_sentinel(spark, sf):
    df = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return clean.fill_sentinel(clean.fill_sentinel(df, ["quality"]), ["toxic"], also="0")


@query("drop_null_rows", """
SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)
WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def drop_null_rows(spark, sf):
    df = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return clean.drop_null_rows(df, ["quality", "toxic"])


@query("ratio_filter", L + """
SELECT obs, round(sold_price / nullif(listed_price, 0), 6) AS price_ratio FROM listing
WHERE sold_price / nullif(listed_price, 0) < 20""")
def ratio_filter(spark, sf):
    return clean.ratio_filter(views.listing(spark, sf), "sold_price", "listed_price").select("obs", _r("price_ratio"))


@query("ratio_outliers", L + """
SELECT obs, listed_price, sold_price FROM listing WHERE sold_price / nullif(listed_price, 0) >= 20
ORDER BY sold_price, obs""")
def ratio_outliers(spark, sf):
    return clean.ratio_outliers(views.listing(spark, sf), "sold_price", "listed_price",
                                order=["sold_price", "obs"]).select("obs", "listed_price", "sold_price")


@query("topk_ratio", L + """
SELECT obs, round(sold_price / listed_price, 6) AS price_ratio FROM listing
ORDER BY sold_price / listed_price DESC, obs LIMIT 15""")
def topk_ratio(spark, sf):
    df = views.listing(spark, sf).withColumn("price_ratio", F.try_divide("sold_price", "listed_price"))
    return df.orderBy(F.desc("price_ratio"), "obs").limit(15).select("obs", _r("price_ratio"))


@query("bottomk_ratio", L + """
SELECT obs, round(sold_price / listed_price, 6) AS price_ratio FROM listing
ORDER BY sold_price / listed_price, obs LIMIT 15""")
def bottomk_ratio(spark, sf):
    df = views.listing(spark, sf).withColumn("price_ratio", F.try_divide("sold_price", "listed_price"))
    return df.orderBy("price_ratio", "obs").limit(15).select("obs", _r("price_ratio"))


@query("tied_intervals_head", L + """
SELECT obs, listed_date, sold_date FROM listing WHERE listed_date >= sold_date ORDER BY obs LIMIT 6""")
def tied_intervals_head(spark, sf):
    df = views.listing(spark, sf)
    return df.filter(F.col("listed_date") >= F.col("sold_date")).orderBy("obs").limit(6).select(
        "obs", "listed_date", "sold_date")


@query("recode_levels", L + """
SELECT obs, CASE WHEN type IN ('ECONOMY', 'STANDARD') THEN 'plain' WHEN type IN ('PROMO', 'SMALL') THEN 'special'
       ELSE type END AS type,
       CASE WHEN heating IN ('1-URGENT', '2-HIGH') THEN heating ELSE 'Yes' END AS heating FROM listing""")
def recode_levels(spark, sf):
    df = clean.recode(views.listing(spark, sf, dims=True), "type",
                      {"plain": ["ECONOMY", "STANDARD"], "special": ["PROMO", "SMALL"]})
    return clean.collapse_levels(df, ["heating"], keep=["1-URGENT", "2-HIGH"]).select("obs", "type", "heating")


@query("duration_months", L + """
SELECT obs, round(CAST(sold_date - listed_date AS BIGINT) / 30.4375, 6) AS sale_time,
       CAST(sold_date - listed_date AS INTEGER) AS days FROM listing WHERE listed_date < sold_date""")
def duration_months(spark, sf):
    df = clean.positive_intervals(views.listing(spark, sf), "listed_date", "sold_date")
    return df.select("obs", F.round(clean.months_between("listed_date", "sold_date"), 6).alias("sale_time"),
                     clean.days_between("listed_date", "sold_date").alias("days"))


@query("drop_year_span", L + """
SELECT obs, listed_date, sold_date FROM listing WHERE NOT (year(listed_date) <= 1996 AND year(sold_date) >= 1999)""")
def drop_year_span(spark, sf):
    return clean.drop_year_span(views.listing(spark, sf), "listed_date", "sold_date", 1996, 1999).select(
        "obs", "listed_date", "sold_date")


@query("admin_censor", S + "SELECT obs, to_modify, event, round(sale_time, 6) AS sale_time FROM survival")
def admin_censor(spark, sf):
    return views.survival(spark, sf).select("obs", "to_modify", "event", _r("sale_time"))


@query("threshold_filter", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size > 12")
def threshold_filter(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice").filter("p_size > 12")


_DEDUP_KEYS = ["lang", "source", "text"]


@query("dedup_keep_first", """
SELECT min(doc_id) AS doc_id, lang, source, md5(text) AS text_md5 FROM documents GROUP BY lang, source, text""")
def dedup_keep_first(spark, sf):
    df = views.corpus(spark, sf).select("doc_id", *_DEDUP_KEYS)
    return clean.dedup_keep_first(df, _DEDUP_KEYS, "doc_id").select(
        "doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@query("dup_groups", """
SELECT doc_id, n FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1""")
def dup_groups(spark, sf):
    return clean.duplicate_groups(views.corpus(spark, sf).select("doc_id", "text"), ["text"]).select("doc_id", "n")


@query("distinct_rows", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()


# --- joins and sets -------------------------------------------------------------------------

@query("union_by_name", L + """
SELECT obs, event, listed_price, CAST(NULL AS DOUBLE) AS price_ratio FROM listing WHERE event = 0
UNION ALL SELECT obs, event, listed_price, round(listed_price / sold_price, 6) FROM listing WHERE event = 1""")
def union_by_name(spark, sf):
    df = views.listing(spark, sf)
    sold = df.filter("event = 1").select("obs", "event", "listed_price",
                                         F.round(F.try_divide("listed_price", "sold_price"), 6).alias("price_ratio"))
    return clean.union_by_name(df.filter("event = 0").select("obs", "event", "listed_price"), sold)


@query("natural_left_join", """
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def natural_left_join(spark, sf):
    return clean.natural_left_join(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"))


@query("keyed_left_join", """
SELECT c_custkey, c_mktsegment, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def keyed_left_join(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return clean.keyed_left_join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), orders, ["c_custkey"])


@query("bind_columns", """
SELECT d.doc_id, d.lang, length(text) AS n_text, n_chars FROM documents d""")
def bind_columns(spark, sf):
    docs = table(spark, sf, "documents")
    return clean.bind_columns(
        [docs.select("doc_id", "lang"), docs.select("doc_id", F.length("text").cast("long").alias("n_text")),
         docs.select("doc_id", "n_chars")], "doc_id")


@query("reattach_missing", """
SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, '') AS note
FROM documents d LEFT JOIN labels USING (doc_id)""")
def reattach_missing(spark, sf):
    kept = table(spark, sf, "labels").filter("quality = 1").select("doc_id", F.lit("good").alias("note"))
    return clean.reattach_missing(table(spark, sf, "documents"), kept, "doc_id", "note")


@query("anti_exclusion", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source NOT IN ('src0', 'src3')""")
def anti_exclusion(spark, sf):
    docs = clean.exclude_keys(table(spark, sf, "documents").select("doc_id", "lang", "source"), "source", ["src0", "src3"])
    return clean.exclude_keys(docs, "doc_id", table(spark, sf, "labels")).select("doc_id", "lang")


@query("semi_membership", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_membership(spark, sf):
    toxic = table(spark, sf, "labels").filter("toxic = 1")
    return table(spark, sf, "documents").select("doc_id", "lang").join(toxic, "doc_id", "left_semi")


@query("symdiff", """
(SELECT l_orderkey AS ord FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
UNION (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def symdiff(spark, sf):
    items = table(spark, sf, "lineitem")
    flagged = lambda flag: items.filter(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("ord"))
    return clean.symmetric_difference(flagged("R"), flagged("A"))


@query("set_difference", """
SELECT c_custkey AS cust FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def set_difference(spark, sf):
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("cust"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("cust")).subtract(urgent)


# --- descriptive statistics -----------------------------------------------------------------

@query("freq", """
SELECT quality, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality""")
def freq(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return stats.frequencies(df, "quality").select("quality", "n", _r("pct"))


@query("crosstab_pct", S + """
SELECT heating, event, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
FROM survival GROUP BY heating, event""")
def crosstab_pct(spark, sf):
    return stats.crosstab(views.survival(spark, sf), "heating", "event").select("heating", "event", "n", _r("pct"))


@query("column_summary", S + """, long AS (
  SELECT 'listed_price' AS variable, CAST(listed_price AS DOUBLE) AS v FROM survival
  UNION ALL SELECT 'sale_time', sale_time FROM survival UNION ALL SELECT 'lot_area', lot_area FROM survival)
SELECT variable, round(min(v), 6) AS "min", round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS median,
       round(avg(v), 6) AS mean, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS "max",
       count(*) - count(v) AS n_null FROM long GROUP BY variable""")
def column_summary(spark, sf):
    df = stats.column_summary(views.survival(spark, sf), ["listed_price", "sale_time", "lot_area"])
    return df.select("variable", *[_r(c) for c in ("min", "q1", "median", "mean", "q3", "max")], "n_null")


_PROBS = [0.0, 0.0001, 0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@query("quantiles", f"""
WITH q AS (SELECT quantile_cont(l_extendedprice, {_PROBS}) AS q FROM lineitem)
SELECT CAST(prob AS DOUBLE) AS prob, round(value, 4) AS value
FROM (SELECT unnest({_PROBS}) AS prob, unnest(q) AS value FROM q)""")
def quantiles(spark, sf):
    return stats.quantiles(table(spark, sf, "lineitem"), "l_extendedprice", _PROBS).select("prob", _r("value", 4))


@query("median_by_group", S + """
SELECT event, CAST(0.5 AS DOUBLE) AS prob, round(median(sale_time), 6) AS value FROM survival GROUP BY event""")
def median_by_group(spark, sf):
    return stats.quantiles(views.survival(spark, sf), "sale_time", [0.5], by=["event"]).select("event", "prob", _r("value"))


@query("count_predicate", S + """
SELECT count(*) FILTER (WHERE sale_time >= 20) AS at_horizon, count(*) FILTER (WHERE event = 1) AS events,
       count(*) AS n FROM survival""")
def count_predicate(spark, sf):
    return views.survival(spark, sf).agg(
        F.count_if(F.col("sale_time") >= 20).alias("at_horizon"), F.count_if(F.col("event") == 1).alias("events"),
        F.count("*").alias("n"))


_HIST = """, span AS (SELECT min({x}) AS lo, max({x}) AS hi FROM survival), h AS (
  SELECT event, CAST(least(49, floor(({x} - lo) / ((hi - lo) / 50))) AS INTEGER) AS bin, lo, (hi - lo) / 50 AS w, count(*) AS n
  FROM survival, span GROUP BY ALL)
SELECT event, bin, round(lo + bin * w, 6) AS left_edge, n, round(n / (sum(n) OVER (PARTITION BY event) * w), 6) AS density FROM h"""


@query("hist_density", S + _HIST.format(x="sale_time"))
def hist_density(spark, sf):
    return stats.histogram(views.survival(spark, sf), "sale_time", 50, by=["event"]).select(
        "event", "bin", _r("left_edge"), "n", _r("density"))


@query("hist_log_density", S + _HIST.format(x="ln(sale_time)"))
def hist_log_density(spark, sf):
    df = views.survival(spark, sf).withColumn("log_time", F.log("sale_time"))
    return stats.histogram(df, "log_time", 50, by=["event"]).select(
        "event", "bin", _r("left_edge"), "n", _r("density"))


@query("kernel_density", """
WITH g AS (SELECT lang, count(*) AS n, stddev_samp(n_chars) AS sd,
                  quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25) AS iqr FROM documents GROUP BY lang),
     b AS (SELECT lang, n, 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS bw FROM g),
     x AS (SELECT CAST(500 * i AS DOUBLE) AS x FROM range(0, 64) t(i))
SELECT lang, x.x AS x, round(1000 * sum(exp(-0.5 * pow((x.x - n_chars) / bw, 2)) / (n * bw * sqrt(2 * pi()))), 6) AS density
FROM documents JOIN b USING (lang), x GROUP BY lang, x.x""")
def kernel_density(spark, sf):
    df = stats.kernel_density(table(spark, sf, "documents"), "n_chars", [500.0 * i for i in range(64)], by=["lang"])
    return df.select("lang", "x", F.round(1000 * F.col("density"), 6).alias("density"))


@query("level_table", S + """, l AS (
  SELECT DISTINCT 'heating' AS variable, heating AS level FROM survival
  UNION SELECT 'outdoor', outdoor FROM survival UNION SELECT 'type', type FROM survival)
SELECT variable, level, CAST(row_number() OVER (PARTITION BY variable ORDER BY level) - 1 AS INTEGER) AS rank FROM l""")
def level_table(spark, sf):
    return clean.level_table(views.survival(spark, sf, dims=True), ["heating", "outdoor", "type"])


# --- Kaplan-Meier ---------------------------------------------------------------------------

def _km_sql(by: str = "", hit: str = "n_event") -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return S + f""", t AS (
  SELECT {cols}sale_time AS time, sum(event)::BIGINT AS n_event, sum(1 - event)::BIGINT AS n_censor, count(*) AS n
  FROM survival GROUP BY {cols}sale_time),
r AS (SELECT *, CAST(sum(n) OVER ({part} ORDER BY time DESC) AS BIGINT) AS n_risk FROM t)
SELECT {cols}round(time, 6) AS time, n_risk, n_event, n_censor,
       round(product(1 - {hit} / n_risk) OVER ({part} ORDER BY time), 6) AS surv FROM r"""


@query("event_times", S + "SELECT DISTINCT round(sale_time, 6) AS time FROM survival WHERE event = 1")
def event_times(spark, sf):
    return metrics.event_times(views.survival(spark, sf)).select(_r("time"))


@query("km_curve", _km_sql())
def km_curve(spark, sf):
    return survival.kaplan_meier(views.survival(spark, sf)).select(
        _r("time"), "n_risk", "n_event", "n_censor", _r("surv"))


@query("km_by_group", _km_sql("heating"))
def km_by_group(spark, sf):
    return survival.kaplan_meier(views.survival(spark, sf), by=["heating"]).select(
        "heating", _r("time"), "n_risk", "n_event", "n_censor", _r("surv"))


@query("censor_km", _km_sql(hit="n_censor"))
def censor_km(spark, sf):
    return survival.kaplan_meier(views.survival(spark, sf), censoring=True).select(
        _r("time"), "n_risk", "n_event", "n_censor", _r("surv"))


@query("km_left_truncated", """
WITH u AS (SELECT user_id, CAST(min(epoch_us(ts)) AS BIGINT) AS t0, min(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) AS tp,
                  max(epoch_us(ts)) AS t1 FROM events GROUP BY user_id),
     r AS (SELECT round(t0 / 3.6e9, 0) - 1 AS start_h, round(coalesce(tp, t1) / 3.6e9, 0) AS stop_h,
                  CASE WHEN tp IS NULL THEN 0 ELSE 1 END AS event FROM u),
     k AS (SELECT stop_h AS time, sum(event)::BIGINT AS n_event, sum(1 - event)::BIGINT AS n_censor FROM r GROUP BY stop_h),
     n AS (SELECT k.time, n_event, n_censor, count(*) AS n_risk FROM k JOIN r ON r.start_h < k.time AND k.time <= r.stop_h GROUP BY ALL)
SELECT time, n_risk, n_event, n_censor, round(product(1 - n_event / n_risk) OVER (ORDER BY time), 6) AS surv FROM n""")
def km_left_truncated(spark, sf):
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")  # no session time zone
    users = table(spark, sf, "events").groupBy("user_id").agg(
        F.min(us).alias("t0"), F.min(F.when(F.col("event_type") == "purchase", us)).alias("tp"), F.max(us).alias("t1"))
    rows = users.select(
        (F.round(F.col("t0") / 3.6e9, 0) - 1).alias("start_h"),
        F.round(F.coalesce("tp", "t1") / 3.6e9, 0).alias("stop_h"),
        F.when(F.col("tp").isNull(), 0).otherwise(1).alias("event"))
    spec = survival.SurvSpec("stop_h", "event", "start_h")
    return survival.kaplan_meier(rows, spec).select("time", "n_risk", "n_event", "n_censor", _r("surv"))


@query("separation_levels", """
WITH p AS (SELECT 'source' AS variable, source AS level, coalesce(quality, 0) AS event FROM documents LEFT JOIN labels USING (doc_id)
           UNION ALL SELECT 'lang', lang, coalesce(quality, 0) FROM documents LEFT JOIN labels USING (doc_id)
           UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), coalesce(quality, 0) FROM documents LEFT JOIN labels USING (doc_id))
SELECT variable, level, count(*) AS n, sum(event)::BIGINT AS n_event FROM p GROUP BY variable, level
HAVING sum(event) = 0 OR sum(event) = count(*)""")
def separation_levels(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "source", "lang", "toxic", F.coalesce("quality", F.lit(0)).alias("event"))
    return survival.separation(df, ["source", "lang", "toxic"])


# --- files ----------------------------------------------------------------------------------

def _folder(spark, sf, name):
    """A folder in the session's warehouse, which all executors share."""
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{root}/lapsewise_{name}_{sf.rstrip('/').rsplit('/', 1)[-1].replace('.', '_')}"


def _name(sf, name):
    return "lapsewise_" + name + "_" + sf.rstrip("/").rsplit("/", 1)[-1].replace(".", "_")


@query("csv_scan", """
SELECT p_name AS description, round(p_retailprice, 2) AS listed_price, CAST(p_size AS DOUBLE) AS bed, p_size > 12 AS is_sold FROM part""")
def csv_scan(spark, sf):
    """Two CSV files with a header and one schema, written from the part table and read back."""
    parts = table(spark, sf, "part")
    sold = F.col("p_size") > 12
    folders = []
    for name, rows in (("sold", parts.where(sold)), ("censored", parts.where(~sold))):
        cells = {"listed_price": F.round("p_retailprice", 2).cast("string"), "bed": F.col("p_size").cast("string"),
                 "description": F.col("p_name"), "type": F.lit(name)}
        folders.append(_folder(spark, sf, f"csv_{name}"))
        tables.write_listing_csv(rows.select(*[cells.get(f.name, F.lit(None).cast("string")).alias(f.name) for f in tables.LISTING_SCHEMA.fields]), folders[-1])
    found = tables.read_listing_csv(spark, *folders)
    return found.select("description", F.col("listed_price").cast("double").alias("listed_price"), F.col("bed").cast("double").alias("bed"),
                        (F.col("type") == "sold").alias("is_sold"))


@query("feature_files", "SELECT vec_id, label, embedding[1] AS v1, embedding[64] AS v64 FROM embeddings")
def feature_files(spark, sf):
    """Features written as Parquet by label and read again."""
    path = _folder(spark, sf, "features")
    tables.write_features(table(spark, sf, "embeddings"), path, ("label",))
    return tables.read_features(spark, path).select("vec_id", "label", F.element_at("embedding", 1).alias("v1"), F.element_at("embedding", 64).alias("v64"))


@query("score_files", "SELECT o_orderstatus AS model, 'mean_price' AS metric, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY o_orderstatus")
def score_files(spark, sf):
    """A score table written as CSV with a header and read again."""
    path = _folder(spark, sf, "scores")
    scores = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("model")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    tables.write_scores(scores.select("model", F.lit("mean_price").alias("metric"), "value"), path, "csv")
    return spark.read.schema("model string, metric string, value double").option("header", True).csv(path)


@query("bucketed_join", "SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def bucketed_join(spark, sf):
    """Two feature tables bucketed by key, joined on all common columns without a shuffle."""
    buckets = shuffle_width(spark)
    docs = tables.write_bucketed(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), _name(sf, "documents"), "doc_id", buckets)
    labels = tables.write_bucketed(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), _name(sf, "labels"), "doc_id", buckets)
    return clean.keyed_left_join(docs, labels.hint("merge"), ["doc_id"])
