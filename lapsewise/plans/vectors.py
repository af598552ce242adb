"""Queries on splits, designs, principal components, neighbours and collinearity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, linalg, sparse, split
from ..session import settle
from ..sources import views
from ..sources.tables import table
from ..sources.views import SURVIVAL_SQL
from .registry import query

S = "WITH " + SURVIVAL_SQL


def _r(col: str, n: int = 6, name: str | None = None):
    return F.round(F.col(col), n).alias(name or col)


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


# --- splits ---------------------------------------------------------------------------------

_SPLIT = S + """, h AS (SELECT obs, event, row_number() OVER (PARTITION BY event ORDER BY md5('1|' || obs)) AS r,
   count(*) OVER (PARTITION BY event) AS n FROM survival),
 lab AS (SELECT obs, event, CASE WHEN r <= round(0.8::DOUBLE * n) THEN 'train'
   WHEN r <= round((0.8::DOUBLE + 0.1::DOUBLE) * n) THEN 'valid' ELSE 'test' END AS split FROM h)"""


def _split(spark, sf):
    rows = settle(views.survival(spark, sf).select("obs", "event"))
    return split.stratified_split(rows, "obs", "event")


@query("strat_split", _SPLIT + " SELECT obs, event, split FROM lab")
def strat_split(spark, sf):
    return _split(spark, sf)


@query("split_shares", _SPLIT + """
SELECT event, split, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event), 6) AS share FROM lab GROUP BY event, split""")
def split_shares(spark, sf):
    return split.split_shares(_split(spark, sf), "event").select("event", "split", "n", _r("share"))


@query("merge_valid_test", _SPLIT + """
SELECT obs, CASE WHEN split = 'train' THEN 'train' ELSE 'test' END AS split FROM lab""")
def merge_valid_test(spark, sf):
    return split.merge_splits(_split(spark, sf)).select("obs", "split")


@query("grouped_split", """
WITH u AS (SELECT event_id, user_id, ('0x' || substr(md5('1|' || user_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM events)
SELECT event_id, user_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'valid' ELSE 'test' END AS split FROM u""")
def grouped_split(spark, sf):
    return split.grouped_split(table(spark, sf, "events").select("event_id", "user_id"), "user_id")


@query("kfold", S + """
SELECT obs, CAST(('0x' || substr(md5('1|' || obs), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM survival""")
def kfold(spark, sf):
    return views.survival(spark, sf).select("obs", split.fold_of("obs").alias("fold"))


@query("bootstrap_weights", """
WITH r AS (SELECT doc_id, replicate, ('0x' || substr(md5('1|' || replicate || '|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
           FROM documents, range(1, 6) t(replicate)),
 p AS (SELECT i, sum(exp(-1) / gamma(i + 1)) OVER (ORDER BY i) AS c FROM range(0, 12) t(i))
SELECT doc_id, CAST(replicate AS INTEGER) AS replicate, CAST(count(*) FILTER (WHERE u >= c) AS INTEGER) AS weight
FROM r, p GROUP BY doc_id, replicate HAVING count(*) FILTER (WHERE u >= c) > 0""")
def bootstrap_weights(spark, sf):
    return split.bootstrap_rows(table(spark, sf, "documents").select("doc_id"), "doc_id", 5).select(
        "doc_id", "replicate", "weight")


# --- designs --------------------------------------------------------------------------------

@query("design_matrix", S + """
SELECT obs, CAST(listed_price AS DOUBLE) AS x1, lot_area AS x2, CASE heating WHEN '2-HIGH' THEN 1.0::DOUBLE ELSE 0 END AS x3,
       CASE heating WHEN '3-MEDIUM' THEN 1.0::DOUBLE ELSE 0 END AS x4, CASE heating WHEN '4-NOT SPECIFIED' THEN 1.0::DOUBLE ELSE 0 END AS x5,
       CASE heating WHEN '5-LOW' THEN 1.0::DOUBLE ELSE 0 END AS x6, CASE outdoor WHEN 'N' THEN 1.0::DOUBLE ELSE 0 END AS x7,
       CASE outdoor WHEN 'R' THEN 1.0::DOUBLE ELSE 0 END AS x8 FROM survival""")
def design_matrix(spark, sf):
    df = views.survival(spark, sf)
    df, cols = linalg.design(df, ["listed_price", "lot_area"], linalg.levels_of(df, ["heating", "outdoor"]))
    return df.select("obs", *[F.element_at("x", i + 1).alias(f"x{i + 1}") for i in range(len(cols))])


@query("design_sparse", S + """, u AS (
  SELECT obs, 'listed_price' AS "column", CAST(listed_price AS DOUBLE) AS value FROM survival UNION ALL SELECT obs, 'event', event FROM survival
  UNION ALL SELECT obs, 'heating=' || heating, 1.0::DOUBLE FROM survival WHERE heating <> (SELECT min(heating) FROM survival)
  UNION ALL SELECT obs, 'outdoor=' || outdoor, 1.0::DOUBLE FROM survival WHERE outdoor <> (SELECT min(outdoor) FROM survival))
SELECT obs, "column", value FROM u WHERE value <> 0""")
def design_sparse(spark, sf):
    df = views.survival(spark, sf)
    df, cols = sparse.sparse_design(df, ["listed_price", "event"], linalg.levels_of(df, ["heating", "outdoor"]))
    return sparse.sparse_entries(df, "obs", cols)


# --- principal components -------------------------------------------------------------------

_COV = """WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
 m AS (SELECT i, avg(v) AS m FROM c GROUP BY i), z AS (SELECT vec_id, i, v - m AS z FROM c JOIN m USING (i)),
 cov AS (SELECT a.i AS i, b.i AS j, sum(a.z * b.z) / (SELECT count(*) FROM embeddings) AS value
         FROM z a JOIN z b USING (vec_id) GROUP BY a.i, b.i)"""


@query("covariance_matrix", _COV + " SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(value, 6) + 0.0::DOUBLE AS value FROM cov")
def covariance_matrix(spark, sf):
    return linalg.covariance_table(_vectors(spark, sf), "embedding").select("i", "j", (F.round("value", 6) + 0.0).alias("value"))


@query("pca_eig")
def pca_eig(spark, sf):
    return linalg.pca(_vectors(spark, sf), "embedding").table(spark)


@query("pca_eig_scaled")
def pca_eig_scaled(spark, sf):
    return linalg.pca(_vectors(spark, sf), "embedding", scaled=True).table(spark)


@query("pca_variance_check", _COV + """, s AS (SELECT sum(value) FILTER (WHERE i = j) AS trace, sum(value * value) AS square FROM cov)
SELECT round(trace, 6) AS trace, round(square, 6) AS square FROM s""")
def pca_variance_check(spark, sf):
    eig = linalg.pca(_vectors(spark, sf), "embedding").table(spark)
    return eig.agg(F.round(F.sum("eigenvalue"), 6).alias("trace"),
                   F.round(F.sum(F.col("eigenvalue") ** 2), 6).alias("square"))


@query("pca_k80")
def pca_k80(spark, sf):
    k = linalg.pca(_vectors(spark, sf), "embedding").components_for(80.0)
    return _vectors(spark, sf).agg(F.count("*").alias("n_vectors")).withColumn("k80", F.lit(k))


def _coords(spark, sf, k):
    df = _vectors(spark, sf)
    return linalg.project(df, "embedding", linalg.pca(df, "embedding"), k)


@query("pca_coords")
def pca_coords(spark, sf):
    return _coords(spark, sf, 10).select("vec_id", F.posexplode("pc").alias("component", "coord"))


@query("pca_region")
def pca_region(spark, sf):
    df = _coords(spark, sf, 2)
    return df.filter((F.element_at("pc", 1) < 0) & (F.element_at("pc", 2) < 0)).select("vec_id", "label", "pc")


# Two columns have their components in closed form.
_TWO = S + """, v AS MATERIALIZED (SELECT obs, CAST(listed_price AS DOUBLE) AS x, CAST(lot_area AS DOUBLE) AS y FROM survival), mu AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM v),
 ev AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2 FROM mu),
 un AS (SELECT *, b / sqrt(b * b + pow(l1 - a, 2)) AS u, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) AS w FROM ev),
 ax AS (SELECT *, CASE WHEN abs(u) >= abs(w) THEN sign(u) ELSE sign(w) END AS s1, CASE WHEN abs(w) >= abs(u) THEN sign(-w) ELSE sign(u) END AS s2 FROM un),
 pc AS MATERIALIZED (SELECT obs, s1 * (u * (x - mx) + w * (y - my)) AS pc1, s2 * (-w * (x - mx) + u * (y - my)) AS pc2 FROM v, ax)"""


def _two(spark, sf, again=True):
    flat = views.survival(spark, sf).select("obs", F.col("listed_price").cast("double").alias("x"), F.col("lot_area").cast("double").alias("y"))
    if again:  # read for the components and again for the rows: the tables are joined once
        flat = settle(flat)
    df = flat.select("obs", F.array("x", "y").alias("v"))
    return df, linalg.pca(df, "v")


@query("pca_two_eig", _TWO + """ SELECT 1 AS component, round(l1, 6) AS eigenvalue, round(100 * l1 / (l1 + l2), 6) AS percent, round(100 * l1 / (l1 + l2), 6) AS cumulative FROM ev
UNION ALL SELECT 2, round(l2, 6), round(100 * l2 / (l1 + l2), 6), 100.0::DOUBLE FROM ev""")
def pca_two_eig(spark, sf):
    t = _two(spark, sf, again=False)[1].table(spark)
    return t.select(*[F.col(c) if c == "component" else _r(c) for c in t.columns])


@query("pca_two_k80", _TWO + """ SELECT (SELECT count(*) FROM v) AS n, CAST(1 + (100 * l1 / (l1 + l2) <= 80)::INT + (100 <= 80)::INT AS INTEGER) AS k80 FROM ev""")
def pca_two_k80(spark, sf):
    df, model = _two(spark, sf)
    return df.agg(F.count("*").alias("n")).withColumn("k80", F.lit(model.components_for(80.0)))


@query("pca_two_coords", _TWO + " SELECT obs, round(pc1, 5) + 0.0::DOUBLE AS pc1, round(pc2, 5) + 0.0::DOUBLE AS pc2 FROM pc")
def pca_two_coords(spark, sf):
    df, model = _two(spark, sf)
    return linalg.project(df, "v", model, 2).select("obs", *[(F.round(F.element_at("pc", i), 5) + 0.0).alias(f"pc{i}") for i in (1, 2)])


@query("pca_two_region", _TWO + """ SELECT obs, CAST(listed_price AS DOUBLE) AS listed_price, lot_area FROM pc JOIN survival USING (obs) WHERE pc1 < 0 AND pc2 < -0.1""")
def pca_two_region(spark, sf):
    df, model = _two(spark, sf)
    near = linalg.project(df, "v", model, 2).where((F.element_at("pc", 1) < 0) & (F.element_at("pc", 2) < -0.1)).select("obs")
    rows = views.survival(spark, sf).select("obs", "listed_price", "lot_area")
    return rows.join(near, "obs")


_KNN = """WITH p AS (SELECT a.vec_id, b.vec_id AS neighbour, round({d}, 9) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS rank FROM p)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, round(d, 6) AS distance FROM r WHERE rank <= {k}"""


@query("knn_cosine", _KNN.format(d="1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", k=10))
def knn_cosine(spark, sf):
    return linalg.nearest_neighbours(_vectors(spark, sf), "vec_id", "embedding", 10).select(
        "vec_id", "rank", "neighbour", _r("distance"))


@query("knn_euclidean", _KNN.format(d="list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", k=5))
def knn_euclidean(spark, sf):
    return linalg.nearest_neighbours(_vectors(spark, sf), "vec_id", "embedding", 5, "euclidean").select(
        "vec_id", "rank", "neighbour", _r("distance"))


# --- collinearity ---------------------------------------------------------------------------

_VIF_COLS = ["listed_price", "lot_area", "living_area"]


@query("vif", S + """, c AS (SELECT corr(listed_price, lot_area) AS ab, corr(listed_price, living_area) AS ac, corr(lot_area, living_area) AS bc FROM survival),
 d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM c),
 v AS (SELECT 'listed_price' AS variable, (1 - bc * bc) / det AS vif FROM d UNION ALL SELECT 'lot_area', (1 - ac * ac) / det FROM d
       UNION ALL SELECT 'living_area', (1 - ab * ab) / det FROM d)
SELECT variable, round(vif, 6) AS vif, round(1 / vif, 6) AS tolerance FROM v""")
def vif(spark, sf):
    df, cols = linalg.design(views.survival(spark, sf, dims=True), _VIF_COLS)
    return linalg.collinearity(df, "x", cols).select("variable", _r("vif"), _r("tolerance"))


# Eigenvalues of a 3 x 3 matrix with unit diagonal and off-diagonal a, b, c in closed form.
_EIG3 = """, q AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM m), f AS (SELECT p, acos(greatest(-1, least(1, a * b * c / (p * p * p)))) / 3 AS phi FROM q),
 ev AS (SELECT 1 + 2 * p * cos(phi) AS e1, 1 + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM f),
 e AS (SELECT unnest([1, 2, 3]) AS i, unnest([e1, 3 - e1 - e3, e3]) AS v FROM ev)"""


@query("condition_indices", S + """, m AS (SELECT sum(lot_area) / sqrt(count(*) * sum(lot_area * lot_area)) AS a,
   sum(bath) / sqrt(count(*) * sum(bath * bath)) AS b, sum(lot_area * bath) / sqrt(sum(lot_area * lot_area) * sum(bath * bath)) AS c FROM survival)"""
       + _EIG3 + """
SELECT CAST(i AS INTEGER) AS dimension, round(v, 6) AS eigenvalue, round(sqrt(max(v) OVER () / v), 5) AS condition_index FROM e""")
def condition_indices(spark, sf):
    df, cols = linalg.design(views.survival(spark, sf, dims=True), ["lot_area", "bath"])
    return linalg.condition_indices(df, "x", cols).select("dimension", _r("eigenvalue"), _r("condition_index", 5))


@query("pca_structured", S + """, m AS (SELECT corr(listed_price, lot_area) AS a, corr(listed_price, sold_price) AS b, corr(lot_area, sold_price) AS c FROM survival)"""
       + _EIG3 + """
SELECT CAST(i AS INTEGER) AS component, round(v, 6) AS eigenvalue, round(100 * v / 3, 4) AS percent,
       round(100 * sum(v) OVER (ORDER BY i) / 3, 4) AS cumulative FROM e""")
def pca_structured(spark, sf):
    df, _ = linalg.design(views.survival(spark, sf), ["listed_price", "lot_area", "sold_price"])
    return linalg.pca(df, "x", scaled=True).table(spark).select(
        "component", _r("eigenvalue"), _r("percent", 4), _r("cumulative", 4))


@query("vector_head", """
SELECT vec_id, CAST(i AS INTEGER) AS place, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM embeddings, range(1, 9) t(i)""")
def vector_head(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("p", "v")).select(
        "vec_id", (F.col("p") + 1).alias("place"), F.round(F.col("v").cast("double"), 6).alias("value"))


@query("least_squares", S + """, m AS (SELECT covar_pop(sale_time, listed_price) AS ya, covar_pop(sale_time, lot_area) AS yb, covar_pop(listed_price, lot_area) AS ab,
   var_pop(listed_price) AS aa, var_pop(lot_area) AS bb, avg(sale_time) AS my, avg(listed_price) AS ma, avg(lot_area) AS mb FROM survival),
 b AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS ba, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS bb2 FROM m)
SELECT 'listed_price' AS term, round(ba, 6) AS beta FROM b UNION ALL SELECT 'lot_area', round(bb2, 6) FROM b
UNION ALL SELECT '(Intercept)', round(my - ma * ba - mb * bb2, 6) FROM b""")
def least_squares(spark, sf):
    fit = linalg.least_squares(views.survival(spark, sf), "sale_time", ["listed_price", "lot_area"])
    return spark.createDataFrame(list(fit.items()), "term string, beta double").select("term", _r("beta"))
