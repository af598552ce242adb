"""Queries on Cox models: fits, predictors, hazards, residuals, criteria."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cox, linalg, sparse, text
from ..operators.survival import SurvSpec
from ..session import settle
from ..sources import views
from ..sources.views import SURVIVAL_SQL, TEXT_SURVIVAL_SQL
from .newton_sql import newton, penalised
from .registry import query
from .texts import _S90

S = "WITH " + SURVIVAL_SQL

_ROWS = """, src AS MATERIALIZED (SELECT obs, sale_time AS t, event AS e, lot_area / 10 AS x1, CASE outdoor WHEN 'N' THEN 1.0::DOUBLE ELSE 0 END AS x2 FROM survival), """
_FIT = S + _ROWS + newton("src", ["x1", "x2"])


def _r(col: str, n: int = 6, name: str | None = None):
    return F.round(F.col(col), n).alias(name or col)


def two_covariates(spark, sf):
    df = views.survival(spark, sf).select(
        "obs", "sale_time", "event", (F.col("lot_area") / 10).alias("lot"), "listed_date", "sold_date",
        F.when(F.col("outdoor") == "N", "b").otherwise("a").alias("open"))
    return linalg.design(df, ["lot"], {"open": ["a", "b"]})


def _table(model, spark):
    return model.coefficients(spark).select("term", _r("beta", 5), _r("se", 5))


def _coef_sql(terms=("lot", "open=b")):
    return " UNION ALL ".join(
        f"SELECT '{t}' AS term, round(b{i}, 5) AS beta, round(sqrt(v{i}{i}), 5) AS se FROM fit" for i, t in enumerate(terms, 1))


@query("cox_fit", _FIT + _coef_sql())
def cox_fit(spark, sf):
    df, cols = two_covariates(spark, sf)
    return _table(cox.fit(df, cols), spark)


@query("cox_fit_breslow", S + _ROWS + newton("src", ["x1", "x2"], ties="breslow") + _coef_sql())
def cox_fit_breslow(spark, sf):
    df, cols = two_covariates(spark, sf)
    return _table(cox.fit(df, cols, ties="breslow"), spark)


@query("cox_fit_left_truncated", S + """, src AS MATERIALIZED (
  SELECT datediff('day', DATE '1970-01-01', listed_date) AS s, datediff('day', DATE '1970-01-01', sold_date) AS t, event AS e,
         lot_area / 10 AS x1, CASE outdoor WHEN 'N' THEN 1.0::DOUBLE ELSE 0 END AS x2 FROM survival), """
       + newton("src", ["x1", "x2"], late=True) + _coef_sql())
def cox_fit_left_truncated(spark, sf):
    df, cols = two_covariates(spark, sf)
    df = df.withColumn("start", F.unix_date("listed_date")).withColumn("stop", F.unix_date("sold_date"))
    return _table(cox.fit(df, cols, surv=SurvSpec("stop", "event", "start")), spark)


@query("cox_univariate", S + """, src AS MATERIALIZED (SELECT sale_time AS t, event AS e, CAST(listed_price AS DOUBLE) AS x1 FROM survival), """
       + newton("src", ["x1"]) + _coef_sql(["listed_price"]))
def cox_univariate(spark, sf):
    df, cols = linalg.design(views.survival(spark, sf), ["listed_price"])
    return _table(cox.fit(df, cols), spark)


_TOP_TERM = _S90 + """, top AS (SELECT term FROM vocab ORDER BY df DESC, term LIMIT 1), """ + TEXT_SURVIVAL_SQL + """,
 src AS MATERIALIZED (SELECT s.time AS t, s.event AS e, 10 * coalesce(w.weight, 0) AS x1 FROM text_survival s
   LEFT JOIN (SELECT doc_id, weight FROM weights WHERE term = (SELECT term FROM top)) w USING (doc_id)), """


@query("cox_one_term", _TOP_TERM + newton("src", ["x1"]) + _coef_sql(["term"]))
def cox_one_term(spark, sf):
    docs = views.corpus(spark, sf).select("doc_id", "text")
    weights, vocab = text.tfidf(docs, "doc_id", "text", text.options(stemming=False))
    top = vocab.orderBy(F.desc("df"), "term").limit(1).select("term")
    one = weights.join(F.broadcast(top), "term").select("doc_id", (10 * F.col("weight")).alias("term"))
    df = views.text_survival(spark, sf).join(one, "doc_id", "left").fillna({"term": 0.0})
    df, cols = linalg.design(df, ["term"])
    return _table(cox.fit(df, cols, surv=SurvSpec("time", "event")), spark)


@query("cox_fit_wide")
def cox_fit_wide(spark, sf):
    df = settle(views.survival(spark, sf, dims=True).drop("obs", "listed_date", "sold_date"))
    df, cols = linalg.design(df, ["listed_price", "lot_area", "bed", "bath", "living_area"],
                             linalg.levels_of(df, ["heating", "parking", "outdoor"]))
    return cox.fit(df, cols).coefficients(spark)


def _sparse_two(spark, sf):
    df = views.survival(spark, sf).withColumns({
        "lot": F.col("lot_area") / 10, "open": F.when(F.col("outdoor") == "N", "b").otherwise("a"),
        "start": F.unix_date("listed_date"), "stop": F.unix_date("sold_date")})
    return sparse.sparse_design(df.select("sale_time", "event", "lot", "open", "start", "stop"), ["lot"], {"open": ["a", "b"]})


def _beta_sql(terms=("lot", "open=b")):
    return " UNION ALL ".join(f"SELECT '{t}' AS term, round(b{i}, 5) AS beta FROM fit" for i, t in enumerate(terms, 1))


@query("cox_sparse", _FIT + _beta_sql())
def cox_sparse(spark, sf):
    df, cols = _sparse_two(spark, sf)
    return sparse.fit_sparse(df, cols).coefficients(spark).select("term", _r("beta", 5))


@query("cox_sparse_left_truncated", S + """, src AS MATERIALIZED (
  SELECT datediff('day', DATE '1970-01-01', listed_date) AS s, datediff('day', DATE '1970-01-01', sold_date) AS t, event AS e,
         lot_area / 10 AS x1, CASE outdoor WHEN 'N' THEN 1.0::DOUBLE ELSE 0 END AS x2 FROM survival), """
       + newton("src", ["x1", "x2"], late=True) + _beta_sql())
def cox_sparse_left_truncated(spark, sf):
    df, cols = _sparse_two(spark, sf)
    return sparse.fit_sparse(df, cols, surv=SurvSpec("stop", "event", "start")).coefficients(spark).select("term", _r("beta", 5))


@query("cox_sparse_penalised", S + ", src AS MATERIALIZED (SELECT sale_time AS t, event AS e, lot_area AS x1 FROM survival), "
       + penalised("src", [0.004], 0.95) + " SELECT round(beta, 5) + 0.0::DOUBLE AS beta FROM path")
def cox_sparse_penalised(spark, sf):
    df, cols = sparse.sparse_design(views.survival(spark, sf).select("sale_time", "event", "lot_area"), ["lot_area"])
    return sparse.fit_sparse(df, cols, lam=0.004, alpha=0.95, ties="breslow", tol=1e-8).coefficients(spark).select((F.round("beta", 5) + 0.0).alias("beta"))


@query("cox_sparse_terms")
def cox_sparse_terms(spark, sf):
    """Elastic net over one column per term that a hundredth of the documents has."""
    weights, _ = text.tfidf(views.corpus(spark, sf).select("doc_id", "text"), "doc_id", "text", text.options(stemming=False, sparse=0.99))
    rows = views.text_survival(spark, sf).select("doc_id", "time", "event")
    df, cols = sparse.sparse_design(rows, terms=settle(weights.select("doc_id", "term", "weight")), key="doc_id")
    model = sparse.fit_sparse(df, cols, surv=SurvSpec("time", "event"), lam=0.2, alpha=0.5, tol=1e-3, max_iter=20)
    return model.coefficients(spark).select("term", "beta").where("beta <> 0")


@query("model_ic", _FIT + """, ne AS (SELECT sum(event) AS ne FROM survival)
SELECT round(loglik0, 3) AS loglik_null, round(loglik, 3) AS loglik, 2.0::DOUBLE AS df, round(-2 * loglik + 4, 3) AS aic,
       round(-2 * loglik + 2 * ln(ne), 3) AS bic,
       round((1 - exp(2 / ne * (loglik0 - loglik))) / (1 - exp(2 / ne * loglik0)), 6) AS r2_scaled FROM fit, ne""")
def model_ic(spark, sf):
    df, cols = two_covariates(spark, sf)
    found = cox.fit(df, cols).information_criteria()
    digits = {"r2_scaled": 6}
    return spark.createDataFrame([tuple(map(float, found.values()))], ", ".join(f"{k} double" for k in found)).select(
        *[_r(k, digits.get(k, 3)) for k in ("loglik_null", "loglik")], "df", _r("aic", 3), _r("bic", 3), _r("r2_scaled", 6))


_LP = """, mu AS (SELECT avg(x1) AS m1, avg(x2) AS m2 FROM src),
 p AS MATERIALIZED (SELECT obs, t, e, b1 * (x1 - m1) + b2 * (x2 - m2) AS lp FROM src, fit, mu)"""
_HAZ = _LP + """, hz AS (SELECT t, sum(e) AS d, sum(exp(lp)) AS r FROM p GROUP BY t),
 ha AS (SELECT t, d, d / sum(r) OVER (ORDER BY t DESC) AS h FROM hz), cum AS MATERIALIZED (SELECT t, d, h, sum(h) OVER (ORDER BY t) AS ch FROM ha)"""


@query("cox_lp", _FIT + _LP + " SELECT obs, round(lp, 5) AS lp FROM p")
def cox_lp(spark, sf):
    df, cols = two_covariates(spark, sf)
    df = settle(df.select("obs", "sale_time", "event", "x"))
    return cox.fit(df, cols).linear_predictor(df).select("obs", _r("lp", 5))


@query("baseline_hazard", _FIT + _HAZ + """
SELECT round(t, 6) AS time, round(1000 * h, 4) AS hazard_1000, round(ch, 5) AS cumulative FROM cum WHERE d > 0""")
def baseline_hazard(spark, sf):
    df, cols = two_covariates(spark, sf)
    df = settle(df.select("obs", "sale_time", "event", "x"))
    scored = cox.fit(df, cols).linear_predictor(df)
    return cox.baseline_hazard(scored).select(
        _r("time"), F.round(1000 * F.col("hazard"), 4).alias("hazard_1000"), _r("cumulative", 5))


@query("deviance_resid", _FIT + _HAZ + """, m AS (SELECT obs, e, e - ch * exp(lp) AS m FROM p JOIN cum USING (t))
SELECT obs, round(m, 4) AS martingale,
       round(sign(m) * sqrt(greatest(0, -2 * (m + CASE WHEN e = 1 THEN ln(e - m) ELSE 0 END))), 4) AS deviance FROM m""")
def deviance_resid(spark, sf):
    df, cols = two_covariates(spark, sf)
    df = settle(df.select("obs", "sale_time", "event", "x"))
    scored = cox.fit(df, cols).linear_predictor(df)
    out = cox.deviance_residuals(scored, cox.baseline_hazard(scored))
    return out.select("obs", _r("martingale", 4), _r("deviance", 4))
