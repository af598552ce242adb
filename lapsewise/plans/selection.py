"""Queries on elastic-net selection, sample comparison and the experiment grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, compare, cox, coxnet, grid, linalg, metrics, split
from ..session import settle
from ..sources import views
from ..sources.tables import table
from ..sources.views import SURVIVAL_SQL
from .models import _FIT as _TWO_FIT
from .models import two_covariates
from .newton_sql import concordance_cv, deviance_cv, elastic_net, penalised, unit_scale
from .registry import query

S = "WITH " + SURVIVAL_SQL


def _r(col: str, n: int = 6, name: str | None = None):
    return F.round(F.col(col), n).alias(name or col)


def _wide(spark, sf):
    df = settle(views.survival(spark, sf, dims=True).drop("listed_date", "sold_date", "parking", "type"))
    levels = linalg.levels_of(df, ["heating", "outdoor"])
    df = split.merge_splits(split.stratified_split(df, "obs", "event"))
    df, cols = linalg.design(df, ["listed_price", "lot_area", "bed", "bath"], levels)
    df = settle(df.select("obs", "sale_time", "event", "heating", "outdoor", "x", "split",
                          split.fold_of("obs", 3).alias("fold")))
    return df, cols, levels


_PATH = {"n_lambda": 12, "min_ratio": 0.02, "fold": "fold"}


def _path(spark, sf, measure=None):
    df, cols, levels = _wide(spark, sf)
    train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
    p = coxnet.path(train, cols, measure=measure, **_PATH)
    return p, train, test, levels


# --- elastic net ----------------------------------------------------------------------------

@query("coxnet_path")
def coxnet_path(spark, sf):
    p, *_ = _path(spark, sf)
    return p.coefficients(spark)


_LAMBDAS = [0.05, 0.01, 0.004, 0.001, 0.0]


@query("coxnet_one_covariate", S + """, src AS MATERIALIZED (SELECT sale_time AS t, event AS e, CAST(lot_area AS DOUBLE) AS x1 FROM survival), """
       + penalised("src", _LAMBDAS, 0.95) + """
SELECT "lambda", 'lot_area' AS term, round(1000 * beta, 4) + 0.0::DOUBLE AS beta_1000 FROM path""")
def coxnet_one_covariate(spark, sf):
    df, cols = linalg.design(views.survival(spark, sf), ["lot_area"])
    p = coxnet.path(df, cols, lambdas=_LAMBDAS, tol=1e-12)
    return p.coefficients(spark).select("lambda", "term", (F.round(1000 * F.col("beta"), 4) + 0.0).alias("beta_1000"))


# Path, cross-validation, choice and refit over two numbers and a factor, each held against SQL.
_TERMS = ("lot_area", "bed", "open=b")
_CHAIN = S + """, src AS MATERIALIZED (SELECT sale_time AS t, event AS e, CAST(('0x' || substr(md5('1|' || obs), 1, 8))::BIGINT % 3 AS INTEGER) AS f,
   CAST(lot_area AS DOUBLE) AS x1, bed AS x2, CASE outdoor WHEN 'N' THEN 1.0::DOUBLE ELSE 0 END AS x3 FROM survival), """ \
    + unit_scale("src", 3, 3, 6, 0.05, 0.95) + ", " + elastic_net("z", 3, "lanes", "net", 0.95)
_CHAIN_CV = _CHAIN + ", " + deviance_cv("z", "net", 3)


def _by_term(body):
    return " UNION ALL ".join(body.format(i=i, term=t) for i, t in enumerate(_TERMS, 1))


def _chain(spark, sf, measure=None):
    df = views.survival(spark, sf).select("obs", "sale_time", "event", "lot_area", "bed", F.when(F.col("outdoor") == "N", "b").otherwise("a").alias("open"))
    df = settle(df.withColumn("fold", split.fold_of("obs", 3)))
    df, cols = linalg.design(df, ["lot_area", "bed"], {"open": ["a", "b"]})
    return coxnet.path(df, cols, n_lambda=6, min_ratio=0.05, fold="fold", measure=measure, tol=1e-13), df


@query("coxnet_chain_path", _CHAIN + " " + _by_term(
    """SELECT round("lam", 7) AS "lambda", '{term}' AS term, round(1000 * b{i} / sd{i}, 4) + 0.0::DOUBLE AS beta_1000 FROM net, sc WHERE skip = -2"""))
def coxnet_chain_path(spark, sf):
    """Automatic grid and path of three covariates."""
    p, _ = _chain(spark, sf)
    return p.coefficients(spark).select(_r("lambda", 7), "term", (F.round(1000 * F.col("beta"), 4) + 0.0).alias("beta_1000"))


@query("coxnet_chain_cv", _CHAIN_CV + """
SELECT round(cv.lam, 7) AS "lambda", round(mean, 6) AS cv_mean, round(se, 6) AS cv_se, (abs(b1) > 1e-9)::INTEGER + (abs(b2) > 1e-9)::INTEGER + (abs(b3) > 1e-9)::INTEGER AS n_nonzero,
       cv.lam IN (SELECT lam FROM chosen WHERE rule = 'lambda.min') AS is_min, cv.lam IN (SELECT lam FROM chosen WHERE rule = 'lambda.1se') AS is_1se
FROM cv JOIN net ON cv.lam = net.lam AND skip = -2""")
def coxnet_chain_cv(spark, sf):
    """Cross-validated deviance along the path, and the two lambdas that it chooses."""
    p, _ = _chain(spark, sf, "loglik")
    size = p.coefficients(spark).groupBy("lambda").agg(F.count_if(F.abs("beta") > 1e-9).cast("int").alias("n_nonzero"))
    return p.table(spark).drop("n_nonzero").join(size, "lambda").select(
        _r("lambda", 7), _r("cv_mean"), _r("cv_se"), "n_nonzero",
        (F.col("lambda") == p.cv.lambda_min).alias("is_min"), (F.col("lambda") == p.cv.lambda_1se).alias("is_1se"))


@query("coxnet_chain_concordance", _CHAIN + ", " + concordance_cv("z", "net", 3) + """
SELECT round(lam, 7) AS "lambda", round(mean, 6) AS cv_mean, round(se, 6) AS cv_se,
       lam IN (SELECT lam FROM chosen WHERE rule = 'lambda.min') AS is_min, lam IN (SELECT lam FROM chosen WHERE rule = 'lambda.1se') AS is_1se FROM cv""")
def coxnet_chain_concordance(spark, sf):
    """Cross-validated concordance along the path, and the two lambdas that it chooses."""
    p, _ = _chain(spark, sf, "C")
    return p.table(spark).select(_r("lambda", 7), _r("cv_mean"), _r("cv_se"), (F.col("lambda") == p.cv.lambda_min).alias("is_min"),
                                 (F.col("lambda") == p.cv.lambda_1se).alias("is_1se"))


@query("coxnet_chain_refit", _CHAIN_CV + """, again AS (SELECT CAST(0 AS DOUBLE) AS lam, CAST(-2 AS INTEGER) AS skip, (abs(b1) > 1e-9)::INTEGER AS m1, (abs(b2) > 1e-9)::INTEGER AS m2,
   (abs(b3) > 1e-9)::INTEGER AS m3 FROM net WHERE skip = -2 AND lam = (SELECT max(lam) FILTER (round(lam, 12) < (SELECT round(top, 12) FROM top)) FROM net)), """
       + elastic_net("z", 3, "again", "fit", 0.95) + " " + _by_term(
    "SELECT '{term}' AS term, m{i} = 1 AS kept, round(1000 * b{i} / sd{i}, 4) + 0.0::DOUBLE AS beta_1000 FROM fit, sc"))
def coxnet_chain_refit(spark, sf):
    """What the path keeps at its second lambda, refitted without a penalty."""
    p, df = _chain(spark, sf)
    lam = float(p.lambdas[1])
    model, chosen = coxnet.refit(p, df, lam, ties="breslow")
    new = {c.name: float(b) for c, b in zip(model.columns, model.beta)}
    return coxnet.zero_nonzero(p, spark, lam).join(
        spark.createDataFrame(list(new.items()), "term string, refitted double"), "term", "left").select(
        "term", "kept", (F.round(1000 * F.coalesce("refitted", F.lit(0.0)), 4) + 0.0).alias("beta_1000"))


@query("coxnet_cv_concordance")
def coxnet_cv_concordance(spark, sf):
    p, *_ = _path(spark, sf, "C")
    return p.table(spark)


@query("coxnet_cv_loglik")
def coxnet_cv_loglik(spark, sf):
    p, *_ = _path(spark, sf, "loglik")
    return p.table(spark)


@query("select_1se")
def select_1se(spark, sf):
    p, *_ = _path(spark, sf, "loglik")
    return coxnet.zero_nonzero(p, spark, "lambda.1se").select("term", "role", "beta", "kept")


@query("cv_table")
def cv_table(spark, sf):
    df, cols, _ = _wide(spark, sf)
    measures = ("loglik", "C")
    return coxnet.cv_table(spark, dict(zip(measures, coxnet.paths(df.filter("split = 'train'"), cols, measures, **_PATH))))


@query("coef_change")
def coef_change(spark, sf):
    df, cols, _ = _wide(spark, sf)
    lambdas = [0.004, 0.002, 0.001]
    a = coxnet.path(df, cols, lambdas=lambdas, alpha=0.95).coefficients(spark)
    b = coxnet.path(df, cols, lambdas=lambdas, alpha=0.5).coefficients(spark)
    return cox.coefficient_change(a, b)


_MERGED = {"heating": ("2-HIGH", "4-NOT SPECIFIED"), "outdoor": ("N", "R")}


@query("merge_levels", S + """
SELECT obs, CASE WHEN heating IN ('2-HIGH', '4-NOT SPECIFIED') THEN '1-URGENT' ELSE heating END AS heating,
       CASE WHEN outdoor IN ('N', 'R') THEN 'A' ELSE outdoor END AS outdoor FROM survival""")
def merge_levels(spark, sf):
    df = views.survival(spark, sf)
    return coxnet.merge_levels(df, _MERGED, {"heating": "1-URGENT", "outdoor": "A"}).select("obs", "heating", "outdoor")


@query("one_level_factors", S + """, m AS (SELECT CASE WHEN heating IN ('2-HIGH', '4-NOT SPECIFIED') THEN '1-URGENT' ELSE heating END AS heating,
       CASE WHEN outdoor IN ('N', 'R') THEN 'A' ELSE outdoor END AS outdoor FROM survival),
 l AS (SELECT 'heating' AS variable, heating AS level FROM m UNION SELECT 'outdoor', outdoor FROM m)
SELECT variable, count(*) AS n_levels, count(*) = 1 AS dropped FROM l GROUP BY variable""")
def one_level_factors(spark, sf):
    levels = clean.level_table(merge_levels(spark, sf), ["heating", "outdoor"])
    return levels.groupBy("variable").agg(F.count("*").alias("n_levels")).withColumn("dropped", F.col("n_levels") == 1)


_RECODED = S + """, src AS MATERIALIZED (SELECT sale_time AS t, event AS e, CASE outdoor WHEN 'N' THEN 1.0::DOUBLE ELSE 0 END AS x1 FROM survival), """ \
    + penalised("src", [0.05, 0.0], 0.95)


@query("recode_selected", _RECODED + """
SELECT "lambda", CASE WHEN outdoor = 'N' AND abs(beta) > 1e-9 THEN 'b' ELSE 'a' END AS open, count(*) AS n, (abs(beta) < 1e-9) AS dropped
FROM survival, path GROUP BY ALL""")
def recode_selected(spark, sf):
    """A penalised path over one factor decides which of its levels merge, and if the factor stays."""
    df = settle(views.survival(spark, sf).select("sale_time", "event", F.when(F.col("outdoor") == "N", "b").otherwise("a").alias("open")))
    design, cols = linalg.design(df, [], {"open": ["a", "b"]})
    p = coxnet.path(design, cols, lambdas=[0.05, 0.0], tol=1e-12)
    out = None
    for lam in (0.05, 0.0):
        merged = coxnet.recode_selected(df, coxnet.selection_table(p, spark, {"open": "a"}, lam), ["open"])
        _, gone = coxnet.drop_constant_factors(merged, ["open"])
        part = merged.groupBy("open").agg(F.count("*").alias("n")).select(F.lit(lam).alias("lambda"), "open", "n", F.lit("open" in gone).alias("dropped"))
        out = part if out is None else out.unionByName(part)
    return out


@query("cox_status", _TWO_FIT + """SELECT TRUE AS converged, (SELECT count(*) FROM src) AS n, (SELECT CAST(sum(e) AS BIGINT) FROM src) AS n_event, round(loglik, 3) AS loglik FROM fit""")
def cox_status(spark, sf):
    df, cols = two_covariates(spark, sf)
    return cox.fit(df, cols).status(spark).select("converged", "n", "n_event", _r("loglik", 3))


@query("refit_score")
def refit_score(spark, sf):
    p, train, test, _ = _path(spark, sf, "loglik")
    _, found, counts = coxnet.select_refit_score(p, train, test, "lambda.min", ("c_index", "c_uno", "brier_med"))
    found |= {f"n_{k}": v for k, v in counts.items()}
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in found.items()], "metric string, value double")


# --- comparison of two samples --------------------------------------------------------------

_KS = S + """, x AS (SELECT sale_time AS x, count(*) FILTER (WHERE event = 0) AS a, count(*) FILTER (WHERE event = 1) AS b FROM survival GROUP BY sale_time),
 f AS (SELECT sum(a) OVER (ORDER BY x) / (SELECT sum(a) FROM x) AS fa, sum(b) OVER (ORDER BY x) / (SELECT sum(b) FROM x) AS fb FROM x),
 d AS (SELECT max({d}) AS d, (SELECT sum(a)::BIGINT FROM x) AS n, (SELECT sum(b)::BIGINT FROM x) AS m FROM f),
 z AS (SELECT *, d * sqrt(n * m / (n + m)) AS z FROM d)
SELECT round(d, 6) AS statistic, round({p}, 6) AS p_value, n AS n_first, m AS n_second FROM z"""


@query("ks2", _KS.format(d="abs(fa - fb)", p="least(1, greatest(0, (SELECT 2 * sum(pow(-1, j - 1) * exp(-2 * pow(j * z, 2))) FROM range(1, 101) t(j))))"))
def ks2(spark, sf):
    out = compare.ks_two_sample(views.survival(spark, sf), "sale_time", F.col("event") == 1)
    return out.select(_r("statistic"), _r("p_value"), "n_first", "n_second")


@query("ks2_less", _KS.format(d="fb - fa", p="exp(-2 * z * z)"))
def ks2_less(spark, sf):
    out = compare.ks_two_sample(views.survival(spark, sf), "sale_time", F.col("event") == 1, "less")
    return out.select(_r("statistic"), _r("p_value"), "n_first", "n_second")


@query("kl_knn", """
WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, label < 5 AS first FROM embeddings),
 ds AS (SELECT a.vec_id, b.first AS own, abs(a.x - b.x) AS d FROM e a JOIN e b ON a.first AND a.vec_id <> b.vec_id),
 r AS (SELECT vec_id, own, d, row_number() OVER (PARTITION BY vec_id, own ORDER BY d) AS k FROM ds),
 p AS (SELECT vec_id, k, max(d) FILTER (WHERE own) AS rho, max(d) FILTER (WHERE NOT own) AS nu FROM r WHERE k <= 5 GROUP BY vec_id, k)
SELECT CAST(k AS INTEGER) AS k, round(avg(ln(nu / rho)) + ln((SELECT count(*) FILTER (WHERE NOT first) / count(*) FILTER (WHERE first) FROM e)), 6) AS divergence,
       CAST(0 AS BIGINT) AS n_zero FROM p GROUP BY k""")
def kl_knn(spark, sf):
    df = table(spark, sf, "embeddings").select(F.element_at("embedding", 1).cast("double").alias("x"), "label")
    return compare.kl_divergence(df, "x", F.col("label") >= 5).select("k", _r("divergence"), "n_zero")


# Harrell-Davis weights by Simpson's rule over each rank's interval, from the density of the beta distribution.
_HD = S + """, v AS (SELECT event AS second, sale_time AS x, row_number() OVER (PARTITION BY event ORDER BY sale_time) AS i, count(*) OVER (PARTITION BY event) AS n FROM survival),
 q AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS prob), k(j, w) AS (VALUES (0, 1), (1, 4), (2, 2), (3, 4), (4, 2), (5, 4), (6, 2), (7, 4), (8, 1)),
 ab AS (SELECT second, n, prob, (n + 1) * prob AS a, (n + 1) * (1 - prob) AS b FROM (SELECT DISTINCT second, n FROM v), q),
 c AS (SELECT *, lgamma(a + b) - lgamma(a) - lgamma(b) AS lc FROM ab),
 m AS (SELECT second, prob, i, sum(w * CASE WHEN u <= 0 OR u >= 1 THEN 0 ELSE exp(lc + (a - 1) * ln(u) + (b - 1) * ln(1 - u)) END) / (24 * any_value(n)) AS mass
       FROM (SELECT c.*, i, w, (i - 1 + j / 8.0::DOUBLE) / c.n AS u FROM c, LATERAL (SELECT unnest(range(1, c.n + 1)) AS i) r, k) GROUP BY second, prob, i),
 z AS (SELECT prob, second, sum(mass * x) AS value FROM m JOIN v USING (second, i) GROUP BY prob, second)
SELECT prob, round(max(value) FILTER (WHERE second = 0), 5) AS first, round(max(value) FILTER (WHERE second = 1), 5) AS second,
       round(max(value) FILTER (WHERE second = 0) - max(value) FILTER (WHERE second = 1), 4) AS difference FROM z GROUP BY prob"""


@query("hd_quantiles", _HD)
def hd_quantiles(spark, sf):
    out = compare.compare_quantiles(views.survival(spark, sf), "sale_time", F.col("event") == 1)
    return out.select("prob", _r("first", 5), _r("second", 5), _r("difference", 4))


@query("hd_quantiles_bootstrap")
def hd_quantiles_bootstrap(spark, sf):
    df = views.text_survival(spark, sf).select("doc_id", "time", "event")
    return compare.compare_quantiles(df, "time", F.col("event") == 1, key="doc_id", replicates=20)


# --- grid -----------------------------------------------------------------------------------

_SETTING = grid.Setting(factors=("lang", "source"), folds=3, n_lambda=6, min_ratio=0.1, rules=("none", "loglik"),
                        wanted=("c_index", "c_uno"))


def _documents(spark, sf):
    return views.text_survival(spark, sf)


@query("score_grid")
def score_grid(spark, sf):
    return grid.run(_documents(spark, sf), _SETTING, [
        grid.Representation("structured"), grid.Representation("tf-idf", "tf-idf", options={"sparse": 0.6}),
        grid.Representation("subword", "subword", 16)])


@query("component_grid")
def component_grid(spark, sf):
    s = grid.Setting(covariates=("text",), rules=("none",), wanted=("c_index",))
    return grid.run(_documents(spark, sf), s, [
        grid.Representation("encoder, 12 components", "encoder", 32, 12), grid.Representation("encoder, 80%", "encoder", 32, "80%")])


@query("low_idf_grid")
def low_idf_grid(spark, sf):
    s = grid.Setting(covariates=("text",), rules=("none",), wanted=("c_index",))
    return grid.run(_documents(spark, sf), s, [
        grid.Representation("tf-idf", "tf-idf", options={"sparse": 0.7}),
        grid.Representation("tf-idf, no frequent words", "tf-idf", options={"sparse": 0.7, "low_idf_quantile": 0.15})])


@query("degradation_delta")
def degradation_delta(spark, sf):
    s = grid.Setting(covariates=("text",), rules=("none",), wanted=("c_index", "c_uno"))
    return grid.degradation_delta(grid.run_levels(_documents(spark, sf), s, [grid.Representation("subword", "subword", 16)], (0.0, 0.1)))


@query("model_table")
def model_table(spark, sf):
    """AIC, BIC, concordance with error and number of variables over several models."""
    df, cols, _ = _wide(spark, sf)
    train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
    rows = []
    for name, keep in (("numeric", [i for i, c in enumerate(cols) if c.level is None]), ("all", list(range(len(cols))))):
        part = coxnet.keep_columns(train, "x", len(cols), keep, "xk")
        model = cox.fit(part, [cols[i] for i in keep], "xk")
        scored = model.linear_predictor(coxnet.keep_columns(test, "x", len(cols), keep, "xk"))
        c = metrics.concordance(scored).first()
        ic = model.information_criteria()
        rows.append((name, float(ic["aic"]), float(ic["bic"]), float(ic["r2_scaled"]), c["c_index"], c["se"], len(keep)))
    return spark.createDataFrame(
        rows, "model string, aic double, bic double, r2_scaled double, c_index double, c_se double, n_variables int")
