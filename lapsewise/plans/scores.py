"""Queries on held-out scores: concordance, Brier, time-dependent AUC."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cox, metrics, split
from ..operators.linalg import DesignColumn
from ..operators.survival import SurvSpec, kaplan_meier
from ..session import settle
from ..sources import views
from ..sources.views import SURVIVAL_SQL, TEXT_SURVIVAL_SQL
from .models import two_covariates
from .newton_sql import newton
from .registry import query


def _r(col: str, n: int = 6, name: str | None = None):
    return F.round(F.col(col), n).alias(name or col)


# --- concordance on the text table ----------------------------------------------------------

TEXT_SURV = SurvSpec("time", "event")
_TEXT = "WITH " + TEXT_SURVIVAL_SQL + """, p AS MATERIALIZED (
  SELECT doc_id, time AS t, event AS e, ('0x' || substr(md5('1|' || doc_id), 1, 8))::BIGINT % 97 / 97.0::DOUBLE AS lp FROM text_survival)"""
_PAIR = """, pr AS (SELECT a.doc_id AS i, b.doc_id AS j, CASE WHEN a.lp > b.lp THEN 1 ELSE 0 END AS con,
   CASE WHEN a.lp < b.lp THEN 1 ELSE 0 END AS dis, CASE WHEN a.lp = b.lp THEN 1 ELSE 0 END AS tie
  FROM p a JOIN p b ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0)))"""


def _text_scored(spark, sf):
    lp = split.hash_number(split.key_hash(1, "doc_id")) % 97 / F.lit(97.0)
    return views.text_survival(spark, sf).select("doc_id", "time", "event", lp.alias("lp"))


@query("harrell_c", _TEXT + _PAIR + """, s AS (SELECT sum(con)::DOUBLE AS con, sum(dis)::DOUBLE AS dis, sum(tie)::DOUBLE AS tie FROM pr),
 c AS (SELECT *, (con + 0.5 * tie) / (con + dis + tie) AS c, con + dis + tie AS n FROM s),
 half AS (SELECT i AS id, con, tie FROM pr UNION ALL SELECT j, con, tie FROM pr),
 inf AS (SELECT id, (sum(half.con + 0.5 * half.tie) - any_value(c.c) * count(*)) / any_value(c.n) AS v FROM half, c GROUP BY id)
SELECT con AS concordant, dis AS discordant, tie AS tied, round(c, 6) AS c_index,
       round((SELECT sqrt(sum(v * v)) FROM inf), 6) AS se, round(2 * (c - 0.5), 6) AS dxy FROM c""")
def harrell_c(spark, sf):
    return metrics.concordance(_text_scored(spark, sf), surv=TEXT_SURV).select(
        "concordant", "discordant", "tied", _r("c_index"), _r("se"), _r("dxy"))


@query("harrell_c_by_lang", _TEXT.replace("event AS e,", "event AS e, lang,") + """
SELECT a.lang, round(sum(CASE WHEN a.lp > b.lp THEN 1 WHEN a.lp = b.lp THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS c_index, count(*)::DOUBLE AS pairs
FROM p a JOIN p b ON a.e = 1 AND a.lang = b.lang AND (b.t > a.t OR (b.t = a.t AND b.e = 0)) GROUP BY a.lang""")
def harrell_c_by_lang(spark, sf):
    df = _text_scored(spark, sf).join(views.corpus(spark, sf).select("doc_id", "lang"), "doc_id")
    return metrics.concordance(df, surv=TEXT_SURV, by=["lang"]).select(
        "lang", _r("c_index"), (F.col("concordant") + F.col("discordant") + F.col("tied")).alias("pairs"))


@query("bootstrap_c", _TEXT + """, u AS (SELECT p.*, replicate, ('0x' || substr(md5('1|' || replicate || '|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
           FROM p, range(1, 6) g(replicate)),
 po AS (SELECT i, sum(exp(-1) / gamma(i + 1)) OVER (ORDER BY i) AS c FROM range(0, 12) g(i)),
 w AS MATERIALIZED (SELECT doc_id, t, e, lp, CAST(replicate AS INTEGER) AS replicate, count(*) FILTER (WHERE u >= c) AS w FROM u, po GROUP BY ALL)
SELECT a.replicate, round(sum(a.w * b.w * CASE WHEN a.lp > b.lp THEN 1 WHEN a.lp = b.lp THEN 0.5 ELSE 0 END)::DOUBLE / sum(a.w * b.w), 6) AS c_index
FROM w a JOIN w b ON a.e = 1 AND a.replicate = b.replicate AND (b.t > a.t OR (b.t = a.t AND b.e = 0)) WHERE a.w > 0 AND b.w > 0 GROUP BY a.replicate""")
def bootstrap_c(spark, sf):
    rows = split.bootstrap_rows(_text_scored(spark, sf), "doc_id", 5)
    return metrics.concordance(rows, surv=TEXT_SURV, by=["replicate"], weight=F.col("weight")).select("replicate", _r("c_index"))


# The concordance of one covariate depends on the sign of its coefficient alone, which is the sign of the score at zero.
@query("optimism_c", _TEXT + """, u AS (SELECT p.*, replicate, ('0x' || substr(md5('1|' || replicate || '|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
           FROM p, range(1, 4) g(replicate)),
 po AS (SELECT i, sum(exp(-1) / gamma(i + 1)) OVER (ORDER BY i) AS c FROM range(0, 12) g(i)),
 w AS MATERIALIZED (SELECT doc_id, t, e, lp, CAST(replicate AS INTEGER) AS replicate, count(*) FILTER (WHERE u >= c) AS w FROM u, po GROUP BY ALL
   UNION ALL SELECT doc_id, t, e, lp, 0, 1 FROM p),
 tm AS (SELECT replicate, t, sum(w * e) AS d, sum(w * e * lp) AS dx, sum(w) AS n, sum(w * lp) AS sx FROM w WHERE w > 0 GROUP BY ALL),
 rs AS (SELECT replicate, d, dx, sum(n) OVER o AS n, sum(sx) OVER o AS sx FROM tm WINDOW o AS (PARTITION BY replicate ORDER BY t DESC)),
 sg AS (SELECT replicate, sign(sum(dx - d * sx / n)) AS s FROM rs GROUP BY replicate),
 c1 AS (SELECT a.replicate, sum(a.w * b.w * sign(a.lp - b.lp))::DOUBLE / sum(a.w * b.w) AS dxy
  FROM w a JOIN w b ON a.e = 1 AND a.replicate = b.replicate AND (b.t > a.t OR (b.t = a.t AND b.e = 0)) WHERE a.w > 0 AND b.w > 0 GROUP BY a.replicate),
 cs AS MATERIALIZED (SELECT c1.replicate, 0.5 + s * c1.dxy / 2 AS c_sample, 0.5 + s * z.dxy / 2 AS c_original
  FROM c1 JOIN sg USING (replicate), (SELECT dxy FROM c1 WHERE replicate = 0) z)
SELECT replicate, round(c_sample, 6) AS c_sample, round(c_original, 6) AS c_original,
  round((SELECT max(c_original) FROM cs WHERE replicate = 0) - (SELECT avg(c_sample - c_original) FROM cs WHERE replicate > 0), 6) AS c_corrected
FROM cs WHERE replicate > 0""")
def optimism_c(spark, sf):
    df = _text_scored(spark, sf).withColumn("x", F.array("lp"))
    found = metrics.optimism_corrected(df, "doc_id", [DesignColumn("x", "x", None, "x")], replicates=3, surv=TEXT_SURV, ties="breslow")
    return found.select("replicate", _r("c_sample"), _r("c_original"), _r("c_corrected"))


_G = """, gt AS (SELECT t, sum(e) AS d, sum(1 - e) AS c, count(*) AS n FROM {src} GROUP BY t),
 gr AS (SELECT t, c, sum(n) OVER (ORDER BY t DESC) AS r FROM gt),
 gk AS MATERIALIZED (SELECT t, product(1 - c / r) OVER (ORDER BY t) AS g FROM gr)"""


@query("uno_c", _TEXT + _G.format(src="p") + """, pw AS (SELECT p.*, g FROM p JOIN gk USING (t))
SELECT round(sum(CASE WHEN a.lp > b.lp THEN 1 WHEN a.lp = b.lp THEN 0.5 ELSE 0 END / (a.g * a.g)) / sum(1 / (a.g * a.g)), 6) AS c_uno
FROM pw a JOIN p b ON a.e = 1 AND a.g > 0 AND b.t > a.t""")
def uno_c(spark, sf):
    df = _text_scored(spark, sf)
    return metrics.uno_c(df, metrics.censoring_curve(df, TEXT_SURV), surv=TEXT_SURV).select(_r("c_uno"))


@query("uno_c_tau", _TEXT + _G.format(src="p") + """, pw AS (SELECT p.*, g FROM p JOIN gk USING (t))
SELECT round(sum(CASE WHEN a.lp > b.lp THEN 1 WHEN a.lp = b.lp THEN 0.5 ELSE 0 END / (a.g * a.g)) / sum(1 / (a.g * a.g)), 6) AS c_uno
FROM pw a JOIN p b ON a.e = 1 AND a.g > 0 AND a.t < 5 AND b.t > a.t""")
def uno_c_tau(spark, sf):
    df = _text_scored(spark, sf)
    return metrics.uno_c(df, metrics.censoring_curve(df, TEXT_SURV), surv=TEXT_SURV, tau=5.0).select(_r("c_uno"))


@query("auc_uno", _TEXT + _G.format(src="p") + """, cs AS (SELECT p.t, lp, 1 / g AS w FROM p JOIN gk USING (t) WHERE e = 1 AND g > 0),
 ti AS (SELECT DISTINCT t AS time FROM p WHERE e = 1)
SELECT round(time, 6) AS time, round(sum(w * CASE WHEN cs.lp > b.lp THEN 1 WHEN cs.lp = b.lp THEN 0.5 ELSE 0 END) / sum(w), 6) AS auc
FROM ti JOIN cs ON cs.t <= time JOIN p b ON b.t > time GROUP BY time""")
def auc_uno(spark, sf):
    df = _text_scored(spark, sf)
    out = metrics.auc_uno(df, metrics.censoring_curve(df, TEXT_SURV), surv=TEXT_SURV)
    return out.join(metrics.event_times(df, TEXT_SURV), "time").filter("auc is not null").select(_r("time"), _r("auc"))


# --- a fitted model on the listing split ----------------------------------------------------

_MODEL = "WITH " + SURVIVAL_SQL + """, ho AS (SELECT obs, sale_time AS t, event AS e, lot_area / 10 AS x1,
   CASE outdoor WHEN 'N' THEN 1.0::DOUBLE ELSE 0 END AS x2,
   row_number() OVER (PARTITION BY event ORDER BY md5('1|' || obs)) AS place, count(*) OVER (PARTITION BY event) AS size FROM survival),
 tr AS MATERIALIZED (SELECT t, e, x1, x2 FROM ho WHERE place <= round(0.8::DOUBLE * size)),
 te AS MATERIALIZED (SELECT t, e, x1, x2 FROM ho WHERE place > round(0.8::DOUBLE * size)), """ \
    + newton("tr", ["x1", "x2"]) + """, mu AS (SELECT avg(x1) AS m1, avg(x2) AS m2 FROM tr),
 ptr AS MATERIALIZED (SELECT t, e, b1 * (x1 - m1) + b2 * (x2 - m2) AS lp FROM tr, fit, mu),
 pte AS MATERIALIZED (SELECT t, e, b1 * (x1 - m1) + b2 * (x2 - m2) AS lp FROM te, fit, mu),
 hz AS (SELECT t, sum(e) AS d, sum(exp(lp)) AS r FROM ptr GROUP BY t),
 ha AS (SELECT t, d, d / sum(r) OVER (ORDER BY t DESC) AS h FROM hz), cum AS MATERIALIZED (SELECT t, sum(h) OVER (ORDER BY t) AS ch FROM ha)""" \
    + _G.format(src="ptr") + """,
 ti AS MATERIALIZED (SELECT DISTINCT t AS time FROM pte WHERE e = 1),
 lv AS MATERIALIZED (SELECT time, coalesce((SELECT max(ch) FROM cum WHERE cum.t <= time), 0) AS l,
                            coalesce((SELECT min(g) FROM gk WHERE gk.t <= time), 1) AS g FROM ti),
 km0 AS (SELECT t, sum(e) AS d, count(*) AS n FROM pte GROUP BY t), km1 AS (SELECT t, d, sum(n) OVER (ORDER BY t DESC) AS r FROM km0),
 km2 AS (SELECT t, product(1 - d / r) OVER (ORDER BY t) AS s FROM km1),
 km AS MATERIALIZED (SELECT t, coalesce(lag(s) OVER (ORDER BY t), 1) - s AS m FROM km2)"""


def _fitted(spark, sf):
    df, cols = two_covariates(spark, sf)
    df = settle(df.select("obs", "sale_time", "event", "x"))
    parts = settle(split.stratified_split(df, "obs", "event"))
    train, test = parts.filter("split = 'train'"), parts.filter("split <> 'train'")
    model = cox.fit(train, cols)
    return settle(model.linear_predictor(train)), settle(model.linear_predictor(test))


@query("harrell_c_model", _MODEL + """
SELECT round(sum(CASE WHEN round(a.lp, 12) > round(b.lp, 12) THEN 1 WHEN round(a.lp, 12) = round(b.lp, 12) THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS c_index
FROM pte a JOIN pte b ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0))""")
def harrell_c_model(spark, sf):
    _, test = _fitted(spark, sf)
    return metrics.concordance(test.withColumn("lp", F.round("lp", 12))).select(_r("c_index"))


_BRIER = _MODEL + """, bc AS (SELECT lp, pte.t, e, count(*) AS n, any_value((SELECT min(g) FROM gk WHERE gk.t <= pte.t)) AS gi FROM pte GROUP BY lp, pte.t, e),
 br AS MATERIALIZED (SELECT time, sum(n * CASE WHEN t <= time THEN CASE WHEN e = 1 AND gi > 0 THEN exp(-2 * l * exp(lp)) / gi ELSE 0 END
    ELSE pow(1 - exp(-l * exp(lp)), 2) / g END) / (SELECT count(*) FROM pte) AS b FROM bc, lv GROUP BY time)"""


def _brier(spark, sf):
    train, test = _fitted(spark, sf)
    return metrics.brier(test, cox.baseline_hazard(train), metrics.censoring_curve(train), metrics.event_times(test))


@query("brier_t", _BRIER + " SELECT round(time, 6) AS time, round(b, 6) AS brier FROM br")
def brier_t(spark, sf):
    return _brier(spark, sf).select(_r("time"), _r("brier"))


@query("ibs", _BRIER + """, nx AS (SELECT time, b, lead(time) OVER (ORDER BY time) AS t2, lead(b) OVER (ORDER BY time) AS b2 FROM br)
SELECT round(sum((t2 - time) * (b + b2) / 2) / (max(t2) - min(time)), 6) AS ibs FROM nx WHERE t2 IS NOT NULL""")
def ibs(spark, sf):
    return metrics.integrated_brier(_brier(spark, sf)).select(_r("ibs"))


def _auc_sql(case: str) -> str:
    return _MODEL + f""", sc AS (SELECT round(lp, 12) AS lp, count(*) AS n FROM pte GROUP BY round(lp, 12)),
 w AS MATERIALIZED (SELECT time, lp, n * ({case}) AS ca, n * exp(-l * exp(lp)) AS co FROM sc, lv),
 lo AS (SELECT time, ca, co, sum(co) OVER (PARTITION BY time ORDER BY lp) - 0.5 * co AS below FROM w),
 au AS MATERIALIZED (SELECT time, sum(ca * below) / (sum(ca) * sum(co)) AS auc FROM lo GROUP BY time)"""


_CD, _SH = _auc_sql("1 - exp(-l * exp(lp))"), _auc_sql("exp(lp) * exp(-l * exp(lp))")


def _auc(spark, sf, kind):
    train, test = _fitted(spark, sf)
    return metrics.model_auc(test, cox.baseline_hazard(train), metrics.event_times(test), kind), test


@query("auc_cd", _CD + " SELECT round(time, 6) AS time, round(auc, 6) AS auc FROM au")
def auc_cd(spark, sf):
    return _auc(spark, sf, "cumulative")[0].select(_r("time"), _r("auc"))


@query("auc_sh", _SH + " SELECT round(time, 6) AS time, round(auc, 6) AS auc FROM au")
def auc_sh(spark, sf):
    return _auc(spark, sf, "incident")[0].select(_r("time"), _r("auc"))


@query("iauc", _CD + " SELECT round(sum(auc * m) / sum(m), 6) AS iauc FROM au JOIN km ON au.time = km.t WHERE m > 0")
def iauc(spark, sf):
    auc, test = _auc(spark, sf, "cumulative")
    return metrics.integrated_auc(auc, kaplan_meier(test)).select(_r("iauc"))


@query("iauc_incident", _SH + " SELECT round(sum(auc * m) / sum(m), 6) AS iauc FROM au JOIN km ON au.time = km.t WHERE m > 0")
def iauc_incident(spark, sf):
    auc, test = _auc(spark, sf, "incident")
    return metrics.integrated_auc(auc, kaplan_meier(test)).select(_r("iauc"))


# Uno scores of held-out rows weigh by the censoring curve of the training rows, carried forward from its last step.
_UNO = _MODEL + """, pw AS MATERIALIZED (SELECT t, e, round(lp, 12) AS lp, coalesce((SELECT min(g) FROM gk WHERE gk.t <= pte.t), 1) AS g FROM pte)"""


@query("uno_c_model", _UNO + """
SELECT round(sum(CASE WHEN a.lp > b.lp THEN 1 WHEN a.lp = b.lp THEN 0.5 ELSE 0 END / (a.g * a.g)) / sum(1 / (a.g * a.g)), 6) AS c_uno
FROM pw a JOIN pw b ON a.e = 1 AND a.g > 0 AND b.t > a.t""")
def uno_c_model(spark, sf):
    train, test = _fitted(spark, sf)
    return metrics.uno_c(test.withColumn("lp", F.round("lp", 12)), metrics.censoring_curve(train)).select(_r("c_uno"))


@query("iauc_uno", _UNO + """, au AS (SELECT time, sum(CASE WHEN a.lp > b.lp THEN 1 WHEN a.lp = b.lp THEN 0.5 ELSE 0 END / a.g) / sum(1 / a.g) AS auc
 FROM ti JOIN pw a ON a.e = 1 AND a.g > 0 AND a.t <= time JOIN pw b ON b.t > time GROUP BY time)
SELECT round(sum(auc * m) / sum(m), 6) AS iauc FROM au JOIN km ON au.time = km.t WHERE m > 0""")
def iauc_uno(spark, sf):
    train, test = _fitted(spark, sf)
    auc = metrics.auc_uno(test.withColumn("lp", F.round("lp", 12)), metrics.censoring_curve(train))
    return metrics.integrated_auc(auc.join(metrics.event_times(test), "time"), kaplan_meier(test)).select(_r("iauc"))


@query("score_bundle")
def score_bundle(spark, sf):
    train, test = _fitted(spark, sf)
    found = metrics.score(train, test)
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in found.values())],
                                 ", ".join(f"{k} double" for k in found))
