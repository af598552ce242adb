"""Experiment grid: representation x degradation level x covariates x selection rule, as one long score table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from . import cox, coxnet, degrade, encode, linalg, metrics, split
from . import text as terms
from .survival import SurvSpec

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("representation", "level", "covariates", "rule", "metric")]
                      + [T.StructField("value", T.DoubleType())])


@dataclass(frozen=True)
class Representation:
    """How a text becomes a vector: a method of ``embed``, its options, and the number of components kept
    (a number, ``"80%"`` for the variance rule, or nothing)."""

    name: str
    method: str | None = None
    dim: int | None = None
    components: int | str | None = None
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Setting:
    key: str = "doc_id"
    text: str = "text"
    surv: SurvSpec = SurvSpec("time", "event")
    numeric: tuple[str, ...] = ()
    factors: tuple[str, ...] = ()
    rules: tuple[str, ...] = ("none", "C", "loglik")
    covariates: tuple[str, ...] = ("both", "text")
    folds: int = 5
    alpha: float = 0.95
    n_lambda: int = 20
    min_ratio: float | None = None
    lam: str = "lambda.1se"
    seed: int = 1
    fit_on: str = "all"
    wanted: tuple[str, ...] = metrics.SCORES


def vectors_for(df: DataFrame, s: Setting, r: Representation, shared: list | None = None) -> tuple[DataFrame, int]:
    """Column ``v`` for a representation in place of the text; components are fitted on all rows or on the training rows.

    ``shared`` keeps what representations of the same rows have in common: equal embeddings, and the terms of documents.
    """
    if r.method is None:
        return df, 0
    shared = [] if shared is None else shared

    def once(what, build):
        if not any(k == what for k, _ in shared):
            shared.append((what, build()))
        return next(v for k, v in shared if k == what)

    def embedded() -> DataFrame:
        more = {}
        if r.method == "tf-idf":
            choice = terms.counting(terms.options(**r.options))
            more["rows"] = once(("terms", choice), lambda: terms.document_terms(df, s.key, s.text, choice))
        return settle(encode.embed(df, s.key, s.text, r.method, r.dim, **r.options, **more).withColumnRenamed("vector", "v").drop(s.text))

    out = once((r.method, r.dim, r.options), embedded)
    if r.components is not None:
        basis = out if s.fit_on == "all" else out.filter("split = 'train'")
        model = linalg.pca(basis, "v")
        k = model.components_for(80.0) if r.components == "80%" else min(int(r.components), len(model.values))
        return settle(linalg.project(out, "v", model, k, "pc").drop("v").withColumnRenamed("pc", "v")), k
    return out, linalg.width_of(out, "v")


def run(df: DataFrame, s: Setting, representations: Sequence[Representation], level: str = "original") -> DataFrame:
    """Scores of every combination on the rows of ``df``; the loop is over models, never over rows."""
    spark = df.sparkSession
    parts = split.merge_splits(split.stratified_split(df, s.key, s.surv.event, seed=s.seed)).withColumn(
        "fold", split.fold_of(s.key, s.folds, s.seed))
    parts = settle(parts)
    levels = linalg.levels_of(parts, s.factors)
    rows: list[tuple] = []
    shared: list = []
    for r in representations:
        built, width = vectors_for(parts, s, r, shared)
        for covariates in s.covariates if width else ("structured",):
            only_text = covariates == "text"
            designed, columns = linalg.design(
                built, () if only_text else s.numeric, {} if only_text else levels, {"v": width} if width else {})
            designed = settle(designed.select(s.key, s.surv.time, s.surv.event, "split", "fold", "x"))
            train, test = designed.filter("split = 'train'"), designed.filter("split = 'test'")
            for rule in s.rules:
                if rule == "none":
                    model = cox.fit(train, columns, surv=s.surv)
                    found = metrics.score(model.linear_predictor(train), model.linear_predictor(test),
                                          surv=s.surv, wanted=s.wanted)
                    counts = {"non_text": sum(c.role != "text" for c in columns), "text": sum(c.role == "text" for c in columns)}
                    extra = model.information_criteria()
                else:
                    p = coxnet.path(train, columns, surv=s.surv, alpha=s.alpha, n_lambda=s.n_lambda,
                                    min_ratio=s.min_ratio, fold="fold", measure=rule)
                    model, found, counts = coxnet.select_refit_score(p, train, test, s.lam, s.wanted)
                    extra = model.information_criteria() if model else {}
                found = {**found, "n_non_text": float(counts["non_text"]), "n_text": float(counts["text"]),
                         **{k: extra[k] for k in ("aic", "bic") if k in extra}}
                rows += [(r.name, level, covariates, rule, k, None if v is None else float(v)) for k, v in found.items()]
    return spark.createDataFrame(rows, SCHEMA)


def run_levels(df: DataFrame, s: Setting, representations: Sequence[Representation],
               levels: Sequence[float] = (0.0, 0.05, 0.1)) -> DataFrame:
    """The same grid on the original text and on each typo level of the degraded text."""
    out = run(df, s, representations)
    texts = settle(degrade.degrade_levels(df, s.key, s.text, levels, seed=s.seed))
    rest = df.drop(s.text)
    for p in levels:
        degraded = texts.filter(F.abs(F.col("level") - p) < 1e-12).select(s.key, F.col("modified_text").alias(s.text))
        out = out.unionByName(run(rest.join(degraded, s.key), s, representations, f"p={p:g}"))
    return out


def degradation_delta(scores: DataFrame, base: str = "original") -> DataFrame:
    """Change of every score against the original text, per model."""
    keys = ["representation", "covariates", "rule", "metric"]
    origin = scores.filter(F.col("level") == base).select(*keys, F.col("value").alias("base_value"))
    return scores.filter(F.col("level") != base).join(origin, keys).select(
        *keys, "level", "value", "base_value", (F.col("value") - F.col("base_value")).alias("delta"))
