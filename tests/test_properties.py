"""Brute-force and property checks on small fixtures."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapsewise import plans
from lapsewise.functions import special
from lapsewise.functions.special import beta_cdf, digamma, trigamma
from lapsewise.functions.stem import stem_word
from lapsewise.operators import (
    clean, compare, cox, coxnet, degrade, encode, grid, linalg, metrics, pairs, running, split, stats, survival, text,
)
from lapsewise.operators.blocks import matrix
from lapsewise.operators.linalg import DesignColumn
from lapsewise.operators.survival import SurvSpec

RNG = np.random.default_rng(7)


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


# --- running totals, quantiles --------------------------------------------------------------

@pytest.mark.parametrize("limit", [10_000, 20])
def test_running_totals_one_task_and_ranges(spark, limit):
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], 150), "x": np.tile(np.arange(150) * 1.5, 2),
                        "v": RNG.integers(0, 9, 300), "m": RNG.random(300)})
    out = running.running(spark.createDataFrame(pdf), "x", {"v": "s"}, {"m": "low"}, by=["g"], one_task_rows=limit).toPandas()
    out = out.sort_values(["g", "x"]).reset_index(drop=True)
    assert (out["s"] == pdf.groupby("g")["v"].cumsum()).all()
    assert np.allclose(out["low"], pdf.groupby("g")["m"].cummin())


def test_quantiles_are_type_seven(spark):
    x = [1.0, 2.0, 3.0, 10.0]
    out = stats.quantiles(frame(spark, x=x), "x", [0.25, 0.5, 0.75]).orderBy("prob").toPandas()
    assert out["value"].tolist() == [1.75, 2.5, 4.75]


# --- cleaning -------------------------------------------------------------------------------

def test_null_rules(spark):
    df = spark.createDataFrame([(1, None, "Unknown"), (2, "x", None)], "id int, a string, b string")
    out = clean.fill_sentinel(clean.fill_sentinel(df, ["a"]), ["b"], also="Unknown").orderBy("id").collect()
    assert [(r.a, r.b) for r in out] == [("No Info", "No Info"), ("x", "No Info")]
    joined = clean.natural_left_join(df.select("a", "id"), df.select("a", F.lit(5).alias("z")))
    assert joined.filter("z = 5").count() == 2


def test_dedup_keeps_first_with_nulls(spark):
    df = spark.createDataFrame([(3, "k", None, 1.0), (1, "k", None, 2.0), (2, "k", "y", 3.0)], "obs int, a string, b string, v double")
    out = clean.dedup_keep_first(df, ["a", "b"], "obs").orderBy("obs").collect()
    assert [(r.obs, r.v) for r in out] == [(1, 2.0), (2, 3.0)]
    assert clean.duplicate_groups(df, ["a", "b"]).count() == 2


def test_year_span_and_censoring(spark):
    df = spark.createDataFrame([(20.0, 1), (20.5, 1), (3.0, 0)], "sale_time double, event int")
    out = clean.censor_at(df, "sale_time", "event", 20).collect()
    assert [(r.sale_time, r.event, r.to_modify) for r in out] == [(20.0, 1, 0), (20.0, 0, 1), (3.0, 0, 0)]


# --- text -----------------------------------------------------------------------------------

def test_stems():
    cases = {"restaurants": "restaur", "communities": "communiti", "hoping": "hope", "hopping": "hop", "sky": "sky",
             "generously": "generous", "relational": "relat", "dying": "die", "oneofakind": "oneofakind"}
    assert {w: stem_word(w) for w in cases} == cases


def test_punctuation_is_deleted_and_empty_documents_survive(spark):
    docs = spark.createDataFrame([(1, "One-of-a-kind home! homes"), (2, "...")], "doc_id long, text string")
    opts = text.options(sparse=0.99)
    counts = {(r.doc_id, r.term): r.tf for r in text.term_counts(docs, "doc_id", "text", opts).collect()}
    assert counts == {(1, "oneofakind"): 1, (1, "home"): 2}
    out = encode.embed(docs, "doc_id", "text", "tf-idf", sparse=0.99).orderBy("doc_id").collect()
    assert len(out) == 2 and sum(out[1]["vector"]) == 0
    assert np.allclose(sorted(out[0]["vector"]), [1 / 3, 2 / 3])  # idf is log2(2/1) = 1


def test_sparse_threshold_is_strict(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i < 2 else "alpha") for i in range(4)], "doc_id long, text string")
    counts = text.term_counts(docs, "doc_id", "text", text.options(stemming=False))
    assert [r.term for r in text.vocabulary(counts, docs, 0.5).collect()] == ["alpha"]
    with pytest.raises(ValueError):
        text.options(sparse=0)


def test_term_matrix_round_trip(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue green")], "doc_id long, text string")
    opts = text.options(stemming=False, sparse=0.99)
    counts = text.term_counts(docs, "doc_id", "text", opts)
    wide = counts.groupBy("doc_id").pivot("term").agg(F.first("tf"))
    again = wide.selectExpr("doc_id", "stack(3, 'blue', blue, 'green', green, 'red', red) as (term, tf)").filter("tf is not null")
    a, b = ({(r.doc_id, r.term): r.weight for r in text.weighted(c, text.vocabulary(c, docs, 0.99), "doc_id", opts).collect()}
            for c in (counts, again))
    assert a == b


# --- degradation ----------------------------------------------------------------------------

def test_pos_filter_keeps_empty_documents(spark):
    texts = ["Barack Obama was the 44 president. He was the first.", "", "something else.", *"abcdefg", "", *"hij"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    row = docs.select("doc_id", degrade.filter_pos_text(F.col("text"), remove=degrade.STUDY_TAGS).alias("t")).orderBy("doc_id").collect()
    tab = degrade.filter_pos_tokens(docs, degrade.annotate(docs, "doc_id", "text"), "doc_id",
                                    remove=degrade.STUDY_TAGS, name="t").orderBy("doc_id").collect()
    assert [r.t for r in row] == [r.t for r in tab] and len(row) == 14
    assert row[0].t == "barack obama was president . was first ." and row[1].t == row[10].t == ""
    with pytest.raises(ValueError):
        degrade.filter_pos_text(F.col("text"), keep=["NUM"], remove=["DET"])


def test_typo_kinds():
    s = "Bonjour! Comment ca va aujourd'hui? " * 30
    go = lambda p, kinds: degrade.mistype(s, (3, 1, 2), p, 0.5, kinds)
    assert go(0.0, (0.4, 0.3, 0.15, 0.15)) == s
    assert len(go(0.1, (1, 0, 0, 0))) == len(s)
    assert len(go(0.1, (0, 1, 0, 0))) > len(s)
    assert len(go(0.1, (0, 0, 1, 0))) < len(s)
    assert Counter(go(0.1, (0, 0, 0, 1)).lower()) == Counter(s.lower())
    changed = sum(a != b for a, b in zip(s, go(0.1, (1, 0, 0, 0)))) / sum(c.isalpha() or c in "?." for c in s)
    assert 0.06 < changed < 0.14
    one = degrade.mistype("ab", (0, 1, 2), 1.0, 1.0, (0, 0, 0, 1))
    assert one == "ba"


def test_typos_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, "a home with a view " * 5) for i in range(20)], "doc_id long, text string")
    run = lambda d: {r.doc_id: r.modified_text for r in degrade.degrade(d, "doc_id", "text", p=0.1).collect()}
    first = run(docs.repartition(1))
    assert first == run(docs.repartition(7)) and len(set(first.values())) > 10
    with pytest.raises(ValueError):
        degrade.typos(F.col("text"), F.col("doc_id"), 0.1, kinds=(0.5, 0.5, 0.5, 0.5))


# --- vectors --------------------------------------------------------------------------------

def test_empty_text_gives_zero_vector(spark):
    docs = spark.createDataFrame([(1, ""), (2, "two words")], "doc_id long, text string")
    for method in ("subword", "encoder"):
        out = encode.embed(docs, "doc_id", "text", method, dim=8).orderBy("doc_id").collect()
        assert out[0]["vector"] == [0.0] * 8 and any(out[1]["vector"])
    with pytest.raises(ValueError):
        encode.embed(docs, "doc_id", "text", "bag")


def test_pca_coordinates_have_the_eigenvalues_as_variance(spark):
    x = RNG.normal(size=(200, 5)) @ RNG.normal(size=(5, 5)) + 3
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    for scaled in (False, True):
        model = linalg.pca(df, "v", scaled)
        pc = np.array([r.pc for r in linalg.project(df, "v", model, 5).orderBy("id").collect()])
        assert np.allclose(np.cov(pc.T, bias=True), np.diag(model.values), atol=1e-8)
        assert np.isclose(model.table(spark).agg(F.sum("percent")).first()[0], 100)
    assert model.components_for(80) == int(((100 * model.values / model.values.sum()).cumsum() <= 80).sum()) + 1


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_neighbours_in_blocks(spark, metric):
    x = RNG.normal(size=(120, 6))
    x[40:80] = x[0]  # many copies
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = linalg.nearest_neighbours(df, "id", "v", 4, metric, block_rows=25).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T if metric == "cosine" else np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    for i in range(120):
        mine = got[got["id"] == i].sort_values("rank")
        assert np.allclose(mine["distance"], np.sort(d[i])[:4], atol=1e-7)


# --- splits ---------------------------------------------------------------------------------

def test_zero_vectors_keep_their_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, [0.0, 1.0]), (5, None)]
    got = linalg.nearest_neighbours(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 2, "cosine").collect()
    assert {i: sum(r.id == i for r in got) for i in range(1, 6)} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 0}
    assert {(r.neighbour, r.distance) for r in got if r.id == 3} == {(1, 1.0), (2, 1.0)}


def test_broadcasts_are_bounded_by_bytes(spark):
    from lapsewise.session import small_side

    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small_side(wide, 20_000)) and not hinted(small_side(wide, 9_000))


def test_split_shares_are_exact(spark):
    df = frame(spark, k=np.arange(997), e=(np.arange(997) % 5 == 0).astype(int))
    a = split.stratified_split(df, "k", "e", (0.8, 0.1, 0.1), seed=4)
    b = split.stratified_split(df.repartition(5), "k", "e", (0.8, 0.1, 0.1), seed=4)
    assert a.exceptAll(b).count() == 0 and a.count() == 997
    for r in split.split_shares(a, "e").collect():
        n = {0: 797, 1: 200}[r.e]
        assert abs(r.n - n * {"train": 0.8, "valid": 0.1, "test": 0.1}[r.split]) <= 1
    g = split.grouped_split(df.withColumn("g", F.col("k") % 50), "g").groupBy("g").agg(F.count_distinct("split").alias("n"))
    assert g.filter("n > 1").count() == 0
    with pytest.raises(ValueError):
        split.stratified_split(df, "k", "e", (0.8, 0.1, 0.2))


# --- survival -------------------------------------------------------------------------------

def test_km_without_censoring_is_one_minus_ecdf(spark):
    t = RNG.integers(1, 20, 200).astype(float)
    out = survival.kaplan_meier(frame(spark, sale_time=t, event=np.ones(200, int))).toPandas()
    assert np.allclose(out["surv"], [(t > x).mean() for x in out["time"]])


def hazards_data(n, p, ties=True, late=False):
    x = RNG.normal(size=(n, p))
    beta = np.linspace(0.8, -0.5, p)
    t = RNG.exponential(1 / np.exp(x @ beta)) * 5
    c = RNG.exponential(6, n)
    time, event = np.minimum(t, c), (t <= c).astype(int)
    if ties:
        time = np.ceil(time * 4) / 4
    start = np.where(RNG.random(n) < 0.5, 0.0, time * RNG.random(n)) if late else np.full(n, -np.inf)
    return x, time, event, start


def brute_loglik(beta, x, time, event, start, ties):
    lp = x @ beta
    total = 0.0
    for t in np.unique(time[event == 1]):
        risk = (time >= t) & (start < t)
        ev = (time == t) & (event == 1)
        d, s0, e0 = ev.sum(), np.exp(lp[risk]).sum(), np.exp(lp[ev]).sum()
        total += lp[ev].sum()
        for l in range(d):
            total -= math.log(s0 - (l / d if ties == "efron" else 0) * e0)
    return total


@pytest.mark.parametrize("ties,late", [("efron", False), ("breslow", False), ("efron", True)])
def test_cox_fit_is_the_brute_force_optimum(spark, ties, late, monkeypatch):
    x, time, event, start = hazards_data(150, 2, late=late)
    pdf = pd.DataFrame({"sale_time": time, "event": event, "start": start, "x": x.tolist()})
    df = spark.createDataFrame(pdf).repartition(3)
    cols = [DesignColumn("a", "a"), DesignColumn("b", "b")]
    surv = SurvSpec(start="start") if late else SurvSpec()
    m = cox.fit(df, cols, surv=surv, ties=ties)
    f = lambda b: brute_loglik(b, x, time, event, start, ties)
    assert m.converged and np.isclose(m.loglik, f(m.beta)) and np.isclose(m.loglik_null, f(np.zeros(2)))
    h = 1e-4
    eye = np.eye(2) * h
    grad = np.array([(f(m.beta + e) - f(m.beta - e)) / (2 * h) for e in eye])
    assert np.abs(grad).max() < 1e-4
    hess = np.array([[(f(m.beta + a + b) - f(m.beta + a - b) - f(m.beta - a + b) + f(m.beta - a - b)) / (4 * h * h)
                      for b in eye] for a in eye])
    assert np.allclose(np.linalg.inv(-hess), m.variance, rtol=1e-3)
    # The same answer when the event times are worked off in several blocks.
    monkeypatch.setattr(cox, "PASS_CELLS", 1)
    monkeypatch.setattr(cox.CoxRows, "time_blocks", small_blocks)
    again = cox.fit(df, cols, surv=surv, ties=ties)
    assert np.allclose(again.beta, m.beta, atol=1e-8) and np.allclose(again.variance, m.variance, rtol=1e-8)


def small_blocks(self, lanes):
    times = np.sort(np.array([r["t"] for r in self._times.collect()]))
    for s in range(0, len(times), 7):
        yield times[s:s + 7]


def test_time_blocks_cover_all_times(spark):
    x, time, event, _ = hazards_data(600, 1, ties=False)
    df = spark.createDataFrame(pd.DataFrame({"sale_time": time, "event": event, "x": x.tolist()}))
    rows = cox.CoxRows(df, "x", 1)
    cox_cells, cox.PASS_CELLS = cox.PASS_CELLS, 300
    try:
        blocks = list(rows.time_blocks(1))
    finally:
        cox.PASS_CELLS = cox_cells
    assert len(blocks) > 1 and np.array_equal(np.concatenate(blocks), np.unique(time[event == 1]))


def test_large_ties_by_digamma(monkeypatch):
    s0, e0, d = np.array([60.0, 300.0]), np.array([20.0, 300.0]), np.array([40.0, 77.0])
    exact = cox.tie_sums(s0, e0, d, "efron")
    monkeypatch.setattr(cox, "DIRECT_TIES", 1)
    closed = cox.tie_sums(s0, e0, d, "efron")
    for name in ("log", "u", "v", "w0", "w1", "w2"):
        assert np.allclose(getattr(exact, name), getattr(closed, name), rtol=1e-8), name


def test_special_functions():
    assert np.isclose(digamma(np.array([1.0]))[0], -0.5772156649015329)
    assert np.isclose(trigamma(np.array([1.0]))[0], math.pi**2 / 6)
    x = np.linspace(0, 1, 11)
    assert np.allclose(beta_cdf(x, 2, 3), 6 * x**2 - 8 * x**3 + 3 * x**4)


def test_incomplete_rows_take_no_part(spark):
    rng = np.random.default_rng(4)
    rows = [(float(t), int(e), [float(x) for x in v]) for t, e, v in zip(rng.exponential(4, 80).round(1) + 0.1, rng.integers(0, 2, 80), rng.normal(size=(80, 2)))]
    schema = "sale_time double, event int, x array<double>"
    full = spark.createDataFrame(rows, schema)
    more = spark.createDataFrame(rows + [(1.0, 1, [None, 1.0]), (2.0, 0, [float("nan"), 0.0]), (None, 1, [1.0, 1.0]), (1.0, None, [1.0, 1.0]), (1.0, 1, None)], schema)
    cols = [DesignColumn("a", "a", "num"), DesignColumn("b", "b", "num")]
    want, got = cox.fit(full, cols), cox.fit(more, cols)
    assert got.n == 80 and np.allclose(got.beta, want.beta) and got.status(spark).first().converged
    assert cox.CoxRows(more, "x", 2).left_out() == 5


def test_subword_vectors_by_slices(spark, monkeypatch):
    """A worker used to hold all words of a batch, whatever the length of its texts."""
    texts = ["red house by the sea", None, "", "  ", "sea " * 9 + "the hill", "a", "red red sea"]
    assert [list(x) for x in encode.slices(texts, 40)] == [texts[:5], texts[5:]] and [*encode.slices([])] == []
    assert [len(x) for x in encode.slices(["abc"] * 5, 2)] == [1] * 5
    df = frame(spark, i=range(len(texts)), t=texts).repartition(1)
    whole = {r.i: r.v for r in encode.subword_vector(df, "t", 8, name="v").collect()}
    monkeypatch.setattr(encode, "slices", lambda x: [x[j:j + 2] for j in range(0, len(x), 2)])
    cut = {r.i: r.v for r in encode.subword_vector(df, "t", 8, name="v").collect()}
    assert len(whole) == 7 and all(np.allclose(whole[i], cut[i]) for i in whole) and whole[1] == whole[3] == [0.0] * 8


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_vector_means_shuffle_no_vectors(spark, part_bytes):
    """Each pair of a key and a term used to shuffle a vector of its own."""
    rng = np.random.default_rng(3)
    vectors = {t: [float(x) for x in rng.normal(size=3)] for t in range(12)}
    pairs = [(int(k), int(t), int(rng.integers(1, 5))) for k in range(9) for t in rng.choice(14, 6, replace=False)]
    counts = spark.createDataFrame(pairs, "doc long, term long, tf long").repartition("doc")
    table = spark.createDataFrame([*vectors.items(), (3, [1.0, None, 0.0])], "term long, embedding array<float>")
    out = encode.vector_table_mean(counts, table, "doc", part_bytes=part_bytes)
    rows = [(t, v) for t, v in [*vectors.items(), (3, [1.0, 0.0, 0.0])]]
    got = {r.doc: r.vector for r in out.collect()}
    assert set(got) == {k for k, t, _ in pairs if t < 12}
    for k in got:
        used = [(n, np.float32(v)) for d, t, n in pairs if d == k for u, v in rows if u == t]
        assert np.allclose(got[k], sum(n * v.astype(float) for n, v in used) / sum(n for n, _ in used))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ObjectHashAggregate" not in plan and "embedding" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    wrong = spark.createDataFrame([(0, None), (1, [1.0])], "term long, embedding array<float>")
    with pytest.raises(Exception, match="a vector is null or not of length"):
        encode.vector_table_mean(counts, wrong, "doc").collect()


@pytest.mark.parametrize("tasks", [None, 5])
def test_large_sums_reach_the_driver_once(spark, monkeypatch, tasks):
    """Every task's whole array used to be collected."""
    from lapsewise.operators import blocks

    cells, seen = 9 * blocks.PIECE + 5, []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: seen.append(collect(df)) or seen[-1])

    def kernel(batches, cells=cells):
        return np.arange(cells) * float(sum(b.num_rows for b in batches))

    found = blocks.tree_sum(spark.range(0, 1000, 1, 5), kernel, tasks, cells)
    assert np.array_equal(found, np.arange(cells) * 1000.0)
    assert sum(len(r["part"]) for rows in seen for r in rows) == 8 * cells
    assert blocks.tree_sum(spark.range(3), lambda batches: None) is None


def test_large_beta_parameters():
    x = np.array([0.4995, 0.5, 0.5003])
    near = special.beta_cdf(x, 4e6, 4e6), special._beta_normal(x, 4e6, 4e6)
    assert np.allclose(*near, atol=1e-8)
    assert np.allclose(special.beta_cdf(np.array([0.0, 0.5, 1.0]), 5e11, 5e11), [0.0, 0.5, 1.0], atol=1e-12)


@pytest.mark.parametrize("n,q", [(31_000, 0.1), (400_000, 0.5), (3_000_000, 0.1), (30_000_000, 0.9)])
def test_beta_between_the_fraction_and_the_normal_form(n, q):
    """The fraction stopped with an error from some hundred thousand ranks on."""
    a, b = (n + 1) * q, (n + 1) * (1 - q)
    x = np.sort(np.r_[0, 1, q + np.sqrt(q * (1 - q) / n) * np.linspace(-9, 9, 2001), np.linspace(0, 1, 20_000)])
    found = beta_cdf(x, a, b)
    assert np.allclose(found, special._beta_normal(x, a, b), atol=1e-8) and (found[0], found[-1]) == (0, 1)
    assert np.all(np.diff(found) >= -1e-13)


def test_weighted_quantiles_of_many_ranks(spark):
    values = [(v / 2000, r) for v in range(1, 2001) for r in (1, 2)]
    df = spark.createDataFrame(values, "x double, replicate int")
    found = compare.smoothed_quantiles(df, "x", [0.1, 0.5, 0.9], ["replicate"], F.lit(1500)).collect()
    assert len(found) == 6 and all(abs(r.value - r.prob) < 1e-3 for r in found)


def test_a_fold_without_a_score_does_not_count():
    raw = np.array([[0.6, 0.7, np.nan], [0.5, np.nan, np.nan], [np.nan] * 3])
    cv = coxnet._choose(np.array([3.0, 2.0, 1.0]), raw, np.array([10.0, 30.0, 5.0]), "C")
    assert np.allclose(cv.mean[:2], [0.675, 0.5]) and np.isnan(cv.mean[2]) and cv.lambda_min == 3.0


def test_cox_symmetries(spark):
    x, time, event, _ = hazards_data(120, 1, ties=False)
    mk = lambda z: spark.createDataFrame(pd.DataFrame({"sale_time": time, "event": event, "x": z.tolist()}))
    cols = [DesignColumn("a", "a")]
    a, b, c = cox.fit(mk(x), cols), cox.fit(mk(-x), cols), cox.fit(mk(x), cols, ties="breslow")
    assert np.isclose(a.beta[0], -b.beta[0]) and np.isclose(a.beta[0], c.beta[0])
    scored = a.linear_predictor(mk(x))
    res = cox.deviance_residuals(scored, cox.baseline_hazard(scored)).agg(F.sum("martingale")).first()[0]
    assert abs(res) < 1e-6
    ic = a.information_criteria()
    assert np.isclose(ic["aic"], -2 * a.loglik + 2) and 0 < ic["r2_scaled"] < 1


# --- elastic net ----------------------------------------------------------------------------

def test_path_ends(spark):
    x, time, event, _ = hazards_data(300, 4)
    df = spark.createDataFrame(pd.DataFrame({"sale_time": time, "event": event, "x": x.tolist(), "fold": np.arange(300) % 3}))
    cols = [DesignColumn(c, c, role="text" if c > "b" else "structured") for c in "abcd"]
    p = coxnet.path(df, cols, n_lambda=6, min_ratio=1e-6, fold="fold", measure="C")
    assert (p.betas[0] == 0).all() and (p.betas[-1] != 0).all() and set(p.status) == {"converged"}
    assert np.allclose(p.betas[-1], cox.fit(df, cols, ties="breslow").beta, atol=1e-3)
    assert p.cv.lambda_1se >= p.cv.lambda_min and p.cv.mean.max() > 0.6
    # Optimality of a middle point: the gradient lies within the penalty.
    lam, b = p.lambdas[2], p.betas[2]
    rows = cox.CoxRows(df, "x", 4)
    g = 2 / rows.n * cox.likelihood(rows, [cox.Lane(b * rows.sd)], "breslow")[0].gradient
    b = b * rows.sd
    off = b == 0
    assert (np.abs(g[off]) <= lam * 0.95 + 1e-4).all()
    assert np.allclose(g[~off], lam * (0.95 * np.sign(b[~off]) + 0.05 * b[~off]), atol=1e-3)
    model, chosen = coxnet.refit(p, df, "lambda.min")
    assert chosen.counts()["text"] + chosen.counts()["non_text"] == len(model.beta)
    loglik = coxnet.path(df, cols, n_lambda=4, min_ratio=0.05, fold="fold", measure="loglik")
    full, part = cox.Lane(np.zeros(4)), cox.Lane(np.zeros(4), 1)
    rows = cox.CoxRows(df, "x", 4, fold="fold")
    two = coxnet.loglik_only(rows, np.zeros((2, 4)), np.array([-2, 1]), "breslow")
    assert np.allclose(two, [s.loglik for s in cox.likelihood(rows, [full, part], "breslow")])
    assert loglik.cv.mean[-1] < loglik.cv.mean[0]


def test_ridge_keeps_everything(spark):
    x, time, event, _ = hazards_data(120, 3)
    df = spark.createDataFrame(pd.DataFrame({"sale_time": time, "event": event, "x": x.tolist()}))
    p = coxnet.path(df, [DesignColumn(c, c) for c in "abc"], lambdas=[1.0, 0.01], alpha=0.0)
    assert (p.betas != 0).all() and np.abs(p.betas[0]).sum() < np.abs(p.betas[1]).sum()
    assert np.allclose(p.beta_at(0.505), p.betas.mean(0))


def test_level_merge_is_exact(spark):
    df = spark.createDataFrame([("No",), ("No_Info",), ("Yes",)], "h string")
    out = coxnet.merge_levels(df, {"h": ("No",)}, {"h": "Yes"})
    assert sorted(r.h for r in out.collect()) == ["No_Info", "Yes", "Yes"]


# --- pairs and metrics ----------------------------------------------------------------------

def scored_rows(n=250, scores=25, horizon=6.0):
    t = np.minimum(np.ceil(RNG.exponential(4, n) * 3) / 3, horizon)  # a third of all rows at the horizon
    e = ((RNG.random(n) < 0.6) & (t < horizon)).astype(int)
    lp = np.where(RNG.random(n) < 0.35, 0.5, RNG.integers(0, scores, n) / scores)  # a hot score
    return t, e, lp


def brute_pairs(t, e, lp):
    i, j = np.nonzero((e[:, None] == 1) & ((t[None] > t[:, None]) | ((t[None] == t[:, None]) & (e[None] == 0))))
    return (lp[i] > lp[j]).sum(), (lp[i] < lp[j]).sum(), (lp[i] == lp[j]).sum()


@pytest.mark.parametrize("cells", [pairs.GROUP_CELLS, 30])
def test_concordance_counts(spark, cells):
    t, e, lp = scored_rows()
    df = frame(spark, sale_time=t, event=e, lp=lp, g=(np.arange(len(t)) % 2).astype(int))
    r = metrics.concordance(df, group_cells=cells).first()
    assert (r.concordant, r.discordant, r.tied) == brute_pairs(t, e, lp)
    flip = metrics.concordance(df.withColumn("lp", -F.col("lp")), group_cells=cells).first()
    assert np.isclose(r.c_index + flip.c_index, 1) and np.isclose(r.se, flip.se)
    for r in metrics.concordance(df, by=["g"], group_cells=cells).collect():
        at = np.arange(len(t)) % 2 == r.g
        assert (r.concordant, r.discordant, r.tied) == brute_pairs(t[at], e[at], lp[at])
    assert metrics.concordance(df.withColumn("lp", F.lit(1.0))).first().c_index == 0.5


def test_a_hot_score_is_cut(spark, monkeypatch):
    """Half of the rows share one score amid continuous ones; no task holds a group above the limit."""
    rng = np.random.default_rng(8)
    n, limit = 400, 60
    t, e = rng.exponential(5, n), rng.integers(0, 2, n)
    lp = np.where(rng.random(n) < 0.5, 0.25, rng.normal(size=n))
    plain = pairs._nodes

    def seen(pdf, score, strict, plain=plain, limit=limit):
        assert len(pdf) <= limit
        return plain(pdf, score, strict)

    monkeypatch.setattr(pairs, "_nodes", seen)
    df = frame(spark, sale_time=t, event=e, lp=lp)
    r = metrics.concordance(df, group_cells=limit, with_se=False).first()
    assert (r.concordant, r.discordant, r.tied) == brute_pairs(t, e, lp)


def test_rows_without_a_score_enter_no_pair(spark):
    t, e, lp = scored_rows()
    some = frame(spark, sale_time=t, event=e, lp=lp)
    more = some.unionByName(spark.createDataFrame([(1.0, 1, None), (2.0, 0, float("nan")), (None, 1, 0.5)], "sale_time double, event long, lp double")
                            .select(*[F.col(c).cast(some.schema[c].dataType) for c in some.columns]))
    assert metrics.concordance(more).first() == metrics.concordance(some).first()


@pytest.mark.parametrize("cells", [pairs.GROUP_CELLS, 25])
def test_uno_scores(spark, cells):
    t, e, lp = scored_rows()
    df = frame(spark, sale_time=t, event=e, lp=lp)
    g = metrics.censoring_curve(df)
    steps = g.toPandas().set_index("time")["surv"]
    gt = steps[t].to_numpy()
    w = np.where((e == 1) & (gt > 0), 1 / np.where(gt > 0, gt, 1), 0)
    phi = (lp[:, None] > lp[None]) + 0.5 * (lp[:, None] == lp[None])
    later = t[None] > t[:, None]
    want = ((w**2)[:, None] * later * phi).sum() / ((w**2)[:, None] * later).sum()
    assert np.isclose(metrics.uno_c(df, g, group_cells=cells).first()[0], want)
    auc = metrics.auc_uno(df, g, group_cells=cells).toPandas().set_index("time")["auc"]
    for x in np.unique(t)[2:-1:4]:
        use = w[:, None] * (t[:, None] <= x) * (t[None] > x)
        assert np.isclose(auc[x], (use * phi).sum() / use.sum())
    all_events = df.withColumn("event", F.lit(1))
    uno = metrics.uno_c(all_events, metrics.censoring_curve(all_events)).first()[0]
    assert np.isclose(uno, metrics.concordance(all_events).first().c_index)


@pytest.mark.parametrize("kind", ["cumulative", "incident"])
def test_model_auc(spark, kind):
    t, e, lp = scored_rows(120)
    df = frame(spark, sale_time=t, event=e, lp=lp)
    hazard = cox.baseline_hazard(df)
    table = hazard.toPandas()
    times = [1.0, 3.0]
    for pieces in (1, 6):
        out = metrics.model_auc(df, hazard, times, kind, pieces=pieces).toPandas().set_index("time")["auc"]
        for x in times:
            level = table.loc[table["time"] <= x, "cumulative"].max()
            s = np.exp(-level * np.exp(lp))
            case = 1 - s if kind == "cumulative" else np.exp(lp) * s
            phi = (lp[:, None] > lp[None]) + 0.5 * (lp[:, None] == lp[None])
            assert np.isclose(out[x], (case[:, None] * s[None] * phi).sum() / (case.sum() * s.sum()))


def test_brier_bounds(spark):
    t = RNG.exponential(3, 200)
    df = frame(spark, sale_time=t, event=np.ones(200, int), lp=np.zeros(200))
    hazard = spark.createDataFrame([(0.0, math.log(2))], "time double, cumulative double")
    out = metrics.brier(df, hazard, metrics.censoring_curve(df), [0.5, 2.0, 4.0]).toPandas()
    assert np.allclose(out["brier"], 0.25)
    ibs = metrics.integrated_brier(spark.createDataFrame(out)).first()[0]
    assert np.isclose(ibs, 0.25)


def test_score_bundle_and_separation(spark):
    t, e, lp = scored_rows(200)
    df = frame(spark, sale_time=t, event=e, lp=lp)
    found = metrics.score(df, df)
    assert set(found) == set(metrics.SCORES) and 0 <= found["integrated_brier"] <= 1
    flags = frame(spark, event=[1, 1, 0, 0, 1], level=["a", "a", "b", "c", "c"])
    assert {r.level for r in survival.separation(flags, ["level"]).collect()} == {"a", "b"}
    assert metrics.c_from_dxy(0.2) == pytest.approx(0.6)


# --- comparison -----------------------------------------------------------------------------

@pytest.mark.parametrize("task", [10_000, 60])
def test_kl_by_neighbours(spark, task):
    r = np.random.default_rng(1000)
    x, y = r.exponential(5, 3000), r.exponential(2.5, 400)
    df = frame(spark, v=np.r_[x, y], s=np.r_[np.zeros(3000, bool), np.ones(400, bool)])
    out = compare.kl_divergence(df, "v", F.col("s"), 5, task_values=task).toPandas().set_index("k")["divergence"]
    kth = lambda a, b, k, own: np.sort(np.abs(a[:, None] - b[None]), axis=1)[:, k - 1 + own]
    for k in (1, 5):
        want = np.log(kth(x, y, k, 0) / kth(x, x, k, 1)).mean() + math.log(400 / 3000)
        assert np.isclose(out[k], want)
    assert abs(out[5] - 0.307) < 0.2


def test_ks_and_smoothed_quantiles(spark):
    x, y = RNG.normal(size=80), RNG.normal(0.5, 1, 60)
    df = frame(spark, v=np.r_[x, y], s=np.r_[np.zeros(80, bool), np.ones(60, bool)])
    z = np.r_[x, y]
    gap = [(y <= v).mean() - (x <= v).mean() for v in z]
    assert np.isclose(compare.ks_two_sample(df, "v", F.col("s")).first().statistic, np.abs(gap).max())
    assert np.isclose(compare.ks_two_sample(df, "v", F.col("s"), "less").first().statistic, max(max(gap), 0))
    q = compare.smoothed_quantiles(df.filter("not s"), "v", [0.5]).first().value
    edges = beta_cdf(np.arange(81) / 80, 81 * 0.5, 81 * 0.5)
    assert np.isclose(q, (np.diff(edges) * np.sort(x)).sum())
    boot = compare.compare_quantiles(df.withColumn("k", F.monotonically_increasing_id()), "v", F.col("s"), [0.5],
                                     key="k", replicates=10).first()
    assert boot.low <= boot.high


# --- sources --------------------------------------------------------------------------------

def test_listing_csv_and_parquet_round_trip(spark, tmp_path):
    from lapsewise.sources import tables

    for i, day in enumerate(("2021-01-05", "bad")):
        head = ",".join(f.name for f in tables.LISTING_SCHEMA)
        cells = dict.fromkeys((f.name for f in tables.LISTING_SCHEMA), "NA") | {
            "listed_date": day, "bath": "2.5", "description": '"two\nlines, ""quoted"""'}
        (tmp_path / f"{i}.csv").write_text(head + "\n" + ",".join(cells.values()) + "\n")
    df = tables.read_listing_csv(spark, str(tmp_path / "0.csv"), str(tmp_path / "1.csv")).drop("X")
    df = clean.to_dates(clean.to_numeric(df, ["bath", "bed"]), ["listed_date"])
    rows = df.orderBy(F.col("listed_date").desc_nulls_last()).collect()
    assert [r.listed_date is None for r in rows] == [False, True]
    assert rows[0].bath == 2.5 and rows[0].bed is None and rows[0].description == 'two\nlines, "quoted"'
    tables.write_features(df.select("bath", F.lit("p0").alias("level")), str(tmp_path / "out"), ("level",))
    assert tables.read_features(spark, str(tmp_path / "out")).filter("level = 'p0'").count() == 2
    tables.write_scores(df.select("bath"), str(tmp_path / "scores"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "scores")).count() == 2


# --- plans ----------------------------------------------------------------------------------

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_prune_columns_and_run_python_once(spark):
    from lapsewise import plans

    folder = "/root/testdata/sf0.001"
    plan = plan_of(plans.QUERIES["count_predicate"](spark, folder))
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan and "l_linestatus" in plan
    for name in ("subword_vec", "doc_term_stemmed", "typos_p05", "pca_coords"):
        assert plan_of(plans.QUERIES[name](spark, folder)).split("== Initial Plan ==")[0].count("ArrowEvalPython") == 1, name
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,12)]" in plan_of(plans.QUERIES["threshold_filter"](spark, folder))
    assert "ArrowEvalPython" not in plan_of(plans.QUERIES["pos_filter"](spark, folder))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_closest_by_tiles_equals_brute_force(monkeypatch, metric):
    monkeypatch.setattr(linalg, "TILE", (7, 9))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 5)).round(1)
    x[::3], x[1] = x[0], np.nan
    u = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    ids = np.arange(90) * 2
    d = np.round(1 - u @ u.T if metric == "cosine" else np.linalg.norm(x[:, None] - x[None], axis=2), 9) + 0.0
    np.fill_diagonal(d, np.inf)
    at, near, other = linalg._closest(u, ids, u, ids, 4, metric, True)
    for i in range(90):
        want = [] if i == 1 else sorted((v, o) for v, o in zip(d[i], ids) if np.isfinite(v))[:4]
        assert [o for o in other[at == i]] == [o for _, o in want] and np.allclose(near[at == i], [v for v, _ in want], atol=1e-9)


def test_copies_far_from_the_origin_rank_by_key(spark):
    """Squares of large components lose their last digits; copies are at distance 0 all the same."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5)) + 1000.0
    x[::3] = x[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = linalg.nearest_neighbours(df, "id", "v", 3, "euclidean", block_rows=4).where("id = 30").orderBy("rank").collect()
    assert [(r.neighbour, r.distance) for r in got] == [(0, 0.0), (3, 0.0), (6, 0.0)]


# --- many scores of the same rows -------------------------------------------------------------

@pytest.mark.parametrize("times, limit", [(40, 500_000), (40, 100), (900, 150)])
def test_score_totals_equal_concordance(spark, times, limit):
    """Packed scores count the same pairs as the general operator: hot scores, signed zeros, scores that are not numbers, several ranges."""
    rng = np.random.default_rng(3)
    t, e, f = rng.integers(0, times, 1500) / 7, rng.integers(0, 2, 1500), rng.integers(0, 2, 1500)
    x = np.stack([np.where(rng.random(1500) < 0.3, 1.5, rng.random(1500).round(2)), rng.normal(size=1500), np.where(t < 1, -0.0, 0.0)], axis=1)
    x[7, 1] = np.nan
    df = frame(spark, t=t, e=e, f=f, x=list(x)).repartition(3).select("t", F.col("e").cast("int"), F.col("f").cast("int"), "x")
    got = pairs.score_totals(df, lambda b: matrix(b.column(3), 3), np.unique(t[e == 1]), {g: int((f == g).sum()) for g in (0, 1)}, limit)
    want = metrics.concordance(df.select("t", "e", "f", F.posexplode("x").alias("i", "lp")), "lp", SurvSpec("t", "e"), by=["f", "i"], with_se=False)
    assert got.orderBy("f", "i").collect() == want.select("f", "i", "concordant", "discordant", "tied").orderBy("f", "i").collect()


def test_paths_fit_once_for_all_measures(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    df = frame(spark, time=rng.exponential(np.exp(-x[:, 0])).round(2) + 0.01, event=rng.integers(0, 2, 300), x=list(x), fold=np.arange(300) % 3)
    cols = [DesignColumn("a", "a"), DesignColumn("b", "b")]
    surv, how = SurvSpec("time", "event"), {"n_lambda": 4, "min_ratio": 0.1, "fold": "fold"}
    apart = [coxnet.path(df, cols, surv=surv, measure=m, **how) for m in ("loglik", "C")]
    made = []
    monkeypatch.setattr(coxnet, "CoxRows", lambda *a: made.append(1) or cox.CoxRows(*a))
    both = coxnet.paths(df, cols, ("loglik", "C"), surv=surv, **how)
    assert len(made) == 1 and [p.cv.measure for p in both] == ["loglik", "C"]
    for a, b in zip(apart, both):
        assert np.allclose(a.betas, b.betas) and np.allclose(a.cv.mean, b.cv.mean) and a.cv.lambda_1se == b.cv.lambda_1se


def test_two_column_components_join_once(spark, monkeypatch):
    from lapsewise.plans import vectors

    rows = frame(spark, obs=["a", "b", "c"], listed_price=[1.0, 2.0, 4.0]).join(frame(spark, obs=["a", "b", "c"], lot_area=[3.0, 1.0, 2.0]), "obs")
    monkeypatch.setattr(vectors.views, "survival", lambda *a: rows)
    out = vectors.pca_two_coords(spark, "")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 3


def test_documents_count_their_terms_where_they_are(spark, monkeypatch):
    rows = [(1, "red red blue"), (2, None), (None, "green red"), (3, "..."), (1, "blue of Grün"), (None, "green"), (4, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    opts = text.options(stemming=False, sparse=0.99)
    monkeypatch.setattr(text, "COUNTED_TERMS", 2)
    for some in (docs, docs.where("text like '%blue%' and text not like 'red%' or doc_id > 1")):  # with keys that repeat, and without
        counts = text.term_counts(some, "doc_id", "text", opts)
        long = text.document_terms(some, "doc_id", "text", opts).select("doc_id", F.inline("terms"))
        assert Counter(map(tuple, long.collect())) == Counter(map(tuple, counts.collect()))
        weights, _ = text.tfidf(some, "doc_id", "text", opts)
        plain = text.weighted(counts, text.vocabulary(counts, some, 0.99), "doc_id", opts)
        assert Counter(map(tuple, weights.collect())) == Counter(map(tuple, plain.collect()))
    assert "Window" not in weights._jdf.queryExecution().toString()


def test_term_vectors_need_no_shuffle_of_weights(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, "..."), (4, "red green green")], "doc_id long, text string")
    vectors = lambda: {r.doc_id: r["vector"] for r in encode.embed(docs, "doc_id", "text", "tf-idf", stemming=False, sparse=0.9, low_idf_quantile=0.1).collect()}
    monkeypatch.setattr(text, "is_small", lambda *_: False)
    plain = vectors()
    monkeypatch.undo()
    monkeypatch.setattr(text, "term_vectors", None)
    assert vectors() == plain and plain[3] == [0.0] * len(plain[1])


def test_grid_builds_what_representations_share_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"red blue green {'plum ' * (i % 3)}") for i in range(12)], "doc_id long, text string")
    made = Counter()
    for module, name in ((text, "document_terms"), (encode, "encode")):
        def counted(*args, _real=getattr(module, name), _name=name, **more):
            made[_name] += 1
            return _real(*args, **more)
        monkeypatch.setattr(module, name, counted)
    shared = []
    for r in (grid.Representation("a", "tf-idf", options={"sparse": 0.7}), grid.Representation("b", "tf-idf", options={"sparse": 0.9, "low_idf_quantile": 0.1}),
              grid.Representation("c", "encoder", 8, 2), grid.Representation("d", "encoder", 8, "80%"), grid.Representation("e", "encoder", 4)):
        built, _ = grid.vectors_for(docs, grid.Setting(), r, shared)
        assert "text" not in built.columns and built.count() == 12
    assert made == {"document_terms": 1, "encode": 2}


def test_encoder_digests_a_token_once(monkeypatch):
    asked = []
    real = encode._digest
    monkeypatch.setattr(encode, "_digest", lambda piece: asked.append(piece) or real(piece))
    model = encode.HashingEncoder(8)
    out = model(["a home A b", "", "b home"])
    assert sorted(asked) == ["a", "b", "home"]
    want = np.zeros(8)
    for i, token in enumerate("a home a b".split()):
        h, sign = real(token)
        want[h % 8] += (1.0 if sign else -1.0) / np.sqrt(1.0 + i)
    assert (out[0] == np.tanh(want)).all() and not out[1].any()


def test_removal_asks_for_the_wanted_tags_alone(spark):
    docs = spark.createDataFrame([(1, "He took THAT 12 7th boats , which it 'twas ½ ٣ İt none - one's")], "doc_id long, text string")
    for remove in (degrade.STUDY_TAGS, ("DET",), ("PRON",), ("NUM",), ("PUNCT", "DET"), ("PROPN",)):
        for lower in (True, False):
            fast = degrade.filter_pos_text(F.col("text"), remove=remove, lowercase=lower)
            source = F.lower("text") if lower else F.col("text")
            plain = F.array_join(F.filter(degrade.tokens_of(source), lambda t: ~degrade.tag_of(t).isin(list(remove))), " ")
            row = docs.select(fast.alias("a"), plain.alias("b")).first()
            assert row.a == row.b
    removed = docs.select(degrade.filter_pos_text(F.col("text"), remove=degrade.STUDY_TAGS))
    assert degrade.SIGN_PATTERN not in removed._jdf.queryExecution().optimizedPlan().toString()


def test_rebuilt_texts_shuffle_no_tokens(spark, tmp_path):
    rows = [(1, "a red home", "en", "x"), (2, None, "en", "x"), (3, "the 3 homes", "en", "x"), (4, "the", "en", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = plans.QUERIES["rebuild_text"](spark, str(tmp_path))
    assert "ObjectHashAggregate" in (plan := out._jdf.queryExecution().executedPlan().toString())
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL") == 2  # texts and keys
    assert {r.doc_id: r.n_chars for r in out.collect()} == {1: 8, 2: 0, 3: 5, 4: 0}


def test_typos_draw_for_a_bounded_number_of_characters(spark, monkeypatch):
    """The draws of one long text, and of all texts of a slice, used to be made together."""
    words = "The quick brown fox. " * 40
    rows = [(i, words[: 7 * i % 800] or None) for i in range(60)] + [(None, ""), (60, words)]
    plain = [degrade.mistype(t, (i, 5, 9), 0.1, 0.5, (0.4, 0.3, 0.15, 0.15)) for i, t in enumerate(t for _, t in rows if t)]
    seen, draws = [], degrade.counter_draws
    monkeypatch.setattr(degrade, "counter_draws", lambda at, *k: seen.append(len(at)) or draws(at, *k))
    monkeypatch.setattr(degrade, "DRAW_CHARS", 64)
    some = [t for _, t in rows if t]
    keys = np.array([(i, 5, 9) for i in range(len(some))], dtype=np.int64)
    assert degrade.mistype_all(some, keys, np.full(len(some), 0.1), 0.5, (0.4, 0.3, 0.15, 0.15)) == plain
    # a draw per character of a piece; the kinds and choices are drawn for places that are hit
    assert max(seen[:-2]) <= 64 and sum(seen[:-2]) == sum(map(len, some))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = df.select("doc_id", degrade.typos(F.col("text"), F.col("doc_id"), 0.2).alias("t")).collect()
    assert [r.t for r in whole if r.doc_id is not None and r.doc_id < 1] == [None] and sum(r.t == "" for r in whole) == 1
    assert degrade.degrade_levels(df, "doc_id", "text", (0.0, 0.1)).count() == 2 * len(rows)


def test_stemming_sends_runs_of_terms_to_python(spark, monkeypatch):
    """A row of a Python batch used to hold all terms of a text, whatever its length."""
    long = " ".join(f"walking{'s' * (i % 2)} word{i % 70}" for i in range(100))
    docs = spark.createDataFrame([(1, long), (1, "Running"), (2, None), (3, ""), (None, "the of"), (None, "jumps jumped")], "doc_id long, text string")
    found = {(r.doc_id, r.term): r.tf for r in text.term_counts(docs, "doc_id", "text").collect()}
    whole = docs.select("doc_id", F.explode(text.terms_of(F.col("text"), text.TermOptions())).alias("term")).where("length(term) >= 3").collect()
    assert found == Counter((r.doc_id, r.term) for r in whole) and found[1, "walk"] == 100 and found[None, "jump"] == 2

    @F.arrow_udf("array<string>")
    def only_runs(terms):
        assert max(terms.value_lengths().fill_null(0).to_pylist()) <= 32, "a whole text"
        return terms

    monkeypatch.setattr(text, "stem_terms", only_runs)
    raw = text.term_counts(docs, "doc_id", "text").agg(F.sum("tf")).first()[0]
    assert raw == sum(found.values())


def test_word_grams_are_hashed_side_by_side(monkeypatch):
    """Every n-gram of every word used to be hashed by a call of its own."""
    import hashlib
    import random

    from lapsewise.functions import digest

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh<>éß日🙂", k=rng.choice([1, 2, 5, 9, 30, 53, 70]))) for _ in range(300)]
    places = {}

    def place(gram):
        h = hashlib.md5(gram.encode()).hexdigest()
        return places.setdefault(gram, (int(h[:8], 16) % 10, 2 * (int(h[8], 16) % 2) - 1))

    want = np.zeros((len(words), 10))
    for i, word in enumerate(words):
        marked = f"<{word}>"
        for gram in [marked[j:j + n] for n in range(3, 7) for j in range(len(marked) - n + 1)] + [marked]:
            at, sign = place(gram)
            want[i, at] += sign
    norm = np.sqrt((want ** 2).sum(1, keepdims=True))
    want /= np.where(norm > 0, norm, 1.0)
    real, asked = hashlib.md5, []
    monkeypatch.setattr(hashlib, "md5", lambda x: asked.append(x) or real(x))
    seen = digest.Digests(6)
    for _ in range(2):  # also with a full table
        assert np.array_equal(encode.word_vectors(words, 10, 3, 6, seen), want)
    assert asked and all(len(x) > digest.LONGEST for x in asked)
    assert encode.word_vectors([], 10, 3, 6, seen).shape == (0, 10)


def test_vector_means_store_no_counts(spark, monkeypatch):
    """With more than one part the counts, and a sum per key and part, used to be checkpointed; odd rows count as in a join."""
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df, eager=True: pytest.fail("rows are stored"))
    monkeypatch.setattr(encode, "PAIRS", 7)
    rng = np.random.default_rng(5)
    pairs = [(int(k), f"t{t}", int(rng.integers(1, 5))) for k in range(9) for t in rng.choice(14, 6)]
    pairs += [(None, "t1", 2), (None, "t2", None), (20, None, 3), (21, "t3", None), (22, "absent", 1)]
    vectors = [(f"t{t}", [float(x) for x in rng.normal(size=3)]) for t in range(13)]
    vectors += [("t3", [1.0, None, 0.0]), ("t3", [0.5, 0.5, 0.5]), (None, [1.0, 1.0, 1.0]), ("never used", None), ("nor this", [2.0])]
    counts = spark.createDataFrame(pairs, "doc long, term string, tf int")
    table = spark.createDataFrame(vectors, "term string, embedding array<double>")
    one, many = ({r.doc: r.vector for r in encode.vector_table_mean(counts, table, "doc", part_bytes=b).collect()} for b in (1 << 20, 200))
    assert set(one) == set(many) == {*range(9), None, 21} and many[21] == one[21] == [None] * 3
    assert all(np.allclose(one[k], many[k], rtol=1e-12) for k in one if k != 21)
    nothing = encode.vector_table_mean(counts.limit(0), table, "doc", part_bytes=200)
    assert nothing.collect() == [] and nothing.schema == encode.vector_table_mean(counts, table, "doc").schema
    with pytest.raises(Exception, match="a vector is null or not of length"):
        encode.vector_table_mean(counts.union(spark.createDataFrame([(1, "never used", 1)], "doc long, term string, tf int")), table, "doc", part_bytes=200).collect()


def test_small_tasks_of_a_fit_are_joined(spark, monkeypatch):
    """Every partition used to bring its own sums per event time, however few its rows were."""
    rng = np.random.default_rng(6)
    rows = [(float(t), int(e), [float(x) for x in v]) for t, e, v in zip(rng.exponential(4, 400).round(1) + 0.1, rng.integers(0, 2, 400), rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "sale_time double, event int, x array<double>").repartition(30)
    cols = [DesignColumn("a", "a", "num"), DesignColumn("b", "b", "num")]
    cores, cached = spark.sparkContext.defaultParallelism, lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = cached()
    prepared = cox.CoxRows(df, "x", 2)
    assert prepared.tasks == prepared.df.rdd.getNumPartitions() == cores
    one = cox.fit(df, cols, rows=prepared)
    prepared.release()
    assert cached() == before
    monkeypatch.setattr(cox, "TASK_BYTES", 1)
    apart = cox.CoxRows(df, "x", 2)
    assert apart.tasks == apart.df.rdd.getNumPartitions() == 30
    assert np.allclose(cox.fit(df, cols, rows=apart).beta, one.beta, rtol=1e-9)
    apart.release()
