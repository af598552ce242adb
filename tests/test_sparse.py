"""Sparse designs and fits against dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsewise.operators import cox, coxnet, linalg, sparse
from lapsewise.operators.survival import SurvSpec

RNG = np.random.default_rng(12)


def homes(spark, n=400):
    rows = [(i, float(RNG.integers(1, 30)), float(RNG.integers(0, 1)), int(RNG.random() < 0.6), float(RNG.normal()) if RNG.random() < 0.5 else 0.0, "abc"[RNG.integers(3)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, t double, s double, e int, v double, h string")


def test_entries_are_the_non_zero_cells(spark):
    df = homes(spark, 60)
    terms = spark.createDataFrame([(1, "x", 2.0), (1, "a", 1.0), (7, "x", 0.0), (9, "zz", 4.0)], "id long, term string, w double")
    dense, dense_columns = linalg.design(df, ["v"], {"h": ["a", "b", "c"]})
    rows, columns = sparse.sparse_design(df, ["v"], {"h": ["a", "b", "c"]}, terms, "id")
    assert [c.name for c in columns] == [*[c.name for c in dense_columns], "a", "x", "zz"]
    want = {r.id: list(r.x) + [0.0] * 3 for r in dense.collect()}
    want[1][-3:], want[9][-3:] = [1.0, 2.0, 0.0], [0.0, 0.0, 4.0]
    for r in rows.collect():
        got = [0.0] * len(columns)
        for place, value in r.x:
            got[place] = value
        assert got == want[r.id] and [p for p, _ in r.x] == sorted(p for p, v in r.x) and all(v for _, v in r.x)
    assert rows.columns == [*df.columns, "x"]


def test_the_vocabulary_stays_in_spark(spark):
    """Terms used to be collected for their places, whatever their number."""
    words = [f"{i * 7919 % 5000:04d}w" for i in range(5000)]
    terms = spark.createDataFrame([(i % 50, w, i % 9) for i, w in enumerate(words)], "id long, term string, n long").repartition(7)
    rows, columns = sparse.sparse_design(spark.range(50).withColumn("v", F.lit(1.0)), ["v"], terms=terms, key="id")
    entries = sparse.sparse_entries(rows, "id", columns)
    assert columns._all is None and len(columns) == 5001
    assert {tuple(r) for r in entries.where("column <> 'v'").collect()} == {(i % 50, w, float(i % 9)) for i, w in enumerate(words) if i % 9}
    assert entries.where("column = 'v'").count() == 50
    assert [tuple(r) for r in columns.table().orderBy("_place").collect()] == list(enumerate(["v", *sorted(words)]))
    assert [c.name for c in columns] == ["v", *sorted(words)] and columns[-1].role == "text"


def test_nulls_and_unknown_levels(spark):
    df = spark.createDataFrame([(1, None, "b", 1.0, 1), (2, 1.0, "q", 2.0, 1), (3, 0.0, None, 3.0, 1), (4, 2.0, "a", 4.0, 0), (5, float("nan"), "a", 4.0, 0)], "id int, v double, h string, t double, e int")
    rows, columns = sparse.sparse_design(df, ["v"], {"h": ["a", "b"]})
    assert {r.id: [tuple(c) for c in r.x] for r in rows.where("id <> 5").collect()} == {1: [(0, None), (1, 1.0)], 2: [(0, 1.0)], 3: [(1, None)], 4: [(0, 2.0)]}
    assert sparse.SparseRows(rows, "x", 2, SurvSpec("t", "e")).n == 2
    with pytest.raises(ValueError):
        sparse.SparseRows(rows.where("id = 1"), "x", 2, SurvSpec("t", "e"))


@pytest.mark.parametrize("late,ties", [(False, "efron"), (True, "efron"), (False, "breslow")])
def test_gradient_equals_the_dense_one(spark, late, ties):
    df = homes(spark).withColumn("s", F.col("t") - 1 - F.pmod("id", F.lit(9)))
    surv = SurvSpec("t", "e", "s" if late else None)
    dense, columns = linalg.design(df, ["v"], {"h": ["a", "b", "c"]})
    rows, _ = sparse.sparse_design(df, ["v"], {"h": ["a", "b", "c"]})
    full, thin = cox.CoxRows(dense, "x", 3, surv), sparse.SparseRows(rows, "x", 3, surv)
    beta = np.array([0.3, -0.2, 0.5])
    step = cox.likelihood(full, [cox.Lane(beta)], ties)[0]
    value, gradient = thin.likelihood(beta, ties)
    shift = (full.mean / full.sd) @ beta  # the dense score is centred; the likelihood does not see it
    assert np.isfinite(shift) and np.allclose(gradient, step.gradient, atol=1e-8) and np.isclose(value, step.loglik)


def test_fit_equals_newton(spark):
    df = homes(spark)
    dense, columns = linalg.design(df, ["v"], {"h": ["a", "b", "c"]})
    rows, _ = sparse.sparse_design(df, ["v"], {"h": ["a", "b", "c"]})
    newton, thin = cox.fit(dense, columns, surv=SurvSpec("t", "e")), sparse.fit_sparse(rows, columns, surv=SurvSpec("t", "e"))
    assert thin.converged and np.allclose(thin.beta, newton.beta, atol=1e-6)
    assert np.isclose(thin.loglik, newton.loglik) and np.isclose(thin.loglik_null, newton.loglik_null)
    with pytest.raises(ValueError):
        sparse.fit_sparse(rows, columns, ties="exact")


def test_minimise_with_an_absolute_penalty():
    a = RNG.normal(size=(50, 20))
    y = a[:, :3] @ [2.0, -1.0, 0.5] + RNG.normal(size=50) * 0.1
    f = lambda b: (((a @ b - y) ** 2).mean() / 2, a.T @ (a @ b - y) / 50)
    b, *_, done = sparse.minimise(f, 20, 0.1, max_iter=500, tol=1e-9)
    plain = np.zeros(20)
    for _ in range(3000):  # coordinate descent
        for j in range(20):
            rho = a[:, j] @ (y - a @ plain + a[:, j] * plain[j]) / 50
            plain[j] = np.sign(rho) * max(abs(rho) - 0.1, 0) / ((a[:, j] ** 2).mean())
    assert done and np.allclose(b, plain, atol=1e-6) and (b == 0).sum() == (np.abs(plain) < 1e-9).sum()


def test_a_selection_recodes_and_drops(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], "xy"[i % 2], float(i % 7), 1) for i in range(60)], "id int, h string, o string, t double, e int")
    columns = tuple(linalg.DesignColumn(f"{v}={k}", v, k) for v, k in (("h", "b"), ("h", "c"), ("o", "y")))
    path = coxnet.CoxPath(columns, np.array([0.1]), np.array([[0.0, 0.4, 0.0]]), ("ok",), 0.95, "x", SurvSpec("t", "e"))
    table = coxnet.selection_table(path, spark, {"h": "a", "o": "x"}, 0.1)
    assert {tuple(r) for r in table.collect()} == {("h", "b", "a", False), ("h", "c", "c", True), ("o", "y", "x", False)}
    merged = coxnet.recode_selected(df, table, ["h", "o"])
    assert merged.columns == df.columns and {tuple(r) for r in merged.select("h", "o").distinct().collect()} == {("a", "x"), ("c", "x")}
    kept, gone = coxnet.drop_constant_factors(merged, ["h", "o"])
    assert gone == ["o"] and kept.columns == ["id", "h", "t", "e"]


def test_bucketed_tables_join_without_a_shuffle(spark):
    from lapsewise import plans

    plan = plans.QUERIES["bucketed_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


@pytest.mark.parametrize("late", [False, True])
def test_few_times_need_no_table_of_times(spark, monkeypatch, late):
    """Every step used to join the rows with a table of times; with few times it adds up packed rows, to the same value and gradient."""
    df = homes(spark).withColumn("s", F.col("t") - 1 - F.pmod("id", F.lit(9)))
    surv = SurvSpec("t", "e", "s" if late else None)
    rows, _ = sparse.sparse_design(df, ["v"], {"h": ["a", "b", "c"]})
    beta = np.array([0.3, -0.2, 0.5])
    monkeypatch.setattr(sparse, "DENSE_TIMES", 0)
    by_table = sparse.SparseRows(rows, "x", 3, surv)
    want = by_table.likelihood(beta)
    monkeypatch.setattr(sparse, "DENSE_TIMES", 1 << 16)
    monkeypatch.setattr(sparse, "running", None)
    dense = sparse.SparseRows(rows, "x", 3, surv)
    got = dense.likelihood(beta)
    assert by_table.times is None and len(dense.times) == by_table.n_times
    assert np.isclose(got[0], want[0]) and np.allclose(got[1], want[1], atol=1e-9)
