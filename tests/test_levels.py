"""Time-dependent scores by hazard levels against their definitions, over narrow and very wide ranges of scores."""

import numpy as np
import pandas as pd
import pytest

from lapsewise.operators import cox, metrics
from lapsewise.operators.levels import NODES, Panels

RNG = np.random.default_rng(5)


def held_out(spark, n, spread):
    pdf = pd.DataFrame({"sale_time": np.round(RNG.exponential(3, n), 1), "event": RNG.integers(0, 2, n),
                        "lp": np.round(RNG.normal(0, spread, n), 2)})
    pdf.loc[: n // 3, "sale_time"] = 2.0  # a hot time
    return pdf, spark.createDataFrame(pdf)


def carried(table, column, times, before):
    table = table.sort_values("time")
    at = np.searchsorted(table["time"], times, side="right") - 1
    return np.where(at >= 0, table[column].to_numpy()[at.clip(0)], before)


@pytest.mark.parametrize("rate", [0.0, 1e-6, 1.0, 37.0, 1e4, 1e12])
def test_panels_read_terms(rate):
    panels = Panels.over(2.5, max(rate, 1.0))
    level = np.concatenate([[0.0, 2.5], panels.at[:5], 2.5 * RNG.random(200), 2.5 * 10 ** -RNG.uniform(0, 14, 200)])
    got = panels.read(level, np.exp(-rate * panels.at))
    assert np.abs(got - np.exp(-rate * level)).max() < 1e-12
    assert len(panels.at) <= NODES * (3 + max(0, np.log2(max(rate, 1.0))))


@pytest.mark.parametrize("spread, pieces", [(0.0, 1), (0.5, 5), (6.0, 5)])
def test_brier_by_definition(spark, spread, pieces):
    pdf, df = held_out(spark, 150, spread)
    hazard, g = cox.baseline_hazard(df), metrics.censoring_curve(df)
    times = sorted({0.0, 0.05, 50.0, *pdf["sale_time"]})
    out = metrics.brier(df, hazard, g, times, pieces=pieces).toPandas().set_index("time")["brier"]
    t, e, r = pdf["sale_time"].to_numpy(), pdf["event"].to_numpy(), np.exp(pdf["lp"].to_numpy())
    steps, level = g.toPandas(), carried(hazard.toPandas(), "cumulative", times, 0.0)
    inverse = lambda at: np.array([1 / x if x > 0 else 0.0 for x in carried(steps, "surv", at, 1.0)])
    own, now = inverse(t), inverse(times)
    assert sorted(out.index) == times
    for x, lv, w in zip(times, level, now):
        s = np.exp(-lv * r)
        want = np.where(t <= x, s**2 * e * own, (1 - s) ** 2 * w).mean()
        assert out[x] == pytest.approx(want, abs=1e-10)


@pytest.mark.parametrize("kind", ["cumulative", "incident"])
@pytest.mark.parametrize("spread", [0.0, 6.0])
def test_auc_by_definition(spark, kind, spread):
    pdf, df = held_out(spark, 150, spread)
    hazard = cox.baseline_hazard(df)
    times = sorted({0.0, 0.05, 50.0, *pdf["sale_time"]})
    grid = spark.createDataFrame([(x,) for x in times], "time double")
    out = metrics.model_auc(df, hazard, grid, kind, pieces=3).toPandas().set_index("time")["auc"]
    lp = pdf["lp"].to_numpy()
    r, phi = np.exp(lp), (lp[:, None] > lp[None]) + 0.5 * (lp[:, None] == lp[None])
    for x, lv in zip(times, carried(hazard.toPandas(), "cumulative", times, 0.0)):
        s = np.exp(-lv * r)
        case = -np.expm1(-lv * r) if kind == "cumulative" else r * s
        if case.sum() == 0:
            assert np.isnan(out[x])
        else:
            assert out[x] == pytest.approx((case[:, None] * s[None] * phi).sum() / (case.sum() * s.sum()), abs=1e-8)


def test_rows_without_scores_and_empty_tables(spark):
    pdf, df = held_out(spark, 40, 1.0)
    hazard, g = cox.baseline_hazard(df), metrics.censoring_curve(df)
    odd = df.unionByName(spark.createDataFrame([(1.0, 1, None), (2.0, 0, float("nan"))], "sale_time double, event int, lp double"))
    for one in (lambda d: metrics.brier(d, hazard, g, [1.0, 2.0]), lambda d: metrics.model_auc(d, hazard, [1.0, 2.0], "incident")):
        assert sorted(one(df).collect()) == sorted(one(odd).collect())
        assert [tuple(x) for x in one(df.limit(0)).orderBy("time").collect()] == [(1.0, None), (2.0, None)]
