"""MinHash near-dedup and embedding near-dedup against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsewise.llm import common, minhash, vectors

from .conftest import clashing, words


def closed(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def plain_sets(rows, width):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = set() if not w else {tuple(w)} if len(w) < width else {tuple(w[k:k + width]) for k in range(len(w) - width + 1)}
    return out


def plain_components(rows, width, percent):
    sets = plain_sets(rows, width)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return closed(ids, links), {i: len(s) for i, s in sets.items()}


def near_rows(n_groups=30, seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for g in range(n_groups):
        base = words(100 + g, int(rng.integers(4, 400)))
        for _ in range(int(rng.integers(1, 8))):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 15))):
                own[int(rng.integers(len(own)))] = f"x{rng.integers(10**6)}"
            rows.append((i, " ".join(own)))
            i += 1
    return rows


def test_components_equal_all_pairs(make):
    rows = near_rows() + [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a b c d"), (905, "a b c d e"), (906, "a b c d e f")]
    want, sizes = plain_components(rows, 4, 80)
    got = {r.doc_id: r for r in minhash.near_duplicates(make(rows), width=4).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (i == want[i]) for i, r in got.items())


@pytest.mark.parametrize("whole, stars", [(64, 0), (0, 0), (64, 1)])
def test_a_hot_group_is_cut_in_pieces(make, monkeypatch, whole, stars):
    """A chain of texts in which most pairs are no links, with pieces of four rows, by cluster and by group."""
    monkeypatch.setattr(minhash, "HOT", 4)
    monkeypatch.setattr(minhash, "STARS", stars)
    monkeypatch.setattr(minhash, "WHOLE", whole)
    base = words(5, 300)
    rows = [(i, " ".join(base[:290 - 7 * i] + words(50 + i, 7 * i))) for i in range(25)]
    want, _ = plain_components(rows, 5, 80)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make(rows)).collect()}
    assert got == want


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    common_part, a, b = (rng.integers(1, 1 << 63, n, dtype=np.uint64) for n in (2000, 200, 300))
    x, y = (np.unique(np.concatenate([common_part, p])) for p in (a, b))
    regs = minhash.sketch([x, y, np.unique(np.concatenate([x, y]))])
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()  # registers of a union are maxima
    assert abs((regs[0] == regs[1]).mean() - 0.8) < 0.1
    up, down = np.array([(regs[0] > regs[1]).sum()]), np.array([(regs[0] < regs[1]).sum()])
    assert minhash.plausible(up, down, np.array([len(x)]), np.array([len(y)]), 80).all()
    other = minhash.sketch([np.unique(rng.integers(1, 1 << 63, 2000, dtype=np.uint64))])
    up, down = np.array([(regs[0] > other[0]).sum()]), np.array([(regs[0] < other[0]).sum()])
    assert not minhash.plausible(up, down, np.array([len(x)]), np.array([2000]), 80).any()


def test_odd_documents(odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by[4]} == {4} and by[5][0].component_id == 4 and by[8][0].component_id == 7
    assert [by[i][0].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and all(by[i][0].kept for i in (1, 2, 3))
    assert by[None][0].component_id is None and not by[None][0].kept


def test_repeated_id_with_other_texts(make):
    base = words(9, 100)
    rows = [(1, " ".join(base)), (1, "quite another text that is here"), (2, " ".join(base[:-1] + ["end"])), (3, "quite another text that is here")]
    got = minhash.near_duplicates(make(rows)).select("doc_id", "component_id").distinct().collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1)}


def test_empty_tables(make, spark):
    assert minhash.near_duplicates(make([])).count() == 0
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(300, 301), (302, 301), (5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 300 for i in (300, 301, 302)}


def plain_vectors(rows, least):
    ok = {i: np.array(v, dtype=float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if ok[a] @ ok[b] / (np.sqrt(ok[a] @ ok[a]) * np.sqrt(ok[b] @ ok[b])) >= least]
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, closed([i for i, _ in rows], links)


@pytest.mark.parametrize("block, leaf", [(4096, 256), (16, 4)])
def test_vector_links_equal_all_pairs(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "LEAF", leaf)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    rows = []
    for i in range(400):
        v = centres[i % 40] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.3])
        rows.append((i, [float(x) for x in v * rng.choice([0.01, 1.0, 50.0])]))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, [0.0] * 24), (503, None), (504, [float("nan")] + [1.0] * 23), (505, [None] + [1.0] * 23), (506, []), (507, [1.0])]
    df = clashing(spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])))
    n, roots = plain_vectors([(i, v + [0.0] * (24 - len(v)) if v else v or None) for i, v in rows], 0.95)
    got = {r.vec_id: r for r in vectors.link_vectors(df).collect()}
    assert max(n.values()) > 3
    assert {i: r.n_links for i, r in got.items()} == n
    assert {i: r.component_id for i, r in got.items()} == roots
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vectors_without_an_id_or_repeated(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.link_vectors(df).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, False)]


def test_no_pairs_are_collected(spark):
    """A group of copies meets as one vector with a count."""
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert vectors.link_vectors(df).select("n_links", "component_id").distinct().collect() == [(2999, 0)]


def test_intervals_are_not_copied_for_their_pairs(spark, monkeypatch):
    """Every pair of intervals used to shuffle both of them, so the disk in use grew with the square of the table."""
    plans = []

    def settle(df, plain=vectors.settle):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(vectors, "settle", settle)
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng = np.random.default_rng(2)
    base, side = rng.normal(size=(2, 300, 30))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = 0.95 + np.where(np.arange(300) % 2, 1e-7, -1e-7) * rng.integers(0, 30, 300)  # closer to the edge than single precision tells
    near = cos[:, None] * base + np.sqrt(1 - cos[:, None] ** 2) * side
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate([*base, *near])]
    rows += [(600 + i, rows[7][1]) for i in range(50)]  # copies, dealt over all tasks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    n, roots = plain_vectors(rows, 0.95)
    got = {r.vec_id: r for r in vectors.link_vectors(df).collect()}
    assert {i: r.n_links for i, r in got.items()} == n and {i: r.component_id for i, r in got.items()} == roots
    joins = [p for p in plans if "raw_b" in p]
    assert joins and not any("Exchange" in p for p in joins)
