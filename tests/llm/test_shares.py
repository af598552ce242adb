"""Sharding, mixing and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lapsewise.llm import common, lines, mixing, pieces, sharding

from .conftest import words
from .test_near_duplicates import plain_components
from .test_repeats import plain_lines


def check_shards(rows, got, shards, slack):
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 1 for _, t, *_ in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    share = sum(load.values()) / shards
    assert max(abs(load[s] - share) for s in range(shards)) <= slack * share, load


def test_near_equal_shards(make):
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(rng.pareto(1.5) * 50 + 1) + str(i)) for i in range(3000)]
    rows += [(5000 + i, "a copy of a text " * 20) for i in range(40)]
    got = sharding.shard_by_size(make(rows)).collect()
    check_shards(rows, got, 8, 0.05)
    assert all(r.text_crc32 == zlib.crc32(dict(rows)[r.doc_id].encode()) for r in got)
    assert len({r.shard for r in got if r.doc_id >= 5000}) == 1
    assert sorted(got) == sorted(sharding.shard_by_size(make(rows[::-1])).collect())


def test_a_group_above_a_shard_is_divided(make):
    rows = [(i, "hot text " * 10) for i in range(3000)] + [(10_000 + i, f"other {i} " * 8) for i in range(1500)]
    check_shards(rows, sharding.shard_by_size(make(rows)).collect(), 8, 0.05)


def test_odd_shards(odd, make):
    got = sharding.shard_by_size(odd).collect()
    assert len(got) == odd.count() and {r.size for r in got if r.doc_id in (1, 2)} == {1}
    assert sharding.shard_by_size(make([])).count() == 0


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2.0) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([10, 0, 1000], [5, 2, 1], 1.5, 2.0) == pytest.approx([20, 0, 1495])
    assert mixing.targets([], [], 1.5, 2.0) == []


def test_split_tree():
    quotas = [100, 0, 37, 1, 500]
    got = mixing.split_quotas(quotas, 7, 3)
    assert got.sum(axis=0).tolist() == quotas
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 1
    assert (got == mixing.split_quotas(quotas, 7, 3)).all()


def sources():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        s = ["b", "a", None, "ü", "z", ""][int(rng.choice(6, p=[0.4, 0.2, 0.1, 0.1, 0.15, 0.05]))]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 60))), "en", s, 0))
    return rows


def test_mix_meets_targets(make):
    rows = sources()
    got = mixing.mix(make(rows), lambda i: (5, 2, 1)[i % 3]).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert len(r.shards) <= 2 and r.size == len(rows[r.doc_id][1].split())
        size[r.source] += r.size
        taken[r.source] += r.size * len(r.shards)
        target[r.source] = r.target
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2.0)
    for s, t in zip(names, want):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 30
    assert sorted(got) == sorted(mixing.mix(make(rows), lambda i: (5, 2, 1)[i % 3]).collect())
    # every shard has copies in number and composition close to its share
    by = defaultdict(Counter)
    for r in got:
        for s in r.shards:
            by[s][r.source] += 1
    assert set(by) == set(range(8)) and max(sum(c.values()) for c in by.values()) < 1.5 * min(sum(c.values()) for c in by.values())


def test_mixed_rows(make):
    rows = sources()
    docs = make(rows)
    plan = mixing.mix(docs, lambda i: (5, 2, 1)[i % 3])
    copies = mixing.mixed_rows(plan).collect()
    assert len(copies) == sum(len(r.shards) for r in plan.collect())
    for s in range(8):
        slots = sorted(r.slot for r in copies if r.shard == s)
        assert slots == list(range(len(slots)))
    full = mixing.mixed_documents(docs, lambda i: (5, 2, 1)[i % 3])
    assert full.columns == docs.columns
    assert Counter(r.doc_id for r in full.collect()) == Counter(r.doc_id for r in copies)


def test_odd_mix(odd, make):
    got = mixing.mix(odd, lambda i: 1).collect()
    assert len(got) == odd.count()
    assert mixing.mix(make([]), lambda i: 1).count() == 0
    assert mixing.mixed_documents(make([]), lambda i: 1).count() == 0


def test_number_rows(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    got = common.number_rows(df, "g", F.xxhash64("id"), "slot").collect()
    for g in range(3):
        assert sorted(r.slot for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small folder with documents and labels: clean ones, junk, copies, near copies, shared lines."""
    rows = []
    for i in range(160):
        ls = [" ".join(words(1000 * i + k, 30)) for k in range(4)]
        if i % 8 == 1:
            ls = [" ".join(x + "###" for x in ln.split()) for ln in ls]
        if i % 8 == 2:
            ls = rows[-2][1].split("\n")  # a copy of a clean one
        if i % 8 == 3:
            ls = [" ".join(ln.split()[:-1] + [f"y{i}"]) for ln in rows[-3][1].split("\n")]
        if i % 8 == 4:
            ls = ls[:1] + ["the same first line", "and the same second line"] + ls[1:]
        rows.append((i, "\n".join(ls), "en", f"s{i % 3}", 0))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), (None, " ".join(words(77, 50)), "en", "s2", 5)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 1), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_pipeline_against_plain_versions(spark, corpus):
    folder, _ = corpus
    docs = common.table(spark, folder, "documents")
    columns = docs.columns
    good = corpus_pipeline.quality_stage(spark, docs, folder)
    before = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == columns and {i for i in range(160) if i % 8 != 1} <= set(before) and not {i for i in range(160) if i % 8 == 1} & set(before)
    cleaned = corpus_pipeline.line_stage(spark, good, folder)
    want = {i: t for i, _, n, _, t in plain_lines(list(before.items()), lines.RUN) if not (n and not (t or "").split())}
    after = {r.doc_id: r.text for r in cleaned.collect()}
    assert cleaned.columns == columns and after == want
    assert all(r.n_chars == len(r.text or "") for r in cleaned.collect())
    single = corpus_pipeline.near_duplicate_stage(spark, cleaned, folder)
    roots, _ = plain_components([(i, t) for i, t in after.items() if i is not None], 5, 80)
    assert single.columns == columns
    assert {r.doc_id for r in single.collect()} == {i for i in after if i is None or roots[i] == i}
    mixed = corpus_pipeline.mixing_stage(spark, single, folder)
    assert mixed.columns == columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    tokens = corpus_pipeline.encoding_stage(spark, mixed, folder)
    vocabulary = pieces.Vocabulary.load(pieces.MODEL)
    texts = {r.doc_id: r.text for r in mixed.collect()}
    got = tokens.collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in mixed.collect())
    assert all(pieces.decode(vocabulary, r.ids) == (texts[r.doc_id] or "") and r.n_tokens == len(r.ids) for r in got)
    # run() applies the same stages
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()) == Counter((r.doc_id, tuple(r.ids)) for r in got)


def test_pipeline_on_an_empty_table(spark, corpus, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
