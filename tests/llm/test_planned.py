"""Fill-in-middle, packing and clustering against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsewise.llm import clusters, infill, packing

from .conftest import clashing, words


# --- fill-in-middle -------------------------------------------------------------------------

def plain_infill(i, text, seed=7, rate=100, spm=50, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text, re.S)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def infill_rows():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a", "\n", "é\n", "🙂 x", "<", "P>", "\r", " ", "\x00"]) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "\n"), (1003, "has <M> inside"), (None, "no id\nat all\n"), (1004, "x" * 1000), (1005, "\n" * 500), (5, "again\nthe same id")]
    return rows


@pytest.mark.parametrize("unit,frame,rate", [("line", 7, 100), ("line", 1 << 16, 60), ("char", 11, 100)])
def test_fill_in_middle(make, unit, frame, rate):
    rows = infill_rows()
    made = infill.fill_in_middle(clashing(make(rows)), rate=rate, unit=unit, frame=frame)
    got = made.collect()
    want = [(i, *plain_infill(i, t, rate=rate, unit="." if unit == "char" else r"[^\n]*\n|[^\n]+"), t or "") for i, t in rows]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got], key=key) == \
        sorted([(i, n, f, p, m, sha(o), sha(t)) for i, n, f, p, m, o, t in want], key=key)
    assert sorted((r.doc_id or 0, r.text) for r in infill.output_texts(made).collect()) == sorted((i or 0, o) for i, *_, o, _ in want)
    assert sorted((r.doc_id or 0, r.text) for r in infill.output_texts(made, restore=True).collect()) == sorted((i or 0, t or "") for i, t in rows)


def test_only_cut_frames_are_opened(monkeypatch):
    text = infill.Frames.of("".join(f"line {i}\n" for i in range(5000)), size=100)
    opened = []
    real = infill.Frames.text
    monkeypatch.setattr(infill.Frames, "text", lambda self, k: opened.append(k) or real(self, k))
    out, a, b = infill.transform(text, "psm", 1000, 4000)
    assert len(opened) <= 8 < len(text.data)
    assert "".join(infill.restored(out, "psm")) == "".join(f"line {i}\n" for i in range(5000))
    assert out.chars[-1] == text.chars[-1] + 9 and (a, b) == (len("".join(f"line {i}\n" for i in range(1000))), len("".join(f"line {i}\n" for i in range(4000))))


def test_odd_infill(odd, make):
    got = infill.fill_in_middle(odd).collect()
    assert len(got) == odd.count() and {r.form for r in got if r.doc_id in (1, 2)} == {"plain"}
    assert infill.fill_in_middle(make([])).count() == 0
    with pytest.raises(ValueError):
        infill.frame_texts(odd, unit="word")


# --- packing --------------------------------------------------------------------------------

def plain_best_fit(lengths, capacity):
    """Rooms left after best fit, longest first, one piece after the other."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 16, 50])
    lengths = [min(capacity, int(rng.paretovariate(rng.choice([0.5, 1, 2])))) for _ in range(rng.randrange(400))]
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    runs, n = packing.plan(counts, capacity)
    used = defaultdict(list)
    for length, rank, k, first, layers, offset in runs:
        for j in range(k):
            used[first + j // layers].append((offset + j % layers * length, length))
    ranks = defaultdict(list)
    for length, rank, k, *_ in runs:
        ranks[length] += range(rank, rank + k)
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(c)) for x, c in counts.items()}
    for s in used.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(used) == set(range(n)) and sorted(capacity - sum(x for _, x in s) for s in used.values()) == plain_best_fit(lengths, capacity)


def test_plan_of_billions():
    runs, n = packing.plan({2048: 10**12, 1500: 10**11, 500: 3 * 10**11, 3: 10**12}, 2048)
    assert len(runs) < 20 and sum(r[2] for r in runs) == 10**12 + 4 * 10**11 + 10**12
    with pytest.raises(ValueError):
        packing.plan({2049: 1})
    assert packing.plan({}) == ([], 0)


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.MODEL).encode(text or "", add_special_tokens=False).ids + [0]


def check_packed(rows, got, capacity):
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.ids_crc32, r.start].append(r)
    want = []
    for i, t in rows:
        ids = plain_ids(t)
        want += [(i, s // capacity, s, len(ids[s:s + capacity]), zlib.crc32(np.array(ids[s:s + capacity], dtype="<u4").tobytes())) for s in range(0, len(ids), capacity)]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for s in held.values():
        s.sort()
        assert [o for o, _ in s] == [sum(x for _, x in s[:k]) for k in range(len(s))] and sum(x for _, x in s) <= capacity
    assert len(held) == len(plain_best_fit([w[3] for w in want], capacity))


def test_packing(make, odd):
    rng = random.Random(4)
    rows = [(i, " ".join(words(i, int(rng.paretovariate(0.8))))) for i in range(400)] + [(900, "İΑΣ 's ﬁ\x1c\xa0é <|endoftext|>'ll " * 3), (901, "x" * 5000), (901, None), (None, "")]
    rows += [(2000 + i, "a copy of one text") for i in range(300)]
    pieces = packing.token_pieces(clashing(make(rows)), capacity=64)
    packed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")), 64)
    check_packed(rows, packed.collect(), 64)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert all(len(r.ids) == 4 * r.length and [d.offset for d in r.documents] == sorted(d.offset for d in r.documents) for r in whole.values())
    assert packing.pack(packing.token_pieces(make([]))).count() == 0
    got = packing.pack(packing.token_pieces(odd).withColumn("ids_crc32", F.crc32("ids"))).collect()
    check_packed([(r.doc_id, r.text) for r in odd.collect()], got, 2048)


def test_words_are_apart_only_if_the_tokenizer_says_so():
    with open(packing.MODEL, encoding="utf-8") as f:
        assert packing.splits_at_space(f.read())
    with open(packing.MODEL.replace("word_bpe_49k", "byte_bpe_50k"), encoding="utf-8") as f:
        assert not packing.splits_at_space(f.read())


# --- clustering -----------------------------------------------------------------------------

def plain_clusters(rows, k, rounds, seed):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        centroids = [[sum(col) // len(col) for col in zip(*[v for (_, v), o in zip(kept, own) if o == j])] if j in own else c for j, c in enumerate(centroids)]
    return sorted([(i is not None, i, near(v)[1], near(v)[0]) for i, v in kept], key=str), centroids


def vector_rows(big=1.0):
    rng = np.random.default_rng(6)
    heart = rng.normal(size=(5, 8))
    rows = [(i, (heart[i % 5] + rng.normal(size=8) * 0.2).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(2000, [0.0] * 8), (2001, [-big] * 8), (None, [0.5] * 8), (7, [1.0] * 8)]
    return rows


@pytest.mark.parametrize("block,big", [(16, 1.0), (256, 100_000.0), (1, 3.0)])
def test_clusters(spark, block, big):
    rows = vector_rows(big)
    left_out = [(3000, None), (3001, [1.0] * 7), (3002, [float("nan")] * 8), (3003, [None] + [1.0] * 7), (3004, [float("inf")] + [0.0] * 7), (3005, [200_000.0] * 8), (3006, [])]
    df = clashing(spark.createDataFrame(rows + left_out, "vec_id long, embedding array<float>").repartition(3))
    got, centroids = clusters.cluster(df, k=6, rounds=4, width=8, block=block)
    want, plain = plain_clusters(rows, 6, 4, 3)
    assert centroids == plain
    assert sorted([(r.vec_id is not None, r.vec_id, r.cluster, r.distance) for r in got.collect()], key=str) == want


def test_few_vectors(spark):
    few, centroids = clusters.cluster(spark.createDataFrame([(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [3.0, 1.0])], "vec_id int, embedding array<double>"), width=2)
    assert len(centroids) == 3 and sorted((r.vec_id, r.cluster, r.distance) for r in few.collect())[0][2] == 0
    none, centroids = clusters.cluster(spark.createDataFrame([], "vec_id int, embedding array<double>"))
    assert none.count() == 0 and centroids == []
    with pytest.raises(TypeError):
        clusters.cluster(spark.createDataFrame([(1, ["a"])], "vec_id int, embedding array<string>"))


def test_curve_visits_neighbours():
    bits = 3
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(clusters.hilbert_keys(cells, bits))]
    assert len(set(clusters.hilbert_keys(cells, bits).tolist())) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_boxes_leave_blocks_closed(spark):
    rng = np.random.default_rng(8)
    heart = rng.normal(size=(8, 64)) * 3
    rows = [(i, (heart[i % 8] + rng.normal(size=64) * 0.01).tolist()) for i in range(2000)]
    scaled = clusters.scaled_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    blocks = clusters.curve_blocks(scaled, 64, 32)
    _, opened, of = clusters.step(blocks, np.floor(heart * 1024).astype(int).tolist())
    assert opened < of / 4
