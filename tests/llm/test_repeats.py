"""Line dedup and suffix-array dedup against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lapsewise.llm import lines, suffixes

from .conftest import clashing, words


def plain_lines(rows, run):
    """(removed places, text) per row, by the definition."""
    order = sorted({(i is None, i or 0, t) for i, t in rows if t is not None})
    first, full = {}, {}
    for key in order:
        full[key] = [k for k, x in enumerate(key[2].split("\n")) if x.strip(" \t\x0b\x0c\r")]
        ls = key[2].split("\n")
        for j in range(len(full[key]) - run + 1):
            first.setdefault(tuple(ls[k] for k in full[key][j:j + run]), (key, j))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, 0, 0, 0, None))
            continue
        key, ls = (i is None, i or 0, t), t.split("\n")
        gone = set()
        for j in range(len(full[key]) - run + 1):
            if first[tuple(ls[k] for k in full[key][j:j + run])] != (key, j):
                gone |= set(range(j, j + run))
        places = {full[key][j] for j in gone}
        out.append((i, len(ls), len(gone), sum(j - 1 not in gone for j in gone), "\n".join(x for k, x in enumerate(ls) if k not in places)))
    return out


def same(found, want):
    assert sorted(found, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("run", [1, 2, 3])
def test_runs_of_lines(make, run):
    rng = np.random.default_rng(run)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "d", "", " ", "e"], size=rng.integers(1, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (3, rows[3][1]), (None, "a\nb\nc\nd"), (103, "x\ny\nx\ny\nx\ny")]
    got = lines.repeated_lines(clashing(make(rows)), run=run).collect()
    same([(r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.text) for r in got], plain_lines(rows, run))


def test_single_passages(make):
    """A long line that repeats between other lines goes; a shorter one stays, and so do texts without copies."""
    long, short = " ".join(words(1, lines.PASSAGE)), " ".join(words(2, lines.PASSAGE - 1))
    clean = [(i, "\n".join(" ".join(words(10 * i + k, 60)) for k in range(3))) for i in range(20, 30)]
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd\n{short}\n\n{long}"), (3, long), (4, f"e\n{short}\nf"), (5, f"b\n{long}\na"), *clean]
    got = {r.doc_id: (r.n_removed, r.n_runs, r.text) for r in lines.repeated_lines(make(rows)).collect()}
    assert got == {1: (0, 0, rows[0][1]), 2: (2, 2, f"c\nd\n{short}\n"), 3: (1, 1, ""), 4: (0, 0, rows[3][1]), 5: (1, 1, "b\na"), **{i: (0, 0, t) for i, t in clean}}


def test_lines_are_native(make):
    plan = lines.repeated_lines(make([(1, "a\nb")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_odd_documents(odd):
    got = lines.repeated_lines(odd, carry=("kept", "lang")).collect()
    assert len(got) == odd.count() and all(r.rest.kept == "x" for r in got)
    spans = suffixes.remove_repeats(odd).collect()
    assert len(spans) == odd.count()
    by = {r.doc_id: r for r in spans}
    assert by[1].n_bytes == 0 and by[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[7].n_removed == by[7].n_bytes and by[8].n_spans == 1
    assert by[10].n_removed == by[10].n_bytes  # a text that repeats itself


def test_empty_tables(make):
    assert lines.repeated_lines(make([])).count() == 0
    assert suffixes.remove_repeats(make([])).count() == 0


def plain_spans(rows, span):
    count = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, r in raws:
        count.update(r[k:k + span] for k in range(len(r) - span + 1))
    out = []
    for i, r in raws:
        cover = np.zeros(len(r) + 1, dtype=int)
        for k in range(len(r) - span + 1):
            if count[r[k:k + span]] > 1:
                cover[k] += 1
                cover[k + span] -= 1
        gone = cover[:-1].cumsum() > 0
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((i, len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    """Texts that share passages of lengths around the span, with other bytes on either side."""
    rng = np.random.default_rng(seed)
    parts = [" ".join(words(seed * 100 + k, 300))[:n] for k, n in enumerate((395, 399, 400, 401, 405, 415, 420, 470, 610, 1300))]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.integers(1, 5)):
            p = parts[rng.integers(len(parts))]
            a = rng.integers(0, 12)
            text += [" ".join(words(int(rng.integers(1 << 30)), int(rng.integers(0, 40)))), p[a:] if rng.random() < 0.5 else p[:len(p) - a]]
        rows.append((i, "é".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_bytes(make, seed):
    rows = passages(seed) + [(100, "ab" * 700), (101, "z" * 401), (102, "y" * 400), (5, passages(seed)[5][1]), (None, "q" * 900)]
    got = suffixes.remove_repeats(make(rows)).collect()
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], plain_spans(rows, suffixes.SPAN))


def test_long_texts_in_chunks(make, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    rows = [(1, " ".join(words(3, 2000))), (2, " ".join(words(4, 300) + words(3, 2000)[400:1500])), (3, " ".join(words(5, 900)))]
    # the setting is only seen by this process, so the functions run here
    found = []
    for batch_rows in (rows,):
        for held in suffixes._segments([t for _, t in batch_rows]):
            raw, _, part, first, last, anchor, g = suffixes.anchor_ranges(held)
            begin = np.cumsum([0] + [len(p) for *_, p in held])[part]
            for p, a, b, x, b0 in zip(part, first, last, anchor, begin):
                row, at, _ = held[p]
                found += [(row, int(k - b0 + at), int(x - k)) for k in range(a, b + 1)]
    want = [(row, k) for row, (_, t) in enumerate(rows) for k in range(len(t.encode()) - suffixes.SPAN + 1)]
    assert sorted((r, k) for r, k, _ in found) == want
    # equal windows have their anchor at the same distance
    by = {}
    for r, k, d in found:
        by.setdefault(rows[r][1].encode()[k:k + suffixes.SPAN], set()).add(d)
    assert all(len(d) == 1 for d in by.values())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=30), min_size=1, max_size=12))
def test_suffix_order(spark, strings):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "piece long, s array<long>")
    ranks = {r.piece: r.ranks for r in suffixes.sort_suffixes(df).collect()}
    flat = [(ranks[i][o], s[o:o + 27]) for i, s in enumerate(strings) for o in range(len(s))]
    assert sorted(r for r, _ in flat) == list(range(1, len(flat) + 1))
    in_order = [s for _, s in sorted(flat)]
    assert in_order == sorted(in_order)
