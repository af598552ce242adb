"""Quality classifier, quality rules, URL filters and tokens."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsewise.llm import pieces, quality, rules, urls

from .conftest import words


def labelled(n):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = words(i, rng.randrange(5, 80))
        rows.append((i, " ".join(w if good else [x + "###" for x in w])))
        if i % 2 == 0:
            labels.append((i, int(good)))
    return rows, labels


def test_quality_on_held_out_rows(make, spark):
    rows, labels = labelled(1500)
    got = {r.doc_id: r for r in quality.quality_scores(make(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.97
    kept = {r.doc_id for r in quality.keep_good(make(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


def test_scores_ignore_held_out_labels(make, spark):
    rows, labels = labelled(300)
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    scores = lambda x: sorted(quality.quality_scores(make(rows), spark.createDataFrame(x, "doc_id long, quality int")).select("doc_id", "score").collect())
    assert scores(labels) == scores(other)


def test_linear_time_form():
    """The sum-of-squares identity gives the sum over pairs."""
    m = quality.Machine(30)
    m.v *= 30
    rng = np.random.default_rng(1)
    at, x = np.arange(30), rng.normal(size=30)
    z, _ = m.logits(np.zeros(30, dtype=int), at, x, 1)
    pairs = sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in range(30) for j in range(i + 1, 30))
    assert z[0] == pytest.approx(pairs)


def test_odd_quality(odd, spark):
    got = quality.quality_scores(odd, spark.createDataFrame([(4, 1), (9, 0), (None, 1), (7, None)], "doc_id long, quality int")).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    kept = quality.keep_good(odd, spark.createDataFrame([(4, 1)], "doc_id long, quality int"))
    assert kept.columns == odd.columns
    assert quality.quality_scores(odd.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def plain_repeats(w):
    win = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    n = Counter(win)
    return len({k + j for k, x in enumerate(win) if n[x] > 1 for j in range(5)})


def test_repeated_words():
    rng = random.Random(1)
    for n in (0, 3, 5, 6, 9, 40, 300):
        for pool in (1, 2, 4, 50):
            w = [str(rng.randrange(pool)).encode() for _ in range(n)]
            assert rules.repeated_words(w) == plain_repeats(w)
    many = [b"%d" % k for k in range(5000)] + [b"1", b"2", b"3", b"4", b"5"]
    assert rules.repeated_words(many) == 10


def test_statistics():
    got = rules.statistics("Ab é#\x1c x\n\n \nab\nab\n%")
    assert got[:5] == (6, 11, 2, 1, 0)
    assert rules.statistics(None)[:5] == rules.statistics("")[:5] == (0, 0, 0, 0, 0)


def test_robust_outliers(make):
    """A third of junk does not hide itself; clean texts stay; a lone text of a source is not rejected."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        w = words(i, rng.randrange(12, 200))
        rows.append((i, " ".join(w if i % 3 else [x + "&&&" for x in w]), "en", "a" if i % 2 else None, 0))
    rows.append((1000, "a text alone in its source, a bit longer than ten words as one can see", "fr", "z", 0))
    got = {r.doc_id: r for r in rules.apply_rules(make(rows)).collect()}
    assert {i for i, r in got.items() if not r.kept} == {i for i in range(400) if i % 3 == 0}
    assert not any(r.base_failed for r in got.values())


def test_odd_rules(odd):
    got = rules.apply_rules(odd).collect()
    assert len(got) == odd.count()
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (1, 2, 3, 4, 10))
    assert rules.apply_rules(odd.limit(0)).count() == 0


def test_chi_squared():
    assert rules.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert rules.chi2_quantile(0.99, 5) == pytest.approx(15.086272, abs=1e-5)


URLS = [
    ("http://Blog.Example.ORG/es/1", "blog.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12?x#y", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://myexample.org/es/2", "myexample.org", "/es/2", "org/", "allow"),
    ("ftp://a.com/fr/?q", "a.com", "/fr/", "com/fr/", "allow"),
    ("ftp://a.com/de/x://b.org/", "a.com", "/de/x://b.org/", "com/de/", "block"),
    ("http://a.org?x/y", "a.org", "", None, None), ("http://a.com#/fr/", "a.com", "", None, None),
    ("no scheme.org/", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None), ("://ÄB.net/Ä?", "Äb.net", "/Ä", None, None)]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, rule string, host string")
    got = {r.page_id: r for r in urls.judge_urls(df, urls.RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_url_models_learn(spark):
    """Hosts of one kind are learnt from rule-decided URLs and carried over to undecided ones."""
    rng = random.Random(2)
    name = lambda good: "".join(rng.choice("abcde" if good else "vwxyz") for _ in range(12))
    rows = [(i, f"http://{name(i % 2)}.{('org' if i % 2 else 'com') if i < 600 else 'net'}/{'x' if i % 2 else 'de'}/") for i in range(800)]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), (("allow", "org", "/"), ("block", "com", "/de/"))).collect()
    right = [(r.verdict == "allow") == (r.page_id % 2 == 1) for r in got if r.rule is None]
    assert len(right) == 200 and np.mean(right) > 0.95


def plain_url_scores(rows):
    """Score per URL by the definition, with one counter per context and continuation."""
    count = {"org": Counter(), "com": Counter()}
    grams = lambda u: [("\0" * urls.ORDER + u)[i + urls.ORDER - k:i + urls.ORDER + 1] for i in range(len(u)) for k in range(urls.ORDER + 1)]
    for u in rows:
        kind = u.split("/")[2].split(".")[-1]
        if kind in count:
            count[kind].update(("gram", g) for g in grams(u))
            count[kind].update(("context", g[:-1]) for g in grams(u))
    out = []
    for u in rows:
        total = 0.0
        for sign, seen in ((1, count["org"]), (-1, count["com"])):
            p = 1.0
            for i, g in enumerate(grams(u)):
                p = 1 / 256 if i % (urls.ORDER + 1) == 0 else p
                p = (seen["gram", g] + urls.PRIOR * p) / (seen["context", g[:-1]] + urls.PRIOR)
                total += sign * math.log(p) if i % (urls.ORDER + 1) == urls.ORDER else 0
        out.append(total / max(len(u), 1))
    return out


def test_url_scores_are_exact(spark, monkeypatch):
    """No two contexts share a counter, with some 30,000 of them, and few or many grams sent to every task."""
    rng = random.Random(5)
    rows = [f"http://{''.join(rng.choices('abcdefghijklmnopqrstuvwxyz0123456789', k=40))}.{('org', 'com', 'net')[i % 3]}/de/" for i in range(900)]
    rows += rows[:20] + ["http://a.org/de/"]
    want = plain_url_scores(rows)
    for hot in (4, 4096):
        monkeypatch.setattr(urls, "HOT", hot)
        got = urls.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), (("allow", "org", "/"), ("block", "com", "/de/"))).collect()
        assert len(got) == len(rows) and [r.score for r in sorted(got)] == pytest.approx(want, abs=1e-8)


def test_url_scores_do_not_depend_on_company():
    rng = np.random.default_rng(1)
    model = urls.UrlModels(*rng.integers(0, 9, (2, (1 << urls.NGRAM_BITS) + (1 << urls.CONTEXT_BITS))))
    some = [b"http://a.b/c", b"", b"x" * 5000, b"http://a.b/c"]
    assert np.allclose(model.scores(some), [model.scores([u])[0] for u in some]) and model.scores([b""])[0] == 0


def test_urls_without_one_kind(spark):
    got = urls.judge_urls(spark.createDataFrame([(1, "http://a.org/"), (2, "http://b.net/")], "page_id long, url string"), urls.RULES).collect()
    assert {r.verdict for r in got} == {"allow"}
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), urls.RULES).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(pieces.MODEL)


def test_tokens_equal_the_library(make, spark, vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(1)
    texts = ["", "  a  b   ", "\n\n x\t▁y ▁▁ z", "<s> </s> <0x0A>", "日本語 🙂 é", "    code", " " * 40 + "x"]
    texts += ["".join(rng.choice("abthe ▁ \n.ßé日") for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += [" ".join(rng.choice(["the", "hello", "worlds", "internationalisation", "xyzzy", "123456", "foo_bar"]) + rng.choice(["", "s", ".", "\n"]) for _ in range(40)) for _ in range(60)]
    encoded = pieces.encode_texts(make([*enumerate(texts), (9999, None)]), vocabulary, check=True)
    got = {r.doc_id: r for r in encoded.collect()}
    assert all(got[i].ids == model.encode(t) for i, t in enumerate(texts)) and got[9999].ids == []
    assert all(r.round_trip for r in got.values())
    back = {r.doc_id: r.text for r in pieces.decode_texts(encoded, vocabulary).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(texts))


def test_unigram_scores(vocabulary):
    """For a unigram vocabulary the forward pass finds the best sum of scores."""
    rng = random.Random(5)
    known = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(14)} | {"a", "b"})
    scores = {p: -rng.random() * len(p) - 1 for p in known}
    v = pieces.Vocabulary({p: i for i, p in enumerate(known)}, scores, list(range(1000, 1256)), "unigram")

    def best(word):
        if not word:
            return 0.0
        return max(scores[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in scores)

    words_ = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(60)}
    for w, packed in pieces.Forward(v).encode(words_).items():
        ids = np.frombuffer(packed, dtype=np.int32)
        assert "".join(known[i] for i in ids) == w and sum(scores[known[i]] for i in ids) == pytest.approx(best(w))


def test_odd_tokens(odd, vocabulary):
    got = pieces.encode_texts(odd, vocabulary, check=True).collect()
    assert len(got) == odd.count() and all(r.round_trip for r in got)
    assert pieces.decode(vocabulary, [10**6, 1]) == ""
    assert pieces.encode_texts(odd.limit(0), vocabulary).count() == 0
    assert pieces.decode_texts(odd.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), vocabulary).where("text IS NOT NULL").count() == 0
