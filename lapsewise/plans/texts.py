"""Queries over the corpus: terms, tf-idf, vectors, degradation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.words import DETERMINERS, ENGLISH_STOPWORDS, NEARBY_KEYS, PRONOUNS
from ..operators import degrade, encode, sparse, stats, text
from ..session import settle, shuffle_width
from ..sources import views
from ..sources.tables import table
from .registry import query


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_PLAIN = dict(stemming=False)

TERMS_SQL = f"""raw AS (
  SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '[[:punct:]]+', '', 'g'), '[ \\t\\n\\r\\f\\v]+')) AS term
  FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM raw WHERE length(term) >= 3
           AND term NOT IN ({_quoted(ENGLISH_STOPWORDS)}) GROUP BY doc_id, term),
n AS (SELECT count(*) AS n FROM documents),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term)"""


def _vocab(sparse: float) -> str:
    return f""", vocab AS (SELECT term, df, log2(n / df) AS idf FROM dfs, n WHERE df > n * (1 - {sparse}::DOUBLE))"""


_WEIGHTS = """, weights AS (SELECT doc_id, term, tf, df, idf, tf / sum(tf) OVER (PARTITION BY doc_id) * idf AS weight
  FROM counts JOIN vocab USING (term))"""

W = "WITH " + TERMS_SQL
_S90 = W + _vocab(0.9) + _WEIGHTS
_S99 = W + _vocab(0.99) + _WEIGHTS


def _docs(spark, sf):
    return views.corpus(spark, sf).select("doc_id", "text")


def _counts(spark, sf):
    return text.term_counts(_docs(spark, sf), "doc_id", "text", text.options(**_PLAIN))


def _r(col: str, n: int = 6, name: str | None = None):
    return F.round(F.col(col), n).alias(name or col)


@query("doc_term", W + " SELECT doc_id, term, tf FROM counts")
def doc_term(spark, sf):
    return _counts(spark, sf)


@query("term_round_trip", W + " SELECT doc_id, term, tf FROM counts")
def term_round_trip(spark, sf):
    """Counts to rows of non-zero entries and back."""
    rows, columns = sparse.sparse_design(_docs(spark, sf).select("doc_id"), terms=_counts(spark, sf).select("doc_id", "term", "tf"), key="doc_id")
    return sparse.sparse_entries(rows, "doc_id", columns).select("doc_id", F.col("column").alias("term"), F.col("value").cast("long").alias("tf"))


@query("doc_term_stemmed")
def doc_term_stemmed(spark, sf):
    return text.term_counts(_docs(spark, sf), "doc_id", "text", text.options())


@query("doc_term_no_numbers", W.replace("'[[:punct:]]+'", "'[[:punct:]0-9]+'") + " SELECT doc_id, term, tf FROM counts")
def doc_term_no_numbers(spark, sf):
    return text.term_counts(_docs(spark, sf), "doc_id", "text", text.options(remove_numbers=True, **_PLAIN))


@query("doc_freq", W + " SELECT term, df FROM dfs")
def doc_freq(spark, sf):
    return text.document_frequency(_counts(spark, sf))


@query("sparse_terms", W + _vocab(0.99) + " SELECT term, df FROM vocab")
def sparse_terms(spark, sf):
    return text.vocabulary(_counts(spark, sf), _docs(spark, sf), 0.99).select("term", "df")


@query("tf_norm", _S90 + """ SELECT doc_id, term, round(tf / sum(tf) OVER (PARTITION BY doc_id), 6) AS tf_share FROM weights""")
def tf_norm(spark, sf):
    weights, _ = text.tfidf(_docs(spark, sf), "doc_id", "text", text.options(sparse=0.9, **_PLAIN))
    return weights.select("doc_id", "term", F.round(F.col("weight") / F.col("idf"), 6).alias("tf_share"))


@query("idf", W + _vocab(1.0).replace("WHERE df > n * (1 - 1.0::DOUBLE)", "") + " SELECT term, df, round(idf, 6) AS idf FROM vocab")
def idf(spark, sf):
    return text.vocabulary(_counts(spark, sf), _docs(spark, sf)).select("term", "df", _r("idf"))


@query("tfidf", _S99 + " SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf(spark, sf):
    weights, _ = text.tfidf(_docs(spark, sf), "doc_id", "text", text.options(sparse=0.99, **_PLAIN))
    return weights.select("doc_id", "term", _r("weight"))


@query("tfidf_raw_counts", W + _vocab(0.9) + """
SELECT doc_id, term, round(tf * idf, 6) AS weight FROM counts JOIN vocab USING (term)""")
def tfidf_raw_counts(spark, sf):
    weights, _ = text.tfidf(_docs(spark, sf), "doc_id", "text", text.options(normalize=False, **_PLAIN))
    return weights.select("doc_id", "term", _r("weight"))


@query("tfidf_stemmed")
def tfidf_stemmed(spark, sf):
    weights, _ = text.tfidf(_docs(spark, sf), "doc_id", "text", text.options(sparse=0.99))
    return weights.select("doc_id", "term", _r("weight"))


@query("prune_low_idf", _S99 + """
SELECT doc_id, term, round(weight, 6) AS weight FROM weights
WHERE idf > (SELECT quantile_cont(idf, 0.15) FROM vocab)""")
def prune_low_idf(spark, sf):
    weights, _ = text.tfidf(_docs(spark, sf), "doc_id", "text",
                            text.options(sparse=0.99, low_idf_quantile=0.15, **_PLAIN))
    return weights.select("doc_id", "term", _r("weight"))


@query("prune_low_df", _S99 + " SELECT doc_id, term, round(weight, 6) AS weight FROM weights WHERE df > 25")
def prune_low_df(spark, sf):
    weights, _ = text.tfidf(_docs(spark, sf), "doc_id", "text", text.options(sparse=0.99, low_df=25, **_PLAIN))
    return weights.select("doc_id", "term", _r("weight"))


@query("vocab_pattern", W + _vocab(0.99) + """
SELECT term, df FROM vocab WHERE NOT regexp_matches(term, '^[0-9]+|que|tion')""")
def vocab_pattern(spark, sf):
    vocab = text.vocabulary(_counts(spark, sf), _docs(spark, sf), 0.99)
    return text.matching_terms(vocab, "^[0-9]+|que|tion", keep=False).select("term", "df")


@query("top_terms", _S99 + """
SELECT term, round(sum(weight), 6) AS total FROM weights GROUP BY term ORDER BY sum(weight) DESC, term LIMIT 15""")
def top_terms(spark, sf):
    weights, _ = text.tfidf(_docs(spark, sf), "doc_id", "text", text.options(sparse=0.99, **_PLAIN))
    return text.top_terms(weights, 15).select("term", _r("total"))


@query("bottom_terms", _S99 + """
SELECT term, round(sum(weight), 6) AS total FROM weights GROUP BY term ORDER BY sum(weight), term LIMIT 15""")
def bottom_terms(spark, sf):
    weights, _ = text.tfidf(_docs(spark, sf), "doc_id", "text", text.options(sparse=0.99, **_PLAIN))
    return text.bottom_terms(weights, 15).select("term", _r("total"))


@query("term_variance", _S90 + """
SELECT term, round(1e6 * (sum(weight * weight) - pow(sum(weight), 2) / n) / (n - 1), 4) AS variance_ppm
FROM weights, n GROUP BY term, n""")
def term_variance(spark, sf):
    docs = _docs(spark, sf)
    weights, _ = text.tfidf(docs, "doc_id", "text", text.options(**_PLAIN))
    return text.term_variance(weights, docs.count()).select("term", F.round(1e6 * F.col("variance"), 4).alias("variance_ppm"))


_IDF_PROBS = [0.0, 0.0001, 0.001, 0.005, 0.01, 0.05, 0.06, 0.10]


@query("idf_quantiles", W + _vocab(1.0).replace("WHERE df > n * (1 - 1.0::DOUBLE)", "") + f""", q AS (
  SELECT quantile_cont(idf, {_IDF_PROBS}) AS q FROM vocab)
SELECT CAST(prob AS DOUBLE) AS prob, round(value, 6) AS value FROM (SELECT unnest({_IDF_PROBS}) AS prob, unnest(q) AS value FROM q)""")
def idf_quantiles(spark, sf):
    vocab = text.vocabulary(_counts(spark, sf), _docs(spark, sf))
    return stats.quantiles(vocab, "idf", _IDF_PROBS).select("prob", _r("value"))


@query("idf_histogram", W + _vocab(0.99) + """, span AS (SELECT min(idf) AS lo, max(idf) AS hi FROM vocab)
SELECT CAST(least(9, floor((idf - lo) / ((hi - lo) / 10))) AS INTEGER) AS bin, count(*) AS n FROM vocab, span GROUP BY bin""")
def idf_histogram(spark, sf):
    vocab = text.vocabulary(_counts(spark, sf), _docs(spark, sf), 0.99)
    return stats.histogram(vocab, "idf", 10).select("bin", "n")


@query("vocab_overlap", W + """, v AS (
  SELECT 's99' AS s, term FROM dfs, n WHERE df > n * (1 - 0.99::DOUBLE)
  UNION ALL SELECT 's90', term FROM dfs, n WHERE df > n * (1 - 0.9::DOUBLE)
  UNION ALL SELECT 'df25', term FROM dfs WHERE df > 25)
SELECT x.s AS a, y.s AS b, count(*) AS n_terms FROM v x JOIN v y USING (term)
WHERE (x.s, y.s) IN (('s99', 's99'), ('s99', 's90'), ('s99', 'df25'), ('s90', 's90'), ('s90', 'df25'), ('df25', 'df25'))
GROUP BY x.s, y.s""")
def vocab_overlap(spark, sf):
    full = settle(text.vocabulary(_counts(spark, sf), _docs(spark, sf)))
    n = _docs(spark, sf).count()
    return text.vocabulary_overlap({
        "s99": full.filter(F.col("df") > n * (1 - 0.99)), "s90": full.filter(F.col("df") > n * (1 - 0.9)),
        "df25": full.filter("df > 25"),
    })


@query("term_intersection", W + """
SELECT term FROM dfs, n WHERE df > n * (1 - 0.99::DOUBLE) INTERSECT SELECT term FROM dfs, n WHERE df > 25 AND log2(n / df) > 4""")
def term_intersection(spark, sf):
    full = settle(text.vocabulary(_counts(spark, sf), _docs(spark, sf)))
    n = _docs(spark, sf).count()
    return full.filter(F.col("df") > n * (1 - 0.99)).select("term").intersect(full.filter("df > 25 and idf > 4").select("term"))


@query("log_tf_weight", W + _vocab(0.9) + """
SELECT doc_id, term, round((1 + ln(tf)) * idf, 6) AS weight FROM counts JOIN vocab USING (term)""")
def log_tf_weight(spark, sf):
    counts = _counts(spark, sf)
    vocab = text.vocabulary(counts, _docs(spark, sf), 0.9)
    out = text.weighted(counts, vocab, "doc_id", weight=lambda tf, size, df, idf: (1 + F.log(tf)) * idf)
    return out.select("doc_id", "term", _r("weight"))


@query("term_vectors", _S90 + """, ix AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS place FROM vocab)
SELECT d.doc_id, ix.place, round(coalesce(w.weight, 0), 6) AS weight
FROM documents d CROSS JOIN ix LEFT JOIN weights w ON w.doc_id = d.doc_id AND w.term = ix.term""")
def term_vectors(spark, sf):
    df = encode.embed(_docs(spark, sf), "doc_id", "text", "tf-idf", **_PLAIN)
    return df.select("doc_id", F.posexplode("vector").alias("place", "weight")).select("doc_id", "place", _r("weight"))


# --- vectors --------------------------------------------------------------------------------

@query("subword_vec", """
WITH raw AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+')) AS word FROM documents),
 words AS (SELECT doc_id, word, count(*) AS n FROM raw WHERE word <> '' GROUP BY doc_id, word),
 marked AS (SELECT DISTINCT word, '<' || word || '>' AS m FROM words),
 grams AS (SELECT word, m[i:i + k - 1] AS g FROM marked, range(3, 7) t(k), range(1, length(m) - k + 2) u(i)
           UNION ALL SELECT word, m FROM marked),
 hashed AS (SELECT word, ('0x' || substr(md5(g), 1, 8))::BIGINT % 16 AS place,
                   CASE WHEN ('0x' || substr(md5(g), 9, 1))::BIGINT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM grams),
 vec AS (SELECT word, place, sum(s) AS v FROM hashed GROUP BY word, place),
 unit AS (SELECT word, place, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY word)), 0) AS v FROM vec),
 total AS (SELECT doc_id, sum(n) AS n FROM words GROUP BY doc_id),
 sums AS (SELECT doc_id, place, sum(n * coalesce(v, 0)) AS s FROM words JOIN unit USING (word) GROUP BY doc_id, place)
SELECT d.doc_id, CAST(p.place AS INTEGER) AS place, round(coalesce(s / n, 0), 6) + 0.0::DOUBLE AS value
FROM documents d CROSS JOIN range(0, 16) p(place) LEFT JOIN total ON total.doc_id = d.doc_id
     LEFT JOIN sums ON sums.doc_id = d.doc_id AND sums.place = p.place""")
def subword_vec(spark, sf):
    df = encode.embed(_docs(spark, sf), "doc_id", "text", "subword", dim=16)
    return df.select("doc_id", F.posexplode("vector").alias("place", "value")).select(
        "doc_id", "place", (F.round("value", 6) + 0.0).alias("value"))


@query("encoder_vec", """
WITH w AS (SELECT doc_id, string_split_regex(regexp_replace(lower(text), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g'), '[ \\t\\n\\r\\f\\v]+') AS ws FROM documents),
 e AS (SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM w),
 h AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS place,
              (2 * (('0x' || substr(md5(token), 9, 1))::BIGINT % 2) - 1) / sqrt(i) AS s FROM e WHERE token <> ''),
 v AS (SELECT doc_id, place, sum(s) AS s FROM h GROUP BY ALL)
SELECT d.doc_id, CAST(p.place AS INTEGER) AS place, round(tanh(coalesce(s, 0)), 6) + 0.0::DOUBLE AS value
FROM documents d CROSS JOIN range(0, 64) p(place) LEFT JOIN v ON v.doc_id = d.doc_id AND v.place = p.place""")
def encoder_vec(spark, sf):
    df = encode.embed(_docs(spark, sf), "doc_id", "text", "encoder", dim=64)
    return df.select("doc_id", F.posexplode("vector").alias("place", "value")).select(
        "doc_id", "place", (F.round("value", 6) + 0.0).alias("value"))


@query("vector_table_mean", W + """, m AS (SELECT count(*) AS m FROM embeddings),
 b AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % m AS vec_id, sum(tf)::BIGINT AS tf FROM counts, m GROUP BY ALL)
SELECT doc_id, round(sum(tf * CAST(embedding[1] AS DOUBLE)) / sum(tf), 6) AS v1,
       round(sum(tf * CAST(embedding[64] AS DOUBLE)) / sum(tf), 6) AS v64
FROM b JOIN embeddings USING (vec_id) GROUP BY doc_id""")
def vector_table_mean(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("term"), "embedding")
    spot = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint") % vectors.count()
    # texts are dealt by document: the counts, the counts per vector and the sums need no further shuffle
    docs = _docs(spark, sf)
    docs = docs.repartition(max(shuffle_width(spark), docs.rdd.getNumPartitions()), "doc_id")
    counts = text.term_counts(docs, "doc_id", "text", text.options(**_PLAIN)).groupBy("doc_id", spot.alias("term")).agg(F.sum("tf").alias("tf"))
    df = encode.vector_table_mean(counts, vectors, "doc_id")
    return df.select("doc_id", F.round(F.element_at("vector", 1), 6).alias("v1"),
                     F.round(F.element_at("vector", 64), 6).alias("v64"))


# --- token counts ---------------------------------------------------------------------------

_TOK = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+(?:[''’]\p{{L}}+)?|[^\s\p{{L}}\p{{N}}]')"


@query("token_count", f"SELECT doc_id, CAST(len({_TOK.format('text')}) AS INTEGER) AS n_tokens FROM documents")
def token_count(spark, sf):
    return _docs(spark, sf).select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


@query("over_limit", f"""
SELECT len({_TOK.format('text')}) > 512 AS over, CAST(coalesce(quality, 0) AS INTEGER) AS event, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def over_limit(spark, sf):
    return text.over_limit(views.text_survival(spark, sf), "text", "event")


# --- degradation ----------------------------------------------------------------------------


_TAG = rf"""CASE WHEN regexp_matches(t, '^\p{{N}}+$') THEN 'NUM' WHEN regexp_matches(t, '^[^\p{{L}}\p{{N}}]') THEN 'PUNCT'
  WHEN lower(t) IN ({_quoted(PRONOUNS)}) THEN 'PRON' WHEN lower(t) IN ({_quoted(DETERMINERS)}) THEN 'DET' ELSE 'X' END"""
_TOKENS_SQL = f"""WITH l AS (SELECT doc_id, {_TOK.format('lower(text)')} AS ts FROM documents),
 e AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM l),
 tagged AS (SELECT doc_id, i, t, {_TAG} AS pos, lower(t) IN ({_quoted(ENGLISH_STOPWORDS)}) AS is_stop FROM e)"""
_FILTERED = """, kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS txt FROM tagged WHERE {where} GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(txt, '')) AS text_md5, CAST(length(coalesce(txt, '')) AS INTEGER) AS n_chars
FROM documents d LEFT JOIN kept USING (doc_id)"""
_REMOVE = "pos NOT IN ('NUM', 'PRON', 'PROPN', 'DET')"


def _digest(df, col):
    return df.select("doc_id", F.md5(col).alias("text_md5"), F.length(col).alias("n_chars"))


@query("pos_tags", _TOKENS_SQL + " SELECT pos, is_stop, count(*) AS n FROM tagged GROUP BY ALL")
def pos_tags(spark, sf):
    return degrade.annotate(_docs(spark, sf), "doc_id", "text").groupBy("pos", "is_stop").agg(F.count("*").alias("n"))


@query("pos_filter", _TOKENS_SQL + _FILTERED.format(where=_REMOVE))
def pos_filter(spark, sf):
    docs = _docs(spark, sf).withColumn("out", degrade.filter_pos_text(F.col("text"), remove=degrade.STUDY_TAGS))
    return _digest(docs, "out")


@query("pos_keep", _TOKENS_SQL + _FILTERED.format(where="pos IN ('NUM', 'DET', 'PUNCT')"))
def pos_keep(spark, sf):
    docs = _docs(spark, sf).withColumn("out", degrade.filter_pos_text(F.col("text"), keep=("NUM", "DET", "PUNCT")))
    return _digest(docs, "out")


@query("drop_stop_words", _TOKENS_SQL + _FILTERED.format(where="NOT is_stop"))
def drop_stop_words(spark, sf):
    docs = _docs(spark, sf).withColumn("out", degrade.filter_pos_text(F.col("text"), drop_stop=True))
    return _digest(docs, "out")


@query("rebuild_text", _TOKENS_SQL + _FILTERED.format(where=_REMOVE))
def rebuild_text(spark, sf):
    docs = _docs(spark, sf).repartition("doc_id")  # the texts are dealt out once, their tokens need no further shuffle
    tokens = degrade.annotate(docs, "doc_id", "text")
    return _digest(degrade.filter_pos_tokens(docs, tokens, "doc_id", remove=degrade.STUDY_TAGS, name="out"), "out")


def _typos(spark, sf, p):
    df = degrade.degrade(_docs(spark, sf), "doc_id", "text", "out", p=p, remove=degrade.STUDY_TAGS,
                         kinds=degrade.STUDY_KINDS)
    return _digest(df, "out")


def _draw(name: str, source: str, lane: int) -> str:
    """CTEs that add a draw ``name`` in [0, 1) with the counter ``3 i + lane`` to the rows of ``source``."""
    out, last = [f"{name}_ AS (SELECT *, 3 * i + {lane} AS x FROM {source})"], f"{name}_"
    for r, (k, shift) in enumerate(zip("abca", degrade.ROUND_SHIFTS)):
        out.append(f"{name}_{r}p AS (SELECT * EXCLUDE (x), (x + k{k} + {shift}) % {degrade.PRIME} AS y FROM {last})")
        out.append(f"{name}_{r}q AS (SELECT *, y * y % {degrade.PRIME} AS y2 FROM {name}_{r}p)")
        out.append(f"{name}_{r} AS (SELECT * EXCLUDE (y, y2), y2 * y2 % {degrade.PRIME} * y % {degrade.PRIME} AS x FROM {name}_{r}q)")
        last = f"{name}_{r}"
    return ", ".join(out) + f", {name} AS (SELECT * EXCLUDE (x), x AS {name} FROM {last})"


def typos_sql(source: str, kinds=degrade.STUDY_KINDS, seed: int = 1, edge: float = 0.5) -> str:
    """CTEs from ``source(doc_id, level, txt)`` to ``typed(doc_id, level, txt)``, place by place.

    Of neighbouring swaps every second one counts, since each uses up the place after it.
    """
    prime, cum = degrade.PRIME, [repr(float(x)) for x in np.cumsum(kinds)[:3]]
    near = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in NEARBY_KEYS.items())
    raised = lambda x: f"CASE WHEN up THEN replace(upper(replace({x}, 'ß', chr(1))), chr(1), 'ß') ELSE {x} END"
    key = f"md5('{seed}|' || doc_id || '|' || CAST(round(level * 1000000) AS BIGINT))"
    part = "PARTITION BY doc_id, level ORDER BY i"
    return f"""near(low, near) AS (VALUES {near}),
 keyed AS (SELECT doc_id, level, regexp_extract_all(txt, '(?s).') AS cs, {key} AS h FROM {source}),
 placed AS (SELECT doc_id, level, len(cs) AS n, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS i,
            {", ".join(f"CAST('0x' || substr(h, {7 * j + 1}, 7) AS BIGINT) AS k{k}" for j, k in enumerate("abc"))} FROM keyed),
 {_draw("d0", "placed", 0)},
 struck AS MATERIALIZED (SELECT * FROM d0 WHERE d0 < level * CASE WHEN i = 0 OR i = n - 1 THEN {edge}::DOUBLE ELSE 1.0::DOUBLE END * {prime}),
 {_draw("d1", "struck", 1)}, {_draw("d2", "d1", 2)},
 kinds AS (SELECT doc_id, level, n, i, d2 / {prime} AS u, CASE WHEN d1 / {prime} < {cum[0]}::DOUBLE THEN 0 WHEN d1 / {prime} < {cum[1]}::DOUBLE THEN 1
           WHEN d1 / {prime} < {cum[2]}::DOUBLE THEN 2 ELSE 3 END AS kind FROM d2),
 swaps AS (SELECT *, i - row_number() OVER ({part}) AS isle FROM kinds WHERE kind = 3 AND i < n - 1),
 paired AS (SELECT doc_id, level, i, (i - min(i) OVER (PARTITION BY doc_id, level, isle)) % 2 = 0 AS eff FROM swaps),
 marked AS (SELECT p.doc_id, p.level, p.n, p.i, p.c, CASE WHEN length(lower(p.c)) = 1 THEN lower(p.c) ELSE p.c END AS low, k.kind, k.u, coalesce(s.eff, FALSE) AS eff
            FROM placed p LEFT JOIN kinds k USING (doc_id, level, i) LEFT JOIN paired s USING (doc_id, level, i)),
 around AS (SELECT m.*, c <> m.low AS up, coalesce(near, '') AS near, coalesce(lag(eff) OVER ({part}), FALSE) AS used, lag(m.low) OVER ({part}) AS before, lead(c) OVER ({part}) AS after
            FROM marked m LEFT JOIN near ON near.low = m.low),
 done AS (SELECT *, CASE WHEN used THEN before
    WHEN kind = 0 AND near <> '' THEN {raised("substr(near, CAST(floor(u * length(near)) AS BIGINT) + 1, 1)")}
    WHEN kind = 1 THEN {raised("low || substr(low || near, CAST(floor(u * (length(near) + 1)) AS BIGINT) + 1, 1)")}
    WHEN kind = 2 THEN '' WHEN kind = 3 AND i < n - 1 THEN {raised("after")} ELSE c END AS o,
    coalesce(kind = 3 AND i = n - 1 AND n > 1 AND NOT used, FALSE) AS ends FROM around),
 turned AS (SELECT doc_id, level, i, CASE WHEN ends THEN {raised(f"lag(o) OVER ({part})")} WHEN lead(ends) OVER ({part}) THEN lead(low) OVER ({part}) ELSE o END AS o FROM done),
 typed AS (SELECT doc_id, level, string_agg(o, '' ORDER BY i) AS txt FROM turned GROUP BY doc_id, level)"""


def _typos_sql(source: str, levels) -> str:
    return _TOKENS_SQL + f""", kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS txt FROM tagged WHERE {_REMOVE} GROUP BY doc_id),
 clean AS MATERIALIZED (SELECT d.doc_id, l.level, coalesce({source}, '') AS txt FROM documents d LEFT JOIN kept USING (doc_id),
   (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in levels)}]) AS level) l),
 hurt AS (SELECT * FROM clean WHERE level > 0), {typos_sql("hurt")},
 ends AS (SELECT doc_id, c.level, CASE WHEN c.level > 0 THEN coalesce(t.txt, '') ELSE c.txt END AS txt FROM clean c LEFT JOIN typed t USING (doc_id, level))
SELECT doc_id, """


_TYPO_COLUMNS = "md5(txt) AS text_md5, CAST(length(txt) AS INTEGER) AS n_chars FROM ends"


@query("typos_p0", _TOKENS_SQL + _FILTERED.format(where=_REMOVE))
def typos_p0(spark, sf):
    return _typos(spark, sf, 0.0)


@query("typos_p05", _typos_sql("kept.txt", [0.05]) + _TYPO_COLUMNS)
def typos_p05(spark, sf):
    return _typos(spark, sf, 0.05)


@query("typos_p10", _typos_sql("kept.txt", [0.1]) + _TYPO_COLUMNS)
def typos_p10(spark, sf):
    return _typos(spark, sf, 0.10)


@query("typos_cased", _typos_sql("d.text", [0.025]) + _TYPO_COLUMNS)
def typos_cased(spark, sf):
    """Typos in the texts as they stand: capitals are remembered at their place."""
    return _digest(_docs(spark, sf).withColumn("out", degrade.typos(F.coalesce("text", F.lit("")), F.col("doc_id"), 0.025, kinds=degrade.STUDY_KINDS)), "out")


@query("degrade_levels", _typos_sql("kept.txt", degrade.STUDY_LEVELS) + "level, " + _TYPO_COLUMNS)
def degrade_levels(spark, sf):
    df = degrade.degrade_levels(_docs(spark, sf), "doc_id", "text")
    return df.select("doc_id", "level", F.md5("modified_text").alias("text_md5"), F.length("modified_text").alias("n_chars"))


@query("degrade_lengths", _typos_sql("kept.txt", degrade.STUDY_LEVELS).rsplit("SELECT", 1)[0]
       + "SELECT level, count(*) AS n, round(avg(length(txt)), 6) AS mean_chars FROM ends GROUP BY level")
def degrade_lengths(spark, sf):
    df = degrade.degrade_levels(_docs(spark, sf), "doc_id", "text")
    return df.groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg(F.length("modified_text")), 6).alias("mean_chars"))


_TOK_LEN = _TOKENS_SQL + f""", kept AS (SELECT doc_id, count(*) AS n FROM tagged WHERE {_REMOVE} GROUP BY doc_id),
 lens AS (SELECT d.doc_id, len({_TOK.format('d.text')}) AS original, coalesce(n, 0) AS degraded
          FROM documents d LEFT JOIN kept USING (doc_id))"""


@query("length_change", _TOK_LEN + """
SELECT doc_id, CAST(original AS INTEGER) AS original, CAST(degraded AS INTEGER) AS degraded,
       CAST(original - degraded AS INTEGER) AS diff FROM lens""")
def length_change(spark, sf):
    original = text.token_count(F.col("text"))
    degraded = text.token_count(degrade.filter_pos_text(F.col("text"), remove=degrade.STUDY_TAGS))
    return _docs(spark, sf).select("doc_id", original.alias("original"), degraded.alias("degraded")).withColumn(
        "diff", F.col("original") - F.col("degraded"))


@query("over_limit_change", _TOK_LEN + """
SELECT count(*) FILTER (WHERE original > 512) AS over_before, count(*) FILTER (WHERE degraded > 512) AS over_after,
       count(*) FILTER (WHERE original > 512 AND degraded <= 512) AS moved_under, count(*) AS n FROM lens""")
def over_limit_change(spark, sf):
    df = length_change(spark, sf)
    return df.agg(
        F.count_if(F.col("original") > 512).alias("over_before"), F.count_if(F.col("degraded") > 512).alias("over_after"),
        F.count_if((F.col("original") > 512) & (F.col("degraded") <= 512)).alias("moved_under"), F.count("*").alias("n"))
