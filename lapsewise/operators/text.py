"""Document-term counts and tf-idf with pruning, as long tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stem import row_slices, stem_terms
from ..functions.words import ENGLISH_STOPWORDS, TOKEN_PATTERN
from ..session import is_small, settle, small_side
from . import stats

# Terms that a Python worker counts together.
COUNTED_TERMS = 1 << 20
# Terms of a text that go to the stemmer as one row.
RUN_TERMS = 32


@dataclass(frozen=True)
class TermOptions:
    """Steps run in this order: lower case, punctuation, digits, stop words, stems, length."""

    lower: bool = True
    remove_punctuation: bool = True
    remove_numbers: bool = False
    stopwords: Sequence[str] = ENGLISH_STOPWORDS
    stemming: bool = True
    min_length: int = 3
    max_length: int | None = None
    normalize: bool = True
    sparse: float = 0.9
    low_idf_quantile: float | None = None
    low_df: int = 1

    def __post_init__(self):
        if not 0 < self.sparse <= 1:
            raise ValueError("sparse must be in (0, 1]")


def terms_of(text: Column, opts: TermOptions) -> Column:
    """Terms of one text as an array. Punctuation is deleted, not replaced by a space."""
    t = F.lower(text) if opts.lower else text
    if opts.remove_punctuation:
        t = F.regexp_replace(t, r"\p{Punct}+", "")
    if opts.remove_numbers:
        t = F.regexp_replace(t, "[0-9]+", "")
    terms = F.split(t, r"[ \t\n\r\f\x0B]+")
    if opts.stopwords:
        stop = list(opts.stopwords)
        terms = F.filter(terms, lambda w: ~w.isin(stop))
    if opts.stemming:
        terms = stem_terms(terms)
    return terms


def term_counts(docs: DataFrame, key: str, text: str, opts: TermOptions = TermOptions()) -> DataFrame:
    """Long document-term counts ``(key, term, tf)``; one shuffle, combined on the map side."""
    terms = terms_of(F.col(text), replace(opts, stemming=False))
    if opts.stemming:
        # A Python batch has a fixed number of rows; as runs of a text's terms these are short, whatever the texts.
        at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("_terms") / RUN_TERMS).cast("int") - 1, F.lit(0)))
        runs = F.transform(at, lambda i: F.slice("_terms", i * RUN_TERMS + 1, RUN_TERMS))
        docs = docs.select(key, terms.alias("_terms")).select(key, F.explode(runs).alias("_run"))
        terms = stem_terms("_run")
    # The outer form keeps the optimizer from running the stemmer a second time to test for empty arrays.
    long = docs.select(key, F.explode_outer(terms).alias("term"))
    size = F.length("term")
    long = long.filter(size >= max(opts.min_length, 1))
    if opts.max_length is not None:
        long = long.filter(size <= opts.max_length)
    return long.groupBy(key, "term").agg(F.count("*").alias("tf"))


def _row_of(lists: pa.ListArray) -> np.ndarray:
    """Row of each entry of a list column."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _count_rows(terms: pa.ListArray, low: int, high: int | None) -> pa.Array:
    coded = terms.flatten().dictionary_encode()
    words, length = coded.dictionary, pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
    fits = length >= low if high is None else (length >= low) & (length <= high)
    row, code, width = _row_of(terms), coded.indices.to_numpy(zero_copy_only=False), max(len(words), 1)
    on = fits[code]
    pair, tf = np.unique(row[on] * width + code[on], return_counts=True)
    offsets = np.searchsorted(pair // width, np.arange(len(terms) + 1))
    cells = pa.StructArray.from_arrays([words.take(pa.array(pair % width)), pa.array(tf, pa.int64())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells)


def document_terms(docs: DataFrame, key: str, text: str, opts: TermOptions = TermOptions()) -> DataFrame:
    """The counts of ``term_counts`` as one row per key, ``(key, terms array<struct<term, tf>>)``, computed.

    A row counts its own terms where it is. Only if a key repeats are its rows added up by a shuffle.
    """
    low, high = max(opts.min_length, 1), opts.max_length

    @F.arrow_udf("array<struct<term:string,tf:bigint>>")
    def counted(terms: pa.Array) -> pa.Array:
        sizes = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        parts = [_count_rows(terms.slice(a, b - a), low, high) for a, b in row_slices(sizes, COUNTED_TERMS)]
        return pa.concat_arrays(parts) if parts else _count_rows(terms, low, high)

    rows = settle(docs.select(key, counted.asNondeterministic()(terms_of(F.col(text), opts)).alias("terms")))
    if rows.groupBy(key).count().filter("count > 1").isEmpty():
        return rows
    merged = rows.select(key, F.inline("terms")).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    return settle(merged.groupBy(key).agg(F.collect_list(F.struct("term", "tf")).alias("terms")))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(counts: DataFrame, docs: DataFrame, sparse: float = 1.0) -> DataFrame:
    """``term, df, idf`` of terms in more than ``N * (1 - sparse)`` documents; N counts empty documents too."""
    n_docs = docs.agg(F.count("*").alias("_docs"))
    vocab = document_frequency(counts).join(F.broadcast(n_docs))
    if sparse < 1:
        vocab = vocab.filter(F.col("df") > F.col("_docs") * (1 - sparse))
    return vocab.select("term", "df", F.log2(F.col("_docs") / F.col("df")).alias("idf"))


def _matched(counts: DataFrame, vocab: DataFrame, sparse: float) -> DataFrame:
    # Kept terms number less than (mean distinct terms per document) / (1 - sparse), whatever N is; their bytes are checked.
    return counts.join(small_side(vocab) if sparse < 1 else vocab, "term")


def weighted(counts: DataFrame, vocab: DataFrame, key: str, opts: TermOptions = TermOptions(),
             weight: Callable[[Column, Column, Column, Column], Column] | None = None) -> DataFrame:
    """``(key, term, tf, df, weight)``: frequency within the kept terms of the document, times idf.

    ``weight`` may be any function of the columns (tf, kept terms of the document, df, idf).
    """
    kept = _matched(counts, vocab, opts.sparse)
    size = F.sum("tf").over(Window.partitionBy(key))
    if weight is not None:
        value = weight(F.col("tf"), size, F.col("df"), F.col("idf"))
    else:
        value = _weight(size, opts)
    return kept.select(key, "term", "tf", "df", "idf", value.alias("weight"))


def _weight(size: Column, opts: TermOptions) -> Column:
    return F.col("tf") / size * F.col("idf") if opts.normalize else F.col("tf").cast("double") * F.col("idf")


def _kept_rows(rows: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """``document_terms`` with the kept terms only, ``(key, kept array<struct<term, tf, df, idf, size>>)``; the vocabulary goes to every task."""
    table = vocab.select("term", "df", "idf").toArrow()
    words, df, idf = pa.array(table["term"].to_pylist(), pa.string()), table["df"].to_numpy(), table["idf"].to_numpy()

    @F.arrow_udf("array<struct<term:string,tf:bigint,df:bigint,idf:double,size:bigint>>")
    def kept(terms: pa.Array) -> pa.Array:
        flat, row = terms.flatten(), _row_of(terms)
        at = pc.index_in(flat.field("term"), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
        on = np.flatnonzero(at >= 0)
        at, row, tf = at[on], row[on], flat.field("tf").to_numpy(zero_copy_only=False)[on]
        ends = np.searchsorted(row, np.arange(len(terms) + 1))
        size = np.diff(np.r_[0, np.cumsum(tf)][ends])[row]
        cells = [words.take(pa.array(at)), pa.array(tf, pa.int64()), pa.array(df[at], pa.int64()), pa.array(idf[at], pa.float64()), pa.array(size, pa.int64())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cells, ["term", "tf", "df", "idf", "size"]))

    return rows.select(key, kept.asNondeterministic()("terms").alias("kept"))


def weighted_rows(rows: DataFrame, vocab: DataFrame, key: str, opts: TermOptions = TermOptions()) -> DataFrame:
    """``weighted`` over ``document_terms`` and a computed vocabulary: a document meets the kept terms where it is if they are few."""
    if opts.sparse >= 1 or not is_small(vocab):
        return weighted(rows.select(key, F.inline("terms")), vocab, key, opts)
    out = _kept_rows(rows, vocab, key).select(key, F.inline("kept"))
    return out.select(key, "term", "tf", "df", "idf", _weight(F.col("size"), opts).alias("weight"))


def pruned_vocabulary(vocab: DataFrame, opts: TermOptions) -> DataFrame:
    """Drop frequent terms (idf at or below a quantile) and rare ones (df at or below a count)."""
    if opts.low_idf_quantile is not None:
        vocab = settle(vocab)
        cut = stats.quantiles(vocab, "idf", [opts.low_idf_quantile]).first()
        if cut is not None:
            vocab = vocab.filter(F.col("idf") > cut["value"])
    if opts.low_df != 1:
        vocab = vocab.filter(F.col("df") > opts.low_df)
    return vocab


def counting(opts: TermOptions) -> TermOptions:
    """The options that ``document_terms`` depends on; those of the weights are left at their defaults."""
    return replace(opts, **{f: getattr(TermOptions(), f) for f in ("normalize", "sparse", "low_idf_quantile", "low_df")})


def _terms_and_vocabulary(docs: DataFrame, key: str, text: str, opts: TermOptions, rows: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    rows = document_terms(docs, key, text, opts) if rows is None else rows  # read for the vocabulary and for the weights
    return rows, settle(vocabulary(rows.select(key, F.inline("terms")), docs, opts.sparse))


def tfidf(docs: DataFrame, key: str, text: str, opts: TermOptions = TermOptions(), rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Long weights and the pruned vocabulary. Sparse-term removal changes weights; pruning does not. ``rows`` are the ``document_terms``
    of the same documents where they are there already."""
    rows, full = _terms_and_vocabulary(docs, key, text, opts, rows)
    weights = weighted_rows(rows, full, key, opts)
    if opts.low_idf_quantile is None and opts.low_df == 1:
        return weights, full
    kept = pruned_vocabulary(full, opts)
    left = small_side(kept.select("term")) if opts.sparse < 1 else kept.select("term")
    return weights.join(left, "term", "left_semi"), kept


def tfidf_vectors(docs: DataFrame, key: str, text: str, opts: TermOptions = TermOptions(), rows: DataFrame | None = None) -> DataFrame:
    """Add the dense vector of a document's weights, in the order of the pruned vocabulary (``sparse < 1``); documents without terms get zeros."""
    rows, full = _terms_and_vocabulary(docs.select(key, text), key, text, opts, rows)
    index = settle(indexed(pruned_vocabulary(full, opts)))
    size = index.count()
    if not (is_small(full) and is_small(index)):
        return term_vectors(docs, key, weighted_rows(rows, full, key, opts), index, size)
    names = pa.array([r["term"] for r in index.orderBy("index").collect()], pa.string())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def places(terms: pa.Array) -> pa.Array:
        at = pc.index_in(terms.flatten(), value_set=names).fill_null(-1)
        ends = np.r_[0, np.cumsum(terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), at.cast(pa.int32()))

    weight = F.transform("kept", lambda k: k["tf"] / k["size"] * k["idf"] if opts.normalize else k["tf"].cast("double") * k["idf"])
    lists = _kept_rows(rows, full, key).select(key, places.asNondeterministic()("kept.term").alias("_i"), weight.alias("_w"))
    return docs.join(lists, key, "left").withColumn("vector", _dense("_i", "_w", F.lit(size))).drop("_i", "_w")


def top_terms(weights: DataFrame, k: int) -> DataFrame:
    return weights.groupBy("term").agg(F.sum("weight").alias("total")).orderBy(F.desc("total"), "term").limit(k)


def bottom_terms(weights: DataFrame, k: int) -> DataFrame:
    return weights.groupBy("term").agg(F.sum("weight").alias("total")).orderBy("total", "term").limit(k)


def term_variance(weights: DataFrame, n_docs: int) -> DataFrame:
    """Sample variance of each term's column over all documents, absent ones as zero."""
    s, q = F.sum("weight"), F.sum(F.col("weight") * F.col("weight"))
    return weights.groupBy("term").agg(((q - s * s / n_docs) / (n_docs - 1)).alias("variance"))


def matching_terms(vocab: DataFrame, pattern: str, keep: bool) -> DataFrame:
    hit = F.col("term").rlike(pattern)
    return vocab.filter(hit if keep else ~hit)


def vocabulary_overlap(vocabularies: dict[str, DataFrame]) -> DataFrame:
    """Size of each vocabulary and of each intersection, in one grouped pass over all settings."""
    names = list(vocabularies)
    tagged = None
    for name in names:
        part = vocabularies[name].select("term", F.lit(name).alias("setting"))
        tagged = part if tagged is None else tagged.unionByName(part)
    sides = tagged.groupBy("term").agg(F.collect_set("setting").alias("s"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    spots = F.explode(F.filter(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]),
        lambda p: F.array_contains(F.col("s"), p["a"]) & F.array_contains(F.col("s"), p["b"]),
    ))
    return sides.select(spots.alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n_terms"))


def indexed(vocab: DataFrame) -> DataFrame:
    """Kept terms with their position in sorted order; needs a vocabulary bounded by ``sparse < 1``."""
    return vocab.select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("index"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _dense(index: pd.Series, weight: pd.Series, size: pd.Series) -> pd.Series:
    out = []
    for i, w, n in zip(index, weight, size):
        row = np.zeros(n)
        if i is not None:
            at = np.asarray(i, dtype=int)
            row[at[at >= 0]] = w[at >= 0]
        out.append(row)
    return pd.Series(out)


_dense = _dense.asNondeterministic()  # computed once, however often the vector is read


def term_vectors(docs: DataFrame, key: str, weights: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """One dense vector per document in the order of ``index``; documents without terms get zeros."""
    rows = weights.join(small_side(index), "term").groupBy(key).agg(
        F.collect_list("index").alias("_i"), F.collect_list("weight").alias("_w")
    )
    return docs.join(rows, key, "left").withColumn("vector", _dense("_i", "_w", F.lit(size))).drop("_i", "_w")


def token_count(text: Column) -> Column:
    """Word and sign tokens of a text."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)))


def over_limit(docs: DataFrame, text: str, event: str, limit: int = 512) -> DataFrame:
    """Counts of texts over and under a token limit by event."""
    return docs.groupBy((token_count(F.col(text)) > limit).alias("over"), F.col(event)).agg(F.count("*").alias("n"))


def options(**changes) -> TermOptions:
    return replace(TermOptions(), **changes)
