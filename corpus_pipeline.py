"""A training-data pipeline over ``documents``, built from the operators in ``lapsewise.llm``.

Rows keep the columns of ``documents`` up to the last stage. Null texts count as empty, rows without an id pass the
stages that compare documents, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm import common, lines, minhash, mixing, pieces, quality
from lapsewise.plans import ship
from lapsewise.session import settle


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand earlier in the corpus go; documents of which no word is left go with them."""
    ship(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = lines.repeated_lines(docs, carry=rest)
    emptied = (F.col("n_removed") > 0) & (common.word_count(F.col("text")) == 0)
    kept = done.where(~emptied).select("doc_id", "text", "rest.*")
    if "n_chars" in rest:
        kept = kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    ship(spark)
    name = "_" + max(docs.columns, key=len)  # a name that no column has
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 in turn, one row per copy of a document that the mix takes."""
    ship(spark)
    return mixing.mixed_documents(docs, lambda i: (5, 2, 1)[i % 3])


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: ``doc_id, n_tokens, ids``."""
    ship(spark)
    encoded = pieces.encode_texts(docs, pieces.Vocabulary.load(pieces.MODEL))
    return encoded.select("doc_id", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: The classifier, the sketches and the tokenizer have no SQL form; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is stored before the next stage reads it, often more than once."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else settle(docs)
    return docs
