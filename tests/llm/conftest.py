import pytest
from pyspark.sql import types as T

TEXT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make(spark):
    """A table of documents from (id, text[, lang, source, n_chars]) rows."""
    def of(rows):
        full = [(*r, *("en", "a", len(r[1] or ""))[len(r) - 2:]) if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, TEXT)

    return of


def words(seed, n, pool=4000):
    import random

    rng = random.Random(seed)
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


CLASH = ("kept", "component_id", "size", "shard", "score", "key", "rest", "row", "_k", "spans", "g", "h1", "n", "id", "rule", "source_size")


def clashing(df):
    """The table with columns named like those the operators make."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


@pytest.fixture
def odd(make):
    """Nulls in every column, empty and blank texts, repeated rows, a text with odd characters, a long one."""
    long_text = " ".join(words(1, 30_000))
    return clashing(make([
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (5, "one two three"), (None, "no id here at all, only words"),
        (6, "Ünïcode ▁ 日本語   🙂\x00 #*$%&|<>", None, None, None), (7, long_text), (8, long_text, None, "b", None), (9, "a\nb\na\nb\n\na\nb"),
        (10, "same words again " * 200)]))
