"""Line dedup by winnowing over line hashes, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.session import settle, small_side

from .common import table

RUN = 2  # lines of a run that is deleted; also what winnowing guarantees to find
PASSAGE = 50  # words from which on a line is a run by itself


def repeated_lines(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), passage: int | None = PASSAGE) -> DataFrame:
    """Delete runs of ``run`` or more lines that stand earlier in the corpus: ``doc_id, n_lines, n_removed, n_runs, text``.

    A line of ``passage`` or more words is a run by itself, also between other lines; None leaves that out.

    Earlier means a lower (id, line); null ids come last. Only lines with a character other than white space
    count, the others are never deleted and do not interrupt a run. Each window of ``run`` line hashes selects its
    minimum, so two equal windows select the same line: only windows around a fingerprint that stands at two
    or more places can match. The places of those fingerprints are extended to the windows on either side that selected them and joined
    with the first place of the same window; neighbouring matches chain to runs as far as the lines agree. Every line of a matching later window goes,
    also where a text repeats itself, judged on the input. Groups meet in sums and skewed joins that adaptive
    execution splits, never as pairs. One row per input row: a null text stays null with no lines, an empty one
    has one line; rows with equal id and text are one document and get equal results. Columns named in ``carry`` come
    along as a struct ``rest``.
    """
    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *rest)
    key = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(run), "text").alias("h2")]
    # patterns that stop at the first word, or at the last one needed; so many words take twice as many bytes less one
    full = lambda x: x.rlike(r"[^ \t\x0b\x0c\r]")
    many = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{(passage or 1) - 1}}}[^\x20\x09-\x0D]"
    long = (lambda x: [F.when(F.octet_length(x) >= 2 * passage - 1, x.rlike(many)).otherwise(False).alias("long")]) if passage else lambda x: []
    lines = F.transform(F.filter(F.split("text", "\n"), full), lambda x: F.struct(F.xxhash64(x).alias("f"), F.xxhash64(F.lit(1), x).alias("g"), *long(x)))
    held = rows.where(F.col("text").isNotNull()).select("doc_id", *key, lines.alias("lines")).where(F.size("lines") >= (1 if passage else run))

    def window(i: Column) -> Column:
        """The lines from ``i`` on: their least hash, its place, and two hashes of them all."""
        own = F.slice("lines", i + 1, run)
        least = F.array_min(F.transform(own, lambda x, k: F.struct(x["f"].alias("f"), (i + k).alias("at"))))
        return F.struct(
            i.alias("start"), F.lit(run).alias("n"), least["f"].alias("mark"), least["at"].alias("at"),
            F.aggregate(own, F.lit(0).cast("long"), lambda s, x: F.xxhash64(s, x["f"])).alias("k1"),
            F.aggregate(own, F.lit(1).cast("long"), lambda s, x: F.xxhash64(s, x["g"])).alias("k2"))

    windows = F.transform(F.sequence(F.lit(0), F.size("lines") - run), window)
    if passage:
        alone = F.filter(F.transform("lines", lambda x, i: F.struct(
            x["long"].alias("long"), F.struct(i.alias("start"), F.lit(1).alias("n"), x["f"].alias("mark"), i.alias("at"), F.xxhash64(F.lit(2), x["f"]).alias("k1"), F.xxhash64(F.lit(3), x["g"]).alias("k2")).alias("w"))), lambda x: x["long"])
        windows = F.concat(F.when(F.size("lines") >= run, windows).otherwise(F.array()), F.transform(alone, lambda x: x["w"]))
    placed = settle(held.select("doc_id", "h1", "h2", windows.alias("windows")).dropDuplicates(["doc_id", "h1", "h2"]))

    # fingerprints: the selected lines, each place once; one that stands at a single place has no match
    marks = placed.select(F.explode(F.array_distinct(F.transform("windows", lambda w: F.struct(w["mark"].alias("mark"), w["at"].alias("at"))))).alias("m"))
    known = settle(marks.groupBy("m.mark").count().where("count > 1").select(F.col("mark").alias("known")))
    spread = placed.select("doc_id", "h1", "h2", F.inline("windows"))
    near = settle(spread.join(known, F.col("mark") == F.col("known"), "left_semi").drop("mark", "at"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("h1").alias("x"), F.col("h2").alias("y"), F.col("start").alias("at"))
    first = settle(near.groupBy(F.col("k1").alias("j1"), F.col("k2").alias("j2")).agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1").drop("places"))
    later = near.join(first, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2"))).where(~place.eqNullSafe(F.col("first")))
    # the lines to go, per text that loses some; while this table is small it goes to the texts instead of the texts to it
    gone = small_side(
        later.groupBy("doc_id", "h1", "h2").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("starts"))
        .select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"),
                F.array_distinct(F.flatten(F.transform("starts", lambda w: F.sequence(w["start"], w["start"] + w["n"] - 1)))).alias("gone"))
    )
    done = rows.withColumns({"h1": key[0], "h2": key[1]}).join(
        gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    hit = F.col("gone").isNotNull()
    done = done.withColumn("all_lines", F.when(hit, F.split("text", "\n")))
    # places of the lines to go among all lines
    counted = F.filter(F.transform("all_lines", lambda x, i: F.when(full(x), i)), lambda i: i.isNotNull())
    done = done.withColumn("counted", F.when(hit, counted))
    kept = F.array_except(F.sequence(F.lit(0), F.size("all_lines") - 1), F.transform("gone", lambda j: F.get("counted", j)))
    return done.select(
        "doc_id", *["rest"] * bool(carry), F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"),
        F.when(hit, F.size("gone")).otherwise(0).cast("long").alias("n_removed"),
        F.when(hit, F.size(F.array_except("gone", F.transform("gone", lambda j: j + 1)))).otherwise(0).cast("long").alias("n_runs"),
        F.when(hit, F.array_join(F.transform(kept, lambda i: F.get("all_lines", i)), "\n")).otherwise(F.col("text")).alias("text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two lines, and single lines of ``PASSAGE`` words."""
    return repeated_lines(table(spark, sf_dir, "documents"))


def op2_line_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``op2_line_dedup``, under its earlier name."""
    return repeated_lines(table(spark, sf_dir, "documents"))


def op2_line_dedup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two lines alone."""
    return repeated_lines(table(spark, sf_dir, "documents"), passage=None)


SQL_OP2_PAIRS = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), counted AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM lines WHERE regexp_matches(line, '[^ \\t\\x0B\\x0C\\r]')
), windows AS (
  SELECT doc_id, n, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM counted
), ranked AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, n) AS place FROM windows WHERE b IS NOT NULL
), gone AS (
  SELECT doc_id, n FROM ranked WHERE place > 1 UNION SELECT doc_id, n + 1 FROM ranked WHERE place > 1
), left_over AS (
  SELECT l.doc_id, l.pos, l.line FROM lines l LEFT JOIN counted c USING (doc_id, pos) LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.n = c.n WHERE g.n IS NULL
), texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM left_over GROUP BY doc_id),
removed AS (
  SELECT g.doc_id, count(*) AS n_removed, count(*) FILTER (WHERE h.n IS NULL) AS n_runs
  FROM gone g LEFT JOIN gone h ON h.doc_id = g.doc_id AND h.n = g.n - 1 GROUP BY g.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
  coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_runs, 0) AS n_runs,
  CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN texts t USING (doc_id) LEFT JOIN removed r USING (doc_id)
"""

_PASSAGES = f"""ranked_lines AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) AS place FROM counted WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {PASSAGE}
), gone AS (
  SELECT doc_id, n FROM ranked_lines WHERE place > 1 UNION """
SQL_OP2 = SQL_OP2_PASSAGES = SQL_OP2_PAIRS.replace("gone AS (\n  ", _PASSAGES)
