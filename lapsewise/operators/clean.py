"""Cleaning verbs for listing-style tables: casts, sentinels, recodes, censoring, joins, sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS_PER_MONTH = 30.4375


# --- projection and casts -------------------------------------------------------------------

def to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast to double; text that is not a number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def to_dates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("date") for c in cols})


def rename_roles(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def scale_units(df: DataFrame, divisors: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(float(d)) for c, d in divisors.items()})


def months_between(start: str, stop: str) -> Column:
    """Length of a date interval in months of 30.4375 days."""
    return F.datediff(F.col(stop), F.col(start)) / F.lit(DAYS_PER_MONTH)


def days_between(start: str, stop: str) -> Column:
    return F.datediff(F.col(stop), F.col(start))


# --- missing values and recodes ------------------------------------------------------------

def fill_sentinel(df: DataFrame, cols: Sequence[str], sentinel: str = "No Info", also: str | None = None) -> DataFrame:
    """Null becomes ``sentinel``; so does the value ``also`` when given."""
    def filled(c: str) -> Column:
        missing = F.col(c).isNull() if also is None else F.col(c).isNull() | (F.col(c) == also)
        return F.when(missing, F.lit(sentinel)).otherwise(F.col(c))

    return df.withColumns({c: filled(c) for c in cols})


def drop_null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(cols))


def collapse_levels(df: DataFrame, cols: Sequence[str], keep: Sequence[str], other: str = "Yes") -> DataFrame:
    """Keep the listed levels, call every other one ``other``."""
    return df.withColumns(
        {c: F.when(F.col(c).isin(list(keep)), F.col(c)).otherwise(F.lit(other)) for c in cols}
    )


def recode(df: DataFrame, col: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Give each listed set of values its new name; other values stay."""
    value = F.col(col)
    for name, members in reversed(list(groups.items())):
        value = F.when(F.col(col).isin(list(members)), F.lit(name)).otherwise(value)
    return df.withColumn(col, value)


def recode_exact(df: DataFrame, cols: Sequence[str], mapping: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(mapping), subset=list(cols))


# --- row filters ----------------------------------------------------------------------------

def ratio_filter(df: DataFrame, num: str, den: str, name: str = "price_ratio", below: float = 20.0) -> DataFrame:
    """Add ``num/den`` and keep rows below the limit; null ratios (also from a zero) are dropped."""
    return df.withColumn(name, F.try_divide(F.col(num), F.col(den))).filter(F.col(name) < below)


def ratio_outliers(df: DataFrame, num: str, den: str, at_least: float = 20.0, order: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.try_divide(F.col(num), F.col(den)) >= at_least).orderBy(*(order or [den]))


def positive_intervals(df: DataFrame, start: str, stop: str) -> DataFrame:
    return df.filter(F.col(start) < F.col(stop))


def drop_year_span(df: DataFrame, start: str, stop: str, start_until: int, stop_from: int) -> DataFrame:
    """Drop rows that start by one year and stop from another; a null date drops the row, as ``NOT NULL`` does."""
    return df.filter(~((F.year(start) <= start_until) & (F.year(stop) >= stop_from)))


def censor_at(df: DataFrame, time: str, event: str, horizon: float, flag: str = "to_modify") -> DataFrame:
    """Rows beyond the horizon stop there without an event; ``time == horizon`` is left alone."""
    late = F.col(time) > horizon
    return df.select(
        *[c for c in df.columns if c not in (time, event, flag)],
        F.when(late, 1).otherwise(0).alias(flag),
        F.when(late, 0).otherwise(F.col(event)).cast("int").alias(event),
        F.when(late, F.lit(float(horizon))).otherwise(F.col(time)).alias(time),
    )


def exclude_keys(df: DataFrame, key: str, keys: Sequence | DataFrame) -> DataFrame:
    """Drop rows by key: a short literal list, or a table of keys of any size."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key).distinct(), key, "left_anti")
    return df.filter(~F.col(key).isin(list(keys)))


# --- duplicates -----------------------------------------------------------------------------

def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of groups with more than one member, with the group size ``n``.

    Long keys (whole texts) are not shuffled for every row: only rows whose key hash occurs twice go on to the
    exact comparison. Sizes are counted with map-side combine and joined back, so a group that holds
    a large share of all rows is never one window task; null keys match null keys.
    """
    h = F.xxhash64(*keys)
    twice = df.select(h.alias("_h")).groupBy("_h").agg(F.count("*").alias("n")).filter("n > 1")
    columns = df.columns
    df = df.withColumn("_h", h).join(twice.select("_h"), "_h", "left_semi").select(*columns)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n")
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(sizes, match, "inner").select(*df.columns, "n")


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one with the least ``order``; hot keys shrink in the map-side combine."""
    rest = [c for c in df.columns if c not in keys and c != order]
    first = F.min(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_first")
    return df.groupBy(*keys).agg(first).select(
        *[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns]
    )


# --- joins ----------------------------------------------------------------------------------

def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on all common columns, where null matches null."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("no common columns")
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in common else F.col(c) for c in right.columns])
    match = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in common]
    return left.join(r, match, "left").drop(*[f"_r_{c}" for c in common])


def keyed_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left")


def bind_columns(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Put the columns of several tables side by side by key; every table must hold the same keys."""
    return reduce(lambda a, b: a.join(b, key, "inner"), tables)


def reattach_missing(docs: DataFrame, part: DataFrame, key: str, col: str, default: str = "") -> DataFrame:
    """All keys of ``docs``; those that ``part`` lost come back with the default."""
    return docs.select(key).join(part.select(key, col), key, "left").withColumn(
        col, F.coalesce(F.col(col), F.lit(default))
    )


# --- sets -----------------------------------------------------------------------------------

def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of exactly one side: one grouped pass over both, instead of two anti joins."""
    cols = a.columns
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(2)))
    return both.groupBy(*cols).agg(F.min("_side").alias("_lo"), F.max("_side").alias("_hi")).filter(
        "_lo = _hi"
    ).select(*cols)


def level_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Levels of each factor in sorted order with their rank; rank 0 is the reference level.

    Levels of all factors are made distinct in one pass; a factor has few levels by its nature,
    and the rank counts the levels below within its factor.
    """
    from pyspark.sql import Window

    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols])
    )
    levels = df.select(pairs.alias("p")).select("p.*").filter("level is not null").distinct()
    rank = F.row_number().over(Window.partitionBy("variable").orderBy("level")) - 1
    return levels.withColumn("rank", rank.cast("int"))
