"""Text degradation: part-of-speech filters and seeded keyboard typos."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stem import row_slices
from ..functions.words import (
    DETERMINERS, ENGLISH_STOPWORDS, NEARBY_KEYS, NUMBER_PATTERN, PRONOUNS, SIGN_PATTERN, TOKEN_PATTERN,
)

STUDY_TAGS = ("NUM", "PRON", "PROPN", "DET")
STUDY_KINDS = (0.4, 0.3, 0.15, 0.15)
STUDY_LEVELS = (0.0, 0.025, 0.05, 0.1)


# --- part of speech -------------------------------------------------------------------------

def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def tag_of(token: Column, proper: Sequence[str] = ()) -> Column:
    """Tag of a token from closed word classes and patterns; open classes are ``X``."""
    word = F.lower(token)
    tag = (
        F.when(token.rlike(NUMBER_PATTERN), "NUM")
        .when(token.rlike(SIGN_PATTERN), "PUNCT")
        .when(word.isin(list(PRONOUNS)), "PRON")
        .when(word.isin(list(DETERMINERS)), "DET")
    )
    if proper:
        tag = tag.when(token.isin(list(proper)), "PROPN")
    return tag.otherwise("X")


def annotate(docs: DataFrame, key: str, text: str, lowercase: bool = True, proper: Sequence[str] = ()) -> DataFrame:
    """Token table ``(key, i, token, pos, is_stop)``. Lower case comes first, so it changes proper nouns."""
    source = F.lower(F.col(text)) if lowercase else F.col(text)
    return docs.select(key, F.posexplode(tokens_of(source)).alias("i", "token")).select(
        key, "i", "token", tag_of(F.col("token"), proper).alias("pos"),
        F.lower("token").isin(list(ENGLISH_STOPWORDS)).alias("is_stop"),
    )


def _kept(tag: Column, keep, remove) -> Column:
    if keep is not None and remove is not None:
        raise ValueError("give tags to keep or tags to remove, not both")
    if keep is not None:
        return tag.isin(list(keep))
    return ~tag.isin(list(remove)) if remove else F.lit(True)


def _not_tagged(word: Column, remove: Sequence[str]) -> Column:
    """Whether the tag of a lower-case token is none of ``remove``, without the tags that nobody asks for: words of the closed classes begin
    with a letter, so numbers and signs are not among them, and the patterns are tried on what the words leave."""
    words = [w for tag, some in (("PRON", PRONOUNS), ("DET", DETERMINERS)) if tag in remove for w in some if not (tag == "DET" and w in PRONOUNS)]
    out = ~word.isin(words) if words else F.lit(True)
    for tag, pattern in (("NUM", NUMBER_PATTERN), ("PUNCT", SIGN_PATTERN)):
        if tag in remove:
            out = out & ~word.rlike(pattern)
    return out


def filter_pos_text(
    text: Column, keep: Sequence[str] | None = None, remove: Sequence[str] | None = None,
    drop_stop: bool = False, lowercase: bool = True, proper: Sequence[str] = (),
) -> Column:
    """Filtered text from the built-in tags: stays inside the row, no shuffle. Emptied texts are ``""``."""
    tokens = tokens_of(F.lower(text) if lowercase else text)
    if keep is None and remove and not proper and "X" not in remove:
        tokens = F.filter(tokens, lambda t: _not_tagged(t if lowercase else F.lower(t), remove))
    else:
        tokens = F.filter(tokens, lambda t: _kept(tag_of(t, proper), keep, remove))
    if drop_stop:
        tokens = F.filter(tokens, lambda t: ~F.lower(t).isin(list(ENGLISH_STOPWORDS)))
    return F.array_join(tokens, " ")


def filter_pos_tokens(
    docs: DataFrame, tokens: DataFrame, key: str, keep: Sequence[str] | None = None,
    remove: Sequence[str] | None = None, drop_stop: bool = False, name: str = "text",
) -> DataFrame:
    """The same from a token table of an outside tagger; documents that lose all tokens return as ``""``."""
    kept = tokens.filter(_kept(F.col("pos"), keep, remove))
    if drop_stop:
        kept = kept.filter(~F.col("is_stop"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "token")))
    rebuilt = kept.groupBy(key).agg(F.array_join(ordered["token"], " ").alias(name))
    return docs.select(key).join(rebuilt, key, "left").withColumn(name, F.coalesce(name, F.lit("")))


# --- typos ----------------------------------------------------------------------------------

def _check_kinds(kinds: Sequence[float]) -> None:
    if len(kinds) != 4 or abs(sum(kinds) - 1) > 1e-9:
        raise ValueError("four kind probabilities that sum to 1 are needed: replace, add, remove, swap")


PRIME = (1 << 31) - 1
ROUND_SHIFTS = (0, 715_827_883, 1_431_655_766, 68_719_477)
DRAW_CHARS = 1 << 17  # characters whose draws are made together


def counter_draws(counter: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Uniform whole numbers below ``PRIME`` that depend on a counter and three keys alone.

    Each round adds a key and takes the fifth power modulo the prime, which permutes the residues. All steps stay below 2 ** 62, so
    SQL can repeat them.
    """
    x = counter % PRIME
    for k, shift in zip((a, b, c, a), ROUND_SHIFTS):
        x = (x + k + shift) % PRIME
        square = x * x % PRIME
        x = square * square % PRIME * x % PRIME
    return x


def _lowered(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


@cache
def _key(own: str) -> tuple[str, bool, str]:
    """A character in lower case, whether that is another one, and its neighbours on the keyboard."""
    c = _lowered(own)
    return c, c != own, NEARBY_KEYS.get(c, "")


def _raised(s: str) -> str:
    return "".join([u if len(u := c.upper()) == 1 else c for c in s])


def _apply_hits(text: str, hits: list[int], kind_of: list[int], pick: list[float]) -> str:
    """Typos at the given places; a swap uses up the place after it."""
    n, chars, taken = len(text), list(text), -1
    for i, kind, u in zip(hits, kind_of, pick):
        if i == taken:
            continue
        c, upper, near = _key(chars[i])
        if kind == 0:
            c = near[int(u * len(near))] if near else c
        elif kind == 1:
            choice = c + near
            c = c + choice[int(u * len(choice))]
        elif kind == 2:
            c = ""
        elif i == n - 1:
            if n > 1:
                chars[i - 1], c = c, chars[i - 1]
        else:
            chars[i + 1], c = c, chars[i + 1]
            taken = i + 1
        chars[i] = _raised(c) if upper else c
    return "".join(chars)


def mistype_all(texts: Sequence[str], keys: np.ndarray, rates: np.ndarray, edge: float, kinds: Sequence[float]) -> list[str]:
    """Typos in many texts; the draws of all their characters are made together, places without a hit are not visited.

    ``keys`` has three whole numbers per text. Place ``i`` draws with the counters ``3 i`` (hit or not), ``3 i + 1`` (kind) and ``3 i + 2`` (choice).
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    ends = size.cumsum()
    starts, found = ends - size, []
    for lo in range(0, int(size.sum()), DRAW_CHARS):  # also inside a long text
        hi = min(lo + DRAW_CHARS, int(ends[-1]))
        a, b = np.searchsorted(ends, [lo, hi - 1], side="right") + [0, 1]
        row = np.repeat(np.arange(a, b), np.minimum(ends[a:b], hi) - np.maximum(starts[a:b], lo))
        place = np.arange(lo, hi) - starts[row]
        limit = rates[row] * np.where((place == 0) | (place == size[row] - 1), edge, 1.0)
        hit = np.flatnonzero(counter_draws(3 * place, *keys[row].T) < limit * PRIME)
        found.append((row[hit], place[hit]))
    row, place = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(2))
    kind = np.searchsorted(np.cumsum(kinds)[:3], counter_draws(3 * place + 1, *keys[row].T) / PRIME, side="right").tolist()
    pick = (counter_draws(3 * place + 2, *keys[row].T) / PRIME).tolist()
    ends = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    place = place.tolist()
    return [t if a == b else _apply_hits(t, place[a:b], kind[a:b], pick[a:b]) for t, a, b in zip(texts, ends, ends[1:])]


def mistype(text: str, key: Sequence[int], p: float, edge: float, kinds: Sequence[float]) -> str:
    """Typos in one text."""
    return mistype_all([text], np.array([key], dtype=np.int64), np.array([p]), edge, kinds)[0]


def typos(
    text: Column, key: Column, p: Column | float, seed: int = 1, edge: float = 0.5,
    kinds: Sequence[float] = (0.25, 0.25, 0.25, 0.25),
) -> Column:
    """Keyboard typos at rate ``p`` per character, half on the first and last one.

    Draws depend on (seed, key, p, place) alone, so the result does not change with the partitioning. The three numbers of a text are
    the first 7-digit groups of the hex md5 of ``seed|key|p in millionths``. Null texts stay null; a null key counts as an empty one.
    """
    _check_kinds(kinds)
    kinds = tuple(float(k) for k in kinds)

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, rates: pa.Array) -> pa.Array:
        sizes = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        keys = np.stack([k.fill_null(0).to_numpy(zero_copy_only=False) for k in (a, b, c)], axis=1)
        rates = rates.fill_null(0.0).to_numpy(zero_copy_only=False)
        parts = []
        for start, end in row_slices(sizes, DRAW_CHARS):  # a batch is long: only the texts of a slice become Python strings
            out = np.array([*texts.slice(start, end - start).to_pylist(), None], dtype=object)[:-1]
            live = np.flatnonzero((sizes[start:end] > 0) & (rates[start:end] > 0))
            if len(live):
                out[live] = mistype_all(out[live].tolist(), keys[start + live], rates[start + live], edge, kinds)
            parts.append(pa.array(out, pa.string()))
        return pa.concat_arrays(parts) if parts else texts

    rate = (p if isinstance(p, Column) else F.lit(float(p))).cast("double")
    hexed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.round(rate * 1_000_000).cast("long").cast("string")))
    keys = [F.conv(F.substring(hexed, 7 * k + 1, 7), 16, 10).cast("long") for k in range(3)]
    return run.asNondeterministic()(text, *keys, rate)


def degrade(
    df: DataFrame, key: str, text: str, name: str = "modified_text", p: float = 0.01,
    keep: Sequence[str] | None = None, remove: Sequence[str] | None = None, drop_stop: bool = False,
    lowercase: bool = True, proper: Sequence[str] = (), seed: int = 1, edge: float = 0.5,
    kinds: Sequence[float] = (0.25, 0.25, 0.25, 0.25),
) -> DataFrame:
    """Part-of-speech filter, then typos."""
    filtered = filter_pos_text(F.col(text), keep, remove, drop_stop, lowercase, proper)
    return df.withColumn(name, typos(filtered, F.col(key), p, seed, edge, kinds))


def degrade_levels(
    df: DataFrame, key: str, text: str, levels: Sequence[float] = STUDY_LEVELS,
    remove: Sequence[str] = STUDY_TAGS, kinds: Sequence[float] = STUDY_KINDS, seed: int = 1,
) -> DataFrame:
    """Every document at every typo level in one pass: ``(key, level, modified_text)``."""
    filtered = df.select(key, filter_pos_text(F.col(text), remove=remove).alias("_t"))
    rows = filtered.select(key, "_t", F.explode(F.array(*[F.lit(float(p)) for p in levels])).alias("level"))
    return rows.select(
        key, "level", typos(F.col("_t"), F.col(key), F.col("level"), seed, 0.5, kinds).alias("modified_text")
    )
