"""Suffix-array dedup of long repeated byte strings by a distributed difference-cover sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapsewise.session import settle, shuffle_width, small_side

from .common import table, tidy

SPAN = 400               # bytes of a string that counts as repeated
GRAM = 128               # bytes of an anchor; a window of SPAN bytes holds SPAN - GRAM + 1 of them
BLOCK = 16               # window starts that share one core
CHUNK = 1 << 18          # bytes that are hashed together
PLACE = 20               # bits of a place in what is hashed together
STRIDE = 2 * BLOCK       # symbols of a contracted piece, with a zero behind it
DEPTH = 3                # rounds of triples: 3 ** DEPTH symbols are told apart, more than the BLOCK of a window

_TABLES = np.random.default_rng(20).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2^64."""
    if which not in _powers or len(_powers[which][0]) < n:
        base, size = _BASES[which], max(n, 2 * CHUNK + 4 * SPAN)
        up, down = np.full(size, base, dtype=np.uint64), np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[which] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[which][0][:n], _powers[which][1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def prefix_hash(raw: np.ndarray, which: int) -> np.ndarray:
    """Running sums of byte values times powers; differences give the hash of any substring."""
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_TABLES[which][raw] * _power(which, len(raw))[0], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
    return _mix((prefix[stop] - prefix[start]) * _power(which, len(prefix))[1][start])


def _least_of_windows(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each window of w values, from running minima of blocks in both directions."""
    n = len(x)
    full = np.concatenate([x, np.full(-n % w, x[-1], dtype=x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def _segments(texts: list[str | None]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Lists of (row, offset, bytes) to be looked at together; a long text comes in parts whose windows do not overlap."""
    held, size = [], 0
    for row, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        for at in range(0, len(raw) - SPAN + 1, CHUNK):
            part = raw[at:at + CHUNK + SPAN - 1]
            held.append((row, at, part))
            size += len(part)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchor_ranges(held: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Ranges of window starts with one anchor: joined bytes, running hash, part number, first, last, anchor, anchor hash.

    The anchor of a SPAN-byte window is the first of its grams with the least hash, so equal windows have equal
    anchors at equal distance, and the windows of an anchor follow each other. Places are in the joined bytes; windows across two
    parts are left out.
    """
    raw = np.concatenate([p for *_, p in held])
    prefix = prefix_hash(raw, 0)
    w, low = SPAN - GRAM + 1, np.uint64((1 << PLACE) - 1)
    n = len(raw) - GRAM + 1
    grams = _mix((prefix[GRAM:] - prefix[:n]) * _power(0, n)[1])
    # the upper bits of the hash and the place; the least is the first place of the least hash
    least = _least_of_windows((grams & ~low) | np.arange(n, dtype=np.uint64), w) & low
    ends = np.cumsum([len(p) for *_, p in held])
    fresh = least[1:] != least[:-1]
    fresh[ends[:-1] - 1] = True
    for e in ends[:-1]:  # the last windows of a part reach into the next one
        fresh[e - SPAN:e - SPAN + 1] = True
    first = np.flatnonzero(np.concatenate([[True], fresh]))
    last = np.concatenate([first[1:] - 1, [len(least) - 1]])
    part = np.searchsorted(ends, first, side="right")
    whole = first + SPAN <= ends[part]
    first, last, part = first[whole], last[whole], part[whole]
    anchor = least[first].astype(np.int64)
    return raw, prefix, part, first, last, anchor, grams[anchor]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for held in _segments(batch.column("text").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(anchor_ranges(held)[-1].view(np.int64))], names=["g"])


# A range in few longs, as many of them are dealt out: the document, (first start, hi, lo) packed, and two hashes.
_RANGE = "u long, h long, packed long, g long, c long"
_FIRST, _HI, _LO = "shiftright(packed, 20)", "cast(shiftright(packed, 10) & 1023 as int)", "cast(packed & 1023 as int)"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: document, first start, greatest and least distance to the anchor, anchor hash, hash of all its windows' bytes.

    The two hashes have different bases and byte values, so together they name a range by 128 bits.
    """
    for batch in batches:
        u, h = (batch.column(c).to_numpy() for c in ("u", "h"))
        for held in _segments(batch.column("text").to_pylist()):
            raw, _, part, first, last, anchor, g = anchor_ranges(held)
            row, base = np.array([r for r, *_ in held])[part], np.array([a for _, a, _ in held])[part]
            begin = np.concatenate([[0], np.cumsum([len(p) for *_, p in held])[:-1]])[part]
            c = substring_hash(prefix_hash(raw, 1), first, last + SPAN, 1)
            packed = ((first - begin + base) << 20) | ((anchor - first) << 10) | (anchor - last)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u[row]), pa.array(h[row]), pa.array(packed), pa.array(g.view(np.int64)), pa.array(c.view(np.int64))], names=["u", "h", "packed", "g", "c"])


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the windows of wanted ranges of a text."""
    for batch in batches:
        for i in range(batch.num_rows):
            raw = batch.column("text")[i].as_py().encode()
            for w in batch.column("wanted")[i].as_py():
                f = w["first"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["piece"]]), pa.array([w["g"]]), pa.array([w["hi"]], pa.int32()), pa.array([w["lo"]], pa.int32()),
                     pa.array([raw[f:f + w["hi"] - w["lo"] + SPAN]], pa.binary())], names=["fragment", "g", "hi", "lo", "raw"])


def _gathered(run, size: int = 2000):
    """Join the single rows of ``run`` to batches."""
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in run(batches):
            held.append(b)
            if len(held) == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut fragments where the distance to the anchor is a multiple of BLOCK.

    All windows of a block hold its core. A window is then some bytes, the core, and some bytes, BLOCK symbols with the
    core as one. Rows: fragment, distance of the first start, number of starts, core (its name), bytes before and after.
    """
    for batch in batches:
        out = {k: [] for k in ("fragment", "from", "starts", "core", "left", "right")}
        for fragment, g, hi, lo, raw in zip(*(batch.column(c).to_pylist() for c in ("fragment", "g", "hi", "lo", "raw"))):
            for k in range(lo // BLOCK, hi // BLOCK + 1):
                top, least = min(hi, BLOCK * k + BLOCK - 1), max(lo, BLOCK * k)
                start, core, end = hi - top, hi - BLOCK * k, hi - BLOCK * k - BLOCK + 1 + SPAN
                name = int.from_bytes(hashlib.blake2b(raw[core:end], digest_size=8, key=b"%d %d" % (g, k)).digest(), "big") >> 2
                out["fragment"].append(fragment)
                out["from"].append(top)
                out["starts"].append(top - least + 1)
                out["core"].append(name)
                out["left"].append(raw[start:core])
                out["right"].append(raw[end:hi - least + SPAN])
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["fragment"], pa.int64()), pa.array(out["from"], pa.int32()), pa.array(out["starts"], pa.int32()), pa.array(out["core"], pa.int64()),
             pa.array(out["left"], pa.binary()), pa.array(out["right"], pa.binary())], names=list(out))


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes plus 1, and the name of the core above them."""
    for batch in batches:
        rows = [[b + 1 for b in x] + [c + 257] + [b + 1 for b in y] for x, c, y in zip(*(batch.column(k).to_pylist() for k in ("left", "core", "right")))]
        kept = ("piece", "fragment", "from", "starts", "n")
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(rows, pa.list_(pa.int64()))], names=[*kept, "s"])


# --- difference-cover sort of many short strings -------------------------------------------------------------------

def _at(c: str | Column, i: Column) -> Column:
    """An array's entry, 0 behind its end."""
    return F.coalesce(F.get(c, i.cast("int")), F.lit(0).cast("long"))


def _placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sort by range partitions and number the rows through, from 0, as ``place``; ``_part`` is the range of a row.

    A row's number in its partition comes from the sort itself, the totals of the partitions before it from a table of
    one row per partition.
    """
    ranked = settle(df.repartitionByRange(shuffle_width(df.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()))
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    before, run = [], 0
    for r in sorted(ranked.groupBy(part.alias("p")).count().collect()):
        before.append((r.p, run))
        run += r["count"]
    starts = df.sparkSession.createDataFrame(before, "_part long, _start long")
    return ranked.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("place", row + F.col("_start")).drop("_m", "_start")


def _counted(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Sort and count for each row the rows before it with and without ``flag``: ``flagged``, ``others``."""
    ranked = _placed(df.withColumn("_salt", F.xxhash64("piece", "o")), [*keys, "_salt"]).select("piece", "o", flag, "_part", "place")
    inside = Window.partitionBy("_part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    own = ranked.withColumn("_in", F.coalesce(F.sum(F.col(flag).cast("long")).over(inside), F.lit(0)))
    before, run = [], 0
    for r in sorted(ranked.groupBy("_part").agg(F.sum(F.col(flag).cast("long")).alias("n")).collect()):
        before.append((r._part, run))
        run += r.n
    starts = df.sparkSession.createDataFrame(before, "_part long, _start long")
    return own.join(F.broadcast(starts), "_part").withColumn("flagged", F.col("_in") + F.col("_start")).withColumn("others", F.col("place") - F.col("flagged")).drop("_in", "_start", "_part")


def sort_suffixes(strings: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The suffixes of many short strings numbered from 1 in the order of their first ``3 ** depth`` symbols at least: ``piece, ranks``.

    ``strings`` is as for ``rank_suffixes``. Suffixes that are equal so far follow each other by piece and place, so the numbers
    are a permutation.
    """
    ranked = rank_suffixes(strings, depth).select("piece", F.posexplode("ranks").alias("o", "rank"))
    numbered = _placed(ranked, ["rank", "piece", "o"])
    return numbered.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("o", (F.col("place") + 1).alias("n")))).alias("m")).select(
        "piece", F.transform("m", lambda x: x["n"]).alias("ranks"))


def rank_suffixes(strings: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Order the suffixes of many short strings by their first ``3 ** depth`` symbols at least.

    ``strings`` has ``piece`` (long) and ``s`` (array of positive longs). Returns ``piece, ranks``, a number for each place of the
    string: a suffix that is less within these symbols has a lower one, suffixes that are equal so far may have equal ones in any
    order, with none of another string between them. Places 1 and 2 of every three are the sample. Their triples are sorted and named by their
    order; the names make a string of two thirds the length, whose suffixes are ordered by recursion. Sampled ranks
    then order the rest: place 0 of three by (symbol, rank behind it), and against the sample by counting. With
    place 1 it compares by (symbol, rank behind), with place 2 by (two symbols, rank behind those), so one sort of both kinds
    and running counts tell how many of each stand before. Every sort is a range partitioned one.
    """
    places = F.sequence(F.lit(0), F.size("s") - 1)
    triples = strings.select("piece", F.inline(F.filter(  # made twice, which is cheaper than stored
        F.transform(places, lambda o: F.struct(o.alias("o"), *[_at("s", o + k).alias(f"t{k}") for k in range(3)])), lambda x: (x["o"] % 3 != 0) & (x["t0"] > 0))))
    keys = ["t0", "t1", "t2"]
    names = _placed(triples.select(*keys).distinct(), keys).select(*keys, (F.col("place") + 1).alias("name"))
    named = triples.join(names, keys).select("piece", "o", "name")
    if depth > 1:
        # names of the places 1, a zero, names of the places 2
        width = F.floor((F.size("s") + 1) / 3).cast("int")
        sized = strings.select("piece", width.alias("w"))
        later = F.when(F.col("o") % 3 == 1, F.floor(F.col("o") / 3)).otherwise(F.col("w") + 1 + F.floor(F.col("o") / 3)).cast("int")
        joined = named.join(sized, "piece").withColumn("q", later)
        lists = joined.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("q", "o", "name"))).alias("m"))
        # fill the places between by zeros
        lists = settle(lists.withColumn("top", F.array_max(F.transform("m", lambda x: x["q"])))
                       .withColumn("by", F.map_from_entries(F.transform("m", lambda x: F.struct(x["q"], x["name"]))))
                       .withColumn("s", F.transform(F.sequence(F.lit(0), F.col("top")), lambda q: F.coalesce(F.try_element_at("by", q), F.lit(0).cast("long"))))
                       .select("piece", "s", F.transform("m", lambda x: F.struct(x["q"], x["o"])).alias("of")))
        below = rank_suffixes(lists.select("piece", "s"), depth - 1)
        sampled = below.join(lists.select("piece", "of"), "piece").select("piece", F.inline(F.transform("of", lambda x: F.struct(
            x["o"].alias("o"), F.element_at("ranks", x["q"] + 1).alias("r")))))
    else:
        sampled = named.select("piece", "o", F.col("name").alias("r"))
    # total order of the sample; equal ones stay together
    sampled = settle(_placed(sampled.withColumn("_salt", F.xxhash64("piece", "o")), ["r", "_salt"]).select("piece", "o", (F.col("place") + 1).alias("r")))
    ranks = sampled.groupBy("piece").agg(F.map_from_entries(F.collect_list(F.struct("o", "r"))).alias("r"))
    behind = lambda i: F.coalesce(F.try_element_at("r", i), F.lit(0).cast("long"))
    joined = settle(strings.join(ranks, "piece", "left").select("piece", "s", "r"))
    rows = joined.select("piece", F.inline(F.filter(F.transform(places, lambda o: F.struct(
        o.alias("o"), _at("s", o).alias("s0"), _at("s", o + 1).alias("s1"), behind(o + 1).alias("r1"), behind(o + 2).alias("r2"), (o % 3 == 0).alias("rest"))),
        lambda x: x["s0"] > 0)))
    tidy(strings.sparkSession)
    ones = _counted(rows.where("o % 3 <> 2").select("piece", "o", "rest", "s0", "r1"), ["s0", "r1"], "rest")
    twos = _counted(rows.where("o % 3 <> 1").select("piece", "o", "rest", "s0", "s1", "r2"), ["s0", "s1", "r2"], "rest")
    shares = (
        # rest: rest and places 1 before it, places 2 before it; sample: sample before it, rest before it
        ones.select("piece", "o", F.when(F.col("rest"), F.col("flagged") + F.col("others")).otherwise(F.col("flagged")).alias("n"))
        .unionByName(twos.select("piece", "o", F.when(F.col("rest"), F.col("others")).otherwise(F.col("flagged")).alias("n")))
        .unionByName(sampled.select("piece", "o", (F.col("r") - 1).alias("n")))
    )
    solved = shares.groupBy("piece", "o").agg((F.sum("n") + 1).alias("rank"))
    lists = solved.groupBy("piece").agg(F.map_from_entries(F.collect_list(F.struct("o", "rank"))).alias("by"))
    return settle(strings.join(lists, "piece").select("piece", F.transform(places, lambda o: F.coalesce(F.try_element_at("by", o), F.lit(0).cast("long"))).alias("ranks")))


def _equal_neighbours(starts: DataFrame) -> DataFrame:
    """Rows of (rank, w1, w2, ...) whose window hash equals that of a neighbour in the order of ranks."""
    bits = 16
    placed = _placed(starts, ["rank", "piece", "o"]).drop("_part")
    # slices of the order; the first row of a slice is also shown to the slice before it, the last to the one behind it
    slice_ = F.shiftright("place", bits)
    low = F.col("place").bitwiseAND((1 << bits) - 1)
    shown = placed.withColumn("slice", F.explode(F.array_compact(F.array(
        slice_, F.when((low == 0) & (slice_ > 0), slice_ - 1), F.when(low == (1 << bits) - 1, slice_ + 1)))))
    order = Window.partitionBy("slice").orderBy("place")
    same = lambda f: F.coalesce((f("w1").over(order) == F.col("w1")) & (f("w2").over(order) == F.col("w2")), F.lit(False))
    marked = shown.withColumn("hit", same(F.lag) | same(F.lead))
    return marked.where(F.col("hit") & (F.col("slice") == slice_))


def _spans(df: DataFrame, start: Column, size: Column) -> DataFrame:
    """Spans per document, each as start << 20 | size; a size is below 2 ** 11."""
    packed = F.shiftleft(start.cast("long"), PLACE) + size.cast("long")
    return df.groupBy("u", "h").agg(F.collect_set(packed).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join overlapping spans of each text and hash what they leave."""
    for batch in batches:
        out: list[tuple] = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw = (text or "").encode()
            merged: list[list[int]] = []
            for s in sorted(spans or []):
                a, b = s >> PLACE, (s >> PLACE) + (s & ((1 << PLACE) - 1))
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            digest, at = hashlib.sha256(), 0
            for a, b in merged:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            out.append((len(raw), sum(b - a for a, b in merged), len(merged), digest.hexdigest(), [{"start": a, "stop": b} for a, b in merged]))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()),
             pa.array(cols[4], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes covered by a 400-byte string that also starts elsewhere: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``.

    Texts are UTF-8 bytes, a null one is empty; one row per input row, and a repeated row is a place elsewhere. ``spans`` are the maximal removed
    runs (start, stop). Before the suffix sort, what needs no sorting is settled. Windows are tied to the least of
    their 128-byte grams; a window whose anchor stands nowhere else is unique. Ranges of windows with equal
    bytes throughout are one range with a count, and repeated. The distinct ranges of an anchor are cut into pieces of
    up to 16 starts; equal pieces are one piece with a count, and repeated; the bytes that all windows of a piece share, its
    core, become one symbol, and pieces whose core
    no other piece has are unique. What is left, the edges of repeated passages, is a set of strings of at most 31 symbols in
    which a 400-byte window is 16 symbols. Their suffixes are ordered by the difference-cover sort and neighbouring prefixes
    compared. Names are 128-bit hashes of the bytes (62-bit for a core).
    """
    h = F.xxhash64(F.lit(SPAN), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), h).alias("u"), h.alias("h"), F.col(text_col).alias("text"))
    long_ones = rows.where(F.octet_length("text") >= SPAN)
    known = settle(long_ones.select("text").mapInArrow(_anchors, "g long").groupBy("g").count().where("count > 1").select(F.col("g").alias("known")))
    found = long_ones.select("u", "h", "text").mapInArrow(_ranges, _RANGE)
    ranges = settle(found.join(known, F.col("g") == F.col("known"), "left_semi"))
    del known, found
    tidy(docs.sparkSession)

    same = ["g", "span", "c"]
    ranges = ranges.withColumn("span", F.expr("packed & 1048575"))
    kinds = settle(ranges.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("u", "h", "packed")).alias("at")).select(
        "g", "span", "c", "n", "at.*", F.monotonically_increasing_id().alias("piece")))
    copied = ranges.join(kinds.where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in same]), [F.col(c) == F.col(f"_{c}") for c in same], "left_semi")
    # a span is one long; a document's spans stay together from here on
    spans = [settle(_spans(copied, F.expr(_FIRST), F.expr(f"{_HI} - {_LO} + {SPAN}")))]
    del ranges, copied
    tidy(docs.sparkSession)
    # anchors with several kinds of ranges: their texts, cut into pieces
    several = settle(kinds.groupBy(F.col("g").alias("_g")).count().where("count > 1").select("_g"))
    mixed = settle(kinds.join(several, F.col("g") == F.col("_g"), "left_semi").select(
        "piece", "g", "n", "u", "h", F.expr(f"{_FIRST} as first"), F.expr(f"{_HI} as hi"), F.expr(f"{_LO} as lo")))
    wanted = mixed.groupBy(F.col("u").alias("_u"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("piece", "g", "hi", "lo", "first")).alias("wanted"))
    held = long_ones.join(small_side(wanted), (F.col("u") == F.col("_u")) & (F.col("h") == F.col("_h"))).select("text", "wanted")
    fragments = held.mapInArrow(_gathered(_fragments), "fragment long, g long, hi int, lo int, raw binary")
    pieces = settle(fragments.mapInArrow(_pieces, "fragment long, from int, starts int, core long, left binary, right binary"))
    alike = ["core", "left", "right"]
    sorts = settle(pieces.groupBy(*alike).agg(F.count("*").alias("n"), F.min(F.struct("fragment", "from", "starts")).alias("at")))
    single = F.col("fragment") == F.col("_f")
    source = settle(mixed.where("n = 1").select(F.col("piece").alias("_f"), "u", "h", "first", "hi"))
    start = F.col("first") + F.col("hi") - F.col("from")
    twins = pieces.join(sorts.where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in alike]), [F.col(c) == F.col(f"_{c}") for c in alike], "left_semi").join(source, single)
    spans.append(settle(_spans(twins, start, F.col("starts") - 1 + SPAN)))

    shared = settle(sorts.groupBy(F.col("core").alias("_core")).count().where("count > 1").select("_core"))
    live = settle(sorts.join(shared, F.col("core") == F.col("_core"), "left_semi").select(
        F.monotonically_increasing_id().alias("piece"), "at.fragment", "at.from", "at.starts", "n", "core", "left", "right")
        .mapInArrow(_symbols, "piece long, fragment long, from int, starts int, n long, s array<long>"))
    del held, fragments, twins, pieces, sorts, wanted, kinds, several
    tidy(docs.sparkSession)
    ranks = rank_suffixes(live.select("piece", "s"))
    window = lambda o: F.slice("s", o + 1, BLOCK)
    starts = live.join(ranks, "piece").select("piece", "fragment", "from", "n", F.inline(F.transform(F.sequence(F.lit(0), F.col("starts") - 1), lambda o: F.struct(
        o.alias("o"), F.element_at("ranks", o + 1).alias("rank"), F.xxhash64(window(o)).alias("w1"), F.xxhash64(F.lit(1), window(o)).alias("w2")))))
    hits = _equal_neighbours(starts).where("n = 1").join(source, single)
    spans.append(settle(_spans(hits, start + F.col("o"), F.lit(SPAN))))
    del live, ranks, starts, hits, source
    tidy(docs.sparkSession)
    every = spans[0].unionByName(spans[1]).unionByName(spans[2])
    # while this table is small it goes to the texts instead of the texts to it
    gone = small_side(every.groupBy(F.col("u").alias("_u"), F.col("h").alias("_h")).agg(F.flatten(F.collect_list("spans")).alias("spans")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(gone, (F.col("u") == F.col("_u")) & (F.col("h") == F.col("_h")), "left").select("doc_id", "text", "spans").mapInArrow(
        _cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
