"""Near-dedup of documents: SetSketch registers, banding, joint likelihood, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.session import settle, shuffle_width

from .common import components, table, tidy

BANDS, ROWS = 40, 5      # at similarity 0.8 a pair shares no band with chance 6e-8
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.1, 4.0, 254  # register k stands for minima around RATE * BASE ** -k; TOP ends beyond 1e9 elements
SLACK = 18.0             # log likelihood that a pair may lose against its best similarity and is still verified
HOT = 1024               # rows of a group that are compared in one piece
PIECE = 4 << 20          # bytes of full sets in a piece
WHOLE = 16               # pieces up to which a cluster of groups is compared as one; larger ones go group by group
STARS = 2                # rounds that compare a group with one member before its rest is compared throughout

_G = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _G[1]
    x = (x ^ (x >> np.uint64(27))) * _G[2]
    return x ^ (x >> np.uint64(31))


_words: dict[bytes, int] = {}  # hashes of frequent words in this process


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = _words
    if len(known) > 200_000:  # a cache only
        known.clear()
    hashes = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, dtype=np.uint64)
    if len(h) < width:
        return _mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(h))], dtype=np.uint64))
    n, total = len(h) - width + 1, np.zeros(len(h) - width + 1, dtype=np.uint64)
    for k in range(width):
        total = (total ^ h[k:k + n]) * _G[0] + _G[5]
        total ^= total >> np.uint64(29)
    return np.unique(_mix(total))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (sets x registers, uint8) of disjoint hash sets.

    Each element draws the points of a Poisson process, every point on a random register; the least point of a register is
    then exponential. The logarithm of a minimum to BASE, cut to the register range, is kept; registers of a
    union are maxima of registers. Points come in increasing order, so an element stops as soon as its point
    is above every minimum of its set.
    """
    n = len(sets)
    out = np.zeros((n, REGISTERS), dtype=np.uint8)
    if not n:
        return out
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    least = np.full((n, REGISTERS), 1.0)  # truncated: a larger minimum is register value 0
    limit = np.ones(n)
    point = np.zeros(len(element))
    step = 0
    while len(element):
        h = _mix(element + np.uint64((2 * step + 1) * int(_G[0]) & 0xFFFFFFFFFFFFFFFF))
        register = (_mix(h + _G[3]) % np.uint64(REGISTERS)).astype(np.int64)
        point = point - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / (RATE * REGISTERS)
        alive = point < limit[owner]
        element, owner, point, register = element[alive], owner[alive], point[alive], register[alive]
        np.minimum.at(least, (owner, register), point)
        step += 1
        if step < 8 or step % 8 == 0:
            limit = least.max(axis=1)
    return np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, TOP + 1).astype(np.uint8) * (least < 1.0)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / math.log(BASE)


def plausible(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair may have the wanted similarity, from the joint likelihood of its register comparisons.

    ``above`` and ``below`` count the registers where the first is larger or smaller; the set sizes are known. A pair goes only if
    some lower similarity explains the counts better by more than ``SLACK``.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    equal = REGISTERS - above - below

    def loss(j: float) -> np.ndarray:
        jac = np.minimum(j, np.minimum(n_a, n_b) / np.maximum(n_a, n_b))
        up, down = _p(u - v * jac), _p(v - u * jac)
        return above * np.log(np.maximum(up, 1e-12)) + below * np.log(np.maximum(down, 1e-12)) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    goal = percent / 100
    wanted = loss(goal)
    lower = np.max([loss(j) for j in np.arange(0.0, goal, 0.04)], axis=0)
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (lower - wanted <= SLACK)


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start = batch.column("text"), 0
            while start < batch.num_rows:
                sets, size, stop = [], 0, start
                while stop < batch.num_rows and size < 500_000:
                    sets.append(shingles(texts[stop].as_py(), width))
                    size += len(sets[-1])
                    stop += 1
                with np.errstate(over="ignore"):
                    sums = [(int(s.sum()), int(_mix(s ^ _G[4]).sum())) for s in sets]
                regs = sketch([s if len(s) >= 4 else s[:0] for s in sets])
                signed = lambda k: pa.array(np.array([s[k] for s in sums], dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array([len(s) for s in sets], pa.int64()), signed(0), signed(1),
                     pa.array([r.tobytes() for r in regs], pa.binary())], names=["doc_id", "n", "s1", "s2", "regs"])
                start = stop

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [shingles(t.as_py(), width) for t in part.column("text")]
                # rows that repeat an id with another text have another sum
                own = [int(s.sum().view(np.int64)) == k for s, k in zip(found, part.column("s1").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "shingles"]).filter(pa.array(own))

    return run


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS)


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _registers(batch.column("regs_a")), _registers(batch.column("regs_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            ok = plausible((a > b).sum(axis=1), (a < b).sum(axis=1), n_a, n_b, percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return run


def _verify(percent: int):
    """Rows sorted by (hub, lane, role): the hub's set, then the sets to hold against it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = own = None
        for batch in batches:
            out: list[tuple[int, int]] = []
            hubs, ids, sets = batch.column("hub").to_pylist(), batch.column("id").to_pylist(), batch.column("shingles")
            for i, (h, x) in enumerate(zip(hubs, ids)):
                s = np.frombuffer(sets[i].as_buffer(), dtype=np.uint64)
                if x == h:
                    hub, own = h, s.copy()
                    continue
                assert hub == h
                if _linked(own, s, percent):
                    out.append((h, x))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return run


def _crossing(percent: int):
    """One piece against another of the same group: pairs of different components that are plausible.

    A pair that shares several bands is left to the first of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                band, same = batch.column("band")[i].as_py(), batch.column("i")[i].as_py() == batch.column("j")[i].as_py()
                sides = []
                for c in ("rows_a", "rows_b"):
                    rows = batch.column(c)[i].values
                    sides.append([rows.field(k).to_numpy() for k in ("id", "comp", "n")] + [_registers(rows.field("regs"))])
                (ids_a, comp_a, n_a, regs_a), (ids_b, comp_b, n_b, regs_b) = sides
                found: list[np.ndarray] = []
                for r in range(len(ids_a)):
                    pick = np.flatnonzero((comp_b != comp_a[r]) & (100 * np.minimum(n_b, n_a[r]) >= percent * np.maximum(n_b, n_a[r])) & ((ids_b > ids_a[r]) if same else True))
                    if not len(pick):
                        continue
                    other = regs_b[pick]
                    up, down = (regs_a[r] > other), (regs_a[r] < other)
                    first = (~(up | down)).reshape(len(pick), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
                    ok = first & plausible(up.sum(axis=1), down.sum(axis=1), np.full(len(pick), float(n_a[r])), n_b[pick].astype(float), percent)
                    found.append(np.stack([np.full(int(ok.sum()), ids_a[r]), ids_b[pick][ok]], axis=1))
                pairs = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _within(percent: int):
    """One piece of a cluster against another: links that join components, verified on full sets at once.

    Partners of a row are tried from the most alike down, and only those that are not yet in its component.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column("i")[i].as_py() == batch.column("j")[i].as_py()
                sides = []
                for c in ("rows_a", "rows_b"):
                    rows = batch.column(c)[i].values
                    sides.append([rows.field(k).to_numpy() for k in ("id", "comp", "n")] + [_registers(rows.field("regs")), rows.field("shingles")])
                (ids_a, comp_a, n_a, regs_a, sets_a), (ids_b, comp_b, n_b, regs_b, sets_b) = sides
                names, where = np.unique(np.concatenate([comp_a, comp_b]), return_inverse=True)
                label = np.arange(len(names))
                at_a, at_b = where[:len(ids_a)], where[len(ids_a):]
                found: list[tuple[int, int]] = []
                for r in range(len(ids_a)):
                    mine = label[at_a[r]]
                    pick = np.flatnonzero((label[at_b] != mine) & (100 * np.minimum(n_b, n_a[r]) >= percent * np.maximum(n_b, n_a[r])) & ((ids_b > ids_a[r]) if same else True))
                    if not len(pick):
                        continue
                    up, down = (regs_a[r] > regs_b[pick]).sum(axis=1), (regs_a[r] < regs_b[pick]).sum(axis=1)
                    ok = plausible(up, down, np.full(len(pick), float(n_a[r])), n_b[pick].astype(float), percent)
                    own = None
                    for k in pick[ok][np.argsort((up + down)[ok], kind="stable")]:
                        other = label[at_b[k]]
                        if other == label[at_a[r]]:
                            continue
                        own = np.frombuffer(sets_a[r].as_buffer(), dtype=np.uint64) if own is None else own
                        s = np.frombuffer(sets_b[int(k)].as_buffer(), dtype=np.uint64)
                        if _linked(own, s, percent):
                            found.append((int(ids_a[r]), int(ids_b[k])))
                            label[label == other] = label[at_a[r]]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(a, b)
    common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have at least ``percent`` in common: ``doc_id, n_shingles, component_id, kept``.

    Words are what stands between ASCII white space, A-Z lower-cased; a text with fewer words than ``width`` is one shingle, a null or blank one has none and
    links with nothing. Equal sets (equal texts among them) collapse to one representative. Its SetSketch registers are banded; in each band
    group the member first in a fixed hash order is the hub, and every member is held against its hub: a joint
    likelihood over all registers drops what cannot reach the similarity, full sets decide the rest. Members
    that are linked by then need no further comparison with each other. After a second round with other hubs, groups that still
    hold several components are compared throughout, in pieces of bounded size, across components: clusters of groups
    with common members as one, so that a pair meets once, clusters above 16 pieces group by group. So the
    components are those of all links between band partners. A hub with many members is dealt in lanes, a large group in pieces;
    no group meets in one task. Ids must be integers; a row with a null id gets a null component and is not kept. Rows that repeat an id
    share the component of that id. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = settle(rows.mapInArrow(_sketched(width), "doc_id long, n long, s1 long, s2 long, regs binary"))
    known = base.where("n > 0 AND doc_id IS NOT NULL")
    # the size and two 64-bit sums of hashes name a set
    single = settle(known.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "regs")).alias("m"))
                    .select("n", "s1", "s2", F.col("m.doc_id").alias("doc"), F.col("m.regs").alias("regs"), F.monotonically_increasing_id().alias("id")))
    able = single.where("n >= 4")
    slices = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substr(F.col("regs"), k * ROWS + 1, F.lit(ROWS))))
    bands = able.select("id", F.posexplode(slices).alias("band", "key"))
    many = settle(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    member = settle(bands.join(many.select(F.col("key").alias("k"), "size"), F.col("key") == F.col("k")).drop("k"))
    regs = able.select("id", "n", "regs")

    wanted = single.join(member.select(F.col("id").alias("i")).distinct(), F.col("id") == F.col("i"), "left_semi").select("doc", "id", "s1")
    texts = rows.join(wanted, F.col("doc_id") == F.col("doc")).select("id", "s1", "text")
    sets = settle(texts.mapInArrow(_sets(width), "id long, shingles binary"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Of distinct plausible pairs (hub a, member b), those whose full sets agree."""
        lanes = pairs.groupBy("a").agg(F.ceil(F.count("*") / HOT).cast("int").alias("lanes"))
        dealt = pairs.join(lanes, "a").select(F.col("a").alias("hub"), F.col("b").alias("id"), F.pmod(F.xxhash64("b"), F.col("lanes")).cast("int").alias("lane"))
        heads = lanes.select(F.col("a").alias("hub"), F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))
        full = dealt.unionByName(heads).join(sets, "id").select("hub", "lane", (F.col("hub") != F.col("id")).alias("role"), "id", "shingles")
        return settle(full.repartition("hub", "lane").sortWithinPartitions("hub", "lane", "role").mapInArrow(_verify(percent), "a long, b long"))

    def side(k: str) -> DataFrame:
        return regs.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("regs").alias(f"regs_{k}"))

    def packed(rows: DataFrame, *group: str) -> DataFrame:
        """Pairs of pieces of each group: group columns, i, j, rows_a, rows_b."""
        of = [c for c in rows.columns if c not in (*group, "pieces", "piece")]
        held = settle(rows.groupBy(*group, "pieces", "piece").agg(F.collect_list(F.struct(*of)).alias("rows")))
        # both sides are dealt by the pair at once, so a piece travels once per pair
        left = held.select(*group, F.col("rows").alias("rows_a"), F.col("piece").alias("i"), F.explode(F.sequence(F.col("piece"), F.col("pieces") - 1)).alias("j"))
        right = held.select(*group, F.col("rows").alias("rows_b"), F.explode(F.sequence(F.lit(0), F.col("piece"))).alias("i"), F.col("piece").alias("j"))
        deal = lambda side: side.repartition(4 * shuffle_width(docs.sparkSession), *group, "i", "j")
        return deal(left).join(deal(right), [*group, "i", "j"])

    def mixed_groups(comp: DataFrame | None) -> DataFrame:
        """Band members with their components, of the groups that hold several."""
        if comp is None:
            return member.withColumn("comp", F.col("id"))
        now = member.drop("size").join(comp, F.col("id") == F.col("node"), "left").select("id", "band", "key", F.coalesce("root", "id").alias("comp"))
        mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select(F.col("key").alias("k"), "lo", "size")
        return settle(now.join(mixed, F.col("key") == F.col("k")).drop("k"))

    links, comp = None, None
    for turn in range(STARS):
        now = mixed_groups(comp)
        hubs = now.groupBy(F.col("key").alias("k")).agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "comp")).alias("hub"))
        stars = now.join(hubs, F.col("key") == F.col("k")).where(F.col("comp") != F.col("hub.comp")).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
        likely = settle(stars.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(_likely(percent), "a long, b long"))
        found = linked(likely)
        links = found if links is None else links.unionByName(found)
        comp = components(links)
        del now, hubs, stars, likely, found
        tidy(docs.sparkSession)

    now = mixed_groups(comp)
    if comp is None:
        lows = now.groupBy("key").agg(F.min("comp").alias("lo")).withColumnRenamed("key", "k")
        now = settle(now.join(lows, F.col("key") == F.col("k")).drop("k"))
    cluster = components(now.select(F.col("comp").alias("a"), F.col("lo").alias("b"))).select(F.col("node").alias("_node"), F.col("root").alias("cluster"))
    rows_of = now.select("id", "comp").distinct().join(cluster, F.col("comp") == F.col("_node")).drop("_node")
    weighed = rows_of.join(regs.select(F.col("id").alias("_id"), "n"), F.col("id") == F.col("_id"))
    sizes = settle(weighed.groupBy(F.col("cluster").alias("_c")).agg(F.greatest(F.ceil(F.count("*") / HOT), F.ceil(F.sum("n") * 8 / PIECE)).cast("int").alias("pieces")))
    piece = F.pmod(F.xxhash64("id", F.lit(99)), F.col("pieces")).cast("int").alias("piece")
    small = rows_of.join(sizes.where(F.col("pieces") <= WHOLE), F.col("cluster") == F.col("_c")).select("cluster", "id", "comp", "pieces", piece)
    once = packed(small.join(regs, "id").join(sets, "id").select("cluster", "pieces", "piece", "id", "comp", "n", "regs", "shingles"), "cluster")
    found = settle(once.select("i", "j", "rows_a", "rows_b").mapInArrow(_within(percent), "a long, b long"))
    links = found if links is None else links.unionByName(found)
    large = rows_of.join(sizes.where(F.col("pieces") > WHOLE), F.col("cluster") == F.col("_c"), "left_semi").select(F.col("id").alias("_id"))
    each = now.join(large, F.col("id") == F.col("_id"), "left_semi").withColumn("pieces", F.ceil(F.col("size") / HOT).cast("int"))
    each = packed(each.select("key", "band", "id", "comp", "pieces", piece).join(regs, "id").select("key", "band", "pieces", "piece", "id", "comp", "n", "regs"), "key", "band")
    likely = settle(each.select("band", "i", "j", "rows_a", "rows_b").mapInArrow(_crossing(percent), "a long, b long"))
    links = links.unionByName(linked(likely))
    comp = components(links)
    solved = settle(single.join(comp, F.col("id") == F.col("node"), "left").select("n", "s1", "s2", "doc", F.coalesce("root", "id").alias("root")))
    least = solved.groupBy("root").agg(F.min("doc").alias("component"))
    solved = solved.join(least, "root").select("n", "s1", "s2", "component")
    of = known.select("doc_id", "n", "s1", "s2").join(solved, ["n", "s1", "s2"]).groupBy(F.col("doc_id").alias("known")).agg(F.min("component").alias("component"))
    return (
        base.select("doc_id", "n").join(of, F.col("doc_id") == F.col("known"), "left")
        .withColumn("component_id", F.coalesce("component", "doc_id"))
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    )


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


SQL_OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(a, b) AS (
  SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), low AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM sets LEFT JOIN low ON low.a = doc_id
"""
