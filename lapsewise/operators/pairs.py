"""Exact counts over ordered pairs of rows, far below the pair count.

Rows are first merged into cells of equal (time, score). A node is the event part or the censored part
of a cell. For every node we count, by score, the mass that comes later and the event mass that came
earlier. Small groups are counted in one task each. Large ones are cut into score ranges and time ranges:
pairs in one score range, pairs in one time range, and pairs on the coarse grid are counted apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle, small_side
from .blocks import numbers

# Cells that one task may hold.
GROUP_CELLS = 500_000
# Bounds per axis and level; the coarse grid of one group then stays below a million cells. A range that is
# still too large is cut again by the same steps, so the number of levels grows with the data, not a range.
PIECES = 500
COUNTS = ("later_low", "later_high", "later_same", "early_low", "early_high", "early_same")
_NODE = "t double, lp double, kind int, mass double, case double, " + ", ".join(f"{c} double" for c in COUNTS)


# --- counting in one task -------------------------------------------------------------------

def _runs(*keys: np.ndarray) -> np.ndarray:
    """Index of the first element of each run of equal keys, per element."""
    change = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]
    return np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))


def _before(values: np.ndarray, run: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sum of values in front of each element's run, inside its group."""
    front = np.r_[0.0, values.cumsum()]
    return front[run] - front[group]


def later_lower(order: np.ndarray, rank: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Mass at strictly higher order and strictly lower rank, per element.

    Two ranks differ first at exactly one binary digit; at that digit, among elements
    that share the higher digits, the wanted ones have 0 where the element has 1.
    """
    n = len(order)
    start = np.argsort(-order, kind="stable")
    short = n and rank.max() < 1 << 16  # sorted digit by digit, which is much faster
    o, r, m = order[start], rank[start].astype(np.uint16 if short else np.int64), mass[start]
    found = np.zeros(n)
    for bit in range(int(r.max()).bit_length() if n else 0):
        head = r >> (bit + 1)
        at = np.argsort(head, kind="stable")
        digit = (r[at] >> bit) & 1
        low = np.where(digit == 0, m[at], 0.0)
        total = _before(low, _runs(head[at], o[at]), _runs(head[at]))
        found[at] += np.where(digit == 1, total, 0.0)
    out = np.empty(n)
    out[start] = found
    return out


def _beyond(order: np.ndarray, mass: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """Mass at strictly higher order, over all ranks or inside the own one."""
    group = np.zeros(len(order), dtype=np.int64) if rank is None else rank
    at = np.lexsort((-order, group))
    out = np.empty(len(order))
    out[at] = _before(mass[at], _runs(group[at], order[at]), _runs(group[at]))
    return out


def count_nodes(order: np.ndarray, rank: np.ndarray, mass: np.ndarray, case: np.ndarray) -> dict[str, np.ndarray]:
    low, same = later_lower(order, rank, mass), _beyond(order, mass, rank)
    top = rank.max() if len(rank) else 0
    early_high, early_same = later_lower(-order, top - rank, case), _beyond(-order, case, rank)
    return {
        "later_low": low, "later_same": same, "later_high": _beyond(order, mass) - low - same,
        "early_high": early_high, "early_same": early_same,
        "early_low": _beyond(-order, case) - early_high - early_same,
    }


def _nodes(pdf: pd.DataFrame, score: str, strict: bool) -> pd.DataFrame:
    """Event and censored nodes of cells, with counts; unless ``strict``, a censored row outlasts an event at its time."""
    rank = np.unique(pdf[score].to_numpy(), return_inverse=True)[1]
    time = np.unique(pdf["t"].to_numpy(), return_inverse=True)[1]
    parts = []
    for kind, mass, case in ((1, pdf["d"], pdf["w"]), (0, pdf["c"], None)):
        keep = mass.to_numpy() > 0
        parts.append(pd.DataFrame({
            "row": np.flatnonzero(keep), "kind": kind, "mass": mass.to_numpy()[keep],
            "case": case.to_numpy()[keep] if case is not None else 0.0,
        }))
    nodes = pd.concat(parts, ignore_index=True)
    at = nodes["row"].to_numpy()
    order = time[at] if strict else 2 * time[at] + (1 - nodes["kind"].to_numpy())
    counted = count_nodes(order, rank[at], nodes["mass"].to_numpy(), nodes["case"].to_numpy())
    return pd.concat([pdf.iloc[at].reset_index(drop=True).drop(columns=["d", "c", "w"]),
                      nodes.drop(columns="row"), pd.DataFrame(counted)], axis=1)


# --- many scores of the same rows -------------------------------------------------------------

# Rows whose scores a task packs at a time, event times that travel with it, and rows drawn to place a bound.
PACK_ROWS = 1 << 18
PACK_TIMES = 1 << 20
BOUND_ROWS = 100
# Time codes of a single hot score that one task adds up.
HOT_CODES = 1 << 15
_PACKED = "f int, i int, b int, h int, lp binary, code binary, n binary"
_COUNTED = "f int, i int, b int, code int, mass double, low double, high double, same double"


def _inside(lp: np.ndarray, code: np.ndarray) -> tuple[float, float, float]:
    """Pairs of an event (an even code) and a row with a higher code: with a lower, a higher and the same score."""
    rank = np.unique(lp, return_inverse=True)[1]
    values, place = np.unique(code, return_inverse=True)
    one, event = np.ones(len(lp)), code % 2 == 0
    low = later_lower(-rank, len(values) - 1 - place, one)[event].sum()
    same = _beyond(place, one, rank)[event].sum()
    return low, _beyond(place, one)[event].sum() - low - same, same


def score_totals(df: DataFrame, score_of: Callable[[pa.RecordBatch], np.ndarray], times: np.ndarray, sizes: Mapping[int, int],
                 group_cells: int = GROUP_CELLS) -> DataFrame:
    """``f, i, concordant, discordant, tied`` of each group ``f`` by each of its scores ``i``, exactly.

    ``df`` starts with ``t, e, f``; ``score_of`` gives a batch's scores, rows x scores; ``times`` are the sorted event times, ``sizes`` the
    rows per group. A time matters only by the event times up to it, so a row is a small code and its scores. Tasks pack them by score range, as
    arrays; a range is one small task, and pairs across ranges are counted on the cells (code, range). A bound is a range of its own: a hot score is added
    up by code and counted with the cells alone. Drawn rows place the bounds; they do not change the counts.
    """
    pieces = {g: -(-2 * n // group_cells) for g, n in sizes.items()}
    bounds: dict[int, np.ndarray] = {}
    if max(pieces.values(), default=1) > 1:
        n = sum(sizes.values())
        share = min(1.0, BOUND_ROWS * sum(pieces.values()) / n)

        def drawn(batches):
            for b in batches:
                if b.num_rows:
                    lp = score_of(b)
                    yield pa.RecordBatch.from_pydict({"f": b.column(2).cast(pa.int32()), "lp": [row.tobytes() for row in lp]})

        some = df.sample(share, seed=1).mapInArrow(drawn, "f int, lp binary").collect()
        for g, k in pieces.items():
            own = [np.frombuffer(r["lp"]) for r in some if r["f"] == g]
            if k > 1 and own:
                at = np.sort(np.stack(own), axis=0)
                bounds[g] = at[np.arange(1, k) * len(at) // k].T
    narrow = np.uint16 if 2 * len(times) + 1 < 1 << 16 else np.int32

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            f, code, lps = (np.concatenate(c) for c in zip(*held))
            held.clear()
            for g in np.unique(f):
                own, scores = code[f == g], lps[f == g]
                for i in range(scores.shape[1]):
                    yield blocks(int(g), i, own, scores[:, i], np.unique(bounds[g][i]) if g in bounds else np.zeros(0))

        def blocks(g: int, i: int, own: np.ndarray, lp: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
            known = ~np.isnan(lp)
            own, lp = own[known], lp[known]
            b = np.zeros(len(lp), np.int32)
            if len(cuts):
                at = np.searchsorted(cuts, lp, side="left")
                b = (2 * at + (cuts[np.minimum(at, len(cuts) - 1)] == lp)).astype(np.uint16 if len(cuts) < 1 << 15 else np.int32)
            order = np.argsort(b, kind="stable")
            ranges, starts = np.unique(b[order], return_index=True)
            rows = []
            for r, part in zip(ranges.tolist(), np.split(order, starts[1:])):
                if r % 2 == 0:
                    rows.append((r, 0, lp[part].tobytes(), own[part].astype(narrow).tobytes(), b""))
                    continue
                codes, n = np.unique(own[part], return_counts=True)
                pages, first = np.unique(codes // HOT_CODES, return_index=True)
                rows += [(r, int(h), b"", c.astype(narrow).tobytes(), m.astype(np.int64).tobytes())
                         for h, c, m in zip(pages, np.split(codes, first[1:]), np.split(n, first[1:]))]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([v] * len(rows), pa.int32()) for v in (g, i)] + [pa.array(c, k) for c, k in zip(cols, kinds)],
                names=["f", "i", "b", "h", "lp", "code", "n"])

        for b in batches:
            if b.num_rows:
                t, e, f = numbers(b.column(0)), numbers(b.column(1)), numbers(b.column(2), int)
                held.append((f, 2 * np.searchsorted(times, t, side="right") + (e != 1), score_of(b)))
                if sum(len(h[0]) for h in held) >= PACK_ROWS:
                    yield from flush()
        if held:
            yield from flush()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        f, i, b = (int(pdf[c].iloc[0]) for c in ("f", "i", "b"))
        code = np.concatenate([np.frombuffer(x, narrow) for x in pdf["code"]]).astype(np.int64)
        if b % 2:
            mass = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["n"]])
            found = None
        else:
            mass = np.ones(len(code))
            found = _inside(np.concatenate([np.frombuffer(x) for x in pdf["lp"]]), code)
        codes, place = np.unique(code, return_inverse=True)
        out = pd.DataFrame({"f": f, "i": i, "b": b, "code": codes, "mass": np.bincount(place, mass), "low": 0.0, "high": 0.0, "same": 0.0})
        return out if found is None else pd.concat([out, pd.DataFrame([(f, i, b, -1, 0.0, *found)], columns=out.columns)])

    counted = settle(df.mapInArrow(pack, _PACKED).groupBy("f", "i", "b", "h").applyInPandas(count, _COUNTED))
    keys, kinds = ["f", "i"], ("low", "high", "same")
    inside = counted.where("code < 0").groupBy(*keys).agg(*[F.sum(k).alias(k) for k in kinds])
    event, mass = F.col("code") % 2 == 0, F.col("mass")
    cells = counted.where("code >= 0").select(
        *keys, F.col("code").cast("double").alias("t"), F.col("b").cast("double").alias("lp"), F.when(event, mass).otherwise(0.0).alias("d"),
        F.when(event, 0.0).otherwise(mass).alias("c"), F.when(event, mass).otherwise(0.0).alias("w"))
    case = F.col("case")
    across = node_counts(cells, keys, strict=True, group_cells=group_cells).groupBy(*keys).agg(
        F.sum(case * F.col("later_low")).alias("low"), F.sum(case * F.col("later_high")).alias("high"),
        F.sum(F.when(F.col("lp") % 2 == 1, case * F.col("later_same")).otherwise(0.0)).alias("same"))
    return inside.unionByName(across).groupBy(*keys).agg(
        F.sum("low").alias("concordant"), F.sum("high").alias("discordant"), F.sum("same").alias("tied"))


# --- cells and groups -----------------------------------------------------------------------

def cells_of(
    df: DataFrame, time: str, event: str, score: str, by: Sequence[str] = (), weight: Column | None = None,
    case_weight: Column | None = None,
) -> DataFrame:
    """Cells ``(by, t, lp, d, c, w)``: event mass, censored mass, weighted event mass.

    Rows without a time, an event flag or a score (null or not a number) can enter no pair and are left out.
    """
    df = df.where(F.col(event).isNotNull())
    for c in (time, score):
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    v = F.lit(1.0) if weight is None else weight.cast("double")
    e = F.col(event).cast("double")
    w = e * v if case_weight is None else e * v * case_weight
    return df.groupBy(*by, F.col(time).cast("double").alias("t"), F.col(score).cast("double").alias("lp")).agg(
        F.sum(e * v).alias("d"), F.sum((1 - e) * v).alias("c"), F.sum(w).alias("w"))


def _typed(by: Sequence[str], df: DataFrame) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in by)


def node_counts(cells: DataFrame, by: Sequence[str] = (), strict: bool = False,
                group_cells: int = GROUP_CELLS) -> DataFrame:
    """Per node: ``by, t, lp, kind, mass, case`` and the six counts."""
    by = list(by)
    cells = settle(cells)
    most = cells.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= group_cells:
        keys = by or [F.lit(0).alias("_one")]
        grouped = cells.groupBy(*keys)

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return _nodes(pdf, "lp", strict)

        return grouped.applyInPandas(whole, _typed(by, cells) + _NODE)
    return _ranged_counts(cells, by, strict, max(2, min(2 * -(-most // group_cells), PIECES)), group_cells)


def _places(value: Column, bounds: Sequence[float]) -> Column:
    """2 i + 1 at bound i, 2 i between the bounds before it."""
    cuts = np.asarray(bounds, dtype=float)

    @F.arrow_udf("int")
    def find(values: pa.Array) -> pa.Array:
        v = values.to_numpy(zero_copy_only=False)
        at = np.searchsorted(cuts, v, side="left")
        return pa.array((2 * at + (cuts[np.minimum(at, len(cuts) - 1)] == v)).astype(np.int32))

    return find(value.cast("double")) if len(cuts) else F.lit(0)


def _ranged_counts(cells: DataFrame, by: list[str], strict: bool, pieces: int, group_cells: int) -> DataFrame:
    probs = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    bounds = settle(cells.groupBy(*by).agg(
        F.array_distinct(F.percentile_approx("lp", probs, F.lit(100 * pieces))).alias("_lb"),
        F.array_distinct(F.percentile_approx("t", probs, F.lit(100 * pieces))).alias("_tb")))
    # A bound is a range of its own between two open ones, so a hot value never shares a range with its neighbours.
    if by:
        place = lambda value, cuts: 2 * F.size(F.filter(cuts, lambda b: b < value)) + F.array_contains(cuts, value).cast("int")
        keyed = join_groups(cells, bounds, by, small=True).select(
            *cells.columns, place(F.col("lp"), F.col("_lb")).alias("_b"), place(F.col("t"), F.col("_tb")).alias("_g"))
    else:
        cuts = bounds.first()
        keyed = cells.select("*", _places(F.col("lp"), cuts["_lb"]).alias("_b"), _places(F.col("t"), cuts["_tb"]).alias("_g"))
    alone = keyed.groupBy(*by, "_b").agg((F.min("lp") == F.max("lp")).alias("_alone"))
    keyed = settle(join_groups(keyed, alone, [*by, "_b"], small=True))
    head = _typed(by, cells)
    counts = ", ".join(f"{c} double" for c in COUNTS)

    # 1. Pairs inside one score range. A range of a single score is also cut by time.
    own = keyed.select(*by, "_b", F.when(F.col("_alone"), F.col("_g")).otherwise(F.lit(-1)).alias("_h"), "t", "lp", "d", "c", "w")
    level = len([k for k in by if k.startswith("_h")])
    inner = [*by, f"_b{level}", f"_h{level}"]
    first = node_counts(own.withColumnsRenamed({"_b": f"_b{level}", "_h": f"_h{level}"}), inner, strict, group_cells)
    first = first.withColumnRenamed(f"_b{level}", "_b").drop(f"_h{level}")

    # 2. Pairs inside one time range but different score ranges: only the range numbers matter.
    coarse = keyed.groupBy(*by, "t", "_g", "_b", "_alone").agg(*[F.sum(c).alias(c) for c in ("d", "c", "w")])
    coarse = settle(coarse)
    second = node_counts(coarse.select(*by, F.col("_g").alias(f"_h{level}"), "t", F.col("_b").cast("double").alias("lp"), "d", "c", "w"),
                         [*by, f"_h{level}"], strict, group_cells)
    second = second.select(*by, F.col(f"_h{level}").alias("_g"), "t", F.col("lp").cast("int").alias("_b"), "kind", *[
        F.lit(0.0).alias(c) if c.endswith("_same") else F.col(c) for c in COUNTS])

    # 3. Pairs in different time ranges and different score ranges, on the grid of ranges.
    grid = coarse.groupBy(*by, "_g", "_b", "_alone").agg(*[F.sum(c).alias(c) for c in ("d", "c", "w")])

    def on_grid(pdf: pd.DataFrame) -> pd.DataFrame:
        mass = (pdf["d"] + pdf["c"]).to_numpy()
        found = count_nodes(pdf["_g"].to_numpy(), pdf["_b"].to_numpy(), mass, pdf["w"].to_numpy())
        single = pdf["_alone"].to_numpy()
        found["later_same"] = np.where(single, found["later_same"], 0.0)
        found["early_same"] = np.where(single, found["early_same"], 0.0)
        return pd.concat([pdf[[*by, "_g", "_b"]], pd.DataFrame(found, index=pdf.index)], axis=1)

    third = grid.groupBy(*(by or [F.lit(0).alias("_one")])).applyInPandas(on_grid, head + "_g int, _b int, " + counts)
    rest = join_groups(second, third.withColumnsRenamed({c: f"{c}_3" for c in COUNTS}), [*by, "_g", "_b"])
    rest = rest.select(*by, "t", "_b", "kind", *[(F.col(c) + F.col(f"{c}_3")).alias(f"{c}_2") for c in COUNTS])
    both = join_groups(first, rest, [*by, "t", "_b", "kind"])
    return both.select(*by, "t", "lp", "kind", "mass", "case", *[(F.col(c) + F.col(f"{c}_2")).alias(c) for c in COUNTS])


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool = False) -> DataFrame:
    """Inner join where null keys match; the key columns of the left side stay. ``small``: the right side has one
    row per group, so it is counted and broadcast if it is short."""
    if not keys:
        return left.join(F.broadcast(right))  # one row: the whole table is a single group
    r = right.select(*[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    r = small_side(r) if small else r
    return left.join(r, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys]).drop(*[f"_j_{k}" for k in keys])
