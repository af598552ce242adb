"""Best-fit packing of token pieces into sequences, planned over the histogram of lengths."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapsewise.session import settle

from .common import table

MODEL = "/opt/tokenizers/word_bpe_49k.json"
CAPACITY = 2048
END = 0           # id behind every document
WORD_BYTES = 48   # longer words are encoded each time they occur
CACHE = 500_000   # words of at most WORD_BYTES that a Python worker remembers between batches
SLICE = 1 << 14     # rows of one length that a window numbers together, in expectation
STRIDE = 1 << 16     # planned slots that one row of the plan is unfolded into

_workers: dict[int, Words] = {}  # what this process has learnt about a tokenizer


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Words:
    """Ids of words between ASCII white space, each distinct one encoded once.

    A word of Latin letters, with or without punctuation behind it, is one or two tokens to the splitter. Its letters in lower
    case, as the vocabulary writes their bytes, go straight to the merges, and few of those are new; other words take the whole way. Probes
    decide if a tokenizer lowers and splits like that; one that does not takes the whole way for all words.
    """

    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#$%&|]*)")

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.known: dict[bytes, bytes] = {}   # words as they stand
        self.parts: dict[str, bytes] = {}     # lower case letters, and punctuation
        self.letters = byte_letters()
        probes = [h + t for h in ("a", "Zürich", "ÀÉÎÕÜß", "Øre", "ÿ", "don", "THE", "ll", "naïve", "straße") for t in ("", ".", "!!", "?!...", ",;:", "*#$%&|", "|")]
        self.plain = True
        self.plain = [self.whole(x) for x in probes] == list(self.encode([x.encode() for x in probes]))
        self.parts.clear()

    def whole(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            written = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()
            if len(part) <= WORD_BYTES:
                self.parts[part] = ids
        return ids

    def encode(self, words: Iterable[bytes]) -> Iterator[bytes]:
        parts, known_part, plain = self.parts, self.parts.get, self.PLAIN.fullmatch if self.plain else lambda text: None
        for word in words:
            text = word.decode()
            found = plain(text)
            if found is None:
                yield self.whole(text)
                continue
            head, tail = found.groups()
            head = head.lower()
            ids = known_part(head)
            if ids is None:
                ids = self._part(head)
            yield ids + (parts[tail] if tail in parts else self._part(tail)) if tail else ids

    def rows(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of whole texts."""
        rows = [(t or "").encode().split() for t in texts]
        if len(self.parts) > CACHE:
            self.parts.clear()
        if len(self.known) > CACHE:
            self.known.clear()
        long = {}
        new = list(set().union(*rows).difference(self.known))
        for w, ids in zip(new, self.encode(new)):
            if len(w) <= WORD_BYTES:
                self.known[w] = ids
            else:
                long[w] = ids
        if long:
            return [b"".join([long[w] if w in long else self.known[w] for w in r]) for r in rows]
        return [b"".join(map(self.known.__getitem__, r)) for r in rows]


def splits_at_space(model: str) -> bool:
    """True if a tokenizer encodes each word between ASCII white space by itself, seen on words that join if it does not."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(model)
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    words = ["a", "́b", "'", "s", "l", "'ll", "<|endoftext|>", "1", "23", "\x1c", "ΑΣ", "...", "é", "ᄀ", "ᅡ"]
    return all(ids(x + s + y) == ids(x) + ids(y) for x in words for y in words for s in (" ", "\n", "\t \r"))


def _encode(model: str, by_word: bool, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        key = hash(model)
        words = _workers.get(key) or _workers.setdefault(key, Words(model))
        last = np.asarray([end], dtype="<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column("text").to_pylist()
                if by_word:
                    packed = [i + last for i in words.rows(texts)]
                else:
                    packed = [words.whole(t or "") + last for t in texts]
                cuts = [(k, s) for k, p in enumerate(packed) for s in range(0, len(p), 4 * capacity)]
                own = pa.array([k for k, _ in cuts], pa.int32())
                ids = [packed[k][s:s + 4 * capacity] for k, s in cuts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(own), pa.array([s // (4 * capacity) for _, s in cuts], pa.int32()), pa.array([s // 4 for _, s in cuts], pa.int64()),
                     pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"])

    return run


def token_pieces(docs: DataFrame, model: str = MODEL, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text and the closing id, cut into pieces of at most ``capacity``.

    Returns ``doc_id, piece, start, length, ids``, at least one row per input row; ``ids`` holds little-endian unsigned 32-bit
    numbers. Null and empty texts have the closing id alone. ``model`` is a tokenizer file that the driver reads and sends to the tasks. Whole
    texts are encoded, whatever their length.
    """
    with open(model, encoding="utf-8") as f:
        content = f.read()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(content, splits_at_space(content), capacity, end),
                           f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit, longest first, over counts of equal lengths.

    Returns runs ``(length, rank, n, sequence, layers, offset)`` and the number of sequences: the ``n`` pieces of that length from ``rank``
    on fill the sequences from ``sequence`` on, ``layers`` in each one after the other, from ``offset``. A group
    is a run of sequences with the same room left. The fullest group that still fits takes the next pieces, and as many in
    one sequence as fit, since that sequence is then the fullest that fits. The work depends on the number of distinct lengths,
    not on the number of pieces.
    """
    runs, sequences = [], 0
    rooms: list[int] = []                     # sorted, distinct
    groups: dict[int, list[list[int]]] = {}   # room -> [first sequence, count]

    def add(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append([first, count])

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a length must be 1 to {capacity}")
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(k)
            else:
                room, first, count = capacity, sequences, -(-left // (capacity // length))
                sequences += count
            layers = room // length
            used = min(count, -(-left // layers))
            n = min(left, used * layers)
            runs.append((length, rank, n, first, layers, capacity - room))
            full, rest = divmod(n, layers)
            add(room - layers * length, first, full)
            if rest:
                add(room - rest * length, first + full, 1)
            add(room, first + used, count - used)
            left, rank = left - n, rank + n
    return runs, sequences


def _ranked(pieces: DataFrame, counts: dict[int, int], seed: int) -> DataFrame:
    """Add ``rank``, gapless from 0 within each length, in the order of a hash. A length is cut into slices of some SLICE rows by the
    leading bits of the hash; a window numbers each slice, and slice totals shift it."""
    spark = pieces.sparkSession
    cut = spark.createDataFrame([(x, -(-n // SLICE)) for x, n in counts.items()], "_length long, _slices long")  # one row per length
    hashed = pieces.withColumn("_key", F.xxhash64("doc_id", "piece", F.lit(seed))).join(F.broadcast(cut), F.col("length") == F.col("_length")).drop("_length")
    slice_ = F.floor(F.shiftrightunsigned("_key", 32) * F.col("_slices") / F.lit(1 << 32))
    sliced = hashed.withColumn("_slice", slice_).drop("_slices")
    ahead = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(F.col("length").alias("_g"), F.col("_slice").alias("_s")).agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    )
    inside = Window.partitionBy("length", "_slice").orderBy("_key", *[c for c in pieces.columns if c != "length"])
    return (
        sliced.withColumn("_r", F.row_number().over(inside) - 1)
        .join(starts, (F.col("length") == F.col("_g")) & (F.col("_slice") == F.col("_s")))
        .withColumn("rank", F.col("_start") + F.col("_r")).drop("_key", "_slice", "_g", "_s", "_start", "_r")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, seed: int = 17) -> DataFrame:
    """Give every piece a place: the columns of ``pieces`` with ``sequence_id`` and ``offset``, offsets gapless from 0 in each sequence.

    ``pieces`` needs ``doc_id``, ``piece`` and ``length`` (1 to ``capacity``) and is read more than once. The
    driver sees the histogram, one row per length. Pieces of one length are ranked by hash in slices, so a length that most rows
    share is ranked by many tasks; the runs of the plan are unfolded to one row per planned slot, in steps of some thousand, and pieces
    join their slots by length and rank. An empty table gives an empty result.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    spark = pieces.sparkSession
    table_ = spark.createDataFrame(runs, "_length long, first long, n long, sequence long, layers long, start long")
    chunks = table_.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STRIDE).cast("long"))).alias("chunk"))
    slots = (
        chunks.repartition("_length", "chunk", "first")
        .select("*", F.explode(F.sequence("chunk", F.least(F.col("chunk") + STRIDE, "n") - 1)).alias("at"))
        .select("_length", (F.col("first") + F.col("at")).alias("_rank"), (F.col("sequence") + F.floor(F.col("at") / F.col("layers"))).alias("sequence_id"),
                (F.col("start") + (F.col("at") % F.col("layers")) * F.col("_length")).alias("offset"))
    )
    ranked = _ranked(pieces, counts, seed)
    return ranked.join(slots, (F.col("length") == F.col("_length")) & (F.col("rank") == F.col("_rank"))).drop("rank", "_length", "_rank")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id, length, ids, documents``; a sequence holds at most its capacity, so no group grows with the data."""
    part = F.struct("offset", "length", "ids", "doc_id", "piece")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(part)).alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), model)
    thin = settle(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(thin).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
