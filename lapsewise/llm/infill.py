"""Fill-in-middle transformation over seekable compressed frames."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

FRAME = 1 << 16  # code points in a frame
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
UNITS = ("line", "char")

# A frame is a zstandard frame of its own; ``units`` and ``chars`` count what ends up to its last character, so a
# reader finds the frame of a place without opening another one.
FRAMES = "array<struct<units: bigint, chars: bigint, data: binary>>"
_press, _open = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()  # contexts hold megabytes; a process needs one of each
_FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))


class Frames:
    """A text as compressed frames with running counts; at most one frame is open at a time."""

    def __init__(self, rows: Iterable[dict] | None = None, unit: str = "line"):
        self.unit, self.data = unit, []
        self.units, self.chars = [], []
        for r in rows or ():
            self.units.append(r["units"])
            self.chars.append(r["chars"])
            self.data.append(r["data"])

    @classmethod
    def of(cls, text: str, unit: str = "line", size: int = FRAME) -> Frames:
        out = cls(unit=unit)
        for start in range(0, len(text), size):
            out.append(text[start:start + size])
        return out

    def append(self, part: str) -> None:
        """Close a new frame over a part."""
        if part:
            self._take(part.count("\n") if self.unit == "line" else len(part), len(part), _press.compress(part.encode()))

    def _take(self, units: int, chars: int, data: bytes) -> None:
        self.units.append((self.units[-1] if self.units else 0) + units)
        self.chars.append((self.chars[-1] if self.chars else 0) + chars)
        self.data.append(data)

    def rows(self) -> list[dict]:
        return [{"units": u, "chars": c, "data": d} for u, c, d in zip(self.units, self.chars, self.data)]

    def text(self, k: int) -> str:
        return _open.decompress(self.data[k]).decode()

    def count(self) -> int:
        """Units of the whole text; only the last frame is opened, to see if it ends inside a line."""
        if not self.data:
            return 0
        return self.units[-1] + (self.unit == "line" and not self.text(len(self.data) - 1).endswith("\n"))

    def place(self, unit: int) -> int:
        """Code points before the end of that many units; the one frame that holds the end is opened."""
        if unit <= 0 or not self.data:
            return 0
        k = bisect_left(self.units, unit)
        if k == len(self.units):  # the last line has no end
            return self.chars[-1]
        before, inside = (self.chars[k - 1], self.units[k - 1]) if k else (0, 0)
        if self.unit == "char":
            return before + unit - inside
        part, at = self.text(k), 0
        for _ in range(unit - inside):
            at = part.index("\n", at) + 1
        return before + at

    def parts(self, start: int, stop: int) -> Iterator[str]:
        """The text between two places in order, frame by frame."""
        for k in range(bisect_left(self.chars, start + 1), len(self.chars)):
            before = self.chars[k - 1] if k else 0
            if before >= stop:
                return
            yield self.text(k)[max(0, start - before):stop - before]

    def copy(self, other: Frames, start: int, stop: int) -> None:
        """Append a range of another text; frames that lie inside are taken as they are, cut ones are opened."""
        for k in range(bisect_left(other.chars, start + 1), len(other.chars)):
            before, seen = (other.chars[k - 1], other.units[k - 1]) if k else (0, 0)
            if before >= stop:
                return
            if start <= before and other.chars[k] <= stop:
                self._take(other.units[k] - seen, other.chars[k] - before, other.data[k])
            else:
                self.append(other.text(k)[max(0, start - before):stop - before])

    def find(self, mark: str, start: int = 0) -> int:
        """Place of the first ``mark`` from ``start`` on, also across frames; -1 if there is none."""
        tail, at = "", start
        for part in self.parts(start, self.chars[-1] if self.chars else 0):
            joined = tail + part
            hit = joined.find(mark)
            if hit >= 0:
                return at - len(tail) + hit
            at += len(part)
            tail = joined[-(len(mark) - 1):]
        return -1


def transform(text: Frames, form: str, first: int, second: int) -> tuple[Frames, int, int]:
    """The output frames for a cut after ``first`` and ``second`` units, and the places of both cuts."""
    out = Frames(unit=text.unit)
    end = text.chars[-1] if text.chars else 0
    if form == PLAIN:
        out.copy(text, 0, end)
        return out, end, end
    a, b = text.place(first), text.place(second)
    pieces = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, end)}
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == PSM else (SUFFIX, PREFIX, MIDDLE):
        out.append(mark)
        out.copy(text, *pieces[mark])
    return out, a, b


def restored(output: Frames, form: str) -> Iterator[str]:
    """The original text in order, from the output and its form alone."""
    end = output.chars[-1] if output.chars else 0
    if form == PLAIN:
        yield from output.parts(0, end)
        return
    order = (PREFIX, SUFFIX, MIDDLE) if form == PSM else (SUFFIX, PREFIX, MIDDLE)
    starts, at = [], 0
    for mark in order:
        at = output.find(mark, at) + len(mark)
        starts.append(at)
    stops = [s - len(m) for s, m in zip(starts[1:], order[1:])] + [end]
    for mark in (PREFIX, MIDDLE, SUFFIX):
        k = order.index(mark)
        yield from output.parts(starts[k], stops[k])


def digest(parts: Iterable[str]) -> str:
    out = hashlib.sha256()
    for part in parts:
        out.update(part.encode())
    return out.hexdigest()


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that only their Python values live at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _pack(unit: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            held = [Frames.of(t or "", unit, size) for t in batch.column("text").to_pylist()]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array([f.count() for f in held], pa.int64()), pa.array([f.rows() for f in held], _FRAMES)],
                names=[*keep, "n", "frames"])

    return run


def _apply(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            form, first, second = (batch.column(c).to_pylist() for c in ("form", "first", "second"))
            out = []
            for k in range(batch.num_rows):
                made, a, b = transform(Frames(batch.column("frames")[k].as_py(), unit), form[k], first[k], second[k])
                cut = (None, None) if form[k] == PLAIN else (a, b - a)
                out.append((*cut, made.rows(), digest(made.parts(0, made.chars[-1] if made.chars else 0)), digest(restored(made, form[k]))))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), _FRAMES, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n"), batch.column("form"), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"])

    return run


def _text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["".join(restored(Frames(batch.column("output")[k].as_py()), form)) if back else "".join(map(made.text, range(len(made.data))))
                 for k, (form, back) in enumerate(zip(batch.column("form").to_pylist(), batch.column("back").to_pylist()))
                 for made in [Frames(batch.column("output")[k].as_py())]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def frame_texts(docs: DataFrame, unit: str = "line", id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME) -> DataFrame:
    """Texts as frames: ``doc_id, marked, n, frames``, one row per input row; ``n`` counts units, ``marked`` is
    true if the text holds one of the three marks. Null texts are empty and have no frame."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    text = F.col(text_col)
    marked = F.coalesce(text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), marked.alias("marked"), text.alias("text"))
    return rows.mapInArrow(_pack(unit, frame), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, marked boolean, n long, frames {FRAMES}")


def draws(seed: int, key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the digest of seed and key; a null key counts as an empty one."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line",
                   id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME) -> DataFrame:
    """Reorder texts for fill-in-middle training, one row per input row and without a shuffle.

    Returns ``doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256``. A text is cut into
    ``n`` lines or characters and after two drawn numbers of these; ``rate`` per cent of the texts are changed, ``spm`` per cent
    of these get the suffix first. ``output`` holds frames: whole frames of the text are taken over as they are, only frames
    with a cut are opened. Both digests stream over the output's frames; the second is of the text rebuilt from output and form.
    Null and empty texts are plain and have no frames, as are texts that hold a mark (these keep their frames). Draws
    depend on seed and id alone, so rows that repeat an id are cut by the same draws; a null id draws like an empty one. An empty
    table gives an empty result. A task holds one compressed text, one open frame and the batch.
    """
    rows = frame_texts(docs, unit, id_col, text_col, frame)
    h1, h2, h3, h4 = draws(seed, F.col("doc_id"))
    n = F.col("n") + 1
    form = (
        F.when((F.size("frames") == 0) | F.col("marked") | (h3 % 100 >= rate), PLAIN)
        .when(h4 % 100 < spm, SPM).otherwise(PSM)
    )
    cut = rows.select("doc_id", "n", "frames", form.alias("form"), F.least(h1 % n, h2 % n).alias("first"), F.greatest(h1 % n, h2 % n).alias("second"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return cut.mapInArrow(_apply(unit), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output {FRAMES}, "
                                        "output_sha256 string, restored_sha256 string")


def output_texts(transformed: DataFrame, restore: bool = False) -> DataFrame:
    """``doc_id, text`` of a result of ``fill_in_middle``: the outputs, or with ``restore`` the original texts."""
    rows = transformed.select("doc_id", "form", "output", F.lit(restore).alias("back"))
    return rows.mapInArrow(_text, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents")).drop("output")


SQL_OP11 = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || doc_id) AS h FROM documents
), r AS (
    SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
             WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r
), s AS (
    SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(p || m || s) AS restored_sha256
FROM s
"""
