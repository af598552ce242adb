"""SentencePiece encoding and decoding over distinct marked words in trie order."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 1_000_000  # words a Python worker remembers between batches, some 200 MB


class Vocabulary:
    """Pieces of a SentencePiece model, read once on the driver; a few megabytes that go to every task.

    Only models without text normalisation beyond the marking of spaces are taken, with a dummy prefix and
    byte fallback; ``kind`` is "bpe" or "unigram".
    """

    def __init__(self, pieces: dict[str, int], scores: dict[str, float], byte_ids: list[int], kind: str):
        self.pieces, self.scores, self.byte_ids, self.kind = pieces, scores, byte_ids, kind
        self.text = {i: p.replace(MARK, " ").encode() for p, i in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece holds a space after another character; words cannot be encoded apart")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores, byte_ids = {}, {}, [-1] * 256
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                pieces[p], scores[p] = i, model.get_score(i)
        if min(byte_ids) < 0 or model.encode("ﬁ  ① ", out_type=str)[-1] != MARK:
            raise ValueError("the model must fall back to bytes and leave texts as they are")
        # the two kinds split a word of three letters differently unless merges decide; the file itself names its kind
        with open(path, "rb") as f:
            kind = _model_kind(f.read())
        return cls(pieces, scores, byte_ids, kind)


def _model_kind(raw: bytes) -> str:
    """The model type from the trainer settings of a model file (field 2, there field 3; 1 unigram, 2 bpe)."""
    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            n = shift = 0
            while True:
                b = data[at]
                at += 1
                n |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return n

        while at < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                size = number() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
                yield tag >> 3, data[at:at + size]
                at += size

    settings = next((v for k, v in fields(raw) if k == 2), b"")
    kind = next((v for k, v in fields(settings) if k == 3), 1)
    if kind not in (1, 2):
        raise ValueError("only unigram and bpe models can be used")
    return {1: "unigram", 2: "bpe"}[kind]


class Forward:
    """Forward pass over words in sorted order; the states of a common prefix are kept from the word before.

    The state of a prefix is the last piece of its best segmentation and where that piece starts. For a unigram
    model the best one has the highest sum of scores. For a merge model it is the segmentation that the merges give: every prefix that ends
    at a piece border is encoded by the same pieces as in the word, and a list of pieces is what merging gives
    exactly if each piece merges to itself and each neighbouring pair merges to the pair. So one
    admissible last piece exists per prefix and the same left-to-right pass finds it.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.tails = {p[k:] for p in vocabulary.pieces for k in range(len(p))}
        self.letters = {p for p in vocabulary.pieces if len(p) == 1}
        self.merged: dict[tuple[str, str], bool] = {}
        self.unknown = min(vocabulary.scores.values(), default=0.0) - 10.0

    def merge(self, word: str) -> list[str]:
        """Merge the best scored neighbours, the leftmost of equals, until no two make a piece."""
        scores, parts = self.v.scores, list(word)
        none = float("-inf")
        gains = [scores.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while gains:
            best = max(gains)
            if best == none:
                break
            k = gains.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del gains[k]
            if k < len(gains):
                gains[k] = scores.get(parts[k] + parts[k + 1], none)
            if k:
                gains[k - 1] = scores.get(parts[k - 1] + parts[k], none)
        return parts

    def admits(self, a: str, b: str) -> bool:
        found = self.merged.get((a, b))
        if found is None:
            if len(self.merged) > 2_000_000:  # a cache only
                self.merged.clear()
            found = self.merged[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return found

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each word as packed 32-bit integers; ``words`` are distinct."""
        out, letters, pieces, bpe = {}, self.letters, self.v.pieces, self.v.kind == "bpe"
        step = self._merge_step if bpe else self._score_step
        before, last, back, total = "", [""], [0], [0.0]
        for word in sorted(words):
            k = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                k += 1
            del last[k + 1:], back[k + 1:], total[k + 1:]
            for i in range(k + 1, len(word) + 1):
                if word[i - 1] not in letters:  # no piece holds it: bytes, and a border on both sides
                    last.append("")
                    back.append(i - 1)
                    total.append(total[-1] + self.unknown)
                else:
                    step(word, i, last, back, total)
            before = word
            ids: list[int] = []
            i = len(word)
            while i:
                if last[i]:
                    ids.append(pieces[last[i]])
                else:
                    ids += [self.v.byte_ids[b] for b in reversed(word[i - 1].encode())]
                i = back[i]
            out[word] = np.array(ids[::-1], dtype=np.int32).tobytes()
        return out

    def _merge_step(self, word: str, i: int, last: list, back: list, total: list) -> None:
        tails, pieces, merged = self.tails, self.v.pieces, self.merged
        for s in range(i - 1, -1, -1):
            p = word[s:i]
            if p not in tails:
                break
            if p in pieces:
                key = (last[s], p)
                ok = merged.get(key)
                if (self.admits(*key) if ok is None else ok):
                    if last[s] and not self.admits("", p):
                        continue
                    last.append(p)
                    back.append(s)
                    total.append(0.0)
                    return
        raise AssertionError(f"no segmentation of {word[:i]!r}")

    def _score_step(self, word: str, i: int, last: list, back: list, total: list) -> None:
        best = None
        for s in range(i - 1, -1, -1):
            p = word[s:i]
            if p not in self.tails:
                break
            if p in self.v.pieces and (best is None or total[s] + self.v.scores[p] > best[0]):
                best = (total[s] + self.v.scores[p], p, s)
        total.append(best[0])
        last.append(best[1])
        back.append(best[2])


# a run of marks with the word behind it; control characters are no part of any piece and stand alone
_WORDS = re.compile(f"{MARK}*[^{MARK}\x00-\x1f]+|{MARK}+|[\x00-\x1f]")


def marked_words(text: str | None) -> list[str]:
    """A text with marks for spaces and one in front, cut where no piece crosses; joined they give it back."""
    return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


_workers: dict[int, tuple[Forward, dict[str, bytes]]] = {}  # what this process has learnt about a vocabulary


def _encode(vocabulary: Vocabulary, decode_check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(repr((vocabulary.kind, sorted(vocabulary.scores.items()))).encode())
        forward, known = _workers.setdefault(key, (Forward(vocabulary), {}))
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                texts = batch.column("text").to_pylist()
                rows = [marked_words(t) for t in texts]
                new = {w for r in rows for w in r if w not in known}
                if len(known) > CACHE:
                    known.clear()
                    new = {w for r in rows for w in r}
                known.update(forward.encode(new))
                packed = [b"".join([known[w] for w in r]) for r in rows]
                ids = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)),
                    pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))
                columns = [batch.column("doc_id"), ids]
                if decode_check:
                    columns.append(pa.array([decode(vocabulary, np.frombuffer(p, dtype=np.int32)) == (t or "").replace(MARK, " ") for p, t in zip(packed, texts)]))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "round_trip"][:len(columns)])

    return run


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    """The text of a list of ids; bytes that are no UTF-8 become replacement characters, unknown ids nothing."""
    text = vocabulary.text
    raw = b"".join([text.get(i, b"") for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _decode(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else decode(vocabulary, i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """Ids of every text: ``doc_id, ids`` (and ``round_trip`` with ``check``), one row per input row, without a shuffle.

    The distinct marked words of some thousand texts are sorted, so words with a common prefix follow each other, and one forward pass
    walks them as a trie. A null or empty text has no ids. A text of any length is encoded whole.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encode(vocabulary, check), f"doc_id {kind}, ids array<int>" + ", round_trip boolean" * check)


def decode_texts(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id lists: ``doc_id, text``; null lists stay null."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(_decode(vocabulary), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    encoded = encode_texts(table(spark, sf_dir, "documents"), Vocabulary.load(model), check=True)
    return encoded.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "round_trip")
