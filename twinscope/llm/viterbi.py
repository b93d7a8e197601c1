"""SentencePiece encoding and decoding with a streaming Viterbi search.

The best segmentation is the one whose pieces' scores add up to most. The search keeps a window of back pointers as
wide as the longest piece. Whenever all paths that survive in the window go through one boundary, the ids before it
are certain: they are committed and their part of the window is dropped, so memory doesn't grow with the text.

A boundary that no piece of the vocabulary can cross (before a space mark after another character) is such a place
for every text. Runs between these are searched once and kept in a bounded table.

Null and empty texts have no ids, which decode to an empty text. Characters outside the vocabulary fall back to byte
pieces. Scores are those of the model file. Ties go to the longest last piece. Repeated rows and doc_ids, null ones
too, give a row each. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.llm.common import _KEPT, packed, slices, tidy
from twinscope.llm.words import PieceTable

MARK = "▁"
#: The library's penalty of a character outside the vocabulary, below the lowest score.
UNKNOWN = 10.0


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown_id, self.unknown = model.unk_id(), min(model.get_score(i) for i in normal) - UNKNOWN
        self.longest = max(len(self.pieces[i]) for i in normal)
        #: A piece's (score, id), or None for what only begins pieces.
        self.known: dict[str, tuple[float, int] | None] = {}
        for i in normal:
            for k in range(1, len(self.pieces[i])):
                self.known.setdefault(self.pieces[i][:k], None)
        for i in normal:
            self.known[self.pieces[i]] = (model.get_score(i), i)
        self.splits = not any(a != MARK and b == MARK for i in normal for a, b in zip(self.pieces[i], self.pieces[i][1:], strict=False))
        self.raw = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        for i in range(size):
            if model.is_control(i):
                self.raw[i] = b""

    def of_unknown(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown_id]


def stream(vocabulary: Vocabulary, chars: Iterator[str]) -> Iterator[list[int]]:
    """Yields ids as soon as they are certain. chars: parts of a text with space marks, of any sizes."""
    known, longest = vocabulary.known, vocabulary.longest
    text, best, back = "", [0.0], [(-1, 0)]  # of the window: characters, best scores, (start, id) of the last piece
    done, ended = 0, False  # characters of the window whose pieces have been tried
    while True:
        while not ended and len(text) - done <= longest:  # a piece may need that many more characters
            part = next(chars, None)
            ended = part is None
            text += part or ""
        n = len(text)
        if done == n:
            break
        lowest = -float("inf")
        best += [lowest] * (n + 1 - len(best))
        back += [(-1, 0)] * (n + 1 - len(back))
        until = n if ended else n - longest
        for s in range(done, until):
            here = best[s]
            single = known.get(text[s])
            for e in range(s + 1, min(n, s + longest) + 1):
                found = known.get(text[s:e], 0)
                if found:
                    score = here + found[0]
                    if score > best[e]:
                        best[e], back[e] = score, (s, found[1])
                elif found == 0:
                    break
            if not single and here + vocabulary.unknown > best[s + 1]:
                best[s + 1], back[s + 1] = here + vocabulary.unknown, (s, -1)
        done = until
        # paths end at `done` or later; follow them back until they meet
        alive = {e for e in range(done, min(n, done + longest) + 1) if best[e] > lowest and (back[e][0] < done or e == done)} if not ended else {n}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(back[last][0])
        meet = alive.pop()
        if meet > 0:
            ids: list[int] = []
            e = meet
            while e > 0:
                s, i = back[e]
                ids += [i] if i >= 0 else vocabulary.of_unknown(text[s:e])[::-1]
                e = s
            yield ids[::-1]
            base = best[meet]
            text, best, back = text[meet:], [x - base for x in best[meet:]], [(s - meet, i) for s, i in back[meet:]]
            done -= meet
            if ended:
                break


def search(vocabulary: Vocabulary, text: str) -> list[int]:
    return [i for ids in stream(vocabulary, iter((text,))) for i in ids]


class Encoder:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.table = PieceTable(self.learn)

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [self.encode_run(x) for x in new]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64), np.arange(len(new))

    def encode_run(self, run: str) -> list[int]:
        step = 1 << 14
        return [i for ids in stream(self.vocabulary, (run[k : k + step] for k in range(0, len(run), step))) for i in ids]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts.to_pylist()]
        raw, starts = packed(pa.array(marked, pa.large_string()))
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cut = np.zeros(len(raw) + 1, bool)
        cut[starts] = True
        if self.vocabulary.splits:  # the mark is three bytes, E2 96 81
            mark = np.zeros(len(raw) + 3, bool)
            mark[3:-2] = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
            cut[:-1] |= mark[3:] & ~mark[:-3]
        at = np.flatnonzero(cut)
        ids, count = self.table.find(raw, at[:-1], at[1:])
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(ends[np.searchsorted(at, starts)])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    _KEPT.append(encoder.cache_clear)
    return Encoder(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids (little-endian unsigned 32-bit) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            for part in slices(batch):
                ids, counts = enc.ids(part.column("text"))
                data, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
                blobs = [data[a:b] for a, b in zip((ends - 4 * counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n_ids", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, keeps=True), "doc_id long, n_ids long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and the text of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            texts = [None if x is None else enc.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run, keeps=True), "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Per document: the number and crc32 of its ids, and whether decoding them gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            for part in slices(batch):
                ids, counts = enc.ids(part.column("text"))
                ends = np.cumsum(counts)
                rows = []
                for text, a, b in zip(part.column("text").to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    own = ids[a:b]
                    rows.append((zlib.crc32(own.astype("<u4").tobytes()), enc.decode(own) == (text or "").replace(MARK, " ")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "same_text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, keeps=True), "doc_id long, n_ids long, ids_crc32 long, same_text boolean")
