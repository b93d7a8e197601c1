"""Token ids of many texts, with each distinct piece encoded once.

A tokeniser never joins characters across certain places of a text, so the ids of a text are those of the pieces
between such places, one after the other. Pieces recur: a bounded table, searched for all pieces of a batch at once,
saves most of the work. Its keys are the pieces' own bytes, so no two pieces are taken for each other.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from twinscope.llm.common import _KEPT, heads, packed

SLOTS = 1 << 20
ARENA = 6_000_000
#: Bytes of pieces above 16 bytes that are kept with their ids.
LONG_BYTES = 8_000_000


class PieceTable:
    """A direct-mapped table from a piece of at most 16 bytes to its ids; a slot holds the last piece that took it.
    Longer pieces are in a dict, which is emptied when it holds LONG_BYTES.

    learn: gives the ids of a list of strings, in any order of the strings: all ids, how many each string has, and
    which string that is.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], slots: int = SLOTS, arena: int = ARENA):
        self.learn, self.mask, self.most = learn, np.uint64(slots - 1), arena
        self.slots = slots
        self.clear()

    def clear(self) -> None:
        self.one, self.two = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.size = np.zeros(self.slots, np.uint8)  # 0 marks a free slot
        self.place, self.count = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.ids, self.used = np.zeros(1 << 20, np.uint16), 0
        self.long: dict[bytes, tuple[int, int]] = {}
        self.long_bytes = 0

    def _keep(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Learns strings: where the ids of each are now, and how many they are."""
        ids, counts, which = self.learn(new)
        if len(ids) and ids.max() >= 1 << (8 * self.ids.itemsize):
            self.ids = self.ids.astype(np.uint32)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), self.ids.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        first, many = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        first[which], many[which] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)
        return first, many

    def _long(self, data: bytes, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
        pieces = [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        new = [x for x in dict.fromkeys(pieces) if x not in self.long]
        first, counts = self._keep([x.decode("utf-8", "replace") for x in new])
        self.long.update(zip(new, zip(first.tolist(), counts.tolist(), strict=True), strict=True))
        self.long_bytes += sum(map(len, new))
        return [self.long[x] for x in pieces]

    def find(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces raw[start:end], one piece after the other, and how many each has."""
        if self.used > self.most or self.long_bytes > LONG_BYTES:
            self.clear()
        size = end - start
        one, two = heads(raw, start, size)
        slot = (one * np.uint64(0x9E3779B97F4A7C15) ^ (two + size.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40) & self.mask
        hit = (self.one[slot] == one) & (self.two[slot] == two) & (self.size[slot] == size)
        place, count = self.place[slot].astype(np.int64), self.count[slot].astype(np.int64)
        if not hit.all():
            data = raw.tobytes()
            long = np.flatnonzero(size > 16)
            if len(long):
                found = np.array(self._long(data, start[long], end[long]), np.int64)
                place[long], count[long] = found[:, 0], found[:, 1]
            miss = np.flatnonzero(~hit & (size <= 16))
            order = miss[np.lexsort((size[miss], two[miss], one[miss]))]
            new = np.ones(len(order), bool)
            new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]) | (size[order[1:]] != size[order[:-1]])
            chosen = order[new]
            places, counts = self._keep([data[a:b].decode("utf-8", "replace") for a, b in zip(start[chosen].tolist(), end[chosen].tolist(), strict=True)])
            which = np.cumsum(new) - 1
            place[order], count[order] = places[which], counts[which]
            s = slot[chosen]
            self.one[s], self.two[s], self.size[s], self.place[s], self.count[s] = one[chosen], two[chosen], size[chosen], places, counts
            # two new pieces may share a slot: the last one written owns all five fields, as numpy writes in order
        total = int(count.sum())
        ends = np.cumsum(count)
        at = np.repeat(place - (ends - count), count) + np.arange(total)
        return self.ids[at].astype(np.uint32), count


def _is_in(raw: np.ndarray, *ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table[raw]


class WordEncoder:
    """`ids(texts)`: the ids that the `tokenizers` library gives, one text after the other, and each text's count.

    kind "byte": byte-level BPE where a word's space belongs to it. kind "word": lower-casing BPE with word ends.
    A null text has no ids. Strings of special tokens in a text are what the library makes of them; texts that hold one
    are encoded by the library whole.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.kind, self.table = Tokenizer.from_file(path), kind, PieceTable(self.learn)
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if kind == "byte" else t.endswith("</w>"))]] = True

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Plain words are encoded many at a time, as one text, and its ids cut at word edges where these are as many."""
        spaced = self.kind == "byte"
        glue = "" if spaced else " "
        plain, rest = [], []
        for i, w in enumerate(new):
            (plain if (w[0] == " " and w[1:].isalpha() if spaced else w.isalpha()) else rest).append(i)
        groups = [plain[k : k + 200] for k in range(0, len(plain), 200)]
        ids, counts, which = [], [], []
        for group, e in zip(groups, self.library.encode_batch_fast([glue.join(new[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            found = np.array(e.ids, np.uint32)
            edges = np.flatnonzero(self.edge[found])
            if len(edges) != len(group):
                rest += group
                continue
            ids.append(found)
            counts.append(np.diff(np.append(edges, len(found)) if spaced else np.append(-1, edges)))
            which += group
        for i, e in zip(rest, self.library.encode_batch_fast([new[i] for i in rest], add_special_tokens=False), strict=True):
            ids.append(np.array(e.ids, np.uint32))
            counts.append(np.array([len(e.ids)]))
            which.append(i)
        if not which:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(counts).astype(np.int64), np.array(which)

    def cuts(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of pieces."""
        n = len(raw)
        cut = np.zeros(n + 1, bool)
        cut[starts] = True
        near = np.zeros(n + 3, np.uint8)  # near[i + 2] is byte i; 0 is outside of every text
        near[2:-1] = raw
        before, before2, after = near[1:-2], near[:-3], near[3:]
        word = _is_in(before, (48, 57), (65, 90), (97, 122)) | (before >= 128) & (before2 == 0xC3) & (before != 0x97) & (before != 0xB7)
        cut[:-1] |= ((raw == 44) | (raw == 46)) & word
        if self.kind == "word":
            white = (raw == 32) | ((raw >= 9) & (raw <= 13))
            cut[:-1] |= white
            cut[1:] |= white
            at = np.flatnonzero(cut)
            a, b = at[:-1], at[1:]
            some = ~white[a]
            return a[some], b[some]
        seen = _is_in(after, (0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xF4))
        seen[starts[(starts > 0) & (starts <= n)] - 1] = False  # the next byte is another text's
        cut[:-1] |= (raw == 32) & seen
        line = np.flatnonzero((raw == 10) & seen)
        line = line[(_is_in(before[line], (0x21, 0x7E)) | word[line])]
        cut[line] = True
        cut[line + 1] = True
        at = np.flatnonzero(cut)
        return at[:-1], at[1:]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = np.zeros(len(texts), bool)
        for x in self.special:  # a lower-cased piece could be one too
            marked |= pc.fill_null(pc.match_substring(texts, x, ignore_case=True), False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._pieces(texts)
        ids, count = self._pieces(pc.if_else(pa.array(marked), pa.scalar("", texts.type), texts))
        parts = np.split(ids, np.cumsum(count)[:-1])
        for i in np.flatnonzero(marked).tolist():
            parts[i] = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            count[i] = len(parts[i])
        return np.concatenate(parts), count

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, starts = packed(texts)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if self.kind == "word":
            lower = np.arange(256, dtype=np.uint8)
            lower[65:91] += 32
            raw = lower[raw]
        a, b = self.cuts(raw, starts)
        ids, count = self.table.find(raw, a, b)
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(ends[np.searchsorted(a, starts)])


@lru_cache(2)
def encoder(path: str, kind: str) -> WordEncoder:
    _KEPT.append(encoder.cache_clear)
    return WordEncoder(path, kind)
