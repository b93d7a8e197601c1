"""Suffix-array dedup: bytes covered by strings of `size` bytes that start in two places or more are removed.

1. Each window of `size` bytes belongs to an anchor, the leftmost of its 32-byte grams with the smallest hash. Equal
   windows have equal anchors, so only windows of anchors that occur twice can repeat; the rest of the text is left out.
2. Copies are dealt to shards as whole documents and passages of other documents one by one, by an anchor that they
   share, so that equals meet; shards are of bounded size, and what is too large for one is dealt to several. Each shard's suffix array is refined by doubling (Larsson-Sadakane),
   Kasai's common prefixes give the windows that repeat in the shard.
3. Of anchors that other shards have too, windows that don't repeat in the shard, and one of each class of those that
   do, go on as runs of text, dealt by the half of their bytes that lies around the anchor. What meets there is merged:
   each shard's windows are sorted by their bytes and sought in those of other shards by binary search.
4. Repeating windows are united to spans, and removed from the whole texts.

Texts are UTF-8 bytes, null is empty; matches don't cross documents. Each row is a document, also where doc_ids repeat
or are null: rows of equal texts (known by a 64-bit hash) are copies of each other and go whole, from `size` bytes on;
against others one of them stands for all. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.llm.common import Bloom, RollingHash, dropped, member, packed, run_hashes, slices, stored, tidy, tidy_groups

GRAM = 32
CHUNK = 1 << 20
SHARD = 400_000
PIECE = 200_000
#: A document is dealt by an anchor of so few occurrences, if it has one: passages of many documents come after copies.
RARE = 50
#: Rows of a key, or of many keys, whose windows are merged at once; a key with more is merged window place by window
#: place, which holds one window of each row at a time.
MEET = 256
#: An anchor with more than this share of all occurrences is joined by broadcast; there are fewer than its inverse.
HOT_SHARE = 0.001


def anchors_of(raw: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """hash, first window, last window and gram (places in raw) of every anchor."""
    out = []
    w = size - GRAM + 1
    for base in range(0, len(raw), CHUNK):
        part = raw[base : base + CHUNK + size - 1]
        if len(part) < size:
            break
        grams = RollingHash(part).of(np.arange(len(part) - GRAM + 1), GRAM)
        value = grams & ~np.uint64((1 << 24) - 1) | np.arange(len(grams), dtype=np.uint64)
        blocks = np.full(-(-len(grams) // w) * w, np.uint64(2**64 - 1))
        blocks[: len(grams)] = value
        blocks = blocks.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        n = len(part) - size + 1
        at = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        row = np.searchsorted(starts, base + np.arange(n), side="right")
        inside = base + np.arange(n) + size <= starts[np.minimum(row, len(starts) - 1)]
        first = np.ones(n, bool)
        first[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], n)
        good = inside[begin]
        # windows of a document end where the next one begins; the run may go on over places that are no windows
        begin, end = begin[good], end[good]
        limit = starts[row[begin]] - size + 1 - base
        out.append((grams[at[begin]], base + begin, base + np.minimum(end, limit) - 1, base + at[begin]))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchors(docs: DataFrame, size: int) -> DataFrame:
    """h, rid, lo, hi, g: the windows that start at lo to hi of a row's text have the anchor h, whose gram is at g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, starts = packed(part.column("text"))
                h, lo, hi, g = anchors_of(raw, starts, size)
                row = np.searchsorted(starts, lo, side="right") - 1
                rid = part.column("rid").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rid), pa.array((lo - starts[row]).astype(np.int64)), pa.array((hi - starts[row]).astype(np.int64)), pa.array((g - starts[row]).astype(np.int64))], names=["h", "rid", "lo", "hi", "g"])

    return docs.select("rid", "text").mapInArrow(tidy(run), "h long, rid long, lo long, hi long, g long")


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Suffixes sorted by their first `depth` bytes at least, marks of those that differ there from the one before, the
    text's 8-byte words, marks of those that differ in their first `sure` bytes already, and `sure`. Zeros follow the
    text."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words |= padded[k : k + n] << np.uint64(8 * (7 - k))
    order = np.argsort(words)
    new = np.append(True, words[order[1:]] != words[order[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n, np.int64)
    rank[order] = group
    h = sure = 8
    early = new
    while h < depth:
        early, sure = new.copy(), h
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        at = order[open_]
        after = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        new[open_] = np.append(True, key[1:] != key[:-1])
        rank[at] = np.maximum.accumulate(np.where(new[open_], open_, 0))
        h *= 2
    return order, new, words, early, sure


def common_prefixes(order: np.ndarray, new: np.ndarray, words: np.ndarray, most: int, early: np.ndarray, sure: int, lane: int = 256) -> np.ndarray:
    """Kasai's common prefixes of neighbours in the order, up to `most`; each lane of places goes on its own. Where the
    first `sure` bytes differ, 0; elsewhere these are known to be shared, whatever the place before says.

    Neighbours that the sorting left together share `most` at least. Nothing carries over from these to the next place,
    as their own order says nothing of it.
    """
    n = len(order)
    tied = np.zeros(n + 1, bool)
    tied[order] = ~new
    far = np.zeros(n + 1, bool)
    far[order] = early
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    long = np.zeros(n, np.int64)
    at = np.arange(0, n, lane)
    have = np.zeros(len(at), np.int64)
    pad = np.append(words, np.zeros(most + 9, np.uint64))
    for _ in range(lane):
        other = before[at]
        have = np.where((other < 0) | far[at], 0, np.maximum(have, min(sure, most)))
        grow = np.flatnonzero((other >= 0) & ~tied[at] & ~far[at])
        while len(grow):
            x = pad[at[grow] + have[grow]] ^ pad[other[grow] + have[grow]]
            same = x == 0
            more = np.full(len(grow), 8)
            some = x[~same]
            # whole bytes above the highest bit that differs
            more[~same] = 7 - np.searchsorted(_EDGES, some, side="right")
            have[grow] = np.minimum(have[grow] + more, most)
            grow = grow[same & (have[grow] < most)]
        have = np.minimum(have, n - np.maximum(at, other))
        long[at] = np.where(tied[at], most, have)
        have[tied[at]] = 0
        at, have = at + 1, np.maximum(have - 1, 0)
        if at[-1] >= n:
            at, have = at[:-1], have[:-1]
        if not len(at):
            break
    return long[order]


_EDGES = np.array([1 << (8 * k) for k in range(1, 8)], np.uint64)


def repeating(text: np.ndarray, valid: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the valid places whose first `size` bytes start at another valid place too, and the class of each place."""
    order, new, words, early, sure = suffix_array(text, size)
    group = np.cumsum(common_prefixes(order, new, words, size, early, sure) < size)
    fine = valid[order]
    many = np.bincount(group[fine], minlength=int(group[-1]) + 1 if len(group) else 0) > 1
    out = np.zeros(len(text), bool)
    out[order[fine & many[group]]] = True
    of = np.zeros(len(text), np.int64)
    of[order] = group
    return out, of


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _covered(lo: np.ndarray, hi: np.ndarray, size: int) -> int:
    """Bytes that windows from lo to hi cover; lo ascends."""
    end = hi + size
    before = np.append(0, np.maximum.accumulate(end)[:-1])
    return int(np.maximum(0, end - np.maximum(lo, before)).sum())


def apart(rows: DataFrame, repeats: Bloom) -> tuple[DataFrame, DataFrame]:
    """rows whose rid is not among the repeats, and the others with a few more."""
    hit = member(rows.sparkSession, repeats)
    marked = rows.withColumn("again", hit(F.xxhash64("rid")))
    return marked.where("not again").drop("again"), marked.where("again").drop("again")


def segments(docs: DataFrame, twice: DataFrame, size: int, repeats: Bloom | None = None) -> DataFrame:
    """The parts of texts that windows of repeated anchors cover: route, rid, start, body, and the anchors' h, lo, hi, g.
    Of rows with one rid, which are among the repeats, one is read."""
    of_rows = twice.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi", "h", "c", "g")).alias("a"))
    picked = docs.sparkSession.sparkContext.broadcast(Bloom.of(twice.select("rid").distinct().select(F.xxhash64("rid").alias("h"))))
    copies = None if repeats is None else docs.sparkSession.sparkContext.broadcast(repeats)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of the repeats, a task gives each once
        for batch in batches:
            batch = batch.filter(pa.array(picked.value.has(batch.column("bit").to_numpy())))
            again = np.zeros(batch.num_rows, bool) if copies is None else copies.value.has(batch.column("bit").to_numpy())
            fresh = np.ones(batch.num_rows, bool)
            for i, rid in zip(np.flatnonzero(again).tolist(), batch.column("rid").to_numpy()[again].tolist(), strict=True):
                fresh[i] = rid not in seen
                seen.add(rid)
            batch, again = batch.filter(pa.array(fresh)), again[fresh]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("text"), pa.array(again)], names=["rid", "text", "again"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, text, found in zip(batch.column("rid").to_pylist(), batch.column("text"), batch.column("a"), strict=True):
                body = text.as_buffer()
                a = found.values
                lo, hi, h, c, g = (a.field(k).to_numpy() for k in range(5))
                by = np.argsort(lo, kind="stable")
                lo, hi, h, c, g = lo[by], hi[by], h[by], c[by], g[by]
                rare = c <= RARE
                covered = _covered(lo, hi, size)
                whole_ = int(h[rare].min()) if rare.any() and 2 * covered >= len(body) else None
                begin = np.append(True, (lo[1:] > np.maximum.accumulate(hi)[:-1] + size) | (lo[1:] // PIECE != lo[:-1] // PIECE))
                at = np.append(np.flatnonzero(begin), len(lo))
                for x, y in zip(at, at[1:], strict=False):
                    start, end = int(lo[x]), int(hi[x:y].max()) + size
                    route = int(h[x:y].min()) if whole_ is None else whole_
                    out.append((route, rid, start, bytes(body[start:end]), h[x:y].tolist(), c[x:y].tolist(), (lo[x:y] - start).tolist(), (hi[x:y] - start).tolist(), (g[x:y] - start).tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip(_SEGMENT.names, x, strict=True)) for x in out], schema=_SEGMENT)

    texts = docs.select("rid", "text", F.xxhash64("rid").alias("bit")).mapInArrow(tidy(pick), "rid long, text string, again boolean")
    if repeats is not None:
        texts = texts.where("not again").select("rid", "text").union(texts.where("again").groupBy("rid").agg(F.first("text").alias("text")))
    return texts.select("rid", "text").join(of_rows, "rid").mapInArrow(tidy(cut), "route long, rid long, start long, body binary, h array<long>, c array<long>, lo array<long>, hi array<long>, g array<long>")


_LONGS = pa.list_(pa.int64())
_SEGMENT = pa.schema([("route", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("body", pa.binary()), ("h", _LONGS), ("c", _LONGS), ("lo", _LONGS), ("hi", _LONGS), ("g", _LONGS)])


def dealt(parts: DataFrame) -> DataFrame:
    """parts with a shard: by route, and by row too where a route has more than a shard holds."""
    sizes = parts.groupBy("route").agg(F.sum(F.length("body")).alias("bytes"))
    large = sizes.where(F.col("bytes") > SHARD // 2).withColumn("into", F.ceil(2 * F.col("bytes") / SHARD).cast("int")).select("route", "into")
    total = parts.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).head()[0]
    n = total // SHARD + 1
    alone = F.pmod(F.xxhash64("route"), F.lit(n))
    spread = n + F.pmod(F.xxhash64("route", F.pmod(F.xxhash64("rid", "start"), F.col("into"))), F.lit(1 << 40))
    return parts.join(large, "route", "left").withColumn("shard", F.when(F.col("into").isNull(), alone).otherwise(spread)).drop("into")


def in_shards(parts: DataFrame, size: int) -> DataFrame:
    """kind 0: rid and a span (a to b) of repeating windows. kind 1: windows that another shard may have: rid, where the
    first begins, the key that equal windows share, the shard, the bytes of the first before the key's, and all bytes; no
    window is given twice by a shard."""
    half = (size - GRAM) // 2

    def run(part: pd.DataFrame) -> pd.DataFrame:
        text, base, valid = _laid(part)
        marks, group = repeating(text, valid, size)
        rid, start = part["rid"].to_numpy(), part["start"].to_numpy()
        x, y = _runs(marks)  # a run ends in its part, as the last window of a part ends inside of it
        owner = np.searchsorted(base, x, side="right") - 1
        shift = start[owner] - base[owner]
        spans = pd.DataFrame({"kind": 0, "rid": rid[owner], "a": x + shift, "b": y - 1 + size + shift, "shard": 0, "before": 0, "body": None})
        h, c = (np.concatenate(part[k].to_list()) for k in ("h", "c"))
        lo, hi, g = (np.concatenate([np.asarray(v) + b for v, b in zip(part[k], base, strict=False)]) for k in ("lo", "hi", "g"))
        _, back, here = np.unique(h, return_inverse=True, return_counts=True)
        shared = here[back] < c
        lo, hi, g = lo[shared], hi[shared], g[shared]
        # a window holds the half before its gram, or the half after it
        lo, hi, begin = np.append(lo, np.maximum(lo, g - half + 1)), np.append(np.minimum(hi, g - half), hi), np.append(g - half, g)
        length = np.repeat([half + GRAM, size - half], len(g))
        some = np.flatnonzero(lo <= hi)
        some = some[np.argsort(lo[some])]
        lo, hi, begin, length = lo[some], hi[some], begin[some], length[some]
        count = hi - lo + 1
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        of = np.repeat(np.arange(len(lo)), count)
        again = np.flatnonzero(marks[at])
        _, one = np.unique(group[at[again]], return_index=True)
        chosen = ~marks[at]
        chosen[again[one]] = True
        at, of = at[chosen], of[chosen]
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1]))) if len(at) else np.zeros(0, np.int64)
        s, e, of = at[first], at[np.append(first[1:], len(at))[: len(first)] - 1] + size, of[first]
        key = run_hashes(text, begin[of], length[of]).view(np.int64)
        owner = np.searchsorted(base, s, side="right") - 1
        data = text.tobytes()
        far = pd.DataFrame({"kind": 1, "rid": rid[owner], "a": s - base[owner] + start[owner], "b": key, "shard": int(part["shard"].iloc[0]), "before": begin[of] - s, "body": [data[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)]})
        return pd.concat([x for x in (spans, far) if len(x)]) if len(spans) + len(far) else spans

    return parts.groupBy("shard").applyInPandas(tidy_groups(run), "kind int, rid long, a long, b long, shard long, before int, body binary")


def _laid(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts' bytes one after the other, the bounds, and marks of the places where windows start."""
    bodies = part["body"].to_list()
    base = np.append(0, np.cumsum([len(x) for x in bodies])).astype(np.int64)
    text = np.frombuffer(b"".join(bodies), np.uint8)
    step = np.zeros(len(text) + 1, np.int32)
    for lo, hi, b in zip(part["lo"], part["hi"], base, strict=False):
        np.add.at(step, np.asarray(lo) + b, 1)
        np.add.at(step, np.asarray(hi) + b + 1, -1)
    return text, base, np.cumsum(step[:-1]) > 0


class Windows:
    """Windows sorted by their bytes, each once, with the row and place of one that has them."""

    def __init__(self, body: np.ndarray, rid: np.ndarray, at: np.ndarray, hit: np.ndarray):
        self.body, self.rid, self.at, self.hit = body, rid, at, hit

    @classmethod
    def of(cls, bodies: list[bytes], rid: np.ndarray, at: np.ndarray, size: int) -> Windows:
        sizes = np.array([len(x) for x in bodies], np.int64)
        base, count = np.cumsum(sizes) - sizes, sizes - size + 1
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        raw = np.frombuffer(b"".join(bodies), np.uint8)
        found = np.lib.stride_tricks.sliding_window_view(raw, size)[np.repeat(base, count) + step].view(f"S{size}").ravel()
        order = np.argsort(found, kind="stable")
        return cls(found[order], np.repeat(rid, count)[order], (np.repeat(at, count) + step)[order], np.zeros(len(order), bool))

    def merged(self, other: Windows, out: list[tuple[np.ndarray, np.ndarray]]) -> Windows:
        """Both as one. Each window of other is sought here by binary search; what is found is given to out, once."""
        place = np.searchsorted(self.body, other.body)
        inside = np.minimum(place, len(self.body) - 1)
        same = (place < len(self.body)) & (self.body[inside] == other.body)
        mine = np.unique(inside[same])
        mine = mine[~self.hit[mine]]
        fresh = same & ~other.hit
        out += [(self.rid[mine], self.at[mine]), (other.rid[fresh], other.at[fresh])]
        self.hit[mine] = True
        new = ~same
        return Windows(*(np.insert(getattr(self, k), place[new], getattr(other, k)[new]) for k in ("body", "rid", "at", "hit")))


def _spans(out: list[tuple[np.ndarray, np.ndarray]], size: int) -> pa.RecordBatch:
    """Runs of windows as spans."""
    rid, at = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((at, rid))
    rid, at = rid[order], at[order]
    first = np.flatnonzero(np.append(True, (rid[1:] != rid[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return pa.RecordBatch.from_arrays([pa.array(rid[first]), pa.array(at[first]), pa.array(at[last] + size)], names=["rid", "s", "e"])


def across_shards(found: DataFrame, size: int) -> DataFrame:
    """rid and spans of windows that repeat in another shard than their own."""

    def united_runs(runs: list[Windows], out: list) -> None:
        while len(runs) > 1:
            runs = [runs[i].merged(runs[i + 1], out) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]

    def meet(rows: list[pa.RecordBatch], out: list) -> None:
        """rows: of whole keys."""
        part = pa.Table.from_batches(rows)
        key, rid, at, shard = (part.column(c).to_numpy() for c in ("b", "rid", "a", "shard"))
        change = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(change, len(key)))
        some = np.flatnonzero(np.repeat(sizes, sizes) > 1)
        some = some[np.argsort(shard[some], kind="stable")]
        if not len(some):
            return
        cuts = np.flatnonzero(np.diff(shard[some])) + 1
        bodies = part.column("body").take(pa.array(some)).to_pylist()
        united_runs([Windows.of(bodies[x[0] : x[-1] + 1], rid[some[x]], at[some[x]], size) for x in np.split(np.arange(len(some)), cuts)], out)

    def meet_by_place(rows: list[pa.RecordBatch], out: list) -> None:
        """rows: of one key. Equal windows have equally many bytes before the key's."""
        part = pa.Table.from_batches(rows)
        part = part.take(np.argsort(part.column("shard").to_numpy(), kind="stable"))
        rid, at, shard, before = (part.column(c).to_numpy() for c in ("rid", "a", "shard", "before"))
        bodies = part.column("body").to_pylist()
        many = np.array([len(x) for x in bodies], np.int64) - size + 1
        for place in range(int((before - many).min()) + 1, int(before.max()) + 1):
            on = np.flatnonzero((place <= before) & (place > before - many))
            if len(on) < 2:
                continue
            step = before[on] - place
            cuts = np.flatnonzero(np.diff(shard[on])) + 1
            parts = [[bodies[i][k : k + size] for i, k in zip(on[x].tolist(), step[x].tolist(), strict=True)] for x in np.split(np.arange(len(on)), cuts)]
            ends = np.append(0, np.append(cuts, len(on)))
            united_runs([Windows.of(w, rid[on[x:y]], (at[on] + step)[x:y], size) for w, x, y in zip(parts, ends, ends[1:], strict=False)], out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # of whole keys
        for group in keyed(batches):
            if sum(b.num_rows for b in group) > MEET:
                out: list[tuple[np.ndarray, np.ndarray]] = []
                meet_by_place(group, out)
                yield _spans(out, size)
                continue
            kept += group
            if sum(b.num_rows for b in kept) >= MEET:
                out = []
                meet(kept, out)
                yield _spans(out, size)
                kept = []
        if kept:
            out = []
            meet(kept, out)
            yield _spans(out, size)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        """The rows of each key of two rows or more."""
        group: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = batch.column("b").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else [0]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if group and key[s] != last:
                    if sum(b.num_rows for b in group) > 1:
                        yield group
                    group = []
                group.append(batch.slice(s, e - s))
                last = key[s]
        if sum(b.num_rows for b in group) > 1:
            yield group

    windows = found.where("kind = 1").select("b", "rid", "a", "shard", "before", "body")
    return windows.repartition("b").sortWithinPartitions("b").mapInArrow(tidy(merge), "rid long, s long, e long")


def counted(found: DataFrame) -> DataFrame:
    """found with c, the occurrences of the anchor, where these are two or more. Very common anchors are not dealt by their hash."""
    counts = stored(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "anchor-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).head()[0]
    hot = counts.where(F.col("c") > max(1000, int(HOT_SHARE * total)))
    if hot.isEmpty():
        return found.join(counts, "h")
    hot = F.broadcast(hot)
    return found.join(hot, "h").unionByName(found.join(hot.select("h"), "h", "left_anti").join(counts, "h"))


def repeated_spans(docs: DataFrame, size: int) -> DataFrame:
    """rid and its spans (sorted starts and ends, in bytes) to remove. docs: rid, text."""
    found = stored(anchors(docs, size), "anchors")
    # each row of size bytes or more has one anchor at 0
    many = stored(found.where("lo = 0").groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").select("rid"), "repeated")
    repeats = None if many.isEmpty() else Bloom.of(many.select(F.xxhash64("rid").alias("h")))
    if repeats is not None:
        once, again = apart(found, repeats)
        again = stored(again.distinct(), "repeated-anchors")
        whole = again.join(many, "rid").groupBy("rid").agg(F.lit(0).cast("long").alias("s"), (F.max("hi") + size).alias("e"))
        found = once.union(again)
    twice = stored(counted(found), "twice")
    parts = dealt(stored(segments(docs, twice, size, repeats), "segments"))
    in_shard = stored(in_shards(parts, size), "shards")
    near = in_shard.where("kind = 0").select("rid", F.col("a").alias("s"), F.col("b").alias("e"))
    far = across_shards(in_shard, size)
    spans = near.union(far) if repeats is None else near.union(far).union(whole)
    return spans.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))


def united(spans) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans; spans that touch are one."""
    out: list[list[int]] = []
    for s in spans:
        a, b = s["s"], s["e"]
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def less(text: str, runs: list[tuple[int, int]]) -> str:
    """text without runs of its bytes; a run gives up the bytes of characters that it only cuts."""
    raw, at, parts = text.encode(), 0, []
    for a, b in runs:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]]).decode()


def dedup(docs: DataFrame, size: int = 200, rewrite: bool = False) -> DataFrame:
    """All columns of docs, and (in place of columns of these names) spans (array of s, e) and kept (the bytes that remain).
    rewrite: without kept; text loses its spans, but for the bytes of characters that a span only cuts."""
    names = [c for c in docs.columns if c not in ("spans", "kept")]
    docs = docs.select(F.struct(*(c for c in names if c != "text")).alias("row"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("rid"))
    spans = stored(repeated_spans(docs.select("rid", "text"), size), "spans")
    hit = member(docs.sparkSession, Bloom.of(spans.select(F.xxhash64("rid").alias("h"))))
    new, kind = ("text", "string") if rewrite else ("kept", "binary")

    @F.pandas_udf(f"struct<spans: array<struct<s: long, e: long>>, {new}: {kind}>")
    def cut(text: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(text, found, strict=True):
            runs = united(s) if s is not None else []
            marks = [{"s": a, "e": b} for a, b in runs]
            if rewrite:
                rows.append((marks, less(t, runs) if runs else t))
                continue
            raw = (t or "").encode()
            ends = [0, *(x for r in runs for x in r), len(raw)]
            rows.append((marks, b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))))
        return pd.DataFrame(rows, columns=["spans", new])

    cut = cut.asNondeterministic()  # a caller's filter on the new text is not pushed below, which would cut twice
    marked = docs.withColumn("hit", hit(F.xxhash64("rid")))
    clean = marked.where("not hit").withColumn("spans", F.array().cast("array<struct<s: long, e: long>>"))
    clean = clean if rewrite else clean.withColumn("kept", F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    rest = marked.where("hit").join(spans.withColumnRenamed("spans", "found"), "rid", "left")
    rest = rest.withColumn("cut", cut("text", "found")).withColumn("spans", F.col("cut.spans")).withColumn(new, F.col(f"cut.{new}"))
    columns = [*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names), "spans", *([] if rewrite else ["kept"])]
    return clean.select(*columns).unionByName(rest.select(*columns))


def rewritten(deduped: DataFrame) -> DataFrame:
    """What dedup gives with `rewrite`, from what it gives without."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([less(t, [(x["s"], x["e"]) for x in found]) if t is not None and len(found) else t for t, found in zip(text, spans, strict=True)], dtype=object)

    return deduped.withColumn("text", F.when(F.size("spans") > 0, cut("text", "spans")).otherwise(F.col("text"))).drop("kept")


def digest(deduped: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + s["e"] - s["s"])
    return deduped.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )

