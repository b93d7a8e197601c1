"""N-gram Jaccard join over count-vector R-trees.

A document's set is its distinct five-word shingles. Shingles are hashed into groups; the counts of the groups are a
point. The summed coordinate minima of two points bound the overlap of their sets from above, and those of two
bounding boxes bound all pairs below them, so an R-tree over the points leaves out pairs that can't link.

1. A sketch of fixed size counts all shingles of all documents. It orders the shingles, rare ones first; any one order
   would do for exact results, this one keeps common passages from bringing documents together.
2. Equal sets are one node. Two sets that link share one of the first `n - ceil(t n) + 1` shingles of each in that
   order, so links lie inside of groves: nodes that such shingles connect, where their sizes can link. Of a shingle with
   at most MOST_PAIRED nodes each pair is held against sizes, places and counts of groups before it connects. Groves that
   would not fit in a block are taken apart again: R-trees over their counts of groups leave the pairs that connect.
3. Each grove has an R-tree over its points. Pairs that the tree leaves are verified on their whole sets, one by one
   from the first node on; pairs that verified links connect already are left out.
4. A grove of more than `block_bytes` has a tree for each block of it, and each block also takes the grove's first node
   in, which joins most of a dense family. Blocks of a grove that is not of one component then meet: what stands
   outside of the grove's largest component meets all of the grove.

A salt deals the rows of a common shingle to several tasks. A fixed-size Bloom filter picks the texts to read again.
Shingles are known by 53-bit hashes, which are compared only within a grove.

Null, empty and blank texts have no shingles and link with nothing. Rows that share a doc_id are one node, by which
the links of all of them hold together. Null doc_ids link with nothing. An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.llm.common import Bloom, dropped, list_array, member, mixed, packed, run_hashes, slices, stored, swept, tidy, whole, words_of
from twinscope.llm.components import components, least_reached

SIZE = 5
LOW = np.uint64((1 << 53) - 1)
FANOUT = 16
SALTS = 64
#: Slots of the sketch: from 2**12 to 2**MOST_BITS, 1024 to a document.
MOST_BITS = 24
#: Slots travel in blocks.
SLOT_BLOCK = 1 << 18
#: Texts of a grove whose sets one tree holds, in bytes (and 512 for each).
BLOCK_BYTES = 8 << 20
#: Counts of groups that one tree holds of a large grove, in bytes (and 512 for each).
COUNTS_BLOCK = 1 << 20
#: Large groves whose block counts are broadcast, 12 bytes each; beyond, they are joined.
MOST_LARGE = 100_000
#: Nodes of a key whose pairs are all tried; more are chained.
MOST_PAIRED = 12
_LINKS = "a long, b long"
PROFILE = "doc_id long, n long, one long, two long, prefix array<long>, common int, counts binary"


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 53-bit shingle hashes of at most 2048 texts, one text after the other, and n + 1 bounds."""
    raw, starts = packed(texts)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    raw = lower[raw]
    first, last, row = words_of(raw, starts)
    n = len(starts) - 1
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = run_hashes(raw, first, last - first)

    def chained(at: np.ndarray, count: int) -> np.ndarray:
        h = np.full(len(at), count, np.uint64)
        for k in range(count):
            h = mixed(h) * np.uint64(0xD6E8FEB86659FD93) + word[at + k]
        return mixed(h)

    full = np.flatnonzero(row[: len(row) - SIZE + 1] == row[SIZE - 1 :]) if len(row) >= SIZE else np.zeros(0, np.int64)
    hashes, rows = [chained(full, SIZE)], [row[full]]
    many = np.bincount(row, minlength=n)
    begin = np.searchsorted(row, np.arange(n))
    for count in range(1, SIZE):
        short = np.flatnonzero(many == count)
        hashes.append(chained(begin[short], count))
        rows.append(short)
    keys = np.sort(np.concatenate(rows).astype(np.uint64) << np.uint64(53) | np.concatenate(hashes) >> np.uint64(11))
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    return keys & LOW, np.searchsorted(keys >> np.uint64(53), np.arange(n + 1))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with any set that links with a set of n."""
    return -(-n * percent // 100)


def slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(h) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(docs: DataFrame) -> tuple[int, np.ndarray]:
    """bits, and for each of 2**bits slots how common its shingles are: 12 log2(1 + count over all documents), a byte."""
    bits = min(MOST_BITS, max(12, (1024 * docs.count()).bit_length()))
    block = min(SLOT_BLOCK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        texts = 0

        def given() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(counts), block):
                planes = counts[k : k + block].view(np.uint8).reshape(-1, 2).T.tobytes()  # low bytes, then high ones
                yield pa.RecordBatch.from_arrays([pa.array([k // block], pa.int32()), pa.array([pa.compress(planes, "zstd", asbytes=True)], pa.binary())], names=["block", "counts"])

        for batch in batches:
            for part in slices(batch):
                h, _ = shingles(part.column("text"))
                np.add.at(counts, slot(h, bits), 1)
                texts += part.num_rows
                if texts > 30_000:  # before a count is full
                    yield from given()
                    counts[:], texts = 0, 0
        if texts:
            yield from given()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                sums.setdefault(k, np.zeros(block, np.int64))
                low, high = np.frombuffer(pa.decompress(x.as_buffer(), 2 * block, "zstd"), np.uint8).reshape(2, -1)
                sums[k] += low
                sums[k] += high.astype(np.int64) << 8
        for k, x in sums.items():
            level = np.minimum(255, np.round(12 * np.log2(1.0 + x))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "counts"])

    kind = "block int, counts binary"
    found = docs.select("text").mapInArrow(tidy(count), kind).repartition("block").mapInArrow(tidy(total), kind).collect()  # 2**MOST_BITS bytes at most
    levels = np.zeros(1 << bits, np.uint8)
    for r in found:
        levels[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["counts"], np.uint8)
    return bits, levels


def group_counts(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """How many shingles of each set fall in each of its groups, a byte each; nothing, if one has more than a byte holds.
    There are four to eight shingles for a group, and as many groups as a power of two, so that larger counts can be
    folded to those of a smaller set."""
    n = np.diff(bounds)
    groups = np.int64(1) << np.clip(np.frexp(n)[1] - 3, 5, 16).astype(np.int64)
    starts = np.append(0, np.cumsum(groups))
    row = np.repeat(np.arange(len(n)), n)
    counts = np.bincount(starts[row] + ((mixed(h) >> np.uint64(32)).astype(np.int64) & (groups[row] - 1)), minlength=int(starts[-1]))
    full = np.maximum.reduceat(counts, starts[:-1]) > 255 if len(n) else np.zeros(0, bool)
    kept = counts[~np.repeat(full, groups)].astype(np.uint8)
    ends = np.append(0, np.cumsum(np.where(full, 0, groups))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.tobytes())])


def profile(docs: DataFrame, percent: int, bits: int, levels: np.ndarray) -> DataFrame:
    """Per row: the size of its set, the two halves of the set's hash, its prefix, how many shingles at the end of the
    prefix are common, and counts of groups."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    usual = float(np.median(levels)) if len(levels) else 0.0
    common = usual + 96  # counts 256 times the usual one, or more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, bounds = shingles(part.column("text"))
                n = np.diff(bounds)
                row = np.repeat(np.arange(len(n)), n)
                sums = []
                for k in range(2):
                    ends = np.append(np.zeros(1, np.uint64), np.cumsum(mixed(h + np.uint64(k * 0x5851F42D4C957F2D))))
                    sums.append(ends[bounds[1:]] - ends[bounds[:-1]])
                level = shared.value[slot(h, bits)]
                order = np.argsort(row << 8 | level, kind="stable")  # h ascends in each row
                p = np.where(n > 0, n - needed(n, percent) + 1, 0)
                last = np.cumsum(p)
                at = order[np.repeat(bounds[:-1] - (last - p), p) + np.arange(int(p.sum()))]
                often = np.append(0, np.cumsum(level[at] >= common))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), list_array(h[at].astype(np.int64), np.append(0, last), pa.int64()), pa.array((often[last] - often[last - p]).astype(np.int32)), group_counts(h, bounds)],
                    names=["doc_id", "n", "one", "two", "prefix", "common", "counts"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), PROFILE)


def may_link(overlap: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """100 overlap >= percent (n + m - overlap), with overlap at most the smaller size."""
    overlap = np.minimum(overlap, np.minimum(n, m))
    return (100 + percent) * overlap >= percent * (n + m)


def points(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Count vectors of sets: as many groups as the largest set has members, between 64 and 1024."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    groups = 1 << min(10, max(6, int(size.max(initial=1)).bit_length()))
    group = (mixed(h) >> np.uint64(32)).astype(np.int64) % groups
    counts = np.zeros((n, groups), np.uint16 if size.max(initial=0) < 1 << 16 else np.uint32)
    for a in range(0, n, 512):
        b = min(n, a + 512)
        cell = np.repeat(np.arange(b - a), size[a:b]) * groups + group[bounds[a] : bounds[b]]
        counts[a:b] = np.bincount(cell, minlength=(b - a) * groups).reshape(b - a, groups)
    return counts


class CountTree:
    """A packed R-tree over count vectors. Boxes keep their upper corner and their smallest and largest set size."""

    def __init__(self, counts: np.ndarray, n: np.ndarray):
        half = counts[:, : counts.shape[1] // 2].sum(1, dtype=np.int64)
        self.order = np.lexsort((half, n))  # by size, then by weight of half of the groups
        self.levels = [(counts[self.order], n[self.order], n[self.order])]
        while len(self.levels[-1][1]) > 1:
            top, least, most = self.levels[-1]
            cuts = np.arange(0, len(least), FANOUT)
            self.levels.append((np.maximum.reduceat(top, cuts, axis=0), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)))

    def pairs(self, other: CountTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows (of self, of other) that the bound leaves; with itself, each pair of two rows once."""
        mine, theirs, alike = self._raised(other), other._raised(self), other is self
        stack = [(len(mine) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > 1 << 12:
                stack += [(level, x, y) for x, y in zip(np.array_split(a, 16), np.array_split(b, 16), strict=True)]
                continue
            (top, least, most), (top2, least2, most2) = mine[level], theirs[level]
            near = 100 * np.minimum(most[a], most2[b]) >= percent * np.maximum(least[a], least2[b])
            a, b = a[near], b[near]
            low = np.minimum(top[a], top2[b]).sum(-1, dtype=np.int64)
            keep = may_link(low, most[a], most2[b], percent) if level == 0 else (100 + percent) * low >= percent * (least[a] + least2[b])
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                if alike:
                    a, b = a[a < b], b[a < b]
                yield self.order[a], other.order[b]
                continue
            fa, fb = (FANOUT if mine[level] is not mine[level - 1] else 1), (FANOUT if theirs[level] is not theirs[level - 1] else 1)
            x = (a[:, None, None] * fa + np.arange(fa)[None, :, None] + 0 * np.arange(fb)[None, None, :]).ravel()
            y = (b[:, None, None] * fb + np.arange(fb)[None, None, :] + 0 * np.arange(fa)[None, :, None]).ravel()
            inside = (x < len(mine[level - 1][1])) & (y < len(theirs[level - 1][1]))
            if alike:
                inside &= x <= y
            stack.append((level - 1, x[inside], y[inside]))

    def _raised(self, other: CountTree) -> list:
        """The levels, with the root repeated up to the height of the other tree."""
        return self.levels + [self.levels[-1]] * (len(other.levels) - len(self.levels))


def linked(h: np.ndarray, bounds: np.ndarray, percent: int, label: np.ndarray, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between the sets that connect all that links connect. label: components so far, changed in place. sides: 0
    and 1; only pairs across are held against each other."""
    n = np.diff(bounds)
    counts = points(h, bounds)
    if sides is None:
        tree = CountTree(counts, n)
        found = [(np.minimum(a, b), np.maximum(a, b)) for a, b in tree.pairs(tree, percent)]
    else:
        left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        if not len(left) or not len(right):
            return []
        found = [(left[a], right[b]) for a, b in CountTree(counts[left], n[left]).pairs(CountTree(counts[right], n[right]), percent)]
    if not found:
        return []
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    if not len(a):
        return []
    begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    made = []
    for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(a)], strict=True):
        i = int(a[s])
        other = b[s:e][label[b[s:e]] != label[i]]
        if not len(other):
            continue
        mine, size = h[bounds[i] : bounds[i + 1]], n[other]
        ends = np.cumsum(size)
        all_ = h[np.repeat(bounds[other] - (ends - size), size) + np.arange(int(ends[-1]))]
        at = np.minimum(np.searchsorted(mine, all_), len(mine) - 1)
        common = np.add.reduceat(mine[at] == all_, ends - size, dtype=np.int64)
        for j in other[100 * common >= percent * (n[i] + size - common)].tolist():
            u, w = int(label[i]), int(label[j])
            if u != w:
                label[label == max(u, w)] = min(u, w)
                made.append((i, j))
    return made


def bands(n: np.ndarray, percent: int) -> np.ndarray:
    """Sizes that can link are in one band or in two that follow each other."""
    return np.floor(np.log(n) / np.log(100 / percent) * (1 - 1e-9)).astype(np.int64)


def chains(keys: DataFrame, percent: int) -> DataFrame:
    """keys: key, node and n, the set's size times 2**31 and the key's place in the prefix, or less than 0 for a common key.

    kind 0: pairs of nodes of a key with few nodes, if their sizes can link, and if they could with no common shingle
    before this one. kind 2: pairs that connect all nodes of another key whose sizes can link: nodes in the order of size,
    each with the next one. Of a common key, which a salt deals to several partitions, the nodes of a size band are
    connected there, and kind 1 has the key, the band and one of these nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, n = whole(batches, "key", "node", "n")
        common, n, place = n < 0, np.abs(n) >> 31, np.abs(n) & ((1 << 31) - 1)
        size = np.where(common, bands(np.maximum(n, 1), percent), n)
        order = np.lexsort((size, key))
        key, node, common, size, place = key[order], node[order], common[order], size[order], place[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        many = np.diff(np.append(begin, len(key)))
        several = np.repeat((many > 1) | common[begin], many)
        key, node, common, size, place = key[several], node[several], common[several], size[several], place[several]
        few = np.repeat(many <= MOST_PAIRED, many)[several] & ~common
        tried = []
        for step in range(1, MOST_PAIRED):
            at = np.flatnonzero((key[step:] == key[:-step]) & few[step:])
            if not len(at):
                break
            x, y = size[at], size[at + step]
            fits = may_link(np.minimum(x - place[at], y - place[at + step]), x, y, percent)
            tried.append(np.stack([node[at[fits]], node[at[fits] + step]]))
        same = key[1:] == key[:-1]
        near = same & ~few[1:] & np.where(common[1:], size[1:] == size[:-1], 100 * size[:-1] >= percent * size[1:])
        at = np.flatnonzero(near)
        chained = np.stack([node[at], node[at + 1]])
        tops = np.flatnonzero(common & np.append(True, ~near)[: len(key)])
        parts = [(2, *np.unique(chained, axis=1), np.zeros(0, np.int64)), (1, key[tops], node[tops], size[tops])]
        if tried:
            both = np.concatenate(tried, 1)
            parts.append((0, *np.unique(np.sort(both[:, both[0] != both[1]], 0), axis=1), np.zeros(0, np.int64)))
        for kind, a, b, band in parts:
            for k in range(0, len(a), 1 << 17):
                part = slice(k, k + (1 << 17))
                x, y = a[part], b[part]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y), pa.array(band[part] if kind == 1 else 0 * x)], names=["kind", "a", "b", "band"])

    salted = F.when(F.col("n") < 0, F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0)
    return keys.repartition("key", salted).select("key", "node", "n").mapInArrow(tidy(run), "kind int, a long, b long, band long")


def tops_chained(tops: DataFrame) -> DataFrame:
    """Pairs that connect the nodes of a common key's bands: each with the next one, if their bands are equal or follow
    each other. tops: SALTS rows for each key and band at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, band = whole(batches, "key", "node", "band")
        order = np.lexsort((band, key))
        key, node, band = key[order], node[order], band[order]
        at = np.flatnonzero((key[1:] == key[:-1]) & (band[1:] - band[:-1] <= 1))
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[at + 1])], names=["a", "b"])

    return tops.repartition("key").mapInArrow(tidy(run), "a long, b long")


def folded(counts: list[bytes], groups: int) -> np.ndarray:
    """Counts of as many groups or more, all of one length, folded to so many groups."""
    return np.frombuffer(b"".join(counts), np.uint8).reshape(len(counts), -1, groups).sum(1, dtype=np.int32)


def most_shared(n: np.ndarray, m: np.ndarray, x: list[bytes], y: list[bytes]) -> np.ndarray:
    """A bound of the overlap of each pair, from their sizes and counts of groups."""
    wide = np.array([[len(c) for c in x], [len(c) for c in y]], np.int64).reshape(2, -1)
    low = np.minimum(n, m)
    for p, q in {*zip(*wide.tolist(), strict=True)}:
        if p and q:
            at = np.flatnonzero((wide[0] == p) & (wide[1] == q))
            u, v = (folded([c[k] for k in at.tolist()], min(p, q)) for c in (x, y))
            low[at] = np.minimum(u, v).sum(1)
    return low


def may_link_by_counts(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes that the summed minima of their counts leave; of a node of several rows any may do."""
    of = lambda c: rows.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"c{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            low = most_shared(n, m, batch.column("ca").to_pylist(), batch.column("cb").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array(may_link(low, n, m, percent)))

    met = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "ca", "cb")
    return met.mapInArrow(tidy(run), _LINKS)


def near_by_counts(n: np.ndarray, counts: list[bytes], percent: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose sizes and counts of groups leave that they link; side: 0 and 1, only pairs across are given.

    Each pair is held against each other by the fewer groups of the two, in a tree of 1024 groups at most."""
    wide = np.array([len(c) for c in counts], np.int64)
    for i in np.flatnonzero(wide == 0).tolist():  # no bound
        near = (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & ((wide > 0) | (np.arange(len(n)) > i))
        near = np.flatnonzero(near if side is None else near & (side != side[i]))
        yield np.full(len(near), i), near
    for groups in np.unique(wide[wide > 0]).tolist():
        trees = []
        for own in (0, 1):
            rows = np.flatnonzero((wide >= groups) & (side == own) if side is not None else wide >= groups)
            if not len(rows):
                break
            least = min(groups, 1024)
            points = np.zeros((len(rows), least), np.int32)
            for width in np.unique(wide[rows]).tolist():
                at = np.flatnonzero(wide[rows] == width)
                points[at] = folded([counts[k] for k in rows[at].tolist()], least)
            trees.append((rows, CountTree(points.astype(np.uint16) if points.max() < 1 << 16 else points, n[rows])))
            if side is None:
                trees *= 2
                break
        if len(trees) < 2:
            continue
        (left, mine), (right, theirs) = trees
        for a, b in mine.pairs(theirs, percent):
            a, b = left[a], right[b]
            due = (wide[a] == groups) | (wide[b] == groups)
            a, b = a[due], b[due]
            step = max(1, (1 << 23) // groups)
            for k in range(0, len(a), step) if groups > 1024 else ():
                x, y = a[k : k + step], b[k : k + step]
                fits = may_link(most_shared(n[x], n[y], [counts[i] for i in x.tolist()], [counts[i] for i in y.tolist()]), n[x], n[y], percent)
                yield x[fits], y[fits]
            if groups <= 1024:
                yield a, b


def split_by_counts(found: DataFrame, rows: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Groves again; those with sets of about block_bytes of text or more are connected anew, by the pairs that counts of
    groups leave. A pair is tried where the smaller size has its band. Counts travel as often as a band of a grove has
    blocks; they are some thirtieth of the texts."""
    spark = rows.sparkSession
    sizes = rows.select(F.col("doc_id").alias("node"), "n").join(found, "node").groupBy("grove").agg(F.sum(8 * F.col("n") + 512).alias("total"))
    large = stored(sizes.where(F.col("total") > block_bytes).select("grove"), "groves-to-split")
    if large.isEmpty():
        return found
    nodes = stored(found.join(large, "grove"), "nodes-to-split")
    hit = member(spark, Bloom.of(nodes.select(F.xxhash64("node").alias("h"))))
    held = rows.select(F.col("doc_id").alias("node"), "n", "counts", hit(F.xxhash64("doc_id")).alias("hit")).where("hit").drop("hit").join(nodes, "node")
    band = F.floor(F.log("n") / F.lit(math.log(100 / min(percent, 99))) * F.lit(1 - 1e-9)).cast("long")
    held = stored(held.withColumn("band", band), "counts-to-split")
    cells = held.withColumn("cell", F.explode(F.array("band", F.col("band") - 1)))
    weights = cells.groupBy("grove", "cell").agg(F.sum(F.octet_length("counts") + 512).alias("total"), F.min("band").alias("least"), F.count("*").alias("c"))
    weights = weights.where("least = cell and c > 1").select("grove", "cell", F.ceil(F.col("total") / COUNTS_BLOCK).cast("int").alias("blocks"))
    put = cells.join(weights, ["grove", "cell"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    put = put.select("grove", "cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "n", "counts", "band")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "grove", "cell", "x", "y"):
            node, n, own, above = (part.column(c).to_numpy() for c in ("node", "n", "own", "band"))
            above = above > part.column("cell")[0].as_py()
            x, y = part.column("x")[0].as_py(), part.column("y")[0].as_py()
            made = [np.zeros((2, 0), np.int64)]
            for a, b in near_by_counts(n, part.column("counts").to_pylist(), percent, None if x == y else (own == y).astype(np.int64)):
                keep = ~(above[a] & above[b]) & (node[a] != node[b])
                made.append(np.stack([node[a[keep]], node[b[keep]]]))
                if sum(m.shape[1] for m in made) > 1 << 20:
                    made = [np.stack(least_reached(*np.concatenate(made, 1)))]
            nodes, least = least_reached(*np.concatenate(made, 1))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != least]), pa.array(least[nodes != least])], names=["a", "b"])

    by = ("grove", "cell", "x", "y")
    edges = stored(put.repartition(*by).sortWithinPartitions(*by).mapInArrow(tidy(run), _LINKS).distinct(), "counts-edges")
    swept(spark)
    dropped(held)
    again = components(edges, "a", "b", "groves").withColumnRenamed("component", "grove")
    return stored(found.join(large, "grove", "left_anti").select("node", "grove").union(again.select("node", "grove")), "groves")


def groves(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """node and grove (its smallest node) of all nodes that share a prefix shingle with another of a size that can link."""
    of_nodes = rows.select(F.col("doc_id").alias("node"), "n", "prefix", "common").join(nodes, "node", "left_semi")
    keys = of_nodes.select("node", F.shiftleft("n", 31).alias("n"), (F.size("prefix") - F.col("common")).alias("from"), F.posexplode("prefix").alias("place", "key"))
    keys = keys.select("node", "key", F.when(F.col("place") >= F.col("from"), -F.col("n")).otherwise(F.col("n") + F.col("place")).alias("n"))
    found = stored(chains(keys, percent), "chains")
    swept(rows.sparkSession)
    tried = may_link_by_counts(found.where("kind = 0").select("a", "b").distinct(), rows, percent)
    above = tops_chained(found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), "band"))
    edges = stored(found.where("kind = 2").select("a", "b").union(tried).union(above).where("a <> b").distinct(), "chain-edges")
    swept(rows.sparkSession)
    out = stored(components(edges, "a", "b", "groves").withColumnRenamed("component", "grove"), "groves")
    dropped(found)
    dropped(edges)
    return out


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, grove, text and a weight in bytes of the nodes' rows; a Bloom filter picks the texts to read again. Texts
    travel, as they are smaller than their sets."""
    picked = docs.sparkSession.sparkContext.broadcast(Bloom.of(nodes.select(F.xxhash64("node").alias("h"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(picked.value.has(batch.column("h").to_numpy()))).select(["node", "text"])

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("node"), "text")
    rows = rows.withColumn("h", F.xxhash64("node")).mapInArrow(tidy(pick), "node long, text string")
    return rows.join(nodes, "node").withColumn("weight", (F.octet_length("text") + 512).cast("long"))


def _groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[pa.Table]:
    """The rows of each run of equal values of the columns `by`, one run after the other."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in by]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            value = tuple(int(c[s]) for c in cols)
            if kept and value != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(s, e - s))
            last = value
    if kept:
        yield pa.Table.from_batches(kept)


def _sets(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each row's text, and their bounds."""
    found = [shingles(x.column("text")) for batch in part.combine_chunks().to_batches() for x in slices(batch)]
    sizes = np.concatenate([np.diff(bounds) for _, bounds in found])
    return np.concatenate([h for h, _ in found]), np.append(0, np.cumsum(sizes))


def _made(node: np.ndarray, made: list[tuple[int, int]]) -> pa.RecordBatch:
    i = np.array(made, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(node[i[:, 0]]), pa.array(node[i[:, 1]])], names=["a", "b"])


def tree_links(sets: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links inside of groves, or of the blocks of large ones, that connect all which links there connect."""
    sizes = sets.groupBy("grove").agg(F.sum("weight").alias("total")).withColumn("blocks", F.ceil(F.col("total") / block_bytes).cast("int")).where("blocks > 1")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    everywhere = F.when(F.col("node") == F.col("grove"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    large = stored(sizes.select("grove", "blocks"), "large-groves")
    if large.isEmpty():
        put = sets.withColumn("blocks", F.lit(1))
    elif large.count() <= MOST_LARGE:
        put = sets.join(F.broadcast(large), "grove", "left")
    else:
        put = sets.join(large, "grove", "left")
    put = put.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.explode(everywhere))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "grove", "block"):
            node = part.column("node").to_numpy()
            part = part.take(np.argsort(node, kind="stable"))
            node = np.sort(node)
            h, bounds = _sets(part)
            same = np.searchsorted(node, node)  # rows that share a doc_id are one node
            made = linked(h, bounds, percent, same)
            if made:
                yield _made(node, made)

    rows = put.select("grove", "block", "node", "text").repartition("grove", "block").sortWithinPartitions("grove", "block")
    return rows.mapInArrow(tidy(run), _LINKS)


def no_links(sets: DataFrame) -> DataFrame:
    """No links."""
    return sets.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")


def cross_links(sets: DataFrame, labels: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links across the blocks of groves that hold several components: what is outside of a grove's largest component
    meets all of it."""
    sizes = sets.groupBy("grove").agg(F.sum("weight").alias("total")).withColumn("blocks", F.ceil(F.col("total") / block_bytes).cast("int")).where("blocks > 1")
    if sizes.isEmpty():
        return no_links(sets)
    rows = sets.join(sizes, "grove").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component", "total")
    weights = rows.groupBy("grove", "label").agg(F.sum("weight").alias("w"))
    largest = weights.groupBy("grove").agg(F.max(F.struct("w", "label")).alias("m"), F.count("*").alias("parts"), F.sum("w").alias("total"))
    largest = largest.where("parts > 1").select("grove", F.col("m.label").alias("main"), F.ceil((F.col("total") - F.col("m.w")) / block_bytes).cast("int").alias("asking"))
    rows = rows.join(largest, "grove")
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    asked = rows.where("label <> main").withColumn("side", F.lit(0)).withColumn("x", own("asking")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    given = rows.withColumn("side", F.lit(1)).withColumn("y", own("blocks")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)))
    put = asked.unionByName(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "grove", "x", "y"):
            node, side, label = (part.column(c).to_numpy() for c in ("node", "side", "label"))
            h, bounds = _sets(part)
            _, label = np.unique(label, return_inverse=True)
            made = linked(h, bounds, percent, label, side)
            if made:
                yield _made(node, made)

    rows = put.select("grove", "x", "y", "node", "side", "label", "text").repartition("grove", "x", "y").sortWithinPartitions("grove", "x", "y")
    return rows.mapInArrow(tidy(run), _LINKS)


def near_duplicates(docs: DataFrame, percent: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    bits, levels = sketch(docs)
    swept(spark)
    profiles = stored(profile(docs, percent, bits, levels), "profiles")
    rows = stored(profiles.select("doc_id", "n", "one", "two"), "sets")
    full = rows.where("n > 0 and doc_id is not null")
    classes = stored(full.groupBy("n", "one", "two").agg(F.min("doc_id").alias("node")), "classes")
    nodes = classes.select("node").distinct()
    held = profiles.where("n > 0 and doc_id is not null")
    of_groves = split_by_counts(groves(held, nodes, percent), held, percent, block_bytes)
    dropped(profiles)
    sets = stored(texts_of(docs, of_groves), "grove-texts")
    swept(spark)
    links = stored(tree_links(sets, percent, block_bytes), "links")
    swept(spark)
    labels = components(links, "a", "b")
    more = stored(cross_links(sets, labels, percent, block_bytes), "more")
    # equal sets are one class by the smallest doc_id; a doc_id of several rows belongs to each of their classes
    several = full.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    tied = full.join(several, "doc_id").join(classes, ["n", "one", "two"]).where("node <> doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    more = stored(more.union(tied.distinct()), "all-links")
    if not more.isEmpty():
        labels = components(links.union(more), "a", "b")
    dropped(sets)
    out = rows.select("doc_id", "n", "one", "two").join(classes, ["n", "one", "two"], "left").join(labels, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))
