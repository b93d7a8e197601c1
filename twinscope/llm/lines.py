"""Line dedup by a segment-partition edit join.

Two lines are near if at most `most` edits (insertions, deletions, substitutions of UTF-8 bytes) turn one into the
other. A line is split into most + 1 even segments; a near line of at least its length holds one of them unchanged
near the same place, so each line indexes its segments by their length-aware place and probes the index with the few
substrings that can match. Pairs that meet are verified with a banded bit-parallel edit distance.

Lines in more than one place are one text with one id (63 bits of a 128-bit hash; lines of one id whose other bits
differ all stay, and are near to none). Connected texts are a class, and of each class
only the first line, by doc_id and place, stays. Runs of an index key that are too long to pair are verified in
blocks that give only the links that connect new lines.

Lines shorter than `shortest` bytes or without a word always stay. Null texts are empty and stay null. Rows that
repeat both doc_id and text are one document, also where doc_id is null; null doc_ids come before others. An empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.llm.common import Bloom, RollingHash, dropped, mixed, member, packed, slices, stored, tidy, tidy_groups, whole, wide_hashes
from twinscope.llm.components import components

MOST = 2
SHORTEST = 20
LONG_RUN = 2048
BLOCK = 1024
#: Pairs of a block that are verified at once.
PAIRS = 1 << 15
_WHITE = " \t\n\x0b\x0c\r"


def lines_of(raw: np.ndarray, starts: np.ndarray, shortest: int) -> tuple[np.ndarray, ...]:
    """start, end, row and number in its row of every line that takes part."""
    n = len(starts) - 1
    breaks = np.flatnonzero(raw == 10)
    row = np.append(np.arange(n), np.searchsorted(starts, breaks, side="right") - 1)
    begin = np.append(starts[:-1], breaks + 1)
    order = np.lexsort((begin, row))
    row, begin = row[order], begin[order]
    end = starts[row + 1].copy()
    same = row[1:] == row[:-1]
    end[:-1][same] = begin[1:][same] - 1
    number = np.arange(len(row)) - np.searchsorted(row, row)
    seen = np.append(0, np.cumsum((raw != 32) & ((raw < 9) | (raw > 13))))
    on = (end - begin >= shortest) & (seen[end] > seen[begin])
    return begin[on], end[on], row[on], number[on]


def ids_of(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """63-bit ids of lines, shifted left by one, and other bits of their hashes."""
    one, two = wide_hashes(raw, begin, end)
    return (one & ~np.uint64(1)).view(np.int64), two.view(np.int64)


_KINDS = (mixed(np.arange(256, dtype=np.uint64)) >> np.uint64(61)).astype(np.int64)
#: Four counts of 16 bits in a word: what each byte adds, for the lower and the upper four kinds.
_LANES = [np.where(_KINDS // 4 == half, np.uint64(1) << (16 * (_KINDS % 4)).astype(np.uint64), np.uint64(0)) for half in range(2)]


def signatures(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Eight counts of byte kinds, each modulo 256, in one long."""
    out = np.zeros(len(begin), np.uint64)
    for half, lanes in enumerate(_LANES):
        sums = np.append(np.uint64(0), np.cumsum(lanes[raw]))
        counts = sums[end] - sums[begin]
        for k in range(4):
            out |= (counts >> np.uint64(16 * k) & np.uint64(255)) << np.uint64(8 * (4 * half + k))
    for i in np.flatnonzero(end - begin >= 1 << 16).tolist():  # a count may not have fitted
        many = np.bincount(_KINDS[raw[begin[i] : end[i]]], minlength=8)
        out[i] = sum(int(c) % 256 << 8 * k for k, c in enumerate(many))
    return out.view(np.int64)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far two signatures' counts differ in sum; an edit changes the sum by two at most."""
    d = x.view(np.uint8).reshape(*x.shape, 8) - y.view(np.uint8).reshape(*y.shape, 8)
    return np.minimum(d, -d).sum(-1, dtype=np.int64)


def segment(length: np.ndarray, i: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and size of segment i of lines of these lengths."""
    base, longer = length // (most + 1), length % (most + 1)
    first = most + 1 - longer  # segments before this one have the base size
    return i * base + np.maximum(0, i - first), base + (i >= first)


def keys_of(hashes: RollingHash, begin: np.ndarray, end: np.ndarray, ids: np.ndarray, most: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys (id as it is), which the line probes too, and the other probe keys (id + 1) of lines."""
    n = end - begin
    keys, owners = [], []

    def put(at: np.ndarray, size: np.ndarray, length: np.ndarray, i: int, on: np.ndarray, side: int) -> None:
        at, size, length = at[on], size[on], length[on]
        place = (length * (most + 1) + i).astype(np.uint64)
        keys.append(mixed(hashes.of(begin[on] + at, size) + place * np.uint64(0xC2B2AE3D27D4EB4F)))
        owners.append(ids[on] + side)

    for i in range(most + 1):
        at, size = segment(n, i, most)
        put(at, size, n, i, np.ones(len(n), bool), 0)
        for less in range(most + 1):
            length = n - less
            at, size = segment(length, i, most)
            low, high = max(-i, less - (most - i)), min(i, less + (most - i))
            for shift in range(low, high + 1):
                if not less and not shift:
                    continue  # the line's own index key
                put(at + shift, size, length, i, (length >= shortest) & (at + shift >= 0) & (at + shift + size <= n), 1)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def within(raw: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, most: int) -> np.ndarray:
    """Whether raw[a:a + n] and raw[b:b + m] are within `most` edits: Hyyro's bit-parallel columns in a band around the
    diagonal, for all pairs at once. Bit 63 is the lowest row of the band, `most` below the diagonal."""
    swap = n < m
    a, n, b, m = np.where(swap, b, a), np.where(swap, m, n), np.where(swap, a, b), np.where(swap, n, m)
    out = np.zeros(len(a), bool)
    one, top = np.uint64(1), np.uint64(63)
    lanes = np.flatnonzero(n - m <= most)
    lanes = lanes[np.argsort(-m[lanes], kind="stable")]
    up = np.full(len(lanes), ((1 << 64) - 1) << (63 - most) & ((1 << 64) - 1), np.uint64)  # rows that grow downwards
    down = np.zeros(len(lanes), np.uint64)
    score = np.full(len(lanes), most, np.int64)
    a, n, b, m = a[lanes], n[lanes], b[lanes], m[lanes]
    limit = 2 * most + m - n
    alive = np.arange(len(lanes))
    for j in range(int(m.max(initial=0))):
        count = int(np.searchsorted(-m, -j, side="left"))  # lines longer than j come first
        if len(alive) and alive[-1] >= count or j % 32 == 31:
            alive = alive[(alive < count) & (score[alive] <= limit[alive])]
        if not len(alive):
            break
        la, ln, lb = a[alive], n[alive], b[alive]
        char = raw[lb + j]
        x = np.zeros(len(alive), np.uint64)
        for k in range(2 * most + 1):
            at = j - most + k
            if at >= 0:
                hit = (at < ln) & (raw[np.minimum(la + at, len(raw) - 1)] == char)
                x |= hit.astype(np.uint64) << np.uint64(63 - 2 * most + k)
        p, q = up[alive], down[alive]
        d = (((x & p) + p) ^ p) | x | q
        hp, hn = q | ~(d | p), d & p
        over = j - (ln - most)
        mask = one << (62 - np.clip(over, 0, 62)).astype(np.uint64)
        score[alive] += np.where(over < 0, (d >> top ^ one).astype(np.int64), ((hp & mask) != 0).astype(np.int64) - ((hn & mask) != 0))
        d >>= one
        up[alive], down[alive] = hn | ~(d | hp), d & hp
    out[lanes] = score <= most
    return out


def occurrences(docs: DataFrame, shortest: int) -> DataFrame:
    """id, check, line, length and signature of every line that takes part, once for each slice of a task's texts and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, starts = packed(part.column("text"))
                begin, end, row, number = lines_of(raw, starts, shortest)
                ids, check = ids_of(raw, begin, end)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), part.column("rid").take(pa.array(row)), pa.array(number, pa.int64()), pa.array(ids), pa.array(check), pa.array(end - begin), pa.array(signatures(raw, begin, end))],
                    names=["doc_id", "rid", "line", "id", "check", "length", "signature"],
                )

    return docs.select("doc_id", "rid", "text").mapInArrow(tidy(run), "doc_id long, rid long, line long, id long, check long, length long, signature long")


def candidates(docs: DataFrame, most: int, shortest: int) -> DataFrame:
    """kind 0: ids of two lines that share a key; kind 1: key and id of runs that are too long to pair."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, starts = packed(part.column("text"))
                begin, end, _, _ = lines_of(raw, starts, shortest)
                ids, first = np.unique(ids_of(raw, begin, end)[0], return_index=True)
                if len(ids):
                    hashes = RollingHash(raw)
                    key, owner = keys_of(hashes, begin[first], end[first], ids, most, shortest)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner)], names=["key", "owner"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, owner = whole(batches, "key", "owner")
        if not len(key):
            return
        order = np.lexsort((owner & 1, key))
        key, owner = key[order], owner[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ids = owner & ~np.int64(1)
        many = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)
        size = np.diff(np.append(begin, len(key)))
        indexed = size - np.add.reduceat(owner & 1, begin)
        paired = many & (indexed > 0)
        short, long = paired & (size * indexed <= LONG_RUN), paired & (size * indexed > LONG_RUN)
        s, p, q = begin[short], size[short], indexed[short]
        total = p * q
        run = np.repeat(np.arange(len(s)), total)
        k = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
        x, y = ids[s[run] + k // p[run]], ids[s[run] + k % p[run]]
        kept = x != y
        a, b = np.minimum(x, y)[kept], np.maximum(x, y)[kept]
        inside = np.repeat(long, size)
        kind = np.append(np.zeros(len(a), np.int32), np.ones(int(inside.sum()), np.int32))
        rows = pd.DataFrame({"kind": kind, "a": np.append(a, key[inside]), "b": np.append(b, ids[inside])}).drop_duplicates()
        for at in range(0, len(rows), 1 << 17):
            yield pa.RecordBatch.from_pandas(rows.iloc[at : at + (1 << 17)], preserve_index=False)

    return docs.select("text").mapInArrow(tidy(emit), "key long, owner long").repartition("key").mapInArrow(tidy(meet), "kind int, a long, b long")


def texts_of(docs: DataFrame, ids: DataFrame, shortest: int) -> DataFrame:
    """id and text of the lines of `ids` (a column id)."""
    picked = docs.sparkSession.sparkContext.broadcast(Bloom.of(ids.select(F.col("id").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, starts = packed(part.column("text"))
                begin, end, _, _ = lines_of(raw, starts, shortest)
                found, first = np.unique(ids_of(raw, begin, end)[0], return_index=True)
                hit = picked.value.has(found)
                data = raw.tobytes()
                bodies = [data[x:y] for x, y in zip(begin[first[hit]].tolist(), end[first[hit]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found[hit], pa.int64()), pa.array(bodies, pa.binary())], names=["id", "body"])

    return docs.select("text").mapInArrow(tidy(run), "id long, body binary").groupBy("id").agg(F.first("body").alias("body"))


def _laid(*columns: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    sizes = [np.array([len(x) for x in c], np.int64) for c in columns]
    at = np.append(0, np.cumsum(np.concatenate(sizes)))
    raw = np.frombuffer(b"".join(x for c in columns for x in c) or b"\0", np.uint8)
    cuts = np.append(0, np.cumsum([len(s) for s in sizes]))
    return raw, [(at[a:b], s) for a, b, s in zip(cuts, cuts[1:], sizes, strict=False)]


def links(found: DataFrame, firsts: DataFrame, docs: DataFrame, most: int, shortest: int) -> DataFrame:
    """Pairs of near lines that connect all lines that near lines connect."""
    facts = lambda c: firsts.select(F.col("id").alias(c), F.col("length").alias(f"n{c}"), F.col("signature").alias(f"s{c}"))
    pairs = found.where("kind = 0").select("a", "b").distinct().join(facts("a"), "a").join(facts("b"), "b").where(F.abs(F.col("na") - F.col("nb")) <= most)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.ascontiguousarray(batch.column(c).to_numpy()) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array(apart(x, y) <= 2 * most))

    pairs = stored(pairs.select("a", "b", "sa", "sb").mapInArrow(tidy(prune), "a long, b long"), "line-pairs")
    runs = stored(found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("id")).distinct().join(firsts.select("id"), "id", "left_semi"), "line-runs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(runs.select("id")).distinct()
    texts = stored(texts_of(docs, ids, shortest), "line-texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ((a, n), (b, m)) = _laid(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array(within(raw, a, n, b, m, most)))

    body = lambda c: texts.select(F.col("id").alias(c), F.col("body").alias(f"t{c}"))
    near = pairs.join(body("a"), "a").join(body("b"), "b").select("a", "b", "ta", "tb").mapInArrow(tidy(verify), "a long, b long")

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        ids, block, sign = part["id"].to_numpy(), part["own"].to_numpy(), np.ascontiguousarray(part["signature"].to_numpy())
        raw, ((at, size),) = _laid(part["body"].to_list())
        x, y = part["x"].iloc[0], part["y"].iloc[0]
        label, made = np.arange(len(ids)), []

        def met(i: np.ndarray, j: np.ndarray) -> None:
            """Unites what is near among pairs of different labels."""
            for k in range(0, len(i), PAIRS):
                u, v = i[k : k + PAIRS], j[k : k + PAIRS]
                on = (label[u] != label[v]) & (np.abs(size[u] - size[v]) <= most)
                u, v = u[on], v[on]
                on = apart(sign[u], sign[v]) <= 2 * most
                u, v = u[on], v[on]
                near = within(raw, at[u], size[u], at[v], size[v], most) if len(u) else np.zeros(0, bool)
                for c, d in zip(u[near].tolist(), v[near].tolist(), strict=True):
                    low, high = sorted((int(label[c]), int(label[d])))
                    if low != high:
                        label[label == high] = low
                        made.append((min(ids[c], ids[d]), max(ids[c], ids[d])))

        order = np.lexsort((ids, sign, size))  # near lines often stand side by side here
        across = block[order]
        for step in (1, 2, 4, 8):
            i, j = order[:-step], order[step:]
            on = (x == y) | (across[:-step] != across[step:])
            met(i[on], j[on])
        left, right = order[across == x], order[across == y]
        for k in range(0, len(left), 32):
            some = left[k : k + 32]
            i, j = np.repeat(some, len(right)), np.tile(right, len(some))
            on = (i < j) | (x != y)
            met(i[on], j[on])
        return pd.DataFrame(made, columns=["a", "b"])

    sizes = runs.groupBy("key").agg(F.count("*").alias("c"))
    put = runs.join(sizes, "key").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    put = put.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("own", "with")).withColumn("y", F.greatest("own", "with"))
    put = put.join(firsts.select("id", "signature"), "id").join(texts, "id")
    far = put.select("key", "x", "y", "id", "own", "signature", "body").groupBy("key", "x", "y").applyInPandas(tidy_groups(cluster), "a long, b long")
    return near.union(far).distinct()


def kept_lines(docs: DataFrame, most: int, shortest: int) -> tuple[DataFrame, DataFrame]:
    """rid and the numbers of its lines that take part and stay; and per rid how many take part and have near others."""
    seen = stored(occurrences(docs, shortest), "lines")
    place = F.struct("doc_id", "rid", "line")
    known = stored(seen.groupBy("id").agg(F.min(place).alias("first"), F.first("length").alias("length"), F.first("signature").alias("signature"), (F.min("check") == F.max("check")).alias("sure")), "firsts")
    firsts = known.where("sure").drop("sure")
    found = stored(candidates(docs, most, shortest), "line-candidates")
    near_lines = stored(links(found, firsts, docs, most, shortest), "line-links")
    labels = stored(components(near_lines, "a", "b", "line-classes"), "line-labels").withColumnRenamed("node", "id")
    alone = firsts.join(labels, "id", "left_anti").select("first")
    of_class = firsts.join(labels, "id").groupBy("component").agg(F.min("first").alias("first")).select("first")
    first = alone.union(of_class)
    unsure = known.where("not sure").select("id")
    if not unsure.isEmpty():
        first = first.union(seen.join(unsure, "id").select(place.alias("first")).distinct())
    kept = first.groupBy("first.rid").agg(F.collect_list("first.line").alias("kept"))
    dropped(found)
    near = seen.join(labels, "id").groupBy("rid").agg(F.count("*").alias("n_near"))
    counts = seen.groupBy("rid").agg(F.count_distinct("line").alias("n_part")).join(near, "rid", "left")
    return kept, counts


def dedup(docs: DataFrame, most: int = MOST, shortest: int = SHORTEST) -> DataFrame:
    """docs with what stays as text, and (in place of columns of these names) n_lines, n_removed, n_near (lines with near lines of another text)."""
    made = ("n_lines", "n_removed", "n_near")
    names = [c for c in docs.columns if c not in made]
    docs = docs.select(F.struct(*(c for c in names if c != "text")).alias("row"), "text", F.col("doc_id").cast("long").alias("doc_id")).withColumn("rid", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    plain = docs.select("doc_id", "rid", "text")
    kept, counts = kept_lines(plain, most, shortest)
    marks = stored(counts.join(kept, "rid", "left").where("n_near is not null or coalesce(size(kept), 0) < n_part"), "line-marks")
    hit = member(docs.sparkSession, Bloom.of(marks.select(F.xxhash64("rid").alias("h"))))

    @F.pandas_udf("struct<text: string, n_removed: long>")
    def cut(text: pd.Series, part: pd.Series, stay: pd.Series) -> pd.DataFrame:
        rows = []
        for t, n, s in zip(text, part, stay, strict=True):
            if t is None or n != n:
                rows.append((t, 0))
                continue
            stays = set() if s is None else set(s.tolist())
            lines = t.split("\n")
            out = [x for k, x in enumerate(lines) if k in stays or len(x.encode()) < shortest or not x.strip(_WHITE)]
            rows.append(("\n".join(out), len(lines) - len(out)))
        return pd.DataFrame(rows, columns=["text", "n_removed"])

    cut = cut.asNondeterministic()  # a caller's filter on the new text is not pushed below, which would cut twice
    marked = docs.withColumn("hit", hit(F.xxhash64("rid"))).withColumn("n_lines", F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))
    zero = F.lit(0).cast("long")
    clean = marked.where("not hit").withColumn("n_removed", zero).withColumn("n_near", zero)
    rest = marked.where("hit").join(marks, "rid", "left").withColumn("cut", cut("text", F.col("n_part").cast("double"), "kept"))
    rest = rest.withColumn("text", F.col("cut.text")).withColumn("n_removed", F.col("cut.n_removed")).withColumn("n_near", F.coalesce("n_near", zero))
    columns = [*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names), *made]
    return clean.select(*columns).unionByName(rest.select(*columns))
