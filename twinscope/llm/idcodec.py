"""Token ids in Simple-8b files.

A 64-bit word holds a selector in its top four bits and as many ids of one width as fit below. Selector 15 is an
escape: the next word is one raw 64-bit value. Words are grouped into blocks of BLOCK ids; a run has the words of
whole documents with an offset for each block, so that blocks are decoded independently and all at once.

Run layout, little-endian: b"S8B1", u32 blocks, u64 ids, u64[blocks + 1] first word of each block, u64[] words.
The files are Parquet shards, written and committed by Spark: a row per run with its doc_ids, id counts and the number
of ids before it in its shard.

Null texts have the end id alone. Null doc_ids come first. Rows with equal doc_ids stand in the order of their texts,
null first; equal rows are alike. An empty table gives no runs and no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscope.llm.common import list_array, new_path, slices, tidy

# Fixed values of the format: ids in a word and their width in bits, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
BLOCK = 1024
MAGIC = b"S8B1"
RUN = "shard int, run int, before long, doc_ids array<long>, counts array<long>, n_ids long, payload binary"
#: Shards whose sizes are broadcast to the readers, 16 bytes each; beyond, they are joined.
MOST_SHARDS = 1_000_000


def encode(ids: np.ndarray) -> bytes:
    """One run. Each word takes as many ids as fit; the blocks advance together."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    ends = np.minimum((np.arange(n, dtype=np.int64) // BLOCK + 1) * BLOCK, n)
    best = np.full(n, len(COUNTS), np.int64)  # the selector; ESCAPE where even one id doesn't fit
    best[:] = ESCAPE
    for s in range(len(COUNTS) - 1, -1, -1):
        narrow = np.flatnonzero(ids < np.uint64(1 << WIDTHS[s]))
        if len(narrow):
            last = np.append(np.flatnonzero(np.diff(narrow) != 1), len(narrow) - 1)  # of each run of narrow ids
            until = np.repeat(narrow[last] + 1, np.diff(np.append(-1, last)))
            best[narrow[(until - narrow >= COUNTS[s]) | (until >= ends[narrow])]] = s
    step = np.where(best == ESCAPE, 1, np.minimum(np.array([*COUNTS, 1, 1])[best], ends - np.arange(n)))
    at, starts = np.arange(blocks, dtype=np.int64) * BLOCK, []
    limit = np.minimum(at + BLOCK, n)
    while len(at):
        starts.append(at)
        at = at + step[at]
        more = at < limit
        at, limit = at[more], limit[more]
    heads = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    selector = best[heads]
    size = 1 + (selector == ESCAPE)
    first = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(selector == s)
        word = np.full(len(mine), s << 60, np.uint64)
        for j in range(COUNTS[s]):
            on = step[heads[mine]] > j
            word[on] |= ids[heads[mine[on]] + j] << np.uint64(WIDTHS[s] * j)
        words[first[mine]] = word
    raw = np.flatnonzero(selector == ESCAPE)
    words[first[raw]], words[first[raw] + 1] = np.uint64(ESCAPE << 60), ids[heads[raw]]
    offsets = np.append(first[np.searchsorted(heads, np.arange(blocks) * BLOCK)], len(words)).astype("<u8")
    return MAGIC + struct.pack("<IQ", blocks, n) + offsets.tobytes() + words.astype("<u8").tobytes()


def decode(run: bytes, blocks: tuple[int, int] | None = None) -> np.ndarray:
    """The ids of a run, or of blocks [from, to) of it."""
    if run[:4] != MAGIC:
        raise ValueError("not a run of Simple-8b ids")
    count, n = struct.unpack_from("<IQ", run, 4)
    offsets = np.frombuffer(run, "<u8", count + 1, 16).astype(np.int64)
    a, b = blocks or (0, count)
    if a == b:
        return np.zeros(0, np.uint64)
    words = np.frombuffer(run, "<u8", int(offsets[b] - offsets[a]), 16 + 8 * (count + 1) + 8 * int(offsets[a]))
    selector = (words >> np.uint64(60)).astype(np.int64)
    # a word after an escape is raw; escapes follow each other only at every other word of a chain
    escape = selector == ESCAPE
    if escape.any():
        place = np.arange(len(words))
        last = np.maximum.accumulate(np.where(~escape, place, -1))
        escape &= (place - last) % 2 == 1
        raw = np.zeros(len(words), bool)
        raw[1:] = escape[:-1]
        escape &= ~raw
    else:
        raw = escape
    kept = np.array([*COUNTS, 1, 1])[selector]
    kept[escape], kept[raw] = 0, 1
    left = np.minimum(n - BLOCK * np.arange(a, b), BLOCK)  # ids in each block
    block = np.searchsorted(offsets[a : b + 1] - offsets[a], np.arange(len(words)), side="right") - 1
    total = np.cumsum(kept)
    base = np.concatenate([[0], total])[offsets[a:b] - offsets[a]]
    begin = total - kept - base[block]  # place in the block
    kept = np.minimum(kept, left[block] - begin)
    place = begin + BLOCK * block
    out = np.zeros(int(left.sum()), np.uint64)
    out[place[raw]] = words[raw]
    for s in range(len(COUNTS)):
        mine = np.flatnonzero((selector == s) & ~raw & ~escape)
        width = np.uint64((1 << WIDTHS[s]) - 1)
        for j in range(COUNTS[s]):
            on = mine[kept[mine] > j]
            out[place[on] + j] = words[on] >> np.uint64(WIDTHS[s] * j) & width
    return out


def write_ids(docs: DataFrame, path: str, tokenizer: str, kind: str = "word", end_id: int = 1) -> None:
    """Writes the ids of all texts, in ascending doc_id order, to the folder `path`; null texts have the end id alone.

    A shard is a range of doc_ids, so no task holds more than its shard, and a lost task writes its shard again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from twinscope.llm.words import encoder

        enc, shard, k, before = encoder(tokenizer, kind), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part in slices(batch):
                ids, counts = enc.ids(part.column("text"))
                whole = np.full(len(ids) + len(counts), end_id, np.uint64)
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                one = pa.array([0, len(counts)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([before], pa.int64()), pa.ListArray.from_arrays(one, part.column("doc_id")), list_array(counts + 1, np.array([0, len(counts)]), pa.int64()), pa.array([len(whole)], pa.int64()), pa.array([encode(whole)], pa.binary())],
                    names=["shard", "run", "before", "doc_ids", "counts", "n_ids", "payload"],
                )
                k, before = k + 1, before + len(whole)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(tidy(run, keeps=True), RUN).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document in the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                doc_ids, counts = one.column("doc_ids").flatten(), one.column("counts").flatten().to_numpy(zero_copy_only=False)
                ids = decode(one.column("payload")[0].as_py()).astype("<u4")
                ends = np.cumsum(counts)
                base = one.column("base")[0].as_py()
                offsets = pa.py_buffer((4 * np.concatenate([[0], ends])).astype(np.int64).tobytes())
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, offsets, pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(base + ends - counts, pa.int64()), pa.array(counts, pa.int64()), blobs], names=["doc_id", "start", "n_tokens", "ids"])

    runs = spark.read.schema(RUN).parquet(path)
    shards = runs.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_base"))
    small = len(runs.inputFiles()) <= MOST_SHARDS  # a shard is a file at least
    placed = runs.join(F.broadcast(shards) if small else shards, "shard").withColumn("base", F.col("shard_base") + F.col("before"))
    return placed.select("doc_ids", "counts", "payload", "base").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids binary")


def ids_path(spark: SparkSession) -> str:
    return new_path(spark, "ids")
