"""Best-fit packing by minimum bin slack.

Documents are cut into pieces of at most `size` tokens. A bin is filled by taking the longest piece left and the
combination of other lengths that fills the rest best, found with a bitset subset-sum over the lengths available.
The plan depends on how many pieces each length has, so it is made once from a histogram of at most `size` rows;
a combination is repeated as often as its lengths last. Pieces then take their places by their rank in their length.

Null and empty texts are one piece that holds the end id. Repeated and null doc_ids are packed as separate rows. An empty
table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinscope.llm.common import slices, stored, tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_into_pieces(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2, size: int = 1024, keeps: bool = True) -> DataFrame:
    """A row per piece of each document's ids; only a first piece is shorter than `size`. keeps: workers keep their piece
    tables from task to task, which saves time and takes memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from twinscope.llm.words import encoder

        enc = encoder(tokenizer, kind)
        for batch in batches:
            for part in slices(batch):
                ids, counts = enc.ids(part.column("text"))
                ends = np.cumsum(counts)
                at = np.repeat(np.arange(len(counts)), counts)
                whole = np.full(len(ids) + len(counts), end_id, "<u4")
                whole[np.arange(len(ids)) + at] = ids
                total = counts + 1
                first = ends - counts + np.arange(len(counts))
                n = -(-total // size)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                head = (total - 1) % size + 1
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * size)
                length = np.where(piece == 0, head[row], size)
                a = first[row] + start
                data = memoryview(whole.tobytes())
                crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, keeps), PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that they fill `room` best."""
    layers, items, bits = [1], [], 1
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left and not bits >> room & 1:
            take = min(step, left)
            bits |= bits << (length * take) & mask
            layers.append(bits)
            items.append((length, take))
            left, step = left - take, step * 2
        if bits >> room & 1:
            break
    total, chosen = bits.bit_length() - 1, {}
    for j in range(len(items), 0, -1):
        if not layers[j - 1] >> total & 1:
            length, take = items[j - 1]
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(histogram: dict[int, int], size: int = 1024) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, each with the number of bins that it fills."""
    left, bins = {x: c for x, c in histogram.items() if c}, []
    while left:
        seed = max(left)
        rest = left | {seed: left[seed] - 1}
        chosen = fullest(rest, size - seed)
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(left[x] // m for x, m in chosen.items())
        bins.append((chosen, times))
        for x, m in chosen.items():
            left[x] -= m * times
            if not left[x]:
                del left[x]
    return bins


def places(bins: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks and where they go, ordered by length and first rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, times in bins:
        offset = 0
        for length in sorted(chosen, reverse=True):
            m = chosen[length]
            rows.append((length, taken.get(length, 0), sequence, m, offset))
            taken[length] = taken.get(length, 0) + m * times
            offset += m * length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "rank", "sequence", "m", "offset"))}


def pack(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2, size: int = 1024, rows_per_block: int = 500_000, keeps: bool = True) -> DataFrame:
    """Per piece its sequence and its offset there. Lengths with many pieces are ranked in blocks of `rows_per_block`."""
    pieces = stored(cut_into_pieces(docs, tokenizer, kind, end_id, size, keeps), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    table = places(plan(histogram, size))
    where = table["length"] << 44 | table["rank"]
    blocks = max(16, sum(histogram.values()) // rows_per_block + 1)

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(where, length.to_numpy() << 44 | rank.to_numpy(), side="right") - 1
        k = rank.to_numpy() - table["rank"][at]
        return pd.DataFrame({"sequence_id": table["sequence"][at] + k // table["m"][at], "offset": table["offset"][at] + k % table["m"][at] * length.to_numpy()})

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")))
    sums = dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = sums.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    out = ranked.join(before, ["length", "block"]).withColumn("to", placed("length", (F.col("before") + F.col("nth") - 1).cast("long")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("to.sequence_id").alias("sequence_id"), F.col("to.offset").alias("offset"))
