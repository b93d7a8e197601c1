"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope.session import shared_dir

WHITE = "\\x20\\x09-\\x0D"


#: Whole texts cross to Python in batches of so many rows and bytes at most (a longer text comes alone).
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What a task keeps for the next one in its worker (piece tables, powers); called when a task of another kind begins.
_KEPT: list[Callable[[], None]] = []


def tidy(run: Callable, keeps: bool = False) -> Callable:
    """run, for mapInArrow; what the task kept is let go when it ends, and freed memory goes back to the system.

    Workers are used again for later stages, in turn, so what one stage leaves in each adds to the next one's peak.
    keeps: the task leaves what it kept to others of its kind, and uses what these have left.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            let_go()
        try:
            yield from run(batches)
        finally:
            if not keeps:
                let_go()
            trim()

    return tidied


def tidy_groups(run: Callable) -> Callable:
    """run, for applyInPandas; as tidy, after a group that was large."""

    def tidied(part):
        let_go()
        out = run(part)
        let_go()
        if len(part) > 1000:
            trim()
        return out

    return tidied


def row_key(*columns: str) -> tuple[Column, Column]:
    """Two columns, never null, that are equal for rows that are equal in these columns and for no others: the first
    column as text, and a hash of all and of which are null."""
    bare = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    nulls = [F.col(c).isNull() for c in columns]
    return bare[0], F.xxhash64(*bare, *nulls)


def let_go() -> None:
    for forget in _KEPT:
        forget()
    _KEPT.clear()


def trim() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/twinscope-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back, which cuts the lineage durably. Row groups are
    small, as each writing task holds one in memory."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the folder of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/twinscope-" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that have run: it does so when the driver collects its garbage, which
    may be long after the result was stored."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Runs of at most `rows` rows whose texts hold about `most` bytes; a longer text comes alone."""
    texts = batch.column(column)
    if batch.num_rows == 0:
        return
    sizes = _lengths(texts)
    group = np.cumsum(sizes) // most
    cuts = sorted({*range(0, batch.num_rows, rows), *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows})
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def _lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and the n + 1 places where they begin; null is empty."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, (offsets - offsets[0]) if len(texts) else np.zeros(1, np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def heads(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the next eight bytes of each run raw[start:start + size], zeros after its end.

    With its size they are the run itself, where that is 16 at most.
    """
    padded = np.zeros(len(raw) + 24, np.uint8)
    padded[: len(raw)] = raw
    words = np.ndarray((len(raw) + 16,), "<u8", buffer=padded, strides=(1,))
    return words[start] & _LOW_BYTES[np.minimum(size, 8)], words[start + 8] & _LOW_BYTES[np.clip(size - 8, 0, 8)]


def run_hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes: of short ones from the bytes themselves, of others by XXH3."""
    import xxhash

    one, two = heads(raw, start, size)
    h = mixed(mixed(one + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ two * np.uint64(0xC2B2AE3D27D4EB4F))
    long = np.flatnonzero(size > 16)
    if len(long):
        data = raw.tobytes()
        h[long] = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start[long].tolist(), (start[long] + size[long]).tolist(), strict=True)), np.uint64, len(long))
    return h


def wide_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit XXH3 of each run."""
    import xxhash

    data = raw.tobytes()
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), ">u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)


class RollingHash:
    """Hashes of byte runs of one buffer: sums of byte values times powers of an odd base, modulo 2**64.

    `of(start, length)` gives equal values for equal runs of equal length. Different runs can have equal values (some
    long regular ones do in every base), so these hashes choose candidates and never decide that runs are equal.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.down = _powers(pow(self.BASE, -1, 2**64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        values = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1000))[raw]
        values *= _powers(self.BASE, n + 1)[:n]
        np.cumsum(values, out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.down[start])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 1 << 21:  # one very long text; not kept
            return have[:n]
        _POWERS[base] = have
        if _POWERS.clear not in _KEPT:
            _KEPT.append(_POWERS.clear)
    return have[:n]


def words_of(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space, and the row of each; no run crosses a row."""
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~white
    begins = inside[1:-1] & ~inside[:-2]
    edge = starts[1:-1]
    edge = edge[edge < len(raw)]
    begins[edge] |= inside[1:-1][edge]
    first = np.flatnonzero(begins)
    ends = inside[1:-1] & ~inside[2:]
    prior = edge[edge > 0] - 1
    ends[prior] |= inside[1:-1][prior]
    last = np.flatnonzero(ends) + 1
    row = np.searchsorted(starts, first, side="right") - 1
    return first, last, row


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def hashed_rows(*cols: str):
    return F.xxhash64(*cols)


class Bloom:
    """A filter of a fixed number of bits over 64-bit hashes: it may let others pass, never loses a member.

    Its size is bounded whatever the number of members, so it can be broadcast.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, hashes: DataFrame, most_bits: int = 28) -> Bloom:
        """hashes: one long column `h`. At most 2**(most_bits - 6) words come to the driver."""
        hashes = hashes.where(F.col("h").isNotNull())
        bits = min(most_bits, max(16, (12 * hashes.count()).bit_length()))
        mask = (1 << bits) - 1
        places = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 34).bitwiseAND(mask)))
        rows = hashes.select(places.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("w")).toPandas()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[rows["i"].to_numpy().astype(np.int64)] = rows["w"].to_numpy().astype(np.int64).view(np.uint64)
        return cls(words, bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        h, mask = h.astype(np.int64).view(np.uint64), np.uint64((1 << self.bits) - 1)
        out = np.ones(len(h), bool)
        for p in (h & mask, (h >> np.uint64(34)) & mask):
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def member(spark: SparkSession, of: Bloom):
    """A UDF of longs that are never null: whether `of` may have them. It is marked as not deterministic so that it runs
    where it is put, once: a copy of it in a pushed filter, or on the other side of a join, would be one more worker."""
    shared = spark.sparkContext.broadcast(of)

    @F.arrow_udf("boolean")
    def hit(h: pa.Array) -> pa.Array:
        return pa.array(shared.value.has(h.to_numpy(zero_copy_only=False)))

    return hit.asNondeterministic()


def whole(batches, *names: str) -> list[np.ndarray]:
    """Columns of all batches of a partition as arrays."""
    got = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches]
    return [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64) for _ in names]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids. A Bloom filter keeps most other rows out of the join."""
    ids = ids.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    hit = member(docs.sparkSession, Bloom.of(ids.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"))))
    marked = docs.select(F.struct("*").alias("row"), "doc_id", hit(F.xxhash64(F.col("doc_id").cast("long"))).alias("hit"))
    rest = marked.where("hit").join(ids, "doc_id", "left_anti")
    return marked.where("not hit").select("row.*").union(rest.select("row.*"))
