"""Approximate nearest neighbours: inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and codebooks are fitted on at most `sample` vectors, taken by hash; every vector is indexed. The
index is dealt by hash to PARTS parts, however large it is, so a list that holds a third of all rows is in all of them.
A query goes to every part, which is read list by list in blocks of bounded size, and is scored by its asymmetric
distance tables against the codes of its `probe` share of nearest lists only. A part keeps and gives a query's `rerank`
best, so what is given grows with the queries only. Of all parts' best, its `rerank` best are ranked by the exact inner product of the original vectors in double precision, so as many are ranked at every size of
the table.

Codes alone miss neighbours where rows differ by less than a code can tell (copies, near copies, a common offset) or have
many components. So an exact check follows: each row has the distance to what its codes stand for, which bounds
its inner product with any query; every row whose bound reaches the query's k-th score so far is multiplied in double
precision. What is found is all that brute force finds, in the same order. Codes are of rows less the sample's median
and by its scale, so that no offset or size of the numbers wears them out; where a bound overflows, the row is multiplied.

Vectors that are null, zero, of another than the most common length, or that hold null or non-finite components take
no part. Ties go to the smaller vec_id. Rows that share a vec_id are candidates each, but never of a query with that
vec_id; such rows ask once, by the first of their vectors. A query probes more lists until these hold
`least` rows, so a small table is scored whole, and only one with fewer than k candidates gives fewer rows. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinscope.llm.common import stored, tidy

#: Parts of the index, whatever its size.
PARTS = 8
#: Queries that go through a part together, at most.
QUERY_ROWS = 2048
#: Bytes of vectors that the exact check holds at a time.
CHECK_BYTES = 1 << 25
FOUND = "query_id long, vec_id long, uid long, near float"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v, an array of finite doubles of one length, not all zero."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["size"] if sizes else -1))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centres * centres).sum(1) - 2 * part @ centres.T, axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, without overflow of squares."""
    top = np.abs(x).max(1, initial=0.0)
    with np.errstate(over="ignore"):
        return top * np.sqrt(((x / np.where(top > 0, top, 1)[:, None]) ** 2).sum(1))


def directions(q: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    q = q / np.abs(q).max(1, keepdims=True)
    return q / norms(q)[:, None]


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int, width: int, seed: int = 0):
        """width: components in a subspace, each coded in a byte."""
        rng = np.random.default_rng(seed)
        half = (len(sample) - 1) // 2
        self.middle = np.partition(sample, half, axis=0)[half]
        with np.errstate(over="ignore"):
            far = np.sort(norms(sample - self.middle)) / np.sqrt(sample.shape[1])
        far = far[(far > 0) & (far < 1e300)]
        self.scale = float(far[len(far) // 2]) if len(far) else 1.0
        sample = self.scaled(sample)
        self.dim, self.width = sample.shape[1], width
        self.parts = -(-self.dim // width)
        self.coarse = kmeans(sample, lists, 8, rng)
        rest = self.split(sample - self.coarse[nearest(sample, self.coarse)])
        self.books = np.zeros((self.parts, 256, width), np.float32)
        for p in range(self.parts):
            centres = kmeans(rest[:, p], 256, 5, rng)
            self.books[p] = centres[np.arange(256) % len(centres)]

    def split(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.parts * self.width), np.float32)
        padded[:, : self.dim] = x
        return padded.reshape(len(x), self.parts, self.width)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip((x - self.middle) / self.scale, -1e9, 1e9).astype(np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.scaled(x)
        home = nearest(x, self.coarse)
        rest = self.split(x - self.coarse[home])
        return home, np.stack([nearest(rest[:, p], self.books[p]) for p in range(self.parts)], 1).astype(np.uint8)

    def decoded(self, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The scaled vectors that the codes stand for."""
        rest = np.stack([self.books[p][codes[:, p]] for p in range(self.parts)], 1).reshape(len(codes), -1)[:, : self.dim]
        return self.coarse[home] + rest

    def off(self, x: np.ndarray, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """For each row, over the scale: no inner product with a row of length one is farther than this from that of its
        codes, rounding included. Infinite where it can't be told."""
        stands = self.decoded(home, codes).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            gap = norms(x - self.middle - self.scale * stands) / self.scale * (1 + 1e-6)
            single = (self.dim + 8) * 2.0**-23 * norms(stands)
            double = (self.dim + 8) * 2.0**-51 * (norms(x) / self.scale + norms(self.middle[None]) / self.scale)
            out = gap + single + double
        return np.where(out < 1e37, out, np.inf)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and subspace the inner products with the 256 codes."""
        return np.einsum("qpw,pcw->qpc", self.split(q), self.books, dtype=np.float32)

    def probed(self, q: np.ndarray, sizes: np.ndarray, probe: float, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Marks of the lists that each query probes (the nearest ones, until they hold `rows` rows at least), and the
        inner products with their centroids."""
        near = q.astype(np.float32) @ self.coarse.T.astype(np.float32)
        order = np.argsort(-near, 1, kind="stable")
        held = np.cumsum(sizes[order], 1)
        enough = (held < rows).sum(1) + 1
        marks = np.zeros(near.shape, bool)
        np.put_along_axis(marks, order, np.arange(len(sizes)) < np.maximum(enough, max(1, round(probe * len(sizes))))[:, None], 1)
        return marks, near


def fit(rows: DataFrame, lists: int = 1024, width: int = 2, sample: int = 10_000) -> Quantiser | None:
    """A list for ten sampled vectors, `lists` at most."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas().sort_values("vec_id", kind="stable")
    return Quantiser(np.array(found["v"].tolist(), np.float64), min(lists, max(1, len(found) // 10)), width) if len(found) else None


def index(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """vec_id, uid (a number of its own), v, list, codes and how far these are off, of every row, written to the shared folder."""
    shared = rows.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.array(batch["v"].tolist(), np.float64)
                home, codes = shared.value.encode(x)
                yield batch.assign(list=home.astype(np.int32), codes=[c.tobytes() for c in codes], off=shared.value.off(x, home, codes))

    return stored(rows.mapInPandas(run, "vec_id long, v array<double>, list int, codes binary, off double").withColumn("uid", F.monotonically_increasing_id()), "vectors")


def blocks_of(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first block and how many it has: runs of small lists share one, a large list has its own."""
    first, many = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    block, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > block_rows:
            block, held = block + 1, 0
        first[k], many[k] = block, max(1, -(-n // block_rows))
        held += n
        if many[k] > 1:
            block, held = block + int(many[k]), 0
    return first, many


def nearest_by_codes(found: DataFrame, queries: DataFrame, quantiser: Quantiser, probe: float, rerank: int, least: int, block_rows: int) -> DataFrame:
    """The `rerank` best of each part of the index for each query, by distance tables."""
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast(quantiser)
    sizes = np.zeros(len(quantiser.coarse), np.int64)
    for r in found.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row for each list
        sizes[r["list"]] = r["n"]
    query_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    none = F.lit(None)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    indexed = found.select("vec_id", "uid", "list", "codes", none.cast("array<double>").alias("v"), F.pmod(F.xxhash64("uid"), F.lit(PARTS)).cast("int").alias("part"), every(query_blocks).alias("qb"))
    asked = queries.select("vec_id", none.cast("long").alias("uid"), F.lit(-1).alias("list"), none.cast("binary").alias("codes"), "v", every(PARTS).alias("part"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"))
    put = asked.unionByName(indexed).repartition("qb", "part").sortWithinPartitions("qb", "part", "list", "vec_id", "uid")

    def scored(q: np.ndarray, q_ids: np.ndarray, held: list[pa.RecordBatch], best: list[tuple[np.ndarray, ...]]) -> None:
        """Puts the rows of `held` to the best of each 256 queries."""
        ids, uids, home = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("vec_id", "uid", "list"))
        codes = np.frombuffer(b"".join(c for x in held for c in x.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        cuts = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)]
        for at, a in enumerate(range(0, len(q), 256)):
            best[at] = _merged(best[at], ids, uids, _block(shared.value, q[a : a + 256], q_ids[a : a + 256], ids, home, codes, cuts, sizes, probe, rerank, least), rerank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asking, held, rows, q = None, [], [], 0, None
        best: list[tuple[np.ndarray, ...]] = []

        def ended() -> Iterator[pa.RecordBatch]:
            if q is not None:
                if held:
                    scored(*q, held, best)
                for at, (row, *cols) in enumerate(best):
                    yield pa.RecordBatch.from_arrays([pa.array(q[1][256 * at + row]), *map(pa.array, cols)], names=["query_id", "vec_id", "uid", "near"])

        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("qb", "part")], 1)
            index_row = batch.column("list").to_numpy() >= 0
            mark = np.column_stack([where, index_row])
            cuts = [0, *(np.flatnonzero((mark[1:] != mark[:-1]).any(1)) + 1).tolist(), len(mark)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                piece = batch.slice(x, y - x)
                if key != (now := tuple(where[x].tolist())):
                    yield from ended()
                    key, asking, held, rows, q, best = now, [], [], 0, None, []
                if not index_row[x]:
                    asking.append(piece)
                    continue
                if asking:
                    q = (directions(np.array([v for p in asking for v in p.column("v").to_pylist()])).astype(np.float32), np.concatenate([p.column("vec_id").to_numpy() for p in asking]))
                    best = [_NOTHING] * -(-len(q[0]) // 256)
                    asking = []
                if q is None:  # nothing asks here
                    continue
                held.append(piece)
                rows += piece.num_rows
                if rows >= block_rows:
                    scored(*q, held, best)
                    held, rows = [], 0
        yield from ended()

    return put.mapInArrow(tidy(run), FOUND)


_NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))


def _merged(best: tuple[np.ndarray, ...], ids: np.ndarray, uids: np.ndarray, got: list[tuple[np.ndarray, ...]], rerank: int) -> tuple[np.ndarray, ...]:
    """The `rerank` best of each query (row, id, uid, value), of those so far and new ones (row, place, value)."""
    row, col, value = (np.concatenate(c) for c in zip(*got, strict=True)) if got else (_NOTHING[0], _NOTHING[0], _NOTHING[3])
    row, id_, uid, value = (np.concatenate(c) for c in zip(best, (row, ids[col], uids[col], value.astype(np.float32)), strict=True))
    order = np.lexsort((uid, id_, -value, row))
    row = row[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < rerank
    return row[kept], *(x[order][kept] for x in (id_, uid, value))


def _block(quantiser: Quantiser, q: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, home: np.ndarray, codes: np.ndarray, cuts: list[int], sizes: np.ndarray, probe: float, rerank: int, least: int) -> list[tuple[np.ndarray, ...]]:
    """query, place in the block and value of the `rerank` best of each list that a query probes."""
    tables = quantiser.tables(q)
    marks, near = quantiser.probed(q, sizes, probe, least)
    got: list[tuple[np.ndarray, ...]] = []
    for x, y in zip(cuts, cuts[1:], strict=False):
        mine = np.flatnonzero(marks[:, home[x]])
        if not len(mine):
            continue
        score = np.repeat(near[mine, home[x], None], y - x, 1)
        for p in range(codes.shape[1]):
            score += tables[mine, p][:, codes[x:y, p]]
        score[q_ids[mine, None] == ids[None, x:y]] = -np.inf
        if y - x > rerank:
            top = np.argpartition(-score, rerank, 1)[:, :rerank]
            row, col = np.repeat(mine, rerank), top.ravel()
            value = np.take_along_axis(score, top, 1).ravel()
        else:
            row, col, value = np.repeat(mine, y - x), np.tile(np.arange(y - x), len(mine)), score.ravel()
        on = value > -np.inf
        got.append((row[on], x + col[on], value[on]))
    return got


def products(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """q[row] times x[col], added up in the order of the components."""
    out = np.zeros(len(row))
    with np.errstate(over="ignore", invalid="ignore"):
        for a in range(0, len(row), 16384):
            r, c = row[a : a + 16384], col[a : a + 16384]
            part = q[r] * x[c]
            for i in range(part.shape[1]):
                out[a : a + 16384] += part[:, i]
    return out


def reaching(quantiser: Quantiser, q: np.ndarray, least: np.ndarray) -> np.ndarray:
    """What the inner product of a query's direction with a row's codes and how far they are off must add up to, for the
    row to score `least` with the query; minus infinity where doubles could overflow or vanish."""
    size = norms(q)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        unit = size * quantiser.scale
        base = q @ quantiser.middle
        slack = (quantiser.dim + 8) * 2.0**-50 * (np.abs(least) + np.abs(base) + size * norms(quantiser.middle[None]))
        t = (least - base - slack) / unit
        t -= 4e-7 * np.abs(t)
    safe = (unit > 1e-250) & (unit < 1e250) & (size > 1e-250) & (size < 1e250) & (np.abs(base) < 1e290) & (np.abs(least) < 1e290) & (np.abs(t) < 1e37)
    return np.where(safe, t, -np.inf).astype(np.float32)


def checked(found: DataFrame, asked: DataFrame, quantiser: Quantiser, k: int, check_bytes: int = CHECK_BYTES) -> DataFrame:
    """query_id, vec_id, uid, score: all rows that may be among the k nearest of a query. asked: vec_id, v and least, a
    score that k rows reach (null: none is known).

    Each block of rows is held once and all queries go by, so rows are shuffled once, and queries once for each block."""
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast(quantiser)
    blocks = max(PARTS, -(-found.count() * quantiser.dim * 8 // check_bytes))
    none = lambda t: F.lit(None).cast(t)
    rows = found.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"), F.lit(False).alias("asks"), "vec_id", "uid", "v", "list", "codes", F.col("off").alias("bound"))
    queries = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("asks"), "vec_id", none("long").alias("uid"), "v", none("int").alias("list"), none("binary").alias("codes"), F.coalesce("least", F.lit(float("-inf"))).alias("bound"))
    put = rows.unionByName(queries).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    vectors = lambda batch: batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
    plain = lambda batch, c: batch.column(c).to_numpy(zero_copy_only=False)

    def scored(q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, held: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        ids, uids, x, stands, off = held
        towards, t = directions(q).astype(np.float32), reaching(shared.value, q, least)[:, None]
        best = (*_NOTHING[:3], np.zeros(0))
        for a in range(0, len(ids), 8192):
            bound = towards @ stands[a : a + 8192].T
            bound += off[None, a : a + 8192]
            row, col = np.nonzero(~(bound < t))
            col += a
            other = q_ids[row] != ids[col]
            row, col = row[other], col[other]
            score = products(q, x, row, col)
            kept = ~(score < least[row])
            row, col, score = row[kept], col[kept], score[kept]
            row, id_, uid, score = (np.concatenate(c) for c in zip(best, (row, ids[col], uids[col], score), strict=True))
            order = np.lexsort((uid, id_, -score, ~np.isnan(score), row))
            row = row[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            best = (row[first], *(c[order][first] for c in (id_, uid, score)))
        return pa.RecordBatch.from_arrays([pa.array(q_ids[best[0]]), *map(pa.array, best[1:])], names=["query_id", "vec_id", "uid", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, held = None, [], None
        for batch in batches:
            mark = np.stack([plain(batch, "block"), plain(batch, "asks").astype(np.int64)], 1)
            cuts = [0, *(np.flatnonzero((mark[1:] != mark[:-1]).any(1)) + 1).tolist(), len(mark)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if key != (now := mark[a, 0]):
                    key, pieces, held = now, [], None
                if not mark[a, 1]:
                    codes = np.frombuffer(b"".join(piece.column("codes").to_pylist()), np.uint8).reshape(b - a, -1)
                    pieces.append((plain(piece, "vec_id"), plain(piece, "uid"), vectors(piece), shared.value.decoded(plain(piece, "list"), codes), plain(piece, "bound").astype(np.float32)))
                    continue
                if held is None:
                    if not pieces:  # no rows here
                        continue
                    held, pieces = tuple(np.concatenate(c) for c in zip(*pieces, strict=True)), []
                for c in range(0, b - a, 256):
                    some = piece.slice(c, 256)
                    yield scored(vectors(some), plain(some, "vec_id"), plain(some, "bound"), held)

    return put.mapInArrow(tidy(run), "query_id long, vec_id long, uid long, score double")


def search(vectors: DataFrame, every: int = 20, k: int = 20, probe: float = 0.1, rerank: int = 100, least: int = 2000, block_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by `every`. probe, rerank, least
    and block_rows change how soon these are found, not which."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    quantiser = fit(rows)
    if quantiser is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = index(rows, quantiser)
    queries = found.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("uid", "v")).alias("x")).select("vec_id", "x.v")
    best = nearest_by_codes(found, queries, quantiser, probe, rerank, max(least, 2 * (k + 1)), block_rows)
    near = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id", "uid")
    best = best.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= rerank).select("query_id", "uid")
    product = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0).cast("double"), lambda a, x: a + x)
    exact = best.join(found.select("uid", "vec_id", "v"), "uid").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    kth = ranked(exact.select("query_id", "vec_id", "uid", product.alias("score"))).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    asked = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").select("vec_id", "v", "least")
    return ranked(checked(found, asked, quantiser, k)).select("query_id", "rank", "vec_id", "score")
