"""Nearest fingerprints: range joins by near bands, bit-sampling LSH, mutual neighbours and votes for images."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscope.functions.fingerprints import hamming
from twinscope.session import materialised

#: Hashes of a side that are tried at once.
BLOCK = 16384


class Bands:
    """A hash of `bits` bits cut into bands, each with a radius: two hashes at most `most` bits apart are within the radius
    in one band at least, as the radii and the number of bands add up to more than `most`.

    There are as few bands (the wider, the fewer strangers meet) as keep the ways to change a band at MOST_WAYS at most.
    """

    MOST_WAYS = 100

    def __init__(self, most: int, bits: int = 64):
        for count in range(1, most + 2):
            even = lambda n, k, c=count: n * (k + 1) // c - n * k // c
            self.parts = [(bits * k // count, even(bits, k), even(most + 1, k) - 1) for k in range(count)]  # first bit, width, radius
            if max(sum(comb(w, i) for i in range(r + 1)) for _, w, r in self.parts) <= self.MOST_WAYS:
                return

    def _value(self, h: Column, at: int, width: int) -> Column:
        return F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))

    def own(self, h: Column) -> Column:
        """A struct of band and value for each band."""
        return F.array(*(F.struct(F.lit(k).alias("band"), self._value(h, at, w).alias("value")) for k, (at, w, _) in enumerate(self.parts)))

    def near(self, h: Column) -> Column:
        """As own, with all values inside of each band's radius."""

        def ways(k: int, at: int, width: int, radius: int) -> Column:
            masks = [sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(width), n)]
            value = self._value(h, at, width)
            return F.transform(F.array(*(F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long") for m in masks)), lambda m: F.struct(F.lit(k).alias("band"), value.bitwiseXOR(m).alias("value")))

        return F.flatten(F.array(*(ways(k, *p) for k, p in enumerate(self.parts))))

    def first(self, x: Column, y: Column) -> Column:
        """The first band in which two hashes are within its radius."""
        differ = x.bitwiseXOR(y)
        return F.coalesce(*(F.when(F.bit_count(self._value(differ, at, w)) <= r, k) for k, (at, w, r) in enumerate(self.parts)))


def within_distance(left: DataFrame, right: DataFrame, most: int, bits: int = 64) -> DataFrame:
    """a, b, distance of all pairs of (id, h) rows at most `most` bits apart. Rows meet where a band of the right one is near
    the left one's; a pair that meets in several bands is given for its first one, so nothing has to be made distinct.

    The left rows are never broadcast: Spark takes them for as large as before they were multiplied."""
    cut = Bands(most, bits)
    asked = left.select(F.col("id").alias("a"), F.col("h").alias("ha"), F.inline(cut.near(F.col("h"))))
    kept = right.select(F.col("id").alias("b"), F.col("h").alias("hb"), F.inline(cut.own(F.col("h"))))
    distance = hamming(F.col("ha"), F.col("hb"))
    met = asked.hint("merge").join(kept, ["band", "value"]).where((distance <= most) & (cut.first(F.col("ha"), F.col("hb")) == F.col("band")))
    return met.select("a", "b", distance.alias("distance"))


def nearest_neighbour(left: DataFrame, right: DataFrame, most: int | None = None) -> DataFrame:
    """a, b, distance of each left row's nearest right row, by trying all in blocks; ties go to the smallest b.

    Equal hashes are tried once. A block of left hashes and one of right hashes give a row for each of the left ones, so
    no pair is ever written. Null hashes are near to nothing."""
    asked = materialised(left.where("h is not null").select("h").distinct(), "asked-hashes")
    kept = materialised(right.where("h is not null").groupBy("h").agg(F.min("id").alias("b")), "kept-hashes")
    nx, ny = (max(1, -(-rows.count() // BLOCK)) for rows in (asked, kept))
    block = lambda n: F.pmod(F.xxhash64("h"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = x if len(y) else x.iloc[:0], y.sort_values("b", kind="stable")
        h, other = x["h"].to_numpy(), y["h"].to_numpy()
        at, apart = np.zeros(len(h), np.int64), np.zeros(len(h), np.int32)
        for k in range(0, len(h), 64):
            bits = np.bitwise_count((h[k : k + 64, None] ^ other).view(np.uint64))
            at[k : k + 64] = near = bits.argmin(1)
            apart[k : k + 64] = np.take_along_axis(bits, near[:, None], 1)[:, 0]
        return pd.DataFrame({"h": h, "distance": apart, "b": y["b"].to_numpy()[at]})

    x = asked.withColumn("x", block(nx)).withColumn("y", every(ny)).groupBy("x", "y")
    y = kept.withColumn("y", block(ny)).withColumn("x", every(nx)).groupBy("x", "y")
    met = x.cogroup(y).applyInPandas(run, f"h long, distance int, b {dict(right.dtypes)['id']}")
    best = met.groupBy("h").agg(F.min(F.struct("distance", "b")).alias("x"))
    found = left.select(F.col("id").alias("a"), "h").join(best, "h").groupBy("a").agg(F.min("x").alias("x"))
    out = found.select("a", F.col("x.b").alias("b"), F.col("x.distance").alias("distance"))
    return out if most is None else out.where(F.col("distance") < most)


def sampled_bits(table: int, size: int, bits: int = 64) -> list[int]:
    """The bits that a table of the index reads, `bits` a power of two: all different, by an odd stride of the table's own."""
    return [(table * 11 + (2 * table + 5) * k) % bits for k in range(size)]


def lsh_neighbour(left: DataFrame, right: DataFrame, tables: int = 6, size: int = 12, probes: int = 1) -> DataFrame:
    """As nearest_neighbour, among rows that agree in the sampled bits of a table, up to `probes` of these."""
    picks = [sampled_bits(t, size) for t in range(tables)]

    def keys(df: DataFrame, name: str, changed: int) -> DataFrame:
        """A row for each table and each way to change up to `changed` of its bits."""
        read = F.array(*(F.array(*map(F.lit, p)) for p in picks))
        masks = F.array(*(F.lit(sum(1 << k for k in c)).cast("long") for n in range(changed + 1) for c in combinations(range(size), n)))
        bit = lambda b, k: F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col("h"), b).bitwiseAND(F.lit(1).cast("long")), k)
        rows = df.select(F.col("id").alias(name), F.col("h").alias(f"h{name}"), "h", F.posexplode(read).alias("t", "bits"))
        rows = rows.withColumn("key", F.aggregate(F.transform("bits", bit), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y)))
        rows = rows.withColumn("mask", F.explode(masks))
        return rows.select(name, f"h{name}", "t", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))

    asked, kept = keys(left, "a", probes), keys(right, "b", 0)
    met = asked.join(kept, ["t", "key"]).select("a", "b", hamming(F.col("ha"), F.col("hb")).alias("distance"))
    best = met.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("x"))
    return best.select("a", F.col("x.b").alias("b"), F.col("x.distance").alias("distance"))


def mutual(met: DataFrame, query: str = "a", train: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows that are each other's nearest; ties go to the smallest id."""
    forth = Window.partitionBy(*by, query).orderBy("distance", train)
    back = Window.partitionBy(*by, train).orderBy("distance", query)
    return met.withColumn("_f", F.row_number().over(forth)).withColumn("_b", F.row_number().over(back)).where("_f = 1 and _b = 1").drop("_f", "_b")


def voted(found: DataFrame, query: str, image: str) -> DataFrame:
    """The image with most votes of each query; ties go to the smallest image."""
    counts = found.groupBy(query, image).agg(F.count("*").alias("votes"))
    best = counts.groupBy(query).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(image))).alias("x"))
    return best.select(query, F.col(f"x.{image}").alias(image), (-F.col("x.v")).alias("votes"))
