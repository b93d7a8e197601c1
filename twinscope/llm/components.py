"""Connected components by large-star and small-star steps on DataFrames; few edges are joined in one task instead."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.llm.common import stored, tidy, whole

#: Edges that one task takes, 16 bytes each; the rounds of more edges cost more than that.
FEW = 1 << 17


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, and the smallest node that each reaches."""
    nodes, at = np.unique(np.append(u, v), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while len(u):
        np.minimum.at(least, np.maximum(u, v), np.minimum(u, v))
        while (least != (up := least[least])).any():
            least = up
        u, v = least[u], least[v]
        u, v = u[u != v], v[u != v]
    return nodes, nodes[least]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes, least = least_reached(*whole(batches, "u", "v"))
    for k in range(0, len(nodes), 1 << 17):
        part = slice(k, k + (1 << 17))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(least[part])], names=["node", "component"])


def components(edges: DataFrame, a: str, b: str, label: str = "components") -> DataFrame:
    """node and component (the smallest node it reaches) of every node of an edge. Each round is written to the shared folder."""
    now = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), label)
    if now.count() <= FEW:
        return stored(now.coalesce(1).mapInArrow(tidy(_at_once), "node long, component long"), label)
    seen = None
    while True:
        now = stored(_small(_large(now)), label)
        mark = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).head()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
