"""Checks new fingerprints against a gallery as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from twinscope.operators.matching import within_distance


def near_gallery(stream: DataFrame, gallery: DataFrame, most: int, bits: int = 64) -> DataFrame:
    """a, b, distance of streamed (id, h) rows and gallery rows at most `most` bits apart: a stream-static join that keeps no
    state, as each pair is given once."""
    return within_distance(stream, gallery, most, bits)


def run_once(found: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, written once to `path`."""
    found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()
