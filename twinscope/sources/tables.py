"""Pair, score and fingerprint files. Schemas are explicit: a label is a copy only if it is "1"."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscope.functions.fingerprints import from_hex, from_hex_list

PAIRS = "original_image string, copy_image string, manipulation_type string, is_copy string"
COMPOSITES = PAIRS + ", manip_first string, manip_second string"
COUNT_SCORES = PAIRS + ", orb_inliers int"
LIST_SCORES = PAIRS + ", shash_dist double"
HASHES = "image string, ahash string, phash string, hsvhash string"
SEGMENTS = "image string, segments string"
AUTHOR = "original_image string, copy_image string, is_copy string, aHash_dist int, pHash_dist int, hsvHash_dist int, sHash_dist double"
TRUE_WORDS = ("true", "1", "yes", "t", "y")


def is_one(label: Column) -> Column:
    return F.trim(label) == "1"


def is_true_word(label: Column) -> Column:
    return F.lower(F.trim(label)).isin(*TRUE_WORDS)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_pairs(spark: SparkSession, path: str, schema: str = PAIRS) -> DataFrame:
    rows = read_csv(spark, path, schema)
    return rows.select(*(F.trim(c).alias(c) if t == "string" and c != "is_copy" else F.col(c) for c, t in rows.dtypes if c != "is_copy"), is_one(F.col("is_copy")).alias("is_copy"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An empty table of the schema where there is no file: every score abstains."""
    return read_pairs(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema).withColumn("is_copy", is_one(F.col("is_copy")))


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, HASHES)
    return rows.select("image", *(from_hex(F.col(c)).alias(c) for c in ("ahash", "phash", "hsvhash")))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, SEGMENTS)
    return rows.select("image", from_hex_list(F.coalesce("segments", F.lit(""))).alias("segments"))


def write_hashes(hashes: DataFrame, path: str) -> None:
    hashes.select("image", *(F.lower(F.hex(c)).alias(c) for c in ("ahash", "phash", "hsvhash"))).write.csv(path, header=True)


def write_segments(hashes: DataFrame, path: str) -> None:
    hashes.select("image", F.array_join(F.transform("segments", lambda x: F.lower(F.hex(x))), "|").alias("segments")).write.csv(path, header=True)


def missing(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Keys that a cache doesn't have yet."""
    return wanted.select(key).distinct().join(cached.select(key), key, "left_anti")


def refreshed(wanted: DataFrame, cached: DataFrame, key: str, compute) -> DataFrame:
    """The cache with what was missing."""
    return cached.unionByName(compute(missing(wanted, cached, key)))


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(order).limit(n)


def write_curve(curve: DataFrame, path: str, budgets: list[int], canonical: list[int]) -> bool:
    """Writes only the curve of the full list of budgets."""
    if budgets != canonical:
        return False
    curve.write.mode("overwrite").csv(path, header=True)
    return True


def collection_of(name: Column) -> Column:
    return F.substring_index(name, "_", 1)
