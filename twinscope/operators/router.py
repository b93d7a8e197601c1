"""A forest that says from one image what was done to it, and the trust in signals that follows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.functions import fingerprints as fp


def canvas_features(rows: DataFrame) -> DataFrame:
    """rows with numbers f0, f1, ... of their canvas v, as column expressions."""
    v = F.col("v")
    mean = fp.mean_of(v)
    spread = F.transform(F.array(mean), lambda m: F.aggregate(v, F.lit(0.0), lambda a, c: a + F.pow(c - m, F.lit(2))))[0]
    away = lambda source: F.transform(F.array(v), lambda x: F.aggregate(F.transform(x, lambda c, i: F.abs(c - F.get(x, source(i).cast("int")))), F.lit(0.0), lambda a, y: a + y))[0]
    numbers = (
        mean, F.sqrt(spread / 64), F.array_min(v), F.array_max(v), F.size(F.array_distinct(v)) / 64.0,
        away(lambda i: i - i % 8 + 7 - i % 8), away(lambda i: 56 - (i - i % 8) + i % 8), away(lambda i: i - i % 2), away(lambda i: i - i % 8 + (i + 1) % 8),
        F.size(F.filter(v, lambda c: c == 0.5)) / 64.0, F.size(F.filter(v, lambda c: c == 0.3)) / 64.0,
    )
    return rows.withColumns({f"f{k}": n for k, n in enumerate(numbers)})


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Adds weight n / (classes x n of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(counts.crossJoin(total)), label).withColumn("weight", F.col("_t") / (F.col("_k") * F.col("_n"))).drop("_n", "_t", "_k")


def forest(names: Sequence[str], label: str, trees: int = 300, depth: int = 10, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(names), outputCol="features"),
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, weightCol="weight", seed=seed),
    ])


def shares(model: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    """key, classes in a map to their shares, and the likeliest class."""
    names = model.stages[1].labels
    arr = F.slice(vector_to_array("probability"), 1, len(names))
    out = model.transform(rows).select(key, F.map_from_arrays(F.array(*map(F.lit, names)), arr).alias("shares"), arr.alias("_a"))
    return out.select(key, "shares", F.element_at(F.array(*map(F.lit, names)), F.array_position("_a", F.array_max("_a")).cast("int")).alias("predicted"))


def fit(rows: DataFrame, names: Sequence[str], label: str, **how) -> PipelineModel:
    return forest(names, label, **how).fit(balanced(rows, label))


def cross_fitted(rows: DataFrame, names: Sequence[str], label: str, key: str, folds: int = 3, **how) -> DataFrame:
    """Shares of each row by a forest that hasn't seen it: what out-of-bag shares are for. Rows of one `base` stay in one fold."""
    dealt = rows.withColumn("fold", F.pmod(F.xxhash64("base"), F.lit(folds)))
    out = None
    for k in range(folds):
        model = fit(dealt.where(F.col("fold") != k), names, label, **how)
        part = shares(model, dealt.where(F.col("fold") == k), key)
        out = part if out is None else out.union(part)
    return out


def importances(model: PipelineModel, names: Sequence[str], top: int = 25) -> DataFrame:
    from pyspark.sql import SparkSession

    found = model.stages[2].featureImportances.toArray().tolist()
    return SparkSession.active().createDataFrame(list(zip(names, found, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)
