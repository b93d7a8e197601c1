"""Confusion counts and what follows from them, in one pass over the pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def count_if(test: Column) -> Column:
    return F.coalesce(F.sum(test.cast("long")), F.lit(0).cast("long"))


def confusion(predicted: Column, actual: Column | None = None) -> list[Column]:
    actual = F.col("is_copy") if actual is None else actual
    return [count_if(t).alias(n) for n, t in (("tp", predicted & actual), ("fp", predicted & ~actual), ("fn", ~predicted & actual), ("tn", ~predicted & ~actual))]


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def derived(df: DataFrame, accuracy: bool = False) -> DataFrame:
    """Adds precision, recall and f1 to confusion counts."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = df.withColumn("precision", F.round(p, DIGITS)).withColumn("recall", F.round(r, DIGITS)).withColumn("f1", F.round(f1(p, r), DIGITS))
    return out.withColumn("accuracy", F.round(ratio(tp + tn, tp + fp + fn + tn), DIGITS)) if accuracy else out


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def evaluate(pairs: DataFrame, predicted: Column, by: Sequence[str] = (), accuracy: bool = False) -> DataFrame:
    return derived(pairs.groupBy(*by).agg(*confusion(predicted)), accuracy)


def flag_everything(positives: Column, negatives: Column) -> Column:
    """F1 of calling every pair a copy."""
    share = positives / F.nullif(positives + negatives, F.lit(0))
    return F.round(F.when(positives == 0, 0.0).otherwise(2 * share / (share + 1)), DIGITS)


def by_category(pairs: DataFrame, predicted: Column) -> DataFrame:
    """Detection of each kind of copy, with precision against all negatives."""
    counts = pairs.groupBy("manipulation_type").agg(F.count("*").alias("n"), count_if(predicted).alias("hits"), F.max("is_copy").alias("is_copy"))
    negatives = pairs.where(~F.col("is_copy")).agg(count_if(predicted).alias("false_hits"))
    out = counts.crossJoin(F.broadcast(negatives))
    rate, p = ratio(F.col("hits"), F.col("n")), ratio(F.col("hits"), F.col("hits") + F.col("false_hits"))
    return out.select("manipulation_type", "n", "hits", F.round(rate, DIGITS).alias("rate"), F.when(F.col("is_copy"), F.round(f1(p, rate), DIGITS)).alias("f1"))


def policies(pairs: DataFrame, verdicts: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Metrics of several policies, a row each."""
    tagged = F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), v.alias("hit")) for n, v in verdicts.items())))
    rows = pairs.select("is_copy", *by, tagged.alias("x")).select("is_copy", *by, "x.policy", "x.hit")
    return derived(rows.groupBy("policy", *by).agg(*confusion(F.col("hit"))))


def at_prevalence(recall: Column, false_rate: Column, share: Column) -> Column:
    tp, fn, fp = recall * share, (1 - recall) * share, false_rate * (1 - share)
    return F.round(ratio(2 * tp, 2 * tp + fp + fn), DIGITS)
