"""Threshold sweeps: one histogram of the scores and running sums, rather than a pass for each threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscope.operators.metrics import DIGITS, confusion, count_if, derived, f1, ratio
from twinscope.operators.votes import COUNTS


def grid(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """df once for each value of a small grid."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def curve(pairs: DataFrame, signal: str, steps: Sequence[float]) -> DataFrame:
    """Confusion counts at each threshold of an ascending grid."""
    value = F.col(signal)
    above = signal in COUNTS
    # the place in the grid of the first threshold at which a score starts (distance) or stops (count) to fire
    place = F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t < value))
    bins = pairs.groupBy(F.when(value.isNull(), -1).otherwise(place).alias("bin")).agg(count_if(F.col("is_copy")).alias("p"), count_if(~F.col("is_copy")).alias("n"))
    points = pairs.sparkSession.createDataFrame(list(enumerate(map(float, steps))), "bin int, threshold double")
    full = bins.join(F.broadcast(points), "bin", "full").na.fill(0, ["p", "n"])
    everything = Window.partitionBy()
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("bin") >= 0
    low = lambda c: F.sum(F.when(known, F.col(c)).otherwise(0)).over(upto)
    all_ = lambda c: F.sum(F.when(known, F.col(c)).otherwise(0)).over(everything)
    hit = lambda c: (all_(c) - low(c)) if above else low(c)
    every = lambda c: F.sum(c).over(everything)
    out = full.select("threshold", hit("p").alias("tp"), hit("n").alias("fp"), (every("p") - hit("p")).alias("fn"), (every("n") - hit("n")).alias("tn"))
    return derived(out.where(F.col("threshold").isNotNull()))


def best(points: DataFrame, key: str, value: str = "f1") -> DataFrame:
    """The row with the largest value; of equals the one with the smallest key."""
    return points.orderBy(F.desc(value), key).limit(1)


def within_budget(pairs: DataFrame, signal: str, steps: Sequence[int], budget: float = 0.1) -> DataFrame:
    """The widest threshold at which at most `budget` of the negatives fire. A row: signal, threshold, false_rate."""
    points = curve(pairs.where(~F.col("is_copy")), signal, steps).select("threshold", ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("rate"))
    fine = F.when(F.col("rate") <= budget, F.col("threshold"))
    if signal in COUNTS:
        chosen = points.agg(F.coalesce(F.min(fine), F.lit(float(steps[-1]))).alias("threshold"))
    else:
        chosen = points.agg(F.coalesce(F.max(fine), F.lit(float(steps[0]))).alias("threshold"))
    return chosen.join(points, "threshold").select(F.lit(signal).alias("signal"), "threshold", F.round("rate", DIGITS).alias("false_rate"))


def guarded(chosen: DataFrame, name: str, steps: Sequence[float]) -> DataFrame:
    """Fails where a chosen value lies at an edge of its grid."""
    edge = F.col(name).isin(float(steps[0]), float(steps[-1]))
    return chosen.withColumn(name, F.when(edge, F.raise_error(F.concat(F.lit("threshold at the edge of its grid: "), F.col(name).cast("string"))).cast("double")).otherwise(F.col(name)))


def decision_sweep(rows: DataFrame, share: Column, actual: Column, taus: Sequence[float]) -> DataFrame:
    """Per tau: precision, recall, f1, misses and false alarms of `share > tau`."""
    swept = grid(rows.select(share.alias("share"), actual.alias("actual")), "tau", taus)
    out = derived(swept.groupBy("tau").agg(*confusion(F.col("share") > F.col("tau"), F.col("actual"))))
    miss, alarm = ratio(F.col("fn"), F.col("tp") + F.col("fn")), ratio(F.col("fp"), F.col("fp") + F.col("tn"))
    return out.withColumn("miss", F.round(miss, DIGITS)).withColumn("false_alarm", F.round(alarm, DIGITS))


def quorum_sweep(pairs: DataFrame, fired: Column, ks: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Metrics of each quorum, the best marked (of equals the smallest), and the floor of calling all copies."""
    counted = pairs.select("is_copy", fired.alias("fired")).groupBy("is_copy", "fired").count()
    swept = grid(counted, "k", ks)
    hit, positive, n = F.col("fired") >= F.col("k"), F.col("is_copy"), F.col("count")
    part = lambda test, name: F.coalesce(F.sum(F.when(test, n)), F.lit(0)).cast("long").alias(name)
    out = derived(swept.groupBy("k").agg(part(hit & positive, "tp"), part(hit & ~positive, "fp"), part(~hit & positive, "fn"), part(~hit & ~positive, "tn")))
    pos, neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    share = pos / (pos + neg)
    w = Window.partitionBy().orderBy(F.desc("f1"), "k")
    return out.withColumn("floor", F.round(2 * share / (share + 1), DIGITS)).withColumn("selected", F.row_number().over(w) == 1)


def two_way_grid(rows: DataFrame, votes: str, inliers: str, vs: Sequence[int], rs: Sequence[int]) -> DataFrame:
    """Metrics in percent of `votes > V and inliers > R`."""
    swept = grid(grid(rows, "v", vs), "r", rs)
    out = swept.groupBy("v", "r").agg(*confusion((F.col(votes) > F.col("v")) & (F.col(inliers) > F.col("r"))))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    cent = lambda x: F.round(100 * x, 2)
    return out.select("v", "r", cent(f1(p, r)).alias("f1"), cent(p).alias("precision"), cent(r).alias("recall"), cent(ratio(tp + tn, tp + fp + fn + tn)).alias("accuracy"), "tp", "tn", "fp", "fn")
