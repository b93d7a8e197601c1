"""The queries of the test bed against their SQL, and the literal cases of the fixtures."""

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from twinscope.functions import fingerprints as fp
from twinscope.operators import metrics, sweeps, votes
from twinscope.plans import reference

CHECKED = ["a1_confusion", "a4_by_category", "a6_quorum_sweep", "a7_count_curve", "a10_budget_thresholds", "a23_prevalence", "h2_hashes", "h17_list_matches", "j1_score_join", "j15_mutual_neighbours", "j17_hamming_range_join", "s4_hash_cache", "s5_segment_cache", "v5_routed_policies", "v11_weighted_vote", "m10_composites"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(str([round(float(x), 5) if isinstance(x, float) else x for x in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, db, name):
    got = reference.QUERIES[name](spark, SMALL).toPandas()
    want = db.execute(reference.ORACLES[name]).df().astype({c: t for c, t in got.dtypes.items() if t.kind in "ifb"})
    assert rows(got) == rows(want)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def longs(*values):
    return F.array(*(F.lit(v).cast("long") for v in values))


def test_hamming(spark):
    assert one(spark, fp.hamming(F.lit(7), F.lit(7))) == 0
    assert one(spark, fp.hamming(F.lit(0).cast("long"), F.lit(-1).cast("long"))) == 64


def test_list_distance_is_directional(spark):
    a, b = longs(0b11, 0b1100), longs(0, 0b1111111111 << 20)
    assert one(spark, fp.list_distance(a, b)) == 2
    assert one(spark, fp.list_distance(b, a)) == (2 + 12) / 2
    assert one(spark, fp.list_distance(longs().cast("array<bigint>"), a)) == float("inf")


def test_no_match_leaves_the_count(spark):
    assert one(spark, fp.list_difference(longs(0, 1), longs(-1), 4)) == 2.0


def test_abstention_and_boundaries(spark):
    null = F.lit(None).cast("double")
    assert one(spark, votes.fires("ahash", 7, null)) is False and one(spark, votes.fires("orb", 7, null)) is False
    assert one(spark, votes.fires("ahash", 7, F.lit(7))) is True and one(spark, votes.fires("orb", 7, F.lit(7))) is False


def test_zero_denominators(spark):
    empty = spark.createDataFrame([], "is_copy boolean, hit boolean")
    r = metrics.evaluate(empty, F.col("hit")).head()
    assert (r["precision"], r["recall"], r["f1"]) == (0, 0, 0)


@pytest.mark.parametrize(("pos", "neg", "floor"), [(3600, 2400, 75.0), (11400, 2400, 90.5), (202, 1600, 20.2), (18000, 2400, 93.75)])
def test_floor(spark, pos, neg, floor):
    assert abs(100 * one(spark, metrics.flag_everything(F.lit(pos), F.lit(neg))) - floor) < 0.06


def test_published_grid_row(spark):
    tp, tn, fp_, fn = 30210, 3294, 6306, 15390
    r = metrics.derived(spark.createDataFrame([(tp, fp_, fn, tn)], "tp long, fp long, fn long, tn long"), accuracy=True).head()
    assert [round(100 * r[c], 2) for c in ("precision", "recall", "f1", "accuracy")] == [82.73, 66.25, 73.58, 60.7]


def test_curve_equals_naive_sweep(spark):
    s = reference.scored(spark, SMALL)
    got = {r["threshold"]: (r["tp"], r["fp"]) for r in sweeps.curve(s, "ahash", range(0, 30, 3)).collect()}
    naive = sweeps.grid(s, "t", list(range(0, 30, 3))).groupBy("t").agg(*metrics.confusion(votes.fires("ahash", F.col("t"))))
    assert got == {float(r["t"]): (r["tp"], r["fp"]) for r in naive.collect()}


def test_edge_guard_fails(spark):
    edge = spark.createDataFrame([(0.0,)], "threshold double")
    with pytest.raises(Exception, match="edge of its grid"):
        sweeps.guarded(edge, "threshold", range(5)).collect()


def test_shipped_policy_loses_nothing(spark):
    assert reference.QUERIES["u5_static_or_routed"](spark, SMALL).head()["lost"] == 0


def test_exact_copies_have_distance_zero(spark):
    s = reference.scored(spark, SMALL).where("manipulation_type = 'exact_copy'")
    assert s.agg(*(F.max(c) for c in ("ahash", "phash", "dhash", "hsvhash", "shash"))).head() == (0, 0, 0, 0, 0.0)


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, check=True)
    assert out.stdout.strip().endswith("True")
