"""Range joins by near bands against all pairs."""

import random

import pytest

from twinscope.operators.matching import Bands, within_distance


@pytest.mark.parametrize("most", [0, 1, 3, 14, 20])
def test_bands_leave_no_pair_out(most):
    cut = Bands(most)
    assert sum(r + 1 for _, _, r in cut.parts) == most + 1
    assert [at for at, _, _ in cut.parts] == [sum(w for _, w, _ in cut.parts[:k]) for k in range(len(cut.parts))]
    assert sum(w for _, w, _ in cut.parts) == 64


@pytest.mark.parametrize("most", [0, 3, 14])
def test_within_distance_is_all_pairs_once(spark, most):
    rng = random.Random(most)
    left = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(60)]
    right = []
    for i, h in left:  # copies a few bits away, at the threshold and just beyond it, and strangers
        for d in (0, most, most + 1):
            right.append((len(right), h ^ (sum(1 << b for b in rng.sample(range(63), d)))))
        right.append((len(right), rng.getrandbits(64) - (1 << 63)))
    kind = "id long, h long"
    got = [tuple(r) for r in within_distance(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), most).collect()]
    apart = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    assert sorted(got) == sorted((a, b, apart(x, y)) for a, x in left for b, y in right if apart(x, y) <= most)


def test_within_distance_of_nothing_and_null(spark):
    none = spark.createDataFrame([], "id long, h long")
    one = spark.createDataFrame([(1, 5), (2, None)], "id long, h long")
    assert within_distance(none, one, 3).count() == 0
    assert [tuple(r) for r in within_distance(one, one, 3).collect()] == [(1, 1, 0)]


@pytest.mark.parametrize("streamed", [False, True])
def test_multiplied_rows_are_not_broadcast(spark, tmp_path, streamed):
    """A small file becomes hundreds of rows for each of its rows; its size says nothing of that."""
    from twinscope.streaming.mint import near_gallery

    rows = spark.range(50).selectExpr("id", "xxhash64(id) AS h")
    rows.write.parquet(str(tmp_path / "new"))
    new = (spark.readStream if streamed else spark.read).schema(rows.schema).parquet(str(tmp_path / "new"))
    found = near_gallery(new, spark.read.parquet(str(tmp_path / "new")), 14)
    if not streamed:
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        return
    run = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert "BroadcastHashJoin" not in run._jsq.explainInternal(False)
    assert spark.read.parquet(str(tmp_path / "out")).where("a = b and distance = 0").count() == 50


def test_nearest_neighbour_in_blocks(spark, monkeypatch):
    """Against all pairs, with repeated hashes and ids, ties, nulls, and no plan that pairs row by row."""
    from twinscope.operators import matching

    monkeypatch.setattr(matching, "BLOCK", 30)
    rng = random.Random(4)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(50)] + [0, -1]
    left = [(f"a{k % 90}", rng.choice(hashes) ^ (1 << rng.randrange(63))) for k in range(100)]
    right = [(f"b{k}", rng.choice(hashes)) for k in range(130)]
    kind = "id string, h long"
    found = matching.nearest_neighbour(spark.createDataFrame([*left, ("null", None)], kind), spark.createDataFrame([*right, ("0", None)], kind))
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    want = {}
    for a, x in left:
        want[a] = min(want.get(a, (99, "")), *((((x ^ y) & (2**64 - 1)).bit_count(), b) for b, y in right))
    assert sorted(map(tuple, found.collect())) == sorted((a, b, d) for a, (d, b) in want.items())
    assert matching.nearest_neighbour(spark.createDataFrame(left, kind), spark.createDataFrame([], kind)).count() == 0
    assert [r["distance"] for r in matching.nearest_neighbour(spark.createDataFrame(left[:1], kind), spark.createDataFrame([("b", ~left[0][1])], kind), 64).collect()] == []
