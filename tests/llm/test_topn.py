import random

import pytest

from tausift.llm.topn import latest_per_key, top_n


def brute(rows, n):
    out = set()
    for g in {r[0] for r in rows if r[0] is not None}:
        best = sorted([r for r in rows if r[0] == g and r[1] is not None and r[2] is not None and r[2] == r[2]], key=lambda r: (-r[2], r[1]))
        out |= {(g, k + 1, r[1]) for k, r in enumerate(best[:n])}
    return out


@pytest.mark.parametrize("spread", [True, False])
def test_hot_groups_and_ties(spark, spread):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaaaab") if k % 3 else "hot", f"m{k}", rng.randint(0, 9) / 10) for k in range(3000)]
    rows += [(None, "m", 1.0), ("a", None, 1.0), ("a", "nan", float("nan")), ("a", "null", None), ("one", "é", 0.5), ("one", "z", 0.5), ("one", "Z", 0.5)]
    df = spark.createDataFrame(rows, "g string, i string, s double").repartition(7)
    assert {(r.g, r.place, r.i) for r in top_n(df, "g", "s", "i", 5, spread=spread).collect()} == brute(rows, 5)


def test_small_batches_carry_counts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [("g", f"m{k:03}", 1.0) for k in range(20)] + [("h", "x", 2.0)]
        df = spark.createDataFrame(rows, "g string, i string, s double")
        assert {(r.g, r.place, r.i) for r in top_n(df, "g", "s", "i", 7).collect()} == brute(rows, 7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 5), ("a", "x", 1.0, 6)], "g string, i string, s double, __g int")
    assert sorted(r.place for r in top_n(df, "g", "s", "i", 5).collect()) == [1, 2]
    assert top_n(df.limit(0), "g", "s", "i", 5).count() == 0
    with pytest.raises(ValueError):
        top_n(df, "g", "s", "i", 0)


def test_latest(spark):
    rows = [("a", 1, 5.0), ("a", 2, None), ("b", 1, 1.0), ("b", 1, 3.0), ("c", None, 9.0), ("c", 1, 2.0), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, at long, v double")
    assert {(r.k, r.v) for r in latest_per_key(df, ["k"], "v", "at").collect()} == {("a", None), ("b", 3.0), ("c", 2.0)}
