import pytest
from pyspark.sql import functions as F

from tausift.operators.scores import borda, consensus_scores, covered_scores, full_coverage, global_scores, leave_one_out, row_aggregators, weighted_scores
from tausift.operators.stats import adjusted_p, correlation, pareto_front, spearman, two_regressors

LONG = [("a", "t1", 10), ("a", "t2", 20), ("b", "t1", 30), ("b", "t2", 30), ("c", "t1", 5), ("d", "t3", None)]


@pytest.fixture
def scores(spark):
    return spark.createDataFrame(LONG, "entity string, task string, s long")


def as_dict(df, key, *values):
    return {r[key]: tuple(r[v] for v in values) for r in df.collect()}


def test_global_and_coverage(scores):
    assert as_dict(global_scores(scores), "entity", "n_tasks", "score") == {"a": (2, 15.0), "b": (2, 30.0), "c": (1, 5.0)}
    assert as_dict(full_coverage(scores.dropna(), "entity", "task"), "entity", "n_tasks") == {"a": (2,), "b": (2,)}
    assert as_dict(covered_scores(scores, "entity", "s", F.lit(2), 0.6), "entity", "score") == {"a": (15.0,), "b": (30.0,), "c": (None,), "d": (None,)}


def test_consensus(scores):
    got = consensus_scores(scores.withColumn("slice", F.lit("x")), "slice", "entity", "task", "s")
    assert as_dict(got, "entity", "n_consensus", "score") == {"a": (2, 15.0), "b": (2, 30.0)}


def test_leave_one_out(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("a", "z", 8), ("b", "x", 4)], "entity string, slice string, v long")
    got = {(r.entity, r.slice): (r.macro, r.loo) for r in leave_one_out(df, "entity", "slice", "v").collect()}
    assert got["a", "x"] == (4.0, 5.5) and got["b", "x"] == (4.0, None)


def test_weighted_and_row_aggregators(scores):
    w = scores.withColumn("w", F.when(F.col("task") == "t1", 0.5).otherwise(0.25))
    assert as_dict(weighted_scores(w, "entity", "s", "w"), "entity", "score")["a"][0] == pytest.approx(40 / 3)
    a = row_aggregators(scores, "entity", "s")
    assert as_dict(a, "entity", "n", "lowest", "median", "mean", "trimmed")["a"] == (2, 10.0, 15.0, 15.0, 15.0)
    assert as_dict(a, "entity", "harmonic")["a"][0] == pytest.approx(2 / (1 / 10 + 1 / 20))


def test_borda(spark):
    df = spark.createDataFrame([("a", "t", 2), ("b", "t", 2), ("c", "t", 1), ("a", "u", 1)], "entity string, task string, s long")
    assert as_dict(borda(df, "entity", "task", "s"), "entity", "points") == {"a": (1.5,), "b": (1.5,), "c": (0.0,)}


def test_adjusted_p(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "i string, p double")
    got = as_dict(adjusted_p(df.dropna(), [], "p", "i"), "i", "p_adjusted")
    assert [got[k][0] for k in "abc"] == pytest.approx([0.03, 0.04, 0.04])
    assert as_dict(adjusted_p(df, [], "p", "i"), "i", "p_adjusted")["d"] == (1.0,)


def test_correlations(spark):
    df = spark.createDataFrame([("g", x, y) for x, y in ((1, 10), (2, 20), (3, 30), (4, 40))] + [("h", 1, 1), ("h", 1, 2), ("h", 1, 3)], "g string, x long, y long")
    assert as_dict(spearman(df, ["g"], "x", "y"), "g", "rho") == {"g": (1.0,), "h": (None,)}
    assert as_dict(correlation(df, ["g"], "x", "y", "r"), "g", "r")["g"][0] == pytest.approx(1.0)


def test_two_regressors(spark):
    df = spark.createDataFrame([("g", float(a), float(b), 3.0 + 2 * a - b) for a in range(4) for b in range(3)], "g string, a double, b double, y double")
    r = two_regressors(df, ["g"], "y", "a", "b").first()
    assert (r.intercept, r.b1, r.b2, r.r2) == pytest.approx((3, 2, -1, 1))


def test_pareto_keeps_ties(spark):
    df = spark.createDataFrame([("g", "a", 1, 5), ("g", "b", 1, 5), ("g", "c", 2, 5), ("g", "d", 3, 9), ("g", "e", None, 99)], "g string, e string, c long, s long")
    assert {r.e for r in pareto_front(df, ["g"], "c", "s").collect()} == {"a", "b", "d"}
