import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tausift.operators import agreement
from tausift.operators.agreement import inversions, pair_counts, tau_b
from tausift.operators.order import at_positions, ordinal, running, tie_ranks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(g, i, rng.randint(0, 12), rng.randint(0, 9)) for g, n in (("a", 1), ("b", 40), ("c", 120)) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 500])
def test_inversions_against_brute_force(n):
    v = np.random.default_rng(n).integers(0, max(2, n // 2), n)
    assert inversions(v) == sum(int((v[i] > v[i + 1 :]).sum()) for i in range(n))


def brute(rows):
    c = d = tx = ty = tb = o = 0
    for (_, _, x, y), (_, _, u, v) in itertools.combinations(sorted(rows, key=lambda r: r[1]), 2):
        a, b = (x > u) - (x < u), (y > v) - (y < v)
        c, d = c + (a * b > 0), d + (a * b < 0)
        tb, tx, ty = tb + (a == b == 0), tx + (a == 0 != b), ty + (b == 0 != a)
        o += (x > u) != (y > v)
    return c, d, tx, ty, tb, o


@pytest.mark.parametrize("most", [10**6, 20])
def test_pair_counts_merge_and_grid(spark, rows, most, monkeypatch):
    monkeypatch.setattr(agreement, "GRID", 7)
    df = spark.createDataFrame(rows, "g string, i long, x long, y long")
    got = {r.g: (r.concordant, r.discordant, r.tied_x, r.tied_y, r.tied_both, r.oriented) for r in pair_counts(df, ["g"], "x", "y", "i", most).collect()}
    assert got == {g: brute([r for r in rows if r[0] == g]) for g in "abc"}


def test_tau_of_constant_side_is_null(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2)], "g string, x long, y long")
    assert pair_counts(df, ["g"], "x", "y").select(tau_b().alias("t")).first().t is None


def test_pair_counts_of_nothing(spark):
    df = spark.createDataFrame([], "g string, x long, y long")
    assert pair_counts(df, ["g"], "x", "y", "x").count() == 0


@pytest.mark.parametrize("most", [10**6, 3])
def test_running_over_parts(spark, rows, most):
    df = spark.createDataFrame([*rows, (None, 1, 5, 1), (None, 2, 7, 1)], "g string, i long, x long, y long")
    order = [F.col("i").asc()]
    for how, fold in (("sum", sum), ("max", max), ("min", min)):
        got = {(r.g, r.i): r.v for r in running(df, ["g"], order, "x", how, "v", most=most).collect()}
        for g in ("a", "b", "c"):
            values = [r[2] for r in rows if r[0] == g]
            assert all(got[g, k] == fold(values[: k + 1]) for k in range(len(values)))
        assert got[None, 2] == fold([5, 7])
    before = {(r.g, r.i): r.v for r in running(df, ["g"], order, "x", "sum", "v", inclusive=False, most=most).collect()}
    assert before["a", 0] is None and before[None, 2] == 5


@pytest.mark.parametrize("most", [10**6, 2])
def test_ranks(spark, most):
    df = spark.createDataFrame([("g", "a", 2), ("g", "b", 2), ("g", "c", 1), ("g", "d", None)], "g string, e string, s long")
    ranks = {r.e: (r.rank_min, r.rank_avg) for r in tie_ranks(df, ["g"], "s", most=most).collect()}
    assert ranks == {"a": (1, 1.5), "b": (1, 1.5), "c": (3, 3.0), "d": (4, 4.0)}
    assert {r.e: r["rank"] for r in ordinal(df.dropna(), ["g"], [F.col("s").desc(), F.col("e").asc()], most=most).collect()} == {"a": 1, "b": 2, "c": 3}


def test_percentile_is_interpolated(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 4)], "g string, v double")
    assert at_positions(df, ["g"], "v", {"p": (F.col("n") - 1) * F.lit(0.025)}).first().p == pytest.approx(1.075)
