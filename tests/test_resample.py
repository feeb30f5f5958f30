import random

import numpy as np

from tausift.operators.agreement import counts_of, pair_counts
from tausift.operators.resample import bootstrap_pairs, bootstrap_rows, drawn_order, drawn_with_replacement, permuted, permuted_pairs, replicates, rho_of

NAMES = ["g", "rep", "n", "pairs", "concordant", "discordant", "tied_x", "tied_y", "tied_both"]


def brute(x, y):
    c = d = tx = ty = tb = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = int(np.sign(x[i] - x[j])), int(np.sign(y[i] - y[j]))
            c, d, tx, ty, tb = c + (a * b > 0), d + (a * b < 0), tx + (a == 0 != b), ty + (b == 0 != a), tb + (a == b == 0)
    return len(x), len(x) * (len(x) - 1) // 2, c, d, tx, ty, tb


def test_counts_against_all_pairs():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 30, 90):
        x, y = np.array([rng.randint(0, 9) for _ in range(n)]), np.array([rng.randint(0, 9) for _ in range(n)])
        assert counts_of(x, y) == brute(x, y)


def test_rho():
    assert rho_of(np.array([1, 2, 3]), np.array([5, 6, 9])) == 1.0 and rho_of(np.array([1, 1, 1]), np.array([5, 6, 9])) is None
    assert abs(rho_of(np.array([1, 2, 2, 4]), np.array([4, 3, 2, 1])) + 0.9486832980505138) < 1e-12


def table(spark):
    rng = random.Random(5)
    rows = [(g, f"e{k}", rng.randint(0, 6), rng.randint(0, 6)) for g, n in (("a", 12), ("b", 5), ("c", 1)) for k in range(n)]
    return spark.createDataFrame(rows, "g string, e string, x long, y long")


def rows_of(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def test_replicates_in_arrays_and_by_joins(spark):
    df = table(spark)
    assert rows_of(bootstrap_pairs(df, ["g"], "e", "x", "y", 7)) == rows_of(pair_counts(bootstrap_rows(df, ["g"], "e", ["x", "y"], 7), ["g", "rep"], "x", "y"))
    dealt = permuted(df, ["g"], "e", "y", 7).join(df.select("g", "e", "x"), ["g", "e"])
    assert rows_of(permuted_pairs(df, ["g"], "e", "x", "y", 7)) == rows_of(pair_counts(dealt, ["g", "rep"], "x", "y"))


def test_counts_in_one_task_and_by_joins(spark):
    df = table(spark)
    one, many = pair_counts(df, ["g"], "x", "y", "e"), pair_counts(df, ["g"], "x", "y", "e", most=1)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.select(one.columns).collect()))
    rows = [r for r in df.collect() if r.g == "a"]
    differ = sum((p.x > q.x) != (p.y > q.y) for i, p in enumerate(sorted(rows, key=lambda r: r.e)) for q in sorted(rows, key=lambda r: r.e)[i + 1 :])
    assert next(r.oriented for r in one.collect() if r.g == "a") == differ


def test_every_replicate_once(spark):
    got = replicates(table(spark), ["g"], "e", ["x"], 600, lambda rep, c: (int(c["x"].sum()),), "s long").groupBy("g").count().collect()
    assert {tuple(r) for r in got} == {("a", 600), ("b", 600), ("c", 600)}
    assert replicates(table(spark).limit(0), ["g"], "e", ["x"], 600, lambda rep, c: (0,), "s long").count() == 0


def test_draws():
    assert sorted(drawn_order(3, 50, 42).tolist()) == list(range(50)) and set(drawn_with_replacement(3, 50, 42)) < set(range(50))
