"""Statistics of pairs of columns per group, from exact sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tausift.operators.order import running, tie_ranks


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def correlation(df: DataFrame, group: list[str], x: str, y: str, name: str, least: int = 3) -> DataFrame:
    """(group, n, name): Pearson's correlation of whole-number columns, from sums that are exact.

    Null with fewer than `least` rows or where a side has one value only.
    """
    sums = df.dropna(subset=[x, y]).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy")
    )
    n = _double("n")
    vx, vy = n * _double("sxx") - _double("sx") * _double("sx"), n * _double("syy") - _double("sy") * _double("sy")
    r = (n * _double("sxy") - _double("sx") * _double("sy")) / F.sqrt(vx * vy)
    return sums.select(*group, "n", F.when((F.col("n") >= least) & (vx > 0) & (vy > 0), r).alias(name))


def spearman(df: DataFrame, group: list[str], x: str, y: str, name: str = "rho", least: int = 3) -> DataFrame:
    """(group, n, name): Spearman's correlation, average ranks for ties."""
    rows = df.dropna(subset=[x, y]).select(*group, x, y)
    ranked = tie_ranks(tie_ranks(rows, group, x, "__m", "__rx"), group, y, "__l", "__ry")
    whole = ranked.select(*group, (F.col("__rx") * 2).cast("long").alias("a"), (F.col("__ry") * 2).cast("long").alias("b"))
    return correlation(whole, group, "a", "b", name, least)


def adjusted_p(df: DataFrame, group: list[str], p: str, item: str, name: str = "p_adjusted") -> DataFrame:
    """df with Benjamini-Hochberg adjusted p-values, within each group; a null p counts as 1."""
    known = df.withColumn("__p", F.coalesce(F.col(p), F.lit(1.0))).withColumn("__one", F.lit(1).cast("long"))
    ranked = running(known, group, [F.col("__p").asc(), F.col(item).asc()], "__one", "sum", "__rank")
    sized = ranked.join(ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")), group) if group else ranked.join(F.broadcast(ranked.agg(F.count(F.lit(1)).alias("__n"))))
    raw = sized.withColumn("__raw", F.col("__p") * F.col("__n") / F.col("__rank"))
    least = running(raw, group, [F.col("__rank").desc()], "__raw", "min", "__least")
    return least.withColumn(name, F.least(F.lit(1.0), F.col("__least"))).drop("__p", "__one", "__rank", "__n", "__raw", "__least")


def two_regressors(df: DataFrame, group: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """(group, n, intercept, b1, b2, r2) of y on two columns, by normal equations over centred sums."""
    rows = df.dropna(subset=[y, x1, x2])
    c = {"a": x1, "b": x2, "y": y}
    sums = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(f"m{k}") for k, v in c.items()), *(F.covar_pop(c[p], c[q]).alias(f"s{p}{q}") for p, q in ("aa", "bb", "ab", "ay", "by", "yy")))
    det = F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab")
    b1 = (F.col("say") * F.col("sbb") - F.col("sby") * F.col("sab")) / det
    b2 = (F.col("sby") * F.col("saa") - F.col("say") * F.col("sab")) / det
    solved = sums.filter((F.col("n") >= 4) & (det != 0)).withColumns({"b1": b1, "b2": b2})
    return solved.select(*group, "n", (F.col("my") - F.col("b1") * F.col("ma") - F.col("b2") * F.col("mb")).alias("intercept"), "b1", "b2", ((F.col("b1") * F.col("say") + F.col("b2") * F.col("sby")) / F.col("syy")).alias("r2"))


def pareto_front(df: DataFrame, group: list[str], cost: str, score: str) -> DataFrame:
    """The rows of df that no other row of the group beats: none with less or equal cost and more or equal score, one strictly.

    Rows with a null cost or score are left out; equal rows stay together. One running maximum over the distinct costs.
    """
    rows = df.dropna(subset=[cost, score])
    best = rows.groupBy(*group, cost).agg(F.max(score).alias("__best"))
    front = running(best, group, [F.col(cost).asc()], "__best", "max", "__before", inclusive=False)
    kept = front.filter(F.col("__before").isNull() | (F.col("__best") > F.col("__before"))).select(*group, cost, F.col("__best").alias(score))
    return rows.join(kept, [*group, cost, score], "left_semi")
