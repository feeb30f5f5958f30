"""Joins by name that fall back from exact to partial matches, without forming all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_or_unique(left: DataFrame, right: DataFrame, key: str, short_left: Column, short_right: Column) -> DataFrame:
    """(key, matched, method): the right key that is equal, else the only right key with the same short name.

    method: exact, short or none. Several right keys of one short name match nothing. Null keys are left out.
    """
    names = left.select(F.col(key).alias("k"), short_left.alias("s")).dropna(subset=["k"]).distinct()
    known = right.select(F.col(key).alias("rk"), short_right.alias("s")).dropna(subset=["rk"]).distinct()
    only = known.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("rk").alias("only")).filter("c = 1").select("s", "only")
    joined = names.join(known.select(F.col("rk").alias("k"), F.col("rk").alias("same")), "k", "left").join(only, "s", "left")
    method = F.when(F.col("same").isNotNull(), "exact").when(F.col("only").isNotNull(), "short").otherwise("none")
    return joined.select(F.col("k").alias(key), F.coalesce("same", "only").alias("matched"), method.alias("method"))


def longest_prefix(left: DataFrame, right: DataFrame, name: str, least: int = 6) -> DataFrame:
    """(name, matched, overlap): the right name that shares the longest prefix of at least `least` characters; ties go to the first.

    Every name gives its prefixes; the right side is reduced to its first name for each prefix before the join.
    """
    prefixes = lambda df: df.select(F.col(name).alias("n")).dropna().distinct().filter(F.length("n") >= least).select("n", F.explode(F.transform(F.sequence(F.lit(least), F.length("n")), lambda k: F.substring("n", F.lit(1), k))).alias("p"))
    firsts = prefixes(right).groupBy("p").agg(F.min("n").alias("m"))
    best = prefixes(left).join(firsts, "p").groupBy("n").agg(F.max_by("m", F.length("p")).alias("m"), F.max(F.length("p")).alias("overlap"))
    return best.select(F.col("n").alias(name), F.col("m").alias("matched"), F.col("overlap").cast("long").alias("overlap"))


def contained_tokens(left: DataFrame, right: DataFrame, name: str, separator: str = "-") -> DataFrame:
    """(name, matched): the longest right name whose tokens stand in a row in the left name; ties go to the first.

    Every left name gives its runs of tokens, which an equi-join looks up.
    """
    tokens = F.filter(F.split(F.col("n"), separator), lambda t: t != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.transform(F.sequence(F.lit(1), F.size("t") - i + 1), lambda k: F.array_join(F.slice("t", i, k), separator))))
    mine = left.select(F.col(name).alias("n")).dropna().distinct().withColumn("t", tokens).filter(F.size("t") > 0).select("n", F.explode(F.array_distinct(runs)).alias("r"))
    known = right.select(F.col(name).alias("r")).dropna().distinct()
    order = Window.partitionBy("n").orderBy(F.length("r").desc(), "r")
    return mine.join(known, "r").withColumn("k", F.row_number().over(order)).filter("k = 1").select(F.col("n").alias(name), F.col("r").alias("matched"))


def by_priority(values: DataFrame, codes: DataFrame, slice_: str, code: str, priority: str, value: str) -> DataFrame:
    """(slice, code, value): of each slice's ordered alternative codes the first that has a value."""
    found = codes.join(values.dropna(subset=[value]), code)
    best = found.groupBy(slice_).agg(F.min_by(F.struct(code, value), F.struct(priority, code)).alias("b"))
    return best.select(slice_, f"b.{code}", f"b.{value}")
