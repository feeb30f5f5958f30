"""Resampling whose draws come from whole-number arithmetic, so that any engine draws the same.

Replicates of groups that fit a task are drawn where the group's columns lie as arrays: the group travels once per block of
replicates, not once per replicate. Larger groups are drawn by joins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tausift.operators.agreement import COUNTS, counts_of, pair_counts
from tausift.operators.order import largest_group, ordinal
from tausift.runtime import cut

#: Rows of a group up to which a task holds it as arrays, and replicates that a task draws.
ARRAY_ROWS, BLOCK = 1_000_000, 250

MODULUS = 2147483647


def draw(rep: Column, k: Column, seed: int = 42) -> Column:
    """A whole number from 0 to MODULUS - 1 for a replicate and a position."""
    a = (rep * 48271 + F.lit(seed)) % MODULUS
    b = (k * 16807 + a * 69621) % MODULUS
    return (b * 39373 + a) % MODULUS


DRAW_SQL = "(((({k} * 16807 + (({rep} * 48271 + {seed}) % 2147483647) * 69621) % 2147483647) * 39373 + (({rep} * 48271 + {seed}) % 2147483647)) % 2147483647)"


def bootstrap_rows(df: DataFrame, group: list[str], item: str, values: list[str], reps: int, seed: int = 42) -> DataFrame:
    """(group, rep, k, values): each group resampled with replacement, reps times, to its own size.

    Positions follow the item's order. Each draw is looked up by an equi-join on its position.
    """
    placed = ordinal(df, group, [F.col(item).asc()], "__k").select(*group, (F.col("__k") - 1).alias("__k"), *values)
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    positions = placed.select(*group, F.col("__k").alias("k")).join(sizes, group)
    drawn = positions.select(*group, "k", "__n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(reps).cast("long"))).alias("rep")).withColumn("__k", F.pmod(draw(F.col("rep"), F.col("k"), seed), F.col("__n")))
    return drawn.join(placed, [*group, "__k"]).select(*group, "rep", "k", *values)


def permuted(df: DataFrame, group: list[str], item: str, value: str, reps: int, seed: int = 42) -> DataFrame:
    """(group, rep, item, value): the values of each group dealt out to its items anew, reps times, without replacement."""
    placed = ordinal(df, group, [F.col(item).asc()], "__k").select(*group, item, value, "__k")
    shuffled = placed.withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(reps).cast("long"))))
    ordered = ordinal(shuffled.withColumn("__d", draw(F.col("rep"), F.col("__k"), seed)), [*group, "rep"], [F.col("__d").asc(), F.col("__k").asc()], "__to")
    target = placed.select(*group, item, "__k")
    return ordered.select(*group, "rep", F.col("__to").alias("__k"), value).join(target, [*group, "__k"]).select(*group, "rep", item, value)


def _draws(rep: int, n: int, seed: int, first: int) -> np.ndarray:
    """`draw` for the positions first, first + 1 and so on."""
    a = (rep * 48271 + seed) % MODULUS
    b = (np.arange(first, first + n, dtype=np.int64) * 16807 + a * 69621) % MODULUS
    return (b * 39373 + a) % MODULUS


def drawn_with_replacement(rep: int, n: int, seed: int) -> np.ndarray:
    """The positions (from 0) that a bootstrap replicate draws."""
    return _draws(rep, n, seed, 0) % n


def drawn_order(rep: int, n: int, seed: int) -> np.ndarray:
    """All positions (from 0) in the order in which a permutation deals them."""
    return np.argsort(_draws(rep, n, seed, 1), kind="stable")


def replicates(df: DataFrame, group: list[str], item: str, columns: list[str], reps: int, stat: Callable[[int, dict[str, np.ndarray]], tuple], schema: str) -> DataFrame:
    """(group, rep, the columns of `schema`): stat(rep, columns as arrays in the item's order) for each replicate of each group.

    Whole groups go to a task, so this is for groups of at most ARRAY_ROWS.
    """
    placed = ordinal(df, group, [F.col(item).asc()], "__k").select(*group, "__k", *columns)
    blocks = placed.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // BLOCK))))
    # few bytes and much work: a fixed number of partitions, which adaptive execution doesn't merge into one
    blocks = blocks.repartition(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *group, "__block")
    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    names = [part.split()[0] for part in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__k", kind="stable")
        arrays = {c: pdf[c].to_numpy() for c in columns}
        first = int(pdf["__block"].iloc[0]) * BLOCK
        rows = [(rep, *stat(rep, arrays)) for rep in range(first + 1, min(first + BLOCK, reps) + 1)]
        out = pd.DataFrame(rows, columns=["rep", *names])
        for at, g in enumerate(group):
            out.insert(at, g, pdf[g].iloc[0])
        return out

    # statistics of replicates are read several times; drawing them is the work
    return cut(blocks.groupBy(*group, "__block").applyInPandas(run, f"{kinds}, rep long, {schema}"))


def fits_arrays(df: DataFrame, group: list[str]) -> bool:
    """Whether every group fits a task as arrays."""
    return largest_group(df, group) <= ARRAY_ROWS


def rho_of(x: np.ndarray, y: np.ndarray) -> float | None:
    """Spearman's rho: the correlation of average ranks; None if either side has one value only."""

    def ranks(v: np.ndarray) -> np.ndarray:
        _, at, counts = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(counts) - (counts - 1) / 2)[at]

    a, b = ranks(x), ranks(y)
    a, b = a - a.mean(), b - b.mean()
    scale = float((a * a).sum()) * float((b * b).sum())
    return float((a * b).sum()) / scale**0.5 if scale > 0 else None


def bootstrap_pairs(df: DataFrame, group: list[str], item: str, x: str, y: str, reps: int, seed: int = 42) -> DataFrame:
    """`pair_counts` of each bootstrap replicate, by group and rep. Rows with a null x or y should be left out before."""
    if not fits_arrays(df, group):
        return pair_counts(bootstrap_rows(df, group, item, [x, y], reps, seed), [*group, "rep"], x, y)

    def stat(rep: int, c: dict[str, np.ndarray]) -> tuple:
        at = drawn_with_replacement(rep, len(c[x]), seed)
        return counts_of(c[x][at], c[y][at])

    return replicates(df, group, item, [x, y], reps, stat, COUNTS)


def permuted_pairs(df: DataFrame, group: list[str], item: str, x: str, y: str, reps: int, seed: int = 42) -> DataFrame:
    """`pair_counts` of x with y dealt out anew in each replicate, by group and rep."""
    if not fits_arrays(df, group):
        dealt = permuted(df, group, item, y, reps, seed).join(df.select(*group, item, x), [*group, item])
        return pair_counts(dealt, [*group, "rep"], x, y)

    def stat(rep: int, c: dict[str, np.ndarray]) -> tuple:
        return counts_of(c[x], c[y][drawn_order(rep, len(c[x]), seed)])

    return replicates(df, group, item, [x, y], reps, stat, COUNTS)
