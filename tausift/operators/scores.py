"""Aggregate scores of entities over tasks and slices: global, consensus, leave-one-out, weighted, robust and Borda.

Scores are whole numbers (quantised at the source), so that sums are exact and equal scores tie on every engine; each
mean divides once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tausift.operators.order import tie_ranks
from tausift.runtime import small


def ratio(total: Column, count: Column) -> Column:
    """total / count as DOUBLE, null where count is 0."""
    return F.when(count > 0, total.cast("double") / count.cast("double"))


def global_scores(scores: DataFrame, entity: str = "entity", value: str = "s") -> DataFrame:
    """(entity, n_tasks, score): the mean over all tasks of an entity that has any. Null values are skipped."""
    sums = scores.groupBy(entity).agg(F.count(value).alias("n_tasks"), F.sum(value).alias("total")).filter("n_tasks > 0")
    return sums.select(entity, "n_tasks", ratio(F.col("total"), F.col("n_tasks")).alias("score"))


def consensus_scores(scores: DataFrame, slice_: str, entity: str, task: str, value: str, share: float = 0.5) -> DataFrame:
    """(slice, entity, n_consensus, score): means over the tasks of a slice that most of its entities have.

    A task is in the consensus if at least max(1, ceil(share * entities with any score)) entities have it; an entity is in
    if it has all of these tasks. A slice without such a task keeps all of its tasks.
    """
    cells = scores.dropna(subset=[value]).groupBy(slice_, task, entity).agg(F.max(value).alias("v"))
    present = cells.groupBy(slice_).agg(F.count_distinct(entity).alias("n_any"))
    tasks = cells.groupBy(slice_, task).agg(F.count(F.lit(1)).alias("n")).join(present, slice_)
    kept = tasks.withColumn("kept", F.col("n") >= F.greatest(F.lit(1), F.ceil(F.col("n_any") * share)))
    some = kept.groupBy(slice_).agg(F.max("kept").alias("some"))
    used = kept.join(some, slice_).filter(F.col("kept") | ~F.col("some")).select(slice_, task)
    needed = used.groupBy(slice_).agg(F.count(F.lit(1)).alias("n_consensus"))
    sums = cells.join(used, [slice_, task]).groupBy(slice_, entity).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    full = sums.join(needed, slice_).filter("n = n_consensus")
    return full.select(slice_, entity, "n_consensus", ratio(F.col("total"), F.col("n")).alias("score"))


def full_coverage(scores: DataFrame, entity: str, task: str) -> DataFrame:
    """(entity, n_tasks) of the entities that have every task there is (relational division)."""
    wanted = scores.agg(F.count_distinct(task).alias("wanted"))  # one row
    held = scores.groupBy(entity).agg(F.count_distinct(task).alias("n_tasks"))
    return held.join(F.broadcast(wanted), F.col("n_tasks") == F.col("wanted")).select(entity, "n_tasks")


def leave_one_out(local: DataFrame, entity: str, slice_: str, value: str) -> DataFrame:
    """(entity, slice, macro, loo): an entity's mean over its slices, and over all but the given one.

    One row per entity and slice it has a value in; loo is null for an entity with one slice.
    """
    rows = local.dropna(subset=[value])
    sums = rows.groupBy(entity).agg(F.sum(value).alias("t"), F.count(value).alias("n"))
    return rows.join(sums, entity).select(entity, slice_, ratio(F.col("t"), F.col("n")).alias("macro"), ratio(F.col("t") - F.col(value), F.col("n") - 1).alias("loo"))


def weighted_scores(scores: DataFrame, entity: str, value: str, weight: str) -> DataFrame:
    """(entity, score): sum(weight * value) / sum(weight) over the tasks an entity has; weights renormalise themselves."""
    rows = scores.dropna(subset=[value])
    sums = rows.groupBy(entity).agg(F.sum(F.col(weight) * F.col(value)).alias("t"), F.sum(weight).alias("w"))
    return sums.select(entity, ratio(F.col("t"), F.col("w")).alias("score"))


def row_aggregators(scores: DataFrame, entity: str, value: str, trim: float = 0.1, least: float = 1e-6) -> DataFrame:
    """(entity, n, mean, lowest, median, harmonic, trimmed) of each entity's values.

    harmonic: values below `least` count as `least`. trimmed: without floor(n * trim) values at either end. An entity has
    few values (one per task), so they are sorted as an array.
    """
    listed = scores.dropna(subset=[value]).groupBy(entity).agg(F.array_sort(F.collect_list(F.col(value))).alias("v"))
    n = F.size("v")
    cut_off = F.floor(n * trim).cast("int")
    middle = (F.element_at("v", F.floor((n + 1) / 2).cast("int")) + F.element_at("v", F.floor(n / 2).cast("int") + 1)) / F.lit(2.0)
    add = lambda values, f: F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))
    return listed.select(
        entity, n.cast("long").alias("n"), (add(F.col("v"), lambda x: x.cast("double")) / n).alias("mean"), F.element_at("v", 1).cast("double").alias("lowest"), middle.alias("median"),
        (n / add(F.col("v"), lambda x: 1 / F.greatest(x.cast("double"), F.lit(least)))).alias("harmonic"), (add(F.slice("v", cut_off + 1, n - 2 * cut_off), lambda x: x.cast("double")) / (n - 2 * cut_off)).alias("trimmed"),
    )


def borda(scores: DataFrame, entity: str, task: str, value: str) -> DataFrame:
    """(entity, points): per task, the number of entities less the average rank, over the tasks that all entities have."""
    rows = scores.dropna(subset=[value])
    everyone = rows.agg(F.count_distinct(entity).alias("n"))  # one row
    complete = rows.groupBy(task).agg(F.count_distinct(entity).alias("c")).join(F.broadcast(everyone), F.col("c") == F.col("n")).select(task, "n")
    ranked = tie_ranks(rows.join(complete, task), [task], value)
    return ranked.groupBy(entity).agg(F.sum(F.col("n") - F.col("rank_avg")).alias("points"))


def covered_scores(scores: DataFrame, entity: str, value: str, n_tasks: Column, least: float) -> DataFrame:
    """(entity, n, coverage, score): the mean, null unless the entity has at least `least` of all tasks."""
    sums = scores.groupBy(entity).agg(F.count(value).alias("n"), F.sum(value).alias("t")).withColumn("coverage", ratio(F.col("n"), n_tasks))
    return sums.select(entity, "n", "coverage", F.when(F.col("coverage") >= least, ratio(F.col("t"), F.col("n"))).alias("score"))


def to_unit_scale(scores: DataFrame, value: str, group: list[str]) -> DataFrame:
    """scores with `value` as 0 to 1: a group whose largest value is over 1.5 is in percent and divided by 100.

    The largest values are one row per group and join back. Nulls stay, NaN counts for nothing.
    """
    tops = scores.groupBy(*group).agg(F.max(F.when(~F.isnan(value), F.col(value))).alias("__top"))
    joined = scores.join(small(tops), group)
    return joined.withColumn(value, F.when(F.col("__top") > 1.5, F.col(value) / 100.0).otherwise(F.col(value))).drop("__top")


def covered_items(indices: Column, total: Column) -> tuple[Column, Column]:
    """(covered, rate) of a judge's list of indices: different ones from 0 to total - 1; null lists cover nothing."""
    valid = F.filter(F.array_distinct(F.coalesce(indices, F.array().cast("array<bigint>"))), lambda i: (i >= 0) & (i < total))
    covered = F.size(valid).cast("long")
    return covered, ratio(covered, total)
