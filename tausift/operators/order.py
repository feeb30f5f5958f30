"""Ranks, running aggregates and order statistics over groups of any size.

A window runs a whole group in one task. Here groups are measured first: small ones go through a window; with a large one
anywhere, rows are range-partitioned by (group, order), so that a group may span many tasks, each task aggregates its
part, and the parts' totals are carried over in a second, small window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tausift.runtime import cut

#: Rows up to which a group is left to one task.
WINDOW_ROWS = 500_000


def largest_group(df: DataFrame, group: list[str]) -> int:
    """Rows of the largest group; 0 for an empty table."""
    counts = df.groupBy(*group).count() if group else df.agg(F.count(F.lit(1)).alias("count"))
    return counts.agg(F.max("count")).first()[0] or 0


def _combine(how: str, column: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[how](column)


def running(df: DataFrame, group: list[str], order: list[Column], value: str, how: str, name: str, inclusive: bool = True, most: int = WINDOW_ROWS) -> DataFrame:
    """df with column `name`: sum, max, min or count of `value` over the rows of the group up to this one, in `order`.

    order must be total within a group, or rows that tie get their sums in any order. inclusive=False leaves the row itself
    out (null for the first). Nulls in `value` are skipped; nulls in `group` make a group of their own.
    """
    last = 0 if inclusive else -1
    if largest_group(df, group) <= most:
        return df.withColumn(name, _combine(how, F.col(value)).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)))
    parts = max(2, df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(g).asc() for g in group]
    placed = cut(df.repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()))
    inside = _combine(how, F.col(value)).over(Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, last))
    totals = placed.groupBy(*group, "__part").agg(_combine(how, F.col(value)).alias("__total"))
    merge = "sum" if how == "count" else how
    before = totals.withColumn("__before", _combine(merge, F.col("__total")).over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    joined = _null_safe_join(placed.withColumn("__inside", inside), before.drop("__total"), [*group, "__part"])
    if merge == "sum":
        whole = F.when(F.col("__inside").isNull() & F.col("__before").isNull(), None).otherwise(F.coalesce("__inside", F.lit(0)) + F.coalesce("__before", F.lit(0)))
    else:
        whole = (F.greatest if merge == "max" else F.least)("__inside", "__before")
    return joined.withColumn(name, whole).drop("__part", "__inside", "__before")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = None
    for k in keys:
        equal = left[k].eqNullSafe(renamed[f"__r_{k}"])
        condition = equal if condition is None else condition & equal
    return left.join(renamed, condition).drop(*(f"__r_{k}" for k in keys))


def ordinal(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", most: int = WINDOW_ROWS) -> DataFrame:
    """df with the position (1, 2, 3 ..., BIGINT) of each row in its group; order should be total."""
    marked = df.withColumn("__one", F.lit(1).cast("long"))
    return running(marked, group, order, "__one", "sum", name, most=most).drop("__one")


def tie_ranks(df: DataFrame, group: list[str], value: str, low: str = "rank_min", middle: str = "rank_avg", descending: bool = True, most: int = WINDOW_ROWS) -> DataFrame:
    """df with the least rank (BIGINT) and the average rank (DOUBLE) among the rows of a group that share `value`.

    The best value has rank 1; null values come last. The running count goes over distinct values, not rows.
    """
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    key = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    placed = running(counts, group, [key], "__n", "sum", "__upto", most=most)
    ranks = placed.select(*group, value, (F.col("__upto") - F.col("__n") + 1).alias(low), (F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)).alias(middle))
    return _null_safe_join(df, ranks, [*group, value])


def at_positions(df: DataFrame, group: list[str], value: str, positions: dict[str, Column], total: str = "n") -> DataFrame:
    """One row per group: `total` and, for each name in positions, the value at that position (from 0) in ascending order.

    positions are expressions over the column `total`, whole or not; between two values the position is interpolated.
    Works on the counts of distinct values, so no group is ever collected. Null values are left out.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = running(counts, group, [F.col(value).asc()], "__n", "sum", "__upto")
    totals = counts.groupBy(*group).agg(F.sum("__n").alias(total))
    sized = _null_safe_join(upto, totals, group) if group else upto.crossJoin(F.broadcast(totals))
    picks = []
    for name, position in positions.items():
        for suffix, whole in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            inside = (whole >= F.col("__upto") - F.col("__n")) & (whole < F.col("__upto"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"__{name}_{suffix}"))
    rows = sized.groupBy(*group, total).agg(*picks)
    between = [(F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * (p - F.floor(p))).alias(n) for n, p in positions.items()]
    return rows.select(*group, total, *between)
