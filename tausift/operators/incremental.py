"""Work that picks up where it stopped: logs, caches, idempotent appends."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key of an append log, by `order` and then by all other columns; nulls in order come first."""
    rest = [c for c in log.columns if c not in keys and c not in order]
    picked = log.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__r"))
    return picked.select(*keys, *(F.col(f"__r.{c}").alias(c) for c in [*order, *rest])).select(*log.columns)


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted rows whose key isn't done yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def through_cache(wanted: DataFrame, cache: DataFrame, keys: list[str], value: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """wanted with `value` and `hit`: from the cache where the key is there, else computed, for the missing rows only."""
    held = cache.dropDuplicates(keys).select(*keys, value)
    hits = wanted.join(held, keys).withColumn("hit", F.lit(True))
    fresh = compute(wanted.join(held, keys, "left_anti")).withColumn("hit", F.lit(False))
    return hits.unionByName(fresh)


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows whose key is in new, and all of new: an append that may be repeated, and an upsert."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def first_wins(keys: list[str], *sources: DataFrame) -> DataFrame:
    """The union of the sources with one row per key, from the first source that has it (the least row within it)."""
    ranked = None
    for k, source in enumerate(sources):
        part = source.withColumn("__source", F.lit(k))
        ranked = part if ranked is None else ranked.unionByName(part)
    rest = [c for c in sources[0].columns if c not in keys]
    best = ranked.groupBy(*keys).agg(F.min(F.struct("__source", *rest)).alias("__r"))
    return best.select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest)).select(*sources[0].columns)


def token_batches(df: DataFrame, group: str, order: str, size: str, most_items: int, most_size: int) -> DataFrame:
    """df with `batch`: greedy batches in order, closed before they would pass most_items rows or most_size in all.

    A sequential fold per group; give a group that fits a task's stream (a file, a hash bucket). A row that alone is larger
    has its own batch. Sorted rows stream through; nothing is buffered but one Arrow batch.
    """
    rows = df.repartition(group).sortWithinPartitions(group, order)

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, items, total, number = object(), 0, 0, 0
        for batch in batches:
            out = []
            for g, n in zip(batch.column(batch.schema.get_field_index(group)).to_pylist(), batch.column(batch.schema.get_field_index(size)).to_pylist(), strict=True):
                n = n or 0
                if g != current:
                    current, items, total, number = g, 0, 0, 0
                elif items >= most_items or total + n > most_size:
                    items, total, number = 0, 0, number + 1
                items, total = items + 1, total + n
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "batch"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "batch long"])
    return rows.mapInArrow(fold, schema)


def gate(df: DataFrame, kind: Column, score: Column, least: dict[str, float]) -> DataFrame:
    """df with `valid`: the score reaches the threshold of its kind; false for null scores and unknown kinds."""
    threshold = F.create_map(*(F.lit(x) for k, v in least.items() for x in (k, float(v))))[kind]
    return df.withColumn("valid", F.coalesce(score >= threshold, F.lit(False)))
