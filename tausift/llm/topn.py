"""The N best items of every group, by secondary sort.

A group may hold a third of all rows, so no task may own a whole group. The rows are spread by (group, identifier) first:
every task holds a thin slice of every large group. Each task sorts its slice by score and identifier and streams it, in
Arrow batches, through a filter that lets N rows per group pass; the few survivors are then hash-partitioned by group,
sorted and streamed once more, and the filter numbers them. Neither pass buffers more than one batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_per_key(df: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """One row per key: `value` of the row with the greatest `at`.

    A null `at` counts as the oldest; of several rows at the same time the greatest value wins (NaN above all numbers,
    null below). Rows with a null in a key are dropped. Partial maxima are taken before the shuffle.
    """
    named = df.select(*keys, F.col(at).alias("__at"), F.col(value).alias("__value")).dropna(subset=keys)
    best = named.groupBy(*keys).agg(F.max(F.struct("__at", "__value")).alias("__best"))
    return best.select(*keys, F.col("__best.__value").alias(value))


def _first_of_runs(batches: Iterable[pa.RecordBatch], n: int, place: str | None) -> Iterator[pa.RecordBatch]:
    """Of each run of equal first columns the first n rows; place: a column for the position, from 1.

    The input is sorted by its first column. Runs may span batches; only the last key and its count are kept.
    """
    last, seen = None, 0
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        key = batch.column(0)
        starts = np.concatenate(([True], pc.not_equal(key.slice(1), key.slice(0, rows - 1)).to_numpy(zero_copy_only=False)))
        index = np.arange(rows)
        at = index - np.maximum.accumulate(np.where(starts, index, 0))
        if seen and key[0].as_py() == last:
            first_run = int(np.argmax(starts[1:])) + 1 if starts[1:].any() else rows
            at[:first_run] += seen
        last, seen = key[-1].as_py(), int(at[-1]) + 1
        keep = at < n
        if keep.any():
            out = batch.filter(pa.array(keep))
            if place:
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array(at[keep] + 1, pa.int32())], [*out.schema.names, place])
            yield out


def top_n(df: DataFrame, group: str, score: str, item: str, n: int, place: str = "place", spread: bool = True) -> DataFrame:
    """The n rows with the highest score of each group, as (group, place, item, score); place from 1.

    Order: score descending, then item ascending by code point, then nothing: (group, item) should be unique, repeated
    pairs hold one place each, in an order that makes no difference to the result. Rows with a null group or item and
    rows whose score is null or NaN have no place. A group with fewer than n rows gives what it has; an empty table
    gives an empty result. Other columns of df are ignored, whatever their names.

    spread=False leaves out the first shuffle. Only for a df whose groups lie over many tasks already, as after an
    aggregation by (group, item).
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    slim = df.select(F.col(group).alias("__g"), F.col(score).cast("double").alias("__s"), F.col(item).alias("__i"))
    slim = slim.dropna().filter(~F.isnan("__s"))
    order: list[Column] = [F.col("__g").asc(), F.col("__s").desc(), F.col("__i").asc()]
    schema = slim.schema
    numbered = T.StructType([*schema.fields, T.StructField("__p", T.IntegerType())])
    thin = slim.repartition("__g", "__i") if spread else slim
    local = thin.sortWithinPartitions(*order).mapInArrow(lambda b: _first_of_runs(b, n, None), schema)
    places = local.repartition("__g").sortWithinPartitions(*order).mapInArrow(lambda b: _first_of_runs(b, n, "__p"), numbered)
    return places.select(F.col("__g").alias(group), F.col("__p").alias(place), F.col("__i").alias(item), F.col("__s").alias(score))

