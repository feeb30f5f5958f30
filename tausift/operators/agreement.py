"""Agreement of two orders of the same entities: concordant, discordant and tied pairs, counted without forming pairs.

All tie conventions of inversion rates and of Kendall's tau follow from one set of counts per slice. The counts come from
inversions of permutations: by merging in slices that fit a task; in larger ones over a grid of rank blocks, whose cells
are compared by their counts and only whose rows and columns are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tausift.operators.order import largest_group, ordinal

#: Entities of a slice up to which one task merges it, and blocks per side of the grid beyond.
MERGE_ROWS, GRID = 200_000, 1_000


def inversions(ranks: np.ndarray) -> int:
    """Pairs i < j with ranks[i] > ranks[j], by merging."""
    total = 0
    values = np.asarray(ranks, dtype=np.int64)
    n = len(values)
    if n < 2:
        return 0
    block = 64
    padded = np.full(-(-n // block) * block, np.iinfo(np.int64).max)
    padded[:n] = values
    rows = padded.reshape(-1, block)
    upper = np.triu(np.ones((block, block), bool), 1)
    for start in range(0, len(rows), 1024):
        part = rows[start : start + 1024]
        total += int(((part[:, :, None] > part[:, None, :]) & upper).sum())
    runs = list(np.sort(rows, axis=1))
    while len(runs) > 1:
        merged = []
        for k in range(0, len(runs) - 1, 2):
            left, right = runs[k], runs[k + 1]
            total += int((len(left) - np.searchsorted(left, right, side="right")).sum())
            merged.append(np.sort(np.concatenate((left, right)), kind="stable"))
        if len(runs) % 2:
            merged.append(runs[-1])
        runs = merged
    return total


def count_inversions(df: DataFrame, group: list[str], order: list[str], value: list[str], name: str = "inversions", most: int = MERGE_ROWS) -> DataFrame:
    """(group, name): pairs of rows of a group that `order` and `value` put in opposite orders, BIGINT.

    Rows tied in either list of columns are no inversion. Nulls sort first. Groups of one row count 0.
    """
    rest = [c for c in value if c not in order]
    ties = [c for c in order if c not in value]
    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    slim = df.select(*group, *dict.fromkeys([*order, *value]))
    if largest_group(slim, group) <= most:

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([*order, *rest], kind="stable").reset_index(drop=True)
            at = pdf.sort_values([*value, *ties], kind="stable").index.to_numpy()
            # the k-th row by value stands at at[k] by order: inversions of a permutation and of its inverse are as many
            return pd.DataFrame([[*(pdf[g].iloc[0] for g in group), inversions(at)]], columns=[*group, name])

        return slim.groupBy(*group).applyInPandas(merge, f"{kinds}, {name} long")
    asc = lambda columns: [F.col(c).asc() for c in columns]
    ranked = ordinal(ordinal(slim, group, asc([*order, *rest]), "__x"), group, asc([*value, *ties]), "__y")
    sizes = ranked.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / GRID).alias("__b"))
    cells = ranked.join(sizes, group).select(*group, "__x", "__y", F.floor((F.col("__x") - 1) / F.col("__b")).alias("__i"), F.floor((F.col("__y") - 1) / F.col("__b")).alias("__j"))
    counts = cells.groupBy(*group, "__i", "__j").agg(F.count(F.lit(1)).alias("__n"))
    above = Window.partitionBy(*group, "__j").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    # pairs of cells that differ in row and column: every cell against the cells of earlier rows and later columns
    grid = counts.select(*group, "__i").distinct().join(counts.select(*group, "__j").distinct(), group).join(counts, [*group, "__i", "__j"], "left")
    filled = grid.withColumn("__n", F.coalesce("__n", F.lit(0))).withColumn("__above", F.coalesce(F.sum("__n").over(above), F.lit(0)))
    later = Window.partitionBy(*group, "__i").orderBy(F.col("__j").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cross = filled.withColumn("__c", F.col("__n") * F.coalesce(F.sum("__above").over(later), F.lit(0))).groupBy(*group).agg(F.sum("__c").cast("long").alias("__d"))

    def block(inner: str) -> object:
        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__x", kind="stable")
            own = sum(inversions(p["__y"].to_numpy()) for _, p in pdf.groupby(inner)) if inner else 0
            return pd.DataFrame([[*(pdf[g].iloc[0] for g in group), inversions(pdf["__y"].to_numpy()) - own]], columns=[*group, "__d"])

        return merge

    rows = cells.groupBy(*group, "__i").applyInPandas(block(""), f"{kinds}, __d long")
    columns = cells.groupBy(*group, "__j").applyInPandas(block("__i"), f"{kinds}, __d long")
    return cross.unionByName(rows).unionByName(columns).groupBy(*group).agg(F.sum("__d").cast("long").alias(name))


COUNTS = "n long, pairs long, concordant long, discordant long, tied_x long, tied_y long, tied_both long"


def counts_of(x: np.ndarray, y: np.ndarray) -> tuple[int, ...]:
    """The columns of `pair_counts` for two arrays without nulls."""
    n = len(x)
    pairs = n * (n - 1) // 2
    order = np.lexsort((y, x))
    xs, ys = x[order], y[order]
    tied = lambda c: int((c * (c - 1) // 2).sum())
    lengths = lambda new: np.diff(np.flatnonzero(np.concatenate((new, [True]))))
    new_x = np.concatenate(([True], xs[1:] != xs[:-1])) if n else np.zeros(0, bool)
    new_both = new_x | (np.concatenate(([True], ys[1:] != ys[:-1])) if n else new_x)
    ranked, counts_y = np.unique(ys, return_inverse=True, return_counts=True)[1:] if n else (ys, ys)
    all_x, both, all_y = tied(lengths(new_x)), tied(lengths(new_both)), tied(counts_y)
    discordant = inversions(ranked)
    return n, pairs, pairs - discordant - all_x - all_y + both, discordant, all_x - both, all_y - both, both


def _oriented(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs i < j with y_i > y_j among those tied in x."""
    order = np.argsort(x, kind="stable")
    of_x, of_y = np.unique(x[order], return_inverse=True)[1], np.unique(y[order], return_inverse=True)[1]
    return inversions(of_x.astype(np.int64) * (len(x) + 1) + of_y)


def pair_counts(df: DataFrame, group: list[str], x: str, y: str, orientation: str | None = None, most: int = MERGE_ROWS) -> DataFrame:
    """Per group: n, pairs, concordant, discordant, tied_x and tied_y (in that one only), tied_both, all BIGINT.

    With a column `orientation` also oriented: pairs on which the strict comparisons x_i > x_j and y_i > y_j differ, i
    standing before j in that column; one-sided ties count in one orientation only. Rows with a null x or y are left out.
    """
    rows = df.dropna(subset=[x, y]).select(*group, *dict.fromkeys([x, y, *([orientation] if orientation else [])]))
    if largest_group(rows, group) <= most:
        kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)

        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            if orientation:
                pdf = pdf.sort_values(orientation, kind="stable")
            a, b = pdf[x].to_numpy(), pdf[y].to_numpy()
            found = list(counts_of(a, b))
            if orientation:
                found.append(found[3] + _oriented(a, b) + _oriented(b, a))
            return pd.DataFrame([[*(pdf[g].iloc[0] for g in group), *found]])

        return rows.groupBy(*group).applyInPandas(count, f"{kinds}, {COUNTS}{', oriented long' if orientation else ''}")
    inverted = count_inversions(rows, group, [x], [y], "discordant", most)
    pairs_of = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2).cast("long")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    both = rows.groupBy(*group, x, y).agg(F.count(F.lit(1)).alias("c"))
    in_x = both.groupBy(*group, x).agg(F.sum("c").alias("c")).groupBy(*group).agg(pairs_of("c").alias("all_x"))
    in_y = both.groupBy(*group, y).agg(F.sum("c").alias("c")).groupBy(*group).agg(pairs_of("c").alias("all_y"))
    in_both = both.groupBy(*group).agg(pairs_of("c").alias("tied_both"))
    parts = [inverted, in_x, in_y, in_both]
    if orientation:
        for tied, other, name in ((x, y, "ox"), (y, x, "oy")):
            # ties are few; values that stand alone have no pair to turn round
            keyed = rows.withColumn("__k", F.col(tied))
            several = keyed.join(keyed.groupBy(*group, "__k").count().filter("count > 1").drop("count"), [*group, "__k"], "left_semi")
            turned = count_inversions(several, [*group, "__k"], [orientation], [other], "o", most).groupBy(*group).agg(F.sum("o").alias(name))
            parts.append(sizes.select(*group).join(turned, group, "left").select(*group, F.coalesce(name, F.lit(0)).alias(name)))
    joined = sizes
    for part in parts:
        joined = joined.join(part, group)
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    return joined.select(
        *group, "n", pairs.alias("pairs"), (pairs - F.col("discordant") - F.col("all_x") - F.col("all_y") + F.col("tied_both")).alias("concordant"), "discordant",
        (F.col("all_x") - F.col("tied_both")).alias("tied_x"), (F.col("all_y") - F.col("tied_both")).alias("tied_y"), "tied_both",
        *([(F.col("discordant") + F.col("ox") + F.col("oy")).alias("oriented")] if orientation else []),
    )


def tau_b() -> Column:
    """Kendall's tau-b over the columns of `pair_counts`; null if either side has one value only."""
    c, d = F.col("concordant").cast("double"), F.col("discordant").cast("double")
    free_x, free_y = c + d + F.col("tied_y"), c + d + F.col("tied_x")
    return F.when((free_x > 0) & (free_y > 0), (c - d) / F.sqrt(free_x * free_y))


def gamma() -> Column:
    """(C - D) / (C + D); null without untied pairs."""
    c, d = F.col("concordant").cast("double"), F.col("discordant").cast("double")
    return F.when(c + d > 0, (c - d) / (c + d))


def inversion_rates() -> dict[str, Column]:
    """Inversion rate by tie convention, over the columns of `pair_counts`; null without pairs.

    strict: strict comparisons differ (needs `oriented`); skip: untied pairs only; skip_full: discordant of all pairs; half: half for any
    tie; half_xor: half for a tie in exactly one.
    """
    p, d = F.col("pairs").cast("double"), F.col("discordant").cast("double")
    one = (F.col("tied_x") + F.col("tied_y")).cast("double")
    untied = F.col("concordant").cast("double") + d
    over_all = lambda n: F.when(p > 0, n / p)
    return {
        "strict": over_all(F.col("oriented").cast("double")),
        "skip": F.when(untied > 0, d / untied),
        "skip_full": over_all(d),
        "half": over_all(d + F.lit(0.5) * (one + F.col("tied_both"))),
        "half_xor": over_all(d + F.lit(0.5) * one),
    }
