"""The relations that the analytics queries share, as DataFrames and as SQL.

Scores become whole numbers here (five decimals of a score fact, two of a global score, four of a local one), so that sums
are exact, equal scores tie, and both engines agree to the bit. Copies collapse; NaN and null scores go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tausift.runtime import table

#: Tasks that cover several languages; the others are in one.
MULTILINGUAL = ("BelebeleRetrieval", "WikipediaRetrievalMultilingual", "MIRACLRetrievalHardNegatives", "MLQARetrieval")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(entity, task, s): the score fact, one row per entity and task, s in hundred-thousandths."""
    rows = table(spark, d, "per_task_ndcg").filter("model_id is not null and task_name is not null and not isnan(ndcg_at_10) and ndcg_at_10 is not null")
    return rows.groupBy(F.col("model_id").alias("entity"), F.col("task_name").alias("task")).agg(F.max(F.round(F.col("ndcg_at_10") * 100000).cast("long")).alias("s"))


SCORES = """scores AS (SELECT model_id AS entity, task_name AS task, max(CAST(round(ndcg_at_10 * 100000) AS BIGINT)) AS s
    FROM per_task_ndcg WHERE model_id IS NOT NULL AND task_name IS NOT NULL AND ndcg_at_10 IS NOT NULL AND NOT isnan(ndcg_at_10) GROUP BY ALL)"""


def family(column: str = "task") -> Column:
    """multi for tasks in several languages, single for the others."""
    return F.when(F.col(column).isin(*MULTILINGUAL), "multi").otherwise("single")


FAMILY = "CASE WHEN task IN ('BelebeleRetrieval', 'WikipediaRetrievalMultilingual', 'MIRACLRetrievalHardNegatives', 'MLQARetrieval') THEN 'multi' ELSE 'single' END"


def boards(spark: SparkSession, d: str) -> DataFrame:
    """(entity, slice, g, l, tier, params, dim, kind): the wide fact, one row per entity and slice.

    g: the global score in hundredths, l: the local one in ten-thousandths; either may be null. params: null where unknown.
    """
    rows = table(spark, d, "unified_results").filter("short_name is not null and language is not null")
    known = lambda c, scale: F.max(F.when(~F.isnan(c), F.round(F.col(c) * scale).cast("long")))
    return rows.groupBy(F.col("short_name").alias("entity"), F.col("language").alias("slice")).agg(
        known("mteb_agg_score", 100).alias("g"), known("lang_specific_avg", 10000).alias("l"), F.max("tier").alias("tier"), F.max(F.when(F.col("params_numeric") > 0, F.col("params_numeric"))).alias("params"),
        F.max("dim").cast("long").alias("dim"), F.max("source").alias("kind"),
    )


BOARDS = """boards AS (SELECT short_name AS entity, language AS slice,
    max(CASE WHEN NOT isnan(mteb_agg_score) THEN CAST(round(mteb_agg_score * 100) AS BIGINT) END) AS g,
    max(CASE WHEN NOT isnan(lang_specific_avg) THEN CAST(round(lang_specific_avg * 10000) AS BIGINT) END) AS l,
    max(tier) AS tier, max(CASE WHEN params_numeric > 0 THEN params_numeric END) AS params, CAST(max(dim) AS BIGINT) AS dim, max(source) AS kind
    FROM unified_results WHERE short_name IS NOT NULL AND language IS NOT NULL GROUP BY ALL)"""


def slices(spark: SparkSession, d: str) -> DataFrame:
    """boards with both scores."""
    return boards(spark, d).dropna(subset=["g", "l"])


SLICES = BOARDS + ", slices AS (SELECT * FROM boards WHERE g IS NOT NULL AND l IS NOT NULL)"


def local_scores(spark: SparkSession, d: str) -> DataFrame:
    """(entity, task, slice, s): task scores by slice, in ten-thousandths, from the wide fact's task columns."""
    tasks = ["task_belebele", "task_wikipedia", "task_miracl_hn", "task_mlqa"]
    rows = table(spark, d, "unified_results").filter("short_name is not null and language is not null").select(F.col("short_name").alias("entity"), F.col("language").alias("slice"), *tasks)
    long = rows.unpivot(["entity", "slice"], tasks, "task", "x").filter("x is not null and not isnan(x)")
    return long.groupBy("entity", "slice", "task").agg(F.max(F.round(F.col("x") * 10000).cast("long")).alias("s"))


LOCAL = """local_scores AS (SELECT entity, slice, task, max(CAST(round(x * 10000) AS BIGINT)) AS s FROM (
    UNPIVOT (SELECT short_name AS entity, language AS slice, task_belebele, task_wikipedia, task_miracl_hn, task_mlqa FROM unified_results WHERE short_name IS NOT NULL AND language IS NOT NULL)
    ON task_belebele, task_wikipedia, task_miracl_hn, task_mlqa INTO NAME task VALUE x) WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY ALL)"""
