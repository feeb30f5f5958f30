"""Queries of schema drift over the leaderboard exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tausift.operators.drift import consistent_scores, schema_changes
from tausift.runtime import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a field, with the file in which it first shows."""
    return schema_changes(table(spark, d, "leaderboard_files"))


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    """All scores of all exports in one table, under each field's first name."""
    return consistent_scores(table(spark, d, "leaderboard_files"))


def p4_fields(spark: SparkSession, d: str) -> DataFrame:
    """Per board and field of the consistent table: files, written names, scores, and cells that hold none."""
    scores = p4_scores(spark, d)
    return scores.groupBy("board", "field").agg(
        F.count_distinct("file_id").alias("files"), F.count_distinct("written_field").alias("names"), F.count("score").alias("scores"), F.count_if(F.col("score").isNull()).alias("texts")
    )


def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    """Per file, what the consistent table holds of it: models, cells, and the sum of their numbers in ten-thousandths."""
    scores = p4_scores(spark, d)
    return scores.groupBy("file_id").agg(F.count_distinct("row_no").alias("models"), F.count(F.lit(1)).alias("cells"), F.sum(F.round(F.col("score") * 10_000).cast("long")).alias("total_e4"))


QUERIES = {f.__name__: f for f in (p4_found, p4_scores, p4_fields, p4_cells)}

# Cells are read by regular expressions: a quoted or plain stretch up to the delimiter, of the delimiter that parts the header
# into the most cells. The column of the models is the one with the most cells that begin with no number.
ORACLE = {
    "p4_cells": r"""
        WITH files AS (SELECT DISTINCT file_id, ltrim(payload, chr(65279)) AS x FROM leaderboard_files WHERE board IS NOT NULL AND file_id IS NOT NULL),
        lines AS (SELECT file_id, unnest(list_filter(string_split_regex(x, '\r\n|\r|\n'), lambda s: trim(s) <> '')) AS line, generate_subscripts(list_filter(string_split_regex(x, '\r\n|\r|\n'), lambda s: trim(s) <> ''), 1) AS line_no FROM files),
        marks AS (SELECT file_id, arg_max(mark, (n, rank)) AS mark FROM (
            SELECT file_id, mark, rank, len(regexp_extract_all(line || mark, '("(?:[^"]|"")*"|[^"' || mark || ']*)' || mark)) AS n
            FROM lines, (VALUES (',', 3), (';', 2), (chr(9), 1)) AS m(mark, rank) WHERE line_no = 1) GROUP BY file_id),
        parts AS (SELECT file_id, line_no, regexp_extract_all(line || mark, '(\s*"(?:[^"]|"")*"\s*|[^"' || mark || ']*)' || mark, 1) AS c FROM lines JOIN marks USING (file_id)),
        cells AS (SELECT file_id, line_no, k, trim(trim(trim(c[k], ' ' || chr(9) || chr(160)), '"'), ' ' || chr(9) || chr(160)) AS cell FROM (SELECT *, unnest(generate_series(1, len(c))) AS k FROM parts)),
        named AS (SELECT c.file_id, c.line_no, c.k, c.cell FROM cells c JOIN cells h ON h.file_id = c.file_id AND h.k = c.k AND h.line_no = 1 WHERE c.line_no > 1 AND h.cell <> '' AND lower(c.cell) NOT IN ('', 'n/a', '--', '—', 'nan')),
        model AS (SELECT file_id, arg_max(k, (n, -k)) AS m FROM (SELECT file_id, k, count(*) FILTER (NOT regexp_matches(cell, '^[^\p{L}\d]*\d')) AS n FROM named GROUP BY file_id, k) GROUP BY file_id)
        SELECT file_id, count(DISTINCT line_no) AS models, count(*) AS cells,
               CAST(sum(CAST(round(TRY_CAST(nullif(replace(regexp_extract(cell, '^[^\p{L}\d]*?([-+−]?\d+(?:[.,]\d+)?)', 1), ',', '.'), '') AS DOUBLE) * 10000) AS BIGINT)) AS BIGINT) AS total_e4
        FROM named JOIN model USING (file_id) WHERE k <> m GROUP BY file_id""",
}
