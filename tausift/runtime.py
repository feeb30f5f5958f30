"""Session helpers shared by all operators: lineage cuts, bounded broadcasts, table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a dimension counts as small. A side is broadcast only after it was measured against both.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


_LONG = ("string", "binary", "array", "map", "struct")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for lineage cuts.

    Taken from spark.checkpoint.dir. Only a session on one machine without that setting (a test) gets a folder of its own; on
    a cluster its absence is an error, since other machines couldn't read a local folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not (context.master or "").startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    folder = named or tempfile.mkdtemp(prefix="tausift-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it from there, so that no later use computes it again.

    The files outlive executors; a lost executor costs no recomputation of what lies before the cut.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows and BROADCAST_BYTES of values, else df as it is (Spark then
    shuffles the join).

    Runs one job that reads at most rows + 1 rows. Texts, binaries, arrays and maps are measured, other values count 8 bytes.
    """
    sizes = [F.length(F.col(f"`{f.name}`").cast("string")) if f.dataType.typeName() in _LONG else F.lit(8) for f in df.schema]
    row = sum((F.coalesce(s, F.lit(0)).cast("long") for s in sizes), F.lit(0).cast("long"))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if found.n <= rows and found.b <= BROADCAST_BYTES else df


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN becomes NULL, so that Spark's aggregates skip it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
