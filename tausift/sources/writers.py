"""Writers: tables in a fixed order, documents that merge, append logs, retrieval sets, and text tables.

Distributed writes go where the path says. Files with a preamble and text tables are for reports: they collect, and refuse
more than REPORT_ROWS rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tausift.functions.text import markdown_free
from tausift.operators.incremental import replaced

REPORT_ROWS = 100_000


def _report(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows")
    return rows


def write_sorted_csv(df: DataFrame, path: str, order: Sequence[str], decimals: int | None = None) -> None:
    """CSV files with a header in a total order, doubles with a fixed number of decimals."""
    shown = df.select(*(F.format_string(f"%.{decimals}f", c).alias(c) if decimals is not None and t == "double" else F.col(c) for c, t in df.dtypes))
    shown.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_csv_with_preamble(df: DataFrame, path: str, preamble: Sequence[str], columns: Sequence[str]) -> None:
    """One CSV file: `#` lines, then the columns given, others left out."""
    rows = _report(df.select(*columns))
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"# {line}\n" for line in preamble)
        f.write(",".join(columns) + "\n")
        for r in rows:
            f.write(",".join("" if v is None else json.dumps(v) if isinstance(v, str) and any(c in v for c in ',"\n') else str(v) for v in r) + "\n")


def merge_json(path: str, part: dict) -> dict:
    """The JSON object at path with `part` over it, written back whole."""
    whole: dict = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
    whole |= part
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(whole, f, ensure_ascii=False, indent=1, sort_keys=True)
    os.replace(path + ".new", path)
    return whole


def append_log(df: DataFrame, path: str) -> None:
    """Rows as JSON lines behind those that are there."""
    df.write.mode("append").json(path)


def write_retrieval_set(pairs: DataFrame, documents: DataFrame, path: str) -> None:
    """corpus.jsonl, queries.jsonl and qrels/test.tsv (folders of parts) of valid pairs.

    pairs: (query_id, question, doc_id, query_type, valid); documents: (doc_id, content), whose Markdown marks go. Relevance
    leaves out unanswerable pairs and pairs without a document.
    """
    valid = pairs.filter("valid")
    documents.select(F.col("doc_id").alias("_id"), F.lit("").alias("title"), markdown_free("content").alias("text")).write.mode("overwrite").json(f"{path}/corpus.jsonl")
    valid.select(F.col("query_id").alias("_id"), F.col("question").alias("text")).write.mode("overwrite").json(f"{path}/queries.jsonl")
    judged = valid.filter("query_type <> 'unanswerable' and doc_id is not null")
    judged.select(F.concat_ws("\t", "query_id", F.lit("0"), "doc_id", F.lit("1")).alias("value")).write.mode("overwrite").text(f"{path}/qrels/test.tsv")


def upsert_parquet(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str]) -> str:
    """Writes a new version of a keyed table with `rows` over it, under path/v=N; returns its path. Old versions stay."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    versions = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    whole = replaced(spark.read.parquet(f"{path}/v={max(versions)}"), rows, list(keys)) if versions else rows
    out = f"{path}/v={max(versions, default=-1) + 1}"
    whole.write.mode("overwrite").parquet(out)
    return out


def markdown_table(df: DataFrame, bold: str | None = None, decimals: int = 4) -> str:
    """A Markdown table of a report; rows whose boolean column `bold` is true are bold, and that column isn't shown."""
    columns = [c for c in df.columns if c != bold]
    show = lambda v: "—" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for r in _report(df):
        cells = [show(r[c]) for c in columns]
        lines.append("| " + " | ".join(f"**{c}**" if bold and r[bold] else c for c in cells) + " |")
    return "\n".join(lines) + "\n"


def latex_table(df: DataFrame, caption: str, decimals: int = 3) -> str:
    """A LaTeX tabular of a report."""
    show = lambda v: "--" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("&", r"\&").replace("%", r"\%")
    body = "\n".join(" & ".join(show(v) for v in r) + r" \\" for r in _report(df))
    head = " & ".join(show(c) for c in df.columns)
    return f"\\begin{{table}}\n\\caption{{{caption}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{head} \\\\\n\\hline\n{body}\n\\end{{tabular}}\n\\end{{table}}\n"
