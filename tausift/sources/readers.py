"""Readers for score files, nested results, retrieval sets, logs and configurations."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tausift.runtime import nan_to_null

SCORES = T.StructType([T.StructField("model_id", T.StringType()), T.StructField("task_name", T.StringType()), T.StructField("ndcg_at_10", T.DoubleType())])


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return files is not None and len(files) > 0


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, comment: str | None = "#") -> DataFrame:
    """CSV with a header and a fixed schema; lines that begin with `comment` are skipped, NaN in numbers becomes null."""
    reader = spark.read.option("header", True).schema(schema)
    frame = (reader.option("comment", comment) if comment else reader).csv(path if isinstance(path, str) else list(path))
    return nan_to_null(frame, *(f.name for f in frame.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))))


def read_wide_csv(spark: SparkSession, path: str, key: str = "Model", tasks: Sequence[str] | None = None) -> DataFrame:
    """(entity, task, score) from a wide CSV with an optional unnamed index column.

    tasks: the columns to keep (those that exist), None for all. Markdown links around names are taken off; cells that are
    no numbers, and rows without a name, are dropped.
    """
    wide = spark.read.option("header", True).csv(path)
    names = [c for c in wide.columns if c != key and not c.startswith("_c") and (tasks is None or c in tasks)]
    if not names:
        return spark.createDataFrame([], "entity string, task string, score double")
    long = wide.select(F.col(key).alias("entity"), *(F.col(f"`{c}`") for c in names)).unpivot(["entity"], [f"`{c}`" for c in names], "task", "cell")
    entity = F.regexp_replace(F.trim("entity"), r"^\[([^\]]*)\]\([^)]*\)$", "$1")
    return nan_to_null(long.select(entity.alias("entity"), "task", F.col("cell").try_cast("double").alias("score")), "score").dropna()


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first path (or glob) that there is."""
    return next((p for p in paths if _exists(spark, p)), None)


def read_cached(spark: SparkSession, path: str, make: DataFrame) -> DataFrame:
    """The parquet table at path; made and written there first if it isn't there."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        make.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_latest_log(spark: SparkSession, path: str, schema: T.StructType | str, keys: Sequence[str], order: str) -> DataFrame:
    """The last record per key of an append-only JSON-lines log; lines that are no JSON are skipped."""
    from tausift.operators.incremental import latest

    log = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return latest(log.dropna(subset=list(keys)), list(keys), [order])


def read_retrieval_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, relevance) of a folder with corpus.jsonl, queries.jsonl and qrels/test.tsv.

    corpus: (doc_id, text), title and text joined by a blank and trimmed. relevance: (qid, doc_id, rel) from columns 1, 3
    and 4 of a headerless table; lines with fewer columns are skipped.
    """
    corpus = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl").filter("_id is not null")
    queries = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl").filter("_id is not null")
    lines = spark.read.text(f"{path}/qrels/test.tsv").select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 4)
    relevance = lines.select(F.col("c")[0].alias("qid"), F.col("c")[2].alias("doc_id"), F.col("c")[3].try_cast("int").alias("rel")).dropna()
    return corpus.select(F.col("_id").alias("doc_id"), F.trim(F.concat_ws(" ", "title", "text")).alias("text")), queries.select(F.col("_id").alias("qid"), "text"), relevance


def retrieval_set_of(pairs: DataFrame, position: str, passage: str, link: str, question: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, relevance) of a parallel table: passages are told apart by link, questions by text, first seen wins.

    Numbers follow the first position: C0, C1 ... and Q0, Q1 ...
    """
    from tausift.operators.order import ordinal

    docs = pairs.dropna(subset=[link]).groupBy(link).agg(F.min(F.struct(position, passage)).alias("r")).select(link, F.col(f"r.{position}").alias("p"), F.col(f"r.{passage}").alias("text"))
    docs = ordinal(docs, [], [F.col("p").asc(), F.col(link).asc()], "k").select(F.col(link).alias("__link"), F.concat(F.lit("C"), (F.col("k") - 1).cast("string")).alias("doc_id"), "text")
    asked = pairs.dropna(subset=[question]).groupBy(question).agg(F.min(position).alias("p"))
    asked = ordinal(asked, [], [F.col("p").asc(), F.col(question).asc()], "k").select(question, F.concat(F.lit("Q"), (F.col("k") - 1).cast("string")).alias("qid"))
    judged = pairs.select(F.col(link).alias("__link"), question).dropna().distinct()
    relevance = judged.join(docs.select("__link", "doc_id"), "__link").join(asked, question).select("qid", "doc_id", F.lit(1).alias("rel"))
    return docs.select("doc_id", "text"), asked.select("qid", F.col(question).alias("text")), relevance


ENTRY = "array<struct<languages: array<string>, hf_subset: string, ndcg_at_10: double, main_score: double>>"
SPLITS = ("test", "dev", "validation")


def flatten_results(documents: DataFrame, entity: str, task: str, body: str, splits: Sequence[str] = SPLITS, most_languages: int = 2) -> DataFrame:
    """(entity, task, split, language, score) from nested result documents `{"scores": {split: [entries]}}`.

    Of a document's splits the first of `splits` that it has counts, else the first by name. score: ndcg_at_10, else
    main_score. Entries of more than `most_languages` languages give no row; later entries of a language replace earlier ones.
    Documents that don't parse give no rows.
    """
    parsed = documents.select(F.col(entity).alias("entity"), F.col(task).alias("task"), F.from_json(body, f"scores map<string, {ENTRY}>").getField("scores").alias("m")).filter("m is not null")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, splits)), F.col("split")), F.lit(0)), F.lit(len(splits) + 1))
    each = parsed.select("entity", "task", F.explode("m").alias("split", "entries")).filter(F.size("entries") > 0)
    chosen = each.groupBy("entity", "task").agg(F.min_by(F.struct("split", "entries"), F.struct(rank, F.col("split"))).alias("c"))
    rows = chosen.select("entity", "task", "c.split", F.posexplode("c.entries").alias("k", "e")).filter(F.size("e.languages") <= most_languages)
    scored = rows.select("entity", "task", "split", "k", F.explode("e.languages").alias("language"), F.coalesce(F.when(~F.isnan("e.ndcg_at_10"), F.col("e.ndcg_at_10")), F.col("e.main_score")).alias("score"))
    return scored.groupBy("entity", "task", "split", "language").agg(F.max_by("score", "k").alias("score"))


def result_scores(documents: DataFrame, entity: str, task: str, body: str) -> tuple[DataFrame, DataFrame]:
    """(entity, task, language, score) and (entity, task, n, score): scores by language, and the mean over all entries of all splits.

    The block by language is the first that holds anything of scores.test, scores.dev, test and dev. A block is a list of
    entries with languages, or an object keyed by language; scores are ndcg_at_10, later entries of a language replace earlier
    ones. The mean is over list blocks, ndcg_at_10 else main_score. Documents that don't parse give no rows.
    """
    parsed = documents.select(F.col(entity).alias("entity"), F.col(task).alias("task"), F.from_json(body, "scores map<string, string>, test string, dev string").alias("b"))
    holds = lambda c: F.when(~F.regexp_replace(c, r"\s", "").isin("", "[]", "{}", "null"), c)
    block = F.coalesce(*(holds(c) for c in (F.col("b.scores")["test"], F.col("b.scores")["dev"], F.col("b.test"), F.col("b.dev"))))
    blocks = parsed.select("entity", "task", block.alias("block")).filter("block is not null")
    listed = blocks.select("entity", "task", F.posexplode(F.from_json("block", ENTRY)).alias("k", "e")).select("entity", "task", "k", F.explode("e.languages").alias("language"), F.col("e.ndcg_at_10").alias("score"))
    keyed = blocks.filter(F.ltrim("block").startswith("{")).select("entity", "task", F.explode(F.from_json("block", "map<string, struct<ndcg_at_10: double>>")).alias("language", "m")).select("entity", "task", F.lit(0).alias("k"), "language", F.col("m.ndcg_at_10").alias("score"))
    by_language = listed.unionByName(keyed).dropna(subset=["score"]).groupBy("entity", "task", "language").agg(F.max_by("score", "k").alias("score"))
    entries = parsed.select("entity", "task", F.explode(F.map_values("b.scores")).alias("x")).select("entity", "task", F.explode(F.from_json("x", ENTRY)).alias("e"))
    means = entries.select("entity", "task", F.coalesce("e.ndcg_at_10", "e.main_score").alias("s")).dropna(subset=["s"]).groupBy("entity", "task").agg(F.count("s").alias("n"), F.avg("s").alias("score"))
    return by_language, means


def score_at(body: Column, codes: Sequence[str]) -> Column:
    """The ndcg_at_10 of one language in a result document: of the first entry with any of the codes, or under the first of
    the codes in an object keyed by language. The block is scores.test, else test."""
    document = F.from_json(body, "scores map<string, string>, test string")
    test = document["scores"]["test"]
    block = F.coalesce(F.when(~F.regexp_replace(test, r"\s", "").isin("", "[]", "{}", "null"), test), document["test"])
    wanted = F.array(*map(F.lit, codes))
    hits = F.filter(F.from_json(block, ENTRY), lambda e: F.arrays_overlap(e["languages"], wanted) & e["ndcg_at_10"].isNotNull())
    keyed = F.from_json(F.when(F.ltrim(block).startswith("{"), block), "map<string, struct<ndcg_at_10: double>>")
    return F.coalesce(F.get(hits, F.lit(0))["ndcg_at_10"], *(keyed[c]["ndcg_at_10"] for c in codes))


def task_scores(documents: DataFrame, entity: str, task: str, body: str, splits: str, subsets: str, prefixes: str) -> DataFrame:
    """(entity, task, splits, score): subsets averaged within a split, then splits.

    splits, subsets, prefixes: array columns with what the task declares. The split `test` counts alone if it is there, else
    the declared splits that are, else all. Within a split: the entries of the declared subsets; if none, those with a
    language that begins with one of the prefixes; if none, all. Scores are main_score; a split without any is left out.
    """
    parsed = documents.select(F.col(entity).alias("entity"), F.col(task).alias("task"), F.from_json(body, f"scores map<string, {ENTRY}>").getField("scores").alias("m"), F.col(splits).alias("declared"), F.col(subsets).alias("subsets"), F.col(prefixes).alias("prefixes")).filter("m is not null")
    have = F.map_keys("m")
    declared = F.array_intersect("declared", have)
    chosen = F.when(F.array_contains(have, "test"), F.array(F.lit("test"))).when(F.size(declared) > 0, declared).otherwise(have)
    each = parsed.select("entity", "task", "subsets", "prefixes", "m", F.explode(chosen).alias("split")).withColumn("all", F.col("m")[F.col("split")])
    named = F.filter("all", lambda e: F.coalesce(F.array_contains("subsets", e["hf_subset"]), F.lit(False)))
    prefixed = F.filter("all", lambda e: F.exists(F.coalesce(e["languages"], F.array().cast("array<string>")), lambda c: F.array_contains("prefixes", F.lower(F.split(c, "-")[0]))))
    picked = F.when(F.size(named) > 0, named).when(F.size(prefixed) > 0, prefixed).otherwise(F.col("all"))
    values = F.filter(F.transform(picked, lambda e: e["main_score"]), lambda v: v.isNotNull() & ~F.isnan(v))
    means = each.select("entity", "task", values.alias("v")).filter(F.size("v") > 0).select("entity", "task", (F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")).alias("mean"))
    return means.groupBy("entity", "task").agg(F.count(F.lit(1)).alias("splits"), F.avg("mean").alias("score"))


def latest_revisions(paths: DataFrame, entity: str, revision: str, excluded: Sequence[str] = ()) -> DataFrame:
    """(entity, revision): the last revision by name, leaving out the excluded ones."""
    return paths.filter(~F.col(revision).isin(*excluded) if excluded else F.lit(True)).groupBy(entity).agg(F.max(revision).alias(revision))


def find_key(body: Column, key: str) -> Column:
    """The first number under `key`, in any case, anywhere in a JSON text, depth first; null if there is none."""

    @F.pandas_udf("double")
    def search(texts: pd.Series) -> pd.Series:
        def walk(node: object) -> float | None:
            if isinstance(node, dict):
                for k, v in node.items():
                    if k.lower() == key.lower() and isinstance(v, (int, float)) and not isinstance(v, bool):
                        return float(v)
                for v in node.values():
                    found = walk(v)
                    if found is not None:
                        return found
            elif isinstance(node, list):
                for v in node:
                    found = walk(v)
                    if found is not None:
                        return found
            return None

        out = []
        for text in texts:
            try:
                out.append(walk(json.loads(text)) if text else None)
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype="float64")

    return search(body)


def read_config(path: str, defaults: dict) -> dict:
    """A YAML or JSON file over defaults; a missing file gives the defaults."""
    if not os.path.exists(path):
        return dict(defaults)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        loaded = yaml.safe_load(text)
    except ImportError:
        loaded = json.loads(text)
    return {**defaults, **(loaded or {})}


def remote_vectors(rows: DataFrame, key: str, text: str, connect: Callable[[], Callable[[list[str]], list]], batch: int = 64, retries: int = 3) -> DataFrame:
    """(key, embedding) from an outside service, asked per task in batches, each tried again with growing pauses.

    connect: a function without arguments that runs once per task and returns a function from texts to vectors. No service
    comes with this package.
    """
    kind = rows.schema[key].dataType.simpleString()

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        encode = connect()
        for b in batches:
            texts, vectors = b.column(1).to_pylist(), []
            for at in range(0, len(texts), batch):
                for attempt in range(retries):
                    try:
                        vectors += encode(texts[at : at + batch])
                        break
                    except OSError:
                        if attempt + 1 == retries:
                            raise
                        time.sleep(2**attempt)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32()))], names=["k", "embedding"])

    return rows.select(F.col(key).alias("k"), text).mapInArrow(ask, f"k {kind}, embedding array<float>").withColumnRenamed("k", key)
