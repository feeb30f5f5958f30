"""Lexical and dense retrieval, fusion of runs, and their evaluation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tausift.runtime import cut, small

#: Queries and vectors in a block.
QUERY_BLOCK, VECTOR_BLOCK = 1_000, 5_000


def bm25(queries: DataFrame, documents: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(qid, doc_id, score, rank): the k best documents of each query by Okapi BM25.

    queries: (qid, tokens); documents: (doc_id, tokens). A query token counts as often as it occurs. A token that more
    than half of the documents have gets epsilon times the mean idf of the vocabulary. Scores are rounded to 6 decimals;
    equal ones go by doc_id. Documents without a query token have score 0 and fill up the places that are left. The
    statistics are over all documents; only postings of query tokens are counted and joined.
    """
    df = documents.select(F.explode(F.array_distinct("tokens")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    sizes = documents.select("doc_id", F.size("tokens").cast("double").alias("dl"))
    corpus = sizes.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))  # one row
    raw = df.join(F.broadcast(corpus)).withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    idf = raw.join(F.broadcast(mean)).select("t", "avgdl", F.when(F.col("raw") < 0, F.col("mean") * epsilon).otherwise(F.col("raw")).alias("idf"))
    asked = queries.select("qid", F.explode("tokens").alias("t")).groupBy("qid", "t").agg(F.count(F.lit(1)).alias("qf"))
    wanted = small(asked.select("t").distinct())
    held = documents.select("doc_id", F.size("tokens").cast("double").alias("dl"), F.explode("tokens").alias("t")).join(wanted, "t", "left_semi")
    postings = held.groupBy("t", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    hits = postings.join(small(asked.join(idf, "t")), "t")
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = cut(hits.groupBy("qid", "doc_id").agg(F.round(F.sum(part), 6).alias("score")))  # read three times below
    # the k first documents of all that a query doesn't hit: the k + (hits) first by id hold them
    scores = scored.filter("score > 0")
    few = scores.groupBy("qid").agg(F.count(F.lit(1)).alias("c")).join(queries.select("qid").distinct(), "qid", "right").filter(F.coalesce("c", F.lit(0)) < k).select("qid")
    first = documents.select("doc_id").distinct().orderBy("doc_id").limit(2 * k)  # fewer than k are hit, so 2 k hold k others
    spare = few.join(F.broadcast(first)).join(scored.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").select("qid", "doc_id", F.lit(0.0).alias("score"))
    others = scored.filter("score <= 0")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return scores.union(others).union(spare).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """(ids, width, data): vectors of one length in blocks of at most `rows`, as matrices of 8-byte floats."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                values, offsets = part.column(1).flatten().to_numpy(zero_copy_only=False), np.diff(part.column(1).offsets.to_numpy())
                starts = np.concatenate(([0], np.cumsum(offsets)))
                for width in np.unique(offsets).tolist():
                    of = np.flatnonzero(offsets == width)
                    data = values[(starts[of][:, None] + np.arange(width)).ravel()].astype("<f8")
                    ids = part.column(0).take(pa.array(of))
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), ids), pa.array([width], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["ids", "width", "data"])

    return df.mapInArrow(pack, f"ids array<{df.schema[0].dataType.simpleString()}>, width int, data binary")


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, same: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank): the k vectors with the largest dot product to each query, exactly.

    queries and vectors: (id, embedding). same=True: a query isn't its own neighbour. Both sides are packed into blocks; a
    join brings every block of queries to every block of vectors, one matrix product each, which keeps k rows per query; these
    are then merged by query. Query blocks that are small in all are broadcast, so that the vectors stay where they are.
    Scores are rounded to 6 decimals; equal ones go by id. Null vectors and vectors of another length are left out.
    """
    rows = vectors.select(F.col("id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("e")).dropna()
    asked = queries.select(F.col("id").alias("qid"), F.col("embedding").cast("array<double>").alias("e")).dropna()
    schema = T.StructType([T.StructField("qid", asked.schema["qid"].dataType), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    parts = max(2, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = _packed(rows, VECTOR_BLOCK).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
    sought = _packed(asked, QUERY_BLOCK).select(F.col("ids").alias("qids"), "width", F.col("data").alias("qdata"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    met = held.join(small(sought), ["part", "width"]).select("ids", "qids", "width", "data", "qdata")

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, names, width, data, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, asked_ids = np.array(ids), np.array(names)
                dots = np.round(np.frombuffer(wanted, "<f8").reshape(-1, width) @ np.frombuffer(data, "<f8").reshape(-1, width).T, 6)
                if same:
                    dots[asked_ids[:, None] == own] = -np.inf
                if len(own) > k:
                    least = -np.partition(-dots, k - 1, axis=1)[:, k - 1]  # all rows that tie with the k-th are kept till the merge
                    row, at = np.nonzero((dots >= least[:, None]) & (dots > -np.inf))
                else:
                    row, at = np.nonzero(dots > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(asked_ids[row].tolist(), batch.schema.field(1).type.value_type), pa.array(own[at].tolist(), batch.schema.field(0).type.value_type), pa.array(dots[row, at])], names=["qid", "doc_id", "score"])

    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return met.mapInArrow(best, schema).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def fuse(runs: DataFrame, k: int = 60) -> DataFrame:
    """(qid, doc_id, score): reciprocal rank fusion, the sum of 1 / (k + rank) over the runs that hold a document.

    runs: (run, qid, doc_id, rank). A query without documents is left out.
    """
    return runs.groupBy("qid", "doc_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))


def evaluate(run: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg, recall, mrr) at k of every query that has relevant documents.

    run: (qid, doc_id, rank); relevant: (qid, doc_id, rel). Linear gain, discount log2(rank + 1), against the best order of
    all relevant documents. A query without retrieved documents has 0, one without relevant documents is left out.
    """
    gain = lambda rel, rank: rel / F.log2(rank + F.lit(1.0))
    positive = relevant.select("qid", "doc_id", "rel").filter("rel > 0")
    best = Window.partitionBy("qid").orderBy(F.col("rel").desc(), "doc_id")
    ideal = positive.withColumn("r", F.row_number().over(best)).groupBy("qid").agg(F.sum(F.when(F.col("r") <= k, gain(F.col("rel"), F.col("r")))).alias("ideal"), F.count(F.lit(1)).alias("n"))
    hits = run.select("qid", "doc_id", "rank").filter(F.col("rank") <= k).join(positive, ["qid", "doc_id"]).groupBy("qid").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"), F.count(F.lit(1)).alias("found"), F.min("rank").alias("first"))
    zero = F.lit(0.0)
    return ideal.join(hits, "qid", "left").select("qid", F.coalesce(F.col("dcg") / F.col("ideal"), zero).alias("ndcg"), F.coalesce(F.col("found") / F.col("n"), zero).alias("recall"), F.coalesce(F.lit(1.0) / F.col("first"), zero).alias("mrr"))


def gram_overlap(texts: DataFrame, group: str, grams: str, reference: DataFrame) -> DataFrame:
    """(group, n_grams, n_shared, overlap_pct): distinct grams per group, and how many the reference has too.

    texts: (group, grams ARRAY); reference: (grams ARRAY). Grams are compared by 64-bit hash, so that only hashes are
    shuffled. 0 percent for a group without grams.
    """
    own = texts.select(group, F.explode(F.transform(grams, lambda g: F.xxhash64(g))).alias("h")).distinct()
    known = reference.select(F.explode(F.transform(grams, lambda g: F.xxhash64(g))).alias("h")).distinct().withColumn("known", F.lit(1))
    counts = own.join(known, "h", "left").groupBy(group).agg(F.count(F.lit(1)).alias("n_grams"), F.count("known").alias("n_shared"))
    return counts.select(group, "n_grams", "n_shared", (F.col("n_shared").cast("double") * 100 / F.col("n_grams")).alias("overlap_pct"))
