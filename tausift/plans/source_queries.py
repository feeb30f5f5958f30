"""Readers and writers in round trips over the test tables, distribution functions, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tausift.functions.exact import KENDALL_EXACT, RANK_SUM_EXACT, kendall_p, rank_sum_p, student_p
from tausift.operators.agreement import pair_counts, tau_b
from tausift.operators.incremental import token_batches
from tausift.operators.retrieval import evaluate
from tausift.plans.base import LOCAL, SCORES, SLICES, local_scores, scores, slices
from tausift.plans.rank_queries import ORACLE as RANK_SQL
from tausift.plans.rank_queries import spearman_by_slice
from tausift.plans.relational_queries import ORACLE as RELATIONAL_SQL
from tausift.plans.relational_queries import mann_whitney
from tausift.plans.score_queries import ORACLE as SCORE_SQL
from tausift.plans.score_queries import ols_gap
from tausift.runtime import shared_dir, table
from tausift.sources.readers import find_key, flatten_results, latest_revisions, read_csv, read_latest_log, read_retrieval_set, read_wide_csv, retrieval_set_of
from tausift.sources.writers import append_log, upsert_parquet, write_retrieval_set, write_sorted_csv
from tausift.streaming.replay import file_stream, latest_per_key, windowed_totals


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The score fact written as sorted CSV and read with its schema."""
    path = _place(spark, "csv")
    write_sorted_csv(scores(spark, d).select("entity", "task", (F.col("s") / F.lit(100000.0)).alias("x")), path, ["entity", "task"], 5)
    return read_csv(spark, path, "entity string, task string, x double").select("entity", "task", F.round(F.col("x") * 100000).cast("long").alias("s"))


def wide_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Local scores written as a wide CSV with one column per task, and read as rows again."""
    path = _place(spark, "wide")
    tasks = ["task_belebele", "task_wikipedia", "task_miracl_hn", "task_mlqa"]
    wide = local_scores(spark, d).groupBy(F.concat_ws("|", "slice", "entity").alias("Model")).pivot("task", tasks).agg(F.max("s"))
    wide.write.option("header", True).csv(path)
    rows = read_wide_csv(spark, path).select(F.split("entity", r"\|", 2).alias("e"), "task", F.col("score").cast("long").alias("s"))
    return rows.select(F.col("e")[0].alias("slice"), F.col("e")[1].alias("entity"), "task", "s")


def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Events appended to a log in two goes, the second over the first, and the last record of every user."""
    path = _place(spark, "log")
    e = table(spark, d, "events").filter("user_id is not null").select("user_id", "event_id", "event_type")
    append_log(e.filter("event_type <> 'purchase'"), path)
    append_log(e.filter("event_type = 'purchase'"), path)
    return read_latest_log(spark, path, "user_id long, event_id long, event_type string", ["user_id"], "event_id")


def retrieval_set_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The valid pairs written as a retrieval set and read again: documents, queries and relevant pairs."""
    path = _place(spark, "retrieval")
    pairs = table(spark, d, "qar_pair").filter("query_id is not null").dropDuplicates(["query_id"])
    documents = table(spark, d, "corpus_document").filter("doc_id is not null and content is not null").dropDuplicates(["doc_id"])
    write_retrieval_set(pairs, documents, path)
    corpus, queries, relevance = read_retrieval_set(spark, path)
    counted = [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n, f in (("corpus", corpus), ("queries", queries), ("relevance", relevance))]
    return counted[0].union(counted[1]).union(counted[2])


def parallel_retrieval_set(spark: SparkSession, d: str) -> DataFrame:
    """A retrieval set of pairs and their documents: the best possible run of each query has all metrics 1."""
    pairs = table(spark, d, "qar_pair").filter("query_id is not null and doc_id is not null").select("query_id", "doc_id", "question")
    _, _, relevance = retrieval_set_of(pairs.withColumn("passage", F.col("doc_id")), "query_id", "passage", "doc_id", "question")
    perfect = relevance.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id")).cast("long"))
    e = evaluate(perfect, relevance)
    return e.agg(F.count(F.lit(1)).alias("queries"), F.min("ndcg").alias("lowest_ndcg"), F.min("mrr").alias("lowest_mrr"))


def versioned_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A keyed table after two upserts that overlap: totals by slice."""
    path = _place(spark, "table")
    rows = local_scores(spark, d)
    upsert_parquet(spark, path, rows.filter("slice <> 'hindi'"), ["entity", "slice", "task"])
    last = upsert_parquet(spark, path, rows.filter("slice <> 'italian'"), ["entity", "slice", "task"])
    return spark.read.parquet(last).groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("total"))


def nested_documents(spark: SparkSession, d: str) -> DataFrame:
    """Nested result documents per entity and task, flattened with split fallback: number and sum by slice."""
    entry = F.struct(F.array("slice").alias("languages"), F.col("task").alias("hf_subset"), (F.col("s") / F.lit(10000.0)).alias("ndcg_at_10"), F.lit(0.0).alias("main_score"))
    grouped = local_scores(spark, d).groupBy("entity", "task").agg(F.collect_list(entry).alias("e"))
    body = grouped.select("entity", "task", F.to_json(F.struct(F.create_map(F.lit("validation"), F.array().cast(grouped.schema["e"].dataType), F.lit("dev"), F.col("e")).alias("scores"))).alias("body"))
    flat = flatten_results(body, "entity", "task", "body")
    return flat.groupBy("split", F.col("language").alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("score") * 10000).cast("long")).alias("total"))


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """The last export of every board by file name."""
    return latest_revisions(table(spark, d, "leaderboard_files").filter("board is not null"), "board", "file_name")


def deep_key(spark: SparkSession, d: str) -> DataFrame:
    """The number `k` found in every event's properties, wherever it stands: sum by type."""
    wrapped = F.concat(F.lit('{"a": [1, {"b": '), F.col("props"), F.lit("}]}"))
    return table(spark, d, "events").filter("props is not null").groupBy("event_type").agg(F.sum(find_key(wrapped, "K")).alias("total"))


def _tied(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(slice, name): the sizes of groups of equal values, those of one left out. Different sizes are few."""
    sizes = rows.groupBy("slice", value).agg(F.count(F.lit(1)).alias("t")).filter("t > 1")
    return sizes.groupBy("slice").agg(F.collect_list("t").alias(name))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def tau_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: Kendall's tau-b and its p-value, with ties in either score."""
    rows = slices(spark, d)
    c = pair_counts(rows, ["slice"], "g", "l").filter("n >= 2").join(_tied(rows, "g", "gx"), "slice", "left").join(_tied(rows, "l", "lx"), "slice", "left")
    p = kendall_p(F.col("concordant"), F.col("discordant"), F.col("n"), F.coalesce("gx", _none()), F.coalesce("lx", _none()))
    return c.select("slice", "n", tau_b().alias("tau_b"), F.round(p, 10).alias("p"))


def ols_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: the p-value of the slope of gap on size, from its correlation."""
    fit = ols_gap(spark, d).filter("n > 2")
    free = F.col("n") - 2
    t = F.sqrt(F.try_divide(F.col("r2") * free, 1 - F.col("r2")))
    return fit.select("slice", "n", "slope", F.round(student_p(t, free.cast("double")), 10).alias("p"))


def rank_sum_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: U of large against small models, and the one-sided p-value that the large ones score higher."""
    rows = slices(spark, d).filter("params is not null")
    m = mann_whitney(spark, d).join(_tied(rows, "l", "ties"), "slice", "left")
    return m.select("slice", "n_big", "n_small", "u", F.round(rank_sum_p(F.col("u"), F.col("n_big"), F.col("n_small"), F.coalesce("ties", _none())), 10).alias("p"))


def spearman_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: Spearman's rho and its p-value by Student's distribution."""
    r = spearman_by_slice(spark, d).filter("n > 2 and abs(rho) < 1")
    free = F.col("n") - 2
    return r.select("slice", "n", "rho", F.round(student_p(F.col("rho") * F.sqrt(free / (1 - F.col("rho") * F.col("rho"))), free.cast("double")), 10).alias("p"))


def greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    """Documents of every source in greedy batches of at most 256 texts and 250,000 characters."""
    batched = token_batches(table(spark, d, "documents").filter("source is not null").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 256, 250_000)
    return batched.groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last event of every user, from a stream of the events' files."""
    stream = file_stream(spark, f"{d}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    return latest_per_key(spark, stream, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type, and their value in cents, from a stream of the events' files."""
    stream = file_stream(spark, f"{d}/events.parquet").withColumns({"ts": F.col("ts").cast("timestamp"), "cents": F.round(F.col("value") * 100).cast("long")})
    return windowed_totals(spark, stream, "ts", "event_type", "cents").withColumn("start", F.date_format("start", "yyyy-MM-dd"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_round_trip, wide_csv_round_trip, log_round_trip, retrieval_set_round_trip, parallel_retrieval_set, versioned_upsert, nested_documents, revisions, deep_key, tau_p_values, ols_p_values, rank_sum_p_values,
        spearman_p_values, greedy_batches, stream_latest, stream_windows,
    )
}

# ---- distribution functions in SQL: power series of the error function, finite sums of Student's distribution ----


def _erfc_sql(x: str) -> str:
    """The complementary error function of a number of 0 or more."""
    return f"CASE WHEN {x} = 0 THEN 1 WHEN {x} > 12 THEN 0 ELSE 1 - list_sum(list_transform(range(0, 500), lambda i: exp((2 * i + 1) * ln({x}) - lgamma(i + 1.5) - {x} * {x}))) END"


def _student_sql(t: str, v: str) -> str:
    """Both tails of Student's distribution with a whole number of degrees of freedom."""
    a = f"atan(abs({t}) / sqrt({v}))"
    odd = f"2 / pi() * ({a} + CASE WHEN {v} > 1 THEN sin({a}) * list_sum(list_transform(range(0, CAST(({v} - 1) / 2 AS BIGINT)), lambda i: exp(0.5 * ln(pi()) + lgamma(i + 1) - ln(2) - lgamma(i + 1.5)) * cos({a}) ** (2 * i + 1))) ELSE 0 END)"
    even = f"sin({a}) * list_sum(list_transform(range(0, CAST({v} / 2 AS BIGINT)), lambda i: exp(lgamma(i + 0.5) - 0.5 * ln(pi()) - lgamma(i + 1)) * cos({a}) ** (2 * i)))"
    return f"CASE WHEN {v} % 2 = 1 THEN 1 - ({odd}) ELSE 1 - ({even}) END"


#: Numbers of permutations of n by their inversions, for n up to KENDALL_EXACT.
_MAHONIAN = f"""mahonian AS (SELECT 1 AS n, [CAST(1 AS DOUBLE)] AS c UNION ALL
    SELECT n + 1, list_transform(range(0, CAST((n + 1) * n / 2 AS BIGINT) + 1), lambda j: list_sum(c[greatest(1, j - n + 1) : least(j + 1, len(c))])) FROM mahonian WHERE n < {KENDALL_EXACT})"""
_TAU_P = f"""WITH RECURSIVE {_MAHONIAN}, {SLICES},
    pairs AS (SELECT a.slice, sign(a.g - b.g) AS x, sign(a.l - b.l) AS y FROM slices a JOIN slices b ON a.slice = b.slice AND a.entity < b.entity),
    c AS (SELECT slice, count(*) FILTER (x * y > 0) AS con, count(*) FILTER (x * y < 0) AS dis, count(*) FILTER (x = 0) AS tx, count(*) FILTER (y = 0) AS ty, count(*) AS np FROM pairs GROUP BY slice),
    n AS (SELECT slice, count(*) AS n FROM slices GROUP BY slice HAVING count(*) >= 2),
    tie(slice, v, x1, x2) AS (SELECT slice, sum(t * (t - 1) * (2 * t + 5)), sum(t * (t - 1)), sum(t * (t - 1) * (t - 2)) FROM (SELECT slice, g, CAST(count(*) AS DOUBLE) AS t FROM slices GROUP BY slice, g) GROUP BY slice),
    tia(slice, v, y1, y2) AS (SELECT slice, sum(t * (t - 1) * (2 * t + 5)), sum(t * (t - 1)), sum(t * (t - 1) * (t - 2)) FROM (SELECT slice, l, CAST(count(*) AS DOUBLE) AS t FROM slices GROUP BY slice, l) GROUP BY slice),
    z AS (SELECT slice, n, con, dis, tx, ty, np, m.c AS counts, least(dis, np - dis) AS low,
          abs(con - dis) / sqrt(nullif((CAST(n AS DOUBLE) * (n - 1) * (2 * n + 5) - tie.v - tia.v) / 18 + x1 * y1 / (2 * n * (n - 1)) + CASE WHEN n > 2 THEN x2 * y2 / (9 * CAST(n AS DOUBLE) * (n - 1) * (n - 2)) ELSE 0 END, 0)) / sqrt(2) AS x
          FROM n JOIN c USING (slice) JOIN tie USING (slice) JOIN tia USING (slice) LEFT JOIN mahonian m USING (n))
    SELECT slice, CAST(n AS BIGINT) AS n, CASE WHEN np > tx AND np > ty THEN (con - dis) / sqrt(CAST(np - tx AS DOUBLE) * CAST(np - ty AS DOUBLE)) END AS tau_b,
        round(CASE WHEN tx = 0 AND ty = 0 AND n <= {KENDALL_EXACT} THEN CASE WHEN 2 * low = np THEN 1 ELSE least(1, 2 * list_sum(counts[1 : low + 1]) / list_sum(counts)) END ELSE {_erfc_sql('x')} END, 10) AS p FROM z"""
_RANK_SUM_P = f"""WITH RECURSIVE m AS ({RELATIONAL_SQL['mann_whitney']}), {SLICES},
    ties AS (SELECT slice, sum(t * t * t - t) AS c FROM (SELECT slice, l, CAST(count(*) AS DOUBLE) AS t FROM slices WHERE params IS NOT NULL GROUP BY slice, l) GROUP BY slice),
    step AS (SELECT slice, n_big AS a, n_small AS b, 0 AS i, [CAST(1 AS DOUBLE)] AS c FROM m JOIN ties t USING (slice) WHERE t.c = 0 AND least(n_big, n_small) <= {RANK_SUM_EXACT} UNION ALL
        SELECT slice, a, b, i + 1, list_transform(range(0, greatest(a, b) * (i + 1) + 1), lambda j: list_sum(list_transform(range(0, j // (i + 1) + 1), lambda k: coalesce(c[j - k * (i + 1) + 1], 0) - CASE WHEN j - k * (i + 1) >= greatest(a, b) + i + 1 THEN coalesce(c[j - k * (i + 1) - (greatest(a, b) + i + 1) + 1], 0) ELSE 0 END)))
        FROM step WHERE i < least(a, b)),
    x AS (SELECT m.*, t.c AS tc, s.c AS counts, CAST(n_big AS DOUBLE) * n_small AS ab, CAST(n_big + n_small AS DOUBLE) AS n FROM m JOIN ties t USING (slice) LEFT JOIN step s ON s.slice = m.slice AND s.i = least(a, b)),
    z AS (SELECT *, (u - ab / 2 - 0.5) / sqrt(nullif(ab / 12 * (n + 1 - tc / (n * (n - 1))), 0)) / sqrt(2) AS z FROM x)
    SELECT slice, n_big, n_small, u, round(CASE WHEN counts IS NOT NULL THEN list_sum(counts[CAST(ceil(u) AS BIGINT) + 1 :]) / list_sum(counts) ELSE CASE WHEN z >= 0 THEN ({_erfc_sql('z')}) / 2 ELSE 1 - ({_erfc_sql('(-z)')}) / 2 END END, 10) AS p FROM z"""

ORACLE = {
    "tau_p_values": _TAU_P,
    "rank_sum_p_values": _RANK_SUM_P,
    "ols_p_values": f"WITH f AS ({SCORE_SQL['ols_gap']}), t AS (SELECT *, sqrt(r2 * (n - 2) / nullif(1 - r2, 0)) AS t FROM f WHERE n > 2) SELECT slice, n, slope, round({_student_sql('t', '(n - 2)')}, 10) AS p FROM t",
    "spearman_p_values": f"WITH r AS ({RANK_SQL['spearman_by_slice']}), t AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM r WHERE n > 2 AND abs(rho) < 1) SELECT slice, n, rho, round({_student_sql('t', '(n - 2)')}, 10) AS p FROM t",
    "greedy_batches": """WITH RECURSIVE d AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL),
        f AS (SELECT source, k, n_chars AS total, 1 AS items, CAST(0 AS BIGINT) AS batch, n_chars FROM d WHERE k = 1 UNION ALL
            SELECT d.source, d.k, CASE WHEN items >= 256 OR total + d.n_chars > 250000 THEN d.n_chars ELSE total + d.n_chars END, CASE WHEN items >= 256 OR total + d.n_chars > 250000 THEN 1 ELSE items + 1 END,
                CASE WHEN items >= 256 OR total + d.n_chars > 250000 THEN batch + 1 ELSE batch END, d.n_chars FROM f JOIN d ON d.source = f.source AND d.k = f.k + 1)
        SELECT source, batch, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM f GROUP BY source, batch""",
    "csv_round_trip": f"WITH {SCORES} SELECT * FROM scores",
    "wide_csv_round_trip": f"WITH {LOCAL} SELECT slice, entity, task, s FROM local_scores",
    "log_round_trip": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE user_id IS NOT NULL) WHERE r = 1",
    "retrieval_set_round_trip": """SELECT 'corpus' AS part, CAST(count(DISTINCT doc_id) AS BIGINT) AS n FROM corpus_document WHERE doc_id IS NOT NULL AND content IS NOT NULL UNION ALL SELECT 'queries', count(DISTINCT query_id) FROM qar_pair WHERE valid
        UNION ALL SELECT 'relevance', count(DISTINCT query_id) FROM qar_pair WHERE valid AND query_type <> 'unanswerable' AND doc_id IS NOT NULL""",
    "parallel_retrieval_set": "SELECT CAST(count(DISTINCT question) AS BIGINT) AS queries, CAST(1 AS DOUBLE) AS lowest_ndcg, CAST(1 AS DOUBLE) AS lowest_mrr FROM qar_pair WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND question IS NOT NULL",
    "versioned_upsert": f"WITH {LOCAL} SELECT slice, CAST(count(*) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS total FROM local_scores GROUP BY slice",
    "nested_documents": f"WITH {LOCAL} SELECT 'dev' AS split, slice, CAST(count(*) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS total FROM local_scores GROUP BY slice",
    "revisions": "SELECT board, max(file_name) AS file_name FROM leaderboard_files WHERE board IS NOT NULL GROUP BY board",
    "deep_key": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS DOUBLE) AS total FROM events WHERE props IS NOT NULL GROUP BY event_type",
    "stream_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) WHERE r = 1",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL",
}
