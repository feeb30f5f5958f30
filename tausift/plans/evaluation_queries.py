"""Result documents by several policies, retrieval runs side by side, rosters and clusters, judged lists, planned stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tausift.functions.text import word_tokens
from tausift.operators.order import at_positions, ordinal, running, tie_ranks
from tausift.operators.resample import DRAW_SQL, bootstrap_rows, drawn_with_replacement, fits_arrays, replicates
from tausift.operators.retrieval import bm25, dense_top_k, evaluate, fuse
from tausift.operators.scores import covered_items, ratio, to_unit_scale
from tausift.plans.base import BOARDS, LOCAL, SLICES, boards, local_scores, slices
from tausift.plans.relational_queries import REPS
from tausift.plans.text_queries import _METRICS, _WORDS, _label_relevance, retrieval_metrics
from tausift.runtime import table
from tausift.sources.readers import result_scores, score_at, task_scores

#: The languages of the slices as codes.
_CODES = {"italian": "ita-Latn", "japanese": "jpn-Jpan", "hindi": "hin-Deva", "english": "eng-Latn"}


def _code(column: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for p in _CODES.items() for x in p))[F.col(column)], F.col(column))


_CODE_SQL = "CASE slice " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _CODES.items()) + " ELSE slice END"


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """(entity, task, body): nested result documents of the local scores, in four layouts: a test list, dev and validation
    lists, an object keyed by language, and a list at the top level."""
    rows = local_scores(spark, d).withColumn("code", _code("slice"))
    entry = F.struct(F.array("code").alias("languages"), F.when(F.col("task") == "task_mlqa", F.concat(F.lit("x-"), "slice")).otherwise(F.col("slice")).alias("hf_subset"), (F.col("s") / 10000.0).alias("ndcg_at_10"), (F.col("s") / 10000.0).alias("main_score"))
    grouped = rows.groupBy("entity", "task").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.map_from_entries(F.collect_list(F.struct("code", F.struct((F.col("s") / 10000.0).alias("ndcg_at_10"))))).alias("m"))
    layouts = (
        F.when(F.col("task") == "task_belebele", F.to_json(F.struct(F.create_map(F.lit("test"), F.col("e")).alias("scores"))))
        .when(F.col("task") == "task_mlqa", F.to_json(F.struct(F.create_map(F.lit("dev"), F.col("e"), F.lit("validation"), F.slice("e", 1, 1)).alias("scores"))))
        .when(F.col("task") == "task_wikipedia", F.to_json(F.struct(F.create_map(F.lit("test"), F.col("m")).alias("scores"))))
        .otherwise(F.to_json(F.struct(F.create_map().cast("map<string,string>").alias("scores"), F.col("e").alias("test"))))
    )
    return grouped.select("entity", "task", layouts.alias("body"))


def result_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Scores by task and language from documents of all layouts: number and sum in ten-thousandths."""
    by_language, _ = result_scores(_bodies(spark, d), "entity", "task", "body")
    return by_language.groupBy("task", "language").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("score") * 10000).cast("long")).alias("total"))


def result_means(spark: SparkSession, d: str) -> DataFrame:
    """Per entity and task: entries over all splits that are lists, and their mean."""
    _, means = result_scores(_bodies(spark, d), "entity", "task", "body")
    return means.select("entity", "task", "n", F.round("score", 6).alias("score"))


def point_scores(spark: SparkSession, d: str) -> DataFrame:
    """The Italian score of every entity and task, read straight from its document."""
    found = _bodies(spark, d).select("entity", "task", score_at(F.col("body"), ["ita-Latn", "ita"]).alias("score"))
    return found.dropna(subset=["score"]).select("entity", "task", F.round(F.col("score") * 10000).cast("long").alias("s"))


def subset_policy(spark: SparkSession, d: str) -> DataFrame:
    """Per entity and task: the mean of split means, over the declared subsets, else languages by prefix, else all."""
    lists = _bodies(spark, d).filter(F.col("task").isin("task_belebele", "task_mlqa"))
    declared = lists.withColumns({"splits": F.array(F.lit("dev"), F.lit("validation")), "subsets": F.array(F.lit("italian"), F.lit("hindi")), "prefixes": F.array(F.lit("jpn"), F.lit("hin"))})
    return task_scores(declared, "entity", "task", "body", "splits", "subsets", "prefixes").select("entity", "task", "splits", F.round("score", 6).alias("score"))


def unit_scale(spark: SparkSession, d: str) -> DataFrame:
    """Scores of three sources on one scale from 0 to 1: number and mean by source."""
    facts = table(spark, d, "per_task_ndcg").select(F.lit("fact").alias("source"), F.col("ndcg_at_10").alias("x"))
    averages = table(spark, d, "lang_avg_per_model").select(F.lit("slices").alias("source"), F.col("lang_avg_ndcg").alias("x"))
    boards = table(spark, d, "leaderboard").select(F.lit("boards").alias("source"), F.col("mean_task").alias("x"))
    rows = to_unit_scale(facts.union(averages).union(boards).filter("x is not null and not isnan(x)"), "x", ["source"])
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean"))


def judged_lists(spark: SparkSession, d: str) -> DataFrame:
    """Per query type: key points that lists of judged indices cover, once each and in range, over all of them."""
    pairs = table(spark, d, "qar_pair").filter("query_id is not null and size(keypoints) > 0").groupBy("query_id").agg(F.max(F.struct("query_type", "answer", "keypoints")).alias("r"))
    indices = F.transform(F.regexp_extract_all("r.answer", F.lit(r"([0-9]{1,9})"), F.lit(1)), lambda x: x.cast("long"))
    covered, rate = covered_items(indices, F.size("r.keypoints"))
    judged = pairs.select(F.col("r.query_type").alias("query_type"), covered.alias("covered"), F.size("r.keypoints").alias("total"), rate.alias("rate"))
    return judged.groupBy("query_type").agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"), F.round(F.avg("rate"), 6).alias("mean_rate"))


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    """(entity, tier, g, rank_all, rank_tier): global ranks among all entities and within the tier, the best first."""
    entities = slices(spark, d).groupBy("entity").agg(F.max("tier").alias("tier"), F.max("g").alias("g"))
    everyone = tie_ranks(entities.withColumn("all", F.lit(0)), ["all"], "g", "rank_all", "a").drop("all", "a")
    return tie_ranks(everyone, ["tier"], "g", "rank_tier", "b").drop("b")


def roster_membership(spark: SparkSession, d: str) -> DataFrame:
    """Every entity of every slice with its tier, its global ranks in both rosters, and its local rank in the slice."""
    local = tie_ranks(slices(spark, d).select("entity", "slice", "l"), ["slice"], "l", "local_rank", "x").drop("x")
    return local.join(_ranks(spark, d), "entity").select("entity", "slice", "tier", "rank_all", "rank_tier", "local_rank")


def cluster_table(spark: SparkSession, d: str) -> DataFrame:
    """Per entity: best global rank of both rosters, median local rank, slices in which it is in the last quarter, and those
    in which it has rank 19 or worse."""
    local = roster_membership(spark, d)
    sized = local.join(local.groupBy("slice").agg(F.count(F.lit(1)).alias("n")), "slice")
    return sized.groupBy("entity").agg(
        F.min(F.least("rank_all", "rank_tier")).alias("best_global"), F.median("local_rank").alias("median_local"), F.count_if(F.col("local_rank") > 0.75 * F.col("n")).alias("n_affected"), F.count_if(F.col("local_rank") >= 19).alias("n_behind"),
    )


#: Documents (from, to) by position, and generated items, of each kind of question.
STAGES = {"factual": (0, 175), "multi_hop": (0, 175), "summarization": (150, 250)}
UNANSWERABLE = 50


def stage_plan(spark: SparkSession, d: str) -> DataFrame:
    """The questions to write for each language and domain, by position of the document: (query_id, doc_id, kind)."""
    documents = table(spark, d, "corpus_document").filter("doc_id is not null and language is not null and domain is not null").groupBy("doc_id").agg(F.max("language").alias("language"), F.max("domain").alias("domain"))
    placed = ordinal(documents, ["language", "domain"], [F.col("doc_id").asc()], "k").withColumn("k", F.col("k") - 1)
    stages = F.array(*(F.when((F.col("k") >= a) & (F.col("k") < b), F.struct(F.lit(kind).alias("kind"), (F.col("k") - a).alias("i"))) for kind, (a, b) in STAGES.items()))
    with_document = placed.select("language", "domain", "doc_id", F.explode(F.array_compact(stages)).alias("s")).select("language", "domain", "doc_id", "s.kind", "s.i")
    without = documents.select("language", "domain").distinct().select("language", "domain", F.lit(None).cast("string").alias("doc_id"), F.lit("unans").alias("kind"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(UNANSWERABLE - 1).cast("long"))).alias("i"))
    return with_document.unionByName(without).select(F.format_string("%s_%s_%s_%04d", "language", "domain", "kind", "i").alias("query_id"), "doc_id", "kind")


DIMENSIONS = 64


def _char_vectors(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, embedding): counts of characters by code point modulo DIMENSIONS, to length 1."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) % DIMENSIONS)
    counted = df.select(F.col(id_).alias("id"), codes.alias("c"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.size(F.filter("c", lambda x: x == i)).cast("double"))
    sized = counted.select("id", counts.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return sized.withColumn("n", norm).filter("n > 0").select("id", F.transform("v", lambda x: x / F.col("n")).alias("embedding"))


def hybrid_comparison(spark: SparkSession, d: str) -> DataFrame:
    """BM25, dense vectors and their fusion side by side: queries, and mean NDCG, recall and reciprocal rank at ten.

    Queries: the questions whose number is divisible by 100; relevant: the document of the question.
    """
    pairs = table(spark, d, "qar_pair").filter("query_id is not null and doc_id is not null and question is not null and try_cast(regexp_extract(query_id, '([0-9]+)$', 1) as bigint) % 100 = 0").groupBy(F.col("query_id").alias("qid")).agg(F.max("question").alias("question"), F.max("doc_id").alias("doc_id"))
    documents = table(spark, d, "corpus_document").filter("doc_id is not null and content is not null").groupBy("doc_id").agg(F.max("content").alias("content"))
    lexical = bm25(pairs.select("qid", word_tokens("question", lower=True).alias("tokens")), documents.select("doc_id", word_tokens("content", lower=True).alias("tokens")), 10)
    dense = dense_top_k(_char_vectors(pairs, "qid", "question"), _char_vectors(documents, "doc_id", "content"), 10)
    runs = lexical.select(F.lit("bm25").alias("run"), "qid", "doc_id", "rank").unionByName(dense.select(F.lit("dense").alias("run"), "qid", "doc_id", "rank"))
    fused = fuse(runs).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "doc_id")).cast("long"))
    relevant = pairs.select("qid", "doc_id", F.lit(1).alias("rel"))
    out = None
    for name, run in (("bm25", lexical), ("dense", dense), ("fused", fused)):
        means = evaluate(run, relevant).agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "recall", "mrr"))).select(F.lit(name).alias("run"), "queries", "ndcg", "recall", "mrr")
        out = means if out is None else out.union(means)
    return out


def paired_metric_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Two dense runs, over whole vectors and over their first half, per query: mean difference of NDCG at ten, its 95 percent
    interval over bootstrap replicates of the queries, and the two-sided p."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    half = v.select("id", F.slice("embedding", 1, (F.size("embedding") / 2).cast("int")).alias("embedding"))
    relevant = _label_relevance(spark, d)
    runs = [evaluate(dense_top_k(x.filter("id % 100 = 0"), x, 10, same=True), relevant).select("qid", F.round(F.col("ndcg") * 1_000_000).cast("long").alias(n)) for n, x in (("a", v), ("b", half))]
    deltas = runs[0].join(runs[1], "qid").select(F.lit("all").alias("set"), "qid", (F.col("a") - F.col("b")).alias("delta"))
    if fits_arrays(deltas, ["set"]):
        means = replicates(deltas, ["set"], "qid", ["delta"], REPS, lambda rep, c: (float(c["delta"][drawn_with_replacement(rep, len(c["delta"]), 42)].sum()) / len(c["delta"]),), "m double")
    else:
        means = bootstrap_rows(deltas, ["set"], "qid", ["delta"], REPS).groupBy("set", "rep").agg(ratio(F.sum("delta"), F.count("delta")).alias("m"))
    q = at_positions(means, ["set"], "m", {"low": (F.col("n") - 1) * F.lit(0.025), "high": (F.col("n") - 1) * F.lit(0.975)})
    tails = means.groupBy("set").agg(ratio(F.count_if(F.col("m") <= 0), F.count(F.lit(1))).alias("under"), ratio(F.count_if(F.col("m") >= 0), F.count(F.lit(1))).alias("over"))
    observed = deltas.groupBy("set").agg(F.count(F.lit(1)).alias("queries"), F.round(ratio(F.sum("delta"), F.count("delta")), 4).alias("mean_delta"))
    return observed.join(q, "set").join(tails, "set").select("queries", "mean_delta", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), F.least(F.lit(1.0), 2 * F.least("under", "over")).alias("p"))


def retrieval_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of dense retrieval over all queries and by label of the query, in one table."""
    of = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("label").cast("string").alias("type"))
    rows = retrieval_metrics(spark, d).join(of, "qid")
    both = rows.select(F.explode(F.array(F.lit("overall"), F.col("type"))).alias("type"), "ndcg", "recall", "mrr")
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(c), 5).alias(c) for c in ("ndcg", "recall", "mrr")))


#: Columns by which a view could be filtered, and the tables that may have them.
FILTERS, VIEWS = ("tier", "english_only", "dim", "license", "language", "board"), ("unified_results", "leaderboard", "lang_avg_per_model", "per_task_ndcg")


def filter_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Which of the tables have which of the columns that a view could be filtered by."""
    rows = [(v, f, f in table(spark, d, v).columns) for v in VIEWS for f in FILTERS]
    return spark.createDataFrame(rows, "view string, field string, present boolean")


def data_availability(spark: SparkSession, d: str) -> DataFrame:
    """Per slice and task: entities of the slice, those with a score, and whether the data are complete, partial or missing."""
    keys = boards(spark, d).select("entity", "slice")
    tasks = local_scores(spark, d).select("task").distinct()
    sizes = keys.groupBy("slice").agg(F.count(F.lit(1)).alias("entities"))
    held = local_scores(spark, d).groupBy("slice", "task").agg(F.count(F.lit(1)).alias("scored"))
    grid = sizes.withColumn("task", F.explode(F.array(*(F.lit(r.task) for r in tasks.orderBy("task").collect())))).join(held, ["slice", "task"], "left").withColumn("scored", F.coalesce("scored", F.lit(0)))
    return grid.select("slice", "task", "entities", "scored", F.when(F.col("scored") == 0, "missing").when(F.col("scored") < F.col("entities"), "partial").otherwise("complete").alias("status"))


def deployment_record(spark: SparkSession, d: str) -> DataFrame:
    """Per type of event one record: mean and population deviation of the value in cents, interpolated p50 and p99, users, and
    events a user."""
    e = table(spark, d, "events").filter("value is not null and not isnan(value)").select("event_type", "user_id", F.round(F.col("value") * 100).cast("long").alias("c"))
    spread = e.groupBy("event_type").agg(F.round(F.avg("c"), 4).alias("mean"), F.round(F.stddev_pop("c"), 4).alias("std"), F.count_distinct("user_id").alias("users"))
    q = at_positions(e, ["event_type"], "c", {"p50": (F.col("n") - 1) * F.lit(0.5), "p99": (F.col("n") - 1) * F.lit(0.99)})
    return spread.join(q, "event_type").select("event_type", "n", "mean", "std", F.round("p50", 4).alias("p50"), F.round("p99", 4).alias("p99"), "users", F.round(F.try_divide(F.col("n").cast("double"), F.col("users").cast("double")), 6).alias("events_a_user"))


def lowest_from_here(spark: SparkSession, d: str) -> DataFrame:
    """Per slice and entity, in order of the global score: the lowest local score from this entity on."""
    return running(slices(spark, d).select("slice", "entity", "g", "l"), ["slice"], [F.col("g").desc(), F.col("entity").desc()], "l", "min", "lowest").select("slice", "entity", "lowest")


def distinct_references(spark: SparkSession, d: str) -> DataFrame:
    """Per query type: references, and references without repeats within a pair."""
    pairs = table(spark, d, "qar_pair").filter("query_id is not null and refs is not null").groupBy("query_id").agg(F.max(F.struct("query_type", "refs")).alias("r"))
    return pairs.groupBy(F.col("r.query_type").alias("query_type")).agg(F.sum(F.size("r.refs")).alias("refs"), F.sum(F.size(F.array_distinct("r.refs"))).alias("distinct_refs"))


#: Prices per million characters read and written.
PRICES = (0.15, 0.6)


def writing_costs(spark: SparkSession, d: str) -> DataFrame:
    """Per query type: characters read and written, and what they cost at fixed prices per million."""
    pairs = table(spark, d, "qar_pair").filter("query_id is not null").groupBy("query_id").agg(F.max(F.struct("query_type", F.length("question").alias("a"), F.length("generated_answer").alias("b"))).alias("r"))
    sums = pairs.groupBy(F.col("r.query_type").alias("query_type")).agg(F.coalesce(F.sum("r.a"), F.lit(0)).alias("read"), F.coalesce(F.sum("r.b"), F.lit(0)).alias("written"))
    return sums.select("query_type", "read", "written", F.round((F.col("read") * F.lit(PRICES[0]) + F.col("written") * F.lit(PRICES[1])) / F.lit(1e6), 9).alias("cost"))


QUERIES = {f.__name__: f for f in (paired_metric_bootstrap, retrieval_by_type, filter_exposure, data_availability, deployment_record, lowest_from_here, distinct_references, writing_costs, result_layouts, result_means, point_scores, subset_policy, unit_scale, judged_lists, roster_membership, cluster_table, stage_plan, hybrid_comparison)}

_ROSTER = f"""{SLICES}, e AS (SELECT entity, max(tier) AS tier, max(g) AS g FROM slices GROUP BY entity), k AS (SELECT entity, tier, rank() OVER (ORDER BY g DESC) AS rank_all, rank() OVER (PARTITION BY tier ORDER BY g DESC) AS rank_tier FROM e),
    m AS (SELECT entity, slice, k.tier, rank_all, rank_tier, rank() OVER (PARTITION BY slice ORDER BY l DESC) AS local_rank FROM slices s JOIN k USING (entity))"""
_MEANS = """SELECT '{run}' AS run, count(*) AS queries, round(avg(coalesce(1 / log2(rank + 1), 0)), 6) AS ndcg, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END), 6) AS recall, round(avg(coalesce(CAST(1 AS DOUBLE) / rank, 0)), 6) AS mrr
    FROM p LEFT JOIN (SELECT qid, doc_id, rank FROM {table} WHERE rank <= 10) USING (qid, doc_id)"""


def _vector_sql(name: str, source: str, id_: str, text: str) -> str:
    return f"""{name}_c AS (SELECT {id_} AS id, list_transform(string_split({text}, ''), lambda c: unicode(c) % {DIMENSIONS}) AS c FROM {source}),
    {name}_v AS (SELECT id, list_transform(range(0, {DIMENSIONS}), lambda i: CAST(len(list_filter(c, lambda x: x = i)) AS DOUBLE)) AS v FROM {name}_c),
    {name} AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM {name}_v WHERE list_sum(v) > 0)"""


def _ndcg_sql(name: str, width: str) -> str:
    return f"""{name}_d AS (SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_dot_product(CAST(a.embedding{width} AS DOUBLE[]), CAST(b.embedding{width} AS DOUBLE[])), 6) AS score
        FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10),
    {name} AS (SELECT qid, CAST(round(coalesce(dcg / ideal, 0) * 1000000) AS BIGINT) AS v FROM ideal LEFT JOIN (SELECT qid, sum(1 / log2(rank + 1)) AS dcg FROM {name}_d JOIN rel USING (qid, doc_id) GROUP BY qid) USING (qid))"""


ORACLE = {
    "paired_metric_bootstrap": f"""WITH {_METRICS}, {_ndcg_sql('a', '')}, {_ndcg_sql('b', '[1 : len(a.embedding) // 2]')},
        x AS (SELECT a.qid, a.v - b.v AS delta FROM a JOIN b USING (qid)), placed AS (SELECT delta, row_number() OVER (ORDER BY qid) AS k, count(*) OVER () AS n FROM x), reps AS (SELECT unnest(generate_series(1, {REPS})) AS rep),
        m AS (SELECT rep, CAST(sum(b.delta) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS m FROM placed a CROSS JOIN reps JOIN placed b ON b.k - 1 = {DRAW_SQL.format(rep='rep', k='(a.k - 1)', seed=42)} % a.n GROUP BY rep)
        SELECT (SELECT count(*) FROM x) AS queries, (SELECT round(CAST(sum(delta) AS DOUBLE) / count(*), 4) FROM x) AS mean_delta, round(quantile_cont(m, CAST(0.025 AS DOUBLE)), 4) AS low, round(quantile_cont(m, CAST(0.975 AS DOUBLE)), 4) AS high,
            least(CAST(1 AS DOUBLE), 2 * least(CAST(count(*) FILTER (m <= 0) AS DOUBLE) / count(*), CAST(count(*) FILTER (m >= 0) AS DOUBLE) / count(*))) AS p FROM m""".replace("b.embedding[1 : len(a.embedding) // 2]", "b.embedding[1 : len(b.embedding) // 2]"),
    "retrieval_by_type": f"""WITH {_METRICS}, x AS (SELECT CAST(label AS VARCHAR) AS type, ndcg, recall, mrr FROM metrics JOIN embeddings ON qid = vec_id), y AS (FROM x UNION ALL SELECT 'overall', ndcg, recall, mrr FROM x)
        SELECT type, CAST(count(*) AS BIGINT) AS queries, round(avg(ndcg), 5) AS ndcg, round(avg(recall), 5) AS recall, round(avg(mrr), 5) AS mrr FROM y GROUP BY type""",
    "filter_exposure": f"""WITH v(view) AS (VALUES {', '.join(f"('{v}')" for v in VIEWS)}), f(field) AS (VALUES {', '.join(f"('{f}')" for f in FILTERS)})
        SELECT view, field, EXISTS (SELECT 1 FROM information_schema.columns c WHERE c.table_name = view AND c.column_name = field) AS present FROM v, f""",
    "data_availability": f"""WITH {BOARDS}, {LOCAL}, k AS (SELECT slice, count(*) AS entities FROM boards GROUP BY slice), h AS (SELECT slice, task, count(*) AS c FROM local_scores GROUP BY ALL), x AS (SELECT slice, task, entities, coalesce(c, 0) AS scored FROM k CROSS JOIN (SELECT DISTINCT task FROM local_scores) LEFT JOIN h USING (slice, task))
        SELECT slice, task, CAST(entities AS BIGINT) AS entities, CAST(scored AS BIGINT) AS scored, CASE WHEN scored = 0 THEN 'missing' WHEN scored < entities THEN 'partial' ELSE 'complete' END AS status FROM x""",
    "deployment_record": """WITH e AS (SELECT event_type, user_id, CAST(round(value * 100) AS BIGINT) AS c FROM events WHERE value IS NOT NULL AND NOT isnan(value))
        SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(c), 4) AS mean, round(stddev_pop(c), 4) AS std, round(quantile_cont(CAST(c AS DOUBLE), CAST(0.5 AS DOUBLE)), 4) AS p50, round(quantile_cont(CAST(c AS DOUBLE), CAST(0.99 AS DOUBLE)), 4) AS p99, CAST(count(DISTINCT user_id) AS BIGINT) AS users, round(CAST(count(*) AS DOUBLE) / nullif(count(DISTINCT user_id), 0), 6) AS events_a_user FROM e GROUP BY event_type""",
    "lowest_from_here": f"WITH {SLICES} SELECT slice, entity, min(l) OVER (PARTITION BY slice ORDER BY g, entity ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lowest FROM slices",
    "distinct_references": """WITH p AS (SELECT query_id, max(query_type) AS query_type, max(refs) AS refs FROM qar_pair WHERE query_id IS NOT NULL AND refs IS NOT NULL GROUP BY query_id)
        SELECT query_type, CAST(sum(len(refs)) AS BIGINT) AS refs, CAST(sum(len(list_distinct(refs)) + CASE WHEN len(list_filter(refs, lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS distinct_refs FROM p GROUP BY query_type""",
    "writing_costs": f"""WITH p AS (SELECT query_id, max(query_type) AS query_type, any_value(length(question)) AS a, any_value(length(generated_answer)) AS b FROM qar_pair WHERE query_id IS NOT NULL GROUP BY query_id),
        s AS (SELECT query_type, CAST(coalesce(sum(a), 0) AS BIGINT) AS read, CAST(coalesce(sum(b), 0) AS BIGINT) AS written FROM p GROUP BY query_type) SELECT query_type, read, written, round((read * CAST({PRICES[0]} AS DOUBLE) + written * CAST({PRICES[1]} AS DOUBLE)) / CAST(1000000 AS DOUBLE), 9) AS cost FROM s""",
    "result_layouts": f"WITH {LOCAL} SELECT task, {_CODE_SQL} AS language, CAST(count(*) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS total FROM local_scores GROUP BY ALL",
    "result_means": f"""WITH {LOCAL}, x AS (SELECT *, row_number() OVER (PARTITION BY entity, task ORDER BY {_CODE_SQL}) AS k FROM local_scores)
        SELECT entity, task, CAST(count(*) + count(*) FILTER (task = 'task_mlqa' AND k = 1) AS BIGINT) AS n, round((sum(s) + coalesce(sum(s) FILTER (task = 'task_mlqa' AND k = 1), 0)) / CAST(10000 AS DOUBLE) / (count(*) + count(*) FILTER (task = 'task_mlqa' AND k = 1)), 6) AS score
        FROM x WHERE task IN ('task_belebele', 'task_mlqa') GROUP BY entity, task""",
    "point_scores": f"WITH {LOCAL} SELECT entity, task, s FROM local_scores WHERE slice = 'italian' AND task <> 'task_mlqa'",
    "subset_policy": f"""WITH {LOCAL}, x AS (SELECT entity, task, slice, s / CAST(10000 AS DOUBLE) AS s, {_CODE_SQL} AS code FROM local_scores), y AS (SELECT *, row_number() OVER (PARTITION BY entity, task ORDER BY code) AS k FROM x),
        e AS (SELECT entity, task, 'test' AS split, slice AS subset, code, s FROM y WHERE task = 'task_belebele' UNION ALL SELECT entity, task, 'dev', concat('x-', slice), code, s FROM y WHERE task = 'task_mlqa' UNION ALL SELECT entity, task, 'validation', concat('x-', slice), code, s FROM y WHERE task = 'task_mlqa' AND k = 1),
        t AS (SELECT *, CASE WHEN subset IN ('italian', 'hindi') THEN 1 WHEN split_part(code, '-', 1) IN ('jpn', 'hin') THEN 2 ELSE 3 END AS level FROM e), b AS (SELECT entity, task, split, min(level) AS best FROM t GROUP BY ALL),
        m AS (SELECT entity, task, split, avg(s) AS m FROM t JOIN b USING (entity, task, split) WHERE CASE best WHEN 1 THEN level = 1 WHEN 2 THEN split_part(code, '-', 1) IN ('jpn', 'hin') ELSE true END GROUP BY ALL)
        SELECT entity, task, CAST(count(*) AS BIGINT) AS splits, round(avg(m), 6) AS score FROM m GROUP BY entity, task""",
    "unit_scale": """WITH x AS (SELECT 'fact' AS source, ndcg_at_10 AS x FROM per_task_ndcg UNION ALL SELECT 'slices', lang_avg_ndcg FROM lang_avg_per_model UNION ALL SELECT 'boards', mean_task FROM leaderboard)
        SELECT source, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN top > 1.5 THEN x / 100 ELSE x END), 6) AS mean FROM (SELECT *, max(x) OVER (PARTITION BY source) AS top FROM x WHERE x IS NOT NULL AND NOT isnan(x)) GROUP BY source""",
    "judged_lists": """WITH p AS (SELECT query_id, max(query_type) AS query_type, any_value(answer) AS answer, any_value(keypoints) AS k FROM qar_pair WHERE query_id IS NOT NULL AND len(keypoints) > 0 GROUP BY query_id),
        c AS (SELECT query_type, len(k) AS total, len(list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(answer, ''), '[0-9]{1,9}'), lambda x: CAST(x AS BIGINT))), lambda i: i >= 0 AND i < len(k))) AS covered FROM p)
        SELECT query_type, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(total) AS BIGINT) AS total, round(avg(CAST(covered AS DOUBLE) / total), 6) AS mean_rate FROM c GROUP BY query_type""",
    "roster_membership": f"WITH {_ROSTER} SELECT * FROM m",
    "cluster_table": f"""WITH {_ROSTER}, z AS (SELECT *, count(*) OVER (PARTITION BY slice) AS n FROM m) SELECT entity, CAST(min(least(rank_all, rank_tier)) AS BIGINT) AS best_global, CAST(median(local_rank) AS DOUBLE) AS median_local,
        CAST(count(*) FILTER (local_rank > CAST(0.75 AS DOUBLE) * n) AS BIGINT) AS n_affected, CAST(count(*) FILTER (local_rank >= 19) AS BIGINT) AS n_behind FROM z GROUP BY entity""",
    "stage_plan": f"""WITH docs AS (SELECT doc_id, max(language) AS language, max(domain) AS domain FROM corpus_document WHERE doc_id IS NOT NULL AND language IS NOT NULL AND domain IS NOT NULL GROUP BY doc_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY language, domain ORDER BY doc_id) - 1 AS k FROM docs), s(kind, a, b) AS (VALUES {', '.join(f"('{n}', {a}, {b})" for n, (a, b) in STAGES.items())})
        SELECT format('{{}}_{{}}_{{}}_{{:04d}}', language, domain, kind, k - a) AS query_id, doc_id, kind FROM k JOIN s ON k >= a AND k < b
        UNION ALL SELECT format('{{}}_{{}}_unans_{{:04d}}', language, domain, i), NULL, 'unans' FROM (SELECT DISTINCT language, domain FROM docs), range(0, {UNANSWERABLE}) r(i)""",
    "hybrid_comparison": rf"""WITH p AS (SELECT query_id AS qid, max(question) AS question, max(doc_id) AS doc_id FROM qar_pair WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND question IS NOT NULL AND TRY_CAST(regexp_extract(query_id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0 GROUP BY query_id),
        x AS (SELECT doc_id, max(content) AS content FROM corpus_document WHERE doc_id IS NOT NULL AND content IS NOT NULL GROUP BY doc_id),
        docs AS (SELECT doc_id, {_WORDS.format('lower(content)')} AS w FROM x), q AS (SELECT qid, {_WORDS.format('lower(question)')} AS w FROM p),
        post AS (SELECT t, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM docs) GROUP BY ALL), corpus AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(w) AS DOUBLE)) AS avgdl FROM docs),
        raw AS (SELECT t, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM post, corpus GROUP BY t, n), idf AS (SELECT t, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
        asked AS (SELECT qid, t, count(*) AS qf FROM (SELECT qid, unnest(w) AS t FROM q) GROUP BY ALL),
        scored AS (SELECT qid, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len(w) / avgdl))), 6) AS score FROM asked JOIN idf USING (t) JOIN post USING (t) JOIN docs USING (doc_id), corpus GROUP BY qid, doc_id),
        filled AS (SELECT qid, doc_id, coalesce(score, 0) AS score FROM (SELECT qid FROM q) a CROSS JOIN (SELECT doc_id FROM docs) b LEFT JOIN scored USING (qid, doc_id)),
        bm AS (SELECT qid, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM filled) WHERE rank <= 10),
        {_vector_sql('qv', 'p', 'qid', 'question')}, {_vector_sql('dv', 'x', 'doc_id', 'content')},
        de AS (SELECT qid, doc_id, rank FROM (SELECT qv.id AS qid, dv.id AS doc_id, row_number() OVER (PARTITION BY qv.id ORDER BY round(list_dot_product(qv.v, dv.v), 6) DESC, dv.id) AS rank FROM qv, dv) WHERE rank <= 10),
        fu AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc_id) AS rank FROM (SELECT qid, doc_id, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS score FROM (FROM bm UNION ALL FROM de) GROUP BY qid, doc_id))
        {_MEANS.format(run='bm25', table='bm')} UNION ALL {_MEANS.format(run='dense', table='de')} UNION ALL {_MEANS.format(run='fused', table='fu')}""",
}
