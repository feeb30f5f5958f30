"""Joins, set operations, nested data, incremental patterns and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tausift.functions.text import base_language, plain_name, without_link
from tausift.operators.agreement import gamma, inversion_rates, pair_counts, tau_b
from tausift.operators.incremental import first_wins, gate, latest, pending, replaced, through_cache
from tausift.operators.lookup import by_priority, contained_tokens, exact_or_unique, longest_prefix
from tausift.operators.order import at_positions, ordinal, tie_ranks
from tausift.operators.resample import DRAW_SQL, bootstrap_pairs, bootstrap_rows, draw, drawn_order, drawn_with_replacement, fits_arrays, permuted_pairs, replicates
from tausift.operators.scores import ratio
from tausift.plans.base import BOARDS, FAMILY, LOCAL, SCORES, SLICES, boards, family, local_scores, scores, slices
from tausift.runtime import small, table


def left_default(spark: SparkSession, d: str) -> DataFrame:
    """Every scored entity, and whether it has all tasks in several languages; without an entry: no."""
    s = scores(spark, d)
    members = s.filter(family() == "multi").groupBy("entity").agg((F.count_distinct("task") == 4).alias("full"))
    return s.select("entity").distinct().join(members, "entity", "left").select("entity", F.coalesce("full", F.lit(False)).alias("full"))


def full_outer_align(spark: SparkSession, d: str) -> DataFrame:
    """Scores of two tasks side by side, for entities that have either."""
    s = scores(spark, d)
    a, b = (s.filter(F.col("task") == t).select("entity", F.col("s").alias(n)) for t, n in (("BelebeleRetrieval", "a"), ("MLQARetrieval", "b")))
    return a.join(b, "entity", "full_outer")


def k_way_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Entities with a value in every slice, with their least and greatest local score."""
    l = slices(spark, d)
    n = l.agg(F.count_distinct("slice").alias("n"))  # one row
    per = l.groupBy("entity").agg(F.count_distinct("slice").alias("c"), F.min("l").alias("lowest"), F.max("l").alias("highest"))
    return per.join(F.broadcast(n), F.col("c") == F.col("n")).select("entity", "lowest", "highest")


def semi_answerable(spark: SparkSession, d: str) -> DataFrame:
    """Answerable pairs whose document exists, by language."""
    pairs = table(spark, d, "qar_pair").filter("query_type <> 'unanswerable' and doc_id is not null").dropDuplicates(["query_id"])
    return pairs.join(table(spark, d, "corpus_document").select("doc_id"), "doc_id", "left_semi").groupBy("language").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("doc_id").alias("documents"))


def anti_resume(spark: SparkSession, d: str) -> DataFrame:
    """Corpus documents that no pair was written for yet."""
    return pending(table(spark, d, "corpus_document").filter("doc_id is not null").select("doc_id").distinct(), table(spark, d, "qar_pair").filter("doc_id is not null"), ["doc_id"])


def intersect_keys(spark: SparkSession, d: str) -> DataFrame:
    """Model ids that stand both in the score fact and in the slice averages."""
    return table(spark, d, "per_task_ndcg").select("model_id").intersect(table(spark, d, "lang_avg_per_model").select("model_id")).dropna()


def except_report(spark: SparkSession, d: str) -> DataFrame:
    """Model ids that stand in one of the two only, with the side."""
    a, b = (table(spark, d, t).select("model_id").dropna() for t in ("per_task_ndcg", "lang_avg_per_model"))
    return a.subtract(b).withColumn("side", F.lit("score fact")).union(b.subtract(a).withColumn("side", F.lit("slice averages")))


def union_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Widths of names from the wide fact, then from the leaderboards; the first source that has a name wins."""
    wide = table(spark, d, "unified_results").filter("short_name is not null and dim is not null").select(F.substring_index("model_id", "/", -1).alias("name"), "dim", F.lit("wide").alias("origin"))
    board = table(spark, d, "leaderboard").filter("model is not null and dim is not null").select(F.lower(F.regexp_replace(F.substring_index(without_link("model"), "/", -1), " ", "-")).alias("name"), "dim", F.lit("board").alias("origin"))
    return first_wins(["name"], wide, board)


def unpivot_scores(spark: SparkSession, d: str) -> DataFrame:
    """The wide fact's task columns as rows."""
    return local_scores(spark, d)


def pivot_first(spark: SparkSession, d: str) -> DataFrame:
    """Local scores with one column per slice."""
    names = ["hindi", "italian", "japanese", "swahili"]
    return boards(spark, d).groupBy("entity").pivot("slice", names).agg(F.max("l"))


def cross_source_delta(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the wide fact whose mean of task scores differs from the stated average by more than 0.05."""
    rows = local_scores(spark, d).groupBy("entity", "slice").agg(F.sum("s").alias("t"), F.count("s").alias("n"))
    joined = rows.join(boards(spark, d).select("entity", "slice", "l").dropna(), ["entity", "slice"]).withColumn("delta", ratio(F.col("t"), F.col("n")) - F.col("l").cast("double"))
    return joined.filter(F.abs("delta") > 500).select("entity", "slice", "delta")


def exact_or_short_names(spark: SparkSession, d: str) -> DataFrame:
    """Leaderboard names in the score fact: equal, else the only one with the same plain name, else none."""
    board = table(spark, d, "leaderboard").select(F.substring_index(without_link("model"), "/", -1).alias("name"))
    facts = table(spark, d, "per_task_ndcg").select(F.col("model_id").alias("name"))
    return exact_or_unique(board, facts, "name", plain_name("name"), plain_name("name"))


def prefix_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Plain names of the wide fact against those of the score fact: the longest common prefix of six or more."""
    wide = table(spark, d, "unified_results").select(plain_name(F.substring_index("model_id", "/", -1)).alias("name"))
    return longest_prefix(wide, table(spark, d, "per_task_ndcg").select(plain_name("model_id").alias("name")), "name")


def contained_names(spark: SparkSession, d: str) -> DataFrame:
    """Slice-average names that hold a name of the score fact as a run of parts, the longest."""
    clean = lambda c: F.regexp_replace(F.lower(c), "[@_]", "-")
    return contained_tokens(table(spark, d, "lang_avg_per_model").select(clean("model_id").alias("name")), table(spark, d, "per_task_ndcg").select(clean("model_id").alias("name")), "name")


def alternate_code_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """For every language the first of its codes that documents use, and their mean length."""
    codes = [(s, c, k) for s, cs in {"Japanese": ["jpn", "ja", "JA"], "Hindi": ["hi-IN", "hin", "hi"], "Italian": ["it-IT", "it"], "English": ["eng", "en"]}.items() for k, c in enumerate(cs)]
    values = table(spark, d, "documents").filter("lang is not null").groupBy(F.col("lang").alias("code")).agg(ratio(F.sum("n_chars"), F.count("n_chars")).alias("value"))
    return by_priority(values, spark.createDataFrame(codes, "slice string, code string, priority long"), "slice", "code", "priority", "value")


def unmatched_names(spark: SparkSession, d: str) -> DataFrame:
    """Leaderboard display names that no plain name of the wide fact equals, with the boards that list them."""
    known = table(spark, d, "unified_results").filter("model_id is not null").select(plain_name(F.substring_index("model_id", "/", -1)).alias("p")).distinct()
    board = table(spark, d, "leaderboard").filter("model is not null").withColumn("p", plain_name(F.substring_index(without_link("model"), "/", -1)))
    return board.join(known, "p", "left_anti").groupBy("model").agg(F.array_join(F.array_sort(F.collect_set("board")), ";").alias("boards"))


def json_props_agg(spark: SparkSession, d: str) -> DataFrame:
    """The number in every event's properties: count, sum and greatest by type; 0 where it is missing."""
    k = F.coalesce(F.from_json("props", "k long").getField("k"), F.lit(0))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(k).alias("greatest"))


def nested_result_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Nested result documents, one per entity, written from the wide fact and flattened again: mean by slice and main score."""
    entry = F.struct(F.array("slice").alias("languages"), (F.col("s") / F.lit(10000.0)).alias("ndcg_at_10"), F.col("task").alias("hf_subset"))
    documents = local_scores(spark, d).groupBy("entity").agg(F.to_json(F.struct(F.create_map(F.lit("test"), F.array_sort(F.collect_list(entry))).alias("scores"))).alias("json"))
    schema = "scores map<string, array<struct<languages: array<string>, ndcg_at_10: double, hf_subset: string>>>"
    parsed = documents.select("entity", F.explode(F.from_json("json", schema).getField("scores")).alias("split", "entries")).select("entity", "split", F.explode("entries").alias("e"))
    return parsed.select("entity", "split", F.explode("e.languages").alias("slice"), F.round(F.col("e.ndcg_at_10") * 10000).cast("long").alias("s")).groupBy("entity", "split", "slice").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("total"))


def split_fallback_mean(spark: SparkSession, d: str) -> DataFrame:
    """Per user the mean value of purchases, else of clicks, else of all events, in cents."""
    order = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    rows = table(spark, d, "events").filter("user_id is not null").select("user_id", order.alias("level"), F.round(F.col("value") * 100).cast("long").alias("c"))
    sums = rows.groupBy("user_id", "level").agg(F.sum("c").alias("t"), F.count("c").alias("n"))
    # the last level means all events, not only those of other types
    all_rows = sums.groupBy("user_id").agg(F.min("level").alias("level"), F.sum("t").alias("at"), F.sum("n").alias("an"))
    joined = all_rows.join(sums, ["user_id", "level"])
    return joined.select("user_id", F.col("level").cast("long").alias("level"), F.when(F.col("level") == 2, ratio(F.col("at"), F.col("an"))).otherwise(ratio(F.col("t"), F.col("n"))).alias("mean"))


def latest_revision(spark: SparkSession, d: str) -> DataFrame:
    """The last event of every user."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def checkpoint_latest(spark: SparkSession, d: str) -> DataFrame:
    """Pairs as last written, per query type: number, and how many were written more than once."""
    log = table(spark, d, "qar_pair").filter("query_id is not null")
    counts = log.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.max("query_type").alias("query_type"))
    return counts.groupBy("query_type").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("c") > 1).alias("rewritten"))


def checkpoint_resume(spark: SparkSession, d: str) -> DataFrame:
    """Documents left to do, by language, when those of finance are done."""
    docs = table(spark, d, "documents")
    todo = pending(docs.select("doc_id", "lang"), docs.filter("domain = 'finance'"), ["doc_id"])
    return todo.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def cache_hit_miss(spark: SparkSession, d: str) -> DataFrame:
    """Text digests of all documents, from a cache of the law documents where they are there, else computed."""
    docs = table(spark, d, "documents").select("doc_id", "text", "domain")
    cache = docs.filter("domain = 'law'").select("doc_id", F.md5("text").alias("digest"))
    out = through_cache(docs.select("doc_id", "text"), cache, ["doc_id"], "digest", lambda missing: missing.withColumn("digest", F.md5("text")))
    return out.select("doc_id", "digest", "hit")


def idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    """Slice counts after the same rows of the wide fact were appended twice by delete and insert."""
    new = boards(spark, d).select("entity", "slice", "l")
    once = replaced(new.filter("slice <> 'hindi'"), new, ["entity", "slice"])
    return replaced(once, new.filter("slice = 'hindi'"), ["entity", "slice"]).groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("total"))


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Parts with the price of their last order where they were ordered, else their own, in cents."""
    parts = table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    sold = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))).alias("r")).select("p_partkey", "r.cents")
    return replaced(parts, sold, ["p_partkey"])


def validation_gates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by type that pass the share of key points their type needs."""
    pairs = table(spark, d, "qar_pair").dropDuplicates(["query_id"])
    share = F.when(F.size("keypoints") > 0, F.size(F.filter("keypoints", lambda k: F.coalesce(F.contains(F.col("answer"), k), F.lit(False)))) / F.size("keypoints")).otherwise(F.lit(0.0))
    judged = gate(pairs, F.col("query_type"), share, {"factual": 0.5, "multi_hop": 0.5, "summarization": 0.3, "unanswerable": 0.0})
    return judged.groupBy("query_type").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("valid").alias("valid"))


#: Replicates of a bootstrap, and permutations of a test.
REPS = 10_000
#: Subsets of a resample without replacement, and entities in each.
SUBSETS, SUBSET_SIZE = 100, 25


def bootstrap_mean_ci(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: mean and 95 percent interval of the mean local score over bootstrap replicates."""
    rows = slices(spark, d)
    if fits_arrays(rows, ["slice"]):
        means = replicates(rows, ["slice"], "entity", ["l"], REPS, lambda rep, c: (float(c["l"][drawn_with_replacement(rep, len(c["l"]), 42)].sum()) / len(c["l"]),), "m double")
    else:
        means = bootstrap_rows(rows, ["slice"], "entity", ["l"], REPS).groupBy("slice", "rep").agg(ratio(F.sum("l"), F.count("l")).alias("m"))
    q = at_positions(means, ["slice"], "m", {"low": (F.col("n") - 1) * F.lit(0.025), "high": (F.col("n") - 1) * F.lit(0.975)})
    return q.select("slice", "n", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def bootstrap_tau_ci(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: 95 percent interval of Kendall's tau-b over bootstrap replicates, replicates without a tau left out."""
    taus = bootstrap_pairs(slices(spark, d), ["slice"], "entity", "g", "l", REPS).select("slice", tau_b().alias("tau")).dropna()
    q = at_positions(taus, ["slice"], "tau", {"low": (F.col("n") - 1) * F.lit(0.025), "high": (F.col("n") - 1) * F.lit(0.975)})
    return q.select("slice", "n", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


#: Entities of the rosters of the null distribution; a slice takes part in those it can fill, and as a whole (0).
ROSTERS = (0, 10, 20, 30)


def null_inversion(spark: SparkSession, d: str) -> DataFrame:
    """Per slice and roster (its best entities by global score; 0: all): mean inversion rate of random orders, its spread, and
    the replicates below the observed rate."""
    ranked = ordinal(slices(spark, d), ["slice"], [F.col("g").desc(), F.col("entity").asc()], "k")
    sized = ranked.join(ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("size")), "slice")
    base = sized.select("slice", "entity", "g", "l", "k", "size", F.explode(F.array(*map(F.lit, ROSTERS))).alias("roster")).filter("roster = 0 or (size >= roster and k <= roster)")
    rates = permuted_pairs(base, ["slice", "roster"], "entity", "g", "l", REPS).select("slice", "roster", inversion_rates()["skip"].alias("r"))
    observed = pair_counts(base, ["slice", "roster"], "g", "l").select("slice", "roster", inversion_rates()["skip"].alias("observed"))
    of = rates.join(observed, ["slice", "roster"]).groupBy("slice", "roster", "observed")
    return of.agg(F.round(F.avg("r"), 6).alias("mean_null"), F.round(F.stddev_pop("r"), 6).alias("std_null"), F.count_if(F.col("r") < F.col("observed")).alias("below"))


def permutation_tau(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: Kendall's tau-b, and the add-one p-value of its size among permuted local scores."""
    base = slices(spark, d)
    taus = permuted_pairs(base, ["slice"], "entity", "g", "l", REPS).select("slice", tau_b().alias("t"))
    observed = pair_counts(base, ["slice"], "g", "l").select("slice", tau_b().alias("tau_b"))
    hits = taus.join(observed, "slice").groupBy("slice", "tau_b").agg(F.count_if(F.abs("t") >= F.abs("tau_b") - 1e-12).alias("c"), F.count(F.lit(1)).alias("n"))
    return hits.select("slice", "tau_b", ratio(F.col("c") + 1, F.col("n") + 1).alias("p"))


def subset_resample(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: SUBSETS subsets of SUBSET_SIZE entities without replacement; median and range of their mean local score."""
    rows = slices(spark, d)
    if fits_arrays(rows, ["slice"]):
        chosen = replicates(rows, ["slice"], "entity", ["l"], SUBSETS, lambda rep, c: (float(c["l"][drawn_order(rep, len(c["l"]), 7)[:SUBSET_SIZE]].sum()) / min(SUBSET_SIZE, len(c["l"])),), "m double")
        means = chosen.select("slice", "rep", "m")
    else:
        placed = ordinal(rows, ["slice"], [F.col("entity").asc()], "k").select("slice", "k", "l", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(SUBSETS).cast("long"))).alias("rep"))
        picked = ordinal(placed.withColumn("key", draw(F.col("rep"), F.col("k"), 7)), ["slice", "rep"], [F.col("key").asc(), F.col("k").asc()], "r").filter(F.col("r") <= SUBSET_SIZE)
        means = picked.groupBy("slice", "rep").agg(ratio(F.sum("l"), F.count("l")).alias("m"))
    return means.groupBy("slice").agg(F.round(F.median("m"), 6).alias("median"), F.min("m").alias("lowest"), F.max("m").alias("highest"))


def inflation_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: the gap that the global score shows between large and small models over the local one (inflation), its mean
    and 95 percent interval over bootstrap replicates of the entities, and the share of replicates at or under 1 (one-sided p)."""
    rows = slices(spark, d).filter("params is not null").select("slice", "entity", (F.col("g") * 100).alias("g"), "l", (F.col("params") >= 500_000_000).cast("long").alias("big"))

    def stat(rep: int, c: dict) -> tuple:
        at = drawn_with_replacement(rep, len(c["l"]), 42)
        big, g, low = c["big"][at], c["g"][at], c["l"][at]
        n1 = int(big.sum())
        n0 = len(at) - n1
        if not n1 or not n0:
            return (None,)
        gap = lambda v: float((v * big).sum()) / n1 - float((v * (1 - big)).sum()) / n0
        return (gap(g) / gap(low) if gap(low) else None,)

    if fits_arrays(rows, ["slice"]):
        drawn = replicates(rows, ["slice"], "entity", ["g", "l", "big"], REPS, stat, "r double")
    else:
        gap = lambda c: ratio(F.sum(F.col(c) * F.col("big")), F.sum("big")) - ratio(F.sum(F.col(c) * (1 - F.col("big"))), F.sum(1 - F.col("big")))
        drawn = bootstrap_rows(rows, ["slice"], "entity", ["g", "l", "big"], REPS).groupBy("slice", "rep").agg(F.try_divide(gap("g"), gap("l")).alias("r"))
    valid = drawn.dropna(subset=["r"])
    q = at_positions(valid, ["slice"], "r", {"low": (F.col("n") - 1) * F.lit(0.025), "high": (F.col("n") - 1) * F.lit(0.975)})
    means = valid.groupBy("slice").agg(F.round(F.avg("r"), 6).alias("mean_ratio"), ratio(F.count_if(F.col("r") <= 1), F.count(F.lit(1))).alias("p"))
    return means.join(q, "slice").select("slice", "n", "mean_ratio", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "p")


def mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: U of the local scores of models with 500 million parameters or more against smaller ones."""
    rows = slices(spark, d).filter("params is not null").withColumn("big", F.col("params") >= 500_000_000)
    ranked = tie_ranks(rows, ["slice"], "l", descending=False)
    sums = ranked.groupBy("slice").agg(F.count_if("big").alias("n_big"), F.count_if(~F.col("big")).alias("n_small"), F.sum(F.when(F.col("big"), F.col("rank_avg"))).alias("w"))
    n = F.col("n_big").cast("double")
    return sums.filter("n_big > 0 and n_small > 0").select("slice", "n_big", "n_small", (F.col("w") - n * (n + 1) / 2).alias("u"))


def cluster_delta(spark: SparkSession, d: str) -> DataFrame:
    """Per group (all tasks in several languages or not): entities, median and mean gap between the two families of tasks."""
    s = scores(spark, d).withColumn("f", family())
    per = s.groupBy("entity").agg(ratio(F.sum(F.when(F.col("f") == "single", F.col("s"))), F.count(F.when(F.col("f") == "single", 1))).alias("a"), ratio(F.sum(F.when(F.col("f") == "multi", F.col("s"))), F.count(F.when(F.col("f") == "multi", 1))).alias("b"), F.count_if(F.col("f") == "multi").alias("m"))
    rows = per.dropna().select(F.when(F.col("m") == 4, "full").otherwise("partial").alias("group"), (F.col("a") - F.col("b")).alias("delta"))
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("delta"), 6).alias("median_delta"), F.round(F.avg("delta"), 4).alias("mean_delta"))


def roster_variants(spark: SparkSession, d: str) -> DataFrame:
    """Agreement per slice over three rosters: all, without instruction-tuned names, and one entity per family."""
    base = slices(spark, d)
    one = base.withColumn("f", F.regexp_extract("entity", "^(?:ml-)?([a-z]+)", 1))
    keep = one.groupBy("slice", "f").agg(F.max_by("entity", F.struct("g", "entity")).alias("entity")).select("slice", "entity")
    parts = [("all", base), ("no_instruct", base.filter(~F.col("entity").rlike("inst"))), ("one_per_family", base.join(keep, ["slice", "entity"], "left_semi"))]
    out = None
    for name, part in parts:
        named = part.select(F.lit(name).alias("roster"), "slice", "entity", "g", "l")
        out = named if out is None else out.union(named)
    counts = pair_counts(out, ["roster", "slice"], "g", "l").filter("pairs > 0")
    return counts.select("roster", "slice", "n", tau_b().alias("tau_b"), gamma().alias("gamma"))


def unified_sources(spark: SparkSession, d: str) -> DataFrame:
    """Per slice and source label: rows, rows with a global score, and rows whose gap is null."""
    rows = boards(spark, d)
    return rows.groupBy("slice", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("g").alias("n_global"), F.count_if((F.col("l") - F.col("g")).isNull()).alias("n_gap_null"))


def query_type_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Per language: mean answer length by query type, and the ratio of summaries to facts."""
    pairs = table(spark, d, "qar_pair").filter("language is not null and answer is not null").dropDuplicates(["query_id"])
    sums = pairs.groupBy("language").agg(*(x for t in ("factual", "summarization") for x in (F.sum(F.when(F.col("query_type") == t, F.length("answer"))).alias(f"t_{t}"), F.count(F.when(F.col("query_type") == t, 1)).alias(f"n_{t}"))))
    a, b = ratio(F.col("t_factual"), F.col("n_factual")), ratio(F.col("t_summarization"), F.col("n_summarization"))
    return sums.select("language", a.alias("factual"), b.alias("summarization"), F.try_divide(b, a).alias("ratio"))


def efficiency_merge(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with their mean sale, and sales per unit of balance; suppliers without sales stay."""
    sold = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("t"), F.count(F.lit(1)).alias("n"))
    return table(spark, d, "supplier").join(sold, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"), ratio(F.col("t"), F.col("n")).alias("mean_cents"), F.round(F.try_divide(ratio(F.col("t"), F.col("n")), F.col("s_acctbal")), 5).alias("efficiency"))


def earlier_check_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Per query type: how the earlier check and the record's own flag agree, and the ratio of their rates."""
    pairs = table(spark, d, "qar_pair").filter("answer_valid is not null and valid is not null").dropDuplicates(["query_id"])
    sums = pairs.groupBy("query_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("valid") == F.col("answer_valid")).alias("agree"), F.count_if("valid").alias("a"), F.count_if("answer_valid").alias("b"))
    return sums.select("query_type", "n", "agree", F.try_divide(F.col("a").cast("double"), F.col("b").cast("double")).alias("ratio"))


def best_other(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: the best entity that isn't an API, against the mean of the APIs."""
    rows = slices(spark, d)
    agg = rows.groupBy("slice").agg(F.max(F.when(F.col("tier") != "api", F.struct("l", "entity"))).alias("b"), ratio(F.sum(F.when(F.col("tier") == "api", F.col("l"))), F.count(F.when(F.col("tier") == "api", 1))).alias("api_mean"))
    return agg.select("slice", F.col("b.entity").alias("best"), F.col("b.l").alias("best_local"), "api_mean")


def run_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Per tier: models and languages whose first and last run differ, and the mean change, in millionths."""
    rows = table(spark, d, "lang_avg_per_model").filter("model_id is not null and language_iso is not null and lang_avg_ndcg is not null and not isnan(lang_avg_ndcg)").select("tier", "model_id", "language_iso", "run_ts", F.round(F.col("lang_avg_ndcg") * 1000000).cast("long").alias("s"))
    ends = rows.groupBy("tier", "model_id", "language_iso").agg(F.min(F.struct("run_ts", "s")).alias("a"), F.max(F.struct("run_ts", "s")).alias("b"))
    moved = ends.select("tier", (F.col("b.s") - F.col("a.s")).alias("c")).filter("c <> 0")
    return moved.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), ratio(F.sum("c"), F.count(F.lit(1))).alias("mean_change"))


def tiers_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Per base language of the slice averages: models by tier, and those below one half, of languages in every tier."""
    rows = table(spark, d, "lang_avg_per_model").filter("language_iso is not null and tier is not null and model_id is not null")
    counts = rows.groupBy(base_language("language_iso").alias("language")).agg(F.count_distinct("tier").alias("tiers"), F.count_distinct("model_id").alias("models"), F.count_if(F.col("lang_avg_ndcg") < 0.5).alias("below"))
    return counts.filter("tiers = 3").select("language", "models", "below")


def customer_region_sales(spark: SparkSession, d: str) -> DataFrame:
    """Revenue in ten-thousandths by region and order priority: the star join of six tables."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    places = small(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(places, "n_nationkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").alias("c_custkey")).join(customers, "c_custkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))).alias("v"))
    return lines.join(orders, "o_orderkey").groupBy("r_name", "o_orderpriority").agg(F.sum("v").alias("revenue"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        left_default, full_outer_align, k_way_intersection, semi_answerable, anti_resume, intersect_keys, except_report, union_first_wins, unpivot_scores, pivot_first, cross_source_delta, exact_or_short_names,
        prefix_fuzzy_match, contained_names, alternate_code_coalesce, unmatched_names, json_props_agg, nested_result_flatten, split_fallback_mean, latest_revision, checkpoint_latest, checkpoint_resume, cache_hit_miss,
        idempotent_append, upsert_latest, validation_gates, bootstrap_mean_ci, bootstrap_tau_ci, inflation_bootstrap, null_inversion, permutation_tau, subset_resample, mann_whitney, cluster_delta, roster_variants, unified_sources,
        query_type_ratio, efficiency_merge, earlier_check_agreement, best_other, run_snapshots, tiers_by_language, customer_region_sales,
    )
}

_PLAIN = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_NAME = r"split_part(regexp_replace(model, '^\s*\[([^\]]*)\]\([^)]*\)\s*$', '\1'), '/', -1)"
_LEAF = "split_part(model_id, '/', -1)"
_BASE = "coalesce(CASE regexp_extract(lower(language_iso), '^([a-z]+)', 1) WHEN 'jpn' THEN 'ja' WHEN 'hin' THEN 'hi' WHEN 'ita' THEN 'it' WHEN 'eng' THEN 'en' WHEN 'swa' THEN 'sw' END, regexp_extract(lower(language_iso), '^([a-z]+)', 1))"
_TAU = "CASE WHEN concordant + discordant + tied_y > 0 AND concordant + discordant + tied_x > 0 THEN CAST(concordant - discordant AS DOUBLE) / sqrt(CAST(concordant + discordant + tied_y AS DOUBLE) * CAST(concordant + discordant + tied_x AS DOUBLE)) END"
_SKIP = "CASE WHEN concordant + discordant > 0 THEN CAST(discordant AS DOUBLE) / CAST(concordant + discordant AS DOUBLE) END"


def _pairs(keys: str, source: str, item: str = "entity", out: str = "gc") -> str:
    names = [k.strip() for k in keys.split(",")]
    return f"""{out} AS (SELECT {keys}, count(*) FILTER (sx * sy > 0) AS concordant, count(*) FILTER (sx * sy < 0) AS discordant, count(*) FILTER (sx = 0 AND sy <> 0) AS tied_x, count(*) FILTER (sx <> 0 AND sy = 0) AS tied_y
    FROM (SELECT {', '.join('a.' + k for k in names)}, sign(a.g - b.g) AS sx, sign(a.l - b.l) AS sy FROM {source} a JOIN {source} b ON {' AND '.join(f'a.{k} = b.{k}' for k in names)} AND a.{item} < b.{item}) GROUP BY {keys})"""


_PLACED = f"{SLICES}, placed AS (SELECT slice, entity, g, l, row_number() OVER (PARTITION BY slice ORDER BY entity) AS k, count(*) OVER (PARTITION BY slice) AS n FROM slices), reps AS (SELECT unnest(generate_series(1, {REPS})) AS rep)"
_BOOT = f"{_PLACED}, boot AS (SELECT a.slice, rep, a.k, b.g, b.l FROM placed a CROSS JOIN reps JOIN placed b ON b.slice = a.slice AND b.k - 1 = {DRAW_SQL.format(rep='rep', k='(a.k - 1)', seed=42)} % a.n)"
_PERM = f"""{_PLACED}, dealt AS (SELECT slice, rep, l, row_number() OVER (PARTITION BY slice, rep ORDER BY {DRAW_SQL.format(rep='rep', k='k', seed=42)}, k) AS t FROM placed, reps),
    perm AS (SELECT p.slice, d.rep, p.entity, p.g, d.l FROM dealt d JOIN placed p ON p.slice = d.slice AND p.k = d.t)"""

ORACLE = {
    "left_default": f"WITH {SCORES}, m AS (SELECT entity, count(DISTINCT task) = 4 AS \"full\" FROM scores WHERE {FAMILY} = 'multi' GROUP BY entity) SELECT entity, coalesce(\"full\", false) AS \"full\" FROM (SELECT DISTINCT entity FROM scores) LEFT JOIN m USING (entity)",
    "full_outer_align": f"WITH {SCORES} SELECT coalesce(x.entity, y.entity) AS entity, x.s AS a, y.s AS b FROM (SELECT * FROM scores WHERE task = 'BelebeleRetrieval') x FULL JOIN (SELECT * FROM scores WHERE task = 'MLQARetrieval') y ON x.entity = y.entity",
    "k_way_intersection": f"WITH {SLICES} SELECT entity, min(l) AS lowest, max(l) AS highest FROM slices GROUP BY entity HAVING count(DISTINCT slice) = (SELECT count(DISTINCT slice) FROM slices)",
    "semi_answerable": "WITH p AS (SELECT DISTINCT ON (query_id) * FROM qar_pair WHERE query_type <> 'unanswerable' AND doc_id IS NOT NULL) SELECT language, CAST(count(*) AS BIGINT) AS pairs, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM p WHERE doc_id IN (SELECT doc_id FROM corpus_document) GROUP BY language",
    "anti_resume": "SELECT DISTINCT doc_id FROM corpus_document WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM qar_pair WHERE doc_id IS NOT NULL)",
    "intersect_keys": "SELECT model_id FROM per_task_ndcg WHERE model_id IS NOT NULL INTERSECT SELECT model_id FROM lang_avg_per_model",
    "except_report": "SELECT model_id, 'score fact' AS side FROM (SELECT model_id FROM per_task_ndcg WHERE model_id IS NOT NULL EXCEPT SELECT model_id FROM lang_avg_per_model) UNION ALL SELECT model_id, 'slice averages' FROM (SELECT model_id FROM lang_avg_per_model WHERE model_id IS NOT NULL EXCEPT SELECT model_id FROM per_task_ndcg)",
    "union_first_wins": f"""WITH u AS (SELECT {_LEAF} AS name, dim, 'wide' AS origin, 0 AS k FROM unified_results WHERE short_name IS NOT NULL AND dim IS NOT NULL UNION ALL SELECT lower(replace({_NAME}, ' ', '-')), dim, 'board', 1 FROM leaderboard WHERE model IS NOT NULL AND dim IS NOT NULL)
        SELECT name, dim, origin FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k, dim) AS r FROM u) WHERE r = 1""",
    "unpivot_scores": f"WITH {LOCAL} SELECT entity, slice, task, s FROM local_scores",
    "pivot_first": f"WITH {BOARDS} SELECT entity, {', '.join(f'max(CASE WHEN slice = {chr(39)}{x}{chr(39)} THEN l END) AS {x}' for x in ('hindi', 'italian', 'japanese', 'swahili'))} FROM boards GROUP BY entity",
    "cross_source_delta": f"WITH {BOARDS}, {LOCAL}, x AS (SELECT entity, slice, CAST(sum(s) AS DOUBLE) / CAST(count(s) AS DOUBLE) AS m FROM local_scores GROUP BY ALL) SELECT entity, slice, m - CAST(l AS DOUBLE) AS delta FROM x JOIN boards USING (entity, slice) WHERE l IS NOT NULL AND abs(m - CAST(l AS DOUBLE)) > 500",
    "exact_or_short_names": f"""WITH a AS (SELECT DISTINCT {_NAME} AS k FROM leaderboard WHERE model IS NOT NULL), b AS (SELECT DISTINCT model_id AS r FROM per_task_ndcg WHERE model_id IS NOT NULL), o AS (SELECT {_PLAIN.format('r')} AS s, min(r) AS one FROM b GROUP BY 1 HAVING count(*) = 1)
        SELECT k AS name, coalesce(r, one) AS matched, CASE WHEN r IS NOT NULL THEN 'exact' WHEN one IS NOT NULL THEN 'short' ELSE 'none' END AS method FROM a LEFT JOIN b ON k = r LEFT JOIN o ON s = {_PLAIN.format('k')}""",
    "prefix_fuzzy_match": f"""WITH a AS (SELECT DISTINCT {_PLAIN.format(_LEAF)} AS n FROM unified_results WHERE model_id IS NOT NULL), b AS (SELECT DISTINCT {_PLAIN.format('model_id')} AS m FROM per_task_ndcg WHERE model_id IS NOT NULL),
        x AS (SELECT n, m, list_max(list_filter(generate_series(6, least(length(n), length(m))), lambda k: substr(n, 1, k) = substr(m, 1, k))) AS o FROM a JOIN b ON substr(n, 1, 6) = substr(m, 1, 6) AND length(n) >= 6 AND length(m) >= 6)
        SELECT n AS name, m AS matched, o AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY o DESC, m) AS r FROM x) WHERE r = 1""",
    "contained_names": """WITH a AS (SELECT DISTINCT regexp_replace(lower(model_id), '[@_]', '-', 'g') AS n FROM lang_avg_per_model WHERE model_id IS NOT NULL), b AS (SELECT DISTINCT regexp_replace(lower(model_id), '[@_]', '-', 'g') AS m FROM per_task_ndcg WHERE model_id IS NOT NULL),
        x AS (SELECT n, m FROM a JOIN b ON contains('-' || n || '-', '-' || m || '-')) SELECT n AS name, m AS matched FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY length(m) DESC, m) AS r FROM x) WHERE r = 1""",
    "alternate_code_coalesce": """WITH c(slice, code, p) AS (VALUES ('Japanese', 'jpn', 0), ('Japanese', 'ja', 1), ('Japanese', 'JA', 2), ('Hindi', 'hi-IN', 0), ('Hindi', 'hin', 1), ('Hindi', 'hi', 2), ('Italian', 'it-IT', 0), ('Italian', 'it', 1), ('English', 'eng', 0), ('English', 'en', 1)),
        v AS (SELECT lang AS code, CAST(sum(n_chars) AS DOUBLE) / CAST(count(n_chars) AS DOUBLE) AS value FROM documents WHERE lang IS NOT NULL GROUP BY lang) SELECT slice, code, value FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY p) AS r FROM c JOIN v USING (code)) WHERE r = 1""",
    "unmatched_names": f"SELECT model, string_agg(DISTINCT board, ';' ORDER BY board) AS boards FROM leaderboard WHERE model IS NOT NULL AND {_PLAIN.format(_NAME)} NOT IN (SELECT {_PLAIN.format(_LEAF)} FROM unified_results WHERE model_id IS NOT NULL) GROUP BY model",
    "json_props_agg": "WITH e AS (SELECT event_type, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k FROM events) SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS greatest FROM e GROUP BY event_type",
    "nested_result_flatten": f"WITH {LOCAL} SELECT entity, 'test' AS split, slice, CAST(count(*) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS total FROM local_scores GROUP BY ALL",
    "split_fallback_mean": """WITH e AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS v, CAST(round(value * 100) AS BIGINT) AS c FROM events WHERE user_id IS NOT NULL), m AS (SELECT user_id, min(v) AS v FROM e GROUP BY user_id)
        SELECT user_id, CAST(m.v AS BIGINT) AS level, CAST(sum(c) AS DOUBLE) / CAST(count(c) AS DOUBLE) AS mean FROM m JOIN e USING (user_id) WHERE m.v = 2 OR e.v = m.v GROUP BY user_id, m.v""",
    "latest_revision": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) WHERE r = 1",
    "checkpoint_latest": "WITH c AS (SELECT query_id, count(*) AS c, max(query_type) AS query_type FROM qar_pair WHERE query_id IS NOT NULL GROUP BY query_id) SELECT query_type, CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (c > 1) AS BIGINT) AS rewritten FROM c GROUP BY query_type",
    "checkpoint_resume": "SELECT coalesce(lang, '') AS lang, CAST(count(*) AS BIGINT) AS n FROM documents WHERE domain IS DISTINCT FROM 'finance' GROUP BY 1",
    "cache_hit_miss": "SELECT doc_id, md5(text) AS digest, coalesce(domain = 'law', false) AS hit FROM documents",
    "idempotent_append": f"WITH {BOARDS} SELECT slice, CAST(count(*) AS BIGINT) AS n, CAST(sum(l) AS BIGINT) AS total FROM boards GROUP BY slice",
    "upsert_latest": """WITH s AS (SELECT l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, round(l_extendedprice * 100) DESC) AS r FROM lineitem)
        SELECT l_partkey AS p_partkey, cents FROM s WHERE r = 1 UNION ALL SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""",
    "validation_gates": """WITH p AS (SELECT DISTINCT ON (query_id) query_type, CASE WHEN len(keypoints) > 0 THEN CAST(len(list_filter(keypoints, lambda k: coalesce(contains(answer, k), false))) AS DOUBLE) / len(keypoints) ELSE 0 END AS share FROM qar_pair)
        SELECT query_type, CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (share >= CASE query_type WHEN 'summarization' THEN 0.3 WHEN 'unanswerable' THEN 0 ELSE 0.5 END) AS BIGINT) AS valid FROM p GROUP BY query_type""",
    "bootstrap_mean_ci": f"WITH {_BOOT}, m AS (SELECT slice, rep, CAST(sum(l) AS DOUBLE) / CAST(count(l) AS DOUBLE) AS m FROM boot GROUP BY ALL) SELECT slice, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(m, CAST(0.025 AS DOUBLE)), 4) AS low, round(quantile_cont(m, CAST(0.975 AS DOUBLE)), 4) AS high FROM m GROUP BY slice",
    "bootstrap_tau_ci": f"WITH {_BOOT}, {_pairs('slice, rep', 'boot', 'k')}, t AS (SELECT slice, {_TAU} AS t FROM gc) SELECT slice, CAST(count(t) AS BIGINT) AS n, round(quantile_cont(t, CAST(0.025 AS DOUBLE)), 9) AS low, round(quantile_cont(t, CAST(0.975 AS DOUBLE)), 9) AS high FROM t GROUP BY slice",
    "null_inversion": f"""WITH {SLICES}, ranked AS (SELECT slice, entity, g, l, row_number() OVER (PARTITION BY slice ORDER BY g DESC, entity) AS k0, count(*) OVER (PARTITION BY slice) AS size FROM slices),
        base AS (SELECT slice, roster, entity, g, l FROM ranked, (VALUES {', '.join(f'({r})' for r in ROSTERS)}) x(roster) WHERE roster = 0 OR (size >= roster AND k0 <= roster)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY slice, roster ORDER BY entity) AS k FROM base), reps AS (SELECT unnest(generate_series(1, {REPS})) AS rep),
        dealt AS (SELECT slice, roster, rep, l, row_number() OVER (PARTITION BY slice, roster, rep ORDER BY {DRAW_SQL.format(rep='rep', k='k', seed=42)}, k) AS t FROM placed, reps),
        perm AS (SELECT p.slice, p.roster, d.rep, p.entity, p.g, d.l FROM dealt d JOIN placed p ON p.slice = d.slice AND p.roster = d.roster AND p.k = d.t),
        {_pairs('slice, roster, rep', 'perm')}, {_pairs('slice, roster', 'base', out='ob')}, r AS (SELECT slice, roster, {_SKIP} AS r FROM gc), o AS (SELECT slice, roster, {_SKIP} AS observed FROM ob)
        SELECT slice, roster, observed, round(avg(r), 6) AS mean_null, round(stddev_pop(r), 6) AS std_null, CAST(count(*) FILTER (r < observed) AS BIGINT) AS below FROM r JOIN o USING (slice, roster) GROUP BY slice, roster, observed""",
    "inflation_bootstrap": f"""WITH {SLICES}, placed AS (SELECT slice, g * 100 AS g, l, CAST(params >= 500000000 AS BIGINT) AS big, row_number() OVER (PARTITION BY slice ORDER BY entity) AS k, count(*) OVER (PARTITION BY slice) AS n FROM slices WHERE params IS NOT NULL),
        reps AS (SELECT unnest(generate_series(1, {REPS})) AS rep), boot AS (SELECT a.slice, rep, b.g, b.l, b.big FROM placed a CROSS JOIN reps JOIN placed b ON b.slice = a.slice AND b.k - 1 = {DRAW_SQL.format(rep='rep', k='(a.k - 1)', seed=42)} % a.n),
        t AS (SELECT slice, rep, CAST(sum(g * big) AS DOUBLE) / nullif(sum(big), 0) - CAST(sum(g * (1 - big)) AS DOUBLE) / nullif(sum(1 - big), 0) AS a, CAST(sum(l * big) AS DOUBLE) / nullif(sum(big), 0) - CAST(sum(l * (1 - big)) AS DOUBLE) / nullif(sum(1 - big), 0) AS b FROM boot GROUP BY slice, rep),
        r AS (SELECT slice, a / nullif(b, 0) AS r FROM t)
        SELECT slice, CAST(count(r) AS BIGINT) AS n, round(avg(r), 6) AS mean_ratio, round(quantile_cont(r, CAST(0.025 AS DOUBLE)), 6) AS low, round(quantile_cont(r, CAST(0.975 AS DOUBLE)), 6) AS high, CAST(count(*) FILTER (r <= 1) AS DOUBLE) / CAST(count(r) AS DOUBLE) AS p FROM r WHERE r IS NOT NULL GROUP BY slice""",
    "permutation_tau": f"WITH {_PERM}, {_pairs('slice, rep', 'perm')}, {_pairs('slice', 'slices', out='ob')}, r AS (SELECT slice, {_TAU} AS t FROM gc), o AS (SELECT slice, {_TAU} AS tau_b FROM ob) SELECT slice, tau_b, CAST(count(*) FILTER (abs(t) >= abs(tau_b) - 1e-12) + 1 AS DOUBLE) / CAST(count(*) + 1 AS DOUBLE) AS p FROM r JOIN o USING (slice) GROUP BY slice, tau_b",
    "subset_resample": f"""WITH {_PLACED}, s AS (SELECT slice, rep, l, row_number() OVER (PARTITION BY slice, rep ORDER BY {DRAW_SQL.format(rep='rep', k='k', seed=7)}, k) AS r FROM placed, reps WHERE rep <= {SUBSETS}), m AS (SELECT slice, rep, CAST(sum(l) AS DOUBLE) / CAST(count(l) AS DOUBLE) AS m FROM s WHERE r <= {SUBSET_SIZE} GROUP BY ALL)
        SELECT slice, round(median(m), 6) AS median, min(m) AS lowest, max(m) AS highest FROM m GROUP BY slice""",
    "mann_whitney": f"""WITH {SLICES}, r AS (SELECT slice, params >= 500000000 AS big, rank() OVER (PARTITION BY slice ORDER BY l) + (count(*) OVER (PARTITION BY slice, l) - 1) / CAST(2 AS DOUBLE) AS k FROM slices WHERE params IS NOT NULL),
        s AS (SELECT slice, CAST(count(*) FILTER (big) AS BIGINT) AS n_big, CAST(count(*) FILTER (NOT big) AS BIGINT) AS n_small, sum(k) FILTER (big) AS w FROM r GROUP BY slice) SELECT slice, n_big, n_small, w - CAST(n_big AS DOUBLE) * (CAST(n_big AS DOUBLE) + 1) / 2 AS u FROM s WHERE n_big > 0 AND n_small > 0""",
    "cluster_delta": f"""WITH {SCORES}, p AS (SELECT entity, CAST(sum(s) FILTER ({FAMILY} = 'single') AS DOUBLE) / CAST(count(*) FILTER ({FAMILY} = 'single') AS DOUBLE) - CAST(sum(s) FILTER ({FAMILY} = 'multi') AS DOUBLE) / CAST(count(*) FILTER ({FAMILY} = 'multi') AS DOUBLE) AS delta, count(*) FILTER ({FAMILY} = 'multi') AS m, count(*) FILTER ({FAMILY} = 'single') AS q FROM scores GROUP BY entity)
        SELECT CASE WHEN m = 4 THEN 'full' ELSE 'partial' END AS "group", CAST(count(*) AS BIGINT) AS n, round(median(delta), 6) AS median_delta, round(avg(delta), 4) AS mean_delta FROM p WHERE m > 0 AND q > 0 GROUP BY 1""",
    "roster_variants": f"""WITH {SLICES}, k AS (SELECT slice, entity FROM (SELECT *, row_number() OVER (PARTITION BY slice, regexp_extract(entity, '^(?:ml-)?([a-z]+)', 1) ORDER BY g DESC, entity DESC) AS r FROM slices) WHERE r = 1),
        x AS (SELECT 'all' AS roster, slice, entity, g, l FROM slices UNION ALL SELECT 'no_instruct', slice, entity, g, l FROM slices WHERE NOT contains(entity, 'inst') UNION ALL SELECT 'one_per_family', slice, entity, g, l FROM slices JOIN k USING (slice, entity)), {_pairs('roster, slice', 'x')}
        SELECT roster, slice, n, {_TAU} AS tau_b, CASE WHEN concordant + discordant > 0 THEN CAST(concordant - discordant AS DOUBLE) / CAST(concordant + discordant AS DOUBLE) END AS gamma FROM gc JOIN (SELECT roster, slice, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY ALL) USING (roster, slice)""",
    "unified_sources": f"WITH {BOARDS} SELECT slice, kind, CAST(count(*) AS BIGINT) AS n, CAST(count(g) AS BIGINT) AS n_global, CAST(count(*) FILTER (l - g IS NULL) AS BIGINT) AS n_gap_null FROM boards GROUP BY ALL",
    "query_type_ratio": """WITH p AS (SELECT DISTINCT ON (query_id) language, query_type, length(answer) AS n FROM qar_pair WHERE language IS NOT NULL AND answer IS NOT NULL), s AS (SELECT language, CAST(sum(n) FILTER (query_type = 'factual') AS DOUBLE) / nullif(CAST(count(*) FILTER (query_type = 'factual') AS DOUBLE), 0) AS factual,
        CAST(sum(n) FILTER (query_type = 'summarization') AS DOUBLE) / nullif(CAST(count(*) FILTER (query_type = 'summarization') AS DOUBLE), 0) AS summarization FROM p GROUP BY language) SELECT language, factual, summarization, summarization / nullif(factual, 0) AS ratio FROM s""",
    "efficiency_merge": """WITH s AS (SELECT l_suppkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS m, count(*) AS n FROM lineitem GROUP BY l_suppkey)
        SELECT s_suppkey, CAST(coalesce(n, 0) AS BIGINT) AS n, m AS mean_cents, round(m / nullif(s_acctbal, 0), 5) AS efficiency FROM supplier LEFT JOIN s ON l_suppkey = s_suppkey""",
    "earlier_check_agreement": """WITH p AS (SELECT DISTINCT ON (query_id) query_type, valid, answer_valid FROM qar_pair WHERE answer_valid IS NOT NULL AND valid IS NOT NULL)
        SELECT query_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (valid = answer_valid) AS BIGINT) AS agree, CAST(count(*) FILTER (valid) AS DOUBLE) / nullif(CAST(count(*) FILTER (answer_valid) AS DOUBLE), 0) AS ratio FROM p GROUP BY query_type""",
    "best_other": f"""WITH {SLICES}, r AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY l DESC, entity DESC) AS k FROM slices WHERE tier <> 'api'), a AS (SELECT slice, CAST(sum(l) FILTER (tier = 'api') AS DOUBLE) / nullif(CAST(count(*) FILTER (tier = 'api') AS DOUBLE), 0) AS api_mean FROM slices GROUP BY slice)
        SELECT slice, entity AS best, l AS best_local, api_mean FROM a LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (slice)""",
    "run_snapshots": """WITH r AS (SELECT tier, model_id, language_iso, CAST(round(lang_avg_ndcg * 1000000) AS BIGINT) AS s, row_number() OVER (PARTITION BY tier, model_id, language_iso ORDER BY run_ts NULLS FIRST, lang_avg_ndcg) AS a, row_number() OVER (PARTITION BY tier, model_id, language_iso ORDER BY run_ts DESC NULLS LAST, lang_avg_ndcg DESC) AS b
        FROM lang_avg_per_model WHERE model_id IS NOT NULL AND language_iso IS NOT NULL AND lang_avg_ndcg IS NOT NULL AND NOT isnan(lang_avg_ndcg)), c AS (SELECT tier, max(s) FILTER (b = 1) - max(s) FILTER (a = 1) AS c FROM r GROUP BY tier, model_id, language_iso)
        SELECT tier, CAST(count(*) AS BIGINT) AS n, CAST(sum(c) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean_change FROM c WHERE c <> 0 GROUP BY tier""",
    "tiers_by_language": f"SELECT {_BASE} AS language, CAST(count(DISTINCT model_id) AS BIGINT) AS models, CAST(count(*) FILTER (lang_avg_ndcg < 0.5) AS BIGINT) AS below FROM lang_avg_per_model WHERE language_iso IS NOT NULL AND tier IS NOT NULL AND model_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT tier) = 3",
    "customer_region_sales": """SELECT r_name, o_orderpriority, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS revenue, CAST(count(*) AS BIGINT) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
}
