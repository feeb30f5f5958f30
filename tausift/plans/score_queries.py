"""Aggregate scores and the statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tausift.operators.agreement import inversion_rates, pair_counts, tau_b
from tausift.operators.order import at_positions, ordinal, running, tie_ranks
from tausift.operators.scores import borda, consensus_scores, covered_scores, full_coverage, global_scores, leave_one_out, ratio, row_aggregators, weighted_scores
from tausift.operators.stats import adjusted_p, correlation, pareto_front, spearman, two_regressors
from tausift.plans.base import BOARDS, FAMILY, LOCAL, SCORES, SLICES, boards, family, local_scores, scores, slices
from tausift.runtime import table


def global_score(spark: SparkSession, d: str) -> DataFrame:
    """Every entity's mean over all its tasks, and their number."""
    return global_scores(scores(spark, d))


def subset_score(spark: SparkSession, d: str) -> DataFrame:
    """Every entity's mean over the tasks in several languages."""
    return global_scores(scores(spark, d).filter(family() == "multi"))


def consensus_local_avg(spark: SparkSession, d: str) -> DataFrame:
    """Per slice, means over the tasks that at least half of its entities have, of the entities that have all of these."""
    return consensus_scores(local_scores(spark, d), "slice", "entity", "task", "s")


def full_coverage_roster(spark: SparkSession, d: str) -> DataFrame:
    """Entities with every one of the tasks in several languages."""
    return full_coverage(scores(spark, d).filter(family() == "multi"), "entity", "task")


def loo_macro(spark: SparkSession, d: str) -> DataFrame:
    """Per entity and slice: its mean over its slices, and over the other slices only."""
    return leave_one_out(slices(spark, d), "entity", "slice", "l")


def inv_coverage_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Means over tasks weighted by the inverse of the entities that have the task."""
    s = scores(spark, d)
    weights = s.groupBy("task").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    return weighted_scores(s.join(weights, "task"), "entity", "s", "w").select("entity", F.round("score", 4).alias("score"))


def agg_min_median_harmonic_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """Mean, minimum, median, harmonic and trimmed mean of the task scores of entities that have all multilingual tasks."""
    s = scores(spark, d)
    full = full_coverage(s.filter(family() == "multi"), "entity", "task")
    a = row_aggregators(s.join(full, "entity", "left_semi"), "entity", "s")
    return a.select("entity", "n", *(F.round(c, 4).alias(c) for c in ("mean", "lowest", "median", "harmonic", "trimmed")))


def borda_points(spark: SparkSession, d: str) -> DataFrame:
    """Borda points over tasks, among the entities that have all tasks in several languages."""
    s = scores(spark, d).filter(family() == "multi")
    roster = full_coverage(s, "entity", "task").select("entity")
    return borda(s.join(roster, "entity", "left_semi"), "entity", "task", "s")


def global_min(spark: SparkSession, d: str) -> DataFrame:
    """Every entity's lowest score over all slices and tasks."""
    return local_scores(spark, d).groupBy("entity").agg(F.min("s").alias("lowest"))


def coverage_gated_score(spark: SparkSession, d: str) -> DataFrame:
    """Means of entities that have at least half of the 20 tasks; the others' score is null."""
    return covered_scores(scores(spark, d), "entity", "s", F.lit(20), 0.5)


def family_profile(spark: SparkSession, d: str) -> DataFrame:
    """Means over single-language and multi-language tasks, counts, and their difference, of entities that have both."""
    s = scores(spark, d).withColumn("f", family())
    sums = s.groupBy("entity").agg(*(x for f in ("single", "multi") for x in (F.sum(F.when(F.col("f") == f, F.col("s"))).alias(f"t_{f}"), F.count(F.when(F.col("f") == f, 1)).alias(f"n_{f}"))))
    both = sums.filter("n_single > 0 and n_multi > 0").withColumns({"single": ratio(F.col("t_single"), F.col("n_single")), "multi": ratio(F.col("t_multi"), F.col("n_multi"))})
    return both.select("entity", "n_single", "n_multi", "single", "multi", (F.col("single") - F.col("multi")).alias("delta"))


def aggregator_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Three aggregates against the local scores per slice: tau-b and inversion rate of each."""
    local = slices(spark, d).select("entity", "slice", "g", "l")
    loo = leave_one_out(local, "entity", "slice", "l")
    variants = local.join(loo, ["entity", "slice"]).select("slice", "entity", "l", F.col("g").cast("double").alias("global"), "macro", "loo")
    long = variants.unpivot(["slice", "entity", "l"], ["global", "macro", "loo"], "aggregator", "x").dropna()
    counts = pair_counts(long, ["aggregator", "slice"], "x", "l").filter("pairs > 0")
    return counts.select("aggregator", "slice", "n", tau_b().alias("tau_b"), inversion_rates()["skip"].alias("inversion_rate"))


def score_gap(spark: SparkSession, d: str) -> DataFrame:
    """Local less global score, in ten-thousandths and in percent of the global score."""
    gap = F.col("l") - F.col("g") * 100
    return boards(spark, d).select("entity", "slice", gap.alias("gap"), F.try_divide(gap.cast("double") * 100, (F.col("g") * 100).cast("double")).alias("gap_pct"))


def ols_gap(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: regression of the gap on log10 of the parameters."""
    rows = slices(spark, d).filter("params is not null").select("slice", ((F.col("l") - F.col("g") * 100) / F.lit(10000.0)).alias("y"), F.log10(F.col("params").cast("double")).alias("x"))
    fit = rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2")).filter("n >= 3")
    return fit.select("slice", "n", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")))


def ols_two_regressors(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: regression of the local score on log10 of the parameters and log2 of the width."""
    rows = slices(spark, d).filter("params is not null and dim is not null").select("slice", (F.col("l") / F.lit(10000.0)).alias("y"), F.log10(F.col("params").cast("double")).alias("a"), F.log2(F.col("dim").cast("double")).alias("b"))
    fit = two_regressors(rows, ["slice"], "y", "a", "b")
    return fit.select("slice", "n", *(F.round(c, 5).alias(c) for c in ("intercept", "b1", "b2", "r2")))


def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted p-values over languages: p is the share of a tier's entities that score below a half there."""
    rows = table(spark, d, "lang_avg_per_model").filter("language_iso is not null and tier is not null and not isnan(lang_avg_ndcg)")
    p = rows.groupBy("tier", "language_iso").agg(ratio(F.count_if(F.col("lang_avg_ndcg") < 0.5), F.count("lang_avg_ndcg")).alias("p")).filter("p is not null")
    return adjusted_p(p, ["tier"], "p", "language_iso").select("tier", "language_iso", "p", "p_adjusted")


def task_rho(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's correlation of two tasks' scores over the entities that have both, for every pair of tasks in several languages."""
    s = scores(spark, d).filter(family() == "multi")
    pairs = s.select("entity", F.col("task").alias("task_a"), F.col("s").alias("a")).join(s.select("entity", F.col("task").alias("task_b"), F.col("s").alias("b")), "entity").filter("task_a < task_b")
    return spearman(pairs, ["task_a", "task_b"], "a", "b")


def score_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Pearson's correlation of global and local score per slice and tier."""
    return correlation(slices(spark, d), ["slice", "tier"], "g", "l", "r")


def gap_correlation_across_slices(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's correlation of one task's gap to the global score between two slices, over common entities."""
    local = local_scores(spark, d).join(boards(spark, d).select("entity", "slice", "g").dropna(), ["entity", "slice"]).select("task", "slice", "entity", (F.col("s") - F.col("g") * 100).alias("gap"))
    pairs = local.select("task", "entity", F.col("slice").alias("slice_a"), F.col("gap").alias("a")).join(local.select("task", "entity", F.col("slice").alias("slice_b"), F.col("gap").alias("b")), ["task", "entity"]).filter("slice_a < slice_b")
    return spearman(pairs, ["task", "slice_a", "slice_b"], "a", "b")


def inflation_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: the largest and the smallest entity, and how much the global score overstates the gain between them."""
    rows = slices(spark, d).filter("params is not null")
    ends = rows.groupBy("slice").agg(F.min_by(F.struct("entity", "g", "l"), F.struct("params", "entity")).alias("a"), F.max_by(F.struct("entity", "g", "l"), F.struct("params", "entity")).alias("b"))
    perceived, actual = (F.col("b.g") - F.col("a.g")) * 100, F.col("b.l") - F.col("a.l")
    return ends.select("slice", F.col("a.entity").alias("small"), F.col("b.entity").alias("large"), perceived.alias("perceived"), actual.alias("actual"), F.try_divide(perceived.cast("double"), actual.cast("double")).alias("inflation"))


def decision_error(spark: SparkSession, d: str) -> DataFrame:
    """Per slice and threshold: the smallest entity at or above it by global and by local score, and the ratio of their sizes."""
    rows = slices(spark, d).filter("params is not null").select("slice", "entity", "params", "g", "l", F.explode(F.array(*map(F.lit, (50, 55, 60, 65, 70, 75, 80)))).alias("t"))
    first = lambda hit: F.min(F.when(hit, F.struct("params", "entity")))
    picks = rows.groupBy("slice", F.col("t").cast("long").alias("threshold")).agg(first(F.col("g") >= F.col("t") * 100).alias("a"), first(F.col("l") >= F.col("t") * 10000).alias("b")).filter("a is not null and b is not null")
    return picks.select("slice", "threshold", F.col("a.entity").alias("by_global"), F.col("b.entity").alias("by_local"), ratio(F.col("b.params"), F.col("a.params")).alias("size_ratio"))


def pareto(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: the entities that none beats in both size and local score."""
    return pareto_front(slices(spark, d), ["slice"], "params", "l").select("slice", "entity", "params", "l")


def percentiles_interpolated(spark: SparkSession, d: str) -> DataFrame:
    """Median, 2.5th, 97.5th and 99th percentile of event values by type, interpolated between neighbours."""
    at = {f"p{n}": (F.col("n") - 1) * F.lit(q) for n, q in (("025", 0.025), ("50", 0.5), ("975", 0.975), ("99", 0.99))}
    rows = at_positions(table(spark, d, "events"), ["event_type"], "value", at)
    return rows.select("event_type", "n", *(F.round(c, 6).alias(c) for c in at))


def percentiles_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The values at positions n / 2 and 0.99 n, without interpolation, by event type."""
    n = F.col("n")
    return at_positions(table(spark, d, "events"), ["event_type"], "value", {"p50": F.floor(n / 2), "p99": F.least(n - 1, F.floor(n * 99 / 100))})


def trial_mean_std(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean, population and sample deviation, range and rate of event values by type."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_pop"), F.stddev_samp("value").alias("std_samp"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    return e.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std_pop", "std_samp")), "lowest", "highest")


def multi_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: medians, mean and distinct entities of the local score (a named summary)."""
    return slices(spark, d).groupBy("slice").agg(F.median("l").alias("median_local"), F.median("g").alias("median_global"), ratio(F.sum("l"), F.count("l")).alias("mean_local"), F.count_distinct("entity").alias("n_entities"))


def tier_mode(spark: SparkSession, d: str) -> DataFrame:
    """Per tier, the slice with the most entities; ties go to the first name."""
    counts = slices(spark, d).groupBy("tier", "slice").agg(F.count_distinct("entity").alias("n"))
    return counts.groupBy("tier").agg(F.min(F.struct(-F.col("n"), F.col("slice"))).alias("x")).select("tier", F.col("x.slice").alias("slice"), (-F.col("x.col1")).alias("n"))


def ratio_of_sums_and_mean_of_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Per language: the share of key points that stand in the answer, over all pairs at once and averaged over pairs."""
    rows = table(spark, d, "qar_pair").filter("language is not null and size(keypoints) > 0 and answer is not null").dropDuplicates(["query_id"])
    covered = rows.select("language", F.size(F.filter("keypoints", lambda k: F.contains(F.col("answer"), k))).alias("c"), F.size("keypoints").alias("n"))
    return covered.groupBy("language").agg(F.count(F.lit(1)).alias("pairs"), ratio(F.sum("c"), F.sum("n")).alias("ratio_of_sums"), F.round(F.avg(F.col("c") / F.col("n")), 6).alias("mean_of_ratios"))


def running_budget(spark: SparkSession, d: str) -> DataFrame:
    """Orders by date until their total passes a third of all, with the running total in cents."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    spent = running(orders, [], [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()], "cents", "sum", "spent")
    whole = orders.agg(F.sum("cents").alias("whole"))  # one row
    return spent.join(F.broadcast(whole), F.col("spent") * 3 <= F.col("whole")).select("o_orderkey", "cents", "spent")


def fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 100 parts in key order: first and last key and size."""
    numbered = ordinal(table(spark, d, "part").select("p_partkey"), [], [F.col("p_partkey").asc()], "k")
    return numbered.groupBy(F.floor((F.col("k") - 1) / 100).alias("batch")).agg(F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key"), F.count(F.lit(1)).alias("n"))


def customer_balance_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Least and average rank of every customer by balance among all customers."""
    rows = table(spark, d, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    return tie_ranks(rows, [], "cents").select("c_custkey", "rank_min", "rank_avg")


QUERIES = {
    f.__name__: f
    for f in (
        global_score, subset_score, consensus_local_avg, full_coverage_roster, loo_macro, inv_coverage_weighted, agg_min_median_harmonic_trimmed, borda_points, global_min, coverage_gated_score, family_profile,
        aggregator_comparison, score_gap, ols_gap, ols_two_regressors, bh_fdr, task_rho, score_correlation, gap_correlation_across_slices, inflation_anchor, decision_error, pareto, percentiles_interpolated,
        percentiles_nearest, trial_mean_std, multi_summary, tier_mode, ratio_of_sums_and_mean_of_ratios, running_budget, fixed_batches, customer_balance_ranks,
    )
}

_R = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"
_TAU = "CASE WHEN concordant + discordant + tied_y > 0 AND concordant + discordant + tied_x > 0 THEN CAST(concordant - discordant AS DOUBLE) / sqrt(CAST(concordant + discordant + tied_y AS DOUBLE) * CAST(concordant + discordant + tied_x AS DOUBLE)) END"


def _rho(keys: str, source: str) -> str:
    """SQL: Spearman's rho of columns a and b of a relation, by keys, from doubled average ranks."""
    ranks = ", ".join(f"2 * rank() OVER (PARTITION BY {keys} ORDER BY {c} DESC) + count(*) OVER (PARTITION BY {keys}, {c}) - 1 AS r{c}" for c in "ab")
    var = lambda c: f"(CAST(count(*) AS DOUBLE) * CAST(sum(r{c} * r{c}) AS DOUBLE) - CAST(sum(r{c}) AS DOUBLE) * CAST(sum(r{c}) AS DOUBLE))"
    cov = "(CAST(count(*) AS DOUBLE) * CAST(sum(ra * rb) AS DOUBLE) - CAST(sum(ra) AS DOUBLE) * CAST(sum(rb) AS DOUBLE))"
    return f"SELECT {keys}, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) >= 3 AND {var('a')} > 0 AND {var('b')} > 0 THEN {cov} / sqrt({var('a')} * {var('b')}) END AS rho FROM (SELECT {keys}, {ranks} FROM {source}) GROUP BY {keys}"


_LOO = "loo AS (SELECT entity, slice, l, g, CAST(sum(l) OVER w AS DOUBLE) / CAST(count(l) OVER w AS DOUBLE) AS macro, CASE WHEN count(l) OVER w > 1 THEN CAST(sum(l) OVER w - l AS DOUBLE) / CAST(count(l) OVER w - 1 AS DOUBLE) END AS loo FROM slices WINDOW w AS (PARTITION BY entity))"

ORACLE = {
    "global_score": f"WITH {SCORES} SELECT entity, CAST(count(s) AS BIGINT) AS n_tasks, {_R('sum(s)', 'count(s)')} AS score FROM scores GROUP BY entity",
    "subset_score": f"WITH {SCORES} SELECT entity, CAST(count(s) AS BIGINT) AS n_tasks, {_R('sum(s)', 'count(s)')} AS score FROM scores WHERE {FAMILY} = 'multi' GROUP BY entity",
    "consensus_local_avg": f"""WITH {LOCAL}, present AS (SELECT slice, count(DISTINCT entity) AS n_any FROM local_scores GROUP BY slice),
        kept AS (SELECT slice, task, count(*) >= greatest(1, ceil(any_value(n_any) * 0.5)) AS kept FROM local_scores JOIN present USING (slice) GROUP BY slice, task),
        used AS (SELECT slice, task FROM kept k WHERE kept OR NOT (SELECT bool_or(kept) FROM kept x WHERE x.slice = k.slice)), needed AS (SELECT slice, count(*) AS n_consensus FROM used GROUP BY slice),
        sums AS (SELECT slice, entity, count(*) AS n, sum(s) AS t FROM local_scores JOIN used USING (slice, task) GROUP BY slice, entity)
        SELECT slice, entity, CAST(n_consensus AS BIGINT) AS n_consensus, CAST(t AS DOUBLE) / CAST(n AS DOUBLE) AS score FROM sums JOIN needed USING (slice) WHERE n = n_consensus""",
    "full_coverage_roster": f"WITH {SCORES}, m AS (SELECT * FROM scores WHERE {FAMILY} = 'multi') SELECT entity, CAST(count(DISTINCT task) AS BIGINT) AS n_tasks FROM m GROUP BY entity HAVING count(DISTINCT task) = (SELECT count(DISTINCT task) FROM m)",
    "loo_macro": f"WITH {SLICES}, {_LOO} SELECT entity, slice, macro, loo FROM loo",
    "inv_coverage_weighted": f"WITH {SCORES}, w AS (SELECT task, CAST(1 AS DOUBLE) / count(*) AS w FROM scores GROUP BY task) SELECT entity, round(sum(w * s) / sum(w), 4) AS score FROM scores JOIN w USING (task) GROUP BY entity",
    "agg_min_median_harmonic_trimmed": f"""WITH {SCORES}, x AS (SELECT entity, list_sort(list(s)) AS v, count(*) AS n, CAST(floor(count(*) * CAST(0.1 AS DOUBLE)) AS BIGINT) AS k FROM scores WHERE entity IN (SELECT entity FROM scores WHERE {FAMILY} = 'multi' GROUP BY entity HAVING count(DISTINCT task) = (SELECT count(DISTINCT task) FROM scores WHERE {FAMILY} = 'multi')) GROUP BY entity)
        SELECT entity, CAST(n AS BIGINT) AS n, round(CAST(list_sum(v) AS DOUBLE) / n, 4) AS mean, CAST(v[1] AS DOUBLE) AS lowest, round((v[CAST(floor((n + 1) / 2) AS BIGINT)] + v[CAST(floor(n / 2) AS BIGINT) + 1]) / CAST(2 AS DOUBLE), 4) AS median,
        round(n / list_sum(list_transform(v, lambda y: 1 / greatest(CAST(y AS DOUBLE), CAST(0.000001 AS DOUBLE)))), 4) AS harmonic, round(CAST(list_sum(v[k + 1 : n - k]) AS DOUBLE) / (n - 2 * k), 4) AS trimmed FROM x""",
    "borda_points": f"""WITH {SCORES}, m AS (SELECT * FROM scores WHERE {FAMILY} = 'multi'), roster AS (SELECT entity FROM m GROUP BY entity HAVING count(DISTINCT task) = (SELECT count(DISTINCT task) FROM m)), r AS (SELECT * FROM m WHERE entity IN (FROM roster)),
        ranked AS (SELECT entity, (SELECT count(*) FROM roster) - (rank() OVER (PARTITION BY task ORDER BY s DESC) + (count(*) OVER (PARTITION BY task, s) - 1) / CAST(2 AS DOUBLE)) AS p FROM r) SELECT entity, sum(p) AS points FROM ranked GROUP BY entity""",
    "global_min": f"WITH {LOCAL} SELECT entity, min(s) AS lowest FROM local_scores GROUP BY entity",
    "coverage_gated_score": f"WITH {SCORES} SELECT entity, CAST(count(s) AS BIGINT) AS n, count(s) / CAST(20 AS DOUBLE) AS coverage, CASE WHEN count(s) / CAST(20 AS DOUBLE) >= 0.5 THEN {_R('sum(s)', 'count(s)')} END AS score FROM scores GROUP BY entity",
    "family_profile": f"""WITH {SCORES}, x AS (SELECT entity, sum(s) FILTER ({FAMILY} = 'single') AS ts, count(s) FILTER ({FAMILY} = 'single') AS ns, sum(s) FILTER ({FAMILY} = 'multi') AS tm, count(s) FILTER ({FAMILY} = 'multi') AS nm FROM scores GROUP BY entity)
        SELECT entity, CAST(ns AS BIGINT) AS n_single, CAST(nm AS BIGINT) AS n_multi, {_R('ts', 'ns')} AS single, {_R('tm', 'nm')} AS multi, {_R('ts', 'ns')} - {_R('tm', 'nm')} AS delta FROM x WHERE ns > 0 AND nm > 0""",
    "aggregator_comparison": f"""WITH {SLICES}, {_LOO}, long AS (SELECT 'global' AS aggregator, slice, entity, l, CAST(g AS DOUBLE) AS x FROM loo UNION ALL SELECT 'macro', slice, entity, l, macro FROM loo UNION ALL SELECT 'loo', slice, entity, l, loo FROM loo WHERE loo IS NOT NULL),
        gp AS (SELECT a.aggregator, a.slice, CASE WHEN a.x > b.x THEN 1 WHEN a.x < b.x THEN -1 ELSE 0 END AS sx, sign(a.l - b.l) AS sy FROM long a JOIN long b ON a.aggregator = b.aggregator AND a.slice = b.slice AND a.entity < b.entity),
        gc AS (SELECT aggregator, slice, count(*) FILTER (sx * sy > 0) AS concordant, count(*) FILTER (sx * sy < 0) AS discordant, count(*) FILTER (sx = 0 AND sy <> 0) AS tied_x, count(*) FILTER (sx <> 0 AND sy = 0) AS tied_y FROM gp GROUP BY ALL)
        SELECT aggregator, slice, n, {_TAU} AS tau_b, {_R('discordant', 'concordant + discordant')} AS inversion_rate FROM gc JOIN (SELECT aggregator, slice, CAST(count(*) AS BIGINT) AS n FROM long GROUP BY ALL) USING (aggregator, slice)""",
    "score_gap": f"WITH {BOARDS} SELECT entity, slice, l - g * 100 AS gap, CASE WHEN g <> 0 THEN CAST(l - g * 100 AS DOUBLE) * 100 / CAST(g * 100 AS DOUBLE) END AS gap_pct FROM boards",
    "ols_gap": f"""WITH {SLICES}, x AS (SELECT slice, (l - g * 100) / CAST(10000 AS DOUBLE) AS y, log10(CAST(params AS DOUBLE)) AS x FROM slices WHERE params IS NOT NULL)
        SELECT slice, CAST(count(*) AS BIGINT) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM x GROUP BY slice HAVING count(*) >= 3""",
    "ols_two_regressors": f"""WITH {SLICES}, x AS (SELECT slice, l / CAST(10000 AS DOUBLE) AS y, log10(CAST(params AS DOUBLE)) AS a, log2(CAST(dim AS DOUBLE)) AS b FROM slices WHERE params IS NOT NULL AND dim IS NOT NULL),
        s AS (SELECT slice, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) AS saa, covar_pop(b, b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby, covar_pop(y, y) AS syy FROM x GROUP BY slice),
        f AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS b1, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS b2 FROM s WHERE n >= 4 AND saa * sbb - sab * sab <> 0)
        SELECT slice, CAST(n AS BIGINT) AS n, round(my - b1 * ma - b2 * mb, 5) AS intercept, round(b1, 5) AS b1, round(b2, 5) AS b2, round((b1 * say + b2 * sby) / syy, 5) AS r2 FROM f""",
    "bh_fdr": """WITH x AS (SELECT tier, language_iso, CAST(count(*) FILTER (lang_avg_ndcg < 0.5) AS DOUBLE) / CAST(count(lang_avg_ndcg) AS DOUBLE) AS p FROM lang_avg_per_model WHERE language_iso IS NOT NULL AND tier IS NOT NULL AND NOT isnan(lang_avg_ndcg) GROUP BY ALL HAVING count(lang_avg_ndcg) > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY p, language_iso) AS k, count(*) OVER (PARTITION BY tier) AS n FROM x)
        SELECT tier, language_iso, p, least(CAST(1 AS DOUBLE), min(p * n / k) OVER (PARTITION BY tier ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS p_adjusted FROM r""",
    "task_rho": f"WITH {SCORES}, m AS (SELECT * FROM scores WHERE {FAMILY} = 'multi'), pairs AS (SELECT x.task AS task_a, y.task AS task_b, x.s AS a, y.s AS b FROM m x JOIN m y ON x.entity = y.entity AND x.task < y.task) {_rho('task_a, task_b', 'pairs')}",
    "score_correlation": f"""WITH {SLICES}, x AS (SELECT slice, tier, CAST(count(*) AS DOUBLE) AS n, CAST(sum(g) AS DOUBLE) AS sx, CAST(sum(l) AS DOUBLE) AS sy, CAST(sum(g * l) AS DOUBLE) AS sxy, CAST(sum(g * g) AS DOUBLE) AS sxx, CAST(sum(l * l) AS DOUBLE) AS syy FROM slices GROUP BY ALL)
        SELECT slice, tier, CAST(n AS BIGINT) AS n, CASE WHEN n >= 3 AND n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END AS r FROM x""",
    "gap_correlation_across_slices": f"""WITH {BOARDS}, {LOCAL}, gaps AS (SELECT task, slice, entity, s - g * 100 AS gap FROM local_scores JOIN boards USING (entity, slice) WHERE g IS NOT NULL),
        pairs AS (SELECT x.task, x.slice AS slice_a, y.slice AS slice_b, x.gap AS a, y.gap AS b FROM gaps x JOIN gaps y ON x.task = y.task AND x.entity = y.entity AND x.slice < y.slice) {_rho('task, slice_a, slice_b', 'pairs')}""",
    "inflation_anchor": f"""WITH {SLICES}, r AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY params, entity) AS lo, row_number() OVER (PARTITION BY slice ORDER BY params DESC, entity DESC) AS hi FROM slices WHERE params IS NOT NULL)
        SELECT a.slice, a.entity AS small, b.entity AS large, (b.g - a.g) * 100 AS perceived, b.l - a.l AS actual, CASE WHEN b.l <> a.l THEN CAST((b.g - a.g) * 100 AS DOUBLE) / CAST(b.l - a.l AS DOUBLE) END AS inflation FROM r a JOIN r b ON a.slice = b.slice AND a.lo = 1 AND b.hi = 1""",
    "decision_error": f"""WITH {SLICES}, t AS (SELECT * FROM slices, (VALUES (50), (55), (60), (65), (70), (75), (80)) v(t) WHERE params IS NOT NULL),
        a AS (SELECT slice, t, entity, params FROM (SELECT *, row_number() OVER (PARTITION BY slice, t ORDER BY params, entity) AS k FROM t WHERE g >= t * 100) WHERE k = 1), b AS (SELECT slice, t, entity, params FROM (SELECT *, row_number() OVER (PARTITION BY slice, t ORDER BY params, entity) AS k FROM t WHERE l >= t * 10000) WHERE k = 1)
        SELECT a.slice, CAST(a.t AS BIGINT) AS threshold, a.entity AS by_global, b.entity AS by_local, CAST(b.params AS DOUBLE) / CAST(a.params AS DOUBLE) AS size_ratio FROM a JOIN b ON a.slice = b.slice AND a.t = b.t""",
    "pareto": f"WITH {SLICES}, r AS (SELECT * FROM slices WHERE params IS NOT NULL) SELECT slice, entity, params, l FROM r WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.slice = r.slice AND x.params <= r.params AND x.l >= r.l AND (x.params < r.params OR x.l > r.l))",
    "percentiles_interpolated": """SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(quantile_cont(value, CAST(0.025 AS DOUBLE)), 6) AS p025, round(quantile_cont(value, CAST(0.5 AS DOUBLE)), 6) AS p50, round(quantile_cont(value, CAST(0.975 AS DOUBLE)), 6) AS p975, round(quantile_cont(value, CAST(0.99 AS DOUBLE)), 6) AS p99 FROM events GROUP BY event_type""",
    "percentiles_nearest": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, n, max(CASE WHEN k = n // 2 THEN value END) AS p50, max(CASE WHEN k = least(n - 1, n * 99 // 100) THEN value END) AS p99 FROM r GROUP BY event_type, n""",
    "trial_mean_std": "SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_pop, round(stddev_samp(value), 6) AS std_samp, min(value) AS lowest, max(value) AS highest FROM events GROUP BY event_type",
    "multi_summary": f"WITH {SLICES} SELECT slice, CAST(median(l) AS DOUBLE) AS median_local, CAST(median(g) AS DOUBLE) AS median_global, {_R('sum(l)', 'count(l)')} AS mean_local, CAST(count(DISTINCT entity) AS BIGINT) AS n_entities FROM slices GROUP BY slice",
    "tier_mode": f"WITH {SLICES}, c AS (SELECT tier, slice, CAST(count(DISTINCT entity) AS BIGINT) AS n FROM slices GROUP BY ALL) SELECT tier, slice, n FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY n DESC, slice) AS k FROM c) WHERE k = 1",
    "ratio_of_sums_and_mean_of_ratios": """WITH r AS (SELECT DISTINCT ON (query_id) language, answer, keypoints FROM qar_pair WHERE language IS NOT NULL AND len(keypoints) > 0 AND answer IS NOT NULL), c AS (SELECT language, len(list_filter(keypoints, lambda k: contains(answer, k))) AS c, len(keypoints) AS n FROM r)
        SELECT language, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(c) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS ratio_of_sums, round(avg(CAST(c AS DOUBLE) / n), 6) AS mean_of_ratios FROM c GROUP BY language""",
    "running_budget": """WITH o AS (SELECT o_orderkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders), s AS (SELECT o_orderkey, cents, CAST(sum(cents) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM o)
        SELECT * FROM s WHERE spent * 3 <= (SELECT sum(cents) FROM o)""",
    "fixed_batches": "SELECT CAST((k - 1) // 100 AS BIGINT) AS batch, min(p_partkey) AS first_key, max(p_partkey) AS last_key, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS k FROM part) GROUP BY 1",
    "customer_balance_ranks": "WITH c AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer) SELECT c_custkey, rank() OVER (ORDER BY cents DESC) AS rank_min, rank() OVER (ORDER BY cents DESC) + (count(*) OVER (PARTITION BY cents) - 1) / CAST(2 AS DOUBLE) AS rank_avg FROM c",
}
