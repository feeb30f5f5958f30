"""Ranks, agreement of global and local order, regret and hidden failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tausift.operators.agreement import gamma, inversion_rates, pair_counts, tau_b
from tausift.operators.order import ordinal, tie_ranks
from tausift.operators.scores import ratio
from tausift.operators.stats import spearman
from tausift.plans.base import SLICES, boards, slices
from tausift.runtime import small, table

PAIR_SQL = f"""{SLICES}, pairs AS (SELECT a.slice, sign(a.g - b.g) * sign(a.l - b.l) AS p, sign(a.g - b.g) AS sx, sign(a.l - b.l) AS sy
    FROM slices a JOIN slices b ON a.slice = b.slice AND a.entity < b.entity),
counts AS (SELECT slice, CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (p > 0) AS BIGINT) AS concordant, CAST(count(*) FILTER (p < 0) AS BIGINT) AS discordant,
    CAST(count(*) FILTER (sx = 0 AND sy <> 0) AS BIGINT) AS tied_x, CAST(count(*) FILTER (sx <> 0 AND sy = 0) AS BIGINT) AS tied_y, CAST(count(*) FILTER (sx = 0 AND sy = 0) AS BIGINT) AS tied_both,
    CAST(count(*) FILTER ((sx > 0) <> (sy > 0)) AS BIGINT) AS oriented FROM pairs GROUP BY slice)"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return pair_counts(slices(spark, d), ["slice"], "g", "l")


def rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: pairs of entities by agreement of the global and the local score, Kendall's tau-b, gamma, inversion rate."""
    rates = inversion_rates()
    return _counts(spark, d).filter("pairs > 0").select("slice", "pairs", "concordant", "discordant", "tied_x", "tied_y", "tied_both", tau_b().alias("tau_b"), gamma().alias("gamma"), rates["skip"].alias("inversion_rate"))


def inversion_policies(spark: SparkSession, d: str) -> DataFrame:
    """Per slice and tie convention: the inversion rate."""
    wide = pair_counts(slices(spark, d), ["slice"], "g", "l", "entity").filter("pairs > 0").select("slice", *(c.alias(n) for n, c in inversion_rates().items()))
    return wide.unpivot(["slice"], list(inversion_rates()), "policy", "rate")


def supplier_rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Per order priority: agreement of suppliers' discount over all orders and over orders of that priority."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("entity"), F.round(F.col("l_discount") * 100).cast("long").alias("v"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("slice"))
    cells = lines.join(orders, "l_orderkey").groupBy("entity", "slice").agg(F.sum("v").alias("t"), F.count(F.lit(1)).alias("n"))
    overall = cells.groupBy("entity").agg(ratio(F.sum("t"), F.sum("n")).alias("g"))
    both = cells.select("entity", "slice", ratio(F.col("t"), F.col("n")).alias("l")).join(overall, "entity")
    counted = pair_counts(both, ["slice"], "g", "l")
    return counted.select("slice", "n", "pairs", "concordant", "discordant", tau_b().alias("tau_b"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    both = tie_ranks(slices(spark, d), ["slice"], "g", "g_min", "g_avg")
    return tie_ranks(both, ["slice"], "l", "l_min", "l_avg")


def rank_min(spark: SparkSession, d: str) -> DataFrame:
    """Least ranks among ties by global and local score, per slice."""
    return _ranked(spark, d).select("slice", "entity", "g_min", "l_min")


def rank_avg(spark: SparkSession, d: str) -> DataFrame:
    """Average ranks among ties by global and local score, per slice."""
    return _ranked(spark, d).select("slice", "entity", "g_avg", "l_avg")


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    first = ordinal(slices(spark, d), ["slice"], [F.col("g").desc(), F.col("entity").asc()], "g_rank")
    return ordinal(first, ["slice"], [F.col("l").desc(), F.col("entity").asc()], "l_rank")


def rank_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Positions by global and local score, ties by name, per slice."""
    return _ordered(spark, d).select("slice", "entity", "g_rank", "l_rank")


def spearman_by_slice(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's correlation of global and local score per slice."""
    return spearman(slices(spark, d), ["slice"], "g", "l")


KS = (1, 3, 5)


def topk_regret(spark: SparkSession, d: str) -> DataFrame:
    """Per slice and k: what is lost locally by choosing among the k best by global score.

    regret_max: the best local score less the best among the chosen. regret_mean: the mean local score of the k best by
    local score less that of the chosen. expected_loss: the best local score less the mean of the chosen.
    """
    ranked = _ordered(spark, d)
    grid = ranked.select("slice", "l", "g_rank", "l_rank", F.explode(F.array(*map(F.lit, KS))).alias("k"))
    chosen, best = F.col("g_rank") <= F.col("k"), F.col("l_rank") <= F.col("k")
    sums = grid.groupBy("slice", F.col("k").cast("long").alias("k")).agg(
        F.max("l").alias("top"), F.max(F.when(chosen, F.col("l"))).alias("mx"), F.sum(F.when(chosen, F.col("l"))).alias("st"), F.count(F.when(chosen, 1)).alias("n"), F.sum(F.when(best, F.col("l"))).alias("sb"), F.count(F.when(best, 1)).alias("nb")
    )
    return sums.select("slice", "k", (F.col("top") - F.col("mx")).alias("regret_max"), (ratio(F.col("sb"), F.col("nb")) - ratio(F.col("st"), F.col("n"))).alias("regret_mean"), (F.col("top").cast("double") - ratio(F.col("st"), F.col("n"))).alias("expected_loss"))


def top1_loss(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: the first entity by global and by local score, and the local score between them."""
    ranked = _ordered(spark, d)
    first = ranked.groupBy("slice").agg(F.max(F.when(F.col("g_rank") == 1, F.struct("entity", "l"))).alias("g"), F.max(F.when(F.col("l_rank") == 1, F.struct("entity", "l"))).alias("b"))
    return first.select("slice", F.col("g.entity").alias("picked"), F.col("b.entity").alias("best"), (F.col("b.l") - F.col("g.l")).alias("loss"))


def rank_drop_notable(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose least ranks by global and local score lie four or more apart."""
    drop = _ranked(spark, d).withColumn("rank_drop", F.col("l_min") - F.col("g_min"))
    return drop.filter(F.abs("rank_drop") >= 4).select("slice", "entity", "g_min", "l_min", "rank_drop")


def _tier_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Entities of a tier, globally ranked among all of the tier that have a global score, locally within the slice."""
    everyone = slices(spark, d)
    overall = everyone.select("tier", "entity", "g").groupBy("tier", "entity").agg(F.max("g").alias("g"))
    ranked = tie_ranks(overall, ["tier"], "g", "global_rank", "ga").drop("ga", "g")
    sizes = overall.groupBy("tier").agg(F.count(F.lit(1)).alias("n_global"))
    local = tie_ranks(everyone, ["tier", "slice"], "l", "local_rank", "la").drop("la")
    local_sizes = everyone.groupBy("tier", "slice").agg(F.count(F.lit(1)).alias("n_local"))
    return local.join(ranked, ["tier", "entity"]).join(sizes, "tier").join(local_sizes, ["tier", "slice"])


def hidden_failures_tier(spark: SparkSession, d: str) -> DataFrame:
    """Entities in the better half of their tier globally and in the worst quarter of a slice."""
    hit = _tier_ranks(spark, d).filter("global_rank <= 0.5 * n_global and local_rank > 0.75 * n_local")
    return hit.select("tier", "slice", "entity", "global_rank", "local_rank", (F.col("local_rank") - F.col("global_rank")).alias("rank_drop"))


def hidden_failure_grid(spark: SparkSession, d: str) -> DataFrame:
    """For nine pairs of thresholds: failing cells, entities that fail anywhere, entities that fail in two slices or more.

    Ordinal ranks: global within the slice up to ceil(a * n), local from ceil((1 - b) * n) on.
    """
    ranked = _ordered(spark, d)
    sized = ranked.join(ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("n")), "slice")
    grid = sized.select("*", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (40, 50, 60) for b in (20, 25, 30)))).alias("t"))
    fails = (F.col("g_rank") <= F.ceil(F.col("t.a") * F.col("n") / 100)) & (F.col("l_rank") >= F.ceil((100 - F.col("t.b")) * F.col("n") / 100))
    cells = grid.groupBy(F.col("t.a").cast("long").alias("top_pct"), F.col("t.b").cast("long").alias("bottom_pct"), "entity").agg(F.count_if(fails).alias("c"))
    return cells.groupBy("top_pct", "bottom_pct").agg(F.sum("c").alias("n_cells"), F.count_if(F.col("c") > 0).alias("n_entities"), F.count_if(F.col("c") >= 2).alias("n_clustered"))


def hidden_failures_absolute(spark: SparkSession, d: str) -> DataFrame:
    """For five local limits: entities above 75 globally and below the limit in a slice."""
    limits = F.explode(F.array(*map(F.lit, (45, 50, 55, 60, 65)))).alias("limit")
    hit = slices(spark, d).filter("g > 7500").select("slice", "entity", "l", limits).filter(F.col("l") < F.col("limit") * 10000)
    return hit.groupBy(F.col("limit").cast("long").alias("local_limit")).agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct("entity").alias("n_entities"), F.array_join(F.array_sort(F.collect_set("slice")), ";").alias("slices"))


def failure_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Entities that fail in a slice: best global rank, median local rank, slices affected, and their largest drop."""
    fails = hidden_failures_tier(spark, d)
    return fails.groupBy("entity").agg(F.min("global_rank").alias("best_global_rank"), F.median("local_rank").alias("median_local_rank"), F.count_distinct("slice").alias("n_slices"), F.max("rank_drop").alias("worst_drop"))


def entity_trace(spark: SparkSession, d: str) -> DataFrame:
    """Every entity in every slice: its ranks, or why it has none."""
    everything = table(spark, d, "unified_results").filter("short_name is not null and language is not null")
    entities, languages = everything.select(F.col("short_name").alias("entity")).distinct(), everything.select(F.col("language").alias("slice")).distinct()
    # the product is the result: a row per entity and language; languages are broadcast if they are few
    full = entities.crossJoin(small(languages))
    state = boards(spark, d).select("entity", "slice", "g", "l")
    traced = full.join(state, ["entity", "slice"], "left").join(_ranked(spark, d).select("entity", "slice", "g_min", "l_min"), ["entity", "slice"], "left")
    reason = F.when(F.col("l_min").isNotNull(), "ranked").when(F.col("l").isNotNull(), "no global score").when(F.col("g").isNotNull(), "no local score").otherwise("not in slice")
    return traced.select("entity", "slice", "g_min", "l_min", reason.alias("status"))


def slice_audit_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row per slice with four entities or more: sizes, tau-b, inversion rate, Spearman, top-1 loss, regret at 3 and 5."""
    regret = topk_regret(spark, d).groupBy("slice").agg(F.max(F.when(F.col("k") == 3, F.col("regret_max"))).alias("regret_3"), F.max(F.when(F.col("k") == 5, F.col("regret_max"))).alias("regret_5"))
    counts = _counts(spark, d).filter("n >= 4").select("slice", "n", tau_b().alias("tau_b"), inversion_rates()["skip"].alias("inversion_rate"))
    return counts.join(spearman_by_slice(spark, d).select("slice", "rho"), "slice").join(top1_loss(spark, d).select("slice", "loss"), "slice").join(regret, "slice")


def tier_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Per tier and slice: tau-b and inversion rate; and a row `MEDIAN` per tier."""
    counts = pair_counts(slices(spark, d), ["tier", "slice"], "g", "l").filter("n >= 3")
    detail = counts.select("tier", "slice", "n", tau_b().alias("tau_b"), inversion_rates()["skip"].alias("inversion_rate"))
    medians = detail.groupBy("tier").agg(F.median("tau_b").alias("tau_b"), F.median("inversion_rate").alias("inversion_rate"), F.floor(F.median("n")).alias("n")).select("tier", F.lit("MEDIAN").alias("slice"), "n", "tau_b", "inversion_rate")
    return detail.unionByName(medians)


def rank_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Per slice and size band: entities above, on and below the diagonal of global and local rank."""
    millions = F.col("params") / 1e6
    band = F.when(millions.isNull(), -1).when(millions < 300, 0).when(millions < 1000, 1).when(millions < 8000, 2).otherwise(3)
    ranked = _ranked(spark, d)
    up, down = F.col("l_min") < F.col("g_min"), F.col("l_min") > F.col("g_min")
    return ranked.groupBy("slice", band.cast("long").alias("band")).agg(F.count_if(up).alias("above"), F.count_if(~up & ~down).alias("diagonal"), F.count_if(down).alias("below"))


def slice_asymmetry(spark: SparkSession, d: str) -> DataFrame:
    """Per tier and band of tasks per row: slices and mean and median inversion rate of the cells."""
    rows = table(spark, d, "unified_results").filter("short_name is not null and language is not null")
    bands = rows.groupBy(F.col("short_name").alias("entity"), F.col("language").alias("slice")).agg(F.max("n_tasks").alias("t"))
    banded = slices(spark, d).join(bands, ["entity", "slice"]).withColumn("band", F.when(F.col("t") <= 2, "2").when(F.col("t") == 3, "3").otherwise("4+"))
    counts = pair_counts(banded, ["tier", "band", "slice"], "g", "l").withColumn("rate", inversion_rates()["skip"]).filter("rate is not null")
    return counts.groupBy("tier", "band").agg(F.count(F.lit(1)).alias("n_slices"), F.round(F.avg("rate"), 6).alias("mean_rate"), F.median("rate").alias("median_rate"))


QUERIES = {
    f.__name__: f
    for f in (
        rank_agreement, inversion_policies, supplier_rank_agreement, rank_min, rank_avg, rank_ordinal, spearman_by_slice, topk_regret, top1_loss, rank_drop_notable, hidden_failures_tier, hidden_failure_grid,
        hidden_failures_absolute, failure_cluster, entity_trace, slice_audit_summary, tier_sensitivity, rank_scatter, slice_asymmetry,
    )
}

_RANKED = f"""{SLICES}, ranked AS (SELECT *, rank() OVER (PARTITION BY slice ORDER BY g DESC) AS g_min, rank() OVER (PARTITION BY slice ORDER BY l DESC) AS l_min,
    count(*) OVER (PARTITION BY slice, g) AS cg, count(*) OVER (PARTITION BY slice, l) AS cl,
    row_number() OVER (PARTITION BY slice ORDER BY g DESC, entity) AS g_rank, row_number() OVER (PARTITION BY slice ORDER BY l DESC, entity) AS l_rank, count(*) OVER (PARTITION BY slice) AS n FROM slices)"""
_TAU = "CASE WHEN concordant + discordant + tied_y > 0 AND concordant + discordant + tied_x > 0 THEN CAST(concordant - discordant AS DOUBLE) / sqrt(CAST(concordant + discordant + tied_y AS DOUBLE) * CAST(concordant + discordant + tied_x AS DOUBLE)) END"
_SKIP = "CASE WHEN concordant + discordant > 0 THEN CAST(discordant AS DOUBLE) / CAST(concordant + discordant AS DOUBLE) END"
_RHO = """rho AS (SELECT slice, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) >= 3 AND (count(*) * sum(a * a) - sum(a) * sum(a)) > 0 AND (count(*) * sum(b * b) - sum(b) * sum(b)) > 0 THEN
    (CAST(count(*) AS DOUBLE) * CAST(sum(a * b) AS DOUBLE) - CAST(sum(a) AS DOUBLE) * CAST(sum(b) AS DOUBLE)) / sqrt((CAST(count(*) AS DOUBLE) * CAST(sum(a * a) AS DOUBLE) - CAST(sum(a) AS DOUBLE) * CAST(sum(a) AS DOUBLE)) * (CAST(count(*) AS DOUBLE) * CAST(sum(b * b) AS DOUBLE) - CAST(sum(b) AS DOUBLE) * CAST(sum(b) AS DOUBLE))) END AS rho
    FROM (SELECT slice, 2 * g_min + cg - 1 AS a, 2 * l_min + cl - 1 AS b FROM ranked) GROUP BY slice)"""
_REGRET = """regret AS (SELECT slice, CAST(k AS BIGINT) AS k, max(l) - max(CASE WHEN g_rank <= k THEN l END) AS regret_max,
    CAST(sum(CASE WHEN l_rank <= k THEN l END) AS DOUBLE) / CAST(count(CASE WHEN l_rank <= k THEN 1 END) AS DOUBLE) - CAST(sum(CASE WHEN g_rank <= k THEN l END) AS DOUBLE) / CAST(count(CASE WHEN g_rank <= k THEN 1 END) AS DOUBLE) AS regret_mean,
    CAST(max(l) AS DOUBLE) - CAST(sum(CASE WHEN g_rank <= k THEN l END) AS DOUBLE) / CAST(count(CASE WHEN g_rank <= k THEN 1 END) AS DOUBLE) AS expected_loss
    FROM ranked, (VALUES (1), (3), (5)) ks(k) GROUP BY slice, k)"""
_TOP1 = """top1 AS (SELECT a.slice, a.entity AS picked, b.entity AS best, b.l - a.l AS loss FROM ranked a JOIN ranked b ON a.slice = b.slice AND a.g_rank = 1 AND b.l_rank = 1)"""
_TIERS = f"""{SLICES}, overall AS (SELECT tier, entity, max(g) AS g FROM slices GROUP BY ALL),
    global_ranks AS (SELECT tier, entity, rank() OVER (PARTITION BY tier ORDER BY g DESC) AS global_rank, count(*) OVER (PARTITION BY tier) AS n_global FROM overall),
    local_ranks AS (SELECT tier, slice, entity, rank() OVER (PARTITION BY tier, slice ORDER BY l DESC) AS local_rank, count(*) OVER (PARTITION BY tier, slice) AS n_local FROM slices),
    failures AS (SELECT tier, slice, entity, global_rank, local_rank, local_rank - global_rank AS rank_drop FROM local_ranks JOIN global_ranks USING (tier, entity) WHERE global_rank <= 0.5 * n_global AND local_rank > 0.75 * n_local)"""


def _grouped_pairs(keys: str, source: str) -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""gp AS (SELECT {cols}, sign(a.g - b.g) AS sx, sign(a.l - b.l) AS sy FROM {source} a JOIN {source} b ON {on} AND a.entity < b.entity),
    gc AS (SELECT {keys}, count(*) FILTER (sx * sy > 0) AS concordant, count(*) FILTER (sx * sy < 0) AS discordant, count(*) FILTER (sx = 0 AND sy <> 0) AS tied_x, count(*) FILTER (sx <> 0 AND sy = 0) AS tied_y FROM gp GROUP BY {keys})"""


ORACLE = {
    "rank_agreement": f"WITH {PAIR_SQL} SELECT slice, pairs, concordant, discordant, tied_x, tied_y, tied_both, {_TAU} AS tau_b, CASE WHEN concordant + discordant > 0 THEN CAST(concordant - discordant AS DOUBLE) / CAST(concordant + discordant AS DOUBLE) END AS gamma, {_SKIP} AS inversion_rate FROM counts",
    "inversion_policies": f"""WITH {PAIR_SQL}, wide AS (SELECT slice, CAST(oriented AS DOUBLE) / CAST(pairs AS DOUBLE) AS strict, {_SKIP} AS skip, CAST(discordant AS DOUBLE) / CAST(pairs AS DOUBLE) AS skip_full,
        (CAST(discordant AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(tied_x + tied_y + tied_both AS DOUBLE)) / CAST(pairs AS DOUBLE) AS half, (CAST(discordant AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(tied_x + tied_y AS DOUBLE)) / CAST(pairs AS DOUBLE) AS half_xor FROM counts)
        SELECT slice, policy, rate FROM wide UNPIVOT INCLUDE NULLS (rate FOR policy IN (strict, skip, skip_full, half, half_xor))""",
    "supplier_rank_agreement": f"""WITH cells AS (SELECT l_suppkey AS entity, o_orderpriority AS slice, sum(CAST(round(l_discount * 100) AS BIGINT)) AS t, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
        overall AS (SELECT entity, CAST(sum(t) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS g FROM cells GROUP BY entity),
        x AS (SELECT entity, slice, CAST(t AS DOUBLE) / CAST(n AS DOUBLE) AS l, g FROM cells JOIN overall USING (entity)),
        gp AS (SELECT a.slice, CASE WHEN a.g > b.g THEN 1 WHEN a.g < b.g THEN -1 ELSE 0 END AS sx, CASE WHEN a.l > b.l THEN 1 WHEN a.l < b.l THEN -1 ELSE 0 END AS sy FROM x a JOIN x b ON a.slice = b.slice AND a.entity < b.entity),
        gc AS (SELECT slice, CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (sx * sy > 0) AS BIGINT) AS concordant, CAST(count(*) FILTER (sx * sy < 0) AS BIGINT) AS discordant, count(*) FILTER (sx = 0 AND sy <> 0) AS tied_x, count(*) FILTER (sx <> 0 AND sy = 0) AS tied_y FROM gp GROUP BY slice)
        SELECT slice, n, pairs, concordant, discordant, {_TAU} AS tau_b FROM gc JOIN (SELECT slice, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY slice) USING (slice)""",
    "rank_min": f"WITH {_RANKED} SELECT slice, entity, g_min, l_min FROM ranked",
    "rank_avg": f"WITH {_RANKED} SELECT slice, entity, g_min + (cg - 1) / CAST(2 AS DOUBLE) AS g_avg, l_min + (cl - 1) / CAST(2 AS DOUBLE) AS l_avg FROM ranked",
    "rank_ordinal": f"WITH {_RANKED} SELECT slice, entity, g_rank, l_rank FROM ranked",
    "spearman_by_slice": f"WITH {_RANKED}, {_RHO} SELECT slice, n, rho FROM rho",
    "topk_regret": f"WITH {_RANKED}, {_REGRET} SELECT * FROM regret",
    "top1_loss": f"WITH {_RANKED}, {_TOP1} SELECT * FROM top1",
    "rank_drop_notable": f"WITH {_RANKED} SELECT slice, entity, g_min, l_min, l_min - g_min AS rank_drop FROM ranked WHERE abs(l_min - g_min) >= 4",
    "hidden_failures_tier": f"WITH {_TIERS} SELECT * FROM failures",
    "hidden_failure_grid": f"""WITH {_RANKED}, cells AS (SELECT a, b, entity, count(*) FILTER (g_rank <= ceil(a * n / CAST(100 AS DOUBLE)) AND l_rank >= ceil((100 - b) * n / CAST(100 AS DOUBLE))) AS c FROM ranked, (VALUES (40), (50), (60)) x(a), (VALUES (20), (25), (30)) y(b) GROUP BY a, b, entity)
        SELECT CAST(a AS BIGINT) AS top_pct, CAST(b AS BIGINT) AS bottom_pct, CAST(sum(c) AS BIGINT) AS n_cells, CAST(count(*) FILTER (c > 0) AS BIGINT) AS n_entities, CAST(count(*) FILTER (c >= 2) AS BIGINT) AS n_clustered FROM cells GROUP BY a, b""",
    "hidden_failures_absolute": f"""WITH {SLICES} SELECT CAST(t AS BIGINT) AS local_limit, CAST(count(*) AS BIGINT) AS n_cells, CAST(count(DISTINCT entity) AS BIGINT) AS n_entities, string_agg(DISTINCT slice, ';' ORDER BY slice) AS slices
        FROM slices, (VALUES (45), (50), (55), (60), (65)) x(t) WHERE g > 7500 AND l < t * 10000 GROUP BY t""",
    "failure_cluster": f"WITH {_TIERS} SELECT entity, min(global_rank) AS best_global_rank, CAST(median(local_rank) AS DOUBLE) AS median_local_rank, CAST(count(DISTINCT slice) AS BIGINT) AS n_slices, max(rank_drop) AS worst_drop FROM failures GROUP BY entity",
    "entity_trace": f"""WITH {_RANKED}, e AS (SELECT DISTINCT short_name AS entity FROM unified_results WHERE short_name IS NOT NULL AND language IS NOT NULL), s AS (SELECT DISTINCT language AS slice FROM unified_results WHERE short_name IS NOT NULL AND language IS NOT NULL)
        SELECT e.entity, s.slice, g_min, l_min, CASE WHEN l_min IS NOT NULL THEN 'ranked' WHEN b.l IS NOT NULL THEN 'no global score' WHEN b.g IS NOT NULL THEN 'no local score' ELSE 'not in slice' END AS status
        FROM e CROSS JOIN s LEFT JOIN boards b ON b.entity = e.entity AND b.slice = s.slice LEFT JOIN ranked r ON r.entity = e.entity AND r.slice = s.slice""",
    "slice_audit_summary": f"""WITH {_RANKED}, {_RHO}, {_REGRET}, {_TOP1}, {_grouped_pairs("slice", "slices")}
        SELECT slice, n, {_TAU} AS tau_b, {_SKIP} AS inversion_rate, rho, loss, r3.regret_max AS regret_3, r5.regret_max AS regret_5
        FROM gc JOIN rho USING (slice) JOIN top1 USING (slice) JOIN (SELECT slice, regret_max FROM regret WHERE k = 3) r3 USING (slice) JOIN (SELECT slice, regret_max FROM regret WHERE k = 5) r5 USING (slice) WHERE n >= 4""",
    "tier_sensitivity": f"""WITH {SLICES}, {_grouped_pairs("tier, slice", "slices")}, sizes AS (SELECT tier, slice, CAST(count(*) AS BIGINT) AS n FROM slices GROUP BY ALL),
        detail AS (SELECT tier, slice, n, {_TAU} AS tau_b, {_SKIP} AS inversion_rate FROM gc JOIN sizes USING (tier, slice) WHERE n >= 3)
        SELECT * FROM detail UNION ALL SELECT tier, 'MEDIAN', CAST(floor(median(n)) AS BIGINT), median(tau_b), median(inversion_rate) FROM detail GROUP BY tier""",
    "rank_scatter": f"""WITH {_RANKED} SELECT slice, CAST(CASE WHEN params IS NULL THEN -1 WHEN params < 300e6 THEN 0 WHEN params < 1000e6 THEN 1 WHEN params < 8000e6 THEN 2 ELSE 3 END AS BIGINT) AS band,
        CAST(count(*) FILTER (l_min < g_min) AS BIGINT) AS above, CAST(count(*) FILTER (l_min = g_min) AS BIGINT) AS diagonal, CAST(count(*) FILTER (l_min > g_min) AS BIGINT) AS below FROM ranked GROUP BY ALL""",
    "slice_asymmetry": f"""WITH {SLICES}, banded AS (SELECT s.*, CASE WHEN t <= 2 THEN '2' WHEN t = 3 THEN '3' ELSE '4+' END AS band FROM slices s JOIN (SELECT short_name AS entity, language AS slice, max(n_tasks) AS t FROM unified_results GROUP BY ALL) USING (entity, slice)),
        {_grouped_pairs("tier, band, slice", "banded")}, rates AS (SELECT tier, band, {_SKIP} AS rate FROM gc)
        SELECT tier, band, CAST(count(*) AS BIGINT) AS n_slices, round(avg(rate), 6) AS mean_rate, median(rate) AS median_rate FROM rates WHERE rate IS NOT NULL GROUP BY tier, band""",
}
