"""Composite analyses: resampled contrasts, alternative aggregators, categories, concordance between sources, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tausift.functions.text import plain_name, without_link
from tausift.operators.agreement import inversion_rates, pair_counts, tau_b
from tausift.operators.lookup import exact_or_unique
from tausift.operators.order import at_positions
from tausift.operators.resample import DRAW_SQL, bootstrap_pairs, bootstrap_rows, drawn_with_replacement, fits_arrays, replicates, rho_of
from tausift.operators.scores import consensus_scores, ratio, row_aggregators
from tausift.operators.stats import spearman
from tausift.plans.base import BOARDS, FAMILY, LOCAL, SCORES, SLICES, boards, family, local_scores, scores, slices
from tausift.plans.relational_queries import ORACLE as RELATIONAL_SQL
from tausift.plans.relational_queries import REPS, subset_resample
from tausift.runtime import table


def _interval(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, low, high): 2.5th and 97.5th percentile of a value, interpolated."""
    q = at_positions(df.dropna(subset=[value]), group, value, {"low": (F.col("n") - 1) * F.lit(0.025), "high": (F.col("n") - 1) * F.lit(0.975)})
    return q.select(*group, "n", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def bootstrap_inversion_ci(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: 95 percent interval of the inversion rate over bootstrap replicates, ties left out in each."""
    rates = bootstrap_pairs(slices(spark, d), ["slice"], "entity", "g", "l", REPS).select("slice", inversion_rates()["skip"].alias("r"))
    return _interval(rates, ["slice"], "r")


#: Valid replicates that an interval of rho needs.
LEAST_VALID = 100


def _drawn_rho(rep: int, c: dict, x: str, y: str) -> float | None:
    at = drawn_with_replacement(rep, len(c[x]), 42)
    return rho_of(c[x][at], c[y][at]) if len(at) >= 3 else None


def bootstrap_spearman_ci(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: 95 percent interval of Spearman's rho over bootstrap replicates."""
    rows = slices(spark, d)
    if fits_arrays(rows, ["slice"]):
        rhos = replicates(rows, ["slice"], "entity", ["g", "l"], REPS, lambda rep, c: (_drawn_rho(rep, c, "g", "l"),), "rho double")
    else:
        rhos = spearman(bootstrap_rows(rows, ["slice"], "entity", ["g", "l"], REPS), ["slice", "rep"], "g", "l")
    return _interval(rhos, ["slice"], "rho").withColumns({c: F.when(F.col("n") >= LEAST_VALID, F.col(c)) for c in ("low", "high")})


def paired_bootstrap_rho(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: difference of two rhos of the local score (with the global score, with one task), its interval and two-sided p.

    Both rhos of a replicate come from the same draws.
    """
    one = local_scores(spark, d).filter("task = 'task_mlqa'").select("entity", "slice", "s")
    rows = slices(spark, d).select("entity", "slice", "g", "l").join(one, ["entity", "slice"])
    if fits_arrays(rows, ["slice"]):
        both = replicates(rows, ["slice"], "entity", ["g", "l", "s"], REPS, lambda rep, c: (_drawn_rho(rep, c, "g", "l"), _drawn_rho(rep, c, "s", "l")), "ra double, rb double")
    else:
        drawn = bootstrap_rows(rows, ["slice"], "entity", ["g", "l", "s"], REPS)
        both = spearman(drawn, ["slice", "rep"], "g", "l", "ra").select("slice", "rep", "ra").join(spearman(drawn, ["slice", "rep"], "s", "l", "rb").select("slice", "rep", "rb"), ["slice", "rep"])
    # far below any difference of two rhos; keeps equal ones equal on every engine
    deltas = both.select("slice", F.round(F.col("ra") - F.col("rb"), 12).alias("delta")).dropna()
    tails = deltas.groupBy("slice").agg(ratio(F.count_if(F.col("delta") <= 0), F.count(F.lit(1))).alias("under"), ratio(F.count_if(F.col("delta") >= 0), F.count(F.lit(1))).alias("over"))
    return _interval(deltas, ["slice"], "delta").join(tails, "slice").select("slice", "n", "low", "high", F.least(F.lit(1.0), 2 * F.least("under", "over")).alias("p"))


def alternative_aggregators(spark: SparkSession, d: str) -> DataFrame:
    """Five ways to aggregate an entity's tasks, against its mean over the tasks in several languages: tau-b and inversion rate."""
    s = scores(spark, d)
    rows = row_aggregators(s.filter(family() == "single"), "entity", "s")
    quantised = rows.select("entity", *(F.round(F.col(c) * 100).cast("long").alias(c) for c in ("mean", "lowest", "median", "harmonic", "trimmed")))
    multi = s.filter(family() == "multi").groupBy("entity").agg(ratio(F.sum("s"), F.count("s")).alias("l"))
    long = quantised.unpivot(["entity"], ["mean", "lowest", "median", "harmonic", "trimmed"], "aggregator", "g").join(multi, "entity")
    return pair_counts(long, ["aggregator"], "g", "l").select("aggregator", "n", tau_b().alias("tau_b"), inversion_rates()["half"].alias("inversion_rate"))


def size_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Per task and slice: Spearman's rho of size and score, over entities whose size is known."""
    sized = boards(spark, d).filter("params is not null").select("entity", "slice", "params")
    return spearman(local_scores(spark, d).join(sized, ["entity", "slice"]), ["task", "slice"], "params", "s")


def category_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per category of tasks and slice: agreement of the global score with the consensus score within the category."""
    tasks = local_scores(spark, d).withColumn("cell", F.concat_ws("|", F.when(F.col("task").isin("task_belebele", "task_mlqa"), "reading").otherwise("search"), "slice"))
    local = consensus_scores(tasks, "cell", "entity", "task", "s").filter("n_consensus >= 2")
    global_ = boards(spark, d).dropna(subset=["g"]).groupBy("entity").agg(F.max("g").alias("g"))
    counts = pair_counts(local.select("cell", "entity", F.col("score").alias("l")).join(global_, "entity"), ["cell"], "g", "l").filter("n >= 6")
    return counts.select(F.split("cell", r"\|")[0].alias("category"), F.split("cell", r"\|")[1].alias("slice"), "n", tau_b().alias("tau_b"), inversion_rates()["half_xor"].alias("inversion_rate"))


def external_concordance(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the leaderboards' mean with the mean of the score fact, over names that match exactly or by plain name."""
    board = table(spark, d, "leaderboard").filter("model is not null and mean_task is not null and not isnan(mean_task)").select(F.substring_index(without_link("model"), "/", -1).alias("name"), F.round(F.col("mean_task") * 100).cast("long").alias("x"))
    facts = scores(spark, d).groupBy(F.col("entity").alias("name")).agg(ratio(F.sum("s"), F.count("s")).alias("l"))
    links = exact_or_unique(board, facts, "name", plain_name("name"), plain_name("name")).filter("matched is not null")
    means = board.groupBy("name").agg(F.max("x").alias("g"))
    both = means.join(links, "name").join(facts.select(F.col("name").alias("matched"), "l"), "matched").withColumn("all", F.lit("all"))
    return pair_counts(both, ["all"], "g", "l").select("n", "concordant", "discordant", tau_b().alias("tau_b"))


def resample_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: whether the median of resampled subsets lies within a tenth of the mean of the range's ends."""
    r = subset_resample(spark, d)
    middle = (F.col("lowest") + F.col("highest")) / 2
    tenth = (F.col("highest") - F.col("lowest")) / 10
    verdict = F.when(F.abs(F.col("median") - middle) <= tenth, "balanced").when(F.col("median") > middle, "upper").otherwise("lower")
    return r.select("slice", verdict.alias("verdict"))


def board_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Per board: entries, entries with a mean, best mean, and the average number of missing task scores, best board first."""
    tasks = ["belebele_retrieval", "wikipedia_retrieval", "miracl_retrieval_hn", "mlqa_retrieval"]
    missing = sum((F.col(t).isNull() | F.isnan(t)).cast("int") for t in tasks)
    rows = table(spark, d, "leaderboard").filter("board is not null and model is not null").withColumn("missing", missing).withColumn("m", F.when(~F.isnan("mean_task"), F.round(F.col("mean_task") * 100).cast("long")))
    return rows.groupBy("board").agg(F.count_distinct("model").alias("entries"), F.count("m").alias("with_mean"), F.max("m").alias("best"), ratio(F.sum("missing"), F.count(F.lit(1))).alias("missing")).orderBy(F.col("best").desc(), "board")


def recomputed_check(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose stated number of tasks isn't the number of their task scores."""
    stated = table(spark, d, "unified_results").filter("short_name is not null and language is not null").groupBy(F.col("short_name").alias("entity"), F.col("language").alias("slice")).agg(F.max("n_tasks").cast("long").alias("stated"))
    counted = local_scores(spark, d).groupBy("entity", "slice").agg(F.count(F.lit(1)).alias("counted"))
    both = stated.join(counted, ["entity", "slice"], "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return both.filter(F.col("stated") != F.col("counted"))


def task_range_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Per entity: range of its scores over the tasks in several languages, `uniform` below five points."""
    r = scores(spark, d).filter(family() == "multi").groupBy("entity").agg(F.count("s").alias("n"), (F.max("s") - F.min("s")).alias("spread")).filter("n >= 2")
    return r.select("entity", "spread", F.when(F.col("spread") < 5000, "uniform").otherwise("varied").alias("verdict"))


def first_documents(spark: SparkSession, d: str) -> DataFrame:
    """The five first documents of every language column by id: a head scan in a fixed order."""
    docs = table(spark, d, "documents").filter("doc_id is not null").select(F.coalesce("lang", F.lit("")).alias("lang"), "doc_id")
    order = Window.partitionBy("lang").orderBy("doc_id")
    return docs.withColumn("place", F.row_number().over(order).cast("long")).filter("place <= 5")


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def tie_report(spark: SparkSession, d: str) -> DataFrame:
    """Per slice: entities whose global score ties with another's, and whose local score does."""
    rows = slices(spark, d)
    g = rows.groupBy("slice", "g").agg(F.count(F.lit(1)).alias("c")).groupBy("slice").agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("tied_global"))
    l = rows.groupBy("slice", "l").agg(F.count(F.lit(1)).alias("c")).groupBy("slice").agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("tied_local"))
    return rows.groupBy("slice").agg(_count(F.lit(True)).alias("n")).join(g, "slice").join(l, "slice")


QUERIES = {
    f.__name__: f
    for f in (
        bootstrap_inversion_ci, bootstrap_spearman_ci, paired_bootstrap_rho, alternative_aggregators, size_correlation, category_audit, external_concordance, resample_verdict, board_comparison, recomputed_check,
        task_range_verdicts, first_documents, tie_report,
    )
}

_PLAIN = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_NAME = r"split_part(regexp_replace(model, '^\s*\[([^\]]*)\]\([^)]*\)\s*$', '\1'), '/', -1)"
_TAU = "CASE WHEN concordant + discordant + tied_y > 0 AND concordant + discordant + tied_x > 0 THEN CAST(concordant - discordant AS DOUBLE) / sqrt(CAST(concordant + discordant + tied_y AS DOUBLE) * CAST(concordant + discordant + tied_x AS DOUBLE)) END"
_SKIP = "CASE WHEN concordant + discordant > 0 THEN CAST(discordant AS DOUBLE) / CAST(concordant + discordant AS DOUBLE) END"


def _pairs(keys: str, source: str, item: str = "entity") -> str:
    names = [k.strip() for k in keys.split(",")]
    side = lambda c: f"CASE WHEN a.{c} > b.{c} THEN 1 WHEN a.{c} < b.{c} THEN -1 ELSE 0 END"
    return f"""gc AS (SELECT {keys}, CAST(count(*) AS DOUBLE) AS pairs, CAST(count(*) FILTER (sx * sy > 0) AS BIGINT) AS concordant, CAST(count(*) FILTER (sx * sy < 0) AS BIGINT) AS discordant, count(*) FILTER (sx = 0 AND sy <> 0) AS tied_x, count(*) FILTER (sx <> 0 AND sy = 0) AS tied_y, count(*) FILTER (sx = 0 AND sy = 0) AS tied_both
    FROM (SELECT {', '.join('a.' + k for k in names)}, {side('g')} AS sx, {side('l')} AS sy FROM {source} a JOIN {source} b ON {' AND '.join(f'a.{k} = b.{k}' for k in names)} AND a.{item} < b.{item}) GROUP BY {keys})"""


def _rho(keys: str, source: str, a: str, b: str, name: str) -> str:
    ranks = ", ".join(f"2 * rank() OVER (PARTITION BY {keys} ORDER BY {c} DESC) + count(*) OVER (PARTITION BY {keys}, {c}) - 1 AS r{k}" for k, c in (("a", a), ("b", b)))
    var = lambda c: f"(CAST(count(*) AS DOUBLE) * CAST(sum(r{c} * r{c}) AS DOUBLE) - CAST(sum(r{c}) AS DOUBLE) * CAST(sum(r{c}) AS DOUBLE))"
    cov = "(CAST(count(*) AS DOUBLE) * CAST(sum(ra * rb) AS DOUBLE) - CAST(sum(ra) AS DOUBLE) * CAST(sum(rb) AS DOUBLE))"
    return f"SELECT {keys}, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) >= 3 AND {var('a')} > 0 AND {var('b')} > 0 THEN {cov} / sqrt({var('a')} * {var('b')}) END AS {name} FROM (SELECT {keys}, {ranks} FROM {source}) GROUP BY {keys}"


def _boot(source: str, columns: str) -> str:
    picked = ", ".join(f"b.{c.strip()}" for c in columns.split(","))
    return f"""placed AS (SELECT slice, {columns}, row_number() OVER (PARTITION BY slice ORDER BY entity) AS k, count(*) OVER (PARTITION BY slice) AS n FROM {source}), reps AS (SELECT unnest(generate_series(1, {REPS})) AS rep),
    boot AS (SELECT a.slice, rep, a.k, {picked} FROM placed a CROSS JOIN reps JOIN placed b ON b.slice = a.slice AND b.k - 1 = {DRAW_SQL.format(rep='rep', k='(a.k - 1)', seed=42)} % a.n)"""


_CI = "CAST(count({0}) AS BIGINT) AS n, round(quantile_cont({0}, CAST(0.025 AS DOUBLE)), 9) AS low, round(quantile_cont({0}, CAST(0.975 AS DOUBLE)), 9) AS high"

ORACLE = {
    "bootstrap_inversion_ci": f"WITH {SLICES}, {_boot('slices', 'g, l')}, {_pairs('slice, rep', 'boot', 'k')}, t AS (SELECT slice, {_SKIP} AS t FROM gc) SELECT slice, {_CI.format('t')} FROM t GROUP BY slice",
    "bootstrap_spearman_ci": f"WITH {SLICES}, {_boot('slices', 'g, l')}, t AS ({_rho('slice, rep', 'boot', 'g', 'l', 't')}) SELECT slice, {_CI.format('t')} FROM t GROUP BY slice",
    "paired_bootstrap_rho": f"""WITH {SLICES}, {LOCAL}, x AS (SELECT entity, slice, g, l, s FROM slices JOIN (SELECT entity, slice, s FROM local_scores WHERE task = 'task_mlqa') USING (entity, slice)), {_boot('x', 'g, l, s')},
        ra AS ({_rho('slice, rep', 'boot', 'g', 'l', 'ra')}), rb AS ({_rho('slice, rep', 'boot', 's', 'l', 'rb')}), t AS (SELECT slice, round(ra - rb, 12) AS t FROM (SELECT slice, rep, ra FROM ra) JOIN (SELECT slice, rep, rb FROM rb) USING (slice, rep) WHERE ra - rb IS NOT NULL)
        SELECT slice, {_CI.format('t')}, least(CAST(1 AS DOUBLE), 2 * least(CAST(count(*) FILTER (t <= 0) AS DOUBLE) / CAST(count(*) AS DOUBLE), CAST(count(*) FILTER (t >= 0) AS DOUBLE) / CAST(count(*) AS DOUBLE))) AS p FROM t GROUP BY slice""",
    "alternative_aggregators": f"""WITH {SCORES}, v AS (SELECT entity, list_sort(list(s)) AS v, count(*) AS n, CAST(floor(count(*) * CAST(0.1 AS DOUBLE)) AS BIGINT) AS k FROM scores WHERE {FAMILY} = 'single' GROUP BY entity),
        a AS (SELECT entity, CAST(round(CAST(list_sum(v) AS DOUBLE) / n * 100) AS BIGINT) AS mean, CAST(v[1] * 100 AS BIGINT) AS lowest, CAST(round((v[CAST(floor((n + 1) / 2) AS BIGINT)] + v[CAST(floor(n / 2) AS BIGINT) + 1]) / CAST(2 AS DOUBLE) * 100) AS BIGINT) AS median, CAST(round(n / list_sum(list_transform(v, lambda y: 1 / greatest(CAST(y AS DOUBLE), CAST(0.000001 AS DOUBLE)))) * 100) AS BIGINT) AS harmonic, CAST(round(CAST(list_sum(v[k + 1 : n - k]) AS DOUBLE) / (n - 2 * k) * 100) AS BIGINT) AS trimmed FROM v),
        m AS (SELECT entity, CAST(sum(s) AS DOUBLE) / CAST(count(s) AS DOUBLE) AS l FROM scores WHERE {FAMILY} = 'multi' GROUP BY entity), u AS (UNPIVOT a ON mean, lowest, median, harmonic, trimmed INTO NAME aggregator VALUE g), x AS (SELECT aggregator, entity, g, l FROM u JOIN m USING (entity)), {_pairs('aggregator', 'x')}
        SELECT aggregator, n, {_TAU} AS tau_b, (CAST(discordant AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(tied_x + tied_y + tied_both AS DOUBLE)) / pairs AS inversion_rate FROM gc JOIN (SELECT aggregator, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY aggregator) USING (aggregator)""",
    "size_correlation": f"WITH {BOARDS}, {LOCAL}, x AS (SELECT task, slice, params AS a, s AS b FROM local_scores JOIN boards USING (entity, slice) WHERE params IS NOT NULL) {_rho('task, slice', 'x', 'a', 'b', 'rho')}",
    "category_audit": f"""WITH {BOARDS}, {LOCAL}, t AS (SELECT CASE WHEN task IN ('task_belebele', 'task_mlqa') THEN 'reading' ELSE 'search' END AS category, slice, entity, task, s FROM local_scores),
        present AS (SELECT category, slice, count(DISTINCT entity) AS n_any FROM t GROUP BY ALL), kept AS (SELECT category, slice, task, count(*) >= greatest(1, ceil(any_value(n_any) * 0.5)) AS kept FROM t JOIN present USING (category, slice) GROUP BY category, slice, task),
        used AS (SELECT category, slice, task FROM kept k WHERE kept OR NOT (SELECT bool_or(kept) FROM kept x WHERE x.category = k.category AND x.slice = k.slice)), needed AS (SELECT category, slice, count(*) AS nc FROM used GROUP BY ALL),
        sums AS (SELECT category, slice, entity, count(*) AS n, CAST(sum(s) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS l FROM t JOIN used USING (category, slice, task) GROUP BY ALL), gl AS (SELECT entity, max(g) AS g FROM boards WHERE g IS NOT NULL GROUP BY entity),
        x AS (SELECT category, slice, entity, g, l FROM sums JOIN needed USING (category, slice) JOIN gl USING (entity) WHERE n = nc AND nc >= 2), {_pairs('category, slice', 'x')}
        SELECT category, slice, n, {_TAU} AS tau_b, (CAST(discordant AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(tied_x + tied_y AS DOUBLE)) / pairs AS inversion_rate FROM gc JOIN (SELECT category, slice, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY ALL) USING (category, slice) WHERE n >= 6""",
    "external_concordance": f"""WITH {SCORES}, b AS (SELECT {_NAME} AS name, max(CAST(round(mean_task * 100) AS BIGINT)) AS g FROM leaderboard WHERE model IS NOT NULL AND mean_task IS NOT NULL AND NOT isnan(mean_task) GROUP BY 1),
        f AS (SELECT entity, CAST(sum(s) AS DOUBLE) / CAST(count(s) AS DOUBLE) AS l FROM scores GROUP BY entity), o AS (SELECT {_PLAIN.format('entity')} AS p, min(entity) AS one FROM f GROUP BY 1 HAVING count(*) = 1),
        m AS (SELECT name, g, coalesce(e.entity, one) AS entity FROM b LEFT JOIN f e ON e.entity = name LEFT JOIN o ON p = {_PLAIN.format('name')}), x AS (SELECT 'all' AS q, name, g, f.l FROM m JOIN f USING (entity)), {_pairs('q', 'x', 'name')}
        SELECT (SELECT CAST(count(*) AS BIGINT) FROM x) AS n, concordant, discordant, {_TAU} AS tau_b FROM gc""",
    "resample_verdict": f"WITH r AS ({RELATIONAL_SQL['subset_resample']}) SELECT slice, CASE WHEN abs(median - (lowest + highest) / 2) <= (highest - lowest) / 10 THEN 'balanced' WHEN median > (lowest + highest) / 2 THEN 'upper' ELSE 'lower' END AS verdict FROM r",
    "board_comparison": """WITH r AS (SELECT board, model, CASE WHEN NOT isnan(mean_task) THEN CAST(round(mean_task * 100) AS BIGINT) END AS m, list_sum(list_transform([belebele_retrieval, wikipedia_retrieval, miracl_retrieval_hn, mlqa_retrieval], lambda x: CASE WHEN x IS NULL OR isnan(x) THEN 1 ELSE 0 END)) AS k FROM leaderboard WHERE board IS NOT NULL AND model IS NOT NULL)
        SELECT board, CAST(count(DISTINCT model) AS BIGINT) AS entries, CAST(count(m) AS BIGINT) AS with_mean, max(m) AS best, CAST(sum(k) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS missing FROM r GROUP BY board""",
    "recomputed_check": f"""WITH {LOCAL}, s AS (SELECT short_name AS entity, language AS slice, CAST(max(n_tasks) AS BIGINT) AS stated FROM unified_results WHERE short_name IS NOT NULL AND language IS NOT NULL GROUP BY ALL), c AS (SELECT entity, slice, CAST(count(*) AS BIGINT) AS counted FROM local_scores GROUP BY ALL)
        SELECT entity, slice, stated, coalesce(counted, 0) AS counted FROM s LEFT JOIN c USING (entity, slice) WHERE stated <> coalesce(counted, 0)""",
    "task_range_verdicts": f"WITH {SCORES} SELECT entity, max(s) - min(s) AS spread, CASE WHEN max(s) - min(s) < 5000 THEN 'uniform' ELSE 'varied' END AS verdict FROM scores WHERE {FAMILY} = 'multi' GROUP BY entity HAVING count(s) >= 2",
    "first_documents": "SELECT lang, doc_id, place FROM (SELECT coalesce(lang, '') AS lang, doc_id, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY doc_id) AS place FROM documents WHERE doc_id IS NOT NULL) WHERE place <= 5",
    "tie_report": f"WITH {SLICES}, c AS (SELECT slice, count(*) OVER (PARTITION BY slice, g) AS a, count(*) OVER (PARTITION BY slice, l) AS b FROM slices) SELECT slice, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (a > 1) AS BIGINT) AS tied_global, CAST(count(*) FILTER (b > 1) AS BIGINT) AS tied_local FROM c GROUP BY slice",
}
