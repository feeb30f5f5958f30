"""The queries of the training-data operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tausift.llm.leaks import leaked_items
from tausift.llm.match import match_models
from tausift.llm.pack import fill_containers, token_counts
from tausift.llm.pairs import pair_defects
from tausift.llm.spam import keyword_pages
from tausift.llm.split import split_oversized
from tausift.llm.topn import latest_per_key, top_n
from tausift.runtime import cut, small, table

ANSWERS = ["answer", "generated_answer"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective answers of qar_pair with their defects."""
    found = pair_defects(table(spark, d, "qar_pair"), "query_id", "question", ANSWERS, "query_type", "written_at", ["refs"])
    return found.select("query_id", "field_name", "defect")


def p1_defects_by_language(spark: SparkSession, d: str) -> DataFrame:
    """How many fields of each defect every language has, and how many of them the earlier check had passed."""
    pairs = table(spark, d, "qar_pair")
    known = pairs.groupBy("query_id").agg(F.max("language").alias("language"), F.max("answer_valid").alias("passed"))
    found = p1_found(spark, d).join(known, "query_id")
    return found.groupBy(F.coalesce("language", F.lit("")).alias("language"), "field_name", "defect").agg(F.count(F.lit(1)).alias("fields"), F.count_if("passed").alias("passed_before"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best models of every language."""
    scores = latest_per_key(table(spark, d, "lang_avg_per_model"), ["language_iso", "model_id"], "lang_avg_ndcg", "run_ts")
    best = top_n(scores, "language_iso", "lang_avg_ndcg", "model_id", 5, spread=False)
    return best.select("language_iso", "place", "model_id")


def _limits(spark: SparkSession, d: str, item_table: str) -> DataFrame:
    """The limits of an item table by language; the row without a language holds for all that have none of their own."""
    return table(spark, d, "size_limit").filter(F.col("item_table") == item_table).select("lang", "max_size", "overlap_size")


def _limited_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each corpus document once, as last written, with the limits of its language."""
    documents = table(spark, d, "corpus_document").dropna(subset=["doc_id"])
    latest = documents.groupBy("doc_id").agg(F.max(F.struct("created_at", "content", "language")).alias("r")).select("doc_id", "r.content", "r.language")
    limits = _limits(spark, d, "corpus_document")
    own = small(limits.filter("lang is not null").groupBy(F.col("lang").alias("language")).agg(F.min("max_size").alias("own_size"), F.min("overlap_size").alias("own_overlap")))
    rest = limits.filter("lang is null").agg(F.min("max_size").alias("any_size"), F.min("overlap_size").alias("any_overlap"))
    joined = latest.join(own, "language", "left").join(F.broadcast(rest))  # one row
    return joined.select("doc_id", "content", F.coalesce("own_size", "any_size").alias("max_size"), F.coalesce("own_overlap", "any_overlap").alias("overlap_size"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized corpus document."""
    return split_oversized(_limited_documents(spark, d), "doc_id", "content", "max_size", "overlap_size")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Oversized corpus documents, and whether a piece had to be cut from a stretch that has no boundary within the limit."""
    forced = F.max(F.col("unbroken") > F.col("max_size"))
    return p3_pieces(spark, d).groupBy("doc_id").agg(F.when(forced, "forced").otherwise("natural").alias("cut_kind"))


def p3_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every oversized corpus document put together again from its pieces, and what the pieces keep to.

    within_limit: no piece is over the limit. shared: consecutive pieces share exactly the overlap. numbered: they are
    numbered from 1 without a gap. parted: pieces that end within a word although some boundary stood in reach.
    """
    over = _limited_documents(spark, d).select("doc_id", "overlap_size")
    pieces = p3_pieces(spark, d).join(over, "doc_id")
    fresh = F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.expr("substring(piece, overlap_size + 1)"))
    whole = pieces.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", fresh.alias("fresh")))).alias("p"), F.max(F.length("piece")).alias("longest"), F.max("max_size").alias("max_size"), F.max("overlap_size").alias("overlap"), F.max("n_pieces").alias("pieces"),
        F.count_if((F.col("boundary") == "none") & F.expr("substring(piece, overlap_size + 2)").rlike(r"[\s。！？।!?]")).alias("parted"),
    )
    shared = F.expr("forall(sequence(1, size(p)), k -> k = 1 or p[k - 1].start = p[k - 2].end - overlap)")
    return whole.select("doc_id", F.md5(F.concat_ws("", "p.fresh")).alias("text_md5"), (F.col("longest") <= F.col("max_size")).alias("within_limit"), shared.alias("shared"), (F.expr("p.piece_no = sequence(1, size(p))") & (F.size("p") == F.col("pieces"))).alias("numbered"), "parted")


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    """Names of one model in two sources, with the confidence of each match."""
    return match_models(*(table(spark, d, t) for t in ("leaderboard", "per_task_ndcg", "unified_results")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Names of one model in two sources."""
    return p5_matches(spark, d).select("source_a", "key_a", "source_b", "key_b")


def _capacity(spark: SparkSession, d: str) -> int:
    return _limits(spark, d, "documents").filter("lang is null").agg(F.min("max_size")).first()[0]


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text of documents in a container of the token limit."""
    sizes = cut(token_counts(table(spark, d, "documents"), "doc_id", "text"))
    return fill_containers(sizes, "doc_id", "n_tokens", _capacity(spark, d))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled: their number, the least possible number, tokens and unused share."""
    capacity = _capacity(spark, d)
    held = p6_containers(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    total = held.agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.sum("pieces").alias("pieces"))
    least = F.ceil(F.col("tokens") / capacity)
    return total.select("containers", least.alias("least_containers"), "pieces", "tokens", "fullest", (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused_share"))


def p6_held(spark: SparkSession, d: str) -> DataFrame:
    """What the containers keep to: every text is in one, none is over the limit, and only texts over it are divided."""
    capacity = _capacity(spark, d)
    pieces = cut(p6_containers(spark, d))
    over = pieces.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).filter(F.col("t") > capacity).agg(F.count(F.lit(1)).alias("over_limit"))
    texts = pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece_no").alias("numbers"), F.sum("n_tokens").alias("t"))
    wrong = (F.col("pieces") > 1) & ((F.col("t") <= capacity) | (F.col("pieces") != F.ceil(F.col("t") / capacity)) | (F.col("numbers") != F.col("pieces")))
    return texts.agg(F.count(F.lit(1)).alias("texts"), F.count_if(wrong).alias("wrongly_divided")).join(F.broadcast(over))  # one row each


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold evaluation items, with the share of the item that stands in one stretch."""
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_item"), "item_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items they hold."""
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p8_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The share of every document in lines of links, tags or repeated keywords, with their shapes."""
    return keyword_pages(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are made of keywords, links or tags."""
    return p8_shapes(spark, d).filter("is_spam").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_defects_by_language, p2_found, p3_found, p3_pieces, p3_rebuilt, p5_found, p5_matches, p6_containers, p6_fill, p6_held, p7_found, p7_leaks, p8_found, p8_shapes)}

_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}。！？!?।]"

ORACLE = {
    "p2_found": """
        WITH latest AS (
            SELECT language_iso, model_id, lang_avg_ndcg,
                   row_number() OVER (PARTITION BY language_iso, model_id ORDER BY run_ts DESC NULLS LAST, lang_avg_ndcg DESC NULLS LAST) AS k
            FROM lang_avg_per_model WHERE language_iso IS NOT NULL AND model_id IS NOT NULL),
        placed AS (
            SELECT language_iso, model_id,
                   CAST(row_number() OVER (PARTITION BY language_iso ORDER BY lang_avg_ndcg DESC, model_id) AS INTEGER) AS place
            FROM latest WHERE k = 1 AND lang_avg_ndcg IS NOT NULL AND NOT isnan(lang_avg_ndcg))
        SELECT language_iso, place, model_id FROM placed WHERE place <= 5""",
    "p3_found": f"""
        WITH latest AS (SELECT doc_id, arg_max(content, created_at) AS content, arg_max(language, created_at) AS language
                        FROM corpus_document WHERE doc_id IS NOT NULL GROUP BY doc_id)
        SELECT doc_id,
               CASE WHEN list_max(list_transform(string_split_regex(content, '{_SPACES}+'), lambda x: length(x))) > max_size
                    THEN 'forced' ELSE 'natural' END AS cut_kind
        FROM latest JOIN size_limit ON item_table = 'corpus_document' AND lang = language
        WHERE length(content) > max_size""",
    "p6_held": "SELECT count(DISTINCT doc_id) AS texts, CAST(0 AS BIGINT) AS wrongly_divided, CAST(0 AS BIGINT) AS over_limit FROM documents WHERE doc_id IS NOT NULL",
    "p3_rebuilt": """
        WITH latest AS (SELECT doc_id, arg_max(content, created_at) AS content, arg_max(language, created_at) AS language
                        FROM corpus_document WHERE doc_id IS NOT NULL GROUP BY doc_id)
        SELECT doc_id, md5(content) AS text_md5, true AS within_limit, true AS shared, true AS numbered, CAST(0 AS BIGINT) AS parted
        FROM latest JOIN size_limit ON item_table = 'corpus_document' AND lang = language
        WHERE length(content) > max_size""",
}
