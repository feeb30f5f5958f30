"""Text functions, retrieval and n-gram overlap over documents, items and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tausift.functions.text import BLANKS, base_language, char_ngrams, char_tokens, collapsed, first_integer, markdown_free, plain_name, short_id, size_number, without_hash, without_link, word_ngrams, word_tokens
from tausift.operators.retrieval import bm25, dense_top_k, evaluate, fuse, gram_overlap
from tausift.runtime import table


def sanitize_ids(spark: SparkSession, d: str) -> DataFrame:
    """Short ids, plain names and names without hash of every model id of the wide fact."""
    ids = table(spark, d, "unified_results").filter("model_id is not null").select("model_id").distinct()
    return ids.select("model_id", short_id("model_id").alias("short_id"), plain_name("model_id").alias("plain"), without_hash(short_id("model_id")).alias("without_hash"))


def parse_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Every size text of the leaderboards as a number, and as text again."""
    sizes = table(spark, d, "leaderboard").filter("params is not null").groupBy("params").agg(F.count(F.lit(1)).alias("n"))
    number = size_number("params")
    return sizes.select("params", "n", number.alias("number"), F.when(number >= 1e9, F.concat((number / 1e9).cast("decimal(10,1)").cast("string"), F.lit("B"))).when(number.isNotNull(), F.concat(F.round(number / 1e6).cast("long").cast("string"), F.lit("M"))).alias("written"))


def unwrapped_names(spark: SparkSession, d: str) -> DataFrame:
    """Leaderboard names without link and organisation."""
    names = table(spark, d, "leaderboard").filter("model is not null").select("model").distinct()
    return names.select("model", F.substring_index(without_link("model"), "/", -1).alias("name"))


def markdown_strip(spark: SparkSession, d: str) -> DataFrame:
    """Length and MD5 of every corpus document without Markdown marks."""
    c = table(spark, d, "corpus_document").filter("doc_id is not null and content is not null").groupBy("doc_id").agg(F.max("content").alias("content"))
    plain = markdown_free("content")
    return c.select("doc_id", F.length(plain).cast("long").alias("n"), F.md5(plain).alias("md5"))


def token_counts_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Per base language: documents, word tokens, distinct word tokens and characters."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.coalesce(base_language("lang"), F.lit("")).alias("language"), word_tokens("text", lower=False).alias("w"), F.size(char_tokens("text")).alias("c"))
    sizes = docs.groupBy("language").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("w")).alias("words"), F.sum("c").alias("chars"))
    kinds = docs.select("language", F.explode("w").alias("t")).distinct().groupBy("language").agg(F.count(F.lit(1)).alias("distinct_words"))
    return sizes.join(kinds, "language", "left").select("language", "docs", "words", "chars", F.coalesce("distinct_words", F.lit(0)).alias("distinct_words"))


def _word_grams(texts: DataFrame, text: str, n: int) -> DataFrame:
    """texts with its n-grams of words in `grams`. The words are a column of their own, else they are split again for every gram."""
    return texts.withColumn("words", word_tokens(text)).withColumn("grams", word_ngrams(F.col("words"), n))


def _char_grams(texts: DataFrame, text: str, n: int) -> DataFrame:
    # as an array: substrings of a string are searched from its start each time
    return texts.withColumn("chars", F.filter(F.split(collapsed(text), ""), lambda c: c != "")).withColumn("grams", char_ngrams(F.col("chars"), n))


def ngram_contamination(spark: SparkSession, d: str) -> DataFrame:
    """Per language column of documents: distinct 8-grams of words, and the share that evaluation items have too."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.coalesce("lang", F.lit("")).alias("language"), "text")
    return gram_overlap(_word_grams(docs, "text", 8), "language", "grams", _word_grams(table(spark, d, "eval_item"), "text", 8))


def char_ngram_contamination(spark: SparkSession, d: str) -> DataFrame:
    """Per language of the corpus documents: distinct 8-grams of characters, and the share that evaluation items have too."""
    docs = table(spark, d, "corpus_document").filter("content is not null").select("language", "content")
    return gram_overlap(_char_grams(docs, "content", 8), "language", "grams", _char_grams(table(spark, d, "eval_item"), "text", 8))


def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that stand under several document ids: first id, copies and sources."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "source", F.md5("text").alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.count_distinct("source").alias("sources")).filter("copies > 1").select("first_id", "copies", "sources")


def first_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The first whole number of every answer, at most 1000, by query type: sum and how many have none."""
    pairs = table(spark, d, "qar_pair").dropDuplicates(["query_id"]).filter("answer is not null")
    n = first_integer("answer", 1000)
    return pairs.groupBy("query_type").agg(F.sum(n).alias("total"), F.count_if(n == 0).alias("without"))


def prompt_keys(spark: SparkSession, d: str) -> DataFrame:
    """Per query: a prompt of its numbered key points, cut to 200 characters, and the key of its text."""
    pairs = table(spark, d, "qar_pair").filter("query_id is not null and question is not null").groupBy("query_id").agg(F.min(F.struct("question", "keypoints")).alias("r")).select("query_id", "r.question", "r.keypoints")
    points = F.array_join(F.transform("keypoints", lambda k, i: F.concat((i + 1).cast("string"), F.lit(". "), k)), "\n")
    prompt = F.substring(F.concat_ws("\n", F.trim("question"), points), 1, 200)
    return pairs.select("query_id", F.length(prompt).cast("long").alias("n"), F.substring(F.sha2(prompt, 256), 1, 16).alias("key"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation items whose id is divisible by 100: the query set of searches."""
    return table(spark, d, "eval_item").filter("item_id % 100 = 0").select(F.col("item_id").alias("qid"), word_tokens("text", lower=True).alias("tokens"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", word_tokens("text", lower=True).alias("tokens"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for every query item by BM25."""
    return bm25(_queries(spark, d), _documents(spark, d), 10)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors, by dot product, of every vector whose id is divisible by 100."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return dense_top_k(v.filter("id % 100 = 0"), v, 10, same=True)


def _label_relevance(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "label")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    return q.join(v, "label").filter("qid <> vec_id").select("qid", F.col("vec_id").alias("doc_id"), F.lit(1).alias("rel"))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """NDCG, recall and reciprocal rank at ten of dense retrieval, vectors of one label being relevant to each other."""
    e = evaluate(dense_topk(spark, d), _label_relevance(spark, d))
    return e.select("qid", *(F.round(c, 6).alias(c) for c in ("ndcg", "recall", "mrr")))


def metrics_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics by label of the query; labels without queries have zeros."""
    labels = table(spark, d, "embeddings").select("label").distinct()
    of = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "label")
    means = retrieval_metrics(spark, d).join(of, "qid").groupBy("label").agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(c), 5).alias(c) for c in ("ndcg", "recall", "mrr")))
    return labels.join(means, "label", "left").select(F.col("label").cast("long").alias("label"), F.coalesce("queries", F.lit(0)).alias("queries"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ndcg", "recall", "mrr")))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of a BM25 run and a run by the number of distinct query words in the document, ten documents each."""
    q, docs = _queries(spark, d), _documents(spark, d)
    lexical = bm25(q, docs, 10).select(F.lit("bm25").alias("run"), "qid", "doc_id", "rank")
    words = q.select("qid", F.explode(F.array_distinct("tokens")).alias("t"))
    hits = words.join(docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("t")), "t").groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("qid").orderBy(F.col("c").desc(), "doc_id")
    overlap = hits.withColumn("rank", F.row_number().over(order).cast("long")).filter("rank <= 10").select(F.lit("overlap").alias("run"), "qid", "doc_id", "rank")
    return fuse(lexical.unionByName(overlap)).select("qid", "doc_id", F.round("score", 9).alias("score"))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """Per label: vectors and the mean length of a vector."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return table(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(norm), 6).alias("mean_norm"))


QUERIES = {
    f.__name__: f
    for f in (
        sanitize_ids, parse_sizes, unwrapped_names, markdown_strip, token_counts_by_language, ngram_contamination, char_ngram_contamination, duplicate_texts, first_numbers, prompt_keys, bm25_topk, dense_topk,
        retrieval_metrics, metrics_by_label, rrf_fusion, vector_norms,
    )
}

_WORDS = r"list_filter(string_split(regexp_replace({}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda t: t <> '')"
_SID = "concat_ws('_', substr(regexp_replace(split_part(model_id, '/', -1), '[^a-zA-Z0-9]', '_', 'g'), 1, 20), substr(md5(model_id), 1, 6))"
_SIZE = "CASE right(params, 1) WHEN 'B' THEN 1e9 WHEN 'M' THEN 1e6 WHEN 'K' THEN 1e3 END * TRY_CAST(nullif(regexp_extract(params, '^([0-9.]+)[KMB]$', 1), '') AS DOUBLE)"
_BASE = "CASE WHEN lang IS NULL THEN '' ELSE coalesce(CASE regexp_extract(lower(lang), '^([a-z]+)', 1) WHEN 'jpn' THEN 'ja' WHEN 'hin' THEN 'hi' WHEN 'ita' THEN 'it' WHEN 'eng' THEN 'en' WHEN 'swa' THEN 'sw' END, regexp_extract(lower(lang), '^([a-z]+)', 1)) END"


def _grams(words: str, n: int) -> str:
    return f"CASE WHEN len({words}) >= {n} THEN list_transform(generate_series(1, len({words}) - {n - 1}), lambda i: array_to_string({words}[i : i + {n - 1}], ' ')) ELSE [] END"


_BM25 = rf"""docs AS (SELECT doc_id, {_WORDS.format('lower(text)')} AS w FROM documents WHERE text IS NOT NULL), q AS (SELECT item_id AS qid, {_WORDS.format('lower(text)')} AS w FROM eval_item WHERE item_id % 100 = 0),
    post AS (SELECT t, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM docs) GROUP BY ALL), corpus AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(w) AS DOUBLE)) AS avgdl FROM docs),
    raw AS (SELECT t, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM post, corpus GROUP BY t, n), idf AS (SELECT t, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    asked AS (SELECT qid, t, count(*) AS qf FROM (SELECT qid, unnest(w) AS t FROM q) GROUP BY ALL),
    scored AS (SELECT qid, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len(w) / avgdl))), 6) AS score FROM asked JOIN idf USING (t) JOIN post USING (t) JOIN docs USING (doc_id), corpus GROUP BY qid, doc_id),
    filled AS (SELECT qid, doc_id, coalesce(score, 0) AS score FROM (SELECT qid FROM q) x CROSS JOIN (SELECT doc_id FROM docs) y LEFT JOIN scored USING (qid, doc_id)),
    bm AS (SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM filled) WHERE rank <= 10)"""
_DENSE = """dense AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10)"""
_METRICS = f"""{_DENSE}, rel AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    ideal AS (SELECT qid, sum(CASE WHEN r <= 10 THEN 1 / log2(r + 1) END) AS ideal, count(*) AS n FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS r FROM rel) GROUP BY qid),
    hits AS (SELECT qid, sum(1 / log2(rank + 1)) AS dcg, count(*) AS found, min(rank) AS first FROM dense JOIN rel USING (qid, doc_id) GROUP BY qid),
    metrics AS (SELECT qid, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(CAST(found AS DOUBLE) / n, 0), 6) AS recall, round(coalesce(CAST(1 AS DOUBLE) / first, 0), 6) AS mrr FROM ideal LEFT JOIN hits USING (qid))"""

ORACLE = {
    "sanitize_ids": f"SELECT model_id, {_SID} AS short_id, regexp_replace(lower(model_id), '[^a-z0-9]', '', 'g') AS plain, regexp_replace({_SID}, '_[0-9a-f]{{6}}$', '') AS without_hash FROM (SELECT DISTINCT model_id FROM unified_results WHERE model_id IS NOT NULL)",
    "parse_sizes": f"""SELECT params, CAST(count(*) AS BIGINT) AS n, any_value({_SIZE}) AS number, any_value(CASE WHEN {_SIZE} >= 1e9 THEN concat(CAST(CAST({_SIZE} / 1e9 AS DECIMAL(10, 1)) AS VARCHAR), 'B') WHEN {_SIZE} IS NOT NULL THEN concat(CAST(CAST(round({_SIZE} / 1e6) AS BIGINT) AS VARCHAR), 'M') END) AS written
        FROM leaderboard WHERE params IS NOT NULL GROUP BY params""",
    "unwrapped_names": r"SELECT model, split_part(regexp_replace(model, '^\s*\[([^\]]*)\]\([^)]*\)\s*$', '\1'), '/', -1) AS name FROM (SELECT DISTINCT model FROM leaderboard WHERE model IS NOT NULL)",
    "markdown_strip": r"""WITH a AS (SELECT doc_id, max(content) AS c FROM corpus_document WHERE doc_id IS NOT NULL AND content IS NOT NULL GROUP BY doc_id),
        b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '(?m)^#{1,6}[@]+', '', 'g'), '\n{3,}', E'\n\n', 'g'), '^[@]+|[@]+$', '', 'g') AS c FROM a)
        SELECT doc_id, length(c) AS n, md5(c) AS md5 FROM b""".replace("@", BLANKS),
    "token_counts_by_language": rf"""WITH d AS (SELECT {_BASE} AS language, {_WORDS.format('text')} AS w, length(regexp_replace(text, '[ \t\r\n]+', '', 'g')) AS c FROM documents WHERE text IS NOT NULL)
        SELECT language, docs, words, chars, coalesce(k, 0) AS distinct_words FROM (SELECT language, CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS words, CAST(sum(c) AS BIGINT) AS chars FROM d GROUP BY language)
        LEFT JOIN (SELECT language, CAST(count(DISTINCT t) AS BIGINT) AS k FROM (SELECT language, unnest(w) AS t FROM d) GROUP BY language) USING (language)""",
    "ngram_contamination": f"""WITH d AS (SELECT coalesce(lang, '') AS language, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL), own AS (SELECT DISTINCT language, unnest({_grams('w', 8)}) AS g FROM d),
        ref AS (SELECT DISTINCT unnest({_grams('w', 8)}) AS g FROM (SELECT {_WORDS.format('text')} AS w FROM eval_item))
        SELECT language, CAST(count(*) AS BIGINT) AS n_grams, CAST(count(r.g) AS BIGINT) AS n_shared, CAST(count(r.g) AS DOUBLE) * 100 / count(*) AS overlap_pct FROM own LEFT JOIN ref r ON own.g = r.g GROUP BY language""",
    "char_ngram_contamination": r"""WITH d AS (SELECT language, regexp_replace(content, '[ \t\r\n]+', ' ', 'g') AS c FROM corpus_document WHERE content IS NOT NULL), own AS (SELECT DISTINCT language, unnest(CASE WHEN length(c) >= 8 THEN list_transform(generate_series(1, length(c) - 7), lambda i: substr(c, i, 8)) ELSE [] END) AS g FROM d),
        ref AS (SELECT DISTINCT unnest(CASE WHEN length(c) >= 8 THEN list_transform(generate_series(1, length(c) - 7), lambda i: substr(c, i, 8)) ELSE [] END) AS g FROM (SELECT regexp_replace(text, '[ \t\r\n]+', ' ', 'g') AS c FROM eval_item))
        SELECT language, CAST(count(*) AS BIGINT) AS n_grams, CAST(count(r.g) AS BIGINT) AS n_shared, CAST(count(r.g) AS DOUBLE) * 100 / count(*) AS overlap_pct FROM own LEFT JOIN ref r ON own.g = r.g GROUP BY language""",
    "duplicate_texts": "SELECT min(doc_id) AS first_id, CAST(count(*) AS BIGINT) AS copies, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "first_numbers": """WITH p AS (SELECT DISTINCT ON (query_id) query_type, least(1000, coalesce(TRY_CAST(nullif(regexp_extract(answer, '([0-9]{1,15})', 1), '') AS BIGINT), 0)) AS n FROM qar_pair WHERE answer IS NOT NULL)
        SELECT query_type, CAST(sum(n) AS BIGINT) AS total, CAST(count(*) FILTER (n = 0) AS BIGINT) AS without FROM p GROUP BY query_type""",
    "prompt_keys": r"""WITH p AS (SELECT query_id, min(question) AS question, any_value(keypoints) AS k FROM qar_pair WHERE query_id IS NOT NULL AND question IS NOT NULL GROUP BY query_id),
        t AS (SELECT query_id, substr(concat_ws(E'\n', trim(question), array_to_string(list_transform(k, lambda x, i: concat(CAST(i AS VARCHAR), '. ', x)), E'\n')), 1, 200) AS prompt FROM p)
        SELECT query_id, length(prompt) AS n, substr(sha256(prompt), 1, 16) AS key FROM t""",
    "bm25_topk": f"WITH {_BM25} SELECT qid, doc_id, score, rank FROM bm",
    "dense_topk": f"WITH {_DENSE} SELECT * FROM dense",
    "retrieval_metrics": f"WITH {_METRICS} SELECT * FROM metrics",
    "metrics_by_label": f"""WITH {_METRICS}, m AS (SELECT label, count(*) AS queries, round(avg(ndcg), 5) AS ndcg, round(avg(recall), 5) AS recall, round(avg(mrr), 5) AS mrr FROM metrics JOIN embeddings ON qid = vec_id GROUP BY label)
        SELECT CAST(label AS BIGINT) AS label, CAST(coalesce(queries, 0) AS BIGINT) AS queries, coalesce(ndcg, 0) AS ndcg, coalesce(recall, 0) AS recall, coalesce(mrr, 0) AS mrr FROM (SELECT DISTINCT label FROM embeddings) LEFT JOIN m USING (label)""",
    "rrf_fusion": f"""WITH {_BM25}, hits AS (SELECT qid, doc_id, count(*) AS c FROM (SELECT DISTINCT qid, unnest(w) AS t FROM q) JOIN (SELECT DISTINCT doc_id, unnest(w) AS t FROM docs) USING (t) GROUP BY ALL),
        ov AS (SELECT qid, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, doc_id) AS rank FROM hits) WHERE rank <= 10)
        SELECT qid, doc_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS score FROM (SELECT qid, doc_id, rank FROM bm UNION ALL SELECT qid, doc_id, rank FROM ov) GROUP BY ALL""",
    "vector_norms": "SELECT CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n, round(avg(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS mean_norm FROM embeddings GROUP BY label",
}
