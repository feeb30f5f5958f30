import json
import os

from pyspark.sql import functions as F

from tausift.functions.text import first_integer, markdown_free, short_id, size_number, word_ngrams, word_tokens
from tausift.operators.incremental import first_wins, gate, latest, pending, replaced, through_cache, token_batches
from tausift.operators.lookup import by_priority, contained_tokens, exact_or_unique, longest_prefix
from tausift.operators.retrieval import bm25, dense_top_k, evaluate, fuse, gram_overlap
from tausift.sources.readers import find_key, first_existing, flatten_results, latest_revisions, read_cached, read_config, read_csv, read_latest_log, read_retrieval_set, read_wide_csv, remote_vectors, retrieval_set_of
from tausift.sources.writers import latex_table, markdown_table, merge_json, upsert_parquet, write_csv_with_preamble


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("# note\nmodel_id,task_name,ndcg_at_10\nm,t,0.5\nm,u,NaN\n")
    assert [r.ndcg_at_10 for r in read_csv(spark, str(p), "model_id string, task_name string, ndcg_at_10 double").collect()] == [0.5, None]
    w = tmp_path / "w.csv"
    w.write_text(",Model,a,b\n0,[m](http://x),1.5,--\n1,n,NaN,2\n")
    assert sorted(tuple(r) for r in read_wide_csv(spark, str(w)).collect()) == [("m", "a", 1.5), ("n", "b", 2.0)]
    assert read_wide_csv(spark, str(w), tasks=["z"]).count() == 0
    assert first_existing(spark, [str(tmp_path / "none*"), str(p)]) == str(p) and first_existing(spark, []) is None
    out = tmp_path / "o.csv"
    write_csv_with_preamble(spark.createDataFrame([(1, "a,b", 2)], "x int, y string, z int"), str(out), ["cpu"], ["y", "x"])
    assert out.read_text() == '# cpu\ny,x\n"a,b",1\n'


def test_logs_and_configs(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"k": "a", "n": 1}\nbroken\n{"k": "a", "n": 2}\n{"k": "b", "n": 1}\n')
    assert sorted(tuple(r) for r in read_latest_log(spark, str(p), "k string, n long", ["k"], "n").collect()) == [("a", 2), ("b", 1)]
    assert read_config(str(tmp_path / "no"), {"x": 1}) == {"x": 1}
    (tmp_path / "c").write_text('{"x": 2}')
    assert read_config(str(tmp_path / "c"), {"x": 1, "y": 3}) == {"x": 2, "y": 3}
    assert merge_json(str(tmp_path / "m.json"), {"a": 1}) == {"a": 1} and merge_json(str(tmp_path / "m.json"), {"b": 2}) == {"a": 1, "b": 2}


def test_retrieval_set(spark, tmp_path):
    os.makedirs(tmp_path / "qrels")
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "T", "text": "x"}\n\n{"_id": "d2", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "?"}\n')
    (tmp_path / "qrels/test.tsv").write_text("q\t0\td1\t1\nshort\tline\n")
    corpus, queries, relevance = read_retrieval_set(spark, str(tmp_path))
    assert {tuple(r) for r in corpus.collect()} == {("d1", "T x"), ("d2", "y")} and [tuple(r) for r in relevance.collect()] == [("q", "d1", 1)] and queries.count() == 1
    pairs = spark.createDataFrame([(1, "P", "l1", "a"), (2, "P2", "l1", "b"), (3, "R", "l2", "a")], "pos long, passage string, doc_id string, question string")
    docs, asked, rel = retrieval_set_of(pairs, "pos", "passage", "doc_id", "question")
    assert {tuple(r) for r in docs.collect()} == {("C0", "P"), ("C1", "R")} and {tuple(r) for r in asked.collect()} == {("Q0", "a"), ("Q1", "b")}
    assert {(r.qid, r.doc_id) for r in rel.collect()} == {("Q0", "C0"), ("Q1", "C0"), ("Q0", "C1")}


def test_nested_results(spark):
    entry = lambda langs, n, m: {"languages": langs, "hf_subset": "s", "ndcg_at_10": n, "main_score": m}
    docs = [("e", "t", json.dumps({"scores": {"dev": [entry(["x"], 0.1, 0.2), entry(["x"], 0.3, 0.2)], "train": [entry(["x"], 0.9, 0.9)]}})), ("e", "u", json.dumps({"scores": {"train": [entry(["x"], None, 0.4), entry(["a", "b", "c"], 1, 1)]}})), ("e", "v", "broken"), ("e", "w", None)]
    got = sorted(tuple(r) for r in flatten_results(spark.createDataFrame(docs, "e string, t string, b string"), "e", "t", "b").collect())
    assert got == [("e", "t", "dev", "x", 0.3), ("e", "u", "train", "x", 0.4)]
    bodies = spark.createDataFrame([('{"a": [{"X": {"ndcg": "no"}}, {"Ndcg": 3}]}',), ("broken",), (None,)], "b string")
    assert [r.v for r in bodies.select(find_key(F.col("b"), "NDCG").alias("v")).collect()] == [3.0, None, None]
    revs = spark.createDataFrame([("a", "r1"), ("a", "r9"), ("a", "external")], "e string, r string")
    assert [tuple(r) for r in latest_revisions(revs, "e", "r", ["external"]).collect()] == [("a", "r9")]


def test_incremental(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v long")
    assert sorted(map(tuple, replaced(replaced(old, new, ["k"]), new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, first_wins(["k"], old, new).collect())) == [("a", 1), ("b", 2), ("c", 4)]
    assert [r.k for r in pending(old, new, ["k"]).collect()] == ["a"]
    assert sorted(map(tuple, latest(old.union(new), ["k"], ["v"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    cached = through_cache(old.select("k"), new, ["k"], "v", lambda m: m.withColumn("v", F.lit(9).cast("long")))
    assert sorted(map(tuple, cached.collect())) == [("a", 9, False), ("b", 3, True)]
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate((5, 5, 5, 50, 1, None))] + [("h", 0, 1)], "g string, i long, n long")
    got = sorted((r.g, r.i, r.batch) for r in token_batches(rows, "g", "i", "n", 2, 12).collect())
    assert got == [("g", 0, 0), ("g", 1, 0), ("g", 2, 1), ("g", 3, 2), ("g", 4, 3), ("g", 5, 3), ("h", 0, 0)]
    assert sorted((r.k, r.valid) for r in gate(old, F.col("k"), F.col("v"), {"a": 1.0}).collect()) == [("a", True), ("b", False)]
    p = str(tmp_path / "t")
    upsert_parquet(spark, p, old, ["k"])
    assert sorted(map(tuple, spark.read.parquet(upsert_parquet(spark, p, new, ["k"])).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    c = str(tmp_path / "c")
    assert read_cached(spark, c, old).count() == 2 and read_cached(spark, c, new.limit(0)).count() == 2


def test_names(spark):
    name = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    low = F.lower("name")
    assert sorted(map(tuple, exact_or_unique(name("A", "b", "c", None), name("A", "B", "C", "c"), "name", low, low).collect())) == [("A", "A", "exact"), ("b", "B", "short"), ("c", "c", "exact")]
    assert list(map(tuple, longest_prefix(name("abcdefgh", "abc"), name("abcdefxx", "abcdefgz", "zz"), "name").collect())) == [("abcdefgh", "abcdefgz", 7)]
    assert list(map(tuple, contained_tokens(name("x-a-b-y", "q"), name("a", "a-b", "b-y-z"), "name").collect())) == [("x-a-b-y", "a-b")]
    codes = spark.createDataFrame([("s", "c1", 0), ("s", "c2", 1)], "slice string, code string, p long")
    assert list(map(tuple, by_priority(spark.createDataFrame([("c2", 5.0)], "code string, v double"), codes, "slice", "code", "p", "v").collect())) == [("s", "c2", 5.0)]


def test_text(spark):
    df = spark.createDataFrame([("org/My Model!", "**b** *i*\n# H\n\n\n\nx ", "118M", "answer 12 of 15")], "a string, m string, s string, n string")
    r = df.select(short_id("a").alias("a"), markdown_free("m").alias("m"), size_number("s").alias("s"), first_integer("n", 10).alias("n")).first()
    assert r.a.startswith("My_Model__") and r.m == "b i\nH\n\nx" and r.s == 118e6 and r.n == 10
    g = spark.createDataFrame([("a b, c d",), ("a",)], "t string").withColumn("w", word_tokens("t")).select(word_ngrams(F.col("w"), 3).alias("g")).collect()
    assert [x.g for x in g] == [["a b c", "b c d"], []]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["c"]), (4, [])], "doc_id long, tokens array<string>")
    run = {r["rank"]: r.doc_id for r in bm25(spark.createDataFrame([("q", ["a"])], "qid string, tokens array<string>"), docs, 4).collect()}
    assert run == {1: 1, 2: 2, 3: 3, 4: 4}
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0])], "id long, embedding array<float>")
    got = [(r.doc_id, r.score) for r in dense_top_k(v.filter("id = 0"), v, 2, same=True).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 0.0)]
    assert dense_top_k(v.limit(0), v, 2).count() == 0


def test_fusion_and_metrics(spark):
    runs = spark.createDataFrame([("r1", "q", "A", 1), ("r1", "q", "B", 2), ("r2", "q", "A", 1), ("r2", "q", "B", 2)], "run string, qid string, doc_id string, rank long")
    assert {r.doc_id: round(r.score, 9) for r in fuse(runs).collect()} == {"A": round(2 / 61, 9), "B": round(2 / 62, 9)}
    assert fuse(runs.limit(0)).count() == 0
    rel = spark.createDataFrame([("q", "A", 1), ("p", "Z", 1), ("o", "A", 0)], "qid string, doc_id string, rel int")
    got = {r.qid: (r.ndcg, r.recall, r.mrr) for r in evaluate(runs.filter("run = 'r1'").select("qid", "doc_id", "rank"), rel).collect()}
    assert got == {"q": (1.0, 1.0, 1.0), "p": (0.0, 0.0, 0.0)}
    o = gram_overlap(spark.createDataFrame([("g", ["x", "y"]), ("g", ["x"]), ("h", [])], "k string, grams array<string>"), "k", "grams", spark.createDataFrame([(["x"],)], "grams array<string>"))
    assert [tuple(r) for r in o.collect()] == [("g", 2, 1, 50.0)]


def test_tables(spark):
    df = spark.createDataFrame([("a_b", 0.123456, True), ("c", None, False)], "k string, v double, hit boolean")
    assert markdown_table(df, bold="hit").splitlines()[2:] == ["| **a_b** | **0.1235** |", "| c | — |"]
    assert r"a\_b & 0.123" in latex_table(df.select("k", "v"), "t")


def test_remote_vectors(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "c")], "id long, text string")

    def connect():
        return lambda texts: [[float(len(t))] for t in texts]

    assert sorted((r.id, r.embedding) for r in remote_vectors(df, "id", "text", connect, batch=1).collect()) == [(1, [2.0]), (2, [1.0])]


def test_result_documents_of_any_layout(spark):
    from tausift.sources.readers import result_scores, score_at, task_scores

    e = '{"languages": ["%s"], "hf_subset": "%s", "ndcg_at_10": %s, "main_score": %s}'
    rows = [
        ("list", '{"scores": {"test": [' + ", ".join([e % ("ita", "a", 0.1, 0.2), e % ("hin", "b", "null", 0.4), e % ("ita", "c", 0.3, 0.6)]) + "]}}"),
        ("keyed", '{"scores": {"test": {"ita": {"ndcg_at_10": 0.5}, "hin": {"ndcg_at_10": null}}}}'),
        ("top", '{"scores": {"test": []}, "test": [' + e % ("hin", "b", 0.7, 0.8) + "]}"),
        ("dev", '{"scores": {"dev": [' + e % ("hin", "b", 0.9, 0.9) + '], "train": [' + e % ("hin", "x", 0.1, 0.3) + "]}}"),
        ("broken", "{"),
        ("none", None),
    ]
    df = spark.createDataFrame([(k, "t", b) for k, b in rows], "entity string, task string, body string")
    by_language, means = result_scores(df, "entity", "task", "body")
    assert sorted((r.entity, r.language, r.score) for r in by_language.collect()) == [("dev", "hin", 0.9), ("keyed", "ita", 0.5), ("list", "ita", 0.3), ("top", "hin", 0.7)]
    assert sorted((r.entity, r.n, round(r.score, 4)) for r in means.collect()) == [("dev", 2, 0.5), ("list", 3, 0.2667)]
    at = {r.entity: r.s for r in df.select("entity", score_at(df.body, ["ita"]).alias("s")).collect()}
    assert at == {"list": 0.1, "keyed": 0.5, "top": None, "dev": None, "broken": None, "none": None}
    declared = df.selectExpr("*", "array('dev', 'train') splits", "array('b', 'x') subsets", "array('ita') prefixes")
    got = {r.entity: (r.splits, round(r.score, 4)) for r in task_scores(declared.filter("entity <> 'keyed'"), "entity", "task", "body", "splits", "subsets", "prefixes").collect()}
    assert got == {"list": (1, 0.4), "dev": (2, 0.6)}


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from tausift.runtime import shared_dir

    missing = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: missing)))
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
