import pytest
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import arrow, hooks
from lectern.operators import evaluate, rank, respond, structure, summarize, understand
from lectern.sources import landed

PAPER = "paper_key long, title string, authors array<string>, year int, abstract string, body string, retrieval_idx int, extra string"


def papers(spark, *rows):
    return spark.createDataFrame([(i, f"T{i}", ["A B", "C D", "E F"], 2000, a, b, i, "x") for i, (a, b) in enumerate(rows)], PAPER)


def test_hooks():
    with pytest.raises(ValueError):
        hooks.plug("other", None)
    assert not hooks.available("translate") and hooks.answer("translate", None) is None
    tried = []

    def fails():
        tried.append(1)
        raise OSError

    assert hooks.first_that_loads("t", [fails, lambda: "second", lambda: "third"]) == "second"
    assert hooks.first_that_loads("t", [fails]) == "second" and len(tried) == 1
    assert hooks.first_that_loads("none", [fails]) is None


def test_plugged_models_answer_and_short_answers_fall_back(spark):
    d = spark.createDataFrame([("bonjour le monde", "fr"), ("bonjour", "en"), (None, "fr")], "t string, l string")
    hooks.plug("translate", lambda t: F.concat(F.lit("hello  world ,"), t))
    hooks.plug("rewrite", lambda title, a, y, f: F.when(title == "long", F.lit("w" * 101)).otherwise("short"))
    hooks.plug("keywords", lambda t: F.array(F.lit("B"), F.lit("a"), F.lit("b")))
    try:
        assert [r[0] for r in d.select(understand.translated(F.col("t"), F.col("l"))).collect()] == ["hello world,bonjour le monde", "bonjour", None]
        facets = {n: F.lit(n * 3) for n in vocab.FACETS}
        none = F.array().cast("array<string>")
        assert spark.range(1).select(respond.rewritten(F.lit("long"), none, F.lit(1), facets)).first()[0] == "w" * 101
        assert spark.range(1).select(respond.rewritten(F.lit("x"), none, F.lit(1), facets)).first()[0].startswith("This paper presents contributions")
        assert spark.range(1).select(understand.keywords(F.lit("t"))).first()[0] == ["b", "a"]
    finally:
        for n in ("translate", "rewrite", "keywords"):
            hooks.plug(n, None)
    assert spark.range(1).select(understand.keywords(F.lit("t"))).first()[0] == []
    assert tuple(spark.range(1).select(evaluate.bert_score(F.lit("a"), F.lit("b")).alias("b")).first().b) == (0.0, 0.0, 0.0)


def test_full_text_ranking_falls_back_to_the_abstract_and_keeps_the_first(spark):
    long, short = "A body sentence about glaciers and ice. " * 8, "An abstract of more than fifty characters about rivers and lakes."
    d = papers(spark, (short, long), (short, "tiny"), (None, None), (short, long))
    got = {r.paper_key: r.summary for r in rank.rank_full_texts(d, "q", 10, first=3).collect()}
    assert set(got) == {0, 1} and got[0].startswith("A body sentence") and got[1] == short


def test_one_pass_summary_has_no_exchange(spark):
    d = papers(spark, ("Alpha beta. Gamma delta. Alpha beta. Epsilon.", None), (None, None))
    plan = summarize.tfidf_summary(d, "paper_key", "abstract", 2)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {r[0]: r[1] for r in plan.collect()}[1] == ""
    assert {r[0]: r[1] for r in summarize.term_weight(d, "paper_key", "abstract", ["gamma"]).collect()} == {0: 0.707107}


def test_facet_without_findings_takes_the_latent_summary(spark):
    text = "\n".join(f"This plain line number {i} tells of weather and of harbours by the sea." for i in range(40))
    d = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "short", "x")], "k long, t string, status string")
    got = {r.k: r for r in structure.analyze(d, "k", "t").collect()}
    assert got[1].results.startswith("This plain line") and got[1].limitations == vocab.FACETS["limitations"][3]
    assert got[1].abstractive_summary == vocab.NO_REWRITE
    assert got[2].status == got[3].status == "too_short" and got[2].results is None


def test_envelope(spark):
    runs = spark.createDataFrame([(1, "q1"), (2, "q2")], "run_id long, query string")
    for c in ("query_language", "intent", "expanded_query", "api_used", "processing_mode", "summary_method", "run_ts"):
        runs = runs.withColumn(c, F.lit("v"))
    runs = runs.withColumn("entities", F.struct(F.array(F.lit("e")).alias("domain")))
    kinds = "struct<tfidf:string,lsa:string,abstractive:string,combined:string,ollama:string>"
    schema = f"result_id long, run_id long, result_rank int, paper_id string, title string, link string, year int, authors array<string>, score double, summaries {kinds}, final_response string, method string, abstract_summary string, abstractive_summary string, paper_focus string, contribution string, key_terms array<string>"
    row = lambda i, run, rank_, model: (i, run, rank_, f"p{i}", "t", "l", 2000, ["a"], 0.5, ("t", "l", "a", "c", model), "f", "m", "s", "old", "pf", "c", ["k"])
    results = spark.createDataFrame([row(1, 1, 2, ""), row(2, 1, 1, "model"), row(3, 9, 1, None)], schema)
    got = {r.run_id: r.response for r in respond.envelope(runs, results).collect()}
    assert [x.paper_id for x in got[1].results] == ["p2", "p1"] and [x.abstractive_summary for x in got[1].results] == ["model", "a"]
    assert got[1].performance.papers_processed == 2 and got[2].results == [] and set(got) == {1, 2}


def test_single_author_and_odd_details(spark):
    one = '{"PubmedArticleSet":{"PubmedArticle":[{"MedlineCitation":{"PMID":{"$":"7"},"Article":{"ArticleTitle":"T","Abstract":{"AbstractText":"whole"},"AuthorList":{"Author":{"LastName":"L"}}}}},{"MedlineCitation":{"PMID":{"$":"8"}}}]}}'
    details = spark.createDataFrame([(one,), (one,), ("bad",), (None,)], "payload string")
    got = {r.id: r for r in landed.read(details, "pubmed").distinct().collect()}
    assert got["7"].authors == ["L"] and got["7"].abstract == "whole" and got["7"].year is None
    assert got["8"].authors == [] and got["8"].abstract == "" and got["8"].title == ""
    asked = spark.createDataFrame([('{"esearchresult":{"idlist":["9","7"]}}',)], "payload string")
    assert [(r.id, r["rank"]) for r in landed.pubmed_found(asked, details).collect()] == [("7", 1)]


def test_arxiv_sorts(spark):
    entry = lambda i, p, u: f'{{"entry_id":"{i}","title":"T","published":"{p}","updated":"{u}"}}'
    d = spark.createDataFrame([(f'{{"entries":[{entry("a", "2020", "2024")},{entry("b", "2022", "2023")},{entry("c", "2021", "2025")}]}}',)], "payload string")
    order = lambda s: [r.id for r in landed.read(d, "arxiv", sort_by=s).collect()]
    assert order("submittedDate") == ["b", "c", "a"] and order("lastUpdatedDate") == ["c", "a", "b"] and order("anything") == ["a", "b", "c"]


def test_fetched_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.pdf").write_bytes(b"")
    assert [(r.file, r.size) for r in landed.fetched(spark, str(tmp_path)).collect()] == [("a.pdf", 4)]


def test_functions_in_sql(spark):
    arrow.register_all(spark)
    got = spark.sql("select idx, sentence from sentences('First long sentence here, see Fig. 2 there. Second long sentence here.')").collect()
    assert [r.idx for r in got] == [0, 1] and "fig. 2" in got[0].sentence
    assert spark.sql("select porter_stem('relational') s").first().s == "relat"


def test_detection_hook_and_vocabulary(spark, tmp_path):
    d = spark.createDataFrame([("bonjour le monde",), ("ab",)], "t string")
    hooks.plug("detect", lambda t: F.struct(F.lit("en").alias("language"), F.lit(0.9).alias("confidence")))
    try:
        assert [r[0] for r in d.select(understand.detect_language(F.col("t"))["language"]).collect()] == ["en", "unknown"]
    finally:
        hooks.plug("detect", None)
    (tmp_path / "v.json").write_text('{"domain": ["ice", "sea", "ice", ""], "methods": ["cnn"]}')
    got = {(r.category, r.term, r.pos) for r in understand.vocabulary(landed.vocabulary(spark, str(tmp_path))).collect()}
    assert got == {("domain", "ice", 0), ("domain", "sea", 1), ("methods", "cnn", 0)}
