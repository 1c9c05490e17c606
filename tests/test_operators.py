import pytest
from pyspark.sql import functions as F

from lectern import vocab
from lectern.operators import evaluate, rank, sequence, structure, summarize, understand, vectors
from lectern.sources import landed, sinks

PAPER = "paper_key long, title string, authors array<string>, year int, abstract string, retrieval_idx int, extra string"


def papers(spark, *abstracts):
    rows = [(i, f"T{i}", ["A B", "C D", "E F"], 2000 + i if i else None, a, i, "x") for i, a in enumerate(abstracts)]
    return spark.createDataFrame(rows, PAPER)


def test_language(spark):
    d = spark.createDataFrame([("Deep learning for medical diagnosis",), ("État de l'art en apprentissage profond",), ("ab",), (None,)], "t string")
    assert [r[0] for r in d.select(understand.detect_language(F.col("t"))["language"]).collect()] == ["en", "fr", "unknown", "unknown"]


def test_intent_ties_and_none(spark):
    d = spark.createDataFrame([("a literature review",), ("method and review",), ("nothing here",), (None,)], "t string")
    assert [r[0] for r in d.select(understand.detect_intent(F.col("t"))).collect()] == ["survey", "survey", "general", "general"]
    assert d.select(understand.intent_scores(F.col("t"))["survey"]).first()[0] == 4


def test_expand(spark):
    d = spark.createDataFrame([("deep learning diagnosis", ["medical ai", "cnn"])], "q string, e array<string>")
    assert d.select(understand.expand_query(F.col("q"), F.col("e"))).first()[0] == ["ai", "cnn", "deep", "diagnosis", "learning", "medical"]


def test_entity_topk(spark):
    import random

    rng = random.Random(8)
    v = [(i % 3, f"t{i}", i, [rng.gauss(0, 1) for _ in range(4)], "x") for i in range(40)] + [(0, "n", 99, None, "x"), (0, "tie", 100, [1.0, 0.0, 0.0, 0.0], "x"), (0, "tie2", 101, [1.0, 0.0, 0.0, 0.0], "x")]
    q = [(i, [1.0, 0.0, 0.0, 0.1 * i]) for i in range(7)] + [(50, None)]
    words = spark.createDataFrame(v, "category int, term string, pos int, embedding array<double>, score string")
    asked = spark.createDataFrame(q, "query_id long, embedding array<double>")
    got = {(r.query_id, r.category, r["rank"]): r.term for r in understand.entity_topk(asked, words, 2, -1.0, block=3).collect()}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) ** 0.5 + 1e-8) * (sum(y * y for y in b) ** 0.5 + 1e-8)), 6)
    for i, e in q[:-1]:
        for c in range(3):
            best = sorted(((-cos(e, w[3]), w[2], w[1]) for w in v if w[0] == c and w[3]))[:2]
            assert [got[i, c, 1], got[i, c, 2]] == [b[2] for b in best]
    assert understand.entity_topk(asked.limit(0), words).count() == 0


def test_tfidf_summary_edges(spark):
    d = papers(spark, "Cats sit. Dogs run fast in parks. Cats and dogs eat. Birds fly.", "", None, "One only.", "Same text here. Same text here. Same text here.", "! ? .")
    got = {r[0]: r[1] for r in summarize.tfidf_summary(d, "paper_key", "abstract", 2).collect()}
    assert got[0] == "Cats sit. Dogs run fast in parks." or got[0].count(".") == 2
    assert (got[1], got[2], got[3]) == ("", "", "One only.")
    assert got[4] == "Same text here. Same text here."
    assert got[5] == "! ?"


def test_tfidf_weights_are_normalized(spark):
    w = summarize.tfidf_weights(papers(spark, "Alpha beta beta. Alpha gamma delta."), "paper_key", "abstract")
    assert all(abs(r[1] - 1) < 1e-9 for r in w.groupBy("idx").agg(F.sum(F.col("w") * F.col("w"))).collect())


def test_smart_extract(spark):
    text = "We propose a novel deep learning method for this task. The weather was nice on that day in May. Our results show that accuracy achieves new heights. It outperforms the data baseline approach clearly. Another plain sentence follows right here now."
    e = papers(spark, text, None, "short").select(summarize.smart_extract(F.col("abstract")).alias("e")).collect()
    assert len(e[0].e.key_sentences) == 4 and e[0].e.key_sentences[0].startswith("We propose a novel")
    assert "AI" not in e[0].e.important_terms and e[0].e.important_terms[:3] == ["method", "approach", "results"]
    assert e[0].e.structured_summary.startswith("FOCUS: ")
    assert (e[1].e.key_sentences, e[1].e.paper_focus, e[2].e.contribution) == ([], "Research study", "Presents findings")


def test_simple_and_truncated(spark):
    d = papers(spark, "tiny", "a" * 160, None)
    assert [r[0] for r in d.select(summarize.truncated(F.col("abstract"))).collect()] == ["tiny", "a" * 150 + "...", None]
    assert d.select(summarize.simple_summary(F.col("abstract"))).first()[0] == "tiny"


def test_selector(spark):
    d = spark.createDataFrame([("auto",), ("tfidf",), ("lsa",), ("mistral",)], "m string")
    p = summarize.primary_summary(F.col("m"), F.lit("t"), F.lit("l"), F.lit("a"))
    assert [tuple(r[0]) for r in d.select(p).collect()] == [("a", "abstractive"), ("t", "tfidf"), ("l", "lsa"), ("t\nl", "combined")]


def test_hash_embedding_and_cosine(spark):
    v = spark.range(1).select(vectors.hash_embedding(F.lit("abc")).alias("v")).first().v
    assert len(v) == 384 and abs(sum(x * x for x in v) - 1) < 1e-5 and not any(v[16:])
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "k long, embedding array<float>")
    assert [r.k for r in vectors.rank_by_cosine(d, [1.0, 0.0], 2, "k").collect()] == [1, 2]


def test_rank_plan_is_a_bounded_topk(spark):
    d = papers(spark, "A sentence long enough to pass the filter of fifty characters. Another one.", None, "short")
    out = rank.rank_texts(d, "question", 5, "abstract")
    assert [r.paper_key for r in out.collect()] == [0]
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().executedPlan().toString()


def test_fast_mode(spark):
    rows = rank.fast_mode(papers(spark, *["A long sentence about a novel method for data analysis in practice."] * 3), 2).collect()
    assert [(r.paper_key, r.score) for r in rows] == [(0, 0.8), (1, 0.8)]
    assert "(None)" in rows[0].final_response


def test_sections(spark):
    body = "Abstract\n" + "\n".join(f"abstract line {i} with words" for i in range(12)) + "\n1. Introduction\n" + "\n".join(f"intro line {i} with words" for i in range(12)) + "\nMethods\nMethod\n" + "\n".join(f"method line {i} with words" for i in range(12)) + "\nResults\n" + "\n".join(f"result line {i}" for i in range(12))
    d = spark.createDataFrame([(body,)], "t string")
    found = [r.section_type for r in d.select(structure.headers(F.col("t")).alias("h")).first().h]
    assert found == ["abstract", "introduction", "methodology", "results"]
    kept = d.select(structure.resolved(structure.headers(F.col("t"))).alias("h")).first().h
    assert [h.start_idx for h in kept] == [0, 13, 27, 40]
    m = d.select(structure.sections(F.col("t")).alias("m")).first().m
    assert set(m) == {"abstract", "introduction", "methodology", "results"} and m["results"].startswith("result line 0")


def test_near_header_is_replaced_only_by_a_better_one(spark):
    d = spark.createDataFrame([("Analysis\nx\n2. Results\n" + "y\n" * 20,)], "t string")
    assert [h.header_text for h in d.select(structure.resolved(structure.headers(F.col("t"))).alias("h")).first().h] == ["2. Results"]


def test_facet_and_default(spark):
    content = "We propose a new approach to parse long texts quickly. We propose a new approach to parse long texts fast. The novel framework is useful for many readers. Unrelated words fill this sentence without any cue at all"
    d = spark.createDataFrame([({"abstract": content},), ({"x": "y"},)], "m map<string,string>")
    got = [r[0] for r in d.select(structure.facet(F.col("m"), "contributions")).collect()]
    assert got[0] == "We propose a new approach to parse long texts quickly." and got[1] == vocab.FACETS["contributions"][3]


def test_quality(spark):
    d = spark.createDataFrame([("",), (None,), ("Results not clearly identified in available sections.",), ("The accuracy improves and performance is better in the experiment and evaluation results.",)], "c string")
    q = [r[0] for r in d.select(structure.quality(F.col("c"), "results")).collect()]
    assert q[:3] == [0.1, 0.1, 0.1] and q[3] > 0.8
    assert d.select(structure.level(F.lit(0.6))).first()[0] == "good"


def test_analyze_reads_whole_texts(spark):
    text = "The river is long and the lake is deep today.\n" * 1500 + "\nConclusion\nWe propose a new approach to parse long texts quickly.\n"
    d = spark.createDataFrame([(1, text)], "k long, t string")
    assert "to parse long texts" in structure.analyze(d, "k", "t").first().contributions
    assert "to parse long texts" not in structure.analyze(d, "k", "t", 50_000).first().contributions


def test_analyze_short_and_empty(spark):
    d = spark.createDataFrame([(1, "short"), (2, None), (3, "word " * 200 + "\n" + "We use a model based on data.\n" * 30)], "doc_id long, text string")
    got = {r.doc_id: r for r in structure.analyze(d, "doc_id", "text").collect()}
    assert got[1].status == got[2].status == "too_short" and got[1].overall_score is None
    assert got[3].status == "ok" and 0 <= got[3].overall_score <= 1
    assert structure.analyze(d.limit(0), "doc_id", "text").count() == 0


def test_rouge(spark):
    d = spark.createDataFrame([(1, "the cat sat", "the cat sat"), (2, "a b", "b c d"), (3, None, "x"), (4, "", "")], "k long, c string, r string")
    got = {r.k: r.f1 for r in evaluate.rouge_1(d, "k", "c", "r").collect()}
    assert got == {1: 1.0, 2: 0.4, 3: 0.0, 4: 0.0}


def test_feedback_stats(spark):
    d = spark.createDataFrame([("q", "p", True, None), ("q", "p", False, "n"), ("q", "p2", None, None)], "query string, paper_id string, relevant boolean, notes string")
    assert {(r.paper_id, r.votes, r.share) for r in evaluate.feedback_stats(d).collect()} == {("p", 2, 0.5), ("p2", 0, None)}


def test_readers(spark):
    pay = {
        "semantic_scholar": '{"data":[{"paperId":"a","title":" T ","authors":[{"name":"N"},{}],"year":2020,"openAccessPdf":{"url":"u"}}]}',
        "crossref": '{"message":{"items":[{"DOI":"d","title":["T"],"author":[{"given":"G","family":"F"},{"family":"X"}],"published-online":{"date-parts":[[2019,5]]},"URL":"u"}]}}',
        "arxiv": '{"entries":[{"entry_id":"e","title":"T","summary":"S","published":"2021-01-01","authors":["A"],"links":[{"href":"h","title":"x"},{"href":"z.pdf","title":"y"}]}]}',
        "pubmed": '{"PubmedArticleSet":{"PubmedArticle":[{"MedlineCitation":{"PMID":{"$":"1"},"Article":{"ArticleTitle":"T","Abstract":{"AbstractText":["a","b"]},"AuthorList":{"Author":[{"ForeName":"F","LastName":"L"},{"LastName":"M"}]}},"DateCompleted":{"Year":"2018","Month":"5"}}}]}}',
    }
    year = {"semantic_scholar": 2020, "crossref": 2019, "arxiv": 2021, "pubmed": 2018}
    for api, p in pay.items():
        d = spark.createDataFrame([(p,), ("not json",), (None,)], "payload string")
        rows = landed.read(d, api).collect()
        assert len(rows) == 1 and rows[0].year == year[api] and rows[0].title == "T"
    with pytest.raises(ValueError):
        landed.read(spark.createDataFrame([("x",)], "payload string"), "other")


def test_paper_id_urls(spark):
    d = spark.createDataFrame([("http://arxiv.org/abs/1234.5v2",), ("arxiv:99.1v10",), ("7.7v5",), ("8.8",)], "i string")
    assert [r[0][len("https://arxiv.org/pdf/") :] for r in d.select(landed.pdf_url_of(F.col("i"))).collect()] == ["1234.5.pdf", "99.1.pdf", "7.7.pdf", "8.8.pdf"]


def test_sinks_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("q1", "p1", True, None)], "query string, paper_id string, relevant boolean, notes string")
    sinks.write_log(d, str(tmp_path / "log"))
    sinks.write_log(d, str(tmp_path / "log"))
    assert spark.read.schema(d.schema).json(str(tmp_path / "log")).count() == 2
    sinks.write_run_records(d.select("query", F.struct("paper_id").alias("response")), str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).first()["response"]["paper_id"] == "p1"
    assert sinks.as_json(d).first()[0] == '{"query":"q1","paper_id":"p1","relevant":true,"notes":null}'


def test_feedback_stream(spark, tmp_path):
    from lectern.streaming import logs

    rows = [("q", "p", True, None, "2024-01-01 00:00:01"), ("q", "p", True, None, "2024-01-01 00:00:01"), ("q", "p", False, None, "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "query string, paper_id string, relevant boolean, notes string, at string").write.json(str(tmp_path / "in"))
    run = logs.votes_per_window(logs.feedback_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("votes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("votes").count() in (0, 1)


def test_lag_and_rank(spark):
    d = spark.createDataFrame([(1, i, 100 + i) for i in range(0, 5000, 7)] + [(2, 3, 9)], "k long, o long, v long")
    got = {(r.k, r.o): r.before for r in sequence.lag_in_order(d, "k", "o", "v", "before", span=64).collect()}
    assert got[1, 0] is None and got[2, 3] is None and all(got[1, i] == 100 + i - 7 for i in range(7, 5000, 7))
    ranks = sorted(r.n for r in sequence.rank_in_group(d.where("k = 1"), ["k"], ["v"], "n", salts=8).collect())
    assert ranks == list(range(len(ranks)))
    assert sequence.rank_in_group(d.limit(0), ["k"], ["v"], "n").count() == 0
