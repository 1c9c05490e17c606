import json

from lectern.operators import schema_drift as D

SCHEMA = "record_id long, file_id long, stream_id long, file_seq int, payload string, extra string"


def run(spark, files):
    rows, n = [], 0
    for (stream, seq, file_id), records in files.items():
        for r in records:
            n += 1
            rows.append((n, file_id, stream, seq, r if isinstance(r, str) or r is None else json.dumps(r), "x"))
    return spark.createDataFrame(rows, SCHEMA)


def rec(**response):
    return {"query": "q", "response": response}


def changes(spark, files):
    return {(r.file_id, r.change, r.old_field, r.new_field) for r in D.changes(run(spark, files)).collect()}


def test_add_remove_rename_retype_and_objects(spark):
    files = {
        (1, 1, 10): [rec(intent="survey", results=[{"score": 0.51, "method": "lsa", "answer": "a long answer about glaciers"}]), "broken {", None],
        (1, 3, 11): [rec(query_intent="survey", results=[{"score": "0.51", "method": {"name": "lsa", "rev": 1}, "final_response": "a long answer about glaciers", "new": None}])],
        (1, 4, 12): [rec(results=[{"method": {"name": "lsa", "rev": 1}}], performance={"n": 1})],
        (2, 1, 20): [rec(results=[])],
    }
    assert changes(spark, files) == {
        (11, "renamed", "response.intent", "response.query_intent"), (11, "retyped", "response.results.score", "response.results.score"),
        (11, "retyped", "response.results.method", "response.results.method"), (11, "renamed", "response.results.answer", "response.results.final_response"),
        (12, "removed", "response.query_intent", ""), (12, "removed", "response.results.score", ""), (12, "removed", "response.results.final_response", ""), (12, "added", "", "response.performance"),
    }


def test_repeats_and_empty(spark):
    files = {(1, 1, 1): [rec(a="x")] * 3, (1, 2, 2): [rec(a="y")] * 2}
    assert changes(spark, files) == set()
    empty = spark.createDataFrame([], SCHEMA)
    assert D.changes(empty).count() == 0
    assert D.unified(empty, D.changes(empty)).count() == 0


def test_rename_is_known_by_any_value_of_the_field(spark):
    files = {(100 + 3 * i + k, 1, 1000 + 3 * i + k): [rec(topic=f"v{i:03}")] for i in range(80) for k in range(3)}
    files |= {(1, 1, 1): [rec(topic="v000")], (1, 2, 2): [rec(zone="v079")]}
    assert changes(spark, files) == {(2, "renamed", "response.topic", "response.zone")}


def test_unified_reads_all_names(spark):
    files = {
        (1, 1, 1): [rec(summary_method="lsa", results=[{"paper_id": "p", "score": 0.5, "final_response": "text one"}])],
        (1, 2, 2): [rec(summaryMethod="lsa", results=[{"paper_id": "p", "score": "0.5", "final_response": {"text": "text one", "n_chars": 8}}]), rec(summaryMethod="lsa", results=[])],
    }
    d = run(spark, files)
    got = sorted(((r.file_id, r.result_rank or 0, r.summary_method, r.score, r.final_response) for r in D.unified(d, D.changes(d)).collect()), key=str)
    assert got == [(1, 1, "lsa", 0.5, "text one"), (2, 0, "lsa", None, None), (2, 1, "lsa", 0.5, "text one")]


def test_assignment_is_minimal():
    cost = [[4.0, 1.0, 3.0], [2.0, 0.0, 5.0], [3.0, 2.0, 2.0]]
    assert sum(cost[i][j] for i, j in enumerate(D.assign(cost))) == 5.0


def test_unified_follows_each_stream_and_keeps_every_field(spark):
    files = {
        (1, 1, 1): [rec(method="lsa", results=[{"paper_id": "p", "score": 0.5, "note": {"text": "long words here", "n": 3}}])],
        (1, 2, 2): [rec(used_method="lsa", brand_new=True, results=[{"paper_id": "p", "score": "n/a", "memo": {"text": "long words here", "n": 3}}])],
        (1, 3, 3): [rec(results=[{"paper_id": "p"}]), "broken"],
        (1, 4, 4): [rec(used_method="lsa", results=[])],
        (2, 1, 5): [rec(used_method="tfidf", results=[])],
    }
    d = run(spark, files)
    u = D.unified(d, D.changes(d))
    rows = {r.file_id: r.asDict() for r in u.collect()}
    assert [rows[i]["method"] for i in (1, 2, 3, 4, 5)] == ["lsa", "lsa", None, "lsa", "tfidf"]
    assert rows[2]["brand_new"] is True and rows[1]["brand_new"] is None and rows[2]["text"] == "long words here" and rows[2]["n"] == rows[1]["n"] == 3.0
    assert rows[2]["score"] is None and rows[2]["other_values"] == {"score": "n/a"} and rows[1]["other_values"] is None
    assert set(u.columns) == {"record_id", "file_id", "result_rank", "brand_new", "method", "n", "paper_id", "query", "score", "text", "other_values"}


def test_move_to_another_parent(spark):
    deep = {"summary": {"model": "a long value that is kept as it is"}}
    files = {(1, 1, 1): [rec(**deep)] * 3, (1, 2, 2): [rec(model="a long value that is kept as it is", summary={"x": 1})] * 3}
    got = changes(spark, files)
    assert (2, "moved", "response.summary.model", "response.model") in got and (2, "added", "", "response.model") in got and (2, "removed", "response.summary.model", "") in got


def test_odd_records(spark):
    files = {(1, 1, 1): [None, "", "[1]", "3", '{"a": null}', '{"a": {"b": [[1, null], {"c": []}]}, "long": "' + "x" * 200_000 + '"}'], (1, 2, 2): ["{}"], (None, 3, 3): ['{"a": 1}']}
    got = changes(spark, files)
    assert got == {(2, "removed", "a", ""), (2, "removed", "long", "")} or (2, "removed", "long", "") in got
    d = run(spark, files)
    assert D.unified(d, D.changes(d)).count() == 4
