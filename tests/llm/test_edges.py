"""All pN queries over empty tables and over odd rows: nulls everywhere, empty and very long texts, repeats, clashing extra columns."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import queries as llm

KEYS = {
    "papers": "paper_key", "catalog_papers": "catalog_key", "search_runs": "run_id", "search_results": "result_id", "structured_summaries": "summary_id", "smart_extracts": "extract_id",
    "documents": "doc_id", "eval_items": "item_id", "container_specs": "spec_id",
}
COLUMNS = {
    "papers": "paper_key long, api string, id string, title string, authors array<string>, year int, abstract string",
    "catalog_papers": "catalog_key long, api string, id string, title string, authors array<string>, year int, abstract string",
    "search_runs": "run_id long, query string, query_language string",
    "search_results": "result_id long, run_id long, paper_id string, link string, final_response string, method string, abstract_summary string",
    "structured_summaries": "summary_id long, paper_id string, limitations string",
    "smart_extracts": "extract_id long, paper_id string, structured_summary string",
    "documents": "doc_id long, text string",
    "eval_items": "item_id long, prompt string, solution string",
    "container_specs": "spec_id int, spec_name string, capacity_tokens int",
}
#: Extra columns with the names that the operators use inside.
CLASH = ["tbl", "row_key", "field", "source", "key", "k", "h", "th", "n", "t", "l", "words", "p", "c", "weight", "score", "block", "rank", "host", "checked"]
LONG = "A sentence about rivers and the sea, word by word. " * 9000


def value(kind, how):
    if how is None:
        return None
    if isinstance(kind, T.StringType):
        return {"empty": "", "blank": " \n ", "long": LONG, "odd": "﻿“(\u0000 \\u12 <p ½ é"}[how]
    if isinstance(kind, T.ArrayType):
        return {"empty": [], "blank": [None, ""], "long": ["A B"] * 500, "odd": ["et al", "?"]}[how]
    return {"empty": 0, "blank": -1, "long": 2_000_000_000, "odd": 7}[how]


def write(spark, folder, rows_of):
    for name, ddl in COLUMNS.items():
        schema = T.StructType.fromDDL(ddl)
        d = spark.createDataFrame(rows_of(name, schema), schema)
        for x in CLASH:
            if x not in d.columns:
                d = d.withColumn(x, F.lit("clash"))
        d.write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("edges")

    def odd(name, schema):
        rows = []
        for i, how in enumerate([None, "empty", "blank", "long", "odd", "odd", "long"]):
            rows.append(tuple(i if f.name == KEYS[name] else value(f.dataType, how) for f in schema))
        return rows + [rows[1]]

    write(spark, root / "empty", lambda name, schema: [])
    write(spark, root / "odd", odd)
    return root


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p5_rejected", "p5_clean", "p6_rates", "p7_containers", "p8_found", "p9_found", "p9_share"])
def test_empty_and_odd_tables(spark, folders, name):
    assert llm.QUERIES[name](spark, str(folders / "empty")).count() == 0
    got = llm.QUERIES[name](spark, str(folders / "odd")).collect()
    if name == "p9_found":
        assert [tuple(r) for r in got] == [(3, 6)]
    if name == "p1_found":
        assert len({r.row_key for r in got if r.tbl == "papers"}) == 4 and sum(r.row_key == 3 and r.tbl == "papers" for r in got) == 9000
    if name == "p5_rejected":
        assert not got
