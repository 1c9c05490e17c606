"""Responses: the templates that stand in for a language model, and the nested response of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import hooks
from lectern.operators.summarize import author_line, fallback_summary, year_text


def _authors(authors: Column, shown: int) -> Column:
    return F.array_join(F.slice(F.coalesce(authors, F.array().cast("array<string>")), 1, shown), ", ")


def offline_summary(title: Column, authors: Column, year: Column, extract: Column) -> Column:
    """The summary of an extract where there is no language model."""
    return F.concat(
        F.lit('This paper "'), title, F.lit('" by '), author_line(authors, 2), F.lit(" ("), year_text(year), F.lit(") focuses on "), F.lower(extract["paper_focus"]), F.lit(". "), extract["contribution"],
        F.lit(". Key aspects include: "), F.array_join(F.slice(extract["key_sentences"], 1, 2), ", "), F.lit("."),
    )


def extract_summary(title: Column, authors: Column, year: Column, extract: Column, least: int = 50) -> Column:
    """The model's summary of an extract if it is longer than ``least``; a template otherwise, another one without a model."""
    said = hooks.answer("final_response", title, authors, year, extract)
    if said is None:
        return offline_summary(title, authors, year, extract)
    return F.when(F.length(F.trim(said)) > least, F.trim(said)).otherwise(fallback_summary(title, authors, year, extract))


def final_response(title: Column, authors: Column, year: Column, state: Column) -> Column:
    """The response sentence for each way in which a language model gives none.

    ``state`` is offline, empty, timeout or connection; anything else counts as another error.
    """
    start = F.concat(F.lit("This paper '"), title, F.lit("' by "))
    by = F.concat(start, author_line(authors, 3), F.lit(" ("), year_text(year), F.lit(")"))
    low = F.lower(title)
    return (
        F.when(state == "offline", F.concat(start, _authors(authors, 3), F.lit(" ("), year_text(year), F.lit(vocab.FINAL_RESPONSES["offline"])))
        .when(state == "empty", F.concat(by, F.lit(" presents research on "), low, F.lit(vocab.FINAL_RESPONSES["empty"])))
        .when(state == "timeout", F.concat(by, F.lit(" presents research on "), F.substring(low, 1, 50), F.lit(vocab.FINAL_RESPONSES["timeout"])))
        .when(state == "connection", F.concat(by, F.lit(vocab.FINAL_RESPONSES["connection"])))
        .otherwise(F.concat(by, F.lit(vocab.FINAL_RESPONSES["error"])))
    )


def rewritten(title: Column, authors: Column, year: Column, facets: dict[str, Column], least: int = 100) -> Column:
    """The structured summary as running text: the model's if longer than ``least``, else joined facets; a fixed sentence without a model."""
    said = hooks.answer("rewrite", title, authors, year, F.struct(*[c.alias(n) for n, c in facets.items()]))
    if said is None:
        return F.lit(vocab.NO_REWRITE)
    part = lambda n, k: F.concat(F.substring(facets[n], 1, k), F.lit("..."))
    joined = F.concat(
        F.lit("This paper presents "), part("contributions", 200), F.lit(" The methodology involves "), part("methodology", 200), F.lit(" The results show "), part("results", 200), F.lit(" "), part("limitations", 100),
    )
    return F.when(F.length(F.trim(said)) > least, F.trim(said)).otherwise(joined)


def result(row: DataFrame) -> Column:
    """STRUCT of one result in the response layout, from columns of search results."""
    s = F.col("summaries")
    model = F.nullif(s["ollama"], F.lit(""))
    return F.struct(
        "paper_id", "title", "link", "year", "authors", "score", "summaries", "final_response", "method", "abstract_summary",
        F.coalesce(model, s["abstractive"], F.col("abstractive_summary")).alias("abstractive_summary"), "paper_focus", "contribution", "key_terms", s["ollama"].alias("ollama_summary"),
    )


def envelope(runs: DataFrame, results: DataFrame) -> DataFrame:
    """run_id, query, response: one nested response per run, its results by rank.

    Results of one run are bounded by the ranking's k, so a run is one row.  Runs without
    results get an empty array; results of no run are left out.  Ties go to the lower id.
    """
    model = F.lit(hooks.available("final_response"))
    ordered = results.select("run_id", F.struct("result_rank", "result_id", result(results).alias("r")).alias("x")).groupBy("run_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    found = ordered.select("run_id", F.transform("xs", lambda x: x["r"]).alias("results"))
    none = F.array().cast(found.schema["results"].dataType)
    d = runs.join(found, "run_id", "left").withColumn("results", F.coalesce("results", none))
    performance = F.struct(model.alias("ollama_available"), F.lit(False).alias("fast_mode_used"), F.size("results").cast("long").alias("papers_processed"))
    return d.select(
        "run_id", "query",
        F.struct("query_language", "intent", "entities", "expanded_query", "api_used", "processing_mode", "summary_method", F.col("run_ts").alias("timestamp"), performance.alias("performance"), "results").alias("response"),
    )
