"""The ranking pipelines: abstracts, full texts, and the fast mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import hooks
from lectern.functions import text as T
from lectern.operators import respond, summarize, vectors


def long_enough(text: Column, least: int = 50) -> Column:
    return text.isNotNull() & (F.length(F.trim(text)) >= least)


def full_text(body: Column, abstract: Column, least: int = 200) -> Column:
    """The body if it is long enough, else the abstract, cleaned."""
    return T.clean_scientific(F.when(F.length(F.trim(body)) >= least, body).otherwise(abstract))


def rank_texts(papers: DataFrame, query: str, k: int, text: str, m: int = 2, mode: str = "tfidf", stopwords: list[str] | None = None) -> DataFrame:
    """The k papers whose primary summary is nearest to the query, with that summary and a response sentence.

    ``papers`` has paper_key, title, authors, year, retrieval_idx and the text column.
    Null, empty and short texts are left out.  Only the summaries the mode needs are
    made; vectors are the deterministic ones.  Ties go to retrieval order, then key.
    """
    from lectern.functions.arrow import lsa_summarize

    kept = papers.where(long_enough(F.col(text)))
    out = kept
    if mode in ("tfidf",) or mode not in ("abstractive", "auto", "lsa"):
        out = summarize.tfidf_text(out, text, m, stopwords)
    else:
        out = out.withColumn("tfidf", F.lit(None).cast("string"))
    if mode == "lsa" or mode not in ("abstractive", "auto", "tfidf"):
        out = out.withColumn("lsa", lsa_summarize(m, stopwords)(F.col(text)))
    else:
        out = out.withColumn("lsa", F.lit(None).cast("string"))
    short = hooks.answer("abstractive", F.col(text))
    short = summarize.truncated(F.trim(F.col(text))) if short is None else short
    out = out.withColumn("p", summarize.primary_summary(F.lit(mode), F.col("tfidf"), F.col("lsa"), short))
    out = out.withColumn("score", vectors.cosine(vectors.embed(F.col("p.summary")), vectors.embed(F.lit(query))))
    response = summarize.template_response(F.col("title"), F.col("authors"), F.col("year"))
    out = out.select("paper_key", "title", F.col("p.method").alias("method"), F.col("p.summary").alias("summary"), response.alias("final_response"), "score", "retrieval_idx")
    return out.orderBy(F.desc("score"), "retrieval_idx", "paper_key").limit(k).drop("retrieval_idx")


def rank_full_texts(papers: DataFrame, query: str, k: int, first: int | None = None, m: int = 3, mode: str = "tfidf", stopwords: list[str] | None = None) -> DataFrame:
    """:func:`rank_texts` over whole bodies: ``papers`` has a column body beside the abstract that stands in for short ones.

    ``first`` keeps the papers whose retrieval_idx is below it, before anything is scored.
    """
    kept = papers if first is None else papers.where(F.col("retrieval_idx") < first)
    return rank_texts(kept.withColumn("full", full_text(F.col("body"), F.col("abstract"))), query, k, "full", m, mode, stopwords)


def fast_mode(papers: DataFrame, first: int) -> DataFrame:
    """The papers whose retrieval_idx is below ``first`` with their extract and its summary; every score is 0.8."""
    text = F.coalesce(F.nullif(F.col("abstract"), F.lit("")), F.lit(vocab.NO_ABSTRACT))
    d = papers.where(F.col("retrieval_idx") < first).withColumn("e", summarize.smart_extract(text))
    d = d.withColumn("said", respond.extract_summary(F.col("title"), F.col("authors"), F.col("year"), F.col("e")))
    return d.select(
        "paper_key", "title", F.lit(0.8).alias("score"), text.alias("original_abstract"), F.col("e.structured_summary").alias("extractive_summary"), "e.paper_focus", "e.contribution",
        F.array_join("e.important_terms", "|").alias("key_terms"), F.col("said").alias("final_response"), F.lit("extractive_ollama").alias("method"),
    )
