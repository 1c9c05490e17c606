"""Evaluation of summaries and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import hooks


def rouge_1(pairs: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """key, precision, recall, f1 of lower-case ASCII word tokens, unstemmed; 0 where a side has none or is null.

    One narrow pass: both texts of a pair are in one row.
    """
    from lectern.functions.arrow import rouge_counts

    out = pairs.select(key, rouge_counts(F.lower(F.col(candidate)), F.lower(F.col(reference))).alias("n")).select(key, "n.*")
    p, r = F.when(F.col("c") > 0, F.col("hits") / F.col("c")).otherwise(0.0), F.when(F.col("r") > 0, F.col("hits") / F.col("r")).otherwise(0.0)
    return out.select(key, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def metric_means(scores: DataFrame, *columns: str) -> DataFrame:
    """pairs and the mean of each metric column; one row, nulls for an empty table."""
    return scores.agg(F.count("*").alias("pairs"), *[F.round(F.avg(c), 6).alias(c) for c in columns])


def bert_score(candidate: Column, reference: Column) -> Column:
    """STRUCT<precision, recall, f1> by a model, zeros without one."""
    said = hooks.answer("bertscore", candidate, reference)
    return F.struct(*[F.lit(0.0).alias(n) for n in ("precision", "recall", "f1")]) if said is None else said


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """paper_id, votes, relevant, share of feedback rows (query, paper_id, relevant, notes)."""
    return feedback.groupBy("paper_id").agg(
        F.count("relevant").alias("votes"), F.sum(F.col("relevant").cast("long")).alias("relevant"), F.round(F.avg(F.col("relevant").cast("double")), 6).alias("share")
    )
