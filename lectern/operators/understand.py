"""Query understanding: language, intent, expansion, entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import hooks
from lectern.functions import text as T
from lectern.operators import vectors
from lectern.session import cut


def marker_score(text: Column, markers: list[str]) -> Column:
    """Two per word of each marker that the lower-cased text contains, one per word that is a marker."""
    low = F.lower(text)
    return T.weight_sum(low, [(m, 2 * len(m.split())) for m in markers]) + F.size(F.filter(T.words(T.clean_for_detection(low)), lambda w: F.array_contains(F.array(*[F.lit(m) for m in markers]), w)))


def detect_language(text: Column, french: list[str] = vocab.FRENCH_MARKERS, english: list[str] = vocab.ENGLISH_MARKERS) -> Column:
    """STRUCT<language, fr, en, confidence>: ``unknown`` below three characters, French only with more points.

    A null text is ``unknown``.  A model's answer counts if it is English or French with a
    confidence of 0.7 or more.
    """
    said = hooks.answer("detect", text)
    sure = F.lit(False) if said is None else F.coalesce(said["language"].isin("en", "fr") & (said["confidence"] >= 0.7), F.lit(False))
    model = F.struct(F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence")) if said is None else said
    t = F.coalesce(text, F.lit(""))
    short = (F.length(F.trim(t)) < 3) | (F.length(T.clean_for_detection(t)) < 3)
    n = F.size(T.words(T.clean_for_detection(F.lower(t))))
    parts = F.struct(marker_score(t, french).alias("fr"), marker_score(t, english).alias("en"), short.alias("short"), n.alias("n"))
    return T.let(
        parts,
        lambda x: F.struct(
            F.when(x["short"], "unknown").when(sure, model["language"]).when(x["fr"] > x["en"], "fr").otherwise("en").alias("language"), x["fr"].cast("long").alias("fr"), x["en"].cast("long").alias("en"),
            F.when(x["short"], F.lit(0.0)).when(sure, model["confidence"]).otherwise(F.least(F.greatest(x["fr"], x["en"]) / (x["n"] + 1), F.lit(1.0))).alias("confidence"),
        ),
    )


def intent_scores(text: Column, intents: dict[str, dict[str, int]] = vocab.INTENTS) -> Column:
    """STRUCT of one BIGINT per intent: the weights of the phrases the lower-cased text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.struct(*[T.weight_sum(low, list(phrases.items())).cast("long").alias(name) for name, phrases in intents.items()])


def detect_intent(text: Column, intents: dict[str, dict[str, int]] = vocab.INTENTS) -> Column:
    """The intent with most points, the one named first on ties, ``general`` without any."""

    def best(scores: Column) -> Column:
        top = F.greatest(*[scores[n] for n in intents]) if len(intents) > 1 else scores[next(iter(intents))]
        out = F.when(top == 0, "general")
        for n in intents:
            out = out.when(scores[n] == top, n)
        return out

    return T.let(intent_scores(text, intents), best)


def expand_query(query: Column, entities: Column | None = None, stopwords: list[str] = vocab.QUERY_STOPWORDS, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Distinct tokens of the query and of all entity strings (ARRAY), sorted by code point.

    ``synonyms`` maps a token to others, which join it in lower case with spaces for
    underscores, those of up to 30 characters.
    """
    terms = T.query_tokens(query, stopwords)
    if entities is not None:
        more = F.flatten(F.transform(F.coalesce(entities, F.array().cast("array<string>")), lambda e: T.query_tokens(e, stopwords)))
        terms = F.array_union(terms, more)
    if synonyms:
        table = F.create_map(*[x for t, ws in synonyms.items() for x in (F.lit(t), F.array(*[F.lit(w.replace("_", " ").lower()) for w in ws if len(w) <= 30]).cast("array<string>"))])
        terms = F.array_union(terms, F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))))
    return F.array_sort(F.array_distinct(terms))


def post_process_translation(text: Column) -> Column:
    """White space collapsed, none before punctuation."""
    return F.regexp_replace(T.collapse(text), r"\s+([.,!?;:])", "$1")


def translated(text: Column, language: Column, least: float = 0.3) -> Column:
    """The English text of a French query if a model translates it and gives at least ``least`` of its length; else the text."""
    said = hooks.answer("translate", F.trim(text))
    if said is None:
        return text
    said = post_process_translation(said)
    return F.when((language == "fr") & (F.length(said) >= least * F.length(F.trim(text))), said).otherwise(text)


def keywords(text: Column) -> Column:
    """Distinct lower-case noun phrases by a model, first occurrence first; none without a model."""
    said = hooks.answer("keywords", text)
    return F.array().cast("array<string>") if said is None else F.array_distinct(F.transform(said, lambda k: F.lower(k)))


def distinct_entities(entities: Column, categories: list[str]) -> Column:
    """STRUCT of each category's entities without repeats, nulls and blanks, the first occurrence stays; [] for null."""
    none = F.array().cast("array<string>")
    return F.struct(*[F.array_distinct(F.filter(F.coalesce(entities[c], none), lambda e: F.trim(e) != "")).alias(c) for c in categories])


def vocabulary(lists: DataFrame) -> DataFrame:
    """category, term, pos, embedding of category lists (category, terms): one row per term, pos is its place in its list.

    A term that its category lists again keeps its first place; null and blank terms are
    left out.  The vectors are made once and should be written before they are asked.
    """
    d = lists.select("category", F.posexplode("terms").alias("pos", "term")).where("trim(term) <> ''")
    d = d.groupBy("category", "term").agg(F.min("pos").cast("long").alias("pos"))
    return d.withColumn("embedding", vectors.embed(F.col("term")))


def entity_topk(queries: DataFrame, vocabulary: DataFrame, k: int = 2, threshold: float = 0.5, block: int = 4096) -> DataFrame:
    """query_id, category, term, score, rank: the k nearest terms per category, those above the threshold.

    ``queries`` has query_id and embedding, ``vocabulary`` category, term, pos and
    embedding.  Ties go to the lower ``pos``.  The query set goes in blocks of
    about ``block`` vectors, one after the other, by a hash of the query's id; every batch of
    terms yields its k best per query and category only, so what is shuffled is bounded by
    the batches, not by the pairs.  Rows with a
    null embedding are left out.
    """
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    words = vocabulary.where("embedding is not null").select("category", "term", "pos", "embedding")
    names = {f.name: f.dataType.simpleString() for f in words.schema.fields}
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, category {names['category']}, term {names['term']}, pos {names['pos']}, score double"
    blocks = -(-asked.count() // block) or 1
    found = None
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        part = _nearest(own.collect(), words, k, schema)
        if blocks > 1:
            part = cut(part)  # the block's vectors are no longer needed
        found = part if found is None else found.unionAll(part)
    w = Window.partitionBy("query_id", "category").orderBy(F.desc("score"), "pos")
    return found.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("score") > threshold)).drop("pos")


def _nearest(rows: list, words: DataFrame, k: int, schema: str) -> DataFrame:
    """The k nearest of each batch of terms per category for a block of query vectors."""
    if not rows:
        return words.sparkSession.createDataFrame([], schema)
    q = np.array([r[1] for r in rows], np.float64)
    ids = np.array([r[0] for r in rows], object)
    sent = words.sparkSession.sparkContext.broadcast((ids, q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-8)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, unit = sent.value
        for batch in batches:
            if not len(batch):
                continue
            m = np.array(batch["embedding"].tolist(), np.float64)
            score = np.round(unit @ (m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)).T, 6)
            who, which = [], []
            for own in batch.groupby("category").indices.values():
                own = own[np.argsort(batch["pos"].to_numpy()[own], kind="stable")]
                best = own[np.argsort(-score[:, own], axis=1, kind="stable")[:, :k]]
                who.append(np.repeat(np.arange(len(ids)), best.shape[1]))
                which.append(best.ravel())
            i, j = np.concatenate(who), np.concatenate(which)
            yield pd.DataFrame({"query_id": ids[i], **{c: batch[c].to_numpy()[j] for c in ("category", "term", "pos")}, "score": score[i, j]})

    return words.mapInPandas(run, schema)
