"""Extractive summaries and response templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as T


def sentence_terms(docs: DataFrame, key: str, text: str, stopwords: list[str] | None = None) -> DataFrame:
    """key, idx, sentence, tokens: one row per sentence (terminators kept) with its words."""
    s = docs.select(key, F.posexplode(T.split_a(F.col(text))).alias("idx", "sentence"))
    tokens = T.word_tokens(F.col("sentence"))
    if stopwords:
        stops = F.array(*[F.lit(w) for w in stopwords])
        tokens = F.filter(tokens, lambda t: ~F.array_contains(stops, t))
    return s.withColumn("tokens", tokens)


def tfidf_weights(docs: DataFrame, key: str, text: str, stopwords: list[str] | None = None) -> DataFrame:
    """key, idx, term, tf, df, n, w: L2-normalized TF-IDF of each sentence within its document.

    One shuffle by (key, idx, term), combined map-side, and one by key for the
    document statistics.
    """
    s = sentence_terms(docs, key, text, stopwords)
    n = s.groupBy(key).agg(F.count("*").alias("n"))
    tf = s.select(key, "idx", F.explode("tokens").alias("term")).groupBy(key, "idx", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(key, "term").agg(F.count("*").alias("df"))
    raw = tf.join(df, [key, "term"]).join(n, key)
    raw = raw.withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key, "idx")))
    return raw.select(key, "idx", "term", "tf", "df", "n", (F.col("x") / length).alias("w"))


def tokenized(sentences: Column, stopwords: list[str] | None = None) -> Column:
    """ARRAY<ARRAY<STRING>>: the words of each sentence."""
    tokens = F.transform(sentences, lambda s: T.word_tokens(s))
    if not stopwords:
        return tokens
    stops = F.array(*[F.lit(w) for w in stopwords])
    return F.transform(tokens, lambda ws: F.filter(ws, lambda w: ~F.array_contains(stops, w)))


def tfidf_text(docs: DataFrame, text: str, m: int, stopwords: list[str] | None = None, out: str = "tfidf") -> DataFrame:
    """``docs`` with a column ``out``: the m sentences with the highest mean weight, in their order, lowest index on ties.

    All statistics are those of one document, so one narrow pass does and nothing is
    shuffled.  '' for an empty text or a null; the first m sentences if there is no
    vocabulary; all of them if there are no more than m.
    """
    from lectern.functions.arrow import tfidf_best

    d = docs.withColumn("__s", T.split_a(F.col(text)))
    d = d.withColumn("__best", tfidf_best(m)(tokenized(F.col("__s"), stopwords)))
    joined = F.array_join(F.transform("__best", lambda i: F.get("__s", i)), " ")
    return d.withColumn(out, F.coalesce(joined, F.lit(""))).drop("__s", "__best")


def tfidf_summary(docs: DataFrame, key: str, text: str, m: int, stopwords: list[str] | None = None) -> DataFrame:
    """key, summary: see :func:`tfidf_text`."""
    return tfidf_text(docs.select(key, text), text, m, stopwords, "summary").select(key, "summary")


def term_weight(docs: DataFrame, key: str, text: str, terms: list[str], stopwords: list[str] | None = None) -> DataFrame:
    """key, score: the summed TF-IDF weight of ``terms`` over the sentences of each text that has one; no shuffle."""
    from lectern.functions.arrow import tfidf_weight_of

    return docs.select(key, tfidf_weight_of(terms)(tokenized(T.split_a(F.col(text)), stopwords)).alias("score")).where("score is not null")


def sublinear_pairs(docs: DataFrame, key: str, text: str, stopwords: list[str] | None = None) -> DataFrame:
    """key, idx, term, w: sublinear TF-IDF over words and word pairs, terms in over 95 % of the sentences left out."""
    s = sentence_terms(docs, key, text, stopwords)
    pairs = F.when(F.size("tokens") > 1, F.zip_with(F.slice("tokens", 1, F.size("tokens") - 1), F.slice("tokens", 2, F.size("tokens") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    n = s.groupBy(key).agg(F.count("*").alias("n"))
    tf = s.select(key, "idx", F.explode(F.concat("tokens", pairs)).alias("term")).groupBy(key, "idx", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(key, "term").agg(F.count("*").alias("df"))
    raw = tf.join(df, [key, "term"]).join(n, key).where(F.col("df") <= 0.95 * F.col("n"))
    raw = raw.withColumn("x", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key, "idx")))
    return raw.select(key, "idx", "term", F.round(F.col("x") / length, 6).alias("w"))


def position_score(idx: Column, total: Column) -> Column:
    p = idx / (total - 1)
    return F.when(total <= 1, 1.0).when(p <= 0.1, 1.0).when(p >= 0.9, 0.9).when(p <= 0.3, 0.8).otherwise(0.6)


def keyword_score(sentence: Column, keywords: list[str] = vocab.IMPORTANCE_KEYWORDS) -> Column:
    hits = T.contains_count(F.lower(sentence), keywords)
    return F.least(F.lit(2.0), hits / F.greatest(F.size(T.words(sentence)) / 10, F.lit(1.0)))


def smart_extract(text: Column, most: int = 4, indicators: list[str] = vocab.RESEARCH_INDICATORS) -> Column:
    """STRUCT<key_sentences, important_terms, paper_focus, contribution, structured_summary>.

    Null or under 50 characters: no sentences and terms and the default labels.
    Sentences are scored by the text's indicators, four phrase patterns and length; with
    no more than ``most`` they keep their order, else the best come first.  The last key
    sentence that tells focus or contribution decides.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    none = F.array().cast("array<string>")
    listed = F.array(*[F.lit(i) for i in indicators])
    patterns = F.array(*[F.lit(p) for p in vocab.KEY_SENTENCE_PATTERNS])

    def score(s: Column, terms: Column) -> Column:
        points = F.size(F.filter(terms, lambda i: F.contains(s, i))) * 2.0
        return points + F.size(F.filter(patterns, lambda p: F.rlike(s, p))) + F.size(T.words(s)).between(10, 30).cast("double")

    def any_of(s: Column, *ws: str) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(s, w))

    def focus(acc: Column, s: Column) -> Column:
        kind = F.when(any_of(s, "machine learning", "deep learning"), "Machine Learning methodology").when(any_of(s, "data"), "Data analysis approach").otherwise("Methodological approach")
        return F.when(any_of(s, "method", "approach", "algorithm"), kind).otherwise(acc)

    def gain(acc: Column, s: Column) -> Column:
        return (
            F.when(any_of(s, "novel", "new", "propose", "introduce"), "Introduces novel approach").when(any_of(s, "improve", "better", "outperform"), "Improves existing methods")
            .when(any_of(s, "evaluate", "compare", "analysis"), "Provides comparative analysis").otherwise(acc)
        )

    def chosen(x: Column) -> Column:
        order = F.array_sort(F.transform(x["s"], lambda s, i: F.struct((-score(F.lower(s), x["terms"])).alias("k"), i.alias("i"), s.alias("s"))))
        return F.when(F.size(x["s"]) <= most, x["s"]).otherwise(F.transform(F.slice(order, 1, most), lambda y: y["s"]))

    def labels(x: Column) -> Column:
        low = F.transform(x["keys"], lambda s: F.lower(s))
        return F.struct(x["keys"].alias("k"), x["terms"].alias("t"), F.aggregate(low, F.lit("Research study"), focus).alias("f"), F.aggregate(low, F.lit("Presents findings"), gain).alias("c"))

    def out(x: Column) -> Column:
        template = F.concat(
            F.lit("FOCUS: "), x["f"], F.lit("\nCONTRIBUTION: "), x["c"], F.lit("\nKEY POINTS: "), F.array_join(F.slice(x["k"], 1, 3), " "), F.lit("\nTERMS: "), F.array_join(F.slice(x["t"], 1, 5), ", "),
        )
        return F.struct(x["k"].alias("key_sentences"), x["t"].alias("important_terms"), x["f"].alias("paper_focus"), x["c"].alias("contribution"), template.alias("structured_summary"))

    long = F.length(t) >= 50
    terms = F.when(long, T.let(F.lower(t), lambda low: F.filter(listed, lambda i: F.contains(low, i)))).otherwise(none)
    start = F.struct(F.when(long, T.split_b(t)).otherwise(none).alias("s"), terms.alias("terms"))
    return T.let(T.let(T.let(start, lambda x: F.struct(chosen(x).alias("keys"), x["terms"].alias("terms"))), labels), out)


def truncated(text: Column, most: int = 150) -> Column:
    """The deterministic stand-in of a generated summary: the first ``most`` characters and ``...``."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def simple_summary(text: Column, m: int = 3) -> Column:
    """Sentences over 20 characters by half their length plus 10 for the first three and 5 for the last two; original order.

    Under 50 characters the text itself.  A sentence that repeats a chosen one stays too.
    """
    s = F.filter(T.split_a(text), lambda x: F.length(x) > 20)
    n = F.size(s)
    order = F.array_sort(
        F.transform(s, lambda x, i: F.struct((-(F.length(x) * 0.5 + F.when(i < 3, 10.0).otherwise(0.0) + F.when(i > n - 3, 5.0).otherwise(0.0))).alias("k"), i.alias("i"), x.alias("s")))
    )
    chosen = F.transform(F.slice(order, 1, m), lambda x: x["s"])
    return F.when(F.length(text) < 50, text).when(n <= m, F.array_join(s, " ")).otherwise(F.array_join(F.filter(s, lambda x: F.array_contains(chosen, x)), " "))


def author_line(authors: Column, shown: int) -> Column:
    """The first authors, ``...`` if there are more; '' for null."""
    a = F.coalesce(authors, F.array().cast("array<string>"))
    return F.concat(F.array_join(F.slice(a, 1, shown), ", "), F.when(F.size(a) > shown, "...").otherwise(""))


def year_text(year: Column) -> Column:
    return F.coalesce(year.cast("string"), F.lit("None"))


def template_response(title: Column, authors: Column, year: Column) -> Column:
    """The response sentence of the mode without a language model."""
    a = F.coalesce(authors, F.array().cast("array<string>"))
    return F.concat(F.lit("This paper '"), title, F.lit("' by "), F.array_join(F.slice(a, 1, 2), ", "), F.lit(" ("), year_text(year), F.lit(") presents research findings on the topic."))


def fallback_summary(title: Column, authors: Column, year: Column, extract: Column) -> Column:
    """The sentence made of an extract when no language model answers."""
    return F.concat(
        F.lit('This paper "'), title, F.lit('" by '), author_line(authors, 3), F.lit(" ("), year_text(year), F.lit(") presents work on "), F.lower(extract["paper_focus"]),
        F.lit(". "), extract["contribution"], F.lit(". The research "), F.coalesce(F.try_element_at(extract["key_sentences"], F.lit(1)), F.lit("contributes to the field")), F.lit("."),
    )


def primary_summary(mode: Column, tfidf: Column, lsa: Column, abstractive: Column) -> Column:
    """STRUCT<summary, method>: the summary that a mode asks for; unknown modes combine two."""
    combined = F.concat(tfidf, F.lit("\n"), lsa)
    return F.struct(
        F.when(mode.isin("abstractive", "auto"), abstractive).when(mode == "tfidf", tfidf).when(mode == "lsa", lsa).otherwise(combined).alias("summary"),
        F.when(mode.isin("abstractive", "auto"), "abstractive").when(mode.isin("tfidf", "lsa"), mode).otherwise("combined").alias("method"),
    )
