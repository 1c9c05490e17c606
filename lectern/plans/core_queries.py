"""Queries of the search, ranking and summarization operators, each with its SQL.

The SQL is written for DuckDB and is an independent formulation of the same result.
Lists of words are spelled out into both sides from :mod:`lectern.vocab`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as T
from lectern.operators import evaluate, rank, structure, summarize, understand, vectors
from lectern.sources import landed
from lectern.sources.tables import spread
from lectern.sources.tables import table as plain_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Words of the test data; they stand in for the scientific lists, which the made-up texts hardly contain.
TOPIC_INTENTS = {"survey": {"survey": 2, "a survey of": 3}, "methodology": {"what are the best methods": 3, "how does": 1, "method": 1}, "application": {"diagnosis": 1, "maintenance": 2}, "comparison": {"compare": 2, "comparer": 2}, "recent": {"recent": 2, "2023": 1, "2024": 2}}
INDICATORS = ["glacier", "accuracy", "we show", "experiments", "retriever", "encoder", "planning", "monitoring", "workflow", "data"]
STOPS = ["the", "and", "of", "to", "in", "is", "for", "on", "with", "that", "was", "be"]
FACET_WEIGHT, FACET_KEYWORDS = 0.8, ["encoder", "retriever", "sparse", "monitoring"]
FACET_RULES = [r"(?i)our\s+experiments\s+indicate", r"(?i)we\s+show\s+that", r"(?i)in\s+this\s+paper", r"(?i)improves\s+on"]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spread(plain_table(spark, sf, name, *columns))


def papers(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "papers", "paper_key", *columns)


#: Sentences with their terminators, as a list; the same split as split_a.
SPLIT_A = "list_filter(list_transform(string_split(regexp_replace(trim(abstract), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
SPLIT_B = "list_filter(list_transform(regexp_split_to_array(trim(abstract), '[.!?]+'), lambda x: trim(x)), lambda x: length(x) > 20)"
SPLIT_D = "list_filter(list_transform(regexp_split_to_array(regexp_replace(abstract, '\\b(Dr|Prof|Fig|Table|Eq|et al)\\.', '\\1' || chr(1), 'g'), '[.!?]+\\s+'), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x <> '')"


def WORDS(x: str) -> str:
    return f"list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> '')"


def hits(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"(contains({x}, {q(t)}))::INT" for t in terms) + ")"


@query("SELECT paper_key, length(trim(abstract))::BIGINT AS n FROM papers WHERE abstract IS NOT NULL AND length(trim(abstract)) >= 50")
def length_filter(spark, sf):
    return papers(spark, sf, "abstract").where(rank.long_enough(F.col("abstract"))).select("paper_key", F.length(F.trim("abstract")).cast("long").alias("n"))


@query(f"SELECT paper_key, (i - 1)::BIGINT AS idx, s[i] AS sentence FROM (SELECT paper_key, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT paper_key, {SPLIT_A} AS s FROM papers WHERE abstract IS NOT NULL))")
def split_a(spark, sf):
    return papers(spark, sf, "abstract").select("paper_key", F.posexplode(T.split_a(F.col("abstract"))).alias("idx", "sentence")).withColumn("idx", F.col("idx").cast("long"))


@query(f"SELECT paper_key, len(s)::BIGINT AS n, array_to_string(s, '|') AS parts FROM (SELECT paper_key, {SPLIT_B} AS s FROM papers WHERE abstract IS NOT NULL)")
def split_b(spark, sf):
    d = papers(spark, sf, "abstract").where("abstract is not null").withColumn("s", T.split_b(F.col("abstract")))
    return d.select("paper_key", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("parts"))


@query(f"SELECT paper_key, len(s)::BIGINT AS n, array_to_string(s, '|') AS parts FROM (SELECT paper_key, {SPLIT_D} AS s FROM papers WHERE abstract IS NOT NULL)")
def split_d(spark, sf):
    d = papers(spark, sf, "abstract").where("abstract is not null").withColumn("s", T.split_d(F.col("abstract")))
    return d.select("paper_key", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("parts"))


_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^a-zA-ZÀ-ÿ0-9\\-]+'), lambda t: t <> '' AND NOT list_contains([{s}], t))"
_QTOKENS = _TOKENS.format(x="query", s=", ".join(q(w) for w in vocab.QUERY_STOPWORDS))


@query(f"SELECT run_id, array_to_string({_QTOKENS}, ' ') AS tokens FROM search_runs")
def tokenize_terms(spark, sf):
    return table(spark, sf, "search_runs", "run_id", "query").select("run_id", F.array_join(T.query_tokens(F.col("query"), vocab.QUERY_STOPWORDS), " ").alias("tokens"))


@query(
    "SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_split_to_array(text, '(?i)\\n\\s*references\\s*\\n')[1], '\\[(?:\\s*\\d+\\s*(?:,\\s*\\d+)*\\s*)\\]', '', 'g'),"
    " '\\((?:[A-Z][a-zA-Z\\-'']+\\s+et\\s+al\\.|[A-Z][a-zA-Z\\-'']+),?\\s*\\d{4}[a-z]?\\)', '', 'g'), chr(10)),"
    " lambda l: trim(l) <> '' AND NOT regexp_matches(trim(l), '(?i)^table\\s+\\d+') AND NOT regexp_matches(trim(l), '(?i)^figure\\s+\\d+')"
    " AND length(regexp_replace(trim(l), '[\\pL\\pN\\s]', '', 'g')) / greatest(length(trim(l)), 1) <= 0.4), chr(10)) AS body FROM documents WHERE text IS NOT NULL"
)
def clean_text(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.clean_scientific(F.col("text")).alias("body"))


_DETECT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, 'https?://\\S+|www\\.\\S+', '', 'g'), '\\S+@\\S+', '', 'g'), '[^\\pL\\pN_\\s''\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT run_id, {_DETECT.format(x='query')} AS cleaned FROM search_runs WHERE query IS NOT NULL")
def clean_for_detection(spark, sf):
    return table(spark, sf, "search_runs", "run_id", "query").where("query is not null").select("run_id", T.clean_for_detection(F.col("query")).alias("cleaned"))


def _marker_sql(markers: list[str]) -> str:
    found = " + ".join(f"CASE WHEN contains(l, {q(m)}) THEN {2 * len(m.split())} ELSE 0 END" for m in markers)
    return f"({found} + len(list_filter({WORDS('c')}, lambda w: list_contains([{', '.join(q(m) for m in markers)}], w))))::BIGINT"


@query(
    f"WITH t AS (SELECT run_id, query, lower(query) AS l, {_DETECT.format(x='lower(query)')} AS c FROM search_runs WHERE query IS NOT NULL), s AS (SELECT *, {_marker_sql(vocab.FRENCH_MARKERS)} AS fr, {_marker_sql(vocab.ENGLISH_MARKERS)} AS en FROM t)"
    f" SELECT run_id, CASE WHEN length(trim(query)) < 3 OR length({_DETECT.format(x='query')}) < 3 THEN 'unknown' WHEN fr > en THEN 'fr' ELSE 'en' END AS language, fr, en FROM s"
)
def lang_markers(spark, sf):
    d = table(spark, sf, "search_runs", "run_id", "query").where("query is not null")
    return d.select("run_id", understand.detect_language(F.col("query")).alias("d")).select("run_id", "d.language", "d.fr", "d.en")


def _intent_sql(intents) -> str:
    sums = {n: "(" + " + ".join(f"CASE WHEN contains(l, {q(p)}) THEN {w} ELSE 0 END" for p, w in ps.items()) + ")::BIGINT" for n, ps in intents.items()}
    cols = ", ".join(f"{e} AS {n}" for n, e in sums.items())
    case = " ".join(f"WHEN {n} = greatest({', '.join(sums)}) THEN '{n}'" for n in sums)
    return f"WITH t AS (SELECT run_id, lower(coalesce(query, '')) AS l FROM search_runs), s AS (SELECT run_id, {cols} FROM t) SELECT *, CASE WHEN greatest({', '.join(sums)}) = 0 THEN 'general' {case} END AS intent FROM s"


def _intents(spark, sf, intents):
    d = table(spark, sf, "search_runs", "run_id", "query")
    return d.select("run_id", understand.intent_scores(F.col("query"), intents).alias("s"), understand.detect_intent(F.col("query"), intents).alias("intent")).select("run_id", "s.*", "intent")


@query(_intent_sql(vocab.INTENTS))
def intent_scores(spark, sf):
    return _intents(spark, sf, vocab.INTENTS)


@query(_intent_sql(TOPIC_INTENTS))
def intent_scores_own_terms(spark, sf):
    return _intents(spark, sf, TOPIC_INTENTS)


_ENTITIES = "list_concat(list_concat(list_concat(coalesce(entities.domain, []), coalesce(entities.methods, [])), coalesce(entities.datasets, [])), list_concat(coalesce(entities.metrics, []), coalesce(entities.keywords, [])))"


@query(
    f"SELECT run_id, array_to_string(list_sort(list_distinct(list_concat({_QTOKENS}, coalesce(flatten(list_transform(list_filter({_ENTITIES}, lambda e: e IS NOT NULL), lambda e: {_TOKENS.format(x='e', s=', '.join(q(w) for w in vocab.QUERY_STOPWORDS))})), [])))), ' ') AS expanded FROM search_runs"
)
def expand_terms(spark, sf):
    d = table(spark, sf, "search_runs", "run_id", "query", "entities")
    none = F.array().cast("array<string>")
    entities = F.concat(*[F.coalesce(F.col(f"entities.{c}"), none) for c in ("domain", "methods", "datasets", "metrics", "keywords")])
    return d.select("run_id", F.array_join(understand.expand_query(F.col("query"), F.filter(entities, lambda e: e.isNotNull())), " ").alias("expanded"))


_STOPS = ", ".join(q(w) for w in STOPS)
_TFIDF = (
    f"s AS (SELECT paper_key, i - 1 AS idx, s[i] AS sentence FROM (SELECT paper_key, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT paper_key, {SPLIT_A} AS s FROM papers WHERE abstract IS NOT NULL))),"
    f" w AS (SELECT paper_key, idx, list_filter(regexp_extract_all(lower(sentence), '[\\pL\\pN_]{{2,}}'), lambda t: NOT list_contains([{_STOPS}], t)) AS tk FROM s)"
)
_WEIGHTS = (
    ", t AS (SELECT paper_key, idx, unnest(tk) AS term FROM w), n AS (SELECT paper_key, count(*) AS n FROM s GROUP BY 1), tf AS (SELECT paper_key, idx, term, count(*) AS tf FROM t GROUP BY 1, 2, 3),"
    " df AS (SELECT paper_key, term, count(*) AS df FROM tf GROUP BY 1, 2), x AS (SELECT tf.paper_key, idx, tf.term, tf, df, n, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (paper_key, term) JOIN n USING (paper_key)),"
    " wt AS (SELECT paper_key, idx, term, tf, df, n, x / sqrt(sum(x * x) OVER (PARTITION BY paper_key, idx)) AS w FROM x)"
)


@query(f"WITH {_TFIDF}{_WEIGHTS} SELECT paper_key, idx::BIGINT AS idx, term, tf::BIGINT AS tf, df::BIGINT AS df, round(w, 6) AS w FROM wt")
def tfidf_weights(spark, sf):
    d = summarize.tfidf_weights(papers(spark, sf, "abstract"), "paper_key", "abstract", STOPS)
    return d.select("paper_key", F.col("idx").cast("long").alias("idx"), "term", "tf", "df", F.round("w", 6).alias("w"))


@query(
    f"WITH {_TFIDF}{_WEIGHTS}, v AS (SELECT paper_key, count(DISTINCT term) AS v FROM wt GROUP BY 1), sc AS (SELECT paper_key, idx, round(sum(w) / any_value(v), 9) AS score FROM wt JOIN v USING (paper_key) GROUP BY 1, 2),"
    " r AS (SELECT s.paper_key, s.idx, sentence, row_number() OVER (PARTITION BY s.paper_key ORDER BY coalesce(score, 0) DESC, s.idx) AS r FROM s LEFT JOIN sc USING (paper_key, idx))"
    " SELECT paper_key, coalesce(any_value(summary), '') AS summary FROM papers LEFT JOIN (SELECT paper_key, string_agg(sentence, ' ' ORDER BY idx) AS summary FROM r WHERE r <= 2 GROUP BY 1) USING (paper_key) GROUP BY 1"
)
def tfidf_summary(spark, sf):
    return summarize.tfidf_summary(papers(spark, sf, "abstract"), "paper_key", "abstract", 2, STOPS)


@query(
    f"WITH {_TFIDF}, t AS (SELECT paper_key, idx, unnest(list_concat(tk, CASE WHEN len(tk) > 1 THEN list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]) ELSE [] END)) AS term FROM w), n AS (SELECT paper_key, count(*) AS n FROM s GROUP BY 1),"
    " tf AS (SELECT paper_key, idx, term, count(*) AS tf FROM t GROUP BY 1, 2, 3), df AS (SELECT paper_key, term, count(*) AS df FROM tf GROUP BY 1, 2),"
    " x AS (SELECT tf.paper_key, idx, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (paper_key, term) JOIN n USING (paper_key) WHERE df <= 0.95 * n)"
    " SELECT paper_key, idx::BIGINT AS idx, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY paper_key, idx)), 6) AS w FROM x"
)
def bigram_sublinear(spark, sf):
    return summarize.sublinear_pairs(papers(spark, sf, "abstract"), "paper_key", "abstract", STOPS).withColumn("idx", F.col("idx").cast("long"))


@query(
    f"WITH {_TFIDF} SELECT paper_key, idx::BIGINT AS idx, CASE WHEN n <= 1 THEN 1.0 WHEN idx / (n - 1) <= 0.1 THEN 1.0 WHEN idx / (n - 1) >= 0.9 THEN 0.9 WHEN idx / (n - 1) <= 0.3 THEN 0.8 ELSE 0.6 END::DOUBLE AS position,"
    f" round(least(2.0, {hits('lower(sentence)', vocab.IMPORTANCE_KEYWORDS)} / greatest(len({WORDS('sentence')}) / 10, 1.0)), 6)::DOUBLE AS keywords FROM s JOIN (SELECT paper_key, count(*) AS n FROM s GROUP BY 1) USING (paper_key)"
)
def sentence_positions(spark, sf):
    s = papers(spark, sf, "abstract").where("abstract is not null").withColumn("s", T.split_a(F.col("abstract")))
    s = s.select("paper_key", F.size("s").alias("n"), F.posexplode("s").alias("idx", "sentence"))
    return s.select("paper_key", F.col("idx").cast("long").alias("idx"), summarize.position_score(F.col("idx"), F.col("n")).alias("position"), F.round(summarize.keyword_score(F.col("sentence")), 6).cast("double").alias("keywords"))


@query(
    f"SELECT paper_key, idx::BIGINT AS idx, length(c) BETWEEN 20 AND 300 AND length(regexp_replace(c, '[^0-9()\\[\\]{{}}=<>+\\-*/]', '', 'g')) / length(c) <= 0.4 AND length(regexp_replace(c, '[^\\p{{Lu}}]', '', 'g')) / length(c) <= 0.7 AS usable"
    f" FROM (SELECT paper_key, i - 1 AS idx, trim(regexp_replace(s[i], '\\s+', ' ', 'g')) AS c FROM (SELECT paper_key, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT paper_key, {SPLIT_A} AS s FROM papers WHERE abstract IS NOT NULL)))"
)
def sentence_quality(spark, sf):
    s = papers(spark, sf, "abstract").select("paper_key", F.posexplode(T.split_a(F.col("abstract"))).alias("idx", "s"))
    s = s.withColumn("c", T.collapse(F.col("s")))
    ok = F.length("c").between(20, 300) & (T.share_of(F.col("c"), r"[0-9()\[\]{}=<>+\-*/]") <= 0.4) & (T.share_of(F.col("c"), r"\p{Lu}") <= 0.7)
    return s.select("paper_key", F.col("idx").cast("long").alias("idx"), ok.alias("usable"))


def _smart_sql() -> str:
    terms = f"list_filter([{', '.join(q(i) for i in INDICATORS)}], lambda i: contains(l, i))"
    pats = " + ".join(f"regexp_matches(lower(x), {q(p)})::INT" for p in vocab.KEY_SENTENCE_PATTERNS)
    score = f"(2.0 * len(list_filter(terms, lambda i: contains(lower(x), i))) + {pats} + (len({WORDS('x')}) BETWEEN 10 AND 30)::INT)"
    return (
        f"WITH t AS (SELECT paper_key, trim(coalesce(abstract, '')) AS abstract, lower(trim(coalesce(abstract, ''))) AS l FROM papers), u AS (SELECT paper_key, abstract, {terms} AS terms, CASE WHEN length(abstract) < 50 THEN [] ELSE {SPLIT_B} END AS s FROM t),"
        f" e AS (SELECT paper_key, terms, len(s) AS n, unnest(range(1, len(s) + 1)) AS i, s FROM u), f AS (SELECT paper_key, n, i, s[i] AS x, terms FROM e), g AS (SELECT paper_key, n, i, x, {score} AS score FROM f),"
        " h AS (SELECT *, CASE WHEN n <= 4 THEN i ELSE row_number() OVER (PARTITION BY paper_key ORDER BY score DESC, i) END AS r FROM g),"
        " k AS (SELECT paper_key, string_agg(x, ' | ' ORDER BY r) AS key_sentences FROM h WHERE r <= 4 GROUP BY 1)"
        " SELECT paper_key, coalesce(key_sentences, '') AS key_sentences, CASE WHEN length(abstract) < 50 THEN '' ELSE array_to_string(terms, ', ') END AS terms FROM u LEFT JOIN k USING (paper_key)"
    )


@query(_smart_sql())
def smart_extract(spark, sf):
    d = papers(spark, sf, "abstract").withColumn("e", summarize.smart_extract(F.col("abstract"), 4, INDICATORS))
    return d.select("paper_key", F.array_join("e.key_sentences", " | ").alias("key_sentences"), F.array_join("e.important_terms", ", ").alias("terms"))


@query()
def smart_extract_full(spark, sf):
    d = papers(spark, sf, "abstract").withColumn("e", summarize.smart_extract(F.col("abstract")))
    return d.select("paper_key", "e.paper_focus", "e.contribution", "e.structured_summary")


_SIMPLE = f"list_filter({SPLIT_A}, lambda x: length(x) > 20)"


@query(
    f"WITH t AS (SELECT paper_key, abstract, {_SIMPLE} AS s FROM papers WHERE abstract IS NOT NULL), e AS (SELECT paper_key, len(s) AS n, unnest(range(1, len(s) + 1)) AS i, s FROM t),"
    " r AS (SELECT paper_key, n, i, s[i] AS x, row_number() OVER (PARTITION BY paper_key ORDER BY length(s[i]) * 0.5 + CASE WHEN i <= 3 THEN 10 ELSE 0 END + CASE WHEN i - 1 > n - 3 THEN 5 ELSE 0 END DESC, i) AS r FROM e),"
    " c AS (SELECT paper_key, x FROM r WHERE r <= 3 GROUP BY 1, 2), j AS (SELECT r.paper_key, string_agg(r.x, ' ' ORDER BY r.i) AS summary FROM r SEMI JOIN c ON r.paper_key = c.paper_key AND r.x = c.x GROUP BY 1)"
    " SELECT t.paper_key, CASE WHEN length(abstract) < 50 THEN abstract ELSE coalesce(summary, '') END AS summary FROM t LEFT JOIN j USING (paper_key)"
)
def simple_summary(spark, sf):
    return papers(spark, sf, "abstract").where("abstract is not null").select("paper_key", summarize.simple_summary(F.col("abstract")).alias("summary"))


@query("SELECT paper_key, CASE WHEN length(abstract) > 150 THEN substr(abstract, 1, 150) || '...' ELSE abstract END AS summary FROM papers")
def truncate_summary(spark, sf):
    return papers(spark, sf, "abstract").select("paper_key", summarize.truncated(F.col("abstract")).alias("summary"))


@query("SELECT paper_key, 'This paper ''' || title || ''' by ' || array_to_string(coalesce(authors, [])[1:2], ', ') || ' (' || coalesce(year::VARCHAR, 'None') || ') presents research findings on the topic.' AS response FROM papers")
def template_response(spark, sf):
    return papers(spark, sf, "title", "authors", "year").select("paper_key", summarize.template_response(F.col("title"), F.col("authors"), F.col("year")).alias("response"))


@query(
    "SELECT result_id, CASE WHEN method IN ('abstractive', 'auto') THEN abstractive_summary WHEN method = 'tfidf' THEN summaries.tfidf WHEN method = 'lsa' THEN summaries.lsa ELSE summaries.tfidf || chr(10) || summaries.lsa END AS summary,"
    " CASE WHEN method IN ('abstractive', 'auto') THEN 'abstractive' WHEN method IN ('tfidf', 'lsa') THEN method ELSE 'combined' END AS label FROM search_results"
)
def summary_selector(spark, sf):
    d = table(spark, sf, "search_results", "result_id", "method", "summaries", "abstractive_summary")
    p = summarize.primary_summary(F.col("method"), F.col("summaries.tfidf"), F.col("summaries.lsa"), F.col("abstractive_summary"))
    return d.select("result_id", p.alias("p")).select("result_id", "p.summary", F.col("p.method").alias("label"))


@query(
    "SELECT paper_key, coalesce(nullif(pdf_url, ''), entry_url) AS link, array_to_string(coalesce(authors, [])[1:3], ', ') || CASE WHEN len(coalesce(authors, [])) > 3 THEN '...' ELSE '' END AS shown,"
    " 'https://arxiv.org/pdf/' || regexp_replace(CASE WHEN contains(id, '/abs/') THEN regexp_replace(id, '^.*/abs/', '') ELSE regexp_replace(id, '^.*arxiv:', '') END, 'v\\d+$', '') || '.pdf' AS pdf, md5(entry_url) || '.pdf' AS cache FROM papers"
)
def link_projection(spark, sf):
    d = papers(spark, sf, "id", "authors", "pdf_url", "entry_url")
    return d.select("paper_key", landed.link(F.col("pdf_url"), F.col("entry_url")).alias("link"), summarize.author_line(F.col("authors"), 3).alias("shown"), landed.pdf_url_of(F.col("id")).alias("pdf"), landed.cache_key(F.col("entry_url")).alias("cache"))


_KINDS = {"ollama": 10, "abstractive": 8, "combined": 6, "tfidf": 4, "lsa": 2}


@query(
    "WITH e AS (" + " UNION ALL ".join(f"SELECT result_id, '{k}' AS kind, {p} AS p, summaries.{k} AS s FROM search_results" for k, p in _KINDS.items()) + ")"
    " SELECT result_id, string_agg(kind, ',' ORDER BY p DESC) AS kinds FROM e WHERE s IS NOT NULL AND trim(s) <> '' GROUP BY 1"
)
def summary_order(spark, sf):
    d = table(spark, sf, "search_results", "result_id", "summaries")
    kinds = F.array(*[F.struct(F.lit(-p).alias("p"), F.lit(k).alias("kind"), F.col(f"summaries.{k}").alias("s")) for k, p in _KINDS.items()])
    shown = F.filter(F.array_sort(kinds), lambda x: x["s"].isNotNull() & (F.trim(x["s"]) != ""))
    return d.withColumn("k", F.transform(shown, lambda x: x["kind"])).where(F.size("k") > 0).select("result_id", F.array_join("k", ",").alias("kinds"))


@query(
    "SELECT result_id, coalesce(nullif(summaries.ollama, ''), nullif(summaries.abstractive, ''), abstractive_summary) AS abstractive, coalesce(nullif(abstract_summary, ''), summaries.tfidf) AS abstract_text FROM search_results"
)
def response_compat(spark, sf):
    d = table(spark, sf, "search_results", "result_id", "summaries", "abstract_summary", "abstractive_summary")
    none = F.lit("")
    return d.select("result_id", F.coalesce(F.nullif(F.col("summaries.ollama"), none), F.nullif(F.col("summaries.abstractive"), none), "abstractive_summary").alias("abstractive"), F.coalesce(F.nullif(F.col("abstract_summary"), none), "summaries.tfidf").alias("abstract_text"))


_BYTES = "list_transform(range(0, 16), lambda i: ('0x' || substr(md5({x}), (2 * i + 1)::INT, 2))::INT::DOUBLE)"


@query(
    f"WITH t AS (SELECT paper_key, {_BYTES.format(x='title')} AS v FROM papers WHERE title IS NOT NULL), n AS (SELECT paper_key, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-8 AS n FROM t)"
    " SELECT paper_key, 384::BIGINT AS dimension, round((v[1] / n)::FLOAT::DOUBLE, 5) AS first, round((v[16] / n)::FLOAT::DOUBLE, 5) AS last FROM n"
)
def hash_embedding(spark, sf):
    d = papers(spark, sf, "title").where("title is not null").withColumn("v", vectors.hash_embedding(F.col("title")))
    at = lambda i: F.round(F.element_at("v", i).cast("double"), 5)
    return d.select("paper_key", F.size("v").cast("long").alias("dimension"), at(1).alias("first"), at(16).alias("last"))


_COS = "round(list_sum(list_transform(range(1, 65), lambda i: a[i]::DOUBLE * b[i]::DOUBLE)) / ((sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-8) * (sqrt(list_sum(list_transform(b, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-8)), 6)"


@query(f"SELECT vec_id, {_COS} AS score FROM (SELECT vec_id, embedding AS a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) AS b FROM embeddings) ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf):
    d = table(spark, sf, "embeddings")
    first = d.orderBy("vec_id").select("embedding").first()[0]
    return vectors.rank_by_cosine(d, list(first), 10, "vec_id").select("vec_id", "score")


@query(
    f"WITH p AS (SELECT x.vec_id AS query_id, y.label::BIGINT AS category, y.vec_id AS term, {_COS.replace('a[i]', 'x.embedding[i]').replace('b[i]', 'y.embedding[i]').replace('(a,', '(x.embedding,').replace('(b,', '(y.embedding,')} AS score FROM embeddings x JOIN embeddings y ON x.vec_id % 20 = 0),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY score DESC, term) AS rank FROM p) SELECT query_id, category, term, score, rank::BIGINT AS rank FROM r WHERE rank <= 2 AND score > 0.2"
)
def entity_topk(spark, sf):
    """Search: every vector with an id divisible by 20 asks, all vectors are the vocabulary, their label the category."""
    d = table(spark, sf, "embeddings")
    ask = d.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    words = d.select(F.col("label").cast("long").alias("category"), F.col("vec_id").alias("term"), F.col("vec_id").alias("pos"), "embedding")
    return understand.entity_topk(ask, words, 2, 0.2).withColumn("rank", F.col("rank").cast("long"))


def _header_sql() -> str:
    case = " ".join(f"WHEN {' OR '.join(f'regexp_matches(s, {q(p)})' for p in ps)} THEN '{k}'" for k, ps in vocab.SECTION_HEADERS.items())
    conf = f"round(least(1.0, 0.7 + CASE WHEN regexp_matches(s, '\\d') THEN 0.2 ELSE 0 END + CASE WHEN len({WORDS('s')}) <= 3 THEN 0.1 ELSE 0 END - CASE WHEN contains(lower(s), 'analysis') OR contains(lower(s), 'summary') THEN 0.1 ELSE 0 END), 6)::DOUBLE"
    return (
        "WITH l AS (SELECT paper_key, string_split(abstract, chr(10)) AS ls FROM papers WHERE abstract IS NOT NULL), e AS (SELECT paper_key, unnest(range(1, len(ls) + 1)) AS i, ls FROM l), t AS (SELECT paper_key, i - 1 AS start_idx, trim(ls[i]) AS s FROM e),"
        f" h AS (SELECT paper_key, start_idx::BIGINT AS start_idx, s AS header_text, CASE WHEN s = '' OR length(s) > 100 THEN NULL {case} END AS section_type, {conf} AS confidence FROM t) SELECT * FROM h WHERE section_type IS NOT NULL"
    )


@query(_header_sql())
def section_headers(spark, sf):
    d = papers(spark, sf, "abstract").where("abstract is not null").select("paper_key", F.explode(structure.headers(F.col("abstract"))).alias("h"))
    return d.select("paper_key", F.col("h.start_idx").cast("long").alias("start_idx"), "h.header_text", "h.section_type", F.round("h.confidence", 6).alias("confidence"))


_LINES = "string_split(text, chr(10))"


@query(
    f"WITH l AS (SELECT doc_id, {_LINES} AS ls, len({_LINES}) AS n FROM documents WHERE text IS NOT NULL), p AS (" + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS section_type, floor(n * {a}::DOUBLE)::BIGINT AS a, floor(n * {b}::DOUBLE)::BIGINT AS b, ls FROM l" for t, a, b in vocab.POSITIONS) + "),"
    " c AS (SELECT doc_id, section_type, a, array_to_string(list_filter(list_transform(ls[(a + 2):b], lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS content FROM p) SELECT doc_id, section_type, a AS start_idx, md5(content) AS content_md5 FROM c WHERE length(content) > 50"
)
def position_sections(spark, sf):
    """The position fallback: source files have no header lines."""
    d = table(spark, sf, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.explode(structure.section_rows(F.col("text"))).alias("s"))
    return d.select("doc_id", "s.section_type", F.col("s.start_idx").cast("long").alias("start_idx"), F.md5(F.col("s.content").cast("binary")).alias("content_md5"))


@query(
    f"WITH l AS (SELECT doc_id, {_LINES} AS ls, len({_LINES}) AS n, len({_LINES}) // 5 AS k FROM documents WHERE text IS NOT NULL), p AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS section_type, ls[(k * {i} + 1):({'n' if i == 4 else f'k * {i + 1}'})] AS part FROM l" for i, (t, _, _) in enumerate(vocab.POSITIONS))
    + ") SELECT doc_id, section_type, md5(array_to_string(list_filter(list_transform(part, lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS content_md5 FROM p"
)
def equal_sections(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.explode(structure.equal_sections(F.col("text"))).alias("s"))
    return d.select("doc_id", "s.section_type", F.md5(F.col("s.content").cast("binary")).alias("content_md5"))


def _candidate_sql() -> str:
    any_ = " OR ".join(f"regexp_matches(x, {q(p)})" for p in FACET_RULES)
    return (
        f"WITH t AS (SELECT paper_key, {SPLIT_D} AS s FROM papers WHERE abstract IS NOT NULL), e AS (SELECT paper_key, len(s) AS n, unnest(range(1, len(s) + 1)) AS i, s FROM t), c AS (SELECT paper_key, n, i, s[i] AS x FROM e),"
        f" d AS (SELECT paper_key, i, x, 0.7 * {FACET_WEIGHT} + 0.2 * (n - i + 1) / n + 0.1 * least(1.0, length(x) / 150) AS sc, list_filter(regexp_split_to_array(trim(lower(x)), '\\s+'), lambda w: w <> '') AS ws FROM c WHERE length(x) BETWEEN 25 AND 300 AND ({any_})),"
        f" f AS (SELECT paper_key, i, x, (sc + 0.05 * {hits('lower(x)', FACET_KEYWORDS)}) * CASE WHEN len(list_distinct(ws)) < 0.7 * len(ws) THEN 0.8 ELSE 1.0 END AS score FROM d)"
        " SELECT paper_key, x AS sentence, round(score, 6)::DOUBLE AS score FROM f"
    )


def _candidates():
    return structure.rescored(structure.candidates(F.col("abstract"), "abstract", FACET_WEIGHT, FACET_RULES), FACET_KEYWORDS)


@query(_candidate_sql())
def candidate_scores(spark, sf):
    d = papers(spark, sf, "abstract").where("abstract is not null").select("paper_key", F.explode(_candidates()).alias("c"))
    return d.select("paper_key", F.col("c.text").alias("sentence"), F.round("c.score", 6).alias("score"))


@query()
def diverse_select(spark, sf):
    d = papers(spark, sf, "abstract").where("abstract is not null").select("paper_key", structure.diverse(_candidates(), 3).alias("c"))
    return d.select("paper_key", F.array_join(F.transform("c", lambda x: x["text"]), ". ").alias("chosen"))


@query(
    "WITH w AS (SELECT paper_key, list_distinct(list_filter(regexp_split_to_array(trim(lower(title)), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(trim(lower(abstract)), '\\s+'), lambda x: x <> '')) AS b FROM papers WHERE title IS NOT NULL AND abstract IS NOT NULL)"
    " SELECT paper_key, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END, 6)::DOUBLE AS jaccard FROM w"
)
def jaccard_title_abstract(spark, sf):
    d = papers(spark, sf, "title", "abstract").where("title is not null and abstract is not null")
    return d.select("paper_key", F.round(T.jaccard(T.words(F.lower("title")), T.words(F.lower("abstract"))), 6).alias("jaccard"))


def _argmax_sql(tables: dict[str, list[str]], points: float) -> str:
    per = f"greatest(1.0, len({WORDS('abstract')}) / 100)"
    cols = {k: "round((" + " + ".join(f"len(regexp_extract_all(abstract, {q(p)}))" for p in ps) + f") * {points}::DOUBLE / {per}, 9)" for k, ps in tables.items()}
    top = f"greatest({', '.join(cols)})"
    case = " ".join(f"WHEN {k} = {top} THEN '{k}'" for k in cols)
    # its \\b knows ASCII words only, so other letters become ASCII ones first
    ascii_ = "regexp_replace(regexp_replace(abstract, '[^\\pL\\pN_\\x00-\\x7F]', ' ', 'g'), '[^\\x00-\\x7F]', 'x', 'g')"
    return f"WITH s AS (SELECT paper_key, abstract, {', '.join(f'{e} AS {k}' for k, e in cols.items())} FROM (SELECT paper_key, {ascii_} AS abstract FROM papers WHERE abstract IS NOT NULL)) SELECT paper_key, CASE WHEN trim(abstract) = '' THEN 'unknown' {case} END AS label, round(CASE WHEN trim(abstract) = '' THEN 0.0 ELSE least(1.0, {top}) END, 6)::DOUBLE AS confidence FROM s"


def _label(spark, sf, make):
    d = papers(spark, sf, "abstract").where("abstract is not null").select("paper_key", make(F.col("abstract")).alias("t"))
    return d.select("paper_key", "t.label", F.round("t.confidence", 6).cast("double").alias("confidence"))


@query(_argmax_sql(vocab.PAPER_TYPES, 0.1))
def paper_type(spark, sf):
    return _label(spark, sf, structure.paper_type)


@query(_argmax_sql(vocab.DOMAINS, 0.15))
def paper_domain(spark, sf):
    return _label(spark, sf, structure.domain)


def _quality_sql(c: str, name: str) -> str:
    t = "_".join(w.title() for w in name.split("_"))
    fixed = ", ".join(q(f"{t} {x}") for x in ("not clearly identified in available sections.", "not explicitly discussed in available sections.", "directions not explicitly mentioned."))
    n = f"length(trim({c}))"
    length = f"CASE WHEN {n} < 30 THEN {n} / 30 WHEN {n} > 1000 THEN greatest(0.5, 1 - ({n} - 1000) / 1000) ELSE 1.0 END"
    found = f"least(1.0, ({' + '.join(f'len(regexp_extract_all({c}, {q(p)}))' for p in vocab.QUALITY_PATTERNS[name])}) / greatest(1.0, len({WORDS(c)}) / 20))"
    k = vocab.QUALITY_KEYWORDS[name]
    rel = f"least(1.0, {hits(f'lower({c})', k)} / {len(k)} + least(0.3, len(list_filter(string_split({c}, '.'), lambda s: length(trim(s)) > 10)) / len(string_split({c}, '.'))))"
    return f"round(CASE WHEN {c} = '' OR trim({c}) IN ({fixed}) THEN 0.1 ELSE least(1.0, 0.3 * ({length}) + 0.4 * {found} + 0.3 * {rel}) END, 6)"


_Q = {n: _quality_sql(n, n) for n in vocab.FACETS}


@query(
    f"WITH c AS (SELECT summary_id, {', '.join(f'coalesce({n}, {q(chr(0)[:0])}) AS {n}' for n in vocab.FACETS)} FROM structured_summaries), s AS (SELECT summary_id, {', '.join(f'{e}::DOUBLE AS q_{n}' for n, e in _Q.items())} FROM c),"
    f" o AS (SELECT *, round(({' + '.join(f'q_{n}' for n in _Q)}) / 5, 6) AS overall FROM s) SELECT *, CASE WHEN overall >= 0.8 THEN 'excellent' WHEN overall >= 0.6 THEN 'good' WHEN overall >= 0.4 THEN 'fair' ELSE 'poor' END AS level FROM o"
)
def quality_scores(spark, sf):
    d = table(spark, sf, "structured_summaries", "summary_id", *vocab.FACETS)
    d = d.select("summary_id", *[structure.quality(F.col(n), n).alias(f"q_{n}") for n in vocab.FACETS])
    d = d.withColumn("overall", F.round(sum((F.col(f"q_{n}") for n in vocab.FACETS), F.lit(0.0)) / 5, 6))
    return d.withColumn("level", structure.level(F.col("overall")))


@query()
def recommendations(spark, sf):
    d = quality_scores(spark, sf)
    return d.select("summary_id", F.array_join(structure.recommendations(F.col("overall"), {n: F.col(f"q_{n}") for n in vocab.FACETS}), " | ").alias("recommendations"))


def _first(c: str) -> str:
    return f"CASE WHEN {c} <> '' THEN string_split({c}, '.')[1] || '.' END"


@query(f"SELECT summary_id, concat_ws(' ', {_first('contributions')}, {_first('methodology')}, {_first('results')}) AS overview FROM structured_summaries")
def short_overview(spark, sf):
    d = table(spark, sf, "structured_summaries", "summary_id", "contributions", "methodology", "results")
    return d.select("summary_id", structure.short_overview(F.col("contributions"), F.col("methodology"), F.col("results")).alias("overview"))


@query()
def structured_analysis(spark, sf):
    """The whole analyzer over all documents."""
    d = structure.analyze(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")
    return d.select("doc_id", "status", *vocab.FACETS, "short_overview", "paper_type", "domain", "overall_score", "quality_level", F.array_join("recommendations", " | ").alias("recommendations"), F.array_join(F.array_sort("sections_detected"), ",").alias("sections_detected"), F.array_join("adaptive_config.focus_sections", ",").alias("focus_sections"))


@query(
    "WITH t AS (SELECT result_id, list_filter(regexp_split_to_array(lower(coalesce(abstractive_summary, '')), '[^a-z0-9]+'), lambda x: x <> '') AS c, list_filter(regexp_split_to_array(lower(coalesce(abstract_summary, '')), '[^a-z0-9]+'), lambda x: x <> '') AS r FROM search_results),"
    " a AS (SELECT result_id, w, count(*) AS n FROM (SELECT result_id, unnest(c) AS w FROM t) GROUP BY 1, 2), b AS (SELECT result_id, w, count(*) AS n FROM (SELECT result_id, unnest(r) AS w FROM t) GROUP BY 1, 2), h AS (SELECT a.result_id, sum(least(a.n, b.n)) AS hits FROM a JOIN b USING (result_id, w) GROUP BY 1),"
    " s AS (SELECT t.result_id, CASE WHEN len(c) > 0 THEN coalesce(hits, 0) / len(c) ELSE 0.0 END AS p, CASE WHEN len(r) > 0 THEN coalesce(hits, 0) / len(r) ELSE 0.0 END AS rc FROM t LEFT JOIN h USING (result_id))"
    " SELECT result_id, round(p, 6)::DOUBLE AS precision, round(rc, 6)::DOUBLE AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END, 6)::DOUBLE AS f1 FROM s"
)
def rouge1(spark, sf):
    return evaluate.rouge_1(table(spark, sf, "search_results", "result_id", "abstractive_summary", "abstract_summary"), "result_id", "abstractive_summary", "abstract_summary")


@query()
def rouge_l(spark, sf):
    from lectern.functions.arrow import rouge_l as udf

    d = table(spark, sf, "search_results", "result_id", "abstractive_summary", "abstract_summary")
    return d.select("result_id", F.round(udf("abstractive_summary", "abstract_summary"), 6).alias("rouge_l"))


@query()
def lsa_summary(spark, sf):
    from lectern.functions.arrow import lsa_summarize

    return papers(spark, sf, "abstract").select("paper_key", lsa_summarize(2, STOPS)(F.col("abstract")).alias("summary"))


@query("SELECT api_used, processing_mode, count(*)::BIGINT AS runs, count(result_count)::BIGINT AS known, sum(result_count)::BIGINT AS results, count(DISTINCT query)::BIGINT AS queries FROM search_runs GROUP BY 1, 2")
def run_log_stats(spark, sf):
    d = table(spark, sf, "search_runs", "api_used", "processing_mode", "result_count", "query")
    return d.groupBy("api_used", "processing_mode").agg(F.count("*").alias("runs"), F.count("result_count").alias("known"), F.sum("result_count").alias("results"), F.count_distinct("query").alias("queries"))


@query("SELECT paper_id, count(*)::BIGINT AS shown, min(result_rank)::BIGINT AS best_rank, round(sum(score), 6) AS score_sum, round(min(score), 6) AS low, round(max(score), 6) AS high FROM search_results GROUP BY 1")
def result_stats(spark, sf):
    d = table(spark, sf, "search_results", "paper_id", "result_rank", "score")
    return d.groupBy("paper_id").agg(F.count("*").alias("shown"), F.min("result_rank").cast("long").alias("best_rank"), F.round(F.sum("score"), 6).alias("score_sum"), F.round(F.min("score"), 6).alias("low"), F.round(F.max("score"), 6).alias("high"))


QUESTION = "which encoder improves glacier monitoring"


@query()
def rank_papers(spark, sf):
    """Flagship: filter, TF-IDF summary, vector, cosine, deterministic top 10."""
    d = papers(spark, sf, "title", "authors", "year", "abstract", "retrieval_idx")
    return rank.rank_texts(d, QUESTION, 10, "abstract", 2, "tfidf", STOPS)


@query()
def rank_papers_combined(spark, sf):
    d = papers(spark, sf, "title", "authors", "year", "abstract", "retrieval_idx")
    return rank.rank_texts(d, QUESTION, 10, "abstract", 2, "comprehensive", STOPS)


@query()
def fast_mode(spark, sf):
    return rank.fast_mode(papers(spark, sf, "title", "authors", "year", "abstract", "retrieval_idx"), 10)


_TERMS = [t for t in "which encoder improves glacier monitoring".split()]


@query(
    f"WITH {_TFIDF}{_WEIGHTS}, p AS (SELECT paper_key, round(sum(w), 6) AS score FROM wt WHERE term IN ({', '.join(q(t) for t in _TERMS)}) GROUP BY 1) SELECT paper_key, score FROM p ORDER BY score DESC, paper_key LIMIT 10"
)
def lexical_topk(spark, sf):
    """The ten papers with most weight on the words of a question."""
    w = summarize.term_weight(papers(spark, sf, "abstract"), "paper_key", "abstract", _TERMS, STOPS)
    return w.orderBy(F.desc("score"), "paper_key").limit(10)
