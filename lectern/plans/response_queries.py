"""Queries of the readers, the responses and the remaining steps, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as T
from lectern.operators import evaluate, rank, respond, structure, summarize, understand
from lectern.plans import core_queries as core
from lectern.plans.core_queries import ORACLE, QUESTION, SPLIT_B, STOPS, WORDS, papers, q, query, table
from lectern.sources import landed, sinks

# ---- readers: payloads in each API's layout are made from the tables and read back -------------------

_READ = ("id", "title", "year", "published", "abstract", "pdf_url", "entry_url")


def _payload(rows, *fields):
    return rows.select(F.to_json(F.struct(*fields)).alias("payload"))


def _shown(found):
    return found.select(*_READ, F.array_join("authors", "|").alias("authors"))


def _source(spark, sf, name, key):
    return table(spark, sf, name, key, "id", "title", "authors", "year", "published", "abstract", "pdf_url", "entry_url").withColumnRenamed(key, "key")


_AUTHORS = "array_to_string(authors, '|') AS authors"


@query(f"SELECT id, trim(title) AS title, try_cast(substr(published, 1, 4) AS INT) AS year, published, trim(abstract) AS abstract, pdf_url, id AS entry_url, {_AUTHORS} FROM papers")
def read_arxiv(spark, sf):
    d = _source(spark, sf, "papers", "paper_key")
    links = F.array(F.struct(F.col("entry_url").alias("href"), F.lit("html").alias("title")), F.struct(F.col("pdf_url").alias("href"), F.when(F.col("pdf_url").isNotNull(), "pdf").alias("title")))
    entry = F.struct(F.col("id").alias("entry_id"), "title", F.col("abstract").alias("summary"), "published", "authors", links.alias("links"))
    return _shown(landed.read(_payload(d, F.array(entry).alias("entries")), "arxiv"))


@query(f"SELECT id, coalesce(trim(title), '') AS title, year, coalesce(published, '') AS published, trim(coalesce(abstract, '')) AS abstract, pdf_url, coalesce(entry_url, '') AS entry_url, {_AUTHORS} FROM papers")
def read_semantic_scholar(spark, sf):
    d = _source(spark, sf, "papers", "paper_key")
    item = F.struct(
        F.col("id").alias("paperId"), "title", F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"), "year", F.col("published").alias("publicationDate"), "abstract",
        F.col("entry_url").alias("url"), F.struct(F.col("pdf_url").alias("url")).alias("openAccessPdf"),
    )
    return _shown(landed.read(_payload(d, F.array(item).alias("data")), "semantic_scholar"))


@query(
    "SELECT id, coalesce(title, '') AS title, year, CASE WHEN year IS NULL THEN '{\"date-parts\":[[]]}' ELSE '{\"date-parts\":[[' || year || ',1]]}' END AS published, coalesce(abstract, '') AS abstract, NULL::VARCHAR AS pdf_url,"
    f" coalesce(entry_url, '') AS entry_url, {_AUTHORS} FROM catalog_papers"
)
def read_crossref(spark, sf):
    d = _source(spark, sf, "catalog_papers", "catalog_key")
    parts = F.array(F.when(F.col("year").isNull(), F.array().cast("array<int>")).otherwise(F.array("year", F.lit(1))))
    item = F.struct(F.col("id").alias("DOI"), F.array_compact(F.array("title")).alias("title"), F.transform("authors", lambda a: F.struct(a.alias("family"))).alias("author"), F.struct(parts.alias("date-parts")).alias("published-print"), "abstract", F.col("entry_url").alias("URL"))
    return _shown(landed.read(_payload(d, F.struct(F.array(item).alias("items")).alias("message")), "crossref"))


@query(
    "WITH one AS (SELECT coalesce(id, '') AS id, title, authors, year, abstract, row_number() OVER (PARTITION BY coalesce(id, '') ORDER BY catalog_key) AS r FROM catalog_papers)"
    " SELECT id, trim(coalesce(title, '')) AS title, year, CASE WHEN year IS NULL THEN '{}' ELSE '{''Year'': ''' || year || ''', ''Month'': ''1''}' END AS published, trim(coalesce(abstract, '')) AS abstract, NULL::VARCHAR AS pdf_url,"
    " 'https://pubmed.ncbi.nlm.nih.gov/' || id || '/' AS entry_url, coalesce(array_to_string(list_filter(authors, lambda a: a IS NOT NULL AND a <> ''), '|'), '') AS authors FROM one WHERE r = 1"
)
def read_pubmed(spark, sf):
    """Ids of landed searches meet their landed details; single authors stand without a list."""
    d = _source(spark, sf, "catalog_papers", "catalog_key").withColumn("id", F.coalesce("id", F.lit("")))
    first = d.groupBy("id").agg(F.min_by(F.struct("title", "authors", "year", "abstract"), "key").alias("x")).select("id", "x.*")
    names = F.transform("authors", lambda a: F.to_json(F.struct(a.alias("LastName"))))
    author = F.when(F.size("authors") == 1, F.element_at(names, 1)).otherwise(F.concat(F.lit("["), F.array_join(names, ","), F.lit("]")))
    article = F.struct(F.col("title").alias("ArticleTitle"), F.struct(F.split("abstract", " ").alias("AbstractText")).alias("Abstract"), F.struct(F.lit("@authors@").alias("Author")).alias("AuthorList"))
    date = F.when(F.col("year").isNull(), F.struct(F.lit(None).cast("string").alias("Year"), F.lit(None).cast("string").alias("Month"))).otherwise(F.struct(F.col("year").cast("string").alias("Year"), F.lit("1").alias("Month")))
    citation = F.struct(F.struct(F.col("id").alias("$")).alias("PMID"), article.alias("Article"), date.alias("DateCompleted"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(citation.alias("MedlineCitation"))).alias("PubmedArticle")).alias("PubmedArticleSet")))
    details = first.select(F.replace(body, F.lit('"@authors@"'), F.coalesce(author, F.lit("[]"))).alias("payload"))
    searches = first.select(F.to_json(F.struct(F.struct(F.array("id").alias("idlist")).alias("esearchresult"))).alias("payload"))
    return _shown(landed.pubmed_found(searches, details))


@query("SELECT result_id, paper_id, result_rank::BIGINT AS result_rank, score FROM search_results")
def json_rows(spark, sf):
    """Rows as JSON lines, read back."""
    d = table(spark, sf, "search_results", "result_id", "paper_id", "result_rank", "score")
    return sinks.as_json(d).select(F.from_json("json", "result_id long, paper_id string, result_rank long, score double").alias("r")).select("r.*")


# ---- understanding ----------------------------------------------------------------------------------

_CATEGORIES = ["domain", "methods", "datasets", "metrics", "keywords"]


@query(
    "WITH e AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category, unnest(range(1, len(entities.{c}) + 1)) AS i, entities.{c} AS t FROM search_runs" for c in ("domain", "methods", "datasets", "metrics")) + "),"
    f" d AS (SELECT category, t[i] AS term, min(i) - 1 AS pos FROM e WHERE trim(t[i]) <> '' GROUP BY 1, 2), r AS (SELECT *, {core._BYTES.format(x='term')} AS v FROM d)"
    " SELECT category, term, pos::BIGINT AS pos, round((v[1] / (sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-8))::FLOAT::DOUBLE, 5) AS first FROM r"
)
def vocabulary_scan(spark, sf):
    """The entities of all runs as a vocabulary with vectors."""
    d = table(spark, sf, "search_runs", "entities")
    lists = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"entities.{c}").alias("terms")) for c in ("domain", "methods", "datasets", "metrics")])).alias("x")
    return understand.vocabulary(d.select(lists).select("x.*")).select("category", "term", "pos", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"))


@query("SELECT run_id, " + ", ".join(f"array_to_string(list_transform(list_filter(list_zip(coalesce(entities.{c}, []), range(1, 1 + len(coalesce(entities.{c}, [])))), lambda x: trim(x[1]) <> '' AND list_position(entities.{c}, x[1]) = x[2]), lambda x: x[1]), '|') AS {c}" for c in _CATEGORIES) + " FROM search_runs")
def distinct_entities(spark, sf):
    d = table(spark, sf, "search_runs", "run_id", "entities").withColumn("e", understand.distinct_entities(F.col("entities"), _CATEGORIES))
    return d.select("run_id", *[F.array_join(f"e.{c}", "|").alias(c) for c in _CATEGORIES])


_SYNONYMS = {"survey": ["review", "literature_overview"], "method": ["approach", "technique"], "vergleich": ["comparison"], "a": ["an_extraordinarily_long_synonym_phrase_here"]}
_SYN_SQL = "flatten(list_transform(t, lambda w: CASE " + " ".join(f"WHEN w = {q(t)} THEN [{', '.join(q(x.replace('_', ' ')) for x in ws if len(x) <= 30)}]::VARCHAR[]" for t, ws in _SYNONYMS.items()) + " ELSE [] END))"


@query(f"SELECT run_id, array_to_string(list_sort(list_distinct(list_concat(t, coalesce({_SYN_SQL}, [])))), ' ') AS expanded FROM (SELECT run_id, {core._QTOKENS} AS t FROM search_runs)")
def expand_synonyms(spark, sf):
    d = table(spark, sf, "search_runs", "run_id", "query")
    return d.select("run_id", F.array_join(understand.expand_query(F.col("query"), None, vocab.QUERY_STOPWORDS, _SYNONYMS), " ").alias("expanded"))


@query("SELECT run_id, regexp_replace(trim(regexp_replace(query, '\\s+', ' ', 'g')), '\\s+([.,!?;:])', '\\1', 'g') AS text FROM search_runs WHERE query IS NOT NULL")
def translation(spark, sf):
    """Queries after translation; without a model the text itself, put in order."""
    d = table(spark, sf, "search_runs", "run_id", "query", "query_language").where("query is not null")
    return d.select("run_id", understand.post_process_translation(understand.translated(F.col("query"), F.col("query_language"))).alias("text"))


# ---- summaries and responses ------------------------------------------------------------------------


def _extract_sql(indicators) -> str:
    """CTEs up to x: paper_key, abstract, keys, terms, focus, contribution, structured."""
    terms = f"list_filter([{', '.join(q(i) for i in indicators)}], lambda i: contains(l, i))"
    pats = " + ".join(f"regexp_matches(lower(x), {q(p)})::INT" for p in vocab.KEY_SENTENCE_PATTERNS)
    score = f"(2.0 * len(list_filter(terms, lambda i: contains(lower(x), i))) + {pats} + (len({WORDS('x')}) BETWEEN 10 AND 30)::INT)"
    any_of = lambda v, *ws: "(" + " OR ".join(f"contains(lower({v}), {q(w)})" for w in ws) + ")"
    last = lambda cond: f"list_filter(keys, lambda k: {cond})[-1]"
    focus = last(any_of("k", "method", "approach", "algorithm"))
    gains = (("novel", "new", "propose", "introduce"), ("improve", "better", "outperform"), ("evaluate", "compare", "analysis"))
    gain = last(any_of("k", *[w for g in gains for w in g]))
    return (
        f"t AS (SELECT paper_key, trim(coalesce(abstract, '')) AS abstract, lower(trim(coalesce(abstract, ''))) AS l FROM papers), u AS (SELECT paper_key, abstract, CASE WHEN length(abstract) < 50 THEN []::VARCHAR[] ELSE {terms} END AS terms, CASE WHEN length(abstract) < 50 THEN []::VARCHAR[] ELSE {SPLIT_B} END AS s FROM t),"
        f" e AS (SELECT paper_key, terms, len(s) AS n, unnest(range(1, len(s) + 1)) AS i, s FROM u), f AS (SELECT paper_key, n, i, s[i] AS x, terms FROM e), g AS (SELECT paper_key, n, i, x, {score} AS score FROM f),"
        " h AS (SELECT *, CASE WHEN n <= 4 THEN i ELSE row_number() OVER (PARTITION BY paper_key ORDER BY score DESC, i) END AS r FROM g), k AS (SELECT paper_key, list(x ORDER BY r) AS keys FROM h WHERE r <= 4 GROUP BY 1),"
        f" m AS (SELECT u.paper_key, abstract, terms, coalesce(keys, []::VARCHAR[]) AS keys FROM u LEFT JOIN k USING (paper_key)), o AS (SELECT *, {focus} AS fs, {gain} AS gs FROM m),"
        f" w AS (SELECT *, CASE WHEN fs IS NULL THEN 'Research study' WHEN {any_of('fs', 'machine learning', 'deep learning')} THEN 'Machine Learning methodology' WHEN {any_of('fs', 'data')} THEN 'Data analysis approach' ELSE 'Methodological approach' END AS focus,"
        f" CASE WHEN gs IS NULL THEN 'Presents findings' WHEN {any_of('gs', *gains[0])} THEN 'Introduces novel approach' WHEN {any_of('gs', *gains[1])} THEN 'Improves existing methods' ELSE 'Provides comparative analysis' END AS contribution FROM o),"
        " x AS (SELECT *, 'FOCUS: ' || focus || chr(10) || 'CONTRIBUTION: ' || contribution || chr(10) || 'KEY POINTS: ' || array_to_string(keys[1:3], ' ') || chr(10) || 'TERMS: ' || array_to_string(terms[1:5], ', ') AS structured FROM w)"
    )


ORACLE["smart_extract_full"] = f"WITH {_extract_sql(vocab.RESEARCH_INDICATORS)} SELECT paper_key, focus AS paper_focus, contribution, structured AS structured_summary FROM x"

_YEAR = "coalesce(p.year::VARCHAR, 'None')"


def _line(n: int) -> str:
    return f"array_to_string(coalesce(p.authors, [])[1:{n}], ', ') || CASE WHEN len(coalesce(p.authors, [])) > {n} THEN '...' ELSE '' END"


ORACLE["fast_mode"] = (
    f"WITH {_extract_sql(vocab.RESEARCH_INDICATORS)} SELECT p.paper_key, p.title, 0.8::DOUBLE AS score, coalesce(nullif(p.abstract, ''), 'No abstract available') AS original_abstract, structured AS extractive_summary, focus AS paper_focus, contribution,"
    f" array_to_string(terms, '|') AS key_terms, 'This paper \"' || p.title || '\" by ' || {_line(2)} || ' (' || {_YEAR} || ') focuses on ' || lower(focus) || '. ' || contribution || '. Key aspects include: ' || array_to_string(keys[1:2], ', ') || '.' AS final_response, 'extractive_ollama' AS method"
    " FROM papers p JOIN x USING (paper_key) WHERE p.retrieval_idx < 10"
)

_STATES = ["offline", "empty", "timeout", "connection", "error"]


@query(
    "SELECT paper_key, s.state, CASE s.state"
    f" WHEN 'offline' THEN 'This paper ''' || title || ''' by ' || array_to_string(coalesce(authors, [])[1:3], ', ') || ' (' || {_YEAR} || ') focuses on the research described in the abstract. The key findings include insights from multiple analysis methods.'"
    f" WHEN 'empty' THEN 'This paper ''' || title || ''' by ' || {_line(3)} || ' (' || {_YEAR} || ') presents research on ' || lower(title) || '. Based on multiple analysis methods, the work appears to focus on the key concepts and findings described in the abstract and summaries.'"
    f" WHEN 'timeout' THEN 'This paper ''' || title || ''' by ' || {_line(3)} || ' (' || {_YEAR} || ') presents research on ' || substr(lower(title), 1, 50) || '. Based on the analysis summaries, this work contributes valuable insights to the field.'"
    f" WHEN 'connection' THEN 'This paper ''' || title || ''' by ' || {_line(3)} || ' (' || {_YEAR} || ') presents important research findings. The analysis suggests significant contributions to the field.'"
    f" ELSE 'This paper ''' || title || ''' by ' || {_line(3)} || ' (' || {_YEAR} || ') contains valuable research insights based on the available analysis.' END AS response FROM papers p, (SELECT unnest([{', '.join(q(s) for s in _STATES)}]) AS state) s"
)
def final_responses(spark, sf):
    d = papers(spark, sf, "title", "authors", "year").withColumn("state", F.explode(F.array(*[F.lit(s) for s in _STATES])))
    return d.select("paper_key", "state", respond.final_response(F.col("title"), F.col("authors"), F.col("year"), F.col("state")).alias("response"))


@query(
    f"WITH {_extract_sql(vocab.RESEARCH_INDICATORS)} SELECT paper_key, 'This paper \"' || p.title || '\" by ' || {_line(3)} || ' (' || {_YEAR} || ') presents work on ' || lower(focus) || '. ' || contribution || '. The research ' || coalesce(keys[1], 'contributes to the field') || '.' AS response FROM papers p JOIN x USING (paper_key)"
)
def extract_fallback(spark, sf):
    d = papers(spark, sf, "title", "authors", "year", "abstract").withColumn("e", summarize.smart_extract(F.col("abstract")))
    return d.select("paper_key", summarize.fallback_summary(F.col("title"), F.col("authors"), F.col("year"), F.col("e")).alias("response"))


@query(
    "WITH r AS (SELECT run_id, count(*) AS n, string_agg(coalesce(paper_id, '-'), '|' ORDER BY result_rank NULLS FIRST, result_id) AS ids,"
    " string_agg(coalesce(nullif(summaries.ollama, ''), summaries.abstractive, abstractive_summary, '-'), '|' ORDER BY result_rank NULLS FIRST, result_id) AS texts FROM search_results GROUP BY 1)"
    " SELECT run_id, query, processing_mode, api_used, coalesce(n, 0)::BIGINT AS papers_processed, coalesce(ids, '') AS paper_ids, md5(coalesce(texts, '')) AS texts_md5 FROM search_runs LEFT JOIN r USING (run_id)"
)
def response_envelope(spark, sf):
    runs = table(spark, sf, "search_runs")
    d = respond.envelope(runs, table(spark, sf, "search_results"))
    joined = lambda f: F.array_join(F.transform("response.results", lambda r: F.coalesce(r[f], F.lit("-"))), "|")
    return d.select("run_id", "query", "response.processing_mode", "response.api_used", "response.performance.papers_processed", joined("paper_id").alias("paper_ids"), F.md5(joined("abstractive_summary").cast("binary")).alias("texts_md5"))


@query(
    f"SELECT summary_id, {q(vocab.NO_REWRITE)} AS abstractive_summary FROM structured_summaries"
)
def rewrite(spark, sf):
    """The structured summary as running text: the fixed sentence, as no model is plugged in."""
    d = table(spark, sf, "structured_summaries", "summary_id", *vocab.FACETS)
    none = F.lit(None).cast("string")
    return d.select("summary_id", respond.rewritten(none, F.array().cast("array<string>"), F.lit(None).cast("int"), {n: F.col(n) for n in vocab.FACETS}).alias("abstractive_summary"))


# ---- ranking ----------------------------------------------------------------------------------------


def _rank_sql(source: str, m: int, k: int) -> str:
    """Top k of ``source`` (paper_key, title, authors, year, retrieval_idx, abstract) by the vector of its TF-IDF summary."""
    cte = f"{core._TFIDF}{core._WEIGHTS}".replace("FROM papers WHERE abstract IS NOT NULL", "FROM src")
    unit = lambda v: f"list_transform({v}, lambda x: (x / (sqrt(list_sum(list_transform({v}, lambda y: y * y))) + 1e-8))::FLOAT::DOUBLE)"
    size = lambda v: f"(sqrt(list_sum(list_transform({v}, lambda x: x * x))) + 1e-8)"
    return (
        f"WITH src AS ({source}), {cte}, v AS (SELECT paper_key, count(DISTINCT term) AS v FROM wt GROUP BY 1), sc AS (SELECT paper_key, idx, round(sum(w) / any_value(v), 9) AS score FROM wt JOIN v USING (paper_key) GROUP BY 1, 2),"
        " r AS (SELECT s.paper_key, s.idx, sentence, row_number() OVER (PARTITION BY s.paper_key ORDER BY coalesce(score, 0) DESC, s.idx) AS r FROM s LEFT JOIN sc USING (paper_key, idx)),"
        f" summed AS (SELECT paper_key, coalesce(string_agg(sentence, ' ' ORDER BY idx), '') AS summary FROM r WHERE r <= {m} GROUP BY 1), j AS (SELECT src.*, coalesce(summary, '') AS summary FROM src LEFT JOIN summed USING (paper_key)),"
        f" b AS (SELECT *, {core._BYTES.format(x='summary')} AS b, {core._BYTES.format(x=q(QUESTION))} AS c FROM j), u AS (SELECT *, {unit('b')} AS bu, {unit('c')} AS cu FROM b),"
        f" z AS (SELECT *, round(list_sum(list_transform(range(1, 17), lambda i: bu[i] * cu[i])) / ({size('bu')} * {size('cu')}), 6) AS score FROM u)"
        f" SELECT paper_key, title, 'tfidf' AS method, summary, 'This paper ''' || title || ''' by ' || array_to_string(coalesce(authors, [])[1:2], ', ') || ' (' || coalesce(year::VARCHAR, 'None') || ') presents research findings on the topic.' AS final_response, score FROM z ORDER BY score DESC, retrieval_idx NULLS FIRST, paper_key LIMIT {k}"
    )


ORACLE["rank_papers"] = _rank_sql("SELECT paper_key, title, authors, year, retrieval_idx, abstract FROM papers WHERE abstract IS NOT NULL AND length(trim(abstract)) >= 50", 2, 10)


@query()
def rank_full_texts(spark, sf):
    """Documents ranked over their whole texts by path, repository and year of the commit."""
    d = table(spark, sf, "documents", "doc_id", "text", "path", "repo", "committed_at")
    d = d.select(F.col("doc_id").alias("paper_key"), F.col("path").alias("title"), F.array_compact(F.array("repo")).alias("authors"), F.year("committed_at").alias("year"), F.lit(0).alias("retrieval_idx"), F.col("text").alias("body"), F.lit(None).cast("string").alias("abstract"))
    return rank.rank_full_texts(d, QUESTION, 10, None, 3, "tfidf", STOPS)


_CLEAN = ORACLE["clean_text"].replace("SELECT doc_id,", "SELECT doc_id AS paper_key, path AS title, CASE WHEN repo IS NULL THEN [] ELSE [repo] END AS authors, year(committed_at) AS year, 0 AS retrieval_idx,").replace("AS body FROM documents WHERE text IS NOT NULL", "AS abstract FROM documents WHERE length(trim(text)) >= 200")
ORACLE["rank_full_texts"] = _rank_sql(f"SELECT * FROM ({_CLEAN}) WHERE length(trim(abstract)) >= 50", 3, 10)


# ---- structured analysis ----------------------------------------------------------------------------

_Q_ROWS = ORACLE["quality_scores"]
_MESSAGES = [
    f"CASE WHEN overall < 0.4 THEN {q(vocab.RECOMMEND_POOR)} WHEN overall < 0.6 THEN {q(vocab.RECOMMEND_FAIR)} END",
    *[f"CASE WHEN q_{n} < 0.3 THEN {q(vocab.RECOMMEND_MUCH.format(n))} WHEN q_{n} < 0.5 THEN {q(vocab.RECOMMEND_SOME.format(n))} END" for n in vocab.FACETS],
]
_MISSING = "concat_ws(', ', " + ", ".join(f"CASE WHEN q_{n} < 0.2 THEN '{n}' END" for n in ("contributions", "methodology", "results")) + ")"
ORACLE["recommendations"] = f"SELECT summary_id, concat_ws(' | ', {', '.join(_MESSAGES)}, CASE WHEN {_MISSING} <> '' THEN {q(vocab.RECOMMEND_MISSING)} || {_MISSING} END) AS recommendations FROM ({_Q_ROWS})"

_WORDSET = lambda c: f"list_distinct({WORDS(f'lower({c})')})"
_JACCARD = f"(len(list_intersect({_WORDSET('x[1].text')}, {_WORDSET('y.text')})) / len(list_distinct(list_concat({_WORDSET('x[1].text')}, {_WORDSET('y.text')}))))"
ORACLE["diverse_select"] = (
    f"WITH f AS (SELECT *, row_number() OVER (PARTITION BY paper_key) AS i FROM ({ORACLE['candidate_scores'].replace('SELECT paper_key, x AS sentence, round(score, 6)::DOUBLE AS score FROM f', 'SELECT paper_key, i AS place, x AS sentence, round(score, 9) AS score FROM f')})),"
    " l AS (SELECT paper_key, list([{'score': score, 'text': sentence}] ORDER BY score DESC, place) AS found FROM f GROUP BY 1),"
    f" d AS (SELECT paper_key, list_reduce(found, lambda acc, x: CASE WHEN len(acc) >= 3 OR len(list_filter(acc, lambda y: {_JACCARD} > 0.6)) > 0 OR x[1].score < 1.2 * acc[-1].score THEN acc ELSE list_concat(acc, x) END) AS chosen FROM l)"
    " SELECT paper_key, coalesce(array_to_string(list_transform(chosen, lambda c: c.text), '. '), '') AS chosen FROM papers LEFT JOIN d USING (paper_key) WHERE abstract IS NOT NULL"
)


@query(
    "WITH h AS (" + ORACLE["section_headers"] + "), l AS (SELECT paper_key, list([{'a': start_idx, 't': section_type, 'c': confidence}] ORDER BY start_idx) AS found FROM h GROUP BY 1),"
    " d AS (SELECT paper_key, list_reduce(found, lambda acc, x: CASE WHEN x[1].a - acc[-1].a < 10 AND x[1].c > acc[-1].c THEN list_concat(acc[:-2], x) WHEN x[1].a - acc[-1].a < 10 THEN acc ELSE list_concat(acc, x) END) AS kept FROM l)"
    " SELECT paper_key, array_to_string(list_transform(kept, lambda k: k.t || '@' || k.a), '|') AS kept FROM d"
)
def resolved_headers(spark, sf):
    d = papers(spark, sf, "abstract").where("abstract is not null").withColumn("k", structure.resolved(structure.headers(F.col("abstract")))).where(F.size("k") > 0)
    return d.select("paper_key", F.array_join(F.transform("k", lambda k: F.concat(k["section_type"], F.lit("@"), k["start_idx"].cast("string"))), "|").alias("kept"))


@query(
    "WITH l AS (SELECT doc_id, string_split(text, chr(10))[1:100] AS ls FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM l), t AS (SELECT doc_id, i, trim(ls[i]) AS s FROM e),"
    " b AS (SELECT doc_id, min(i) AS b FROM t WHERE regexp_matches(s, '(?i)^(?:abstract|summary|résumé)\\s*:?$') GROUP BY 1), g AS (SELECT t.*, b, sum((s <> '')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM t JOIN b USING (doc_id) WHERE i > b),"
    " c AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY doc_id ORDER BY i), 0) AS got FROM g), z AS (SELECT doc_id, min(i) AS z FROM c WHERE got > 30 OR regexp_matches(s, '(?i)^(?:\\d+\\.?\\s*)?(?:introduction|keywords?)\\b') GROUP BY 1)"
    " SELECT doc_id, md5(string_agg(s, ' ' ORDER BY i)) AS abstract_md5 FROM c LEFT JOIN z USING (doc_id) WHERE s <> '' AND (z IS NULL OR i < z) GROUP BY 1 HAVING count(*) >= 3"
)
def abstract_lines(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text").where("text is not null").withColumn("a", structure.abstract_section(F.col("text"))).where("a is not null")
    return d.select("doc_id", F.md5(F.col("a").cast("binary")).alias("abstract_md5"))


def _config_sql() -> str:
    focus = (
        "list_concat(['abstract', 'introduction', 'conclusion'], list_concat(CASE kind WHEN 'theoretical' THEN ['methodology'] WHEN 'empirical' THEN ['results', 'methodology'] WHEN 'survey' THEN ['related_work', 'discussion'] ELSE [] END,"
        " CASE field WHEN 'machine_learning' THEN ['methodology', 'results'] WHEN 'theory' THEN ['methodology'] ELSE [] END))"
    )
    return (
        f"WITH k AS (SELECT paper_key, label AS kind FROM ({ORACLE['paper_type']})), f AS (SELECT paper_key, label AS field FROM ({ORACLE['paper_domain']})) SELECT paper_key, CASE kind WHEN 'theoretical' THEN 2 WHEN 'survey' THEN 4 ELSE 3 END::BIGINT AS max_contributions,"
        f" CASE WHEN kind = 'theoretical' OR field = 'theory' THEN 5 ELSE 4 END::BIGINT AS max_methodology, CASE kind WHEN 'empirical' THEN 5 WHEN 'survey' THEN 2 ELSE 4 END::BIGINT AS max_results, array_to_string({focus}, ',') AS focus FROM k JOIN f USING (paper_key)"
    )


@query(_config_sql())
def adaptive_config(spark, sf):
    d = papers(spark, sf, "abstract").where("abstract is not null")
    d = d.withColumn("c", structure.adaptive_config(structure.paper_type(F.col("abstract"))["label"], structure.domain(F.col("abstract"))["label"]))
    return d.select("paper_key", *[F.col(f"c.{n}").cast("long").alias(n) for n in ("max_contributions", "max_methodology", "max_results")], F.array_join("c.focus_sections", ",").alias("focus"))


# ---- evaluation -------------------------------------------------------------------------------------


@query(f"SELECT count(*)::BIGINT AS pairs, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM ({ORACLE['rouge1']})")
def metric_means(spark, sf):
    return evaluate.metric_means(core.rouge1(spark, sf), "precision", "recall", "f1")


@query("SELECT paper_id, count(score)::BIGINT AS votes, sum((score >= 0.5)::INT)::BIGINT AS relevant, round(avg((score >= 0.5)::INT), 6) AS share FROM search_results GROUP BY 1")
def feedback_stats(spark, sf):
    """Shown results as votes: relevant from a score of 0.5 on."""
    d = table(spark, sf, "search_results", "paper_id", "score")
    return evaluate.feedback_stats(d.select("paper_id", (F.col("score") >= 0.5).alias("relevant")))


@query("SELECT result_id, 0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, 0.0::DOUBLE AS f1 FROM search_results")
def bert_score(spark, sf):
    """Zeros, as no model is plugged in."""
    d = table(spark, sf, "search_results", "result_id", "abstractive_summary", "abstract_summary")
    return d.select("result_id", evaluate.bert_score(F.col("abstractive_summary"), F.col("abstract_summary")).alias("b")).select("result_id", "b.*")


@query()
def split_c(spark, sf):
    """Robust sentences behind compatibility normalization (Python; tested against cases)."""
    from lectern.functions.arrow import robust_split

    d = papers(spark, sf, "abstract").where("abstract is not null").withColumn("s", robust_split("abstract"))
    return d.select("paper_key", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("parts"))


@query()
def stems(spark, sf):
    """Porter stems of the words of the queries (Python; tested against published examples)."""
    from lectern.functions.arrow import porter_stem

    d = table(spark, sf, "search_runs", "query").where("query is not null")
    return d.select(F.explode(F.array_distinct(T.word_tokens(F.col("query")))).alias("word")).distinct().select("word", porter_stem("word").alias("stem"))
