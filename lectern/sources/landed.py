"""Readers of landed API payloads into one paper schema, and file readers.

Retrieval from the network happens outside: payloads are landed as JSON, one response
per row, and read here with explicit schemas (all optional fields nullable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The common schema.
PAPER = "id string, title string, authors array<string>, year int, published string, abstract string, pdf_url string, entry_url string"

_SCHOLAR = "data array<struct<paperId:string,title:string,authors:array<struct<name:string>>,year:int,publicationDate:string,abstract:string,url:string,openAccessPdf:struct<url:string>>>"
_DATE = "struct<`date-parts`:array<array<int>>>"
_CROSSREF = f"message struct<items:array<struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,`published-print`:{_DATE},`published-online`:{_DATE},abstract:string,URL:string>>>"
_ARXIV = "entries array<struct<entry_id:string,title:string,summary:string,published:string,updated:string,authors:array<string>,links:array<struct<href:string,title:string>>>>"
_PUBMED = "PubmedArticleSet struct<PubmedArticle:array<struct<MedlineCitation:struct<PMID:struct<`$`:string>,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:string>,AuthorList:struct<Author:string>>,DateCompleted:string>>>>"
_AUTHOR = "struct<ForeName:string,LastName:string>"


def _rows(payloads: DataFrame, column: str, schema: str, path: str) -> DataFrame:
    return payloads.select(F.explode(F.from_json(column, schema)[path] if "." not in path else F.from_json(column, schema)[path.split(".")[0]][path.split(".")[1]]).alias("r"))


def semantic_scholar(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Papers of landed Semantic Scholar responses; unnamed authors are ``Unknown``, bad payloads give no rows."""
    r = _rows(payloads, column, _SCHOLAR, "data")
    return r.select(
        F.col("r.paperId").alias("id"), F.trim(F.coalesce("r.title", F.lit(""))).alias("title"), F.transform("r.authors", lambda a: F.coalesce(a["name"], F.lit("Unknown"))).alias("authors"),
        "r.year", F.coalesce("r.publicationDate", F.lit("")).alias("published"), F.trim(F.coalesce("r.abstract", F.lit(""))).alias("abstract"), F.col("r.openAccessPdf.url").alias("pdf_url"), F.coalesce("r.url", F.lit("")).alias("entry_url"),
    )


def crossref(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Papers of landed CrossRef responses: first title, ``given family`` names, year of the print or else online date."""
    r = _rows(payloads, column, _CROSSREF, "message.items")
    date = F.coalesce(F.col("r.published-print"), F.col("r.published-online"))
    return r.select(
        F.col("r.DOI").alias("id"), F.coalesce(F.try_element_at("r.title", F.lit(1)), F.lit("")).alias("title"), F.transform("r.author", lambda a: F.concat_ws(" ", a["given"], a["family"])).alias("authors"),
        F.try_element_at(F.try_element_at(date["date-parts"], F.lit(1)), F.lit(1)).alias("year"), F.coalesce(F.to_json(date), F.lit("")).alias("published"), F.coalesce("r.abstract", F.lit("")).alias("abstract"), F.lit(None).cast("string").alias("pdf_url"), F.coalesce("r.URL", F.lit("")).alias("entry_url"),
    )


def arxiv(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Papers of landed arXiv responses; the PDF link is the first titled ``pdf`` or ending in ``.pdf``."""
    r = _rows(payloads, column, _ARXIV, "entries")
    pdf = F.try_element_at(F.filter("r.links", lambda x: (x["title"] == "pdf") | x["href"].endswith(".pdf")), F.lit(1))
    return r.select(
        F.col("r.entry_id").alias("id"), F.trim("r.title").alias("title"), "r.authors", F.substring("r.published", 1, 4).try_cast("int").alias("year"), "r.published", F.trim("r.summary").alias("abstract"), pdf["href"].alias("pdf_url"), F.col("r.entry_id").alias("entry_url"), F.coalesce("r.updated", "r.published").alias("updated"),
    )


def _listed(json: Column, of: str) -> Column:
    """A JSON value that is a list of things or one thing, as an array."""
    return F.when(F.startswith(F.ltrim(json), F.lit("[")), F.from_json(json, f"array<{of}>")).otherwise(F.array(F.from_json(json, of)) if of != "string" else F.array(json))


def pubmed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Papers of landed PubMed details (MedlineCitation layout).

    Abstract parts are joined by a space, one author may stand without a list, authors
    without a last name are left out, the year is that of DateCompleted; no PDF link.
    """
    r = _rows(payloads, column, _PUBMED, "PubmedArticleSet.PubmedArticle").select(F.col("r.MedlineCitation").alias("m"))
    named = F.filter(_listed(F.col("m.Article.AuthorList.Author"), _AUTHOR), lambda a: F.coalesce(a["LastName"], F.lit("")) != "")
    authors = F.transform(named, lambda a: F.concat_ws(" ", F.nullif(a["ForeName"], F.lit("")), a["LastName"]))
    pmid, date = F.coalesce(F.col("m.PMID")["$"], F.lit("")), F.col("m.DateCompleted")
    printed = F.replace(F.replace(F.replace(date, F.lit('":'), F.lit("': ")), F.lit(',"'), F.lit(", '")), F.lit('"'), F.lit("'"))
    return r.select(
        pmid.alias("id"), F.trim(F.coalesce("m.Article.ArticleTitle", F.lit(""))).alias("title"), F.coalesce(authors, F.array().cast("array<string>")).alias("authors"), F.get_json_object(date, "$.Year").try_cast("int").alias("year"),
        F.coalesce(printed, F.lit("")).alias("published"), F.trim(F.coalesce(F.array_join(_listed(F.col("m.Article.Abstract.AbstractText"), "string"), " "), F.lit(""))).alias("abstract"),
        F.lit(None).cast("string").alias("pdf_url"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")).alias("entry_url"),
    )


def pubmed_found(searches: DataFrame, details: DataFrame, column: str = "payload") -> DataFrame:
    """Papers of the ids that landed searches list, in the order of the list (rank from 0), with their landed details.

    An id without details gives no row; repeated details of an id count once.
    """
    ids = searches.select(F.posexplode(F.from_json(column, "esearchresult struct<idlist:array<string>>")["esearchresult"]["idlist"]).alias("rank", "id"))
    return ids.join(pubmed(details, column).dropDuplicates(["id"]), "id")


READERS = {"arxiv": arxiv, "semantic_scholar": semantic_scholar, "pubmed": pubmed, "crossref": crossref}
#: Orders of arXiv results; any other name counts as relevance.  All but relevance run from the newest on.
SORTS = {"lastUpdatedDate": "updated", "submittedDate": "published"}


def read(payloads: DataFrame, api: str, column: str = "payload", sort_by: str = "relevance") -> DataFrame:
    """Papers of landed payloads of one API; ValueError for an unknown API, before anything is planned.

    ``sort_by`` orders arXiv results; by relevance they stay as they landed.
    """
    if api not in READERS:
        raise ValueError(f"unknown api {api!r}; known: {sorted(READERS)}")
    found = READERS[api](payloads, column)
    if api == "arxiv":
        found = found.orderBy(F.desc(SORTS[sort_by]), "id") if sort_by in SORTS else found
        return found.drop("updated")
    return found


def pdf_url_of(paper_id: Column) -> Column:
    """PDF address of a paper id: the part behind ``/abs/``, or without ``arxiv:``; any version suffix is dropped."""
    plain = F.when(F.contains(paper_id, F.lit("/abs/")), F.substring_index(paper_id, "/abs/", -1)).otherwise(F.regexp_replace(paper_id, "^.*arxiv:", ""))
    return F.concat(F.lit("https://arxiv.org/pdf/"), F.regexp_replace(plain, r"v\d+$", ""), F.lit(".pdf"))


def cache_key(url: Column) -> Column:
    """File name of a fetched document: the MD5 of its address."""
    return F.concat(F.md5(url.cast("binary")), F.lit(".pdf"))


def link(pdf_url: Column, entry_url: Column) -> Column:
    return F.coalesce(F.nullif(pdf_url, F.lit("")), entry_url)


def fetched(spark: SparkSession, path: str) -> DataFrame:
    """file, size, content of landed documents, as binary files; empty ones were never fetched."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), "content")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """category, terms of landed JSON files that map each category to its list of terms."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("category", "terms"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of landed ``.txt`` files, one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
