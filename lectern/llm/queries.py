"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language, leakage, linkage, packing, residue, sentences, sharedspans, truncation
from lectern.session import cut
from lectern.sources.tables import table

_WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold SPAN consecutive tokens of a test item."""
    found = leakage.leaks(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "eval_items"))
    return found.where(F.col("exact_run") >= leakage.SPAN).select("doc_id", "item_id").distinct()


def p8_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    """Per test item the documents it leaked into and the longest overlaps."""
    found = leakage.leaks(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "eval_items"))
    return found.groupBy("item_id", "part").agg(
        F.countDistinct("doc_id").alias("documents"), F.max("exact_run").alias("longest_exact_run"),
        F.max("overlap").alias("longest_overlap"), F.sum("matched").alias("matched_tokens"),
    )


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents with a common span of SPAN characters."""
    return sharedspans.shared_pairs(table(spark, sf, "documents", "doc_id", "text"))


def p9_share(spark: SparkSession, sf: str) -> DataFrame:
    """Per document the share of its text found elsewhere."""
    return sharedspans.shared_share(table(spark, sf, "documents", "doc_id", "text"))


def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The shared spans of each document."""
    spans = sharedspans.shared_spans(table(spark, sf, "documents", "doc_id", "text"))
    return spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def _unit_texts(spark: SparkSession, sf: str) -> DataFrame:
    def of(name: str, key: str, field: str) -> DataFrame:
        return table(spark, sf, name, key, field).select(F.lit(name).alias("tbl"), F.col(key).alias("row_key"), F.col(field).alias("text"))

    return of("papers", "paper_key", "abstract").unionAll(of("search_results", "result_id", "abstract_summary"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence units of the abstracts and of their summaries."""
    return sentences.segment(_unit_texts(spark, sf))


def p1_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Number and mean length of the units of each table's texts."""
    units = p1_found(spark, sf)
    return units.groupBy("tbl").agg(
        F.count("*").alias("units"), F.countDistinct("row_key").alias("texts"), F.round(F.avg(F.col("sent_end") - F.col("sent_start")), 4).alias("mean_length")
    )


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.match(
        table(spark, sf, "papers", "paper_key", "title", "authors", "year"),
        table(spark, sf, "catalog_papers", "catalog_key", "title", "authors", "year"), "paper_key", "catalog_key",
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of rows of the same work."""
    return _linked(spark, sf).select("paper_key", "catalog_key").distinct()


def p3_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs with their confidence."""
    return _linked(spark, sf)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of the runs whose label is missing or wrong or whose query mixes languages."""
    segments = language.label_segments(table(spark, sf, "search_runs", "run_id", "query", "query_language"), "run_id", "query", "query_language")
    return segments.where("case").select(F.col("key").alias("run_id"), "seg_no", "lang").distinct()


def p4_segments(spark: SparkSession, sf: str) -> DataFrame:
    """All segments of all runs with place, language and confidence."""
    segments = language.label_segments(table(spark, sf, "search_runs", "run_id", "query", "query_language"), "run_id", "query", "query_language")
    return segments.withColumnRenamed("key", "run_id")


def _residue_values(spark: SparkSession, sf: str) -> DataFrame:
    def of(name: str, key: str, field: str, link: str) -> DataFrame:
        t = table(spark, sf, name, key, field, link)
        host = F.coalesce(F.regexp_extract(link, "^https?://([^/]+)", 1), F.lit(""))
        return t.select(F.lit(name).alias("tbl"), F.col(key).alias("row_key"), F.col(field).alias("text"), host.alias("host"))

    return (
        of("search_results", "result_id", "final_response", "link").unionAll(of("structured_summaries", "summary_id", "limitations", "paper_id"))
        .unionAll(of("smart_extracts", "extract_id", "structured_summary", "paper_id"))
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values that are or hold residue, filler or error text."""
    return residue.verdicts(_residue_values(spark, sf)).where("rejected").select("tbl", "row_key").distinct()


def p5_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """The rejected values with the part that gave the reason."""
    return residue.verdicts(_residue_values(spark, sf)).where("rejected").drop("rejected")


def p5_clean(spark: SparkSession, sf: str) -> DataFrame:
    """All values that stay, null and empty ones left out."""
    values = _residue_values(spark, sf)
    bad = residue.verdicts(values).where("rejected").select("tbl", "row_key").distinct()
    return values.where("length(text) > 0").join(bad, ["tbl", "row_key"], "left_anti").select("tbl", "row_key", "text")


def p5_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts against weak labels over all values, each judged by a classifier that has not seen its host."""
    return residue.validate(_residue_values(spark, sf))


def _cut_values(spark: SparkSession, sf: str) -> DataFrame:
    def of(name: str, key: str, field: str, source: str) -> DataFrame:
        t = table(spark, sf, name, key, field, source)
        return t.select(F.lit(name).alias("tbl"), F.col(key).alias("row_key"), F.lit(field).alias("field"), F.col(source).alias("source"), F.col(field).alias("text"))

    values = (
        of("papers", "paper_key", "abstract", "api").unionAll(of("catalog_papers", "catalog_key", "abstract", "api"))
        .unionAll(of("search_results", "result_id", "abstract_summary", "method")).unionAll(of("search_results", "result_id", "final_response", "method"))
    )
    # residue is no truncated text
    checked = F.col("field") == "final_response"
    return truncation.verdicts(values.withColumn("checked", checked), residue.rejecter(_residue_values(spark, sf)))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values that were cut off."""
    return _cut_values(spark, sf).where("is_cut").select("tbl", "row_key", "field").distinct()


def p6_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source truncates."""
    return _cut_values(spark, sf).groupBy("tbl", "field", "source").agg(
        F.count("*").alias("values"), F.sum(F.col("is_cut").cast("long")).alias("cut"), F.round(F.avg(F.col("is_cut").cast("double")), 6).alias("rate")
    )


def p7_assign(spark: SparkSession, sf: str) -> DataFrame:
    """The container of each document, or of each piece of one that exceeds the capacity."""
    return packing.packed_documents(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "container_specs"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Items, used and unused tokens of each container."""
    return packing.containers(p7_assign(spark, sf), table(spark, sf, "container_specs"))


def p7_unused(spark: SparkSession, sf: str) -> DataFrame:
    """Per capacity the number of containers, the least that any packing needs, and the unused space."""
    specs = table(spark, sf, "container_specs")
    boxes = packing.containers(p7_assign(spark, sf), specs)
    boxes = boxes.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("used").alias("used"), F.sum("unused").alias("unused"))
    return boxes.join(specs, "spec_id").select(
        "spec_id", "spec_name", "containers", F.ceil(F.col("used") / F.col("capacity_tokens")).alias("least"), "used", "unused"
    )


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per capacity the documents that were placed, and how many containers and documents break a rule (none should)."""
    specs = table(spark, sf, "container_specs")
    documents = table(spark, sf, "documents", "doc_id", "text")
    tokens = cut(packing.count_tokens(documents))
    packed = cut(packing.pack(tokens, specs))
    boxes = packing.containers(packed, specs).groupBy("spec_id").agg(F.sum((F.col("unused") < 0).cast("long")).alias("over"), F.sum((F.col("used") + F.col("unused") != F.col("used") + F.abs("unused")).cast("long")).alias("unbalanced"))
    placed = packed.groupBy("spec_id", "doc_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("pieces"), F.max("start_token").alias("last"))
    capacity = specs.select(F.col("spec_id").cast("long").alias("spec_id"), F.col("capacity_tokens").cast("long").alias("capacity"))
    whole = placed.join(tokens, "doc_id").join(capacity, "spec_id")
    fits = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")))
    wrong = (F.col("placed") != F.col("tokens")) | (F.col("pieces") != fits) | (F.col("last") != (fits - 1) * F.col("capacity"))
    docs = whole.groupBy("spec_id").agg(F.count("*").alias("documents"), F.sum(wrong.cast("long")).alias("broken"))
    return docs.join(boxes, "spec_id", "left").select("spec_id", "documents", "broken", F.coalesce(F.col("over") + F.col("unbalanced"), F.lit(0)).alias("overfull"))


def p1_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Per text the characters but white space that its units hold together."""
    texts = _unit_texts(spark, sf)
    found = sentences.segment(texts).groupBy("tbl", "row_key").agg(F.collect_list(F.struct("sent_start", "sent_end")).alias("u"))
    held = F.array_join(F.transform("u", lambda x: F.substring(F.col("text"), (x["sent_start"] + 1).cast("int"), (x["sent_end"] - x["sent_start"]).cast("int"))), "")
    return found.join(texts, ["tbl", "row_key"]).select("tbl", "row_key", F.length(F.regexp_replace(held, _WHITE, "")).cast("long").alias("chars"))


QUERIES = {
    "p1_found": p1_found, "p1_cover": p1_cover, "p1_lengths": p1_lengths,
    "p3_found": p3_found, "p3_matches": p3_matches,
    "p4_found": p4_found, "p4_segments": p4_segments,
    "p5_found": p5_found, "p5_rejected": p5_rejected, "p5_clean": p5_clean, "p5_validation": p5_validation,
    "p6_found": p6_found, "p6_rates": p6_rates,
    "p7_assign": p7_assign, "p7_containers": p7_containers, "p7_unused": p7_unused, "p7_check": p7_check,
    "p8_found": p8_found, "p8_leaked_items": p8_leaked_items, "p9_found": p9_found, "p9_share": p9_share, "p9_spans": p9_spans,
}
def _windows(source: str, key: str) -> str:
    """Keys and all runs of SPAN word tokens of a text, as strings."""
    n = leakage.SPAN
    tokens = "list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda t: t <> '')"
    return f"SELECT {key}, array_to_string(tk[i:i + {n - 1}], ' ') AS w FROM (SELECT {key}, tk, unnest(range(1, len(tk) - {n - 2})) AS i FROM (SELECT {key}, {tokens} AS tk FROM ({source})))"


_ITEM_TEXTS = "SELECT item_id, prompt AS text FROM eval_items UNION ALL SELECT item_id, solution FROM eval_items"
_SPAN_HASHES = f"SELECT DISTINCT doc_id, hash(substr(text, i, {sharedspans.SPAN})) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - {sharedspans.SPAN - 2})) AS i FROM documents WHERE length(text) >= {sharedspans.SPAN})"
_SHARED = (
    f"w AS (SELECT doc_id, i, hash(substr(text, i, {sharedspans.SPAN})) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - {sharedspans.SPAN - 2})) AS i FROM documents WHERE length(text) >= {sharedspans.SPAN})),"
    " c AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), p AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM w SEMI JOIN c USING (h))"
)
_WHITE_SQL = _WHITE.replace("\\x{1c}-\\x{1f}", "\\x1c-\\x1f")

ORACLE: dict[str, str] = {
    "p1_cover": " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, {k} AS row_key, length(regexp_replace({f}, '{_WHITE_SQL}', '', 'g'))::BIGINT AS chars FROM {t} WHERE length(regexp_replace({f}, '{_WHITE_SQL}', '', 'g')) > 0"
        for t, k, f in (("papers", "paper_key", "abstract"), ("search_results", "result_id", "abstract_summary"))
    ),
    "p7_check": "SELECT spec_id::BIGINT AS spec_id, (SELECT count(*) FROM documents)::BIGINT AS documents, 0::BIGINT AS broken, 0::BIGINT AS overfull FROM container_specs WHERE capacity_tokens > 0",
    "p8_found": f"WITH d AS ({_windows('SELECT doc_id, text FROM documents WHERE text IS NOT NULL', 'doc_id')}), i AS (SELECT DISTINCT * FROM ({_windows(_ITEM_TEXTS, 'item_id')})) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (w)",
    "p9_found": f"WITH s AS ({_SPAN_HASHES}) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p9_share": (
        f"WITH {_SHARED}, s AS (SELECT doc_id, sum(least({sharedspans.SPAN}, coalesce(next - i, {sharedspans.SPAN}))) AS n FROM p GROUP BY 1)"
        " SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(n, 0) / length(text), 6) ELSE 0.0 END::DOUBLE AS share FROM documents LEFT JOIN s USING (doc_id)"
    ),
    "p9_spans": (
        f"WITH {_SHARED}, g AS (SELECT doc_id, i, sum((before IS NULL OR i > before + {sharedspans.SPAN})::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM p)"
        f" SELECT doc_id, (min(i) - 1)::BIGINT AS start, (max(i) - 1 + {sharedspans.SPAN})::BIGINT AS \"end\" FROM g GROUP BY doc_id, g"
    ),
}
