"""Structured analysis of a document: sections, findings per facet, type, domain, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions.arrow import lsa_summarize_each
from lectern.functions import text as T
from lectern.operators import respond

#: Shortest text that is analyzed, in characters.
LEAST = 500
_BOUNDARY = "array<struct<start_idx:int,section_type:string,confidence:double,header_text:string>>"


def header_type(line: Column, headers: dict[str, list[str]] = vocab.SECTION_HEADERS) -> Column:
    """The first section type with a matching header pattern, null for no header."""
    s = F.trim(line)
    ok = (s != "") & (F.length(s) <= 100)
    out = None
    for kind, patterns in headers.items():
        hit = s.rlike("|".join(p.replace("(?i)", "(?iu)") for p in patterns))
        out = F.when(ok & hit, kind) if out is None else out.when(ok & hit, kind)
    return out


def header_confidence(line: Column) -> Column:
    """0.7, plus 0.2 with a digit, plus 0.1 up to three words, minus 0.1 with an ambiguous word; at most 1."""
    s = F.trim(line)
    low = F.lower(s)
    c = F.lit(0.7) + F.when(s.rlike(r"\d"), 0.2).otherwise(0.0) + F.when(F.size(T.words(s)) <= 3, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), c - F.when(F.contains(low, F.lit("analysis")) | F.contains(low, F.lit("summary")), 0.1).otherwise(0.0))


def headers(text: Column) -> Column:
    """ARRAY<STRUCT<start_idx, section_type, confidence, header_text>> of all header lines in order."""
    found = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.cast("int").alias("start_idx"), header_type(line).alias("section_type"), header_confidence(line).alias("confidence"), F.trim(line).alias("header_text")))
    return F.filter(found, lambda x: x["section_type"].isNotNull()).cast(_BOUNDARY)


def resolved(found: Column, apart: int = 10) -> Column:
    """Headers that stay: one within ``apart`` lines of the last kept one replaces it only with higher confidence."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        near = x["start_idx"] - last["start_idx"] < apart
        swapped = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))
        return (
            F.when(F.size(acc) == 0, F.array(x)).when(near & (x["confidence"] > last["confidence"]), swapped).when(near, acc).otherwise(F.concat(acc, F.array(x)))
        ).cast(_BOUNDARY)

    return F.aggregate(found, F.array().cast(_BOUNDARY), step)


def spans(text: Column, kept: Column | None = None) -> Column:
    """ARRAY<STRUCT<section_type, start_idx, end_idx>>: the header spans, or five by position if there are under three."""
    lines = F.size(F.split(text, "\n"))
    kind = "array<struct<section_type:string,start_idx:int,end_idx:int>>"
    by_position = F.array(*[F.struct(F.lit(t).alias("section_type"), F.floor(lines * a).cast("int").alias("start_idx"), F.floor(lines * b).cast("int").alias("end_idx")) for t, a, b in vocab.POSITIONS])

    def of(kept: Column) -> Column:
        ends = F.concat(F.transform(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), lambda x: x["start_idx"]), F.array(lines))
        by_header = F.zip_with(kept, ends, lambda b, e: F.struct(b["section_type"].alias("section_type"), b["start_idx"].alias("start_idx"), e.alias("end_idx")))
        return F.when(F.size(kept) >= 3, by_header.cast(kind)).otherwise(by_position.cast(kind))

    return of(kept) if kept is not None else T.let(resolved(headers(text)), of)


def section_rows(text: Column, of: Column | None = None) -> Column:
    """ARRAY<STRUCT<section_type, start_idx, content>>: spans without their first line and blank lines, over 50 characters."""
    lines = F.split(text, "\n")

    def content(s: Column) -> Column:
        part = F.slice(lines, s["start_idx"] + 2, F.greatest(s["end_idx"] - s["start_idx"] - 1, F.lit(0)))
        return F.array_join(F.filter(F.transform(part, lambda x: F.trim(x)), lambda x: x != ""), "\n")

    rows = F.transform(spans(text) if of is None else of, lambda s: F.struct(s["section_type"].alias("section_type"), s["start_idx"].alias("start_idx"), content(s).alias("content")))
    return F.filter(rows, lambda r: F.length(r["content"]) > 50)


def equal_sections(text: Column) -> Column:
    """Five equal chunks of lines under the position types."""
    lines = F.split(text, "\n")
    each = F.floor(F.size(lines) / 5).cast("int")
    out = []
    for i, (kind, _, _) in enumerate(vocab.POSITIONS):
        n = each if i < 4 else F.size(lines) - each * 4
        part = F.filter(F.transform(F.slice(lines, each * i + 1, F.greatest(n, F.lit(0))), lambda x: F.trim(x)), lambda x: x != "")
        out.append(F.struct(F.lit(kind).alias("section_type"), (each * i).alias("start_idx"), F.array_join(part, "\n").alias("content")))
    return F.array(*out)


def abstract_section(text: Column) -> Column:
    """The lines between an abstract header and the introduction or keywords, within the first 100; null under three lines.

    Collection also ends when more than 30 lines are gathered.
    """
    state = F.struct(F.lit(0).alias("on"), F.array().cast("array<string>").alias("got"))

    def step(s: Column, line: Column) -> Column:
        t = F.trim(line)
        begin = (s["on"] == 0) & t.rlike(r"(?iu)^(?:abstract|summary|résumé)\s*:?$")
        end = (s["on"] == 1) & (t.rlike(r"(?i)^(?:\d+\.?\s*)?(?:introduction|keywords?)\b") | (F.size(s["got"]) > 30))
        on = F.when(begin, 1).when(end, 2).otherwise(s["on"])
        got = F.when((s["on"] == 1) & ~end & (t != ""), F.concat(s["got"], F.array(t))).otherwise(s["got"])
        return F.struct(on.alias("on"), got.alias("got"))

    got = F.aggregate(F.slice(F.split(text, "\n"), 1, 100), state, step)["got"]
    return F.when(F.size(got) >= 3, F.array_join(got, " "))


def sections(text: Column, rows: Column | None = None, abstract: Column | None = None) -> Column:
    """MAP<section_type, content>: the last section of a type wins; equal chunks if under three; the abstract overrides."""
    kind = "array<struct<key:string,value:string>>"

    def put(acc: Column, x: Column) -> Column:
        return F.concat(F.filter(acc, lambda y: y["key"] != x["key"]), F.array(x)).cast(kind)

    def of(rows: Column) -> Column:
        enough = F.size(F.array_distinct(F.transform(rows, lambda r: r["section_type"]))) >= 3
        used = F.when(enough, rows).otherwise(F.filter(equal_sections(text), lambda r: F.length(r["content"]) > 50))
        pairs = F.transform(used, lambda r: F.struct(r["section_type"].alias("key"), r["content"].alias("value"))).cast(kind)
        first = F.array(abstract_section(text) if abstract is None else abstract)
        extra = F.transform(F.filter(first, lambda a: a.isNotNull()), lambda a: F.struct(F.lit("abstract").alias("key"), a.alias("value"))).cast(kind)
        return F.map_from_entries(F.aggregate(F.concat(pairs, extra), F.array().cast(kind), put))

    return of(rows) if rows is not None else T.let(section_rows(text), of)


def candidates(content: Column, section: str, weight: float, patterns: list[str], sentences: Column | None = None) -> Column:
    """ARRAY<STRUCT<score, section, text>>: sentences of 25 to 300 characters that match a pattern.

    0.7 of the section's weight, 0.2 by earliness, 0.1 by length up to 150 characters.
    """
    points = lambda s: F.transform(
        s, lambda x, i: F.struct((0.7 * F.lit(weight) + 0.2 * (F.size(s) - i) / F.size(s) + 0.1 * F.least(F.lit(1.0), F.length(x) / 150)).alias("score"), F.lit(section).alias("section"), x.alias("text"))
    )
    scored = T.let(T.split_d(content), points) if sentences is None else points(sentences)

    def hit(x: Column) -> Column:
        return F.length(x["text"]).between(25, 300) & x["text"].rlike("|".join(patterns))

    return F.coalesce(F.filter(scored, hit), F.array().cast("array<struct<score:double,section:string,text:string>>"))


def rescored(found: Column, keywords: list[str]) -> Column:
    """0.05 more per keyword, 0.8 of it for repetitive sentences; best first, earlier first on ties."""

    def again(x: Column, i: Column) -> Column:
        w = T.words(F.lower(x["text"]))
        score = x["score"] + 0.05 * T.contains_count(F.lower(x["text"]), keywords)
        score = F.when(F.size(F.array_distinct(w)) < F.size(w) * 0.7, score * 0.8).otherwise(score)
        return F.struct((-F.round(score, 9)).alias("k"), i.alias("i"), x["section"].alias("section"), x["text"].alias("text"))

    return F.transform(F.array_sort(F.transform(found, again)), lambda x: F.struct((-x["k"]).alias("score"), x["section"].alias("section"), x["text"].alias("text")))


def diverse(found: Column, most: int) -> Column:
    """Greedy choice: no sentence over 0.6 Jaccard of a chosen one, one per section unless 1.2 times better than the last."""
    kind = "array<struct<score:double,section:string,text:string>>"

    def step(acc: Column, x: Column) -> Column:
        w = T.words(F.lower(x["text"]))
        close = F.exists(acc, lambda y: T.jaccard(w, T.words(F.lower(y["text"]))) > 0.6)
        last = F.try_element_at(acc, F.lit(-1))
        same = F.exists(acc, lambda y: y["section"] == x["section"]) & (x["score"] < 1.2 * last["score"])
        return F.when((F.size(acc) >= most) | close | same, acc).otherwise(F.concat(acc, F.array(x))).cast(kind)

    return F.aggregate(found.cast(kind), F.array().cast(kind), step)


def facet(of: Column, name: str, sentences: Column | None = None, fixed: bool = True) -> Column:
    """The findings of a facet in a MAP of sections, or its fixed sentence (null unless ``fixed``).

    ``sentences`` may give the MAP of the sections' sentences if it is known.
    """
    weights, most, keywords, default = vocab.FACETS[name]
    default = default if fixed else None
    least = 100 if name == "methodology" else 1
    found = F.concat(
        *[
            F.when(F.length(F.coalesce(F.try_element_at(of, F.lit(s)), F.lit(""))) >= least, candidates(F.try_element_at(of, F.lit(s)), s, w, vocab.FACET_PATTERNS[name], None if sentences is None else F.try_element_at(sentences, F.lit(s))))
            .otherwise(F.array().cast("array<struct<score:double,section:string,text:string>>"))
            for s, w in weights
            if sentences is None or s != "other"  # never detected
        ]
    )
    text = lambda c: F.when(F.size(c) > 0, F.concat(F.array_join(F.transform(c, lambda x: x["text"]), ". "), F.lit("."))).otherwise(default)
    return T.let(diverse(rescored(found, keywords), most), text)


def _argmax(text: Column, tables: dict[str, list[str]], points: float) -> Column:
    """STRUCT<label, confidence>: most pattern matches per 100 words, the label named first on ties; unknown if blank."""
    per = F.greatest(F.lit(1.0), F.size(T.words(text)) / 100)
    scores = {k: F.round(T.pattern_count(text, p) * points / per, 9) for k, p in tables.items()}
    top = F.greatest(*scores.values())
    label = None
    for k, s in scores.items():
        label = F.when(s == top, k) if label is None else label.when(s == top, k)
    blank = F.trim(text) == ""
    return F.struct(F.when(blank, "unknown").otherwise(label).alias("label"), F.when(blank, F.lit(0.0)).otherwise(F.least(F.lit(1.0), top)).alias("confidence"))


def paper_type(text: Column, types: dict[str, list[str]] = vocab.PAPER_TYPES) -> Column:
    return _argmax(text, types, 0.1)


def domain(text: Column, domains: dict[str, list[str]] = vocab.DOMAINS) -> Column:
    return _argmax(text, domains, 0.15)


def adaptive_config(kind: Column, field: Column) -> Column:
    """STRUCT of the extraction limits and focus sections that fit a paper type and a domain (reported only)."""
    none = F.array().cast("array<string>")

    def arr(*names: str) -> Column:
        return F.array(*[F.lit(n) for n in names])

    focus = F.concat(
        arr("abstract", "introduction", "conclusion"),
        F.when(kind == "theoretical", arr("methodology")).when(kind == "empirical", arr("results", "methodology")).when(kind == "survey", arr("related_work", "discussion")).otherwise(none),
        F.when(field == "machine_learning", arr("methodology", "results")).when(field == "theory", arr("methodology")).otherwise(none),
    )
    return F.struct(
        F.when(kind == "theoretical", 2).when(kind == "survey", 4).otherwise(3).alias("max_contributions"),
        F.when((kind == "theoretical") | (field == "theory"), 5).otherwise(4).alias("max_methodology"),
        F.when(kind == "empirical", 5).when(kind == "survey", 2).otherwise(4).alias("max_results"),
        F.lit(3).alias("max_limitations"), F.lit(3).alias("max_future_work"), focus.alias("focus_sections"),
    )


def quality(content: Column, name: str) -> Column:
    """Quality of a facet's text: 0.3 length, 0.4 indicator patterns, 0.3 relevance; 0.1 for its default sentence or none.

    The default sentences of contributions and future work are scored like text: their
    wording differs from the one tested.
    """
    c = F.coalesce(content, F.lit(""))
    title = "_".join(w.title() for w in name.split("_"))
    defaults = [f"{title} not clearly identified in available sections.", f"{title} not explicitly discussed in available sections.", f"{title} directions not explicitly mentioned."]
    n = F.length(F.trim(c))
    length = F.when(n < 30, n / 30).when(n > 1000, F.greatest(F.lit(0.5), 1 - (n - 1000) / 1000)).otherwise(1.0)
    found = F.least(F.lit(1.0), T.pattern_count(c, vocab.QUALITY_PATTERNS[name]) / F.greatest(F.lit(1.0), F.size(T.words(c)) / 20))
    keywords = vocab.QUALITY_KEYWORDS[name]
    parts = F.split(c, r"\.")
    long = F.size(F.filter(parts, lambda s: F.length(F.trim(s)) > 10))
    relevance = F.least(F.lit(1.0), T.contains_count(F.lower(c), keywords) / len(keywords) + F.least(F.lit(0.3), long / F.size(parts)))
    score = F.least(F.lit(1.0), 0.3 * length + 0.4 * found + 0.3 * relevance)
    return F.round(F.when((c == "") | F.trim(c).isin(*defaults), 0.1).otherwise(score), 6)


def level(overall: Column) -> Column:
    return F.when(overall >= 0.8, "excellent").when(overall >= 0.6, "good").when(overall >= 0.4, "fair").otherwise("poor")


def recommendations(overall: Column, scores: dict[str, Column]) -> Column:
    """ARRAY<STRING> of what to improve: overall, per facet, and the critical facets that are missing."""
    out = [
        F.when(overall < 0.4, vocab.RECOMMEND_POOR).when(overall < 0.6, vocab.RECOMMEND_FAIR)
    ]
    for name, s in scores.items():
        out.append(F.when(s < 0.3, vocab.RECOMMEND_MUCH.format(name)).when(s < 0.5, vocab.RECOMMEND_SOME.format(name)))
    missing = F.array_join(F.array_compact(F.array(*[F.when(scores[n] < 0.2, n) for n in ("contributions", "methodology", "results")])), ", ")
    out.append(F.when(missing != "", F.concat(F.lit(vocab.RECOMMEND_MISSING), missing)))
    return F.array_compact(F.array(*out))


def short_overview(contributions: Column, methodology: Column, results: Column) -> Column:
    """The parts before the first stop of three facets, each closed by a stop; empty ones are skipped."""
    first = [F.when(c != "", F.concat(F.substring_index(c, ".", 1), F.lit("."))) for c in (contributions, methodology, results)]
    return F.concat_ws(" ", *first)


def analyze(documents: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """Structured summary, type, domain and quality of every document, one narrow plan without a shuffle.

    A facet without findings falls back to a latent-semantic summary of its sections, then to
    its fixed sentence.  A document that can't be read (status ``too_short``) has only nulls.

    Texts that are null or under LEAST characters get status ``too_short`` and nulls.
    Texts are analyzed whole unless ``most`` cuts the cleaned ones to so many characters.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    clean = T.clean_scientific(raw)
    d = documents.select(key, (F.length(raw) >= LEAST).alias("ok"), (clean if most is None else F.substring(clean, 1, most)).alias("body"))
    # one step each, so that every list is computed once
    d = d.withColumn("kept", F.when(F.col("ok"), resolved(headers(F.col("body")))))
    d = d.withColumn("rows", F.when(F.col("ok"), section_rows(F.col("body"), spans(F.col("body"), F.col("kept")))))
    d = d.withColumn("abstract", F.when(F.col("ok"), abstract_section(F.col("body"))))
    d = d.withColumn("sections", F.when(F.col("ok"), sections(F.col("body"), F.col("rows"), F.col("abstract"))))
    d = d.withColumn("sentences", F.transform_values("sections", lambda k, v: T.split_d(v)))
    part = lambda s: F.coalesce(F.try_element_at(F.col("sections"), F.lit(s)), F.lit(""))
    d = d.withColumns({name: F.when(F.col("ok"), facet(F.col("sections"), name, F.col("sentences"), fixed=False)) for name in vocab.FACETS})
    # without findings the latent-semantic summary of two sections stands in; one call of Python for all
    spare = {n: F.trim(F.concat_ws(" ", *[F.nullif(part(s), F.lit("")) for s in names])) for n, names in vocab.FACET_FALLBACK.items()}
    asked = [F.when(F.col("ok") & F.col(n).isNull() & (F.length(t) > 100), t).alias(n) for n, t in spare.items()]
    d = d.withColumn("spare", lsa_summarize_each(3)(F.array(*asked)))
    for i, n in enumerate(spare):
        d = d.withColumn(n, F.coalesce(F.col(n), F.when(F.length(F.get("spare", F.lit(i))) > 50, F.get("spare", F.lit(i)))))
    d = d.withColumns({n: F.when(F.col("ok"), F.coalesce(F.col(n), F.lit(vocab.FACETS[n][3]))) for n in vocab.FACETS})
    d = d.withColumn("type", paper_type(F.concat_ws(" ", part("abstract"), part("introduction"), part("methodology"))))
    d = d.withColumn("field", domain(F.concat_ws(" ", part("abstract"), part("introduction"))))
    scores = {n: quality(F.col(n), n) for n in vocab.FACETS}
    d = d.withColumns({f"q_{n}": scores[n] for n in vocab.FACETS})
    overall = F.round(sum((F.col(f"q_{n}") for n in vocab.FACETS), F.lit(0.0)) / len(vocab.FACETS), 6)
    d = d.withColumn("overall", overall)
    only = lambda c: F.when(F.col("ok"), c)
    return d.select(
        key, F.when(F.col("ok"), "ok").otherwise("too_short").alias("status"), *vocab.FACETS,
        only(short_overview(F.col("contributions"), F.col("methodology"), F.col("results"))).alias("short_overview"),
        only(F.col("type.label")).alias("paper_type"), only(F.round("type.confidence", 6)).alias("type_confidence"), only(F.col("field.label")).alias("domain"), only(F.round("field.confidence", 6)).alias("domain_confidence"),
        only(F.col("overall")).alias("overall_score"), only(level(F.col("overall"))).alias("quality_level"),
        only(F.create_map(*[x for n in vocab.FACETS for x in (F.lit(n), F.col(f"q_{n}"))])).alias("section_scores"),
        only(recommendations(F.col("overall"), {n: F.col(f"q_{n}") for n in vocab.FACETS})).alias("recommendations"),
        only(respond.rewritten(F.lit(""), F.array().cast("array<string>"), F.lit(None).cast("int"), {n: F.col(n) for n in vocab.FACETS})).alias("abstractive_summary"),
        only(F.map_keys("sections")).alias("sections_detected"), only(adaptive_config(F.col("type.label"), F.col("field.label"))).alias("adaptive_config"),
    )
