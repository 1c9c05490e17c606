"""Matching records of the same work across sources that share no key.

1. Rows become nodes: rows of one side with equal title, authors and year are one.
2. Nodes get keys from their attributes (the title, pairs of runs of title words, author
   with run, pairs of authors).  A node with authors is indexed under its rarest keys of
   each family only; by the prefix argument two nodes that share more than 1 - PREFIX of a
   family's keys still meet.  Pairs of such nodes that share fewer of both families are no
   candidates, and no other way finds them.  Keys are split by year.
3. The candidate graph weighs an edge by the rarity of what it shares; meta-blocking
   keeps the edges of at least PRUNE times the best weight of one of their ends.
4. Edges are compared in title, authors, year and part number.
5. Neighbour similarity is propagated until stable: the neighbours of a node are the
   nodes of its own side that compare well with it in known authors too, and an edge
   without a contradiction takes over part of the score that its catalogue node has with
   a neighbour of its paper (and the other way round).

Nulls: a null title or an empty one gives no node; null authors and years are unknown
and neither support nor contradict.  Repeated rows are pairs of their own.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut

#: Share of its title keys and of its author keys, from the rarest on, that a node is indexed under.
PREFIX = {"title_keys": 0.6, "author_keys": 0.6}
#: Farthest that the second run of a pair begins behind the end of the first, so that a title's keys are proportional to its length.
APART = 8
#: An edge stays if it has this share of the best weight at one of its ends.
PRUNE = 0.4
#: Share of a neighbour's score that is taken over, and score of a match.  What is under MATCH / PASS_ON passes no match on.
PASS_ON, MATCH = 0.8, 0.5

_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8}
_PART = re.compile(r"[,:;(\s]+(?:part|teil|partie|parte|часть|vol|no)\.?\s+([ivx]+|\d+)\)?\s*\.?\s*$", re.I)
_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]+|[^぀-ヿ㐀-鿿가-힯]+")


def fold(text: str) -> str:
    """Lower case without accents (marks of scripts that need them stay)."""
    out = []
    for ch in unicodedata.normalize("NFKD", text.lower()):
        if not "̀" <= ch <= "ͯ":
            out.append(ch)
    return unicodedata.normalize("NFC", "".join(out)).replace("ß", "ss").replace("ø", "o").replace("ł", "l")


def title_of(raw: str) -> tuple[str, list[str], int]:
    """(compact title, words, part): part is 0 for none, -1 if a cut title may have lost it."""
    text = html.unescape(re.sub(r"<[^>]*>", "", raw)).strip()
    cut_off = bool(re.search(r"(\.\.\.|…)\s*$", text))
    part = -1 if cut_off else 0
    if m := _PART.search(text):
        word = m.group(1).lower()
        part = int(word) if word.isdigit() else _ROMAN.get(word, 0)
        text = text[: m.start()]
    words = []
    for w in _WORD.findall(fold(text)):
        words += _CJK.findall(w)
    return "".join(words), words, part


def author_of(raw: str) -> str | None:
    """``surname|initial`` of a name in any usual order; None where it names nobody."""
    text = fold(raw).strip(" .;")
    if not text or text in ("unknown", "et al", "al", "n/a", "anonymous", "none"):
        return None
    if "," in text:
        last, _, first = text.partition(",")
        first = first.strip(" .")
        if not first or len(last.split()) > 2:
            words = text.replace(",", " ").split()
            last, first = words[0], " ".join(words[1:])
    else:
        words = text.split()
        if len(words) > 1 and len(words[-1].strip(".")) <= 2:
            last, first = " ".join(words[:-1]), words[-1]
        else:
            last, first = words[-1], " ".join(words[:-1])
    last = re.sub(r"[^\w]", "", last)
    return f"{last}|{first.strip(' .')[:1]}" if last else None


def keys_of(title: str, words: list[str], authors: list[str]) -> tuple[list[int], list[int]]:
    """Hashed attribute keys of a node, of its title and of its authors.

    A single word is frequent in a large catalogue, so most keys join pieces of evidence:
    runs of three words, two such runs apart from each other, an author with a word, two
    authors.  Titles of up to three words have their words.
    """
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    names = sorted({a.partition("|")[0] for a in authors})
    of_title = {f"f:{title}"} | {f"t:{r}" for r in runs}
    of_title |= {f"p:{runs[i]}|{runs[j]}" for i in range(len(runs)) for j in range(i + 3, min(i + 3 + APART, len(runs)))}
    if len(words) <= 3:
        of_title |= {f"w:{w}" for w in words}
    of_authors = {f"a:{n}|{w}" for n in names for w in words if len(w) > 2 or len(words) <= 3} | {f"n:{a}|{b}" for a, b in zip(names, names[1:])}
    return tuple(sorted(xxhash.xxh64_intdigest(k) - (1 << 63) for k in ks) for ks in (of_title, of_authors))


_NODE = pa.schema([("key", pa.int64()), ("title", pa.string()), ("part", pa.int32()), ("authors", pa.list_(pa.string())), ("year", pa.int32()), ("title_keys", pa.list_(pa.int64())), ("author_keys", pa.list_(pa.int64()))])


def _normalize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, title, authors, year in zip(*(c.to_pylist() for c in batch.columns)):
            if not title or not title.strip():
                continue
            compact, words, part = title_of(title)
            if compact:
                names = sorted({a for a in (author_of(x) for x in authors or [] if x) if a})
                rows.append((key, compact, part, names, year, *keys_of(compact, words, names)))
        columns = list(zip(*rows)) or [[] for _ in _NODE]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE)], schema=_NODE)


def nodes(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(node rows, membership) of one side: node, title, part, authors, year and keys; and node, key."""
    flat = rows.select(F.col(key).cast("long").alias("key"), "title", "authors", F.col("year").cast("int").alias("year"))
    flat = flat.mapInArrow(_normalize, "key long, title string, part int, authors array<string>, year int, title_keys array<long>, author_keys array<long>")
    flat = cut(flat.withColumn("node", F.xxhash64("title", "part", F.concat_ws(";", "authors"), F.coalesce("year", F.lit(-1)))))
    one = flat.groupBy("node").agg(*[F.first(c).alias(c) for c in ("title", "part", "authors", "year", "title_keys", "author_keys")])
    return cut(one), flat.select("node", "key")


def _trigrams(s: str) -> set[str]:
    return {s[i : i + 3] for i in range(len(s) - 2)} or {s}


def near(a: str, b: str) -> bool:
    """Whether two names are equal up to one typing error (two in long names), swaps included."""
    if a == b:
        return True
    limit = 1 if min(len(a), len(b)) < 9 else 2
    if abs(len(a) - len(b)) > limit or min(len(a), len(b)) < 4:
        return False
    before2, before = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before2[j - 2] + 1)
            row.append(d)
        if min(row) > limit:
            return False
        before2, before = before, row
    return before[-1] <= limit


def title_similarity(a: str, b: str, part_a: int, part_b: int) -> float:
    """Trigram overlap of compact titles; a cut title is compared as a beginning."""
    if a == b:
        return 1.0
    if part_a == -1 or part_b == -1:
        n = min(len(a), len(b))
        if (part_a == -1 and len(a) == n) or (part_b == -1 and len(b) == n):
            a, b = a[:n], b[:n]
            if a == b:
                return 0.95
    x, y = _trigrams(a), _trigrams(b)
    both = len(x & y)
    dice = 2 * both / (len(x) + len(y))
    inside = both / min(len(x), len(y))
    return max(dice, 0.9 * inside if min(len(a), len(b)) >= 16 and inside > 0.75 else 0.0)


def author_similarity(a: list[str], b: list[str]) -> float | None:
    """Share of the shorter list found in the other one; None if either is unknown."""
    if not a or not b:
        return None
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    hits = 0.0
    for s in small:
        name, _, first = s.partition("|")
        best = 0.0
        for t in large:
            other, _, given = t.partition("|")
            if near(name, other):
                best = max(best, 1.0 if not first or not given or first == given else 0.4)
            elif near(name + first, other + given) and min(len(name), len(other)) > 5:
                best = max(best, 0.8)
        hits += best
    return hits / len(small)


def compare(a: tuple, b: tuple) -> tuple[float, bool]:
    """(score, contradiction) of two nodes given as (title, part, authors, year)."""
    title = title_similarity(a[0], b[0], a[1], b[1])
    authors = author_similarity(a[2], b[2])
    gap = abs(a[3] - b[3]) if a[3] is not None and b[3] is not None else None
    parts = a[1] == b[1] or -1 in (a[1], b[1])
    if not parts or (gap is not None and gap > 1) or title < 0.6 or (authors is not None and authors < 0.3):
        return 0.0, True
    year = {None: 0.0, 0: 0.1, 1: 0.05}[gap]
    if authors is None:
        score = (title - 0.85) * 4 + year + 0.18 if title >= 0.85 else 0.0
    else:
        score = (title - 0.6) / 0.4 * 0.55 + 0.4 * authors + year
    return max(0.0, min(1.0, score)), False


_EDGE = pa.schema([("p", pa.int64()), ("c", pa.int64()), ("score", pa.float64()), ("locked", pa.bool_())])


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for p, c, *x in zip(*(col.to_pylist() for col in batch.columns)):
            rows.append((p, c, *compare(tuple(x[:4]), tuple(x[4:]))))
        columns = list(zip(*rows)) or [[] for _ in _EDGE]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _EDGE)], schema=_EDGE)


_GAIN = pa.schema([("p", pa.int64()), ("c", pa.int64()), ("gain", pa.float64())])


def _support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for p, c, score, passed, *x in zip(*(col.to_pylist() for col in batch.columns)):
            similar, contradiction = compare(tuple(x[:4]), tuple(x[4:]))
            gain = PASS_ON * min(passed, similar)
            if not contradiction and gain >= MATCH and gain > score + 1e-9:
                rows.append((p, c, gain))
        columns = list(zip(*rows)) or [[] for _ in _GAIN]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _GAIN)], schema=_GAIN)


def _may_share(a: str, b: str) -> Column:
    """Whether a name of both lists may be near the other; a swap is two edits here, so no pair that ``near`` takes is left out."""

    def close(x: Column, y: Column) -> Column:
        return F.levenshtein(x, y, 4).between(0, F.when(F.least(F.length(x), F.length(y)) < 9, 2).otherwise(4))

    def pair(x: Column, y: Column) -> Column:
        u, v = F.split(x, r"\|", 2), F.split(y, r"\|", 2)
        return close(u[0], v[0]) | close(F.array_join(u, ""), F.array_join(v, ""))

    return F.exists(a, lambda x: F.exists(b, lambda y: pair(x, y)))


def _gains(scored: DataFrame, fresh: DataFrame, one: DataFrame, side: str, across: str) -> DataFrame:
    """p, c, gain of the edges that a fresh edge of the same node across raises, by the similarity of the two nodes of one side.

    A node without authors is nobody's neighbour, and one with a cut title passes nothing on: they are like different works.
    """
    strong = fresh.where(F.col("score") >= MATCH / PASS_ON).select(across, F.col(side).alias("other"), F.col("score").alias("passed"))
    met = scored.join(strong, across).where((F.col(side) != F.col("other")) & (F.col("passed") * PASS_ON > F.col("score") + 1e-9))
    mine, others = (one.where(F.size("authors") > 0).select(F.col("node").alias(n), *[F.col(x).alias(f"{n}_{x}") for x in ("title", "part", "authors", "year")]) for n in (side, "other"))
    met = met.repartition(side, "other").join(mine, side).join(others.where("other_part <> -1"), "other").where(_may_share(f"{side}_authors", "other_authors"))
    met = met.select("p", "c", "score", "passed", *mine.columns[1:], *others.columns[1:])
    return met.mapInArrow(_support, "p long, c long, gain double")


def _indexed(one: DataFrame, idf: DataFrame, family: str) -> DataFrame:
    """node, k, weight, year under the rarest of a family's keys that occur on both sides; under all for a node without authors."""
    keyed = one.select("node", "year", (F.size("authors") == 0).alias("alone"), F.explode(family).alias("k")).join(idf.hint("merge"), "k")
    rank = Window.partitionBy("node").orderBy(F.desc("weight"), "k")
    keyed = keyed.withColumn("r", F.row_number().over(rank)).withColumn("n", F.count("*").over(Window.partitionBy("node")))
    share = F.when(F.col("alone"), 1.0).otherwise(PREFIX[family])
    return keyed.where(F.col("r") <= F.greatest(F.lit(2), F.ceil(F.col("n") * share))).select("node", "k", "weight", "year")


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """p, c, weight of all pairs of nodes that share a key and whose years don't contradict each other.

    Works of one title differ by at most a year, so a key is split by years: a node of the
    left meets its own year and the two beside it, and the nodes without a year; a left node
    without a year meets all.  Every pair meets once, and a key that many works share
    falls into parts.  A part that is still hot is one that the join may split.
    """
    year, any_year, none = F.col("year"), F.lit(1_000_000_000), F.lit(1_000_000_001)
    left = left.select(F.col("node").alias("p"), "k", "weight", F.explode(F.when(year.isNull(), F.array(any_year)).otherwise(F.array(year - 1, year, year + 1, none))).alias("y"))
    right = right.select(F.col("node").alias("c"), "k", F.explode(F.array(any_year, F.coalesce(year, none))).alias("y"))
    return left.join(right.hint("merge"), ["k", "y"]).select("p", "c", "weight")


def match(papers: DataFrame, catalog: DataFrame, paper_key: str, catalog_key: str) -> DataFrame:
    """Pairs (paper_key, catalog_key, confidence) of rows of the same work.

    Both inputs have their key, title, authors (array) and year.
    """
    pn, p_rows = nodes(papers, paper_key)
    cn, c_rows = nodes(catalog, catalog_key)
    total = float(pn.count() + cn.count())
    edges = None
    for family in PREFIX:
        pk = pn.select(F.explode(family).alias("k")).groupBy("k").agg(F.count("*").alias("np"))
        ck = cn.select(F.explode(family).alias("k")).groupBy("k").agg(F.count("*").alias("nc"))
        idf = cut(pk.join(ck, "k").select("k", F.log(F.lit(total) / (F.col("np") + F.col("nc")) + 1).alias("weight")))
        part = _met(_indexed(pn, idf, family), _indexed(cn, idf, family))
        edges = part if edges is None else edges.unionAll(part)
    edges = cut(edges.groupBy("p", "c").agg(F.sum("weight").alias("w")))
    best_p = edges.groupBy("p").agg(F.max("w").alias("mp"))
    best_c = edges.groupBy("c").agg(F.max("w").alias("mc"))
    edges = edges.join(best_p, "p").join(best_c, "c").where((F.col("w") >= PRUNE * F.col("mp")) | (F.col("w") >= PRUNE * F.col("mc"))).select("p", "c")
    a = pn.select(F.col("node").alias("p"), *[F.col(x).alias(f"p_{x}") for x in ("title", "part", "authors", "year")])
    b = cn.select(F.col("node").alias("c"), *[F.col(x).alias(f"c_{x}") for x in ("title", "part", "authors", "year")])
    compared = edges.join(a, "p").join(b, "c").select("p", "c", *a.columns[1:], *b.columns[1:])
    scored = compared.mapInArrow(_score, "p long, c long, score double, locked boolean").where("not locked")
    fresh = scored = cut(scored.select("p", "c", "score"))
    while True:  # ends: a score rises to PASS_ON of a fresh one at most, and only to MATCH or more
        gains = _gains(scored, fresh, pn, "p", "c").unionAll(_gains(scored, fresh, cn, "c", "p"))
        gains = cut(gains.groupBy("p", "c").agg(F.max("gain").alias("gain")))
        if gains.isEmpty():
            break
        scored = cut(scored.join(gains, ["p", "c"], "left").select("p", "c", F.coalesce("gain", "score").alias("score")))
        fresh = gains.withColumnRenamed("gain", "score")
    found = scored.where(F.col("score") >= MATCH).select("p", "c", F.round("score", 4).alias("confidence"))
    found = found.join(p_rows.select(F.col("node").alias("p"), F.col("key").alias("paper_key")), "p")
    found = found.join(c_rows.select(F.col("node").alias("c"), F.col("key").alias("catalog_key")), "c")
    return found.select("paper_key", "catalog_key", "confidence")
