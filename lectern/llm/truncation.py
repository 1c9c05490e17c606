"""Text cut off by field limits or mid-transfer.

A stack automaton checks the structure of every value: unclosed quotes, brackets and
markup, broken characters and escapes, marks of truncation.  A value that ends without
a terminator is held against the corpus: whether its last words were ever seen to end
a sentence, and whether its length is a limit at which the unfinished values of its
source pile up, or those of all sources of the field.  Word statistics are counted over all different
texts, so that copies of a cut text don't vouch for each other.

Null and empty values are no cases.  Repeated rows are cases of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut

#: From this share of sentence ends after the same words on, a bare ending counts as complete.
ENDS = 0.03
#: A length is a limit if so many times as many unfinished values have it as a length nearby.
SPIKE, SPIKE_LEAST, NEARBY = 8, 6, 10
#: Share of an ending against the longer words that go on after the same word, and of a last word's uses inside sentences
#: against its bare and dotted ends: from these on, it is a whole word and dots behind it are the author's.
OWN_DOTS, WHOLE = 0.5, 0.5
#: A last word of a label line that is used nowhere else ends at least so many different texts.
LABEL_ENDS = 3
#: Longest word that may be an abbreviation.
ABBREVIATION = 6
#: Entries of a task's counter before it is handed on.
FLUSH = 400_000

_TERMINATORS = ".!?。！？।؟…"
_CLOSERS = "\"”’»」』)]'“›"
_PAIRS = {")": "(", "]": "[", "”": "“„", "»": "«", "」": "「", "』": "『", "“": "„"}
_STRUCTURE = re.compile("[()\\[\\]“”„«»「」『』\"]")
_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*|\.\.\.|[.!?。！？।؟…]")
_INSIDE = re.compile(r"\.(?= ?[^\W_A-Z]| ?[,;:)])")
_BEFORE = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*$")
_RUN = re.compile("[぀-ヿ㐀-鿿฀-๿]")
_MARK = re.compile(r"\s*[\[(<{](?:truncated|more|cut|continued|snip|read more|\.\.\.|…)[^\])>}]{0,12}[\])>}]\s*$|\s*(?:read more|see more)\s*$", re.I)
_DOTS = re.compile(r"\s*(?:\.{3,}|…)\s*$")
_BROKEN = re.compile(r"(?:�|\\u?[0-9a-fA-F]{0,3}|&[#a-zA-Z][a-zA-Z0-9]{0,6}|<[/a-zA-Z][^<>]{0,20}|%[0-9A-F]?)$")
_URL = re.compile(r"https?://\S+/\S+$")
_LABEL = re.compile(r"^(?![A-Z]+:)[^\W\d_][\w ]{2,18}: [^\s,;]+(?: [^\s,;]+){0,2}(?:[,;] [^\s,;]+(?: [^\s,;]+){0,2})*$|^\d+ pages?\b.{0,40}$|^[-•*] .{3,}$")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")


def unclosed(text: str) -> bool:
    """Whether a bracket or quotation is still open at the end (stack automaton)."""
    stack: list[str] = []
    for ch in _STRUCTURE.findall(text):
        if ch == '"':
            if '"' in stack:
                while stack.pop() != '"':
                    pass
            else:
                stack.append('"')
        elif ch in "([“„«「『" and not (ch == "“" and stack and stack[-1] == "„"):
            stack.append(ch)
        elif ch in _PAIRS:
            opens = _PAIRS[ch]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in opens:
                    del stack[i:]
                    break
    return bool(stack)


def _fold(word: str) -> str:
    return re.sub(r"\d", "0", word.lower())


def last_words(text: str) -> tuple[str, str]:
    """The statistics key of an ending: last two words, or last characters where words aren't spaced."""
    if _RUN.match(text[-1:]):
        return text[-5:-1], text[-1]
    tokens = _TOKEN.findall(text[-120:].rstrip(_TERMINATORS))
    before = tokens[-2] if len(tokens) > 1 else ""
    return _fold(before) if before[:1].isalnum() else ".", _fold(tokens[-1]) if tokens and tokens[-1][0].isalnum() else ""


def examine(raw: str) -> tuple[str, str, str]:
    """(verdict, word, last word): verdict complete, cut, ask (the corpus), dots or stop.

    ``dots`` asks whether the dots are the author's, ``stop`` whether the final stop is
    one of an abbreviation.
    """
    text = raw.strip()
    if not text:
        return "complete", "", ""
    end = text[-60:]
    if _MARK.search(end):
        return "cut", "", ""
    if _BROKEN.search(text[-24:]) and not text.endswith("&"):
        return "cut", "", ""
    opened = text.startswith("<jats:p>") or "<jats:p>" in text[:40]
    if opened and not text.endswith(("</jats:p>", "</jats:sec>")):
        return "cut", "", ""
    if "<" in text:
        text = _TAG.sub("", text).strip()
    if not text:
        return "complete", "", ""
    dots = _DOTS.search(text[-12:])
    if dots:
        body = text[: max(0, len(text) - 12) + dots.start()]
        return ("dots", *last_words(body)) if body and body[-1].isalnum() or _RUN.match(body[-1:]) else ("cut", "", "")
    if unclosed(text):
        return "cut", "", ""
    body = text.rstrip(_CLOSERS + " ")
    closed = len(body) < len(text)
    if body and body[-1] in _TERMINATORS:
        if closed or body[-1] != ".":
            return "complete", "", ""
        before, word = last_words(body)
        return ("stop", before, word) if len(word) <= ABBREVIATION else ("complete", "", "")
    if closed and text[-1] in ")]":
        return "complete", "", ""
    if closed and text[-1] in "'’" and body and body[-1].isalnum():
        return "ask", *last_words(body)
    if closed:
        return "complete", "", ""
    if _URL.search(text[-300:]):
        return "complete", "", ""
    if not (text[-1].isalnum() or _RUN.match(text[-1])):
        return ("ask", *last_words(text)) if text[-1] in "%°$€" or not text[-1].isascii() and text[-1].isprintable() and text[-1] not in "—–‐‑" else ("cut", "", "")
    tail = re.split(r"\n|(?<=[.!?])\s+", text[-200:])[-1]
    if _LABEL.match(tail):
        return ("label", *last_words(text))
    return ("ask", *last_words(text))


_STATS = pa.schema([("w1", pa.string()), ("w2", pa.string()), ("go", pa.int64()), ("end", pa.int64()), ("dots", pa.int64()), ("abbr", pa.int64()), ("fin", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What follows every pair of words: a word, an end, final dots, a stop inside a sentence, nothing."""
    triples: Counter = Counter()  # three tokens in a row
    windows: Counter = Counter()  # seven characters in a row, where words aren't spaced
    inside: Counter = Counter()  # words with a stop that a sentence goes on behind
    finals: Counter = Counter()  # the last two tokens of texts

    def flush() -> pa.RecordBatch:
        rows: dict[tuple[str, str], list[int]] = {}

        def add(a: str, b: str, kind: int, n: int) -> None:
            rows.setdefault((a, b), [0, 0, 0, 0, 0])[kind] += n

        for (a, b, c), n in triples.items():
            if b[0].isalnum():
                add(_fold(a) if a[0].isalnum() else ".", _fold(b), 1 if c in _TERMINATORS else 0, n)
        for w, n in windows.items():
            if _RUN.match(w[4]):
                if w[5] in "。！？" or w[5] in " \n" and not w[6].isdigit():
                    add(w[:4], w[4], 1, n)
                elif w[5] != "…":
                    add(w[:4], w[4], 0, n)
        for b, n in inside.items():
            add("", _fold(b), 3, n)
        for (a, b, c), n in finals.items():
            if c in ("...", "…"):
                if b[0].isalnum():
                    add(_fold(a) if a[0].isalnum() else ".", _fold(b), 2, n)
            elif c[0].isalnum():
                add(_fold(b) if b[0].isalnum() else ".", _fold(c), 4, n)
        for counter in (triples, windows, inside, finals):
            counter.clear()
        cols = list(zip(*((*k, *v) for k, v in rows.items()))) or [[] for _ in _STATS]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _STATS)], schema=_STATS)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            if not text.isascii() and _RUN.search(text):
                windows.update([text[i : i + 7] for i in range(len(text) - 6)])
            t = _TOKEN.findall(_TAG.sub("", text) if "<" in text else text)
            if len(t) > 2:
                dotted = t[-1] in ("...", "…")
                triples.update(zip(t, t[1:], t[2:-1] if dotted else t[2:]))
                finals[tuple(t[-3:])] += 1
            for m in _INSIDE.finditer(text):
                word = _BEFORE.search(text, max(0, m.start() - 30), m.start())
                if word and not word.group()[-1].isdigit():
                    inside[word.group()] += 1
            if len(triples) + len(windows) > FLUSH:
                yield flush()
    yield flush()


_SEEN = pa.schema([("tbl", pa.string()), ("row_key", pa.int64()), ("field", pa.string()), ("source", pa.string()), ("n", pa.int32()), ("verdict", pa.string()), ("w1", pa.string()), ("w2", pa.string()), ("th", pa.int64())])


def _examine(batches: Iterator[pa.RecordBatch], rejects) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tbl, key, field, source, text, th, checked = (c.to_pylist() for c in batch.columns)
        said = [examine(v) for v in text]
        open_ = [i for i, (verdict, *_) in enumerate(said) if checked[i] and verdict != "complete"]
        for i, bad in zip(open_, rejects([text[i] for i in open_]) if open_ else ()):
            if bad:
                said[i] = ("complete", "", "")
        rows = [(t, k, f, s, len(v), *x, h) for t, k, f, s, v, x, h in zip(tbl, key, field, source, text, said, th)]
        cols = list(zip(*rows)) or [[] for _ in _SEEN]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SEEN)], schema=_SEEN)


def _longer(words: DataFrame, asked: DataFrame, keys: list[str], name: str) -> DataFrame:
    """For each asked ending the summed ``n`` of the words that its last word, w2, begins and doesn't fill."""
    starts = F.transform(F.sequence(F.lit(1), F.length("w2") - 1), lambda i: F.substring("w2", F.lit(1), i))
    words = words.where("n > 0 and length(w2) > 1").select(*keys[:-1], F.explode(starts).alias("w2"), "n")
    return words.join(asked, keys).groupBy(*keys).agg(F.sum("n").alias(name))


def _spikes(bare: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: the lengths at which different unfinished values (n, th) of a group pile up against lengths nearby; one row per length."""
    at = bare.groupBy(*keys, "n").agg(F.count("*").alias("c"))
    near = at.select(*keys, F.explode(F.sequence(F.col("n") - NEARBY, F.col("n") + NEARBY)).alias("n"), F.col("c").alias("c2")).groupBy(*keys, "n").agg(F.sum("c2").alias("around"))
    spikes = at.join(near, [*keys, "n"]).where((F.col("c") >= SPIKE_LEAST) & (F.col("c") * 2 * NEARBY >= SPIKE * (F.col("around") - F.col("c"))))
    return spikes.select(*keys, "n")


def verdicts(values: DataFrame, rejects=None) -> DataFrame:
    """tbl, row_key, field, source, is_cut for all values (tbl, row_key, field, source, text).

    ``rejects`` (texts -> booleans) tells which texts are no text of their field at all, of
    those with a true column ``checked``; these count as complete.
    """
    values = values.where("length(text) > 0")
    checked = F.lit(False) if rejects is None else F.col("checked")
    examined = lambda batches, rejects=rejects: _examine(batches, rejects)
    seen = cut(values.select("tbl", "row_key", "field", F.coalesce("source", F.lit("")).alias("source"), "text", F.xxhash64("text").alias("th"), checked.alias("checked")).mapInArrow(examined, "tbl string, row_key long, field string, source string, n int, verdict string, w1 string, w2 string, th long"))
    stats = values.select("text").distinct().mapInArrow(_count, "w1 string, w2 string, go long, end long, dots long, abbr long, fin long")
    stats = cut(stats.groupBy("w1", "w2").agg(*[F.sum(c).alias(c) for c in ("go", "end", "dots", "abbr", "fin")]))
    word = stats.groupBy("w2").agg(F.sum(F.col("go") + F.col("end")).alias("uses"), F.sum("abbr").alias("w_abbr"), (F.sum("end") - F.sum("abbr")).alias("w_end"), F.sum("fin").alias("w_fin"), F.sum("dots").alias("w_dots"))
    # words that an ending may be a piece of: behind the same word for dots, anywhere for labels
    asked = seen.where("verdict = 'dots'").select("w1", "w2").distinct()
    behind = _longer(stats.join(asked.select("w1").distinct(), "w1", "left_semi").select("w1", "w2", (F.col("go") + F.col("end")).alias("n")), asked, ["w1", "w2"], "longer")
    asked = seen.where("verdict = 'label'").select("w2").distinct()
    anywhere = _longer(word.select("w2", (F.col("uses") + F.col("w_fin")).alias("n")), asked, ["w2"], "w_longer")
    # the limits of the value's source, and those of the whole field, which texts bring along that were cut before
    bare = cut(seen.where(F.col("verdict").isin("ask", "label", "cut")).select("tbl", "field", "source", "n", "th").distinct())
    every = _spikes(bare.select("tbl", "field", "n", "th").distinct(), ["tbl", "field"])
    sources = bare.select("tbl", "field", "source").distinct()
    spikes = _spikes(bare, ["tbl", "field", "source"]).unionByName(every.join(sources, ["tbl", "field"]).select("tbl", "field", "source", "n")).distinct()
    open_ = seen.where(~F.col("verdict").isin("complete", "cut")).join(stats, ["w1", "w2"], "left").join(word, "w2", "left").join(behind, ["w1", "w2"], "left").join(anywhere, "w2", "left")
    open_ = open_.join(spikes.withColumn("limit", F.lit(True)), ["tbl", "field", "source", "n"], "left").na.fill(0, ["go", "end", "dots", "abbr", "uses", "w_abbr", "w_end", "w_fin", "w_dots", "longer", "w_longer"])
    share = F.col("end") / F.greatest(F.col("go") + F.col("end"), F.lit(1))
    bare_end = (F.col("go") + F.col("end") > 0) & (share >= ENDS)
    whole = (F.col("uses") > 0) & (F.col("uses") >= WHOLE * (F.col("uses") + F.col("w_dots") + F.col("w_fin")))
    own = whole & (F.col("dots") > 0) & (F.col("dots") >= OWN_DOTS * (F.col("dots") + F.col("longer"))) & ((F.col("go") == 0) | bare_end)
    is_cut = (
        F.when(F.col("verdict") == "stop", (F.col("w_abbr") >= 5) & (F.col("w_end") < 0.1 * F.col("w_abbr")))
        .when(F.col("verdict") == "dots", ~own)
        .when(F.coalesce("limit", F.lit(False)), F.lit(True))
        .when(F.col("verdict") == "label", (F.col("uses") == 0) & ((F.col("w_fin") < LABEL_ENDS) | (F.col("w_fin") < WHOLE * (F.col("w_fin") + F.col("w_longer")))))
        .otherwise(~bare_end)
    )
    done = seen.where(F.col("verdict").isin("complete", "cut")).select("tbl", "row_key", "field", "source", (F.col("verdict") == "cut").alias("is_cut"))
    return done.unionByName(open_.select("tbl", "row_key", "field", "source", is_cut.alias("is_cut")))
