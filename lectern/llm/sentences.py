"""Sentence boundaries across languages and scripts.

A hidden-event n-gram language model: a boundary token may be hidden behind every
terminator, at every line break and at every space of a script without stops, outside
quotations and brackets.  The model knows
how often a boundary follows a word (or the last characters, where words aren't spaced)
and which words follow a boundary or stand inside a sentence, with back-off to shapes
for rare words; forward-backward over these gaps of a text gives the posterior of each boundary.  It is trained without labels: a first guess
from punctuation and case, then rounds of expectation and maximization over all distinct
texts.  Each round is a distributed count: a task weighs the gaps of its texts, the sums
by word and shape make the next model.  Weights are whole numbers, so the sums don't
depend on the partitions.

Structure restricts the gaps: inside an open quotation or bracket there is none and a
blank line always is one.  Between words of one line without a terminator there is no
gap in scripts that have stops.  What is usual behind full-width stops, the danda and the
spaces of scripts without stops enters as a prior of the model (PRIORS).

Null texts, empty ones and ones of white space give no units.  Texts of any length are
handled whole; repeated rows give their own units.
"""

from __future__ import annotations

import marshal
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut

#: Rounds of training; weight of a whole gap in the sums; different gaps of a task before their sums are handed on.
ROUNDS, WHOLE, FLUSH = 4, 1 << 20, 200_000
#: Weight of a word's shape against its own counts.
BACKOFF = 2.0
#: Pseudo-counts and share of boundaries behind marks and spaces of scripts that have a clear use for them, so that few texts do.
PRIORS = {"cjk。": (200.0, 0.999), "cjk！": (200.0, 0.999), "cjk？": (200.0, 0.999), "danda": (200.0, 0.999), "thai space": (200.0, 0.998), "thai num": (200.0, 0.002)}
#: Pseudo-count of each pair of neighbouring events.
STEP = 10.0
#: Share of the words not seen before, inside sentences and at their starts.
UNSEEN = (0.02, 0.002)
#: Words and characters of a line that may be a heading, at most (characters where words aren't spaced).
HEADING, HEADING_CHARS, HEADING_RUN = 8, 80, 12
#: An opening mark without its closing one counts only so near the end of a text.
OPEN_END = 300

#: Abbreviations that start the training (without their final stop).
ABBREVIATIONS = frozenset(
    "dr prof mr mrs ms st mt jr sr fig figs eq eqs sec app no nos vol pp p ch ed eds cf vs etc al approx resp ca e.g i.e viz univ dept inc ltd co "
    "jan feb mar apr jun jul aug sep sept oct nov dec bzw usw vgl abb tab kap nr bd hrsg hl gl anm fa z b u a d h s f "
    "m mme mlle env av apr tabl art ex chap sra sr srta núm pág cap ej aprox ee uu ud uds г гг рис табл см т е д п ул им др н э км л डॉ د".split()
)

_SCAN = re.compile(r"[.!?…。！？।؟]+|[\"“”„«»‘’‹›「」『』()（）\[\]【】]|\n[^\S\n]*\n\s*|\n|(?<=[฀-๿])[ \t\n]+|[ \t\n]+(?=[฀-๿])")
_OPEN = {"“": "”", "„": "“”", "«": "»", "‘": "’", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "‹": "›"}
_CLOSE = frozenset("”»’」』)）]】›")
_TAIL = re.compile(r"\s*(?:(?:Key ?words|Index terms|Mots-clés|Schlüsselwörter|Palabras clave)\s*:|\d+ pages?\b)")
_LAST = re.compile(r"([^\s\"“”„«»‘()（）\[\]【】]+)[\s\"“”«»’)）\]】」』]*$")
_FIRST = re.compile(r"\s*([\"“„«‘「『(（\[【]?)\s*([^\s\"“”„«»‘()（）\[\]【】]+)?")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿]")
_THAI = re.compile("[฀-๿]")
_DIGIT = re.compile(r"\d")


def _line(text: str, end: int) -> str:
    """The shape of a line without a terminator: how many words, if a sentence or the text begins with it."""
    start = text.rfind("\n", 0, end) + 1
    before = text[max(0, start - 60) : start].rstrip()
    if start and before and before[-1] not in ".!?…。！？।؟" and before[-1] not in _CLOSE and before[-1] != '"' and not text[:start].endswith("\n\n"):
        return "line in"
    line = text[start:end].strip()
    words = line.count(" ") + 1
    if words > HEADING or len(line) > (HEADING_RUN if _UNSPACED.search(line) else HEADING_CHARS) or any(c in ".!?。！？।" for c in line) or not line or line[0].islower() or line[-1] in ",;(-–—":
        return "line long"
    return f"line head{1 if words == 1 else 2 if words < 5 else 3}"


def _left(text: str, end: int) -> tuple[str, str]:
    """(word with its final marks, shape) before a gap."""
    if 0 < end < len(text) and text[end].isspace():
        after = text[end : end + 20].lstrip()[:1]
        if _THAI.match(text[end - 1]) or _THAI.match(after):
            return _DIGIT.sub("0", text[max(0, end - 3) : end]), "thai num" if text[end - 1].isdigit() or after.isdigit() else "thai space"
    if text[end : end + 1] == "\n" and text[end - 1] not in ".!?…。！？।؟" and not (text[end - 1] in _CLOSE or text[end - 1] in "\"'"):
        m = _LAST.search(text, max(0, end - 40), end)
        return _DIGIT.sub("0", (m.group(1) if m else text[max(0, end - 3) : end]).lower()) + "\n", _line(text, end)
    m = _LAST.search(text, max(0, end - 40), end)
    word = m.group(1) if m else text[max(0, end - 3) : end]
    marks = text[end - 1] if end else ""
    if marks in "。！？" or _UNSPACED.search(text, max(0, end - 10), end):
        return _DIGIT.sub("0", text[max(0, end - 4) : end]), "cjk" + marks
    word = _DIGIT.sub("0", word.lower()).lstrip("-–—")
    body = word.rstrip(".!?…")
    n = len(body)
    kind = "abbr" if body in ABBREVIATIONS else "num" if body[-1:] == "0" and n < 3 else "year" if body[-1:] == "0" else "dotted" if "." in body else f"w{min(n, 5)}"
    final = word[len(body) :][:3]
    return word, f"{kind} {final}{'q' if marks not in '.!?…' else ''}"


def _right(text: str, start: int) -> tuple[str, str]:
    """(word, shape) after a gap."""
    m = _FIRST.match(text, start, start + 60)
    mark, word = m.group(1), m.group(2) or ""
    spaced = "" if text[start : start + 1].isspace() or not text[start : start + 1] else "~"
    if _UNSPACED.match(word):
        return word[:2], "cjk" + mark
    if _THAI.match(word):
        return word[:2], "other" + mark
    word = word.rstrip(".,;:!?")
    if not word:
        return "", "none" + mark
    shape = "num" if word[0].isdigit() else "lower" if word[0].islower() else "caps" if len(word) > 1 and word.isupper() else "upper" if word[0].isupper() else "other"
    return _DIGIT.sub("0", word), spaced + shape + mark


def gaps(text: str) -> tuple[list[int], list[int]]:
    """(candidate gaps, certain gaps) as offsets: a unit may end before, must end before."""
    n = len(text)
    # openers that are never closed count only near the end
    stack: list[tuple[str, int]] = []
    closes: dict[int, int] = {}
    marks = list(_SCAN.finditer(text))
    for k, m in enumerate(marks):
        ch = m.group()
        if len(ch) > 1:
            continue
        if ch == '"':
            if any(o == '"' for o, _ in stack):
                while True:
                    o, at = stack.pop()
                    if o == '"':
                        break
                closes[at] = k
                closes[-1 - k] = k
            else:
                stack.append((ch, k))
        elif ch == "“" and any(o == "„" for o, _ in stack) or ch in _CLOSE:
            for i in range(len(stack) - 1, -1, -1):
                if ch in _OPEN.get(stack[i][0], ""):
                    closes[stack[i][1]] = k
                    closes[-1 - k] = k
                    del stack[i:]
                    break
        elif ch in _OPEN:
            stack.append((ch, k))
    depth, candidates, certain, ended = 0, [], [], -1
    for k, m in enumerate(marks):
        ch = m.group()
        c = ch[0]
        s, e = m.start(), m.end()
        if c == "\n" and ch.count("\n") > 1:
            certain.append(s)
            ended = -1
            continue
        if c in ".!?…。！？।؟":
            ended = e
        elif -1 - k in closes:  # a closing mark
            depth = max(0, depth - 1)
            gap = s - ended
            if ended >= 0 and (gap == 0 or gap == 1 and text[s - 1].isspace() and c in "»›”"):
                ended = e
        elif k in closes:
            depth += 1
            continue
        elif (c == '"' or c in _OPEN) and n - s < OPEN_END:
            depth += 1  # never closed: open to the end of a cut text
            continue
        elif c.isspace():
            thai = s and "฀" <= text[s - 1] <= "๿" or e < n and "฀" <= text[e : e + 1] <= "๿"
            if thai:
                if depth == 0:
                    candidates.append(s)
            elif depth == 0 and ch == "\n" and _TAIL.match(text, s):
                certain.append(s)
            elif depth == 0 and ch == "\n" and text[max(ended, 0) : s].strip():
                candidates.append(s)
            continue
        if ended == e and depth == 0 and e < n:
            nxt = text[e]
            follow = marks[k + 1] if k + 1 < len(marks) else None
            if follow is not None and k + 1 > 0 and -1 - (k + 1) in closes and (follow.start() == e or follow.start() == e + 1 and nxt.isspace() and follow.group() in "»›”"):
                continue  # closing marks still belong to this end
            if nxt.isspace():
                candidates.append(e)
            elif text[s] in "。！？" or c in "。！？" or _UNSPACED.match(nxt) and (text[e - 1] in "」』”）" or text[e - 1] in "!?"):
                candidates.append(e)
            elif (nxt.isupper() or nxt in "\"“„«‘(" or nxt.isalpha() and not nxt.islower()) and e >= 3 and (text[e - 1] in "!?।؟…»”\")" or text[e - 2].isalpha() and text[e - 3].isalpha() and text[e - 2].islower() or not text[e - 2].isascii()):
                after = text[e + 1 : e + 2]
                if not (nxt.isupper() and after == "."):
                    candidates.append(e)
    return candidates, certain


def around(text: str, candidates: list[int]) -> tuple[list[tuple], list[int]]:
    """The words and shapes on both sides of the candidate gaps, and their distances."""
    far, last = [], 0
    for c in candidates:
        words = text.count(" ", last, c)
        far.append(0 if words < 3 else 1 if words < 6 else 2)
        last = c
    return [(_left(text, c), _right(text, c)) for c in candidates], far


class Model:
    """Counts of boundaries after words and of words after boundaries and elsewhere."""

    def __init__(self):
        self.end: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        self.end_shape: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        self.next: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        self.next_shape: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        self.pair: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0.0])
        self.step = [[[STEP, STEP], [STEP, STEP]] for _ in range(3)]
        self.total = [1e-9, 1e-9]
        self.memo: dict[tuple, float] = {}

    def __getstate__(self):
        return {k: dict(v) if isinstance(v, defaultdict) else {} if k == "memo" else v for k, v in self.__dict__.items()}

    def add(self, kind: str, a: str, b: str, n0: float, n1: float) -> None:
        """Set the counts of a word, shape, pair or step."""
        if kind == "step":
            row = self.step[int(a)][int(b)]
            row[0] += n0
            row[1] += n1
        elif kind == "total":
            self.total = [self.total[0] + n0, self.total[1] + n1]
        else:
            getattr(self, kind)[(a, b) if kind == "pair" else a] = [n0, n1]

    def balance(self) -> None:
        """Steps relative to the share of boundaries, which the odds hold already."""
        for bucket in self.step:
            share = sum(r[1] for r in bucket) / sum(sum(r) for r in bucket)
            for r in bucket:
                n = sum(r)
                x = r[1] / n / share
                y = r[0] / n / max(1 - share, 1e-6)
                r[0], r[1] = y / (x + y), x / (x + y)

    def odds(self, left: tuple[str, str], right: tuple[str, str]) -> float:
        """Log odds of a boundary between two words, without the neighbouring events."""
        key = (*left, *right)
        got = self.memo.get(key)
        if got is not None:
            return got
        none = (0.0, 0.0)
        shape = self.end_shape.get(left[1], none)
        weight, end = PRIORS.get(left[1], (1.0, 0.5))
        if left[0].endswith("।"):
            weight, end = PRIORS["danda"]
        prior = (shape[1] + weight * end) / (shape[0] + shape[1] + weight)
        own = self.end.get(left[0], none)
        p = (own[1] + BACKOFF * prior) / (own[0] + own[1] + BACKOFF)
        out = math.log(p / (1 - p)) if 0 < p < 1 else 0.0
        # the word that follows, as the start of a sentence against inside one: first within its
        # shape (sentences begin with few different words, so an unseen one speaks against a
        # boundary), then the shape itself where the script has cases
        cased = not right[1].lstrip("~").startswith(("cjk", "other"))
        for side, sign in ((1, 1), (0, -1)):
            shape_n = self.next_shape.get(right[1], none)[side]
            out += sign * 0.8 * math.log((self.next.get(right[0], none)[side] + BACKOFF * UNSEEN[side]) / (shape_n + BACKOFF))
            if cased:
                out += sign * 0.6 * math.log((shape_n + 0.3) / (self.total[side] + 3.0))
        both = self.pair.get((left[1], right[1]), none)
        share = self.total[1] / (self.total[0] + self.total[1])
        out += 0.5 * math.log((both[1] + share) / (both[0] + 1 - share) * (1 - share) / share)
        if len(self.memo) > 300_000:
            self.memo.clear()
        self.memo[key] = out
        return out

    def posteriors(self, sides: list[tuple], far: list[int]) -> list[float]:
        """Forward-backward over the candidate gaps of a text, given their words and distances."""
        up = [math.exp(max(-30.0, min(30.0, self.odds(*x)))) for x in sides]
        step = [[[row[j] / (row[0] + row[1]) * 2 for j in (0, 1)] for row in bucket] for bucket in self.step]
        forward, state = [], (0.0, 1.0)  # a text starts behind a boundary
        for f, o in zip(far, up):
            t = step[f]
            a0 = state[0] * t[0][0] + state[1] * t[1][0]
            a1 = (state[0] * t[0][1] + state[1] * t[1][1]) * o
            z = a0 + a1
            state = (a0 / z, a1 / z)
            forward.append(state)
        out, b = [0.0] * len(up), (1.0, 1.0)
        for i in range(len(up) - 1, -1, -1):
            x0, x1 = forward[i][0] * b[0], forward[i][1] * b[1]
            out[i] = x1 / (x0 + x1)
            t, o = step[far[i]], up[i]
            b0 = t[0][0] * b[0] + t[0][1] * o * b[1]
            b1 = t[1][0] * b[0] + t[1][1] * o * b[1]
            z = b0 + b1
            b = (b0 / z, b1 / z)
        return out


def first_guess(left: tuple[str, str], right: tuple[str, str]) -> float | None:
    """Probability of a boundary by punctuation and case alone; None where these leave it open."""
    mark = left[0][-1:] if left[0] else ""
    kind, shape = left[1].split(" ")[0], right[1]
    if kind == "line":  # short lines of their own before a capital are headings
        return 0.002 if "head" not in left[1] else None if "lower" in shape or "num" in shape else 0.9
    if kind == "thai":  # the script has no stop: its spaces set sentences apart, except beside numerals
        return 0.998 if left[1] == "thai space" else 0.002
    plain = kind in ("w3", "w4", "w5", "year")
    if "lower" in shape:
        return None if plain and mark == "." and not left[1].endswith("q") else 0.002
    if left[1].startswith("cjk"):
        return 0.999 if left[1][-1] in "。！？" else None
    if mark == "।":
        return 0.999
    if left[1].endswith("q"):
        return None
    if mark in "!?।؟":
        return 0.999
    if "num" in shape:
        return None if plain else 0.002
    return 0.999 if plain and kind != "year" else None


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the model sees of each text with gaps: words and shapes around them, distances, the first word."""
    for batch in batches:
        seen = []
        for text in batch.column(0).to_pylist():
            candidates = gaps(text)[0]
            if candidates:
                seen.append(marshal.dumps((*around(text, candidates), _right(text, 0))))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary())], names=["seen"])


_SUMS = pa.schema([("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())])


def _weigh(model: Model | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expectation: the sums of a task by word, shape, pair and step."""
    met: dict[tuple, list[int]] = {}  # different gaps: times they were open, weighed, their weight
    firsts: dict[tuple, int] = defaultdict(int)
    steps: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])

    def flush() -> pa.RecordBatch:
        sums: dict[tuple[str, str, str], list[int]] = defaultdict(lambda: [0, 0])

        def add(kind: str, a: str, b: str, n0: int, n1: int) -> None:
            row = sums[kind, a, b]
            row[0] += n0
            row[1] += n1

        for (left, right), (open_, n, n1) in met.items():
            n0 = n * WHOLE - n1
            half = open_ * WHOLE // 2
            add("end", left[0], "", n0 + half, n1 + half)
            add("end_shape", left[1], "", n0 + half, n1 + half)
            if n:
                add("next", right[0], "", n0, n1)
                add("next_shape", right[1], "", n0, n1)
                add("pair", left[1], right[1], n0, n1)
                add("total", "", "", n0, n1)
        for (word, shape), n in firsts.items():  # the start of a text follows a boundary
            add("next", word, "", 0, n * WHOLE)
            add("next_shape", shape.lstrip("~"), "", 0, n * WHOLE)
            add("total", "", "", 0, n * WHOLE)
        for (f, before), (n0, n1) in steps.items():
            add("step", str(f), str(before), n0, n1)
        for counter in (met, firsts, steps):
            counter.clear()
        cols = list(zip(*((*k, *v) for k, v in sums.items()))) or [[] for _ in _SUMS]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SUMS)], schema=_SUMS)

    for batch in batches:
        for raw in batch.column(0).to_pylist():
            sides, far, first = marshal.loads(raw)
            firsts[first] += 1
            post = [first_guess(*x) for x in sides] if model is None else model.posteriors(sides, far)
            before = 1.0
            for p, x, f in zip(post, sides, far):
                row = met.get(x)
                if row is None:
                    row = met[x] = [0, 0, 0]
                if p is None:  # open: says nothing about the word that follows
                    row[0] += 1
                    continue
                row[1] += 1
                row[2] += round(p * WHOLE)
                if model is not None:
                    for a, w in ((0, 1 - before), (1, before)):
                        step = steps[f, a]
                        n1 = round(w * p * WHOLE)
                        step[0] += round(w * WHOLE) - n1
                        step[1] += n1
                before = p
            if len(met) > FLUSH:
                yield flush()
    yield flush()


def train(texts: DataFrame) -> Model:
    """Expectation and maximization from the first guess, over all distinct texts (text)."""
    sc = texts.sparkSession.sparkContext
    seen = cut(texts.select("text").distinct().mapInArrow(_sides, "seen binary"))
    model = None
    for _ in range(ROUNDS + 1):
        sent = sc.broadcast(model)
        sums = seen.mapInArrow(lambda batches, sent=sent: _weigh(sent.value, batches), "kind string, a string, b string, n0 long, n1 long")
        rows = sums.groupBy("kind", "a", "b").agg(F.sum("n0"), F.sum("n1")).collect()
        new = Model()
        for kind, a, b, n0, n1 in rows:
            new.add(kind, a, b, n0 / WHOLE, n1 / WHOLE)
        if model is not None:
            new.balance()
        model = new
        sent.destroy()
    return model


def units(text: str, model: Model) -> list[tuple[int, int]]:
    """The (start, end) of the sentence units of a text, without white space at the ends."""
    candidates, certain = gaps(text)
    cuts = set(certain)
    if candidates:
        cuts.update(c for c, p in zip(candidates, model.posteriors(*around(text, candidates))) if p > 0.5)
    out, start = [], 0
    for end in [*sorted(cuts), len(text)]:
        piece = text[start:end]
        a = start + len(piece) - len(piece.lstrip())
        b = start + len(piece.rstrip())
        if b > a:
            out.append((a, b))
        start = end
    return out


def segment(texts: DataFrame) -> DataFrame:
    """tbl, row_key, sent_start, sent_end for all texts (tbl, row_key, text)."""
    texts = texts.where("length(text) > 0").select("tbl", F.col("row_key").cast("long").alias("row_key"), "text")
    sent = texts.sparkSession.sparkContext.broadcast(train(texts))
    schema = pa.schema([("tbl", pa.string()), ("row_key", pa.int64()), ("sent_start", pa.int64()), ("sent_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = sent.value, {}
        for batch in batches:
            tbl, key, start, end = [], [], [], []
            for t, k, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = memo.get(text)
                if found is None:
                    if len(memo) > 4000:
                        memo.clear()
                    found = memo[text] = units(text, model)
                tbl += [t] * len(found)
                key += [k] * len(found)
                start += [s for s, _ in found]
                end += [e for _, e in found]
            yield pa.RecordBatch.from_arrays([pa.array(tbl, pa.string()), pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], schema=schema)

    return texts.mapInArrow(run, "tbl string, row_key long, sent_start long, sent_end long")
