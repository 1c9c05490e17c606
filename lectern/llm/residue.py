"""Template residue, filler, error pages and script notices among real content.

A regularized linear classifier over hashed word n-grams, length and title features
judges every sentence or line of a value by itself; a value is rejected if one of its
parts is.  N-grams that hold a slot count in full however long the part is.

Weak labels for the fit come from response statuses and common phrases: a part that
consists of such words is residue, a long part that only mentions them is content, what
lies between is left out, and so is what stands beside residue and nowhere else.  The
labels take no part in the verdict.  The classifier is fitted on a bounded sample of
values (SAMPLE_SEARCHED and SAMPLE_ANY) and applied to all.  :func:`validate` judges all
values by classifiers that have not seen their host.

Null and empty values are no cases.  Without any weakly positive value nothing is rejected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that are searched for weakly positive ones, and values the classifier is fitted on in
#: any case; both in expectation, chosen by a hash of the row.
SAMPLE_SEARCHED, SAMPLE_ANY = 50_000, 12_000
#: Hash space of the features, strength of the ridge penalty, steps of the fit.
BITS, RIDGE, STEPS = 16, 2e-5, 300
#: Score from which a part is residue.
SURE = 0.75
#: Least weight of an n-gram with a slot.
SLOT_WEIGHT = 0.35
#: Other words up to which a part with a phrase is residue by weak label, and from which on it only mentions it.
FEW, MANY = 5, 8
#: Folds of hosts of the validation.
FOLDS = 5

#: Unfilled slots of the usual template languages, and notes to fill one.
SLOT = (
    r"\{\{[^{}]*\}\}|\{%[^%]*%\}|[$#]?\{[\w.\[\]]{3,}\}|<%=?[^%]*%>|%\([\w.\[\]]+\)[sd]|\[\[[\w.\[\]]+\]\]|@@[\w.\[\]]+@@"
    r"|__[A-Z][\w.\[\]]*__|~~[\w.\[\]]+~~|\$[A-Z][A-Z_.\[\]0-9]{2,}\$|<[A-Z][A-Z_.\[\]0-9]{3,}>|&lt;[\w.\[\]]+&gt;"
    r"|\[insert [^\]]*\]|\[[^\[\]]*(?:\[\d\])? goes here\]|<(?:enter|insert|your)\b[^>]*>|\[(?:placeholder|tbd|todo)\]"
)
#: Response statuses as servers print them.
STATUS = r"\b[45]\d\d:? (?:Bad (?:Gateway|Request)|Forbidden|Not Found|Gateway Time-?out|Internal Server Error|Service Unavailable|Too Many Requests|Unauthorized|Gone)"
#: Common phrases: failed requests, error markup, stack traces, script notices, failed steps, missing pages, notes to write something.
PHRASES = (
    rf"(?:HTTP/[\d.]+ |Error )?{STATUS}|^(?:request|connection|access|login|download)\b.{{0,20}}\b(?:failed|reset|refused|denied|blocked|timed out)\b.*"
    r"|^\{\"(?:error|status|message|detail)\".*\}$|</?(?:html|head|title|body|h1)>|<noscript>.*"
    r"|^traceback \(most recent call last.*|^\s*file \"[^\"]+\", line \d+.*|^\W?\w*(?:error|exception)\b\W* .*"
    r"|\b(?:enable|activate|activer|aktivieren|active|turn on|requires?|needs?)\b.{0,30}\bjavascript\b|\bjavascript\b.{0,30}\b(?:enable|activer|aktivieren|required|disabled|switched|available)\b|^checking your browser.*|^your (?:browser|session|request) (?:has|is|was|does)\b.*"
    r"|^(?:unable|failed) to (?:extract|generate|load|process|retrieve|find)\b.*|\bcould not be (?:processed|produced|generated|located|extracted|found|loaded)\b.*|\bunavailable\b.*|\boffline\b|\bno (?:text|answer|summary) (?:was |could be )?(?:generated|produced|found|available)\b|\bnothing (?:was )?(?:extracted|found)\b"
    r"|\bpage not found\b|\bpage .{0,20}introuvable\b|\bseite nicht gefunden\b|\bpágina no encontrada\b|\bpage you are looking for\b.*|^this (?:page|site) (?:is|requires|cannot)\b.*|\bsomething went wrong\b|\btry again later\b|^you have (?:reached|exceeded)\b.*\blimit\b.*"
    r"|^(?:todo|tbd|fixme|x{3,})\b.*|\bto be (?:completed|written|added|determined)\b|\bà compléter\b|\bpendiente de \w+|\btext folgt\b|\bfill(?:ed)? in later\b|\bhier steht\b.*\btext\b|\b(?:sample|dummy|placeholder|your) text\b|\btext goes here\b|\btexte d'exemple\b|\btexto de ejemplo\b"
)
#: Words of filler text; a part made of them is filler.
FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit eiusmod tempor incididunt labore magna aliqua quis nostrud exercitation ullamco laboris nisi bla blah dummy xxx foo bar baz qux asdf qwer qwerty jkl hjkl test".split()
#: Mark of an unfinished last part, a word of its own for the classifier.
TAIL = " \x03"
#: Words of sentences that speak about slots.
MENTION = r"\b(?:slots?|templates?|placeholders?|variables?)\b"

_SLOT, _PHRASES, _MENTION = re.compile(SLOT), re.compile(PHRASES, re.I), re.compile(MENTION, re.I)
_PARTS = re.compile(r"(?<=[.!?])\s+|\n+|; ")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_+|\x01")
_WORD = re.compile(r"[^\W\d_]+|\.\.\.")
_FILLER = frozenset(FILLER)
_MASK = np.uint64((1 << BITS) - 1)
_SLOT_ID = zlib.crc32(b"\x01")
_RARE = r"(?i)lorem|ipsum|adipiscing|ullamco|\bbla\b|blah|dummy|\bxxx|asdf|qwer|test test|foo bar"


def parts(value: str) -> list[str]:
    """The sentences and lines of a value; the last of several is marked with TAIL if it has no end."""
    out = [p for p in (x.strip() for x in _PARTS.split(value)) if p]
    if len(out) > 1 and out[-1][-1].isalnum():
        out[-1] += TAIL
    return out


def weak_label(part: str) -> bool | None:
    """Whether a part is residue by its statuses, phrases, slots and filler words; None where that is open."""
    slots = [m.span() for m in _SLOT.finditer(part)]
    spans = slots + [m.span() for m in _PHRASES.finditer(part)]
    words = list(_WORD.finditer(part))
    filler = [m.span() for m in words if m.group().lower() in _FILLER]
    if len(filler) > 1 or filler and len(filler) == len(words):
        spans += filler
    if not spans:
        return False
    others = sum(not any(a <= m.start() < b for a, b in spans) and m.group() != "..." for m in words)
    if slots:
        return not (others > MANY and _MENTION.search(_SLOT.sub(" ", part)))
    if others <= FEW or others <= 0.3 * len(words):
        return True
    return False if others >= MANY else None


_ids: dict[str, int] = {}


def _word_id(word: str) -> int:
    got = _ids.get(word)
    if got is None:
        if len(_ids) > 300_000:
            _ids.clear()
        got = _ids[word] = zlib.crc32(word.encode())
    return got


def features(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes of all parts in one array, the part of each, and its weight."""
    ids, starts, extra, owner = [], [], [], []
    for i, part in enumerate(items):
        words = _TOKEN.findall(_SLOT.sub(" \x01 ", part))
        starts.append(len(ids))
        ids.append(1)
        ids += [_word_id(re.sub(r"\d", "0", w.lower()) if not w.isalpha() else w.lower()) for w in words]
        ids.append(2)
        n = len(words)
        capital = sum(w[0].isupper() for w in words) / max(n, 1)
        filler = sum(w.lower() in _FILLER for w in words) / max(n, 1)
        own = [f"len{min(n.bit_length(), 7)}", f"cap{int(capital * 4)}", f"fill{int(filler * 4)}", "title" if 1 < n < 9 and capital > 0.6 and part[-1].isalnum() else "-", "stop" if part[-1] in ".!?" else "nostop"]
        extra += [zlib.crc32(x.encode()) for x in own]
        owner += [i] * len(own)
    a = np.asarray(ids, np.uint64)
    at = np.searchsorted(np.asarray(starts), np.arange(len(a)), "right") - 1
    slot = a == np.uint64(_SLOT_ID)
    two = a[:-1] * np.uint64(0x9E3779B1) + a[1:] * np.uint64(0x85EBCA77)
    three = two[:-1] * np.uint64(0xC2B2AE3D) + a[2:]
    g = np.concatenate([a, np.asarray(extra, np.uint64) + np.uint64(77), two, three])
    w = np.concatenate([at, np.asarray(owner, np.int64), np.where(at[:-1] == at[1:], at[:-1], -1), np.where(at[:-2] == at[2:], at[:-2], -1)])
    held = np.concatenate([slot, np.zeros(len(extra), bool), slot[:-1] | slot[1:], slot[:-2] | slot[1:-1] | slot[2:]])
    keep = w >= 0
    g, w, held = g[keep] * np.uint64(0x9E3779B97F4A7C15), w[keep], held[keep]
    x = (1 / np.sqrt(np.bincount(w, minlength=len(items))))[w]
    return ((g >> np.uint64(64 - BITS)) & _MASK).astype(np.int64), w, np.where(held, np.maximum(x, SLOT_WEIGHT), x)


class Classifier:
    """Logistic regression with a ridge penalty on hashed features."""

    def __init__(self, items: list[str], labels: np.ndarray):
        f, who, x = features(items)
        y = labels.astype(float)
        balance = np.where(labels, 0.5 / max(labels.sum(), 1), 0.5 / max((~labels).sum(), 1))
        w, bias = np.zeros(1 << BITS), 0.0
        squares, bias_square = np.full(1 << BITS, 1e-10), 1e-10
        for _ in range(STEPS):
            z = np.bincount(who, w[f] * x, minlength=len(items)) + bias
            err = (1 / (1 + np.exp(-z)) - y) * balance
            grad = np.bincount(f, err[who] * x, minlength=1 << BITS) + RIDGE * w
            squares += grad**2
            w -= 0.5 * grad / np.sqrt(squares)
            bias_square += err.sum() ** 2
            bias -= 0.1 * err.sum() / np.sqrt(bias_square)
        self.w, self.bias = w.astype(np.float32), bias

    def scores(self, items: list[str]) -> np.ndarray:
        """Probability of residue of each part."""
        if not items:
            return np.empty(0)
        f, who, x = features(items)
        z = np.bincount(who, self.w[f] * x, minlength=len(items)) + self.bias
        return 1 / (1 + np.exp(-z))


def labelled(values: DataFrame) -> tuple[list[str], np.ndarray, list[str]]:
    """Parts, weak labels and hosts of the bounded training sample of values (tbl, row_key, text, host)."""
    v = values.where("length(text) > 0")
    n = max(v.count(), 1)
    place = F.pmod(F.xxhash64("tbl", "row_key"), F.lit(1 << 30)) / float(1 << 30)
    v = v.withColumn("place", place).where(F.col("place") < SAMPLE_SEARCHED / n)
    slots = F.col("text").rlike(r"[{}$%<\[@~&]|__") & F.col("text").rlike(SLOT)
    suspect = slots | F.col("text").rlike("(?mi)" + PHRASES) | F.col("text").rlike(_RARE)
    rows = v.where((F.col("place") < SAMPLE_ANY / n) | suspect).select("text", "host").collect()
    seen: dict[str, str] = {}
    label: dict[str, bool | None] = {}
    free: set[str] = set()
    for text, host in sorted((r[0], r[1] or "") for r in rows):
        own = parts(text)
        for p in own:
            seen.setdefault(p, host)
            if p not in label:
                label[p] = weak_label(p)
        if len(own) > 4 or not any(label[p] for p in own):
            free.update(own)  # not what stands beside residue only
    items = sorted(p for p in seen if label[p] or label[p] is False and p in free)
    return items, np.array([bool(label[p]) for p in items], bool), [seen[p] for p in items]


def _judged(items: list[list[str]], model: Classifier) -> list[tuple[float, str]]:
    """Score and text of the worst part of each list of parts."""
    flat = [p for ps in items for p in ps]
    score, n, out = model.scores(flat), 0, []
    for ps in items:
        i = n + int(np.argmax(score[n : n + len(ps)])) if ps else -1
        out.append((float(score[i]), flat[i]) if ps else (0.0, ""))
        n += len(ps)
    return out


def fitted(values: DataFrame):
    """A broadcast classifier fitted on the values (tbl, row_key, text, host); None if one of the labels is missing."""
    items, labels, _ = labelled(values)
    return None if not labels.any() or labels.all() else values.sparkSession.sparkContext.broadcast(Classifier(items, labels))


def rejecter(values: DataFrame):
    """A function that tells of each text of a list whether it is or holds residue, by a classifier fitted on ``values``."""
    sent = fitted(values)
    return lambda texts: [False] * len(texts) if sent is None else [s > SURE for s, _ in _judged([parts(t) for t in texts], sent.value)]


def verdicts(values: DataFrame) -> DataFrame:
    """tbl, row_key, score, part, rejected for all values (tbl, row_key, text, host): the worst part and its score."""
    schema = "tbl string, row_key long, score double, part string, rejected boolean"
    sent = fitted(values)
    if sent is None:
        return values.where("false").select("tbl", "row_key", F.lit(0.0).alias("score"), F.lit("").alias("part"), F.lit(False).alias("rejected"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                tbl, key, text = (c.slice(at, 2000).to_pylist() for c in batch.columns)
                found = _judged([parts(t) for t in text], sent.value)
                score = [s for s, _ in found]
                columns = [pa.array(tbl, pa.string()), pa.array(key, pa.int64()), pa.array(score, pa.float64()), pa.array([p.removesuffix(TAIL) for _, p in found], pa.string()), pa.array([s > SURE for s in score], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["tbl", "row_key", "score", "part", "rejected"])

    return values.where("length(text) > 0").select("tbl", "row_key", "text").mapInArrow(run, schema)


def validate(values: DataFrame) -> DataFrame:
    """host, vals, labelled, rejected, both: all values judged by a classifier that has seen no value of their host's fold.

    ``labelled`` counts the values with a weakly labelled part, ``both`` those that are rejected too.
    """
    items, labels, hosts = labelled(values)
    folds = {h: i % FOLDS for i, h in enumerate(sorted(set(hosts)))}  # hosts outside the sample go by a hash
    fold = np.array([folds[h] for h in hosts])
    models = {}
    for k in range(FOLDS):
        train = np.flatnonzero(fold != k)
        if labels[train].any() and not labels[train].all():
            models[k] = Classifier([items[i] for i in train], labels[train])
    sent = values.sparkSession.sparkContext.broadcast((models, folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, text = ([x or "" for x in c.to_pylist()] for c in batch.columns)
            kept, weak, bad = [], [], []
            models, folds = sent.value
            at_fold = [folds[h] if h in folds else zlib.crc32(h.encode()) % FOLDS for h in host]
            for k, model in models.items():
                own = [i for i, f in enumerate(at_fold) if f == k]
                for at in range(0, len(own), 2000):
                    chunk = [parts(text[i]) for i in own[at : at + 2000]]
                    kept += [host[i] for i in own[at : at + 2000]]
                    bad += [s > SURE for s, _ in _judged(chunk, model)]
                    weak += [any(weak_label(p) for p in ps) for ps in chunk]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(weak, pa.bool_()), pa.array(bad, pa.bool_())], ["host", "weak", "bad"])

    judged = values.where("length(text) > 0").select("host", "text").mapInArrow(run, "host string, weak boolean, bad boolean")
    count = lambda c: F.sum(c.cast("long"))
    return judged.groupBy("host").agg(F.count("*").alias("vals"), count(F.col("weak")).alias("labelled"), count(F.col("bad")).alias("rejected"), count(F.col("weak") & F.col("bad")).alias("both"))
