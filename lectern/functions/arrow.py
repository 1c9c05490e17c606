"""Functions that need Python: Unicode normalization, linear algebra, alignment, stemming."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from lectern import vocab


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Unicode normal form KD; null stays null."""
    return s.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


_ABBREVIATION = re.compile(r"\b(" + "|".join(re.escape(a) for a in vocab.SENTENCE_ABBREVIATIONS) + r")\.", re.I)


def robust_sentences(text: str) -> list[str]:
    """Sentences longer than 10 characters; abbreviations, decimals and bracketed stops don't split."""
    t = unicodedata.normalize("NFKD", text)
    t = _ABBREVIATION.sub(lambda m: m.group(1).lower() + "\0", t)
    t = re.sub(r"(\d)\.(\d)", "\\1\0\\2", t)
    t = re.sub(r"\[[^\]]*\]|\([^)]*\)", lambda m: m.group().replace(".", "\0"), t)
    parts = (p.replace("\0", ".").strip() for p in re.split(r"(?<=[.!?])\s+", t))
    return [p for p in parts if len(p) > 10]


@F.pandas_udf(ArrayType(StringType()))
def robust_split(s: pd.Series) -> pd.Series:
    """:func:`robust_sentences` of each text; null stays null."""
    return s.map(robust_sentences, na_action="ignore")


def usable(sentence: str) -> bool:
    """20 to 300 characters, not mostly numbers and signs, not mostly upper case."""
    n = len(sentence)
    if not 20 <= n <= 300:
        return False
    return len(re.findall(r"[0-9()\[\]{}=<>+\-*/]", sentence)) / n <= 0.4 and sum(c.isupper() for c in sentence) / n <= 0.7


def position_score(i: int, n: int) -> float:
    if n <= 1:
        return 1.0
    p = i / (n - 1)
    return 1.0 if p <= 0.1 else 0.9 if p >= 0.9 else 0.8 if p <= 0.3 else 0.6


def keyword_score(sentence: str, keywords: list[str]) -> float:
    low = sentence.lower()
    return min(2.0, sum(k in low for k in keywords) / max(len(sentence.split()) / 10, 1))


def lsa_scores(sentences: list[str], stopwords: frozenset[str]) -> np.ndarray | None:
    """Norm of each sentence in the latent space, 1 for the largest; None without a vocabulary.

    Sublinear TF-IDF over words and pairs, the terms in more than 95 % of the sentences
    left out; the decomposition is exact (eigenvectors of the sentence Gram matrix).
    """
    n = len(sentences)
    rows = []
    for s in sentences:
        w = [t for t in re.findall(r"\b\w\w+\b", s.lower()) if t not in stopwords]
        rows.append(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df: dict[str, int] = {}
    tf: dict[str, int] = {}
    for r in rows:
        for t in r:
            tf[t] = tf.get(t, 0) + 1
        for t in set(r):
            df[t] = df.get(t, 0) + 1
    terms = [t for t in sorted(df) if df[t] <= 0.95 * n]
    terms = sorted(sorted(terms, key=lambda t: (-tf[t], t))[: min(5000, 10 * n)])
    if not terms:
        return None
    column = {t: j for j, t in enumerate(terms)}
    x = np.zeros((n, len(terms)))
    for i, r in enumerate(rows):
        for t in r:
            if t in column:
                x[i, column[t]] += 1
    x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * (np.log((1 + n) / (1 + np.array([df[t] for t in terms]))) + 1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1)
    k = min(max(int(0.15 * n), 5), len(terms) - 1, 50)
    if k < 1:
        return None
    value, vector = np.linalg.eigh(x @ x.T)
    top = np.argsort(value)[::-1][:k]
    lengths = np.sqrt(np.maximum((vector[:, top] ** 2) @ np.maximum(value[top], 0), 0))
    return lengths / lengths.max() if lengths.max() > 0 else lengths


def lsa_summary(text: str | None, m: int = 30, stopwords: frozenset[str] = frozenset(), keywords: list[str] = vocab.IMPORTANCE_KEYWORDS) -> str | None:
    """The m best sentences in their order: 0.6 latent weight, 0.2 position, 0.2 keywords."""
    if text is None:
        return None
    s = [c for c in (re.sub(r"\s+", " ", x).strip() for x in robust_sentences(text)) if usable(c)]
    if len(s) <= m:
        return " ".join(s)
    latent = lsa_scores(s, stopwords)
    if latent is None:
        return " ".join(s[:m])
    score = 0.6 * latent + np.array([0.2 * position_score(i, len(s)) + 0.2 * keyword_score(x, keywords) for i, x in enumerate(s)])
    best = np.lexsort((np.arange(len(s)), -np.round(score, 9)))[:m]
    return " ".join(s[i] for i in sorted(best))


def lsa_summarize(m: int, stopwords: list[str] | None = None):
    """An Arrow UDF of :func:`lsa_summary`."""
    stops = frozenset(stopwords or ())

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: lsa_summary(t if isinstance(t, str) else None, m, stops))

    return run


def lsa_summarize_each(m: int, stopwords: list[str] | None = None):
    """An Arrow UDF of :func:`lsa_summary` over arrays of texts."""
    stops = frozenset(stopwords or ())

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ts: [lsa_summary(t, m, stops) if t else None for t in ts])

    return run


def tfidf_rows(sentences: list) -> tuple[list[dict[str, float]], int]:
    """L2-normalized TF-IDF weights of each tokenized sentence within its document, and the size of the vocabulary."""
    counts = [Counter(s) for s in sentences]
    df = Counter(t for c in counts for t in c)
    n = len(counts)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    rows = []
    for c in counts:
        x = {t: k * idf[t] for t, k in c.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        rows.append({t: v / length for t, v in x.items()})
    return rows, len(df)


def tfidf_best(m: int):
    """An Arrow UDF of tokenized sentences: the places of the m with the highest mean weight, in order; lowest place on ties."""

    def best(sentences) -> list[int]:
        if sentences is None:
            return []
        if len(sentences) <= m:
            return list(range(len(sentences)))
        rows, v = tfidf_rows(sentences)
        score = [round(sum(r.values()) / v, 9) if v else 0.0 for r in rows]
        return sorted(sorted(range(len(rows)), key=lambda i: (-score[i], i))[:m])

    @F.pandas_udf("array<int>")
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(best)

    return run


def tfidf_weight_of(terms: list[str]):
    """An Arrow UDF of tokenized sentences: the summed weights of ``terms``, null if no sentence has one."""

    def weight(sentences) -> float | None:
        if sentences is None or not any(t in terms for s in sentences for t in s):
            return None
        return round(sum(r.get(t, 0.0) for r in tfidf_rows(sentences)[0] for t in terms), 6)

    @F.pandas_udf(DoubleType())
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(weight)

    return run


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, np.int64)
    other = np.array(b, object)
    for x in a:
        took = np.concatenate(([0], row[:-1] + (other == x)))
        row = np.maximum.accumulate(np.maximum(row, took))
    return int(row[-1])


@F.pandas_udf(DoubleType())
def rouge_l(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """ROUGE-L F of lower-case word tokens, unstemmed; 0 if either side has none."""

    def one(c, r):
        x, y = re.findall(r"[a-z0-9]+", (c or "").lower()), re.findall(r"[a-z0-9]+", (r or "").lower())
        n = lcs(x, y) if x and y else 0
        return 2 * n / (len(x) + len(y)) if n else 0.0

    return pd.Series([one(c, r) for c, r in zip(candidate, reference)])


@F.pandas_udf(StructType([StructField(n, LongType()) for n in ("hits", "c", "r")]))
def rouge_counts(candidate: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Words that two lower-case texts have in common, with their counts, and the words of each."""
    rows = []
    for c, r in zip(candidate, reference):
        x, y = Counter(re.findall(r"[a-z0-9]+", c or "")), Counter(re.findall(r"[a-z0-9]+", r or ""))
        rows.append((sum(min(n, y[w]) for w, n in x.items() if w in y), x.total(), y.total()))
    return pd.DataFrame(rows, columns=["hits", "c", "r"])


_VOWEL = "aeiou"


def _shape(word: str) -> str:
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in _VOWEL or ch == "y" and i and out[-1] == "c" else "c"
    return out


def porter(word: str) -> str:
    """The stem of a lower-case English word by the algorithm published in 1980."""
    if len(word) < 3:
        return word

    def measure(stem: str) -> int:
        return len(re.findall("v+c", re.sub("v+", "v", re.sub("c+", "c", _shape(stem)))))

    def vowel(stem: str) -> bool:
        return "v" in _shape(stem)

    def double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"

    def cvc(w: str) -> bool:
        return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    w = word
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: -len(end)] + to
            break
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    steps = (
        (0, "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"),
        (0, "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"),
        (1, "al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ion: ou: ism: ate: iti: ous: ive: ize:"),
    )
    for least, rules in steps:
        for rule in sorted((r.split(":") for r in rules.split()), key=lambda r: -len(r[0])):
            if w.endswith(rule[0]):
                stem = w[: -len(rule[0])]
                if measure(stem) > least and (rule[0] != "ion" or stem[-1:] in ("s", "t")):
                    w = stem + rule[1]
                break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    if measure(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def porter_stem(s: pd.Series) -> pd.Series:
    """Porter stem of each word; null stays null."""
    return s.map(lambda t: porter(t.lower()), na_action="ignore")


def register_all(spark: SparkSession) -> None:
    """Make the functions available in SQL: nfkd, robust_split, porter_stem, rouge_l, lsa_summarize (two sentences), the table function sentences."""
    spark.udf.register("nfkd", nfkd)
    spark.udf.register("porter_stem", porter_stem)
    spark.udf.register("rouge_l", rouge_l)
    spark.udf.register("lsa_summarize", lsa_summarize(2))
    spark.udf.register("robust_split", robust_split)
    spark.udtf.register("sentences", Sentences)


@F.udtf(returnType=StructType([StructField("idx", IntegerType()), StructField("sentence", StringType())]))
class Sentences:
    """Table function: the robust sentences of a text with their places; no rows for null."""

    def eval(self, text: str):
        if text is not None:
            yield from enumerate(robust_sentences(text))
