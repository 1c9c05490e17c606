"""Missing or wrong language labels: one language per segment, with a confidence.

The script of a word narrows its candidate languages; words of shared scripts are
scored by word and character-trigram frequencies; Viterbi with a switching penalty
labels the sequence, so that a borrowed term makes no segment but a sentence does.

The frequencies are trained on the table's own labels: a bounded sample of distinct
labelled texts (SAMPLE in expectation, chosen by a hash of the text), relabelled by the
model itself for a few rounds so that wrong labels lose their weight.  A text's labels
share its weight, so that the majority of a frequent text outweighs its wrong labels.  A
few function words per language start the training.  Languages beyond the usual ones of
a script become candidates when LEAST texts of the sample bear their label.

Whether a Latin text holds more than names is decided by the words of all texts: those
that the sample doesn't know are looked up in counts over the whole table.

Null and empty texts have no segments.  A text without a word of any known
vocabulary (names, numbers) has one segment ``und``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut

LATIN = ("en", "fr", "de", "es", "pt", "it", "nl")
#: Candidate languages of a script.
SCRIPTS = {"latin": LATIN, "cyrillic": ("ru",), "arabic": ("ar",), "devanagari": ("hi",), "thai": ("th",), "hangul": ("ko",), "greek": ("el",), "hebrew": ("he",), "kana": ("ja",), "han": ("zh", "ja")}
#: Further languages of a script, candidates when the labels name them.
MORE = {"latin": ("sv", "pl", "tr", "da", "fi", "no", "cs"), "cyrillic": ("uk",)}
#: Distinct labelled texts the model is trained on in expectation; texts with the label of a further language that make it a candidate.
SAMPLE, LEAST = 30_000, 50
#: Weight of a text in the first round, at most.
VOTES = 5
#: Rounds of relabelling.
ROUNDS = 3
#: Price of a change of language.
SWITCH = 11.0
#: Most that one word, and one character of a script without spaces, can speak against a language.
WORD, CHAR = 3.6, 2.2
#: What a Han character speaks for Chinese by itself; Japanese text shows by its kana.
HAN_ALONE = 0.7

#: Function words that start the training.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with on are this be from by what which how does an a other using",
    "fr": "le la les des du et en est que pour dans par sur avec une un aux quelles sont au ce qui",
    "de": "der die das und ist von zu mit den für auf im eine ein nicht sich auch bei durch welche wie",
    "es": "el la los las del y en es que para por con una un se al son cuáles cómo sobre",
    "pt": "o a os as do da dos das e em é que para por com uma um ao são como sobre na no",
    "it": "il lo la i gli le di del della e in è che per con una un sono quali come su si",
    "nl": "de het een van en in is dat voor met op zijn te bij naar hoe welke men aan door",
}

#: Names of languages in labels.
NAMES = {
    "en": "en eng english", "fr": "fr fra fre french français francais", "de": "de deu ger german deutsch", "es": "es spa spanish español espanol",
    "pt": "pt por portuguese português portugues", "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands", "ru": "ru rus russian русский",
    "zh": "zh zho chi chinese 中文", "ja": "ja jpn japanese 日本語", "ar": "ar ara arabic العربية", "hi": "hi hin hindi हिन्दी",
    "ko": "ko kor korean", "th": "th tha thai", "el": "el ell gre greek", "he": "he heb hebrew", "sv": "sv swe swedish", "pl": "pl pol polish",
    "tr": "tr tur turkish", "da": "da dan danish", "fi": "fi fin finnish", "no": "no nor norwegian nb nn", "cs": "cs ces cze czech", "uk": "uk ukr ukrainian",
}
_CODE = {word: code for code, words in NAMES.items() for word in words.split()}

_UNIT = re.compile(
    "(?P<latin>[A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ]+[0-9]*)|(?P<cyrillic>[Ѐ-ԯ]+)|(?P<arabic>[؀-ۿݐ-ݿ]+)"
    "|(?P<devanagari>[ऀ-ॿ]+)|(?P<thai>[฀-๿]+)|(?P<hangul>[가-힯]+)|(?P<greek>[Ͱ-Ͽ]+)|(?P<hebrew>[֐-׿]+)"
    "|(?P<kana>[ぁ-ヿ])|(?P<han>[㐀-鿿])"
)


def label_code(label) -> str | None:
    """The ISO 639-1 code that a label names in any spelling; None where it names none."""
    if not isinstance(label, str):
        return None
    word = label.strip().lower()
    return _CODE.get(word) or _CODE.get(re.split(r"[-_ ]", word)[0]) if word else None


def units(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, script, word) of all words; of scripts without spaces, of all characters."""
    out = []
    for m in _UNIT.finditer(text):
        word = m.group()
        if not word[-1].isdigit():  # a name with a number speaks for no language
            out.append((m.start(), m.end(), m.lastgroup, word.lower()))
    return out


def _trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Model:
    """Word, trigram and character frequencies per language."""

    def __init__(self, scripts: dict[str, tuple[str, ...]] = SCRIPTS):
        self.scripts = scripts
        self.words: dict[str, Counter] = defaultdict(Counter)
        self.grams: dict[str, Counter] = defaultdict(Counter)
        self.known: Counter = Counter()
        for lang, words in FUNCTION_WORDS.items():
            for w in words.split():
                self.words[lang][w] += 3
                self.known[w] += 3
                for g in _trigrams(w):
                    self.grams[lang][g] += 1
        self._memo: dict[tuple[str, str], tuple[dict[str, float], float]] = {}

    def add(self, lang: str, parts: list[tuple[int, int, str, str]], weight: float = 1) -> None:
        """Count the words of a segment."""
        for _, _, script, word in parts:
            if lang not in self.scripts[script]:
                continue
            self.words[lang][word] += weight
            if script == "latin":
                for g in _trigrams(word):
                    self.grams[lang][g] += weight

    def fix(self) -> Model:
        """Derive the totals; call once after all add()."""
        self.size = {lang: sum(c.values()) for lang, c in self.words.items()}
        self.gram_size = {lang: sum(c.values()) for lang, c in self.grams.items()}
        self._memo = {}
        return self

    def score(self, script: str, word: str) -> dict[str, float]:
        """Log posterior of each candidate language of a word, cut off at -WORD or -CHAR."""
        key = (script, word)
        got = self._memo.get(key)
        if got is not None:
            return got
        candidates = self.scripts[script]
        if len(candidates) == 1:
            out = {candidates[0]: 0.0}
        else:
            raw = {}
            seen = sum(self.words[lang][word] for lang in candidates)
            for lang in candidates:
                p = (self.words[lang][word] + 0.05) / (self.size.get(lang, 0) + 200)
                raw[lang] = math.log(p) + (HAN_ALONE if script == "han" and lang == "zh" else 0.0)
                if script == "latin" and seen < 5:
                    g = [math.log((self.grams[lang][x] + 0.2) / (self.gram_size.get(lang, 0) + 500)) for x in _trigrams(word)]
                    raw[lang] = (raw[lang] if seen else 0.0) + 0.6 * sum(g)
            top = max(raw.values())
            total = top + math.log(sum(math.exp(v - top) for v in raw.values()))
            floor = WORD if script == "latin" else CHAR
            out = {lang: max(v - total, -floor) for lang, v in raw.items()}
        if len(self._memo) > 200_000:
            self._memo.clear()
        self._memo[key] = out
        return out

    def segments(self, text: str, switch: float = SWITCH, words: bool = False) -> list[tuple[int, int, str, float, int, int]]:
        """(start, end, language, confidence, first unit, last unit + 1) in reading order.

        ``words`` tells that the text is known to hold more than names.
        """
        parts = units(text)
        if not parts:
            return [(0, len(text), "und", 1.0, 0, 0)] if text.strip() else []
        if not words and all(s == "latin" for _, _, s, _ in parts) and not any(self.known[w] >= 2 and len(w) > 1 for *_, w in parts):
            return [(0, len(text), "und", 1.0, 0, len(parts))]
        scores = [self.score(s, w) for _, _, s, w in parts]
        floors = [-(CHAR if s in ("kana", "han") else WORD) for _, _, s, _ in parts]
        langs = sorted({lang for s in scores for lang in s})
        best = [scores[0].get(lang, floors[0]) for lang in langs]
        back = []
        for sc, floor in zip(scores[1:], floors[1:]):
            top = max(range(len(langs)), key=best.__getitem__)
            stay, from_ = [], []
            for i, lang in enumerate(langs):
                jump = best[top] - switch
                keep = best[i] >= jump
                from_.append(i if keep else top)
                stay.append((best[i] if keep else jump) + sc.get(lang, floor))
            best = stay
            back.append(from_)
        at = max(range(len(langs)), key=best.__getitem__)
        path = [at]
        for from_ in reversed(back):
            at = from_[at]
            path.append(at)
        path.reverse()
        out, first = [], 0
        for i in range(1, len(path) + 1):
            if i == len(path) or path[i] != path[first]:
                lang = langs[path[first]]
                # confidence: posterior of the segment's language against all others over its units
                sums = [sum(scores[j].get(x, floors[j]) for j in range(first, i)) for x in langs]
                mine, top = sums[path[first]], max(sums)
                out.append((parts[first][0], parts[i - 1][1], lang, round(math.exp(mine - top - math.log(sum(math.exp(s - top) for s in sums))), 4), first, i))
                first = i
        return out


def _held(model: Model, text: str) -> Iterator[str]:
    """The words of the text's segments of three words or more."""
    parts = units(text)
    for _, _, lang, _, a, b in model.segments(text):
        if lang != "und" and b - a >= 3:
            yield from (word for _, _, script, word in parts[a:b] if lang in model.scripts[script])


def votes_of(labels: list, counts: list[int]) -> dict[str, float]:
    """The weight of each language that a text's labels name: their shares of VOTES, or of as many labels as there are."""
    own: Counter = Counter()
    for label, n in zip(labels, counts):
        if code := label_code(label):
            own[code] += n
    total = sum(own.values())
    return {code: n / total * min(total, VOTES) for code, n in own.items()}


def fit(sample: list[tuple[str, list, list[int]]]) -> Model:
    """The model of the given texts with their labels and how often each occurs."""
    votes = {t: votes_of(ls, ns) for t, ls, ns in sorted(sample)}
    named = Counter(max(sorted(own), key=own.get) for own in votes.values() if own)
    scripts = {s: langs + tuple(x for x in MORE.get(s, ()) if named[x] >= LEAST) for s, langs in SCRIPTS.items()}
    model = Model(scripts)
    for t, own in votes.items():
        parts = units(t)
        for lang, weight in own.items():
            model.add(lang, parts, weight)
            if len(parts) >= 3:
                model.known.update({w: weight for _, _, script, w in parts if lang in scripts[script]})
    model.fix()
    for _ in range(ROUNDS):
        new = Model(scripts)
        for t in votes:
            parts = units(t)
            for _, _, lang, _, a, b in model.segments(t):
                if lang != "und":
                    new.add(lang, parts[a:b])
                    if b - a >= 3:
                        new.known.update(w for _, _, script, w in parts[a:b] if lang in scripts[script])
        model = new.fix()
    return model


def train(texts: DataFrame, text: str, label: str) -> tuple[Model, DataFrame]:
    """The model, and all distinct texts (t)."""
    counted = texts.where(F.length(F.trim(text)) > 0).groupBy(F.col(text).alias("t"), F.col(label).alias("l")).agg(F.count("*").alias("n"))
    whole = cut(counted.groupBy("t").agg(F.collect_list("l").alias("ls"), F.collect_list(F.when(F.col("l").isNotNull(), F.col("n"))).alias("ns")))
    labelled = whole.where(F.size("ls") > 0)
    n = max(labelled.count(), 1)
    place = F.pmod(F.xxhash64("t"), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.where(place < SAMPLE / n).collect()
    return fit([(r["t"], r["ls"], r["ns"]) for r in rows]), whole.select("t")


def _with_words(names: DataFrame, whole: DataFrame, sent) -> DataFrame:
    """t: those of the distinct texts ``names`` that hold a word which two segments of any texts hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            for t in batch.column(0).to_pylist():
                held.update(_held(sent.value, t))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, w) for t in batch.column(0).to_pylist() for w in {w for *_, w in units(t) if len(w) > 1}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["t", "word"])

    known = whole.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2").select("word")
    return names.mapInArrow(own, "t string, word string").join(known.hint("merge"), "word", "left_semi").select("t").distinct()


_SEGMENTS = "key long, seg_no long, start int, end int, lang string, confidence double, case boolean"
_SEGMENTS_SCHEMA = pa.schema([("key", pa.int64()), ("seg_no", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("case", pa.bool_())])


def wrong(label, langs: list[str]) -> bool:
    """Whether a label is missing, wrong, or not enough because the text has several languages."""
    if langs == ["und"]:
        return not (isinstance(label, str) and label.strip().lower() in ("und", "unknown"))
    return len(langs) != 1 or label_code(label) != langs[0]


def label_segments(texts: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """key, seg_no, start, end, lang, confidence, case for every text.

    ``case`` tells that the row's label is missing or wrong or the text has several
    languages.  Texts that occur often are decoded once per Python worker and batch run.
    Texts of unknown Latin words only are decoded a second time, after their words were
    looked up in the counts over all texts.
    """
    model, whole = train(texts, text, label)
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = sent.value, {}
        for batch in batches:
            rows = []
            for k, t, l, words in zip(*(c.to_pylist() for c in batch.columns)):
                if not t:
                    continue
                found = memo.get((t, words))
                if found is None:
                    if len(memo) > 50_000:
                        memo.clear()
                    found = memo[t, words] = model.segments(t, words=bool(words))
                case = wrong(l, [s[2] for s in found])
                rows += [(k, i, s[0], s[1], s[2], s[3], case) for i, s in enumerate(found, 1)]
            columns = list(zip(*rows)) or [[] for _ in _SEGMENTS_SCHEMA]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEGMENTS_SCHEMA)], schema=_SEGMENTS_SCHEMA)

    def nameless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [t for t in batch.column(0).to_pylist() if units(t) and sent.value.segments(t)[0][2] == "und"]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], ["t"])

    names = cut(whole.mapInArrow(nameless, "t string"))
    saved = cut(_with_words(names, whole, sent))
    rows = texts.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t"), F.col(label).alias("l"))
    if not saved.isEmpty():
        rows = rows.join(saved.withColumn("words", F.lit(True)).hint("merge"), "t", "left").select("key", "t", "l", "words")
    else:
        rows = rows.withColumn("words", F.lit(False))
    return rows.mapInArrow(run, _SEGMENTS)
