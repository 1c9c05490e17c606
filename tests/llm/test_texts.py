import random
import re

import numpy as np
import pytest

from lectern.llm import codes, fmindex, language, leakage, linkage, packing, residue, sentences, sharedspans, truncation

LETTERS = "abcdefghij {}();\n"


def noise(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


# ---- arrays --------------------------------------------------------------------------


def test_tokens_and_span_hash():
    flat, starts = codes.codepoints(["foo_bar Baz1", "", "foo"])
    at, h = codes.tokens(flat)
    assert list(at) == [0, 4, 8, 14] and h[0] == h[3] and len(set(h)) == 3 and list(starts) == [0, 13, 14]


def test_winnow_guarantee():
    rng = random.Random(1)
    shared = noise(rng, 130)
    a, b = noise(rng, 333) + shared + noise(rng, 90), noise(rng, 71) + shared + noise(rng, 200)
    found = []
    for t in (a, b):
        flat, _ = codes.codepoints([t])
        h = codes.gram_hash(flat, 16)
        found.append({int(h[p]) for p in codes.winnow(h, 100)})
    assert found[0] & found[1]


def test_fm_index_against_scan():
    rng = np.random.default_rng(2)
    seq = np.append(rng.integers(1, 5, 300), 0)
    index = fmindex.FMIndex(seq)
    for _ in range(50):
        i, n = int(rng.integers(0, 295)), int(rng.integers(1, 5))
        pattern = seq[i : i + n]
        lo, hi = np.zeros(1, np.int64), np.array([index.n])
        for s in pattern[::-1]:
            lo, hi = index.extend(np.array([s]), lo, hi)
        want = [j for j in range(len(seq) - n + 1) if np.array_equal(seq[j : j + n], pattern)]
        assert sorted(index.sa[lo[0] : hi[0]]) == want


# ---- problem 8 -----------------------------------------------------------------------


def words(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, 30)), "_".join(words(rng, 40)), "x") for i in range(12)] + [(99, None, "", "x"), (98, "too short", None, "x")]
    docs = []
    for d in range(60):
        w = words(rng, 50)
        if d % 3 == 0:
            src = re.findall(r"[^\W_]+", items[d % 12][1 + d % 2])
            n = rng.choice([9, 11, 12, 13, 20])
            s = rng.randrange(len(src) - n)
            w[20:20] = [x.upper() for x in src[s : s + n]]
        docs.append((d, "-".join(w), "e"))
    docs += [(100, None, "e"), (101, "", "e"), (0, docs[0][1], "e")]
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, prompt string, solution string, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(dd, ii).where("exact_run >= 12").collect()}
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = {tuple(x[k : k + 12]): i for i, *ts, _ in items for x in map(tok, ts) for k in range(len(x) - 11)}
    want = {(d, grams[g]) for d, t, _ in docs for x in [tok(t)] for k in range(len(x) - 11) for g in [tuple(x[k : k + 12])] if g in grams}
    assert got == want and want
    assert leakage.leaks(dd.limit(0), ii).count() == 0 and leakage.leaks(dd, ii.limit(0)).count() == 0


def test_leak_tolerates_substitutions(spark):
    rng = random.Random(4)
    src = words(rng, 30)
    changed = list(src)
    changed[14] = "other"
    got = leakage.leaks(spark.createDataFrame([(1, " ".join(changed))], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(src), None)], "item_id long, prompt string, solution string")).collect()
    assert max(r.overlap for r in got) == 30 and max(r.matched for r in got) == 29 and max(r.exact_run for r in got) == 15


# ---- problem 9 -----------------------------------------------------------------------


def brute_pairs(docs):
    sets = {}
    for i, t in docs:
        if t and len(t) >= sharedspans.SPAN:
            sets[i] = {t[k : k + sharedspans.SPAN] for k in range(len(t) - sharedspans.SPAN + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] & sets[b]}


@pytest.fixture(scope="module")
def span_docs():
    rng = random.Random(5)
    base = [noise(rng, 1500) for _ in range(4)]
    docs = []
    for i in range(24):
        t = noise(rng, rng.randrange(0, 900))
        if i % 2:
            b = base[i % 4]
            n = [380, 399, 400, 401, 700][i % 5]
            s = rng.choice([0, 1, 300])
            t = t[:300] + b[s : s + n] + t[300:]
        docs.append((i, t))
    docs += [(50, base[0]), (51, base[0]), (52, base[0][200:900]), (53, " " * 900), (54, "x" + " " * 450 + "y" * 420), (55, "y" * 430), (60, None), (61, "")]
    return docs


def test_shared_pairs_against_brute_force(spark, span_docs):
    got = {tuple(r) for r in sharedspans.shared_pairs(spark.createDataFrame(span_docs, "doc_id long, text string")).collect()}
    assert got == brute_pairs(span_docs) and len(got) > 5


def test_hot_anchor_blocks(spark, monkeypatch):
    rng = random.Random(6)
    common = noise(rng, 500)
    docs = [(i, noise(rng, 200) + common + noise(rng, 200)) for i in range(13)]
    monkeypatch.setattr(sharedspans, "BLOCK", 4)
    got = {tuple(r) for r in sharedspans.shared_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_pairs(docs) and len(got) == 78


def test_runs_of_other_length_before_a_shared_passage(spark):
    rng = random.Random(9)
    docs = []
    for i, unit in enumerate(["=", "-", "ab", "xyz", "#", "*", "~", "+-", "_", "."] * 2):
        passage = noise(rng, [22, 60, 500, 900][i % 4])
        for k, n in enumerate((rng.randrange(378, 400), rng.randrange(300, 500))):
            docs.append((2 * i + k, noise(rng, 150) + (unit * 500)[-n:] + passage + noise(rng, 150)))
            docs.append((100 + 2 * i + k, noise(rng, 150) + passage + (unit * 500)[:n] + noise(rng, 150)))
    got = {tuple(r) for r in sharedspans.shared_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_pairs(docs) and len(got) > 20


def test_shared_share(spark, span_docs):
    d = spark.createDataFrame([(i, t, "x") for i, t in span_docs], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in sharedspans.shared_share(d).collect()}
    assert len(got) == len(span_docs) and got[50].share == 1.0 and got[60].share == 0.0 and got[61].n_chars == 0
    assert got[52].shared_chars == 700 and got[53].share == 1.0
    assert sharedspans.shared_pairs(d.limit(0)).count() == 0


# ---- problem 7 -----------------------------------------------------------------------


def bfd(sizes, capacity):
    free, n = [], 0
    for x in sorted(sizes, reverse=True):
        fit = [f for f in free if f >= x]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - x)
        else:
            n += 1
            free.append(capacity - x)
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 50, 256])
    sizes = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 40, 400]))]
    hist = {s: sizes.count(s) for s in set(sizes)}
    rows, opened = packing.plan(hist, capacity)
    assert opened == bfd(sizes, capacity)
    used = {}
    for i, (size, rank, first, each) in enumerate(rows):
        end = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == size else hist[size]
        for k in range(rank, end):
            box = first + (k - rank) // each
            used[box] = used.get(box, 0) + size
    assert sum(used.values()) == sum(sizes) and all(v <= capacity for v in used.values()) and len(used) == opened


def test_pack_whole_items_and_pieces(spark):
    sizes = spark.createDataFrame([(1, 30), (2, 10), (3, 5), (4, 5), (5, 0), (6, 10), (6, 10), (None, 3)], "doc_id long, tokens long")
    specs = spark.createDataFrame([(1, "s", 10), (2, "t", 16), (3, "u", None)], "spec_id long, spec_name string, capacity_tokens int")
    rows = packing.pack(sizes, specs).collect()
    for s in (1, 2):
        mine = [r for r in rows if r.spec_id == s]
        assert sum(r.tokens for r in mine) == 73
        assert sorted(r.start_token for r in mine if r.doc_id == 1) == ([0, 10, 20] if s == 1 else [0, 16])
        assert [r.container for r in mine if r.doc_id == 5] == [None]
    boxes = packing.containers(packing.pack(sizes, specs), specs).collect()
    assert all(b.unused >= 0 for b in boxes) and len([b for b in boxes if b.spec_id == 1]) == 8
    assert packing.pack(sizes.limit(0), specs).count() == 0 and packing.pack(sizes, specs.limit(0)).count() == 0


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "def f(x):\n    return x"), (2, ""), (3, None), (4, "a" * 20_000)], "doc_id long, text string")
    n = {r.doc_id: r.tokens for r in packing.count_tokens(docs).collect()}
    assert n[2] == n[3] == 0 and 5 < n[1] < 15 and n[4] > 1000


# ---- problem 4 -----------------------------------------------------------------------


def queries(spark):
    lines = {
        "en": ["how does deep learning help with the {} of the river", "what are the best methods for {} and the mapping of rivers"],
        "fr": ["quelles sont les meilleures méthodes pour la {} des rivières", "comment les réseaux profonds aident à améliorer la {} deep learning"],
        "de": ["welche Verfahren eignen sich für die {} von Flüssen", "ein Vergleich von tiefen Netzen mit anderen Methoden für die {}"],
    }
    rows, n = [], 0
    for lang, ts in lines.items():
        for t in ts:
            for w in ("mesure", "detection", "kontrolle"):
                n += 1
                rows.append((n, t.format(w), lang, "x"))
    rows += [(50 + i, t, "zh", "x") for i, t in enumerate(["如何利用弱标注改进洪水预测", "关于冰川监测与深度网络的综述", "如何利用知识图谱改进方言转写"])]
    rows += [
        (100, "quelles sont les meilleures méthodes pour la mesure des rivières. welche Verfahren eignen sich für die kontrolle von Flüssen", "fr", "x"),
        (101, "如何利用弱标注改进冰川监测", "ja", "x"), (102, "氷河の観測に役立つか", "jpn", "x"), (103, "обзор работ (BERT)", "Russian", "x"),
        (104, "XQVRTZ-17", "en", "x"), (105, "XQVRTZ-17", "und", "x"), (106, "", "en", "x"), (107, None, "en", "x"), (108, "how does the detection of the river help", "FR_fr", "x"), (109, "how does the detection of the river help", None, "x"),
    ]
    return spark.createDataFrame(rows, "run_id long, query string, query_language string, lang string")


def test_language_segments(spark):
    got = {}
    for r in language.label_segments(queries(spark), "run_id", "query", "query_language").orderBy("key", "seg_no").collect():
        got.setdefault(r.key, []).append((r.lang, r.case))
    assert got[100] == [("fr", True), ("de", True)]
    assert got[101] == [("zh", True)] and got[102] == [("ja", False)] and got[103] == [("ru", False)]
    assert got[104] == [("und", True)] and got[105] == [("und", False)] and 106 not in got and 107 not in got
    assert got[108] == [("en", True)] and got[109] == [("en", True)]
    assert all(got[i] == [(lang, False)] for i, lang in [(1, "en"), (8, "fr"), (10, "fr"), (14, "de")])
    assert language.label_segments(queries(spark).limit(0), "run_id", "query", "query_language").count() == 0


def test_known_words_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 4)
    rows = [(i, f"how does the {w} help with rivers", "en") for i, w in enumerate("survey mapping model method network sensor weather harvest".split())]
    rows += [(20 + i, f"a study of zirkonium {w} in lakes", "en") for i, w in enumerate("mapping survey model".split())] + [(50, "zirkonium", "en"), (51, "xqvrtz", "en")]
    d = spark.createDataFrame(rows, "run_id long, query string, query_language string")
    got = {r.key: r.lang for r in language.label_segments(d, "run_id", "query", "query_language").collect()}
    model, _ = language.train(d, "query", "query_language")
    assert model.known["zirkonium"] < 2  # found in the counts over all texts, not in the sample
    assert got[50] != "und" and got[51] == "und"


def test_label_spellings():
    assert [language.label_code(x) for x in ("EN", "eng", "English", "en-US", "fr_FR", "zh-Hans", "xx", "", None, "unknown")] == ["en", "en", "en", "en", "fr", "zh", None, None, None, None]


# ---- problem 3 -----------------------------------------------------------------------


def test_normalization():
    assert linkage.title_of("<i>A</i> Study &amp; More, Part II")[2] == 2 and linkage.title_of("A Study of...")[2] == -1
    assert linkage.author_of("Müller, J.") == linkage.author_of("J. Müller") == linkage.author_of("Muller J") == "muller|j"
    assert linkage.author_of("et al.") is None and linkage.author_of("Unknown") is None
    assert linkage.near("stravilthal", "srtavilthal") and not linkage.near("abcd", "wxyz")


def test_matches(spark):
    schema = "k long, title string, authors array<string>, year int, p string"
    left = [
        (1, "Sparse Encoders for Glacier Monitoring in the Field", ["Anna Bergmann", "Carl Dahl"], 2020, "x"), (2, "Sparse Encoders for Glacier Monitoring in the Field", ["Anna Bergmann", "Carl Dahl"], None, "x"),
        (3, "Sparse Encoders for Glacier Monitoring in the Field, Part II", ["Anna Bergmann", "Carl Dahl"], 2021, "x"), (4, "Sparse Encoders for Glacier Monitoring in the Field", ["Olaf Petersen"], 2016, "x"),
        (5, None, ["A"], 2020, "x"), (6, "", None, None, "x"), (7, "Another Title on Something Else Entirely", None, None, "x"),
    ]
    right = [
        (11, "SPARSE ENCODERS FOR GLACEIR MONITORING IN THE FIELD.", ["Bergmann, A.", "et al."], 2021, "x"), (12, "Sparse Encoders for Glacier Monitoring in the Field", ["Unknown"], 2020, "x"),
        (13, "Different Work by the Same Two People on Rivers", ["Bergmann A", "Dahl C"], 2020, "x"), (11, "SPARSE ENCODERS FOR GLACEIR MONITORING IN THE FIELD.", ["Bergmann, A.", "et al."], 2021, "x"),
    ]
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = {(r.paper_key, r.catalog_key) for r in linkage.match(a, b, "k", "k").collect()}
    assert got == {(1, 11), (2, 11), (1, 12), (2, 12)}
    assert linkage.match(a.limit(0), b, "k", "k").count() == 0


def test_neighbours_decide(spark):
    """A pair too weak alone is a match by a neighbour of either side, over two steps too, and never by a work of other authors."""
    schema = "k long, title string, authors array<string>, year int"
    clean, swapped, worse = "Sparse Encoders for Glacier Monitoring in the Northern Field", "Sparse Encoders for Glacier Monitoring in the Norhtern Field", "Sparse Encoders for Glacier Mnoitoring in the Norhtern Filed"
    a, b = ["Anna Bergmann", "Carl Dahl"], ["Olaf Petersen"]
    bare, fine = "Tidal Archives and the Memory of Harbour Towns", "Tidla Archives and the Memory of Harobur Towns"
    left = [(1, clean, a, 2019), (2, swapped, a, 2020), (3, worse, a, 2021), (4, worse, b, 2021), (5, bare, None, 2010)]
    right = [(11, clean, None, 2020), (12, bare, a, 2010), (13, fine, a, 2010), (14, fine, b, 2010)]

    def alone(x, y):
        return linkage.compare(*((*linkage.title_of(r[1])[::2], [linkage.author_of(n) for n in r[2] or []], r[3]) for r in (x, y)))

    for weak in (alone(left[2], right[0]), alone(left[3], right[0]), alone(left[4], right[2]), alone(left[4], right[3])):
        assert weak[0] < linkage.MATCH and not weak[1]
    assert alone(left[0], left[2])[1]  # the third meets the first by way of the second only
    got = {(r.paper_key, r.catalog_key): r.confidence for r in linkage.match(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "k").collect()}
    assert set(got) == {(1, 11), (2, 11), (3, 11), (5, 12), (5, 13)}
    assert got[1, 11] == 0.83 and got[2, 11] == 0.664 and got[3, 11] == 0.5312


# ---- problem 5 -----------------------------------------------------------------------


def residue_values(spark):
    good = ["The encoder handles river data well.", "Labels were produced by 3 raters only.", "Server timeouts (error 503) hit 7% of the requests and bias the river data.", "Templates with slots such as {name} or ${value} were filled by hand for river data, which limits scale."]
    bad = ["502 Bad Gateway", "TODO: write this section", "The encoder handles {{ title }} well.", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet elit sed.", "Model offline, no text generated.", "Labels were produced by 2 raters only. [Error: model overloaded, answer aborted]"]
    rows = [("t", i, g.replace("river", w), f"h{i % 3}") for i, (g, w) in enumerate((g, w) for g in good for w in "river lake sea wood soil sand rock snow rain wind".split())]
    rows += [("t", 1000 + i, b, f"h{i % 3}") for i, b in enumerate(bad * 3)] + [("t", 2000, None, None), ("t", 2001, "", None)]
    return spark.createDataFrame(rows, "tbl string, row_key long, text string, host string")


def test_residue(spark):
    v = residue_values(spark)
    got = {r.row_key for r in residue.verdicts(v).where("rejected").collect()}
    assert got == set(range(1000, 1021))
    by_host = {r.host: r for r in residue.validate(v).collect()}
    assert set(by_host) <= {"h0", "h1", "h2"} and all(r.both <= min(r.labelled, r.rejected) and r.rejected <= r.vals for r in by_host.values())
    assert residue.verdicts(v.limit(0)).count() == 0


def test_weak_labels():
    yes = ["502 Bad Gateway", "It concerns {{ title }}.", "TODO: write this section", "lorem ipsum dolor sit", "xxx"]
    no = ["Server timeouts (error 503) hit 7% of the requests and bias the river data.", "Templates with slots such as {name} were filled by hand for the river data.", "Labels were produced by 3 raters."]
    assert all(residue.weak_label(x) for x in yes) and not any(residue.weak_label(x) for x in no)


# ---- problem 6 -----------------------------------------------------------------------


def test_structure_of_endings():
    verdict = lambda t: truncation.examine(t)[0]
    assert [verdict(t) for t in ("Done.", "Is it?", 'He said "stop."', "(See App. 2.)", "完了。", "See https://x.y/z", "  ")] == ["stop", "complete", "complete", "complete", "complete", "complete", "complete"]
    assert [verdict(t) for t in ("A cut [truncated]", "broken �", "open (bracket", '"We stop here.', "hyphen-", "and,", "x &am", "<jats:p>No end.")] == ["cut"] * 8
    assert verdict("The work goes on...") == "dots" and verdict("no stop") == "ask" and verdict("Done. Keywords: river, lake") == "label"


def test_truncation(spark):
    s = ["We show that the method works on rivers over three seasons.", "These findings suggest that lakes should be studied with little tuning.", "And the work goes on..."]
    rows = [("t", i, "f", "s", f"{s[i % 2]} {s[(i + 1) % 2]}", "x") for i in range(40)] + [("t", 50 + i, "f", "s", f"{s[0]} {s[2]}", "x") for i in range(4)]
    rows += [
        ("t", 100, "f", "s", s[0] + " These findings sugg", "x"), ("t", 101, "f", "s", s[1] + " We show that the", "x"), ("t", 102, "f", "s", s[1] + " We show that the...", "x"),
        ("t", 103, "f", "s", s[1] + " We show that the method works on rivers over three seasons", "x"), ("t", 104, "f", "s", None, "x"), ("t", 105, "f", "s", "", "x"),
    ]
    d = spark.createDataFrame(rows, "tbl string, row_key long, field string, source string, text string, n string")
    got = {r.row_key: r.is_cut for r in truncation.verdicts(d).collect()}
    assert {k for k, v in got.items() if v} == {100, 101, 102} and 104 not in got and 105 not in got
    assert truncation.verdicts(d.limit(0)).count() == 0


def test_copies_of_a_cut_text_do_not_vouch(spark):
    s = ["We show that the encoder works on foundry planning over three seasons.", "The plan holds on rivers.", "And the work goes on..."]
    rows = [("t", i, "f", "s", f"{s[0]} Site {i} was checked on foot. {s[1] if i == 0 else ''}") for i in range(8)] + [("t", 20 + i, "f", "s", f"{s[1]} {s[2]}") for i in range(2)]
    rows += [("t", 100 + i, "f", "s", "It reduces the error for glaciers and foundry plan...") for i in range(6)]
    rows += [("t", 200 + i, "f", "s", "It is done. Keywords: river, glaci") for i in range(4)]
    d = spark.createDataFrame(rows, "tbl string, row_key long, field string, source string, text string")
    got = {r.row_key for r in truncation.verdicts(d).where("is_cut").collect()}
    assert got == {*range(100, 106), *range(200, 204)}


# ---- problem 1 -----------------------------------------------------------------------


def test_sentence_units(spark):
    base = ["We show that it works in the U.S. and the U.K. this year.", "The survey covers the U.S.", "How does the method help?", "Dr. Smith and Prof. Jones saw Fig. 3.", 'One rater wrote: "It is sound."', '"Is it enough?" the reviewers asked.', "结果可靠。", "评审者问：“够吗？”作者未答。", "有人写道：“可靠。”", "The first season ended in 2013."]
    rng = random.Random(7)
    texts = []
    for i in range(300):
        part = [base[rng.randrange(10)] for _ in range(5)]
        texts.append(("p", i, [x for x in part if x[0] < "一"] or [base[0]]))
        if i % 3 == 0:
            texts.append(("p", 1000 + i, [x for x in part if x[0] >= "一"] or [base[6]]))
    rows = [(t, k, (" " if s[0][0] < "一" else "").join(s), "x") for t, k, s in texts]
    rows += [("p", 5000, None, "x"), ("p", 5001, " \n ", "x"), ("p", 5002, "Background\n\nHow does the method help?", "x"), ("p", 5003, "ข้อมูล 0.5 เป็น 0.7 ดี เราแสดง", "x"), ("p", 5004, "How does the\nmethod help? The surv [truncated]", "x")]
    d = spark.createDataFrame(rows, "tbl string, row_key long, text string, sent_end string")
    got = {}
    for r in sentences.segment(d).orderBy("row_key", "sent_start").collect():
        got.setdefault(r.row_key, []).append((r.sent_start, r.sent_end))
    text = {k: t for _, k, t, _ in rows}
    wrong = [k for _, k, s in texts if [text[k][a:b] for a, b in got[k]] != s]
    assert len(wrong) <= len(texts) // 20, [[text[k][a:b] for a, b in got[k]] for k in wrong[:3]]
    cut = lambda k: [text[k][a:b] for a, b in got[k]]
    assert 5000 not in got and 5001 not in got and cut(5002) == ["Background", "How does the method help?"]
    assert cut(5003) == ["ข้อมูล 0.5 เป็น 0.7 ดี", "เราแสดง"] and cut(5004) == ["How does the\nmethod help?", "The surv [truncated]"]
    for k, spans in got.items():
        assert re.sub(r"\s", "", text[k]) == "".join(re.sub(r"\s", "", text[k][a:b]) for a, b in spans)
    assert sentences.segment(d.limit(0)).count() == 0


def test_heading_lines_are_units(spark):
    base = ["We show that it works on the rivers this year.", "mRNA profiles were linked to lakes over three seasons.", "How does the method help?", "The first season ended in spring."]
    rng = random.Random(8)
    rows = [("p", i, " ".join(base[rng.randrange(4)] for _ in range(4)), "x") for i in range(100)]
    rows += [("p", 100 + i, "{}\n{} {}".format(["Summary", "Purpose of the study"][i % 2], base[i % 4 // 2 * 2], base[3]), "x") for i in range(8)]
    rows += [("p", 200 + i, "We show that\nit works on the rivers this year. The first\nseason ended in spring.", "x") for i in range(4)]
    rows += [("p", 300, "Summary\n" + base[3], "x"), ("p", 301, base[0] + "\n" + base[3], "x")]
    d = spark.createDataFrame(rows, "tbl string, row_key long, text string, sent_end string")
    text, got = {k: t for _, k, t, _ in rows}, {}
    for r in sentences.segment(d).orderBy("row_key", "sent_start").collect():
        got.setdefault(r.row_key, []).append(text[r.row_key][r.sent_start : r.sent_end])
    assert [got[100 + i][0] for i in range(8)] == ["Summary", "Purpose of the study"] * 4 and {len(got[100 + i]) for i in range(8)} == {3}
    assert got[200] == ["We show that\nit works on the rivers this year.", "The first\nseason ended in spring."]
    assert got[300] == ["Summary", base[3]] and got[301] == [base[0], base[3]]


def test_model_counts_all_distinct_texts(spark):
    rows = [(f"W{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)} was seen here. It ended there.",) for i in range(8200)]
    d = spark.createDataFrame(rows + rows[:50], "text string")
    one, many = sentences.train(d.coalesce(1)), sentences.train(d.repartition(7))
    assert sum(w.startswith("W") and n[1] == 1 for w, n in one.next.items()) == 8200
    assert one.next["It"] == many.next["It"] and sum(one.next["It"]) == 8200 and one.end == many.end and one.step == many.step


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(f"p{n}_found" in names for n in (1, 2, 3, 4, 5, 6, 8, 9)) and "p7_assign" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_majority_of_a_frequent_text_outweighs_its_wrong_labels():
    hot = "estuary archive reports with layered retrieval"
    english = [(f"what are the methods for {w} in the archive", ["en"], [1]) for w in ("glacier", "reactor", "pollen", "timber")]
    italian = [(f"quali sono i metodi per la {w} del ghiacciaio", ["it"], [1]) for w in ("gestione", "analisi", "stima", "misura")]
    model = language.fit([(hot, ["en", "it", "de", None], [700, 15, 15]), *english, *italian])
    assert [s[2] for s in model.segments(hot)] == ["en"]
    assert language.votes_of(["en", "EN", "it"], [60, 30, 10]) == {"en": 4.5, "it": 0.5}


def test_a_further_language_becomes_a_candidate_by_its_labels():
    swedish = [(f"hur kan man förbättra {w} med hjälp av nya metoder", ["sv"], [1]) for w in (f"ord{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}" for i in range(60))]
    english = [("how can one improve the archive with the help of methods", ["en"], [3])]
    assert language.fit(swedish + english).segments("hur kan man förbättra arkivet med nya metoder")[0][2] == "sv"
    assert "sv" not in language.fit(swedish[:20] + english).scripts["latin"]


def test_spans_that_start_or_end_inside_longer_runs(spark):
    rng = random.Random(11)
    docs = []
    for i in range(96):
        period = i % 8 + 1
        unit = "".join(rng.choice("-=*#_.") for _ in range(period))
        held = rng.randrange(40, 380)
        passage = noise(rng, sharedspans.SPAN - held + rng.choice([0, 0, 1, 30]))
        for k in range(2):
            # both documents hold the last (or first) `held` characters of a run, which is longer in each by another number
            run = (unit * 1000)[: held + rng.randrange(0, 700)]
            run = (unit * 1000)[len(run) % period :][: len(run)] if rng.random() < 0.3 else run
            docs.append((2 * i + k, noise(rng, 80) + (run + passage if i % 16 < 8 else passage + run) + noise(rng, 80)))
    got = {tuple(r) for r in sharedspans.shared_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_pairs(docs) and len(got) > 30


def test_hot_anchor_with_different_surroundings(spark, monkeypatch):
    rng = random.Random(12)
    heads = [noise(rng, 380) for _ in range(3)]
    mark = noise(rng, 150)
    docs = [(i, noise(rng, 60) + heads[i % 3][: rng.choice([200, 380])] + mark + noise(rng, 500)) for i in range(24)]
    docs += [(100 + i, noise(rng, 500) + mark + heads[i % 3][:rng.choice([260, 380])] + noise(rng, 60)) for i in range(12)]
    monkeypatch.setattr(sharedspans, "BLOCK", 5)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in sharedspans.shared_pairs(d).collect()}
    assert got == brute_pairs(docs) and len(got) > 20
    share = {r.doc_id for r in sharedspans.shared_share(d).where("shared_chars > 0").collect()}
    assert share == {x for p in got for x in p}


def test_leaks_block_by_block(spark, monkeypatch):
    rng = random.Random(13)
    items = [(i, " ".join(words(rng, 30)), None) for i in range(9)]
    docs = [(i, " ".join(items[i][1].split()[3:18])) for i in range(9)] + [(50, items[0][1] + " " + items[8][1])]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, prompt string, solution string")
    whole = {tuple(r) for r in leakage.leaks(d, t).collect()}
    monkeypatch.setattr(leakage, "BLOCK", 300)
    assert {tuple(r) for r in leakage.leaks(d, t).collect()} == whole and len(whole) == 11
