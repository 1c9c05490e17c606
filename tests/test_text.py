from pyspark.sql import functions as F

from lectern.functions import arrow
from lectern.functions import text as T


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()[0]


def test_splitters(spark):
    t = "First one. Second one! 1 starts the third? Is 0.5 kept"
    assert one(spark, t, T.split_a(F.col("t"))) == ["First one.", "Second one!", "1 starts the third?", "Is 0.5 kept"]
    assert one(spark, "Short. This one is long enough to stay! No", T.split_b(F.col("t"))) == ["This one is long enough to stay"]
    assert one(spark, "See Fig. 3 here. Dr. X agrees. End", T.split_d(F.col("t"))) == ["See Fig. 3 here", "Dr. X agrees", "End"]
    assert one(spark, "", T.split_a(F.col("t"))) == []
    assert one(spark, None, T.split_a(F.col("t"))) is None


def test_tokens(spark):
    assert one(spark, "The Deep-Learning of État, 2024!", T.query_tokens(F.col("t"), ["the", "of"])) == ["deep-learning", "état", "2024"]
    assert one(spark, None, T.query_tokens(F.col("t"), [])) == []
    assert one(spark, "A bc été x_1", T.word_tokens(F.col("t"))) == ["bc", "été", "x_1"]


def test_clean_scientific(spark):
    t = "Intro [1, 2] text (Smith et al., 2020).\n\nTable 3 numbers\nfigure 1 shows\n=+=+=+==(1)\nKept line\nReferences\n[1] gone"
    assert one(spark, t, T.clean_scientific(F.col("t"))) == "Intro  text .\nKept line"


def test_clean_for_detection(spark):
    assert one(spark, "Mail a@b.de or https://x.y/z, it's  fine!", T.clean_for_detection(F.col("t"))) == "Mail or it's fine"


def test_jaccard_and_counts(spark):
    d = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [round(r[0], 3) for r in d.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [0.333, 0.0]
    assert one(spark, "novel novel method", T.contains_count(F.col("t"), ["novel", "method", "x"])) == 2
    assert one(spark, "novel novel method", T.pattern_count(F.col("t"), ["novel", "m.t"])) == 3


def test_porter_and_lcs():
    words = "caresses ponies hopping relational conditional triplicate electricity adjustable controll roll happy generalizations oscillators".split()
    assert [arrow.porter(w) for w in words] == "caress poni hop relat condit triplic electr adjust control roll happi gener oscil".split()
    assert arrow.lcs("a b c d".split(), "b d a c d".split()) == 3


def test_robust_sentences():
    s = arrow.robust_sentences("As Fig. 3 shows, it rose by 0.5 points. The cited work (cf. Sec. 2. there) agrees. Tiny.")
    assert s == ["As fig. 3 shows, it rose by 0.5 points.", "The cited work (cf. sec. 2. there) agrees."]


def test_lsa_summary():
    text = " ".join(f"Sentence number {i} talks about topic {w} and method {w} in detail." for i, w in enumerate("alpha beta gamma delta epsilon zeta eta".split()))
    out = arrow.lsa_summary(text, 2)
    assert out.count(".") == 2 and all(p in text for p in out.split(". "))
    assert arrow.lsa_summary(None, 2) is None and arrow.lsa_summary("", 2) == ""


def test_registered_functions(spark):
    arrow.register_all(spark)
    r = spark.sql("select porter_stem('Relational') a, round(rouge_l('a b c', 'a c'), 3) b, nfkd('é') c, nfkd(null) d").first()
    assert (r.a, r.b, len(r.c), r.d) == ("relat", 0.8, 2, None)
