import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("Linear Maps and DEEP-net.", ["linear", "maps", "and", "deep-net"]), ("=== 1234 ===", []), ("overﬁt", ["overfit"]), (None, [])])
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.lit(text).cast("string")), t=1) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("Refer to Eq. 4 for details. We define X.", ["Refer to Eq. 4 for details.", "We define X."]), ("   ", []), ("See Fig. A here. Then e.g. Bob left. End", ["See Fig. A here.", "Then e.g. Bob left.", "End"])],
)
def test_sentences(spark, text, want):
    assert one(spark, T.sentences(F.lit(text)), t=1) == want


def test_paths(spark):
    assert one(spark, T.chapter_of(F.lit("b/ch5/s5_8"))) == "b/ch5" and one(spark, T.chapter_of(F.lit("b/front/x"))) == ""
    assert one(spark, T.second_segment(F.lit("b/front/x"))) == "b/front"
    assert one(spark, T.ancestors_or_self(F.lit("b/ch1/s2"))) == ["b", "b/ch1", "b/ch1/s2"]
    assert one(spark, T.within(F.lit("b/ch12"), F.lit("b/ch1"))) is False
    assert one(spark, T.nid_segment(F.lit("theorem"), F.lit("1.1"), F.lit(None).cast("string"))) == "thm1_1"


def test_numbers_and_titles(spark):
    assert tuple(one(spark, T.split_number(F.lit("5.8.1 Kernels and more")))) == ("5.8.1", "Kernels and more")
    assert tuple(one(spark, T.split_number(F.lit("Preface")))) == (None, "Preface")
    assert one(spark, T.spoken_citation(F.lit("see Section 5.8 now"))) == "see Section 5 point 8 now"
    assert one(spark, T.citation_key(F.lit("Equation 5.42"))) == "5.42"


@pytest.mark.parametrize(("head", "alias", "want"), [("radial basis function", "RBF", True), ("kernel matrix", "RBF", False), ("machine learning method", "ML", True), ("kernel", "gram", True)])
def test_acronyms(spark, head, alias, want):
    assert one(spark, T.acronym_fits(F.lit(head), F.lit(alias))) is want


@pytest.mark.parametrize(("text", "want"), [("(a[b]{c})", True), ("(]", False), ("", True), ("((", False), (")(", False)])
def test_brackets(spark, text, want):
    assert one(spark, T.balanced_brackets(F.lit(text))) is want


def test_cosine(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.cosine(a(1, 0), a(0.6, 0.8))) == pytest.approx(0.6)
    assert one(spark, V.cosine(a(2, 0), a(3, 4))) == pytest.approx(0.6)
    assert one(spark, V.cosine(a(0, 0), a(3, 4))) == 0 and one(spark, V.cosine(a(1), a(3, 4))) == 0
    assert one(spark, V.proximity(F.lit("b/ch1/s1"), F.lit("b/ch1/s2/x"))) == 199


def test_prose(spark):
    assert one(spark, T.strip_latex(F.lit(r"\section{A} We let $x=1$ % note" + "\nbe."))) == "A We let be."
    assert one(spark, T.strip_vtt(F.lit("WEBVTT\n\n1\n00:00 --> 00:01\n<b>Hi</b> there"))) == "Hi there"
    assert one(spark, T.clause_seconds(F.lit("x" * 45))) == 3.0
