import pytest
from pyspark.sql import functions as F

from sokhan.functions import align as A
from sokhan.functions import text as T


def value(spark, c, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(c).first()[0]


@pytest.mark.parametrize("a, b, want", [("زفری", "ظفری", 1.0), ("بدنبهشون", "بدن بهشون", 1.0)])
def test_sounds_alike(spark, a, b, want):
    assert value(spark, T.span_similarity(F.col("a"), F.col("b")), a=a, b=b) == want
    assert A.similarity(tuple(a.split()), tuple(b.split())) == want


def test_unlike_names_are_apart(spark):
    assert value(spark, T.sound_similarity(F.col("a"), F.col("b")), a="الویزی", b="پرویزی") < 0.75


def test_spaces_count_when_spoken(spark):
    assert value(spark, T.sound_similarity(F.col("a"), F.col("b")), a="بدنبهشون", b="بدن بهشون") < 1


@pytest.mark.parametrize("text, want", [("همین رو", "همینو"), ("الان هم", "الانم"), ("رو رو", "رو رو"), ("شونزده أحمد", "شانزده احمد"), ("", "")])
def test_clitics(spark, text, want):
    assert value(spark, T.normalize_clitics(F.col("t")), t=text) == want
    assert " ".join(A.join_clitics([A.canonical(w) for w in text.split()])) == want


@pytest.mark.parametrize("a, b, want", [("کنین", "کنید", True), ("این", "اید", False), ("را", "رو", True), ("چیزو", "چیز", True), ("کتاب", "کتان", False)])
def test_equivalent(spark, a, b, want):
    assert A.equivalent(a, b) is want
    assert value(spark, T.words_equivalent(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize("o, r, want", [("خودتونهشصت", "خودتونه شصت", False), ("پانزده", "پانصد هزار", True), ("کتاب", "دفتر", False), ("۱۲", "۱۳", True)])
def test_numbers(spark, o, r, want):
    assert A.changes_number(tuple(o.split()), tuple(r.split())) is want
    assert value(spark, T.changes_number(T.words(F.col("o")), T.words(F.col("r"))), o=o, r=r) is want


def test_style_same_in_both(spark):
    pairs = [("نمونه‌پور", "نمونه پور"), ("همین رو", "همینو"), ("یه", "یک"), ("کنین", "کنید"), ("کتاب", "دفتر"), ("می کنم", "می‌کنم")]
    rows = spark.createDataFrame(pairs, "o string, r string").select(T.is_style(T.words(F.col("o")), T.words(F.col("r")))).collect()
    assert [r[0] for r in rows] == [A.is_style(tuple(o.split()), tuple(r.split())) for o, r in pairs]


def test_typo_letters_overlap(spark):
    assert value(spark, T.character_overlap(F.col("a"), F.col("b")), a="میگیره", b="می‌گیره") == 1.0
    assert value(spark, T.character_overlap(F.col("a"), F.col("b")), a="", b="x") == 0.0


def test_words_part_on_any_space(spark):
    assert value(spark, T.words(F.col("t")), t=" a b c\t\nd‌e ") == ["a", "b", "c", "d‌e"]


def test_overlap(spark):
    assert value(spark, T.overlap_pct(F.col("a"), F.col("b")), a="x x y", b="x z") == 33.33
    assert value(spark, T.overlap_pct(F.col("a"), F.col("b")), a="", b="x") == 100.0


def test_word_distances_of_columns(spark):
    pairs = [("a b c", "a x c d", None), ("", "a b", "a"), ("a a a", "a", ""), ("سلام خوب", "سلام", "خوب سلام"), ("a" * 50, "b", "b c")]
    got = spark.createDataFrame(pairs, "a string, b string, c string").select(A.word_distances(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [list(g[0]) for g in got] == [[A.distance(a.split(), (x or "").split()) for x in xs] for a, *xs in pairs]


def test_object_marker_columns_agree_with_lists(spark):
    ws = ["چیز", "چیزو", "چیزرو", "را", "رو", "چیز‌", "بفرمایید", "بفرمایین", "ا", "او", ""]
    df = spark.createDataFrame([(a, b) for a in ws for b in ws], "a string, b string").select("a", "b", T.words_equivalent(F.col("a"), F.col("b")).alias("x"))
    assert all(r.x == A.equivalent(r.a, r.b) for r in df.collect())


def test_style_and_clitics_agree_with_lists(spark):
    import random

    rng = random.Random(2)
    vocabulary = ["کتاب", "کتابو", "رو", "را", "هم", "می", "رود", "می‌رود", "یه", "یک", "شیش", "شش", "ه", "هم‌", "کتاب‌"]
    pairs = [(rng.choices(vocabulary, k=rng.randint(0, 4)), rng.choices(vocabulary, k=rng.randint(0, 4))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", T.is_style(F.col("a"), F.col("b")).alias("s"), T.join_clitics(F.col("a")).alias("j"))
    for r in df.collect():
        assert r.s == A.is_style(tuple(r.a), tuple(r.b)) and r.j == A.join_clitics(r.a), (r.a, r.b)


def test_half_even_and_strip(spark):
    assert value(spark, T.overlap_pct(F.col("a"), F.col("b")), a="x " + "y " * 31, b="x") == 3.12
    assert value(spark, T.strip(F.col("t")), t="\u3000 a b\n") == "a b"


def test_lenient_span(spark):
    there = lambda t, s: value(spark, T.lenient_span_in(F.col("t"), F.col("s")), t=t, s=s)
    assert there("من می روم خانه", "می‌روم") and there("یه کتاب", "یک کتاب") and not there("یه کتابخانه", "کتاب") and not there("a", " ")
