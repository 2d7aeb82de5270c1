import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sokhan.llm.canonical import canonical_changes, canonical_text, canonicalize
from sokhan.llm.reading import ReadingLevels
from sokhan.llm.splitting import cut_points, split_oversized, split_text


@pytest.mark.parametrize(
    "text, want",
    [
        ("كتاب علي", "کتاب علی"), ("ﺳﻔﺎﺭﺵ", "سفارش"), ("آب", "آب"), ("ＢＫ２３９", "BK239"), ("Вrаvіk ХК125", "Bravik XK125"), ("фильтр", "фильтр"),
        ("می‌‌شه ‌تا", "می‌شه تا"), ("سه شنبه", "سه شنبه"), ("کا​لا", "کالا"), ("٣٤", "۳۴"), ("AB٣", "AB3"), ("Névo", "Névo"),
        ("لطفاً‌ها", "لطفاً‌ها"), ("ساده", "ساده"), ("", ""), (None, None), ("\n", "\n"), ("نە", "نه"),
    ],
)
def test_forms(text, want):
    assert canonicalize(text) == want


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("اكيکی‌​ \n١۱1aаΑхфéｅ́ٓﺳە"), max_size=25))
def test_canonical_form_is_stable(text):
    once = canonicalize(text)
    assert canonicalize(once) == once


def test_changes_and_clashing_columns(spark):
    rows = [("a", "كتاب", "x"), ("a", "كتاب", "x"), ("b", "کتاب", None), (None, "ك", "ك"), ("c", "", "ي" * 50_000)]
    df = spark.createDataFrame(rows, "id string, text string, other string").withColumn("value", F.lit("ك")).withColumn("field_name", F.lit(1))
    got = {(r.id, r.field_name) for r in canonical_changes(df, "id", ["text", "other"]).collect()}
    assert got == {("a", "text"), ("c", "other")}
    assert canonical_changes(df.limit(0), "id", ["text"]).count() == 0
    kept = canonical_text(df, ["text"])
    assert kept.columns == df.columns and kept.count() == 5 and kept.filter("text like '%ك%'").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("ab .\n‌،é", max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_pieces_join_to_the_text(text, limit, overlap):
    parts = split_text(text, limit, overlap)
    assert "".join(text[a:b] for a, b, _, _ in parts) == text
    assert all(len(p) <= limit for *_, p in parts)
    assert all(o == min(overlap, a) and p == text[a - o : b] for a, b, o, p in parts)


def test_cuts_at_the_strongest_boundary():
    text = "a" * 20 + " " + "b" * 20 + ". " + "c" * 20 + " " + "d" * 20
    assert cut_points(text, 60, 0)[1] == text.index("c")
    with pytest.raises(ValueError):
        cut_points("abc", 3, 3)


def test_cuts_at_a_far_boundary_rather_than_inside_a_word():
    text = "a" * 20 + " " + "b" * 58 + " " + "c" * 20
    # the spaces stand at a fifth and four fifths, the middle half is unbroken
    assert cut_points(text, 84, 0) == [0, 21] and cut_points(text, 60, 0) == cut_points(text, 62, 2) == [0, 21, 80]
    assert cut_points("a" * 100, 60, 0) == [0, 50]


def test_oversized_items(spark):
    limits = spark.createDataFrame([("f", 10, 2)], "field_name string, max_chars int, overlap_chars int")
    rows = [("f", "a", "x" * 11), ("f", "a", "x" * 11), ("f", "b", "x" * 10), ("f", "c", None), ("f", None, "x" * 50), ("g", "d", "x" * 50), ("f", "e", "😀" * 10), ("f", "l", "word " * 40_000)]
    df = spark.createDataFrame(rows, "field_name string, item_id string, text string").withColumn("max_chars", F.lit(1)).withColumn("piece", F.lit("?"))
    got = split_oversized(df, limits)
    assert {r.item_id for r in got.select("item_id").distinct().collect()} == {"a", "l"}
    assert split_oversized(df.limit(0), limits).count() == 0 and split_oversized(df, limits.limit(0)).count() == 0


def test_reading_levels(spark):
    easy, hard = "پیک آمد. کالا نرسید. پول کم شد. او پنکه خرید. در را باز کن. ", "چنانچه متعهد از ایفای تعهدات قراردادی پیش‌گفته استنکاف نماید خسارت گزاف مطالبه می‌گردد. "
    specimens = spark.createDataFrame([(easy * 3, 1), (hard * 3, 4), (None, 2), ("x", None)], "text string, grade int")
    rows = [(1, easy * 4), (2, hard * 4), (3, "مشتری: " + easy * 2 + "\nکارشناس: " + easy), (4, "کوتاه است."), (5, None), (6, "This is plain English about parcels and nothing else " * 5), (7, " "), (8, hard * 2_000), (9, "تم فحص الطلب مع بطاقة الهدية لأن السلعة غير متوفرة وسوف نتصل بكم غدا في الصباح إن شاء الله تعالى حول الموضوع " * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slots", F.lit(1)).withColumn("grade", F.lit("?"))
    r = ReadingLevels(docs, specimens)
    assert {x.doc_id: x.grade for x in r.levels().collect()} == {1: 1, 2: 4, 3: 1, 8: 4}
    assert {x.grade: x.documents for x in r.profile().collect()} == {1: 2, 4: 2}
    assert ReadingLevels(docs.limit(0), specimens).levels().count() == 0 and ReadingLevels(docs, specimens.limit(0)).levels().count() == 0


@pytest.mark.parametrize("text, want", [("K", "K"), ("Ω", "Ω"), ("①", "1"), ("Ⅳ", "IV"), ("x²", "x2"), ("㎡", "m2"), ("क़", "क़"), ("가", "가"), ("سَّ", "سَّ"), ("سَّ", "سَّ"), ("a…b", "a…b")])
def test_unstable_by_the_quick_check_properties(spark, text, want):
    import unicodedata

    from sokhan.llm import canonical as c

    got = c.canonicalize(text)
    assert got == want and c.canonicalize(got) == got and unicodedata.is_normalized("NFC", got)
    df = spark.createDataFrame([("k", text)], "id string, text string")
    assert [r.canonical for r in c.canonical_changes(df, "id", ["text"]).collect()] == ([want] if want != text else [])


def test_the_quick_check_of_the_jvm_passes_no_unstable_text(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from sokhan.llm import canonical as c

    # every character that normalisation or the look-alike layer changes, in a word, and the ordinary ones beside them
    texts = [f"ب{chr(p)}ا" for p in [*range(0x20, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0xFFFE), *range(0x1D400, 0x1D800)] if unicodedata.category(chr(p)) not in ("Cn", "Cs", "Co")]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", c.needs_check(F.col("t")).alias("flagged"))
    assert not [r.t for r in df.collect() if not r.flagged and c.canonicalize(r.t) != r.t]
