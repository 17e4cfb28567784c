import pytest
from conftest import record
from pyspark.sql import functions as F

from dossierlens.functions import markup
from dossierlens.operators.pages import eligible_pages, page_titles


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "body, expected",
    [
        ("[[Category:A]] x [[Category:B]]", ["A", "B"]),
        ("[[Category:X [[Category:Y]]", ["X [[CATEGORY:Y", "Y"]),
        ("[[Category:A]] [[Category:B", ["A"]),
        ("[[category:a]]", []),
        ("[[Category:A]][[Category:a]]", ["A", "A"]),
        ("[[Category:A b|key]]", ["A B|KEY"]),
        ("[[Category: \t two \n\n  words\x0b ]]", ["TWO WORDS"]),
        ("[[Category:\x01 A\x02B \x1f]]", ["A\x02B"]),
        ("[[Category:]]", [""]),
        ("[[Category:straße]]", ["STRASSE"]),
        ("no mark", []),
    ],
)
def test_page_categories(spark, body, expected):
    assert one(spark, body, markup.page_categories) == expected


def test_sort_key_cut(spark):
    assert one(spark, "[[Category:A b|key]]", lambda c: markup.page_categories(c, True)) == ["A B"]


@pytest.mark.parametrize(
    "text, expected",
    [("a<b>x</b>y</b>", "x"), ("a<b>x", None), ("x</b>", None), ("</b><b>x</b>", "x"), (None, None)],
)
def test_extract_between(spark, text, expected):
    assert one(spark, text, lambda c: markup.extract_between(c, "<b>", "</b>")) == expected


@pytest.mark.parametrize("text, fits", [("a" * 7, False), ("a" * 8, True), ("a" * 6 + "😀", True), ("😀" * 4, True), ("😀" * 3, False)])
def test_utf16_length(spark, text, fits):
    assert one(spark, text, lambda c: markup.at_least_utf16(c, 8)) is fits


LONG = "x" * 2100


def eligible(spark, *values, **options):
    df = spark.createDataFrame(list(enumerate(values)), "page_id long, value string")
    return {r.page_id: r for r in eligible_pages(df, **options).collect()}


def test_eligible_pages(spark):
    with_cat = LONG + "[[Category:A]]"
    kept = eligible(
        spark,
        record("kept", with_cat),
        record("redirect", with_cat, "\n    <redirect />"),
        record("named redirect", with_cat, '\n    <redirect title="T" />'),
        record("no text", with_cat).replace("</text>", ""),
        record("short", "[[Category:A]]"),
        record("no category", LONG),
        None,
        record("untagged", with_cat).replace('<text xml:space="preserve">', "<text>"),
        record("entities", "AT&amp;T" + with_cat),
    )
    assert sorted(kept) == [0, 2, 8]
    assert kept[0].title == "kept" and kept[0].categories == ["A"]
    assert kept[8].body.startswith("AT&amp;T")


def test_eligible_options(spark):
    no_title = record("x", LONG).replace("</title>", "")
    values = [record("a", LONG), no_title, record("r", LONG, '\n    <redirect title="T" />')]
    assert sorted(eligible(spark, *values, require_category=False)) == [0, 1, 2]
    assert sorted(eligible(spark, *values, require_category=False, require_title=True)) == [0, 2]
    assert sorted(eligible(spark, *values, require_category=False, redirect_pattern="<redirect ")) == [0, 1]
    other = record("o", LONG).replace('<text xml:space="preserve">', "<text>")
    assert sorted(eligible(spark, other, require_category=False, text_open="<text>")) == [0]
    sized = record("s", LONG).replace("<text ", '<text bytes="7" ')
    found = eligible(spark, other, sized, require_category=False, text_pattern="<text[^>]*>")
    assert [found[0].body, found[1].body] == [LONG, LONG]


@pytest.mark.parametrize("body, kept", [("x" * 2047, False), ("x" * 2048, True), ("x" * 2046 + "😀", True)])
def test_body_length_in_utf16_units(spark, body, kept):
    assert bool(eligible(spark, record("t", body), require_category=False)) is kept


def test_generated_page_ids_are_distinct(spark):
    df = spark.createDataFrame([(record("t", LONG),)] * 20, "value string").repartition(5)
    assert eligible_pages(df, require_category=False).select("page_id").distinct().count() == 20


def test_titles(spark):
    df = spark.createDataFrame([("<title>Foo</title>",), ("<title>Bar",)], "value string")
    assert [r.title for r in page_titles(df).collect()] == ["Foo"]
