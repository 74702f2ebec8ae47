import sqlite3

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textledger import formats
from textledger.functions.text import (
    contains_like,
    is_blank,
    is_short,
    is_substantial,
    labelled_page,
    like_regex,
    preview,
    trimmed_bytes,
)
from textledger.operators.cascade import direct_choice, stands_alone


def column(spark, texts, expression):
    rows = spark.createDataFrame([(at, text) for at, text in enumerate(texts)], "at int, text string").coalesce(1)
    return [row.value for row in rows.select(expression(F.col("text")).alias("value"), "at").orderBy("at").collect()]


BORDERS = [
    "x" * 49,
    "x" * 50,
    "x" * 51,
    "é" * 25,
    "é" * 25 + "x",
    "\u3000" + "x" * 50 + "\x85 \n",
    "\u200b" + "x" * 48,
    "x" * 49 + "\x1c",
    " " * 300 + "x" * 51,
    " " * 300 + "x" * 49 + " " * 300,
    "x" + " " * 300 + "x",
    "x" * 30 + " " * 250 + "x" * 30,
    "   \t\u3000",
    "",
    None,
]


def test_trim_takes_unicode_white_space_only(spark):
    # Python also strips U+001C to U+001F, which are not White_Space.
    expected = [text if text is None else len(text.strip(formats.WHITE_SPACE).encode()) for text in BORDERS]
    assert column(spark, BORDERS, trimmed_bytes) == expected
    assert expected[6:8] == [51, 50]


def test_thresholds_are_strict(spark):
    sizes = column(spark, BORDERS, trimmed_bytes)
    assert column(spark, BORDERS, is_substantial) == [size if size is None else size > 50 for size in sizes]
    assert column(spark, BORDERS, is_short) == [size if size is None else size < 50 for size in sizes]


def test_blank_and_label(spark):
    texts = [" \u2003\n", "", "a", None, "\u200b"]
    assert column(spark, texts, is_blank) == [True, True, False, None, False]
    assert column(spark, texts, lambda text: labelled_page(F.lit(3), text)) == [
        None,
        None,
        "--- Page 3 ---\na\n\n",
        None,
        "--- Page 3 ---\n\u200b\n\n",
    ]
    assert column(spark, ["a"], lambda text: labelled_page(F.lit(1), text, ocr=True)) == [
        "--- Page 1 (OCR) ---\na\n\n"
    ]


def test_preview_counts_characters(spark):
    assert column(spark, ["é" * 300, "kurz"], preview) == ["é" * 200, "kurz"]


def test_alternative_must_be_needed_and_strictly_longer(spark):
    cases = [
        ("d" * 49, "a" * 60, "a" * 60, True),
        ("d" * 49, "a" * 49, "d" * 49, False),
        ("d" * 40, "a" * 45, "a" * 45, False),
        ("d" * 50, "a" * 60, "d" * 50, False),
        ("d" * 51, "a" * 60, "d" * 51, True),
        ("d" * 49, None, "d" * 49, False),
        (None, "a" * 60, None, False),
        ("", "a" * 51, "a" * 51, True),
        (" ", "", " ", False),
    ]
    rows = spark.createDataFrame(cases, "direct string, alt string, chosen string, stands boolean")
    choice, stands = direct_choice(F.col("direct"), F.col("alt")), stands_alone(F.col("direct"), F.col("alt"))
    for row in rows.select("*", choice.alias("got"), stands.alias("got_stands")).collect():
        assert (row.got, row.got_stands) == (row.chosen, row.stands)


def sqlite_matches(texts, query):
    con = sqlite3.connect(":memory:")
    ask = "SELECT ? LIKE ?"
    return [None if text is None else bool(con.execute(ask, (text, f"%{query}%")).fetchone()[0]) for text in texts]


def spark_matches(spark, texts, queries):
    rows = spark.createDataFrame([(at, text) for at, text in enumerate(texts)], "at int, text string").coalesce(1)
    found = rows.select("at", *[contains_like(F.col("text"), q).alias(f"q{n}") for n, q in enumerate(queries)])
    taken = found.orderBy("at").collect()
    return [[row[f"q{n}"] for row in taken] for n in range(len(queries))]


def test_like_on_awkward_patterns(spark):
    texts = ["a\\b", "A\nb", "É", "é", "x_y", "100%", "\u212a", "k", "(a+)", "a.b", "ab\U0001f600c", "", "[x]", "Q\\E", "ßSS"]
    queries = ["\\", "a_b", "É", "é", "_", "%", "", "k", "(A+)", ".", "a%c", "b_c", "[X]", "\\e", "a\\B", "%%a%%", "s%S"]
    assert spark_matches(spark, texts, queries) == [sqlite_matches(texts, query) for query in queries]


def test_like_of_null_is_not_true(spark):
    assert [answers[0] or False for answers in spark_matches(spark, [None], ["", "a", "a%b"])] == [False] * 3


alphabet = st.sampled_from(list("abAB_%\\.*[é\u212aK\n\U0001f600 "))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet, max_size=12), min_size=20, max_size=40), st.lists(st.text(alphabet, max_size=5), min_size=15, max_size=15))
def test_like_as_sqlite_does_it(spark, texts, queries):
    assert spark_matches(spark, texts, queries) == [sqlite_matches(texts, query) for query in queries]


def test_like_stays_linear(spark):
    import time

    started = time.time()
    assert column(spark, ["ab" * 200_000], lambda text: contains_like(text, "a%b%a%b%a%z")) == [False]
    assert time.time() - started < 20
    assert like_regex("a%b").startswith("(?is)\\A(?>")
