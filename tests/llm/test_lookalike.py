from threading import Timer

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraph.llm import lookalike


@pytest.mark.parametrize(
    ("stored", "form"),
    [
        ("Ｆｕｌｌ　ｗｉｄｔｈ１", "Full width1"),
        ("naïve", "naïve"),
        ("zero​width­﻿", "zerowidth"),
        ("no break thin", "no break thin"),
        ("оf cоurse", "of course"),  # Cyrillic letters within Latin words
        ("οne", "one"),  # Greek omicron
        ("ﬁrst eﬃcient", "first efficient"),
        ("non‑breaking", "non-breaking"),
        ("метoд", "метод"),  # a Latin letter within a Cyrillic word
        ("ｸﾞﾗﾌ", "グラフ"),
        ("a\r\nb c", "a\nb\nc"),
        ("", ""),
    ],
)
def test_same_look(stored, form):
    assert lookalike.one_form(stored) == form


@pytest.mark.parametrize(
    ("a", "b"),
    [("résumé", "resume"), ("x2", "x²"), ("Word", "word"), ("O", "0"), ("a-b", "a–b"), ("a b", "a  b"), ("a b", "a\nb")],
)
def test_other_look_stays_apart(a, b):
    assert lookalike.one_form(a) != lookalike.one_form(b)


def test_whole_script_confusables_follow_the_text():
    assert lookalike.one_form("Это он, а не она: а и a") == "Это он, а не она: а и а"
    assert lookalike.one_form("а cat and a dog") == "a cat and a dog"
    assert lookalike.one_form("Метод Clovil лучше") == "Метод Clovil лучше"


def test_joiners_that_shape_letters_stay():
    assert lookalike.one_form("نمی‌خواهم") == "نمی‌خواهم"


@given(st.text(alphabet="aoexсеоАBВ βοé -​ ﬁ１", max_size=30))
def test_forms_are_final(text):
    once = lookalike.one_form(text)
    assert lookalike.one_form(once) == once


def test_pairs(spark):
    rows = [(1, "course", 0), (2, "cоurse", 0), (3, "course", 0), (4, "Course", 0), (5, None, 0), (6, "", 0), (7, "", 0), (8, "e\u0301" * 9000, 0), (9, "\u00e9" * 9000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form int")
    assert {tuple(r) for r in lookalike.same_reading_pairs(df).collect()} == {(1, 2), (2, 3), (8, 9)}
    assert lookalike.same_reading_pairs(df.limit(0)).count() == 0
    changed = {r.doc_id: r.changed for r in lookalike.normalized_documents(df).collect()}
    assert [k for k, v in sorted(changed.items()) if v] == [2, 8] and changed[5] is False


def test_a_huge_class_of_copies_with_one_variant(spark):
    n = 200_000
    text = F.when(F.col("id") == 77, "of c\u043eurse").otherwise("of course")
    pairs = lookalike.same_reading_pairs(spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text")))
    # all pairs of the class would be 4e10
    stop = Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = pairs.agg(
            F.count(F.lit(1)), F.countDistinct("doc_id_a", "doc_id_b"), F.expr("count_if((doc_id_a = 77 or doc_id_b = 77) and doc_id_a < doc_id_b)")
        ).first()
    finally:
        stop.cancel()
    assert tuple(got) == (n - 1, n - 1, n - 1)


def test_several_copies_of_several_spellings(spark):
    stored = {i: ["course", "c\u043eurse", "\u0441ourse", "other"][i % 4] for i in range(400)}
    df = spark.createDataFrame(list(stored.items()), "doc_id bigint, text string")
    got = [tuple(r) for r in lookalike.same_reading_pairs(df).collect()]
    ids = [i for i in stored if i % 4 != 3]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in ids for b in ids if a < b and stored[a] != stored[b]}
