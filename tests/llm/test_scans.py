import pytest
from pyspark.sql import functions as F

from lexigraph.llm import scans

SCHEMA = "arxiv_id string, full_text string, references_text string, sections array<struct<name:string,text:string,start_page:int,end_page:int>>, line int"
CLEAN = "The evidence of the second stage is compared with every answer from the self-supervised framework. We use short- and long-range signals for the question."
SCANNED = """Own Title of the Paper
Ann Arber

Abstract
The evidcnce of the second stage is com-
pared with every answer frorn the self-
Page 1 of 3

Own Title
supervised framework. We use short-
and long-range signals for the
question. The evidence of the sec¬
Page 2 of 3

Own Title
ond stage is compared with every answer.
Page 3 of 3

Own Title
The framework is compared with the question."""


def frame(spark, extra=()):
    clean = [(f"c{i}", f"Clean Title\n\nAbstract\n{CLEAN}", None, None, 1) for i in range(12)]
    scan = ("s", SCANNED, "", [("Abstract", SCANNED.split("Abstract\n")[1], 1, 3), ("None", None, 1, 1)], 1)
    return spark.createDataFrame([*clean, scan, scan, *extra], SCHEMA)


def test_repairs_of_a_scanned_paper(spark):
    every, _ = scans.repairs(frame(spark, [("n", None, None, None, 1), ("e", "", "", [], 1), (None, SCANNED, None, None, 1)]))
    rows = [tuple(r)[:6] for r in every.where("field = 'full_text'").collect()]
    assert {r[0] for r in rows} == {"s"} and len(rows) == len(set(rows))
    kinds = {k: {(r[3], r[5]) for r in rows if r[4] == k} for k in ("furniture", "hyphen", "misread")}
    assert kinds["furniture"] == {(6, ""), (8, ""), (12, ""), (14, ""), (16, ""), (18, "")}
    assert kinds["hyphen"] == {(4, "compared"), (5, "self-supervised"), (11, "second")}
    assert kinds["misread"] == {(4, "evidence"), (5, "from")}
    lines = {r.line_no for r in every.where("field = 'section' and kind = 'furniture'").collect()}
    assert lines == {2, 4, 8, 10, 12, 14}


def test_reflow(spark):
    rows = scans.reflowed(frame(spark)).where("field = 'full_text'").orderBy("paragraph_no").collect()
    text = rows[-1].text
    assert text.startswith("The evidence of the second stage is compared with every answer from the self-supervised framework.")
    assert "short- and long-range" in text and "Page" not in text and "Own Title" not in text
    assert len(rows) == 3


def test_reflow_shows_every_repair_and_keeps_capitals(spark):
    scan = """Another Title of Work
Ann Arber

Abstract
Evidcnce of the second stage is com-
pared with every answer. The SECOND Stagc of the frarne-
work, compared with the question, is short. Evi-
dence of every Answcr
is compared."""
    df = frame(spark, [("t", scan, None, None, 1)])
    every, _ = scans.repairs(df)
    text = " ".join(r.text for r in scans.reflowed(df).where("arxiv_id = 't'").orderBy("paragraph_no").collect())
    assert text.endswith(
        "Evidence of the second stage is compared with every answer. The SECOND Stage of the framework,"
        " compared with the question, is short. Evidence of every Answer is compared."
    )
    for r in every.where("arxiv_id = 't' and kind <> 'furniture'").collect():
        assert r.word in text.lower()


def test_a_paper_without_full_text_is_repaired(spark):
    body = SCANNED.split("Abstract\n")[1]
    df = frame(spark, [("u", None, None, [("Abstract", body, 1, 3), (None, None, 1, 1)], 1)])
    found = scans.repairs(df)[0].where("arxiv_id = 'u'").select("field", "kind").distinct().collect()
    assert ("section", "hyphen") in {tuple(r) for r in found}


def test_no_scans_no_repairs(spark):
    assert scans.repairs(frame(spark).where("arxiv_id like 'c%'"))[0].count() == 0
    assert scans.repairs(frame(spark).limit(0))[0].count() == 0


@pytest.mark.parametrize(
    ("misread", "right"),
    [("evidcnce", "evidence"), ("agreecl", "agreed"), ("minirig", "mining"), ("gr0iinding", "grounding"), ("cahbration", "calibration"), ("tbe", "the"), ("sechon", "section"), ("combmes", "combines"), ("softvvare", "software"), ("Acccss".lower(), "access")],
)
def test_confusable_words_share_a_skeleton(spark, misread, right):
    df = spark.createDataFrame([(misread, right)], "a string, b string")
    both = df.select(F.arrays_overlap(scans.skeletons(F.col("a")), scans.skeletons(F.col("b"))).alias("x"))
    assert both.first().x


def test_context_counts_for_options_that_are_not_frequent(spark):
    extracted = frame(spark)
    columns = ", ".join(f"{c} {'int' if c == 'section_no' else 'string'}" for c in scans._DOCUMENT)
    at = tuple(0 if c == "section_no" else "s" for c in scans._DOCUMENT)
    found = spark.createDataFrame([(*at, 1, "stagc", "second", "is")], f"{columns}, line_no int, word string, before string, after string")
    options = spark.createDataFrame([("stagc", "stage", 5), ("stagc", "stags", 100)], "word string, right string, support bigint")
    for frequent in (["stage", "stags"], ["stags"], []):
        known = spark.createDataFrame([(w,) for w in frequent], "word string")
        for bound in (0, 1, 20_000):
            best = scans.in_context(found, options, known, scans.clean_tokens(extracted), bound).collect()
            assert [r.right for r in best] == ["stage"]
