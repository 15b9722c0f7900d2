import random

import pytest
from pyspark.sql import functions as F

from lexigraph.functions import text as tx
from lexigraph.operators import chunking, extraction


def one(spark, text, column):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text", [None, "", "  ", "a B cc　dd\x1cee", "x " * 5000])
def test_tokens_split_at_all_blanks(spark, text):
    expected = [w for w in (text or "").lower().split() if len(w) > 1]
    assert one(spark, text, tx.tokens) == expected


def test_title_falls_back(spark):
    assert one(spark, None, extraction.title_of) == "Unknown Title"
    assert one(spark, "short\narXiv:2001.00001 a long stamp\nA title of good length", extraction.title_of) == (
        "A title of good length"
    )


def test_sections_start_at_headings(spark):
    body = "word " * 20
    text = f"preamble is dropped\n1 Introduction\n{body}\n2.1 Own Idea\n{body}\nConclusion\nshort"
    few = "preamble\n1 Introduction\nfew words\n2.1. No Heading\n1.2.3 Too deep\n3 42 things"
    df = spark.createDataFrame([("a", text), ("b", body), ("c", None), ("d", ""), ("e", few), ("f", " tiny\n")], "id string, text string")
    rows = sorted((r.id, r.name, r.text) for r in extraction.sections(df, "id", "text").collect())
    assert [r[:2] for r in rows] == [
        ("a", "1 Introduction"), ("a", "2.1 Own Idea"), ("b", "Full Text"), ("e", "Full Text"), ("f", "Full Text")
    ]
    assert rows[3][2] == few and rows[4][2] == "tiny"


def test_abstracts_are_found_in_three_ways(spark):
    body = "This is the abstract of a paper that goes on for more than fifty characters."
    assert one(spark, f"T\nAbstract\n{body}\n\n1 Introduction\nx", extraction.abstract_of) == body
    assert one(spark, f"T\nAbstract: {body} Keywords a", extraction.abstract_of) == ": " + body
    assert one(spark, "T\nAn abstract\n\nshort one\ntwo\n\nrest", extraction.abstract_of) == "short one two"
    assert one(spark, "nothing here", extraction.abstract_of) == ""
    assert one(spark, None, extraction.abstract_of) is None


def test_references_are_split_and_parsed(spark):
    text = 'dropped\n[1] A. B. "A quoted title of some length". 2019. arXiv:1901.00001v2\n[2] C. doi:10.1234/ab.c.\n[3] D.'
    got = one(spark, text, extraction.split_references)
    assert len(got) == 3 and got[2] == "[3] D."
    unquoted = "[4] Author A. A title that nobody has quoted. In Proceedings of X, 2020."
    curly = "\u201cA curly quoted title of length\u201d 2021"
    df = spark.createDataFrame([(r,) for r in [*got, None, unquoted, curly]], "raw_text string")
    rows = extraction.reference_fields(df).collect()
    assert rows[0].parsed_arxiv_id == "1901.00001" and rows[0].parsed_year == 2019
    assert rows[0].parsed_title == "A quoted title of some length"
    assert rows[1].parsed_doi == "10.1234/ab.c"
    assert rows[3].parsed_title is None
    assert rows[4].parsed_title == "A title that nobody has quoted"
    assert rows[5].parsed_title == "A curly quoted title of length"


def test_reference_lists_without_numbers(spark):
    authors = "Smith, A. One.\nJones, B. Two\n goes on.\nMiller, C. Three.\nBaker, D. Four."
    assert one(spark, authors, extraction.split_references) == [
        "Smith, A. One.", "Jones, B. Two\n goes on.", "Miller, C. Three.", "Baker, D. Four."
    ]
    assert one(spark, "first one\n\nsecond one\n \nthird", extraction.split_references) == ["first one", "second one", "third"]
    assert one(spark, "a line of more than twenty\nshort", extraction.split_references) == ["a line of more than twenty"]
    assert one(spark, "", extraction.split_references) == []


def test_citations_are_united_from_ids_and_titles(spark):
    docs = spark.createDataFrame(
        [("a", 'x\n[1] arXiv:1901.00001v2 "The title of another paper"\n[2] "The title of another paper"\n[3] 1901.00001', 1), ("b", None, 1)],
        "arxiv_id string, references_text string, title int",
    )
    papers = spark.createDataFrame([("1901.00002", "The Title of Another Paper!"), ("a", "Own"), (None, "x")], "arxiv_id string, title string")
    parsed = extraction.parsed_references(docs)
    edges = extraction.citation_edges(parsed, papers, tx.normalized_title)
    assert {tuple(r) for r in edges.collect()} == {("a", "1901.00001"), ("a", "1901.00002")}
    assert [tuple(r) for r in extraction.citation_summary(parsed, edges).collect()] == [("a", 3, 2, 2)]


@pytest.mark.parametrize("n", [0, 1, 512, 513, 922, 923, 1000, 5999])
def test_windows_cover_the_text(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    got = one(spark, text, chunking.windows)
    if n <= 512:
        assert got == [text]
        return
    assert len(got) == -(-(n - 102) // 410)
    assert got[0].split() == text.split()[:512] and got[-1].split()[-1] == f"w{n - 1}"


def brute_merge(text, size=40, overlap=8):
    paragraphs = [p.strip() for p in text.split("\n\n") if len(p.split()) >= 10] or [text]
    out, cur = [], ""
    for p in paragraphs:
        if cur and len(cur.split()) + len(p.split()) > size:
            out.append(cur)
            cur = " ".join(cur.split()[-overlap:]) + "\n\n" + p
        else:
            cur = cur + "\n\n" + p if cur else p
    return out + [cur] * (len(cur.split()) >= 50)


def test_paragraph_merge_against_brute_force(spark):
    rng = random.Random(4)
    texts = [
        "\n\n".join(" ".join(f"t{rng.randrange(99)}" for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 9)))
        for _ in range(40)
    ] + ["", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", chunking.merged_paragraphs(F.col("t"), 40, 8).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [brute_merge(t) for t in texts]


def test_chunk_ids(spark):
    long = "word " * 60
    schema = "arxiv_id string, abstract string, sections array<struct<name:string,text:string,start_page:int,end_page:int>>"
    rows = [
        ("p", long, [("Abstract", long, 1, 1), ("Method", long, 1, 1), ("Method", long, 1, 1), ("References", long, 2, 2)]),
        ("q", None, [("A", "few words only", 1, 1)]),
        ("r", None, None),
    ]
    got = sorted(r.chunk_id for r in chunking.chunks(spark.createDataFrame(rows, schema)).collect())
    assert got == ["p_abstract", "p_abstract", "p_method", "p_method_2", "q_chunk_0"]
