import random

import pytest

from lexigraph.llm import quality

CHUNKS = "chunk_id string, text string, ord int"
EXTRACTED = "arxiv_id string, sections array<struct<name:string,text:string,start_page:int,end_page:int>>, unit int"
SUBJECTS = "the method|our system|a reader|the second stage|this index|the older model|every query".split("|")
VERBS = "is compared with|was built from|has to be moved to|depends on|is stored with|falls back to".split("|")
OBJECTS = "the records of the archive|a set of short notes|the answer that was given|what we saw in the tests".split("|")


def prose(rng, n=14):
    out = [f"{rng.choice(SUBJECTS).capitalize()} {rng.choice(VERBS)} {rng.choice(OBJECTS)} in {rng.randrange(3, 900)} cases." for _ in range(n)]
    return " ".join(out)


def junk(rng, kind):
    if kind == "table":
        return "\n".join(" | ".join(f"{rng.random():.3f}" for _ in range(6)) for _ in range(14))
    if kind == "list":
        return "\n".join(f"- {rng.choice(['sparse', 'dense'])} thing{i}" for i in range(30))
    if kind == "code":
        return "\n".join(f"    x{i} = f{i}(a[{i}], b) # {i}\n    return x{i}" for i in range(20))
    if kind == "repeat":
        return "\n".join(["see other page left blank"] * 40)
    return " ".join("".join(rng.choice("#~<>0þ¤Ã¬") for _ in range(5)) for _ in range(80))


def test_junk_is_far_from_prose(spark):
    rng = random.Random(8)
    good = {f"g{i}": prose(rng) for i in range(400)}
    good["caps"], good["cited"] = prose(rng).upper(), prose(rng).replace(".", " [3, 17].")
    good["list_inside"] = prose(rng) + "\n- first point\n- second point\n- third point\n" + prose(rng)
    bad = {f"b{k}{i}": junk(rng, k) for k in ("table", "list", "code", "repeat", "noise") for i in range(6)}
    rows = [(k, v, 1) for k, v in (good | bad).items()] + [("null", None, 1), (None, "x", 1), ("btable0", bad["btable0"], 1)]
    sections = [("p", [("A", prose(rng), 1, 1), ("B", junk(rng, "table"), 1, 1), ("C", None, 1, 1)], 1), ("q", None, 1)]
    units = quality.text_units(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(sections, EXTRACTED))
    got = [tuple(r) for r in quality.not_prose(units).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {("chunk", k, 0) for k in bad} | {("section", "p", 1)}


def test_contributions_add_up(spark):
    rng = random.Random(9)
    rows = [(f"g{i}", prose(rng), 1) for i in range(250)] + [("e", "", 1), ("long", "word " * 200000, 1)]
    units = quality.text_units(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([], EXTRACTED))
    for r in quality.scored(units).collect():
        assert r.distance == pytest.approx(sum(r.contributions), rel=1e-6, abs=1e-6)
        assert r.most_unusual in quality.STATISTICS


def test_empty_input(spark):
    units = quality.text_units(spark.createDataFrame([], CHUNKS), spark.createDataFrame([], EXTRACTED))
    assert quality.not_prose(units).count() == 0
