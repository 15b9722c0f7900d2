from collections import Counter

import numpy as np
import pytest

from lexigraph.llm import label_model, linkage

PAPERS = "arxiv_id string, title string, authors array<string>, published string, updated string, profile int"
READING = "arxiv_id string, title string, authors array<string>, published string, primary_category string"
REFS = "ref_id bigint, raw_text string, arxiv_id string, doi string, title string, authors array<string>, year int, key string"


def test_the_model_learns_who_is_right():
    rng = np.random.default_rng(7)
    truth = rng.random(20000) < 0.3
    accuracy = [0.95, 0.9, 0.9, 0.6, 0.55, 0.9]
    votes = np.stack([np.where(rng.random(20000) < a, truth, ~truth) * 2 - 1 for a in accuracy], axis=1)
    votes[:, 2] = votes[:, 1]  # a copy must not count twice
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = label_model.posteriors(patterns, counts)[at.ravel()]
    assert ((p > 0.5) == truth).mean() > 0.93
    assert abs(p.mean() - 0.3) < 0.05
    assert len(label_model.posteriors(np.zeros((0, 6)), np.zeros(0))) == 0


def world(spark):
    names = [("Ann", "Arber"), ("Bo", "Bellim"), ("Cy", "Crouth"), ("Di", "Drazel"), ("Ed", "Elvond"), ("Flo", "Fembur")]
    topics = "sparse dense hybrid neural robust causal latent modal".split()
    tasks = "retrieval ranking parsing linking labelling pruning".split()
    papers = [
        (f"20{i:02d}.{i:05d}", f"Coinage{i}x: {topics[i % 8].title()} Methods for {tasks[i % 6].title()} over Archive Number{i}", [" ".join(names[i % 6]), " ".join(names[(i + 1) % 6])], f"{2015 + i % 9}-01-01", "2024", 1)
        for i in range(60)
    ]
    twins = [("2101.00001", "Equal Words in Equal Order for Equal Ends", ["Gil Gamber"], "2019-01-01", "1", 1), ("2101.00002", "Equal Words in Equal Order for Equal Ends", ["Hal Humbek"], "2019-05-01", "1", 1)]
    again = (papers[0][0], " " + papers[0][1], papers[0][2], papers[0][3], "2025", 1)
    p = spark.createDataFrame([*papers, *twins, again, (None, "x", None, None, None, 1), ("2102.00001", None, None, None, None, 1)], PAPERS)
    r = spark.createDataFrame([("1501.00001", "A Living Bibliography of Everything Around", ["Ida Ikrom"], "2015-02-02", "cs")], READING)
    return p, r, papers


def test_references_find_their_papers(spark):
    p, reading, papers = world(spark)
    refs, truth = [], {}

    def ref(title, authors, year, expected, raw="raw", arxiv=None, doi=None):
        i = len(refs)
        refs.append((i, raw, arxiv, doi, title, authors, year, "k"))
        truth[i] = expected

    for i, x in enumerate(papers[:40]):
        title = x[1]
        if i % 4 == 1:
            title = title.upper().replace("METHODS", "MEHTODS")
        if i % 4 == 2:
            title = title.replace("Methods", "Meth- ods").replace(" for ", " ")
        authors = [a.split()[1] for a in x[2]]
        ref(title if i % 4 != 3 else None, authors, int(x[3][:4]), x[0], raw=f"[3] {', '.join(authors)}: {x[1]}, Venue")
    for i in range(20):
        ref(f"Nothing of the Kind{i}: Unseen Matters about Topic{i}", ["Zed Zumbra"], 2011, None)
    ref("Equal Words in Equal Order for Equal Ends", ["H. Humbek"], 2019, "2101.00002")
    ref("Equal Words in Equal Order for Equal Ends", [], None, None)
    ref("A living bibliography of everything around", ["Ikrom, I."], 2015, "1501.00001")
    ref(papers[5][1], None, None, None, arxiv="2005.00005")
    ref(papers[5][1], None, None, None, doi="10.1/x")
    ref(None, None, None, None, raw=None)
    ref("", [None], None, None, raw="")
    ref("word " * 3000, ["A"], 2000, None)
    got = {
        r.ref_id: r.arxiv_id
        for r in linkage.linked(spark.createDataFrame(refs, REFS), p, reading).where("confidence >= 0.5").collect()
    }
    expected = {k: v for k, v in truth.items() if v}
    assert sum(got.get(k) == v for k, v in expected.items()) >= 0.95 * len(expected)
    assert all(truth[k] == v for k, v in got.items())


def test_empty_tables(spark):
    p, reading, _ = world(spark)
    none = spark.createDataFrame([], REFS)
    assert linkage.linked(none, p, reading).count() == 0
    one = spark.createDataFrame([(1, "r", None, None, "Some Title of a Work", ["A"], 2000, "k")], REFS)
    assert linkage.linked(one, p.limit(0), reading.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("stored", "words"), [("The {D}eep- er End-to-end", "the deeper endtoend"), (None, None), ("—", "")]
)
def test_plain_titles(spark, stored, words):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(stored,)], "t string")
    assert df.select(linkage.plain(F.col("t")).alias("x")).first().x == words


def test_a_title_of_many_papers(spark):
    same = [(f"21{i:02d}.{i:05d}", "Report of the Annual Meeting", [f"Name{chr(97 + i % 26)}{chr(97 + i // 26)}x Zub"], "2020-01-01", "1", 1) for i in range(80)]
    copies = [(f"2201.{i:05d}", "Notes on Copies of One Work", ["Same Author"], "2021-01-01", "1", 1) for i in range(90)]
    p, reading, _ = world(spark)
    p = p.unionByName(spark.createDataFrame([*same, *copies], PAPERS))
    refs = [
        (1, "r", None, None, "Report of the Annual Meeting", ["Namecax Zub"], 2020, "k"),
        (2, "r", None, None, "Report of the Annual Meeting", [], 2020, "k"),
        (3, "r", None, None, "Notes on Copies of One Work", ["Same Author"], 2021, "k"),
    ]
    out = linkage.linked(spark.createDataFrame(refs, REFS), p, reading).collect()
    assert {r.ref_id: r.arxiv_id for r in out if r.confidence >= 0.5} in ({1: "2102.00002"}, {})
    assert max([r.confidence for r in out if r.ref_id == 3], default=0) < 0.5


def test_incidental_rare_words_do_not_hide_the_title(spark):
    p, reading, _ = world(spark)
    same = [(f"23{i:02d}.{i:05d}", f"Annual Report on Deep Sea Currents Part{i}", [f"Nam{chr(97 + i)}x Zub{chr(97 + i)}"], f"{1990 + i}-01-01", "1", 1) for i in range(20)]
    rare = [("2401.00001", "Quorvex of Another Matter", ["Oli Ovik"], "2001-01-01", "1", 1), ("2401.00002", "Plimmet in Yet Another Matter", ["Pia Pavik"], "2002-01-01", "1", 1), ("2401.00003", "Zandrik at Some Other Place", ["Qi Quvik"], "2003-01-01", "1", 1)]
    p = p.unionByName(spark.createDataFrame([*same, *rare], PAPERS))
    raw = "[7] Quorvex, Plimmet, Zandrik: Annual Report on Deep Sea Currents"
    refs = [(1, raw, None, None, None, ["Namfx Zubf"], 1995, "k"), (2, raw + ".", None, None, None, ["Namfx Zubf"], None, "k")]
    records = linkage.paper_records(p, reading).cache()
    _, profiles = linkage.reference_profiles(spark.createDataFrame(refs, REFS))
    first = linkage.compared(linkage.candidates(profiles, records), profiles, records)
    assert "2305.00005" not in {r.arxiv_id for r in first.collect()}
    got = {r.ref_id: r.arxiv_id for r in linkage.linked(spark.createDataFrame(refs, REFS), p, reading).collect()}
    assert got == {1: "2305.00005", 2: "2305.00005"}


def test_one_agreement_singles_out_a_paper_of_a_common_title(spark):
    p, reading, _ = world(spark)
    same = [(f"25{i:02d}.{i:05d}", "Report of the Yearly Findings", [f"Nam{chr(97 + i)}x Zub{chr(97 + i)}"], f"{1980 + 2 * i}-01-01", "1", 1) for i in range(20)]
    p = p.unionByName(spark.createDataFrame(same, PAPERS))
    refs = [
        (1, "r", None, None, "Report of the Yearly Findings", [], 1990, "k"),
        (2, "r", None, None, "Report of the Yearly Findings", ["Zubh"], None, "k"),
        (3, "r", None, None, "Report of the Yearly Findings", ["Zubt"], 2020, "k"),
    ]
    for ref, paper in zip(refs, ("2505.00005", "2507.00007", "2519.00019")):
        out = linkage.linked(spark.createDataFrame([ref], REFS), p, reading).collect()
        assert {r.ref_id: r.arxiv_id for r in out} == {ref[0]: paper}


def test_a_title_of_large_blocks_of_each_author_has_all_its_papers(spark):
    p, reading, papers = world(spark)
    title = "Report of the Yearly Findings"
    same = [(f"{26 + k}{i % 12 + 1:02d}.{i:05d}", title, [f"Nam{chr(97 + i % 26)}{chr(97 + i // 26)}x {name}"], f"{1980 + i % 30}-01-01", "1", 1) for k, name in enumerate(("Zubrin", "Kexholm")) for i in range(40)]
    both = ("2801.00001", title, ["Oli Zubrin", "Pia Kexholm"], "1990-01-01", "1", 1)
    p = p.unionByName(spark.createDataFrame([*same, both], PAPERS))
    refs = [(1, "r", None, None, title, ["Zubrin", "Kexholm"], None, "k")]
    refs += [(10 + i, "r", None, None, x[1], [a.split()[1] for a in x[2]], int(x[3][:4]), "k") for i, x in enumerate(papers)]
    r = spark.createDataFrame(refs, REFS)
    got = {x.ref_id: x.arxiv_id for x in linkage.linked(r, p, reading).collect()}
    assert got.pop(1, None) in {x[0] for x in (*same, both)}
    assert got == {10 + i: x[0] for i, x in enumerate(papers)}
    records = linkage.paper_records(p, reading).cache()
    profiles = linkage.reference_profiles(r.where("ref_id = 1"))[1]
    assert [x.arxiv_id for x in linkage.candidates(profiles, records).collect()] == [None]
    every = linkage.compared(linkage.further_candidates(profiles, records), profiles, records).collect()
    assert {x.arxiv_id for x in every} == {x[0] for x in (*same, both)}
    assert [x.arxiv_id for x in every if x.v_authors == 2] == ["2801.00001"]


def test_every_pair_with_words_enough_in_common_is_compared(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"word{i}" for i in range(25)]

    def text(most):
        return " ".join(rng.choice(vocabulary, size=rng.integers(1, most), replace=False))

    names = ["arber", "bellim", "crouth", "drazel"]
    papers = [(i, text(8), [["x", str(n)] for n in rng.choice(names, size=i % 3)], None, 1) for i in range(150)]
    asked = [(i, text(12), i % 4 == 0, [[str(n)] for n in rng.choice(names, size=i % 2)], False, None) for i in range(60)]
    uses = Counter(w for x in papers for w in x[1].split())
    expected = set()
    for q, t, whole, by, *_ in asked:
        for d, title, held, *_ in papers:
            a, b = set(t.split()), set(title.split())
            of_paper, of_ref = len(a & b) / len(b), len(a & b) / len(a)
            author = {n for x in by for n in x} & {x[-1] for x in held}
            rare = {w for w in a if uses[w] == min(uses[w] for w in a)} & b
            if of_paper >= 0.6 or (of_ref >= 0.6 and not whole) or (of_paper >= 0.4 and (author or rare)) or t.replace(" ", "") == title.replace(" ", ""):
                expected.add((q, d))
    left = spark.createDataFrame(asked, "profile int, text string, whole boolean, names array<array<string>>, et_al boolean, year int")
    held = spark.createDataFrame(papers, "arxiv_id int, title string, names array<array<string>>, year int, copies int")
    for sizes in ((100_000, 250_000), (7, 40)):
        found = linkage.further_candidates(left, held, *sizes).collect()
        assert {(r.profile, r.arxiv_id) for r in found} == expected and len(found) == len(expected) > 300


def test_confidence_is_calibrated_on_masked_references(spark):
    from conftest import SF_DIR
    from pyspark.sql import functions as F

    refs, papers, reading = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("parsed_refs", "papers", "reading_list"))
    known = papers.select("arxiv_id").union(reading.select("arxiv_id")).distinct().select(F.col("arxiv_id").alias("truth"))
    masked = refs.where("arxiv_id is not null")
    truth = masked.select("ref_id", F.regexp_replace("arxiv_id", r"v\d+$", "").alias("truth")).join(known, "truth")
    blind = masked.withColumns({c: F.lit(None).cast("string") for c in ("arxiv_id", "doi")})
    out = linkage.linked(blind, papers, reading).join(truth, "ref_id", "left").select(
        "confidence", F.coalesce(F.col("truth") == F.col("arxiv_id"), F.lit(False)).alias("right")
    )
    table = {
        r.tenth: (r.n, r.share)
        for r in out.groupBy(F.floor(F.least(F.col("confidence"), F.lit(0.99)) * 10).alias("tenth"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("right").cast("int")).alias("share"))
        .collect()
    }
    assert table[9][1] >= 0.97 and table[9][0] >= 0.95 * truth.count()
    assert table.get(0, (0, 0.0))[1] <= 0.1


def test_pairs_work_out_their_words_once(spark):
    p, reading, papers = world(spark)
    refs = spark.createDataFrame([(1, "raw", None, None, papers[0][1], ["Arber"], 2015, "k"), (2, "raw", None, None, papers[1][1], [], 2001, "k")], REFS)
    _, profiles = linkage.reference_profiles(refs)
    records = linkage.paper_records(p, reading)
    pairs = profiles.select("profile").crossJoin(records.select("arxiv_id"))
    found = linkage.compared(pairs, profiles, records)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the words in common are no condition of a join, which would work them out anew for each of its parts
    assert not [line for line in plan.splitlines() if "Join" in line and "array_intersect" in line]
    whole = {r.arxiv_id for r in found.where("v_title = 2").collect()}
    assert whole == {papers[0][0], papers[1][0]}
    assert found.count() < pairs.count()
