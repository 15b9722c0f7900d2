import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraph.llm import mixing, packing, tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.integers(0, 2))
def test_no_container_overflows(lengths, separator):
    lengths = np.array(lengths, np.int64)
    where, place = packing.pack(lengths, 64, separator)
    for c in set(where.tolist()):
        held = lengths[where == c]
        assert held.sum() + separator * (len(held) - 1) <= 64
        assert sorted(place[where == c].tolist()) == list(range(len(held)))


def test_exact_complements_leave_nothing_unused():
    lengths = np.array([60, 4, 50, 7, 7, 40, 10, 9, 5, 64])
    where, _ = packing.pack(lengths, 64, 0)
    assert len(set(where.tolist())) == 4


def test_close_to_the_bound():
    rng = random.Random(5)
    lengths = np.array([rng.randrange(1, 200) for _ in range(4000)])
    where, _ = packing.pack(lengths, 512, 1)
    assert len(set(where.tolist())) <= 1.005 * -(-(lengths + 1).sum() // 513)


def test_packed_documents(spark):
    sized = spark.createDataFrame([(1, 10), (2, 0), (3, 25), (4, 6), (5, 4), (6, None)], "doc_id bigint, n_tokens int")
    budgets = spark.createDataFrame([("a", 10, 0), ("b", 40, 1), ("c", 0, 0), ("d", 8, None)], "budget_name string, capacity_tokens int, separator_tokens int")
    out = packing.packed(sized, budgets)
    rows = out.collect()
    for name, capacity in (("a", 10), ("b", 40), ("d", 8)):
        mine = [r for r in rows if r.budget_name == name]
        assert {d: sum(r.tokens for r in mine if r.doc_id == d) for d in (1, 3, 4, 5)} == {1: 10, 3: 25, 4: 6, 5: 4}
        assert max(r.tokens for r in mine) <= capacity
        keys = [(r.doc_id, r.piece_no) for r in mine]
        assert len(keys) == len(set(keys))
    assert not [r for r in rows if r.budget_name == "c"]
    report = {r.budget_name: r for r in packing.container_report(out, budgets).collect()}
    assert report["a"].unused_tokens == 5 and report["a"].containers == 5
    assert packing.packed(sized.limit(0), budgets).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([("Hello world",), ("",), (None,), ("x" * 20000,)], "t string")
    got = [r.n for r in df.select(tokens.token_count(F.col("t")).alias("n")).collect()]
    assert got[0] == 2 and got[1] == 0 and got[2] is None and got[3] > 0


SIZED = "doc_id bigint, source string, n_tokens int, extra int"
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def mix(spark, targets, n=3000, **options):
    rng = random.Random(6)
    rows = [(i, ("Big", "mid-size", " small ")[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2], rng.randrange(5, 60), 0) for i in range(n)]
    rows += [(n, None, 10, 0), (n + 1, "Big", 0, 0), (n + 2, "unlisted", 9, 0)]
    sized = spark.createDataFrame(rows, SIZED)
    t = spark.createDataFrame(targets, TARGETS)
    records = mixing.mixed(sized, t, **options)
    return records.collect(), {r.source: r for r in mixing.share_report(records, t).collect()}


def test_shares_are_reached_and_repeats_capped(spark):
    records, report = mix(spark, [("m", "big", 0.4, 1), ("m", "mid_size", 0.3, 2), ("m", "small", 0.3, 3)])
    for r in report.values():
        assert r.actual_share == pytest.approx(r.target_share, abs=0.01)
    uses = {}
    for r in records:
        uses.setdefault((r.source, r.doc_id), []).append(r.use)
    assert max(len(v) for (s, _), v in uses.items() if s == "big") == 1
    assert all(sorted(v) == list(range(len(v))) for v in uses.values())
    small = [len(v) for (s, _), v in uses.items() if s == "small"]
    assert max(small) <= 3 and max(small) - min(small) <= 1


def test_budget_truncates_and_missing_sources_are_reported(spark):
    records, report = mix(spark, [("m", "Big", 0.5, 1), ("m", "absent", 0.5, 9)], total_tokens=2000)
    assert 1900 < sum(r.n_tokens for r in records) <= 2000
    assert report["absent"].actual_share == 0 and report["big"].actual_share == 1


def test_more_than_there_is_lets_shares_drift(spark):
    records, report = mix(spark, [("m", "big", 0.1, 1), ("m", "small", 0.9, 1)], total_tokens=10**9)
    assert report["small"].most_uses == 1 and report["big"].actual_share > 0.5
    assert mix(spark, [("m", "absent", 1.0, 1)])[0] == []
