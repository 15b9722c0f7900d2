import numpy as np

from lexigraph.llm import nearest


def vectors(seed=1, n=900):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 64))
    data = centres[rng.integers(0, 12, n)] + 0.6 * rng.standard_normal((n, 64))
    data[1::60] = data[::60][: len(data[1::60])] + 0.02 * rng.standard_normal((len(data[1::60]), 64))
    return data.astype(np.float32)


def frame(spark, data, extra=()):
    rows = [(f"c{i:04d}", [float(x) for x in v], 1) for i, v in enumerate(data)]
    return spark.createDataFrame([*rows, *extra], "chunk_id string, embedding array<float>, vkey int")


def test_recall_against_brute_force(spark):
    data = vectors()
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -2)
    truth = np.argsort(-scores, axis=1)[:, :5]
    found = {}
    for r in nearest.nearest_chunks(frame(spark, data)).collect():
        found.setdefault(r.chunk_id, set()).add(r.neighbour)
    hits = sum(f"c{j:04d}" in found[f"c{i:04d}"] for i, row in enumerate(truth) for j in row)
    assert hits / truth.size >= 0.9
    assert all(len(v) == 5 for v in found.values())
    exact = {
        (f"c{min(i, j):04d}", f"c{max(i, j):04d}")
        for i, row in enumerate(truth)
        for j in row
        if scores[i, j] >= 0.9 and i in truth[j]
    }
    got = {(r.chunk_id_a, r.chunk_id_b) for r in nearest.mutual_pairs(frame(spark, data), 0.9).collect()}
    assert got == exact and len(exact) >= 15


def test_unusable_rows_and_copies(spark):
    data = vectors(2, 40)
    same = [(f"s{i:02d}", [float(x) for x in data[0]], 1) for i in range(9)]
    bad = [("n", None, 1), ("z", [0.0] * 64, 1), ("k", [1.0] * 63, 1), ("e", [float("nan")] * 64, 1), (None, [1.0] * 64, 1), ("m", [None] + [1.0] * 63, 1)]
    df = frame(spark, data, [*same, *same, *bad])
    lists = {}
    for r in nearest.nearest_chunks(df, 3).collect():
        lists.setdefault(r.chunk_id, []).append((r.rank, r.neighbour))
    assert set(lists) == {f"c{i:04d}" for i in range(40)} | {f"s{i:02d}" for i in range(9)}
    assert [n for _, n in sorted(lists["s05"])] == ["c0000", "s00", "s01"]
    assert [n for _, n in sorted(lists["c0000"])] == ["s00", "s01", "s02"]
    pairs = {(r.chunk_id_a, r.chunk_id_b) for r in nearest.mutual_pairs(df, 0.9, 3).collect()}
    assert {("c0000", "s00"), ("s00", "s01")} <= pairs and not any("s05" in p for p in pairs)


def test_few_and_no_vectors(spark):
    assert nearest.nearest_chunks(frame(spark, [])).count() == 0
    assert nearest.mutual_pairs(frame(spark, []), 0.9).count() == 0
    assert nearest.nearest_chunks(frame(spark, vectors(3, 2))).count() == 2


def test_cell_search_finds_what_is_there():
    data = vectors(4, 300)
    unit = nearest._unit(data)
    ids, cosines, _ = nearest.search_cell(unit, np.arange(300), unit, np.arange(300), 5)
    truth = unit @ unit.T
    np.fill_diagonal(truth, -2)
    best = np.sort(truth, axis=1)[:, -5:].sum()
    assert (ids >= 0).all() and cosines.sum() >= 0.98 * best


def test_few_pairs_are_verified():
    data = vectors(5, 3000)
    unit = nearest._unit(data)
    keys = np.arange(3000)
    ids, _, verified = nearest.search_cell(unit[:400], keys[:400], unit, keys, 5)
    scores = unit[:400] @ unit.T
    scores[keys[:400], keys[:400]] = -2
    truth = np.argsort(-scores, axis=1)[:, :5]
    hits = sum(len(set(a) & set(b)) for a, b in zip(ids.tolist(), truth.tolist(), strict=True))
    assert hits >= 0.9 * truth.size
    assert verified < 0.15 * 400 * 3000


def test_bits_are_counted_like_numbers():
    rng = np.random.default_rng(6)
    bits = rng.integers(0, 2, (64, 5, 128)).astype(np.uint8)
    sets = [np.packbits(x, axis=1, bitorder="little").view(np.uint64) for x in bits]
    planes = nearest._counted([x.copy() for x in sets])
    for least in (1, 31, 40, 64):
        got = np.unpackbits(nearest._at_least(planes, least).view(np.uint8), axis=1, bitorder="little")
        assert (got == (bits.sum(axis=0) >= least)).all()
