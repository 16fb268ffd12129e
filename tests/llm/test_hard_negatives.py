"""Dual-tree mining against a search of all rows, and how many pairs of blocks it looks at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import hard_negatives as hn

KIND = "vec_id long, label int, embedding array<double>, anchor boolean"


def brute(rows, positives=5, negatives=3, low=50, high=95, scale=256):
    """All results in plain integers; rows are (vec_id, label, vector, anchor)."""
    good = []
    for vec_id, label, v, anchor in rows:
        if vec_id is None or label is None or not v or any(c is None or not np.isfinite(c) for c in v):
            continue
        x = [int(np.floor(c * scale)) for c in v]
        if max(map(abs, x)) <= hn.entry_limit(len(x)):
            good.append((vec_id, label, x, anchor))
    out = []
    for at, (vec_id, label, x, anchor) in enumerate(good):
        if not anchor:
            continue
        scored = [(-sum(p * q for p, q in zip(x, o[2])), o[0], k, o[1]) for k, o in enumerate(good) if k != at and len(o[2]) == len(x)]
        scored.sort(key=lambda s: s[:2])
        other = [s for s in scored if s[3] != label]
        for p in [s for s in scored if s[3] == label][:positives]:
            fit = [n for n in other if low * -p[0] <= 100 * -n[0] <= high * -p[0]]
            out += [(vec_id, p[1], r + 1, n[1], -p[0], -n[0]) for r, n in enumerate(fit[:negatives])]
    return sorted(out)


def clustered(n, dim, seed, spread=0.05, labels=5):
    """Rows in groups, so that many pairs score within the windows."""
    rng = np.random.default_rng(seed)
    heads = rng.standard_normal((12, dim))
    return [(k, int(rng.integers(0, labels)), (heads[int(rng.integers(0, 12))] + spread * rng.standard_normal(dim)).tolist(), k % 9 == 0) for k in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_equals_brute_force(spark, spread):
    rows = clustered(700, 6, 3, spread)
    got = hn.hard_negatives(spark.createDataFrame(rows, KIND), block_rows=24, anchor_rows=8)
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500
    assert got.schema.simpleString() == spark.createDataFrame([], hn.MINED).schema.simpleString()


def test_odd_rows(spark):
    rows = clustered(120, 4, 5)
    rows += [(k, 1, rows[3][2], k % 2 == 0) for k in range(200, 260)]  # copies: ties by the smaller id
    rows += [(3, rows[3][1], rows[3][2], True)] * 2  # whole rows that repeat
    rows += [(300, None, rows[0][2], True), (301, 1, None, True), (302, 1, [1.0, None, 1.0, 1.0], True), (303, 1, [float("nan")] * 4, True), (304, 1, [float("inf")] * 4, True), (305, 1, [1e300] * 4, True)]
    rows += [(306, 1, [], True), (307, 1, [0.0] * 4, True), (None, 1, rows[0][2], True), (308, 2, [1.0, 2.0], True), (309, 2, [1.0, 2.5], True), (310, 3, [0.75, 1.5], None)]
    rows += [(400, 1, [4e6, 1.0, -3e6, 2.0], True), (401, 1, [4.1e6, 1.0, -3e6, 2.0], False), (402, 2, [3e6, 7.0, -2e6, 5.0], False)]  # beyond 2^53
    clash = {c: F.lit("clash") for c in ("rid", "x", "dim", "path", "block", "root", "n", "score", "rank")}
    got = hn.hard_negatives(spark.createDataFrame(rows, KIND).withColumns(clash), block_rows=8, anchor_rows=8)
    want = brute([(*r[:3], bool(r[3])) for r in rows])
    assert sorted(map(tuple, got.collect())) == want
    assert {w[0] for w in want} >= {3, 200, 308, 400}


def test_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    assert hn.hard_negatives(none).count() == 0
    without = spark.createDataFrame([(*r[:3], False) for r in clustered(50, 4, 1)], KIND)
    assert hn.hard_negatives(without, block_rows=8).count() == 0


def test_whole_groups_are_dropped_by_bounds(spark):
    rows = clustered(3000, 3, 8, 0.01)
    df = hn.whole_rows(spark.createDataFrame(rows, KIND), 256).where("dim = 3")
    x = np.array(df.select("x").toArrow().column("x").to_pylist())
    filed = hn.materialise(hn.filed(df, hn._split(x, 7), 7), "filed").withColumns({"lows": F.array(F.lit(hn.LEAST)), "highs": F.array(F.lit(hn.MOST))})
    anchors = hn.blocks(filed.where("anchor"), 7, 4, True, 3, "anchors")
    candidates = hn.blocks(filed, 7, 16, True, 3, "candidates")
    found = hn.meeting(hn.nodes(anchors, True, 3, "a"), hn.nodes(candidates, True, 3, "c"), 7, 6, True)
    all_pairs = anchors.select("root").join(candidates.select("root"), "root").count()
    print(found.count(), all_pairs)
    assert found.count() < all_pairs / 3
    assert candidates.agg(F.sum("n")).first()[0] == len(rows)
