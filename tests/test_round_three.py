"""Results on odd and dense inputs, held against plain loops."""

import numpy as np

from meridia.functions.shapes import Tri
from meridia.functions.vectors import Vec, held


def test_weights_of_small_and_flat_triangles(spark):
    """A triangle has weights whatever its size; one whose sides are parallel has none."""
    rows = [(k, 0.0, 0.0, 0.0, s, 0.0, 0.0, 0.0, s * h, 0.0) for k, (s, h) in enumerate([(1.0, 1.0), (1e-2, 1e-2), (1e-6, 1.0), (1e-9, 0.5), (1e6, 1e-3)])]
    rows += [(9, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0), (10, *[0.5] * 9)]
    df = spark.createDataFrame(rows, "idx long, " + ", ".join(f"{p}{a} double" for p in "abc" for a in "xyz"))
    t = Tri(*(Vec.columns(p) for p in "abc"))
    df, centre = held(df, centre=t.centroid())
    df, foot = held(df, foot=t.foot(centre))
    found = df.select("idx", *t.barycentric(centre), t.closest(centre, foot).distance(centre)).collect()
    for k, u, v, w, off in found:
        assert (k > 8 and u is None) or (np.allclose([u, v, w], 1 / 3) and off < 1e-9), k


def test_welding_lists_no_pairs(spark, monkeypatch):
    """Twelve thousand vertices in a few dense spots: what is written stays below their number, and the order decides."""
    from meridia.operators import mesh

    tables, plain = [], mesh.written
    monkeypatch.setattr(mesh, "written", lambda df, name: (tables.append(out := plain(df, name)), out)[1])
    rng = np.random.default_rng(1)
    at = rng.normal(0, 0.02, (12_000, 3)) + rng.choice([0.0, 0.05, 0.3], (12_000, 1))
    v = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(at)] + [(0, 12_000, float("nan"), 0.0, 0.0)], "mesh_id int, v_idx long, x double, y double, z double")
    stay, want = np.zeros(len(at), dtype=bool), []
    for k, p in enumerate(at):
        near = np.nonzero(stay & (np.sqrt(((at - p) ** 2).sum(1)) <= 0.06))[0]
        stay[k] = not len(near)
        want.append((k, int(near[0]) if len(near) else k))
    for block in (100, 5_000):
        tables.clear()
        got = sorted((r["v_idx"], r["rep"]) for r in mesh._first_within(v, 0.06, block).collect())
        assert got == [*want, (12_000, 12_000)]
        assert max(t.count() for t in tables) <= 12_000


def test_nearest_points_begin_with_cells_that_hold_few(spark):
    from meridia.operators import cloud

    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(0, 0.01, (3_000, 3)), np.full((2_000, 3), 0.5), rng.uniform(5, 9, (20, 3))])
    q = np.concatenate([rng.normal(0, 0.012, (200, 3)), rng.uniform(-3, 9, (20, 3)), [[0.5, 0.5, 0.51]]])
    of = lambda x: spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "idx long, x double, y double, z double")
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(2))
    got = {r["q_idx"]: (r["idx"], r["distance"]) for r in cloud.nearest_each(of(q), of(p), 0.08).collect()}
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(d.argmin(1).tolist()))
    assert np.allclose([got[k][1] for k in range(len(q))], d.min(1))
    points = of(p).dropDuplicates(["x", "y", "z"])
    edge = cloud._fine(points, 0.08)
    assert edge < 0.01 and cloud._fine(of(p[-20:]), 0.08) == 0.08


def test_sweep_pairs_are_not_compared_by_slices(spark):
    """Boxes of one slice along x that lie apart along y don't meet in one key."""
    from meridia.operators import spatial

    df = spark.range(60_000).selectExpr("id AS idx", "0D AS lo_x", "id * 2D AS lo_y", "0D AS lo_z", "1D AS hi_x", "id * 2D + IF(id % 1000 = 0, 3, 1) AS hi_y", "1D AS hi_z")
    found = spatial.sweep_pairs(df, 4.0)
    assert sorted(map(tuple, found.collect())) == [(k, k + 1) for k in range(0, 60_000, 1000)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "cy" in plan and "cz" in plan


def test_workflows_are_parsed_once(spark, monkeypatch):
    """Several reads of the same texts take apart one written table."""
    from meridia.operators import workflow

    seen, plain = [], workflow.parsed
    monkeypatch.setattr(workflow, "parsed", lambda w: (seen.append("json" in w.columns), plain(w))[1])
    rows = spark.createDataFrame([(1, '{"nodes":[{"id":1,"inputs":[{"type":"image","link":7}]}],"links":[[5,1,0,2,0,"bool"],[5,1,0,2,0,"bool"]]}'), (2, "no")], "workflow long, json string")
    found = sorted(map(tuple, workflow.problems(rows).collect()))
    assert found == [(1, "input_without_link", "1"), (1, "link_without_node", "5"), (1, "repeated_link", "5")] and seen.count(True) == 1
    assert [tuple(r) for r in workflow.socket_types(rows).collect()] == [(1, ["IMAGE"], [], ["BOOLEAN"])] and seen.count(True) == 2


def test_tiles_are_no_groups_of_their_own(spark, monkeypatch):
    """Tiles with their halos come as a sorted stream, many in a task, and give each tile once."""
    from meridia.operators import edges

    plans, plain = {}, edges.written
    monkeypatch.setattr(edges, "written", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), plain(df, name))[1])
    kind = "video int, frame long, height int, width int, top int, left int, edges binary"
    tiles = spark.createDataFrame([(0, f, 4, 3, 0, 0, bytes(12)) for f in range(30)], kind)
    found = edges.grown(tiles, 4, 3)
    assert sorted(r["frame"] for r in found.collect()) == list(range(30))
    assert "FlatMapGroups" not in plans["grown"] and "MapInArrow" in plans["grown"]


def test_listed_boxes_are_shuffled_once(spark, monkeypatch):
    """Crowded cells, dealt out on both sides, go once through a shuffle and give each pair once."""
    from meridia.operators import spatial

    monkeypatch.setattr(spatial, "CROWD", 40)
    rng = np.random.default_rng(8)
    at, half = rng.uniform(0, 3, (500, 3)), np.where(np.arange(500) % 50 == 0, 2.0, 0.3)
    df = spark.createDataFrame([(k, *map(float, p - h), *map(float, p + h)) for k, (p, h) in enumerate(zip(at, half))], "idx long, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    found = spatial.overlap_pairs(df, cell=0.6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    far = np.abs(at[:, None] - at[None]).max(2)
    want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(far < half[:, None] + half[None]))) if i < j}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) > 2_000 and set(got) == want
