"""Operators that go by ranges, grids, blocks and folds, held against plain loops on random rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.operators import cloud, mesh, scenes, spatial, splats, tables, timeline

BOX = "idx long, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double"


def boxes(rng, n, first=0):
    """Boxes of sizes from a hundredth to a hundred."""
    low = rng.uniform(-50, 50, (n, 3))
    size = 10 ** rng.uniform(-2, 2, (n, 1)) * rng.uniform(0.5, 1, (n, 3))
    return [(first + k, *low[k].tolist(), *(low[k] + size[k]).tolist()) for k in range(n)]


def meet(a, b):
    return all(a[1 + k] < b[4 + k] and b[1 + k] < a[4 + k] for k in range(3))


def test_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(1)
    rows = boxes(rng, 300)
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and meet(a, b))
    df = spark.createDataFrame(rows, BOX)
    for cell in (0.5, 3.0, 500.0):
        assert sorted(map(tuple, spatial.overlap_pairs(df, cell=cell).collect())) == want
    assert sorted(map(tuple, spatial.sweep_pairs(df, 5.0).collect())) == want and len(want) > 100
    other = boxes(rng, 200, 100)
    want = sorted((a[0], b[0]) for a in rows for b in other if meet(a, b))
    assert sorted(map(tuple, spatial.overlap_pairs(df, spark.createDataFrame(other, BOX), cell=1.0).collect())) == want
    assert spatial.overlap_pairs(df.limit(0), cell=1.0).count() == 0


def test_no_plan_pairs_everything(spark):
    df = spark.createDataFrame(boxes(np.random.default_rng(2), 20), BOX)
    plan = spatial.overlap_pairs(df, cell=1.0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_points_near_and_far(spark):
    rng = np.random.default_rng(3)
    p, q = rng.uniform(0, 1, (200, 3)), np.concatenate([rng.uniform(0, 1, (50, 3)), rng.uniform(40, 50, (5, 3))])
    of = lambda x: spark.createDataFrame([(k, *v.tolist()) for k, v in enumerate(x)], "idx long, x double, y double, z double")
    got = {r["q_idx"]: (r["idx"], r["distance"]) for r in cloud.nearest_each(of(q), of(p), 0.05).collect()}
    d = np.linalg.norm(q[:, None] - p[None], axis=2)
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(d.argmin(1).tolist()))
    assert np.allclose([got[k][1] for k in range(55)], d.min(1))
    assert cloud.nearest_each(of(q), of(p).limit(0), 0.05).count() == 0


@pytest.mark.parametrize("n", [1, 2, 101, 1000])
def test_median_and_places(spark, n):
    rng = random.Random(n)
    values = [rng.choice([None, *range(40)]) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v long")
    known = sorted(v for v in values if v is not None)
    got = cloud.exact_upper_median(df, F.col("v")).first()["median"]
    assert got == (known[len(known) // 2] if known else None)
    order = sorted(range(n), key=lambda k: (values[k] is not None, values[k] or 0, k))
    placed = {r["place"]: r["k"] for r in tables.numbered(df, [F.col("v").asc_nulls_first(), "k"], "place").collect()}
    assert placed == dict(enumerate(order))


def random_mesh(spark, rng, n=60):
    points = rng.uniform(-1, 1, (n, 3))
    corners = np.array([rng.choice(n, 3, replace=False) for _ in range(120)])
    v = spark.createDataFrame([(k % 1, k, *p.tolist()) for k, p in enumerate(points)], "mesh_id int, v_idx long, x double, y double, z double")
    t = spark.createDataFrame([(0, k, *map(int, c)) for k, c in enumerate(corners)], "mesh_id int, t_idx long, a long, b long, c long")
    return points, corners, v, t


def test_rays_and_closest_points_of_a_tangle(spark):
    rng = np.random.default_rng(5)
    points, corners, v, t = random_mesh(spark, rng)
    origins, ways = rng.uniform(-2, 2, (40, 3)), rng.standard_normal((40, 3))
    rays = spark.createDataFrame([(k, *o.tolist(), *d.tolist()) for k, (o, d) in enumerate(zip(origins, ways))], "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    want = {}
    for k, (o, d) in enumerate(zip(origins, ways)):
        for n, (a, b, c) in enumerate(points[corners]):
            m = np.stack([b - a, c - a, -d], axis=1)
            if abs(np.linalg.det(m)) > 1e-9:
                u, w, s = np.linalg.solve(m, o - a)
                if u >= 0 and w >= 0 and u + w <= 1 and s >= 0:
                    want[k, n] = s * np.linalg.norm(d)
    got = {(r["ray"], r["t_idx"]): r["distance"] for r in mesh.ray_hits(rays, v, t).collect()}
    assert set(got) == set(want) and len(want) > 50
    lengths = {k: np.linalg.norm(d) for k, d in enumerate(ways)}
    assert all(np.isclose(got[k], want[k]) or np.isclose(got[k], want[k] / lengths[k[0]]) for k in want)
    queries = spark.createDataFrame([(k, *o.tolist()) for k, o in enumerate(origins)], "query long, qx double, qy double, qz double")
    found = {r["query"]: r for r in mesh.closest_points(queries, v, t).collect()}
    grid = np.array([(i / 60, j / 60) for i in range(61) for j in range(61 - i)])
    for k, o in enumerate(origins):
        a, b, c = (points[corners[:, n]] for n in range(3))
        spots = a[:, None] + grid[None, :, :1] * (b - a)[:, None] + grid[None, :, 1:] * (c - a)[:, None]
        near = np.linalg.norm(spots - o, axis=2).min()
        assert found[k]["distance"] <= near + 1e-9 and found[k]["distance"] >= near - 0.05
        assert np.isclose(np.linalg.norm(np.array([found[k][c] for c in "xyz"]) - o), found[k]["distance"])


def test_weld_keeps_the_first_found(spark):
    rng = np.random.default_rng(6)
    points = np.round(rng.uniform(0, 1, (150, 3)), 2)
    v = spark.createDataFrame([(0, k, *p.tolist()) for k, p in enumerate(points)], "mesh_id int, v_idx long, x double, y double, z double")
    t = spark.createDataFrame([(0, k, k, k + 1, k + 2) for k in range(148)], "mesh_id int, t_idx long, a long, b long, c long")
    kept, to = [], []
    for k, p in enumerate(points):
        rep = next((r for r in kept if np.linalg.norm(points[r] - p) <= 0.2), None)
        if rep is None:
            kept.append(k)
        to.append(k if rep is None else rep)
    vertices, triangles = mesh.welded(v, t, 0.2)
    assert sorted(r["v_idx"] for r in vertices.collect()) == kept and len(kept) < 120
    want = {(k, *(to[k + n] for n in range(3))) for k in range(148) if len({to[k + n] for n in range(3)}) == 3}
    assert {(r["t_idx"], r["a"], r["b"], r["c"]) for r in triangles.collect()} == want


def merged(frames, above, length):
    """The filter as it is defined, frame by frame."""
    last = since = None
    enabled = merging = False
    cuts = []
    for frame, up in zip(frames, above):
        before = frame if last is None else last
        far = frame - before >= length
        last = frame if up else before
        if merging and far and not up and last - since >= length:
            merging = False
            cuts.append(last)
        elif not merging and up and far:
            enabled = True
            cuts.append(frame)
        elif not merging and up and not far and enabled:
            merging, since = True, frame
    return cuts


def test_merging_sees_only_what_it_needs(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for video in range(30):
        frames = sorted(rng.sample(range(rng.randrange(5), 200), 120))
        above = [rng.random() < 0.15 for _ in frames]
        rows += [(f"v{video}", f, u) for f, u in zip(frames, above)]
        want |= {(f"v{video}", c) for c in merged(frames, above, 6)}
    df = spark.createDataFrame(rows, "video string, frame long, up boolean")
    assert {tuple(r) for r in scenes.merged_cuts(df, F.col("up"), 6).collect()} == want and len(want) > 60


def test_tracks_of_streamed_scenes(spark):
    rng = random.Random(8)
    rows = [(f"s{k % 5}", rng.randrange(40), k, rng.randrange(60), rng.randrange(40), 20, 15) for k in range(400)]
    want = {}
    for name in {r[0] for r in rows}:
        one = timeline._Greedy(2, 0.5)
        for r in sorted((r for r in rows if r[0] == name), key=lambda r: r[1:3]):
            one.add(r[1], *r[3:])
        want[name] = one.opened
    df = spark.createDataFrame(rows, "scene string, frame long, idx long, x long, y long, width long, height long")
    assert {r["scene"]: r["n_tracks"] for r in timeline.distinct_tracks(df).collect()} == want
    assert timeline.distinct_tracks(df.limit(0)).count() == 0


def test_layers_blend_in_runs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(k, *rng.uniform(0, 6, 2).tolist(), float(rng.uniform(1, 9)), float(rng.uniform(1, 4)), *rng.uniform(0, 1, 4).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "idx long, u double, v double, depth double, radius double, opacity double, r double, g double, b double")
    whole = {(r["px"], r["py"]): r for r in splats.render(df, 6, 6, (0.1, 0.2, 0.3)).collect()}
    monkeypatch.setattr(splats, "LAYERS", 3)
    runs = {(r["px"], r["py"]): r for r in splats.render(df, 6, 6, (0.1, 0.2, 0.3)).collect()}
    assert all(np.allclose([whole[k][c] for c in ("r", "g", "b", "alpha")], [runs[k][c] for c in ("r", "g", "b", "alpha")]) for k in whole) and len(runs) == 36
