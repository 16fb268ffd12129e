"""Searches of meshes against plain loops, and welding of long chains in few rounds."""

import numpy as np
import pytest

from meridia.operators import mesh

V = "mesh_id int, v_idx long, x double, y double, z double"
T = "mesh_id int, t_idx long, a long, b long, c long"


def soup(n=900, seed=1):
    """Triangles here and there, some of them flat, some without extent, in two meshes."""
    rng = np.random.default_rng(seed)
    middle = rng.uniform(-5, 5, (n, 1, 3))
    corners = middle + rng.uniform(-0.7, 0.7, (n, 3, 3))
    corners[::50, 2] = corners[::50, 0] * 0.25 + corners[::50, 1] * 0.75
    corners[7] = corners[7, 0]
    corners[:, :, 2] *= 0.4
    return corners


def tables(spark, corners):
    vertices = [(int(k % 2), 3 * k + j, *map(float, p)) for k, t in enumerate(corners) for j, p in enumerate(t)]
    triangles = [(int(k % 2), k, 3 * k, 3 * k + 1, 3 * k + 2) for k in range(len(corners))]
    return spark.createDataFrame(vertices, V), spark.createDataFrame(triangles, T)


def distance(p, t):
    """From a point to a triangle: inside of its plane, or to the nearest of its sides."""
    a, b, c = t
    out = min(np.linalg.norm(p - u - np.clip(np.dot(p - u, v - u) / max(np.dot(v - u, v - u), 1e-300), 0, 1) * (v - u)) for u, v in ((a, b), (b, c), (c, a)))
    n = np.cross(b - a, c - a)
    if np.linalg.norm(n) > 1e-9:
        h = np.dot(p - a, n) / np.dot(n, n)
        f = p - h * n
        if all(np.dot(np.cross(v - u, f - u), n) >= 0 for u, v in ((a, b), (b, c), (c, a))):
            out = min(out, np.linalg.norm(p - f))
    return out


def test_nearest_points_equal_a_plain_search(spark):
    corners = soup()
    rng = np.random.default_rng(2)
    places = rng.uniform(-7, 7, (60, 3))
    queries = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(places)], "query long, qx double, qy double, qz double")
    got = {(r["query"], r["mesh_id"]): r for r in mesh.closest_points(queries, *tables(spark, corners)).collect()}
    assert len(got) == 120
    for (q, m), r in got.items():
        far = [distance(places[q], t) for t in corners[m::2]]
        assert r["distance"] == pytest.approx(min(far), abs=1e-9) and far[(r["t_idx"] - m) // 2] == pytest.approx(min(far), abs=1e-9)
        assert np.linalg.norm(places[q] - [r["x"], r["y"], r["z"]]) == pytest.approx(min(far), abs=1e-9)


def test_ray_hits_equal_a_plain_search_without_a_product(spark):
    corners = soup(seed=3)
    rng = np.random.default_rng(4)
    origins, directions = rng.uniform(-6, 6, (80, 3)), rng.standard_normal((80, 3))
    rays = spark.createDataFrame([(k, *map(float, o), *map(float, d)) for k, (o, d) in enumerate(zip(origins, directions))], "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    found = mesh.ray_hits(rays, *tables(spark, corners))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {(r["ray"], r["t_idx"]): r["distance"] for r in found.collect()}
    want = {}
    for k, (o, d) in enumerate(zip(origins, directions)):
        d = d / np.linalg.norm(d)
        for j, (a, b, c) in enumerate(corners):
            m = np.column_stack([b - a, c - a, -d])
            if abs(np.linalg.det(m)) > 1.2e-7:
                u, v, t = np.linalg.solve(m, o - a)
                if u >= -1e-7 and v >= -1e-7 and u + v <= 1 + 1e-7 and t >= 0:
                    want[k, j] = t
    assert got == pytest.approx(want) and len(want) > 25


def test_empty_meshes(spark):
    v, t = spark.createDataFrame([], V), spark.createDataFrame([], T)
    rays = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    assert mesh.ray_hits(rays, v, t).count() == 0
    assert mesh.closest_points(rays.selectExpr("ray AS query", "ox AS qx", "oy AS qy", "oz AS qz"), v, t).count() == 0


def first_within(points, epsilon):
    out = {}
    for k, p in enumerate(points):
        out[k] = next((u for u in range(k) if out[u] == u and np.linalg.norm(points[u] - p) <= epsilon), k)
    return out


@pytest.mark.parametrize("block", [1, 20, 10_000])
def test_welding_in_blocks_equals_the_order(spark, block):
    points = np.random.default_rng(6).uniform(0, 1, (250, 3))
    v = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(points)], V)
    got = {r["v_idx"]: r["rep"] for r in mesh._first_within(v, 0.2, block).collect()}
    assert got == first_within(points, 0.2)


def test_a_long_strip_takes_few_rounds(spark, monkeypatch):
    rounds, plain = [], mesh.written
    monkeypatch.setattr(mesh, "written", lambda df, name: (rounds.append(name), plain(df, name))[1])
    v = spark.range(100_000).selectExpr("0 AS mesh_id", "id AS v_idx", "id * 0.01D AS x", "0D AS y", "0D AS z")
    got = mesh._first_within(v, 0.0101)
    assert got.where("rep = v_idx").count() == 50_000 and got.count() == 100_000
    assert rounds.count("decided") < 20


def test_leaves_of_a_dense_spot_hold_few_triangles(spark):
    """A spot of many triangles among others far apart is cut until few share a leaf; equal ones end the cutting."""
    rng = np.random.default_rng(9)
    middle = np.concatenate([rng.uniform(0, 1, (1500, 3)), np.linspace([0.0] * 3, [4000.0] * 3, 500)])
    corners = middle[:, None] + rng.uniform(-0.02, 0.02, (2000, 3, 3))
    shared = lambda rows: rows.groupBy("code").count().selectExpr("sum(count * count) / sum(count)").first()[0]
    rows, depth = mesh._tree(*tables(spark, corners), [])
    assert shared(rows) <= mesh.LEAF and rows.count() == 2000 and depth <= mesh.DEEPEST
    same, depth = mesh._tree(*tables(spark, np.repeat(corners[:1], 100, axis=0)), [])
    assert shared(same) == 100 and depth == mesh.STEP
