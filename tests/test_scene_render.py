"""Scenes against a plain recursive drawing, deep and broken trees, and pieces of drawings."""

import math

import pytest
from pyspark.sql import functions as F

from meridia.operators import scene_render as sr

NODE = (
    "scene int, id long, parent long, k int, kind string, tx double, ty double, tz double, qx double, qy double, qz double, qw double, sx double, sy double, sz double,"
    f"fill {sr.COLOUR}, stroke {sr.COLOUR}, stroke_width double, opacity double, visible boolean, points array<struct<x:double,y:double,z:double>>, faces array<array<int>>,"
    "size struct<x:double,y:double,z:double>, radius double, closed boolean"
)
VIEW = "scene int, perspective boolean, eye struct<x:double,y:double,z:double>, target struct<x:double,y:double,z:double>, up struct<x:double,y:double,z:double>, field double, near double, far double, width int, height int"


def node(id_, parent, k, kind="group", t=(0, 0, 0), q=(0, 0, 0, 1), s=(1, 1, 1), fill=None, stroke=None, width=None, opacity=None, visible=None, points=(), faces=None, size=None, radius=None, closed=None):
    f = lambda v: tuple(map(float, v))
    return (0, id_, parent, k, kind, *f(t), *f(q), *f(s), fill, stroke, width, opacity, visible, [f(p) for p in points], faces, None if size is None else f(size), radius, closed)


def turn(q, v):
    n = math.sqrt(sum(c * c for c in q))
    x, y, z, w = (c / n for c in q)
    rows = [(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)), (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)), (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y))]
    return [sum(m * c for m, c in zip(row, v)) for row in rows]


def times(a, b):
    a, b = ([c / math.sqrt(sum(d * d for d in q)) for c in q] for q in (a, b))
    return (a[3] * b[0] + a[0] * b[3] + a[1] * b[2] - a[2] * b[1], a[3] * b[1] - a[0] * b[2] + a[1] * b[3] + a[2] * b[0], a[3] * b[2] + a[0] * b[1] - a[1] * b[0] + a[2] * b[3], a[3] * b[3] - a[0] * b[0] - a[1] * b[1] - a[2] * b[2])


def drawn(rows, near, far):
    """(depth, id, part, corners in pixels) from far to near: a camera at (0, 0, -5) that looks along z, 90 degrees, 100 by 100."""
    out = []

    def see(p):
        d = p[2] + 5
        return (50 - p[0] * 50 / d, 50 - p[1] * 50 / d, d) if near < d < far else None

    def walk(n, t, q, s):
        if n[19] is False:
            return
        at = [a + b for a, b in zip(t, turn(q, [c * d for c, d in zip(n[5:8], s)]))]
        q, s = times(q, n[8:12]), [a * b for a, b in zip(s, n[12:15])]
        points = n[20]
        if n[4] == "box":
            h = [c / 2 for c in n[22]]
            points = [tuple(c + d * e for c, d, e in zip(points[0], h, sign)) for sign in sr.BOX_CORNERS]
        bodies = [[points[k] for k in f] for f in (sr.BOX_FACES if n[4] == "box" else n[21])] if n[4] in ("box", "mesh") else [points]
        if n[4] != "group":
            for part, body in enumerate(bodies):
                seen = [see([a + b for a, b in zip(at, turn(q, [c * d for c, d in zip(p, s)]))]) for p in body]
                if all(seen) and (n[4] != "polyline" or len(seen) > 1):
                    out.append((sum(c[2] for c in seen) / len(seen), n[1], part, seen))
        for child in sorted((c for c in rows if c[2] == n[1]), key=lambda c: c[3]):
            walk(child, at, q, s)

    walk(next(r for r in rows if r[2] is None), (0, 0, 0), (0, 0, 0, 1), (1, 1, 1))
    return sorted(out, key=lambda o: -o[0])


def view(spark, near=0.1, far=100.0):
    return spark.createDataFrame([(0, True, (0.0, 0.0, -5.0), (0.0, 0.0, 0.0), (0.0, 1.0, 0.0), 90.0, near, far, 100, 100)], VIEW)


SCENE = [
    node(1, None, 0, t=(0.1, 0.2, 0), q=(0.1, 0.5, -0.2, 0.8), s=(1, 2, 0.5), fill=(1, 2, 3, 255)),
    node(2, 1, 1, "box", t=(0.3, 0, 0.4), q=(0.7, 0.1, 0.1, 0.6), s=(0.5, 1, 2), points=[(0.1, 0, 0)], size=(1, 0.6, 0.8), stroke=(9, 9, 9, 128), width=2.5),
    node(3, 1, 0, t=(-0.5, 0.1, 0.2), q=(0, 0, 1, 1), opacity=0.25),
    node(4, 3, 0, "mesh", s=(2, 1, 1), points=[(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 3)], faces=[[0, 1, 2], [0, 2, 3]]),
    node(5, 3, 1, "polyline", points=[(0, 0, 0), (0.5, 0.5, 0), (1, 0, 1)], closed=True),
    node(6, 3, 2, "polyline", points=[(0, 0, 0)]),
    node(7, 3, 3, "line", points=[(0, 0, 0), (0, 0, -40)]),
    node(8, 1, 2, visible=False), node(9, 8, 0, "point", points=[(0, 0, 0)], radius=3.0, visible=True),
    node(10, 1, 3, "sphere", t=(0, -0.3, 0), points=[(0, 0, 0)], radius=0.4), node(11, 1, 4, "point", points=[(0.2, 0.1, 0)], radius=3.0),
    node(12, 77, 0, "point", points=[(0, 0, 0)], radius=1.0),
]


@pytest.mark.parametrize(("near", "far"), [(0.1, 100.0), (4.6, 5.4)])
def test_equals_a_recursive_drawing(spark, near, far):
    nodes, cameras = spark.createDataFrame(SCENE, NODE), view(spark, near, far)
    seen = sr.projected(sr.primitives(sr.placed(nodes)), cameras)
    got = [(r["depth"], r["id"], r["part"], r["corners"]) for r in sr.in_painters_order(seen).orderBy("layer").collect()]
    want = drawn(SCENE, near, far)
    assert [g[1:3] for g in got] == [w[1:3] for w in want] and len(want) > 5
    for g, w in zip(got, want):
        assert g[0] == pytest.approx(w[0]) and all(tuple(a) == pytest.approx(b) for a, b in zip(g[3], w[3]))


def test_styles_are_inherited_and_drawn(spark):
    nodes = spark.createDataFrame(SCENE, NODE)
    got = {r["id"]: r for r in sr.markup(sr.projected(sr.primitives(sr.placed(nodes)), view(spark))).where("part = 0").collect()}
    assert set(got) == {2, 4, 5, 10, 11}
    assert 'fill="#010203" fill-opacity="1" stroke="#090909" stroke-opacity="0.502" stroke-width="2.5" opacity="1"' in got[2]["svg"]
    assert 'stroke="#191919" stroke-opacity="1" stroke-width="1" opacity="0.25"' in got[4]["svg"] and got[4]["svg"].startswith("<polygon points=")
    # a sphere's pixels: radius by the larger of the first two scales, over the distance
    assert got[10]["radius"] == pytest.approx(0.4 * 2 * 50 / got[10]["depth"]) and got[11]["radius"] == 3.0


def test_drawings_join_to_one_file(spark):
    nodes = spark.createDataFrame(SCENE, NODE)
    seen, cameras = sr.projected(sr.primitives(sr.placed(nodes)), view(spark)), view(spark)
    whole = [r["content"] for r in sr.drawings(seen, cameras).collect()]
    pieces = sr.drawings(seen, cameras, piece=4).orderBy("piece").collect()
    assert len(whole) == 1 and len(pieces) > 3 and "".join(r["content"] for r in pieces) == whole[0]
    assert whole[0].startswith("<svg ") and whole[0].endswith("</svg>") and whole[0].count("<polygon") == 15
    none = sr.drawings(seen.where("false"), cameras).collect()
    assert len(none) == 1 and none[0]["content"].endswith('role="img"></svg>')


def test_deep_and_broken_trees(spark):
    chain = [node(k, k - 1 if k else None, 0, t=(1, 0, 0), q=(0, 0, 1, 1) if k % 2 else (0, 0, 0, 1)) for k in range(200)]
    got = {r["id"]: r for r in sr.placed(spark.createDataFrame(chain, NODE)).select("id", "level", F.col("world.tx").alias("x"), F.col("world.ty").alias("y")).collect()}
    assert len(got) == 200 and got[199]["level"] == 199
    x = y = 0.0
    direction = 0
    for k in range(200):
        x, y = x + (1, 0, -1, 0)[direction], y + (0, 1, 0, -1)[direction]
        direction = (direction + k % 2) % 4
        assert (got[k]["x"], got[k]["y"]) == pytest.approx((x, y), abs=1e-9)
    with pytest.raises(Exception, match="own ancestor"):
        sr.placed(spark.createDataFrame([node(1, None, 0), node(2, 4, 0), node(3, 2, 0), node(4, 3, 0)], NODE)).collect()
    assert sr.placed(spark.createDataFrame([], NODE)).count() == 0
