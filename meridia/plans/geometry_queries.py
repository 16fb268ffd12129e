"""Queries on points, boxes, rays, rotations and cameras."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.cameras import Intrinsics, Pose, camera_support, intrinsics_of_model, reprojection_error
from ..functions.shapes import Box, Ray, Tri
from ..functions.vectors import Mat, Quat, Similarity, Vec, held, rigid, tidy, trs
from ..operators import cloud, spatial
from . import lifts
from .lifts import BOXES, POINTS, TRIPLES, r
from .registry import query

V = 0.1


def _abc() -> tuple[Vec, Vec, Vec]:
    return Vec.columns("a"), Vec.columns("b"), Vec.columns("c")


@query(f"""SELECT CAST(floor(x / {V}) AS BIGINT) AS vx, CAST(floor(y / {V}) AS BIGINT) AS vy, CAST(floor(z / {V}) AS BIGINT) AS vz,
 {r('avg(x)', 'x')}, {r('avg(y)', 'y')}, {r('avg(z)', 'z')}, count(*) AS n FROM ({POINTS}) GROUP BY 1, 2, 3""")
def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cloud.voxel_downsample(lifts.points(spark, sf_dir), V)
    return out.withColumns({a: tidy(F.col(a)) for a in "xyz"})


@query(f"""SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS vx, CAST(floor(l_extendedprice / 1000 / 5) AS BIGINT) AS vy, CAST(floor(l_discount * 100 / 5) AS BIGINT) AS vz,
 {r('avg(l_quantity)', 'x', 4)}, {r('avg(l_extendedprice / 1000)', 'y', 4)}, {r('avg(l_discount * 100)', 'z', 4)}, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def voxel_downsample_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lifts.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))
    out = cloud.voxel_downsample(rows, 5)
    return out.withColumns({a: tidy(F.col(a), 4) for a in "xyz"})


@query(f"""SELECT count(*) AS n, {', '.join(r(f'avg({a})', f'c{a}') for a in 'xyz')}, {', '.join(r(f'min({a})', f'lo_{a}') for a in 'xyz')},
 {', '.join(r(f'max({a})', f'hi_{a}') for a in 'xyz')} FROM ({POINTS})""")
def point_cloud_summary(spark, sf_dir):
    out = cloud.summary(lifts.points(spark, sf_dir))
    return out.select("n", *(tidy(F.col(c)).alias(c) for c in out.columns[1:]))


@query(f"""WITH b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz FROM ({POINTS})),
 s AS (SELECT *, CASE WHEN greatest(hx - lx, hy - ly, hz - lz) > 1.1920929e-07 THEN greatest(hx - lx, hy - ly, hz - lz) ELSE 1.0 END AS s FROM b)
 SELECT idx, {', '.join(r(f'({a} - (l{a} + h{a}) / 2) / s', a) for a in 'xyz')} FROM ({POINTS}), s""")
def center_and_scale(spark, sf_dir):
    out = cloud.center_and_scale(lifts.points(spark, sf_dir))
    return out.select("idx", *(tidy(F.col(a)).alias(a) for a in "xyz"))


@query(f"""WITH b AS (SELECT {', '.join(f'min({a}) AS lo_{a}, max({a}) AS hi_{a}' for a in 'xyz')} FROM (SELECT x, y, 0.5 AS z FROM ({POINTS})))
 SELECT {', '.join(r(f'CASE WHEN hi_{a} - lo_{a} < 0.0001 THEN lo_{a} - 0.5 ELSE lo_{a} END', f'lo_{a}') for a in 'xyz')},
 {', '.join(r(f'CASE WHEN hi_{a} - lo_{a} < 0.0001 THEN hi_{a} + 0.5 ELSE hi_{a} END', f'hi_{a}') for a in 'xyz')} FROM b""")
def scene_bounds(spark, sf_dir):
    out = cloud.padded_bounds(lifts.points(spark, sf_dir).withColumn("z", F.lit(0.5)), 1e-4, 0.5)
    return out.select(*(tidy(F.col(c)).alias(c) for c in out.columns))


@query(f"SELECT idx, {r('x', 'x')} FROM ({POINTS}) WHERE idx % 7 = 0")
def downsample_stride(spark, sf_dir):
    return cloud.stride(lifts.points(spark, sf_dir), 7).select("idx", tidy(F.col("x")).alias("x"))


@query(f"""SELECT {r('d', 'distance')}, idx FROM (SELECT sqrt((x - 0.1) * (x - 0.1) + (y - 0.05) * (y - 0.05) + (z + 0.02) * (z + 0.02)) AS d, idx FROM ({POINTS})) ORDER BY d, idx LIMIT 1""")
def nearest_point(spark, sf_dir):
    out = cloud.nearest(lifts.points(spark, sf_dir), Vec.of(0.1, 0.05, -0.02))
    return out.select(tidy(F.col("distance")).alias("distance"), "idx")


_NEAREST = f"""WITH p AS ({POINTS}), d AS (SELECT q.idx AS q_idx, p.idx AS idx, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS distance
 FROM (SELECT idx, x + 0.01 AS x, y - 0.01 AS y, z + 0.02 AS z FROM p WHERE idx % 5 = 0) q, p)
 SELECT q_idx, idx, {r('distance', 'distance')} FROM (SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY distance, idx) AS k FROM d) WHERE k = 1"""


@query(_NEAREST)
def nearest_point_each(spark, sf_dir):
    p = lifts.points(spark, sf_dir)
    q = p.where("idx % 5 = 0").select("idx", (F.col("x") + 0.01).alias("x"), (F.col("y") - 0.01).alias("y"), (F.col("z") + 0.02).alias("z"))
    out = cloud.nearest_each(q, p, 0.08)
    return out.select("q_idx", "idx", tidy(F.col("distance")).alias("distance"))


_OVERLAP = " AND ".join(f"a.lo_{x} < b.hi_{x} AND b.lo_{x} < a.hi_{x}" for x in "xyz")
_PAIRS = f"WITH b AS ({BOXES}) SELECT a.idx AS left_idx, b.idx AS right_idx FROM b a JOIN b ON a.idx < b.idx AND {_OVERLAP}"


@query(_PAIRS)
def broad_phase_grid(spark, sf_dir):
    return spatial.overlap_pairs(lifts.boxes(spark, sf_dir), cell=0.08)


@query(_PAIRS)
def broad_phase_sweep(spark, sf_dir):
    return spatial.sweep_pairs(lifts.boxes(spark, sf_dir), 0.04)


@query(_PAIRS)
def broad_phase_brute(spark, sf_dir):
    return spatial.brute_pairs(lifts.boxes(spark, sf_dir))


@query(f"WITH b AS ({BOXES}) SELECT a.idx AS left_idx, b.idx AS right_idx FROM (SELECT * FROM b WHERE idx % 2 = 0) a JOIN (SELECT * FROM b WHERE idx % 2 = 1) b ON {_OVERLAP}")
def broad_phase_between(spark, sf_dir):
    b = lifts.boxes(spark, sf_dir)
    return spatial.overlap_pairs(b.where("idx % 2 = 0"), b.where("idx % 2 = 1"), cell=0.08)


#: half sides of the boxes of three shapes over all orders, and what gathers their places into clusters
_SHAPES = {"sparse": (2.0, 100_000.0), "clustered": (0.4, 40.0), "overlapping": (12.0, 100_000.0)}


def _order_boxes(spark, sf_dir, shape: str) -> DataFrame:
    half, width = _SHAPES[shape]
    at = {"x": F.col("o_totalprice") / 100, "y": F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double"), "z": (F.col("o_orderkey") % 1000).cast("double")}
    o = lifts.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), *((c % width).alias(a) for a, c in at.items()))
    side = F.when(F.col("idx") % 500 == 0, half * 40).otherwise(half)
    return o.select("idx", *((F.col(a) - side).alias(f"lo_{a}") for a in "xyz"), *((F.col(a) + side).alias(f"hi_{a}") for a in "xyz"))


def _order_pairs(shape: str) -> str:
    half, width = _SHAPES[shape]
    ends = ", ".join(f"{a} {sign} h AS {e}_{a}" for e, sign in (("lo", "-"), ("hi", "+")) for a in "xyz")
    return f"""WITH o AS (SELECT o_orderkey AS idx, (o_totalprice / 100) % {width} AS x, CAST(datediff('day', TIMESTAMP '1992-01-01', o_orderdate) AS DOUBLE) % {width} AS y, CAST(o_orderkey % 1000 AS DOUBLE) % {width} AS z,
 CASE WHEN o_orderkey % 500 = 0 THEN {half} * 40 ELSE {half} END AS h FROM orders), b AS (SELECT idx, {ends} FROM o) SELECT a.idx AS left_idx, b.idx AS right_idx FROM b a JOIN b ON a.idx < b.idx AND {_OVERLAP}"""


@query(_order_pairs("sparse"))
def broad_phase_sparse(spark, sf_dir):
    """Boxes of two sizes over all orders, on two grids."""
    return spatial.overlap_pairs(_order_boxes(spark, sf_dir, "sparse"), cell=5.0)


@query(_order_pairs("clustered"))
def broad_phase_clustered(spark, sf_dir):
    return spatial.broad_phase(_order_boxes(spark, sf_dir, "clustered"))


_WIDE = "w AS (SELECT * FROM b UNION ALL SELECT -1, min(lo_x) - 1, min(lo_y) - 1, min(lo_z) - 1, max(hi_x) + 1, max(hi_y) + 1, max(hi_z) + 1 FROM b)"


@query(f"WITH b AS ({BOXES}), {_WIDE} SELECT a.idx AS left_idx, b.idx AS right_idx FROM w a JOIN w b ON a.idx < b.idx AND {_OVERLAP}")
def broad_phase_auto(spark, sf_dir):
    """Grids by the median extent, with a box around all others among them."""
    b = lifts.boxes(spark, sf_dir)
    around = b.agg(F.lit(-1).cast("long").alias("idx"), *((F.min(f"lo_{a}") - 1).alias(f"lo_{a}") for a in "xyz"), *((F.max(f"hi_{a}") + 1).alias(f"hi_{a}") for a in "xyz"))
    return spatial.broad_phase(b.unionByName(around))


@query(_order_pairs("overlapping"))
def broad_phase_overlapping(spark, sf_dir):
    return spatial.overlap_pairs(_order_boxes(spark, sf_dir, "overlapping"), cell=25.0)


@query(_order_pairs("sparse"))
def sweep_sparse(spark, sf_dir):
    return spatial.sweep_pairs(_order_boxes(spark, sf_dir, "sparse"), 5.0)


@query(f"WITH e AS (SELECT greatest(hi_x - lo_x, hi_y - lo_y, hi_z - lo_z) * (1 + idx % 3) AS e FROM ({BOXES})) SELECT {r('e', 'median')} FROM (SELECT e, row_number() OVER (ORDER BY e) AS k, count(*) OVER () AS n FROM e) WHERE k = n // 2 + 1")
def auto_cell_size(spark, sf_dir):
    extent = spatial.largest_extent() * (1 + F.col("idx") % 3)
    return cloud.exact_upper_median(lifts.boxes(spark, sf_dir), extent).select(tidy(F.col("median")).alias("median"))


@query(f"""SELECT idx, {r('ax * bx + ay * by_ + az * bz', 'dot')}, {r('ay * bz - az * by_', 'crossx')}, {r('az * bx - ax * bz', 'crossy')}, {r('ax * by_ - ay * bx', 'crossz')},
 {r('sqrt(ax * ax + ay * ay + az * az)', 'length')}, {r('ax / sqrt(ax * ax + ay * ay + az * az)', 'unitx')}, {r('sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_) + (az - bz) * (az - bz))', 'distance')}
 FROM (SELECT * RENAME ("by" AS by_) FROM ({TRIPLES}))""")
def vector_operations(spark, sf_dir):
    a, b, _ = _abc()
    return lifts.point_pairs(spark, sf_dir).select("idx", tidy(a.dot(b)).alias("dot"), *a.cross(b).named("cross"), tidy(a.length()).alias("length"), tidy(a.normalised().x).alias("unitx"), tidy(a.distance(b)).alias("distance"))


@query(f"""WITH b AS ({BOXES}), j AS (SELECT a.idx, {', '.join(f'greatest(a.lo_{x}, b.lo_{x}) AS lo_{x}, least(a.hi_{x}, b.hi_{x}) AS hi_{x}, least(a.lo_{x}, b.lo_{x}) AS ulo_{x}, greatest(a.hi_{x}, b.hi_{x}) AS uhi_{x}' for x in 'xyz')},
 ({_OVERLAP}) AS o FROM b a JOIN b ON b.idx = a.idx + 1)
 SELECT idx, o AS overlaps, {', '.join(r(f'CASE WHEN o THEN lo_{x} END', f'lo_{x}') for x in 'xyz')}, {r('CASE WHEN o THEN (hi_x - lo_x) * (hi_y - lo_y) * (hi_z - lo_z) END', 'volume')},
 {r('(uhi_x - ulo_x) * (uhi_y - ulo_y) * (uhi_z - ulo_z)', 'union_volume')}, {r('ulo_x + (uhi_x - ulo_x) * 0.5', 'union_cx')} FROM j""")
def bounds_operations(spark, sf_dir):
    b = lifts.boxes(spark, sf_dir)
    other = b.select((F.col("idx") - 1).alias("idx"), *(F.col(c).alias(f"o_{c}") for c in b.columns[1:]))
    one, two = Box.columns(), Box.columns("o_")
    shared, union = one.intersection(two), one.union(two)
    return b.join(other, "idx").select("idx", one.overlaps(two).alias("overlaps"), *(tidy(c).alias(f"lo_{a}") for a, c in zip("xyz", shared.low)), tidy(shared.volume()).alias("volume"), tidy(union.volume()).alias("union_volume"), tidy(union.centre().x).alias("union_cx"))


@query(f"SELECT idx FROM ({POINTS}) WHERE x BETWEEN -0.05 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN -0.2 AND 0.05")
def retain_in_bounds(spark, sf_dir):
    return lifts.points(spark, sf_dir).where(Box(Vec.of(-0.05, -0.1, -0.2), Vec.of(0.1, 0.1, 0.05)).contains(Vec.columns())).select("idx")


_C = {"x": "least(greatest(x, -0.05), 0.05)", "y": "least(greatest(y, -0.04), 0.06)", "z": "least(greatest(z, -0.03), 0.07)"}


@query(f"""SELECT idx, {', '.join(r(e, f'b{k}') for k, e in _C.items())}, {r('sqrt(' + ' + '.join(f'({e} - {k}) * ({e} - {k})' for k, e in _C.items()) + ')', 'box_distance')},
 {r('0.1 + greatest(0.6 * (x - 0.1) + 0.8 * y, 0) * 0.6', 'rayx')}, {r('x - 0.6 * (0.6 * x + 0.8 * z - 0.05)', 'planex')}, {r('0.6 * x + 0.8 * z - 0.05', 'signed')},
 {r('-0.1 + least(greatest(((x + 0.1) * 0.2 + y * 0.1) / 0.05, 0), 1) * 0.2', 'segmentx')}, {r('0.01 + 0.2 * (x - 0.01) / sqrt((x - 0.01) * (x - 0.01) + y * y + z * z)', 'spherex')},
 (({_C['x']} - x) * ({_C['x']} - x) + ({_C['y']} - y) * ({_C['y']} - y) + ({_C['z']} - z) * ({_C['z']} - z)) <= 0.01 AS meets_box FROM ({POINTS})""")
def closest_points(spark, sf_dir):
    p = Vec.columns()
    box = Box(Vec.of(-0.05, -0.04, -0.03), Vec.of(0.05, 0.06, 0.07))
    normal, d = Vec.of(0.6, 0, 0.8), F.lit(-0.05)
    return lifts.points(spark, sf_dir).select(
        "idx", *box.closest(p).named("b"), tidy(box.distance(p)).alias("box_distance"),
        tidy(Ray(Vec.of(0.1, 0, 0), Vec.of(0.6, 0.8, 0)).closest(p).x).alias("rayx"), tidy(shapes.project_to_plane(p, normal, d).x).alias("planex"),
        tidy(shapes.signed_distance(p, normal, d)).alias("signed"), tidy(shapes.closest_on_segment(p, Vec.of(-0.1, 0, 0), Vec.of(0.1, 0.1, 0)).x).alias("segmentx"),
        tidy(shapes.closest_on_sphere(p, Vec.of(0.01, 0, 0), F.lit(0.2)).x).alias("spherex"), shapes.sphere_meets_box(p, F.lit(0.1), box).alias("meets_box"),
    )


_D = "SELECT idx, ax, ay, az, dx / n AS dx, dy / n AS dy, dz / n AS dz FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS n FROM (SELECT idx, ax, ay, az, bx AS dx, \"by\" AS dy, bz AS dz FROM (" + TRIPLES + ")))"


@query(f"""WITH d AS ({_D}), s AS (SELECT *, dx * 0.6 + dz * 0.8 AS facing, ax * dx + ay * dy + az * dz AS half, ax * ax + ay * ay + az * az AS q FROM d),
 t AS (SELECT *, -(0.6 * ax + 0.8 * az - 0.05) / facing AS tp, half * half - (q - 0.04) AS left_, {', '.join(f'least((-0.05 - a{k}) / d{k}, (0.05 - a{k}) / d{k}) AS n{k}, greatest((-0.05 - a{k}) / d{k}, (0.05 - a{k}) / d{k}) AS f{k}' for k in 'xyz')} FROM s),
 u AS (SELECT *, greatest(nx, ny, nz) AS near, least(fx, fy, fz) AS far, CASE WHEN left_ >= 0 THEN -half - sqrt(greatest(left_, 0)) END AS s1, CASE WHEN left_ >= 0 THEN -half + sqrt(greatest(left_, 0)) END AS s2 FROM t)
 SELECT idx, {r('CASE WHEN abs(facing) > 1.1920929e-07 AND tp >= 0 THEN tp END', 'plane')}, {r('CASE WHEN near <= far AND far >= 0 THEN greatest(near, 0) END', 'box_in')},
 {r('CASE WHEN near <= far AND far >= 0 THEN far END', 'box_out')}, {r('CASE WHEN s1 >= 0 THEN s1 WHEN s2 >= 0 THEN s2 END', 'sphere1')}, {r('CASE WHEN s1 >= 0 AND s2 >= 0 THEN s2 END', 'sphere2')} FROM u""")
def ray_intersections(spark, sf_dir):
    a, b, _ = _abc()
    ray = Ray(a, b)
    plane = ray.plane(Vec.of(0.6, 0, 0.8), F.lit(-0.05))
    inner = ray.box(Box(Vec.of(-0.05, -0.05, -0.05), Vec.of(0.05, 0.05, 0.05)))
    ball = ray.sphere(Vec.of(0, 0, 0), F.lit(0.2))
    named = zip(("plane", "box_in", "box_out", "sphere1", "sphere2"), (plane, *inner, *ball))
    return lifts.point_pairs(spark, sf_dir).select("idx", *(tidy(c).alias(n) for n, c in named))


@query(f"""WITH p AS (SELECT a.idx, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM ({POINTS}) a JOIN ({POINTS}) b ON b.idx = a.idx + 1),
 d AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) + (bz - az) * (bz - az)) AS d FROM p)
 SELECT idx, {r('(bx - ax) / d', 'nx')}, {r('0.25 - d', 'depth')}, {r('((ax + (bx - ax) / d * 0.1) + (bx - (bx - ax) / d * 0.15)) * 0.5', 'cx')}, {r('4 * pi() * d * d', 'area', 5)}, {r('4.0 / 3 * pi() * d * d * d', 'volume', 5)}
 FROM d WHERE d * d <= 0.25 * 0.25""")
def collision_sphere_sphere(spark, sf_dir):
    p = lifts.points(spark, sf_dir)
    other = p.select((F.col("idx") - 1).alias("idx"), *(F.col(k).alias(f"o{k}") for k in "xyz"))
    a, b = Vec.columns(), Vec.columns("o")
    normal, depth, contact = shapes.sphere_collision(a, F.lit(0.1), b, F.lit(0.15))
    d = a.distance(b)
    return p.join(other, "idx").where(shapes.spheres_meet(a, F.lit(0.1), b, F.lit(0.15))).select("idx", tidy(normal.x).alias("nx"), tidy(depth).alias("depth"), tidy(contact.x).alias("cx"), tidy(shapes.sphere_area(d), 5).alias("area"), tidy(shapes.sphere_volume(d), 5).alias("volume"))


#: rotation of 0.5 about (1, 2, 2) / 3
_S, _W = math.sin(0.25) / 3, math.cos(0.25)
_Q = (_S, 2 * _S, 2 * _S, _W)


def _rotated(x: str, y: str, z: str) -> tuple[str, str, str]:
    qx, qy, qz, qw = _Q
    m = [
        [1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy - qz * qw), 2 * (qx * qz + qy * qw)],
        [2 * (qx * qy + qz * qw), 1 - 2 * (qx * qx + qz * qz), 2 * (qy * qz - qx * qw)],
        [2 * (qx * qz - qy * qw), 2 * (qy * qz + qx * qw), 1 - 2 * (qx * qx + qy * qy)],
    ]
    return tuple(f"(({a!r}) * ({x}) + ({b!r}) * ({y}) + ({c!r}) * ({z}))" for a, b, c in m)


_RX = _rotated("x * 1.5", "y * 1.5", "z * 1.5")


@query(f"SELECT idx, {r(_RX[0] + ' + 0.1', 'x')}, {r(_RX[1] + ' - 0.2', 'y')}, {r(_RX[2] + ' + 0.3', 'z')}, {r('x', 'back_x')} FROM ({POINTS})")
def similarity_transform(spark, sf_dir):
    move = Similarity(Quat.about(Vec.of(1, 2, 2), 0.5), Vec.of(0.1, -0.2, 0.3), F.lit(1.5))
    out = move.apply(Vec.columns())
    return lifts.points(spark, sf_dir).select("idx", *out.named(), tidy(move.inverse().apply(out).x).alias("back_x"))


_R1 = _rotated("x", "y", "z")
_R2 = _rotated(f"{_R1[0]} + 0.1", f"{_R1[1]} + 0.2", f"{_R1[2]} + 0.3")


@query(f"SELECT idx, {r(_R2[0] + ' + 0.1', 'x')}, {r(_R2[1] + ' + 0.2', 'y')}, {r(_R2[2] + ' + 0.3', 'z')} FROM ({POINTS})")
def rigid_transform_composed(spark, sf_dir):
    one = rigid(Quat.about(Vec.of(1, 2, 2), 0.5), Vec.of(0.1, 0.2, 0.3))
    return lifts.points(spark, sf_dir).select("idx", *one.then(one).apply(Vec.columns()).named())


_RT = _rotated("x * 1.0", "y * 2.0", "z * 3.0")


@query(f"SELECT idx, {r(_RT[0] + ' + 0.1', 'x')}, {r(_RT[1] + ' + 0.2', 'y')}, {r(_RT[2] + ' + 0.3', 'z')}, {r('x', 'back_x')}, {r('6.0', 'determinant')} FROM ({POINTS})")
def trs_transform(spark, sf_dir):
    m = trs(Vec.of(0.1, 0.2, 0.3), Quat.about(Vec.of(1, 2, 2), 0.5), Vec.of(1, 2, 3))
    out = m.apply(Vec.columns())
    return lifts.points(spark, sf_dir).select("idx", *out.named(), tidy(m.inverse().apply(out).x).alias("back_x"), tidy(m.determinant()).alias("determinant"))


@query(f"""WITH q AS (SELECT idx, x, CASE WHEN cos(x) > 0.9995 THEN 0.75 ELSE sin(0.75 * x) / sin(x) END AS a, CASE WHEN cos(x) > 0.9995 THEN 0.25 ELSE sin(0.25 * x) / sin(x) END AS b FROM ({POINTS})),
 m AS (SELECT *, a * sin(0.1) + b * sin(0.1 + x) AS z, a * cos(0.1) + b * cos(0.1 + x) AS w FROM q)
 SELECT idx, {r('z / sqrt(z * z + w * w)', 'qz')}, {r('w / sqrt(z * z + w * w)', 'qw')}, {r('2 * (0.1 + x)', 'turn')} FROM m""")
def quaternion_slerp(spark, sf_dir):
    rows, b = held(lifts.points(spark, sf_dir), b=Quat.about(Vec.of(0, 0, 1), 0.2 + 2 * F.col("x")))
    rows, s = held(rows, s=Quat.about(Vec.of(0, 0, 1), 0.2).slerp(b, 0.25))
    return rows.select("idx", tidy(s.z).alias("qz"), tidy(s.w).alias("qw"), tidy(b.to_euler("xyz")[2]).alias("turn"))


@query(f"SELECT idx, {r('x', 'ex')}, {r('y', 'ey')}, {r('z', 'ez')}, {r('1.0', 'norm')} FROM ({POINTS})")
def euler_round_trip(spark, sf_dir):
    rows, q = held(lifts.points(spark, sf_dir), q=Quat.euler("zxy", F.col("x"), F.col("y"), F.col("z")))
    rows, m = held(rows, m=q.matrix())
    rows, again = held(rows, again=m.quaternion())
    angles = again.to_euler("zxy")
    return rows.select("idx", *(tidy(c).alias(f"e{k}") for k, c in zip("xyz", angles)), tidy(again.dot(again)).alias("norm"))


@query(f"SELECT idx, {r('CASE WHEN z + 0.3 > 0 THEN 30 * x / (z + 0.3) + 15 END', 'u')}, {r('CASE WHEN z + 0.3 > 0 THEN 30 * y / (z + 0.3) + 15 END', 'v')}, {r('CASE WHEN z + 0.3 > 0 THEN z + 0.3 END', 'depth')}, {r('CASE WHEN z + 0.3 > 0 THEN x END', 'ray_x')} FROM ({POINTS})")
def project_points(spark, sf_dir):
    lens = Intrinsics.of(32, 32, 30, 30, 15, 15)
    pose = Pose(Vec.of(0, 0, -0.3), Vec.of(1, 0, 0), Vec.of(0, 1, 0), Vec.of(0, 0, 1))
    u, v, depth = pose.project(lens, Vec.columns())
    origin, way = pose.pixel_ray(lens, u, v)
    on_ray = origin + way * (depth / way.z)
    return lifts.points(spark, sf_dir).select("idx", tidy(u).alias("u"), tidy(v).alias("v"), tidy(depth).alias("depth"), tidy(on_ray.x).alias("ray_x"))


@query(f"""WITH p AS (SELECT *, sqrt(x * x + z * z) AS h, sqrt(x * x + y * y + z * z) AS n FROM ({POINTS}))
 SELECT idx, {r('-x / n', 'fx')}, {r('-z / h', 'rx')}, {r('h / n', 'uy')}, {r('n', 'centre_depth')} FROM p""")
def look_at(spark, sf_dir):
    rows, pose = held(lifts.points(spark, sf_dir), pose=Pose.look_at(Vec.columns(), Vec.of(0, 0, 0), Vec.of(0, 1, 0)))
    m = pose.view_matrix()
    rows, (turn, shift) = held(rows, camera=pose.to_world_to_camera())
    again = Pose.from_world_to_camera(turn, shift)
    return rows.select("idx", tidy(pose.forward.x).alias("fx"), tidy(again.right.x).alias("rx"), tidy(pose.up.y).alias("uy"), tidy(m.apply(Vec.of(0, 0, 0)).z).alias("centre_depth"))


@query(f"""WITH f AS (SELECT idx, 24 / tan((0.8 + x) / 2) AS f FROM ({POINTS}))
 SELECT idx, {r('f', 'focal', 4)}, {r('2 * f / 64', 'm00')}, {r('100 / 99.9', 'm22')}, {r('-100.1 / 99.9', 'w22')}, {r('-20 / 99.9', 'w23')} FROM f""")
def projection_matrices(spark, sf_dir):
    lens = Intrinsics.from_vertical_fov(64, 48, 0.8 + F.col("x"))
    depth, gl = lens.depth_projection(0.1, 100).rows, lens.webgl_projection(0.1, 100).rows
    return lifts.points(spark, sf_dir).select("idx", tidy(lens.fx, 4).alias("focal"), tidy(depth[0][0]).alias("m00"), tidy(depth[2][2]).alias("m22"), tidy(gl[2][2]).alias("w22"), tidy(gl[2][3]).alias("w23"))


@query(f"SELECT idx, {r('CASE WHEN z + 0.5 > 0 THEN sqrt((30 * x / (z + 0.5) + 15 - 16) * (30 * x / (z + 0.5) + 15 - 16) + (30 * y / (z + 0.5) + 15 - 14) * (30 * y / (z + 0.5) + 15 - 14)) END', 'error')} FROM ({POINTS})")
def reprojection_errors(spark, sf_dir):
    pose = Pose(Vec.of(0, 0, -0.5), Vec.of(1, 0, 0), Vec.of(0, 1, 0), Vec.of(0, 0, 1))
    return lifts.points(spark, sf_dir).select("idx", tidy(reprojection_error(pose, Intrinsics.of(32, 32, 30, 30, 15, 15), Vec.columns(), 16, 14)).alias("error"))


@query(f"""WITH m AS (SELECT idx, ['SIMPLE_PINHOLE', 'PINHOLE', 'SIMPLE_RADIAL', 'OPENCV'][1 + idx % 4] AS model FROM ({POINTS}))
 SELECT idx, model, CASE model WHEN 'SIMPLE_PINHOLE' THEN 'supported' WHEN 'PINHOLE' THEN 'supported' WHEN 'SIMPLE_RADIAL' THEN 'approximated' ELSE 'unsupported' END AS support,
 CASE model WHEN 'PINHOLE' THEN 52.0 WHEN 'OPENCV' THEN NULL ELSE 50.0 END AS fy, CASE model WHEN 'PINHOLE' THEN 32.0 WHEN 'OPENCV' THEN NULL ELSE 52.0 END AS cx, CASE model WHEN 'SIMPLE_RADIAL' THEN 24.0 WHEN 'OPENCV' THEN NULL ELSE 0.0 END AS k FROM m""")
def camera_models(spark, sf_dir):
    model = F.element_at(F.array(*map(F.lit, ("SIMPLE_PINHOLE", "PINHOLE", "SIMPLE_RADIAL", "OPENCV"))), (F.col("idx") % 4 + 1).cast("int"))
    rows = lifts.points(spark, sf_dir).select("idx", model.alias("model"))
    lens = intrinsics_of_model(F.col("model"), F.array(*(F.lit(float(v)) for v in (50, 52, 32, 24))))
    return rows.select("idx", "model", camera_support(F.col("model")).alias("support"), *(lens[k].alias(k) for k in ("fy", "cx", "k")))


@query(f"""WITH t AS ({TRIPLES}), n AS (SELECT *, ("by" - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax) AS nz FROM t)
 SELECT idx, {r('sqrt(nx * nx + ny * ny + nz * nz) * 0.5', 'area')}, {r('nx / sqrt(nx * nx + ny * ny + nz * nz)', 'nx')}, {r('(ax + bx + cx) / 3', 'mx')}, {r('1.0 / 3', 'bary')}, {r('0.0', 'off')} FROM n""")
def triangle_measures(spark, sf_dir):
    t = Tri(*_abc())
    rows, centre = held(lifts.point_pairs(spark, sf_dir), centre=t.centroid())
    rows, foot = held(rows, foot=t.foot(centre))
    return rows.select("idx", tidy(t.area()).alias("area"), tidy(t.normal().x).alias("nx"), tidy(centre.x).alias("mx"), tidy(t.barycentric(centre)[1]).alias("bary"), tidy(t.closest(centre, foot).distance(centre)).alias("off"))


@query(f"""WITH t AS ({TRIPLES}), d AS (SELECT *, sqrt(bx * bx + "by" * "by" + bz * bz) AS nb, sqrt(cx * cx + cy * cy + cz * cz) AS nc, bx * cx + "by" * cy + bz * cz AS p FROM t)
 SELECT idx, {r('acos(least(abs(p / nb / nc), 1))', 'angle', 5)} FROM d""")
def ray_angles(spark, sf_dir):
    _, b, c = _abc()
    return lifts.point_pairs(spark, sf_dir).select("idx", tidy(shapes.ray_angle(b, c), 5).alias("angle"))


@query(f"""WITH t AS (SELECT idx, CAST(idx % 40 AS INTEGER) AS ax, CAST(idx % 23 AS INTEGER) AS ay, CAST(idx % 31 AS INTEGER) AS bx, CAST(idx % 17 AS INTEGER) AS by_ FROM ({POINTS})),
 o AS (SELECT *, greatest(least(ax + 20, bx + 15) - greatest(ax, bx), 0) * greatest(least(ay + 10, by_ + 12) - greatest(ay, by_), 0) AS s FROM t)
 SELECT idx, {r('s / (200 + 180 - s)', 'iou')}, greatest(ax - 5, 0) AS px, least(ax + 25, 50) - greatest(ax - 5, 0) AS pw FROM o""")
def box_iou(spark, sf_dir):
    rows = lifts.points(spark, sf_dir)
    at = lambda n: (F.col("idx") % n).cast("int")
    a, b = (at(40), at(23), F.lit(20), F.lit(10)), (at(31), at(17), F.lit(15), F.lit(12))
    x, _, w, _ = shapes.padded(a, F.lit(5), F.lit(50), F.lit(40))
    return rows.select("idx", tidy(shapes.iou(a, b)).alias("iou"), x.alias("px"), w.alias("pw"))


_M = [[f'"{p}{a}"' + (" + 1" if p == q else "") for a, q in zip("xyz", "abc")] for p in "abc"]
_MINOR = "(({0}) * ({3}) - ({1}) * ({2}))"
_DET = " + ".join(f"({_M[0][k]}) * {_MINOR.format(_M[1][(k + 1) % 3], _M[1][(k + 2) % 3], _M[2][(k + 1) % 3], _M[2][(k + 2) % 3])}" for k in range(3))


@query(f"""SELECT idx, {r(_DET, 'determinant')}, {r(_MINOR.format(_M[1][1], _M[1][2], _M[2][1], _M[2][2]) + f' / ({_DET})', 'inverse_xx')}, {r(f'({_M[0][0]}) * ({_M[0][1]}) + ({_M[0][1]}) * ({_M[1][1]}) + ({_M[0][2]}) * ({_M[2][1]})', 'square_xy')},
 {r(_M[2][0], 'transposed_xz')} FROM ({TRIPLES})""")
def matrix_operations(spark, sf_dir):
    """Determinant, inverse, product and transpose of a matrix near one, of nine components."""
    c = lambda p, a: F.col(f"{p}{a}") + (1.0 if "abc".index(p) == "xyz".index(a) else 0.0)
    m = Mat([[c(p, a) for a in "xyz"] for p in "abc"])
    rows = lifts.point_pairs(spark, sf_dir)
    out = {"determinant": m.determinant(), "inverse_xx": m.inverse().rows[0][0], "square_xy": (m @ m).rows[0][1], "transposed_xz": m.transpose().rows[0][2]}
    return rows.select("idx", *(tidy(v).alias(n) for n, v in out.items()))


@query(f"""WITH m AS (SELECT idx, 0.75 * sin(0.1) + 0.25 * sin(0.1 + x) AS z, 0.75 * cos(0.1) + 0.25 * cos(0.1 + x) AS w FROM ({POINTS})) SELECT idx, {r('z / sqrt(z * z + w * w)', 'qz')}, {r('w / sqrt(z * z + w * w)', 'qw')} FROM m""")
def quaternion_nlerp(spark, sf_dir):
    """A linear blend towards a rotation that is given with the opposite sign, along the shorter way."""
    rows, b = held(lifts.points(spark, sf_dir), b=Quat.about(Vec.of(0, 0, 1), 0.2 + 2 * F.col("x")))
    rows, s = held(rows, s=Quat.about(Vec.of(0, 0, 1), 0.2).nlerp(Quat(*(-c for c in b)), 0.25))
    return rows.select("idx", tidy(s.z).alias("qz"), tidy(s.w).alias("qw"))


_ORDERS = ("xyz", "xzy", "yxz", "yzx", "zxy", "zyx")


def _turns(order: str) -> tuple[str, str, str]:
    """(1, 2, 3) turned about the axes by the angles x, y and z, in that order."""
    v = {"x": "1.0", "y": "2.0", "z": "3.0"}
    for axis in order:
        i, j = {"x": "yz", "y": "zx", "z": "xy"}[axis]
        v |= {i: f"(cos({axis}) * {v[i]} - sin({axis}) * {v[j]})", j: f"(sin({axis}) * {v[i]} + cos({axis}) * {v[j]})"}
    return v["x"], v["y"], v["z"]


@query(" UNION ALL ".join(f"SELECT idx, '{o}' AS turn_order, {r(_turns(o)[0], 'vx')}, {r(_turns(o)[1], 'vy')}, {r(_turns(o)[2], 'vz')}, {r('x', 'ex')}, {r('y', 'ey')}, {r('z', 'ez')} FROM ({POINTS})" for o in _ORDERS))
def euler_orders(spark, sf_dir):
    """A vector turned by angles in each of the six orders, and the angles found again."""
    out = None
    for order in _ORDERS:
        rows, q = held(lifts.points(spark, sf_dir), q=Quat.euler(order, F.col("x"), F.col("y"), F.col("z")))
        turned, angles = q.rotate(Vec.of(1, 2, 3)), q.to_euler(order)
        one = rows.select("idx", F.lit(order).alias("turn_order"), *(tidy(c).alias(f"v{k}") for k, c in zip("xyz", turned)), *(tidy(c).alias(f"e{k}") for k, c in zip("xyz", angles)))
        out = one if out is None else out.unionByName(one)
    return out


_A1 = tuple(f"{c} + {t}" for c, t in zip(_rotated("x * 1.0", "y * 2.0", "z * 3.0"), (0.1, 0.2, 0.3)))
_A2 = tuple(f"{c} + {t}" for c, t in zip(_rotated("p * 1.0", "q * 2.0", "s * 3.0"), (0.1, 0.2, 0.3)))


@query(f"WITH one AS (SELECT idx, x, {_A1[0]} AS p, {_A1[1]} AS q, {_A1[2]} AS s FROM ({POINTS})) SELECT idx, {r(_A2[0], 'x')}, {r(_A2[1], 'y')}, {r(_A2[2], 'z')}, {r('x', 'back_x')} FROM one")
def affine_composed(spark, sf_dir):
    """An affine map after itself as one matrix, and its inverse."""
    m = trs(Vec.of(0.1, 0.2, 0.3), Quat.about(Vec.of(1, 2, 2), 0.5), Vec.of(1, 2, 3))
    both = m @ m
    out = both.apply(Vec.columns())
    return lifts.points(spark, sf_dir).select("idx", *out.named(), tidy(both.inverse().apply(out).x).alias("back_x"))


@query(f"""WITH p AS (SELECT *, sqrt(x * x + z * z) AS h, sqrt(x * x + y * y + z * z) AS n FROM ({POINTS}))
 SELECT idx, {r('-z / h', 'right_x')}, {r('y / n', 'back_y')}, {r('-n', 'depth')}, {r('-1.0 - n', 'ahead')} FROM p""")
def webgl_view(spark, sf_dir):
    """Cameras at the points that look at the origin, as a view in which forward is -z: the origin, and a point a step behind it."""
    rows, pose = held(lifts.points(spark, sf_dir), pose=Pose.look_at(Vec.columns(), Vec.of(0, 0, 0), Vec.of(0, 1, 0)))
    m = pose.webgl_view_matrix()
    return rows.select("idx", tidy(m.rows[0][0]).alias("right_x"), tidy(m.rows[2][1]).alias("back_y"), tidy(m.apply(Vec.of(0, 0, 0)).z).alias("depth"), tidy(m.apply(pose.forward).z).alias("ahead"))
