"""Queries on meshes: bent grids of the embeddings, made alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import tidy
from ..operators import mesh
from . import lifts
from .lifts import mesh_sql, r
from .registry import query

_CORNERS = """corners AS (SELECT t.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM triangles t
 JOIN vertices a ON a.mesh_id = t.mesh_id AND a.v_idx = t.a JOIN vertices b ON b.mesh_id = t.mesh_id AND b.v_idx = t.b JOIN vertices c ON c.mesh_id = t.mesh_id AND c.v_idx = t.c),
cross_ AS (SELECT *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM corners),
faces AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS n2 FROM cross_)"""
_EDGES = """sides AS (SELECT mesh_id, t_idx, unnest([{'lo': least(a, b), 'hi': greatest(a, b)}, {'lo': least(b, c), 'hi': greatest(b, c)}, {'lo': least(c, a), 'hi': greatest(c, a)}]) AS e FROM triangles),
edges AS (SELECT mesh_id, e.lo AS lo, e.hi AS hi, count(*) AS n FROM sides GROUP BY 1, 2, 3)"""
_NEAR = "near AS (SELECT mesh_id, lo AS v_idx, hi AS other FROM edges UNION ALL SELECT mesh_id, hi, lo FROM edges)"


@query(f"WITH {mesh_sql()}, {_CORNERS} SELECT mesh_id, t_idx, {r('n2 * 0.5', 'area')}, {r('nx / n2', 'nx')}, {r('(ax + bx + cx) / 3', 'mx')} FROM faces")
def mesh_faces(spark, sf_dir):
    return mesh.faces(*lifts.grid_mesh(spark, sf_dir)).select("mesh_id", "t_idx", *(tidy(F.col(c)).alias(c) for c in ("area", "nx", "mx")))


@query(f"""WITH {mesh_sql()}, {_CORNERS} SELECT mesh_id, {r('sum(n2 * 0.5)', 'area')}, {r('abs(sum((ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx)) / 6))', 'volume', 4)},
 {r('sum(n2 * 0.5 * (ax + bx + cx) / 3) / sum(n2 * 0.5)', 'cx')} FROM faces GROUP BY mesh_id""")
def mesh_measures(spark, sf_dir):
    out = mesh.measures(*lifts.grid_mesh(spark, sf_dir))
    return out.select("mesh_id", tidy(F.col("area")).alias("area"), tidy(F.col("volume"), 4).alias("volume"), tidy(F.col("cx")).alias("cx"))


@query(f"""WITH {mesh_sql()}, {_CORNERS}, s AS (SELECT mesh_id, v, sum(nx / n2) AS sx, sum(ny / n2) AS sy, sum(nz / n2) AS sz FROM (SELECT mesh_id, unnest([a, b, c]) AS v, nx, ny, nz, n2 FROM faces) GROUP BY 1, 2)
 SELECT p.mesh_id, p.v_idx, {r('coalesce(sx / sqrt(sx * sx + sy * sy + sz * sz), 0)', 'nx')}, {r('coalesce(sz / sqrt(sx * sx + sy * sy + sz * sz), 0)', 'nz')} FROM vertices p LEFT JOIN s ON s.mesh_id = p.mesh_id AND s.v = p.v_idx""")
def vertex_normals(spark, sf_dir):
    return mesh.vertex_normals(*lifts.grid_mesh(spark, sf_dir)).select("mesh_id", "v_idx", tidy(F.col("nx")).alias("nx"), tidy(F.col("nz")).alias("nz"))


@query(f"""WITH {mesh_sql()}, {_EDGES} SELECT mesh_id, count(*) AS edges, count(*) FILTER (n = 1) AS boundary_edges, count(*) FILTER (n > 2) AS non_manifold_edges, max(n) <= 2 AS manifold, max(n) = 2 AND min(n) = 2 AS watertight FROM edges GROUP BY 1""")
def mesh_topology(spark, sf_dir):
    return mesh.topology(lifts.grid_mesh(spark, sf_dir)[1])


@query(f"""WITH RECURSIVE {mesh_sql(5)}, {_EDGES}, links AS (SELECT DISTINCT s.mesh_id, s.t_idx AS a, t.t_idx AS b FROM sides s JOIN sides t ON s.mesh_id = t.mesh_id AND s.e = t.e AND s.t_idx <> t.t_idx),
 reach AS (SELECT mesh_id, t_idx, t_idx AS seen FROM triangles UNION SELECT r.mesh_id, r.t_idx, l.b FROM reach r JOIN links l ON l.mesh_id = r.mesh_id AND l.a = r.seen)
 SELECT mesh_id, t_idx, min(seen) AS component FROM reach GROUP BY 1, 2""")
def mesh_components(spark, sf_dir):
    return mesh.components(lifts.grid_mesh(spark, sf_dir, 5)[1])


@query(f"""WITH {mesh_sql()}, {_CORNERS}, {_EDGES}, d AS (SELECT mesh_id, count(*) FILTER (n2 * 0.5 <= 1.1920929e-07) AS degenerate FROM faces GROUP BY 1),
 v AS (SELECT mesh_id, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS duplicate_pairs FROM (SELECT mesh_id, x % 3 AS x, y % 4 AS y, count(*) AS k FROM vertices GROUP BY 1, 2, 3) GROUP BY 1),
 e AS (SELECT mesh_id, count(*) FILTER (n > 2) AS non_manifold_edges, count(*) FILTER (n = 1) AS boundary_edges FROM edges GROUP BY 1)
 SELECT * FROM d JOIN v USING (mesh_id) JOIN e USING (mesh_id)""".replace("degenerate FROM faces", "degenerate FROM faces_d").replace(f"WITH {mesh_sql()}, {_CORNERS}", f"WITH {mesh_sql()}, {_CORNERS.replace('JOIN vertices', 'JOIN vertices_d').replace('corners AS', 'corners_d AS').replace('FROM corners', 'FROM corners_d').replace('cross_', 'cross_d').replace('faces AS', 'faces_d AS')}".replace("raw AS", "vertices_d AS (SELECT mesh_id, v_idx, x % 3 AS x, y % 4 AS y, 0.0 AS z FROM vertices), raw AS")))
def mesh_diagnostics(spark, sf_dir):
    v, t = lifts.grid_mesh(spark, sf_dir)
    folded = v.select("mesh_id", "v_idx", (F.col("x") % 3).alias("x"), (F.col("y") % 4).alias("y"), F.lit(0.0).alias("z"))
    return mesh.diagnostics(folded, t)


@query(f"WITH {mesh_sql()}, {_CORNERS} SELECT mesh_id, t_idx, a, c AS b, b AS c FROM faces WHERE n2 * 0.5 > 1.1920929e-07")
def mesh_flip_and_clean(spark, sf_dir):
    v, t = lifts.grid_mesh(spark, sf_dir)
    return mesh.flipped(mesh.without_degenerate(v, t))


@query(f"WITH {mesh_sql()} SELECT 0 AS mesh_id, t_idx + mesh_id * 242 AS t_idx, a + mesh_id * 144 AS a, b + mesh_id * 144 AS b, c + mesh_id * 144 AS c FROM triangles")
def merge_meshes(spark, sf_dir):
    return mesh.merged(*lifts.grid_mesh(spark, sf_dir))[1]


@query(f"""WITH {mesh_sql()}, f AS (SELECT mesh_id, v_idx, floor(x / 2) AS x, y AS y FROM vertices), w AS (SELECT mesh_id, v_idx, min(v_idx) OVER (PARTITION BY mesh_id, x, y) AS k FROM f),
 o AS (SELECT t.mesh_id, t.t_idx, p.k AS a, q.k AS b, s.k AS c FROM triangles t JOIN w p ON p.mesh_id = t.mesh_id AND p.v_idx = t.a JOIN w q ON q.mesh_id = t.mesh_id AND q.v_idx = t.b JOIN w s ON s.mesh_id = t.mesh_id AND s.v_idx = t.c)
 SELECT * FROM o WHERE a <> b AND b <> c AND a <> c""")
def weld_vertices(spark, sf_dir):
    v, t = lifts.grid_mesh(spark, sf_dir)
    return mesh.welded(v.select("mesh_id", "v_idx", F.floor(F.col("x") / 2).alias("x"), "y", F.lit(0.0).alias("z")), t)[1]


@query(f"""WITH {mesh_sql()}, {_EDGES}, {_NEAR}, m1 AS (SELECT n.mesh_id, n.v_idx, avg(v.z) AS z FROM near n JOIN vertices v ON v.mesh_id = n.mesh_id AND v.v_idx = n.other GROUP BY 1, 2),
 s1 AS (SELECT v.mesh_id, v.v_idx, v.z * 0.5 + coalesce(m1.z, v.z) * 0.5 AS z FROM vertices v LEFT JOIN m1 USING (mesh_id, v_idx)),
 m2 AS (SELECT n.mesh_id, n.v_idx, avg(v.z) AS z FROM near n JOIN s1 v ON v.mesh_id = n.mesh_id AND v.v_idx = n.other GROUP BY 1, 2)
 SELECT v.mesh_id, v.v_idx, {r('v.z * 0.5 + coalesce(m2.z, v.z) * 0.5', 'z')} FROM s1 v LEFT JOIN m2 USING (mesh_id, v_idx)""")
def laplacian_smooth(spark, sf_dir):
    v, t = lifts.grid_mesh(spark, sf_dir)
    return mesh.smoothed(v, t, 2, 0.5).select("mesh_id", "v_idx", tidy(F.col("z")).alias("z"))


@query(f"""WITH {mesh_sql()}, {_CORNERS}, c AS (SELECT *, sum(n2 * 0.5) OVER (PARTITION BY mesh_id ORDER BY t_idx) AS upto, sum(n2 * 0.5) OVER (PARTITION BY mesh_id) AS total FROM faces),
 s AS (SELECT i AS s_idx, m.mesh_id, (i + 0.5) / 50 AS t FROM range(50) q(i), (SELECT DISTINCT mesh_id FROM triangles) m), p AS (SELECT s.*, (SELECT min(t_idx) FROM c WHERE c.mesh_id = s.mesh_id AND c.upto / c.total >= s.t) AS t_idx FROM s)
 SELECT p.s_idx, p.mesh_id, p.t_idx, {r('ax * (1 - sqrt(t)) + bx * sqrt(t) * (1 - v) + cx * sqrt(t) * v', 'x')} FROM (SELECT *, s_idx * 0.618034 - floor(s_idx * 0.618034) AS v FROM p) p JOIN corners c ON c.mesh_id = p.mesh_id AND c.t_idx = p.t_idx""")
def sample_points_uniform(spark, sf_dir):
    return mesh.samples(*lifts.grid_mesh(spark, sf_dir), 50).select("s_idx", "mesh_id", "t_idx", tidy(F.col("x")).alias("x"))


_PLACE = "vec_id // 144 * 12 + 5.5 + 8 * CAST(embedding[5] AS DOUBLE) AS {p}x, 5.5 + 8 * CAST(embedding[6] AS DOUBLE) AS {p}y, {z} AS {p}z"
_RAYS = f"rays AS (SELECT vec_id AS ray, {_PLACE.format(p='o', z='-50.0')} FROM embeddings)"


def _places(spark, sf_dir, prefix: str, name: str):
    """A place over its own grid for each embedding, with its other components."""
    e = lambda k: F.col("embedding")[k].cast("double")
    own = F.floor(F.col("vec_id") / 144)
    return lifts.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(name), own.cast("int").alias("mesh_id"), (own * 12 + 5.5 + 8 * e(4)).alias(f"{prefix}x"), (5.5 + 8 * e(5)).alias(f"{prefix}y"), (2 + 8 * e(6)).alias(f"{prefix}z"))


@query(f"""WITH {mesh_sql()}, {_CORNERS}, {_RAYS}, h AS (SELECT ray, mesh_id, t_idx, nx, ny, nz, n2, (ox - ax) * nx + (oy - ay) * ny + (oz - az) * nz AS above, nz AS facing, ax, ay, bx, by_, cx, cy, ox, oy FROM rays JOIN faces
 ON ox BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx) AND oy BETWEEN least(ay, by_, cy) AND greatest(ay, by_, cy)),
 w AS (SELECT *, ((by_ - cy) * (ox - cx) + (cx - bx) * (oy - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS u, ((cy - ay) * (ox - cx) + (ax - cx) * (oy - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS v FROM h)
 SELECT ray, mesh_id, t_idx, {r('-above / facing', 'distance')} FROM w WHERE u >= -1.1920929e-07 AND v >= -1.1920929e-07 AND u + v <= 1 + 1.1920929e-07""")
def mesh_ray_hits(spark, sf_dir):
    rays = _places(spark, sf_dir, "o", "ray").drop("mesh_id").withColumns({"oz": F.lit(-50.0), "dx": F.lit(0.0), "dy": F.lit(0.0), "dz": F.lit(1.0)})
    return mesh.ray_hits(rays, *lifts.grid_mesh(spark, sf_dir)).withColumn("distance", tidy(F.col("distance")))


def _segment(p: str, q: str) -> str:
    """Squared distance of the query from the segment between two corners."""
    at = lambda c, k: "by_" if c + k == "by" else c + k
    d = {k: f"({at(q, k)} - {at(p, k)})" for k in "xyz"}
    t = f"greatest(0, least(1, ({' + '.join(f'(q{k} - {at(p, k)}) * {d[k]}' for k in 'xyz')}) / ({' + '.join(f'{d[k]} * {d[k]}' for k in 'xyz')})))"
    return " + ".join(f"pow(q{k} - {at(p, k)} - {t} * {d[k]}, 2)" for k in "xyz")


@query(f"""WITH {mesh_sql()}, {_CORNERS}, q AS (SELECT vec_id AS query, vec_id // 144 AS own, {_PLACE.format(p='q', z='2 + 8 * CAST(embedding[7] AS DOUBLE)')} FROM embeddings),
 h AS (SELECT *, ((qx - ax) * nx + (qy - ay) * ny + (qz - az) * nz) / n2 AS above FROM q JOIN faces ON mesh_id = own), f AS (SELECT *, qx - above * nx / n2 AS fx, qy - above * ny / n2 AS fy FROM h),
 w AS (SELECT *, ((by_ - cy) * (fx - cx) + (cx - bx) * (fy - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS u, ((cy - ay) * (fx - cx) + (ax - cx) * (fy - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS v FROM f)
 SELECT query, mesh_id, {r("sqrt(min(CASE WHEN u >= 0 AND v >= 0 AND u + v <= 1 THEN above * above ELSE least(" + _segment("a", "b") + ", " + _segment("b", "c") + ", " + _segment("c", "a") + ") END))", "distance")} FROM w GROUP BY 1, 2""")
def mesh_closest_points(spark, sf_dir):
    """How far a place for each embedding lies from its own mesh."""
    found = mesh.closest_points(_places(spark, sf_dir, "q", "query"), *lifts.grid_mesh(spark, sf_dir))
    return found.select("query", "mesh_id", tidy(F.col("distance")).alias("distance"))
