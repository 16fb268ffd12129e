"""Queries that place, take apart, project and draw whole scenes, over trees lifted from the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..functions.vectors import tidy
from ..operators import scene_render
from . import lifts
from .lifts import r
from .registry import query

KINDS = ("point", "line", "polyline", "mesh", "box", "sphere")


def nodes(spark, sf_dir):
    """Four scenes, each a tree of three children a node; nodes with children are groups, the others shapes of six kinds."""
    v = lifts.table(spark, sf_dir, "embeddings")
    e = lambda k: F.col("embedding")[k].cast("double")
    i = F.floor(F.col("vec_id") / 4)
    v = v.withColumns({"scene": (F.col("vec_id") % 4).cast("int"), "id": i})
    sizes = v.groupBy("scene").agg(F.count("*").alias("n"))
    v = v.join(sizes, "scene")
    point = lambda k: F.struct(e(k).alias("x"), e(k + 1).alias("y"), e(k + 2).alias("z"))
    colour = lambda a, b: F.struct(*((c % 256).cast("int").alias(n) for c, n in zip((F.col("id"), F.col("id") * a, F.col("id") * b, F.lit(200)), "rgba")))
    shape = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("id") % 6 + 1).cast("int"))
    count = F.when(F.col("kind").isin("polyline", "mesh"), 4).when(F.col("kind") == "line", 2).otherwise(1)
    out = v.select(
        "scene", "id", F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 3)).alias("parent"), ((F.col("id") + 2) % 3).cast("int").alias("k"),
        F.when(F.col("id") * 3 + 1 < F.col("n"), "group").otherwise(shape).alias("kind"),
        *((e(k) * 2).alias(f"t{a}") for k, a in enumerate("xyz")), *(e(k + 3).alias(f"q{a}") for k, a in enumerate("xyz")), (e(6) + 0.7).alias("qw"),
        *((1 + e(k + 7)).alias(f"s{a}") for k, a in enumerate("xyz")),
        F.when(F.col("id") % 5 == 0, colour(7, 13)).alias("fill"), F.when(F.col("id") % 7 == 0, colour(11, 3)).alias("stroke"),
        F.when(F.col("id") % 6 == 0, 1 + (F.col("id") % 4) * 0.5).alias("stroke_width"), F.when(F.col("id") % 4 == 1, 0.5 + (F.col("id") % 5) / 10).alias("opacity"),
        F.when(F.col("id") % 17 == 3, False).alias("visible"),
        F.array(*(point(10 + 3 * k) for k in range(4))).alias("points"), F.expr("array(array(0, 1, 2), array(0, 2, 3))").alias("faces"),
        F.struct(*((0.2 + F.abs(e(k + 13))).alias(a) for k, a in enumerate("xyz"))).alias("size"), (1 + F.abs(e(16)) * 4).alias("radius"), (F.col("id") % 2 == 0).alias("closed"),
    )
    return out.withColumn("points", F.slice("points", F.lit(1), count))


def cameras(spark, sf_dir):
    """A camera a scene: perspective for the even ones, orthographic for the odd."""
    s = lifts.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).cast("int").alias("scene")).distinct()
    vec = lambda x, y, z: F.struct(*(F.lit(v).cast("double").alias(a) for v, a in zip((x, y, z), "xyz")))
    eye = F.struct((F.col("scene") - 1.5).alias("x"), F.lit(0.5).alias("y"), F.lit(-4.0).alias("z"))
    return s.select("scene", (F.col("scene") % 2 == 0).alias("perspective"), eye.alias("eye"), vec(0, 0, 0).alias("target"), vec(0, 1, 0).alias("up"),
        F.when(F.col("scene") % 2 == 0, 50.0).otherwise(6.0).alias("field"), F.lit(3.0).alias("near"), F.lit(6.0).alias("far"), F.lit(320).alias("width"), F.lit(240).alias("height"))


def _e(k: int) -> str:
    return f"CAST(embedding[{k + 1}] AS DOUBLE)"


def _point(k: int) -> str:
    return "{" + ", ".join(f"'{a}': {_e(k + j)}" for j, a in enumerate("xyz")) + "}"


def _turned(q: str, v: tuple[str, str, str]) -> list[str]:
    """A vector turned by a unit quaternion, by its rotation matrix."""
    x, y, z, w = (f"{q}{a}" for a in "xyzw")
    rows = [
        (f"1 - 2 * ({y} * {y} + {z} * {z})", f"2 * ({x} * {y} - {z} * {w})", f"2 * ({x} * {z} + {y} * {w})"),
        (f"2 * ({x} * {y} + {z} * {w})", f"1 - 2 * ({x} * {x} + {z} * {z})", f"2 * ({y} * {z} - {x} * {w})"),
        (f"2 * ({x} * {z} - {y} * {w})", f"2 * ({y} * {z} + {x} * {w})", f"1 - 2 * ({x} * {x} + {y} * {y})"),
    ]
    return [" + ".join(f"({m}) * ({c})" for m, c in zip(row, v)) for row in rows]


def _tree() -> str:
    """Nodes and what is visible of them in the world, by recursion from the roots."""
    norm = f"sqrt({_e(3)} * {_e(3)} + {_e(4)} * {_e(4)} + {_e(5)} * {_e(5)} + ({_e(6)} + 0.7) * ({_e(6)} + 0.7))"
    local = ", ".join([*(f"{_e(k)} * 2 AS t{a}" for k, a in enumerate("xyz")), *(f"{_e(k + 3)} / {norm} AS q{a}" for k, a in enumerate("xyz")), f"({_e(6)} + 0.7) / {norm} AS qw", *(f"1 + {_e(k + 7)} AS s{a}" for k, a in enumerate("xyz"))])
    colour = lambda a, b: f"{{'r': id % 256, 'g': id * {a} % 256, 'b': id * {b} % 256, 'a': 200}}"
    moved = _turned("t.q", ("t.sx * n.tx", "t.sy * n.ty", "t.sz * n.tz"))
    turn = [
        "t.qw * n.qx + t.qx * n.qw + t.qy * n.qz - t.qz * n.qy", "t.qw * n.qy - t.qx * n.qz + t.qy * n.qw + t.qz * n.qx",
        "t.qw * n.qz + t.qx * n.qy - t.qy * n.qx + t.qz * n.qw", "t.qw * n.qw - t.qx * n.qx - t.qy * n.qy - t.qz * n.qz",
    ]
    style = "coalesce(n.fill, t.fill), coalesce(n.stroke, t.stroke), coalesce(n.stroke_width, t.stroke_width), coalesce(n.opacity, t.opacity)"
    first = "coalesce(fill, {'r': 220, 'g': 225, 'b': 232, 'a': 255}), coalesce(stroke, {'r': 25, 'g': 25, 'b': 25, 'a': 255}), coalesce(stroke_width, 1), coalesce(opacity, 1)"
    names = "scene, id, level, place, tx, ty, tz, qx, qy, qz, qw, sx, sy, sz, fill, stroke, stroke_width, opacity, kind, points, size, radius, closed"
    world = "tx, ty, tz, qx, qy, qz, qw, sx, sy, sz"
    return f"""counted AS (SELECT *, CAST(vec_id % 4 AS INTEGER) AS scene, vec_id // 4 AS id, count(*) OVER (PARTITION BY vec_id % 4) AS n FROM embeddings),
nodes AS (SELECT scene, id, CASE WHEN id > 0 THEN (id - 1) // 3 END AS parent, (id + 2) % 3 AS k,
  CASE WHEN id * 3 + 1 < n THEN 'group' ELSE {list(KINDS)}[id % 6 + 1] END AS kind, {local},
  CASE WHEN id % 5 = 0 THEN {colour(7, 13)} END AS fill, CASE WHEN id % 7 = 0 THEN {colour(11, 3)} END AS stroke,
  CASE WHEN id % 6 = 0 THEN CAST(1 + (id % 4) * 0.5 AS DOUBLE) END AS stroke_width, CASE WHEN id % 4 = 1 THEN CAST(0.5 + (id % 5) / 10 AS DOUBLE) END AS opacity, id % 17 <> 3 AS visible,
  [{", ".join(_point(10 + 3 * k) for k in range(4))}] AS points, [{", ".join(f"0.2 + abs({_e(13 + k)})" for k in range(3))}] AS size, 1 + abs({_e(16)}) * 4 AS radius, id % 2 = 0 AS closed FROM counted),
tree({names}) AS (SELECT scene, id, 0, [k], {world}, {first}, kind, points, size, radius, closed FROM nodes WHERE parent IS NULL AND visible
 UNION ALL SELECT n.scene, n.id, t.level + 1, list_append(t.place, n.k), {", ".join(f"t.t{a} + {m}" for a, m in zip("xyz", moved))}, {", ".join(turn)}, t.sx * n.sx, t.sy * n.sy, t.sz * n.sz, {style}, n.kind, n.points, n.size, n.radius, n.closed
 FROM tree t JOIN nodes n ON n.scene = t.scene AND n.parent = t.id WHERE n.visible)"""


def _shapes() -> str:
    """Primitives in the world with their camera, from the tree."""
    corner = lambda x, y, z: f"{{'x': points[1].x + {x} * size[1] / 2, 'y': points[1].y + {y} * size[2] / 2, 'z': points[1].z + {z} * size[3] / 2}}"
    box = ", ".join(corner(*c) for c in scene_render.BOX_CORNERS)
    faces = ", ".join(f"[{', '.join(str(k + 1) for k in f)}]" for f in scene_render.BOX_FACES)
    at = _turned("q", ("sx * c.x", "sy * c.y", "sz * c.z"))
    return f"""parts AS (SELECT *, CASE kind WHEN 'point' THEN [points[:1]] WHEN 'sphere' THEN [points[:1]] WHEN 'line' THEN [points[:2]] WHEN 'polyline' THEN [points]
   WHEN 'mesh' THEN [[points[1], points[2], points[3]], [points[1], points[3], points[4]]]
   ELSE list_transform([{faces}], lambda f: list_transform(f, lambda k: ([{box}])[k])) END AS bodies FROM tree WHERE kind <> 'group'),
bodies AS (SELECT * EXCLUDE (bodies), unnest(bodies) AS body, generate_subscripts(bodies, 1) - 1 AS part FROM parts),
spread AS (SELECT *, unnest(body) AS c, generate_subscripts(body, 1) AS j FROM bodies),
worldly AS (SELECT *, tx + {at[0]} AS wx, ty + {at[1]} AS wy, tz + {at[2]} AS wz, scene - 1.5 AS ex, sqrt((1.5 - scene) * (1.5 - scene) + 0.25 + 16) AS reach, 0.5 AS ey, -4.0 AS ez FROM spread),
basis AS (SELECT *, -ex / reach AS fx, -0.5 / reach AS fy, 4 / reach AS fz FROM worldly),
sides AS (SELECT *, -fz / sqrt(fz * fz + fx * fx) AS rx, fx / sqrt(fz * fz + fx * fx) AS rz FROM basis),
seen AS (SELECT *, (wx - ex) * fx + (wy - ey) * fy + (wz - ez) * fz AS d, (wx - ex) * rx + (wz - ez) * rz AS u,
  (wx - ex) * (0 - rz * fy) + (wy - ey) * (rz * fx - rx * fz) + (wz - ez) * (rx * fy) AS v, CASE WHEN scene % 2 = 0 THEN 240 / (2 * tan(radians(25))) ELSE 240 / 6.0 END AS focal FROM sides),
pixels AS (SELECT *, 160 + u * focal / CASE WHEN scene % 2 = 0 THEN d ELSE 1 END AS px, 120 - v * focal / CASE WHEN scene % 2 = 0 THEN d ELSE 1 END AS py FROM seen),
shapes AS (SELECT scene, id, place, part, any_value(kind) AS kind, any_value(closed) AS closed, avg(d) AS depth, list(px ORDER BY j) AS xs, list(py ORDER BY j) AS ys, count(*) AS corners,
  CASE WHEN any_value(kind) = 'sphere' THEN any_value(radius) * greatest(abs(any_value(sx)), abs(any_value(sy))) * any_value(focal) / CASE WHEN scene % 2 = 0 THEN any_value(d) ELSE 1 END ELSE any_value(radius) END AS radius,
  any_value(fill) AS fill, any_value(stroke) AS stroke, any_value(stroke_width) AS stroke_width, any_value(opacity) AS opacity
  FROM pixels GROUP BY scene, id, place, part HAVING scene % 2 = 1 OR bool_and(d > 3 AND d < 6)),
tagged AS (SELECT *, CASE WHEN kind IN ('point', 'sphere') THEN 'circle' WHEN kind = 'line' THEN 'line' WHEN kind = 'polyline' AND NOT closed THEN 'polyline' ELSE 'polygon' END AS tag,
  row_number() OVER (PARTITION BY scene ORDER BY depth DESC, place, part) - 1 AS layer FROM shapes)"""


@query(f"WITH RECURSIVE {_tree()} SELECT scene, id, level, array_to_string(place, '.') AS place, kind, {', '.join(r(c, c) for c in scene_render.PARTS)}, fill.g AS fill_g, stroke.b AS stroke_b, {r('stroke_width', 'stroke_width')}, {r('opacity', 'opacity')} FROM tree")
def scene_placed(spark, sf_dir):
    out = scene_render.placed(nodes(spark, sf_dir))
    return out.select("scene", "id", "level", F.array_join(F.transform("place", lambda k: k.cast("string")), ".").alias("place"), "kind", *(tidy(F.col(f"world.{c}")).alias(c) for c in scene_render.PARTS),
        F.col("fill.g").cast("long").alias("fill_g"), F.col("stroke.b").cast("long").alias("stroke_b"), tidy(F.col("stroke_width")).alias("stroke_width"), tidy(F.col("opacity")).alias("opacity"))


def _seen(spark, sf_dir):
    return scene_render.projected(scene_render.primitives(scene_render.placed(nodes(spark, sf_dir))), cameras(spark, sf_dir))


@query(f"WITH RECURSIVE {_tree()}, {_shapes()} SELECT scene, id, CAST(part AS INTEGER) AS part, tag, layer, CAST(corners AS INTEGER) AS corners, {r('depth', 'depth')}, {r('list_sum(xs)', 'xs')}, {r('list_sum(ys)', 'ys')}, {r('radius', 'radius')} FROM tagged")
def render_items(spark, sf_dir):
    out = scene_render.in_painters_order(_seen(spark, sf_dir))
    total = lambda a: F.aggregate("corners", F.lit(0.0), lambda s, c: s + c[a])
    return out.select("scene", "id", "part", "tag", "layer", F.size("corners").alias("corners"), tidy(F.col("depth")).alias("depth"), tidy(total("x")).alias("xs"), tidy(total("y")).alias("ys"), tidy(F.col("radius")).alias("radius"))


def _number(value: str) -> str:
    return f"CASE WHEN regexp_replace(printf('%.3f', {value}), '\\.?0+$', '') IN ('-0', '') THEN '0' ELSE regexp_replace(printf('%.3f', {value}), '\\.?0+$', '') END"


def _elements() -> str:
    hexed = lambda c: " || ".join(["'#'", *(f"lpad(lower(to_hex({c}.{k})), 2, '0')" for k in "rgb")])
    alpha = lambda c: _number(f"{c}.a / 255.0")
    body = f"""CASE tag WHEN 'circle' THEN ' cx="' || {_number("xs[1]")} || '" cy="' || {_number("ys[1]")} || '" r="' || {_number("radius")} || '"'
   WHEN 'line' THEN ' x1="' || {_number("xs[1]")} || '" y1="' || {_number("ys[1]")} || '" x2="' || {_number("xs[2]")} || '" y2="' || {_number("ys[2]")} || '"'
   ELSE ' points="' || array_to_string(list_transform(range(1, len(xs) + 1), lambda i: ({_number("xs[i]")}) || ',' || ({_number("ys[i]")})), ' ') || '"' END"""
    fill = f"""CASE WHEN tag IN ('line', 'polyline') THEN 'fill="none"' ELSE 'fill="' || {hexed("fill")} || '" fill-opacity="' || {alpha("fill")} || '"' END"""
    stroke = f"""'stroke="' || {hexed("stroke")} || '" stroke-opacity="' || {alpha("stroke")} || '" stroke-width="' || {_number("stroke_width")} || '"'"""
    return f"""elements AS (SELECT scene, layer, '<' || tag || ({body}) || ' ' || ({fill}) || ' ' || ({stroke}) || ' opacity="' || {_number("opacity")} || '" vector-effect="non-scaling-stroke"/>' AS svg FROM tagged)"""


@query(f"""WITH RECURSIVE {_tree()}, {_shapes()}, {_elements()}, pieces AS (SELECT scene, layer // 50 AS piece, string_agg(svg, '' ORDER BY layer) AS body FROM elements GROUP BY 1, 2)
SELECT scene, piece, CASE WHEN piece = 0 THEN '<svg xmlns="http://www.w3.org/2000/svg" width="320" height="240" viewBox="0 0 320 240" role="img">' ELSE '' END || body ||
 CASE WHEN piece = max(piece) OVER (PARTITION BY scene) THEN '</svg>' ELSE '' END AS content FROM pieces""")
def scene_drawings(spark, sf_dir):
    return scene_render.drawings(_seen(spark, sf_dir), cameras(spark, sf_dir), piece=50)


@query("SELECT vec_id % 4 AS scene, vec_id // 4 AS id, CASE WHEN vec_id % 9 = 4 THEN 'scales must not be zero' WHEN vec_id // 4 % 6 = 0 AND vec_id % 5 = 2 THEN 'a stroke''s width must be positive' END AS invalid FROM embeddings")
def validate_scene(spark, sf_dir):
    number = F.col("id") * 4 + F.col("scene")
    rows = nodes(spark, sf_dir).withColumn("sy", F.when(number % 9 == 4, 0.0).otherwise(F.col("sy")))
    rows = rows.withColumn("stroke_width", F.when(number % 5 == 2, -F.col("stroke_width")).otherwise(F.col("stroke_width")))
    return checks.quarantined(rows, scene_render.node_rules()).select(F.col("scene").cast("long").alias("scene"), "id", F.col("_invalid").alias("invalid"))
