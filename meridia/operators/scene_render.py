"""Whole scenes: trees of groups and shapes placed in the world, taken apart into primitives, projected and put in painter's order.

``nodes(scene, id, parent, k, kind, tx, ty, tz, qx, qy, qz, qw, sx, sy, sz, fill, stroke, stroke_width, opacity, visible, points, faces, size, radius,
closed)``: ``k`` is the place among siblings. ``kind`` is group, point, line, polyline, mesh, box or sphere; ``points`` are a shape's points
(one for a point, a box's centre and a sphere's), ``faces`` a mesh's triangles, ``size`` a box's extent. What is null of a style is inherited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import Rule, finite, within
from ..functions.text import short_number
from ..functions.vectors import EPSILON, Quat, Vec, absolute, greatest, held
from .tables import by_ranges, written

COLOUR = "struct<r:int,g:int,b:int,a:int>"
#: the style at the top of a scene: fill, stroke, stroke width, opacity (fixed values)
TOP_STYLE = ((220, 225, 232, 255), (25, 25, 25, 255), 1.0, 1.0)
#: a box's triangles by its corners, which count x first, then y against the sun, below before above (fixed values)
BOX_FACES = [(0, 1, 2), (0, 2, 3), (4, 6, 5), (4, 7, 6), (0, 4, 5), (0, 5, 1), (1, 5, 6), (1, 6, 2), (2, 6, 7), (2, 7, 3), (3, 7, 4), (3, 4, 0)]
BOX_CORNERS = [(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]
PARTS = ["tx", "ty", "tz", "qx", "qy", "qz", "qw", "sx", "sy", "sz"]


def node_rules() -> list[Rule]:
    """What each node of a scene must keep."""
    turn = F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2 + F.col("qw") ** 2
    return [
        finite(*PARTS),
        (turn > 0, "a rotation must not be zero"),
        ((F.col("sx") != 0) & (F.col("sy") != 0) & (F.col("sz") != 0), "scales must not be zero"),
        (F.col("stroke_width").isNull() | (F.col("stroke_width") > 0), "a stroke's width must be positive"),
        (F.col("opacity").isNull() | within("opacity", 0, 1)[0], "opacity must lie between 0 and 1"),
        (~F.col("kind").isin("point", "sphere") | (F.col("radius") > 0), "a radius must be positive"),
        ((F.col("kind") != "box") | ((F.col("size.x") != 0) & (F.col("size.y") != 0) & (F.col("size.z") != 0)), "a box must have an extent"),
    ]


def root_paths(nodes: DataFrame, keys: list[str], local: Column) -> DataFrame:
    """(keys, id, path): what ``local`` holds for each node from its root down to itself, for nodes that hang on a root.

    Each round joins a node's path to that of the node where it ends, so that a path of any length takes the
    logarithm of it in rounds. A node that is its own ancestor is an error.
    """
    start = nodes.where("id IS NOT NULL").select(*keys, "id", F.col("parent").alias("up"), F.array("id").alias("ids"), F.array(local).alias("path"))
    state = written(start, "paths")
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(*keys, F.col("id").alias("up"), F.col("up").alias("next"), F.col("ids").alias("ids_above"), F.col("path").alias("above"))
        moved = state.where("up IS NOT NULL").join(above, [*keys, "up"])
        ids = F.concat("ids_above", "ids")
        turning = F.coalesce(F.array_contains(ids, F.col("next")), F.lit(False)) | (F.size(F.array_distinct(ids)) < F.size(ids))
        ids = F.when(turning, F.raise_error(F.lit("a node must not be its own ancestor")).cast("array<bigint>")).otherwise(ids.cast("array<bigint>"))
        moved = moved.select(*keys, "id", F.col("next").alias("up"), ids.alias("ids"), F.concat("above", "path").alias("path"))
        state = written(state.where("up IS NULL").select(*keys, "id", "up", F.col("ids").cast("array<bigint>").alias("ids"), "path").unionByName(moved), "paths")
    return state.select(*keys, "id", "path")


def _colour(values: tuple[int, ...] | None) -> Column:
    return F.lit(None).cast(COLOUR) if values is None else F.struct(*(F.lit(v).alias(c) for v, c in zip(values, "rgba"))).cast(COLOUR)


def placed(nodes: DataFrame) -> DataFrame:
    """``nodes`` that can be seen, with their place in the world: ``level``, ``place`` (the child numbers from the root), ``world``, a struct of
    translation, rotation and scale, and the style with all that is inherited. A node that isn't visible hides what is below it."""
    fill, stroke, width, opacity = TOP_STYLE
    nodes, unit = held(nodes, unit=Quat(*(F.col(q).cast("double") for q in PARTS[3:7])).normalised())
    turned = [*PARTS[:3], *(c.alias(q) for c, q in zip(unit, PARTS[3:7])), *PARTS[7:]]
    local = F.struct("k", *turned, F.col("fill").cast(COLOUR).alias("fill"), F.col("stroke").cast(COLOUR).alias("stroke"), F.col("stroke_width").cast("double").alias("stroke_width"), F.col("opacity").cast("double").alias("opacity"), "visible")
    top = F.struct(
        *(F.lit(float(p in ("qw", "sx", "sy", "sz"))).alias(p) for p in PARTS),
        _colour(fill).alias("fill"), _colour(stroke).alias("stroke"), F.lit(width).alias("stroke_width"), F.lit(opacity).alias("opacity"), F.lit(True).alias("visible"),
    )

    def below(up: Column, own: Column) -> Column:
        of = lambda s, kind, names: kind(*(s[n].cast("double") for n in names))
        turn, scale = of(up, Quat, PARTS[3:7]), of(up, Vec, PARTS[7:])
        # rotations are of length one from the start, and products of such are too
        v, axis = of(own, Vec, PARTS[:3]).times(scale), Vec(turn.x, turn.y, turn.z)
        side = axis.cross(v) * 2.0
        move = of(up, Vec, PARTS[:3]) + v + side * turn.w + axis.cross(side)
        both = [*move, *(turn * of(own, Quat, PARTS[3:7])), *scale.times(of(own, Vec, PARTS[7:]))]
        style = [F.coalesce(own[s], up[s]).alias(s) for s in ("fill", "stroke", "stroke_width", "opacity")]
        # hidden stays hidden
        return F.struct(*(c.alias(p) for c, p in zip(both, PARTS)), *style, (up["visible"] & F.coalesce(own["visible"], F.lit(True))).alias("visible"))

    paths = root_paths(nodes, ["scene"], local)
    paths = paths.select(
        "scene", "id", (F.size("path") - 1).alias("level"), F.transform(F.expr("slice(path, 2, size(path))"), lambda p: p["k"]).alias("place"),
        F.element_at("path", 1)["k"].alias("_first"), F.aggregate("path", top, below).alias("_w"),
    )
    paths = paths.where("_w.visible").withColumn("place", F.concat(F.array("_first"), "place"))
    style = ["fill", "stroke", "stroke_width", "opacity"]
    paths = paths.select("scene", "id", "level", "place", F.struct(*(F.col(f"_w.{p}").alias(p) for p in PARTS)).alias("world"), *(F.col(f"_w.{s}").alias(s) for s in style))
    return nodes.drop("visible", *style, *PARTS, *(f"_unit_{k}" for k in range(4))).join(paths, ["scene", "id"])


def primitives(nodes: DataFrame) -> DataFrame:
    """(scene, id, place, part, tag, corners, radius, fill, stroke, stroke_width, opacity) of ``placed`` nodes, corners in the world.

    Each triangle of a mesh or box is a polygon of its own; groups have none.
    """
    c, s = Vec(F.col("points")[0]["x"], F.col("points")[0]["y"], F.col("points")[0]["z"]), Vec(*(F.col("size")[a] * 0.5 for a in "xyz"))
    corners = F.array(*(F.struct(*(v.alias(a) for v, a in zip(c + s.times(Vec.of(*at)), "xyz"))) for at in BOX_CORNERS))
    box = F.col("kind") == "box"
    rows = nodes.where("kind <> 'group'")
    rows = rows.withColumn("points", F.when(box, corners).otherwise(F.col("points")))
    faces = F.when(box, F.array(*(F.array(*map(F.lit, f)) for f in BOX_FACES))).when(F.col("kind") == "mesh", F.col("faces"))
    picked = F.transform(faces, lambda f: F.transform(f, lambda k: F.element_at("points", k + 1)))
    rows = rows.withColumn("parts", F.coalesce(picked, F.array("points")))
    tag = F.when(F.col("kind").isin("point", "sphere"), "circle").when(F.col("kind") == "line", "line")
    tag = tag.when((F.col("kind") == "polyline") & ~F.coalesce("closed", F.lit(False)), "polyline").otherwise("polygon")
    w = F.col("world")
    move, turn, scale = Vec(*(w[p] for p in PARTS[:3])), Quat(*(w[p] for p in PARTS[3:7])), Vec(*(w[p] for p in PARTS[7:]))
    rows, move, turn, scale = held(rows, move=move, turn=turn.matrix(), scale=scale)

    def apply(p: Column) -> Column:
        at = move + turn.apply(Vec(p["x"], p["y"], p["z"]).times(scale))
        return F.struct(*(v.alias(a) for v, a in zip(at, "xyz")))

    wide = F.when(F.col("kind") == "sphere", F.col("radius") * greatest(absolute(scale.x), absolute(scale.y))).otherwise(F.col("radius"))
    rows = rows.select("scene", "id", "kind", "place", tag.alias("tag"), wide.alias("radius"), "fill", "stroke", "stroke_width", "opacity", F.posexplode(F.transform("parts", lambda p: F.transform(p, apply))).alias("part", "corners"))
    return rows


def projected(shapes: DataFrame, cameras: DataFrame) -> DataFrame:
    """``primitives`` as seen by their scene's camera: ``corners`` in pixels, ``depth`` their mean distance, ``radius`` in pixels.

    ``cameras(scene, perspective, eye, target, up, field, near, far, width, height)``: vectors as structs, ``field`` the vertical angle in degrees, or the
    height of an orthographic view in the world. With a perspective, a primitive with a corner not between near and far is left out, as is a
    polyline of fewer than two points.
    """
    vec = lambda name: Vec(*(F.col(name)[a].cast("double") for a in "xyz"))
    focal = F.when(F.col("perspective"), F.col("height") / (2.0 * F.tan(F.radians("field") * 0.5))).otherwise(F.col("height") / F.col("field"))
    # one after the other: each is made of columns, not of what made them
    views, eye, forward, focal = held(cameras, eye=vec("eye"), forward=(vec("target") - vec("eye")).normalised(), focal=focal)
    views, right = held(views, right=forward.cross(vec("up")).normalised())
    views, up = held(views, over=right.cross(forward).normalised())
    rows = shapes.join(views, "scene")
    deep = F.col("perspective")

    def seen(p: Column) -> Column:
        to = Vec(p["x"], p["y"], p["z"]) - eye
        depth = to.dot(forward)
        factor = F.when(deep, focal / depth).otherwise(focal)
        inside = ~deep | ((depth > F.col("near")) & (depth < F.col("far")))
        return F.when(inside, F.struct((F.col("width") * 0.5 + to.dot(right) * factor).alias("x"), (F.col("height") * 0.5 - to.dot(up) * factor).alias("y"), depth.alias("depth")))

    rows = rows.withColumn("corners", F.transform("corners", seen))
    rows = rows.where(F.forall("corners", lambda c: c.isNotNull()) & ((F.col("kind") != "polyline") | (F.size("corners") >= 2)))
    depth = F.aggregate("corners", F.lit(0.0), lambda s, c: s + c["depth"]) / F.size("corners")
    rows = rows.withColumn("depth", depth)
    pixels = F.col("radius") * F.when(deep, focal / F.greatest("depth", F.lit(EPSILON))).otherwise(focal)
    return rows.select("scene", "id", "place", "part", "tag", "corners", "depth", F.when(F.col("kind") == "sphere", pixels).otherwise(F.col("radius")).alias("radius"), "fill", "stroke", "stroke_width", "opacity")


def _hex(colour: str) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(F.col(f"{colour}.{c}"))), 2, "0") for c in "rgb"))


def _paint(name: str, colour: Column, alpha: Column) -> Column:
    return F.concat(F.lit(f'{name}="'), colour, F.lit(f'" {name}-opacity="'), short_number(alpha / 255.0), F.lit('"'))


def markup(shapes: DataFrame) -> DataFrame:
    """``projected`` primitives with ``svg``, the element of each."""
    c = lambda k, a: short_number(F.element_at("corners", k)[a])
    at = lambda **parts: F.concat(*(x for n, v in parts.items() for x in (F.lit(f' {n}="'), v, F.lit('"'))))
    listed = F.array_join(F.transform("corners", lambda p: F.concat(short_number(p["x"]), F.lit(","), short_number(p["y"]))), " ")
    where = F.when(F.col("tag") == "circle", at(cx=c(1, "x"), cy=c(1, "y"), r=short_number(F.col("radius"))))
    where = where.when(F.col("tag") == "line", at(x1=c(1, "x"), y1=c(1, "y"), x2=c(2, "x"), y2=c(2, "y"))).otherwise(at(points=listed))
    fill = F.when(F.col("tag").isin("line", "polyline"), 'fill="none"').otherwise(_paint("fill", _hex("fill"), F.col("fill.a")))
    stroke = F.concat(_paint("stroke", _hex("stroke"), F.col("stroke.a")), F.lit(' stroke-width="'), short_number(F.col("stroke_width")), F.lit('"'))
    style = F.concat(fill, F.lit(" "), stroke, F.lit(' opacity="'), short_number(F.col("opacity")), F.lit('" vector-effect="non-scaling-stroke"'))
    return shapes.withColumn("svg", F.concat(F.lit("<"), "tag", where, F.lit(" "), style, F.lit("/>")))


def in_painters_order(shapes: DataFrame) -> DataFrame:
    """``shapes`` with ``layer``, their place in their scene from 0: far before near, then as they stand in the tree. Goes by ranges of the
    order over all scenes, so that one large scene is many tasks."""
    placed = by_ranges(shapes, ["scene", F.desc("depth"), "place", "part"], F.lit(1))
    at = F.col("_before") + F.col("_row")
    placed = placed.withColumn("_place", at)
    # a row for each scene
    first = written(placed.groupBy("scene").agg(F.min("_place").alias("_first")), "scene-begins")
    out = placed.join(first, "scene").withColumn("layer", (F.col("_place") - F.col("_first")).cast("long"))
    return out.drop("_at", "_size", "_part", "_row", "_before", "_sum", "_place", "_first")


def drawings(shapes: DataFrame, cameras: DataFrame, piece: int = 2000) -> DataFrame:
    """(scene, piece, content): the drawings of ``projected`` primitives in pieces of at most that many elements, which joined in order are one SVG.

    Cameras without primitives give an empty drawing. No task holds more than a piece.
    """
    rows = in_painters_order(markup(shapes)).select("scene", F.floor(F.col("layer") / piece).alias("piece"), "layer", "svg")
    bodies = rows.groupBy("scene", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", "svg"))), lambda s: s["svg"]), "").alias("body"))
    bodies = written(bodies, "pieces")
    last = bodies.groupBy("scene").agg(F.max("piece").alias("last"))
    w, h = F.col("width").cast("string"), F.col("height").cast("string")
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), w, F.lit('" height="'), h, F.lit('" viewBox="0 0 '), w, F.lit(" "), h, F.lit('" role="img">'))
    out = cameras.select("scene", head.alias("head")).join(last, "scene", "left").join(bodies, "scene", "left")
    number = F.coalesce("piece", F.lit(0).cast("long"))
    body = F.concat(F.when(number == 0, F.col("head")).otherwise(""), F.coalesce("body", F.lit("")), F.when(number == F.coalesce("last", F.lit(0)), "</svg>").otherwise(""))
    return out.select("scene", number.alias("piece"), body.alias("content"))

