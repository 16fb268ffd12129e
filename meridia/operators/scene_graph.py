"""Scene trees: nodes(id, parent, tx, ty, tz, scale, visible, colour), flattened and drawn as vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_xml, short_number
from .scene_render import root_paths
from .tables import written


def flattened(nodes: DataFrame) -> DataFrame:
    """(id, depth, x, y, z, scale, colour): each node's place in the world. A node that isn't visible hides what is below it; a
    colour that is null is inherited. Paths from the roots are found by doubling, and folded in one expression a node."""
    names = ["tx", "ty", "tz", "scale"]
    local = F.struct(*(F.col(n).cast("double").alias(n) for n in names), F.col("colour").cast("string").alias("colour"), F.coalesce("visible", F.lit(False)).alias("visible"))
    top = F.struct(*(F.lit(float(n == "scale")).alias(n) for n in names), F.lit(None).cast("string").alias("colour"), F.lit(True).alias("visible"))

    def below(up: Column, own: Column) -> Column:
        at = [(up[n] + up["scale"] * own[n]).alias(n) for n in names[:3]]
        return F.struct(*at, (up["scale"] * own["scale"]).alias("scale"), F.coalesce(own["colour"], up["colour"]).alias("colour"), (up["visible"] & own["visible"]).alias("visible"))

    rows = root_paths(nodes, [], local).select("id", (F.size("path") - 1).alias("depth"), F.aggregate("path", top, below).alias("w")).where("w.visible")
    return rows.select("id", "depth", *(F.col(f"w.{n}").alias(a) for n, a in zip(names, ("x", "y", "z", "scale"))), F.col("w.colour").alias("colour"))


def projected(points: DataFrame, width: float, height: float, focal: float | None, near: float = 0.01, far: float = 1e6) -> DataFrame:
    """With sx, sy: orthographic, or with a focal length perspective, which leaves out what isn't between near and far."""
    if focal is None:
        return points.withColumn("sx", F.col("x") + width / 2).withColumn("sy", height / 2 - F.col("y"))
    inside = points.where((F.col("z") > near) & (F.col("z") < far))
    return inside.withColumn("sx", F.col("x") * focal / F.col("z") + width / 2).withColumn("sy", height / 2 - F.col("y") * focal / F.col("z"))


def svg(drawn: DataFrame, width: int, height: int, label: Column | None = None) -> DataFrame:
    """(drawing, content): circles of ``drawn(drawing, id, sx, sy, z, scale, colour)`` from far to near. For drawings of a size a task may hold."""
    title = F.concat(F.lit("<title>"), escape_xml(label), F.lit("</title>")) if label is not None else F.lit("")
    shape = F.concat(F.lit('<circle cx="'), short_number(F.col("sx")), F.lit('" cy="'), short_number(F.col("sy")), F.lit('" r="'), short_number(F.col("scale")), F.lit('" fill="'), escape_xml(F.coalesce("colour", F.lit("black"))), F.lit('">'), title, F.lit("</circle>"))
    layer = F.struct((-F.col("z")).alias("far"), "id", shape.alias("shape"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(layer)), lambda s: s["shape"]), "")
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">'
    return drawn.groupBy("drawing").agg(F.concat(F.lit(head), body, F.lit("</svg>")).alias("content"))


#: the schema and version that scene files name (fixed values of the format)
SCHEMA, VERSION = "scene-vector-3d", "0.1"
_VECTOR = "struct<x:double,y:double,z:double>"
_NODE = f"struct<kind:string,id:string,transform:struct<translation:{_VECTOR},rotation:struct<x:double,y:double,z:double,w:double>,scale:{_VECTOR}>,style:struct<visible:boolean>,children:array<string>>"


def from_json(scenes: DataFrame) -> DataFrame:
    """(scene, id, parent, depth, place, kind, tx, ty, tz, qx, qy, qz, qw, sx, sy, sz, visible) of ``scenes(scene, json)``.

    Nodes are unfolded one level a round; ``place`` is a node's path of child numbers. Other schemas or versions are errors.
    """
    document = F.from_json("json", "struct<schema:string,version:string,root:string>")
    good = (F.col("d.schema") == SCHEMA) & (F.col("d.version") == VERSION)
    level = scenes.select("scene", document.alias("d")).select(
        "scene", F.when(good, F.col("d.root")).otherwise(F.raise_error(F.lit(f"a scene must be {SCHEMA} {VERSION}"))).alias("node"),
        F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.array(F.lit(0)).alias("place"),
    )
    out = None
    while True:
        level = written(level.withColumn("n", F.from_json("node", _NODE)).drop("node"), "nodes")
        t = "n.transform"
        rows = level.select(
            "scene", F.col("n.id").alias("id"), "parent", "depth", "place", F.col("n.kind").alias("kind"),
            *(F.coalesce(F.col(f"{t}.translation.{k}"), F.lit(0.0)).alias(f"t{k}") for k in "xyz"),
            *(F.coalesce(F.col(f"{t}.rotation.{k}"), F.lit(float(k == "w"))).alias(f"q{k}") for k in "xyzw"),
            *(F.coalesce(F.col(f"{t}.scale.{k}"), F.lit(1.0)).alias(f"s{k}") for k in "xyz"), F.coalesce("n.style.visible", F.lit(True)).alias("visible"),
        )
        out = rows if out is None else out.unionByName(rows)
        below = level.select("scene", F.col("n.id").alias("parent"), (F.col("depth") + 1).alias("depth"), "place", F.posexplode("n.children").alias("k", "node"))
        level = below.select("scene", "node", "parent", "depth", F.concat("place", F.array("k")).alias("place"))
        if level.isEmpty():
            return out


def to_json(nodes: DataFrame, width: int, height: int) -> DataFrame:
    """(scene, json): scene files of ``nodes(scene, id, parent, depth, place, kind, tx.., qx.., sx.., visible)``, as ``from_json`` gives them.

    Nodes are folded into their parents one level a round, from the deepest up. A scene is one row.
    """
    of = lambda p, keys: F.struct(*(F.col(f"{p}{k}").alias(k) for k in keys))
    transform = F.struct(of("t", "xyz").alias("translation"), of("q", "xyzw").alias("rotation"), of("s", "xyz").alias("scale"))
    own = F.to_json(F.struct("kind", "id", transform.alias("transform"), F.struct("visible").alias("style")))
    rows = written(nodes.select("scene", "depth", "place", own.alias("own")), "nodes")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    below = None
    for depth in range(deepest, -1, -1):
        level = rows.where(F.col("depth") == depth)
        level = level.withColumn("children", F.lit("")) if below is None else level.join(below, ["scene", "place"], "left")
        body = F.concat(F.expr("substring(own, 1, length(own) - 1)"), F.lit(',"children":['), F.coalesce("children", F.lit("")), F.lit("]}"))
        level = level.select("scene", F.expr("slice(place, 1, size(place) - 1)").alias("place"), F.element_at("place", -1).alias("k"), body.alias("body"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "body"))), lambda s: s["body"])
        below = written(level.groupBy("scene", "place").agg(F.array_join(listed, ",").alias("children")), "level")
    head = F.lit(f'{{"schema":"{SCHEMA}","version":"{VERSION}","viewport":{{"width":{width},"height":{height}}},"root":')
    return below.select("scene", F.concat(head, "children", F.lit("}")).alias("json"))
