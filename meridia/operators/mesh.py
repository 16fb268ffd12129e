"""Meshes as two tables: vertices(mesh_id, v_idx, x, y, z) and triangles(mesh_id, t_idx, a, b, c)."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shapes import Box, Ray, Tri
from ..functions.vectors import EPSILON, Vec, held
from .graph import min_labels
from .tables import broadcast_if_small, written

KEY = "mesh_id"


def with_corners(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Triangles with the coordinates of their corners, as ax .. cz: three equi-joins on (mesh, vertex)."""
    out = triangles
    for corner in "abc":
        v = vertices.select(F.col(KEY), F.col("v_idx").alias(corner), *(F.col(k).cast("double").alias(f"{corner}{k}") for k in "xyz"))
        out = out.join(v, [KEY, corner])
    return out


def corners() -> Tri:
    return Tri(*(Vec(*(F.col(f"{c}{k}") for k in "xyz")) for c in "abc"))


def faces(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Area, unit normal (NULL if degenerate) and centroid of each triangle."""
    t = corners()
    normal, centre = t.normal(), t.centroid()
    return with_corners(vertices, triangles).select(
        KEY, "t_idx", "a", "b", "c", t.area().alias("area"),
        *(c.alias(f"n{k}") for k, c in zip("xyz", normal)), *(c.alias(f"m{k}") for k, c in zip("xyz", centre)),
    )


def measures(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Per mesh: surface area, enclosed volume and area-weighted centroid (degenerate faces don't count)."""
    t = corners()
    area, centre = t.area(), t.centroid()
    signed = t.a.dot(t.b.cross(t.c)) / 6
    weight = F.when(area > EPSILON, area)
    return with_corners(vertices, triangles).groupBy(KEY).agg(
        F.sum(area).alias("area"), F.abs(F.sum(signed)).alias("volume"),
        *((F.sum(weight * c) / F.sum(weight)).alias(f"c{k}") for k, c in zip("xyz", centre)),
    )


def vertex_normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Per vertex: the normalised sum of its faces' unit normals; 0 for unused vertices."""
    f = faces(vertices, triangles).select(KEY, F.explode(F.array("a", "b", "c")).alias("v_idx"), "nx", "ny", "nz")
    sums = f.groupBy(KEY, "v_idx").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in "xyz"))
    n = Vec(*(F.coalesce(F.col(f"n{k}"), F.lit(0.0)) for k in "xyz"))
    unit = Vec(*(F.coalesce(c, F.lit(0.0)) for c in n.normalised()))
    return vertices.join(sums, [KEY, "v_idx"], "left").select(KEY, "v_idx", *(c.alias(f"n{k}") for k, c in zip("xyz", unit)))


def edges(triangles: DataFrame) -> DataFrame:
    """(mesh_id, lo, hi, n, t_idxs): undirected edges with the triangles that share them."""
    sides = F.array(*(F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    rows = triangles.select(KEY, "t_idx", F.explode(sides).alias("e")).select(KEY, "t_idx", "e.lo", "e.hi")
    return rows.groupBy(KEY, "lo", "hi").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("t_idx")).alias("t_idxs"))


def topology(triangles: DataFrame) -> DataFrame:
    """Per mesh: edge counts, manifold (no edge of over two faces) and watertight (all edges of two)."""
    return edges(triangles).groupBy(KEY).agg(
        F.count("*").alias("edges"), F.count_if(F.col("n") == 1).alias("boundary_edges"), F.count_if(F.col("n") > 2).alias("non_manifold_edges"),
        (F.max("n") <= 2).alias("manifold"), ((F.max("n") == 2) & (F.min("n") == 2)).alias("watertight"),
    )


def vertex_neighbours(triangles: DataFrame) -> DataFrame:
    e = edges(triangles)
    both = e.select(KEY, F.col("lo").alias("v_idx"), F.col("hi").alias("to")).unionByName(e.select(KEY, F.col("hi").alias("v_idx"), F.col("lo").alias("to")))
    return both


def triangle_links(triangles: DataFrame) -> DataFrame:
    """(mesh_id, t_idx, to): triangles that share an edge. Each edge chains its triangles, so no all-pairs blow-up."""
    e = edges(triangles).where("n > 1")
    chain = F.expr("transform(sequence(1, size(t_idxs) - 1), i -> struct(t_idxs[i - 1] AS t_idx, t_idxs[i] AS to))")
    return e.select(KEY, F.explode(chain).alias("p")).select(KEY, "p.t_idx", "p.to")


def components(triangles: DataFrame) -> DataFrame:
    """(mesh_id, t_idx, component): triangles joined through shared edges, named by their smallest t_idx."""
    key = lambda t: F.struct(KEY, F.col(t).alias("t"))
    links = triangle_links(triangles).select(key("t_idx").alias("a"), key("to").alias("b"))
    nodes = triangles.select(key("t_idx").alias("id"))
    out = min_labels(nodes, links)
    return out.select(F.col(f"id.{KEY}").alias(KEY), F.col("id.t").alias("t_idx"), F.col("label.t").alias("component"))


def diagnostics(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Per mesh: degenerate triangles, pairs of equal vertices (counted, not listed), non-manifold and boundary edges."""
    bad = faces(vertices, triangles).groupBy(KEY).agg(F.count_if(F.col("area") <= EPSILON).alias("degenerate"))
    equal = vertices.groupBy(KEY, "x", "y", "z").agg(F.count("*").alias("n")).groupBy(KEY).agg(
        F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("duplicate_pairs")
    )
    topo = topology(triangles).select(KEY, "non_manifold_edges", "boundary_edges")
    return bad.join(equal, KEY, "full").join(topo, KEY, "full")


def without_degenerate(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    return faces(vertices, triangles).where(F.col("area") > EPSILON).select(KEY, "t_idx", "a", "b", "c")


def flipped(triangles: DataFrame) -> DataFrame:
    return triangles.select(KEY, "t_idx", "a", F.col("c").alias("b"), F.col("b").alias("c"))


def merged(vertices: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All meshes as one (mesh_id 0), vertex numbers shifted in the order of mesh_id. The offsets are one row a mesh."""
    sizes = vertices.groupBy(KEY).agg((F.max("v_idx") + 1).alias("nv"))
    counts = triangles.groupBy(KEY).agg((F.max("t_idx") + 1).alias("nt"))
    before = Window.orderBy(KEY).rowsBetween(Window.unboundedPreceding, -1)
    both = sizes.join(counts, KEY, "left").fillna(0, ["nt"])
    offsets = both.select(KEY, F.coalesce(F.sum("nv").over(before), F.lit(0)).alias("ov"), F.coalesce(F.sum("nt").over(before), F.lit(0)).alias("ot"))
    v = vertices.join(offsets, KEY).select(F.lit(0).alias(KEY), (F.col("v_idx") + F.col("ov")).alias("v_idx"), "x", "y", "z")
    t = triangles.join(offsets, KEY).select(F.lit(0).alias(KEY), (F.col("t_idx") + F.col("ot")).alias("t_idx"), *((F.col(c) + F.col("ov")).alias(c) for c in "abc"))
    return v, t


def welded(vertices: DataFrame, triangles: DataFrame, epsilon: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Vertices within ``epsilon`` of an earlier one that stays become the first such; collapsed triangles go.

    In the order of v_idx a vertex stays unless one that stays lies within ``epsilon``. Vertices with equal coordinates become
    one first. Neighbours are found by cells of that size; then blocks decide in order, and exchange what they decided.
    """
    if epsilon < 0:
        raise ValueError("the distance must not be negative")
    first = vertices.groupBy(KEY, "x", "y", "z").agg(F.min("v_idx").alias("to"))
    to = vertices.join(first, [KEY, "x", "y", "z"]).select(KEY, "v_idx", "to")
    if epsilon > 0:
        nearer = _first_within(first.withColumnRenamed("to", "v_idx"), epsilon).select(KEY, F.col("v_idx").alias("to"), F.col("rep").alias("_rep"))
        to = to.join(nearer, [KEY, "to"]).select(KEY, "v_idx", F.col("_rep").alias("to"))
    out = triangles
    for c in "abc":
        out = out.join(to.withColumnRenamed("v_idx", c).withColumnRenamed("to", f"_{c}"), [KEY, c])
    out = out.select(KEY, "t_idx", *(F.col(f"_{c}").alias(c) for c in "abc")).where("a <> b AND b <> c AND a <> c")
    stay = to.where("v_idx = to").select(KEY, "v_idx")
    return vertices.join(stay, [KEY, "v_idx"], "left_semi").select(KEY, "v_idx", "x", "y", "z"), out


#: vertices of a block of ``welded``, which decides in order by itself
WELD_BLOCK = 16_384
#: rows that stay, once for each cell around them, that are broadcast at most
WELD_ROWS = 500_000


def _certain(epsilon: float):
    """For a block of (v_idx, x, y, z, own): the own vertices that stay for certain, in order.

    Others of the block may depend on vertices elsewhere: what may stay counts as in doubt, and so does what lies within ``epsilon`` of one in doubt.
    No pairs are listed; cells of half that side hold one that stays at most.
    """
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]

    def near(p, cell, held: dict) -> bool:
        i, j, k = cell
        for a, b, c in steps:
            for q in held.get((i + a, j + b, k + c), ()):
                x, y, z = p[0] - q[0], p[1] - q[1], p[2] - q[2]
                if math.sqrt(x * x + y * y + z * z) <= epsilon:
                    return True
        return False

    def decide(table: pa.Table) -> pa.Table:
        table = table.sort_by("v_idx")
        at = np.stack([table.column(k).to_numpy() for k in "xyz"], axis=1)
        cells, halves = (map(tuple, np.floor(at / side).astype(np.int64).tolist()) for side in (epsilon, epsilon / 2))
        stay, doubt, taken, doubtful, found = {}, {}, set(), set(), []
        for n, (p, cell, half, own) in enumerate(zip(at.tolist(), cells, halves, table.column("own").to_pylist())):
            if half in taken or near(p, cell, stay):
                continue
            if own and half not in doubtful and not near(p, cell, doubt):
                found.append(n)
                taken.add(half)
                stay.setdefault(cell, []).append(p)
            else:
                doubtful.add(half)
                doubt.setdefault(cell, []).append(p)
        return table.select([KEY, "v_idx", "x", "y", "z"]).take(pa.array(found, pa.int64()))

    return decide


def _around(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` once for each of the cells around that of their columns ``names``, as cx, cy, cz."""
    for k, name in zip("xyz", names):
        rows = rows.withColumn(f"c{k}", F.explode(F.sequence(F.col(name) - 1, F.col(name) + 1)))
    return rows


def _first_within(vertices: DataFrame, epsilon: float, block: int = WELD_BLOCK) -> DataFrame:
    """(mesh_id, v_idx, rep): the vertex itself if it stays, else the first of those that stay within ``epsilon``.

    Those that stay lie apart, so however dense the vertices are there are few of them in a cell. The first ``block`` vertices decide in order, and
    what lies within ``epsilon`` of one that stays goes, as long as that takes half of the rest. What is left decides by blocks of cells that lie
    together: in each round a block is told of the undecided vertices around it and decides all it can, so rounds are as many as a chain of
    dependent vertices goes over to another block, not as it has vertices.
    """
    cell = ["cx", "cy", "cz"]
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.col(k) * 0 == 0, F.lit(False)) for k in "xyz"])
    kind = f"{KEY} {vertices.schema[KEY].dataType.simpleString()}, v_idx long, x double, y double, z double"
    rows = vertices.where(whole).select(KEY, F.col("v_idx").cast("long").alias("v_idx"), *(F.col(k).cast("double").alias(k) for k in "xyz"))
    rows = rows.withColumns({f"c{k}": F.floor(F.col(k) / epsilon) for k in "xyz"})

    def reach(kept: DataFrame) -> DataFrame:
        wide = kept.select(KEY, F.col("v_idx").alias("u"), *(F.col(k).alias(f"u{k}") for k in "xyz"), *(F.floor(F.col(k) / epsilon).alias(f"f{k}") for k in "xyz"))
        wide = _around(wide, ["fx", "fy", "fz"]).drop("fx", "fy", "fz")
        return broadcast_if_small(wide, kept.count() * 27, WELD_ROWS)

    def rest(open_: DataFrame, kept: DataFrame) -> DataFrame:
        a, b = open_.alias("a"), reach(kept).alias("b")
        on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (KEY, *cell)]
        far = Vec.columns("a.").distance(Vec.columns("b.u"))
        return written(a.join(b, reduce(lambda p, q: p & q, [*on, far <= epsilon]), "left_anti"), "open")

    open_, stay = written(rows, "open"), []
    n = before = open_.count()
    while n and (not stay or n * 2 <= before):
        first = open_.orderBy("v_idx").limit(block).withColumn("own", F.lit(True))
        stay.append(written(first.select(KEY, "v_idx", "x", "y", "z", "own").groupBy(KEY).applyInArrow(_certain(epsilon), kind), "decided"))
        open_ = rest(open_, stay[-1])
        n, before = open_.count(), n
    if n:
        ends = [f(f"c{k}").alias(f"{e}{k}") for e, f in (("l", F.min), ("h", F.max)) for k in "xyz"]
        placed = _with_code(open_.join(F.broadcast(open_.groupBy(KEY).agg(*ends)), KEY), "c", 10).select(KEY, *cell, "code")
        placed = placed.repartitionByRange(-(-n // block), KEY, "code").withColumn("block", F.spark_partition_id())
        placed = written(placed.select(KEY, *cell, "block").distinct(), "weld-blocks")
        other = placed.select(KEY, *(F.col(c).alias(f"f{c[1]}") for c in cell), F.col("block").alias("to"))
        blocks = _around(other, ["fx", "fy", "fz"]).groupBy(KEY, *cell).agg(F.collect_set("to").alias("blocks"))
        open_ = written(open_.join(placed, [KEY, *cell]).join(blocks, [KEY, *cell]), "open")
    while n:
        told = open_.select(KEY, "v_idx", "x", "y", "z", "block", F.explode("blocks").alias("to")).withColumn("own", F.col("block") == F.col("to"))
        stay.append(written(told.drop("block").groupBy(KEY, "to").applyInArrow(_certain(epsilon), kind), "decided"))
        open_ = rest(open_, stay[-1])
        n = open_.count()
    kept = reduce(DataFrame.unionByName, stay) if stay else rows.limit(0)
    first = rows.join(reach(kept), [KEY, *cell]).where((F.col("u") <= F.col("v_idx")) & (Vec.columns().distance(Vec.columns("u")) <= epsilon))
    first = first.groupBy(KEY, "v_idx").agg(F.min("u").alias("rep"))
    return first.unionByName(vertices.where(~whole).select(KEY, "v_idx", F.col("v_idx").alias("rep")))


def smoothed(vertices: DataFrame, triangles: DataFrame, rounds: int, factor: float) -> DataFrame:
    """Laplacian smoothing: each round moves every vertex towards the mean of its neighbours, all at once. Every four
    rounds are a written table, so that the plan doesn't grow with the rounds."""
    near = vertex_neighbours(triangles)
    out = vertices.select(KEY, "v_idx", *(F.col(k).cast("double").alias(k) for k in "xyz"))
    for done in range(rounds):
        if done and done % 4 == 0:
            near, out = (near if done > 4 else written(near, "neighbours")), written(out, "smoothed")
        mean = near.join(out.withColumnRenamed("v_idx", "to"), [KEY, "to"]).groupBy(KEY, "v_idx").agg(*(F.avg(k).alias(f"m{k}") for k in "xyz"))
        moved = out.join(mean, [KEY, "v_idx"], "left")
        out = moved.select(KEY, "v_idx", *((F.col(k) * (1 - factor) + F.coalesce(f"m{k}", k) * factor).alias(k) for k in "xyz"))
    return out


def samples(vertices: DataFrame, triangles: DataFrame, n: int) -> DataFrame:
    """(s_idx, mesh_id, t_idx, x, y, z): n points spread evenly over each mesh's area, without randomness.

    Sample i falls at (i + 1/2) / n of the running area. Each triangle emits its own samples, from the running sums on
    either side of it, so nothing is joined by range.
    """
    order = Window.partitionBy(KEY).orderBy("t_idx")
    f = with_corners(vertices, triangles).withColumn("area", corners().area())
    f = f.withColumn("upto", F.sum("area").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    f = f.withColumn("total", F.max("upto").over(Window.partitionBy(KEY))).where(F.col("total") > EPSILON)
    f = f.withColumn("before", F.coalesce(F.lag("upto").over(order), F.lit(0.0)))
    low = F.ceil(F.col("before") / F.col("total") * n - 0.5 + F.when(F.col("before") > 0, 1e-12).otherwise(0.0))
    high = F.floor(F.col("upto") / F.col("total") * n - 0.5 + 1e-12)
    high = F.least(high, F.lit(n - 1))
    f = f.withColumn("low", low).withColumn("high", high).where("low <= high")
    f = f.withColumn("s_idx", F.explode(F.sequence("low", "high")))
    u = F.sqrt((F.col("s_idx") + 0.5) / n)
    v = F.col("s_idx") * 0.618034 - F.floor(F.col("s_idx") * 0.618034)
    t = corners()
    p = t.a * (1 - u) + t.b * (u * (1 - v)) + t.c * (u * v)
    return f.select("s_idx", KEY, "t_idx", *(c.alias(k) for k, c in zip("xyz", p)))


#: levels of eight that a step of a search goes down, about how many triangles a leaf holds, and the most levels of a tree
STEP, LEAF, DEEPEST = 2, 24, 20


def _with_code(rows: DataFrame, place: str, depth: int) -> DataFrame:
    """``rows`` with ``code``: ``depth`` bits of each axis of their place within l.. and h.., one of each axis after the other.

    All axes are cut by the longest of them: cells are cubes, and a long row of meshes isn't cut into slabs that hold parts of many.
    """
    code = F.lit(0).cast("long")
    side = F.nullif(F.greatest(*(F.col(f"h{k}") - F.col(f"l{k}") for k in "xyz")), F.lit(0.0))
    for axis, k in enumerate("xyz"):
        share = F.coalesce((F.col(f"{place}{k}") - F.col(f"l{k}")) / side, F.lit(0.0))
        rows = rows.withColumn(f"i{k}", F.least(F.floor(share * (1 << depth)), F.lit((1 << depth) - 1)).cast("long"))
        for bit in range(depth):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(F.col(f"i{k}"), bit).bitwiseAND(F.lit(1).cast("long")), 3 * bit + axis))
    return rows.withColumn("code", code)


def _tree(vertices: DataFrame, triangles: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Triangles with their corners and ``code``, and the depth of the tree of their codes.

    A code holds the bits of the centroid's place within the bounds of its ``keys``, one of each axis after the other, so that its
    first bits are a cell of an octree at every level.
    """
    t = corners()
    rows = with_corners(vertices, triangles).withColumns({f"m{k}": c for k, c in zip("xyz", t.centroid())})
    rows = written(rows.select(KEY, "t_idx", *(f"{c}{k}" for c in "abcm" for k in "xyz")), "corners")
    ends = [f(f"m{k}").alias(f"{e}{k}") for e, f in (("l", F.min), ("h", F.max)) for k in "xyz"]
    bounds = written(rows.groupBy(*keys).agg(*ends), "bounds")
    rows = rows.join(bounds, keys) if keys else rows.join(F.broadcast(bounds), F.lit(True))
    rows = written(_with_code(rows, "m", DEEPEST).select(KEY, "t_idx", "code", *(f"{c}{k}" for c in "abc" for k in "xyz")), "coded")
    depth = _depth(rows, keys)
    return rows.withColumn("code", F.shiftright("code", 3 * (DEEPEST - depth))), depth


def _depth(rows: DataFrame, keys: list[str]) -> int:
    """The first level of which a triangle shares its cell with about ``LEAF`` at most, or with about as few as on the deepest."""
    levels = list(range(STEP, DEEPEST + 1, STEP))
    cell = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.shiftright("code", 3 * (DEEPEST - n)).alias("cell")) for n in levels)))
    cells = rows.select(*keys, cell.alias("_c")).groupBy(*keys, "_c.level", "_c.cell").agg(F.count("*").cast("double").alias("n"))
    # a row for each level
    shared = {r["level"]: r["shared"] for r in cells.groupBy("level").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("shared")).collect()}
    return next((n for n in levels if shared and shared[n] <= max(LEAF, 1.5 * min(shared.values()))), STEP)


def _level(rows: DataFrame, depth: int, level: int, keys: list[str]) -> DataFrame:
    """(keys, up, cell, lo.., hi..): the cells of a level with the bounds of their triangles, ``up`` their cell of the step before."""
    low = [F.min(F.least(*(F.col(f"{c}{k}") for c in "abc"))).alias(f"lo_{k}") for k in "xyz"]
    high = [F.max(F.greatest(*(F.col(f"{c}{k}") for c in "abc"))).alias(f"hi_{k}") for k in "xyz"]
    cells = rows.groupBy(*keys, F.shiftright("code", 3 * (depth - level)).alias("cell")).agg(*low, *high)
    return cells.withColumn("up", F.shiftright("cell", 3 * STEP))


def _descended(queries: DataFrame, rows: DataFrame, depth: int, keys: list[str], kept) -> DataFrame:
    """``queries(.., keys, cell)`` at the root with the leaf cells that ``kept`` leaves of them, a step of levels at a time, by equality of
    cells. Each step drops the bounds of the one before."""
    found = queries
    for level in range(STEP, depth + 1, STEP):
        nodes = _level(rows, depth, level, keys)
        if level == STEP and not keys:
            # at most 8^STEP cells, which every query looks at
            names = [c for c in nodes.columns if c != "up"]
            first = [F.struct(*(F.lit(row[c]).alias(c) for c in names)) for row in nodes.collect()]
            kinds = F.array(*first) if first else F.lit(None).cast(f"array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in nodes.schema if f.name != 'up')}>>")
            found = found.drop("cell").withColumn("_first", F.explode(kinds))
            found = kept(found.select("*", *(F.col(f"_first.{c}").alias(c) for c in names)).drop("_first"))
        else:
            found = kept(found.withColumnRenamed("cell", "up").join(nodes, [*keys, "up"]))
        found = found.drop("up", *(f"{e}_{k}" for e in ("lo", "hi") for k in "xyz"))
    return found


def ray_hits(rays: DataFrame, vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(ray, mesh_id, t_idx, distance) of all triangles that ``rays(ray, ox, oy, oz, dx, dy, dz)`` hit, their borders included.

    All meshes are one tree of bounds, which the rays go down.
    """
    rows, depth = _tree(vertices, triangles, [])
    ray, t = Ray(Vec.columns("o"), Vec.columns("d")), corners()
    # a little wider than the triangles, whose borders count
    wide = {f"{e}_{k}": F.col(f"{e}_{k}") + F.lit(s * 1e-5) * (1 + F.abs(F.col(f"{e}_{k}"))) for e, s in (("lo", -1), ("hi", 1)) for k in "xyz"}

    def kept(met: DataFrame) -> DataFrame:
        return met.withColumns(wide).where(ray.box(Box.columns())[1].isNotNull())

    met = _descended(rays.withColumn("cell", F.lit(0).cast("long")), rows, depth, [], kept).withColumnRenamed("cell", "code")
    near = met.join(rows, "code").withColumn("distance", ray.triangle(t.a, t.b, t.c))
    return near.where("distance IS NOT NULL").select("ray", KEY, "t_idx", "distance")


def _nearest_weights(near: DataFrame, p: Vec) -> tuple[DataFrame, Column, Column]:
    """``near`` with the weights of b and c in the point of a triangle nearest to ``p``: a corner, on a side, or inside."""
    t = corners()
    near, ab, ac, ap, bp, cp = held(near, ab=t.b - t.a, ac=t.c - t.a, ap=p - t.a, bp=p - t.b, cp=p - t.c)
    near, (d1, d2, d3, d4, d5, d6) = held(near, d=tuple(f for v in (ap, bp, cp) for f in (ab.dot(v), ac.dot(v))))
    near, (va, vb, vc) = held(near, v=(d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2))
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    zero, one = F.lit(0.0), F.lit(1.0)
    side = over(d4 - d3, (d4 - d3) + (d5 - d6))
    cases = [
        ((d1 <= 0) & (d2 <= 0), zero, zero), ((d3 >= 0) & (d4 <= d3), one, zero), ((vc <= 0) & (d1 >= 0) & (d3 <= 0), over(d1, d1 - d3), zero),
        ((d6 >= 0) & (d5 <= d6), zero, one), ((vb <= 0) & (d2 >= 0) & (d6 <= 0), zero, over(d2, d2 - d6)), ((va <= 0) & (d4 >= d3) & (d5 >= d6), one - side, side),
    ]
    first = lambda k: reduce(lambda w, case: w.when(case[0], case[k]), cases[1:], F.when(cases[0][0], cases[0][k]))
    total = va + vb + vc
    near, w = held(near, w=(first(1).otherwise(over(vb, total)), first(2).otherwise(over(vc, total))))
    return near, *w


def closest_points(queries: DataFrame, vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(query, mesh_id, t_idx, distance, x, y, z): the nearest surface point of each of ``queries(query, qx, qy, qz)`` on each mesh, or where
    the queries have a mesh_id on that mesh.

    Each mesh is a tree of bounds; cells that begin farther off than another ends are left out at every step. The smaller t_idx wins ties. An
    aggregate keeps only the best so far, so no candidate list is sorted.
    """
    rows, depth = _tree(vertices, triangles, [KEY])
    p, t, box = Vec.columns("q"), corners(), Box.columns()
    end = Vec(*(F.greatest(F.abs(c - a), F.abs(c - b)) for c, a, b in zip(p, box.low, box.high))).length()

    def kept(met: DataFrame) -> DataFrame:
        met = met.withColumn("begin", box.distance(p)).withColumn("end", F.min(end).over(Window.partitionBy("query", KEY)))
        return met.where(F.col("begin") <= F.col("end") * (1 + 1e-9)).drop("begin", "end")

    own = KEY in queries.columns
    some, keys = queries.select("query", "qx", "qy", "qz", *([KEY] if own else [])), [KEY]
    if own:
        start = some
    else:
        # the result has a row for each query and mesh
        meshes = written(rows.select(KEY).distinct(), "meshes")
        first = meshes.limit(2).collect()
        start, keys = (some.withColumn(KEY, F.lit(first[0][0])), []) if len(first) == 1 else (some.crossJoin(meshes), keys)
    met = _descended(start.withColumn("cell", F.lit(0).cast("long")), rows, depth, keys, kept).withColumnRenamed("cell", "code")
    near, v, w = _nearest_weights(met.join(rows, [KEY, "code"]), p)
    near, at = held(near, near=t.a + (t.b - t.a) * v + (t.c - t.a) * w)
    item = F.struct(at.distance(p).alias("distance"), "t_idx", *(c.alias(k) for k, c in zip("xyz", at)))
    return near.groupBy("query", KEY).agg(F.min(item).alias("m")).select("query", KEY, "m.t_idx", "m.distance", "m.x", "m.y", "m.z")
