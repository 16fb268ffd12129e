"""Queries on the edges of frames: each embedding is a small picture, each label a video."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import tidy
from ..operators import edges
from . import lifts
from .lifts import r
from .registry import query

SIDE, TILE = 32, 12


def frames(spark, sf_dir):
    """Pictures of 8 by 8 fields of 4 by 4 pixels, a field for each component, with some grain."""
    cell = lambda p: F.floor(F.floor(p / SIDE) / 4) * 8 + F.floor((p % SIDE) / 4)
    grain = lambda p: (p % SIDE * 7 + F.floor(p / SIDE) * 3) % 5
    e = lambda p: F.element_at("embedding", cell(p).cast("int") + 1).cast("double")
    value = F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda p: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 300 * e(p)).cast("int") + grain(p))))
    hexed = F.array_join(F.transform(value, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    v = lifts.table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    return v.select(F.col("label").alias("video"), F.col("vec_id").alias("frame"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.unhex(hexed).alias("luma"))


def _at(name: str, dy: int, dx: int) -> str:
    """A pixel of a list, those outside repeating the nearest."""
    return f"{name}[greatest(0, least({SIDE - 1}, y + {dy})) * {SIDE} + greatest(0, least({SIDE - 1}, x + {dx})) + 1]"


def _size(dy: int, dx: int) -> str:
    """A gradient's size, 0 outside the frame."""
    return f"CASE WHEN y + {dy} BETWEEN 0 AND {SIDE - 1} AND x + {dx} BETWEEN 0 AND {SIDE - 1} THEN sizes[(y + {dy}) * {SIDE} + x + {dx} + 1] ELSE 0 END"


_PIXELS = f"""cells AS (SELECT label AS video, vec_id AS frame, p, p // {SIDE} AS y, p % {SIDE} AS x,
 greatest(0, least(255, CAST(floor(128 + 300 * CAST(embedding[p // {SIDE} // 4 * 8 + p % {SIDE} // 4 + 1] AS DOUBLE)) AS INTEGER) + (p % {SIDE} * 7 + p // {SIDE} * 3) % 5)) AS v
 FROM embeddings, range({SIDE * SIDE}) t(p) WHERE label IS NOT NULL),
lists AS (SELECT video, frame, list(v ORDER BY p) AS l, median(v) AS m, CAST(floor(median(v) * (1.0 - CAST(1 AS DOUBLE) / 3)) AS INTEGER) AS low,
 CAST(floor(least(255, median(v) * (1.0 + CAST(1 AS DOUBLE) / 3))) AS INTEGER) AS high FROM cells GROUP BY 1, 2),
slopes AS (SELECT c.video, c.frame, c.p, y, x, low, high,
 {_at('l', -1, 1)} + 2 * {_at('l', 0, 1)} + {_at('l', 1, 1)} - {_at('l', -1, -1)} - 2 * {_at('l', 0, -1)} - {_at('l', 1, -1)} AS gx,
 {_at('l', 1, -1)} + 2 * {_at('l', 1, 0)} + {_at('l', 1, 1)} - {_at('l', -1, -1)} - 2 * {_at('l', -1, 0)} - {_at('l', -1, 1)} AS gy FROM cells c JOIN lists USING (video, frame)),
sizes AS (SELECT video, frame, list(abs(gx) + abs(gy) ORDER BY p) AS sizes FROM slopes GROUP BY 1, 2),
ridges AS (SELECT video, frame, y, x, abs(gx) + abs(gy) AS m, high FROM slopes JOIN sizes USING (video, frame) WHERE abs(gx) + abs(gy) > low AND CASE
 WHEN abs(gy) * 32768 < abs(gx) * 13573 THEN abs(gx) + abs(gy) > {_size(0, -1)} AND abs(gx) + abs(gy) >= {_size(0, 1)}
 WHEN abs(gy) * 32768 > abs(gx) * 13573 + abs(gx) * 65536 THEN abs(gx) + abs(gy) > {_size(-1, 0)} AND abs(gx) + abs(gy) >= {_size(1, 0)}
 WHEN (gx < 0) <> (gy < 0) THEN abs(gx) + abs(gy) > {_size(-1, 1)} AND abs(gx) + abs(gy) > {_size(1, -1)}
 ELSE abs(gx) + abs(gy) > {_size(-1, -1)} AND abs(gx) + abs(gy) > {_size(1, 1)} END),
flood AS (SELECT video, frame, y, x FROM ridges WHERE m > high
 UNION SELECT g.video, g.frame, g.y, g.x FROM flood f JOIN ridges g ON g.video = f.video AND g.frame = f.frame AND g.y BETWEEN f.y - 1 AND f.y + 1 AND g.x BETWEEN f.x - 1 AND f.x + 1),
wide AS (SELECT DISTINCT video, frame, y + dy AS y, x + dx AS x FROM flood, range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE y + dy BETWEEN 0 AND {SIDE - 1} AND x + dx BETWEEN 0 AND {SIDE - 1})"""


@query(f"WITH RECURSIVE {_PIXELS} SELECT video, frame, coalesce(e, 0) AS edges, coalesce(checksum, 0) AS checksum, coalesce(w, 0) AS grown FROM lists LEFT JOIN (SELECT video, frame, count(*) AS e, CAST(sum(y * {SIDE} + x) AS BIGINT) AS checksum FROM flood GROUP BY 1, 2) USING (video, frame) LEFT JOIN (SELECT video, frame, count(*) AS w FROM wide GROUP BY 1, 2) USING (video, frame)")
def frame_edges(spark, sf_dir):
    """How many pixels are edges, the sum of their places, and how many they grow to."""
    tiles = edges.written(edges.tiled(frames(spark, sf_dir), TILE), "tiles")
    maps = edges.edge_maps(tiles, TILE)
    on = lambda c: F.filter(F.sequence(F.lit(0), F.octet_length(c) - 1), lambda k: F.substring(c, k + 1, 1) != F.lit(b"\x00"))
    cols = F.least(F.lit(TILE), F.col("width") - F.col("left"))
    place = F.aggregate(on(F.col("edges")), F.lit(0).cast("long"), lambda s, k: s + (F.col("top") + F.floor(k / cols)) * F.col("width") + F.col("left") + k % cols)
    one = maps.withColumn("n", F.size(on(F.col("edges")))).withColumn("place", place).groupBy("video", "frame").agg(F.sum("n").alias("edges"), F.sum("place").alias("checksum"))
    wide = edges.grown(maps, TILE, edges.kernel_size(SIDE, SIDE)).groupBy("video", "frame").agg(F.sum(F.size(on(F.col("edges")))).alias("grown"))
    return one.join(wide, ["video", "frame"]).select("video", "frame", "edges", "checksum", "grown")


@query(f"""WITH RECURSIVE {_PIXELS}, marked AS (SELECT c.video, c.frame, c.y, c.x, c.v, CASE WHEN w.y IS NULL THEN 0 ELSE 255 END AS e FROM cells c LEFT JOIN wide w USING (video, frame, y, x)),
changes AS (SELECT *, lag(v) OVER o AS old_v, lag(e) OVER o AS old_e FROM marked WINDOW o AS (PARTITION BY video, y, x ORDER BY frame)),
deltas AS (SELECT video, frame, coalesce(avg(abs(v - old_v)), 0) AS lum, coalesce(avg(abs(e - old_e)), 0) AS edge FROM changes GROUP BY 1, 2)
SELECT video, frame, {r('lum', 'delta_lum')}, {r('edge', 'delta_edges')}, {r('(lum + edge * 0.5) / 1.5', 'score')} FROM deltas""")
def edge_content_score(spark, sf_dir):
    """The content score with edges as a component beside luma, half as heavy."""
    tiles = edges.written(edges.tiled(frames(spark, sf_dir), TILE), "tiles")
    lum = edges.tile_deltas(tiles, "luma").withColumnRenamed("delta", "delta_lum")
    both = lum.join(edges.edge_deltas(tiles, TILE), ["video", "frame"])
    score = (F.col("delta_lum") + F.col("delta_edges") * 0.5) / 1.5
    return both.select("video", "frame", tidy(F.col("delta_lum")).alias("delta_lum"), tidy(F.col("delta_edges")).alias("delta_edges"), tidy(score).alias("score"))
