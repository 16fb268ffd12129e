"""Queries on reports, detectors as a whole, mapping with known poses, and small scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import Mat, Quat, Vec, col, tidy
from ..functions.cameras import Intrinsics, Pose
from ..operators import frame_hash, mesh, reports, tracks
from . import lifts
from .lifts import POINTS, r
from .registry import query
from .source_queries import _reconstruction, _splats
from .vision_queries import _PX, _hashes, pixel_frames

_POINTS = "pts AS (SELECT vec_id AS point_id, vec_id % 4 + 1 AS length, (vec_id % 10) / 4.0 AS error FROM embeddings)"
_HISTOGRAM = "(SELECT string_agg(length || ':' || n, ',' ORDER BY length) FROM (SELECT length, count(*) AS n FROM pts GROUP BY 1)) AS histogram"
_CENTRES = "min(-0.5 * page_id) AS lo_x, max(-0.5 * page_id) AS hi_x, min(0.25 * page_id) AS lo_y, max(0.25 * page_id) AS hi_y, -2.0 - 0.000001 AS lo_z, -2.0 + 0.000001 AS hi_z"


def _flat(histogram="histogram"):
    """A map of lengths as text."""
    return F.array_join(F.transform(F.map_entries(histogram), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("histogram")


@query(f"WITH {_POINTS} SELECT (SELECT count(*) FROM pages) AS images, (SELECT count(*) FROM pages WHERE page_id % 4 <> 0) AS registered, (SELECT count(*) FROM pages WHERE page_id < 7) AS cameras, count(*) AS points, {r('avg(error)', 'mean_error')}, {_HISTOGRAM} FROM pts")
def reconstruction_report(spark, sf_dir):
    cameras, images, points = _reconstruction(spark, sf_dir)
    out = reports.reconstruction(images, cameras, images.where("size(points2d) > 0"), points)
    return out.select("images", "registered", "cameras", "points", tidy(F.col("mean_error")).alias("mean_error"), _flat())


@query(f"WITH {_POINTS} SELECT (SELECT count(*) FROM pages WHERE page_id < 7) AS cameras, (SELECT count(*) FROM pages) AS images, count(*) AS points, {_HISTOGRAM} FROM pts")
def scene_summary(spark, sf_dir):
    return reports.scene_summary(*_reconstruction(spark, sf_dir)).select("cameras", "images", "points", _flat())


@query("SELECT (SELECT count(*) FROM pages) AS views, (SELECT count(*) FROM documents) AS depth_maps, (SELECT count(*) FROM embeddings) AS points, (SELECT count(*) FROM embeddings WHERE vec_id % 50 < 48) AS triangles")
def dense_report(spark, sf_dir):
    e = lifts.table(spark, sf_dir, "embeddings")
    return reports.dense(lifts.table(spark, sf_dir, "pages"), lifts.table(spark, sf_dir, "documents"), e, e.where("vec_id % 50 < 48"))


@query(f"SELECT {_CENTRES.replace('AS lo_z', 'AS lo_z').replace(' AS hi_z', ' AS hi_z')} FROM pages".replace("-2.0 - 0.000001", "round(-2.0 - 0.000001, 6)").replace("-2.0 + 0.000001", "round(-2.0 + 0.000001, 6)"))
def camera_center_bounds(spark, sf_dir):
    out = reports.centre_bounds(reports.camera_centres(_reconstruction(spark, sf_dir)[1]))
    return out.select(*(tidy(F.col(c)).alias(c) for c in out.columns))


@query(f"""SELECT (SELECT count(*) FROM pages WHERE page_id < 7) AS cameras, (SELECT count(*) FROM pages) AS images, (SELECT count(*) FROM embeddings) AS points, CAST(0 AS BIGINT) AS frames, (SELECT count(*) FROM embeddings) AS splats, (SELECT min(-0.5 * page_id) FROM pages) AS lo_x, (SELECT max(0.25 * page_id) FROM pages) AS hi_y,
 (SELECT {r('min(CAST(embedding[1] AS DOUBLE))', 'm')} FROM embeddings) AS splat_lo_x""")
def radiance_project_summary(spark, sf_dir):
    out = reports.project(_reconstruction(spark, sf_dir), None, _splats(spark, sf_dir))
    return out.select("cameras", "images", "points", "frames", "splats", *(tidy(F.col(c)).alias(c) for c in ("lo_x", "hi_y", "splat_lo_x")))


@query(f"""WITH o AS (SELECT vec_id // 3 AS track, CASE WHEN vec_id % 5 <> 0 THEN CAST(embedding[1] AS DOUBLE) * 4 + 0.5 END AS r, CASE WHEN vec_id % 5 <> 0 AND vec_id % 7 <> 0 THEN CAST(embedding[2] AS DOUBLE) END AS g FROM embeddings)
 SELECT track, {r("coalesce(least(greatest(avg(CASE WHEN g IS NOT NULL THEN r END), 0), 1), 1)", 'r')}, {r("coalesce(least(greatest(avg(g), 0), 1), 1)", 'g')} FROM o GROUP BY 1""")
def track_color(spark, sf_dir):
    e, i = F.col("embedding"), F.col("vec_id")
    rows = lifts.table(spark, sf_dir, "embeddings").select(F.floor(i / 3).alias("track"), F.when(i % 5 != 0, e[0].cast("double") * 4 + 0.5).alias("r"), F.when((i % 5 != 0) & (i % 7 != 0), e[1].cast("double")).alias("g"), F.lit(0.5).alias("b"))
    return reports.track_colours(rows).select("track", tidy(F.col("r")).alias("r"), tidy(F.col("g")).alias("g"))


@query("SELECT vec_id AS point_id FROM embeddings WHERE (vec_id % 10) / 4.0 <= 1.0")
def retain_points_with_max_error(spark, sf_dir):
    return reports.within_error(_reconstruction(spark, sf_dir)[2], 1.0).select("point_id")


@query(f"SELECT CAST(idx AS VARCHAR) AS point, CAST(3 AS BIGINT) AS n, {r('x', 'x', 4)}, {r('y', 'y', 4)}, {r('z', 'z', 4)} FROM ({POINTS}) WHERE idx % 7 <> 0 UNION ALL SELECT CAST(idx AS VARCHAR), -2, NULL, NULL, NULL FROM ({POINTS}) WHERE idx % 7 = 0")
def known_pose_sparse_mapper(spark, sf_dir):
    """Points seen by three cameras are matched, tracked and found again; every seventh is seen wrongly, by two, and rejected."""
    lens = Intrinsics.of(64, 64, 60, 60, 32, 32)
    wrong = F.col("idx") % 7 == 0
    rows = lifts.points(spark, sf_dir).withColumn("image_id", F.explode(F.when(wrong, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))))
    place = lambda i: Vec.of(i * 1.0, F.lit(0.3) * i, F.lit(-3.0))
    axes = Vec.of(1, 0, 0), Vec.of(0, 1, 0), Vec.of(0, 0, 1)
    u, v, _ = Pose(place(F.col("image_id")), *axes).project(lens, Vec.columns())
    off = F.when(wrong & (F.col("image_id") == 1), 40.0).otherwise(0.0)
    features = rows.select("image_id", F.col("idx").alias("feature"), u.alias("u"), (v + off).alias("v"))
    i = F.col("image_id")
    images = spark.range(3).select(F.col("id").cast("int").alias("image_id")).select("image_id", *(col(c).alias(f"{p}{k}") for p, vec in zip("pruf", (place(i), *axes)) for k, c in zip("xyz", vec)), *(F.lit(float(n)).alias(c) for c, n in (("focal_x", 60), ("focal_y", 60), ("cx", 32), ("cy", 32))))
    matches = features.where("image_id > 0").select((i - 1).alias("left_image"), F.col("feature").alias("left_feature"), i.alias("right_image"), F.col("feature").alias("right_feature"))
    points, rejects = tracks.known_pose_map(features, images, matches, max_error=1.0)
    name = F.substring_index("track", ":", -1).alias("point")
    good = points.select(name, "n", *(tidy(F.col(c), 4).alias(c) for c in "xyz"))
    return good.unionByName(rejects.select(name, (-F.col("n")).alias("n"), *(F.lit(None).cast("double").alias(c) for c in "xyz")))


@query(f"""WITH RECURSIVE {_PX}, y AS (SELECT video, frame, CAST(round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS INTEGER) // 16 AS bin FROM px), n AS (SELECT video, frame, bin, count(*) AS n FROM y GROUP BY 1, 2, 3),
 d AS (SELECT f.video, f.frame, k AS bin, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT video, frame FROM px) f CROSS JOIN range(16) t(k) LEFT JOIN n ON n.video = f.video AND n.frame = f.frame AND n.bin = k),
 c AS (SELECT a.video, a.frame, corr(a.n, b.n) AS c FROM d a JOIN d b ON b.video = a.video AND b.frame = a.frame - 1 AND b.bin = a.bin GROUP BY 1, 2), hot AS (SELECT video, frame FROM c WHERE c <= 0.95),
 keep AS (SELECT video, (SELECT min(frame) FROM hot h WHERE h.video = v.video AND frame >= 1 + 4) AS cut FROM (SELECT DISTINCT video FROM hot) v
 UNION ALL SELECT k.video, (SELECT min(frame) FROM hot h WHERE h.video = k.video AND frame >= k.cut + 4) FROM keep k WHERE k.cut IS NOT NULL) SELECT video, cut FROM keep WHERE cut IS NOT NULL""")
def histogram_detector(spark, sf_dir):
    return frame_hash.histogram_cuts(pixel_frames(spark, sf_dir), 0.05, 16, 4)


@query(f"""WITH RECURSIVE {_PX}, {_hashes(8, 16)}, keep AS (SELECT video, (SELECT min(frame) FROM changed h WHERE h.video = v.video AND distance >= 0.395 AND frame >= 3) AS cut FROM (SELECT DISTINCT video FROM px) v
 UNION ALL SELECT k.video, (SELECT min(frame) FROM changed h WHERE h.video = k.video AND distance >= 0.395 AND frame >= k.cut + 3) FROM keep k WHERE k.cut IS NOT NULL) SELECT video, cut FROM keep WHERE cut IS NOT NULL""")
def hash_detector(spark, sf_dir):
    """Cuts by perceptual hashes of the embeddings' pictures."""
    return frame_hash.hash_cuts(pixel_frames(spark, sf_dir, side=32), 0.395, 8, 2, 3)


_S = 0.001


@query(f"SELECT idx, {r('x', 'back_x')}, {r('y', 'back_y')}, {r(f'{_S} * {_S} * {_S} * 1e9', 'determinant')} FROM ({POINTS})")
def small_scale_inverse(spark, sf_dir):
    """A scale of a thousandth has an inverse, and a vector of a billionth a direction."""
    m = Mat([[_S, 0, 0, 0.1], [0, _S, 0, 0.2], [0, 0, _S, 0.3], [0, 0, 0, 1]])
    back = m.inverse().apply(m.apply(Vec.columns()))
    return lifts.points(spark, sf_dir).select("idx", tidy(back.x).alias("back_x"), tidy(back.y).alias("back_y"), tidy(F.lit(m.determinant() * 1e9)).alias("determinant"))


@query(f"SELECT idx, {r('x / sqrt(x * x + y * y + z * z)', 'ux')}, {r('x / sqrt(x * x + y * y + z * z + 1)', 'qx')} FROM ({POINTS})")
def tiny_directions(spark, sf_dir):
    v, q = Vec.columns() * 1e-9, Quat(*(F.col(k) * 1e-9 for k in "xyz"), F.lit(1e-9))
    return lifts.points(spark, sf_dir).select("idx", tidy(v.normalised().x).alias("ux"), tidy(q.normalised().x).alias("qx"))


@query(f"""WITH RECURSIVE p AS (SELECT idx, x, y, z FROM ({POINTS})), e AS (SELECT a.idx AS v, list(b.idx) AS us FROM p a JOIN p b ON b.idx < a.idx AND sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2) <= 0.06 GROUP BY 1),
 g AS (SELECT CAST(0 AS BIGINT) AS i, [CAST(0 AS BIGINT)] AS kept UNION ALL SELECT i + 1, CASE WHEN list_has_any(kept, coalesce((SELECT us FROM e WHERE e.v = g.i + 1), [])) THEN kept ELSE list_append(kept, g.i + 1) END FROM g WHERE i < (SELECT max(idx) FROM p)),
 k AS (SELECT unnest(kept) AS rep FROM g WHERE i = (SELECT max(idx) FROM p)) SELECT rep AS v_idx FROM k""")
def weld_within_distance(spark, sf_dir):
    """The vertices that stay where those within a distance of an earlier one that stays are welded to it."""
    v = lifts.points(spark, sf_dir).select(F.lit(0).alias("mesh_id"), F.col("idx").alias("v_idx"), "x", "y", "z")
    i = F.col("v_idx")
    t = v.select("mesh_id", i.alias("t_idx"), i.alias("a"), (i + 1).alias("b"), (i + 2).alias("c"))
    return mesh.welded(v, t, 0.06)[0].select("v_idx")
