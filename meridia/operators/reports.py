"""Reports on reconstructions and projects: counts, means and bounds, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cameras import Pose
from ..functions.vectors import Quat, Vec, clamp, held

AXES = "xyz"
#: what flat sides of bounds are widened by (a fixed value)
WIDENED = 1e-6


def _together(*rows: DataFrame) -> DataFrame:
    """One row of the columns of tables of one row."""
    out = rows[0]
    for row in rows[1:]:
        out = out.crossJoin(F.broadcast(row))
    return out


def lengths(points: DataFrame) -> DataFrame:
    """(histogram): how many ``points(track)`` have a track of each length, as a map. There are as many lengths as images at most."""
    counted = points.groupBy(F.size("track").alias("length")).agg(F.count("*").alias("n"))
    return counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("length", "n")))).alias("histogram"))


def reconstruction(images_asked: DataFrame, cameras: DataFrame, images: DataFrame, points: DataFrame) -> DataFrame:
    """Images asked for and registered, cameras, points, their mean reprojection error (NULL without points) and track lengths."""
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    found = points.agg(F.count("*").alias("points"), F.avg("error").alias("mean_error"))
    return _together(count(images_asked, "images"), count(images, "registered"), count(cameras, "cameras"), found, lengths(points))


def dense(views: DataFrame, depth_maps: DataFrame, points: DataFrame, triangles: DataFrame | None = None) -> DataFrame:
    """Counts of views, depth maps, points and mesh triangles (NULL without a mesh)."""
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    mesh = count(triangles, "triangles") if triangles is not None else views.sparkSession.range(1).select(F.lit(None).cast("long").alias("triangles"))
    return _together(count(views, "views"), count(depth_maps, "depth_maps"), count(points, "points"), mesh)


def camera_centres(images: DataFrame) -> DataFrame:
    """``images(qw..qz, tx..tz)``, world to camera, with the camera's place as px, py, pz."""
    turn = Quat(*(F.col(f"q{k}") for k in "xyzw"))
    rows, pose = held(images, pose=Pose.from_world_to_camera(turn, Vec(*(F.col(f"t{k}") for k in AXES))))
    return rows.withColumns({f"p{k}": c for k, c in zip(AXES, pose.position)}).select(*images.columns, *(f"p{k}" for k in AXES))


def centre_bounds(centres: DataFrame) -> DataFrame:
    """Bounds of ``centres(px, py, pz)``, widened where flat; NULL without cameras."""
    ends = centres.agg(*(F.min(f"p{k}").alias(f"lo_{k}") for k in AXES), *(F.max(f"p{k}").alias(f"hi_{k}") for k in AXES))
    wide = lambda e, k, by: F.when(F.col(f"lo_{k}") == F.col(f"hi_{k}"), F.col(f"{e}_{k}") + by).otherwise(F.col(f"{e}_{k}")).alias(f"{e}_{k}")
    return ends.select(*(wide("lo", k, -WIDENED) for k in AXES), *(wide("hi", k, WIDENED) for k in AXES))


def project(sparse: tuple[DataFrame, DataFrame, DataFrame] | None = None, frames: DataFrame | None = None, splats: DataFrame | None = None) -> DataFrame:
    """Counts of a project's sources and bounds of its cameras and splats, those of the sparse reconstruction before the frames'.

    ``sparse``: cameras, images and points; ``frames(m)`` with row-major camera-to-world matrices; ``splats(x, y, z)``.
    """
    some = next(rows for rows in (*(sparse or ()), frames, splats) if rows is not None)
    none = some.sparkSession.range(1)
    count = lambda rows, name: rows.agg(F.count("*").alias(name)) if rows is not None else none.select(F.lit(0).cast("long").alias(name))
    cameras, images, points = sparse or (None, None, None)
    if images is not None:
        bounds = centre_bounds(camera_centres(images))
    elif frames is not None:
        bounds = centre_bounds(frames.select(*(F.get("m", F.lit(4 * r + 3)).alias(f"p{k}") for r, k in enumerate(AXES))))
    else:
        bounds = none.select(*(F.lit(None).cast("double").alias(f"{e}_{k}") for e in ("lo", "hi") for k in AXES))
    solid = centre_bounds(splats.select(*(F.col(k).alias(f"p{k}") for k in AXES))) if splats is not None else bounds.select(*(F.lit(None).cast("double").alias(c) for c in bounds.columns))
    solid = solid.select(*(F.col(c).alias(f"splat_{c}") for c in solid.columns))
    return _together(count(cameras, "cameras"), count(images, "images"), count(points, "points"), count(frames, "frames"), count(splats, "splats"), bounds, solid)


def scene_summary(cameras: DataFrame, images: DataFrame, points: DataFrame) -> DataFrame:
    """Counts of a dataset's tables and its track lengths."""
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    return _together(count(cameras, "cameras"), count(images, "images"), count(points, "points"), lengths(points))


def track_colours(observations: DataFrame) -> DataFrame:
    """(track, r, g, b): the mean of the observations that have a colour, within [0, 1]; white without any."""
    whole = F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
    mean = lambda c: F.coalesce(clamp(F.avg(F.when(whole, F.col(c))), 0, 1), F.lit(1.0)).alias(c)
    return observations.groupBy("track").agg(*map(mean, "rgb"))


def within_error(points: DataFrame, most: float) -> DataFrame:
    """Points whose reprojection error is at most ``most``."""
    if not 0 <= most < float("inf"):
        raise ValueError("the error must be finite and not negative")
    return points.where(_finite(F.col("error")) & (F.col("error") <= most))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)
