"""Feature matching, tracks and triangulation over images, features and cameras."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cameras import Intrinsics, Pose, reprojection_error
from ..functions.shapes import closest_between_rays, ray_angle
from ..functions.vectors import Vec
from .graph import min_labels
from .tables import numbered, written


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of descriptors held as arrays of 64-bit words; NULL for unequal lengths."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), bits)


def match_features(
    features: DataFrame, pairs: DataFrame, max_distance: int = 96, ratio: float = 0.8, cross_check: bool = True
) -> DataFrame:
    """(left_image, right_image, left_feature, right_feature, distance) for the image ``pairs``.

    ``features(image_id, feature, words)``. The nearest right feature of each left one (smaller number on ties), kept if
    within ``max_distance`` and at most ``ratio`` of the next larger distance there is; with ``cross_check`` the left one
    must be nearest to it too. Best and next distances are aggregates, so no candidate list is kept or sorted.
    """
    left = features.select(F.col("image_id").alias("left_image"), F.col("feature").alias("left_feature"), F.col("words").alias("lw"))
    right = features.select(F.col("image_id").alias("right_image"), F.col("feature").alias("right_feature"), F.col("words").alias("rw"))
    both = pairs.join(left, "left_image").join(right, "right_image").withColumn("distance", hamming(F.col("lw"), F.col("rw")))
    both = both.where("distance IS NOT NULL").drop("lw", "rw")
    key = ["left_image", "right_image", "left_feature"]
    # a set of distances holds at most as many as a descriptor has bits
    found = both.groupBy(key).agg(F.min(F.struct("distance", "right_feature")).alias("best"), F.sort_array(F.collect_set("distance")).alias("all"))
    out = found.select(*key, "best.distance", "best.right_feature", F.get("all", F.lit(1)).alias("second")).where(F.col("distance") <= max_distance)
    out = out.where(F.col("second").isNull() | (F.col("distance") <= ratio * F.col("second"))).drop("second")
    if cross_check:
        rkey = ["left_image", "right_image", "right_feature"]
        back = both.groupBy(rkey).agg(F.min(F.struct("distance", "left_feature")).alias("back"))
        out = out.join(back.select(*rkey, F.col("back.left_feature").alias("_l")), rkey).where("left_feature = _l").drop("_l")
    return out.select(*key, "right_feature", "distance")


def adjacent_pairs(images: DataFrame) -> DataFrame:
    """(left_image, right_image) of consecutive image ids."""
    placed = numbered(images.select("image_id").distinct(), ["image_id"], "place")
    after = placed.select(F.col("image_id").alias("right_image"), (F.col("place") - 1).alias("place"))
    return placed.withColumnRenamed("image_id", "left_image").join(after, "place").select("left_image", "right_image")


def build_tracks(matches: DataFrame) -> DataFrame:
    """(track, image_id, feature): components of the match graph with at most one feature in each image.

    A track is named by its smallest (image, feature).
    """
    key = lambda i, f: F.struct(F.col(i).alias("image_id"), F.col(f).alias("feature"))
    links = matches.select(key("left_image", "left_feature").alias("a"), key("right_image", "right_feature").alias("b"))
    nodes = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    labels = min_labels(nodes, links)
    good = labels.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("id.image_id").alias("images"))
    good = good.where("n > 1 AND n = images").select("label")
    track = F.concat_ws(":", "label.image_id", "label.feature").alias("track")
    return labels.join(good, "label").select(track, "id.image_id", "id.feature")


def triangulate(
    observations: DataFrame, min_angle: float = 0.0, max_distance: float = float("inf"), max_error: float = float("inf")
) -> DataFrame:
    """(track, n, x, y, z, angle, ray_distance, error) of tracks that pass the limits.

    ``observations(track, image_id, u, v, px.., rx.., ux.., fx.., focal_x, focal_y, cx, cy)``: what a track sees, with pose
    and intrinsics. Positions are the mean over all observation pairs of the midpoint between their rays.
    """
    lens = lambda p="": Intrinsics(0.0, 0.0, *(F.col(f"{p}{c}") for c in ("focal_x", "focal_y", "cx", "cy")))
    pose = lambda p="": Pose(*(Vec(*(F.col(f"{p}{b}{k}") for k in "xyz")) for b in ("p", "r", "u", "f")))
    origin, toward = pose().pixel_ray(lens(), F.col("u"), F.col("v"))
    rays = observations.withColumns(
        {f"o{k}": c for k, c in zip("xyz", origin)} | {f"d{k}": c for k, c in zip("xyz", toward)}
    )
    a, b = rays.alias("a"), rays.alias("b")
    pairs = a.join(b, (F.col("a.track") == F.col("b.track")) & (F.col("a.image_id") < F.col("b.image_id")))
    vec = lambda t, p: Vec(*(F.col(f"{t}.{p}{k}") for k in "xyz"))
    p, q = closest_between_rays(vec("a", "o"), vec("a", "d"), vec("b", "o"), vec("b", "d"))
    middle = (p + q) * 0.5
    found = pairs.groupBy(F.col("a.track").alias("track")).agg(
        *(F.avg(c).alias(k) for k, c in zip("xyz", middle)),
        F.min(ray_angle(vec("a", "d"), vec("b", "d"))).alias("angle"),
    ).where("x IS NOT NULL")
    point = Vec.columns()
    seen = rays.join(found, "track")
    along = F.greatest((point - Vec.columns("o")).dot(Vec.columns("d")), F.lit(0.0))
    off = point.distance(Vec.columns("o") + Vec.columns("d") * along)
    miss = reprojection_error(pose(), lens(), point, F.col("u"), F.col("v"))
    out = seen.groupBy("track", "x", "y", "z", "angle").agg(
        F.count("*").alias("n"), F.max(off).alias("ray_distance"), F.avg(miss).alias("error"), F.count(miss).alias("front")
    )
    ok = [F.col("front") == F.col("n"), F.col("angle") >= min_angle, F.col("ray_distance") <= max_distance, F.col("error") <= max_error]
    return out.where(reduce(lambda x, y: x & y, ok)).drop("front")


def track_length_histogram(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("track").agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("n"))


def compared_histograms(left: DataFrame, right: DataFrame) -> DataFrame:
    """(length, difference) of two histograms, missing lengths counting 0."""
    r = right.select("length", F.col("n").alias("m"))
    return left.join(r, "length", "full_outer").select("length", (F.coalesce("m", F.lit(0)) - F.coalesce("n", F.lit(0))).alias("difference"))


def known_pose_map(
    features: DataFrame, images: DataFrame, matches: DataFrame, min_angle: float = 0.0, max_distance: float = float("inf"), max_error: float = float("inf")
) -> tuple[DataFrame, DataFrame]:
    """(points, rejects) of images whose poses are known: matches become tracks, and tracks that pass the limits points.

    ``features(image_id, feature, u, v)``, ``images(image_id, px.., rx.., ux.., fx.., focal_x, focal_y, cx, cy)``. ``rejects(track,
    n)`` are the tracks without a point, which are kept apart rather than dropped.
    """
    tracks = written(build_tracks(matches), "tracks")
    seen = tracks.join(features, ["image_id", "feature"]).join(images, "image_id")
    points = written(triangulate(seen, min_angle, max_distance, max_error), "points")
    return points, tracks.join(points, "track", "left_anti").groupBy("track").agg(F.count("*").alias("n"))
