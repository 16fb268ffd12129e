"""Sparse reconstructions and camera sets: COLMAP text files and Nerfstudio transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import numbered
from .files import joined_lines, lines, tokens


def _data_lines(spark: SparkSession, path: str) -> DataFrame:
    rows = lines(spark, path).withColumn("t", tokens(F.col("line")))
    return rows.where((F.trim("line") != "") & ~F.startswith(F.ltrim("line"), F.lit("#")))


def _at(k: int, kind: str):
    return F.get("t", F.lit(k)).cast(kind)


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """(camera_id, model, width, height, params) of cameras.txt."""
    rows = _data_lines(spark, path)
    params = F.transform(F.slice("t", F.lit(5), F.size("t")), lambda s: s.cast("double"))
    return rows.select(_at(0, "long").alias("camera_id"), _at(1, "string").alias("model"), _at(2, "int").alias("width"), _at(3, "int").alias("height"), params.alias("params"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, qw..qz, tx..tz, camera_id, name, points2d) of images.txt: pairs of lines.

    The line below an image's is its points, and stays so when it is blank: an image without points keeps its own.
    """
    rows = lines(spark, path).where(~F.startswith(F.ltrim("line"), F.lit("#")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1)
    rows = rows.withColumn("below", F.lead("line").over(Window.partitionBy("file").orderBy("line_no")))
    heads = rows.where((F.col("k") % 2 == 0) & (F.trim("line") != "")).withColumn("t", tokens(F.col("line")))
    p = F.filter(F.split(F.trim(F.coalesce("below", F.lit(""))), r"\s+"), lambda s: s != "")
    triple = F.transform(F.sequence(F.lit(0), F.floor(F.size("p") / 3) - 1), lambda k: F.struct(F.get("p", (k * 3).cast("int")).cast("double").alias("x"), F.get("p", (k * 3 + 1).cast("int")).cast("double").alias("y"), F.get("p", (k * 3 + 2).cast("int")).cast("long").alias("id")))
    triple = F.transform(triple, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), F.when(s["id"] >= 0, s["id"]).alias("point3d_id")))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, point3d_id: BIGINT>>)")
    names = ["qw", "qx", "qy", "qz", "tx", "ty", "tz"]
    return heads.withColumn("p", p).select(
        _at(0, "long").alias("image_id"), *(_at(k + 1, "double").alias(n) for k, n in enumerate(names)), _at(8, "long").alias("camera_id"),
        F.array_join(F.slice("t", F.lit(10), F.size("t")), " ").alias("name"), F.when(F.size("p") >= 3, triple).otherwise(none).alias("points2d"),
    )


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, line_no, x, y, z, r, g, b, error, track) of points3D.txt, colours from 0 to 1."""
    rows = _data_lines(spark, path)
    track = F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 8) / 2) - 1), lambda k: F.struct(F.get("t", (k * 2 + 8).cast("int")).cast("long").alias("image_id"), F.get("t", (k * 2 + 9).cast("int")).cast("int").alias("feature")))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<image_id: BIGINT, feature: INT>>)")
    return rows.select(
        _at(0, "long").alias("point_id"), "line_no", *(_at(k + 1, "double").alias(a) for k, a in enumerate("xyz")), *((_at(k + 4, "double") / 255).alias(c) for k, c in enumerate("rgb")),
        _at(7, "double").alias("error"), F.when(F.size("t") >= 10, track).otherwise(none).alias("track"),
    )


def read_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return read_cameras(spark, f"{folder}/cameras.txt"), read_images(spark, f"{folder}/images.txt"), read_points(spark, f"{folder}/points3D.txt")


def as_texts(cameras: DataFrame, images: DataFrame, points: DataFrame) -> DataFrame:
    """(name, content) of the three files."""
    s = lambda *cs: F.concat_ws(" ", *(F.col(c).cast("string") for c in cs))
    of = lambda rows, name, key, text: joined_lines(rows.select(F.lit(name).alias("name"), F.col(key).alias("k"), text.alias("text")), "name", ["k"], F.col("text"))
    cam = F.concat_ws(" ", s("camera_id", "model", "width", "height"), F.array_join(F.transform("params", lambda p: p.cast("string")), " "))
    seen = F.array_join(F.transform("points2d", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), F.coalesce(p["point3d_id"], F.lit(-1)).cast("string"))), " ")
    img = F.concat(s("image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id", "name"), F.lit("\n"), seen)
    byte = lambda c: F.round(F.col(c) * 255).cast("int").cast("string")
    pts = F.concat_ws(" ", s("point_id", "x", "y", "z"), byte("r"), byte("g"), byte("b"), s("error"), F.array_join(F.transform("track", lambda e: F.concat_ws(" ", e["image_id"].cast("string"), e["feature"].cast("string"))), " "))
    return of(cameras, "cameras.txt", "camera_id", cam).unionByName(of(images, "images.txt", "image_id", img)).unionByName(of(points, "points3D.txt", "point_id", pts))


def sparse_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points seen in two images or more, numbered from 1 in file order, with the first element of each image.

    Returns (points with ``new_id``, elements(new_id, image_id, feature)).
    """
    e = points.select("point_id", "line_no", F.posexplode("track").alias("pos", "e")).select("point_id", "line_no", "pos", "e.*")
    first = e.groupBy("point_id", "line_no", "image_id").agg(F.min(F.struct("pos", "feature")).alias("f")).select("point_id", "line_no", "image_id", "f.feature")
    kept = first.groupBy("point_id", "line_no").agg(F.count("*").alias("images")).where("images >= 2")
    placed = numbered(kept, ["line_no"], "new_id").select("point_id", (F.col("new_id") + 1).alias("new_id"))
    return points.join(placed, "point_id"), first.join(placed, "point_id").select("new_id", "image_id", "feature")


def views(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Images with their cameras; ``missing_camera`` marks those that have none."""
    return images.join(cameras, "camera_id", "left").withColumn("missing_camera", F.col("model").isNull())


def read_nerfstudio(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, file_path, m, fl_x, fl_y, cx, cy, w, h): frames of transforms files; a frame's own values come before the file's."""
    lens = "fl_x double, fl_y double, cx double, cy double, w int, h int"
    schema = f"{lens}, frames array<struct<file_path:string,transform_matrix:array<array<double>>,{lens.replace(' ', ':', 1).replace(', ', ',').replace(',fl_y ', ',fl_y:').replace(',cx ', ',cx:').replace(',cy ', ',cy:').replace(',w ', ',w:').replace(',h ', ',h:')}>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), "fl_x", "fl_y", "cx", "cy", "w", "h", F.posexplode("frames").alias("idx", "f"))
    return rows.select("file", "idx", F.col("f.file_path").alias("file_path"), F.flatten("f.transform_matrix").alias("m"), *(F.coalesce(F.col(f"f.{c}"), F.col(c)).alias(c) for c in ("fl_x", "fl_y", "cx", "cy", "w", "h")))


def as_nerfstudio(frames: DataFrame) -> DataFrame:
    """(file, content): a transforms file of each group of frames."""
    matrix = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice("m", (r * 4 + 1).cast("int"), 4))
    frame = F.struct("idx", F.struct("file_path", matrix.alias("transform_matrix"), "fl_x", "fl_y", "cx", "cy", "w", "h").alias("f"))
    ordered = F.transform(F.array_sort(F.collect_list(frame)), lambda s: s["f"])
    return frames.groupBy("file").agg(F.to_json(F.struct(ordered.alias("frames"))).alias("content"))
