"""Listings: model files by kind, images by frame, summaries of reconstructions, command plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import frame_number, shell_quote
from .tables import numbered

# Folders of model kinds, and the endings of model files.
KINDS = {"checkpoints": "checkpoint", "loras": "lora", "vae": "vae", "controlnet": "controlnet", "clip": "clip", "upscale_models": "upscaler", "embeddings": "embedding"}
ENDINGS = ["safetensors", "ckpt", "pt", "pth", "bin", "onnx"]


def model_files(spark: SparkSession, root: str) -> DataFrame:
    """(kind, name, path, length) of the model files below ``root``, by kind and name. File contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return classified(found).orderBy("kind", "name")


def classified(files: DataFrame) -> DataFrame:
    """``files(path, length)`` with a known kind folder and ending."""
    folder = F.regexp_extract("path", "/(" + "|".join(KINDS) + ")/", 1)
    kind = F.try_element_at(F.create_map(*(F.lit(v) for pair in KINDS.items() for v in pair)), folder)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.withColumn("kind", kind).where(F.col("kind").isNotNull() & ending.isin(ENDINGS))
    return rows.select("kind", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "path", "length")


# Kinds of models in order with the folders below "models" that hold them, and the endings that are taken.
MODEL_FOLDERS = {
    "checkpoints": ["checkpoints"], "configs": ["configs"], "loras": ["loras"], "vae": ["vae"], "text_encoders": ["text_encoders", "clip"], "diffusion_models": ["unet", "diffusion_models"],
    "clip_vision": ["clip_vision"], "style_models": ["style_models"], "embeddings": ["embeddings"], "vae_approx": ["vae_approx"], "controlnet": ["controlnet", "t2i_adapter"], "gligen": ["gligen"],
    "upscale_models": ["upscale_models"], "latent_upscale_models": ["latent_upscale_models"], "hypernetworks": ["hypernetworks"], "photomaker": ["photomaker"], "classifiers": ["classifiers"],
    "model_patches": ["model_patches"], "audio_encoders": ["audio_encoders"],
}
MODEL_ENDINGS = ["ckpt", "pt", "pt2", "bin", "pth", "safetensors", "pkl", "sft"]
ENDINGS_OF = {"configs": ["yaml", "yml"], "classifiers": [""]}


def model_kind(key: Column) -> Column:
    """The kind that a folder's key stands for: older names give today's, unknown ones stay, an empty one has none."""
    older = {folder: kind for kind, folders in MODEL_FOLDERS.items() for folder in folders if folder != kind}
    known = F.create_map(*(F.lit(v) for pair in older.items() for v in pair))
    return F.when(key != "", F.coalesce(F.try_element_at(known, key), key))


def model_assets(files: DataFrame) -> DataFrame:
    """(kind, name, place, length) of ``files(path, length)`` below a folder of models with an ending that its kind takes, in the order of
    kinds and names; the name is the path below the kind's folder, ``place`` counts from 1 over all."""
    folders = "|".join(sorted(f for names in MODEL_FOLDERS.values() for f in names))
    kind = model_kind(F.regexp_extract("path", f"/models/({folders})/", 1))
    ending = F.lower(F.regexp_extract("path", r"[^/.][^/]*\.([^./]*)$", 1))
    rows = files.withColumn("kind", kind).where("kind IS NOT NULL")
    special = F.when(F.lit(False), F.lit(False))
    for name, endings in ENDINGS_OF.items():
        special = special.when(F.col("kind") == name, ending.isin(endings))
    rows = rows.where(special.otherwise(ending.isin(MODEL_ENDINGS)))
    rank = F.array_position(F.array(*map(F.lit, MODEL_FOLDERS)), F.col("kind"))
    rows = rows.select("kind", F.regexp_extract("path", f"/models/(?:{folders})/(.*)$", 1).alias("name"), "path", "length").withColumn("_rank", rank)
    out = numbered(rows, ["_rank", "name", "path"], "place")
    return out.select("kind", "name", (F.col("place") + 1).alias("place"), "length")


def extra_paths(paths: DataFrame) -> DataFrame:
    """(section, content): configuration text of ``paths(section, base_path, is_default, kind, k, path)``, a section a row. A kind of one path is quoted in
    its line, one of several a block of lines in the order of ``k``. A section has the paths of a few folders."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("/")), F.lit("'"), F.lit("''")), F.lit("'"))
    plain = F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda s: F.replace(s["path"], F.lit("\\"), F.lit("/")))
    kinds = paths.groupBy("section", "base_path", "is_default", "kind").agg(plain.alias("p"))
    many = F.concat(F.lit(": |\n"), F.array_join(F.transform("p", lambda x: F.concat(F.lit("    "), x)), "\n"), F.lit("\n"))
    line = F.concat(F.lit("  "), "kind", F.when(F.size("p") == 1, F.concat(F.lit(": "), quoted(F.element_at("p", 1)), F.lit("\n"))).otherwise(many))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", line.alias("line")))), lambda s: s["line"]), "")
    rows = kinds.groupBy("section", "base_path", "is_default").agg(lines.alias("lines"))
    default = F.when(F.col("is_default"), "  is_default: true\n").otherwise("")
    return rows.select("section", F.concat("section", F.lit(":\n  base_path: "), quoted(F.col("base_path")), F.lit("\n"), default, "lines").alias("content"))


def image_list(images: DataFrame) -> DataFrame:
    """``images(image_id, camera_id, name)`` with frame numbers and their ``place`` from 1, those without a number first."""
    rows = numbered(images.withColumn("frame", frame_number(F.col("name"))), [F.col("frame").asc_nulls_first(), "name", "image_id"], "place")
    return rows.withColumn("place", F.col("place") + 1)


def image_counts(images: DataFrame) -> DataFrame:
    """Per camera: images, first and last frame number."""
    frame = frame_number(F.col("name"))
    return images.groupBy("camera_id").agg(F.count("*").alias("images"), F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"))


def sparse_summary(points: DataFrame) -> DataFrame:
    """One row of ``points(point_id, track, error)``: counts, track lengths, mean error and a status."""
    n = F.size("track")
    out = points.agg(F.count("*").alias("points"), F.coalesce(F.sum(n), F.lit(0)).alias("observations"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.avg(n).alias("mean_length"), F.avg("error").alias("mean_error"))
    return out.withColumn("status", F.when(F.col("points") == 0, "empty").when(F.col("longest") < 2, "unmatched").otherwise("ok"))


def camera_path(images: DataFrame) -> DataFrame:
    """(camera_id, path): positions in image order. For cameras of as many images as a row may hold."""
    item = F.struct("image_id", F.struct("x", "y", "z").alias("p"))
    return images.groupBy("camera_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["p"]).alias("path"))


def command_plan(runs: DataFrame) -> DataFrame:
    """(run, step, command): what external tools would be told for each of ``runs(run, images, workspace)``; nothing is run."""
    steps = [("features", "feature_extractor"), ("matches", "exhaustive_matcher"), ("sparse", "mapper"), ("undistorted", "image_undistorter"), ("dense", "patch_match_stereo")]
    made = [F.struct(F.lit(k).alias("step"), F.concat_ws(" ", F.lit("colmap"), F.lit(tool), F.lit("--image_path"), shell_quote(F.col("images")), F.lit("--workspace_path"), shell_quote(F.concat_ws("/", "workspace", F.lit(name)))).alias("command")) for k, (name, tool) in enumerate(steps)]
    return runs.select("run", F.explode(F.array(*made)).alias("s")).select("run", "s.step", "s.command")
