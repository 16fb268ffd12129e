"""Queries on constraints, scene trees, listings and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..functions.vectors import tidy
from ..operators import inventory, scene_graph
from ..operators.tables import numbered
from . import lifts
from .lifts import POINTS, r
from .registry import query


@query(f"""SELECT idx, CASE WHEN x * 2000 NOT BETWEEN -180 AND 180 THEN 'lon must lie between -180 and 180' WHEN y * 900 NOT BETWEEN -90 AND 90 THEN 'lat must lie between -90 and 90' END AS invalid FROM ({POINTS})""")
def validate_positions(spark, sf_dir):
    rows = lifts.points(spark, sf_dir).select("idx", (F.col("x") * 2000).alias("lon"), (F.col("y") * 900).alias("lat"))
    return checks.quarantined(rows, checks.geographic()).select("idx", F.col("_invalid").alias("invalid"))


@query("SELECT user_id AS joint, CASE WHEN parent IS NOT NULL AND parent >= user_id THEN 'a joint''s parent must come before it' END AS invalid FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 10 <> 0 THEN user_id * 7 % 60 END AS parent FROM events)")
def validate_skeleton(spark, sf_dir):
    u = F.col("user_id")
    rows = lifts.table(spark, sf_dir, "events").select(u.alias("joint"), F.when(u % 10 != 0, u * 7 % 60).alias("parent")).distinct()
    return checks.quarantined(rows, checks.parents_come_first()).select("joint", F.col("_invalid").alias("invalid"))


@query(f"SELECT count(*) AS n FROM ({POINTS})")
def validate_strict(spark, sf_dir):
    return checks.strict(lifts.points(spark, sf_dir), [checks.finite("x", "y", "z")]).agg(F.count("*").alias("n"))


_TREE = f"""nodes AS (SELECT idx AS id, CASE WHEN idx > 0 THEN (idx - 1) // 3 END AS parent, x AS tx, y AS ty, z AS tz, 1 + x AS scale, idx % 13 <> 7 AS visible, CASE WHEN idx % 4 = 0 THEN 'c' || idx % 5 END AS colour FROM ({POINTS})),
 tree AS (SELECT id, 0 AS depth, tx AS x, ty AS y, tz AS z, scale, colour FROM nodes WHERE parent IS NULL AND visible
 UNION ALL SELECT n.id, t.depth + 1, t.x + t.scale * n.tx, t.y + t.scale * n.ty, t.z + t.scale * n.tz, t.scale * n.scale, coalesce(n.colour, t.colour) FROM tree t JOIN nodes n ON n.parent = t.id WHERE n.visible)"""


def _tree(spark, sf_dir):
    i = F.col("idx")
    return lifts.points(spark, sf_dir).select(i.alias("id"), F.when(i > 0, F.floor((i - 1) / 3)).alias("parent"), *(F.col(a).alias(f"t{a}") for a in "xyz"), (1 + F.col("x")).alias("scale"), (i % 13 != 7).alias("visible"), F.when(i % 4 == 0, F.concat(F.lit("c"), (i % 5).cast("string"))).alias("colour"))


@query(f"WITH RECURSIVE {_TREE} SELECT id, depth, {r('x', 'x')}, {r('z', 'z')}, {r('scale', 'scale')}, colour FROM tree")
def scene_tree(spark, sf_dir):
    out = scene_graph.flattened(_tree(spark, sf_dir))
    return out.select("id", "depth", *(tidy(F.col(c)).alias(c) for c in ("x", "z", "scale")), "colour")


@query(f"WITH RECURSIVE {_TREE} SELECT id, {r('x * 50 / (z + 1) + 50', 'sx')}, {r('40 - y * 50 / (z + 1)', 'sy')}, row_number() OVER (ORDER BY z DESC, id) AS layer FROM tree WHERE z + 1 > 0.9 AND z + 1 < 1.2")
def scene_projection(spark, sf_dir):
    flat = scene_graph.flattened(_tree(spark, sf_dir)).withColumn("z", F.col("z") + 1)
    out = scene_graph.projected(flat, 100, 80, 50, 0.9, 1.2)
    out = numbered(out, [F.desc("z"), "id"], "layer")
    return out.select("id", tidy(F.col("sx")).alias("sx"), tidy(F.col("sy")).alias("sy"), (F.col("layer") + 1).alias("layer"))


def _plain(value: str) -> str:
    text = f"regexp_replace(printf('%.3f', {value}), '\\.?0+$', '')"
    return f"(CASE WHEN {text} IN ('-0', '') THEN '0' ELSE {text} END)"


@query(f"""WITH RECURSIVE {_TREE} SELECT 0 AS drawing, '<svg xmlns="http://www.w3.org/2000/svg" width="100" height="80">' || string_agg('<circle cx="' || {_plain("x + 50")} || '" cy="' || {_plain("40 - y")} || '" r="' || {_plain("scale")} || '" fill="' || coalesce(colour, 'black')
 || '"><title>node &lt;' || id || '&gt;</title></circle>', '' ORDER BY z DESC, id) || '</svg>' AS content FROM tree""")
def scene_svg(spark, sf_dir):
    flat = scene_graph.projected(scene_graph.flattened(_tree(spark, sf_dir)), 100, 80, None).withColumn("drawing", F.lit(0))
    return scene_graph.svg(flat, 100, 80, F.concat(F.lit("node <"), F.col("id").cast("string"), F.lit(">")))


def _images(spark, sf_dir):
    i = F.col("page_id")
    return lifts.table(spark, sf_dir, "pages").select(i.alias("image_id"), (i % 3).alias("camera_id"), F.when(i % 10 == 0, "cover.png").otherwise(F.concat(F.lit("cam2_frame"), F.lpad((i * 5).cast("string"), 6, "0"), F.lit(".png"))).alias("name"))


_IMAGES = "im AS (SELECT page_id AS image_id, page_id % 3 AS camera_id, CASE WHEN page_id % 10 <> 0 THEN page_id * 5 END AS frame FROM pages)"


@query(f"WITH {_IMAGES} SELECT image_id, frame, row_number() OVER (ORDER BY frame NULLS FIRST, image_id) AS place FROM im")
def image_list(spark, sf_dir):
    return inventory.image_list(_images(spark, sf_dir)).select("image_id", "frame", "place")


@query(f"WITH {_IMAGES} SELECT camera_id, count(*) AS images, min(frame) AS first_frame, max(frame) AS last_frame FROM im GROUP BY 1")
def image_counts(spark, sf_dir):
    return inventory.image_counts(_images(spark, sf_dir))


@query(f"WITH p AS (SELECT 1 + (user_id % 5) AS len, value FROM events) SELECT count(*) AS points, CAST(sum(len) AS BIGINT) AS observations, CAST(min(len) AS INTEGER) AS shortest, CAST(max(len) AS INTEGER) AS longest, {r('avg(len)', 'mean_length')}, {r('avg(value)', 'mean_error')}, 'ok' AS status FROM p")
def sparse_summary(spark, sf_dir):
    p = lifts.table(spark, sf_dir, "events").select(F.sequence(F.lit(0).cast("long"), F.col("user_id") % 5).alias("track"), F.col("value").alias("error"))
    out = inventory.sparse_summary(p)
    return out.withColumns({c: tidy(F.col(c)) for c in ("mean_length", "mean_error")})


@query("SELECT user_id AS camera_id, list_aggregate(list(event_id ORDER BY event_id), 'string_agg', ',') AS path FROM events GROUP BY 1")
def camera_path(spark, sf_dir):
    rows = lifts.table(spark, sf_dir, "events").select(F.col("user_id").alias("camera_id"), F.col("event_id").alias("image_id"), F.col("event_id").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"))
    out = inventory.camera_path(rows)
    return out.select("camera_id", F.array_join(F.transform("path", lambda p: p["x"].cast("string")), ",").alias("path"))


@query("""SELECT CASE page_id % 4 WHEN 0 THEN 'checkpoint' WHEN 1 THEN 'lora' ELSE 'vae' END AS kind, 'm' || page_id || '.SafeTensors' AS name, page_id AS length FROM pages WHERE page_id % 4 <> 3 AND page_id % 5 <> 0""")
def model_scan(spark, sf_dir):
    i = F.col("page_id")
    folder = F.element_at(F.array(*map(F.lit, ("checkpoints", "loras", "vae", "other"))), (i % 4 + 1).cast("int"))
    ending = F.when(i % 5 == 0, ".txt").otherwise(".SafeTensors")
    rows = lifts.table(spark, sf_dir, "pages").select(F.concat(F.lit("/root/models/"), folder, F.lit("/sub/m"), i.cast("string"), ending).alias("path"), i.alias("length"))
    return inventory.classified(rows).drop("path")


@query("SELECT page_id AS run, CAST(k AS INTEGER) AS step, 'colmap ' || ['feature_extractor', 'exhaustive_matcher', 'mapper', 'image_undistorter', 'patch_match_stereo'][k + 1] || ' --image_path ''/my images'' --workspace_path /w/' || page_id || '/' || ['features', 'matches', 'sparse', 'undistorted', 'dense'][k + 1] AS command FROM pages, range(5) t(k)")
def command_plan(spark, sf_dir):
    i = F.col("page_id")
    return inventory.command_plan(lifts.table(spark, sf_dir, "pages").select(i.alias("run"), F.lit("/my images").alias("images"), F.concat(F.lit("/w/"), i.cast("string")).alias("workspace")))


_FOLDERS = ["checkpoints", "clip", "unet", "t2i_adapter", "configs", "classifiers", "loras", "elsewhere"]
_ENDS = [".SafeTensors", ".ckpt", ".yaml", "", ".txt"]


@query(f"""WITH f AS (SELECT page_id, {_FOLDERS}[page_id % 8 + 1] AS folder, {_ENDS}[page_id % 5 + 1] AS ending FROM pages),
 k AS (SELECT *, CASE folder WHEN 'clip' THEN 'text_encoders' WHEN 'unet' THEN 'diffusion_models' WHEN 't2i_adapter' THEN 'controlnet' ELSE folder END AS kind FROM f WHERE folder <> 'elsewhere'
  AND CASE folder WHEN 'configs' THEN ending = '.yaml' WHEN 'classifiers' THEN ending = '' ELSE ending IN ('.SafeTensors', '.ckpt') END)
 SELECT kind, 'sub/m' || page_id || ending AS name, row_number() OVER (ORDER BY list_position(['checkpoints', 'configs', 'loras', 'text_encoders', 'diffusion_models', 'controlnet', 'classifiers'], kind), 'sub/m' || page_id || ending, page_id) AS place, page_id AS length FROM k""")
def model_assets(spark, sf_dir):
    """Model files by today's kinds, in the order of kinds and names."""
    i = F.col("page_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (i % n + 1).cast("int"))
    path = F.concat(F.lit("/root/models/"), pick(_FOLDERS, 8), F.lit("/sub/m"), i.cast("string"), pick(_ENDS, 5))
    return inventory.model_assets(lifts.table(spark, sf_dir, "pages").select(path.alias("path"), i.alias("length")))


@query("""WITH p AS (SELECT 's' || page_id % 20 AS section, '/my ' || chr(39) || page_id % 20 || chr(39) AS base, page_id % 20 % 2 = 0 AS main, ['loras', 'vae', 'checkpoints'][page_id % 3 + 1] AS kind, page_id, 'd' || chr(92) || page_id AS path FROM pages),
 k AS (SELECT section, base, main, kind, CASE WHEN count(*) = 1 THEN '  ' || kind || ': ' || chr(39) || replace(any_value(path), chr(92), '/') || chr(39) || chr(10) ELSE '  ' || kind || ': |' || chr(10) || string_agg('    ' || replace(path, chr(92), '/') || chr(10), '' ORDER BY page_id) END AS line FROM p GROUP BY 1, 2, 3, 4)
 SELECT section, section || ':' || chr(10) || '  base_path: ' || chr(39) || replace(base, chr(39), chr(39) || chr(39)) || chr(39) || chr(10) || CASE WHEN main THEN '  is_default: true' || chr(10) ELSE '' END || string_agg(line, '' ORDER BY kind) AS content FROM k GROUP BY section, base, main""")
def extra_model_paths(spark, sf_dir):
    i = F.col("page_id")
    s = (i % 20).cast("string")
    rows = lifts.table(spark, sf_dir, "pages").select(F.concat(F.lit("s"), s).alias("section"), F.concat(F.lit("/my '"), s, F.lit("'")).alias("base_path"), (i % 20 % 2 == 0).alias("is_default"), F.element_at(F.array(F.lit("loras"), F.lit("vae"), F.lit("checkpoints")), (i % 3 + 1).cast("int")).alias("kind"), i.alias("k"), F.concat(F.lit("d\\"), i.cast("string")).alias("path"))
    return inventory.extra_paths(rows)
