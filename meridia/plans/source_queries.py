"""Queries that write files of each format to the shared folder, read them back, and are held against the tables they came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import tidy
from ..operators import scenes as scene_ops
from ..operators import workflow
from ..operators.scene_graph import from_json, to_json
from ..operators.tables import fresh_path
from ..sources import files, meshes, reconstructions, scene_files, splat_files
from . import lifts
from .lifts import FRAMES, POINTS, r
from .registry import query
from .scene_queries import _SCENES, _scenes

#: points a mesh file: the number of files grows with the table, not their size
_PER_FILE = 50
_STRIP = f"s AS (SELECT idx // {_PER_FILE} AS mesh, idx % {_PER_FILE} AS v_idx, x, y, z FROM ({POINTS}))"
_FACES = f"{_STRIP}, f AS (SELECT mesh, v_idx AS t_idx, v_idx AS a, v_idx + 1 AS b, v_idx + 2 AS c FROM (SELECT *, count(*) OVER (PARTITION BY mesh) AS n FROM s) WHERE v_idx + 2 < n)"


def _strips(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Meshes of ``_PER_FILE`` points each, a strip of triangles through them."""
    p = lifts.points(spark, sf_dir)
    v = p.select(F.floor(F.col("idx") / _PER_FILE).alias("mesh_id"), (F.col("idx") % _PER_FILE).alias("v_idx"), "x", "y", "z")
    sizes = v.groupBy("mesh_id").agg(F.count("*").alias("n"))
    t = v.join(sizes, "mesh_id").where("v_idx + 2 < n")
    return v, t.select("mesh_id", F.col("v_idx").alias("t_idx"), F.col("v_idx").alias("a"), (F.col("v_idx") + 1).alias("b"), (F.col("v_idx") + 2).alias("c"))


def _written(spark, contents: DataFrame, key: str, ending: str) -> str:
    """The folder of one file for each row of ``contents(key, content)``."""
    folder = fresh_path(spark, "files")
    files.write_files(contents.select(F.format_string(f"{folder}/m%s.{ending}", F.col(key).cast("string")).alias("path"), "content"))
    return folder


def _numbered(rows: DataFrame, column: str, name: str = "mesh") -> DataFrame:
    """The number in a file's name instead of the name."""
    return rows.withColumn(name, F.regexp_extract(column, r"/m(\d+)\.[a-z]+$", 1).cast("long")).drop(column)


def _vertices(v: DataFrame) -> DataFrame:
    return _numbered(v, "mesh_id").select("mesh", "v_idx", *(tidy(F.col(k)).alias(k) for k in "xyz"))


def _triangles(t: DataFrame) -> DataFrame:
    return _numbered(t, "mesh_id").select("mesh", "t_idx", "a", "b", "c")


_V = f"WITH {_STRIP} SELECT mesh, v_idx, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} FROM s"
_T = f"WITH {_FACES} SELECT mesh, t_idx, a, b, c FROM f"


@query(_V)
def obj_vertices(spark, sf_dir):
    return _vertices(meshes.read_mesh(spark, _written(spark, meshes.as_obj(*_strips(spark, sf_dir)), "mesh_id", "obj") + "/*.obj")[0])


@query(_T)
def obj_triangles(spark, sf_dir):
    return _triangles(meshes.read_mesh(spark, _written(spark, meshes.as_obj(*_strips(spark, sf_dir)), "mesh_id", "obj") + "/*.obj")[1])


@query(_V)
def ply_vertices(spark, sf_dir):
    return _vertices(meshes.read_mesh(spark, _written(spark, meshes.as_ply(*_strips(spark, sf_dir)), "mesh_id", "ply") + "/*.ply")[0])


@query(_T)
def ply_triangles(spark, sf_dir):
    return _triangles(meshes.read_mesh(spark, _written(spark, meshes.as_ply(*_strips(spark, sf_dir)), "mesh_id", "ply") + "/*.ply")[1])


@query(_V)
def gltf_vertices(spark, sf_dir):
    return _vertices(meshes.read_mesh(spark, _written(spark, meshes.as_gltf(*_strips(spark, sf_dir)), "mesh_id", "gltf") + "/*.gltf")[0])


@query(_T)
def gltf_triangles(spark, sf_dir):
    return _triangles(meshes.read_mesh(spark, _written(spark, meshes.as_gltf(*_strips(spark, sf_dir)), "mesh_id", "gltf") + "/*.gltf")[1])


@query(_V)
def ply_point_cloud(spark, sf_dir):
    return _vertices(meshes.read_ply_points(spark, _written(spark, meshes.as_ply(_strips(spark, sf_dir)[0]), "mesh_id", "ply") + "/*.ply"))


@query(_V.replace("SELECT mesh, v_idx,", "SELECT mesh, v_idx AS idx,"))
def preview_point_cloud(spark, sf_dir):
    """Coloured points, read by the header's properties; the colours are not read."""
    v = _strips(spark, sf_dir)[0].withColumns({c: F.col(k) + 0.5 for c, k in zip("rgb", "xyz")})
    rows = splat_files.read_ply_cloud(spark, _written(spark, meshes.as_ply(v, colours=True), "mesh_id", "ply") + "/*.ply")
    return _numbered(rows, "file").select("mesh", "idx", *(tidy(F.col(k)).alias(k) for k in "xyz"))


def _splats(spark, sf_dir):
    v = lifts.table(spark, sf_dir, "embeddings")
    e = lambda k: F.col("embedding")[k].cast("double")
    names = ["x", "y", "z", "sx", "sy", "sz", "qx", "qy", "qz", "qw", "logit"]
    lists = [F.transform(F.slice("embedding", a, n), lambda x: x.cast("double")).alias(name) for name, a, n in (("dc", 12, 3), ("sh", 15, 9))]
    return v.select(F.floor(F.col("vec_id") / 100).cast("string").alias("file"), (F.col("vec_id") % 100).alias("idx"), *(e(k).alias(n) for k, n in enumerate(names)), *lists)


@query(f"SELECT vec_id // 100 AS scene, vec_id % 100 AS idx, {r('CAST(embedding[3] AS DOUBLE)', 'z')}, {r('CAST(embedding[6] AS DOUBLE)', 'sz')}, {r('CAST(embedding[10] AS DOUBLE)', 'qw')}, {r('CAST(embedding[11] AS DOUBLE)', 'logit')}, {r('CAST(embedding[13] AS DOUBLE)', 'dc1')}, {r('CAST(embedding[23] AS DOUBLE)', 'sh8')} FROM embeddings")
def gaussian_splat_files(spark, sf_dir):
    rows = splat_files.read_splats(spark, _written(spark, splat_files.as_splat_files(_splats(spark, sf_dir)), "file", "ply") + "/*.ply")
    rows = _numbered(rows, "file", "scene").withColumn("dc1", F.col("dc")[1]).withColumn("sh8", F.col("sh")[8])
    return rows.select("scene", "idx", *(tidy(F.col(c)).alias(c) for c in ("z", "sz", "qw", "logit", "dc1", "sh8")))


def _reconstruction(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cameras of pages, an image a page, points of embeddings that are seen by one to four images."""
    page, vec = F.col("page_id"), F.col("vec_id")
    pages = lifts.table(spark, sf_dir, "pages")
    cameras = pages.where("page_id < 7").select(page.alias("camera_id"), F.lit("PINHOLE").alias("model"), F.lit(64).alias("width"), F.lit(48).alias("height"), F.array(50.0 + page, 50.0 - page, F.lit(32.5), F.lit(24.0)).alias("params"))
    seen = F.transform(F.sequence(F.lit(0), page % 3), lambda k: F.struct((page + k * 0.5).alias("x"), (page * 2.0).alias("y"), F.when(k > 0, page).alias("point3d_id")))
    images = pages.select(page.alias("image_id"), *(F.lit(c).alias(n) for n, c in (("qw", 1.0), ("qx", 0.0), ("qy", 0.0), ("qz", 0.0))), (page * 0.5).alias("tx"), (page * -0.25).alias("ty"), F.lit(2.0).alias("tz"), (page % 7).alias("camera_id"), F.format_string("a %d.png", page).alias("name"), F.when(page % 4 == 0, F.slice(seen, 1, 0)).otherwise(seen).alias("points2d"))
    e = lambda k: F.col("embedding")[k].cast("double")
    track = F.transform(F.sequence(F.lit(0), (vec % 4).cast("int")), lambda k: F.struct((vec % 11 + k % 3).cast("long").alias("image_id"), k.alias("feature")))
    points = lifts.table(spark, sf_dir, "embeddings").select(vec.alias("point_id"), *(e(k).alias(a) for k, a in enumerate("xyz")), *((vec % n / 255.0).alias(c) for c, n in zip("rgb", (256, 7, 100))), (vec % 10 / 4.0).alias("error"), track.alias("track"))
    return cameras, images, points


def _folder(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    folder = fresh_path(spark, "sparse")
    texts = reconstructions.as_texts(*_reconstruction(spark, sf_dir))
    files.write_files(texts.select(F.concat(F.lit(folder + "/"), "name").alias("path"), "content"))
    return reconstructions.read_folder(spark, folder)


@query("SELECT page_id AS camera_id, 'PINHOLE' AS model, 64 AS width, 48 AS height, 50.0::DOUBLE + page_id AS fx, 50.0::DOUBLE - page_id AS fy, 32.5::DOUBLE AS cx FROM pages WHERE page_id < 7")
def colmap_cameras(spark, sf_dir):
    p = F.col("params")
    return _folder(spark, sf_dir)[0].select("camera_id", "model", "width", "height", p[0].alias("fx"), p[1].alias("fy"), p[2].alias("cx"))


@query("SELECT page_id AS image_id, page_id * 0.5::DOUBLE AS tx, page_id * -0.25::DOUBLE + 0.0 AS ty, page_id % 7 AS camera_id, 'a ' || page_id || '.png' AS name, CASE WHEN page_id % 4 = 0 THEN 0 ELSE CAST(page_id % 3 + 1 AS INTEGER) END AS seen, CASE WHEN page_id % 4 <> 0 AND page_id % 3 > 0 THEN page_id END AS second FROM pages")
def colmap_images(spark, sf_dir):
    i = _folder(spark, sf_dir)[1]
    return i.select("image_id", "tx", (F.col("ty") + F.lit(0.0)).alias("ty"), "camera_id", "name", F.size("points2d").alias("seen"), F.get("points2d", F.lit(1))["point3d_id"].alias("second"))


@query(f"SELECT vec_id AS point_id, {r('CAST(embedding[1] AS DOUBLE)', 'x')}, {r('(vec_id % 256) / 255.0', 'r')}, {r('(vec_id % 100) / 255.0', 'b')}, (vec_id % 10) / 4.0::DOUBLE AS error, CAST(vec_id % 4 + 1 AS INTEGER) AS length, vec_id % 11 AS first_image FROM embeddings")
def colmap_points(spark, sf_dir):
    p = _folder(spark, sf_dir)[2]
    return p.select("point_id", *(tidy(F.col(c)).alias(c) for c in ("x", "r", "b")), "error", F.size("track").alias("length"), F.col("track")[0]["image_id"].alias("first_image"))


@query("SELECT page_id AS image_id, page_id % 7 AS camera_id, page_id % 7 NOT IN (SELECT page_id FROM pages WHERE page_id < 7) AS missing FROM pages")
def colmap_views(spark, sf_dir):
    cameras, images, _ = _folder(spark, sf_dir)
    return reconstructions.views(images, cameras).select("image_id", "camera_id", F.col("missing_camera").alias("missing"))


@query("""WITH e AS (SELECT vec_id, vec_id % 11 + k % 3 AS image_id, min(k) AS feature FROM embeddings, range(4) t(k) WHERE k <= vec_id % 4 GROUP BY 1, 2), p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS new_id FROM (SELECT vec_id FROM e GROUP BY 1 HAVING count(*) >= 2))
 SELECT new_id, image_id, CAST(feature AS INTEGER) AS feature FROM p JOIN e USING (vec_id)""")
def colmap_sparse_elements(spark, sf_dir):
    """Tracks of points that two images see, numbered anew in the order of the file."""
    return reconstructions.sparse_points(_folder(spark, sf_dir)[2])[1]


@query(f"SELECT idx // 40 AS scene, CAST(idx % 40 AS INTEGER) AS idx, 'f' || (idx % 40) || '.png' AS file_path, {r('x', 'm3')}, {r('z', 'm11')}, CASE WHEN idx % 2 = 0 THEN 60.0 ELSE 50.0 END::DOUBLE AS fl_x, 64 AS w FROM ({POINTS})")
def nerfstudio_transforms(spark, sf_dir):
    p = lifts.points(spark, sf_dir)
    rows = [["x", 3], ["y", 7], ["z", 11]]
    m = F.array(*(next((F.col(a) for a, at in rows if at == k), F.lit(float(k % 5 == 0))) for k in range(16)))
    frames = p.select(F.floor(F.col("idx") / 40).alias("file"), (F.col("idx") % 40).alias("idx"), F.format_string("f%d.png", F.col("idx") % 40).alias("file_path"), m.alias("m"), F.when(F.col("idx") % 2 == 0, 60.0).otherwise(50.0).alias("fl_x"), *(F.lit(v).alias(n) for n, v in (("fl_y", 50.0), ("cx", 32.0), ("cy", 24.0), ("w", 64), ("h", 48))))
    found = reconstructions.read_nerfstudio(spark, _written(spark, reconstructions.as_nerfstudio(frames), "file", "json") + "/*.json")
    return _numbered(found, "file", "scene").select("scene", "idx", "file_path", tidy(F.col("m")[3]).alias("m3"), tidy(F.col("m")[11]).alias("m11"), "fl_x", "w")


def _clock(frames: str) -> str:
    """SQL of HH:MM:SS.mmm at 25 frames a second."""
    return f"printf('%02d:%02d:%02d.%03d', ({frames}) // 90000, ({frames}) // 1500 % 60, ({frames}) // 25 % 60, ({frames}) % 25 * 40)"


def _scene_csv(spark, sf_dir) -> str:
    folder = fresh_path(spark, "scene-lists")
    scene_files.write_scene_list(_scenes(spark, sf_dir), 25, folder)
    return folder


@query(f"WITH {_SCENES} SELECT video, CAST(scene AS BIGINT) AS scene, start_frame + 1 AS start_frame, {_clock('start_frame')} AS start_time, end_frame, {_clock('end_frame')} AS end_time, printf('%.3f', (end_frame - start_frame) / 25.0) AS seconds FROM sc")
def scene_list_csv(spark, sf_dir):
    rows = spark.read.csv(_scene_csv(spark, sf_dir), header=True)
    whole = lambda c, name: F.col(c).cast("long").alias(name)
    return rows.select("video", whole("Scene Number", "scene"), whole("Start Frame", "start_frame"), F.col("Start Timecode").alias("start_time"), whole("End Frame", "end_frame"), F.col("End Timecode").alias("end_time"), F.col("Length (seconds)").alias("seconds"))


@query(f"WITH {_SCENES} SELECT video, start_frame AS cut FROM sc WHERE start_frame > 0 AND start_frame BETWEEN 100 AND 899")
def load_scene_list(spark, sf_dir):
    """The cuts of all videos' lists, clipped to frames 100 to 900."""
    return scene_files.load_scenes(spark, _scene_csv(spark, sf_dir), 25, 100, 900)


@query(f"WITH f AS ({FRAMES}) SELECT video, frame, 'size' AS metric, CAST(frame + 1 AS DOUBLE) AS value FROM f UNION ALL SELECT video, frame, 'value', value FROM f WHERE frame % 3 <> 0")
def statistics_csv(spark, sf_dir):
    """Two metrics of all videos' frames, one of them missing in every third frame."""
    f = lifts.frames(spark, sf_dir)
    one = f.select("video", "frame", F.lit("size").alias("metric"), (F.col("frame") + 1).cast("double").alias("value"))
    two = f.where("frame % 3 <> 0").select("video", "frame", F.lit("value").alias("metric"), "value")
    folder = fresh_path(spark, "statistics")
    scene_files.stats_table(one.unionByName(two), ["value", "size"]).write.partitionBy("video").csv(folder, header=True)
    return scene_files.load_stats(spark, folder)


def _edit(frames: str) -> str:
    return f"printf('%02d:%02d:%02d:%02d', ({frames}) // 90000, ({frames}) // 1500 % 60, ({frames}) // 25 % 60, ({frames}) % 25)"


def _lists(sql: str, separator: str, head: str = "", tail: str = "") -> str:
    return f"WITH {_SCENES} SELECT video, '{head}' || string_agg({sql}, {separator} ORDER BY scene) || {tail or chr(39) * 2} AS content FROM sc GROUP BY 1"


@query(_lists(f"lpad(CAST(scene AS VARCHAR), CAST(greatest(3, length(CAST(scene AS VARCHAR))) AS INTEGER), '0') || '  AX       V     C        ' || {_edit('start_frame')} || ' ' || {_edit('end_frame')} || ' ' || {_edit('start_frame')} || ' ' || {_edit('end_frame')}", "chr(10)", "* CREATED WITH MERIDIA' || chr(10) || 'TITLE: Cuts' || chr(10) || 'FCM: NON-DROP FRAME' || chr(10) || chr(10) || '", "chr(10)"))
def save_edl(spark, sf_dir):
    return scene_files.edit_list(_scenes(spark, sf_dir), 25, "Cuts")


@query(_lists("start_frame || ' I -1'", "chr(10)", tail="chr(10)"))
def save_qp(spark, sf_dir):
    return scene_files.keyframe_list(_scenes(spark, sf_dir))


_SEC = "printf('%.3fs', ({}) / 25.0)"


@query(f"""WITH {_SCENES}, c AS (SELECT *, {_SEC.format('end_frame - start_frame')} AS len, {_SEC.format('start_frame')} AS beg FROM sc),
 g AS (SELECT video, {_SEC.format('max(end_frame)')} AS whole, string_agg('<clip name="Shot ' || scene || '" duration="' || len || '" start="' || beg || '" offset="' || beg || '"><asset-clip ref="asset1" duration="' || len || '" start="' || beg || '" offset="0s" name="Shot ' || scene || '"/></clip>', '' ORDER BY scene) AS clips FROM c GROUP BY 1)
 SELECT video, '<fcpxml version="1.9"><resources><format id="format1" name="FFVideoFormat1080p24"/><asset id="asset1" name="' || video || '" duration="' || whole || '" hasVideo="1" hasAudio="1" format="format1"/></resources><library><event name="Shot Detection"><project name="' || video || '"><sequence format="format1" duration="' || whole || '"><spine>' || clips || '</spine></sequence></project></event></library></fcpxml>' AS content FROM g""")
def save_xml(spark, sf_dir):
    return scene_files.xml_list(_scenes(spark, sf_dir), 25)


@query(f"WITH {_SCENES} SELECT video, CAST(scene AS BIGINT) AS scene, CAST(start_frame AS DOUBLE) AS start, CAST(end_frame - start_frame AS DOUBLE) AS length FROM sc")
def save_otio(spark, sf_dir):
    """Timelines written as JSON and taken apart again."""
    time = "struct<value:double>"
    shape = f"struct<tracks:struct<children:array<struct<children:array<struct<name:string,source_range:struct<start_time:{time},duration:{time}>>>>>>>"
    rows = scene_files.timeline_list(_scenes(spark, sf_dir), 25).select("video", F.from_json("content", shape).alias("d"))
    rows = rows.select("video", F.explode("d.tracks.children").alias("t")).select("video", F.explode("t.children").alias("c"))
    return rows.select("video", F.regexp_extract("c.name", r"(\d+)", 1).cast("long").alias("scene"), F.col("c.source_range.start_time.value").alias("start"), F.col("c.source_range.duration.value").alias("length"))


@query(f"WITH {_SCENES} SELECT video, count(*) AS n, CAST(sum(start_frame + 1) AS BIGINT) AS starts FROM sc GROUP BY 1")
def scene_list_html(spark, sf_dir):
    """Tables written as HTML, their second cells summed up."""
    rows = scene_files.html_table(_scenes(spark, sf_dir), 25).select("video", F.explode(F.regexp_extract_all("content", F.lit("<tr><td>([^<]*)</td><td>([^<]*)</td>"), F.lit(2))).alias("start"))
    return rows.groupBy("video").agg(F.count("*").alias("n"), F.sum(F.col("start").cast("long")).alias("starts"))


@query(f"WITH {_SCENES} SELECT video, CAST(scene AS BIGINT) AS scene, 'ffmpeg -ss ' || {_clock('start_frame')} || ' -i ' || video || ' -t ' || {_clock('end_frame - start_frame')} || ' ' || video || '-Scene-' || lpad(CAST(scene AS VARCHAR), CAST(greatest(3, length(CAST(scene AS VARCHAR))) AS INTEGER), '0') || '.mp4' AS command FROM sc")
def split_video_commands(spark, sf_dir):
    out = scene_files.split_commands(_scenes(spark, sf_dir), 25)
    return out.select("video", F.col("scene").cast("long").alias("scene"), "command")


@query(f"WITH {_SCENES} SELECT DISTINCT video, unnest([start_frame, end_frame]) AS frame FROM sc")
def marked_frames(spark, sf_dir):
    """Cuts and scene ends of all videos, each frame once."""
    found = _scenes(spark, sf_dir)
    cuts = found.where("start_frame > 0").select("video", F.col("start_frame").alias("cut"))
    return scene_ops.marked_frames(cuts, found)


def _trees(spark, sf_dir) -> DataFrame:
    """Scenes of 13 nodes each: a root, three groups below it, three nodes below each."""
    i = F.col("idx")
    k = (i % 13).cast("int")
    group = F.when(k < 4, k - 1).otherwise(F.floor((k - 4) / 3).cast("int"))
    place = F.when(k == 0, F.array(F.lit(0))).when(k < 4, F.array(F.lit(0), group)).otherwise(F.array(F.lit(0), group, (k - 4) % 3))
    parent = F.when(k == 0, F.lit(None).cast("string")).when(k < 4, "n0").otherwise(F.concat(F.lit("n"), (group + 1).cast("string")))
    return lifts.points(spark, sf_dir).select(
        F.floor(i / 13).alias("scene"), F.concat(F.lit("n"), k.cast("string")).alias("id"), parent.alias("parent"), F.when(k == 0, 0).when(k < 4, 1).otherwise(2).alias("depth"), place.alias("place"),
        F.lit("group").alias("kind"), *(F.col(a).alias(f"t{a}") for a in "xyz"), *(F.lit(float(a == "w")).alias(f"q{a}") for a in "xyzw"), *((1 + F.col(a)).alias(f"s{a}") for a in "xyz"), (k % 5 != 3).alias("visible"),
    )


@query(f"""WITH k AS (SELECT *, idx // 13 AS scene, idx % 13 AS k FROM ({POINTS})), whole AS (SELECT *, CASE WHEN k < 4 THEN k - 1 ELSE (k - 4) // 3 END AS g FROM k),
 there AS (SELECT scene, max(k) AS most, min(k) AS least FROM k GROUP BY 1)
 SELECT scene, 'n' || k AS id, CASE WHEN k = 0 THEN NULL WHEN k < 4 THEN 'n0' ELSE 'n' || (g + 1) END AS parent, CASE WHEN k = 0 THEN 0 WHEN k < 4 THEN 1 ELSE 2 END AS depth, {r('x', 'tx')}, {r('1 + z', 'sz')}, k % 5 <> 3 AS visible
 FROM whole JOIN there USING (scene)""")
def scene_json(spark, sf_dir):
    """Scene trees written as nested JSON and unfolded again."""
    rows = from_json(to_json(_trees(spark, sf_dir), 64, 48))
    return rows.select("scene", "id", "parent", "depth", tidy(F.col("tx")).alias("tx"), tidy(F.col("sz")).alias("sz"), "visible")


@query("SELECT event_id AS workflow, CAST(k AS BIGINT) AS id, CAST(k AS VARCHAR) AS origin, CAST(event_id % 3 AS INTEGER) AS origin_slot, CAST(k + 1 AS VARCHAR) AS target, CASE k WHEN 1 THEN 'IMAGE' ELSE upper(event_type) END AS type FROM events, (VALUES (1), (2)) t(k)")
def workflow_json(spark, sf_dir):
    """Workflows put together from nodes and links, written as JSON and read again."""
    e = lifts.table(spark, sf_dir, "events")
    k, i = F.col("k"), F.col("event_id")
    sockets = F.lit(None).cast("array<struct<name:string,type:string,link:bigint>>")
    nodes = e.select(i.alias("workflow"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), "event_type")
    nodes = nodes.select("workflow", k.cast("string").alias("id"), F.concat(F.lit("T"), "event_type").alias("type"), sockets.alias("inputs"), sockets.alias("outputs"), F.array("event_type").alias("widgets_values"))
    links = e.select(i.alias("workflow"), "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    links = links.select("workflow", k.cast("long").alias("id"), k.cast("string").alias("origin"), (F.col("workflow") % 3).cast("int").alias("origin_slot"), (k + 1).cast("string").alias("target"), F.lit(0).alias("target_slot"), F.when(k == 1, "IMAGE").otherwise(F.upper("event_type")).alias("type"))
    return workflow.links(workflow.as_json(nodes, links)).select("workflow", "id", "origin", "origin_slot", "target", "type")


@query("""WITH e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role FROM conversations WHERE turn % 4 <> 2),
 i AS (SELECT conv_id AS collection, CAST(n - 1 AS INTEGER) AS pos, role AS youtube_id, row_number() OVER (PARTITION BY conv_id, role ORDER BY n) - 1 AS k, CASE WHEN turn % 2 = 0 THEN 'https://x.org/' || turn ELSE 'https://www.youtube.com/watch?v=' || role END AS source_url, CAST(turn AS DOUBLE) AS duration_seconds FROM e WHERE n <= 5)
 SELECT collection, pos, CASE WHEN k > 0 THEN youtube_id || '-' || k ELSE youtube_id END AS item_id, youtube_id, CAST(pos + 1 AS BIGINT) AS playlist_index, source_url, duration_seconds FROM i""")
def manifest_from_playlist(spark, sf_dir):
    """Playlists of conversations: null entries are left out, at most five items are taken."""
    c = lifts.table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    entry = F.struct(F.col("role").alias("id"), F.when(turn % 2 == 0, F.concat(F.lit("https://x.org/"), turn.cast("string"))).alias("webpage_url"), turn.cast("double").alias("duration"))
    text = F.when(turn % 4 == 2, "null").otherwise(F.to_json(entry))
    lists = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("text")))), lambda s: s["text"]), ",")
    json = F.concat(F.lit('{"entries":['), lists, F.lit("]}"))
    return workflow.playlist_items(c.groupBy(F.col("conv_id").alias("collection")).agg(json.alias("json")), 5).drop("title", "upload_date")


@query("SELECT page_id AS pos, length(url) AS size FROM pages ORDER BY page_id LIMIT 20")
def first_items(spark, sf_dir):
    """A bounded load: the first twenty in order."""
    from ..operators.cloud import first_rows

    return first_rows(lifts.table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.length("url").alias("size")), 20, "pos")
