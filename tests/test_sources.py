"""Round trips and known files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.sources import files, meshes, reconstructions, scene_files, splat_files
from meridia.streaming.cuts import live_cuts

OBJ = "v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n"


def written(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def triangle(v, t):
    points = [(r["x"], r["y"], r["z"]) for r in v.orderBy("v_idx").collect()]
    return points, [(r["a"], r["b"], r["c"]) for r in t.orderBy("t_idx").collect()]


WANT = ([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)], [(0, 1, 2)])


def test_mesh_formats_agree(spark, tmp_path):
    v, t = meshes.read_mesh(spark, written(tmp_path, "m.obj", "# note\n" + OBJ.replace("f 1 2 3", "f 1/1 2/2 3/3")))
    assert triangle(v, t) == WANT
    assert meshes.as_obj(v, t).first()["content"] == OBJ
    for ending, text in (("ply", meshes.as_ply(v, t)), ("gltf", meshes.as_gltf(v, t))):
        out = text.select(F.lit(f"file://{tmp_path}/again.{ending}").alias("path"), "content")
        assert files.write_files(out) == 1
        assert triangle(*meshes.read_mesh(spark, f"{tmp_path}/again.{ending}")) == WANT
    with pytest.raises(ValueError):
        meshes.read_mesh(spark, "m.stl")


def test_polygons_fan_and_bad_corners_fail(spark, tmp_path):
    v, t = meshes.read_obj(spark, written(tmp_path, "q.obj", "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2 3 4\n"))
    assert triangle(v, t)[1] == [(0, 1, 2), (0, 2, 3)]
    with pytest.raises(Exception, match="positive"):
        meshes.read_obj(spark, written(tmp_path, "n.obj", "v 0 0 0\nf -1 1 1\n"))[1].collect()


def test_sparse_reconstruction(spark, tmp_path):
    written(tmp_path, "cameras.txt", "# cameras\n1 PINHOLE 64 48 50 50 32 24\n")
    written(tmp_path, "images.txt", "# images\n1 1 0 0 0 0 0 0 1 a b.png\n\n2 1 0 0 0 1 0 0 1 c.png\n3.5 4.5 7 1 2 -1\n")
    written(tmp_path, "points3D.txt", "9 1 2 3 255 0 51 0.5 1 0 1 4 2 1\n10 0 0 0 0 0 0 0 1 0\n")
    cameras, images, points = reconstructions.read_folder(spark, str(tmp_path))
    assert cameras.first()["params"] == [50, 50, 32, 24]
    rows = {r["image_id"]: r for r in images.collect()}
    assert rows[1]["name"] == "a b.png" and rows[1]["points2d"] == []
    assert [(p["x"], p["point3d_id"]) for p in rows[2]["points2d"]] == [(3.5, 7), (1.0, None)]
    kept, elements = reconstructions.sparse_points(points)
    assert [(r["new_id"], r["r"]) for r in kept.collect()] == [(1, 1.0)]
    assert sorted(map(tuple, elements.collect())) == [(1, 1, 0), (1, 2, 1)]
    texts = {r["name"]: r["content"] for r in reconstructions.as_texts(cameras, images, points).collect()}
    folder = tmp_path / "again"
    folder.mkdir()
    for name, content in texts.items():
        written(folder, name, content)
    for one, two in zip((cameras, images, points), reconstructions.read_folder(spark, str(folder))):
        assert sorted(map(repr, one.drop("line_no").collect())) == sorted(map(repr, two.drop("line_no").collect()))
    assert not reconstructions.views(images, cameras).where("missing_camera").count()


def test_transforms_files(spark, tmp_path):
    path = written(tmp_path, "t.json", '{"fl_x": 50, "fl_y": 50, "cx": 32, "cy": 24, "w": 64, "h": 48, "frames": [{"file_path": "a.png", "fl_x": 60, "transform_matrix": [[1,0,0,0],[0,1,0,0],[0,0,1,0],[0,0,0,1]]}]}')
    row = reconstructions.read_nerfstudio(spark, path).first()
    assert (row["fl_x"], row["fl_y"], row["w"]) == (60, 50, 64) and row["m"][0] == 1 and len(row["m"]) == 16
    again = written(tmp_path, "u.json", reconstructions.as_nerfstudio(reconstructions.read_nerfstudio(spark, path)).first()["content"])
    assert reconstructions.read_nerfstudio(spark, again).first()["m"] == row["m"]


def test_splat_files(spark, tmp_path):
    row = ("f", 0, 1.0, 2.0, 3.0, 0.1, 0.2, 0.3, 0.0, 0.0, 0.0, 1.0, 0.5, [0.1, 0.2, 0.3], [float(k) for k in range(9)])
    df = spark.createDataFrame([row], splat_files.SPLATS)
    path = written(tmp_path, "s.ply", bytes(splat_files.as_splat_files(df).first()["content"]))
    got = splat_files.read_splats(spark, path).first()
    assert np.allclose([got["x"], got["qw"], got["logit"], *got["sh"]], [1, 1, 0.5, *range(9)])
    assert splat_files.read_ply_cloud(spark, path).first()["z"] == 3.0


def test_scene_files(spark, tmp_path):
    s = spark.createDataFrame([("v", 1, 0, 50), ("v", 2, 50, 75)], "video string, scene int, start_frame long, end_frame long")
    first = scene_files.scene_list(s, 25).orderBy("Scene Number").first()
    assert (first["Start Frame"], first["End Frame"], first["End Timecode"], first["Length (seconds)"]) == (1, 50, "00:00:02.000", "2.000")
    scene_files.write_scene_list(s, 25, f"{tmp_path}/list")
    assert [r["cut"] for r in scene_files.load_scenes(spark, f"{tmp_path}/list", 25, 0, 100).collect()] == [50]
    assert "001  AX       V     C        00:00:00:00 00:00:02:00" in scene_files.edit_list(s, 25, "T").first()["content"]
    assert scene_files.keyframe_list(s).first()["content"] == "0 I -1\n50 I -1\n"
    assert scene_files.html_table(s, 25).first()["content"].count("<tr>") == 3
    assert scene_files.split_commands(s, 25).count() == 2


def test_statistics_files(spark, tmp_path):
    m = spark.createDataFrame([("v", 0, "b", 1.5), ("v", 0, "a", 2.0), ("v", 1, "a", 3.0)], "video string, frame long, metric string, value double")
    scene_files.stats_table(m, ["b", "a"]).drop("video").write.csv(f"{tmp_path}/stats", header=True)
    got = sorted(map(tuple, scene_files.load_stats(spark, f"{tmp_path}/stats").collect()))
    assert got == [(0, "a", 2.0), (0, "b", 1.5), (1, "a", 3.0)]


def test_live_cuts(spark, tmp_path):
    rows = [("v", f, 100.0 if f >= 10 else 0.0) for f in range(20)]
    spark.createDataFrame(rows, "video string, frame long, value double").repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("video string, frame long, value double").parquet(f"{tmp_path}/in")
    q = live_cuts(stream, 50, 5).writeStream.format("memory").queryName("cuts").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM cuts").collect()] == [("v", 10)]
