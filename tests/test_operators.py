"""Fixtures with known values, and properties that hold for any input."""

import math

import pytest
from pyspark.sql import functions as F

from meridia.functions import shapes, text, timecodes
from meridia.functions.cameras import Intrinsics, Pose
from meridia.functions.vectors import Mat, Quat, Similarity, Vec
from meridia.operators import cloud, mesh, scenes, spatial, timeline, tracks, workflow


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def square(spark, extra=""):
    v = spark.createDataFrame([(0, k, *p) for k, p in enumerate([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (1.0, 1.0, 0.0)])], "mesh_id int, v_idx long, x double, y double, z double")
    t = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 1, 3, 2)], "mesh_id int, t_idx long, a long, b long, c long")
    return v, t


def test_constants_fold_in_python():
    q = Quat.about(Vec.of(0, 0, 1), math.pi / 2)
    assert all(isinstance(c, float) for c in q.rotate(Vec.of(1, 0, 0)))
    assert [round(c, 9) for c in q.rotate(Vec.of(1, 0, 0))] == [0, 1, 0]
    m = Mat([[2.0, 0, 0], [0, 3, 0], [0, 0, 4]])
    assert m.determinant() == 24 and [r[i] for i, r in enumerate((m @ m.inverse()).rows)] == [1, 1, 1]
    assert Mat([[1.0, 1], [1, 1]]).inverse().rows == [[None, None], [None, None]]


@pytest.mark.parametrize("order", ["xyz", "xzy", "yxz", "yzx", "zxy", "zyx"])
def test_euler_orders(order):
    q = Quat.euler(order, 0.3, -0.4, 0.5)
    assert [round(a, 9) for a in q.to_euler(order)] == [0.3, -0.4, 0.5]
    assert abs(abs(q.matrix().quaternion().dot(q)) - 1) < 1e-9


def test_transform_and_inverse_cancel():
    move = Similarity(Quat.about(Vec.of(1, 2, 3), 0.7), Vec.of(1, -2, 3), 2.0)
    back = move.then(move.inverse()).apply(Vec.of(4, 5, 6))
    assert [round(c, 9) for c in back] == [4, 5, 6]


def test_camera_projects_its_axis(spark):
    lens, pose = Intrinsics.of(32, 32, 30, 30, 15, 15), Pose.look_at(Vec.of(0, 0, 0), Vec.of(0, 0, 1), Vec.of(0, 1, 0))
    assert pose.project(lens, Vec.of(0, 0, 3)) == (15, 15, 3)
    assert pose.project(lens, Vec.of(0, 0, -3)) == (None, None, None)


def test_touching_shapes():
    box = shapes.Box(Vec.of(0, 0, 0), Vec.of(1, 1, 1))
    beside = shapes.Box(Vec.of(1, 0, 0), Vec.of(2, 1, 1))
    assert not box.overlaps(beside) and box.contains(Vec.of(1, 1, 1))
    assert shapes.spheres_meet(Vec.of(0, 0, 0), 1.0, Vec.of(2, 0, 0), 1.0)
    assert shapes.Ray(Vec.of(-1, 0, 0), Vec.of(1, 0, 0)).sphere(Vec.of(0, 1, 0), 1.0) == (1.0, None)
    assert shapes.Ray(Vec.of(-1, 0.5, 0.5), Vec.of(1, 0, 0)).box(box) == (1.0, 2.0)


def test_pairs_agree_with_brute_force(spark):
    rows = [(i, *(((i * k) % 17) / 4.0 for k in (3, 5, 7))) for i in range(120)]
    b = spark.createDataFrame(rows, "idx long, lo_x double, lo_y double, lo_z double")
    b = b.select("*", *((F.col(f"lo_{a}") + (F.col("idx") % 4 + 1) * 0.3).alias(f"hi_{a}") for a in "xyz"))
    huge = b.unionByName(spark.createDataFrame([(500, -100.0, -100.0, -100.0, 100.0, 100.0, 100.0)], b.schema))
    want = sorted(map(tuple, spatial.brute_pairs(huge).collect()))
    assert sorted(map(tuple, spatial.overlap_pairs(huge, cell=0.5).collect())) == want
    assert sorted(map(tuple, spatial.sweep_pairs(huge, 0.7).collect())) == want


def test_empty_cloud(spark):
    none = spark.createDataFrame([], "idx long, x double, y double, z double")
    assert cloud.summary(none).first()["n"] == 0 and cloud.summary(none).first()["cx"] is None
    assert cloud.nearest(none, Vec.of(0, 0, 0)).count() == 0
    with pytest.raises(ValueError):
        cloud.voxel_downsample(none, 0)


def test_square_mesh(spark):
    v, t = square(spark)
    m = mesh.measures(v, t).first()
    assert m["area"] == 1.0 and m["volume"] == 0.0 and (m["cx"], m["cy"]) == (0.5, 0.5)
    topo = mesh.topology(t).first()
    assert (topo["edges"], topo["boundary_edges"], topo["manifold"], topo["watertight"]) == (5, 4, True, False)
    assert {r["component"] for r in mesh.components(t).collect()} == {0}
    assert {(r["nx"], r["ny"], r["nz"]) for r in mesh.vertex_normals(v, t).collect()} == {(0.0, 0.0, 1.0)}
    assert mesh.samples(v, t, 7).count() == 7


def reference_merge(rows, length):
    last, enabled, merging, since, cuts = None, False, False, None, []
    for frame, above in rows:
        last = frame if last is None else last
        far = frame - last >= length
        last = frame if above else last
        if merging:
            if far and not above and last - since >= length:
                merging = False
                cuts.append(last)
        elif above and far:
            enabled = True
            cuts.append(frame)
        elif above and enabled:
            merging, since = True, frame
    return cuts


def test_merge_fold_equals_a_plain_loop(spark):
    rows = [(f, (f * 7919) % 11 < 3) for f in range(200)]
    df = spark.createDataFrame([("v", f, a) for f, a in rows], "video string, frame long, above boolean")
    for length in (0, 3, 8, 20):
        got = sorted(r["cut"] for r in scenes.merged_cuts(df, F.col("above"), length).collect())
        assert got == (reference_merge(rows, length) if length else [f for f, a in rows if a])


def test_final_scene_of_a_fade_out(spark):
    rows = [("v", f, v) for f, v in enumerate([50.0] * 5 + [0.0] * 5 + [50.0] * 5 + [0.0] * 5)]
    df = spark.createDataFrame(rows, "video string, frame long, value double")
    assert sorted(r["cut"] for r in scenes.fade_cuts(df, 12, length=3, final_scene=True).collect()) == [7, 15]
    assert [r["cut"] for r in scenes.fade_cuts(df, 12, length=3).collect()] == [7]


def test_scenes_tile_the_time_line(spark):
    cuts = spark.createDataFrame([("v", 10), ("v", 30), ("v", 30)], "video string, cut long")
    spans = spark.createDataFrame([("v", 0, 50), ("w", 0, 9)], "video string, first long, end long")
    got = sorted(map(tuple, scenes.scenes(cuts, spans).collect()))
    assert got == [("v", 1, 0, 10), ("v", 2, 10, 30), ("v", 3, 30, 50), ("w", 1, 0, 9)]
    short = scenes.tidied(scenes.scenes(cuts, spans), 21, merge_last=True, drop_short=True)
    assert sorted(map(tuple, short.collect())) == [("v", 2, 10, 50)]


def test_timecodes(spark):
    fps = F.lit(30.0)
    cases = {"00:05:00.000": 9000, "00:05:00": 9000, "9000": 9000, "300s": 9000, "300.0": 9000, "05:00": 9000, "1:2:3:4": None, "00:61:00": None, "x": None}
    df = spark.createDataFrame(list(cases.items()), "t string, f long")
    assert all(r["got"] == r["f"] for r in df.select("f", timecodes.parse_timecode(F.col("t"), fps).alias("got")).collect())
    assert one(spark, timecodes.timecode(F.lit(1799), fps))[0] == "00:00:59.967"
    assert one(spark, timecodes.timecode(F.lit(59.9996), F.lit(1.0)))[0] == "00:01:00.000"


def test_keyframes_clamp_and_interpolate(spark):
    keys = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 3.0)], "track string, t double, value double")
    at = spark.createDataFrame([("a", -5.0), ("a", 0.0), ("a", 5.0), ("a", 99.0), ("b", 1.0)], "track string, t double")
    assert {r["t"]: r["value"] for r in timeline.sampled(keys, at).collect()} == {-5.0: 1.0, 0.0: 1.0, 5.0: 2.0, 99.0: 3.0}


def test_second_best_ignores_ties(spark):
    f = spark.createDataFrame([(0, 0, [0]), (1, 0, [1]), (1, 1, [1]), (1, 2, [255])], "image_id long, feature long, words array<long>")
    pairs = tracks.adjacent_pairs(f.select("image_id").distinct())
    got = tracks.match_features(f, pairs, 96, 0.8).collect()
    assert [(r["left_feature"], r["right_feature"], r["distance"]) for r in got] == [(0, 0, 1)]


def test_tracker_joins_and_opens(spark):
    rows = [("s", 0, 0, 0, 0, 10, 10), ("s", 1, 1, 1, 0, 10, 10), ("s", 2, 2, 50, 50, 10, 10), ("s", 9, 3, 1, 0, 10, 10)]
    df = spark.createDataFrame(rows, "scene string, frame long, idx long, x int, y int, width int, height int")
    assert timeline.distinct_tracks(df).first()["n_tracks"] == 3


def test_small_text_functions(spark):
    assert one(spark, text.item_id(F.lit("  A b!!c ")))[0] == "A-b-c"
    assert one(spark, text.shell_quote(F.lit("it's")))[0] == "'it'\\''s'"
    assert one(spark, text.frame_number(F.lit("no digits")))[0] is None
    assert one(spark, text.short_number(F.lit(-0.0001)))[0] == "0"


def test_broken_json_is_no_workflow(spark):
    df = spark.createDataFrame([(1, "{not json"), (2, None)], "workflow long, json string")
    assert workflow.problems(df).count() == 0 and workflow.nodes(df).count() == 0
