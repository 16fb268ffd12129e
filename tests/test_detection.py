"""Live detection: order of arrival, late records, expiry, restarts and batches that are run again."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meridia.operators import scenes
from meridia.operators.tables import fresh_path
from meridia.streaming import detection as d

KIND = "video string, frame long, ts timestamp, value double"
BEGIN = datetime(2024, 1, 1)
RULES = {"merge": d.Content(30, 4), "suppress": d.Content(30, 4, merges=False), "adaptive": d.Adaptive(1.5, 2, 5.0, 3), "fades": d.Fades(25, 0.5, 3, final_scene=True)}


def frames(n=400):
    rng = random.Random(2)
    return [(v, k, BEGIN + timedelta(seconds=k), float(rng.randint(0, 99) if rng.random() < 0.3 else 50)) for v in ("a", "b") for k in range(n)]


def write(spark, path, k, rows):
    spark.createDataFrame(rows, KIND).repartition(1).write.parquet(f"{path}/part={k}")


def arrivals(spark, late=20):
    """Files in which frames come up to ``late`` seconds late, then two of no video, far ahead, that move the watermark."""
    rng, path = random.Random(4), fresh_path(spark, "arrivals")
    rows = sorted(frames(), key=lambda r: (r[2] + timedelta(seconds=rng.randint(0, late)), rng.random()))
    parts = [rows[k::1][:160] for k in range(0, len(rows), 160)]
    for k in (1, 2):
        parts.append([(None, None, BEGIN + timedelta(days=k), None)])
    return path, parts


def stream(spark, path):
    rows = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
    return d.live_scenes(rows, RULES, "20 seconds", "1 hour")


def cuts(found):
    rows = found.where("video IS NOT NULL").select("rule", "video", F.col("end_frame").alias("cut")).collect()
    return sorted(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def wanted(spark):
    """The batch detectors' cuts, and the end of each video for each rule."""
    rows = spark.createDataFrame(frames(), KIND).select("video", "frame", "value")
    scored = scenes.content_score(rows, {"value": 1.0})
    batch = {
        "merge": scenes.merged_cuts(scored, F.col("score") >= 30, 4), "suppress": scenes.suppressed_cuts(scored, F.col("score") >= 30, 4),
        "adaptive": scenes.adaptive_cuts(scored, 1.5, 2, 5.0, 3), "fades": scenes.fade_cuts(rows, 25, 0.5, 3, final_scene=True),
    }
    found = [(rule, r["video"], r["cut"]) for rule, df in batch.items() for r in df.collect()]
    assert all(sum(f[0] == rule for f in found) > 10 for rule in batch)
    return sorted(found + [(rule, v, 400) for rule in batch for v in "ab"])


def test_shuffled_arrivals_restarts_and_failures(spark, wanted):
    path, parts = arrivals(spark)
    out, checkpoint, calls = fresh_path(spark, "found"), fresh_path(spark, "check"), []
    write(spark, path, 0, parts[0])
    write(spark, path, 1, parts[1])
    d.run_available(stream(spark, path), out, checkpoint)

    def fails_once(batch, number):
        calls.append((number, batch.count()))
        if len(calls) == 2:
            raise RuntimeError("the sink broke")

    for k in range(2, len(parts)):
        write(spark, path, k, parts[k])
    with pytest.raises(Exception, match="the sink broke"):
        d.run_available(stream(spark, path), out, checkpoint, fails_once)
    found = d.run_available(stream(spark, path), out, checkpoint, fails_once)
    assert calls[1] == calls[2]  # the batch that failed is run again, and replaces what it wrote
    assert cuts(found) == wanted
    assert d.run_available(stream(spark, path), out, checkpoint).count() == found.count()  # nothing new, nothing told twice


def test_records_beyond_the_delay_are_left_out(spark):
    path = fresh_path(spark, "late")
    write(spark, path, 0, [("a", k, BEGIN + timedelta(seconds=k), 0.0) for k in (0, 1, 100)])
    write(spark, path, 1, [("a", 101, BEGIN + timedelta(seconds=101), 0.0)])
    write(spark, path, 2, [("a", 2, BEGIN + timedelta(seconds=2), 99.0), ("a", 102, BEGIN + timedelta(seconds=102), 99.0)])
    for k in (3, 4):
        write(spark, path, k, [(None, None, BEGIN + timedelta(days=k), None)])
    rows = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
    found = d.run_available(d.live_scenes(rows, {"cut": d.Content(50, 1)}, "20 seconds"), fresh_path(spark, "found"), fresh_path(spark, "check"))
    assert sorted(map(tuple, found.select("start_frame", "end_frame").collect())) == [(0, 102), (102, 103)]


def test_buckets_close_when_full_or_at_the_end(spark):
    path = fresh_path(spark, "records")
    rows = [("r", k, BEGIN + timedelta(seconds=k), ("video", "audio", "video")[k % 3], k) for k in range(25)]
    kind = "run string, at long, ts timestamp, stream string, bytes long"
    random.Random(1).shuffle(rows)
    for k, part in enumerate((rows[:12], rows[12:], [(None, None, BEGIN + timedelta(days=1), None, None)], [(None, None, BEGIN + timedelta(days=2), None, None)])):
        spark.createDataFrame(part, kind).repartition(1).write.parquet(f"{path}/part={k}")
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
    found = d.run_available(d.live_buckets(source, 10, 4, "30 seconds"), fresh_path(spark, "found"), fresh_path(spark, "check"))
    got = sorted(map(tuple, found.select("kind", "stream", "number", "n", "bytes").collect()))
    streams = {k: ("video", "audio", "video")[k % 3] for k in range(25)}
    want = [("bucket", s, b, sum(streams[k] == s for k in part), sum(k for k in part if streams[k] == s)) for b, part in enumerate((range(10), range(10, 20), range(20, 25))) for s in ("audio", "video")]
    for s in ("audio", "video"):
        own = [k for k in range(25) if streams[k] == s]
        want += [("sample", s, i, 1, own[i]) for i in range(0, len(own), 4)]
    assert got == sorted(want)
