"""Keyframe tracks: as-of joins, interpolation, buckets and greedy box tracking."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sampled(keys: DataFrame, samples: DataFrame) -> DataFrame:
    """(track, t, v0, v1, t0, t1, value): the last key at or before t, the first at or after, and the linear value.

    ``keys(track, t, value)``, ``samples(track, t)``. Outside a track's keys the end key holds. Both are one sorted stream
    by track, read with windows in either direction: one shuffle on the track, no pair join.
    """
    tagged = keys.select("track", "t", "value", F.lit(0).alias("kind")).unionByName(
        samples.select("track", "t", F.lit(None).cast("double").alias("value"), F.lit(1).alias("kind"))
    )
    key = F.when(F.col("kind") == 0, F.struct("t", "value"))
    by_t = Window.partitionBy("track").orderBy("t", "kind")
    back = F.last(key, ignorenulls=True).over(by_t.rowsBetween(Window.unboundedPreceding, 0))
    same = Window.partitionBy("track").orderBy(F.col("t").desc(), "kind")
    ahead = F.last(key, ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, 0))
    rows = tagged.withColumn("p", back).withColumn("q", ahead).where("kind = 1 AND (p IS NOT NULL OR q IS NOT NULL)")
    rows = rows.withColumn("p", F.coalesce("p", "q")).withColumn("q", F.coalesce("q", "p"))
    t0, t1 = F.col("p.t"), F.col("q.t")
    f = F.when(t1 > t0, (F.col("t") - t0) / (t1 - t0)).otherwise(0.0)
    value = F.col("p.value") + (F.col("q.value") - F.col("p.value")) * f
    return rows.select("track", "t", t0.alias("t0"), F.col("p.value").alias("v0"), t1.alias("t1"), F.col("q.value").alias("v1"), value.alias("value"))


def strictly_increasing(keys: DataFrame) -> DataFrame:
    """Keys that do not come after the key before them: what breaks a track."""
    before = F.lag("t").over(Window.partitionBy("track").orderBy("idx"))
    return keys.withColumn("before", before).where("t <= before").select("track", "idx", "t")


def tumbling(records: DataFrame, size: int, order: str = "idx") -> DataFrame:
    """(stream, bucket, n, bytes): records in buckets of ``size`` by order of arrival over all streams.

    ``idx`` numbers the records from 0, so the bucket is arithmetic and no global sort is needed.
    """
    bucket = F.floor(F.col(order) / size)
    return records.groupBy("stream", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


class _Greedy:
    """Tracks of one scene: each box joins the best overlapping track seen lately, or opens one. Holds the live tracks alone."""

    def __init__(self, gap: int, least: float):
        self.gap, self.least, self.opened, self.live = gap, least, 0, []

    def add(self, frame, x, y, w, h) -> None:
        self.live = [track for track in self.live if frame - track[0] <= self.gap]  # others can't be joined any more
        best, top = None, 0.0
        for track in self.live:
            wide = min(track[1] + track[3], x + w) - max(track[1], x)
            high = min(track[2] + track[4], y + h) - max(track[2], y)
            if wide <= 0 or high <= 0:
                continue
            share = wide * high / (track[3] * track[4] + w * h - wide * high)
            if share >= self.least and share > top:
                best, top = track, share
        if best is None:
            self.opened += 1
            self.live.append([frame, x, y, w, h])
        else:
            best[:] = [frame, x, y, w, h]


def distinct_tracks(boxes: DataFrame, sample_every: int = 1, least: float = 0.5) -> DataFrame:
    """(scene, n_tracks) by greedy tracking of ``boxes(scene, frame, idx, x, y, width, height)``.

    A task streams its scenes in frame order; its state is the live tracks of one scene.
    """
    gap = max(1, sample_every) * 2
    names = ["frame", "x", "y", "width", "height"]
    ordered = boxes.select("scene", "frame", "idx", *names[1:]).repartition("scene").sortWithinPartitions("scene", "frame", "idx")

    def run(batches):
        scene, tracks = None, None
        for batch in batches:
            columns, done = batch.to_pydict(), []
            for now, *box in zip(columns["scene"], *(columns[c] for c in names)):
                if tracks is None or now != scene:
                    if tracks is not None:
                        done.append((scene, tracks.opened))
                    scene, tracks = now, _Greedy(gap, least)
                tracks.add(*box)
            yield _counts(done)
        yield _counts([] if tracks is None else [(scene, tracks.opened)])

    return ordered.mapInArrow(run, "scene string, n_tracks long")


def _counts(done: list[tuple]) -> pa.RecordBatch:
    scenes, counts = zip(*done) if done else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(scenes, pa.string()), pa.array(counts, pa.int64())], names=["scene", "n_tracks"])


def peak_visible(boxes: DataFrame) -> DataFrame:
    """(scene, peak): the most boxes in one frame."""
    return boxes.groupBy("scene", "frame").agg(F.count("*").alias("n")).groupBy("scene").agg(F.max("n").alias("peak"))
