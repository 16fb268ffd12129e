"""Scene detection over per-frame metrics: frames(video, frame, value), any number of videos at once.

Window functions compare neighbouring frames; decisions that carry state run as a fold over a video's frames in order, which
a task streams. A fold sees only the events that can change its state.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by_frame():
    return Window.partitionBy("video").orderBy("frame")


def deltas(frames: DataFrame, columns: list[str]) -> DataFrame:
    """Absolute change of each column against the frame before, 0 for a video's first frame."""
    change = {f"delta_{c}": F.coalesce(F.abs(F.col(c) - F.lag(c).over(_by_frame())), F.lit(0.0)) for c in columns}
    return frames.withColumns(change)


def content_score(frames: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the components' changes, as ``score``."""
    total = sum(abs(w) for w in weights.values())
    score = sum((F.col(f"delta_{c}") * w for c, w in weights.items()), F.lit(0.0)) / total
    return deltas(frames, list(weights)).withColumn("score", score)


def adaptive_ratio(scored: DataFrame, width: int = 2, min_content: float = 15.0) -> DataFrame:
    """``ratio``: score over the mean of ``width`` frames on either side, at most 255; NULL without full windows."""
    around = _by_frame().rowsBetween(-width, width)
    n, total = F.count("*").over(around), F.sum("score").over(around)
    mean = (total - F.col("score")) / (2.0 * width)
    ratio = (
        F.when(F.abs(mean) >= 0.00001, F.least(F.col("score") / mean, F.lit(255.0)))
        .when(F.col("score") >= min_content, 255.0)
        .otherwise(0.0)
    )
    return scored.withColumn("ratio", F.when(n == 2 * width + 1, ratio))


def _folded(rows: DataFrame, order: list[str], machine) -> DataFrame:
    """(video, cut): what ``machine()``, a function with state, gives for the rows of a video in order, where it is not None.

    A task streams its videos sorted, with the state of one video at a time, however many rows that has.
    """
    ordered = rows.select("video", *order).repartition("video").sortWithinPartitions("video", *order)

    def run(batches):
        video, step = object(), None
        for batch in batches:
            columns, out = batch.to_pydict(), []
            for now, *values in zip(columns["video"], *(columns[c] for c in order)):
                if step is None or now != video:
                    video, step = now, machine()
                cut = step(*values)
                if cut is not None:
                    out.append((now, cut))
            videos, cuts = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(videos, batch.schema.field("video").type), pa.array(cuts, pa.int64())], names=["video", "cut"])

    return ordered.mapInArrow(run, f"video {rows.schema['video'].dataType.simpleString()}, cut long")


def _spaced(length: int):
    """Machine of (frame, counted, first): a frame cuts if what is counted is ``length`` after the last cut, or the first frame."""

    def machine():
        last = None

        def step(frame, counted, first):
            nonlocal last
            last = first if last is None else last
            if counted - last < length:
                return None
            last = frame
            return frame

        return step

    return machine


def suppressed_cuts(frames: DataFrame, above: Column, length: int, skip_zero: bool = False) -> DataFrame:
    """Cuts at frames ``above`` that come at least ``length`` frames after the last cut (or a video's first frame).

    Only frames above the threshold enter the fold, with their video's first frame. With ``skip_zero`` a first frame 0 does not
    count as one, so that lengths are counted from frame 1.
    """
    first = F.min("frame").over(Window.partitionBy("video"))
    first = F.greatest(first, F.lit(1)) if skip_zero else first
    rows = frames.select("video", F.col("frame").cast("long").alias("frame"), above.alias("above"), first.cast("long").alias("first"))
    rows = rows.where("above")
    if length <= 0:
        return rows.select("video", F.col("frame").alias("cut"))
    return _folded(rows.withColumn("counted", F.col("frame")), ["frame", "counted", "first"], _spaced(length))


def merged_cuts(frames: DataFrame, above: Column, length: int) -> DataFrame:
    """Cuts where bursts of frames ``above``, closer than ``length``, give one cut at the burst's last such frame.

    The fold sees each video's first frame, the frames above, and of the others the first that is ``length`` after one above.
    """
    rows = frames.select("video", F.col("frame").cast("long").alias("frame"), F.coalesce(above, F.lit(False)).alias("above"))
    if length <= 0:
        return rows.where("above").select("video", F.col("frame").alias("cut"))
    by_frame = _by_frame()
    latest = F.last(F.when(F.col("above") | (F.col("place") == 1), F.col("frame")), ignorenulls=True).over(by_frame.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("place", F.row_number().over(by_frame)).withColumn("latest", latest)
    rows = rows.withColumn("far", F.col("frame") - F.col("latest") >= length)
    repeats = F.lag("far").over(by_frame) & (F.lag("latest").over(by_frame) == F.col("latest"))
    rows = rows.withColumn("repeats", F.coalesce(repeats, F.lit(False))).where("above OR place = 1 OR (far AND NOT repeats)")

    def machine():
        last = since = None
        enabled = merging = False

        def step(frame, is_above):
            nonlocal last, since, enabled, merging
            before = frame if last is None else last
            far = frame - before >= length
            last = frame if is_above else before
            if merging:
                if far and not is_above and last - since >= length:
                    merging = False
                    return last
            elif is_above and far:
                enabled = True
                return frame
            elif is_above and enabled:
                merging, since = True, frame
            return None

        return step

    return _folded(rows, ["frame", "above"], machine)


def adaptive_cuts(scored: DataFrame, threshold: float = 3.0, width: int = 2, min_content: float = 15.0, length: int = 15) -> DataFrame:
    """Cuts where ratio and score are high; the length is counted from the frame ``width`` after the candidate."""
    first = F.min("frame").over(Window.partitionBy("video"))
    rows = adaptive_ratio(scored, width, min_content).withColumn("first", first.cast("long"))
    ahead = F.lead("frame", width).over(_by_frame()).cast("long")
    rows = rows.withColumn("counted", ahead).where((F.col("ratio") >= threshold) & (F.col("score") >= min_content))
    rows = rows.select("video", F.col("frame").cast("long").alias("frame"), "counted", "first")
    return _folded(rows, ["frame", "counted", "first"], _spaced(length))


def _fade_events(frames: DataFrame, threshold: float, ceiling: bool) -> DataFrame:
    """(video, frame, kind, seq): crossings with seq 1; a video that starts out has that as an event at 0, with seq 0."""
    low = F.col("value") < threshold
    dark = ~low if ceiling else low
    first = F.row_number().over(_by_frame()) == 1
    rows = frames.withColumn("first", first)
    rows = rows.withColumn("kind", F.when(F.when(F.col("first"), low).otherwise(dark), "out").otherwise("in"))
    rows = rows.withColumn("before", F.lag("kind").over(_by_frame()))
    rows = rows.where(F.when(F.col("first"), F.col("kind") == "out").otherwise(F.col("before") != F.col("kind")))
    frame = F.when(F.col("first"), F.lit(0)).otherwise(F.col("frame")).cast("long")
    return rows.select("video", frame.alias("frame"), "kind", F.when(F.col("first"), 0).otherwise(1).alias("seq"))


def fades(frames: DataFrame, threshold: float, ceiling: bool = False) -> DataFrame:
    """(video, frame, kind): frames at which the value crosses the threshold, "out" below and "in" above it.

    A video's first frame starts "in" unless it lies below, whatever the method.
    """
    return _fade_events(frames, threshold, ceiling).where("seq = 1").drop("seq")


def fade_cuts(frames: DataFrame, threshold: float, bias: float = 0.0, length: int = 15, ceiling: bool = False, final_scene: bool = False) -> DataFrame:
    """A cut between each fade out and the next fade in, if ``length`` frames passed since the last kept fade in."""
    span = frames.groupBy("video").agg(F.min("frame").cast("long").alias("first"), F.max("frame").cast("long").alias("end"))
    events = _fade_events(frames, threshold, ceiling)
    pairs = events.withColumn("out", F.lag("frame").over(Window.partitionBy("video").orderBy("seq", "frame")))
    ins = pairs.where("kind = 'in' AND out IS NOT NULL").join(span, "video").select("video", F.lit(False).alias("ends"), "frame", "out", "first")
    if final_scene:
        # a video that ends in the dark is cut where that began, if the last scene is long enough
        latest = events.groupBy("video").agg(F.max(F.struct("seq", "frame", "kind")).alias("e")).where("e.kind = 'out'")
        ins = ins.unionByName(span.join(latest, "video").select("video", F.lit(True).alias("ends"), F.col("end").alias("frame"), F.col("e.frame").alias("out"), "first"))

    def machine():
        last = None

        def step(ends, frame, out, first):
            nonlocal last
            last = first if last is None else last
            if frame - last < length:
                return None
            last = frame
            return out if ends else (frame + out + int(bias * (frame - out))) // 2

        return step

    return _folded(ins, ["ends", "frame", "out", "first"], machine)


def buffered_frames(detector: str, width: int = 2, length: int = 15, merges: bool = True) -> int:
    """How many frames later than its own a cut may be told at most, by detector; what a live consumer must hold back."""
    late = {"adaptive": width, "content": length if merges else 0, "threshold": 0, "histogram": 0, "hash": 0}
    if detector not in late:
        raise ValueError(f"no detector is known as {detector}")
    return late[detector]


def every_frame(frames: DataFrame, n: int) -> DataFrame:
    """Every ``n``-th frame of each video, from frame 0."""
    if n < 1:
        raise ValueError("frames are sampled every 1 or more")
    return frames.where(F.col("frame") % n == 0)


def marked_frames(cuts: DataFrame, found: DataFrame) -> DataFrame:
    """(video, frame) of all cuts and of the first and last frames of all scenes, each once, in order."""
    ends = found.select("video", F.explode(F.array("start_frame", "end_frame")).alias("frame"))
    return cuts.select("video", F.col("cut").alias("frame")).unionByName(ends).distinct().orderBy("video", "frame")


def scenes(cuts: DataFrame, spans: DataFrame) -> DataFrame:
    """(video, scene, start_frame, end_frame): half-open intervals between the cuts of ``spans(video, first, end)``."""
    starts = spans.select("video", F.col("first").alias("start_frame")).unionByName(cuts.select("video", F.col("cut").alias("start_frame"))).distinct()
    w = Window.partitionBy("video").orderBy("start_frame")
    rows = starts.join(spans, "video").withColumn("end_frame", F.coalesce(F.lead("start_frame").over(w), "end"))
    return rows.select("video", F.row_number().over(w).alias("scene"), "start_frame", "end_frame")


def tidied(found: DataFrame, length: int, merge_last: bool = False, drop_short: bool = False) -> DataFrame:
    """Merge a short last scene into the one before it, then drop scenes shorter than ``length``."""
    if merge_last and length > 0:
        w = Window.partitionBy("video").orderBy("scene")
        n = F.count("*").over(Window.partitionBy("video"))
        short = (F.col("scene") == n) & (F.col("end_frame") - F.col("start_frame") < length) & (n > 1)
        found = found.withColumn("_short", short).withColumn("_next", F.lead("_short").over(w)).withColumn("_end", F.lead("end_frame").over(w))
        found = found.withColumn("end_frame", F.when(F.col("_next"), F.col("_end")).otherwise(F.col("end_frame"))).where("NOT _short").drop("_short", "_next", "_end")
    if drop_short and length > 0:
        found = found.where(F.col("end_frame") - F.col("start_frame") >= length)
    return found


def sampled_frames(found: DataFrame, n: int, margin: int = 1) -> DataFrame:
    """(video, scene, k, frame): n frames of each scene, the first and last ``margin`` inside its ends, the rest evenly."""
    size = F.col("end_frame") - F.col("start_frame")
    rows = found.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    base, more = F.floor(size / n), size % n
    begin = F.col("start_frame") + F.col("k") * base + F.least(F.col("k"), more)
    count = base + F.when(F.col("k") < more, 1).otherwise(0)
    last = begin + count - 1
    middle = begin + F.floor(count / 2)
    if n == 1:
        frame = middle
    else:
        frame = F.when(F.col("k") == 0, F.least(begin + margin, last)).when(F.col("k") == n - 1, F.greatest(last - margin, begin)).otherwise(middle)
    return rows.where(count > 0).select("video", "scene", "k", frame.cast("long").alias("frame"))


def accuracy(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """Recall, precision and F1 (in percent) of cuts (video, cut) over all videos together; 0 where there is nothing to divide by."""
    both = predicted.distinct().join(actual.distinct(), ["video", "cut"], "left_semi")
    row = both.agg(F.count("*").alias("hits")).crossJoin(predicted.distinct().agg(F.count("*").alias("found"))).crossJoin(actual.distinct().agg(F.count("*").alias("wanted")))
    ratio = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(0.0)
    row = row.select("hits", ratio("hits", "wanted").alias("recall"), ratio("hits", "found").alias("precision"))
    f1 = F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0)
    return row.withColumn("f1", f1)


def in_scenes(observations: DataFrame, found: DataFrame, bin_frames: int = 256) -> DataFrame:
    """Observations with the scenes whose frames, both ends included, hold them.

    An interval join by bins: scenes are listed under every bin they reach, observations under their own.
    """
    low, high = F.floor(F.col("start_frame") / bin_frames), F.floor(F.col("end_frame") / bin_frames)
    s = found.withColumn("_bin", F.explode(F.sequence(low, high)))
    o = observations.withColumn("_bin", F.floor(F.col("frame") / bin_frames))
    return o.join(s, ["video", "_bin"]).where("frame BETWEEN start_frame AND end_frame").drop("_bin")
