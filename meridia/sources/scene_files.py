"""Scene lists, frame statistics and edit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_xml
from ..functions.timecodes import edit_point, padded, parse_timecode, timecode


def scene_list(scenes: DataFrame, fps: float) -> DataFrame:
    """The ten columns of a scene list; start frames are given 1-based, end frames as they are."""
    rate = F.lit(float(fps))
    start, end = F.col("start_frame"), F.col("end_frame")
    seconds = lambda f: F.format_string("%.3f", f / rate)
    return scenes.select(
        "video", F.col("scene").alias("Scene Number"), (start + 1).alias("Start Frame"), timecode(start, rate).alias("Start Timecode"), seconds(start).alias("Start Time (seconds)"),
        end.alias("End Frame"), timecode(end, rate).alias("End Timecode"), seconds(end).alias("End Time (seconds)"), (end - start).alias("Length (frames)"), timecode(end - start, rate).alias("Length (timecode)"), seconds(end - start).alias("Length (seconds)"),
    )


def write_scene_list(scenes: DataFrame, fps: float, path: str) -> None:
    """CSV folders by video, in scene order within each file."""
    rows = scene_list(scenes, fps)
    rows.repartition("video").sortWithinPartitions("video", "Scene Number").write.partitionBy("video").csv(path, header=True)


def load_scenes(spark: SparkSession, path: str, fps: float, start: int, end: int, column: str = "Start Timecode") -> DataFrame:
    """(cut): scene starts of CSV files as frames, the first left out, clipped to [start, end); with the video where folders by video are read."""
    rows = spark.read.csv(path, header=True)
    at = parse_timecode(F.col(column), F.lit(float(fps)))
    at = at if column == "Start Timecode" else at - 1
    keys = [c for c in rows.columns if c == "video"]
    rows = rows.select(*keys, at.alias("cut")).where("cut IS NOT NULL")
    first = rows.groupBy(*keys).agg(F.min("cut").alias("first"))
    both = rows.join(first, keys) if keys else rows.crossJoin(F.broadcast(first))
    return both.where((F.col("cut") > F.col("first")) & (F.col("cut") >= start) & (F.col("cut") < end)).select(*keys, "cut").distinct()


def stats_table(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Frame statistics as a wide table: 1-based frames, sorted metric columns, "None" where a value is missing. ``metrics(video, frame, metric, value)``."""
    wide = metrics.groupBy("video", "frame").pivot("metric", sorted(names)).agg(F.first("value"))
    return wide.select("video", (F.col("frame") + 1).alias("Frame Number"), *(F.coalesce(F.col(n).cast("string"), F.lit("None")).alias(n) for n in sorted(names)))


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    """(frame, metric, value) of statistics files: 0-based frames; "None" and blanks are absent; with the video where folders by video are read."""
    rows = spark.read.csv(path, header=True)
    if "Frame Number" not in rows.columns:
        raise ValueError("a statistics file begins with Frame Number")
    names = [c for c in rows.columns if c not in ("Frame Number", "Timecode", "video")]
    keys = [c for c in rows.columns if c == "video"]
    long = rows.unpivot([*keys, "Frame Number"], names, "metric", "text")
    return long.where("text IS NOT NULL AND trim(text) NOT IN ('', 'None')").select(*keys, (F.col("Frame Number").cast("long") - 1).alias("frame"), "metric", F.col("text").cast("double").alias("value"))


def edit_list(scenes: DataFrame, fps: float, title: str) -> DataFrame:
    """(video, content): CMX 3600 edit lists."""
    rate = F.lit(float(fps))
    i, o = edit_point(F.col("start_frame"), rate), edit_point(F.col("end_frame"), rate)
    line = F.concat(padded(F.col("scene"), 3), F.lit("  AX       V     C        "), F.concat_ws(" ", i, o, i, o))
    items = F.transform(F.array_sort(F.collect_list(F.struct("scene", line.alias("line")))), lambda s: s["line"])
    head = F.lit(f"* CREATED WITH MERIDIA\nTITLE: {title}\nFCM: NON-DROP FRAME\n\n")
    return scenes.groupBy("video").agg(F.concat(head, F.array_join(items, "\n"), F.lit("\n")).alias("content"))


def keyframe_list(scenes: DataFrame) -> DataFrame:
    """(video, content): encoder keyframe files, an intra frame at each scene's start."""
    line = F.concat(F.col("start_frame").cast("string"), F.lit(" I -1"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("scene", line.alias("line")))), lambda s: s["line"])
    return scenes.groupBy("video").agg(F.concat(F.array_join(items, "\n"), F.lit("\n")).alias("content"))


def _seconds(frames: Column, rate: Column) -> Column:
    return F.concat(F.format_string("%.3f", frames / rate), F.lit("s"))


def xml_list(scenes: DataFrame, fps: float) -> DataFrame:
    """(video, content): FCPXML edit lists, a clip for each scene."""
    rate = F.lit(float(fps))
    start, length = F.col("start_frame"), F.col("end_frame") - F.col("start_frame")
    shot = F.concat(F.lit("Shot "), F.col("scene").cast("string"))
    clip = F.format_string(
        '<clip name="%s" duration="%s" start="%s" offset="%s"><asset-clip ref="asset1" duration="%s" start="%s" offset="0s" name="%s"/></clip>',
        shot, _seconds(length, rate), _seconds(start, rate), _seconds(start, rate), _seconds(length, rate), _seconds(start, rate), shot,
    )
    items = F.transform(F.array_sort(F.collect_list(F.struct("scene", clip.alias("clip")))), lambda s: s["clip"])
    name, whole = escape_xml(F.col("video").cast("string")), _seconds(F.max("end_frame"), rate)
    head = F.format_string(
        '<fcpxml version="1.9"><resources><format id="format1" name="FFVideoFormat1080p24"/><asset id="asset1" name="%s" duration="%s" hasVideo="1" hasAudio="1" format="format1"/></resources>'
        '<library><event name="Shot Detection"><project name="%s"><sequence format="format1" duration="%s"><spine>', F.col("name"), F.col("whole"), F.col("name"), F.col("whole"),
    )
    rows = scenes.groupBy("video").agg(whole.alias("whole"), F.array_join(items, "").alias("clips")).withColumn("name", name)
    return rows.select("video", F.concat(head, "clips", F.lit("</spine></sequence></project></event></library></fcpxml>")).alias("content"))


def timeline_list(scenes: DataFrame, fps: float) -> DataFrame:
    """(video, content): OpenTimelineIO JSON, a video track with a clip for each scene."""
    time = lambda frames: F.struct(F.lit("RationalTime.1").alias("OTIO_SCHEMA"), F.lit(float(fps)).alias("rate"), frames.cast("double").alias("value"))
    span = F.struct(F.lit("TimeRange.1").alias("OTIO_SCHEMA"), time(F.col("end_frame") - F.col("start_frame")).alias("duration"), time(F.col("start_frame")).alias("start_time"))
    clip = F.struct(F.lit("Clip.2").alias("OTIO_SCHEMA"), F.concat(F.lit("Shot "), F.col("scene").cast("string")).alias("name"), span.alias("source_range"))
    clips = F.transform(F.array_sort(F.collect_list(F.struct("scene", clip.alias("clip")))), lambda s: s["clip"])
    track = F.struct(F.lit("Track.1").alias("OTIO_SCHEMA"), F.lit("Video").alias("kind"), F.lit("Video 1").alias("name"), F.col("clips").alias("children"))
    stack = F.struct(F.lit("Stack.1").alias("OTIO_SCHEMA"), F.lit("tracks").alias("name"), F.array(track).alias("children"))
    document = F.struct(F.lit("Timeline.1").alias("OTIO_SCHEMA"), F.col("video").cast("string").alias("name"), time(F.lit(0)).alias("global_start_time"), stack.alias("tracks"))
    return scenes.groupBy("video").agg(clips.alias("clips")).select("video", F.to_json(document).alias("content"))


def html_table(scenes: DataFrame, fps: float) -> DataFrame:
    """(video, content): an HTML table of each video's scenes."""
    rows = scene_list(scenes, fps)
    names = [c for c in rows.columns if c != "video"]
    cells = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), F.col(n).cast("string"), F.lit("</td>")) for n in names), F.lit("</tr>"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("Scene Number", cells.alias("row")))), lambda s: s["row"])
    head = "<table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"
    return rows.groupBy("video").agg(F.concat(F.lit(head), F.array_join(items, ""), F.lit("</table>")).alias("content"))


def split_commands(scenes: DataFrame, fps: float) -> DataFrame:
    """(video, scene, command): what an external splitter would be told; nothing is run."""
    rate = F.lit(float(fps))
    length = F.col("end_frame") - F.col("start_frame")
    out = F.concat_ws("-", "video", F.lit("Scene"), padded(F.col("scene"), 3))
    return scenes.select("video", "scene", F.concat_ws(" ", F.lit("ffmpeg -ss"), timecode(F.col("start_frame"), rate), F.lit("-i"), "video", F.lit("-t"), timecode(length, rate), F.concat(out, F.lit(".mp4"))).alias("command"))
