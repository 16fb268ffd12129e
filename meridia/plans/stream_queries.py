"""Streams run to the end of their input, so that their results can be compared with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import tidy
from ..operators.tables import fresh_path, written
from ..streaming import detection
from ..streaming.cuts import frame_rates, live_cuts
from . import lifts
from .lifts import r
from .registry import ORACLE_SQL, query
from . import scene_queries  # noqa: F401  its SQL is the batch form of the cuts below


@query(f"SELECT date_trunc('day', ts) AS start, event_type AS video, count(*) AS n, {r('avg(value)', 'mean', 4)} FROM events GROUP BY 1, 2")
def stream_event_windows(spark, sf_dir):
    schema = lifts.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"windows_{uuid.uuid4().hex}"
    run = frame_rates(events).writeStream.format("memory").queryName(name).outputMode("complete")
    run.option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "video", "n", tidy(F.col("mean"), 4).alias("mean"))


@query(ORACLE_SQL["flash_filter_suppress"])
def stream_scene_cuts(spark, sf_dir):
    """The live detector over frames that come in files, its cuts written to a folder."""
    source, out = fresh_path(spark, "frames"), fresh_path(spark, "cuts")
    frames = lifts.frames(spark, sf_dir)
    frames.repartition("video").sortWithinPartitions("video", "frame").write.parquet(source)
    stream = spark.readStream.schema(frames.schema).parquet(source)
    run = live_cuts(stream, 200, 12).writeStream.format("parquet").outputMode("append").option("path", out)
    run.option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("video string, cut long").parquet(out)


#: hours by which records may come late
LATE = 6


def _arrivals(spark, rows, files: int = 6) -> str:
    """A folder of files in which ``rows``, with a timestamp ``ts``, arrive up to ``LATE`` hours late, and behind them a record of no key, far ahead in time."""
    out = fresh_path(spark, "arrivals")
    late = F.expr(f"make_interval(0, 0, 0, 0, pmod(xxhash64(ts), {LATE}), 0, 0)")
    # written once: every file below is a part of it
    rows = written(rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("arrives", F.col("ts") + late), "late")
    ends = rows.agg(F.min("arrives").alias("a"), F.max("arrives").alias("z")).first()
    step = (ends["z"] - ends["a"]) / files
    keep = [c for c in rows.columns if c != "arrives"]
    for k in range(files):
        low, high = ends["a"] + step * k, ends["a"] + step * (k + 1)
        some = rows.where((F.col("arrives") >= F.lit(low)) & ((F.col("arrives") < F.lit(high)) if k < files - 1 else F.lit(True)))
        some.select(*keep).repartition(1).write.parquet(f"{out}/part={k}")
    last = rows.limit(1).select(*((F.lit(ends["z"]) + F.expr("INTERVAL 60 DAYS")).alias(c) if c == "ts" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in keep))
    for k in (files, files + 1):
        last.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {k} DAYS")).repartition(1).write.parquet(f"{out}/part={k}")
    return out


def _stream(spark, rows, path: str):
    return spark.readStream.schema(rows.withColumn("ts", F.col("ts").cast("timestamp")).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


_BATCH = " UNION ALL ".join(f"SELECT '{rule}' AS rule, * FROM ({ORACLE_SQL[name]})" for rule, name in (("merge", "flash_filter_merge"), ("adaptive", "adaptive_cuts"), ("fades", "threshold_cuts")))


@query(f"""WITH found AS ({_BATCH}), videos AS (SELECT event_type AS video, count(*) AS n FROM events GROUP BY 1), ends AS (SELECT rule, video, cut FROM found
 UNION ALL SELECT rule, video, n FROM videos, (VALUES ('merge'), ('adaptive'), ('fades')) v(rule))
SELECT video, rule, row_number() OVER w AS scene, coalesce(lag(cut) OVER w, 0) AS start_frame, cut AS end_frame FROM ends WINDOW w AS (PARTITION BY rule, video ORDER BY cut)""")
def live_scenes(spark, sf_dir):
    """Three detectors at once over frames that arrive out of order; the scenes are those of the batch detectors."""
    order = Window.partitionBy("event_type").orderBy("ts")
    e = lifts.table(spark, sf_dir, "events")
    frames = e.select(F.col("event_type").alias("video"), (F.row_number().over(order) - 1).cast("long").alias("frame"), "ts", "value")
    stream = _stream(spark, frames, _arrivals(spark, frames))
    rules = {"merge": detection.Content(260, 9), "adaptive": detection.Adaptive(2.0), "fades": detection.Fades(60, bias=0.5)}
    scenes = detection.live_scenes(stream, rules, f"{LATE} hours")
    found = detection.run_available(scenes, fresh_path(spark, "scenes"), fresh_path(spark, "stream"))
    return found.where("video IS NOT NULL")


@query("""WITH e AS (SELECT CAST(user_id % 20 AS VARCHAR) AS run, event_type AS stream, len(props) AS bytes, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts) - 1 AS place,
 row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY ts) - 1 AS seen FROM events)
SELECT run, 'bucket' AS kind, stream, CAST(place // 100 AS BIGINT) AS number, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM e GROUP BY 1, 3, 4
UNION ALL SELECT run, 'sample', stream, seen, 1, bytes FROM e WHERE seen % 5 = 0""")
def live_buckets(spark, sf_dir):
    """Buckets by count over the streams of a run, and the records that sampled analysers see, of records that arrive out of order."""
    e = lifts.table(spark, sf_dir, "events")
    run = (F.col("user_id") % 20).cast("string")
    at = F.row_number().over(Window.partitionBy(run).orderBy("ts")) - 1
    records = e.select(run.alias("run"), at.cast("long").alias("at"), "ts", F.col("event_type").alias("stream"), F.length("props").cast("long").alias("bytes"))
    stream = _stream(spark, records, _arrivals(spark, records))
    found = detection.run_available(detection.live_buckets(stream, 100, 5, f"{LATE} hours"), fresh_path(spark, "buckets"), fresh_path(spark, "stream"))
    return found.where("run IS NOT NULL")
