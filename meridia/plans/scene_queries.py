"""Queries on frame metrics, cuts, scenes, keyframes and timecodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timecodes
from ..functions.vectors import tidy
from ..operators import scenes, timeline
from . import lifts
from .lifts import FRAMES, KEYS, SAMPLES, r
from .registry import query

_F = f"f AS ({FRAMES})"
_SCORE = f"{_F}, s AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY video ORDER BY frame)), 0.0) AS score FROM f)"
_RATIO = f"""{_SCORE}, w AS (SELECT *, count(*) OVER k AS n, (sum(score) OVER k - score) / 4.0 AS mean FROM s WINDOW k AS (PARTITION BY video ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
 q AS (SELECT *, CASE WHEN n = 5 THEN CASE WHEN abs(mean) >= 0.00001 THEN least(score / mean, 255.0) WHEN score >= 15 THEN 255.0 ELSE 0.0 END END AS ratio FROM w)"""


def _fold(items: str, guard: str, last: str = "frame", first: str = "0") -> str:
    """A greedy fold over ordered events as a recursive query: the next event at least so far after the last kept one."""
    return f"""keep AS (SELECT video, (SELECT min(frame) FROM {items} i WHERE i.video = v.video AND {guard.format(last=first)}) AS cut FROM (SELECT DISTINCT video FROM f) v
 UNION ALL SELECT k.video, (SELECT min(frame) FROM {items} i WHERE i.video = k.video AND i.frame > k.cut AND {guard.format(last='k.cut')}) FROM keep k WHERE k.cut IS NOT NULL)"""


def _scored(spark, sf_dir):
    return scenes.content_score(lifts.frames(spark, sf_dir), {"value": 1.0})


@query(f"WITH {_SCORE} SELECT video, frame, {r('score', 'score')} FROM s")
def content_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("video", "frame", tidy(F.col("score")).alias("score"))


@query(f"WITH {_RATIO} SELECT video, frame, {r('ratio', 'ratio', 4)} FROM q")
def adaptive_ratio(spark, sf_dir):
    return scenes.adaptive_ratio(_scored(spark, sf_dir)).select("video", "frame", tidy(F.col("ratio"), 4).alias("ratio"))


@query(f"WITH RECURSIVE {_SCORE}, hot AS (SELECT * FROM s WHERE score >= 200), {_fold('hot', 'i.frame - {last} >= 12')} SELECT video, cut FROM keep WHERE cut IS NOT NULL")
def flash_filter_suppress(spark, sf_dir):
    return scenes.suppressed_cuts(_scored(spark, sf_dir), F.col("score") >= 200, 12)


_MERGE = f"""WITH RECURSIVE {_SCORE}, n AS (SELECT video, frame, score >= 260 AS above FROM s),
 fold AS (SELECT video, CAST(-1 AS BIGINT) AS frame, CAST(0 AS BIGINT) AS last, false AS enabled, false AS merging, CAST(0 AS BIGINT) AS since, CAST(NULL AS BIGINT) AS cut FROM (SELECT DISTINCT video FROM f)
 UNION ALL SELECT g.video, g.frame, g.l, g.enabled OR g.plain, (g.merging AND NOT g.ends) OR g.begins, CASE WHEN g.begins THEN g.frame ELSE g.since END, CASE WHEN g.ends THEN g.l WHEN g.plain THEN g.frame END
  FROM (SELECT h.*, h.merging AND h.far AND NOT h.above AND h.l - h.since >= 9 AS ends, NOT h.merging AND h.above AND h.far AS plain, NOT h.merging AND h.above AND NOT h.far AND h.enabled AS begins
   FROM (SELECT n.video, n.frame, n.above, fold.enabled, fold.merging, fold.since, n.frame - fold.last >= 9 AS far, CASE WHEN n.above THEN n.frame ELSE fold.last END AS l FROM fold JOIN n ON n.video = fold.video AND n.frame = fold.frame + 1) h) g)
 SELECT video, cut FROM fold WHERE cut IS NOT NULL"""


@query(_MERGE)
def flash_filter_merge(spark, sf_dir):
    return scenes.merged_cuts(_scored(spark, sf_dir), F.col("score") >= 260, 9)


@query(f"""WITH RECURSIVE {_RATIO}, hot AS (SELECT video, frame FROM q WHERE ratio >= 2.0 AND score >= 15), {_fold('hot', 'i.frame + 2 - {last} >= 15')} SELECT video, cut FROM keep WHERE cut IS NOT NULL""")
def adaptive_cuts(spark, sf_dir):
    return scenes.adaptive_cuts(_scored(spark, sf_dir), threshold=2.0)


_FADE = f"""{_F}, st AS (SELECT *, CASE WHEN value < 60 THEN 'out' ELSE 'in' END AS state FROM f), e AS (SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY video ORDER BY frame) AS before FROM st) WHERE before <> state)"""


@query(f"WITH {_FADE} SELECT video, frame, state AS kind FROM e")
def threshold_fades(spark, sf_dir):
    return scenes.fades(lifts.frames(spark, sf_dir), 60)


@query(f"""WITH RECURSIVE {_FADE}, o AS (SELECT video, frame, state AS kind, 1 AS seq FROM e UNION ALL SELECT video, 0, 'out', 0 FROM st WHERE frame = 0 AND state = 'out'),
 hot AS (SELECT video, frame, out_ FROM (SELECT *, lag(frame) OVER (PARTITION BY video ORDER BY seq, frame) AS out_ FROM o) WHERE kind = 'in' AND out_ IS NOT NULL),
 {_fold('hot', 'i.frame - {last} >= 15')} SELECT k.video, CAST(floor((h.frame + h.out_ + CAST(trunc(0.5 * (h.frame - h.out_)) AS BIGINT)) / 2) AS BIGINT) AS cut FROM keep k JOIN hot h ON h.video = k.video AND h.frame = k.cut""")
def threshold_cuts(spark, sf_dir):
    return scenes.fade_cuts(lifts.frames(spark, sf_dir), 60, bias=0.5)


_CUTS = f"{_SCORE}, cuts AS (SELECT video, frame AS cut FROM s WHERE score >= 330), span AS (SELECT video, min(frame) AS first, max(frame) + 1 AS end_ FROM f GROUP BY 1)"
_SCENES = f"""{_CUTS}, starts AS (SELECT video, first AS start_frame FROM span UNION SELECT video, cut FROM cuts),
 sc AS (SELECT a.video, row_number() OVER w AS scene, start_frame, coalesce(lead(start_frame) OVER w, end_) AS end_frame FROM starts a JOIN span b ON a.video = b.video WINDOW w AS (PARTITION BY a.video ORDER BY start_frame))"""


def _cuts(spark, sf_dir):
    return _scored(spark, sf_dir).where("score >= 330").select("video", F.col("frame").alias("cut"))


def _scenes(spark, sf_dir):
    spans = lifts.frames(spark, sf_dir).groupBy("video").agg(F.min("frame").alias("first"), (F.max("frame") + 1).alias("end"))
    return scenes.scenes(_cuts(spark, sf_dir), spans)


@query(f"WITH {_SCENES} SELECT video, CAST(scene AS INTEGER) AS scene, start_frame, end_frame FROM sc")
def scenes_from_cuts(spark, sf_dir):
    return _scenes(spark, sf_dir)


@query(f"""WITH {_SCENES}, k AS (SELECT *, scene = count(*) OVER (PARTITION BY video) AND end_frame - start_frame < 12 AND count(*) OVER (PARTITION BY video) > 1 AS short FROM sc),
 m AS (SELECT *, lead(short) OVER w AS nxt, lead(end_frame) OVER w AS nend FROM k WINDOW w AS (PARTITION BY video ORDER BY scene))
 SELECT video, CAST(scene AS INTEGER) AS scene, start_frame, CASE WHEN nxt THEN nend ELSE end_frame END AS end_frame FROM m WHERE NOT short AND CASE WHEN nxt THEN nend ELSE end_frame END - start_frame >= 12""")
def scenes_postprocessed(spark, sf_dir):
    return scenes.tidied(_scenes(spark, sf_dir), 12, merge_last=True, drop_short=True)


@query(f"WITH {_SCENES} SELECT video, {r('avg((end_frame - start_frame) / 25.0)', 'average_shot')} FROM sc GROUP BY 1")
def average_shot_length(spark, sf_dir):
    return _scenes(spark, sf_dir).groupBy("video").agg(tidy(F.avg((F.col("end_frame") - F.col("start_frame")) / 25.0)).alias("average_shot"))


@query(f"""WITH {_SCENES}, k AS (SELECT *, i AS k, end_frame - start_frame AS size FROM sc, range(3) q(i)), b AS (SELECT *, start_frame + k * (size // 3) + least(k, size % 3) AS begin_, size // 3 + CASE WHEN k < size % 3 THEN 1 ELSE 0 END AS n FROM k)
 SELECT video, CAST(scene AS INTEGER) AS scene, CAST(k AS INTEGER) AS k, CASE k WHEN 0 THEN least(begin_ + 1, begin_ + n - 1) WHEN 2 THEN greatest(begin_ + n - 2, begin_) ELSE begin_ + n // 2 END AS frame FROM b WHERE n > 0""")
def scene_sample_frames(spark, sf_dir):
    return scenes.sampled_frames(_scenes(spark, sf_dir), 3)


@query(f"""WITH {_SCORE}, p AS (SELECT video, frame AS cut FROM s WHERE score >= 330), a AS (SELECT video, frame AS cut FROM s WHERE score >= 300 AND frame % 3 <> 0), h AS (SELECT count(*) AS hits FROM (SELECT * FROM p INTERSECT SELECT * FROM a)),
 m AS (SELECT hits, CASE WHEN (SELECT count(*) FROM a) > 0 THEN 100.0 * hits / (SELECT count(*) FROM a) ELSE 0 END AS recall, CASE WHEN (SELECT count(*) FROM p) > 0 THEN 100.0 * hits / (SELECT count(*) FROM p) ELSE 0 END AS precision FROM h)
 SELECT hits, {r('recall', 'recall')}, {r('precision', 'precision')}, {r('CASE WHEN hits > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END', 'f1')} FROM m""")
def detector_accuracy(spark, sf_dir):
    actual = _scored(spark, sf_dir).where("score >= 300 AND frame % 3 <> 0").select("video", F.col("frame").alias("cut"))
    out = scenes.accuracy(_cuts(spark, sf_dir), actual)
    return out.select("hits", *(tidy(F.col(c)).alias(c) for c in ("recall", "precision", "f1")))


@query(f"WITH {_SCENES} SELECT f.video, f.frame, CAST(sc.scene AS INTEGER) AS scene FROM f JOIN sc ON sc.video = f.video AND f.frame BETWEEN sc.start_frame AND sc.end_frame WHERE f.value > 100")
def scene_assignment(spark, sf_dir):
    seen = lifts.frames(spark, sf_dir).where("value > 100")
    return scenes.in_scenes(seen, _scenes(spark, sf_dir)).select("video", "frame", "scene")


@query(f"WITH {_SCENES} SELECT sc.video, CAST(sc.scene AS INTEGER) AS scene, count(f.frame) AS n FROM sc LEFT JOIN (SELECT * FROM f WHERE value > 150) f ON f.video = sc.video AND f.frame >= sc.start_frame AND f.frame < sc.end_frame GROUP BY 1, 2")
def scene_grouping(spark, sf_dir):
    found = _scenes(spark, sf_dir)
    hits = scenes.in_scenes(lifts.frames(spark, sf_dir).where("value > 150"), found).where("frame < end_frame").groupBy("video", "scene").agg(F.count("*").alias("n"))
    return found.join(hits, ["video", "scene"], "left").select("video", "scene", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH k AS ({KEYS}), s AS ({SAMPLES}), p AS (SELECT s.*, (SELECT max(t) FROM k WHERE k.track = s.track AND k.t <= s.t) AS p0, (SELECT min(t) FROM k WHERE k.track = s.track AND k.t >= s.t) AS p1 FROM s),
 j AS (SELECT p.track, p.t, coalesce(p0, p1) AS t0, coalesce(p1, p0) AS t1 FROM p WHERE p0 IS NOT NULL OR p1 IS NOT NULL), v AS (SELECT j.*, a.value AS v0, b.value AS v1 FROM j JOIN k a ON a.track = j.track AND a.t = j.t0 JOIN k b ON b.track = j.track AND b.t = j.t1)
 SELECT track, t, t0, t1, {r('v0', 'v0')}, {r('v1', 'v1')}, {r('v0 + (v1 - v0) * CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END', 'value')} FROM v""")
def keyframe_sample(spark, sf_dir):
    out = timeline.sampled(lifts.keys(spark, sf_dir), lifts.samples(spark, sf_dir))
    return out.select("track", "t", "t0", "t1", *(tidy(F.col(c)).alias(c) for c in ("v0", "v1", "value")))


@query("SELECT event_type AS stream, CAST((event_id - (SELECT min(event_id) FROM events)) // 100 AS BIGINT) AS bucket, count(*) AS n, CAST(sum(len(props)) AS BIGINT) AS bytes FROM events GROUP BY 1, 2")
def tumbling_buckets(spark, sf_dir):
    e = lifts.table(spark, sf_dir, "events")
    first = e.agg(F.min("event_id").alias("first"))
    rows = e.crossJoin(F.broadcast(first)).select(F.col("event_type").alias("stream"), (F.col("event_id") - F.col("first")).alias("idx"), F.length("props").alias("bytes"))
    return timeline.tumbling(rows, 100)


_TC = """WITH t AS (SELECT event_id AS frame, CAST(round_even(event_id / 29.97 * 1000, 0) AS BIGINT) AS ms FROM events)
 SELECT frame, lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS timecode, frame AS parsed, greatest(frame - 100, 0) AS earlier FROM t"""


@query(_TC)
def frame_timecodes(spark, sf_dir):
    e = lifts.table(spark, sf_dir, "events").select(F.col("event_id").alias("frame"))
    text = timecodes.timecode(F.col("frame"), F.lit(29.97))
    return e.select("frame", text.alias("timecode"), timecodes.parse_timecode(text, F.lit(29.97)).alias("parsed"), timecodes.plus(F.col("frame"), F.lit(-100)).alias("earlier"))


@query("""SELECT 'scene_' || user_id AS scene, max(n) AS peak FROM (SELECT user_id, event_id // 50 AS frame, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def peak_visible(spark, sf_dir):
    e = lifts.table(spark, sf_dir, "events").select(F.concat(F.lit("scene_"), "user_id").alias("scene"), F.floor(F.col("event_id") / 50).alias("frame"))
    return timeline.peak_visible(e)


@query()
def distinct_tracks(spark, sf_dir):
    at = lambda n: (F.col("event_id") * 7 % n).cast("int")
    boxes = lifts.table(spark, sf_dir, "events").select(F.concat(F.lit("scene_"), "user_id").alias("scene"), F.floor(F.col("event_id") / 50).alias("frame"), F.col("event_id").alias("idx"), at(40).alias("x"), at(30).alias("y"), F.lit(20).alias("width"), F.lit(16).alias("height"))
    return timeline.distinct_tracks(boxes)


@query(f"SELECT video, frame, value FROM ({FRAMES}) WHERE frame % 7 = 0")
def sampled_every(spark, sf_dir):
    return scenes.every_frame(lifts.frames(spark, sf_dir), 7).select("video", "frame", "value")
