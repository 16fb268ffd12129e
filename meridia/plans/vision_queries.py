"""Queries on features, tracks, splats, rays and pixels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.cameras import Intrinsics, Pose
from ..functions.vectors import Quat, Vec, col, tidy
from ..operators import scenes, splats, tracks
from . import lifts
from .lifts import POINTS, r
from .registry import query


#: features an image: the number of images grows with the table, the pairs to compare between two images don't
_PER_IMAGE = 40


def _features(spark, sf_dir):
    """(image_id, feature, words): sign bits of 62 components as one word; all rows, ``_PER_IMAGE`` of them an image."""
    v = lifts.table(spark, sf_dir, "embeddings")
    word = None
    for k in range(62):
        bit = F.when(F.col("embedding")[k] > 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        word = bit if word is None else word.bitwiseOR(bit)
    image = F.floor(F.col("vec_id") / _PER_IMAGE)
    return v.select(image.alias("image_id"), (F.col("vec_id") % _PER_IMAGE).alias("feature"), F.array(word).alias("words"))


_WORD = " | ".join(f"CASE WHEN embedding[{k + 1}] > 0 THEN CAST({1 << k} AS BIGINT) ELSE 0 END" for k in range(62))
_MATCH = f"""feats AS (SELECT vec_id // {_PER_IMAGE} AS image_id, vec_id % {_PER_IMAGE} AS feature, {_WORD} AS w FROM embeddings),
 d AS (SELECT a.image_id AS left_image, b.image_id AS right_image, a.feature AS left_feature, b.feature AS right_feature, bit_count(xor(a.w, b.w)) AS distance FROM feats a JOIN feats b ON b.image_id = a.image_id + 1),
 best AS (SELECT *, min(distance) OVER l AS d1, row_number() OVER (PARTITION BY left_image, right_image, left_feature ORDER BY distance, right_feature) AS k,
  row_number() OVER (PARTITION BY left_image, right_image, right_feature ORDER BY distance, left_feature) AS back FROM d WINDOW l AS (PARTITION BY left_image, right_image, left_feature)),
 sec AS (SELECT left_image, right_image, left_feature, min(distance) AS d2 FROM best WHERE distance > d1 GROUP BY 1, 2, 3),
 matches AS (SELECT b.left_image, b.right_image, b.left_feature, b.right_feature, CAST(b.distance AS INTEGER) AS distance FROM best b LEFT JOIN sec s USING (left_image, right_image, left_feature) WHERE k = 1 AND back = 1 AND distance <= 30 AND (d2 IS NULL OR distance <= 0.95 * d2))"""


def _matches(spark, sf_dir):
    f = _features(spark, sf_dir)
    pairs = tracks.adjacent_pairs(f.select("image_id").distinct())
    return tracks.match_features(f, pairs, max_distance=30, ratio=0.95)


@query(f"WITH {_MATCH} SELECT * FROM matches")
def match_binary_features(spark, sf_dir):
    return _matches(spark, sf_dir)


_TRACKS = f"""WITH RECURSIVE {_MATCH}, e AS (SELECT left_image * 1000 + left_feature AS a, right_image * 1000 + right_feature AS b FROM matches), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach AS (SELECT a AS n, a AS seen FROM u UNION SELECT r.n, u.b FROM reach r JOIN u ON u.a = r.seen), lab AS (SELECT n, min(seen) AS l FROM reach GROUP BY 1),
 tr AS (SELECT l, n // 1000 AS image_id, n % 1000 AS feature FROM lab WHERE l IN (SELECT l FROM lab GROUP BY l HAVING count(*) > 1 AND count(*) = count(DISTINCT n // 1000)))"""


@query(f"{_TRACKS} SELECT (l // 1000) || ':' || (l % 1000) AS track, image_id, feature FROM tr")
def build_tracks(spark, sf_dir):
    return tracks.build_tracks(_matches(spark, sf_dir))


@query(f"{_TRACKS} SELECT length, count(*) AS n FROM (SELECT l, count(*) AS length FROM tr GROUP BY 1) GROUP BY 1")
def track_length_histogram(spark, sf_dir):
    return tracks.track_length_histogram(tracks.build_tracks(_matches(spark, sf_dir)))


@query("""WITH a AS (SELECT l_quantity::BIGINT AS length, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 30 GROUP BY 1), b AS (SELECT l_quantity::BIGINT AS length, count(*) AS m FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10 GROUP BY 1)
 SELECT coalesce(a.length, b.length) AS length, coalesce(m, 0) - coalesce(n, 0) AS difference FROM a FULL JOIN b ON a.length = b.length""")
def compare_reports(spark, sf_dir):
    rows = lifts.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("length"), "l_returnflag")
    one = rows.where("l_returnflag = 'A' AND length < 30").groupBy("length").agg(F.count("*").alias("n"))
    two = rows.where("l_returnflag = 'R' AND length > 10").groupBy("length").agg(F.count("*").alias("n"))
    return tracks.compared_histograms(one, two)


@query(f"SELECT CAST(idx AS VARCHAR) AS track, CAST(3 AS BIGINT) AS n, {r('x', 'x', 4)}, {r('y', 'y', 4)}, {r('z', 'z', 4)}, {r('0.0', 'error', 4)} FROM ({POINTS})")
def triangulate_tracks(spark, sf_dir):
    """Points seen by three cameras come back from their pixels."""
    lens = Intrinsics.of(64, 64, 60, 60, 32, 32)
    rows = lifts.points(spark, sf_dir).withColumn("image_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    at = Vec.of(F.col("image_id") * 1.0, F.lit(0.3) * F.col("image_id"), F.lit(-3.0))
    axes = Vec.of(1, 0, 0), Vec.of(0, 1, 0), Vec.of(0, 0, 1)
    u, v, _ = Pose(at, *axes).project(lens, Vec.columns())
    seen = rows.select(
        F.col("idx").cast("string").alias("track"), "image_id", u.alias("u"), v.alias("v"),
        *(col(c).alias(f"{p}{k}") for p, vec in zip("pruf", (at, *axes)) for k, c in zip("xyz", vec)),
        *(F.lit(float(n)).alias(c) for c, n in (("focal_x", 60), ("focal_y", 60), ("cx", 32), ("cy", 32))),
    )
    out = tracks.triangulate(seen, max_error=1.0)
    return out.select("track", "n", *(tidy(F.col(c), 4).alias(c) for c in ("x", "y", "z", "error")))


def _splats(spark, sf_dir):
    v = lifts.table(spark, sf_dir, "embeddings")
    e = lambda k: F.col("embedding")[k].cast("double")
    return v.select(F.col("vec_id").alias("idx"), *(e(k).alias(a) for k, a in enumerate("xyz")), *((e(k + 3) - 3).alias(f"s{a}") for k, a in enumerate("xyz")), (e(6) * 8).alias("logit"), *(splats.preview_colour(e(7 + k) * 3).alias(c) for k, c in enumerate("rgb")))


_SP = "sp AS (SELECT vec_id AS idx, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {a}" for k, a in enumerate("xyz")) + ", " + ", ".join(f"CAST(embedding[{k + 4}] AS DOUBLE) - 3 AS s{a}" for k, a in enumerate("xyz")) + ", CAST(embedding[7] AS DOUBLE) * 8 AS logit, " + ", ".join(f"least(greatest(CAST(embedding[{8 + k}] AS DOUBLE) * 3 * 0.2820948 + 0.5, 0), 1) AS {c}" for k, c in enumerate("rgb")) + " FROM embeddings)"


@query(f"""WITH {_SP} SELECT count(*) AS n, {', '.join(r(f'min({a})', f'lo_{a}') for a in 'xyz')}, {', '.join(r(f'max({a})', f'hi_{a}') for a in 'xyz')}, {r('avg(1 / (1 + exp(-logit)))', 'mean_opacity')},
 {r('min(least(exp(sx), exp(sy), exp(sz)))', 'min_scale')}, {r('max(greatest(exp(sx), exp(sy), exp(sz)))', 'max_scale')} FROM sp""")
def splat_stats(spark, sf_dir):
    out = splats.stats(_splats(spark, sf_dir))
    return out.select("n", *(tidy(F.col(c)).alias(c) for c in out.columns[1:]))


@query(f"WITH {_SP} SELECT idx, {r('x * 2 + 1', 'x')}, {r('sx + ln(2.0)', 'sx')}, {r('1 / (1 + exp(-logit))', 'opacity')}, {r('r', 'r')} FROM sp WHERE 1 / (1 + exp(-logit)) >= 0.4")
def splat_transform_and_filter(spark, sf_dir):
    out = splats.transformed(splats.retain_opacity(_splats(spark, sf_dir), 0.4), 2.0, (1.0, 0.0, 0.0))
    return out.select("idx", tidy(F.col("x")).alias("x"), tidy(F.col("sx")).alias("sx"), tidy(splats.opacity(F.col("logit"))).alias("opacity"), tidy(F.col("r")).alias("r"))


_PROJECTED = f"{_SP}, pr AS (SELECT idx, 20 * x / (z + 1.2) + 12 AS u, 20 * y / (z + 1.2) + 12 AS v, z + 1.2 AS depth, least(greatest(exp(greatest(sx, sy, sz)) * 20 / (z + 1.2) * 3.0, 1.0), 4096.0) AS radius, 1 / (1 + exp(-logit)) AS opacity, r, g, b FROM sp WHERE z + 1.2 > 0.0001)"


def _projected(spark, sf_dir):
    pose = Pose(Vec.of(0, 0, -1.2), Vec.of(1, 0, 0), Vec.of(0, 1, 0), Vec.of(0, 0, 1))
    return splats.project(_splats(spark, sf_dir), Intrinsics.of(24, 24, 20, 20, 12, 12), pose)


@query(f"WITH {_PROJECTED} SELECT idx, {r('u', 'u')}, {r('v', 'v')}, {r('depth', 'depth')}, {r('radius', 'radius')} FROM pr")
def project_gaussian(spark, sf_dir):
    return _projected(spark, sf_dir).select("idx", *(tidy(F.col(c)).alias(c) for c in ("u", "v", "depth", "radius")))


@query(f"""WITH RECURSIVE {_PROJECTED}, px AS (SELECT i % 24 AS px, i // 24 AS py FROM range(576) t(i)),
 h AS (SELECT px, py, row_number() OVER (PARTITION BY px, py ORDER BY depth DESC, idx) AS k, least(greatest(opacity * exp(-0.5 * ((px - u) * (px - u) + (py - v) * (py - v)) / (radius * radius)), 0), 1) AS a, r, g, b
  FROM px JOIN pr ON sqrt((px - u) * (px - u) + (py - v) * (py - v)) <= radius),
 c AS (SELECT px, py, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS r, CAST(0 AS DOUBLE) AS g, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS alpha FROM px
  UNION ALL SELECT c.px, c.py, h.k, h.r * h.a + c.r * (1 - h.a), h.g * h.a + c.g * (1 - h.a), h.b * h.a + c.b * (1 - h.a), h.a + c.alpha * (1 - h.a) FROM c JOIN h ON h.px = c.px AND h.py = c.py AND h.k = c.k + 1),
 z AS (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY k DESC) AS top FROM c) SELECT px, py, {r('least(greatest(r, 0), 1)', 'r')}, {r('least(greatest(b, 0), 1)', 'b')}, {r('alpha', 'alpha')} FROM z WHERE top = 1""")
def render_projected_splats(spark, sf_dir):
    return splats.render(_projected(spark, sf_dir), 24, 24).select("px", "py", *(tidy(F.col(c)).alias(c) for c in ("r", "b", "alpha")))


@query(f"WITH {_SP} SELECT idx, {r('exp(2 * sx)', 'xx')}, {r('exp(2 * sy)', 'zz')}, {r('exp(2 * sz)', 'yy')}, {r('0.0', 'xy')} FROM sp")
def gaussian_covariance(spark, sf_dir):
    """A quarter turn about x exchanges the y and z variances."""
    import math

    q = Quat.about(Vec.of(1, 0, 0), math.pi / 2)
    xx, xy, _, yy, _, zz = splats.covariance(Vec(*(F.exp(f"s{k}") for k in "xyz")), q)
    return _splats(spark, sf_dir).select("idx", *(tidy(c).alias(n) for n, c in (("xx", xx), ("zz", zz), ("yy", yy), ("xy", xy))))


@query(f"SELECT idx, {r('1 - exp(-(2.0 + x))', 'opacity')}, CAST(20 AS INTEGER) AS samples, {r('least((1 - exp(-(2.0 + x))) * 0.8 + exp(-(2.0 + x)) * 0.1, 1)', 'r')} FROM ({POINTS})")
def render_ray(spark, sf_dir):
    """A constant field along a unit of every ray has a closed form."""
    ray = splats.march(F.lit(0.0), F.lit(1.0), 0.05, lambda t: 2.0 + F.col("x"), lambda t: (0.8, 0.5, 0.2), stop=0.999, background=(0.1, 0.1, 0.1))
    rows = lifts.points(spark, sf_dir).select("idx", ray.alias("m"))
    return rows.select("idx", tidy(F.col("m.opacity")).alias("opacity"), F.col("m.samples").alias("samples"), tidy(F.col("m.r")).alias("r"))


def pixel_frames(spark, sf_dir, side: int = 8):
    """(video, frame, y, x, r, g, b): each embedding is a picture of 8 by 8 fields, a field for each component, each label a video."""
    v = lifts.table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    v = v.select(F.col("label").cast("long").alias("video"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("frame"), "embedding")
    rows = v.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))))
    y, x = F.floor(F.col("p") / side).cast("int"), (F.col("p") % side).cast("int")
    field = F.floor(y * 8 / side) * 8 + F.floor(x * 8 / side)
    level = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 300 * F.element_at("embedding", ((field + k) % 64 + 1).cast("int")).cast("double")))).cast("int")
    return rows.select("video", "frame", y.alias("y"), x.alias("x"), level(0).alias("r"), level(21).alias("g"), level(42).alias("b"))


_LEVEL = "greatest(0, least(255, CAST(floor(128 + 300 * CAST(embedding[(p + {k}) % 64 + 1] AS DOUBLE)) AS INTEGER)))"
_PX = f"""px AS (SELECT CAST(label AS BIGINT) AS video, frame, p // 8 AS y, p % 8 AS x, {_LEVEL.format(k=0)} AS r, {_LEVEL.format(k=21)} AS g, {_LEVEL.format(k=42)} AS b
 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings WHERE label IS NOT NULL), range(64) t(p))"""


@query(f"""WITH {_PX}, h AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS span FROM px),
 t AS (SELECT *, CASE WHEN span = 0 THEN 0.0 WHEN hi = r THEN 60.0 * (g - b) / span WHEN hi = g THEN 120.0 + 60.0 * (b - r) / span ELSE 240.0 + 60.0 * (r - g) / span END AS turn FROM h),
 c AS (SELECT video, frame, y, x, CAST(round(CASE WHEN turn < 0 THEN turn + 360 ELSE turn END / 2) AS INTEGER) % 180 AS hue, CASE WHEN hi = 0 THEN 0 ELSE CAST(round(255.0 * span / hi) AS INTEGER) END AS sat, hi AS lum FROM t)
 SELECT a.video, a.frame, {r('avg(coalesce(abs(a.hue - b.hue), 0))', 'hue')}, {r('avg(coalesce(abs(a.sat - b.sat), 0))', 'sat')}, {r('avg(coalesce(abs(a.lum - b.lum), 0))', 'lum')} FROM c a LEFT JOIN c b ON b.video = a.video AND b.frame = a.frame - 1 AND b.y = a.y AND b.x = a.x GROUP BY 1, 2""")
def pixel_frame_deltas(spark, sf_dir):
    """Mean absolute change of hue, saturation and value against the frame before, pixel by pixel."""
    px = pixel_frames(spark, sf_dir)
    hue, sat, lum = pixels.hsv(F.col("r"), F.col("g"), F.col("b"))
    rows = px.select("video", "frame", "y", "x", hue.alias("hue"), sat.alias("sat"), lum.alias("lum"))
    before = rows.select("video", (F.col("frame") + 1).alias("frame"), "y", "x", *(F.col(c).alias(f"b_{c}") for c in ("hue", "sat", "lum")))
    both = rows.join(before, ["video", "frame", "y", "x"], "left")
    return both.groupBy("video", "frame").agg(*(tidy(F.avg(F.coalesce(F.abs(F.col(c) - F.col(f"b_{c}")), F.lit(0)))).alias(c) for c in ("hue", "sat", "lum")))


@query(f"""WITH {_PX}, y AS (SELECT video, frame, CAST(round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS INTEGER) AS l FROM px), hist AS (SELECT video, frame, l // 16 AS bin, count(*) AS n FROM y GROUP BY 1, 2, 3),
 grid AS (SELECT DISTINCT y.video, y.frame, k AS bin FROM y, range(16) t(k)), d AS (SELECT g.*, coalesce(n, 0) AS n FROM grid g LEFT JOIN hist USING (video, frame, bin))
 SELECT a.video, a.frame, {r('corr(a.n, b.n)', 'correlation')} FROM d a JOIN d b ON b.video = a.video AND b.frame = a.frame - 1 AND b.bin = a.bin GROUP BY 1, 2""")
def histogram_correlation(spark, sf_dir):
    """Pearson correlation of the brightness histograms of neighbouring frames."""
    px = pixel_frames(spark, sf_dir)
    level = F.floor(pixels.luma(F.col("r"), F.col("g"), F.col("b")) / 16)
    counts = px.groupBy("video", "frame").agg(*(F.count_if(level == k).alias(f"h{k}") for k in range(16)))
    dense = counts.select("video", "frame", F.posexplode(F.array(*(f"h{k}" for k in range(16)))).alias("bin", "n"))
    before = dense.select("video", (F.col("frame") + 1).alias("frame"), "bin", F.col("n").alias("m"))
    both = dense.join(before, ["video", "frame", "bin"]).groupBy("video", "frame")
    return both.agg(tidy(F.corr(F.col("n").cast("double"), F.col("m").cast("double"))).alias("correlation"))


@query(f"WITH {_PX} SELECT video, frame, {r('avg((r + g + b) / 3.0)', 'value')} FROM px GROUP BY 1, 2")
def frame_mean(spark, sf_dir):
    px = pixel_frames(spark, sf_dir)
    return px.groupBy("video", "frame").agg(tidy(F.avg((F.col("r") + F.col("g") + F.col("b")) / 3.0)).alias("value"))


@query(f"WITH {_PX} SELECT video, frame, {r('avg(r)', 'r')}, {r('avg(g)', 'g')}, {r('avg(b)', 'b')} FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 7 GROUP BY 1, 2")
def mean_rgb(spark, sf_dir):
    inside = pixel_frames(spark, sf_dir).where(F.col("x").between(2, 5) & F.col("y").between(1, 7))
    return inside.groupBy("video", "frame").agg(*(tidy(F.avg(c)).alias(c) for c in "rgb"))


def _hashes(size: int, side: int) -> str:
    """Hash bits of the pictures: a cosine transform of ``side`` by ``side`` cells as sums, its low part against its median."""
    wave = lambda k, i: f"CASE WHEN {k} = 0 THEN sqrt(1.0 / {side}) ELSE sqrt(2.0 / {side}) * cos(pi() * (2 * {i} + 1) * {k} / {2 * side}) END"
    return f"""grey AS (SELECT video, frame, y, x, CAST(round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS INTEGER) AS l FROM px),
 cells AS (SELECT video, frame, cy, cx, l / CAST(greatest(max(l) OVER (PARTITION BY video, frame), 1) AS DOUBLE) AS v FROM grey JOIN (SELECT i AS cy, i * 8 // {side} AS y FROM range({side}) t(i)) USING (y) JOIN (SELECT i AS cx, i * 8 // {side} AS x FROM range({side}) t(i)) USING (x)),
 across AS (SELECT video, frame, cy, l, sum(v * {wave("l", "cx")}) AS v FROM cells, range({size}) q(l) GROUP BY 1, 2, 3, 4),
 low AS (SELECT video, frame, k, l, sum(v * {wave("k", "cy")}) AS v FROM across, range({size}) p(k) GROUP BY 1, 2, 3, 4),
 bits AS (SELECT video, frame, k, l, v > median(v) OVER (PARTITION BY video, frame) AS bit FROM low),
 changed AS (SELECT video, frame, avg(CASE WHEN bit <> was THEN 1.0 ELSE 0.0 END) AS distance FROM (SELECT *, lag(bit) OVER (PARTITION BY video, k, l ORDER BY frame) AS was FROM bits) WHERE was IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {_PX}, {_hashes(4, 8)} SELECT video, frame, {r('distance', 'distance')} FROM changed")
def hash_frame(spark, sf_dir):
    """Perceptual hashes of frames and their distance to the frame before."""
    from ..operators.frame_hash import hash_distances

    return hash_distances(pixel_frames(spark, sf_dir, side=32), 4, 2)


@query(f"WITH {_PX}, d AS (SELECT video, frame, avg((r + g + b) / 3.0) AS v FROM px GROUP BY 1, 2), s AS (SELECT *, coalesce(abs(v - lag(v) OVER (PARTITION BY video ORDER BY frame)), 0) AS score FROM d) SELECT CAST(video AS BIGINT) AS video, CAST(frame AS BIGINT) AS cut FROM s WHERE score >= 4.003")
def content_cuts_of_pixels(spark, sf_dir):
    scored = scenes.content_score(frame_mean(spark, sf_dir), {"value": 1.0})
    return scenes.suppressed_cuts(scored, F.col("score") >= 4.003, 1)
