"""Gaussian splats and radiance fields: statistics, projection, compositing, ray marching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cameras import Intrinsics, Pose
from ..functions.vectors import Mat, Quat, Vec, clamp, col, greatest

#: layers of a pixel that are painted at once
LAYERS = 1024
#: the constant term of spherical harmonics (a fixed value)
SH_C0 = 0.2820948


def opacity(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def preview_colour(dc: Column) -> Column:
    return clamp(dc * SH_C0 + 0.5, 0, 1)


def covariance(scale: Vec, rotation: Quat) -> tuple[Column, ...]:
    """xx, xy, xz, yy, yz, zz of R diag(s^2) R^T."""
    r = rotation.matrix().rows
    half = Mat([[c * s for c, s in zip(row, scale)] for row in r])
    full = (half @ half.transpose()).rows
    return full[0][0], full[0][1], full[0][2], full[1][1], full[1][2], full[2][2]


def stats(splats: DataFrame) -> DataFrame:
    """Count, bounds (widened by 1e-6 where flat), mean opacity, smallest and largest scale; zeros for an empty scene.

    ``splats(x, y, z, sx, sy, sz, logit)`` with logarithmic scales.
    """
    scales = [F.exp(f"s{k}") for k in "xyz"]
    out = splats.agg(
        F.count("*").alias("n"),
        *(F.min(k).alias(f"lo_{k}") for k in "xyz"), *(F.max(k).alias(f"hi_{k}") for k in "xyz"),
        F.avg(opacity(F.col("logit"))).alias("mean_opacity"), F.min(F.least(*scales)).alias("min_scale"), F.max(F.greatest(*scales)).alias("max_scale"),
    )
    flat = {k: F.col(f"hi_{k}") <= F.col(f"lo_{k}") for k in "xyz"}
    return out.select(
        "n",
        *(F.coalesce(F.when(flat[k], F.col(f"lo_{k}") - 1e-6).otherwise(F.col(f"lo_{k}")), F.lit(0.0)).alias(f"lo_{k}") for k in "xyz"),
        *(F.coalesce(F.when(flat[k], F.col(f"hi_{k}") + 1e-6).otherwise(F.col(f"hi_{k}")), F.lit(0.0)).alias(f"hi_{k}") for k in "xyz"),
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_opacity", "min_scale", "max_scale")),
    )


def transformed(splats: DataFrame, scale: float, shift: tuple[float, float, float]) -> DataFrame:
    moves = {k: F.col(k) * scale + t for k, t in zip("xyz", shift)}
    return splats.withColumns(moves | {f"s{k}": F.col(f"s{k}") + F.log(col(float(scale))) for k in "xyz"})


def retain_opacity(splats: DataFrame, least: float) -> DataFrame:
    return splats.where(opacity(F.col("logit")) >= least)


def project(
    splats: DataFrame, lens: Intrinsics, pose: Pose, min_depth: float = 1e-4, deviations: float = 3.0, max_radius: float = 4096.0
) -> DataFrame:
    """(idx, u, v, depth, radius, opacity, r, g, b) of the splats before the camera."""
    c = pose.to_camera(Vec.columns())
    biggest = F.exp(F.greatest("sx", "sy", "sz"))
    radius = clamp(biggest * greatest(lens.fx, lens.fy) / c.z * deviations, 1.0, max_radius)
    return splats.where(c.z > min_depth).select(
        "idx", (lens.fx * c.x / c.z + lens.cx).alias("u"), (lens.fy * c.y / c.z + lens.cy).alias("v"), c.z.alias("depth"),
        radius.alias("radius"), opacity(F.col("logit")).alias("opacity"), "r", "g", "b",
    )


def render(projected: DataFrame, width: int, height: int, background=(0.0, 0.0, 0.0)) -> DataFrame:
    """(px, py, r, g, b, alpha) of every pixel: splats within their radius, painted back to front.

    Every splat is dealt to the pixels its circle can reach, by expression, so there is no pixel-by-splat join.
    """
    span = lambda c, size: (F.greatest(F.ceil(F.col(c) - F.col("radius")), F.lit(0)), F.least(F.floor(F.col(c) + F.col("radius")), F.lit(size - 1)))
    (x0, x1), (y0, y1) = span("u", width), span("v", height)
    hits = projected.where((x0 <= x1) & (y0 <= y1)).withColumn("px", F.explode(F.sequence(x0, x1)))
    hits = hits.withColumn("py", F.explode(F.sequence(y0, y1)))
    squared = (F.col("px") - F.col("u")) ** 2 + (F.col("py") - F.col("v")) ** 2
    reach = F.col("radius") * F.col("radius")
    hits = hits.where(F.sqrt(squared) <= F.col("radius"))
    a = clamp(F.col("opacity") * F.exp(-0.5 * squared / reach), 0, 1)
    far_first = Window.partitionBy("px", "py").orderBy(F.desc("depth"), "idx")
    hits = hits.select("px", "py", "depth", "idx", a.alias("a"), "r", "g", "b").withColumn("run", F.floor((F.row_number().over(far_first) - 1) / LAYERS))

    def over(below: Column, top: Column) -> Column:
        rest = 1 - top["a"]
        return F.struct(*((top[k] * top["a"] + below[k] * rest).alias(k) for k in "rgb"), (top["a"] + below["alpha"] * rest).alias("alpha"), (below["left"] * rest).alias("left"))

    # a pixel's layers are painted in runs of bounded length, and these over each other
    layer = F.struct((-F.col("depth")).alias("far"), "idx", "a", "r", "g", "b")
    clear = F.struct(*(col(0.0).alias(k) for k in (*"rgb", "alpha")), col(1.0).alias("left"))
    runs = hits.groupBy("px", "py", "run").agg(F.aggregate(F.array_sort(F.collect_list(layer)), clear, over).alias("c"))
    start = F.struct(*(col(float(c)).alias(k) for k, c in zip("rgb", background)), col(0.0).alias("alpha"))
    onto = lambda below, top: F.struct(*((top["c"][k] + below[k] * top["c"]["left"]).alias(k) for k in (*"rgb", "alpha")))
    painted = runs.groupBy("px", "py").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("run", "c"))), start, onto).alias("c"))
    spark = projected.sparkSession
    pixels = spark.range(width * height).select((F.col("id") % width).alias("px"), F.floor(F.col("id") / width).alias("py"))
    out = pixels.join(painted, ["px", "py"], "left")
    return out.select("px", "py", *(clamp(F.coalesce(F.col(f"c.{k}"), col(c)), 0, 1).alias(k) for k, c in zip("rgb", background)), F.coalesce("c.alpha", F.lit(0.0)).alias("alpha"))


def march(near: Column, far: Column, step: float, density, colour, stop: float = 0.99, background=(0.0, 0.0, 0.0)) -> Column:
    """Struct (r, g, b, opacity, samples) of a ray through a field, front to back, as a fold over its samples.

    ``density(t)`` and ``colour(t)`` give the field at distance t along the ray as expressions.
    """
    count = F.greatest(F.ceil((far - near) / step - 1e-9), F.lit(0)).cast("int")
    start = F.struct(*(col(0.0).alias(k) for k in "rgb"), col(1.0).alias("left"), F.lit(0).alias("n"))

    def next_(s: Column, i: Column) -> Column:
        t = near + i * step
        delta = F.least(col(step), far - t)
        a = 1 - F.exp(-density(t + delta / 2) * delta)
        a = F.when(1 - s["left"] < stop, a).otherwise(0.0)
        weight, c = s["left"] * a, colour(t + delta / 2)
        more = F.when(1 - s["left"] < stop, 1).otherwise(0)
        return F.struct(*((s[k] + col(v) * weight).alias(k) for k, v in zip("rgb", c)), (s["left"] * (1 - a)).alias("left"), (s["n"] + more).alias("n"))

    steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def finish(s: Column) -> Column:
        return F.struct(*(clamp(s[k] + s["left"] * b, 0, 1).alias(k) for k, b in zip("rgb", background)), (1 - s["left"]).alias("opacity"), s["n"].alias("samples"))

    return F.aggregate(steps, start, next_, finish)
