"""Cuts by perceptual hashes and by histograms of brightness. Hashes need a kernel: a cosine transform in a grouped Arrow call."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import luma
from .scenes import suppressed_cuts


def _cosines(n: int) -> np.ndarray:
    """Orthonormal DCT-II matrix."""
    k, i = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def frame_hashes(pixels: DataFrame, size: int = 16, lowpass: int = 2) -> DataFrame:
    """(video, frame, bits): for each low frequency whether it exceeds their median. ``pixels(video, frame, y, x, r, g, b)``.

    The picture is averaged to ``size * lowpass`` cells a side first, in Spark, so a frame's group is small whatever the video.
    """
    side = size * lowpass
    grey = luma(F.col("r"), F.col("g"), F.col("b"))
    extent = pixels.groupBy("video").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    cell = lambda c, n: F.floor(F.col(c) * side / F.col(n)).cast("int")
    small = pixels.join(extent, "video").groupBy("video", "frame", cell("y", "h").alias("cy"), cell("x", "w").alias("cx")).agg(F.avg(grey).alias("v"))
    m = _cosines(side)[:size]

    def bits(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((side, side))
        grid[pdf["cy"], pdf["cx"]] = pdf["v"]
        top = grid.max()
        low = m @ (grid / top if top > 0 else grid) @ m.T
        return pd.DataFrame({"video": [pdf["video"].iloc[0]], "frame": [pdf["frame"].iloc[0]], "bits": ["".join("1" if b else "0" for b in (low > np.median(low)).ravel())]})

    return small.groupBy("video", "frame").applyInPandas(bits, "video long, frame long, bits string")


def hash_cuts(pixels: DataFrame, threshold: float = 0.395, size: int = 16, lowpass: int = 2, length: int = 15) -> DataFrame:
    """Cuts where the share of changed hash bits reaches the threshold, ``length`` frames after the last cut or the first frame."""
    rows = pixels.select("video", "frame").distinct().join(hash_distances(pixels, size, lowpass), ["video", "frame"], "left")
    return suppressed_cuts(rows, F.coalesce(F.col("distance") >= threshold, F.lit(False)), length)


def histograms(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """(video, frame, shares): the share of a frame's pixels in each bin of brightness."""
    level = F.least(F.floor(luma(F.col("r"), F.col("g"), F.col("b")) * bins / 256), F.lit(bins - 1)).cast("int")
    counted = pixels.groupBy("video", "frame", level.alias("bin")).agg(F.count("*").alias("n"))
    whole = counted.groupBy("video", "frame").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("total"))
    share = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)) / F.col("total"))
    return whole.select("video", "frame", share.alias("shares"))


def histogram_correlations(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """(video, frame, correlation): Pearson's, of each frame's histogram with that of the frame before; NULL for the first.

    Two flat histograms correlate by 1.
    """
    before = F.lag("shares").over(Window.partitionBy("video").orderBy("frame"))
    rows = histograms(pixels, bins).withColumn("before", before)
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    off = lambda c: F.transform(c, lambda v: v - 1.0 / bins)  # noqa: E731  shares sum to one
    both = add(F.zip_with(off("shares"), off("before"), lambda a, b: a * b))
    norm = F.sqrt(add(F.transform(off("shares"), lambda v: v * v)) * add(F.transform(off("before"), lambda v: v * v)))
    return rows.select("video", "frame", F.when(F.col("before").isNotNull(), F.when(norm > 0, both / norm).otherwise(1.0)).alias("correlation"))


def histogram_cuts(pixels: DataFrame, threshold: float = 0.05, bins: int = 256, length: int = 15) -> DataFrame:
    """Cuts where the correlation is at most 1 - threshold, ``length`` frames after the last cut or the first frame that isn't 0."""
    rows = histogram_correlations(pixels, bins).withColumn("above", F.coalesce(F.col("correlation") <= 1 - threshold, F.lit(False)))
    return suppressed_cuts(rows, F.col("above"), length, skip_zero=True)


def hash_distances(pixels: DataFrame, size: int = 16, lowpass: int = 2) -> DataFrame:
    """(video, frame, distance): share of hash bits that changed since the frame before."""
    rows = frame_hashes(pixels, size, lowpass)
    before = F.lag("bits").over(Window.partitionBy("video").orderBy("frame"))
    changed = F.size(F.filter(F.zip_with(F.split("bits", ""), F.split("_b", ""), lambda a, b: a != b), lambda d: d))
    rows = rows.withColumn("_b", before).where("_b IS NOT NULL")
    return rows.select("video", "frame", (changed / float(size * size)).alias("distance"))
