"""Scene cuts of live frame metrics: Structured Streaming with bounded state per video."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_cuts(frames: DataFrame, threshold: float, length: int) -> DataFrame:
    """(video, cut) of a stream ``frames(video, frame, value)``: the change against the frame before reaches the threshold,
    at least ``length`` frames after the last cut.

    A video's state is its last frame, last value and last cut. Frames of a micro-batch are taken in order; frames
    that come later than a frame already seen are left out, as they would rewrite cuts that have been given.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame, value, last = state.get if state.exists else (-1, float("nan"), -1)
        cuts = []
        for row in pd.concat(list(parts)).sort_values("frame").itertuples(index=False):
            if row.frame <= frame:
                continue
            last = row.frame if last < 0 else last
            if value == value and abs(row.value - value) >= threshold and row.frame - last >= length:
                cuts.append(int(row.frame))
                last = row.frame
            frame, value = int(row.frame), float(row.value)
        state.update((frame, value, int(last)))
        yield pd.DataFrame({"video": [key[0]] * len(cuts), "cut": cuts}, columns=["video", "cut"])

    return frames.groupBy("video").applyInPandasWithState(
        step, "video string, cut long", "frame long, value double, last long", "append", GroupStateTimeout.NoTimeout
    )


def frame_rates(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and mean values by video and event-time window, late events allowed for ``delay``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width), F.col("event_type").alias("video"))
    out = rows.agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("start"), "video", "n", "mean")
