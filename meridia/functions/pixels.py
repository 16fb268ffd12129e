"""Pixel arithmetic in the usual 8-bit conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in [0, 179], saturation and value in [0, 255]."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    turn = F.when(span == 0, 0.0).when(high == r, 60.0 * (g - b) / span).when(high == g, 120.0 + 60.0 * (b - r) / span).otherwise(240.0 + 60.0 * (r - g) / span)
    hue = F.round(F.when(turn < 0, turn + 360).otherwise(turn) / 2).cast("int") % 180
    saturation = F.when(high == 0, 0).otherwise(F.round(255.0 * span / high).cast("int"))
    return hue, saturation, high


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.round(0.299 * r + 0.587 * g + 0.114 * b).cast("int")
