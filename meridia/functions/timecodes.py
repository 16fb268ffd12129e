"""Frame timecodes as column expressions: a frame number and a frame rate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(number: Column, width: int) -> Column:
    """A whole number with leading zeros up to ``width`` digits; longer ones stay whole."""
    text = number.cast("long").cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def timecode(frame: Column, fps: Column, digits: int = 3) -> Column:
    """HH:MM:SS.nnn, the fraction rounded half to even; seconds that round up to 60 carry over."""
    total = frame / fps
    unit = 10**digits
    whole = F.bround(total * unit).cast("long")
    hours, rest = F.floor(whole / (3600 * unit)), whole % (3600 * unit)
    minutes, rest = F.floor(rest / (60 * unit)), rest % (60 * unit)
    seconds = F.floor(rest / unit)
    text = F.concat_ws(":", *(padded(p, 2) for p in (hours, minutes, seconds)))
    return F.concat(text, F.lit("."), F.lpad((rest % unit).cast("string"), digits, "0")) if digits else text


def parse_timecode(text: Column, fps: Column) -> Column:
    """Frames of "123" (frames), "[HH:]MM:SS[.n]" or "1.5"/"1.5s" (seconds); NULL if it is none of these."""
    t = F.trim(text)
    parts = F.split(t, ":")
    n = F.size(parts)
    at = lambda k: F.try_element_at(parts, k).try_cast("double")
    three = F.when(n == 3, at(F.lit(1))).otherwise(0.0), at(n - 1), at(n)
    clock = F.when((n <= 3) & (three[0] >= 0) & three[1].between(0, 59) & (three[2] >= 0) & (three[2] < 60), three[0] * 3600 + three[1] * 60 + three[2])
    plain = F.regexp_extract(t, r"^([0-9]*\.?[0-9]*)s?$", 1).try_cast("double")
    frames = lambda seconds: F.bround(seconds * fps).cast("long")
    return (
        F.when(t.rlike("^[0-9]+$"), t.try_cast("long")).when(F.contains(t, F.lit(":")), frames(clock)).otherwise(frames(plain))
    )


def plus(frame: Column, other: Column) -> Column:
    """Frame arithmetic stops at 0."""
    return F.greatest(frame + other, F.lit(0))


def edit_point(frame: Column, fps: Column) -> Column:
    """HH:MM:SS:FF of edit lists."""
    total = frame / fps
    seconds = F.floor(total)
    clock = (F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60, F.floor((total - seconds) * fps + 1e-6))
    return F.concat_ws(":", *(padded(p, 2) for p in clock))


def downscale_factor(width: Column, least: int = 256) -> Column:
    return F.when(width < least, 1.0).otherwise(width / least)
