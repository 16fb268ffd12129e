"""Constraints on rows: a list of (condition, message), enforced or reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[Column, str]


def problem(rules: list[Rule]) -> Column:
    """The message of the first rule that a row breaks, NULL if it keeps all. A condition that is NULL is broken."""
    out = None
    for good, message in rules:
        bad = ~F.coalesce(good, F.lit(False))
        out = F.when(bad, message) if out is None else out.when(bad, message)
    return F.lit(None).cast("string") if out is None else out


def strict(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows as they are; reading them fails at the first that breaks a rule."""
    found = problem(rules)
    return rows.where(F.when(found.isNotNull(), F.raise_error(found).cast("boolean")).otherwise(True))


def quarantined(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows with ``_invalid``, the message or NULL."""
    return rows.withColumn("_invalid", problem(rules))


def finite(*columns: str) -> Rule:
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return good, f"{', '.join(columns)} must be finite"


def within(column: str, low: float, high: float) -> Rule:
    return F.col(column).between(low, high), f"{column} must lie between {low:g} and {high:g}"


def geographic(lon: str = "lon", lat: str = "lat") -> list[Rule]:
    return [within(lon, -180, 180), within(lat, -90, 90)]


def box(prefix: str = "", strictly: bool = False) -> list[Rule]:
    """Bounds whose ends are in order; ``strictly`` asks for some extent on every axis."""
    out = [finite(*(f"{prefix}{e}_{a}" for e in ("lo", "hi") for a in "xyz"))]
    for a in "xyz":
        low, high = F.col(f"{prefix}lo_{a}"), F.col(f"{prefix}hi_{a}")
        out.append((low < high if strictly else low <= high, f"{a} bounds must be in order"))
    return out


def triangle(n: str = "n_vertices") -> list[Rule]:
    return [
        (F.least("a", "b", "c") >= 0, "corners must not be negative"),
        (F.greatest("a", "b", "c") < F.col(n), "corners must be vertices"),
        ((F.col("a") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("c")), "corners must differ"),
    ]


def parents_come_first(joint: str = "joint", parent: str = "parent") -> list[Rule]:
    return [(F.col(parent).isNull() | (F.col(parent) < F.col(joint)), "a joint's parent must come before it")]
