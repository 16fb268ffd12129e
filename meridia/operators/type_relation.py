"""Which types can be assigned to which: structural subtyping as a relation over pairs of types.

``types(id, kind, semantic, media, least, most, open)``: ``kind`` is any, null, boolean, number, string, binary, array, object or union; ``semantic`` narrows
strings, binaries and objects, ``media`` binaries; ``least`` and ``most`` bound an array's length; ``open`` objects allow other properties.
``parts(id, name, part, required)``: a union's variants and an array's item (no name), an object's properties. Types may hold themselves.

A pair asks for other pairs: all of them, or any of them. Pairs are found round by round by equality joins from those that are wanted; then the
relation is the greatest one that holds: what is certainly wrong spreads to the pairs that ask for it, round by round, until nothing more falls.
Rounds are as many as types are nested, and a pair is settled once however often it is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

PAIR = ["source", "target"]


def _narrows(source: str, target: str) -> Column:
    """A target that says nothing takes all; else both must say the same."""
    return F.col(target).isNull() | F.coalesce(F.col(source) == F.col(target), F.lit(False))


def _ruled(pairs: DataFrame, types: DataFrame, parts: DataFrame) -> DataFrame:
    """``pairs`` with ``rule``: yes, no, or which pairs they ask for: any_variant, all_variants, items or properties."""
    side = lambda name: types.select(F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in types.columns if c != "id"))
    rows = pairs.join(side("source"), "source").join(side("target"), "target")
    own, other = F.col("source_kind"), F.col("target_kind")
    semantic = _narrows("source_semantic", "target_semantic")
    longest = F.col("target_most").isNull() | F.coalesce(F.col("source_most") <= F.col("target_most"), F.lit(False))
    bounds = (F.coalesce("source_least", F.lit(0)) >= F.coalesce("target_least", F.lit(0))) & longest
    closed = ~F.coalesce("target_open", F.lit(False))
    shut = closed & F.coalesce("source_open", F.lit(False))
    rule = (
        F.when(other == "any", "yes").when(other == "union", "any_variant").when(own == "union", "all_variants").when((own == "any") | (own != other), "no")
        .when(own.isin("null", "boolean", "number"), "yes")
        .when(own == "string", F.when(semantic, "yes").otherwise("no"))
        .when(own == "binary", F.when(semantic & _narrows("source_media", "target_media"), "yes").otherwise("no"))
        .when(own == "array", F.when(bounds, "items").otherwise("no"))
        .when(own == "object", F.when(semantic & ~shut, "properties").otherwise("no")).otherwise("no")
    )
    rows = rows.select(*PAIR, rule.alias("rule"), closed.alias("closed"))
    objects = rows.where("rule = 'properties'")
    here = parts.select(F.col("id").alias("source"), "name")
    there = parts.select(F.col("id").alias("target"), "name", "required")
    missing = objects.join(there.where("required"), "target").join(here, ["source", "name"], "left_anti").select(*PAIR)
    extra = objects.where("closed").join(here, "source").join(there, ["target", "name"], "left_anti").select(*PAIR)
    wrong = missing.unionByName(extra).distinct().withColumn("wrong", F.lit(True))
    rows = rows.join(wrong, PAIR, "left")
    return rows.select(*PAIR, F.when(F.col("wrong"), "no").otherwise(F.col("rule")).alias("rule"))


def _asked(ruled: DataFrame, parts: DataFrame) -> DataFrame:
    """(source, target, rule, next_source, next_target): the pairs that each pair asks for."""
    own = parts.select(F.col("id").alias("source"), "name", F.col("part").alias("next_source"))
    other = parts.select(F.col("id").alias("target"), "name", F.col("part").alias("next_target"))
    keep = [*PAIR, "rule", "next_source", "next_target"]
    any_of = ruled.where("rule = 'any_variant'").join(other, "target").withColumn("next_source", F.col("source"))
    all_of = ruled.where("rule = 'all_variants'").join(own, "source").withColumn("next_target", F.col("target"))
    items = ruled.where("rule = 'items'").join(own.drop("name"), "source").join(other.drop("name"), "target")
    fields = ruled.where("rule = 'properties'").join(own, "source").join(other, ["target", "name"])
    return any_of.select(*keep).unionByName(all_of.select(*keep)).unionByName(items.select(*keep)).unionByName(fields.select(*keep)).distinct()


def assignable(types: DataFrame, parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, target, fits) of each pair of ``wanted(source, target)`` whose types are known."""
    types, parts = written(types, "types"), written(parts, "parts")
    new = written(wanted.select(*PAIR).where("source IS NOT NULL AND target IS NOT NULL").distinct(), "pairs")
    first, ruled, asked = new, None, None
    while not new.isEmpty():
        some = written(_ruled(new, types, parts), "ruled")
        links = written(_asked(some, parts), "asked")
        ruled = some if ruled is None else ruled.unionByName(some)
        asked = links if asked is None else asked.unionByName(links)
        ahead = links.select(F.col("next_source").alias("source"), F.col("next_target").alias("target")).distinct()
        new = written(ahead.join(ruled.select(*PAIR), PAIR, "left_anti"), "pairs")
    if ruled is None:
        return first.withColumn("fits", F.lit(True))
    # an empty union takes nothing
    barren = ruled.where("rule = 'any_variant'").join(asked, PAIR, "left_anti")
    fallen = written(ruled.where("rule = 'no'").select(*PAIR).unionByName(barren.select(*PAIR)), "fallen")
    latest = fallen
    while not latest.isEmpty():
        names = {"source": "next_source", "target": "next_target"}
        hit = written(asked.join(latest.withColumnsRenamed(names), list(names.values())).select(*PAIR, "rule").distinct().join(fallen, PAIR, "left_anti"), "hit")
        # a pair that asks for any of its variants falls with the last of them
        open_ = hit.where("rule = 'any_variant'")
        held = asked.join(open_.select(*PAIR), PAIR).join(fallen.withColumnsRenamed(names), list(names.values()), "left_anti").select(*PAIR).distinct()
        down = hit.where("rule <> 'any_variant'").select(*PAIR).unionByName(open_.select(*PAIR).join(held, PAIR, "left_anti"))
        latest = written(down, "latest")
        fallen = fallen.unionByName(latest)
    known = ruled.select(*PAIR).join(first, PAIR, "left_semi")
    return known.join(fallen.withColumn("fell", F.lit(True)), PAIR, "left").select(*PAIR, F.col("fell").isNull().alias("fits"))
