"""Workflow files taken apart and written again without loss: what isn't known is kept as VARIANT beside what is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "map<string,variant>"


def _json(value: Column) -> Column:
    """JSON of any value, VARIANT or not."""
    text = F.to_json(F.array(value))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _without(fields: Column, *known: str) -> Column:
    return F.map_filter(fields, lambda k, _: ~k.isin(*known))


def _text(value: Column) -> Column:
    """A text's characters, the JSON of any other value; null stays null."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), _json(value))


def taken_apart(workflows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, nodes, links) of ``workflows(workflow, json)``; what is not a JSON object is left out.

    documents(workflow, rest); nodes(workflow, pos, id, id_json, type, inputs, outputs, rest), inputs and outputs being lists of fields or null where the
    node has none; links(workflow, pos, id, origin, origin_slot, target, target_slot, type, items), ``items`` being all of a link's values.
    """
    rows = workflows.select("workflow", F.try_variant_get(F.try_parse_json("json"), "$", FIELDS).alias("f")).where("f IS NOT NULL")
    documents = rows.select("workflow", F.map_contains_key("f", "nodes").alias("has_nodes"), F.map_contains_key("f", "links").alias("has_links"), _without(F.col("f"), "nodes", "links").alias("rest"))
    boxes = rows.select("workflow", F.posexplode(F.try_variant_get(F.try_element_at("f", F.lit("nodes")), "$", f"array<{FIELDS}>")).alias("pos", "n"))
    field = lambda name: F.try_element_at("n", F.lit(name))
    kind = F.when(_json(field("type")).startswith('"'), F.try_variant_get(field("type"), "$", "string"))
    many = lambda name: F.try_variant_get(field(name), "$", f"array<{FIELDS}>")
    nodes = boxes.select(
        "workflow", "pos", _text(field("id")).alias("id"), F.when(F.map_contains_key("n", "id"), _json(field("id"))).alias("id_json"), kind.alias("type"), many("inputs").alias("inputs"), many("outputs").alias("outputs"),
        F.map_filter("n", lambda k, _: (k != "id") & ~((k == "type") & kind.isNotNull()) & ~((k == "inputs") & many("inputs").isNotNull()) & ~((k == "outputs") & many("outputs").isNotNull())).alias("rest"),
    )
    wires = rows.select("workflow", F.posexplode(F.try_variant_get(F.try_element_at("f", F.lit("links")), "$", "array<array<variant>>")).alias("pos", "items"))
    at = lambda k: F.try_element_at("items", F.lit(k))
    number = lambda k, kind: F.try_variant_get(at(k), "$", kind)
    links = wires.select("workflow", "pos", number(1, "long").alias("id"), _text(at(2)).alias("origin"), number(3, "int").alias("origin_slot"), _text(at(4)).alias("target"), number(5, "int").alias("target_slot"), _text(at(6)).alias("type"), "items")
    return documents, nodes, links


def _object(parts: list[tuple[Column, str, Column]], rest: Column) -> Column:
    """JSON of an object: the parts (condition, name, JSON) that are there, then all other fields."""
    own = [F.when(there, F.concat(F.lit(f'"{name}":'), text)) for there, name, text in parts]
    others = F.transform(F.map_entries(rest), lambda e: F.concat(_json(e["key"]), F.lit(":"), _json(e["value"])))
    fields = F.filter(F.concat(F.array(*own), others), lambda t: t.isNotNull())
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def put_together(documents: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(workflow, json) of what ``taken_apart`` gives. A workflow is one row."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.col(c), lambda m: _object([], m)), ","), F.lit("]"))
    box = _object([(F.col("id_json").isNotNull(), "id", F.col("id_json")), (F.col("type").isNotNull(), "type", _json(F.col("type"))), (F.col("inputs").isNotNull(), "inputs", listed("inputs")), (F.col("outputs").isNotNull(), "outputs", listed("outputs"))], F.col("rest"))
    gathered = lambda rows, text, name: rows.select("workflow", "pos", text.alias("text")).groupBy("workflow").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), ","), F.lit("]")).alias(name))
    boxes = gathered(nodes, box, "nodes")
    wires = gathered(links, F.to_json("items"), "links")
    both = documents.join(boxes, "workflow", "left").join(wires, "workflow", "left")
    own = lambda name: F.coalesce(name, F.lit("[]"))
    text = _object([(F.col("has_nodes"), "nodes", own("nodes")), (F.col("has_links"), "links", own("links"))], F.col("rest"))
    return both.select("workflow", text.alias("json"))
