"""Workflow graphs held as JSON text, manifests and status roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import item_id, normalised, socket_type, upload_date, source_url
from .tables import written

NODES = "nodes array<struct<id:string,type:string,inputs:array<struct<name:string,type:string,link:bigint>>,outputs:array<struct<name:string,type:string,links:array<bigint>>>,widgets_values:array<string>>>"
LINKS = "links array<array<string>>"


def parsed(workflows: DataFrame) -> DataFrame:
    """``workflows(workflow, json)`` with nodes and links; what is not JSON gives NULLs. Those of ``graphs`` are as they are."""
    return workflows if "g" in workflows.columns else workflows.withColumn("g", F.from_json("json", f"{NODES}, {LINKS}"))


def graphs(workflows: DataFrame) -> DataFrame:
    """(workflow, g): nodes and links, parsed once and written, for what reads them several times."""
    return written(parsed(workflows).select("workflow", "g"), "graphs")


def nodes(workflows: DataFrame) -> DataFrame:
    rows = parsed(workflows).select("workflow", F.posexplode("g.nodes").alias("pos", "n"))
    return rows.select("workflow", "pos", F.col("n.id").alias("id"), F.col("n.type").alias("type"), "n.inputs", "n.outputs")


def links(workflows: DataFrame) -> DataFrame:
    """One row per link: id, origin, origin slot, target, target slot, type."""
    rows = parsed(workflows).select("workflow", F.explode("g.links").alias("l"))
    at = lambda k, kind="string": F.try_element_at("l", F.lit(k)).try_cast(kind)
    return rows.select(
        "workflow", at(1, "long").alias("id"), at(2).alias("origin"), at(3, "int").alias("origin_slot"),
        at(4).alias("target"), at(5, "int").alias("target_slot"), at(6).alias("type"),
    )


def problems(workflows: DataFrame) -> DataFrame:
    """(workflow, problem, ref): repeated ids, links to missing nodes, inputs and outputs to missing links."""
    held = graphs(workflows)
    n, e = nodes(held), links(held)
    # sizes after the explode are guessed far too low, so say that neither nodes nor links are to be broadcast
    repeated = lambda rows, what: rows.groupBy("workflow", "id").agg(F.count("*").alias("k")).where("k > 1").select("workflow", F.lit(what).alias("problem"), F.col("id").cast("string").alias("ref"))
    ends = e.select("workflow", F.col("id").cast("string").alias("ref"), F.explode(F.array("origin", "target")).alias("id"))
    lost = ends.join(n.select("workflow", "id").hint("merge"), ["workflow", "id"], "left_anti").select("workflow", F.lit("link_without_node").alias("problem"), "ref").distinct()
    ins = n.select("workflow", F.col("id").alias("ref"), F.explode("inputs").alias("i")).select("workflow", "ref", F.col("i.link").alias("id"))
    outs = n.select("workflow", F.col("id").alias("ref"), F.explode("outputs").alias("o")).select("workflow", "ref", F.explode("o.links").alias("id"))
    known = e.select("workflow", "id").hint("merge")
    miss = lambda rows, what: rows.where("id IS NOT NULL").join(known, ["workflow", "id"], "left_anti").select("workflow", F.lit(what).alias("problem"), "ref").distinct()
    out = repeated(n, "repeated_node").unionByName(repeated(e, "repeated_link")).unionByName(lost)
    return out.unionByName(miss(ins, "input_without_link")).unionByName(miss(outs, "output_without_link"))


def socket_types(workflows: DataFrame) -> DataFrame:
    """(workflow, inputs, outputs, links): the distinct socket types of each, sorted."""
    held = graphs(workflows)
    n, e = nodes(held), links(held)
    of = lambda rows, kind: rows.where("t IS NOT NULL").select("workflow", F.lit(kind).alias("kind"), socket_type(F.col("t")).alias("t"))
    ins = of(n.select("workflow", F.explode("inputs").alias("i")).select("workflow", F.col("i.type").alias("t")), "inputs")
    outs = of(n.select("workflow", F.explode("outputs").alias("o")).select("workflow", F.col("o.type").alias("t")), "outputs")
    mine = of(e.select("workflow", F.col("type").alias("t")), "links")
    rows = ins.unionByName(outs).unionByName(mine)
    pick = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("t")))).alias(k)
    return rows.groupBy("workflow").agg(pick("inputs"), pick("outputs"), pick("links"))


# Node types whose text widgets name assets, and what they name.
ASSET_TYPES = {"CheckpointLoaderSimple": "model", "LoraLoader": "model", "VAELoader": "model", "ControlNetLoader": "model", "LoadImage": "image", "SaveImage": "output"}


def assets(workflows: DataFrame) -> DataFrame:
    """(workflow, kind, value): text widgets of nodes that load models or images or save outputs; numbers are left out."""
    rows = parsed(workflows).select("workflow", F.explode("g.nodes").alias("n")).select("workflow", F.col("n.type").alias("type"), F.explode("n.widgets_values").alias("value"))
    kind = F.try_element_at(F.create_map(*(F.lit(v) for pair in ASSET_TYPES.items() for v in pair)), F.col("type"))
    rows = rows.withColumn("kind", kind).where(F.col("kind").isNotNull() & F.col("value").try_cast("double").isNull() & (F.trim("value") != ""))
    return rows.select("workflow", "kind", "value").distinct()


def prompt_links(prompts: DataFrame) -> DataFrame:
    """(prompt, node, input, origin, slot) of the inputs that are two-element [node, slot] arrays, from ``prompts(prompt, json)``."""
    shape = "map<string,struct<class_type:string,inputs:map<string,string>>>"
    rows = prompts.select("prompt", F.explode(F.from_json("json", shape)).alias("node", "body"))
    rows = rows.select("prompt", "node", F.explode("body.inputs").alias("input", "raw"))
    pair = F.from_json("raw", "array<string>")
    rows = rows.withColumn("pair", pair).where("size(pair) = 2").withColumn("slot", F.try_element_at("pair", F.lit(2)).try_cast("int"))
    return rows.where("slot >= 0").select("prompt", "node", "input", F.try_element_at("pair", F.lit(1)).alias("origin"), "slot")


def manifest_filter(
    items: DataFrame, title_contains: str | None = None, title_excludes: tuple[str, ...] = (), index_min: int | None = None,
    index_max: int | None = None, duration_min: float | None = None, duration_max: float | None = None,
    date_from: str | None = None, date_to: str | None = None,
) -> DataFrame:
    """Items that meet every given condition. A null title is empty, a null index is lowest for the minimum and
    highest for the maximum, a null duration or date fails."""
    title = F.coalesce(normalised(F.col("title")), F.lit(""))
    checks: list[Column] = []
    plain = lambda s: "".join(c.lower() if c.isascii() else c for c in s.strip())
    if title_contains is not None:
        checks.append(F.contains(title, F.lit(plain(title_contains))))
    checks += [~F.contains(title, F.lit(plain(x))) for x in title_excludes if x.strip()]
    if index_min is not None:
        checks.append(F.coalesce("playlist_index", F.lit(0)) >= index_min)
    if index_max is not None:
        checks.append(F.coalesce(F.col("playlist_index") <= index_max, F.lit(False)))
    if duration_min is not None:
        checks.append(F.coalesce(F.col("duration_seconds") >= duration_min, F.lit(False)))
    if duration_max is not None:
        checks.append(F.coalesce(F.col("duration_seconds") <= duration_max, F.lit(False)))
    date = upload_date(F.col("upload_date"))
    only = lambda s: d if s and len(d := "".join(c for c in s if c.isdigit())) == 8 else None
    if only(date_from):
        checks.append(F.coalesce(date >= only(date_from), F.lit(False)))
    if only(date_to):
        checks.append(F.coalesce(date <= only(date_to), F.lit(False)))
    for c in checks:
        items = items.where(c)
    return items


def playlist_items(playlists: DataFrame, max_items: int | None = None) -> DataFrame:
    """Items of ``playlists(collection, json)``: entries that are not null in their order, the first ``max_items`` of each, ids made unique.

    (collection, pos, item_id, youtube_id, playlist_index, title, source_url, duration_seconds, upload_date); an entry without an
    index has its place from 1, one without a page address that of its id.
    """
    entry = "struct<id:string,title:string,webpage_url:string,url:string,duration:double,upload_date:string,playlist_index:bigint>"
    rows = playlists.select("collection", F.from_json("json", f"struct<entries:array<{entry}>>").alias("p"))
    kept = F.filter("p.entries", lambda e: e["id"].isNotNull() | e["title"].isNotNull() | e["webpage_url"].isNotNull() | e["url"].isNotNull())
    if max_items is not None:
        kept = F.slice(kept, 1, max_items)
    rows = rows.select("collection", F.posexplode(kept).alias("pos", "e"))
    watch = F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("e.id"))
    items = rows.select(
        "collection", "pos", item_id(F.coalesce("e.id", "e.title")).alias("item_id"), F.col("e.id").alias("youtube_id"),
        F.coalesce("e.playlist_index", F.col("pos") + 1).alias("playlist_index"), F.col("e.title").alias("title"),
        F.coalesce(source_url(F.col("e.webpage_url"), fallback=source_url(F.col("e.url"), fallback=watch)), watch).alias("source_url"),
        F.col("e.duration").alias("duration_seconds"), F.col("e.upload_date").alias("upload_date"),
    )
    k = F.row_number().over(Window.partitionBy("collection", "item_id").orderBy("pos")) - 1
    return items.withColumn("item_id", F.when(k > 0, F.concat_ws("-", "item_id", k.cast("string"))).otherwise(F.col("item_id")))


def as_json(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(workflow, json): the file form of ``nodes(workflow, id, type, inputs, outputs, widgets_values)`` and
    ``links(workflow, id, origin, origin_slot, target, target_slot, type)``. A workflow is one row."""
    plain = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    row = F.concat(F.lit("["), F.concat_ws(",", F.col("id").cast("string"), plain("origin"), "origin_slot", plain("target"), "target_slot", plain("type")), F.lit("]"))
    wires = links.groupBy("workflow").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", row.alias("row")))), lambda s: s["row"]), ",").alias("links"))
    body = F.to_json(F.struct("id", "type", "inputs", "outputs", "widgets_values"))
    boxes = nodes.groupBy("workflow").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", body.alias("body")))), lambda s: s["body"]), ",").alias("nodes"))
    text = F.concat(F.lit('{"nodes":['), "nodes", F.lit('],"links":['), F.coalesce("links", F.lit("")), F.lit("]}"))
    return boxes.join(wires, "workflow", "left").select("workflow", text.alias("json"))


def with_unique_ids(items: DataFrame, order: str = "pos") -> DataFrame:
    """Cleaned ids, the k-th repeat of an id (k from 1) suffixed -k in the order given."""
    clean = items.withColumn("item_id", item_id(F.col("item_id")))
    k = F.row_number().over(Window.partitionBy("item_id").orderBy(order)) - 1
    return clean.withColumn("item_id", F.when(k > 0, F.concat_ws("-", "item_id", k.cast("string"))).otherwise(F.col("item_id")))


def file_filter(files: DataFrame, min_bytes: int | None = None, max_bytes: int | None = None, extensions: tuple[str, ...] = ()) -> DataFrame:
    """``files(path, length)`` within the size bounds and, if given, with one of the extensions in any case."""
    if min_bytes is not None:
        files = files.where(F.col("length") >= min_bytes)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    if extensions:
        files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))
    return files


def status(rows: DataFrame) -> Column:
    """One status an item, the first that holds; ``rows`` has the flags matched, existing, downloaded, accepted, analysed."""
    return (
        F.when(~F.col("matched"), "filtered").when(F.col("existing"), "skipped").when(~F.col("downloaded"), "download_failed")
        .when(~F.col("accepted"), "rejected").when(~F.col("analysed"), "analysis_failed").otherwise("analysed")
    )


def rolled_up(rows: DataFrame) -> DataFrame:
    """(total, one count a status, duration): the duration of all that is known, NULL if nothing is."""
    names = ["filtered", "skipped", "download_failed", "rejected", "analysis_failed", "analysed"]
    return rows.agg(
        F.count("*").alias("total"), *(F.count_if(F.col("status") == n).alias(n) for n in names), F.sum("duration_seconds").alias("duration")
    )


def latent_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Eighths of the image; NULL unless both sides divide by 8."""
    ok = (width % 8 == 0) & (height % 8 == 0) & (width > 0) & (height > 0)
    return F.when(ok, F.floor(width / 8)), F.when(ok, F.floor(height / 8))


def latent_mask(pixels: DataFrame) -> DataFrame:
    """(ly, lx, value): the largest mask value of each 8 x 8 block, at least 0."""
    return pixels.groupBy(F.floor(F.col("y") / 8).alias("ly"), F.floor(F.col("x") / 8).alias("lx")).agg(F.greatest(F.max("value"), F.lit(0.0)).alias("value"))
