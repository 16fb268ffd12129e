"""Generation workflows from requests: templates of nodes and wires by mode, joined with the requests' parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import Rule, problem

#: node types of the generator: their inputs (name, socket) and outputs (sockets), in slot order (fixed values)
SLOTS = {
    "CheckpointLoaderSimple": ([], ["MODEL", "CLIP", "VAE"]),
    "CLIPTextEncode": ([("clip", "CLIP")], ["CONDITIONING"]),
    "DualCLIPLoader": ([], ["CLIP"]),
    "EmptyLatentImage": ([], ["LATENT"]),
    "ImageUpscaleWithModel": ([("image", "IMAGE"), ("upscale_model", "UPSCALE_MODEL")], ["IMAGE"]),
    "KSampler": ([("model", "MODEL"), ("positive", "CONDITIONING"), ("negative", "CONDITIONING"), ("latent_image", "LATENT")], ["LATENT"]),
    "LoadImage": ([], ["IMAGE"]),
    "LoadImageMask": ([], ["MASK"]),
    "SaveImage": ([("images", "IMAGE")], []),
    "UNETLoader": ([], ["MODEL"]),
    "UpscaleModelLoader": ([], ["UPSCALE_MODEL"]),
    "VAEDecode": ([("samples", "LATENT"), ("vae", "VAE")], ["IMAGE"]),
    "VAEEncode": ([("pixels", "IMAGE"), ("vae", "VAE")], ["LATENT"]),
    "VAEEncodeForInpaint": ([("pixels", "IMAGE"), ("vae", "VAE"), ("mask", "MASK")], ["LATENT"]),
    "VAELoader": ([], ["VAE"]),
}
_SAMPLER = ["seed", "steps", "cfg_scale", "sampler_name", "scheduler", "denoise"]
#: by mode the nodes from 1 with their widgets, names of parameters or texts in quotes, and the wires (origin, slot, target, slot) from 1 (fixed values)
TEMPLATES = {
    "text_to_image": (
        [("CheckpointLoaderSimple", ["checkpoint"]), ("CLIPTextEncode", ["prompt"]), ("CLIPTextEncode", ["negative_prompt"]), ("EmptyLatentImage", ["width", "height", "1"]), ("KSampler", [*_SAMPLER[:5], "1.0"]), ("VAEDecode", []), ("SaveImage", ["output_prefix"])],
        [(1, 0, 5, 0), (1, 1, 2, 0), (1, 1, 3, 0), (1, 2, 6, 1), (2, 0, 5, 1), (3, 0, 5, 2), (4, 0, 5, 3), (5, 0, 6, 0), (6, 0, 7, 0)],
    ),
    "image_to_image": (
        [("CheckpointLoaderSimple", ["checkpoint"]), ("CLIPTextEncode", ["prompt"]), ("CLIPTextEncode", ["negative_prompt"]), ("LoadImage", ["input_image"]), ("VAEEncode", []), ("KSampler", _SAMPLER), ("VAEDecode", []), ("SaveImage", ["output_prefix"])],
        [(1, 0, 6, 0), (1, 1, 2, 0), (1, 1, 3, 0), (1, 2, 5, 1), (2, 0, 6, 1), (3, 0, 6, 2), (4, 0, 5, 0), (5, 0, 6, 3), (6, 0, 7, 0), (1, 2, 7, 1), (7, 0, 8, 0)],
    ),
    "inpaint": (
        [("CheckpointLoaderSimple", ["checkpoint"]), ("CLIPTextEncode", ["prompt"]), ("CLIPTextEncode", ["negative_prompt"]), ("LoadImage", ["input_image"]), ("LoadImageMask", ["mask_image"]), ("VAEEncodeForInpaint", []), ("KSampler", _SAMPLER), ("VAEDecode", []), ("SaveImage", ["output_prefix"])],
        [(1, 0, 7, 0), (1, 1, 2, 0), (1, 1, 3, 0), (1, 2, 6, 1), (2, 0, 7, 1), (3, 0, 7, 2), (4, 0, 6, 0), (5, 0, 6, 2), (6, 0, 7, 3), (7, 0, 8, 0), (1, 2, 8, 1), (8, 0, 9, 0)],
    ),
    "upscale": (
        [("LoadImage", ["input_image"]), ("UpscaleModelLoader", ["upscale_model"]), ("ImageUpscaleWithModel", []), ("SaveImage", ["output_prefix"])],
        [(1, 0, 3, 0), (2, 0, 3, 1), (3, 0, 4, 0)],
    ),
    "flux_inpaint": (
        [("LoadImage", ["input_image"]), ("LoadImageMask", ["mask_image"]), ("DualCLIPLoader", ["'clip_l.safetensors'", "'t5xxl_fp8_e4m3fn.safetensors'", "'flux'"]), ("UNETLoader", ["checkpoint", "'default'"]), ("VAELoader", ["'ae.safetensors'"]), ("CLIPTextEncode", ["prompt"]), ("CLIPTextEncode", ["negative_prompt"]), ("VAEEncodeForInpaint", []), ("KSampler", _SAMPLER), ("VAEDecode", []), ("SaveImage", ["output_prefix"])],
        [(1, 0, 8, 0), (2, 0, 8, 2), (3, 0, 6, 0), (3, 0, 7, 0), (4, 0, 9, 0), (5, 0, 8, 1), (5, 0, 10, 1), (6, 0, 9, 1), (7, 0, 9, 2), (8, 0, 9, 3), (9, 0, 10, 0), (10, 0, 11, 0)],
    ),
}


def request_rules() -> list[Rule]:
    """What a request must keep, by its mode."""
    given = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    within = lambda c, high: F.coalesce(~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) <= high), F.lit(False))
    paints = F.col("mode").isin("inpaint", "flux_inpaint")
    return [
        (F.col("mode").isin(*TEMPLATES), "no such mode"),
        ((F.col("width") > 0) & (F.col("height") > 0), "width and height must be positive"),
        (within("cfg_scale", 1.7976931348623157e308), "cfg_scale must be finite and not negative"),
        (within("denoise", 1.0), "denoise must lie between 0 and 1"),
        (given("checkpoint"), "a checkpoint is needed"),
        (given("upscale_model"), "an upscale model is needed"),
        (~F.col("mode").isin("image_to_image", "upscale") | given("input_image"), "input_image is needed"),
        (~paints | (given("input_image") & given("mask_image")), "input_image and mask_image are needed"),
    ]


def _json(value: Column) -> Column:
    text = F.to_json(F.array(value))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _widget(name: str) -> Column:
    """A parameter or fixed value as JSON."""
    if name[0] == "'":
        return F.lit('"' + name.strip("'") + '"')
    return F.lit(name) if name[0].isdigit() else F.coalesce(_json(F.col(name)), F.lit("null"))


def generated(requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, rejected) for ``requests(workflow, mode, prompt, negative_prompt, width, height, steps, cfg_scale, sampler_name, scheduler, seed,
    checkpoint, upscale_model, input_image, mask_image, denoise, output_prefix)``.

    nodes(workflow, id, type, inputs, outputs, widgets_values) and links(workflow, id, origin, origin_slot, target, target_slot, type) have the columns of
    ``workflow.as_json``, widgets as JSON. Each request is a row until its template unfolds, so requests of all modes go through one plan without a
    shuffle. rejected(workflow, reason) are those that break a rule.
    """
    checked = requests.withColumn("reason", problem(request_rules()))
    good = checked.where("reason IS NULL")
    nodes = links = None
    for mode, (kinds, wires) in TEMPLATES.items():
        numbered = [(k, *wire, SLOTS[kinds[wire[0] - 1][0]][1][wire[1]]) for k, wire in enumerate(wires, 1)]
        boxes = []
        for i, (kind, widgets) in enumerate(kinds, 1):
            into = {slot: k for k, _, _, target, slot, _ in numbered if target == i}
            inputs = [F.struct(F.lit(name).alias("name"), F.lit(socket).alias("type"), F.lit(into.get(slot)).cast("long").alias("link")) for slot, (name, socket) in enumerate(SLOTS[kind][0])]
            outputs = [F.struct(F.lit(socket).alias("name"), F.lit(socket).alias("type"), F.lit(slot).cast("long").alias("slot_index"), F.array(*(F.lit(k).cast("long") for k, origin, at, *_ in numbered if (origin, at) == (i, slot))).cast("array<bigint>").alias("links")) for slot, socket in enumerate(SLOTS[kind][1])]
            empty = lambda items, kind: F.array(*items) if items else F.array().cast(kind)
            boxes.append(F.struct(
                F.lit(i).cast("long").alias("id"), F.lit(kind).alias("type"), empty(inputs, "array<struct<name:string,type:string,link:bigint>>").alias("inputs"),
                empty(outputs, "array<struct<name:string,type:string,slot_index:bigint,links:array<bigint>>>").alias("outputs"), empty([_widget(w) for w in widgets], "array<string>").alias("widgets_values"),
            ))
        rows = [F.struct(*(F.lit(v).cast(t).alias(n) for n, t, v in zip(("id", "origin", "origin_slot", "target", "target_slot", "type"), ("long", "long", "int", "long", "int", "string"), wire))) for wire in numbered]
        when = F.col("mode") == mode
        nodes = F.when(when, F.array(*boxes)) if nodes is None else nodes.when(when, F.array(*boxes))
        links = F.when(when, F.array(*rows)) if links is None else links.when(when, F.array(*rows))
    unfold = lambda items: good.select("workflow", F.explode(items).alias("i")).select("workflow", "i.*")
    return unfold(nodes), unfold(links), checked.where("reason IS NOT NULL").select("workflow", "reason")
