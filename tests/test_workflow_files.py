"""Files of workflows without loss, and templates of all modes."""

import json

from pyspark.sql import functions as F

from meridia.operators import workflow, workflow_files, workflow_templates

ODD = [
    {"nodes": [], "links": []}, {}, {"links": [[1, 2, 0, 3, 1, "A"]]}, {"nodes": [{"id": 1}]}, {"x": [{"y": [None, 1e300, -0.5, "ü\"\\\n", {}]}]},
    {"nodes": [{"id": "a b", "type": "T", "inputs": [], "outputs": [{"name": "o", "links": None, "more": {"deep": [1]}}], "widgets_values": ["[1]", 2.5, None], "inputs2": 1}], "links": [[1, "a b", 0, "[x]", 0, "IMAGE[]", "extra"]], "nodes_": 3},
    {"nodes": [{"id": 5, "type": None, "inputs": "none", "properties": {"cnr": "x"}}], "groups": [{"title": "g", "bounding": [0, 1.25, 2, 3]}], "version": 0.4},
    {"nodes": [{"type": 7, "x": 1}, {"id": None, "inputs": [{"name": None}]}]},
]


def test_files_come_back_as_they_were(spark):
    rows = [(k, json.dumps(d)) for k, d in enumerate(ODD)] + [(100, "not json"), (101, None), (102, "[1]")]
    parts = workflow_files.taken_apart(spark.createDataFrame(rows, "workflow long, json string"))
    back = {r["workflow"]: json.loads(r["json"]) for r in workflow_files.put_together(*parts).collect()}
    assert back == dict(enumerate(ODD))
    link = parts[2].where("workflow = 5").first()
    assert (link["id"], link["origin"], link["target"], link["target_slot"], link["type"]) == (1, "a b", "[x]", 0, "IMAGE[]")


def test_written_workflows_keep_brackets(spark):
    kind = "workflow long, id long, origin string, origin_slot int, target string, target_slot int, type string"
    links = spark.createDataFrame([(1, 7, "[a]", 0, 'b"', 1, "IMAGE[]")], kind)
    nodes = spark.createDataFrame([(1, "[a]", "T", None, None, ["x"])], "workflow long, id string, type string, inputs array<struct<name:string>>, outputs array<struct<name:string>>, widgets_values array<string>")
    text = json.loads(workflow.as_json(nodes, links).first()["json"])
    assert text["links"] == [[7, "[a]", 0, 'b"', 1, "IMAGE[]"]]


def test_templates_hang_together(spark):
    kind = "workflow long, mode string, prompt string, negative_prompt string, width int, height int, steps int, cfg_scale double, sampler_name string, scheduler string, seed long, checkpoint string, upscale_model string, input_image string, mask_image string, denoise double, output_prefix string"
    good = ('a "cat"', None, 512, 768, 20, 7.5, "euler", "normal", 3, "base", "4x", "in.png", "mask.png", 0.5, "out")
    rows = [(k, mode, *good) for k, mode in enumerate(workflow_templates.TEMPLATES)]
    bad = [("dance", good), ("upscale", (*good[:11], " ", *good[12:])), ("inpaint", (*good[:12], None, *good[13:])), ("text_to_image", (*good[:2], 0, *good[3:])), ("text_to_image", (*good[:5], float("nan"), *good[6:])), ("upscale", (*good[:13], 1.5, good[14]))]
    rows += [(100 + k, mode, *values) for k, (mode, values) in enumerate(bad)]
    nodes, links, rejected = workflow_templates.generated(spark.createDataFrame(rows, kind))
    assert sorted(r["reason"] for r in rejected.collect()) == sorted(["no such mode", "input_image is needed", "input_image and mask_image are needed", "width and height must be positive", "cfg_scale must be finite and not negative", "denoise must lie between 0 and 1"])
    ends = {(r["workflow"], r["id"]): r for r in nodes.collect()}
    wires = links.collect()
    assert len(ends) == sum(len(n) for n, _ in workflow_templates.TEMPLATES.values()) and len(wires) == sum(len(w) for _, w in workflow_templates.TEMPLATES.values())
    for w in wires:  # both ends know the wire, by slot and socket
        out, into = ends[w["workflow"], w["origin"]]["outputs"][w["origin_slot"]], ends[w["workflow"], w["target"]]["inputs"][w["target_slot"]]
        assert w["id"] in out["links"] and into["link"] == w["id"] and out["type"] == into["type"] == w["type"]
    assert all(i["link"] is not None for n in ends.values() for i in n["inputs"])
    assert ends[0, 2]["widgets_values"] == ['"a \\"cat\\""'] and ends[0, 3]["widgets_values"] == ["null"] and ends[0, 4]["widgets_values"] == ["512", "768", "1"]
    assert ends[1, 6]["widgets_values"] == ["3", "20", "7.5", '"euler"', '"normal"', "0.5"] and ends[0, 5]["widgets_values"][5] == "1.0"
    plain = nodes.withColumn("outputs", F.transform("outputs", lambda o: F.struct(o["name"], o["type"], o["links"])))
    assert workflow.problems(workflow.as_json(plain, links)).count() == 0


def test_no_side_of_problems_is_broadcast(spark):
    """The size of nodes and links is guessed from their compressed files, far too low, so the driver would hold all of them."""
    link = [[1, 1, 0, 2, 0, "A"], [1, 1, 0, 3, 0, "A"]]
    node = [{"id": 1, "inputs": [{"link": 7}], "outputs": [{"links": [1, 8]}]}, {"id": "2"}, {"id": 2}]
    rows = [(k, json.dumps({"nodes": node, "links": link})) for k in range(20)]
    found = workflow.problems(spark.createDataFrame(rows, "workflow long, json string"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = [("input_without_link", "1"), ("link_without_node", "1"), ("output_without_link", "1"), ("repeated_link", "1"), ("repeated_node", "2")]
    assert sorted(map(tuple, found.collect())) == [(k, *w) for k in range(20) for w in want]
