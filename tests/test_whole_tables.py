"""Queries that once took a part of their table, held against brute force over all of it."""

import math
from collections import Counter

import numpy as np
import pytest
from meridia.plans.registry import QUERIES


@pytest.fixture(scope="module")
def embeddings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    return {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in rows}


def brute_matches(embeddings, per_image=40):
    images = {}
    for i, e in embeddings.items():
        images.setdefault(i // per_image, {})[i % per_image] = sum(1 << k for k in range(62) if e[k] > 0)
    out = set()
    for image, left in images.items():
        right = images.get(image + 1, {})
        for a, word in left.items():
            d = sorted(((word ^ w).bit_count(), b) for b, w in right.items())
            if not d:
                continue
            best, b = d[0]
            second = min((x for x, _ in d if x > best), default=None)
            back = min(((w ^ right[b]).bit_count(), c) for c, w in left.items())[1]
            if back == a and best <= 30 and (second is None or best <= 0.95 * second):
                out.add((image, image + 1, a, b, best))
    return out


def test_all_features_are_matched(spark, sf_dir, embeddings):
    want = brute_matches(embeddings)
    names = ["left_image", "right_image", "left_feature", "right_feature", "distance"]
    got = {tuple(r) for r in QUERIES["match_binary_features"](spark, sf_dir).select(names).collect()}
    assert max(r[1] for r in want) > 200 // 40
    assert got == want
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for p, q, a, b, _ in want:
        x, y = sorted((find((p, a)), find((q, b))))
        parent[y] = x
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    good = {k: v for k, v in groups.items() if len({i for i, _ in v}) == len(v)}
    tracks = {(f"{k[0]}:{k[1]}", *x) for k, v in good.items() for x in v}
    assert {tuple(r) for r in QUERIES["build_tracks"](spark, sf_dir).select("track", "image_id", "feature").collect()} == tracks
    lengths = {r["length"]: r["n"] for r in QUERIES["track_length_histogram"](spark, sf_dir).collect()}
    assert lengths == Counter(map(len, good.values()))


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def brute_projection(embeddings):
    out = {}
    for i, e in embeddings.items():
        depth = e[2] + 1.2
        if depth > 1e-4:
            radius = min(max(math.exp(max(e[3:6]) - 3) * 20 / depth * 3, 1), 4096)
            out[i] = (20 * e[0] / depth + 12, 20 * e[1] / depth + 12, depth, radius)
    return out


def test_all_splats_are_projected_and_drawn(spark, sf_dir, embeddings):
    want = brute_projection(embeddings)
    rows = QUERIES["project_gaussian"](spark, sf_dir).select("idx", "u", "v", "depth", "radius").collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == {i: pytest.approx(x, rel=1e-6, abs=2e-6) for i, x in want.items()}
    drawn = {(r["px"], r["py"]): r for r in QUERIES["render_projected_splats"](spark, sf_dir).collect()}
    assert len(drawn) == 576
    far_first = sorted(want, key=lambda i: (-want[i][2], i))
    for px, py in [(0, 0), (12, 12), (5, 17), (23, 8)]:
        alpha = red = 0.0
        for i in far_first:
            u, v, _, radius = want[i]
            squared = (px - u) ** 2 + (py - v) ** 2
            if math.sqrt(squared) <= radius:
                e = embeddings[i]
                a = sigmoid(e[6] * 8) * math.exp(-0.5 * squared / radius**2)
                red = min(max(e[7] * 3 * 0.2820948 + 0.5, 0), 1) * a + red * (1 - a)
                alpha = a + alpha * (1 - a)
        assert (drawn[px, py]["r"], drawn[px, py]["alpha"]) == pytest.approx((red, alpha), abs=2e-5)


def test_projection_keeps_near_and_large_splats(spark):
    from meridia.functions.cameras import Intrinsics, Pose
    from meridia.functions.vectors import Vec
    from meridia.operators import splats

    columns = "idx long, x double, y double, z double, sx double, sy double, sz double, logit double, r double, g double, b double"
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.005, -9.0, -9.0, -9.0, 0.0, 0.5, 0.5, 0.5), (2, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0, 0.5, 0.5, 0.5)], columns)
    pose = Pose(Vec.of(0, 0, 0), Vec.of(1, 0, 0), Vec.of(0, 1, 0), Vec.of(0, 0, 1))
    got = {r["idx"]: r["radius"] for r in splats.project(rows, Intrinsics.of(24, 24, 20, 20, 12, 12), pose).collect()}
    assert got == {1: pytest.approx(max(math.exp(-9) * 20 / 0.005 * 3, 1)), 2: pytest.approx(math.exp(3) * 60)}


def test_every_event_is_a_workflow(spark, sf_dir):
    ids = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect())
    rows = lambda name, *columns: sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).select(*columns).collect())
    links = [(i, k) for i in ids for k in range(1, 2 + i % 3) for _ in range(2 if i % 5 == 0 and k == 1 else 1)]
    assert rows("workflow_links", "workflow", "id") == links
    lost = [(i, "link_without_node", str(1 + i % 3)) for i in ids if i % 4 == 0]
    assert [r for r in rows("workflow_validate", "workflow", "problem", "ref") if r[1] == "link_without_node"] == lost
    assert [r[0] for r in rows("observed_socket_types", "workflow")] == ids
    assert [r[0] for r in rows("prompt_links", "prompt")] == sorted(ids + [i for i in ids if i % 2 == 0])
    assert [r[0] for r in rows("workflow_assets", "workflow")] == sorted(ids * 2)
