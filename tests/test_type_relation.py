"""Assignability against a plain recursion over random nested types, and types that hold themselves."""

import random

import pytest

from meridia.operators import type_relation

TYPES = "id string, kind string, semantic string, media string, least int, most int, open boolean"
PARTS = "id string, name string, part string, required boolean"
PAIRS = "source string, target string"


def plain(s, t, types, parts):
    """The rules as they read, for types that don't hold themselves."""
    a, b = types[s], types[t]
    go = lambda x, y: plain(x, y, types, parts)
    if b["kind"] == "any":
        return True
    if b["kind"] == "union":
        return any(go(s, v) for _, v, _ in parts[t])
    if a["kind"] == "union":
        return all(go(v, t) for _, v, _ in parts[s])
    if a["kind"] == "any" or a["kind"] != b["kind"]:
        return False
    says = lambda x: b[x] is None or a[x] == b[x]
    if a["kind"] in ("string", "binary"):
        return says("semantic") and (a["kind"] == "string" or says("media"))
    if a["kind"] == "array":
        short = b["most"] is None or (a["most"] is not None and a["most"] <= b["most"])
        return go(parts[s][0][1], parts[t][0][1]) and (a["least"] or 0) >= (b["least"] or 0) and short
    if a["kind"] == "object":
        own, other = {n: v for n, v, _ in parts[s]}, {n: (v, r) for n, v, r in parts[t]}
        fields = all(go(own[n], v) if n in own else not r for n, (v, r) in other.items())
        return says("semantic") and fields and (b["open"] or (not a["open"] and set(own) <= set(other)))
    return True


def rows(types, parts):
    return [(i, *(t[c] for c in ("kind", "semantic", "media", "least", "most", "open"))) for i, t in types.items()], [(i, n, v, r) for i, found in parts.items() for n, v, r in found]


def test_equals_a_plain_recursion(spark):
    rng = random.Random(5)
    types, parts = {}, {}
    for k in range(70):
        kind = rng.choice(["any", "null", "boolean", "number", "string", "string", "binary"] if k < 14 else ["array", "object", "object", "union", "string"])
        some = lambda values: rng.choice([None, *values])
        types[f"t{k}"] = {"kind": kind, "semantic": some(["x", "y"]), "media": some(["m", "n"]), "least": some([0, 1, 2]), "most": some([2, 3]), "open": rng.random() < 0.5}
        below = list(types)[:k]
        if kind == "array":
            parts[f"t{k}"] = [(None, rng.choice(below), True)]
        elif kind == "union":
            parts[f"t{k}"] = [(None, v, True) for v in rng.sample(below, rng.randint(0, 3))]
        elif kind == "object":
            parts[f"t{k}"] = [(n, rng.choice(below), rng.random() < 0.5) for n in rng.sample("abc", rng.randint(0, 3))]
        parts.setdefault(f"t{k}", [])
    own, held = rows(types, parts)
    pairs = [(s, t) for s in types for t in types]
    got = type_relation.assignable(spark.createDataFrame(own, TYPES), spark.createDataFrame(held, PARTS), spark.createDataFrame(pairs, PAIRS))
    want = {(s, t, plain(s, t, types, parts)) for s, t in pairs}
    assert set(map(tuple, got.collect())) == want and 200 < sum(w[2] for w in want) < 4000


@pytest.mark.parametrize(("inner", "fits"), [("number", True), ("string", False)])
def test_types_that_hold_themselves(spark, inner, fits):
    types = [("list", "object", None, None, None, None, False), ("other", "object", None, None, None, None, False), ("n", "number", None, None, None, None, False), ("m", inner, None, None, None, None, False)]
    parts = [("list", "value", "n", True), ("list", "rest", "list", False), ("other", "value", "m", True), ("other", "rest", "other", False)]
    wanted = [("list", "other"), ("list", "other"), ("list", "gone"), (None, "list")]
    got = type_relation.assignable(spark.createDataFrame(types, TYPES), spark.createDataFrame(parts, PARTS), spark.createDataFrame(wanted, PAIRS))
    assert list(map(tuple, got.collect())) == [("list", "other", fits)]
    assert type_relation.assignable(spark.createDataFrame(types, TYPES), spark.createDataFrame(parts, PARTS), spark.createDataFrame([], PAIRS)).count() == 0
