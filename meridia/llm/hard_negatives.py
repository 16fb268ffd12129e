"""Hard-negative mining by dual-tree search for inner products.

Rows are filed under a tree of half-spaces (principal directions and medians of a bounded sample of at most ``sample_values``
entries); every row goes to a block of it, with its label, and crowded blocks are cut into chunks. Blocks and inner nodes of the
tree know their rows' centre and radius, so that two nodes with centres a, c and radii r, s bound all inner products between their
rows by ac - (r|c| + s|a| + rs) and ac + (r|c| + s|a| + rs). There is a tree over candidates and one over anchors. Pairs of nodes go
down both at once, by equality joins of parents with children, and a pair is dropped for all anchors of the node together:

- looking for positives, when enough rows of other nodes are certain to score more than its upper bound;
- looking for negatives, when no score within its bounds can lie in a window of one of the anchors, or both have one label.

Pairs of blocks that are left are scored exactly, as whole numbers: first the few of highest bound for each block of anchors, whose
results give a limit for the rest; then the others that can still reach it, a group of ``group`` blocks a task, from the highest
bound down. A task gives back only its best rows for each anchor.

Rows with a null vec_id, label or vector, with a null or non-finite entry, or with entries so large that inner products of such rows don't
fit a long take no part. Vectors of different lengths never meet. Of equal vectors of one label only as many rows as a result can
name are compared, those of the smallest ids; the others could never be chosen. Rows that repeat are rows of their own: a copy of an anchor is
another row. Ties go to the smaller vec_id. No anchors, or no rows, give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, materialise

MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
BLOCKS = "block string, label_from long, label_to long, n long, centre array<double>, radius double, low long, high long, rids binary, ids binary, labels binary, x binary, lows binary, highs binary"
FOUND = "a string, anchor long, window int, score long, id long, rid long, limit long"
LEAST, MOST = -(2**62), 2**62
#: bits of the tree by which a step goes down
STEP = 3


def entry_limit(dim: int) -> int:
    """The largest entry for which all inner products fit a long and entries fit 32 bits."""
    return min(int(((2**63 - 1) / dim) ** 0.5), 2**31 - 1)


def whole_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """(rid, vec_id, label, dim, x, anchor) of the rows of ``vectors(vec_id, label, embedding, anchor)`` that take part."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
        F.coalesce(F.col("anchor"), F.lit(False)).alias("anchor"),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)).withColumn("dim", F.size("v"))
    most = F.least(F.floor(F.sqrt(F.lit(float(2**63 - 1)) / F.col("dim"))).cast("double"), F.lit(float(2**31 - 1)))
    inside = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.floor(F.least(F.greatest(c * scale, F.lit(-1e15)), F.lit(1e15)))) <= most))
    rows = rows.where(F.coalesce(inside, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "dim", F.transform("v", lambda c: F.floor(c * scale).cast("int")).alias("x"), "anchor")


def _split(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and limits of the inner nodes of a tree of that depth, in heap order."""
    directions, limits = np.zeros((2**depth - 1, x.shape[1])), np.zeros(2**depth - 1)
    parts = {0: x.astype(np.float64)}
    for node in range(2**depth - 1):
        part = parts.pop(node)
        if len(part):
            z = part - part.mean(axis=0)
            d = z[np.argmax((z * z).sum(axis=1))]
            for _ in range(4):
                d = z.T @ (z @ d)
                d = d / (np.linalg.norm(d) or 1.0)
            directions[node], limits[node] = d, np.median(part @ d)
        right = part @ directions[node] > limits[node]
        parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]
    return directions, limits


def filed(rows: DataFrame, tree: tuple[np.ndarray, np.ndarray], depth: int) -> DataFrame:
    """``rows`` with ``path``, the number of their leaf."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        directions, limits = sent.value
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(np.float64)
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, directions[node]) > limits[node])
            yield batch.append_column("path", pa.array(node - (2**depth - 1)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, path long")


def _pack(dim: int):
    def bounds(lists: pa.ChunkedArray) -> np.ndarray:
        return np.array(lists.to_pylist(), dtype=np.int64)

    def run(table: pa.Table) -> pa.Table:
        # ids ascend within a block, so that the first of equal scores is the smaller id
        table = table.sort_by([("vec_id", "ascending"), ("rid", "ascending")])
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.int32)
        labels, centre = table.column("label").to_numpy(), x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()) * (1 + 1e-12)
        lows, highs = bounds(table.column("lows")), bounds(table.column("highs"))
        return pa.table(
            {
                "block": table.column("block").slice(0, 1), "label_from": [labels.min()], "label_to": [labels.max()], "n": [len(x)], "centre": [centre], "radius": [radius],
                "low": [lows.min()], "high": [highs.max()],
                "rids": [table.column("rid").to_numpy().tobytes()], "ids": [table.column("vec_id").to_numpy().tobytes()], "labels": [labels.tobytes()], "x": [x.tobytes()], "lows": [lows.tobytes()], "highs": [highs.tobytes()],
            }
        )

    return run


def blocks(rows: DataFrame, depth: int, block_rows: int, by_label: bool, dim: int, name: str) -> DataFrame:
    """``rows(rid, vec_id, label, x, path, lows, highs)`` as BLOCKS of about ``block_rows`` rows, with root, own depth and prefix."""
    if by_label:
        rows = rows.withColumn("root", F.col("label").cast("string"))
        sizes = materialise(rows.groupBy("root").agg(F.count("*").alias("size")), "roots")
        rows = rows.join(broadcast_if_small(sizes, sizes.count(), 100_000), "root")
    else:
        rows = rows.withColumns({"root": F.lit("all"), "size": F.lit(rows.count())})
    own = F.least(F.greatest(F.ceil(F.log2(F.col("size") / block_rows)), F.lit(0)), F.lit(depth)).cast("int")
    rows = rows.withColumn("own", own).withColumn("prefix", F.expr(f"shiftright(path, {depth} - own)"))
    crowds = materialise(rows.groupBy("root", "prefix").agg(F.count("*").alias("crowd")), "crowds")
    rows = rows.join(broadcast_if_small(crowds, crowds.count(), 100_000), ["root", "prefix"])
    chunk = F.pmod(F.xxhash64("rid"), F.ceil(F.col("crowd") / (2 * block_rows)))
    rows = rows.withColumn("block", F.concat_ws("/", F.lit("block"), "root", "own", "prefix", chunk.cast("string")))
    packed = rows.select("block", "rid", "vec_id", "label", "x", "lows", "highs").groupBy("block").applyInArrow(_pack(dim), BLOCKS)
    part = lambda k: F.element_at(F.split("block", "/"), k)
    return materialise(packed.withColumns({"root": part(2), "own": part(3).cast("int"), "prefix": part(4).cast("long")}), name)


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def nodes(packed: DataFrame, by_root: bool, dim: int, name: str) -> DataFrame:
    """(parent, node, leaf, n, centre, radius, label_from, label_to, low, high): each node under its parent, blocks as leaves, which also are under
    themselves; the topmost nodes have a null parent. ``by_root``: one topmost node for each root."""
    top = F.col("root") if by_root else F.lit("")
    levels = F.sequence(F.lit(0), F.greatest(F.col("own") - 1, F.lit(0)), F.lit(STEP))
    chain = F.transform(levels, lambda k: F.concat_ws("/", F.lit("node"), top, k.cast("string"), F.call_function("shiftright", F.col("prefix"), F.col("own") - k).cast("string")))
    facts = ["n", "centre", "radius", "label_from", "label_to", "low", "high"]
    below = materialise(packed.select("block", chain.alias("chain"), *facts), f"{name}-chains")
    each = below.select(F.posexplode("chain").alias("at", "node"), "chain", *facts)
    parent = F.when(F.col("at") > 0, F.element_at("chain", F.col("at")))
    middle = each.groupBy("node").agg(
        F.first(parent).alias("parent"), F.sum("n").alias("m"), *(F.sum(F.col("n") * F.col("centre")[k]).alias(f"s{k}") for k in range(dim))
    )
    middle = middle.select("node", "parent", F.transform(F.array(*(f"s{k}" for k in range(dim))), lambda s: s / F.col("m")).alias("middle"))
    middle = materialise(middle, f"{name}-middles")
    inner = each.join(middle.select("node", "middle"), "node").groupBy("node").agg(
        F.sum("n").alias("n"), F.max(F.col("radius") + _distance("centre", "middle")).alias("radius"),
        F.min("label_from").alias("label_from"), F.max("label_to").alias("label_to"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    inner = inner.join(middle, "node").select("parent", "node", F.lit(False).alias("leaf"), "n", F.col("middle").alias("centre"), "radius", *facts[3:])
    leaves = below.select(F.explode(F.array(F.element_at("chain", -1), F.col("block"))).alias("parent"), F.col("block").alias("node"), F.lit(True).alias("leaf"), *facts)
    return materialise(inner.unionByName(leaves), name)


def _side(tree: DataFrame, side: str) -> DataFrame:
    return tree.select(*(F.col(c).alias(f"{side}_{c}") for c in tree.columns))


def meeting(anchors: DataFrame, candidates: DataFrame, depth: int, certain: int, same_label: bool) -> DataFrame:
    """(a, c, upper) of the pairs of blocks that may hold a result. ``certain``: rows that must be sure to score more before a pair is
    dropped by its upper bound; 0: no such rule."""
    a, c = _side(anchors, "a"), _side(candidates, "c")
    middle = F.aggregate(F.zip_with("a_centre", "c_centre", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    reach = F.col("a_radius") * norm("c_centre") + F.col("c_radius") * norm("a_centre") + F.col("a_radius") * F.col("c_radius")
    slack = F.lit(0.01) + F.lit(1e-9) * (F.abs(F.col("middle")) + F.col("reach"))
    keep = ["a_node", "c_node", "a_leaf", "c_leaf", "upper"]
    pairs = None
    for _ in range(-(-depth // STEP) + 2):
        if pairs is None:
            own = F.substring_index("a_node", "/", 2) == F.substring_index("c_node", "/", 2)
            both = a.where("a_parent IS NULL").join(c.where("c_parent IS NULL"), own)
        else:
            both = pairs.select(F.col("a_node").alias("a_parent"), F.col("c_node").alias("c_parent")).join(a, "a_parent").join(c, "c_parent")
        both = both.withColumn("middle", middle).withColumn("reach", reach)
        both = both.withColumn("upper", F.col("middle") + F.col("reach") + slack).withColumn("lower", F.col("middle") - F.col("reach") - slack)
        both = both.where("upper >= a_low AND lower <= a_high")
        if not same_label:
            both = both.where("NOT (a_label_from = a_label_to AND c_label_from = c_label_to AND a_label_from = c_label_from)")
        if certain:
            ahead = F.sum("c_n").over(Window.partitionBy("a_node").orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, 0))
            both = both.withColumn("ahead", ahead)
            limit = F.max(F.when(F.col("ahead") >= certain, F.col("lower"))).over(Window.partitionBy("a_node"))
            both = both.withColumn("limit", limit).where("limit IS NULL OR upper >= limit")
        pairs = materialise(both.select(*keep), "node-pairs")
        if pairs.where("NOT a_leaf OR NOT c_leaf").isEmpty():
            break
    return pairs.select(F.col("a_node").alias("a"), F.col("c_node").alias("c"), "upper")


def _scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole inner products, by floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ c.astype(np.int64).T


def _firsts(anchor, score, vec_id, rid, k: int) -> np.ndarray:
    """Places of the first ``k`` of each anchor by falling score, then id."""
    order = np.lexsort((rid, vec_id, -score, anchor))
    who = anchor[order]
    begins = np.append(True, who[1:] != who[:-1])
    place = np.arange(len(who)) - np.maximum.accumulate(np.where(begins, np.arange(len(who)), 0))
    return order[place < k]


def _best(k: int, same_label: bool, dim: int):
    """The best rows of a group of pairs of blocks that share their anchors, for each anchor and window."""

    def block(row: dict, side: str) -> tuple[np.ndarray, ...]:
        x = np.frombuffer(row[f"{side}_x"], dtype=np.int32).reshape(-1, dim)
        return x, *(np.frombuffer(row[f"{side}_{n}"], dtype=np.int64) for n in ("rids", "ids", "labels"))

    def rows_of(table: pa.Table) -> Iterator[dict]:
        for at in range(len(table)):
            yield {c: table.column(c)[at].as_py() for c in table.column_names}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("upper", "descending")])
        first = {c: table.column(c)[0].as_py() for c in table.column_names}
        x, rids, _, labels = block(first, "a")
        lows, highs = (np.frombuffer(first[f"a_{n}"], dtype=np.int64).reshape(len(x), -1) for n in ("lows", "highs"))
        windows = lows.shape[1]
        # least[i, w]: what a score must reach to be among the best of anchor i and window w
        least, none = lows.copy(), np.zeros(0, dtype=np.int64)
        held = [tuple(none for _ in range(4)) for _ in range(windows)]
        for row in rows_of(table.drop_columns(["a"])):
            if row["upper"] < least[lows <= highs].min(initial=MOST):
                break
            cx, c_rids, c_ids, c_labels = block(row, "c")
            scores = _scores(x, cx)
            fit = (c_labels[None, :] == labels[:, None]) == same_label
            fit &= c_rids[None, :] != rids[:, None]
            for w in range(windows):
                good = fit & (scores >= least[:, w : w + 1]) & (scores <= highs[:, w : w + 1])
                i, j = np.nonzero(good)
                if not len(i):
                    continue
                found = i, scores[i, j], c_ids[j], c_rids[j]
                # most fall out within the block; then what is left meets what was held
                found = tuple(f[_firsts(*found, k)] for f in found) if len(i) > k * len(x) else found
                both = tuple(np.concatenate(p) for p in zip(held[w], found))
                both = tuple(b[_firsts(*both, k)] for b in both)
                held[w] = both
                full = np.bincount(both[0], minlength=len(x)) >= k
                last = np.full(len(x), MOST)
                np.minimum.at(last, both[0], both[1])
                least[full, w] = np.maximum(lows[full, w], last[full])
        anchor = np.concatenate([rids[h[0]] for h in held])
        size = len(anchor)
        limit = int(least[lows <= highs].min(initial=MOST))
        out = {
            "a": [first["a"]] * (size + 1), "anchor": [*anchor.tolist(), None], "window": [*np.repeat(np.arange(windows), [len(h[0]) for h in held]).tolist(), None],
            **{name: [*np.concatenate([h[p] for h in held]).tolist(), None] for p, name in ((1, "score"), (2, "id"), (3, "rid"))},
            "limit": [None] * size + [limit],
        }
        kinds = {"a": pa.string(), "window": pa.int32()}
        return pa.table({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()})

    return run


def best(pairs: DataFrame, anchors: DataFrame, candidates: DataFrame, k: int, same_label: bool, dim: int, ahead: int = 4, group: int = 32) -> DataFrame:
    """(anchor, window, score, id, rid, place): the first ``k`` rows of each anchor and window, place from 1."""
    a = anchors.select(F.col("block").alias("a"), *(F.col(c).alias(f"a_{c}") for c in ("x", "rids", "ids", "labels", "lows", "highs")))
    c = candidates.select(F.col("block").alias("c"), *(F.col(n).alias(f"c_{n}") for n in ("x", "rids", "ids", "labels")))

    def scored(some: DataFrame, key: Column, name: str) -> DataFrame:
        full = some.withColumn("bucket", key).join(a, "a").join(c, "c").drop("c", "place")
        return materialise(full.groupBy("a", "bucket").applyInArrow(lambda t: _best(k, same_label, dim)(t.drop_columns(["bucket"])), FOUND), name)

    order = Window.partitionBy("a").orderBy(F.desc("upper"), "c")
    first = materialise(pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ahead), "first-pairs")
    one = scored(first, F.lit(0), "first-found")
    limits = one.where("limit IS NOT NULL").select("a", "limit")
    rest = pairs.join(first.select("a", "c"), ["a", "c"], "left_anti").join(limits, "a").where("upper >= limit").drop("limit")
    # what stands near in the order of bounds meets in one task, so that its highest raise the bar for the others
    rest = rest.withColumn("place", F.row_number().over(order))
    two = scored(rest, F.floor((F.col("place") - 1) / group), "rest-found")
    found = one.unionByName(two).where("anchor IS NOT NULL").drop("a", "limit")
    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "rid"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _mined(rows: DataFrame, dim: int, n: int, positives: int, negatives: int, low: int, high: int, block_rows: int, anchor_rows: int, max_depth: int, sample_values: int) -> DataFrame:
    depth = min(max_depth, int(np.log2(max(1, sample_values // dim))), max(0, int(np.ceil(np.log2(max(1, n / block_rows))))))
    share = min(1.0, sample_values / dim / n)
    some = rows.where(F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).select("x").toArrow()
    x = some.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    rows = materialise(filed(rows, _split(x, depth), depth), "filed-rows")
    keep = max(positives + 1, negatives)
    copies = F.row_number().over(Window.partitionBy("label", "x").orderBy("vec_id", "rid"))
    open_window = {"lows": F.array(F.lit(LEAST)), "highs": F.array(F.lit(MOST))}
    candidates = rows.withColumn("copy", copies).where(F.col("copy") <= keep).withColumns(open_window)
    candidates = blocks(candidates, depth, block_rows, True, dim, "candidate-blocks")
    anchors = rows.where("anchor")
    labelled = blocks(anchors.withColumns(open_window), depth, anchor_rows, True, dim, "anchor-blocks")
    pairs = meeting(nodes(labelled, True, dim, "anchor-nodes"), nodes(candidates, True, dim, "candidate-nodes"), depth, positives + 1, True)
    found = materialise(best(pairs, labelled, candidates, positives, True, dim), "positives")
    percent = lambda p: F.col("score").cast("decimal(20,0)") * p / 100
    windows = found.select(
        "anchor", (F.col("place") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.ceil(percent(low)).cast("long").alias("from"), F.floor(percent(high)).cast("long").alias("to"),
    )
    windows = materialise(windows.where("from <= to"), "windows")
    # at most ``positives`` windows an anchor; where there are fewer, empty ones take their place
    wide = windows.groupBy(F.col("anchor").alias("rid")).agg(
        *(F.coalesce(F.max(F.when(F.col("window") == w, F.col(side))), F.lit(none)).alias(f"{side}{w}") for w in range(positives) for side, none in (("from", MOST), ("to", LEAST)))
    )
    wide = wide.select("rid", F.array(*(f"from{w}" for w in range(positives))).alias("lows"), F.array(*(f"to{w}" for w in range(positives))).alias("highs"))
    mixed = blocks(anchors.join(wide, "rid"), depth, anchor_rows, False, dim, "window-blocks")
    pairs = meeting(nodes(mixed, False, dim, "window-nodes"), nodes(candidates, False, dim, "all-nodes"), depth, 0, False)
    chosen = best(pairs, mixed, candidates, negatives, False, dim)
    names = anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = chosen.join(windows, ["anchor", "window"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(
    vectors: DataFrame,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    block_rows: int = 1024,
    anchor_rows: int = 512,
    max_depth: int = 12,
    sample_values: int = 1 << 20,
) -> DataFrame:
    """For each anchor of ``vectors(vec_id, label, embedding, anchor)`` and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels that score from ``low`` to ``high`` percent of the positive: columns ``MINED``."""
    rows = materialise(whole_rows(vectors, scale), "mined-rows")
    parts = []
    # a row for each length of vectors
    for dim, n in sorted(map(tuple, rows.groupBy("dim").count().collect())):
        some = rows.where(F.col("dim") == dim).drop("dim")
        parts.append(_mined(some, dim, n, positives, negatives, low, high, block_rows, anchor_rows, max_depth, sample_values))
    return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], MINED)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding", (F.col("vec_id") % 50 == 0).alias("anchor")))
