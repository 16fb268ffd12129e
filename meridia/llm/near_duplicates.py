"""SimHash near-duplicates by deletion-variant signatures, and near copies by the similarity of their shingle sets.

Fingerprints of 64 bits link when they differ in at most ``distance`` (3) bits. They are cut into two halves, so
that of two linked fingerprints one half differs in at most one bit. Each half is indexed under its own value
and under the 32 variants with one bit struck out. Two halves that agree meet under their own value; two that differ in one bit
meet under the variant of that bit, on opposite sides of it. So an equality join of the 0-side with the 1-side (and
of the plain values) finds each half's candidates once, and the bit count of the whole decides.

Equal fingerprints are one vertex: copies, however many, never form pairs. A pair found through both halves is
listed once. Keys of halves that over ``HOT`` fingerprints share are not joined: their members are dealt into chunks, pairs of chunks
are compared in tasks of their own, and each gives back a spanning forest of its links instead of the links.

``one_of_each_similar`` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Such sets differ
in more bits of a SimHash than wildcards reach, so candidates are linked by their fingerprints, as above, or share a band of MinHash
values. Texts that hang together by either are a cluster; its members are dealt into chunks, and tasks compare the sets of pairs of chunks, each giving back a
spanning forest of the pairs that are similar. Texts with equal sets are one vertex.

Nulls and empty texts: a null text counts as empty; texts without words have fingerprint zero, which links like any other.
Rows with a null doc_id get a fingerprint and take part, but a class is named by its smallest doc_id that is not null.
Repeated rows are one row each. An empty table gives an empty result. Other columns are ignored. Where one row of a group
stays, rows that share a doc_id but not their text are judged apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprints import bands, set_id, shingles, signed, simhash
from .shared import broadcast_if_small, components, forest, map_batches, materialise

HALF = 32
#: fingerprints that share a half before its keys are taken apart, and members of a chunk of these
HOT, CHUNK = 512, 512
#: shingles of a chunk of a cluster of candidates, and of what a group compares, about
SHINGLES = 200_000
#: rows of one 64-bit id that are broadcast at most
BROADCAST_ROWS = 500_000


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, h, fp): h a hash of the text, fp the SimHash of the whole text as a signed 64-bit integer."""

    def start():
        def fingerprint(batch: dict) -> dict:
            prints = [simhash(t, width) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "h": batch["h"], "fp": [signed(p) for p in prints]}

        return fingerprint

    return map_batches(_slim(docs), start, "doc_id long, h long, fp long")


def _slim(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("h"), text.alias("text"))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _variants(half: Column, which: int) -> Column:
    """(key, side) of one half: its own value, and each value with one bit struck out, sided by that bit."""
    base = which * (HALF + 1)
    rows = [F.struct(F.lit(base + HALF).alias("slot"), half.alias("value"), F.lit(-1).alias("side"))]
    for bit in range(HALF):
        rest = half.bitwiseAND(F.lit(0xFFFFFFFF ^ 1 << bit))
        side = F.when(half.bitwiseAND(F.lit(1 << bit)) != 0, 1).otherwise(0)
        rows.append(F.struct(F.lit(base + bit).alias("slot"), rest.alias("value"), side.alias("side")))
    return F.array(*rows)


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b), a < b: pairs of distinct ``fp`` values that differ in at most ``distance`` bits (3 at most).

    All of them, but for pairs under crowded keys: of these, as many as join the same fingerprints into the same classes.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves with one variant bit find up to 3 differing bits")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", HALF)
    rows = prints.select("fp", F.explode(F.concat(_variants(low, 0), _variants(high, 1))).alias("v"))
    rows = rows.select("fp", "v.slot", "v.value", "v.side")
    halves = prints.select(F.explode(F.array(F.struct(F.lit(0).alias("which"), low.alias("half")), F.struct(F.lit(1).alias("which"), high.alias("half")))).alias("x"))
    crowded = materialise(halves.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("x.which", "x.half"), "crowded")
    n = crowded.count()
    forests = None
    if n:
        keys = F.when(F.col("which") == 0, _variants(F.col("half"), 0)).otherwise(_variants(F.col("half"), 1))
        keys = materialise(crowded.select(F.explode(keys).alias("k")).select("k.slot", "k.value").distinct(), "hot-keys")
        keys = broadcast_if_small(keys, n * (HALF + 1), BROADCAST_ROWS)
        forests = _forests(rows.join(keys, ["slot", "value"], "left_semi"), distance)
        rows = rows.join(keys, ["slot", "value"], "left_anti").select("fp", "slot", "value", "side")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance
    same = (F.col("x.slot") == F.col("y.slot")) & (F.col("x.value") == F.col("y.value"))
    zero, one = rows.where("side = 0").alias("x"), rows.where("side = 1").alias("y")
    # sizes after the explode are guessed far too low, so say that neither side is one to broadcast
    across = zero.join(one.hint("merge"), same & near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    plain = rows.where("side = -1")
    equal = plain.alias("x").join(plain.alias("y").hint("merge"), same & (F.col("x.fp") < F.col("y.fp")) & near)
    equal = equal.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    both = across.unionByName(equal)
    if forests is not None:
        both = both.unionByName(forests)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _forests(rows: DataFrame, distance: int) -> DataFrame:
    """(a, b): links that keep the classes of ``rows(slot, value, side, fp)``, found by pairs of chunks of each key's members.

    Under a variant the 0-side is compared with the 1-side, under a plain value all members with each other.
    """
    rows = materialise(rows, "hot-rows")
    place = ["slot", "value"]
    sizes = rows.groupBy(place).agg(*(F.count_if(F.col("side") == s).alias(f"n{k}") for k, s in enumerate((0, 1, -1))))
    rows = rows.join(sizes.where("(n0 > 0 AND n1 > 0) OR n2 > 1"), place)
    chunks = [F.greatest(F.ceil(F.col(f"n{k}") / CHUNK), F.lit(1)).cast("int") for k in range(3)]
    of = F.when(F.col("side") == 0, chunks[0]).when(F.col("side") == 1, chunks[1]).otherwise(chunks[2])
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fp"), of).cast("int"))
    others = F.when(F.col("side") == 0, chunks[1]).when(F.col("side") == 1, chunks[0]).otherwise(chunks[2])
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), others - 1)))
    left = F.when(F.col("side") == 0, F.col("chunk")).when(F.col("side") == 1, F.col("o")).otherwise(F.least("chunk", "o"))
    right = F.when(F.col("side") == 0, F.col("o")).when(F.col("side") == 1, F.col("chunk")).otherwise(F.greatest("chunk", "o"))
    rows = rows.select(*place, "fp", "side", "chunk", left.alias("i"), right.alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        fp, side, chunk = (table.column(c).to_numpy() for c in ("fp", "side", "chunk"))
        first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        at, to = (fp[side == 0], fp[side == 1]) if (side >= 0).any() else (fp[chunk == first], fp[chunk == second])
        x, y = np.nonzero(np.bitwise_count(at.view(np.uint64)[:, None] ^ to.view(np.uint64)[None]) <= distance)
        edges = [(a, b) for a, b in forest(at[x], to[y]) if a != b]
        a, b = zip(*edges) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return materialise(rows.groupBy(*place, "i", "j").applyInArrow(compare, "a long, b long").distinct(), "hot-links")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: component_id the smallest doc_id reachable by links."""
    return _near_groups(docs, width, distance).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("name.doc_id").alias("component_id")
    )


def _near_groups(docs: DataFrame, width: int, distance: int) -> DataFrame:
    """(doc_id, h, fp, name) per row: name the first (doc_id, h) of its class."""
    prints = materialise(with_fingerprints(docs, width), "fingerprints")
    vertices = _vertices(prints)
    names = materialise(_named(vertices, components(links(vertices.select("fp"), distance))), "classes")
    return prints.join(names, "fp")


def _vertices(prints: DataFrame) -> DataFrame:
    """(fp, first): each distinct fp with its first (doc_id, h), null where no row of it has a doc_id."""
    return materialise(prints.groupBy("fp").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("first")), "vertices")


def _named(vertices: DataFrame, classes: DataFrame) -> DataFrame:
    """(fp, name): each vertex with the first (doc_id, h) of all vertices of its class."""
    members = vertices.join(classes, vertices["fp"] == classes["id"]).select("fp", "first", "component_id")
    members = materialise(members, "members")
    named = materialise(members.groupBy("component_id").agg(F.min("first").alias("name")), "names")
    linked = members.join(named, "component_id").select("fp", "name")
    single = vertices.join(linked, "fp", "left_anti").select("fp", F.col("first").alias("name"))
    return linked.unionByName(single)


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) per row: component_id the smallest doc_id reachable over texts of that similarity.

    Candidates come by the links of ``near_duplicates`` and by MinHash bands; the sets decide.
    Bands are cut for a similarity of 0.8 or more; less is refused.
    """
    return _similar_groups(docs, width, similarity).select("doc_id", F.col("name.doc_id").alias("component_id"))


def _similar_groups(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, h, fp, name) per row: name the first (doc_id, h) of its class."""
    if similarity < 0.8:
        raise ValueError("the MinHash bands find similarities of 0.8 or more")
    slim = _slim(docs)

    def start():
        def sign(batch: dict) -> dict:
            sets = [shingles(t, width) for t in batch["text"]]
            signs = {"fp": [set_id(s) for s in sets], "size": [len(s) for s in sets], "keys": [bands(s) for s in sets]}
            return {"doc_id": batch["doc_id"], "h": batch["h"], "print": [signed(simhash(t)) for t in batch["text"]]} | signs

        return sign

    def start_sets():
        def take(batch: dict) -> dict:
            sets = [shingles(t, width) for t in batch["text"]]
            return {"fp": [set_id(s) for s in sets], "set": [s.view("int64") for s in sets]}

        return take

    prints = materialise(map_batches(slim, start, "doc_id long, h long, print long, fp long, size long, keys array<long>"), "bands")
    vertices = _vertices(prints)
    sizes = materialise(prints.groupBy("fp").agg(F.max("size").alias("size"), F.first("keys").alias("keys")), "sizes")
    # a text without words has fingerprint zero and no shingle to share
    near = materialise(prints.where("size > 0").select("fp", "print").distinct(), "prints")
    classes = components(links(near.select(F.col("print").alias("fp")).distinct()))
    near = near.join(classes, near["print"] == classes["id"], "left").select("fp", F.coalesce("component_id", "print").alias("key"))
    rows = sizes.select("fp", F.explode("keys").alias("key")).unionByName(near)
    # texts that share a band or a class of fingerprints hang together through the smallest of it: clusters hold all candidates
    low = rows.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").select("key", "a")
    clusters = components(rows.join(low, "key").where("a < fp").select("a", F.col("fp").alias("b")))
    members = materialise(_dealt(clusters.select(F.col("id").alias("fp"), F.col("component_id").alias("cluster")).join(sizes.select("fp", "size"), "fp")), "members")
    # the sets of the candidates alone, from one document of each; rows without a doc_id are all looked at
    wanted = members.select("fp").distinct()
    ids = vertices.join(wanted, "fp", "left_semi").where("first IS NOT NULL")
    ids = materialise(ids.select(F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_h")), "ids")
    ids = broadcast_if_small(ids, ids.count(), BROADCAST_ROWS)
    some = slim.join(ids, (slim["doc_id"] == ids["_id"]) & (slim["h"] == ids["_h"]), "left_semi").unionByName(slim.where("doc_id IS NULL"))
    sets = materialise(map_batches(some.select("text"), start_sets, "fp long, set array<long>").dropDuplicates(["fp"]), "sets")
    shingles_dealt = members.agg(F.sum("size")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(int(shingles_dealt // SHINGLES) + 1))
    dealt = members.join(sets.hint("merge"), "fp").withColumn("bucket", bucket)
    found = dealt.groupBy("bucket").applyInArrow(_similar_pairs(similarity), "a long, b long")
    names = materialise(_named(vertices, components(found)), "classes")
    return prints.drop("keys", "size", "print").join(names, "fp")


def _dealt(members: DataFrame) -> DataFrame:
    """``members(cluster, fp, size)`` with a chunk, once for each pair (i, j) of chunks of its cluster that it belongs to.

    A chunk has about ``CHUNK`` members or ``SHINGLES`` shingles at most, whatever the cluster.
    """
    sums = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / SHINGLES)).cast("int").alias("chunks"))
    rows = members.join(sums, "cluster").withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.select("cluster", "fp", "size", "chunk", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"))


def _similar_pairs(similarity: float):
    """For groups of many (cluster, i, j): a spanning forest of the pairs of chunk i and chunk j that are similar."""

    def shared(values: np.ndarray, sizes: np.ndarray, n: int, own: bool) -> np.ndarray:
        """How many shingles each of the first n sets shares with each of the others (or of the first n)."""
        out = np.zeros((n, n if own else len(sizes) - n), dtype=np.float32)
        _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        common = counts > 1
        keep = common[column]
        owner, column = owner[keep], (np.cumsum(common) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for at in range(0, int(common.sum()), 2048):
            part = slice(*np.searchsorted(column, [at, at + 2048]))
            held = np.zeros((len(sizes), 2048), dtype=np.float32)
            held[owner[part], column[part] - at] = 1
            out += held[:n] @ (held[:n] if own else held[n:]).T
        return out

    def run(table: pa.Table) -> pa.Table:
        cluster, i, j, chunk, fp = (table.column(c).to_numpy() for c in ("cluster", "i", "j", "chunk", "fp"))
        lists = table.column("set").combine_chunks()
        sizes, values = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        ends = np.cumsum(sizes)
        order = np.lexsort((chunk, j, i, cluster))
        keys = np.stack([cluster[order], i[order].astype(np.int64), j[order].astype(np.int64)])
        stops = np.append(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(0))[0] + 1, len(order)) if len(order) else []
        begin, ones, others = 0, [], []
        for stop in map(int, stops):
            rows, begin = order[begin:stop], stop
            own = i[rows[0]] == j[rows[0]]
            n = len(rows) if own else int((chunk[rows] == i[rows[0]]).sum())
            if n == 0 or (len(rows) < 2 if own else n == len(rows)):
                continue
            both = shared(np.concatenate([values[ends[r] - sizes[r] : ends[r]] for r in rows]), sizes[rows], n, own).astype(np.float64)
            left, right = rows[:n], rows if own else rows[n:]
            x, y = np.nonzero(both / (sizes[left][:, None] + sizes[right][None] - both) >= similarity)
            a, b = fp[left[x]], fp[right[y]]
            for p, q in forest(a[a != b], b[a != b]):
                ones.append(p)
                others.append(q)
        return pa.table({"a": pa.array(ones, pa.int64()), "b": pa.array(others, pa.int64())})

    return run


def one_of_each_group(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` that no other row precedes in their group, by doc_id and then by a hash of the text.

    Rows with a null doc_id stay. Of rows that share both doc_id and text the least by all columns stays. Rows that
    share a doc_id alone are judged apart. What goes is broadcast only if counted as at most ``BROADCAST_ROWS``.
    """
    return _one_of_each(docs, _near_groups(docs, width, distance))


def one_of_each_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """As ``one_of_each_group``, with groups of texts whose shingle sets are similar."""
    return _one_of_each(docs, _similar_groups(docs, width, similarity))


def _one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    groups = groups.where("doc_id IS NOT NULL").select(F.struct("doc_id", "h").alias("row"), "name")
    found = materialise(groups.groupBy("row").agg(F.count("*").alias("n"), F.first("name").alias("name")), "groups")
    goes = found.where("row <> name").select("row.*")
    repeats = found.where("row = name AND n > 1").select("row.*")
    # the row travels as one struct, so that no column of it can clash
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("h"))
    kept = rows.join(broadcast_if_small(goes, goes.count(), BROADCAST_ROWS), ["doc_id", "h"], "left_anti")
    n = repeats.count()
    if n:
        repeats = broadcast_if_small(repeats, n, BROADCAST_ROWS)
        once = kept.join(repeats, ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(F.min("row").alias("row"))
        kept = kept.join(repeats, ["doc_id", "h"], "left_anti").unionByName(once.select("doc_id", "h", "row"))
    return kept.select("row.*")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs)
