"""Near-duplicate embeddings by lattice hashing on E8.

Vectors are scaled to length 1 and projected by several Gaussian matrices to 8 dimensions; each projection is
decoded to its nearest E8 lattice point, the cell of the vector in that table. A vector is filed in its own cell and
also looks into the neighbouring cells nearest to it. Two vectors are compared if they meet in a cell that is the own cell
of one of them, within equal labels, and linked if their cosine in double precision is at least ``threshold``.

Equal vectors of a label are one class with a count, so copies form no pairs. A cell's members are compared in
chunks of about ``chunk``: chunk pairs are compared apart, so a crowded cell is many small pieces of work; pieces are dealt
into groups of about ``rows_at_once`` rows. A group gives back only sums and spanning forests, never its pairs: a link that is found in several tables or cells
counts only in the first, which each group can tell from the cells its members carry.

Not linked: null labels, and vectors that are null, empty, zero or hold null or non-finite components; they are
classes of their own. Vectors of different lengths are never compared. Rows with a null vec_id count as links of
others but can't name a component. Repeated rows are copies. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lattice import cell_ids, cells, projections
from .shared import components, forest, materialise

SIGNED = "label int, rep long, n long, unit array<double>, own array<long>, near array<array<long>>"
FOUND = "kind int, a long, b long"


def _signatures(tables: int, probes: int, scale: float, seed: int):
    def run(batches):
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.to_pydict()
            by_dim: dict[int, list[int]] = {}
            for k, v in enumerate(rows["v"]):
                by_dim.setdefault(len(v), []).append(k)
            for dim, at in by_dim.items():
                if dim not in made:
                    made[dim] = projections(dim, tables, scale, seed)
                x = np.array([rows["v"][k] for k in at], dtype=np.float64)
                x /= np.abs(x).max(axis=1)[:, None]
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                ids = np.stack([cell_ids(cells(x @ made[dim][t], probes)) for t in range(tables)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows["label"][k] for k in at], pa.int32()),
                        pa.array([rows["rep"][k] for k in at], pa.int64()),
                        pa.array([rows["n"][k] for k in at], pa.int64()),
                        pa.array(list(x), pa.list_(pa.float64())),
                        pa.array(list(ids[:, :, 0]), pa.list_(pa.int64())),
                        pa.array(ids[:, :, 1:].tolist(), pa.list_(pa.list_(pa.int64()))),
                    ],
                    names=["label", "rep", "n", "unit", "own", "near"],
                )

    return run


def _meet(own_x, near_x, own_y, near_y) -> np.ndarray:
    """For each pair and table: whether the two meet in a cell that one of them owns."""
    return (own_x == own_y) | (near_x == own_y[:, :, None]).any(2) | (near_y == own_x[:, :, None]).any(2)


def _numbers(column: pa.ChunkedArray, *shape: int) -> np.ndarray:
    """A column of lists, of lists of numbers or numbers, as one array of that shape."""
    values = column.combine_chunks()
    while pa.types.is_list(values.type):
        values = values.flatten()
    return values.to_numpy(zero_copy_only=False).reshape(shape)


def _compare(threshold: float, tables: int):
    """Links within each (label, dim, t, cell, i, j) of a group of many such cells."""

    def cell_links(t, cell, same, unit, rep, n, left, right, own, near):
        p, q = np.nonzero(unit[left] @ unit[right].T >= threshold - 1e-9)
        p, q = left[p], right[q]
        if same:
            keep = rep[p] < rep[q]
            p, q = p[keep], q[keep]
        if not len(p):
            return p, q
        # exactly as one pair would be computed, and each pair once
        good = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
        good &= (own[p, t] == cell) | (own[q, t] == cell)
        p, q = p[good], q[good]
        # only the first table counts, and in it the own cell of the smaller id before that of the larger
        meets = _meet(own[p], near[p], own[q], near[q])
        small, large = np.where(rep[p] < rep[q], p, q), np.where(rep[p] < rep[q], q, p)
        home = own[small, t]
        at_home = (own[large, t] == home) | (near[large, t] == home[:, None]).any(1)
        here = ~meets[:, :t].any(1) & (cell == np.where(at_home, home, own[large, t]))
        return p[here], q[here]

    def run(table: pa.Table) -> pa.Table:
        ones, others = [], []
        degrees: dict[int, int] = {}
        for dim in np.unique(table.column("dim").to_numpy()).tolist():
            part = table.filter(pc.equal(table.column("dim"), dim))
            size = len(part)
            unit, own = _numbers(part.column("unit"), size, dim), _numbers(part.column("own"), size, tables)
            near = _numbers(part.column("near"), size, tables, -1)
            label, t, cell, i, j, chunk, rep, n = (part.column(c).to_numpy() for c in ("label", "t", "cell", "i", "j", "chunk", "rep", "n"))
            order = np.lexsort((chunk, j, i, cell, t, label))
            keys = np.stack([c[order].astype(np.int64) for c in (label, t, cell, i, j)])
            ends = np.append(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(0))[0] + 1, size)
            begin = 0
            for end in ends.tolist():
                rows, begin = order[begin:end], end
                at = rows[0]
                left, right = rows[chunk[rows] == i[at]], rows[chunk[rows] == j[at]]
                p, q = cell_links(t[at], cell[at], i[at] == j[at], unit, rep, n, left, right, own, near)
                if not len(p):
                    continue
                for a, b in ((p, q), (q, p)):
                    for r, k in zip(rep[a].tolist(), n[b].tolist()):
                        degrees[r] = degrees.get(r, 0) + k
                a, b = zip(*forest(rep[p], rep[q]))
                ones += a
                others += b
        return pa.table(
            {
                "kind": pa.array([0] * len(degrees) + [1] * len(ones), pa.int32()),
                "a": pa.array([*degrees, *ones], pa.int64()),
                "b": pa.array([*degrees.values(), *others], pa.int64()),
            }
        )

    return run


def embedding_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    tables: int = 5,
    probes: int = 2,
    scale: float = 2.0,
    seed: int = 7,
    chunk: int = 512,
    rows_at_once: int = 4096,
) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    ``scale`` is how far a step of length 1 moves in a projection, against a packing radius of 0.707: with 2.0 the
    pairs at cosine 0.98 (0.2 apart) nearly always share or neighbour a cell in one of the tables.
    """
    finite = F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("v"),
        F.col("label").cast("int").alias("label"),
    ).withColumn("ok", finite & F.col("label").isNotNull())
    good = rows.where("ok").select("vec_id", "label", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    # classes of equal vectors; rep numbers them and is fixed by writing the table
    classes = good.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    signed = classes.select("label", "rep", "n", "v").mapInArrow(_signatures(tables, probes, scale, seed), SIGNED)
    signed = materialise(signed, "signatures")
    filed = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(tables - 1)),
            lambda t: F.transform(
                F.concat(F.array(F.element_at("own", t + 1)), F.element_at("near", t + 1)),
                lambda c: F.struct(t.alias("t"), c.alias("cell")),
            ),
        )
    )
    files = signed.select("label", F.size("unit").alias("dim"), "rep", F.explode(filed).alias("f"))
    files = files.select("label", "dim", "rep", F.col("f.t").alias("t"), F.col("f.cell").alias("cell"))
    place = ["label", "dim", "t", "cell"]
    sizes = files.groupBy(place).agg(F.count("*").alias("members")).where("members > 1")
    sizes = materialise(sizes, "cells")
    files = materialise(files, "filed").join(sizes, place)
    chunks = F.ceil(F.col("members") / chunk).cast("int")
    files = files.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    # every chunk pair (i <= j) that the member belongs to
    pair = F.transform(
        F.expr("sequence(0, chunks - 1)"),
        lambda o: F.struct(F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j")),
    )
    files = files.select(*place, "rep", "chunk", F.explode(pair).alias("p")).select(*place, "rep", "chunk", "p.i", "p.j")
    members = files.join(signed.drop("label"), "rep")
    # a group takes many cells: of about ``rows_at_once`` rows, and of one pair of chunks at least
    copies = sizes.agg(F.sum(F.col("members") * F.ceil(F.col("members") / chunk))).first()[0] or 0
    bucket = F.pmod(F.xxhash64(*place, "i", "j"), F.lit(-(-copies // rows_at_once) or 1))
    members = members.withColumn("bucket", bucket)
    found = members.groupBy("bucket").applyInArrow(_compare(threshold, tables), FOUND)
    found = materialise(found, "found")
    degrees = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    stars = components(found.where("kind = 1").select("a", "b"))
    linked = classes.select("rep", "first", "n").join(degrees, "rep", "left").join(
        stars.withColumnRenamed("id", "rep"), "rep", "left"
    )
    linked = materialise(linked.withColumn("component", F.coalesce("component_id", "rep")), "linked")
    names = linked.groupBy("component").agg(F.min("first").alias("name"))
    linked = linked.join(materialise(names, "names"), "component")
    linked = linked.select("rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "name")
    by_vector = materialise(classes.select("rep", "label", "v").join(linked, "rep").drop("rep"), "by-vector")
    out = good.join(by_vector, ["label", "v"]).select("vec_id", "n_links", F.col("name").alias("component_id"))
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return out.unionByName(alone).withColumn("kept", kept)


def op6_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
