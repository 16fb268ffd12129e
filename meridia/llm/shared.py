"""Written tables, batches and forests for the corpus operators.

Lineage is cut with Parquet tables in the folder that ``spark.checkpoint.dir`` names, which the driver and all executors see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# the operators take these from here
from ..operators.graph import components  # noqa: F401
from ..operators.tables import fresh_path  # noqa: F401
from ..operators.tables import written as materialise  # noqa: F401


def map_batches(df: DataFrame, start, schema: str) -> DataFrame:
    """``mapInArrow`` over lists by column: ``start()`` is called once a task and gives the function of a batch."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        apply = start()
        for batch in batches:
            yield pa.RecordBatch.from_pydict(apply(batch.to_pydict()), schema=arrow)

    return df.mapInArrow(run, schema)


def summed(df: DataFrame, start, height: int, width: int) -> np.ndarray:
    """The sum over all batches of a (height, width) matrix: ``start()`` is called once a task and gives the function of a batch.

    Tasks add up their batches; Spark adds the parts by row of the matrix, so that only one matrix comes to the driver."""
    kind = "i int, y array<double>"

    def part(batches):
        apply, total = start(), np.zeros((height, width))
        for batch in batches:
            total += apply(batch)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(height), pa.int32()), "y": pa.array(list(total), pa.list_(pa.float64()))})

    def add(table: pa.Table) -> pa.Table:
        y = table.column("y").combine_chunks().flatten().to_numpy().reshape(-1, width).sum(axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "y": pa.array([y], pa.list_(pa.float64()))})

    found = df.mapInArrow(part, kind).groupBy("i").applyInArrow(add, kind).toArrow()
    out = np.zeros((height, width))
    out[found.column("i").to_numpy()] = np.array(found.column("y").to_pylist()).reshape(-1, width)
    return out


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast ``df`` only when its counted rows are within ``limit``; else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df


def forest(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that keep the components of the pairs (a, b), one less than vertices in each."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            yield x, y
