"""Tables written to the shared folder, and places in an order over all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: bits of ``monotonically_increasing_id`` that number the rows of a partition (a fixed value)
ROW_BITS = 33


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir`` as a URI; a fresh local folder where it is unset (one machine only)."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="spark-meridia-")
        sc.setCheckpointDir(root)
    if ":/" not in root:
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, grouped by application so that it can be cleared as one."""
    return f"{shared_root(spark)}/meridia/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives the loss of executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast ``df`` only when its counted rows are within ``limit``; else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df


def by_ranges(rows: DataFrame, order: list[Column | str], size: Column) -> DataFrame:
    """``rows`` written in ranges of the order, with ``_part``, ``_row`` within it and ``_before``, the sizes of all parts before.

    No task holds more than a range: sizes are summed by part, and only these sums are summed up over all parts.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("_size", size), "ranges")
    ranged = ranged.withColumn("_part", F.shiftright("_at", ROW_BITS)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    # a row for each part
    sums = ranged.groupBy("_part").agg(F.sum("_size").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("_part", F.coalesce(before, F.lit(0)).alias("_before"), "_sum")
    return ranged.join(F.broadcast(sums), "_part")


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with their place from 0 in the order over all rows, as ``name``."""
    placed = by_ranges(rows, order, F.lit(1))
    return placed.withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_at", "_size", "_part", "_row", "_before", "_sum")
