"""Domain tables lifted from the benchmark tables, and the same lifts in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HALF = 0.02


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, x, y, z): the first three components of each embedding."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("idx"), *(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")))


POINTS = "SELECT vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings"


def point_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, ax.., bx.., cx..): three points a row, from nine components."""
    v = table(spark, sf_dir, "embeddings")
    names = [f"{p}{a}" for p in "abc" for a in "xyz"]
    return v.select(F.col("vec_id").alias("idx"), *(F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)))


TRIPLES = "SELECT vec_id AS idx, " + ", ".join(
    f'CAST(embedding[{k + 1}] AS DOUBLE) AS "{p}{a}"' for k, (p, a) in enumerate((p, a) for p in "abc" for a in "xyz")
) + " FROM embeddings"


def boxes(spark: SparkSession, sf_dir: str, half: float = HALF) -> DataFrame:
    p = points(spark, sf_dir)
    return p.select("idx", *((F.col(a) - half).alias(f"lo_{a}") for a in "xyz"), *((F.col(a) + half).alias(f"hi_{a}") for a in "xyz"))


BOXES = f"SELECT idx, x - {HALF} AS lo_x, y - {HALF} AS lo_y, z - {HALF} AS lo_z, x + {HALF} AS hi_x, y + {HALF} AS hi_y, z + {HALF} AS hi_z FROM ({POINTS})"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, frame, value): events of a type in time order."""
    order = Window.partitionBy("event_type").orderBy("ts")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("video"), (F.row_number().over(order) - 1).cast("long").alias("frame"), "value")


FRAMES = "SELECT event_type AS video, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS frame, value FROM events"


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, t, value): a user's events by whole seconds, the last of a second."""
    e = table(spark, sf_dir, "events").where("event_id % 2 = 0")
    t = F.unix_timestamp("ts").cast("double")
    return e.groupBy(F.col("user_id").alias("track"), t.alias("t")).agg(F.max("value").alias("value"))


KEYS = "SELECT user_id AS track, CAST(floor(epoch(ts)) AS DOUBLE) AS t, max(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id % 2 = 1")
    return e.select(F.col("user_id").alias("track"), F.unix_timestamp("ts").cast("double").alias("t")).distinct()


SAMPLES = "SELECT DISTINCT user_id AS track, CAST(floor(epoch(ts)) AS DOUBLE) AS t FROM events WHERE event_id % 2 = 1"


def grid_mesh(spark: SparkSession, sf_dir: str, side: int = 12) -> tuple[DataFrame, DataFrame]:
    """Square grids of points side by side, as many meshes as there are embeddings for, as vertices and triangles: bent, and rough by the first component.

    A square of four points is two triangles; some are missing. The last grid may end early.
    """
    v = table(spark, sf_dir, "embeddings")
    n = side * side
    v = v.select(F.floor(F.col("vec_id") / n).cast("int").alias("mesh_id"), (F.col("vec_id") % n).alias("v_idx"), F.col("embedding")[0].cast("double").alias("e"))
    x, y = (F.col("v_idx") % side).cast("double"), F.floor(F.col("v_idx") / side).cast("double")
    v = v.select("mesh_id", "v_idx", (x + F.col("mesh_id") * side).alias("x"), y.alias("y"), ((x * x + y * (F.col("mesh_id") % 5)) * 0.1 + F.col("e")).alias("z"))
    ends = v.groupBy("mesh_id").agg(F.max("v_idx").alias("last"))
    low = v.where(F.col("v_idx") % side < side - 1).join(ends, "mesh_id").where(F.col("v_idx") + side + 1 <= F.col("last"))
    quad = F.floor(F.col("v_idx") / side) * (side - 1) + F.col("v_idx") % side
    i = F.col("v_idx")
    two = F.array(F.struct((quad * 2).alias("t_idx"), i.alias("a"), (i + 1).alias("b"), (i + side).alias("c")), F.struct((quad * 2 + 1).alias("t_idx"), (i + 1).alias("a"), (i + side + 1).alias("b"), (i + side).alias("c")))
    t = low.select("mesh_id", F.explode(two).alias("t")).select("mesh_id", "t.*")
    return v, t.where("t_idx % 17 <> 5")


def mesh_sql(side: int = 12) -> str:
    n = side * side
    local, row, mesh = f"CAST(vec_id % {n} % {side} AS DOUBLE)", f"CAST(vec_id % {n} // {side} AS DOUBLE)", f"vec_id // {n}"
    return f"""vertices AS (SELECT CAST({mesh} AS INTEGER) AS mesh_id, vec_id % {n} AS v_idx, {local} + {mesh} * {side} AS x, {row} AS y, ({local} * {local} + {row} * ({mesh} % 5)) * 0.1 + CAST(embedding[1] AS DOUBLE) AS z FROM embeddings),
raw AS (SELECT v.mesh_id, v_idx AS low, odd, (v_idx // {side} * {side - 1} + v_idx % {side}) * 2 + odd AS t_idx FROM vertices v
  JOIN (SELECT mesh_id, max(v_idx) AS last FROM vertices GROUP BY 1) e ON e.mesh_id = v.mesh_id AND v_idx + {side} + 1 <= last, (VALUES (0), (1)) o(odd) WHERE v_idx % {side} < {side - 1}),
triangles AS (SELECT mesh_id, t_idx, low + odd AS a, CASE WHEN odd = 1 THEN low + {side} + 1 ELSE low + 1 END AS b, low + {side} AS c FROM raw WHERE t_idx % 17 <> 5)"""


def r(expression: str, name: str, digits: int = 6) -> str:
    """SQL of a rounded column without negative zeros; ties are moved up, as in ``tidy``."""
    return f"round({expression} + 1e-10, {digits}) + 0.0 AS {name}"
