"""Mesh files: OBJ, ASCII PLY and glTF with embedded buffers. A mesh is named by its file."""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import joined_lines, lines, tokens

V_SCHEMA = "mesh_id string, v_idx long, x double, y double, z double"
T_SCHEMA = "mesh_id string, t_idx long, a long, b long, c long"


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) by the file name's ending: obj, ply or gltf."""
    readers = {"obj": read_obj, "ply": read_ply, "gltf": read_gltf}
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in readers:
        raise ValueError(f"no mesh format is known by .{ending}")
    return readers[ending](spark, path)


def _fan(faces: DataFrame) -> DataFrame:
    """Triangles of polygons (file, order, ids) as fans around their first corner, numbered within the file."""
    fan = F.transform(F.sequence(F.lit(1), F.size("ids") - 2), lambda k: F.struct(k.alias("k"), F.col("ids")[0].alias("a"), F.get("ids", k).alias("b"), F.get("ids", k + 1).alias("c")))
    rows = faces.where("size(ids) >= 3").select("file", "line_no", F.explode(fan).alias("t")).select("file", "line_no", "t.*")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("file").orderBy("line_no", "k")) - 1
    return rows.select(F.col("file").alias("mesh_id"), number.cast("long").alias("t_idx"), "a", "b", "c")


def _checked(good, value, message: str):
    return F.when(good, value).otherwise(F.raise_error(F.lit(message)))


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``v`` and ``f`` lines; other lines are ignored. Corners are 1-based, the part before a slash; negative ones are errors."""
    from pyspark.sql import Window

    rows = lines(spark, path).withColumn("t", tokens(F.col("line")))
    kind = F.get("t", F.lit(0))
    v = rows.where(kind == "v").withColumn("v_idx", (F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1).cast("long"))
    ok = F.size("t") == 4
    v = v.select(F.col("file").alias("mesh_id"), "v_idx", *(_checked(ok, F.get("t", F.lit(k + 1)), "a vertex needs three numbers").cast("double").alias(a) for k, a in enumerate("xyz")))
    ids = F.transform(F.slice("t", F.lit(2), F.size("t")), lambda s: F.split(s, "/")[0].cast("long") - 1)
    f = rows.where(kind == "f").select("file", "line_no", ids.alias("ids"))
    good = F.forall("ids", lambda i: i >= 0)
    return v, _fan(f.withColumn("ids", _checked(good, F.col("ids"), "face corners must be positive")))


def _ply_parts(spark: SparkSession, path: str) -> DataFrame:
    """Per file: its lines, the header's last line number and the counts of vertices and faces."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("ls"))
    count = lambda what: F.regexp_extract(F.array_join("ls", "\n"), rf"element {what} (\d+)", 1).try_cast("int")
    end = F.array_position("ls", "end_header").cast("int")
    return whole.select("file", "ls", _checked(end > 0, end, "a PLY file needs end_header").alias("end"), F.coalesce(count("vertex"), F.lit(0)).alias("nv"), F.coalesce(count("face"), F.lit(0)).alias("nf"))


def read_ply_points(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of ASCII PLY files: the first three numbers of each vertex line, whatever the header says of them."""
    rows = _ply_parts(spark, path).select("file", F.posexplode(F.expr("slice(ls, end + 1, nv)")).alias("v_idx", "line")).withColumn("t", tokens(F.col("line")))
    return rows.select(F.col("file").alias("mesh_id"), F.col("v_idx").cast("long").alias("v_idx"), *(F.get("t", F.lit(k)).cast("double").alias(a) for k, a in enumerate("xyz")))


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    parts = _ply_parts(spark, path)
    rows = parts.select("file", F.posexplode(F.expr("slice(ls, end + 1 + nv, nf)")).alias("line_no", "line")).withColumn("t", tokens(F.col("line")))
    ids = F.transform(F.slice("t", F.lit(2), F.size("t")), lambda s: s.cast("long"))
    faces = rows.select("file", "line_no", _checked(F.get("t", F.lit(0)).cast("int") == F.size("t") - 1, ids, "a face must list as many corners as it says").alias("ids"))
    return read_ply_points(spark, path), _fan(faces)


def _gltf(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and triangles of the first primitive of the first mesh."""
    doc = json.loads(content)
    head, _, body = doc["buffers"][0]["uri"].partition(",")
    if head != "data:application/octet-stream;base64":
        raise ValueError("the first buffer must be embedded as base64")
    data = base64.b64decode(body)

    def values(accessor: int, kind: int, dtype: str, width: int) -> np.ndarray:
        a = doc["accessors"][accessor]
        if a["componentType"] != kind:
            raise ValueError(f"component type {a['componentType']} is not read")
        view = doc["bufferViews"][a["bufferView"]]
        at = view.get("byteOffset", 0) + a.get("byteOffset", 0)
        return np.frombuffer(data, dtype, a["count"] * width, at)

    primitive = doc["meshes"][0]["primitives"][0]
    points = values(primitive["attributes"]["POSITION"], 5126, "<f4", 3).reshape(-1, 3).astype(float)
    corners = values(primitive["indices"], 5125, "<u4", 1) if "indices" in primitive else np.arange(len(points))
    if len(corners) % 3:
        raise ValueError("the number of indices must divide by three")
    return points, corners.astype(np.int64).reshape(-1, 3)


def read_gltf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files are decoded by tasks, one file at a time, since buffers are little-endian bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(which: int, names: list[str]):
        def decode(batches):
            for batch in batches:
                for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                    rows = _gltf(content)[which]
                    columns = [pa.array([name] * len(rows)), pa.array(np.arange(len(rows))), *(pa.array(rows[:, k]) for k in range(3))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        return decode

    return (
        files.mapInArrow(run(0, ["mesh_id", "v_idx", "x", "y", "z"]), V_SCHEMA),
        files.mapInArrow(run(1, ["mesh_id", "t_idx", "a", "b", "c"]), T_SCHEMA),
    )


def as_obj(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(mesh_id, content): OBJ text of each mesh."""
    v = vertices.select("mesh_id", F.lit(0).alias("part"), F.col("v_idx").alias("k"), F.concat_ws(" ", F.lit("v"), *(_number(F.col(a)) for a in "xyz")).alias("text"))
    t = triangles.select("mesh_id", F.lit(1).alias("part"), F.col("t_idx").alias("k"), F.concat_ws(" ", F.lit("f"), *((F.col(c) + 1).cast("string") for c in "abc")).alias("text"))
    return joined_lines(v.unionByName(t), "mesh_id", ["part", "k"], F.col("text"))


def _number(c):
    """Whole numbers without a fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def as_ply(vertices: DataFrame, triangles: DataFrame | None = None, colours: bool = False) -> DataFrame:
    """(mesh_id, content): ASCII PLY text; with ``colours`` the vertices' r, g, b (0 to 1) as bytes."""
    extra = [F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255).cast("int").cast("string") for c in ("r", "g", "b")] if colours else []
    v = vertices.select("mesh_id", F.lit(1).alias("part"), F.col("v_idx").alias("k"), F.concat_ws(" ", *(_number(F.col(a)) for a in "xyz"), *extra).alias("text"))
    counts = vertices.groupBy("mesh_id").agg(F.count("*").alias("nv"))
    if triangles is not None:
        counts = counts.join(triangles.groupBy("mesh_id").agg(F.count("*").alias("nf")), "mesh_id", "left")
        t = triangles.select("mesh_id", F.lit(2).alias("part"), F.col("t_idx").alias("k"), F.concat_ws(" ", F.lit("3"), *(F.col(c).cast("string") for c in "abc")).alias("text"))
        v = v.unionByName(t)
    head = ["ply", "format ascii 1.0", "element vertex ?", "property float x", "property float y", "property float z"]
    head += ["property uchar red", "property uchar green", "property uchar blue"] if colours else []
    text = F.replace(F.lit("\n".join(head)), F.lit("?"), F.col("nv").cast("string"))
    if triangles is not None:
        text = F.concat(text, F.lit("\nelement face "), F.coalesce("nf", F.lit(0)).cast("string"), F.lit("\nproperty list uchar int vertex_indices"))
    top = counts.select("mesh_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), F.concat(text, F.lit("\nend_header")).alias("text"))
    return joined_lines(top.unionByName(v), "mesh_id", ["part", "k"], F.col("text"))


def as_gltf(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(mesh_id, content): glTF text with one embedded buffer; a mesh is one group of a task."""
    v = vertices.select("mesh_id", F.lit(0).alias("part"), F.col("v_idx").alias("k"), F.array(*(F.col(a).cast("double") for a in "xyz")).alias("n"))
    t = triangles.select("mesh_id", F.lit(1).alias("part"), F.col("t_idx").alias("k"), F.array(*(F.col(c).cast("double") for c in "abc")).alias("n"))

    def encode(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("k").to_pylist(), table.column("n").to_pylist()))
        points = np.array([n for p, _, n in rows if p == 0], dtype="<f4").reshape(-1, 3)
        corners = np.array([n for p, _, n in rows if p == 1], dtype="<u4").reshape(-1, 3)
        data = points.tobytes() + corners.tobytes()
        doc = {
            "asset": {"version": "2.0"},
            "buffers": [{"byteLength": len(data), "uri": "data:application/octet-stream;base64," + base64.b64encode(data).decode()}],
            "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": points.nbytes}, {"buffer": 0, "byteOffset": points.nbytes, "byteLength": corners.nbytes}],
            "accessors": [
                {"bufferView": 0, "componentType": 5126, "count": len(points), "type": "VEC3", "min": points.min(0).tolist(), "max": points.max(0).tolist()},
                {"bufferView": 1, "componentType": 5125, "count": corners.size, "type": "SCALAR"},
            ],
            "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        }
        return pa.table({"mesh_id": [str(table.column("mesh_id")[0].as_py())], "content": [json.dumps(doc)]})

    return v.unionByName(t).groupBy("mesh_id").applyInArrow(encode, "mesh_id string, content string")
