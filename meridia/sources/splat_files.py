"""Binary little-endian PLY files of Gaussian splats and point clouds: fixed strides, decoded by tasks with numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: scalar kinds of PLY headers and their little-endian forms (fixed values of the format)
KINDS = {"char": "<i1", "uchar": "<u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8"}
#: properties that a splat must have (fixed values of the format)
REQUIRED = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
SPLATS = "file string, idx long, x double, y double, z double, sx double, sy double, sz double, qx double, qy double, qz double, qw double, logit double, dc array<double>, sh array<double>"
POINTS = "file string, idx long, x double, y double, z double"


def header(content: bytes) -> tuple[str, int, np.dtype, int]:
    """(format, vertex count, vertex record, start of data)."""
    end = content.index(b"end_header\n") + len(b"end_header\n")
    form, count, fields, inside = "", 0, [], False
    for line in content[:end].decode("ascii").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            inside = words[1] == "vertex"
            count = int(words[2]) if inside else count
        elif words[:1] == ["property"] and inside:
            fields.append((words[2], KINDS[words[1]]))
    return form, count, np.dtype(fields), end


def read_splats(spark: SparkSession, path: str, rows_at_once: int = 65_536) -> DataFrame:
    """Splats of binary files; spherical harmonics above the constant come in the order of their numbers."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                form, count, record, start = header(content)
                if form != "binary_little_endian":
                    raise ValueError("splat files must be binary_little_endian")
                if missing := [p for p in REQUIRED if p not in record.names]:
                    raise ValueError(f"properties are missing: {missing}")
                rest = sorted((n for n in record.names if re.fullmatch(r"f_rest_\d+", n)), key=lambda n: int(n[7:]))
                terms = len(rest) // 3 + 1
                if len(rest) % 3 or int(terms**0.5) ** 2 != terms or terms > 81:
                    raise ValueError("the harmonics must fill a degree of 8 at most")
                data = np.frombuffer(content, record, count, start)
                for at in range(0, count, rows_at_once):
                    part = data[at : at + rows_at_once]
                    flat = lambda names: list(np.stack([part[n].astype(float) for n in names], 1)) if names else [[] for _ in part]  # noqa: B023, E731
                    scalars = ["x", "y", "z", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3", "opacity"]
                    columns = [pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), *(pa.array(part[n].astype(float)) for n in scalars)]
                    columns += [pa.array(flat(REQUIRED[3:6]), pa.list_(pa.float64())), pa.array(flat(rest), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SPLATS.split(", ")])

    return files.mapInArrow(decode, SPLATS)


def as_splat_files(splats: DataFrame) -> DataFrame:
    """(file, content): a binary file of each group, harmonics padded to the group's largest, normals zero."""

    def encode(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["idx"])
        most = max(len(r["sh"]) for r in rows)
        names = ["x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", *(f"f_rest_{k}" for k in range(most)), "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
        values = [[r["x"], r["y"], r["z"], 0, 0, 0, *r["dc"], *r["sh"], *[0.0] * (most - len(r["sh"])), r["logit"], r["sx"], r["sy"], r["sz"], r["qx"], r["qy"], r["qz"], r["qw"]] for r in rows]
        head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {len(rows)}", *(f"property float {n}" for n in names), "end_header\n"])
        return pa.table({"file": [rows[0]["file"]], "content": pa.array([head.encode() + np.array(values, "<f4").tobytes()], pa.binary())})

    return splats.groupBy("file").applyInArrow(encode, "file string, content binary")


def read_ply_cloud(spark: SparkSession, path: str) -> DataFrame:
    """Points of ASCII or binary PLY files by the header's properties; points that are not finite are left out."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                form, count, record, start = header(content)
                if form == "ascii":
                    lines = content[start:].decode("ascii").splitlines()[:count]
                    at = [record.names.index(a) for a in "xyz"]
                    xyz = np.array([[float(line.split()[k]) for k in at] for line in lines]).reshape(-1, 3)
                else:
                    data = np.frombuffer(content, record, count, start)
                    xyz = np.stack([data[a].astype(float) for a in "xyz"], 1)
                idx = np.nonzero(np.isfinite(xyz).all(1))[0]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(idx)), pa.array(idx), *(pa.array(xyz[idx, k]) for k in range(3))], names=["file", "idx", "x", "y", "z"])

    return files.mapInArrow(decode, POINTS)
