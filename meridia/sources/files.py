"""Whole files in and out: small text or binary files, read and written by tasks."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, lines numbered from 0 as they stand in the file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return whole


def tokens(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def write_files(contents: DataFrame) -> int:
    """Write ``contents(path, content)``, content text or bytes, one file a row, by tasks; the number of files.

    Paths are URIs that all executors reach. A file is written whole before the next, so a retry overwrites it.
    """

    def write(batches):
        n = 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                fs, name = pafs.FileSystem.from_uri(path)
                fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(name) as out:
                    out.write(content.encode() if isinstance(content, str) else content)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]}, schema=pa.schema([("n", pa.int64())]))

    return contents.select("path", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def joined_lines(rows: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    """(key, content): the lines of each key in order, as one text. For files of a size that one task may hold."""
    item = F.struct(*order, line.alias("line"))
    ordered = F.array_sort(F.collect_list(item))
    return rows.groupBy(key).agg(F.concat(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n"), F.lit("\n")).alias("content"))
