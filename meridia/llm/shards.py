"""Sharding by size-tiered compaction with versioned manifests.

A dataset is a folder of immutable Parquet shards and ``_manifest/v<version>.json`` files. Each append writes an arrival as
small shards and commits a manifest that adds them. Compaction puts shards into tiers by size (each tier ``fan_in`` times
the one below); a tier that has ``fan_in`` shards or more is merged into files of up to the target size, and a
new manifest replaces the merged shards by these. Shards of half the target size or more are settled and left alone.

A manifest holds the open shards, the schema, what the last commits replaced, and the names of immutable lists of settled
shards; a commit writes what has changed, not all shards. It creates the next version's file under a temporary name and renames
it without overwriting, so readers see one version or the next, and of two writers one fails; appends try again, as arrivals
don't depend on each other. Merging is one Spark job a round: every task streams the row groups of its shards into one
file, so no rows are shuffled and memory is bounded by a row group. The driver handles names and sizes of shards, never rows.

``vacuum`` deletes shards that a commit has replaced, and files that no manifest lists only once they are older than any
writer may take, so another writer's shards stay until it commits.

Rows are stored as they are: nulls, empty texts, repeated rows and extra columns all survive. Arrivals may bring new columns,
null in earlier rows, and lack some; a column whose type differs from the dataset's is refused. An empty arrival adds no
shards. Attempts write files of their own names; only those of successful tasks are committed.
"""

from __future__ import annotations

import json
import math
import time
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .shared import fresh_path

WRITTEN = "path string, n_rows long, n_bytes long"


def _fs(uri: str):
    return pafs.FileSystem.from_uri(uri)


class _Roller:
    """Writes record batches into Parquet files of about ``target`` bytes each."""

    def __init__(self, folder: str, schema: pa.Schema, target: int):
        self.folder, self.schema, self.target = folder, schema, target
        self.done, self.writer = [], None

    def _open(self) -> None:
        self.uri = f"{self.folder}/shard-{uuid.uuid4().hex}.parquet"
        fs, path = _fs(self.uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream = fs.open_output_stream(path)
        self.writer, self.rows = pq.ParquetWriter(self.stream, self.schema, compression="zstd"), 0

    def write(self, batch: pa.Table) -> None:
        if not batch.num_rows:
            return
        if self.writer is None:
            self._open()
        self.writer.write_table(batch)
        self.rows += batch.num_rows
        if self.stream.tell() >= self.target:
            self.close()

    def close(self) -> None:
        if self.writer is not None:
            self.writer.close()
            size = self.stream.tell()
            self.stream.close()
            self.done.append((self.uri, self.rows, size))
            self.writer = None

    def batch(self) -> pa.RecordBatch:
        self.close()
        paths, rows, sizes = zip(*self.done) if self.done else ((), (), ())
        out = pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(rows, pa.int64()), pa.array(sizes, pa.int64())],
            names=["path", "n_rows", "n_bytes"],
        )
        self.done = []
        return out


def _conformed(batch: pa.RecordBatch, schema: pa.Schema) -> pa.Table:
    """The batch with the columns of ``schema``, nulls for those it lacks."""
    n = batch.num_rows
    columns = [batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(n, f.type) for f in schema]
    return pa.Table.from_arrays(columns, schema=schema)


def _union(old: StructType | None, new: StructType) -> StructType:
    """The columns of both, old ones first; raises where a type differs."""
    fields = {f.name: f for f in old} if old else {}
    for f in new:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, f)
    return StructType([StructField(f.name, f.dataType, True) for f in fields.values()])


class ShardStore:
    """A sharded dataset at ``folder``, a URI that the driver and all executors reach."""

    #: lists of settled shards before they are written as one
    MOST_LISTS = 32

    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = 128 << 20, small_bytes: int = 2 << 20, fan_in: int = 4):
        if fan_in < 2 or not 0 < small_bytes <= target_bytes:
            raise ValueError("fan_in must be 2 or more and small_bytes at most target_bytes")
        self.spark, self.folder = spark, folder.rstrip("/")
        self.target, self.small, self.fan_in = target_bytes, small_bytes, fan_in

    def _read_json(self, name: str):
        fs, path = _fs(f"{self.folder}/_manifest/{name}")
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def _write_json(self, name: str, body) -> None:
        fs, path = _fs(f"{self.folder}/_manifest/{name}")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as out:
            out.write(json.dumps(body).encode())

    def version(self) -> int:
        """The newest committed version, 0 before the first."""
        fs, path = _fs(f"{self.folder}/_manifest")
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        names = [f.base_name for f in found]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def head(self, version: int | None = None) -> dict:
        """A version's manifest: schema, open shards, lists of settled ones, and the files replaced since the last vacuum."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "open": [], "settled": [], "replaced": []}
        return self._read_json(f"v{version:08d}.json")

    def shards(self, version: int | None = None) -> list[dict]:
        """All shards of a version."""
        head = self.head(version)
        return [s for name in head["settled"] for s in self._read_json(name)] + head["open"]

    def _commit(self, base: dict, shards: list[dict], schema: StructType | None = None, replaced: list[str] = ()) -> int:
        """Commit the version after ``base`` with these open shards, of which large ones settle; fails if another writer has been first."""
        version = base["version"] + 1
        lists, done = list(base["settled"]), [s for s in shards if self._settled(s)]
        if done:
            if len(lists) >= self.MOST_LISTS:
                done = [s for name in lists for s in self._read_json(name)] + done
                lists = []
            lists.append(f"settled-{uuid.uuid4().hex}.json")
            self._write_json(lists[-1], done)
        temporary = f".{uuid.uuid4().hex}.tmp"
        body = {"version": version, "schema": schema.json() if schema else base["schema"], "open": [s for s in shards if not self._settled(s)], "settled": lists, "replaced": list(replaced)}
        self._write_json(temporary, body)
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_manifest/{name}")
        final = path(f"v{version:08d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(path(temporary), final, none)  # without OVERWRITE: raises if the version exists
        return version

    def append(self, rows: DataFrame, attempts: int = 8) -> int:
        """Write an arrival as small shards, as its partitions come, and commit; the new version."""
        schema, folder, small = to_arrow_schema(rows.schema), f"{self.folder}/data", self.small
        _union(_schema(self.head()), rows.schema)  # refuses other types before anything is written

        def write(batches):
            roller = _Roller(folder, schema, small)
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    roller.write(pa.Table.from_batches([batch.slice(at, 512)]).cast(schema))
            yield roller.batch()

        written = [self._named(r) for r in rows.mapInArrow(write, WRITTEN).collect()]
        for left in reversed(range(attempts)):
            base = self.head()
            try:
                return self._commit(base, base["open"] + written, _union(_schema(base), rows.schema), base["replaced"])
            except Py4JJavaError as lost:
                if not left or "FileAlreadyExists" not in str(lost.java_exception):
                    raise
        raise AssertionError("unreachable")

    def _named(self, row) -> dict:
        return row.asDict() | {"tier": self.tier(row["n_bytes"])}

    def _settled(self, shard: dict) -> bool:
        return shard["n_bytes"] >= self.target / 2

    def tier(self, n_bytes: int) -> int:
        """0 up to the small size, one more for every factor of ``fan_in``."""
        return 0 if n_bytes <= self.small else math.ceil(math.log(n_bytes / self.small, self.fan_in) - 1e-9)

    def _groups(self, shards: list[dict]) -> list[list[dict]]:
        """Merges of one round: within each tier, runs of similarly sized shards that fill a target-sized file."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            tiers.setdefault(s["tier"], []).append(s)
        out = []
        for tier in sorted(tiers):
            if len(tiers[tier]) < self.fan_in:
                continue
            group, size = [], 0
            for s in sorted(tiers[tier], key=lambda s: (s["n_bytes"], s["path"])):
                if group and size + s["n_bytes"] > self.target:
                    out.append(group)
                    group, size = [], 0
                group.append(s)
                size += s["n_bytes"]
            out.append(group)
        return [g for g in out if len(g) > 1]

    def compact(self, max_rounds: int = 20) -> int:
        """Merge until no tier has ``fan_in`` shards left to merge; the newest version."""
        for _ in range(max_rounds):
            base = self.head()
            groups = self._groups(base["open"])
            if not groups:
                return base["version"]
            plan = self.spark.createDataFrame(
                [(k, [s["path"] for s in g]) for k, g in enumerate(groups)], "merge long, paths array<string>"
            ).repartition(len(groups), "merge")
            folder, schema = f"{self.folder}/data", to_arrow_schema(_schema(base))

            def merge(batches):
                for batch in batches:
                    for row in batch.to_pylist():
                        roller = _Roller(folder, schema, 1 << 62)
                        for uri in row["paths"]:
                            fs, path = _fs(uri)
                            with fs.open_input_file(path) as f:
                                for part in pq.ParquetFile(f).iter_batches(4096):
                                    roller.write(_conformed(part, schema))
                        yield roller.batch()

            written = [self._named(r) for r in plan.mapInArrow(merge, WRITTEN).collect()]
            gone = {s["path"] for g in groups for s in g}
            if sum(r["n_rows"] for r in written) != sum(s["n_rows"] for g in groups for s in g):
                raise RuntimeError("a merge lost or repeated rows; nothing is committed")
            kept = [s for s in base["open"] if s["path"] not in gone]
            self._commit(base, kept + written, replaced=[*base["replaced"], *sorted(gone)])
        return self.version()

    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Delete what commits have replaced, and unlisted files older than ``older_than`` seconds; the number of files.

        Older versions become unreadable. Files another writer has written and not yet committed are unlisted but young.
        """
        base = self.head()
        if base["replaced"]:
            self._commit(base, base["open"])
        fs, path = _fs(f"{self.folder}/data")
        listed = {_fs(s["path"])[1] for s in self.shards()}
        replaced = {_fs(p)[1] for p in base["replaced"]}
        before = time.time() - older_than
        found = [f for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.is_file and f.path not in listed]
        gone = [f.path for f in found if f.path in replaced or f.mtime_ns / 1e9 < before]
        for f in gone:
            fs.delete_file(f)
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version, with all columns it has had; None if it has no shards."""
        paths = [s["path"] for s in self.shards(version)]
        return self.spark.read.schema(_schema(self.head(version))).parquet(*paths) if paths else None


def _schema(head: dict) -> StructType | None:
    return StructType.fromJson(json.loads(head["schema"])) if head["schema"] else None


def sharded(docs: DataFrame, arrivals: int = 4, **options) -> ShardStore:
    """Append ``docs`` in ``arrivals`` parts (by doc_id hash), compacting after each, in a fresh shared folder."""
    store = ShardStore(docs.sparkSession, fresh_path(docs.sparkSession, "shards"), **options)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.where(part == k))
        store.compact()
        store.vacuum()
    return store


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, as read back from the newest version: its columns, the text as length and checksum."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sharded(docs).read()
    if rows is None:
        rows = docs
    return rows.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.col("lang"),
        F.col("source"),
        F.col("n_chars"),
    )
