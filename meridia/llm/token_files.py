"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A dataset is a folder of shards in ascending doc_id order. Shard k is ``<k>.bin``, the token ids of its
documents end to end as little-endian unsigned integers (16 bits where the vocabulary allows it, else 32), and
``<k>.idx``, little-endian 64-bit integers: the doc_ids, then the global start of every document and of what
follows the shard. ``manifest.json`` lists the shards with their bases. A start is an id's place in the whole
dataset, so readers map the files into memory and slice.

Writing takes two passes. The first range-partitions documents by doc_id, encodes each whole text and writes the
ids with local offsets; it returns one count per shard. Prefix sums of the counts are the bases; the second
pass adds them. Files are named by attempt and only those of successful tasks are listed, so retried and
speculative tasks do no harm.

Nulls and empty texts: a null text counts as empty, giving the end id alone. A null doc_id sorts first; the manifest
has the number of them in each shard, and they are read back as null. Repeated doc_ids are all written, in the order of their texts.
An empty table gives a dataset without shards. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memo import Memo
from .shared import fresh_path
from .token_counts import byte_characters

SHARD = "shard long, bin string, idx string, n_docs long, n_null long, n_tokens long"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


class PieceEncoder:
    """Encodes whole texts with the tokenizers library, remembering the ids of the words seen before.

    Plain text (ASCII and Latin-1 letters, which normalization leaves alone but for their case) is cut into words by one
    pattern, and the library's model encodes each new word. Other texts are cut at white space; pieces with other characters
    go through the library's normalizer and pre-tokenizer, those with special strings to the library whole. That is exact
    for tokenizers that drop white space and normalize within words: no token reaches over a cut. ``limit`` and the length
    of what is remembered bound the memory, and long texts are encoded span by span.
    """

    #: the pre-tokenizer pattern of the vocabulary for plain text in lower case (a fixed value of the format)
    WORDS = re.compile(r"[a-zß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^a-z0-9ß-öø-ÿ \t\n\r]+")
    #: Latin-1 codes of plain text
    PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
    SPACE = re.compile(r"[ \t\n\r]+")
    SPAN = 1 << 18

    def __init__(self, path: str, dtype: str, limit: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.dtype = self.tokenizer.model, dtype
        self.normalize = self.tokenizer.normalizer.normalize_str
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        back = {b: c for c, b in byte_characters().items()}
        self.as_bytes = {k: "".join(back[b] for b in chr(k).encode()) for k in range(0xC0, 0x100)}
        self.words, self.odd = Memo(self._word, limit), Memo(self._odd, limit // 4)

    def _packed(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype == "<u2" else "I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A plain word in lower case; the model wants its UTF-8 bytes as characters."""
        return self._packed([t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.as_bytes))])

    def _odd(self, piece: str) -> bytes:
        if any(s in piece for s in self.special):
            return self._packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        tokenize = self.model.tokenize
        return self._packed([t.id for word, _ in self.cut(self.normalize(piece)) for t in tokenize(word)])

    def _plain(self, text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, self.PLAIN) and not any(s in text for s in self.special)
        except UnicodeEncodeError:
            return False

    def _span(self, text: str) -> bytes:
        get = self.words.__getitem__
        if not self._plain(text):
            pieces = self.SPACE.split(text)
            if len(pieces) == 1:
                return self.odd[text]
            return b"".join([self._span(p) if self._plain(p) else self.odd[p] for p in pieces if p])
        lower = text.lower()
        if len(text) <= 2 * self.SPAN:
            return b"".join(map(get, self.WORDS.findall(lower)))
        # without a space to cut at: a list of all its words at once could take many times its size
        found = (m.group() for m in self.WORDS.finditer(lower))
        return b"".join(iter(lambda: b"".join(map(get, islice(found, 50_000))), b""))

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, packed little-endian."""
        text = text or ""
        if len(text) <= self.SPAN:
            return self._span(text) if text else b""
        out, at = [], 0
        while at < len(text):
            end = self.SPACE.search(text, at + self.SPAN)
            end = end.end() if end else len(text)
            out.append(self._span(text[at:end]))
            at = end
        return b"".join(out)


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def _encoder(path: str, dtype: str) -> PieceEncoder:
    """One encoder a worker process: its memory serves all tasks that the process runs."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = PieceEncoder(path, dtype)
    return _ENCODERS[path, dtype]


def dtype_for(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def _encode_shards(folder: str, tokenizer: str, end_id: int, dtype: str):
    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder, end = _encoder(tokenizer, dtype), np.array([end_id], dtype=dtype).tobytes()
        width = np.dtype(dtype).itemsize
        ids, lengths, n_null, stream = [], [], 0, None
        name = f"{folder}/{shard:06d}-{uuid.uuid4().hex[:8]}"
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(batch), 256):  # a few texts at a time, for long ones
                docs = batch.column("doc_id").slice(at, 256).to_pylist()
                for doc, packed in zip(docs, map(encoder.encode, texts.slice(at, 256).to_pylist())):
                    if stream is None:
                        fs, path = _open(f"{name}.bin")
                        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        stream = fs.open_output_stream(path)
                    stream.write(packed)
                    stream.write(end)
                    n_null += doc is None
                    ids.append(doc or 0)
                    lengths.append(len(packed) // width + 1)
        if stream is not None:
            stream.close()
            starts = np.concatenate([[0], np.cumsum(lengths)])
            fs, path = _open(f"{name}.loc")
            with fs.open_output_stream(path) as out:
                out.write(np.array(ids, dtype="<i8").tobytes() + starts.astype("<i8").tobytes())
            row = {"shard": shard, "bin": f"{name}.bin", "idx": f"{name}.loc", "n_docs": len(ids), "n_null": n_null, "n_tokens": int(starts[-1])}
            yield pa.RecordBatch.from_pylist([row])

    return run


def _read(uri: str) -> bytes:
    fs, path = _open(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def _finish(row) -> None:
    """Second pass of one shard: local offsets become global ones."""
    local = np.frombuffer(_read(row["idx"]), dtype="<i8")
    n = row["n_docs"]
    body = local[:n].tobytes() + (local[n:] + row["base"]).astype("<i8").tobytes()
    fs, path = _open(row["idx"].removesuffix(".loc") + ".idx")
    with fs.open_output_stream(path) as out:
        out.write(body)


def _finish_shards(batches):
    for batch in batches:
        for row in batch.to_pylist():
            _finish(row)
        yield pa.RecordBatch.from_pydict({"shard": batch.column("shard")})


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, partitions: int | None = None
) -> list[dict]:
    """Write ``docs(doc_id, text)`` as a token dataset at ``folder`` (a URI all executors reach); the manifest's shards.

    The driver sees one row per shard, nothing of the documents. ``end_id`` follows every document.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dtype = dtype_for(max(_vocabulary(tokenizer), end_id + 1))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = slim.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = slim.mapInArrow(_encode_shards(folder, tokenizer, end_id, dtype), SHARD).collect()
    shards = [r.asDict() for r in sorted(rows, key=lambda r: r["shard"])]
    for row, base in zip(shards, accumulate((r["n_tokens"] for r in shards), initial=0)):
        row["base"] = base
    if shards:
        plan = spark.createDataFrame(shards, SHARD + ", base long").repartition(len(shards), "shard")
        plan.mapInArrow(_finish_shards, "shard long").count()
    for row in shards:
        row |= {"idx": row["idx"].removesuffix(".loc") + ".idx", "dtype": dtype}
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "end_id": end_id, "shards": shards}).encode())
    return shards


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """A shard's ids, mapped into memory where the file is local and read otherwise."""
    fs, path = _open(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    return np.frombuffer(_read(uri), dtype=dtype)


def _read_shards(batches):
    for batch in batches:
        for row in batch.to_pylist():
            index, ids = np.frombuffer(_read(row["idx"]), dtype="<i8"), _mapped(row["bin"], row["dtype"])
            n = row["n_docs"]
            starts = index[n:] - row["base"]
            for at in range(0, n, 10_000):
                span = range(at, min(n, at + 10_000))
                sums = [zlib.crc32(ids[starts[k] : starts[k + 1]].astype("<u4").tobytes()) for k in span]
                docs = [None if k < row["n_null"] else d for k, d in zip(span, index[at : span.stop].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()),
                        pa.array(index[n + at : n + span.stop], pa.int64()),
                        pa.array(np.diff(starts[at : span.stop + 1]), pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the dataset: doc_id, start, n_tokens and the crc32 of its ids as 32-bit integers."""
    shards = json.loads(_read(f"{folder}/manifest.json"))["shards"]
    if not shards:
        return spark.createDataFrame([], DOCUMENT)
    plan = spark.createDataFrame(shards, SHARD + ", base long, dtype string").repartition(len(shards), "shard")
    return plan.mapInArrow(_read_shards, DOCUMENT)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a fresh dataset in the shared folder and read it back."""
    folder = fresh_path(docs.sparkSession, "tokens")
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(docs.sparkSession, folder)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
