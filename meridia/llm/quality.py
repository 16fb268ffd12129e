"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are hashed unigrams and bigrams of tokens (runs of letters and digits, runs of marks), by their share of
the text's n-grams. A bigram of a token with itself is one shared feature, so that repetition shows for any word. Only the
text is read. Training takes a bounded hash sample of labelled rows (``max_rows``), dealt into ``shards`` trained
apart by FTRL-proximal steps and averaged; both are parameters. Scoring is a sparse dot product over whole texts, the
weights (4 bytes times 2^bits) being the only thing broadcast.

Nulls and empty texts score by the bias alone. Rows without a label, with a null label or null doc_id are not learned from; a
doc_id that repeats in labels or documents is learned from once. Repeated rows are scored one by one. Labels of one kind alone
draw all scores to their side; without any labels every score is 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .memo import Memo
from .shared import map_batches

TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")
REPEAT = 0x5BD1E995
SCORED = "doc_id long, score double"


def _hash(token: str) -> int:
    return crc32(token.encode("utf-8", "surrogatepass"))


_HASHES = Memo(_hash, 300_000)


def features(text: str | None, bits: int) -> np.ndarray:
    """Feature numbers of all uni- and bigrams of the whole text, with repeats."""
    tokens = TOKEN.findall(text or "")
    one = np.fromiter(map(_HASHES.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    two = np.where(one[:-1] == one[1:], np.uint64(REPEAT), one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA6B))
    both = np.concatenate([one * np.uint64(0x9E3779B97F4A7C15), two * np.uint64(0xC2B2AE3D27D4EB4F)])
    return (both >> np.uint64(64 - bits)).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    """Weights and bias after FTRL-proximal steps over rows of (features, values, label), in the order given."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for at, x, y in rows:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - root) / alpha * w
            n[at] = grown
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w


def _example(text: str | None, bits: int, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features with their values; the last is the bias."""
    found = features(text, bits)
    at, counts = np.unique(found, return_counts=True)
    return np.append(at, 1 << bits), np.append(counts * (gain / max(1, len(found))), 1.0)


def sampled(labels: DataFrame, max_rows: int) -> DataFrame:
    """A hash sample of the labelled rows, of ``max_rows`` in expectation; all where there are no more."""
    n = labels.count()
    if n <= max_rows:
        return labels
    return labels.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, y, text) of the sampled labels: each doc_id once, with its largest label and the first of its texts."""
    once = labels.where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    # the sample is bounded by a parameter and holds no doc_id twice, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sampled(once, max_rows)), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 16_000,
    shards: int = 8,
    bits: int = 18,
    epochs: int = 3,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.01,
    l2: float = 0.01,
    gain: float = 50.0,
) -> np.ndarray:
    """Weights from ``docs(doc_id, text)`` and ``labels(doc_id, y)``; the bias is last. See ``sampled`` for the bound."""
    chosen = labelled(docs, labels, max_rows)
    shard = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(shards)).cast("int")
    chosen = chosen.select(shard.alias("shard"), "doc_id", "y", "text").groupBy("shard")

    def fit(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "y", "text"))), key=lambda r: crc32(str(r[0]).encode()))
        examples = [(*_example(text, bits, gain), y) for _, y, text in rows]
        w = ftrl(examples, 1 << bits, epochs, alpha, beta, l1, l2)
        some = np.nonzero(w)[0]
        return pa.table({"at": pa.array(some, pa.int32()), "w": pa.array(w[some] / shards, pa.float64())})

    found = chosen.applyInArrow(fit, "at int, w double").groupBy("at").agg(F.sum("w").alias("w")).toArrow()
    weights = np.zeros((1 << bits) + 1, dtype=np.float32)
    weights[found.column("at").to_numpy()] = found.column("w").to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, gain: float = 50.0) -> DataFrame:
    """(doc_id, score) of every row, the score in (0, 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bits = int(np.log2(len(weights) - 1))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def start():
        w = shared.value

        def one(text: str | None) -> float:
            found = features(text, bits)
            total = float(w[-1]) + (float(w[found].sum(dtype=np.float64)) * gain / len(found) if len(found) else 0.0)
            return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))

        return lambda batch: {"doc_id": batch["doc_id"], "score": [one(t) for t in batch["text"]]}

    return map_batches(slim, start, SCORED)


def held_out(fold: int, folds: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold


def with_verdict(scored: DataFrame, fold: int, folds: int, limit: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored.select(
        "doc_id",
        F.coalesce(held_out(fold, folds), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    weights = train(docs, labels.where(~held_out(0, 5)))
    return with_verdict(score(docs, weights), 0, 5)
