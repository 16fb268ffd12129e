"""Language identification by string kernels.

A text is folded to lower-case letters with single blanks between runs of them; its features are the n-grams of 1 to ``longest``
characters (the blended spectrum) that it holds, each counted once. The kernel of two texts is the number of n-grams in both over
the geometric mean of their numbers. Landmarks are texts of the training sample, as many of each language; one-versus-rest ridge
regression on the kernels with the landmarks (Nyström) gives a column of weights for each language. Texts are scored in batches:
presence times landmarks gives the kernels, kernels times weights the languages' values.

Learned from: rows with doc_id, text with a letter, and language; each doc_id once, with the smallest of its languages and texts.
The sample is stratified: a hash sample of ``rows_each`` rows of each language in expectation (all where there are fewer), of which
the first by hash are landmarks, about ``landmarks`` altogether and one of each language at least. Its bound is thus a
parameter times the number of languages. All kernels of training rows are summed up by Spark.

Null texts and texts without a letter are ``und`` with score 0, and so are all texts where nothing was learned. Very long texts are taken
whole, in blocks. Ties go to the first language by code point. Repeated rows are scored one by one; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import held_out
from .shared import broadcast_if_small, materialise, summed

APART = re.compile(r"[\W\d_]+")
#: bits of a code point; three of them fit a long (a fixed value)
POINT = 21
BLOCK = 1 << 20
PREDICTED = "doc_id long, lang_pred string, score double"


def folded(text: str | None) -> str:
    """Lower-case letters, runs of others as one blank, a blank at both ends; empty if there is no letter."""
    out = APART.sub(" ", (text or "").lower()).strip()
    return f" {out} " if any(map(str.isalpha, out)) else ""


def grams(text: str, longest: int) -> np.ndarray:
    """Sorted distinct n-grams of a folded text; each n-gram's code holds its points, so that no two have one code."""
    found = np.zeros(0, dtype=np.int64)
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK + longest - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        codes, parts = points, [points]
        for n in range(1, longest):
            codes = (codes[:-1] << POINT) | points[n:]
            parts.append(codes)
        parts.append(found)
        found = np.unique(np.concatenate(parts))
    return found


@dataclass
class Landmarks:
    """The landmarks' n-grams: sorted codes, and for each landmark the places of its own in them."""

    longest: int
    codes: np.ndarray
    own: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[str], longest: int) -> Landmarks:
        each = [grams(folded(t), longest) for t in texts]
        codes = np.unique(np.concatenate(each)) if each else np.zeros(0, dtype=np.int64)
        return cls(longest, codes, [np.searchsorted(codes, g).astype(np.int32) for g in each])

    def matrix(self) -> np.ndarray:
        """Presence of codes (rows) in landmarks (columns), over the root of each landmark's number of n-grams."""
        out = np.zeros((len(self.codes), len(self.own)), dtype=np.float32)
        for j, at in enumerate(self.own):
            out[at, j] = 1 / np.sqrt(len(at))
        return out

    def kernels(self):
        """A function of a list of folded texts: their kernels with all landmarks, as one matrix product."""
        codes, matrix, longest = self.codes, self.matrix(), self.longest

        def of(texts: list[str]) -> np.ndarray:
            present = np.zeros((len(texts), len(codes)), dtype=np.float32)
            for k, text in enumerate(texts):
                found = grams(text, longest)
                if len(found):
                    at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                    present[k, at[codes[at] == found]] = 1 / np.sqrt(len(found))
            return (present @ matrix).astype(np.float64)

        return of


@dataclass
class Model:
    """Languages in order, landmarks, and the weights (landmarks by languages)."""

    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray


def _in_batches(texts: list[str], size: int = 64):
    for at in range(0, len(texts), size):
        yield slice(at, at + size), texts[at : at + size]


def sample(docs: DataFrame, rows_each: int) -> DataFrame:
    """(doc_id, lang, text, place): the stratified sample, ``place`` being a hash that orders it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("place", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size"))
    kinds = sizes.count()
    # a row for each language; texts are aggregated only behind the sample
    chosen = rows.join(broadcast_if_small(sizes, kinds, 10_000), "lang").where(F.col("place") < F.lit(float((1 << 30) * rows_each)) / F.col("size"))
    return chosen.groupBy("doc_id", "place").agg(F.min("lang").alias("lang"), F.min("text").alias("text"))


def learn(docs: DataFrame, rows_each: int = 1000, landmarks: int = 128, longest: int = 3, ridge: float = 1e-4) -> Model:
    """The model of ``docs(doc_id, text, lang)``; see the module for the bounds of the sample."""
    chosen = materialise(sample(docs, rows_each), "language-sample")
    kinds = chosen.select("lang").distinct().count()
    each = max(1, landmarks // max(1, kinds))
    letters = F.col("text").rlike(r"\p{L}")
    first = chosen.where(letters).groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "doc_id"))), 1, each).alias("first"))
    first = first.select(F.explode("first.doc_id").alias("doc_id"))
    heads = chosen.join(F.broadcast(first), "doc_id").select("lang", "place", "doc_id", "text").toArrow().to_pylist()
    heads.sort(key=lambda r: (r["lang"], r["place"], r["doc_id"]))
    languages, marks = sorted({r["lang"] for r in heads}), Landmarks.of([r["text"] for r in heads], longest)
    m, c = len(heads), len(languages)
    if not m:
        return Model([], marks, np.zeros((0, 0)))
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def start():
        kernels = sent.value.kernels()

        def apply(batch: pa.RecordBatch) -> np.ndarray:
            total = np.zeros((m + 1, m + c))
            langs, texts = batch.column("lang").to_pylist(), [folded(t) for t in batch.column("text").to_pylist()]
            for at, some in _in_batches(texts):
                y = np.array([[1.0 if lang == known else -1.0 for known in languages] for lang in langs[at]])
                real = np.array([bool(t) for t in some])
                k = kernels(some)[real]
                total[:m] += k.T @ np.hstack([k, y[real]])
                total[m, 0] += len(k)
            return total

        return apply

    total = summed(chosen.select("lang", "text"), start, m + 1, m + c)
    own = marks.kernels()([folded(r["text"]) for r in heads])
    left = total[:m, :m] + ridge * total[m, 0] * (own + own.T) / 2 + 1e-9 * total[m, 0] * np.eye(m)
    return Model(languages, marks, np.linalg.solve(left, total[:m, m:]))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs(doc_id, text)``; the score is half of one plus the language's value, within 0 and 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        languages, weights, kernels = sent.value.languages, sent.value.weights, sent.value.landmarks.kernels()
        for whole in batches:
            names, scores = [], []
            for _, some in _in_batches([folded(t) for t in whole.column("text").to_pylist()]):
                if not languages:
                    names += ["und"] * len(some)
                    scores += [0.0] * len(some)
                    continue
                values = kernels(some) @ weights
                best = values.argmax(axis=1)
                names += [languages[b] if t else "und" for b, t in zip(best, some)]
                scores += [min(1.0, max(0.0, (1 + v[b]) / 2)) if t else 0.0 for v, b, t in zip(values, best, some)]
            yield pa.RecordBatch.from_pydict({"doc_id": whole.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return slim.mapInArrow(run, PREDICTED)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out(0, 5)))
    return predicted(docs, model).select("doc_id", F.coalesce(held_out(0, 5), F.lit(False)).alias("held_out"), "lang_pred", "score")
