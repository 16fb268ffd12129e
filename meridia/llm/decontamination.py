"""Benchmark decontamination: BM25 search of test items for every training passage, then an overlap check.

The test items are the indexed collection; every passage of every training document is a query. Impacts are
divided by the score an item has against itself, so 1 means that a passage holds all of an item's terms and
one threshold suits short and long items. Items are searched by their length: those of at most 4^k words, and more than a quarter as many,
meet passages of 2 * 4^k words that overlap by half, so that every run of words as long as an item lies whole inside one passage,
and how long other items are changes no item's passages.

The search is block-max WAND, over all passages of a document at once: passages are passed over whose lists' maxima can't
reach the threshold, then blocks of items whose block maxima can't, and the items of the blocks that are left are
scored exactly. No item at or above the threshold is lost.

The index is bounded: items are dealt into parts of at most ``max_postings`` postings in expectation, and each part is
broadcast, searched by all passages and let go before the next is made. Document frequencies, lengths and self-scores are those of the
whole benchmark, in every part. Nothing is shuffled but the benchmark.

Nulls and empty texts: documents with null or empty text, and items without words, match nothing. A null
doc_id or item_id is carried as it is. Repeated rows are judged one by one. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_batches, materialise

WORD = re.compile(r"[^\W_]+")
#: where a test item says itself where its answer begins
ANSWER_MARK = re.compile(r"(?im)^\s*(?:answer|a|antwort|respuesta|réponse)\s*:")
RESULT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
NAMES = [column.split()[0] for column in RESULT.split(", ")]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def split_item(text: str | None) -> tuple[list[str], list[str]]:
    """Question words and answer words: parted at an answer mark, or else the last quarter answers."""
    text = text or ""
    mark = ANSWER_MARK.search(text)
    if mark and mark.start():
        return words_of(text[: mark.start()]), words_of(text[mark.end() :])
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def grams(words: list[str], width: int) -> set[tuple[str, ...]]:
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def overlap(part: list[str], passage: list[str], width: int = 3) -> float:
    """Share of the part's word n-grams that the passage holds; 1 for a part without words."""
    want = grams(part, width)
    if not want:
        return 1.0
    width = min(width, len(part))
    return len(want & grams(passage, width)) / len(want) if len(passage) >= width else 0.0


def reach_of(words: int) -> int:
    """The power of four that a number of words doesn't go beyond: half the words of the passages it is looked for in."""
    return 1 << -(-max(0, words - 1).bit_length() // 2) * 2


#: sums are taken in an array of all cells where it is not larger than this, else by sorting
DENSE = 1 << 22


def _summed(key: np.ndarray, weights: np.ndarray, cells: int) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """(cells or None where all are there in order, sums, the place of each key in them)."""
    if cells <= DENSE:
        return None, np.bincount(key, weights=weights, minlength=cells), key
    found, at = np.unique(key, return_inverse=True)
    return found, np.bincount(at, weights=weights, minlength=len(found)), at


class LengthIndex:
    """Postings of items of about one length by term, in blocks of neighbouring items, with the maxima of lists and blocks.

    Term t has block postings ``first[t] : first[t + 1]``; block posting j is for block ``blocks[j]``, whose largest impact is
    ``tops[j]`` and whose item postings are ``start[j] : start[j + 1]``. Terms are numbered over all lengths.
    """

    def __init__(self, rows: list[tuple[int, int, float]], terms: int, items: list[tuple[int, str]], reach: int, block: int = 4):
        self.items, self.block, self.reach = items, block, reach
        rows.sort()
        t, self.item, self.impact = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        self.per_item = -(-len(items) // block)  # blocks
        key = t.astype(np.int64) * (self.per_item + 1) + self.item // block
        heads = np.nonzero(np.diff(key, prepend=-1))[0]
        self.start = np.append(heads, len(rows))
        self.blocks = self.item[heads] // block
        self.tops = np.maximum.reduceat(self.impact, heads) if len(rows) else np.zeros(0)
        self.first = np.searchsorted(t[heads], np.arange(terms + 2))
        self.upper = np.zeros(terms + 1)
        np.maximum.at(self.upper, t, self.impact)
        self.words = [split_item(text) for _, text in items]

    def _expand(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ranges lo : hi, the number of the range and every place in it, one after another."""
        counts = hi - lo
        which = np.repeat(np.arange(len(lo)), counts)
        return which, np.arange(len(which)) + np.repeat(lo - np.cumsum(counts) + counts, counts)

    def search(self, window: np.ndarray, term: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
        """(window, item, score) of all items that reach the threshold, for distinct pairs (window, term), sorted.

        Windows whose list maxima can't reach it are passed over, then blocks whose maxima can't; items are scored
        exactly in the blocks that are left.
        """
        slack = 1e-9
        n = int(window.max()) + 1 if len(window) else 0
        may = np.bincount(window, weights=self.upper[term], minlength=n) + slack >= threshold
        keep = may[window]
        window, term = window[keep], term[keep]
        pair, j = self._expand(self.first[term], self.first[term + 1])
        key = window[pair] * np.int64(self.per_item) + self.blocks[j]
        _, sums, at = _summed(key, self.tops[j], n * self.per_item)
        keep = sums[at] + slack >= threshold
        key, j = key[keep], j[keep]
        posting, k = self._expand(self.start[j], self.start[j + 1])
        full = (key[posting] // self.per_item) * np.int64(len(self.items)) + self.item[k]
        cells, score, _ = _summed(full, self.impact[k], n * len(self.items))
        good = np.nonzero(score + slack >= threshold)[0]
        found = good if cells is None else cells[good]
        return [(int(c) // len(self.items), int(c) % len(self.items), float(score[i])) for i, c in zip(good, found)]

    def matches(self, words: list[str], ids: np.ndarray, limits: tuple[float, float, float]) -> Iterator[tuple]:
        """(item_id, score, question overlap, answer overlap, first word) of each verified item, best passage first."""
        threshold, question, answer = limits
        upper = self.upper[ids]
        if upper.sum() + 1e-9 < threshold:
            return
        place = np.nonzero(upper)[0]
        half, window = self.reach, 2 * self.reach
        last = max(0, -(-len(words) // half) - 2)
        best: dict[int, tuple] = {}
        for at in range(0, len(place), 200_000):  # a very long text in parts that share a window
            span = place[max(0, at - window) : at + 200_000]
            k = np.minimum(span // half, last)
            w, t = np.concatenate([k, np.maximum(np.minimum(span // half - 1, last), 0)]), np.tile(ids[span], 2)
            # words that repeat count each time here: a bound that asks for no sort
            keep = np.bincount(w, weights=self.upper[t])[w] + 1e-9 >= threshold
            pairs = np.unique(w[keep] * np.int64(len(self.upper)) + t[keep])
            for w, item, score in self.search(pairs // len(self.upper), pairs % len(self.upper), threshold):
                if item in best and best[item][1] >= score:
                    continue
                q, a = self.words[item]
                passage = words[w * half : w * half + window] if w < last else words[w * half :]
                found = overlap(q, passage), overlap(a, passage)
                if found[0] >= question and found[1] >= answer:
                    best[item] = (self.items[item][0], score, *found, w * half)
        yield from (best[i] for i in sorted(best))


class ItemIndex:
    """One part of the benchmark: an index for each length of items, and the numbers of all their terms."""

    def __init__(self, postings: list[tuple[str, int, float]], items: list[tuple[int, str, int]]):
        self.terms: dict[str, int] = {}
        of: dict[int, list[int]] = {}
        place = []
        for k, (_, _, length) in enumerate(items):
            mine = of.setdefault(reach_of(length), [])
            place.append(len(mine))
            mine.append(k)
        rows: dict[int, list] = {reach: [] for reach in of}
        for term, item, impact in postings:
            rows[reach_of(items[item][2])].append((self.terms.setdefault(term, len(self.terms) + 1), place[item], impact))
        self.lengths = [LengthIndex(rows[reach], len(self.terms), [items[k][:2] for k in of[reach]], reach) for reach in sorted(of)]

    def matches(self, text: str | None, *limits: float) -> list[tuple]:
        """All verified items of a text, shorter ones first; ``limits`` are the threshold and the shares of question and answer."""
        words = words_of(text)
        if not words or not self.terms:
            return []
        get = self.terms.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        return [hit for one in self.lengths for hit in one.matches(words, ids, limits)]


def index_parts(benchmark: DataFrame, k1: float, b: float, max_postings: int) -> Iterator[tuple[ItemIndex, int]]:
    """Index parts of bounded size one after the other, with the number of parts."""
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    words = F.pandas_udf(lambda texts: texts.map(words_of), "array<string>")
    items = items.withColumn("words", words("text")).where(F.size("words") > 0)
    items = materialise(items.withColumn("row", F.monotonically_increasing_id()), "items")
    n, mean = items.agg(F.count("*"), F.avg(F.size("words"))).first()
    if not n:
        return
    tf = items.select("row", F.size("words").alias("dl"), F.explode("words").alias("term"))
    tf = tf.groupBy("row", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean)))
    impacts = materialise(tf.join(df, "term").select("row", "term", weight.alias("impact")), "impacts")
    parts = -(-impacts.count() // max_postings)
    own = impacts.groupBy("row").agg(F.sum("impact").alias("own"))
    scaled = impacts.join(own, "row").select("row", "term", (F.col("impact") / F.col("own")).alias("impact"))
    for part in range(parts):
        mine = F.pmod(F.xxhash64("row"), F.lit(parts)) == part
        rows = items.where(mine).select("row", "item_id", "text", F.size("words").alias("length")).orderBy("item_id", "row").collect()
        at = {r["row"]: k for k, r in enumerate(rows)}
        postings = [(r["term"], at[r["row"]], r["impact"]) for r in scaled.where(mine).collect()]
        yield ItemIndex(postings, [(r["item_id"], r["text"], r["length"]) for r in rows]), parts


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.6,
    question: float = 0.6,
    answer: float = 0.5,
    k1: float = 1.2,
    b: float = 0.75,
    max_postings: int = 2_000_000,
) -> DataFrame:
    """One row per document row and test item found in it, with the best verified passage.

    ``threshold``: BM25 as a share of the item's own score. ``question``/``answer``: shares of the word
    trigrams of the item's two parts that the passage must hold. See the module for nulls and empty input.
    """
    out = None
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(shared) -> DataFrame:
        return map_batches(slim, _finder(shared, (threshold, question, answer)), RESULT)

    for found in _part_by_part(benchmark, k1, b, max_postings, search):
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], RESULT)


def _part_by_part(benchmark: DataFrame, k1: float, b: float, max_postings: int, search) -> Iterator[DataFrame]:
    """``search(broadcast index)`` for each part; where there are several, its result is written and the part let go
    before the next is made, so that one is held at a time."""
    sc = benchmark.sparkSession.sparkContext
    for index, parts in index_parts(benchmark, k1, b, max_postings):
        shared = sc.broadcast(index)
        found = search(shared)
        if parts > 1:
            found = materialise(found, "searched")
            shared.destroy()
        yield found


def _finder(shared, limits: tuple):
    def start():
        index = shared.value

        def find(batch: dict) -> dict:
            rows = [
                (doc, *hit) for doc, text in zip(batch["doc_id"], batch["text"]) for hit in index.matches(text, *limits)
            ]
            return dict(zip(NAMES, zip(*rows))) if rows else {name: [] for name in NAMES}

        return find

    return start


def _judge(shared, limits: tuple):
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.matches(t, *limits) for t in texts], dtype=bool)

    return F.pandas_udf(judge, "boolean")


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.6,
    question: float = 0.6,
    answer: float = 0.5,
    k1: float = 1.2,
    b: float = 0.75,
    max_postings: int = 2_000_000,
) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns kept, without a join; a filter for each part of the index."""
    left = docs

    def search(shared) -> DataFrame:
        return left.where(_judge(shared, (threshold, question, answer))(F.col("text").cast("string")))

    for left in _part_by_part(benchmark, k1, b, max_postings, search):  # noqa: B007  each part searches what the last one left
        pass
    return left


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the evidence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
