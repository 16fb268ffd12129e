"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Folding undoes disguises: compatibility forms, case, look-alike letters of other scripts, digits and signs that stand for
letters, invisible characters; marks become spaces. Entries are whole words or beginnings of words. They come from a short
fixed list and from labelled rows: beginnings and words that toxic texts hold far more often than others. Each
entry weighs the logarithm of its odds. Exception phrases take back the weight of the entries they cover.

The sum of the weights is divided by a power of the text's length in words, and a logistic curve fitted to the labels
turns it into a score. The curve stays below 0.25 for a text that holds no entry. Learning takes a bounded hash sample of
labelled rows (``max_rows``); its counts are Spark aggregations. What reaches the driver is bounded with the sample: an entry
is in a ``share`` of its toxic texts, so there are at most 1 / share times as many as an average one has words and beginnings.
Scoring reads whole texts.

Nulls and empty texts hold no entry and score as such a text. Rows with null labels or doc_ids are not learned from; a doc_id
that repeats is learned from once, as in ``quality.labelled``. Repeated rows are scored one by one; an empty table
gives an empty result. Only the text is read for a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import SCORED, labelled, with_verdict
from .quality import held_out as in_fold
from .shared import map_batches, materialise

# Words that insult in common usage, phrases that excuse them, look-alikes and stand-ins.
SEEDS = """idiot moron stupid loser scum trash clown pathetic worthless disgusting imbecile dumbass bastard asshole bitch
dickhead retard jackass degenerate vermin subhuman parasite filth halfwit dimwit cretin lowlife scumbag wanker twat
dummkopf vollidiot arschloch abschaum versager connard abruti ordure salaud imbécile gilipollas pendejo cabrón""".split()
EXCEPTIONS = ["clown fish", "class clown", "trash can", "trash bin", "trash bag", "pond scum", "sore loser", "pathetic fallacy", "stupid mistake"]
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m",
    "т": "t", "н": "h", "в": "b", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
MARKS = "".join(map(chr, range(33, 127)))
#: highest log odds of a text that holds no entry
CLEAN = -1.1

_FOLD = {ord(c): " " for c in MARKS if not c.isalnum()} | {ord(c): " " for c in "\t\n\r\x0b\x0c«»„“”‘’‚…–—¿¡·•‹›"}
_FOLD |= {ord(a): b for a, b in LOOK_ALIKES.items()} | {ord(a): b for a, b in STAND_INS.items()}
_FOLD |= {ord(c): None for c in INVISIBLE}
#: a sign inside a word stands for a letter too
_INNER = re.compile(r"(?<=[^\W_])[!|](?=[^\W_])")


def fold(text: str | None) -> str:
    """Folded text, words parted by spaces, with a space before the first word and behind the last."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "!" in text or "|" in text:
        text = _INNER.sub("i", text)
    return f" {text.translate(_FOLD)} "


@dataclass
class Lexicon:
    """Entries as they stand in folded text (" word " or " beginning") with weights, and the score's curve."""

    entries: dict[str, float]
    exceptions: list[str]
    slope: float = 1.0
    bias: float = -2.0
    power: float = 0.25

    def automaton(self):
        weights = dict(self.entries)
        for phrase in self.exceptions:
            folded = fold(phrase)
            inner = sum(w for e, w in self.entries.items() if e in folded)
            if inner:
                weights[folded] = weights.get(folded, 0.0) - inner
        if not weights:
            weights[" \0"] = 0.0
        tree = ahocorasick.Automaton()
        for entry, weight in weights.items():
            tree.add_word(entry, weight)
        tree.make_automaton()
        return tree

    def strength(self, tree, text: str | None) -> float:
        """Weight of all hits over length."""
        folded = fold(text)
        total = sum(w for _, w in tree.iter(folded))
        if total <= 0:
            return 0.0
        return math.log1p(total / max(1, len(folded.split())) ** self.power)

    def score(self, strength: float) -> float:
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.slope * strength + self.bias))))


def _candidates(text: str | None, shortest: int, longest: int) -> set[str]:
    out = set()
    for word in set(fold(text).split()):
        if len(word) >= 3:
            out.add(f" {word} ")
            out.update(" " + word[:k] for k in range(shortest, min(longest, len(word)) + 1))
    return out


def _counted(rows: DataFrame, shortest: int, longest: int, only=None) -> DataFrame:
    """(entry, n): texts of ``rows(text)`` that hold each candidate; counted within batches first."""

    def start():
        wanted = only.value if only is not None else None

        def count(batch: dict) -> dict:
            found: Counter = Counter()
            for text in batch["text"]:
                held = _candidates(text, shortest, longest)
                found.update(held if wanted is None else held & wanted)
            return {"entry": list(found), "n": list(found.values())}

        return count

    return map_batches(rows.select("text"), start, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _chosen(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least: int, ratio: float) -> dict[str, float]:
    """Entries far likelier in toxic texts; a longer entry only where no shorter one that begins it serves."""
    odds = {}
    for entry, n in toxic.items():
        weight = math.log(((n + 0.5) / (n_toxic + 1)) / ((clean.get(entry, 0) + 0.5) / (n_clean + 1)))
        if n >= least and weight >= math.log(ratio):
            odds[entry] = weight
    # a beginning gives way to a longer entry that accounts for nearly all of its toxic texts
    longer: dict[str, int] = {}
    for entry in odds:
        stem = entry.rstrip()
        for k in range(2, len(stem) + (entry != stem)):
            longer[stem[:k]] = max(longer.get(stem[:k], 0), toxic[entry])
    out: dict[str, float] = {}
    for entry in sorted(odds, key=lambda e: (len(e.strip()), e)):
        stem = entry.rstrip()
        begun = any(stem[:k] in out for k in range(2, len(stem) + (entry != stem)))
        if not begun and longer.get(entry, 0) < 0.9 * toxic[entry]:
            out[entry] = odds[entry]
    return out


def learn(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 16_000,
    shortest: int = 4,
    longest: int = 7,
    least: int = 3,
    share: float = 0.008,
    ratio: float = 30.0,
    power: float = 0.25,
    exceptions: list[str] | None = None,
) -> Lexicon:
    """A lexicon from ``docs(doc_id, text)`` and ``labels(doc_id, y)``.

    An entry must be held by ``least`` toxic texts of the sample, and by a ``share`` of them, and be ``ratio`` times
    likelier in toxic texts.
    """
    spark = docs.sparkSession
    rows = materialise(labelled(docs, labels, max_rows).select("y", "text"), "labelled")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    least = max(least, math.ceil(share * n_toxic))
    common = _counted(rows.where("y = 1"), shortest, longest).where(F.col("n") >= least)
    toxic = {r["entry"]: r["n"] for r in common.collect()}
    wanted = spark.sparkContext.broadcast(frozenset(toxic))
    clean = {r["entry"]: r["n"] for r in _counted(rows.where("y = 0"), shortest, longest, wanted).collect()}
    entries = _chosen(toxic, clean, n_toxic, n_clean, least, ratio)
    usual = math.log(ratio)
    for word in SEEDS:
        entry = fold(word)
        if not any(entry.startswith(e) for e in entries):
            entries.setdefault(entry, usual)
    lexicon = Lexicon(entries, EXCEPTIONS if exceptions is None else exceptions, power=power)
    if n_toxic and n_clean:
        lexicon.slope, lexicon.bias = _curve(rows, lexicon)
    return lexicon


def _curve(rows: DataFrame, lexicon: Lexicon, steps: int = 30) -> tuple[float, float]:
    """Slope and bias of the logistic curve through (strength, label), from counts by rounded strength; at most ``CLEAN`` at 0."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def start():
        own = shared.value
        tree = own.automaton()
        return lambda batch: {"y": batch["y"], "x": [round(own.strength(tree, t), 2) for t in batch["text"]]}

    found = map_batches(rows, start, "y int, x double").groupBy("x").agg(F.sum("y").alias("ones"), F.count("*").alias("n"))
    table = np.array([(r["x"], r["ones"], r["n"]) for r in found.collect()], dtype=np.float64)
    x, ones, n = table.T
    slope, bias = 1.0, -1.0
    for _ in range(steps):  # Newton, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * x + bias, -35, 35)))
        g = np.array([((ones - n * p) * x).sum() - 0.5 * slope, (ones - n * p).sum() - 0.01 * bias])
        w = n * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        slope, bias = slope + np.clip(step[0], -2, 2), bias + np.clip(step[1], -2, 2)
    return float(max(slope, 0.0)), float(min(bias, CLEAN))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def start():
        own = shared.value
        tree = own.automaton()
        return lambda batch: {
            "doc_id": batch["doc_id"],
            "score": [own.score(own.strength(tree, t)) for t in batch["text"]],
        }

    return map_batches(slim, start, SCORED)


def without_toxic(docs: DataFrame, lexicon: Lexicon, limit: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns kept; a filter, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def judge(texts: pd.Series) -> pd.Series:
        own = shared.value
        tree = own.automaton()
        return pd.Series([own.score(own.strength(tree, t)) < limit for t in texts], dtype=bool)

    return docs.where(F.pandas_udf(judge, "boolean")(F.col("text").cast("string")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("y"))
    lexicon = learn(docs, labels.where(~in_fold(2, 4)))
    return with_verdict(score(docs, lexicon), 2, 4)
