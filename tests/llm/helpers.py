"""Brute-force versions of the corpus operators, and odd rows that all of them must take."""

import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    """Nulls in any column, empty and blank texts, repeats, a very long text, columns with clashing names."""
    long_text = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [
        (1, "plain words stand here in a row", "en", "a", 31), (2, None, "en", "a", 0), (3, "", None, "b", 0), (4, " \t\n ", "en", None, 4), (None, "no id here", "en", "b", 10),
        (6, "plain words stand here in a row", "en", "a", 31), (7, long_text, "en", "c", len(long_text)), (8, "ß ñ é 日本語 ́x", None, None, None), (9, "<|endoftext|> it's 12 'LL !!", "en", "c", 1), (9, "<|endoftext|> it's 12 'LL !!", "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = ["taken", "size", "h", "_s", "_n", "_id", "score", "fp", "target", "threshold", "whole", "value"]
    return df.withColumns({c: F.lit("clash") for c in clash})


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text, width=3):
    w = words(fold(text))
    if not w:
        return 0
    width = min(width, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(len(w) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, pairs):
    """For 0..n-1 the smallest number reachable by the pairs."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return [find(x) for x in range(n)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def mix_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated resharing; ``sizes`` in source order."""
    w = {s: weights[k % len(weights)] for k, s in enumerate(sizes)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in full]
        left, all_w = total - sum(full.values()), sum(w[s] for s in free)
        share = {s: left * w[s] / all_w for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return share | full
        full |= {s: most * sizes[s] for s in over}
