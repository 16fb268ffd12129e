"""Repeated rows, ties, clashing columns and odd texts, and a brute-force BM25 search of whole results."""

import math
from collections import Counter

import numpy as np
import pytest
from helpers import odd_documents
from pyspark.sql import functions as F

from meridia.llm import decontamination, licenses, mixing, near_duplicates, shards


def brute_bm25(docs, items, threshold=0.6, question=0.6, answer=0.5, k1=1.2, b=0.75):
    """(doc, item, score, overlaps, first word) of every item found, from scores of all items against all passages."""
    split = {i: decontamination.words_of(t) for i, t in items if t and decontamination.words_of(t)}
    n, mean = len(split), np.mean([len(w) for w in split.values()])
    df = Counter(t for w in split.values() for t in set(w))
    impact = {}
    for i, w in split.items():
        for t, tf in Counter(w).items():
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            impact[i, t] = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean))
    own = {i: sum(impact[i, t] for t in set(w)) for i, w in split.items()}
    parts = {i: decontamination.split_item(t) for i, t in items if i in split}
    out = []
    for doc, text in docs:
        words = decontamination.words_of(text)
        for i in split:
            longest = decontamination.reach_of(len(split[i]))
            last = max(0, -(-len(words) // longest) - 2)
            best = None
            for w in range(last + 1):
                passage = words[w * longest : w * longest + 2 * longest] if w < last else words[w * longest :]
                score = sum(impact[i, t] for t in set(passage) if (i, t) in impact) / own[i]
                if score < threshold - 1e-9 or (best and best[2] >= score - 1e-12):
                    continue
                over = [decontamination.overlap(p, passage) for p in parts[i]]
                if over[0] >= question and over[1] >= answer:
                    best = (doc, i, score, *over, w * longest)
            if best:
                out.append(best)
    return out


def rounded(rows):
    return sorted(((str(d), i, *(round(float(x), 6) for x in (s, q, a)), w) for d, i, s, q, a, w in rows), key=str)


@pytest.mark.parametrize("postings", [2_000_000, 400])
def test_whole_results_equal_brute_force(spark, postings):
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{k}" for k in rng.zipf(1.3, n) % 300]
    items = [(k, " ".join(word(int(rng.integers(8, 30))))) for k in range(60)] + [(60, None), (61, " . "), (62, "tie and tie"), (63, "tie and tie")]
    rows = []
    for d in range(120):
        body = word(int(rng.integers(1, 150)))
        if d % 2:
            piece = items[int(rng.integers(0, 60))][1].split()
            for _ in range(d % 7):
                piece[int(rng.integers(0, len(piece)))] = "other"
            body[len(body) // 2 : len(body) // 2] = piece
        rows.append((d, " ".join(body)))
    rows += [(200, "a tie and tie here"), (200, "a tie and tie here"), (None, "a tie and tie here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("item_id", "score", "first_word", "row", "words")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("doc_id", "row", "words", "term", "tf", "dl")})
    want = brute_bm25(rows, items)
    got = decontamination.contaminated(docs, bench, max_postings=postings)
    assert rounded(map(tuple, got.collect())) == rounded(want) and len(want) > 25
    assert sum(w[0] == 200 for w in want) == 4  # both rows, both of the equal items
    left = decontamination.without_contaminated(docs, bench, max_postings=postings)
    assert left.columns == docs.columns
    bad = {str(w[0]) for w in want}
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(d) for d, _ in rows if str(d) not in bad)


def test_other_items_lengths_change_nothing(spark):
    """An item of 8 words in pieces over a long text isn't found, however long another item is; one of 2,000 words is found whole."""
    rng = np.random.default_rng(9)
    short, filler = "alpha beta gamma delta epsilon zeta eta theta", [f"f{k}" for k in rng.integers(0, 5000, 1800)]
    pieces = list(filler)
    for k, w in enumerate(short.split()):
        pieces[k * 220] = w
    long_item = " ".join(f"long{k}" for k in rng.integers(0, 3000, 2000))
    texts = [" ".join(pieces), " ".join([*filler[:900], short, *filler[900:]]), " ".join([*filler[:300], long_item, *filler[:50]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for items in ([(1, short)], [(1, short), (2, long_item)]):
        got = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
        found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
        assert found == {(1, 1)} | ({(2, 2)} if len(items) == 2 else set())
    assert rounded(map(tuple, got.collect())) == rounded(brute_bm25(list(enumerate(texts)), items))


def test_licenses_with_clashing_columns_and_repeats(spark):
    odd = odd_documents(spark)
    more = odd.limit(1).select(F.lit(50).cast("long").alias("doc_id"), F.lit("Words.\nReleased under the MIT License.").alias("text"), *(F.lit("clash").alias(c) for c in ("place", "part", "row", "sentence_id", "license", "kept")))
    both = more.unionByName(more).unionByName(odd.select("doc_id", "text"), allowMissingColumns=True)
    got = [tuple(r) for r in licenses.license_matches(both).collect()]
    assert got == [(50, "MIT", "mit-named", 1, 1)] * 2


def test_stages_keep_clashing_columns(spark):
    odd = odd_documents(spark).withColumns({c: F.lit("clash") for c in ("row", "name", "n", "goes", "source_size", "_part", "_row", "_before")})
    for out in (near_duplicates.one_of_each_similar(odd), near_duplicates.one_of_each_group(odd), mixing.mixed(odd)):
        assert out.columns == odd.columns and out.count() > 0


def test_shards_of_very_long_texts(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/long", target_bytes=1 << 20, small_bytes=1 << 16, fan_in=2)
    rows = spark.range(6).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long text "), 200_000).alias("text"))
    for k in range(2):
        store.append(rows.where(f"doc_id % 2 = {k}"))
    store.compact()
    assert store.read().agg(F.count("*"), F.sum(F.length("text"))).first() == (6, 12_000_000)
