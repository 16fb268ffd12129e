"""Near copies by the similarity of their shingle sets, held against all pairs."""

import itertools

import corpus_pipeline
import numpy as np
from helpers import DOCS, classes, fold, no_documents, odd_documents, simhash, words


def shingle_set(text, width=5):
    w = words(fold(text))
    return {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()


def brute_kept(rows):
    """Smallest ids of the groups; ``rows`` of (doc_id, text) by doc_id."""
    sets = [shingle_set(t) for _, t in rows]
    near = lambda s, t: s == t or len(s & t) / len(s | t) >= 0.8
    found = classes(len(rows), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if near(sets[a], sets[b])])
    return [rows[k][0] for k in range(len(rows)) if found[k] == k]


def stage(spark, docs, sf_dir):
    return sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf_dir).select("doc_id").collect())


def test_stage_finds_all_similar_texts(spark, sf_dir):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        base = [f"w{k}" for k in rng.integers(0, 5000, 200)]
        rows.append(base)
        for changed in range(1, 9):
            copy = list(base)
            for at in rng.choice(200, changed, replace=False):
                copy[at] = "Changed"
            rows.append(copy)
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    kept = stage(spark, spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS), sf_dir)
    assert kept == brute_kept(rows) and 40 < len(kept) < 300


def test_stage_on_the_table_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    assert stage(spark, docs, sf_dir) == brute_kept(rows)
    odd = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, odd_documents(spark), sf_dir)
    assert odd.columns == odd_documents(spark).columns
    assert sorted(str(r["doc_id"]) for r in odd.collect()) == ["1", "2", "7", "8", "9", "None"]
    assert dict(corpus_pipeline.STAGES)["near_duplicates"](spark, no_documents(spark), sf_dir).count() == 0


def test_a_large_loose_cluster_and_long_texts(spark, sf_dir, monkeypatch):
    """Copies of one text, each changed on its own, so that few are similar to the first: chunks must find all classes."""
    from meridia.llm import near_duplicates

    monkeypatch.setattr(near_duplicates, "CHUNK", 40)
    monkeypatch.setattr(near_duplicates, "SHINGLES", 3000)
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in rng.integers(0, 5000, 150)]
    rows = []
    for k in range(400):
        copy = list(base)
        for at in rng.choice(150, int(rng.integers(1, 7)), replace=False):
            copy[at] = f"x{rng.integers(0, 50)}"
        rows.append((k, " ".join(copy)))
    long = [f"v{k}" for k in rng.integers(0, 9000, 8000)]
    rows += [(500, " ".join(long)), (501, " ".join([*long[:4000], "y", *long[4000:]])), (502, " ".join(reversed(long)))]
    kept = stage(spark, spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS), sf_dir)
    assert kept == brute_kept(rows) and kept[-2:] == [500, 502]


def test_stage_takes_candidates_from_fingerprints_too(spark, sf_dir, monkeypatch):
    """Without a shared band, texts that op3 links are compared all the same, and the similarity of their sets decides."""
    from meridia.llm import near_duplicates

    monkeypatch.setattr(near_duplicates, "bands", lambda hashes: [])
    rows, seed = [], 0
    while len(rows) < 40:
        rng, seed = np.random.default_rng(seed), seed + 1
        base = [f"w{k}" for k in rng.integers(0, 5000, 300)]
        copy = list(base)
        for at in rng.choice(300, 12 if len(rows) % 4 else 3, replace=False):
            copy[at] = "changed"
        if (simhash(" ".join(base)) ^ simhash(" ".join(copy))).bit_count() <= 3:
            rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate((base, copy))]
    kept = stage(spark, spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS), sf_dir)
    assert kept == brute_kept(rows) and kept == [k for k, _ in rows if k % 4 != 1]
