"""Learned operators by held-out accuracy, shards and pipeline by round trips."""

import math
import re
from zlib import crc32

import numpy as np
import pytest
from helpers import no_documents, odd_documents
from pyspark.sql import functions as F

from meridia.llm import quality, shards, toxicity
from meridia.llm.queries import QUERIES


def held_out(spark, sf_dir, name, column):
    """Accuracy, and the chance that a row labelled 1 outscores one labelled 0, over rows that were not learned from."""
    rows = QUERIES[name](spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").toPandas()
    ones, zeros = rows.score[rows[column] == 1].to_numpy(), rows.score[rows[column] == 0].to_numpy()
    assert len(ones) > 10 and len(zeros) > 10
    auc = ((ones[:, None] > zeros[None]) + 0.5 * (ones[:, None] == zeros[None])).mean()
    return (rows.predicted == rows[column]).mean(), auc


def test_quality(spark):
    accuracy, auc = held_out(spark, "/root/testdata/sf0.1", "op7_quality", "quality")
    assert accuracy > 0.95 and auc > 0.98


def test_toxicity(spark):
    accuracy, auc = held_out(spark, "/root/testdata/sf0.1", "op9_toxicity", "toxic")
    assert accuracy > 0.95 and auc > 0.93


def plain_quality(text, weights, bits=18, gain=50.0):
    """The score of one text by a loop over its tokens, with Python's integers."""
    tokens = re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", text or "")
    h = [crc32(t.encode()) for t in tokens]
    mask = (1 << 64) - 1
    found = [(x * 0x9E3779B97F4A7C15 & mask) >> (64 - bits) for x in h]
    for a, b in zip(h, h[1:]):
        two = 0x5BD1E995 if a == b else (a * 0x9E3779B1 + b * 0x85EBCA6B) & mask
        found.append((two * 0xC2B2AE3D27D4EB4F & mask) >> (64 - bits))
    total = float(weights[-1]) + (sum(float(weights[f]) for f in found) * gain / len(found) if found else 0.0)
    return 1 / (1 + math.exp(-total))


def test_quality_scores_equal_a_plain_loop(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("y")))
    texts = sorted((str(r["doc_id"]), plain_quality(r["text"], weights)) for r in docs.collect())
    got = sorted((str(r["doc_id"]), r["score"]) for r in quality.score(docs, weights).collect())
    assert [g[0] for g in got] == [t[0] for t in texts] and np.allclose([g[1] for g in got], [t[1] for t in texts], atol=1e-9)


def plain_toxicity(text, lexicon):
    """The score of one text by searching every entry at every place."""
    folded = toxicity.fold(text)
    count = lambda entry: sum(folded.startswith(entry, k) for k in range(len(folded)))
    total = sum(w * count(e) for e, w in lexicon.entries.items())
    for phrase in map(toxicity.fold, lexicon.exceptions):
        total -= sum(w for e, w in lexicon.entries.items() if e in phrase) * count(phrase)
    strength = math.log1p(total / max(1, len(folded.split())) ** lexicon.power) if total > 1e-12 else 0.0
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, lexicon.slope * strength + lexicon.bias))))


def test_toxicity_scores_equal_a_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    docs = docs.where("text IS NULL OR length(text) < 20000")
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("y")))
    lexicon.entries = dict(sorted(lexicon.entries.items())[:60]) | {" idiot ": 3.0, " clown ": 3.0}
    docs = docs.unionByName(spark.createDataFrame([(900, "The class clown is an 1d10t, a clown fish")], "doc_id long, text string"))
    want = sorted((str(r["doc_id"]), plain_toxicity(r["text"], lexicon)) for r in docs.collect())
    got = sorted((str(r["doc_id"]), r["score"]) for r in toxicity.score(docs, lexicon).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-9)


def test_ftrl_separates_and_averages():
    rows = [(np.array([y, 2]), np.array([1.0, 1.0]), y) for y in (0, 1)] * 50
    w = quality.ftrl(rows, 2, 3, 1.0, 1.0, 0.01, 0.01)
    assert w[1] > 0.5 > -0.5 > w[0]


def test_scores_of_odd_rows(spark):
    odd = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (7, None), (9, 0), (9, 0)], "doc_id long, y int")
    weights = quality.train(odd.select("doc_id", "text"), labels)
    scores = {}
    for r in quality.score(odd, weights).collect():
        scores.setdefault(r["doc_id"], []).append(r["score"])
    assert sorted(map(len, scores.values())) == [1] * 8 + [2]
    assert scores[2] == scores[3] == scores[4] == [1 / (1 + math.exp(-float(weights[-1])))]
    assert scores[1] == scores[6] and scores[1][0] > 0.5 > scores[9][0] == scores[9][1]
    assert quality.score(no_documents(spark), weights).count() == 0
    lexicon = toxicity.learn(odd, labels)
    held = {r["doc_id"]: r["score"] for r in toxicity.score(odd, lexicon).collect()}
    nothing = lexicon.score(0.0)
    assert nothing < 0.25 and {held[k] for k in (None, 2, 3, 4, 7, 8)} == {nothing}
    assert toxicity.score(no_documents(spark), lexicon).count() == 0
    kept = toxicity.without_toxic(odd, lexicon)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in toxicity.score(odd, lexicon).where("score < 0.3").collect())


def test_labels_of_one_kind_and_none(spark):
    odd = odd_documents(spark).select("doc_id", "text")
    ones = spark.createDataFrame([(1, 1), (9, 1)], "doc_id long, y int")
    assert all(r["score"] > 0.5 for r in quality.score(odd, quality.train(odd, ones)).collect())
    assert all(r["score"] == 0.5 for r in quality.score(odd, quality.train(odd, ones.limit(0))).collect())
    assert toxicity.learn(odd, ones.limit(0)).score(0.0) < 0.25


def test_repeated_ids_are_learned_from_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, 1)], "doc_id long, y int")
    assert sorted(tuple(r) for r in quality.labelled(docs, labels, 100).collect()) == [(1, 1, "a"), (2, 0, None)]


def test_disguises_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " clown ": 3.0, " scu": 3.0}, ["clown fish"], slope=4.0, bias=-3.0)
    tree = lexicon.automaton()
    held = lambda t: lexicon.strength(tree, t) > 0
    assert all(held(t) for t in ("You IDIOT!", "an 1d10t", "іdiоt", "id­iot", "id!ot", "ｉｄｉｏｔ", "idiot idiot", "scumbag"))
    assert not any(held(t) for t in ("", None, "idiotic", "a clown fish", "Clown-Fish", "obscure"))
    assert held("a clown fish and a clown")
    assert lexicon.strength(tree, "idiot " + "word " * 500) < lexicon.strength(tree, "idiot")


def store(spark, tmp_path, **options):
    return shards.ShardStore(spark, f"file://{tmp_path}/set", **{"target_bytes": 40_000, "small_bytes": 4_000, "fan_in": 3} | options)


def test_shards_keep_all_rows(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = store(spark, tmp_path)
    for k in range(3):
        s.append(docs.where(f"doc_id % 3 = {k}").repartition(4))
    before = s.shards()
    assert s.version() == 3
    s.compact()
    after = s.shards()
    assert s.version() > 3 and len(after) < len(before) and s.head()["settled"]
    assert all(x["n_bytes"] <= 1.5 * 40_000 for x in after)
    tiers = [x["tier"] for x in s.head()["open"]]
    assert all(tiers.count(t) < 3 for t in tiers)
    want = sorted(map(repr, docs.collect()))
    assert sorted(map(repr, s.read().collect())) == want == sorted(map(repr, s.read(3).collect()))
    assert s.vacuum() > 0 and s.vacuum() == 0
    assert sorted(map(repr, s.read().collect())) == want
    assert s.compact() == s.version()


def test_groups_follow_the_tiers(spark, tmp_path):
    s = store(spark, tmp_path, target_bytes=1000, small_bytes=100, fan_in=3)
    shard = lambda n: {"path": f"p{n}", "n_bytes": n, "tier": s.tier(n)}
    assert [s.tier(n) for n in (1, 100, 101, 300, 301, 900, 901)] == [0, 0, 1, 1, 2, 2, 3]
    assert [[x["n_bytes"] for x in g] for g in s._groups([shard(n) for n in (90, 20, 60, 250, 310, 240)])] == [[20, 60, 90]]
    assert [[x["n_bytes"] for x in g] for g in s._groups([shard(n) for n in (250, 260, 270, 280, 290, 10)])] == [[250, 260, 270], [280, 290]]


def test_of_two_writers_one_fails(spark, tmp_path):
    s = store(spark, tmp_path)
    base = s.head()
    assert s._commit(base, []) == 1
    with pytest.raises(Exception, match="exist"):
        s._commit(base, [])


def test_appends_try_again(spark, tmp_path, monkeypatch):
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    commit, first = s._commit, []

    def late(*args, **options):
        if not first:
            first.append(other.append(rows))
        return commit(*args, **options)

    monkeypatch.setattr(s, "_commit", late)
    assert s.append(rows) == 2 and s.read().count() == 2


def test_columns_come_and_go(spark, tmp_path):
    s = store(spark, tmp_path, small_bytes=4_000, fan_in=2)
    s.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    s.append(spark.createDataFrame([(2, "b", 0.5)], "doc_id long, text string, extra double"))
    s.append(spark.createDataFrame([(3,)], "doc_id long"))
    want = [(1, "a", None), (2, "b", 0.5), (3, None, None)]
    assert sorted(tuple(r) for r in s.read().collect()) == want
    s.compact()
    assert len(s.shards()) < 3 and sorted(tuple(r) for r in s.read().collect()) == want
    with pytest.raises(ValueError, match="doc_id"):
        s.append(spark.createDataFrame([("4",)], "doc_id string"))


def test_vacuum_leaves_what_is_not_yet_committed(spark, tmp_path, monkeypatch):
    s, other = store(spark, tmp_path, fan_in=2), store(spark, tmp_path)
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for _ in range(3):
        s.append(rows)
    commit = other._commit

    def late(*args, **options):
        s.compact()
        assert s.vacuum() >= 3
        return commit(other.head(), other.head()["open"] + args[1][-1:], *args[2:], **options)

    monkeypatch.setattr(other, "_commit", late)
    other.append(rows)
    assert s.read().count() == 4 and s.vacuum(older_than=-60) == 0


def test_shards_of_odd_and_no_rows(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.read() is None and s.compact() == 0
    s.append(no_documents(spark))
    assert s.shards() == []
    odd = odd_documents(spark)
    s.append(odd)
    s.compact()
    assert sorted(map(repr, s.read().select(odd.columns).collect())) == sorted(map(repr, odd.collect()))


def test_shard_query(spark, sf_dir):
    got = sorted(tuple(r) for r in QUERIES["op10_shards"](spark, sf_dir).select("doc_id", "n_bytes", "text_crc32", "lang", "source", "n_chars").collect())
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got == sorted((r["doc_id"], len(r["text"].encode()), crc32(r["text"].encode()), r["lang"], r["source"], r["n_chars"]) for r in rows)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        seen[name] = (docs.count(), out.count())
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert all(0 < after <= before for n, (before, after) in seen.items() if n != "mixing")
    bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(b in (r["text"] or "") for r in docs.collect() for b in bench)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert tokens.count() == docs.count()
