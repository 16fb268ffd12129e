"""Language identification: kernels against sets, weights against one dense solution, odd texts, held-out rows."""

import numpy as np
from helpers import no_documents, odd_documents
from pyspark.sql import functions as F

from meridia.llm import language as la


def gram_set(text, longest):
    t = la.folded(text)
    return {t[i : i + n] for n in range(1, longest + 1) for i in range(len(t) - n + 1)}


def test_grams_are_the_distinct_strings():
    for text in ["Abc abc, ABCD 12!", "x", "日本語 テスト 𝔘𝔫𝔦", "ß" * 7]:
        assert len(la.grams(la.folded(text), 3)) == len(gram_set(text, 3))
    assert not len(la.grams("", 3))
    block, la.BLOCK = la.BLOCK, 5
    try:
        long = la.folded("the quick brown fox jumps over the lazy dog " * 3)
        in_blocks = la.grams(long, 3)
    finally:
        la.BLOCK = block
    assert np.array_equal(in_blocks, la.grams(long, 3))


def test_kernels_equal_sets():
    marks = ["the cat sat", "der hund lief", "chat et chien", "Ω"]
    texts = ["the dog ran", "ein hund", "", "12", "le chat"]
    k = la.Landmarks.of(marks, 3).kernels()([la.folded(t) for t in texts])
    for i, t in enumerate(texts):
        for j, m in enumerate(marks):
            a, b = gram_set(t, 3), gram_set(m, 3)
            assert abs(k[i, j] - (len(a & b) / (len(a) * len(b)) ** 0.5 if a else 0)) < 1e-6


def test_weights_equal_a_dense_solution(spark):
    words = {"aa": ["kala", "tala", "mala"], "bb": ["fisk", "risk", "disk"], "cc": ["ovo", "uvo", "ivo"]}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[g], 5)), g) for i in range(90) for g in [["aa", "bb", "cc"][i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = la.learn(docs, landmarks=12, ridge=0.01)
    assert model.languages == ["aa", "bb", "cc"] and model.weights.shape == (12, 3)
    of = model.landmarks.kernels()
    k = of([la.folded(t) for _, t, _ in rows])
    y = np.array([[1.0 if g == name else -1.0 for name in model.languages] for _, _, g in rows])
    chosen = [t for t in {t for _, t, _ in rows} if np.any(np.isclose(of([la.folded(t)])[0], 1))]
    own = np.zeros((12, 12))
    for t in chosen:  # a landmark's row of kernels with the others
        row = of([la.folded(t)])[0]
        own[np.isclose(row, 1)] = row
    residual = (k.T @ k + 0.01 * 90 * own + 1e-9 * 90 * np.eye(12)) @ model.weights - k.T @ y
    assert np.abs(residual).max() < 1e-4
    got = {r["doc_id"]: r["lang_pred"] for r in la.predicted(docs, model).collect()}
    assert all(got[i] == g for i, _, g in rows)


def test_odd_texts(spark):
    docs = spark.createDataFrame([(k, "plain words stand in a row", "en", "s", 1) for k in range(20)] + [(30 + k, "wörter stehen für sich", "de", "s", 1) for k in range(20)], odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars").schema)
    odd = odd_documents(spark)
    clash = odd.withColumns({c: F.lit("clash") for c in ("place", "lang_pred", "held_out")})
    model = la.learn(docs.unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars")))
    got = [tuple(r) for r in la.predicted(clash, model).collect()]
    assert len(got) == 10 and model.languages == ["de", "en"]
    by_id = {g[0]: g for g in got}
    for k in (2, 3, 4):
        assert by_id[k][1:] == ("und", 0.0)
    assert by_id[1][1] == "en" and all(0 <= g[2] <= 1 for g in got)
    assert la.predicted(no_documents(spark), model).count() == 0
    nothing = la.learn(no_documents(spark))
    assert {(r["lang_pred"], r["score"]) for r in la.predicted(odd, nothing).collect()} == {("und", 0.0)}


def test_labels_of_held_out_rows_are_not_learned_from(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scrambled = docs.withColumn("lang", F.when(la.held_out(0, 5), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    scrambled.write.parquet(f"{tmp_path}/documents.parquet")
    a = sorted(map(tuple, la.op13_language(spark, sf_dir).collect()))
    b = sorted(map(tuple, la.op13_language(spark, str(tmp_path)).collect()))
    assert [r[:3] for r in a] == [r[:3] for r in b] and np.allclose([r[3] for r in a], [r[3] for r in b], atol=1e-9)
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in a if r[1]]
    assert len(held) > 20 and sum(truth[r[0]] == r[2] for r in held) >= 0.97 * len(held)
