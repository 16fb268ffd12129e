"""Operators with exact results against brute force, on a small table and on odd rows."""

import itertools

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from helpers import classes, crc, mix_targets, no_documents, odd_documents, simhash, words
from oracle import assert_same, connection
from tokenizers import Tokenizer

from meridia.llm import decontamination, embedding_duplicates, licenses, mixing, near_duplicates, shared, token_counts, token_files
from meridia.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


def encoded(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_tokens(got, doc_ids, texts):
    ids = [e + [2] for e in encoded("word_bpe_49k.json", texts)]
    starts = np.cumsum([0] + [len(x) for x in ids])[:-1]
    want = list(zip(doc_ids, starts.tolist(), map(len, ids), map(crc, ids)))
    assert sorted(got, key=lambda r: r[1]) == want


def test_token_files(spark, sf_dir, docs):
    got = [tuple(r) for r in QUERIES["op2_token_files"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    d = docs.sort_values("doc_id")
    check_tokens(got, d.doc_id.tolist(), d.text.tolist())


def test_token_files_of_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = odd_documents(spark)
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    check_tokens([tuple(r) for r in token_files.token_files(odd, path).collect()], [r[0] for r in rows], [r[1] for r in rows])
    assert token_files.token_files(no_documents(spark), path).count() == 0


def test_token_counts(spark, sf_dir, docs):
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op8_token_counts"](spark, sf_dir).collect()}
    assert got == dict(zip(docs.doc_id, map(len, encoded("byte_bpe_50k.json", docs.text))))
    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = odd_documents(spark)
    rows = odd.select("doc_id", "text").collect()
    want = sorted((str(r[0]), len(e)) for r, e in zip(rows, encoded("byte_bpe_50k.json", [r[1] for r in rows])))
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.token_counts(odd, path).collect()) == want
    assert token_counts.token_counts(no_documents(spark), path).count() == 0


def component_names(ids, prints):
    pairs = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    names = {}
    found = classes(len(ids), pairs)
    for i, c in zip(ids, found):
        if i is not None:
            names[c] = min(names.get(c, i), i)
    return [names.get(c) for c in found]


def test_near_duplicates(spark, sf_dir, docs):
    prints = [simhash(t) for t in docs.text]
    want = sorted(zip(docs.doc_id, (f"{p:016x}" for p in prints), component_names(docs.doc_id.tolist(), prints)))
    assert sorted(tuple(r) for r in QUERIES["op3_near_duplicates"](spark, sf_dir).collect()) == want


def test_near_duplicates_of_odd_rows(spark):
    odd = odd_documents(spark)
    rows = odd.select("doc_id", "text").collect()
    prints = [simhash(r[1]) for r in rows]
    want = sorted(map(str, zip([r[0] for r in rows], (f"{p:016x}" for p in prints), component_names([r[0] for r in rows], prints))))
    assert sorted(str(tuple(r)) for r in near_duplicates.near_duplicates(odd).collect()) == want
    both = near_duplicates.one_of_each_group(spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (2, "a b c d e"), (1, "v w x y z")], "doc_id long, text string"))
    assert sorted(map(tuple, both.collect())) == [(1, "a b c d e"), (1, "v w x y z")]
    kept = near_duplicates.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "7", "8", "9", "None"]
    assert near_duplicates.one_of_each_group(no_documents(spark)).count() == 0


def test_links_find_all_pairs(spark):
    rng = np.random.default_rng(5)
    prints = {0, -1, 1 << 62}
    for base in rng.integers(-(2**63), 2**63, 12):
        for _ in range(12):
            bits = rng.choice(64, rng.integers(0, 4), replace=False)
            prints.add(int(np.int64(base)) ^ int(np.array([sum(1 << int(b) for b in bits)], dtype=np.uint64).view(np.int64)[0]))
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = {(a, b) for a, b in itertools.combinations(prints, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert {tuple(r) for r in near_duplicates.links(df).collect()} == want and len(want) > 50


def test_crowded_halves_keep_all_classes(spark):
    rng = np.random.default_rng(6)
    crowd = sorted({int(x) << 32 | 7 for x in rng.integers(0, 2**31, 20_000)} | {int(x) << 32 | 5 for x in rng.integers(0, 2**31, 700)} | {(9 << 32) + (1 << k) for k in range(32)})
    prints = np.array(crowd, dtype=np.uint64)
    want = []
    for at in range(0, len(prints), 2000):
        i, j = np.nonzero(np.bitwise_count(prints[at : at + 2000, None] ^ prints[None]) <= 3)
        want += [(a, b) for a, b in zip((i + at).tolist(), j.tolist()) if a < b]
    names = classes(len(crowd), want)
    stars = shared.components(near_duplicates.links(spark.createDataFrame([(p,) for p in crowd], "fp long")))
    got = {r["id"]: r["component_id"] for r in stars.collect()}
    assert len(want) > 100 and [got.get(p, p) for p in crowd] == [crowd[k] for k in names]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (None, 3)]
    got = {r["id"]: r["component_id"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(200, 260)} == {7} and 5 not in got
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, sf_dir, docs):
    got = QUERIES["op5_mixing"](spark, sf_dir).toPandas().set_index("doc_id")
    sizes = {i: len(words(t)) for i, t in zip(docs.doc_id, docs.text)}
    assert got["size"].to_dict() == sizes
    by_source = {s: sum(sizes[i] for i in docs.doc_id[docs.source == s]) for s in sorted(docs.source.unique(), key=str.encode)}
    want = mix_targets(by_source)
    for s, t in want.items():
        rows = got.loc[docs.doc_id[docs.source == s]]
        assert abs(rows.target.iloc[0] - t) < 1e-6
        assert abs(rows.taken.sum() - t) <= max(rows["size"]) / 2 + 1
        assert (rows.taken <= 3 * rows["size"]).all()
    assert got.taken.to_dict() == QUERIES["op5_mixing"](spark, sf_dir).toPandas().set_index("doc_id").taken.to_dict()


def test_mixing_of_odd_rows(spark):
    odd = odd_documents(spark)
    got = mixing.mix(odd).toPandas()
    assert len(got) == 10 and got["size"].sum() == 60_000 + 7 + 7 + 3 + 5 + 5 + 5 and (got.taken <= 3 * got["size"]).all()
    repeated = mixing.mixed(odd)
    assert repeated.columns == odd.columns and repeated.count() == got.epochs.sum()
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.lpad((F.col("id") % 1000).cast("string"), 4, "0")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 1000 % 37 + F.col("id") % 1000).cast("int")).alias("text"))
    sizes = {f"s{k:04d}": 3 * (k % 37 + k) for k in range(1000)}
    got = {r["source_size"]: r["target"] for r in mixing.mix(many).select("source_size", "target").distinct().collect()}
    want = mix_targets(sizes)
    per = {}
    for source, n in sizes.items():
        per.setdefault(n, set()).add(round(want[source], 6))
    assert all(round(t, 6) in per[n] for n, t in got.items())
    assert mixing.mix(no_documents(spark)).count() == 0 and mixing.mixed(no_documents(spark)).count() == 0


def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    rows = [(k, (base[k % 30] + rng.standard_normal(16) * 0.06 * (k % 4)).tolist(), k % 3) for k in range(240)]
    rows += [(300 + k, base[0].tolist(), 0) for k in range(5)] + [(310, (base[0] * 7).tolist(), 0), (311, base[0].tolist(), None)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] + [1.0] * 15, 1), (404, [None] + [1.0] * 15, 1), (405, [float("inf")] + [1.0] * 15, 1), (406, [1.0, 2.0], 1), (406, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows


def test_embedding_duplicates(spark):
    df, rows = vectors(spark)
    ok = [v is not None and len(v) > 0 and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v) / np.linalg.norm(v) if good else None for (_, v, _), good in zip(rows, ok)]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    degree = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    names = classes(len(rows), pairs)
    want = sorted((r[0], int(degree[k]), rows[names[k]][0], r[0] == rows[names[k]][0]) for k, r in enumerate(rows))
    for chunk in (256, 5):
        got = sorted(tuple(r) for r in embedding_duplicates.embedding_duplicates(df, chunk=chunk).collect())
        assert got == want


def planted_vectors(spark, dim, pairs, seed):
    """Pairs of unit vectors at cosine 0.98 just above or, every fifth, just below."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((pairs, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal((pairs, dim))
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = np.where(np.arange(pairs) % 5 == 0, 0.979, 0.9801)[:, None]
    other = base * cosine + side * np.sqrt(1 - cosine**2)
    rows = [(2 * k, base[k].tolist(), 1) for k in range(pairs)] + [(2 * k + 1, other[k].tolist(), 1) for k in range(pairs)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("dim", [64, 384])
def test_embedding_recall_at_the_threshold(spark, dim):
    """The hardest links there are: the task asks for 0.9 of them."""
    got = {r["vec_id"]: r["n_links"] for r in embedding_duplicates.embedding_duplicates(planted_vectors(spark, dim, 1000, dim)).collect()}
    found = [got[2 * k] == got[2 * k + 1] == 1 for k in range(1000)]
    assert not any(found[::5])
    assert sum(found) >= 0.97 * 800


def test_embedding_query_and_no_rows(spark, sf_dir):
    got = {r["vec_id"]: r for r in QUERIES["op6_embedding_duplicates"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r["label"] for r in rows])
    want = ((x @ x.T >= 0.98) & (label[:, None] == label[None])).sum(1) - 1
    assert [got[r["vec_id"]]["n_links"] for r in rows] == want.tolist()
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_duplicates.embedding_duplicates(none).count() == 0


def test_a_crowded_cell(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16)
    x = base + rng.standard_normal((3000, 16)) * 0.02
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_duplicates.embedding_duplicates(df).collect()}
    want = np.array([int((unit[k] @ unit.T >= 0.98).sum()) - 1 for k in range(3000)])
    assert want.min() > 2000 and {c for _, c in got.values()} == {0}
    assert sum(n for n, _ in got.values()) >= 0.99 * want.sum() and all(got[k][0] <= want[k] for k in range(3000))


def test_decontamination(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    want = {(i, r["item_id"]) for i, t in zip(docs.doc_id, docs.text) for r in items if t and r["text"] in t}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_decontamination"](spark, sf_dir).collect()}
    assert got == want and want


def test_decontamination_of_changed_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 400, n))
    items = [(k, text(30) + ".") for k in range(50)] + [(90, None), (91, ""), (92, "What is the colour of the clear sky today?\nAnswer: it is blue")]
    one = items[3][1].upper().replace(" ", ", ", 3).split(" ")
    one[10] = "changed"
    rows = [(1, text(300) + " " + " ".join(one) + " " + text(200)), (2, text(600)), (3, None), (4, ""), (None, items[5][1]), (6, "what is the colour of the clear sky today it is blue"), (7, "what is the colour of the clear sky today nobody can say"), (8, text(30_000) + " " + items[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (2_000_000, 300):
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, bench, max_postings=parts).collect()}
        assert got == {(1, 3), (None, 5), (6, 92), (8, 7)}
        assert sorted(str(r["doc_id"]) for r in decontamination.without_contaminated(df, bench, max_postings=parts).collect()) == ["2", "3", "4", "7"]
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0
    assert decontamination.without_contaminated(df, bench.limit(0)).count() == 8
    assert decontamination.contaminated(no_documents(spark), bench).count() == 0


@pytest.mark.parametrize("dense", [1 << 22, 0])
def test_block_search_equals_plain_scores(monkeypatch, dense):
    monkeypatch.setattr(decontamination, "DENSE", dense)
    rng = np.random.default_rng(2)
    postings = sorted({(f"t{t}", int(i)): float(rng.random()) for t in range(60) for i in rng.integers(0, 40, 9)}.items())
    postings = [(t, i, w) for (t, i), w in postings]
    numbers = {t: k + 1 for k, t in enumerate(sorted({t for t, _, _ in postings}))}
    index = decontamination.LengthIndex([(numbers[t], i, w) for t, i, w in postings], len(numbers), [(k, "x") for k in range(40)], 1, block=3)
    sets = [sorted(set(rng.integers(1, len(numbers) + 1, 12).tolist())) for _ in range(20)]
    names = {v: k for k, v in numbers.items()}
    want = {}
    for w, terms in enumerate(sets):
        for item in range(40):
            score = sum(x for t, i, x in postings if i == item and t in {names[k] for k in terms})
            if score >= 1.5:
                want[w, item] = round(score, 9)
    got = index.search(np.repeat(np.arange(20), [len(s) for s in sets]), np.concatenate(sets), 1.5)
    assert {(w, i): round(s, 9) for w, i, s in got} == want and want


def test_licenses(spark, sf_dir):
    con = connection(sf_dir)
    assert_same(QUERIES["op4_licenses"](spark, sf_dir).toPandas(), con.execute(ORACLE_SQL["op4_licenses"]).df())


def test_license_rules_keep_order(spark):
    grant, notice = (next(t for i, t in licenses.SENTENCES if i == want) for want in ("mit-grant", "mit-notice"))
    warranty = next(t for i, t in licenses.SENTENCES if i == "mit-warranty")
    far = "\n".join(f"filler {k}" for k in range(9))
    rows = [(1, f"Intro. {grant}. {notice}! Other words.\n{warranty.upper()}"), (2, f"{notice}. {grant}."), (3, f"{grant}\n{far}\n{notice}"), (4, None), (5, ""), (None, "Released under the MIT License."), (7, "Not released under the MIT license today.")]
    got = {(r["doc_id"], r["rule"], r["first_place"], r["last_place"]) for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "mit-text", 1, 2), (1, "mit-full", 1, 4), (None, "mit-named", 0, 0)}
    assert licenses.license_matches(no_documents(spark)).count() == 0
    assert licenses.license_matches(odd_documents(spark)).count() == 0
