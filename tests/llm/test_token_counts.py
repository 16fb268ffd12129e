"""Token counts against the library: all tested code points, odd strings, every prefix, long pieces, budgets."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meridia.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [*"ab sST éß''12½  \t\n\r\x0b\x1c\x85\xa0!?.,<|>日本Ωσ̸=👍​　。", "<|endoftext|>", "'ll", "'ve", "'re", "'VE", "'s", "<|end", "\ua7dd", "\U00018db8", "\U00011db2", "  ", "\n \n"]


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def size(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_tested_code_points_are_cut_as_the_library_cuts(library):
    points = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if not token_counts.UNTESTED.match(c)]
    assert len(points) > 30_000
    for form in ("a{0}1{0}.{0}\n", "{0}'s{0}'ll{0}'ve\n", " {0} {0}a {0}1  {0}\n", "'{0}'s'{0}"):
        for at in range(0, len(points), 4000):
            text = "".join(form.format(c) for c in points[at : at + 4000])
            assert token_counts.PATTERN.findall(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_all_other_code_points_are_counted_as_the_library_counts(counter, library):
    others = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x32400, 1)]) if token_counts.UNTESTED.match(c)]
    for at in range(0, len(others), 997):
        text = "".join(f"a{c}'s {c}'ve1{c}'ll" for c in others[at : at + 60])
        assert counter.total(text) == size(library, text)
    assert counter.total("\ua7dd's") == size(library, "\ua7dd's")


def test_odd_strings_and_all_their_prefixes(counter, library):
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choices(ODD, k=rng.randrange(1, 16)))
        want = [size(library, text[:k]) for k in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want, repr(text)
        assert counter.total(text) == want[-1], repr(text)


def test_words_have_exact_tables(counter, library):
    for word in ("interchangeable", "Donaudampfschiff", "aaaaaaaaaaaa", "x9y8z7", " counterrevolutionaries"):
        assert counter.table(word.encode()) == [size(library, word[:k]) for k in range(len(word) + 1)]


def test_long_pieces_and_texts(counter, library, monkeypatch):
    rng = random.Random(4)
    letters = "".join(rng.choices("etaoinshrdlu", k=5000))
    prose = " ".join("".join(rng.choices("etaoin", k=rng.randrange(1, 9))) for _ in range(3000)) + "\nDone. \n x"
    kanji = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(2000)) + "。次"
    wanted = {t: size(library, t) for t in (letters, prose, kanji, letters + "'s " + prose)}
    for block in (1 << 16, 300):
        monkeypatch.setattr(token_counts, "BLOCK", block)
        for text, want in wanted.items():
            fresh = token_counts.PrefixCounter.__new__(token_counts.PrefixCounter)
            fresh.__dict__.update(counter.__dict__)
            fresh.known = token_counts.Memo(fresh._piece_total, 1000)
            fresh.spans = token_counts.Memo(fresh._span_total, 1000)
            assert fresh.total(text) == want
    assert max(map(len, counter.known)) <= 64


def test_budgets_need_no_encoding(spark, library):
    texts = {1: "one two three", 2: None, 3: "記号" * 200, 4: "interchangeable" * 40, 5: ""}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tables = token_counts.prefix_tables(rows, PATH)
    for budget in (0, 2, 25):
        want = {k: max(n for n in range(len(t or "") + 1) if size(library, (t or "")[:n]) <= budget) for k, t in texts.items()}
        assert {r["doc_id"]: r["n_chars"] for r in token_counts.fits(tables, budget).collect()} == want
    want = {k: size(library, (t or "")[:7]) for k, t in texts.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.tokens_within(tables, 7).collect()} == want
