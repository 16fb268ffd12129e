"""Token files against the library on odd characters, extreme ids and very long texts without spaces."""

import random

import numpy as np
import public_tokenizers
import pytest
from test_exact import check_tokens
from tokenizers import Tokenizer

from meridia.llm import memo, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [*"ab sS tré éÉß'' \"12½²ªº µ  \t\n\r\x0b\x0c\x1c\x85\xa0!?.,<|>日本Ωσς̸̌=´<­İı👍​　ǅﬁ𝟘가가", "<|endoftext|>", "<|startoftext|>", "'ll", "'VE", "'s", "<|END"]


@pytest.mark.parametrize("span", [1 << 18, 7])
def test_encoder_is_the_library(span):
    encoder, library = token_files.PieceEncoder(PATH, "<u2"), Tokenizer.from_file(PATH)
    encoder.SPAN = span
    rng = random.Random(5)
    for _ in range(5000):
        text = "".join(rng.choices(ODD, k=rng.randrange(1, 60)))
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_without_spaces_leave_memory_bounded():
    encoder, library = token_files.PieceEncoder(PATH, "<u2"), Tokenizer.from_file(PATH)
    for text in ("ab,c1" * 200_000, "x" * 100_000, "日本," * 20_000):
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, [*encoder.words, *encoder.odd])) <= 64


def test_twenty_megabytes_without_spaces():
    got = np.frombuffer(token_files.PieceEncoder(PATH, "<u2").encode("ab,c1" * 4_000_000), "<u2")
    some = Tokenizer.from_file(PATH).encode("ab,c1" * 2, add_special_tokens=False).ids
    assert np.array_equal(got, np.tile(some[: len(some) // 2], 4_000_000))


def test_extreme_and_null_ids(spark):
    rows = [(-(2**63), "least"), (None, "no id"), (None, "another"), (2**63 - 1, "most"), (0, None)]
    got = [tuple(r) for r in token_files.token_files(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()]
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    check_tokens(got, [r[0] for r in rows], [r[1] for r in rows])


def test_memo_forgets_in_two_generations():
    calls = []
    m = memo.Memo(lambda k: calls.append(k) or len(k), 2, longest=3)
    assert [m[k] for k in ("a", "b", "c", "a", "long", "long")] == [1, 1, 1, 1, 4, 4]
    assert calls == ["a", "b", "c", "long", "long"] and "long" not in m and len(m) <= 2
