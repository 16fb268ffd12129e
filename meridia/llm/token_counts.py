"""Token counts by prefix dynamic programming.

For a byte-level BPE vocabulary the count at every prefix follows from one pass: the encoding of a prefix is the encoding
of a shorter prefix and one more token, and that token is the only suffix that stays a token next to
the one before it. So ``count[i] = count[i - len(token)] + 1``, for every byte position. The table of a piece of
text is kept with the piece; a text is the sum of its pieces, which are cut where no token can reach over, so the
count at any byte prefix is a sum over whole pieces and one table lookup. Truncation ("how many bytes fit into k
tokens") and budget questions need no further encoding.

Pieces are cut by the vocabulary's own pre-tokenizer pattern, in texts of the scripts for which it is tested to cut as the
library does; blocks with other characters are cut by the library. Special strings inside a text are one token, as the
library has it by default. Long texts are counted block by block, and long pieces keep only the end of their table.

Nulls and empty texts count 0 tokens and 0 bytes. A null doc_id is carried. Repeated rows are counted one by one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memo import Memo
from .shared import map_batches

#: the pre-tokenizer pattern of byte-level vocabularies of this kind (a fixed value of the format)
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: a space that has white space beside it: only then may a cut at spaces differ from the pattern's
CLOSE_SPACES = regex.compile(r" \s|\s ")
#: any character but those whose classes are tested to be the library's, which knows another version of Unicode
UNTESTED = regex.compile(
    r"[^\u0000-\u0557\u05D0-\u06FF\u0900-\u097F\u0E00-\u0E7F\u2010-\u2064\u20A0-\u20BF\u2190-\u27BF"
    r"\u3000-\u30FF\u4E00-\u9FFF\uAC00-\uD7A3\uFF00-\uFF65\U0001F300-\U0001FAFF]"
)
#: places where no piece of the pattern reaches over, and how far apart those are at which long texts are cut
BORDER = regex.compile(r"(?<=[!-~])(?=[ \n][!-~])|(?<=[。、，！？])(?=[一-鿿])")
BLOCK = 1 << 16
#: contractions whose first two characters alone are two pieces
CONTRACTED = {"'re": "'r", "'ve": "'v", "'ll": "'l"}
#: bytes of a piece's beginning that pieces share
STEM = 6
#: of a byte, which no merge made
SINGLE = (-1, b"", b"")
RESULT = "doc_id long, n_bytes long, n_tokens long"


def byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself, or the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Token counts at all byte prefixes, for one byte-level BPE vocabulary file."""

    def __init__(self, path: str, limit: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_characters()
        as_bytes = lambda s: bytes(back[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank: dict[tuple[bytes, bytes], int] = {}
        #: of each token: its merge's rank and parts
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for k, (a, b) in enumerate(merges):
            pair = as_bytes(a), as_bytes(b)
            self.rank[pair] = k
            self.made.setdefault(pair[0] + pair[1], (k, *pair))
        #: of each token whether its own bytes encode to it, None before that was asked
        self.usable: dict[bytes, bool | None] = dict.fromkeys(map(as_bytes, spec["model"]["vocab"]))
        self.longest = max(map(len, self.usable))
        #: of pairs of tokens whether they stay apart, forgotten at the limit
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        #: counts and last tokens of the beginnings of pieces, forgotten at the limit
        self.stems: dict[bytes, tuple[list[int], list[bytes]]] = {}
        self.limit = limit
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.splitter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known = Memo(self._piece_total, limit)
        self.spans = Memo(self._span_total, limit)
        from tokenizers import Tokenizer

        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain BPE of a short byte string: the definition the program below rests on."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 60:
                break
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, token: bytes) -> bool:
        """Whether the vocabulary's token is what its own bytes encode to; remembered."""
        known = self.usable[token] = self.merge(token) == [token]
        return known

    def _beside(self, a: bytes, b: bytes) -> bool:
        """Whether the tokens a and b stay apart and whole when their bytes are encoded together.

        Undo the later of the two last merges, again and again, down to single bytes: the tokens stay apart unless
        a merge over their border would have come first. Of equal merges the left one comes first.
        """
        rank, made = self.rank, self.made
        before = 1 << 60
        while True:
            if rank.get((a, b), before) < before:
                return False
            at_a, at_b = made.get(a, SINGLE), made.get(b, SINGLE)
            if at_a[0] > at_b[0]:
                before, a = at_a[0], at_a[2]
            elif at_b[0] >= 0:
                before, b = at_b[0] + 1, at_b[1]
            else:
                return True

    def table(self, piece: bytes) -> list[int]:
        """``table[i]``: the tokens of the first i bytes of the piece, i from 0.

        A prefix's entries don't depend on what follows, so pieces that begin alike share those of their beginning.
        """
        if len(piece) <= STEM:
            return self._grown(piece, [0], [b""])[0]
        stem = self.stems.get(piece[:STEM])
        if stem is None:
            if len(self.stems) > self.limit:
                self.stems.clear()
            stem = self.stems[piece[:STEM]] = self._grown(piece[:STEM], [0], [b""])
        return self._grown(piece, stem[0].copy(), stem[1].copy())[0]

    def _grown(self, piece: bytes, counts: list[int], last: list[bytes]) -> tuple[list[int], list[bytes]]:
        """The counts and the last tokens of the prefixes, carried on from those given to the end of the piece.

        What is given may be an end of the prefixes before, of ``longest`` at least; the empty prefix has no last token.
        """
        usable, pairs, longest = self.usable, self.pairs, self.longest
        if len(pairs) > self.limit:
            pairs.clear()
        for end in range(len(counts), len(piece) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = piece[start:end]
                good = usable.get(token, False)
                if good is None:
                    good = self._stands(token)
                if not good:
                    continue
                before = last[start]
                if before:
                    pair = before, token
                    apart = pairs.get(pair)
                    if apart is None:
                        apart = pairs[pair] = self._beside(*pair)
                    if not apart:
                        continue
                counts.append(counts[start] + 1)
                last.append(token)
                break
            else:
                raise ValueError(f"no token ends at byte {end} of {piece[:end]!r}")
        return counts, last

    def pieces(self, text: str) -> list[str]:
        """Plain text cut where no token reaches over."""
        if UNTESTED.search(text):
            return [text[a:b] for _, (a, b) in self.cut(text)]
        return PATTERN.findall(text)

    def _piece_total(self, piece: str) -> int:
        data = piece.encode("utf-8", "surrogatepass")
        if len(data) <= BLOCK:
            return self.table(data)[-1]
        # of a very long piece only the end of the table is kept
        counts, last, begin = [0], [b""], 0
        for end in range(BLOCK, len(data) + BLOCK, BLOCK):
            counts, last = self._grown(data[begin:end], counts, last)
            begin += max(0, len(counts) - self.longest - 1)
            counts, last = counts[-self.longest - 1 :], last[-self.longest - 1 :]
        return counts[-1]

    def _span_total(self, span: str) -> int:
        return sum(map(self.known.__getitem__, PATTERN.findall(span)))

    def _plain_total(self, text: str) -> int:
        if UNTESTED.search(text) or CLOSE_SPACES.search(text):
            return sum(map(self.known.__getitem__, self.pieces(text)))
        # a single space always begins a new piece of the pattern: cut there
        first, *rest = text.split(" ")
        return self.spans[first] + sum(map(self.spans.__getitem__, map(" ".__add__, rest)))

    def _segments(self, text: str) -> Iterator[tuple[str, str]]:
        """Plain texts, each with the special string that ends it; "" for the last."""
        at = 0
        if any(s in text for s in self.special):
            for m in self.splitter.finditer(text):
                yield text[at : m.start()], m.group()
                at = m.end()
        yield text[at:], ""

    def total(self, text: str | None) -> int:
        """Tokens of the whole text: the last entry of its prefix counts."""
        return sum(self._plain_total(b) for plain, _ in self._segments(text or "") for b in blocks(plain)) + sum(
            bool(special) for _, special in self._segments(text or "")
        )

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Tokens of the first 0, 1, 2 .. characters of the text, as the library has them for each of these prefixes.

        A prefix that ends inside a special string is plain text; one that ends with white space or inside a contraction is
        cut otherwise there than the whole text.
        """
        out, base = [np.zeros(1, dtype=np.int32)], 0
        for plain, special in self._segments(text or ""):
            counts = self._plain_counts(plain + special)
            out.append(base + counts[1 : len(plain) + len(special) + (not special)])
            base += int(counts[len(plain)]) + bool(special)
            if special:
                out.append(np.array([base], dtype=np.int32))
        return np.concatenate(out)

    def _plain_counts(self, text: str) -> np.ndarray:
        out, base, run = [np.zeros(1, dtype=np.int32)], 0, ""
        for piece in self.pieces(text):
            data = piece.encode("utf-8", "surrogatepass")
            table = np.array(self.table(data), dtype=np.int32)
            inner = table if len(data) == len(piece) else table[np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in piece)])]
            if piece in CONTRACTED:
                inner[2] = sum(map(self.known.__getitem__, CONTRACTED[piece]))
            counts = base + inner
            if run and piece[0].isspace():  # up to here the text ends with all of the white space in one piece
                counts[1] = base - self.known[run] + self.known[run + piece[0]]
            out.append(counts[1:])
            base, run = base + int(table[-1]), piece if piece.isspace() else ""
        return np.concatenate(out)


def blocks(text: str) -> Iterator[str]:
    """The text, cut about every ``BLOCK`` characters at a border where no piece reaches over."""
    at = 0
    while len(text) - at > BLOCK:
        border = BORDER.search(text, at + BLOCK)
        if border is None:
            break
        yield text[at : border.start()]
        at = border.start()
    if at < len(text):
        yield text[at:]


_COUNTERS: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    """One counter a worker process: its tables serve all tasks that the process runs."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each whole text."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def start():
        counter = _counter(tokenizer)

        def count(batch: dict) -> dict:
            texts = batch["text"]
            return {
                "doc_id": batch["doc_id"],
                "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts],
                "n_tokens": [counter.total(t) for t in texts],
            }

        return count

    return map_batches(slim, start, RESULT)


def prefix_tables(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, counts): the tokens of the first 0, 1, 2 .. characters of each text, one entry more than it has characters."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def start():
        counter = _counter(tokenizer)
        return lambda batch: {"doc_id": batch["doc_id"], "counts": [counter.prefix_counts(t) for t in batch["text"]]}

    return map_batches(slim, start, "doc_id long, counts array<int>")


def fits(tables: DataFrame, budget: int) -> DataFrame:
    """(doc_id, n_chars): the longest prefix of at most ``budget`` tokens, from ``prefix_tables``."""
    longest = F.array_max(F.filter(F.transform("counts", lambda n, k: F.when(n <= budget, k)), lambda k: k.isNotNull()))
    return tables.select("doc_id", F.coalesce(longest, F.lit(0)).cast("long").alias("n_chars"))


def tokens_within(tables: DataFrame, n_chars: int) -> DataFrame:
    """(doc_id, n_tokens): the tokens of the first ``n_chars`` characters, or of all there are, from ``prefix_tables``."""
    at = F.least(F.lit(n_chars), F.size("counts") - 1)
    return tables.select("doc_id", F.element_at("counts", at + 1).cast("long").alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)
