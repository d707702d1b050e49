"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

A piece model's encoding has two properties that make it a recurrence over prefixes: any run of consecutive tokens of an
encoding is itself the encoding of its characters, and a token sequence is an encoding if each two neighbours are. So the last
token of a prefix is the one token that ends there and follows the last token of the shorter prefix before it, and the
count is that prefix's count plus one. No prefix is encoded again; which tokens can follow each other is found by merging two tokens' characters, once per
pair.

Stored is one byte per character: the change of the count from the prefix before. Counts, truncation points and
budgets are cumulative sums of it (``count_at``, ``longest_prefix``). Counts can fall as a prefix grows.

The text is cut before each run of spaces that follows something else (no piece of the vocabulary spans such a place) and at characters
that no piece contains; the bytes of each such chunk are kept per worker, so a repeated word costs one lookup. Blocks of a long text are
cut at such places too: memory grows with one text's length only through its stored bytes.

Models: BPE with byte fallback, identity normalisation, a leading space mark. Others are refused.
Cases: null and empty text have no tokens and no stored bytes; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from .arrow import id_field, keyed_text, map_rows, vocabulary_path

SPACE = "▁"
BLOCK = 1 << 20
CACHED_CHUNKS = 300_000
CACHED_PAIRS = 1_000_000


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        self.score = {library.id_to_piece(i): library.get_score(i) for i in range(size)
                      if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))}
        self.fallback = any(library.is_byte(i) for i in range(size))
        probe = "  a ﬁ é\n"
        if not self.fallback or any(SPACE in p.lstrip(SPACE) for p in self.score) or library.normalize(probe) != (
                SPACE + probe.replace(" ", SPACE)):
            raise ValueError(f"{path}: byte fallback, identity normalisation and pieces within words are needed")
        self.pieces = ["", *self.score]  # 0 stands for a start
        self.ending = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if piece:
                self.ending.add_word(piece, (i, len(piece)))
        self.ending.make_automaton()
        alone = [c for c in "\n\t\r" if not any(c in p for p in self.score)]
        others = "".join(map(re.escape, alone))
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{others}]*|[{others}]|[^{SPACE}{others}]+" if alone
                              else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.follows: dict[int, bool] = {}
        self.chunks = _Chunks(self)

    def merge(self, text: str) -> list[str]:
        """Tokens of a short text by merging the best-scored neighbours, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(-self.score[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1)
                      if parts[i] + parts[i + 1] in self.score]
            if not scored:
                break
            _, i = min(scored)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def can_follow(self, pair: int) -> bool:
        """Whether two tokens stay two when they meet; with 0 on the left, whether the right one is a token by itself."""
        if len(self.follows) >= CACHED_PAIRS:
            self.follows.clear()
        left, right = self.pieces[pair >> 20], self.pieces[pair & 0xFFFFF]
        known = self.follows[pair] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    def changes(self, chunk: str) -> bytes:
        """Change of the token count at each character of a chunk, as signed bytes.

        ``last[end]`` is the last token of the prefix of that length: the one token that ends there and can follow the last
        token of the prefix before it. The automaton names the tokens that end at each place. A character that
        no piece holds stands alone as its bytes; what follows it is as at a start.
        """
        last, counts, done = [0] * (len(chunk) + 1), [0] * (len(chunk) + 1), 0
        known = self.follows.get
        for at, (token, length) in self.ending.iter(chunk):
            if at < done:
                continue
            while done < at:
                done = self._alone(chunk, done, counts)
            start = at + 1 - length
            pair = last[start] << 20 | token
            fits = known(pair)
            if fits is None:
                fits = self.can_follow(pair)
            if fits:
                done = at + 1
                last[done] = token
                counts[done] = counts[start] + 1
        while done < len(chunk):
            done = self._alone(chunk, done, counts)
        return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])

    def _alone(self, chunk: str, done: int, counts: list[int]) -> int:
        if chunk[done] in self.score:
            raise ValueError(f"no token ends at {done + 1} in {chunk!r}")
        counts[done + 1] = counts[done] + len(chunk[done].encode())
        return done + 1

    def text_changes(self, text: str) -> bytes:
        """As ``changes`` for a whole text; the leading space mark counts with the first character."""
        if not text:
            return b""
        out = b"".join(b"".join(map(self.chunks.__getitem__, self.cut(block))) for block in blocks(text))
        return (np.frombuffer(out[:2], np.int8).sum().astype(np.int8).tobytes()) + out[2:]


class _Chunks(dict):
    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHED_CHUNKS:
            self.clear()
        found = self.model.changes(chunk)
        if len(chunk) <= 64:
            self[chunk] = found
        return found


def blocks(text: str) -> Iterator[str]:
    """The text with its leading mark and spaces as marks, in blocks cut before a run of spaces."""
    start, lead = 0, SPACE
    while start < len(text):
        end = start + BLOCK
        while end < len(text) and not (text[end] in (" ", SPACE) and text[end - 1] not in (" ", SPACE)):
            end += 1
        yield lead + text[start:end].replace(" ", SPACE)
        start, lead = end, ""


@functools.lru_cache(maxsize=4)
def load(name: str) -> PieceModel:
    return PieceModel(vocabulary_path(name))


def prefix_counts(df: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` of the whole text and ``count_changes``, one signed byte per character."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        pieces = load(model)
        for key, text in rows:
            changes = pieces.text_changes(text.decode())
            yield key, len(text), int(np.frombuffer(changes, np.int8).sum(dtype=np.int64)), changes

    fields = [id_field(df, id_col), StructField("n_bytes", LongType()), StructField("n_tokens", LongType()),
              StructField("count_changes", BinaryType())]
    return map_rows(keyed_text(df, id_col, text_col), fields, run, lambda row: len(row[3]))


def _counts(changes: bytes) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64)))


def count_at(changes: str | Column, n_chars: str | Column) -> Column:
    """Token count of the first ``n_chars`` characters (at most the text's length; null if either is null)."""

    @F.pandas_udf("long")
    def counted(stored, chars):
        import pandas as pd

        def one(s, n):
            if s is None or pd.isna(n):
                return None
            return int(np.frombuffer(s, np.int8)[:max(0, int(n))].sum(dtype=np.int64))

        return pd.Series([one(s, n) for s, n in zip(stored, chars)], dtype="Int64")

    return counted(F.col(changes) if isinstance(changes, str) else changes, F.col(n_chars) if isinstance(n_chars, str) else n_chars)


def longest_prefix(changes: str | Column, budget: str | Column) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens (null if either is null or the budget is negative)."""

    @F.pandas_udf("long")
    def fitted(stored, budgets):
        import pandas as pd

        def one(s, n):
            if s is None or pd.isna(n) or n < 0:
                return None
            return int(np.flatnonzero(_counts(s) <= n)[-1])

        return pd.Series([one(s, n) for s, n in zip(stored, budgets)], dtype="Int64")

    return fitted(F.col(changes) if isinstance(changes, str) else changes, F.col(budget) if isinstance(budget, str) else budget)
