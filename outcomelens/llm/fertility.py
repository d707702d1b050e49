"""Quality rules from tokeniser fertility: how a public vocabulary splits a text, against a band per language.

Three measures per text, over its words (runs of other than the six ASCII white space characters), each word encoded by itself:

* ``chars_per_token``: characters of the words per token. Low for letter salad, markup debris and wrong encodings.
* ``byte_share``: share of tokens that are single bytes, that is, characters the vocabulary does not know.
* ``token_entropy``: entropy of the text's token counts in bits, divided by the logarithm of their number (0..1). Low for repetition.

Judged are the same three without separators (``text_...``; a separator is a word of one repeated mark, as between the cells of a table), and

* ``mark_share``: share of tokens without letter or digit (single bytes aside) in words that are no separators, with the separators in excess of
  those words. High where symbols hang on the words.

A text is rejected outside its group's band. The group is its language, or the commonest script of its words where no language is given.
The band is the group's median plus and minus ``width`` times the spread on that side (the distance from the median to the
first or third quartile), learnt over all rows of the group that pass the base rules; a floor on the spread keeps a
uniform group from rejecting its own small differences. Measures of short texts scatter more: below the group's median number of
words (separators aside) the band widens with the square root of median / words. Every group has a band of its own, so that languages a vocabulary serves
badly are not rejected for it; it widens with the square root of 1 + ``least`` / rows, without a step at any size. ``mark_share``
hardly depends on the language: its median and spread are averages of the group's and those of all rows, by rows against ``least``, and it has no lower limit.

Base counts and rules are in ``base_counts``; ``n_symbols`` and ``n_dup_lines`` are for the reader and enter no verdict. Word and line counts are exact. Cases: null and empty texts have no words, so
that base rules reject them; repeated rows are judged alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField

from ..session import scratch_path
from .arrow import id_field, map_rows, vocabulary_path

# White space of the word pattern, symbol characters.
WHITE = b"\t\n\x0b\x0c\r "
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["chars_per_token", "byte_share", "token_entropy"]
MARKS = "mark_share"
JUDGED = [*(f"text_{m}" for m in MEASURES), MARKS]
#: Words that are no separators.
TEXT_WORDS = "n_text_words"
#: Least spread of each measure, so that a group of alike texts still has a band.
SPREAD_FLOOR = {"text_chars_per_token": 0.02, "text_byte_share": 0.02, "text_token_entropy": 0.02, MARKS: 0.015}
#: One repeated mark: ASCII, middle dot, dashes and bullets, box drawing.
SEPARATOR = re.compile(rb"([!-/:-@\[-`{-~]|\xc2\xb7|\xe2\x80[\x90-\xa7]|\xe2[\x94\x95][\x80-\xbf])\1*")
SCRIPTS = re.compile(r"([A-Za-zÀ-ɏ]+)|([Ͱ-Ͽ]+)|([Ѐ-ӿ]+)|([֐-׿]+)|([؀-ۿ]+)|([ऀ-ॿ]+)|([぀-ヿ]+)|([一-鿿]+)|([가-힯]+)")
SCRIPT_NAMES = ["Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Devanagari", "Kana", "Han", "Hangul"]
CACHED_WORDS = 300_000


class Fertility:
    """Tokens of words by a piece model, kept per worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self.is_byte = np.array([self.library.is_byte(i) for i in range(size)])
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        bare = [p.strip("\u2581") != "" and not any(map(str.isalnum, p)) for p in pieces]  # U+2581: a word's begin
        self.is_mark = np.array(bare) & ~self.is_byte
        self.kind = "H" if size <= 65536 else "I"
        self.words: dict[bytes, bytes] = {}

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of the tokens of each of some distinct words, as ``self.kind`` integers."""
        known = self.words
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = words
        for start in range(0, len(new), 4096):
            part = new[start:start + 4096]
            known.update(zip(part, [array(self.kind, ids).tobytes()
                                    for ids in self.library.encode([w.decode() for w in part], num_threads=1)]))
        found = list(map(known.__getitem__, words))
        if len(known) > CACHED_WORDS:  # one text with more distinct words
            known.clear()
        return found


@functools.lru_cache(maxsize=4)
def load(name: str) -> Fertility:
    return Fertility(vocabulary_path(name))


def numbered(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and the number of each word in that list."""
    distinct = list(dict.fromkeys(words))
    number = dict(zip(distinct, range(len(distinct))))
    return distinct, np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def repeated_words(codes: np.ndarray) -> int:
    """Words, given by number, inside a three-word window that occurs twice or more in the text."""
    if len(codes) < 4:
        return 0
    width = int(codes.max()) + 1
    often = np.bincount(codes)[codes] > 1  # a window can repeat only if each of its words does
    starts = np.flatnonzero(often[:-2] & often[1:-1] & often[2:])
    pairs = codes[starts] * width + codes[starts + 1]
    if width >= 1 << 21:  # renumbered, so that triples fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * width + codes[starts + 2]
    ordered = np.sort(windows)
    repeated = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(repeated):
        return 0
    starts = starts[np.isin(windows, repeated)]
    covered = np.zeros(len(codes), bool)
    for shift in range(3):
        covered[starts + shift] = True
    return int(covered.sum())


def base_counts(text: bytes, codes: np.ndarray) -> tuple[int, int, int, int, int]:
    chars = len(text.translate(None, NO_LETTER))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(WHITE)]
    return len(codes), chars, symbols, len(lines) - len(set(lines)), repeated_words(codes)


#: White space, and UTF-8's continuation bytes, which begin no character.
NO_LETTER = WHITE + bytes(range(0x80, 0xC0))


def measures(tokens: np.ndarray, weights: np.ndarray, pieces: Fertility, chars: int):
    """The three measures from token ids and how often each stands in the text."""
    n = int(weights.sum())
    if not n:
        return None, None, None
    single = int(weights[pieces.is_byte[tokens]].sum())
    times = np.bincount(tokens, weights)
    times = times[times > 0]
    entropy = math.log2(n) - float((times * np.log2(times)).sum()) / n if n > 1 else 0.0
    return chars / n, single / n, entropy / math.log2(n) if n > 1 else 1.0


def all_measures(distinct: list[bytes], codes: np.ndarray, pieces: Fertility, chars: int) -> tuple:
    """``MEASURES``, ``TEXT_WORDS`` and ``JUDGED`` of a text's words; null without a word, and ``JUDGED`` where all are separators."""
    if not len(codes):
        return (*(None,) * len(MEASURES), 0, *(None,) * len(JUDGED))
    ids = pieces.ids(distinct)
    tokens = np.frombuffer(b"".join(ids), pieces.kind)
    lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // tokens.itemsize
    times = np.bincount(codes)
    weights = np.repeat(times, lengths)
    found = measures(tokens, weights, pieces, chars)
    split = np.fromiter((SEPARATOR.fullmatch(w) is not None for w in distinct), bool, len(distinct))
    apart, excess, judged = 0, 0, found
    if split.any():
        apart = int(times[split].sum())
        excess = max(0, 2 * apart - len(codes))
        chars -= sum(int(times[i]) * len(distinct[i].decode()) for i in np.flatnonzero(split))
        weights = np.where(np.repeat(split, lengths), 0, weights)
        judged = measures(tokens, weights, pieces, chars)
    if judged[0] is None:
        return (*found, 0, *judged, None)
    return (*found, len(codes) - apart, *judged, (int(weights[pieces.is_mark[tokens]].sum()) + excess) / (int(weights.sum()) + excess))


def script_of(text: str) -> str:
    """Script with the most letters; of equal ones the first by name."""
    total: dict[str, int] = {}
    for found in SCRIPTS.finditer(text):
        name = SCRIPT_NAMES[found.lastindex - 1]
        total[name] = total.get(name, 0) + found.end() - found.start()
    return min(total, key=lambda k: (-total[k], k)) if total else "none"


def measured(df: DataFrame, id_col: str, text_col: str, model: str, lang_col: str | None = None) -> DataFrame:
    """``id_col``, ``_group`` (language or script), the base counts and all measures (null without a word)."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows_in = df.select(F.col(id_col), lang.alias("_lang"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        pieces = load(model)
        for key, lang, text in rows:
            distinct, codes = numbered(text.split())  # of bytes: the six ASCII white space characters only
            counts = base_counts(text, codes)
            found = all_measures(distinct, codes, pieces, counts[1])
            yield key, lang or script_of(text.decode()), *counts, *found

    fields = [id_field(df, id_col), StructField("_group", StringType())]
    fields += [StructField(c, LongType()) for c in COUNTS] + [StructField(c, DoubleType()) for c in MEASURES]
    fields += [StructField(TEXT_WORDS, LongType())] + [StructField(c, DoubleType()) for c in JUDGED]
    return map_rows(rows_in, fields, run)


def bands(rows: DataFrame) -> DataFrame:
    """One row per ``_group`` and one for all rows (``_group`` null): rows, median words, median and spreads of each judged measure.

    Percentiles are Spark's mergeable sketches over all rows (relative rank error 1 / 10,000); one shuffle of sketches.
    """
    spread = [0.25, 0.5, 0.75]
    found = rows.rollup("_group").agg(F.count(F.lit(1)).alias("_rows"), F.grouping("_group").alias("_all"),
                                      *[F.percentile_approx(m, spread, 10_000).alias(m) for m in [TEXT_WORDS, *JUDGED]])
    limits = [F.col("_rows").alias("rows"), F.col(TEXT_WORDS)[1].alias("words")]
    for m in JUDGED:
        low, mid, high = (F.col(m)[i] for i in range(3))
        limits += [mid.alias(m), F.greatest(mid - low, F.lit(SPREAD_FLOOR[m])).alias(f"{m}_below"),
                   F.greatest(high - mid, F.lit(SPREAD_FLOOR[m])).alias(f"{m}_above")]
    return found.select("_group", "_all", *limits)


def judge(df: DataFrame, id_col: str, text_col: str, model: str, lang_col: str | None = None, width: float = 6.0,
          least: int = 100, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``id_col``, base counts, measures, words but separators, judged measures, ``base_failed`` and ``kept``: one row per row of ``df``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated windows. ``kept``: base passed
    and every judged measure inside the band. Measures are written to the shared folder once, as both the bands and the verdicts need them. The
    bands (one row per language or script) are joined to narrow rows of counts; Spark broadcasts them when they are small.
    """
    spark = df.sparkSession
    place = scratch_path(spark, "fertility")
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    measured(df, id_col, text_col, model, lang_col).withColumn("base_failed", base_failed).write.parquet(place)
    rows = spark.read.parquet(place)
    limits = bands(rows.where(~F.col("base_failed")))
    columns = [c for c in limits.columns if c not in ("_group", "_all")]
    overall = limits.where("_all = 1").select(F.struct(*columns)).scalar()
    own = limits.where("_all = 0").select("_group", F.struct(*columns).alias("_own"))
    judged = rows.join(own, "_group", "left").withColumn("_all", overall)
    short = width * F.greatest(F.lit(1.0), F.sqrt(F.col("_own.words") / F.greatest(F.lit(1), TEXT_WORDS)))
    few = F.sqrt(1 + least / F.col("_own.rows"))
    inside = F.lit(True)
    for m in JUDGED:
        if m == MARKS:
            mid, above = ((F.col("_own.rows") * F.col(f"_own.{c}") + least * F.col(f"_all.{c}")) / (F.col("_own.rows") + least)
                          for c in (m, f"{m}_above"))
            inside = inside & (F.col(m) <= mid + short * above)
        else:
            mid, below, above = (F.col(f"_own.{c}") for c in (m, f"{m}_below", f"{m}_above"))
            inside = inside & F.col(m).between(mid - short * few * below, mid + short * few * above)
    return judged.select(id_col, *COUNTS, *MEASURES, TEXT_WORDS, *JUDGED, "base_failed",
                         (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
