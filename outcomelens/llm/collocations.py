"""Phrase collocations by Toivonen mining: a sample proposes, passes over all documents count exactly until nothing can be missing.

Phrases are runs of words inside a piece (texts are cut at ``.,;:!?`` and line ends). A phrase can only be frequent if its parts are.

1. The sample's frequent words and pairs, by a lowered threshold, are proposed.
2. A full pass counts exactly, per language: all words; the pairs of proposed words; the triples of proposed pairs. So it counts what was proposed and its
   negative border, which is whatever is not proposed itself though all its parts are.
3. Words and pairs of the border that turn out frequent are failures of the sample: they join the proposed, and a further pass counts the phrases that
   they open up and no pass has counted. When no failure is left, every frequent phrase has been counted.

The result is exact whatever the sample holds; a poor sample costs a pass (two words more than it proposes, at most).

What is proposed reaches the tasks as two bit fields of fixed size (``bits`` each), so the broadcast does not grow with the corpus. A bit set by another phrase only lets
something more be counted; nothing proposed is ever missed. Tasks merge their counts before the shuffle, in blocks of bounded size, and the phrase itself is the
key, so no hash clash can change a count.

Scores are exact integers (38 decimal digits: counts up to 10^15). Parts are joined by sort-merge, which Spark splits where a word is part of very many phrases; the first ``top``
of a language are taken within ``SHARDS`` shares of it, then among those.

Cases: null text counts as empty, null language as ``und``; repeated rows count each; a piece or text of any length is taken whole; ties go by count, then by the
phrase's bytes; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .arrow import plain_rows, ship

BORDER = b"\xff"
#: Line ends and marks become the border of a piece, a tab a space; other bytes stay.
CLEAN = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))
BLOCK_BYTES = 1 << 20
BLOCK_WORDS = 1_000_000
ROWS_OUT = 20_000
BYTES_OUT = 16 << 20
SHARDS = 128
COUNTS = "lang string, size int, phrase binary, n long"
#: What tasks send: language and phrase in one value, so that one short key is hashed and shuffled. No phrase holds a tab.
KEYED, TAB = "key binary, n long", "\t"


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text with ``BORDER`` between pieces, in blocks cut between pieces."""
    clean, start = text.lower().translate(CLEAN), 0
    while start < len(clean):
        end = clean.find(BORDER, start + BLOCK_BYTES)
        end = len(clean) if end < 0 else end
        words = clean[start:end].replace(BORDER, b" \xff ").split()
        words.append(BORDER)
        yield words
        start = end


def word_names(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + second
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Field:
    """A set of names as bits: what was put in is always found."""

    words: np.ndarray

    def __contains__(self, other: Field) -> bool:
        return not (other.words & ~self.words).any()

    def __or__(self, other: Field) -> Field:
        return Field(self.words | other.words)

    def holds(self, names: np.ndarray) -> np.ndarray:
        at = _bit(names, len(self.words) * 64)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _bit(names: np.ndarray, bits: int) -> np.ndarray:
    return names >> np.uint64(64 - (bits.bit_length() - 1))


@dataclass(frozen=True)
class Proposed:
    """Words and pairs whose extensions a pass counts."""

    words: Field
    pairs: Field

    @staticmethod
    def nothing(bits: int) -> Proposed:
        empty = Field(np.zeros(bits // 64, np.uint64))
        return Proposed(empty, empty)


def phrase_field(phrases: DataFrame, size: int, bits: int) -> Field:
    """Field of the phrases of ``size`` words in (lang, size, phrase); tasks send set bits only, merged per 64 bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(phrase)
            for lang, held in by.items():
                parts = [word_names(lang, list(column)) for column in zip(*(p.split(b" ") for p in held))]
                at = _bit(functools.reduce(pair_names, parts), bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["at", "bit"])

    ship(phrases.sparkSession)
    found = phrases.where(F.col("size") == size).select("lang", "phrase").mapInArrow(run, "at long, bit long")
    merged = found.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most bits / 64 rows
    field = np.zeros(bits // 64, np.uint64)
    field[merged["at"].to_numpy()] = merged["bit"].to_numpy().view(np.uint64)
    return Field(field)


class Block:
    """Words of some documents of one language, numbered as they come."""

    def __init__(self, lang: str):
        self.lang, self.parts = lang, []
        self.number = _Numbers({BORDER: 0})

    def add(self, words: list[bytes]) -> int:
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        return len(words)

    def counts(self, now: Proposed, before: Proposed | None) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """(size, word numbers by place, counts) of what ``now`` lets be counted and ``before`` did not; size 0 is the number of words.
        Without ``before`` words are counted too."""
        at = np.concatenate(self.parts)
        if before is None:
            each = np.bincount(at, minlength=len(self.number))[1:]
            yield 0, [], np.array([each.sum()])
            yield 1, [np.arange(1, len(each) + 1)], each
        names = word_names(self.lang, list(self.number))
        inside = at > 0
        both = inside[:-1] & inside[1:]
        known = now.words.holds(names)[at]
        pairs = both & known[:-1] & known[1:]
        if before is not None:
            known = before.words.holds(names)[at]
            pairs &= ~(known[:-1] & known[1:])
        first = np.flatnonzero(pairs)
        keys, n = np.unique(at[first] << 32 | at[first + 1], return_counts=True)
        yield 2, [keys >> 32, keys & 0xFFFFFFFF], n

        joined = pair_names(names[at[:-1]], names[at[1:]])
        known = both & now.pairs.holds(joined)
        triples = known[:-1] & known[1:]
        if before is not None:
            known = both & before.pairs.holds(joined)
            triples &= ~(known[:-1] & known[1:])
        first = np.flatnonzero(triples)
        begins, which = np.unique(at[first] << 32 | at[first + 1], return_inverse=True)
        keys, n = np.unique(which << 32 | at[first + 2], return_counts=True)
        begins = begins[keys >> 32]
        yield 3, [begins >> 32, begins & 0xFFFFFFFF, keys & 0xFFFFFFFF], n

    def batches(self, now: Proposed, before: Proposed | None) -> Iterator[pa.RecordBatch]:
        lang = (self.lang + TAB).encode()
        words = pa.array(list(self.number), pa.large_binary())
        opening = pc.binary_join_element_wise(pa.scalar(lang, pa.large_binary()), words, pa.scalar(b"", pa.large_binary()))
        lengths = np.fromiter(map(len, self.number), np.int64, len(self.number)) + 1
        for _, places, n in self.counts(now, before):
            total = np.cumsum(sum((lengths[p] for p in places), np.full(len(n), len(lang))))
            start = 0
            while start < len(n):
                limit = (total[start - 1] if start else 0) + BYTES_OUT
                end = min(start + ROWS_OUT, max(start + 1, int(np.searchsorted(total, limit))), len(n))
                parts = [held.take(pa.array(p[start:end])) for held, p in zip((opening, words, words), places)]
                key = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if parts else pa.array([lang])
                yield pa.RecordBatch.from_arrays([key.cast(pa.binary()), pa.array(n[start:end].astype(np.int64))], ["key", "n"])
                start = end


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def counted(texts: DataFrame, now: Proposed, before: Proposed | None) -> DataFrame:
    """(lang, size, phrase, n): exact counts of what ``now`` lets be counted and ``before`` did not, merged per task, then over all."""
    spark = texts.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((now, before))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, Block] = {}
        held = 0
        for lang, text in plain_rows(batches):
            for words in word_blocks(text):
                if lang not in blocks:
                    blocks[lang] = Block(lang)
                held += blocks[lang].add(words)
                if held >= BLOCK_WORDS:
                    for block in blocks.values():
                        yield from block.batches(*sent.value)
                    blocks, held = {}, 0
        for block in blocks.values():
            yield from block.batches(*sent.value)

    merged = texts.mapInArrow(run, KEYED).groupBy("key").agg(F.sum("n").alias("n"))
    key = F.col("key").cast("string")
    phrase = F.substring_index(key, TAB, -1)
    spaces = F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit("")))
    return merged.select(
        F.substr(key, F.lit(1), F.length(key) - F.length(phrase) - 1).alias("lang"), F.when(phrase == "", 0).otherwise(spaces + 1).alias("size"),
        phrase.cast("binary").alias("phrase"), "n")


def frequent(df: DataFrame, text_col: str, lang_col: str, min_count: int, share: float = 0.1, lowered: int = 2, seed: int = 7,
             bits: int = 1 << 26) -> DataFrame:
    """(lang, size, phrase, n): every phrase of one to three words that comes ``min_count`` times or more in a language, and under size 0 the
    number of its words. ``share`` of the rows is the sample, ``lowered`` its threshold; neither changes the result."""
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    every = Field(np.full(bits // 64, ~np.uint64(0)))
    sampled = _written(spark, counted(texts.sample(share, seed=seed), Proposed(every, Proposed.nothing(bits).pairs), None)
                       .where(F.col("size").isin(1, 2) & (F.col("n") >= lowered)), "phrases-proposed")
    now, before = Proposed(phrase_field(sampled, 1, bits), phrase_field(sampled, 2, bits)), None
    passes: list[DataFrame] = []
    while True:
        exact = _written(spark, counted(texts, now, before).where((F.col("size") == 0) | (F.col("n") >= min_count)), "phrases")
        passes.append(exact)
        found = Proposed(phrase_field(exact, 1, bits), phrase_field(exact, 2, bits))
        if found.words in now.words and found.pairs in now.pairs:
            return functools.reduce(DataFrame.unionAll, passes)
        now, before = Proposed(now.words | found.words, now.pairs | found.pairs), now


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    place = scratch_path(spark, name)
    df.write.parquet(place)
    return spark.read.parquet(place)


def _whole(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, cover): candidates with the counts of their lowest-scoring cut and of the most frequent longer candidate around them."""
    words = F.split("phrase", " ")
    phrases = counts.select("lang", "size", F.col("phrase").cast("string").alias("phrase"), "n")

    def joined(start: int, length: int) -> Column:
        return F.array_join(F.slice(words, start, length), " ")

    def cut(k: int, side: str, part: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part"))

    pair = F.array(cut(1, "l", joined(1, 1)), cut(1, "r", joined(2, 1)))
    triple = F.array(cut(1, "l", joined(1, 1)), cut(1, "r", joined(2, 2)), cut(2, "l", joined(1, 2)), cut(2, "r", joined(3, 1)))
    candidates = phrases.where(F.col("size") >= 2).select("lang", "phrase", "size", F.col("n").alias("a"))
    asked = candidates.select("lang", "phrase", "a", F.inline(F.when(F.col("size") == 2, pair).otherwise(triple)))
    parts = phrases.where(F.col("size").isin(1, 2)).select("lang", F.col("phrase").alias("part"), F.col("n").alias("value"))
    answered = asked.join(parts, ["lang", "part"]).select("lang", "phrase", "a", "k", "side", "value")
    around = candidates.where(F.col("size") == 3).select(
        "lang", F.explode(F.array(joined(1, 2), joined(2, 2))).alias("phrase"), F.lit(None).cast("long").alias("a"),
        F.lit(0).alias("k"), F.lit("cover").alias("side"), F.col("a").alias("value"))

    def of(k: int, side: str) -> Column:
        return F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("value")))

    merged = answered.unionAll(around).groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), of(1, "l").alias("l1"), of(1, "r").alias("r1"), of(2, "l").alias("l2"), of(2, "r").alias("r2"),
        of(0, "cover").alias("cover"))

    def score(k: int) -> Column:
        parts = _whole(f"l{k}") * _whole(f"r{k}")
        value = F.call_function("div", _whole("a") * _whole("a") * F.lit(1_000_000).cast("decimal(7,0)"), parts)
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(value.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    lowest = F.array_min(F.array_compact(F.array(score(1), score(2))))
    return merged.withColumn("cut", lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "cover")


def mine(df: DataFrame, text_col: str, lang_col: str, min_count: int = 10, top: int = 2000, covered: int = 50, **sampling) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the first ``top`` collocations of each language.

    Phrases that stand in ``covered`` percent or more of their places inside one longer candidate are left out. ``sampling``: see ``frequent``.
    """
    counts = frequent(df, text_col, lang_col, min_count, **sampling)
    free = scored(counts).where(F.col("cover").isNull() | (100 * F.col("cover") < covered * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    shard = F.pmod(F.xxhash64("phrase"), F.lit(SHARDS))
    near = free.withColumn("rank", F.row_number().over(Window.partitionBy("lang", shard).orderBy(*order))).where(F.col("rank") <= top)
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = counts.where(F.col("size") == 0).select("lang", "n")
    return first.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
