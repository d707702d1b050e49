"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A benchmark item's seeds are its three-word n-grams that occur in at most ``RARE`` items, and always its rarest ones. A passage that holds
a seed of an item is a candidate; its words around the seed's diagonal are aligned with the item's (local alignment, words as
letters). The score over the score of a perfect copy is the ``similarity``; at ``least`` (0.5) or more the passage is a copy: half
the item verbatim, or the whole with up to every third or fourth word changed, with words put in or left out.

Rarity is counted over the whole benchmark, not over the documents: a passage that has leaked into a third of all documents must not become common
by that. The benchmark is the stated query set. It is sent to the tasks in blocks of at most ``BLOCK_WORDS`` words (plus one
item), whatever its size; every document is read once per block and meets the block's seeds by hash lookups. No document is
shuffled, and a seed that many documents share stays where they are.

A candidate is aligned only if the window holds enough of the item's words to reach ``least`` at all; that bound drops no match.

Cases: null and empty texts and items match nothing; an item of fewer than three words is its own seed; words are runs without white space or ASCII
punctuation, lower-cased; items alike are each reported; of several alignments of a document and an item the best counts, then the first;
rows with the same id are reported together, the best counts; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField

from .arrow import id_field, keyed_text, map_rows

SEED = 3
RARE = 10
BLOCK_WORDS = 1_000_000
# Scores of the alignment.
MATCH, MISMATCH, GAP = 2, -1, -1

_PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum())
_SPACED = bytes(ord(" ") if b in _PUNCTUATION else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(_SPACED).split()


def seeded(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item``, ``words`` and ``at``, the places where the item's seeds begin."""

    def cut(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            words = words_of(text)
            if words:
                yield key, [w.decode() for w in words]

    fields = [StructField("item", benchmark.schema[item_col].dataType), StructField("words", ArrayType(StringType()))]
    items = map_rows(keyed_text(benchmark, item_col, text_col), fields, cut)
    items = items.withColumn("uid", F.sha2(F.concat_ws(" ", "words"), 256))
    grams = items.select("uid", "words").distinct().select("uid", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("words") - SEED, F.lit(0))),
        lambda i: F.slice("words", i + 1, SEED))).alias("at", "gram"))
    count = grams.groupBy("gram").agg(F.count_distinct("uid").alias("items"))
    counted = grams.join(count, "gram")
    rarest = counted.groupBy("uid").agg(F.min("items").alias("fewest"))
    seeds = counted.join(rarest, "uid").where((F.col("items") <= RARE) | (F.col("items") == F.col("fewest")))
    return items.join(seeds.groupBy("uid").agg(F.array_sort(F.collect_list("at")).alias("at")), "uid").select("item", "words", "at")


class Block:
    """Items of one block: their word numbers, and their seeds in order."""

    def __init__(self, items: list[tuple]):
        self.vocabulary: dict[bytes, int] = {}  # 0: a word of no item
        self.items, seeds = [], {}
        for item, words, at in items:
            ids = np.array([self.vocabulary.setdefault(w.encode(), len(self.vocabulary) + 1) for w in words], np.int64)
            self.items.append((item, ids))
            for a in at:
                gram = tuple(ids[a:a + SEED])
                seeds.setdefault(len(gram), []).append((gram, len(self.items) - 1, a))
        self.base = len(self.vocabulary) + 1
        self.seeds = {}
        for n, found in seeds.items():
            keys = np.array([self.key(np.array([g]))[0] for g, _, _ in found], np.int64)
            order = np.argsort(keys, kind="stable")
            self.seeds[n] = (keys[order], np.array([x[1] for x in found])[order], np.array([x[2] for x in found])[order])

    def key(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), np.int64)
        for i in range(grams.shape[1]):
            out = out * self.base + grams[:, i]
        return out

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Item number and the diagonals (place in the text less place in the item) of its seeds, sorted."""
        items, diagonals = [], []
        for n, (keys, item, at) in self.seeds.items():
            if len(ids) < n:
                continue
            known = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(ids > 0, n).all(1))
            text_keys = self.key(np.stack([ids[known + i] for i in range(n)], 1))
            low, high = np.searchsorted(keys, text_keys, "left"), np.searchsorted(keys, text_keys, "right")
            times = high - low
            place = np.repeat(known, times)
            seed = np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
            items.append(item[seed]), diagonals.append(place - at[seed])
        if not items or not sum(map(len, items)):
            return
        item, diagonal = np.concatenate(items), np.concatenate(diagonals)
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        starts = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        for start, stop in zip(starts, np.append(starts[1:], len(item))):
            yield int(item[start]), diagonal[start:stop]

    def matches(self, text: bytes, least: float) -> Iterator[tuple]:
        """(item, similarity, first word, word after the last) of items copied in a text."""
        words = words_of(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        for number, diagonal in self.hits(ids):
            name, item = self.items[number]
            reach = len(item) // 2 + 2
            cuts = np.flatnonzero(np.diff(diagonal) > len(item) + 2 * reach) + 1
            best = None
            own = np.zeros(self.base, bool)
            own[item] = True
            for run in np.split(diagonal, cuts):
                start, stop = max(0, int(run[0]) - reach), min(len(ids), int(run[-1]) + len(item) + reach)
                window = ids[start:stop]
                if own[window].sum() < least * len(item):  # not even if all of them matched
                    continue
                score, end = align(item, window)
                if score >= least * MATCH * len(item) and (best is None or score > best[0]):
                    _, back = align(item[::-1], window[:end][::-1])
                    best = score, start + end - back, start + end
            if best:
                yield name, best[0] / (MATCH * len(item)), best[1], best[2]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and the number of window words up to its end (the first of equal ones).

    A row of the dynamic programme at a time; gaps along the row are a running maximum.
    """
    ramp = -GAP * np.arange(len(window) + 1)
    above = np.zeros(len(window) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.zeros(len(window) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(window == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp) - ramp
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
        above = row
    return best, end


def blocks(items: DataFrame) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append(tuple(row))
        size += len(row["words"])
        if size >= BLOCK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document and item copied in it: ``id_col``, ``item_col``, ``similarity``, ``first_word`` and ``end_word`` of the passage."""
    spark: SparkSession = docs.sparkSession
    texts = keyed_text(docs, id_col, text_col)
    fields = [id_field(docs, id_col), StructField(item_col, benchmark.schema[item_col].dataType),
              StructField("similarity", DoubleType()), StructField("first_word", LongType()), StructField("end_word", LongType())]
    found = None
    for held in blocks(seeded(benchmark, item_col, item_text_col)):
        sent = spark.sparkContext.broadcast(held)  # at most BLOCK_WORDS words and one item
        part = map_rows(texts, fields, lambda rows, sent=sent: matched(rows, sent.value, least))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], map_rows(texts, fields, iter).schema)
    best = F.max_by(F.struct("similarity", "first_word", "end_word"), F.struct("similarity", -F.col("first_word"), -F.col("end_word")))
    return found.groupBy(id_col, item_col).agg(best.alias("_best")).select(id_col, item_col, "_best.*")


def matched(rows: Iterable[tuple], items: list[tuple], least: float) -> Iterator[tuple]:
    block = Block(items)
    for key, text in rows:
        for item, similarity, first, end in block.matches(text, least):
            yield key, item, similarity, first, end
