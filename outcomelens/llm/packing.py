"""Best-fit packing of tokenised documents into sequences of bounded length, after a dominance reduction.

How many sequences are needed hangs only on how many pieces there are of each length, at most ``capacity`` numbers whatever the
corpus. Spark counts them; ``plan`` turns the counts into fillings (which lengths share a sequence, how often); Spark then deals the pieces out to the
places of their length. No piece passes the driver.

- ``reduced`` (Martello and Toth): among all fillings that hold a piece of length j, one that dominates every other can be fixed for good, for some best packing
  holds it. {j, k} dominates if k is the largest sum that other pieces can reach beside j: whatever stood there fits where k was (k = 0: j stays alone; k fills
  the rest exactly: a perfect pair). {j, a, b} does if no more than two fit beside j and each of two others is no larger than a and b
  or both together no larger than a. What is fixed leaves the instance, and smaller instances are tried again until nothing is fixed.
- ``best_fitted`` packs the rest: longest first, each into the fullest sequence with room.

Equal pieces are handled together, so the work of the plan is bounded by the capacity too; so is its size, which is why it may be broadcast.

Places: the task that tokenises numbers its own pieces of each length; pieces are written out, and the counts of the tasks before give each piece its number among all of
its length. Only (id, piece, start, length, checksum) is shuffled, by (task, length), so a length that a third of all pieces have is spread as the tasks are.

Cases: null and empty text are one end mark; repeated rows are packed each for itself; texts are taken whole, and those longer than the capacity are cut into full
pieces, the first being shorter; null ids stay null; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField

from ..session import scratch_path
from .arrow import id_field, keyed_text, map_rows, vocabulary_path

#: (((length, how many of it), ...) of one sequence, number of such sequences)
Filling = tuple[tuple[tuple[int, int], ...], int]


class ByteVocabulary:
    """Ids as the ``tokenizers`` file gives them, computed with the same vocabulary's ranks where that library is faster."""

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(f"{name}.json"))
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        with open(vocabulary_path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.ranks = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.ranks.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:  # a run of blanks that is too long for its pattern
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def load(name: str) -> ByteVocabulary:
    return ByteVocabulary(name)


def pieces(df: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, capacity: int, ids: bool = False) -> DataFrame:
    """``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, on request ``ids`` (little-endian), and the piece's number ``_rank`` among those of its length
    that its ``_task`` has made. Write it out before use: another run may deal documents out to tasks anew."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        task, made, vocab = TaskContext.get().partitionId(), [0] * (capacity + 1), load(vocabulary)
        for key, text in rows:
            tokens = np.append(vocab.ids(text.decode(errors="replace")), [end_id]).astype("<u4")
            first = (len(tokens) - 1) % capacity + 1
            for i, end in enumerate(range(first, len(tokens) + 1, capacity)):
                start = end - capacity if i else 0
                held = tokens[start:end].tobytes()
                length = end - start
                yield key, i, start, length, zlib.crc32(held), task, made[length], *([held] if ids else [])
                made[length] += 1

    fields = [id_field(df, id_col), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
              StructField("ids_crc32", LongType()), StructField("_task", IntegerType()), StructField("_rank", LongType())]
    return map_rows(keyed_text(df, id_col, text_col), fields + [StructField("ids", BinaryType())] * ids, run,
                    (lambda row: len(row[7])) if ids else lambda row: 0)


class Lengths:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = [0] * (capacity + 1)
        for length, count in counts.items():
            self.n[length] += count
        self.capacity = capacity

    def largest(self, room: int, taken: dict[int, int]) -> int:
        """The largest length of at most ``room`` of which more are left than ``taken`` says; 0 if there is none."""
        return next((x for x in range(room, 0, -1) if self.n[x] > taken.get(x, 0)), 0)

    def best_sum(self, room: int, taken: dict[int, int]) -> int:
        """The largest sum of at most ``room`` that pieces other than those ``taken`` can reach."""
        whole, sums = (1 << room + 1) - 1, 1
        for x in range(1, room + 1):
            left, times = min(self.n[x] - taken.get(x, 0), room // x), 1
            while left > 0 and not sums >> room:
                step = min(times, left)
                sums |= sums << step * x & whole
                left, times = left - step, times * 2
        return sums.bit_length() - 1

    def smallest_sum(self, number: int, taken: dict[int, int]) -> float:
        """Sum of the ``number`` smallest pieces other than those ``taken``; infinite if there are not so many."""
        total = 0
        for x in range(1, self.capacity + 1):
            step = min(number, self.n[x] - taken.get(x, 0))
            total, number = total + step * x, number - step
            if not number:
                return total
        return float("inf")

    def dominating(self, j: int) -> dict[int, int] | None:
        """A filling with a piece of length j that no other can better, as length: how many; None if none is known."""
        room, taken = self.capacity - j, {j: 1}
        k = self.largest(room, taken)
        if k == room or self.best_sum(room, taken) == k:
            return _with(taken, k) if k else taken
        if self.smallest_sum(3, taken) <= room:
            return None
        pair = _with(taken, k)
        b = self.largest(room - k, pair)
        for y in range(b + 1, room // 2 + 1):
            if self.n[y] > taken.get(y, 0):
                x = self.largest(room - y, _with(taken, y))
                if x >= y and x + y > k:
                    return None
        return _with(pair, b) if b else None

    def take(self, filling: dict[int, int]) -> Filling:
        """Fix the filling as often as the pieces allow."""
        times = min(self.n[x] // many for x, many in filling.items())
        for x, many in filling.items():
            self.n[x] -= times * many
        return tuple(sorted(filling.items(), reverse=True)), times


def _with(taken: dict[int, int], x: int) -> dict[int, int]:
    return taken | {x: taken.get(x, 0) + 1}


def reduced(lengths: Lengths) -> list[Filling]:
    """Fillings that some best packing holds; their pieces leave ``lengths``."""
    fixed: list[Filling] = []
    before = -1
    while before != len(fixed):
        before = len(fixed)
        for j in range(lengths.capacity, 0, -1):
            while lengths.n[j] and (filling := lengths.dominating(j)):
                fixed.append(lengths.take(filling))
    return fixed


def best_fitted(lengths: Lengths) -> list[Filling]:
    """The remaining pieces, longest first, each where least room is left beside it."""
    open_: list[list[Filling]] = [[] for _ in range(lengths.capacity + 1)]
    for j in range(lengths.capacity, 0, -1):
        while left := lengths.n[j]:
            room = next((r for r in range(j, lengths.capacity + 1) if open_[r]), 0)
            held, there = open_[room].pop() if room else ((), left)
            room = room or lengths.capacity
            many = min(room // j, left)  # it stays the fullest until no more fit
            times = min(there, left // many)
            if there > times and held:
                open_[room].append((held, there - times))
            open_[room - many * j].append(((*held, (j, many)), times))
            lengths.n[j] -= times * many
    return [filling for fillings in open_ for filling in fillings]


def plan(counts: dict[int, int], capacity: int) -> list[Filling]:
    lengths = Lengths(counts, capacity)
    return reduced(lengths) + best_fitted(lengths)


def places(fillings: list[Filling]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(length, first number, number after the last, how many of it in a sequence, first sequence, offset): where pieces go by their number."""
    used: dict[int, int] = {}
    sequence = 0
    for filling, times in fillings:
        offset = 0
        for length, many in filling:
            first = used.get(length, 0)
            used[length] = first + times * many
            yield length, first, used[length], many, sequence, offset
            offset += length * many
        sequence += times


def pack(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k", end_id: int = 2, capacity: int = 1024,
         ids: bool = False) -> DataFrame:
    """Per piece: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, on request ``ids``, and its place: ``sequence_id``, ``offset``."""
    spark = df.sparkSession
    written = scratch_path(spark, "pieces")
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    pieces(texts, "_id", "_text", vocabulary, end_id, capacity, ids).write.parquet(written)
    made = spark.read.parquet(written)
    counts = made.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    where = spark.createDataFrame(list(places(plan(total, capacity))),
                                  "_length long, _from long, _to long, _many long, _sequence long, _offset long")
    before = counts.select("length", "_task", F.expr(
        "coalesce(sum(_n) OVER (PARTITION BY length ORDER BY _task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_before"))
    numbered = made.join(before, ["length", "_task"]).withColumn("_number", F.col("_rank") + F.col("_before"))
    mine = (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("_from")) & (F.col("_number") < F.col("_to"))
    place = F.col("_number") - F.col("_from")
    return numbered.join(F.broadcast(where), mine).select(
        F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", *(["ids"] if ids else []),
        F.expr("_sequence + (_number - _from) div _many").alias("sequence_id"),
        (F.col("_offset") + place % F.col("_many") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids`` (little-endian) and ``n_tokens`` of the sequences of ``pack(..., ids=True)``; a sequence has ``capacity`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda held, part: F.concat(held, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))
