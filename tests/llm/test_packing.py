import functools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from outcomelens.llm import packing
from outcomelens.llm.arrow import vocabulary_path

COUNTS = st.integers(6, 24).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 3), max_size=5)))


@functools.cache
def least(items, capacity):
    """Fewest sequences for the items (descending), over all fillings that hold the first."""
    if not items:
        return 0
    first, *rest = items
    tried, best = set(), len(items)

    def fill(at, chosen, room):
        nonlocal best
        if at == len(rest):
            if chosen not in tried:
                tried.add(chosen)
                others = tuple(x for i, x in enumerate(rest) if i not in chosen)
                best = min(best, 1 + least(others, capacity))
            return
        fill(at + 1, chosen, room)
        if rest[at] <= room:
            fill(at + 1, chosen | {at}, room - rest[at])

    fill(0, frozenset(), capacity - first)
    return best


def spread(counts):
    return tuple(sorted((x for x, n in counts.items() for _ in range(n)), reverse=True))


@settings(deadline=None, max_examples=250)
@given(COUNTS)
def test_reduction_keeps_the_optimum(case):
    capacity, counts = case
    items = spread(counts)[:9]
    counts = {x: items.count(x) for x in items}
    lengths = packing.Lengths(counts, capacity)
    fixed = packing.reduced(lengths)
    left = spread({x: n for x, n in enumerate(lengths.n) if n})
    assert sum(times for _, times in fixed) + least(left, capacity) == least(items, capacity)


def one_by_one(counts, capacity):
    """Best-fit decreasing, piece by piece."""
    rooms = []
    for x in spread(counts):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


@settings(deadline=None, max_examples=300)
@given(st.integers(6, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 40), max_size=12))))
def test_best_fit_by_counts(case):
    capacity, counts = case
    fillings = packing.best_fitted(packing.Lengths(counts, capacity))
    rooms = [capacity - sum(x * many for x, many in filling) for filling, times in fillings for _ in range(times)]
    assert sorted(rooms) == one_by_one(counts, capacity)


@settings(deadline=None, max_examples=200)
@given(st.integers(6, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 400), max_size=30))))
def test_plan_holds_every_piece_once(case):
    capacity, counts = case
    fillings = packing.plan(counts, capacity)
    assert all(sum(x * many for x, many in filling) <= capacity for filling, _ in fillings)
    found = {}
    for length, first, last, many, sequence, offset in packing.places(fillings):
        for number in range(first, last):
            at = number - first
            key = (sequence + at // many, offset + at % many * length)
            assert key not in found and found.setdefault(key, (length, number))
    assert sorted(found.values()) == sorted((x, i) for x, n in counts.items() for i in range(n))


def test_perfect_pairs_and_single_pieces():
    lengths = packing.Lengths({600: 3, 424: 3, 1024: 2, 1000: 1}, 1024)
    fixed = packing.reduced(lengths)
    assert sorted(fixed) == [(((600, 1), (424, 1)), 3), (((1000, 1),), 1), (((1024, 1),), 2)] and not any(lengths.n)


DATA = [(1, "one two three"), (2, None), (3, ""), (3, ""), (None, "no id"), (4, "word " * 3000), (5, "a<|endoftext|>b"), (6, "x" * 5000),
        (7, "é😀\0 ﬁ\n\n\t"), (8, "one two three")]


def expected(data, capacity):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    out = []
    for key, text in data:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        short = len(ids) % capacity
        cuts = ([0] if short else []) + list(range(short, len(ids) + 1, capacity))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((key, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=repr)


def check_places(packed, capacity):
    by = {}
    for r in packed.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_pieces_and_places(spark, rows, clashing):
    df = spark.createDataFrame(DATA * 3, "doc_id long, text string").repartition(5)
    more = clashing(df).withColumns({c: F.lit("x") for c in ("_task", "_rank", "piece", "length", "_n", "_id", "_from", "offset", "ids")})
    for capacity in (16, 64, 1024):
        packed = packing.pack(more, "doc_id", "text", capacity=capacity)
        assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        want = expected(DATA * 3, capacity)
        assert rows(packed.drop("sequence_id", "offset")) == want
        counts = {}
        for r in want:
            counts[r[3]] = counts.get(r[3], 0) + 1
        assert check_places(packed, capacity) == sum(times for _, times in packing.plan(counts, capacity))


def test_sequences_hold_their_pieces(spark):
    df = spark.createDataFrame(DATA, "doc_id long, text string")
    packed = packing.pack(df, "doc_id", "text", capacity=64, ids=True).cache()
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"])
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    assert sum(map(len, whole.values())) == 4 * sum(r["length"] for r in packed.collect())


def test_one_length_holds_all(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text")).repartition(7)
    packed = packing.pack(df, "doc_id", "text", capacity=10)
    assert check_places(packed, 10) == 1000 and packed.count() == 3000


def test_empty_table_and_long_blanks(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, "doc_id", "text").count() == 0
    vocabulary = packing.load("byte_bpe_50k")
    text = " " * 1_200_000 + "x"
    assert vocabulary.ids(text).tolist() == vocabulary.library.encode(text, add_special_tokens=False).ids
