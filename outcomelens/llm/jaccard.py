"""Exact Jaccard join of shingle sets by count vectors in R-trees, and the components of its links.

Two texts link when ``100 * |A and B| >= 80 * |A or B|`` for their sets of distinct five-word shingles (hashed to 64 bits).

1. *Count vectors.* Shingles are hashed into groups; the numbers of shingles per group are the set's point. The sum of the coordinate
   minima of two points bounds the overlap of their sets from above; with the maximum corner of a box in place of one point it bounds the
   overlap with every set in the box, so an R-tree over points finds all sets that may overlap enough.
2. *Dealing out.* One R-tree over all points cannot be shared between tasks, and in so many dimensions its boxes overlap. The same groups
   give an exact way to deal it out: linked sets differ in at most ``r = |A| // 4`` shingles (|A| is either size), so of more than
   r non-empty groups one holds the very same shingles in both. Each set is filed under (size class, group, hash of the
   group's shingles) for its first groups until more than r of them are not empty: two linked sets meet under some key. Size classes double; a set
   within a factor 1.25 of the next class is filed there too. A set that runs out of groups is filed under its empty groups as well.
3. *Pivots.* Under each key, every set is paired with the first one. Pairs whose bound is high enough are verified on the full sets, and
   links joined to components. Large groups of near copies are connected here, with a linear number of pairs.
4. *R-trees.* Sets that share a key share its pivot. Pivots whose sets are not yet one component get an R-tree over their points per size
   class; each point asks it for all others of another component that may overlap enough. Sets with such a pair get their full sets beside them
   and are compared where they are; a link joins two components, whose further pairs are not needed: no link can add to them. Groups
   of more than ``CELL`` sets or ``CELL_SHINGLES`` shingles are split into cells, pairs of parts of bounded size.

Equal sets are one set from the start. Texts are read twice: for the keys, and, of sets in a pair to verify, for the sets. No pair is dropped.

A set is named by 64 bits of its hash: two different sets among N share a name with chance N^2 / 2^65.

Cases: null, empty and blank texts have no shingle and are linked with nothing; with fewer than five words the whole sequence is the one shingle; a
null id yields to any other as a component's least id; rows of one id, repeated or not, are one document in the result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .arrow import id_field, keyed_text, map_rows, ship
from .components import components, written

WORDS = 5
PERCENT = 80
CELL = 2048
CELL_SHINGLES = 1 << 21
FANOUT = 16
PIVOT_ROWS = 2000

MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[3]
    h = (h ^ (h >> np.uint64(29))) * MIX[4]
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    distinct = list(dict.fromkeys(words))
    number = dict(zip(distinct, range(len(distinct))))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    h = hashes[codes]
    n = len(words) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for i in range(WORDS):
        total = (total ^ (total >> np.uint64(27))) * MIX[2] + h[i:i + n] * MIX[i]
    return np.unique(_mixed(total))


def name_of(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(found.tobytes()), np.uint64).astype(np.int64))


def size_class(n: int) -> int:
    return n.bit_length() - 1


def classes(n: int) -> list[int]:
    """The set's size class, and the next one if a set a quarter larger is in it."""
    own = size_class(n)
    return [own, own + 1] if 5 * n >= 4 * (2 << own) else [own]


def groups_of(level: int) -> int:
    """Groups for filing: enough to have more non-empty ones than shingles that may differ."""
    return int(0.6 * (1 << level)) + 8


def file_keys(found: np.ndarray) -> np.ndarray:
    """Keys under which a set is filed, as signed 64-bit integers."""
    n, out = len(found), []
    may_differ = n // 4
    for level in classes(n):
        count = groups_of(level)
        group = ((found >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)  # sorted as the set is
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        filled = group[start]
        content = np.add.reduceat(_mixed(found * MIX[0] + np.uint64(level)), start)
        content = _mixed(content ^ (filled.astype(np.uint64) * MIX[1] + np.uint64(level)))
        if len(filled) > may_differ:
            out.append(content[:may_differ + 1])
        else:
            empty = np.setdiff1d(np.arange(count), filled).astype(np.uint64)
            out += [content, _mixed(empty * MIX[1] + np.uint64(level) * MIX[2])]
    return np.concatenate(out).view(np.int64)


def point(found: np.ndarray) -> bytes:
    """Shingles per group, as bytes: twice as many groups as the size class begins with, at least eight."""
    count = max(8, 2 << size_class(len(found)))
    group = found >> np.uint64(64 - (count.bit_length() - 1))
    return np.minimum(np.bincount(group.astype(np.int64), minlength=count), 255).astype(np.uint8).tobytes()


def points(stored: list[bytes], width: int) -> np.ndarray:
    """Points as rows of ``width`` groups: finer ones are summed, as group numbers are leading bits."""
    return np.array([np.frombuffer(p, np.uint8).reshape(width, -1).sum(1, dtype=np.uint16) for p in stored], np.uint16)


def needed(a, b):
    """Least overlap of linked sets of sizes ``a`` and ``b``."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def fits(a: int, b: int) -> bool:
    """Whether sets of these sizes can link."""
    return 100 * min(a, b) >= PERCENT * max(a, b)


def bound(a: bytes, b: bytes) -> int:
    width = min(len(a), len(b))
    both = points([a, b], width)
    return int(np.minimum(both[0], both[1]).sum())


class RTree:
    """Packed R-tree over points with sizes, in order of size: per node the maximum corner and the range of sizes."""

    def __init__(self, corners: np.ndarray, sizes: np.ndarray):
        self.levels = [(corners, sizes, sizes)]
        while len(self.levels[-1][0]) > FANOUT:
            corner, low, high = self.levels[-1]
            cut = np.arange(0, len(corner), FANOUT)
            self.levels.append((np.maximum.reduceat(corner, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def search(self, at: np.ndarray, size: int) -> np.ndarray:
        """Positions of the points whose bound with ``at`` reaches what a link needs."""
        node = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, high = self.levels[depth]
            reach = (100 * np.minimum(high[node], size) >= PERCENT * np.maximum(low[node], size))
            node = node[reach]
            enough = np.minimum(corner[node], at).sum(1, dtype=np.int64) >= needed(low[node], size)
            node = node[enough]
            if depth:
                below = len(self.levels[depth - 1][0])
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                node = node[node < below]
        return node


FILED = [StructField("key", LongType()), StructField("name", LongType()), StructField("n", IntegerType()),
         StructField("point", BinaryType())]


def filed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per set and key (key, name), and one per row of ``docs`` with id, name, n and point (key: the name)."""
    schema = StructType([*FILED, id_field(docs, id_col)])
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return filed_batches(batches, schema)

    return keyed_text(docs, id_col, text_col).mapInArrow(run, schema)


def filed_batches(batches, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def out(ids, names, sizes, stored, keys, of):
        none = pa.nulls(len(of))
        docs = [pa.array(names, pa.int64()), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()),
                pa.array(stored, pa.binary()), pa.array(ids, target.field(4).type)]
        yield pa.RecordBatch.from_arrays(docs, schema=target)
        if len(of):
            rows = [pa.array(keys), pa.array(of), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(target.field(4).type)]
            yield pa.RecordBatch.from_arrays(rows, schema=target)

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            names, sizes, stored, keys, of, seen = [], [], [], [], [], set()
            for text in texts:
                found = shingles(text)
                names.append(name_of(found)), sizes.append(len(found))
                stored.append(point(found) if len(found) else b"")
                if len(found) and names[-1] not in seen:
                    seen.add(names[-1])
                    keys.append(file_keys(found))
                    of.append(np.full(len(keys[-1]), names[-1], np.int64))
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, of)]
            yield from out(ids, names, sizes, stored, *flat)


SHARED = ["key", "name", "pivot"]


def shared_batches(batches):
    """Of rows (key, name), sorted by both, those of keys with two names or more, with the key's first name as pivot."""
    last_key = first = last = None  # of the open run: its key, first name and latest name
    opened = False  # whether the open run's first row is out
    for batch in batches:
        if not batch.num_rows:
            continue
        key, name = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        fresh[0] = not (last_key is not None and key[0] == last_key and name[0] == last)
        key, name = key[fresh], name[fresh]  # equal sets of different batches are filed once
        if not len(key):
            continue
        begins = np.ones(len(key), bool)
        begins[1:] = key[1:] != key[:-1]
        begins[0] = last_key is None or key[0] != last_key
        starts = np.flatnonzero(begins)
        pivot = np.empty(len(key), np.int64)
        head = starts[0] if len(starts) else len(key)
        pivot[:head] = first if first is not None else 0
        if len(starts):
            pivot[head:] = np.repeat(name[starts], np.diff(np.append(starts, len(key))))
        follows = ~begins
        lead = np.zeros(len(key), bool)  # first rows of runs that go on within this batch
        lead[:-1] = begins[:-1] & follows[1:]
        emit = follows | lead
        keys, names, pivots = key[emit], name[emit], pivot[emit]
        if head and not opened and last_key is not None:  # the run's first row was in an earlier batch
            keys, names, pivots = (np.concatenate(([x], y)) for x, y in ((last_key, keys), (first, names), (first, pivots)))
        opened = bool(follows[-1])
        last_key, last, first = key[-1], name[-1], pivot[-1]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (keys, names, pivots)], names=SHARED)


def contents(wanted: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(name, content) of the sets named in ``wanted``: their sorted shingles, from one text of each."""
    ids = sets.join(wanted, "name", "left_semi").select(F.col("id").alias("_id")).distinct()
    texts = docs.join(ids, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")

    def full(rows: Iterable[tuple]) -> Iterator[tuple]:
        for _, text in rows:
            found = shingles(text)
            yield name_of(found), found.tobytes()

    fields = [StructField("name", LongType()), StructField("content", BinaryType())]
    content = map_rows(keyed_text(texts, id_col, text_col), fields, full, lambda row: len(row[1]))
    return written(content.groupBy("name").agg(F.first("content").alias("content")), "sets")


def overlap(mine: np.ndarray, other: np.ndarray) -> int:
    at = np.searchsorted(mine, other)
    at[at == len(mine)] = 0
    return int((mine[at] == other).sum())


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links ``a``, ``b`` among candidate ``pairs`` (a, b): distinct pairs whose bound suffices, compared on the full sets.

    The second set of each pair travels to the first; a first set with more than ``PIVOT_ROWS`` pairs is sent to several places.
    """
    size = sets.select("name", "n", "point")
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(size.toDF("a", "na", "pa"), "a").join(size.toDF("b", "nb", "pb"), "b")
    pairs = pairs.where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")

    def bounded(rows: Iterable[tuple]) -> Iterator[tuple]:
        for a, b, na, nb, pa_, pb in rows:
            if bound(pa_, pb) >= needed(na, nb):
                yield a, b

    ends = [StructField("a", LongType()), StructField("b", LongType())]
    pairs = written(map_rows(pairs.select("a", "b", "na", "nb", "pa", "pb"), ends, bounded), "pairs")

    wanted = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    content = contents(wanted, sets, docs, id_col, text_col)

    spread = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PIVOT_ROWS).cast("int").alias("places"))
    firsts = spread.join(content, spread.a == content.name).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(None).cast("long").alias("b"), "content")
    seconds = pairs.join(spread, "a").join(content, F.col("b") == content.name).select(
        "a", F.pmod(F.hash("b"), "places").cast("int").alias("place"), "b", "content")
    laid = firsts.unionByName(seconds).repartition("a", "place").sortWithinPartitions("a", "place", F.col("b").asc_nulls_first())

    def compared(rows: Iterable[tuple]) -> Iterator[tuple]:
        mine = np.empty(0, np.uint64)
        for a, _, b, stored in rows:
            found = np.frombuffer(stored, np.uint64)
            if b is None:
                mine = found
            else:
                if overlap(mine, found) >= needed(len(mine), len(found)):
                    yield a, b

    return map_rows(laid, ends, compared)


CELL_KEY = ["pivot", "i", "j"]


def remaining(shared: DataFrame, roots: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between different components among sets that share a key, as far as they are needed to join these: found by R-trees in cells.

    Sets that share a key share its pivot: a pivot's sets are one group, whatever keys they share with it. A first search tells which sets may link at all;
    only their full sets are sent to the cells, where they are compared. No pair leaves a cell but the links that join something there, fewer than its sets.
    """
    rows = shared.select("pivot", "name").unionByName(shared.select("pivot", F.col("pivot").alias("name"))).distinct()
    rows = rows.join(roots.toDF("name", "root"), "name", "left").select("pivot", "name", F.coalesce("root", "name").alias("root"))
    rows = rows.join(sets.select("name", "n", "point"), "name")
    open_ = rows.groupBy("pivot").agg(
        F.min("root").alias("_r0"), F.max("root").alias("_r1"), F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_shingles"))
    parts = F.ceil(F.greatest(F.col("_rows") / CELL, F.col("_shingles") / CELL_SHINGLES)).cast("int")
    open_ = open_.where("_r0 <> _r1").select("pivot", parts.alias("parts"))
    rows = rows.join(open_, "pivot").withColumn("part", F.pmod(F.hash("name"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = rows.select("pivot", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "name", "root", "n", "point")

    def may_link(cell: tuple, held: list) -> Iterator[tuple]:
        for x in sorted({x for pair in in_cell(held, cell) for x in pair}):
            yield (*cell, *held[x])

    def joined(cell: tuple, held: list) -> Iterator[tuple]:
        found = [np.frombuffer(entry[5], np.uint64) for entry in held]
        root = dict.fromkeys((entry[2] for entry in held))
        root = dict(zip(root, root))

        def top(r: int) -> int:
            while root[r] != r:
                root[r] = r = root[root[r]]
            return r

        for x, y in in_cell(held, cell):
            a, b = top(held[x][2]), top(held[y][2])
            if a != b and overlap(found[x], found[y]) >= needed(len(found[x]), len(found[y])):
                root[a] = b
                yield held[x][1], held[y][1]

    numbers = [StructField(c, LongType()) for c in (*CELL_KEY, "part", "name", "root", "n")]
    asking = written(by_cell(cells, [*numbers, StructField("point", BinaryType())], may_link), "may-link")
    full = contents(asking.select("name").distinct(), sets, docs, id_col, text_col)
    return by_cell(asking.join(full, "name"), [StructField("a", LongType()), StructField("b", LongType())], joined)


def by_cell(cells: DataFrame, fields: list[StructField], run: Callable[[tuple, list], Iterator[tuple]]) -> DataFrame:
    """What ``run`` gives for each cell and its entries (part, name, root, n, point and, if there, content) in order of n."""
    entry = [c for c in ("part", "name", "root", "n", "point", "content") if c in cells.columns]
    laid = cells.select(*CELL_KEY, *entry).repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY, "n", "name")

    def each(found: Iterable[tuple]) -> Iterator[tuple]:
        cell, held = None, []
        for row in found:
            if row[:3] != cell:
                yield from run(cell, held)
                cell, held = row[:3], []
            held.append(row[3:])
        yield from run(cell, held)

    return map_rows(laid, fields, each)


def in_cell(held: list, cell) -> Iterator[tuple]:
    """Positions of the pairs of a cell, of different components and with a bound that suffices; its entries begin with part, name, root, n and point and are
    in order of n. In a cell of two parts, the pairs across.

    A size class is searched for its own sets and for those of the class below, whose coarser groups both then have.
    """
    if len(held) < 2:
        return
    part, root, n = (np.array([e[k] for e in held], np.int64) for k in (0, 2, 3))
    level = np.array([size_class(int(x)) for x in n])
    across = cell[1] != cell[2]
    for upper in np.unique(level):
        there = np.flatnonzero(level == upper)
        for lower in (upper, upper - 1):
            asking = np.flatnonzero(level == lower)
            if not len(asking):
                continue
            width = len(held[asking[0]][4])
            tree = RTree(points([held[x][4] for x in there], width), n[there])
            for x, at in zip(asking, points([held[x][4] for x in asking], width)):
                found = there[tree.search(at, int(n[x]))]
                found = found[(found > x) & (root[found] != root[x])]
                if across:
                    found = found[part[found] != part[x]]
                for y in found:
                    yield int(x), int(y)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (least id reachable by links) of every id."""
    spread = filed(docs, id_col, text_col).repartition("key").sortWithinPartitions("key", "name")
    # one pass over the texts gives both kinds of rows; written together, read apart
    kept = written(both_kinds(spread, id_col), "filed")
    rows = kept.where("n is not null").select("name", "n", "point", F.col(id_col).alias("id"))
    sets = rows.where("n > 0").groupBy("name").agg(F.min("id").alias("id"), F.first("n").alias("n"),
                                                  F.first("point").alias("point"))
    sets = written(sets, "sets-named")
    shared = kept.where("n is null").select("name", "pivot").distinct()
    shared = written(shared, "pivots")
    links = written(verified(shared.select(F.col("name").alias("a"), F.col("pivot").alias("b")), sets, docs, id_col, text_col), "links-1")
    more = written(remaining(shared, components(links), sets, docs, id_col, text_col), "links-2")
    roots = components(links.unionByName(more))
    grouped = sets.join(roots.toDF("name", "root"), "name", "left").select("name", F.coalesce("root", "name").alias("root"), "id")
    least = grouped.groupBy("root").agg(F.min("id").alias("_least"))
    of_set = grouped.join(least, "root").select("name", "_least")
    return rows.join(of_set, "name", "left").groupBy("id").agg(
        F.max("n").cast("long").alias("n_shingles"), F.min("_least").alias("_c")
    ).select(F.col("id").alias(id_col), "n_shingles", F.coalesce("_c", "id").alias("component_id"))


def both_kinds(spread: DataFrame, id_col: str) -> DataFrame:
    """Document rows as they are, and of the (key, name) rows those of shared keys with their pivot."""
    schema = StructType([*FILED, StructField("pivot", LongType()), spread.schema[id_col]])
    ship(spread.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return split_kinds(batches, schema)

    return spread.mapInArrow(run, schema)


def split_kinds(batches, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    documents: list[pa.RecordBatch] = []

    def keys_only():
        for batch in batches:
            own = batch.column(2).is_valid()
            rows = batch.filter(own)
            if rows.num_rows:
                none = pa.nulls(rows.num_rows, pa.int64())
                documents.append(pa.RecordBatch.from_arrays([*rows.columns[:4], none, rows.column(4)], schema=target))
            yield batch.filter(pc.invert(own)).select(["key", "name"])

    for batch in shared_batches(keys_only()):
        yield from documents
        documents.clear()
        empty = [pa.nulls(batch.num_rows, target.field(i).type) for i in (2, 3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *empty, batch.column(2),
                                          pa.nulls(batch.num_rows, target.field(5).type)], schema=target)
    yield from documents
