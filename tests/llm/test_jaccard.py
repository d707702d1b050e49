import random
import re
from itertools import combinations

import numpy as np
import pytest

from outcomelens.llm import jaccard
from outcomelens.llm.components import components

DOCS = "doc_id long, text string"


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {}
    for key, text in rows:
        sets[key] = brute_set(text)
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {k: (len(s), root(k)) for k, s in sets.items()}


def result(spark, rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(spark.createDataFrame(rows, DOCS)).collect()}


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rnd.randrange(len(words))
        kind = rnd.random()
        if kind < 0.6:
            words[at] = rnd.choice("abcdefgh") * 3
        elif kind < 0.8:
            words.insert(at, "in")
        elif len(words) > 1:
            del words[at]
    return words


@pytest.fixture(scope="module")
def rows():
    """Families around the limit of 80 %, of all sizes, chains of edits, and a passage that many share."""
    rnd, out = random.Random(11), []
    passage = [f"p{i}" for i in range(40)]
    for size in (1, 3, 4, 5, 6, 8, 9, 12, 15, 20, 31, 40, 64, 100, 129, 200, 300, 520):
        for _ in range(3):
            words = [rnd.choice("xyzuvw") + str(rnd.randrange(200)) for _ in range(size)]
            for _ in range(5):
                out.append(words)
                words = edited(rnd, words, rnd.choice([0, 1, 1, 2, max(1, size // 40), max(1, size // 25)]))
    for size in (5, 10, 20, 60, 150):
        for _ in range(8):
            out.append(passage + [f"q{rnd.randrange(10 ** 6)}" for _ in range(size)])
    texts = [" ".join(w) for w in out] + ["", " \n", None, "A B c", "a b C", "Das ÄPFEL eins zwei drei", "das Äpfel eins zwei drei"]
    rnd.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def test_against_brute_force(spark, rows):
    want = brute(rows)
    assert len({r for _, r in want.values()}) < len(want) - 60  # there are links
    assert result(spark, rows) == want


def test_trees_and_cells_find_what_pivots_miss(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 4)
    assert result(spark, rows) == brute(rows)


def test_large_group_of_near_copies(spark):
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rnd, base, rnd.randrange(4)))) for i in range(150)]
    rows += [(1000 + i, " ".join(base)) for i in range(60)]
    assert result(spark, rows) == brute(rows)


def test_nulls_repeated_rows_extra_columns_and_empty_table(spark, clashing):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(df).collect()}
    assert got == {(None, 2, 5), (5, 2, 5), (7, 0, 7)}
    assert jaccard.link(df.limit(0)).collect() == []


def test_linked_sets_share_a_key():
    rnd = np.random.default_rng(1)
    for n in [*range(1, 60), 100, 127, 128, 200, 255, 256, 1000]:
        for _ in range(20):
            a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            # as many left out or put in as a link allows
            common = rnd.permutation(a)[:max(1, int(np.ceil(0.8 * len(a))))]
            room = int(len(common) / 0.8 - len(a) + 1e-9)
            b = np.unique(np.concatenate((common, rnd.integers(0, 1 << 63, max(0, room)).astype(np.uint64))))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 80 * (len(a) + len(b) - shared):
                assert np.intersect1d(jaccard.file_keys(a), jaccard.file_keys(b)).size, n


def test_tree_finds_all_points_within_the_bound():
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 1 << 63, int(n)).astype(np.uint64) * np.uint64(2)) for n in rnd.integers(64, 128, 300)]
    sets.sort(key=len)
    corners, sizes = jaccard.points([jaccard.point(s) for s in sets], 32), np.array([len(s) for s in sets])
    tree = jaccard.RTree(corners, sizes)
    for x in range(0, 300, 7):
        bounds = np.minimum(corners, corners[x]).sum(1)
        want = np.flatnonzero((bounds >= jaccard.needed(sizes, sizes[x])) & (100 * np.minimum(sizes, sizes[x]) >= 80 * np.maximum(sizes, sizes[x])))
        assert tree.search(corners[x], int(sizes[x])).tolist() == want.tolist()


def test_bound_is_never_below_the_overlap():
    rnd = np.random.default_rng(6)
    for _ in range(50):
        a = np.unique(rnd.integers(0, 1 << 63, 140).astype(np.uint64))
        b = np.unique(np.concatenate((a[:100], rnd.integers(0, 1 << 63, 20).astype(np.uint64))))
        assert jaccard.bound(jaccard.point(a), jaccard.point(b)) >= len(np.intersect1d(a, b))


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    edges += [(500, 501 + i) for i in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_near_copies_apart_from_their_pivot_give_no_pair_each(spark):
    """Before: all 435 pairs of them left the cells."""
    from pyspark.sql import functions as F
    from outcomelens.llm import jaccard
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:5 + 6 * i], f"x{i}", *base[6 + 6 * i:]]) for i in range(30)] + [" ".join(f"p{i}" for i in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(jaccard.name_of(s), i, len(s), jaccard.point(s)) for i, s in enumerate(jaccard.shingles(t.encode()) for t in texts)]
    sets = spark.createDataFrame([(name, i, n, bytearray(p)) for name, i, n, p in rows], "name long, id long, n int, point binary")
    shared = sets.select("name", F.lit(rows[30][0]).alias("pivot"))
    roots = spark.createDataFrame([], "node long, root long")
    found = jaccard.remaining(shared, roots, sets, docs, "doc_id", "text").collect()
    number = {name: i for name, i, _, _ in rows}
    parent = list(range(31))
    for a, b in found:
        a, b = number[a], number[b]
        assert jaccard.overlap(jaccard.shingles(texts[a].encode()), jaccard.shingles(texts[b].encode())) >= jaccard.needed(rows[a][2], rows[b][2])
        parent = [parent[b] if p == parent[a] else p for p in parent]
    assert len(found) == 29 and len(set(parent[:30])) == 1 and parent[30] == 30
