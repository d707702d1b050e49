import random

import numpy as np
import pytest

from outcomelens.llm import decontamination as d

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


@pytest.fixture(scope="module")
def vocabulary():
    rnd = random.Random(3)
    return rnd, ["the", "of", "and", "in", "to"] * 8 + ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(3, 8))) for _ in range(400)]


@pytest.fixture(scope="module")
def cases(vocabulary):
    rnd, words = vocabulary
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(15, 50)))) for i in range(60)]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    docs, want = [], set()
    for i, text in items:
        w = text.split()
        fourth = [x if k % 4 else rnd.choice(words) for k, x in enumerate(w)]
        loose = [x for k, x in enumerate(w) if k % 9] + ["extra"]
        half = w[: len(w) * 6 // 10]
        for n, copy in enumerate((w, fourth, loose, half)):
            docs.append((i * 10 + n, f"{prose(80)}\n{' '.join(copy).upper()}! {prose(60)}"))
            want.add((i * 10 + n, i))
    docs += [(5000 + i, prose(400)) for i in range(200)]
    return items, docs, want


def test_copies_and_edited_copies_are_found_and_others_left(spark, cases):
    items, docs, want = cases
    found = d.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    texts = dict(docs)
    for r in found:
        if r.doc_id % 10 == 0:
            assert r.similarity == 1.0
            words = d.words_of(texts[r.doc_id].encode())[r.first_word:r.end_word]
            assert b" ".join(words).decode() == dict(items)[r.item_id]


def test_alignment_against_the_full_table():
    rnd = np.random.default_rng(2)
    for _ in range(60):
        a, b = rnd.integers(0, 6, rnd.integers(1, 15)), rnd.integers(0, 6, rnd.integers(1, 25))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(0, table[i, j] + (d.MATCH if a[i] == b[j] else d.MISMATCH), table[i, j + 1] + d.GAP, table[i + 1, j] + d.GAP)
        assert d.align(a, b)[0] == table.max()


def test_blocks_of_items_change_nothing(spark, cases, monkeypatch):
    items, docs, want = cases
    monkeypatch.setattr(d, "BLOCK_WORDS", 400)
    found = d.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want


def test_a_passage_in_many_documents_and_items_with_common_words_only(spark):
    items = [(i, "the of and in to the of and") for i in range(20)] + [(50, "zig zag zog zug zeg zyg zaag"), (60, "zo za")]
    docs = [(i, "plain words before zig zag zog zug zeg zyg zaag and after") for i in range(60)] + [(99, "so the of and in to the of and"), (98, "x zo za y")]
    found = {(r.doc_id, r.item_id) for r in d.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert found == {(i, 50) for i in range(60)} | {(99, i) for i in range(20)} | {(98, 60)}


def test_nulls_long_texts_repeated_rows_extra_columns_and_empty_tables(spark, clashing, vocabulary):
    rnd, words = vocabulary
    item = "alpha beta gamma delta epsilon zeta eta theta"
    long = " ".join(rnd.choice(words) for _ in range(60_000)) + " " + item + " and and and" * 3000
    docs = clashing(spark.createDataFrame([(None, item), (1, None), (2, ""), (3, long), (4, item), (4, item)], DOCS))
    items = clashing(spark.createDataFrame([(1, item), (None, None), (3, ""), (4, item)], ITEMS))
    found = sorted((repr(r.doc_id), r.item_id) for r in d.find(docs, items).collect())
    assert found == sorted((x, i) for x in ("None", "3", "4") for i in (1, 4))
    assert d.find(docs, items.limit(0)).collect() == [] and d.find(docs.limit(0), items).collect() == []
