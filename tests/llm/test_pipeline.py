import random

import pytest

import corpus_pipeline as cp
from __spark_entry__ import oracle_sql, queries


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents of which it is known what each stage does to them."""
    place = str(tmp_path_factory.mktemp("tables"))
    rnd = random.Random(1)
    words = ["river", "stone", "under", "winter", "yellow", "people", "garden", "mother", "window", "letter", "summer", "evening"]
    words += [a + b for a in words for b in words]

    def prose(n=120):
        return " ".join(rnd.choice(words) for _ in range(n))

    rows = [(i, prose()) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " and more") for i in range(3)]  # near copies of 0, 1, 2
    item = prose(30)
    rows += [(200, prose() + " " + item + " " + prose()), (300, "too short"), (301, "again and again " * 40)]
    rows += [(400 + i, prose() + "\nSubscribe to our letter number " + str(i)) for i in range(12)]
    docs = [(i, t, "en", "src", len(t)) for i, t in rows] + [(None, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def test_stages_in_order(spark, sf_dir):
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == cp.COLUMNS
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {*range(60), *range(400, 412)}
    assert set(kept["quality"]) == clean | {100, 101, 102, 200}
    assert set(kept["lines"]) == set(kept["quality"])
    assert ["Subscribe" in kept["lines"][400 + i] for i in range(12)] == [True] + [False] * 11
    assert set(kept["near_duplicates"]) == clean | {200}
    assert set(kept["decontaminate"]) == clean
    assert {r.doc_id for r in cp.STAGES[-1][1](spark, docs, sf_dir).collect()} == clean


def test_run(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {*range(60), *range(400, 412)} and all(len(r.token_ids) == 4 * r.n_tokens for r in rows)


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []
        if docs.columns != cp.COLUMNS:
            break


def test_registered():
    names = [n for n in queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in queries()
    assert {n for n in oracle_sql() if n in names} == {"op1_chat_round_trip", "op6_jaccard_rtree", "op8_warc_revisits", "op9_url_rules"}
