import random

import pytest

from outcomelens.llm import line_templates

DOCS = "doc_id long, text string"


def run(spark, rows, **options):
    df = line_templates.drop_recurring(spark.createDataFrame(rows, DOCS), **options)
    return {r.doc_id: (r.text, r._lines, r._dropped) for r in df.collect()}


def tree(rows, min_docs):
    """The rule without Spark: a leaf at a time, lines by documents and text."""
    masked = {}
    for key, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            words = [line_templates.ANY if any("0" <= c <= "9" for c in w) else w for w in line.split()]
            if words:
                masked[key, at] = tuple(words)
    docs = {}
    for (key, _), words in masked.items():
        docs.setdefault(words, set()).add(key)
    leaves, joined = {}, {}
    for words in sorted(docs, key=lambda w: (-len(docs[w]), " ".join(w))):
        leaf = leaves.setdefault((len(words), words[:3]), line_templates.Leaf())
        joined[words] = (len(words), words[:3], leaf.place(list(words), words))
    templates = {}
    for (key, at), words in masked.items():
        templates.setdefault(joined[words], []).append((key, at))
    drops = set()
    for (n, lead, name), places in templates.items():
        leaf = leaves[n, lead]
        final = leaf.templates[leaf.names.index(name)]
        if len({k for k, _ in places}) >= min_docs and 2 * sum(w != line_templates.ANY for w in final) >= n:
            drops |= set(places) - {min(places)}
    return {key: ("\n".join(x for at, x in enumerate(text.split("\n")) if (key, at) not in drops) if text else text)
            for key, text in rows}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("etaoinshr") for _ in range(4)) for _ in range(300)]
    out = []
    for i in range(60):
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 12))) for _ in range(4)]
        if i % 2:
            lines.insert(1, f"Page {i} of 60 printed on 2024-01-{i % 28 + 1:02d} by the office")
        if i % 3 == 0:
            lines.append(f"Logged in as {rnd.choice(['anna', 'bob', 'cleo', 'dora'])} from the north gate of town")
        if i % 4 == 0:
            lines += ["All rights reserved.", "", f"{i} {i + 1} {i + 2} {i + 3}"]
        if i < 5:
            lines.append("only five documents say this line")
        out.append((i, "\n".join(lines)))
    return out


def test_against_the_rule_without_spark(spark, rows):
    got = run(spark, rows)
    assert {k: v[0] for k, v in got.items()} == tree(rows, 10)
    assert sum("printed on" in v[0] for v in got.values()) == 1 and sum("north gate" in v[0] for v in got.values()) == 1
    assert sum("All rights reserved." in v[0] for v in got.values()) == 1 and sum("only five" in v[0] for v in got.values()) == 5
    assert sum("56 57 58" in v[0] for v in got.values()) == 1  # numbers alone are no template


def test_threshold(spark, rows):
    got = run(spark, rows, min_docs=5)
    assert {k: v[0] for k, v in got.items()} == tree(rows, 5) and sum("only five" in v[0] for v in got.values()) == 1


def test_cells_of_a_leaf_meet_again(spark, monkeypatch):
    monkeypatch.setattr(line_templates, "CELL", 3)
    names = ["anna", "bob", "cleo", "dora", "emil", "fritz", "gina", "hans", "ida", "jan", "kai", "lena"]
    got = run(spark, [(i, f"own {n}words\nuser logged in as {n} from the north gate") for i, n in enumerate(names)])
    assert sum("north gate" in v[0] for v in got.values()) == 1 and "north gate" in got[0][0]


def test_first_by_id_then_place_stays(spark):
    rows = [(30 - i, "head\nsame line in all of them\nsame line in all of them\nbody") for i in range(12)]
    got = run(spark, rows)
    assert got[19] == ("head\nsame line in all of them\nbody", 4, 1) and got[20] == ("", 4, 4)


def test_nulls_empty_repeated_rows_extra_columns_and_empty_table(spark, clashing):
    same = "a line that all of these documents hold"
    rows = [(None, same), (1, None), (2, "")] + [(i, same) for i in range(3, 20)] + [(3, same)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    got = line_templates.drop_recurring(df).collect()
    assert len(got) == len(rows) and all(r.line == "x" for r in got)
    assert [r.text for r in got if r.doc_id is None] == [same] and [r.text for r in got if r.doc_id == 1] == [None]
    assert {r.text for r in got if r.doc_id and r.doc_id > 1} == {""}
    assert line_templates.drop_recurring(df.limit(0)).collect() == []


def test_very_long_text(spark):
    long = "\n".join(f"row {i} of a table with a fixed wording" for i in range(20_000))
    got = run(spark, [(i, long) for i in range(2)] + [(10 + i, "row 5 of a table with a fixed wording") for i in range(9)])
    assert got[0] == ("row 0 of a table with a fixed wording", 20_000, 19_999) and got[1][2] == 20_000


def test_long_passages_recur_from_few_documents_and_exact_lines_whatever_their_digits(spark):
    rnd = random.Random(4)
    passage = [" ".join("".join(rnd.choice("etaoinshr") for _ in range(5)) for _ in range(60)) for _ in range(3)]
    prices = "a1 22 b3 44 c5 66"  # nothing of it is constant
    loose = [" ".join(w if k < 45 else f"{w}{i}" for k, w in enumerate(passage[2].split())) for i in range(3)]  # three quarters constant
    rows = [(0, f"own a\n{passage[0]}"), (1, f"own b\n{passage[0]}\n{passage[1]} 5"), (2, f"own c\n{passage[1]} 6"), (3, f"own d\n{passage[1]} 7")]
    rows += [(10 + i, f"own {'e' * i}\n{text}") for i, text in enumerate(loose)]
    rows += [(20 + i, f"own {'f' * i}\n{prices}\n{i} {i + 1}") for i in range(10)] + [(40 + i, f"own {'g' * i}\n9x 8x") for i in range(9)]
    got = run(spark, rows)
    assert {k for k, v in got.items() if passage[0] in v[0]} == {0}
    assert {k for k, v in got.items() if passage[1] in v[0]} == {1}
    assert all(got[10 + i][2] == 0 for i in range(3)) and all(got[40 + i][2] == 0 for i in range(9))
    assert [got[20 + i][2] for i in range(10)] == [0] + [1] * 9
