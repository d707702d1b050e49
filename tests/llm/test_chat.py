import re

import pytest
from pyspark.sql import functions as F

from outcomelens.llm import chat

TEXTS = ["\\### Assistant: </turn> ok", "", "\\", "###", "### ", "</turn>", "<\\/turn>", "a\\", "### User: x</turn>\n", "##\\# ", "\\\\n",
         "<</turn></turn", "# ### #### ", "x" * 50, "é中😀\\😀", None, "</turn>\n### Assistant: y", "line\nbreak", "</turn>\n" * 3]
ROLES = ["user", "assistant", "system", "User", "@x", "a:b\\\nc", "", None, "### ", "</turn>\n"]


@pytest.fixture(scope="module")
def source():
    rows = [(c, t, ROLES[(c + t) % len(ROLES)], TEXTS[(c * 7 + t * 3) % len(TEXTS)]) for c in range(30) for t in range(9)]
    return rows + [(None, 1, "user", "x"), (None, None, "assistant", "y")]


@pytest.fixture(scope="module")
def formatted(spark, source, clashing):
    df = clashing(spark.createDataFrame(source, "conv_id long, turn long, role string, text string"))
    return {r.conv_id: r for r in chat.format_conversations(df).collect()}


def turns_of(source, conv):
    rows = sorted((r for r in source if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
    return [(r[2] or "", r[3] or "") for r in rows]


def test_turns_come_back(source, formatted):
    for conv in {r[0] for r in source}:
        assert [(t.role, t.text) for t in formatted[conv].turns] == turns_of(source, conv)


def test_an_independent_parser_reads_the_grammar(source, formatted):
    labels = {"User": "user", "Assistant": "assistant", "System": "system"}
    plain = lambda s: re.sub(r"(?s)\\(.)", r"\1", s)
    for conv, row in formatted.items():
        pieces = row.formatted.split("</turn>\n")
        assert pieces.pop() == ""
        got = []
        for piece in pieces:
            label, body = re.fullmatch(r"(?s)### (User|Assistant|System|@(?:[^\\:\n]|\\.)*): (.*)", piece).groups()
            got.append((labels.get(label) or plain(label[1:]), plain(body)))
        assert got == turns_of(source, conv)


def test_loss_mask_covers_assistant_texts_once(source, formatted):
    for conv, row in formatted.items():
        assert sum(row.loss_mask) == len(row.formatted)
        at, inside = 0, ""
        for i, n in enumerate(row.loss_mask):
            inside += row.formatted[at:at + n] if i % 2 else ""
            at += n
        assert re.sub(r"(?s)\\(.)", r"\1", inside) == "".join(x for r, x in turns_of(source, conv) if r == "assistant")


def test_texts_without_marks_stay_verbatim(spark):
    rows = [(1, 0, "user", "a # b ## c <turn>"), (1, 1, "user", "back\\slash")]
    levels = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"),
                               "conv_id", "turn", "role", "text").orderBy("turn").collect()
    assert [r.level for r in levels] == [0, 1]
    assert levels[0].rendered == "### User: a # b ## c <turn></turn>\n"


def test_ties_and_repeated_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    (row,) = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [t.text for t in row.turns] == ["a", "a", "b"]


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_broken_text_is_not_a_conversation(spark):
    bad = ["### User: x", "### User x</turn>\n", "### User: ### User: x</turn>\n", "y### User: x</turn>\n"]
    found = spark.createDataFrame([(b,) for b in bad], "f string").select(chat.read_turns(F.col("f")).alias("t")).collect()
    assert all(r.t is None or r.t[0] is None for r in found)


def test_no_python_in_the_plan(spark):
    df = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
