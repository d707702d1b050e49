"""Chat formatting with a grammar that can be read back, in DataFrame expressions only.

Grammar of a formatted conversation::

    conversation = turn*
    turn         = "### " label ": " body "</turn>\\n"
    label        = "User" | "Assistant" | "System" | "@" other role, escaped
    body         = text in which neither "### " nor "</turn>" stands; a backslash makes the next character plain

``read_turns`` is a deterministic parser of that grammar: cut at the end marks, match each piece, drop the backslashes. Every
turn is rendered, parsed and compared with its source. A text that comes back unlike its source (it holds a mark or a
backslash) is rendered again at the next level of escaping until it comes back identical:

* level 0: the text as it is;
* level 1: a backslash before each backslash, inside each end mark and inside each turn mark;
* level 2: a backslash before every character that is neither letter, digit nor white space. A turn that no level brings back raises.

So ordinary texts stay verbatim. Whole conversations are parsed again after they are put together (``formatted_turns``).

A conversation is one value, so its text must fit one row (Spark's 2 GB). Its rows are rendered where they lie; the
rendered turns are range-partitioned by (conversation, turn), joined to pieces inside each partition and only those
pieces (at most one per partition) meet in the conversation's row: a conversation with a third of all rows is rendered, ordered and
first joined by many tasks.

Cases: null text and null role are empty; turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have a
place; a null conversation id is a conversation; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template and the labels of the usual roles.
START, AFTER_LABEL, END = "### ", ": ", "</turn>\n"
LABELS = {"user": "User", "assistant": "Assistant", "system": "System"}

LEVELS = range(3)
TURN = r"(?s)\A### (User|Assistant|System|@(?:[^\\:\n]|\\.)*): (.*)\z"


def escaped(text: Column, level: int) -> Column:
    if level == 0:
        return text
    if level == 1:
        doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        return F.replace(F.replace(doubled, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("### "), F.lit("##\\# "))
    return F.regexp_replace(text, r"([^\p{L}\p{N}\s])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def label_of(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    other = F.concat(F.lit("@"), F.regexp_replace(role, r"([\\:\n])", r"\\$1"))
    return F.coalesce(F.try_element_at(known, role), other)


def role_of(label: Column) -> Column:
    roles = F.create_map(*[F.lit(x) for role, name in LABELS.items() for x in (name, role)])
    return F.coalesce(F.try_element_at(roles, label), unescaped(F.substring(label, 2, 2_147_483_647)))


def render_turn(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(START), label_of(role), F.lit(AFTER_LABEL), escaped(text, level), F.lit(END))


def read_turns(formatted: Column) -> Column:
    """Parse: array of (header, body, role, text) per turn, body as it stands, text unescaped. A piece against the grammar is
    null; so is the array where the last turn has no end mark."""

    def cut(piece: Column) -> Column:
        return F.when(piece.rlike(TURN), F.struct(F.regexp_extract(piece, TURN, 1).alias("label"),
                                                  F.regexp_extract(piece, TURN, 2).alias("body")))

    def turn(part: Column) -> Column:
        fits = ~F.contains(part["body"], F.lit(START)) & ~F.contains(part["body"], F.lit("</turn>"))
        return F.when(fits, F.struct(
            F.concat(F.lit(START), part["label"], F.lit(AFTER_LABEL)).alias("header"), part["body"].alias("body"),
            role_of(part["label"]).alias("role"), unescaped(part["body"]).alias("text")))

    ended = F.substring(formatted, F.lit(1), F.length(formatted) - len(END))
    return F.when(F.endswith(formatted, F.lit(END)), F.transform(F.transform(F.split(ended, END, -1), cut), turn))


def format_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One row per turn: ``conv_id``, ``turn``, ``role``, ``text``, ``level`` and ``rendered``, which parses to that turn."""
    rows = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for level in LEVELS:
        open_ = ~F.col(f"_ok{level - 1}") if level else F.lit(True)
        rows = rows.withColumn(f"_r{level}", F.when(open_, render_turn(F.col("role"), F.col("text"), level)))
        rows = rows.withColumn(f"_ok{level}", F.when(open_, comes_back(f"_r{level}")))
    stuck = F.raise_error(F.concat(F.lit("turn cannot be rendered reversibly, conversation "),
                                   F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("int")
    level = F.coalesce(*[F.when(F.col(f"_ok{n}"), n) for n in LEVELS], stuck)
    return rows.select("conv_id", "turn", "role", "text", level.alias("level"),
                       F.coalesce(*[F.when(F.col(f"_ok{n}"), F.col(f"_r{n}")) for n in LEVELS]).alias("rendered"))


def comes_back(rendered: str) -> Column:
    """Whether a rendered turn parses to one turn with the row's role and text."""
    found = F.transform(read_turns(F.col(rendered)), lambda t: F.struct(t["role"], t["text"]))
    return F.coalesce(found == F.array(F.struct("role", "text")), F.lit(False))


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and, read back from it, ``turns`` (array of header, body, role,
    text) and ``loss_mask``: lengths in code points of the alternating stretches outside and inside the loss, the first one outside;
    inside are the bodies of the ``trained`` role's turns. Raises where the whole does not parse."""
    turns = format_turns(df, conv_col, turn_col, role_col, text_col)
    placed = turns.repartitionByRange("conv_id", "turn", "role", "text").withColumn("_part", F.spark_partition_id())
    entry = F.struct("turn", "role", "text", "rendered")
    pieces = placed.groupBy("conv_id", "_part").agg(F.sort_array(F.collect_list(entry)).alias("_turns")).select(
        "conv_id", "_part", F.size("_turns").alias("_n"),
        F.array_join(F.transform("_turns", lambda t: t["rendered"]), "").alias("_piece"))
    whole = pieces.groupBy("conv_id").agg(
        F.sum("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_part", "_piece"))).alias("_pieces"))
    whole = whole.select("conv_id", "_n", F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "").alias("formatted"))
    whole = whole.withColumn("turns", read_turns(F.col("formatted")))
    sound = F.isnotnull("turns") & (F.size("turns") == F.col("_n")) & ~F.exists("turns", lambda t: t.isNull())
    broken = F.raise_error(F.concat(F.lit("not the grammar: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    mask = F.flatten(F.transform("turns", lambda t: F.when(
        t["role"] == trained, F.array(F.length(t["header"]), F.length(t["body"]), F.lit(len(END)), F.lit(0))
    ).otherwise(F.array(F.length(t["header"]) + F.length(t["body"]) + F.lit(len(END)), F.lit(0)))))
    return whole.select("conv_id", F.when(sound, F.col("formatted")).otherwise(broken).alias("formatted"), "turns",
                        mask.alias("loss_mask"))


def trained_text(turns: str = "turns", trained: str = "assistant") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == trained), lambda t: t["text"]), "")
