"""Line dedup by a log-template tree of fixed depth.

Words of a line that hold a digit are variable fields and read ``<*>``. The tree's inner levels are the number of words and the first ``LEADING``
words; a leaf holds the lines that agree in them. Inside a leaf a line joins the template it shares most words with, place by place, if that is
``SIMILAR`` (70 %) of its words or more, and the places where they differ become ``<*>`` too; else it starts a template.

A template that occurs in ``min_docs`` documents or more recurs. Of all its lines only the first (least document id, then place) stays. A template
of which less than half is constant says too little and is left alone, so are blank lines. A template of ``LONG`` words or more of which
``STEADY`` is constant recurs from ``FEW`` documents on.

Lines that are alike byte for byte are counted beside the templates, whatever share of their words holds digits: they recur in ``min_docs``
documents, those of ``LONG`` words or more in ``PAIR``. The first line of a template is always the first of its like, so it stays.

Spread: lines are counted by hash with a merge before the shuffle, so a line that every document holds is a few rows. Only leaves that hold several
different lines and enough documents need texts: a bit field keeps the others in their tasks, and a line leaves its task once. Leaves with more than ``CELL`` lines are parsed in cells by
hash, and the cells' templates are then parsed against each other: that order of arrival is fixed (documents, then text), not by chance.
Documents that lose a line meet the list of their dropped places; the others are not dealt out.

Lines and documents are named by 64-bit hashes of their content.

Cases: null text stays null, empty text stays; rows with the same id and text are one document here and are treated alike; a null id sorts first;
an empty table gives an empty result; other columns pass through ``drop_recurring`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .arrow import map_rows, plain_rows, ship
from .components import written
from .fields import hashed_field, held

LEADING = 3
SIMILAR = 0.7
CELL = 4096
LONG, STEADY = 50, 0.9
FEW, PAIR = 3, 2
ANY = "<*>"


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def occurrences(docs: DataFrame, id_col: str, text_col: str, keep_text: bool = False) -> DataFrame:
    """A row per line with a word: document, place, ``line``, ``leaf`` and ``same`` (the line unmasked) as hashes, ``long``; with ``keep_text`` the line and no place."""
    lines = docs.select(F.col(id_col).alias("_id"), _row(id_col, text_col).alias("_doc"),
                        F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("at", "raw"))
    lines = lines.where(F.col("raw").rlike(r"[^\x20\x09-\x0D]"))
    raw = F.col("raw")
    # each pattern begins where a word does and never goes back, and runs only on lines that need it
    masked = F.when(raw.rlike("[0-9]"), F.regexp_replace(
        raw, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+", ANY)).otherwise(raw)
    lines = lines.withColumn("text", masked)
    plain = F.when(F.col("text").rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace("text", r"[\x20\x09-\x0D]++", " ")).otherwise(F.col("text"))
    lines = lines.withColumn("text", F.trim(plain))
    begin = F.substring_index("text", " ", LEADING)
    count = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    named = lines.withColumns({"line": F.xxhash64("text"), "leaf": F.xxhash64(count, begin), "same": F.xxhash64("raw"), "long": count + 1 >= LONG,
                               "masked": raw.rlike("[0-9]")})
    return named.select("line", "leaf", "text") if keep_text else named.select("_id", "_doc", "at", "line", "leaf", "same", "long", "masked")


def counted_lines(found: DataFrame) -> DataFrame:
    """``line``, ``leaf`` and ``docs``, the number of documents that hold the line."""
    return found.groupBy("line", "_doc").agg(F.first("leaf").alias("leaf"), F.first("long").alias("long")).groupBy("line").agg(
        F.first("leaf").alias("leaf"), F.first("long").alias("long"), F.count(F.lit(1)).alias("docs"))


class Leaf:
    """Templates of one leaf, in order of arrival."""

    def __init__(self):
        self.templates: list[list[str]] = []
        self.names: list[int] = []

    def place(self, words: list[str], name: int) -> int:
        """The name of the template that the words join; ``name`` if they start one."""
        best, most = None, 0
        for i, template in enumerate(self.templates):
            same = sum(a == b for a, b in zip(template, words) if a != ANY)
            if same > most and same >= SIMILAR * len(words):
                best, most = i, same
        if best is None:
            self.templates.append(list(words))
            self.names.append(name)
            return name
        self.templates[best] = [a if a == b else ANY for a, b in zip(self.templates[best], words)]
        return self.names[best]


PLACED = StructType([StructField("line", LongType()), StructField("template", LongType()), StructField("leaf", LongType()),
                     StructField("text", StringType())])


def parsed(lines: DataFrame, cell: Column) -> DataFrame:
    """Lines (line, leaf, docs, text) with the name of the template they join within their cell, and that template's last text on the row
    of the line that started it."""
    laid = lines.withColumn("cell", cell).repartition("leaf", "cell").sortWithinPartitions(
        "leaf", "cell", F.col("docs").desc(), "text", "line").select("leaf", "cell", "line", "text")
    ship(lines.sparkSession)

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        here, leaf, joined = None, Leaf(), []

        def finished():
            texts = dict(zip(leaf.names, leaf.templates))
            for line, name in joined:
                yield line, name, here[0], " ".join(texts[name]) if line == name else None

        for at, part, line, text in rows:
            if (at, part) != here:
                yield from finished()
                here, leaf, joined = (at, part), Leaf(), []
            joined.append((line, leaf.place(text.split(" "), line)))
        yield from finished()

    return map_rows(laid, list(PLACED), run)


def templates(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, min_docs: int) -> DataFrame:
    """``line``, ``template`` of the lines whose template may recur, and ``least``, the documents it takes."""
    counted = written(counted_lines(found), "lines")
    leaves = counted.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("docs").alias("_docs"), F.first("long").alias("_long")).where(
        F.col("_docs") >= F.when(F.col("_long"), min(FEW, min_docs)).otherwise(min_docs))
    busy = written(counted.join(leaves, "leaf").select("line", "leaf", "docs", "n"), "busy-lines")
    texts = occurrences(docs, id_col, text_col, keep_text=True).drop("leaf")
    # only lines that a busy leaf may hold leave their task, each once
    texts = texts.where(held(texts, hashed_field(busy, F.col("line")), F.col("line"))).groupBy("line").agg(F.first("text").alias("text"))
    texts = texts.join(busy, "line")
    first = written(parsed(texts, F.when(F.col("n") > CELL, F.pmod("line", F.ceil(F.col("n") / CELL))).otherwise(0)), "cell-templates")
    begun = first.where("text is not null").select("line", "leaf", F.lit(0).alias("docs"), "text")
    second = written(parsed(begun, F.lit(0)), "leaf-templates")
    final = second.where("text is not null").select(F.col("template").alias("_t"), F.col("text").alias("_text"))
    # words of the template, and those that are constant
    size = F.size(F.split("_text", " "))
    constant = size - F.size(F.filter(F.split("_text", " "), lambda w: w == ANY))
    least = F.when((size >= LONG) & (constant >= STEADY * size), min(FEW, min_docs)).otherwise(min_docs)
    telling = final.where(2 * constant >= size).select("_t", least.alias("least"))
    return first.select("line", F.col("template").alias("_c")).join(
        second.select(F.col("line").alias("_c"), F.col("template").alias("_t")), "_c").join(telling, "_t").select(
        "line", F.col("_t").alias("template"), "least")


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10) -> DataFrame:
    """``docs`` with recurring lines but the first taken out of the text, and the numbers ``_lines`` and ``_dropped`` (long)."""
    found = written(occurrences(docs, id_col, text_col), "occurrences")
    known = templates(docs, found, id_col, text_col, min_docs)
    hits = written(found.join(known, "line").select("_id", "_doc", "at", "template", "least"), "template-lines")
    # unmasked short lines are templates of their own
    alike = found.where("long or masked").select("_id", "_doc", "at", F.col("same").alias("template"),
                                                 F.when(F.col("long"), min(PAIR, min_docs)).otherwise(min_docs).alias("least"))
    drops = repeats(hits).unionByName(repeats(alike))
    drops = written(drops.groupBy("_doc").agg(F.collect_set("at").alias("_places")), "dropped-places")
    # documents that lose nothing stay where they are, the others meet their places; no task holds two kinds of Python workers
    rows = docs.withColumn("_doc", _row(id_col, text_col))
    may_lose = held(rows, hashed_field(drops, F.col("_doc")), F.col("_doc"))
    text = F.col(text_col).cast("string")
    lines = F.when(text != "", F.size(F.split(text, "\n", -1))).otherwise(0).cast("long")
    same = rows.where(~may_lose).select(*docs.columns, lines.alias("_lines"), F.lit(0).cast("long").alias("_dropped"))
    some = rows.where(may_lose).join(drops.hint("merge"), "_doc", "left").select(*docs.columns, "_places")
    return edited(some, text_col).unionByName(same)


def repeats(hits: DataFrame) -> DataFrame:
    """``_doc`` and ``at`` of all lines but the first of each ``template`` in ``least`` documents or more."""
    spread = hits.groupBy("template", "_doc").agg(F.min(F.struct("_id", "_doc", "at")).alias("first"), F.first("least").alias("_least")).groupBy(
        "template").agg(F.min("first").alias("first"), F.first("_least").alias("_least"), F.count(F.lit(1)).alias("docs"))
    spread = spread.where(F.col("docs") >= F.col("_least"))
    return hits.join(spread, "template").where(~((F.col("_doc") == F.col("first._doc")) & (F.col("at") == F.col("first.at")))).select("_doc", "at")


def edited(docs: DataFrame, text_col: str) -> DataFrame:
    """Take the lines at ``_places`` out of the text."""
    columns = [c for c in docs.columns if c != "_places"]
    schema = StructType([*[docs.schema[c] for c in columns], StructField("_lines", LongType()), StructField("_dropped", LongType())])
    at = columns.index(text_col)
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, places in plain_rows([batch.select([text_col, "_places"])]):
                parts = text.split("\n") if text else []
                gone = set(places or ())
                kept = [p for i, p in enumerate(parts) if i not in gone] if gone else parts
                texts.append("\n".join(kept) if gone else text)
                lines.append(len(parts)), dropped.append(len(parts) - len(kept))
            arrays = [batch.column(c) for c in columns]
            arrays[at] = pa.array(texts, arrays[at].type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                                             names=schema.names)

    return docs.select(*columns, "_places").mapInArrow(run, schema)
