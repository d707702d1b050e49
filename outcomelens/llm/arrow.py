"""Helpers for operators that run on Arrow batches inside Spark tasks."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

ROWS_OUT = 2_000
BYTES_OUT = 16 << 20


def vocabulary_path(name: str) -> str:
    """Place of a vocabulary file on this machine: a path as it is, a bare name from the public tokenizer package."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their workers import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and the text as UTF-8 bytes (null: empty); no other column reaches the Python side."""
    return df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))


def id_field(df: DataFrame, id_col: str) -> StructField:
    return StructField(id_col, df.schema[id_col].dataType, True)


def map_rows(df: DataFrame, fields: list[StructField], per_row: Callable[[Iterable[tuple]], Iterator[tuple]],
             size_of: Callable[[tuple], int] = lambda row: 0) -> DataFrame:
    """``mapInArrow`` with rows as tuples; a batch goes out after ``ROWS_OUT`` rows or ``BYTES_OUT`` bytes by ``size_of``."""
    schema = StructType(fields)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_batches(per_row(plain_rows(batches)), schema, size_of)

    return df.mapInArrow(run, schema)


def plain_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(part.column(i).to_pylist() for i in range(part.num_columns)))


def arrow_batches(rows: Iterator[tuple], schema: StructType, size_of) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if len(held) >= ROWS_OUT or size >= BYTES_OUT:
            yield _batch(held, target)
            held, size = [], 0
    if held:
        yield _batch(held, target)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target)
