"""Text tables read by declared types: every field that cannot be converted is accounted for, the rows go to a quarantine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import quoted

#: Columns that a declared read adds: names of the fields that could not be converted, and the raw line of a record with too few or too many fields.
BAD_FIELDS, BAD_RECORD = "_bad_fields", "_bad_record"
RECORD = "(record)"


def read_csv_declared(
    spark: SparkSession, path: str, declared: Mapping[str, str], names: Sequence[str] | None = None, **options,
) -> DataFrame:
    """CSV with the ``declared`` types (column to SQL type) in one pass, without inference.

    Columns are found by their name in the header, or among ``names`` if the files have no header, in any order; undeclared ones stay text, absent ones are left out. A field that its type
    cannot hold becomes null and its name joins ``_bad_fields``. A record with too few or too many fields keeps its line in ``_bad_record`` and
    counts as one bad record; its fields are null. An empty field is a null, not a fault.
    """
    header = names is None
    names = spark.read.options(header=True, **options).csv(path).columns if header else names  # reads the header line only
    schema = ", ".join(f"{quoted(c)} string" for c in (*names, BAD_RECORD))
    raw = spark.read.options(header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_RECORD, columnPruning=False, **options)
    return convert(raw.schema(schema).csv(path), declared)


def convert(raw: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """Text columns to their declared types, with ``_bad_fields``. ``_bad_record`` is added as null where the source has none."""
    if BAD_RECORD not in raw.columns:
        raw = raw.withColumn(BAD_RECORD, F.lit(None).cast("string"))
    whole = F.col(BAD_RECORD).isNull()
    columns, faults = [], []
    for c in raw.columns:
        if c == BAD_RECORD:
            continue
        text = F.when(whole, F.col(quoted(c)))
        kind = declared.get(c, "string")
        value = text if kind == "string" else text.try_cast(kind)
        columns.append(value.alias(c))
        if kind != "string":
            faults.append(F.when(text.isNotNull() & value.isNull(), F.lit(c)))
    return raw.select(*columns, F.array_compact(F.array(*faults) if faults else F.array().cast("array<string>")).alias(BAD_FIELDS), BAD_RECORD)


def is_bad() -> Column:
    return F.col(BAD_RECORD).isNotNull() | (F.size(BAD_FIELDS) > 0)


def split_bad(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that hold what was declared, the quarantined ones with what is wrong with them)."""
    return read.filter(~is_bad()).drop(BAD_FIELDS, BAD_RECORD), read.filter(is_bad())


def field_accounts(read: DataFrame, declared: Mapping[str, str]) -> list[Column]:
    """Aggregates for one pass, also for ``Dataset.observe``: rows, bad records, bad rows and, per declared column, the values that are present and those
    that could not be converted. See ``account_rows``."""
    present = [c for c in declared if c in read.columns]
    return [
        F.count("*").alias("rows"), F.count(BAD_RECORD).alias("bad_records"), F.count_if(is_bad()).alias("bad_rows"),
        *[F.count(quoted(c)).alias(f"present_{i}") for i, c in enumerate(present)],
        *[F.count_if(F.array_contains(BAD_FIELDS, c)).alias(f"failed_{i}") for i, c in enumerate(present)],
    ]


def account_rows(read: DataFrame, declared: Mapping[str, str], facts: DataFrame) -> DataFrame:
    """(field, type, present, failed): a row per declared column, and one for records that could not be cut into fields. ``facts`` is the row of
    ``field_accounts``. Columns that the file lacks have null counts."""
    present = {c: i for i, c in enumerate(c for c in declared if c in read.columns)}
    unknown = F.lit(None).cast("long")
    cells = [F.struct(F.lit(RECORD).alias("field"), F.lit("csv").alias("type"), (F.col("rows") - F.col("bad_records")).alias("present"),
                      F.col("bad_records").alias("failed"))]
    for c, kind in declared.items():
        i = present.get(c)
        cells.append(F.struct(F.lit(c).alias("field"), F.lit(kind).alias("type"), (unknown if i is None else F.col(f"present_{i}")).alias("present"),
                              (unknown if i is None else F.col(f"failed_{i}")).alias("failed")))
    return facts.select(F.inline(F.array(*cells)))


def account(read: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """``account_rows`` by a pass of its own."""
    return account_rows(read, declared, read.agg(*field_accounts(read, declared)))
