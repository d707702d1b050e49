"""Repeatable splits, class weights and stable samples, all by a hash of the row key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sized
from .ordering import running_before


def key_digest(keys: Sequence[str], salt: str = "") -> Column:
    """md5 of the key columns; the same in any partition layout and in other engines."""
    return F.md5(F.concat_ws("-", F.lit(salt), *[F.col(k).cast("string") for k in keys]))


def hash_bucket(keys: Sequence[str], buckets: int, salt: str = "") -> Column:
    return F.pmod(F.conv(F.substring(key_digest(keys, salt), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def split_name(keys: Sequence[str], shares: dict[str, int], salt: str = "") -> Column:
    """Name of the part each row belongs to; ``shares`` are whole numbers such as 7, 2, 1.

    The bucket does not depend on the label, so each label is split in the same expected ratio.
    """
    slots = [name for name, share in shares.items() for _ in range(share)]
    return F.get(F.array(*[F.lit(name) for name in slots]), hash_bucket(keys, len(slots), salt).cast("int"))


def hash_split(df: DataFrame, keys: Sequence[str], shares: dict[str, int], salt: str = "") -> dict[str, DataFrame]:
    """Disjoint, exhaustive parts of ``df``, each a filter. Duplicate keys stay together."""
    part = split_name(keys, shares, salt)
    return {name: df.filter(part == name) for name in shares}


def quota_bounds(rows: Column, shares: dict[str, int]) -> dict[str, Column]:
    """For each part, how many of ``rows`` rows belong to it and the parts before: whole numbers by the largest remainder, ties to the
    part named first."""
    total = sum(shares.values())
    even = {name: F.floor(rows * share / total).cast("long") for name, share in shares.items()}
    rest = {name: (rows * share) % total for name, share in shares.items()}
    over = rows - sum(even.values(), F.lit(0))
    bounds, upto = {}, F.lit(0).cast("long")
    names = list(shares)
    for i, name in enumerate(names):
        ahead = [(rest[o] >= rest[name]) if j < i else (rest[o] > rest[name]) for j, o in enumerate(names) if j != i]
        place = sum((a.cast("int") for a in ahead), F.lit(0))
        upto = upto + even[name] + (place < over).cast("long")
        bounds[name] = upto
    return bounds


#: Leading hex digits of a digest: its bucket when cuts are sought, and its slot when rows meet the cuts.
BUCKET_DIGITS, SLOT_DIGITS = 3, 2


def label_and_digest(df: DataFrame, keys: Sequence[str], label: str, salt: str = "") -> DataFrame:
    return df.withColumns({"_label": F.to_json(F.struct(F.col(label).alias("l"))), "_digest": key_digest(keys, salt)})


def split_cuts(df: DataFrame, keys: Sequence[str], label: str, shares: dict[str, int], salt: str = "") -> DataFrame:
    """(_label, _cuts): per label the digests at which a part ends, in the order of ``shares``; null where the last key is in that part.

    Rows are counted per label and leading digits of the digest, merged inside the tasks. Only the digests of a bucket in which a part ends are
    put in order, at most one bucket per label and end; elsewhere the first digest of a bucket is all a cut can be.
    """
    rows = label_and_digest(df, keys, label, salt).select("_label", "_digest")
    rows = rows.withColumn("_bucket", F.substring("_digest", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("_label", "_bucket").agg(F.count("*").alias("_n"), F.min("_digest").alias("_digest"))
    placed = running_before(buckets, [F.col("_bucket")], {"_before": "_n"}, by=["_label"], totals={"_rows": "_n"})
    ends = list(quota_bounds(F.col("_rows"), shares).values())[:-1]
    inside = [(F.col("_before") < end) & (end < F.col("_before") + F.col("_n")) for end in ends]
    split = placed.where(reduce(or_, inside, F.lit(False))).select("_label", "_bucket", F.col("_before").alias("_start"), "_rows")
    split = rows.join(sized(split, "split-buckets"), ["_label", "_bucket"])
    split = split.groupBy("_label", "_bucket", "_digest", "_start", "_rows").agg(F.count("*").alias("_n"))
    split = running_before(split, [F.col("_digest")], {"_before": "_n"}, by=["_label", "_bucket"])
    points = placed.select("_label", "_rows", "_before", "_digest").unionByName(
        split.select("_label", "_rows", (F.col("_start") + F.col("_before")).alias("_before"), "_digest"))
    return points.groupBy("_label").agg(F.array(*[F.min(F.when(F.col("_before") >= end, F.col("_digest"))) for end in ends]).alias("_cuts"))


def exact_split(df: DataFrame, keys: Sequence[str], label: str, shares: dict[str, int], salt: str = "", name: str = "part") -> DataFrame:
    """``df`` with the part of each row: of each label exactly its quota of rows goes to each part.

    Rows are taken in the order of their key digest, so the split is repeatable in any layout. Rows with one key stay together, which is all that
    can keep a part from its quota. A null label is a label. The cuts are written first, so the planner knows how few they are and sends them to
    the rows; were there too many labels for that, rows of a label would meet them in as many places as there are slots.
    """
    slots = [F.lit(f"{i:0{SLOT_DIGITS}x}") for i in range(16 ** SLOT_DIGITS)]
    cuts = sized(split_cuts(df, keys, label, shares, salt), "cuts").withColumn("_slot", F.explode(F.array(*slots)))
    names = list(shares)
    tagged = label_and_digest(df, keys, label, salt).withColumn("_slot", F.substring("_digest", 1, SLOT_DIGITS))
    part = F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):
        cut = F.get("_cuts", F.lit(i))
        part = F.when(cut.isNull() | (F.col("_digest") < cut), names[i]).otherwise(part)
    return tagged.join(cuts, ["_label", "_slot"]).select(*df.columns, part.alias(name))


@dataclass(frozen=True)
class ClassWeights:
    """Balanced weights total / (2 * rows of the label), learnt on train and applied to any frame."""

    good: float
    bad: float

    @classmethod
    def fit(cls, train: DataFrame, label: str = "label") -> ClassWeights:
        row = class_weight_table(train, label).first()
        return cls(good=row["good_weight"], bad=row["bad_weight"])

    def transform(self, df: DataFrame, label: str = "label", name: str = "class_weight") -> DataFrame:
        return df.withColumn(name, F.when(F.col(label) == 1, F.lit(self.bad)).otherwise(F.lit(self.good)))


def class_weight_table(train: DataFrame, label: str = "label") -> DataFrame:
    """One row: label counts and the weight of each label; an absent label counts as one row."""
    counts = train.agg(
        F.count_if(F.col(label) == 0).alias("good_rows"), F.count_if(F.col(label) == 1).alias("bad_rows")
    )
    total = (F.col("good_rows") + F.col("bad_rows")).cast("double")
    return counts.select(
        "good_rows", "bad_rows",
        (total / (2.0 * F.greatest("good_rows", F.lit(1)))).alias("good_weight"),
        (total / (2.0 * F.greatest("bad_rows", F.lit(1)))).alias("bad_weight"),
    )


def stable_sample(df: DataFrame, keys: Sequence[str], n: int, salt: str = "") -> DataFrame:
    """The ``n`` rows with the smallest key digest: a repeatable random sample, planned as a per-task top-n."""
    return (
        df.withColumn("_digest", key_digest(keys, salt)).orderBy("_digest", *keys).limit(n).drop("_digest")
    )
