"""URL rules by a sort-merge range join.

A rule is a host and a path; it fits its host and all hosts below it where the url's path starts with its path. The rule with the longest host wins,
then the one with the longest path.

The host's labels in reverse (``blog.example.net`` as ``net,example,blog,``) make "below this host" a prefix, hence an interval of sorted keys:
intervals of hosts are nested or apart. Urls and rules are sorted together by key; a sweep keeps the stack of the
hosts whose intervals are open, with the paths of each. A url asks the stack from the top.

The sorted order is cut into ranges, which are the tasks. The cuts come from a sample of the url keys bounded by ``SAMPLE``; it sets only where
ranges end, not what is found. A rule goes to every range that its interval meets, so that each range starts with the stack it needs: that is
the depth of nesting per range. Cuts are (host key, url id hash), so one host with a third of all urls is spread over many ranges.

Cases: a null url, or one without ``://``, has an empty host and path and no rule but those with an empty host and path; a null rule host or path
is empty; of rules alike in host and path the least verdict by name counts (``allow`` before ``block``); repeated rows are judged alike; empty
tables are fine; extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from .arrow import id_field, map_rows

SAMPLE = 20_000
RANGES_PER_PARTITION = 2
#: The cuts stand in the plan, so there are at most so many; rows stream through a range, which may be of any size.
MOST_RANGES = 2_000

# Letters that host names fold.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """Labels in reverse, each ended by NUL, which sorts before all that a label may hold; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\0"), F.lit("\0")))


def judge(urls: DataFrame, rules: DataFrame, id_col: str, url_col: str, default: str = "allow") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` (host and path, null without one) and ``verdict`` of every url.

    ``rules`` has ``host``, ``path`` and ``verdict``.
    """
    spark = urls.sparkSession
    url = F.col(url_col).cast("string")
    placed = urls.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path")).withColumns({
        "_key": key_of(F.col("host")), "_salt": F.xxhash64(F.col(id_col))})
    cuts = cut_points(placed, min(MOST_RANGES, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    plain = rules.select(F.translate(F.coalesce(F.col("host").cast("string"), F.lit("")), UPPER, LOWER).alias("host"),
                         F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), "verdict")
    plain = plain.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("_key", key_of(F.col("host")))
    # a host's interval runs from its key to the key with a greater last character
    last = F.concat(F.substring("_key", F.lit(1), F.length("_key") - 1), F.lit("\1"))
    first_range, last_range = range_of(cuts, F.col("_key"), F.lit(-(1 << 63))), range_of(cuts, last, F.lit(-(1 << 63)))
    spread = plain.withColumn("_range", F.explode(F.sequence(first_range, F.when(
        F.col("_key") == "", range_of(cuts, F.col("_key"), F.lit((1 << 63) - 1))).otherwise(last_range))))
    both = placed.select("_key", F.lit(1).alias("_kind"), F.col("_salt"), F.col(id_col), "host", "path",
                         F.lit(None).cast("string").alias("_verdict"),
                         range_of(cuts, F.col("_key"), F.col("_salt")).alias("_range"))
    both = both.unionByName(spread.select(
        "_key", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_salt"),
        F.lit(None).cast(urls.schema[id_col].dataType).alias(id_col), "host", "path", F.col("verdict").alias("_verdict"), "_range"))
    ordered = both.repartition("_range").sortWithinPartitions("_range", "_key", "_kind", "path").select(
        "_range", "_key", "_kind", id_col, "host", "path", "_verdict")

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        return sweep(rows, default)

    fields = [id_field(urls, id_col)] + [StructField(c, StringType()) for c in ("host", "path", "rule", "verdict")]
    return map_rows(ordered, fields, run)


def cut_points(placed: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Up to ``ranges - 1`` (key, salt) pairs that cut a sample of about ``SAMPLE`` urls evenly."""
    rows = placed.count()
    share = min(1.0, SAMPLE / rows) if rows else 1.0
    sample = sorted((r[0].encode(), r[1]) for r in placed.select("_key", "_salt").sample(share, 17).collect())
    picked = {sample[i * len(sample) // ranges] for i in range(1, ranges)} if sample else set()
    return [(k.decode(), s) for k, s in sorted(picked)]


def range_of(cuts: list[tuple[str, int]], key: Column, salt: Column) -> Column:
    """Number of cuts at or before (key, salt)."""
    if not cuts:
        return F.lit(0)
    points = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).cast("long").alias("s")) for k, s in cuts])
    here = F.struct(key.alias("k"), salt.cast("long").alias("s"))
    return F.size(F.filter(points, lambda p: p <= here))


def sweep(rows: Iterable[tuple], default: str) -> Iterator[tuple]:
    """Verdicts of urls (kind 1) among rules (kind 0), sorted by range, key, kind and, for rules, path."""
    stack: list[tuple[str, str, list[tuple[str, str]]]] = []  # key, host, (path, verdict) in path order
    current = None
    for at, key, kind, row_id, host, path, verdict in rows:
        if at != current:
            current, stack = at, []
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if kind == 0:
            if not stack or stack[-1][0] != key:
                stack.append((key, host, []))
            stack[-1][2].append((path, verdict))
            continue
        rule, found = None, default
        for _, rule_host, paths in reversed(stack):
            fitting = [p for p in paths if path.startswith(p[0])]
            if fitting:
                longest, found = fitting[-1]  # prefixes of one path sort by length
                rule = rule_host + longest
                break
        yield row_id, host, path, rule, found
