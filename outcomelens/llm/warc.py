"""WARC archives with revisit records: write, read back, resolve.

Writing: each row's payload is digested where it lies. Only headers (id, digest, length, url) are shuffled by digest: the least id per digest of an
eligible payload keeps its payload as a ``response`` record, the others become ``revisit`` records that name it. A digest
that a third of all pages share is one row after the map-side minimum, and the join back to the headers is a plain sort-merge
join whose large partitions Spark splits.

Payloads stay where they lie: revisit records need none and are written from the headers. A bit field of the revisits' ids, of fixed size, tells which
pages cannot be among them; these are written as they are read. What the field lets through in vain is known from the headers, and only these
payloads are joined. (With very many revisits the field fills up and more payloads take that way; the archives are the same.)

Records go out through Spark's text writer with the record separator as its line end, so any Hadoop file system will do and lost executors
are replaced by Spark's commit protocol. Archives are uncompressed, hold at most ``RECORDS_PER_FILE`` records and about a
partition's bytes; a record is a row.

Reading: archives come as binary files, cut by Content-Length, never by what payloads contain. Plain archives and gzip archives with one
member per file or per record are read. A file must fit memory twice, which is why archives stay near a partition's size.
A revisit gets the length and digest of its original by a join on the record it refers to, headers only; an unresolved
revisit raises.

Cases: null payload and null url are empty (no WARC-Target-URI line then); line ends inside a url are percent-encoded; rows with the same id and payload are all kept, as responses if theirs is the least id; a null id sorts first;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from .arrow import map_rows
from .components import written
from .fields import BITS, hashed_field, held

# Fixed values of the format.
VERSION, SEPARATOR = "WARC/1.1", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS_PER_FILE = 50_000
ID_PREFIX = "urn:record:"


def record_id(column: str) -> Column:
    return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(F.col(column).cast("string"), F.lit("null")), F.lit(">"))


def headers(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """``_id``, ``_url``, ``_digest``, ``_bytes``, ``_revisit`` and ``_original`` of every row; payloads stay behind."""
    rows = digested(pages, id_col, url_col, payload_col).select("_id", "_url", "_digest", F.octet_length("_payload").cast("long").alias("_bytes"))
    large = F.col("_bytes") >= min_bytes
    # min() leaves nulls out: a null id counts as the least one, by a marker
    least = rows.where(large).groupBy("_digest").agg(F.min(F.struct("_id")).alias("_least"), F.count(F.lit(1)).alias("_n"))
    joined = rows.join(least.where("_n > 1").drop("_n"), "_digest", "left")
    revisit = large & F.col("_least").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_least._id"))
    return joined.select("_id", "_url", "_digest", "_bytes", revisit.alias("_revisit"), F.when(revisit, F.col("_least._id")).alias("_original"))


def digested(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``_id``, ``_url``, ``_payload``, ``_digest`` of every row."""
    url = F.replace(F.replace(F.col(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col).alias("_id"), url.alias("_url"), payload.alias("_payload")).withColumn("_digest", F.sha2("_payload", 256))


def rendered(rows: DataFrame, revisits: bool, date: str) -> DataFrame:
    """One text per row: its record without the separator that ends it."""
    lines = [
        F.lit(f"{VERSION}\r\nWARC-Type: {'revisit' if revisits else 'response'}"),
        F.concat(F.lit("WARC-Record-ID: "), record_id("_id")), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.nullif(F.col("_url"), F.lit(""))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("_digest")),
        *([F.concat(F.lit("WARC-Refers-To: "), record_id("_original")), F.lit(f"WARC-Profile: {PROFILE}")] if revisits else []),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.lit("0") if revisits else F.octet_length("_payload").cast("string")),
    ]
    head = F.concat_ws("\r\n", *lines)  # leaves null lines out
    return rows.select(F.concat(head, F.lit(SEPARATOR), *([] if revisits else [F.col("_payload")])).alias("value"))


def render(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int, date: str, bits: int = BITS) -> DataFrame:
    """One text per row of ``pages``: its record without the separator that ends it."""
    name = F.xxhash64("_id")
    heads = written(headers(pages, id_col, url_col, payload_col, min_bytes), "warc-headers")
    revisits = heads.where("_revisit")
    field = hashed_field(revisits, name, bits)
    rows = digested(pages, id_col, url_col, payload_col)
    straight = rows.where(~held(rows, field, name))
    texts = rendered(straight, False, date).unionByName(rendered(revisits, True, date))
    # let through in vain: responses whose bit is set by another id, or that share their id with a revisit
    vain = written(heads.where(~F.col("_revisit") & held(heads, field, name)).select("_id", "_digest").distinct(), "warc-vain")
    if vain.isEmpty():
        return texts
    some = rows.where(held(rows, hashed_field(vain, name, bits), name))
    same = some["_id"].eqNullSafe(vain["_id"]) & (some["_digest"] == vain["_digest"])
    return texts.unionByName(rendered(some.join(vain, same, "left_semi"), False, date))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``pages`` to new archives in folder ``path``. Payloads under ``min_bytes`` bytes are never revisits."""
    render(pages, id_col, url_col, payload_col, min_bytes, date).write.option("lineSep", SEPARATOR).option(
        "maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and content of each record of an archive. Raises ValueError where it is cut short or malformed."""
    if archive[:2] == b"\x1f\x8b":
        try:
            archive = gzip.decompress(archive)
        except (EOFError, zlib.error) as error:
            raise ValueError(f"damaged gzip archive: {error}") from error
    at = 0
    while at < len(archive):
        end = archive.find(SEPARATOR.encode(), at)
        if end < 0 or not archive.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        found: dict[str, str] = {}
        for line in archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"no header line: {line[:80]!r}")
            found[name.strip().lower()] = value.strip()
        start = end + 4
        stop = start + int(found.get("content-length", "-1"))
        if stop < start or archive[stop:stop + 4] != SEPARATOR.encode():
            raise ValueError(f"record at byte {at} does not end where its Content-Length says")
        yield found, archive[start:stop]
        at = stop + 4


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record in the archives under ``path``: ``record_id``, ``record_type``, ``url``, ``refers_to``,
    ``stated_digest``, ``digest`` (SHA-256 of the content), ``n_bytes``, and with ``payloads`` the content. A content that does not have
    its stated digest raises, except in revisits."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for (archive,) in rows:
            for head, content in records(archive):
                stated = head.get("warc-payload-digest", "").removeprefix("sha256:")
                digest = hashlib.sha256(content).hexdigest()
                kind = head.get("warc-type", "")
                if kind != "revisit" and stated and stated != digest:
                    raise ValueError(f"{head.get('warc-record-id')}: content has digest {digest}, header says {stated}")
                yield (bare(head.get("warc-record-id")), kind, head.get("warc-target-uri"), bare(head.get("warc-refers-to")),
                       stated, digest, len(content), *([content] if payloads else []))

    fields = [StructField(c, StringType()) for c in ("record_id", "record_type", "url", "refers_to", "stated_digest", "digest")]
    fields += [StructField("n_bytes", LongType())] + ([StructField("content", BinaryType())] if payloads else [])
    return map_rows(files, fields, run, lambda row: row[6] if payloads else 0)


def bare(identifier: str | None) -> str | None:
    """The id inside ``<urn:record:id>``; other identifiers without their brackets; ``null`` is null."""
    if identifier is None:
        return None
    identifier = identifier.strip("<>").removeprefix(ID_PREFIX)
    return None if identifier == "null" else identifier


def resolve(found: DataFrame) -> DataFrame:
    """Records as read, with ``payload_bytes`` and ``payload_digest`` of the full payload: a revisit's are those of the response it
    refers to, joined by record and digest."""
    responses = found.where("record_type = 'response'").groupBy(
        F.col("record_id").alias("_of"), F.col("digest").alias("_digest")).agg(F.first("n_bytes").alias("_bytes"))
    revisits = found.where("record_type = 'revisit'")
    same = F.col("refers_to").eqNullSafe(F.col("_of")) & (F.col("stated_digest") == F.col("_digest"))
    lost = F.raise_error(F.concat(F.lit("no response for revisit "), F.coalesce(F.col("record_id"), F.lit("null"))))
    resolved = revisits.join(responses, same, "left").withColumns({
        "payload_bytes": F.coalesce("_bytes", lost.cast("long")), "payload_digest": F.col("stated_digest")})
    kept = found.where("record_type <> 'revisit'").withColumns({"payload_bytes": F.col("n_bytes"), "payload_digest": F.col("digest")})
    columns = [*found.columns, "payload_bytes", "payload_digest"]
    return kept.select(columns).unionByName(resolved.select(columns))
