import gzip
import hashlib

import pytest

from outcomelens.llm import warc
from outcomelens.session import scratch_path

PAGES = "page_id long, url string, html string"
BIG = "<p>same body</p>" * 20
ROWS = [(5, "http://a/1", BIG), (3, "http://a/2", BIG), (9, "http://b", BIG), (1, "http://c", "small"), (2, None, "small"), (4, "u\r\nEvil: x", None),
        (6, "http://d", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.1\r\n" + "é中😀" * 40), (7, "", ""), (8, "http://e", "\r\n\r\n" * 50),
        (11, "http://f", BIG + "!"), (10, "http://g", BIG + "!")]


def expected(rows, least=100):
    first = {}
    for key, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least:
            first[body] = min(first.get(body, key), key)
    out = {}
    for key, _, html in rows:
        body = (html or "").encode()
        origin = first.get(body, key)
        out[key] = (len(body), hashlib.sha256(body).hexdigest(), "response" if origin == key else "revisit", None if origin == key else origin)
    return out


@pytest.fixture(scope="module")
def archives(spark, clashing):
    place = scratch_path(spark, "warc-test")
    warc.write(clashing(spark.createDataFrame(ROWS, PAGES)).repartition(3), place)
    return place


def test_write_read_resolve(spark, archives):
    rows = warc.resolve(warc.read(spark, archives)).collect()
    got = {int(r.record_id): (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in rows}
    assert len(rows) == len(ROWS) and got == expected(ROWS)
    urls = {int(r.record_id): r.url for r in rows}
    assert urls[5] == "http://a/1" and urls[2] is None and urls[7] is None and urls[4] == "u%0D%0AEvil: x"


def test_payloads_come_back_and_revisits_hold_none(spark, archives):
    rows = {int(r.record_id): r for r in warc.read(spark, archives, payloads=True).collect()}
    for key, _, html in ROWS:
        revisit = expected(ROWS)[key][2] == "revisit"
        assert bytes(rows[key].content).decode() == ("" if revisit else html or "")


def test_bytes_of_a_record(spark):
    (row,) = warc.render(spark.createDataFrame([(1, "http://x/", "body")], PAGES), "page_id", "url", "html", 100, "2024-01-01T00:00:00Z").collect()
    digest = hashlib.sha256(b"body").hexdigest()
    assert row.value == ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:1>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"
                         f"WARC-Target-URI: http://x/\r\nWARC-Payload-Digest: sha256:{digest}\r\n"
                         "Content-Type: text/html; charset=utf-8\r\nContent-Length: 4\r\n\r\nbody")


def record(body, **head):
    lines = ["WARC/1.1", *[f"{k.replace('_', '-')}: {v}" for k, v in head.items()], f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_gzip_members_are_read():
    two = [record(b"a", WARC_Type="response"), record(b"\r\n\r\nb", WARC_Type="resource")]
    for archive in (b"".join(two), gzip.compress(b"".join(two)), b"".join(map(gzip.compress, two))):
        assert [(h["warc-type"], c) for h, c in warc.records(archive)] == [("response", b"a"), ("resource", b"\r\n\r\nb")]


@pytest.mark.parametrize("bad", [record(b"abc")[:-6], b"junk\r\n\r\n", record(b"abc").replace(b"Length: 3", b"Length: 2"),
                                 gzip.compress(record(b"abc"))[:-9], b"WARC/1.1\r\nno colon\r\n\r\n"])
def test_damage_is_an_error(bad):
    with pytest.raises(ValueError):
        list(warc.records(bad))


def test_a_revisit_without_its_response_is_an_error(spark):
    schema = "record_id string, record_type string, url string, refers_to string, stated_digest string, digest string, n_bytes long"
    lost = spark.createDataFrame([("1", "revisit", None, "9", "ab", "cd", 0)], schema)
    with pytest.raises(Exception, match="no response for revisit 1"):
        warc.resolve(lost).collect()


def test_null_ids_repeated_rows_and_empty_table(spark):
    place = scratch_path(spark, "warc-test")
    warc.write(spark.createDataFrame([(None, "u", BIG), (4, "u", BIG), (4, "u", BIG)], PAGES), place)
    rows = warc.resolve(warc.read(spark, place)).collect()
    assert sorted((str(r.record_id), r.record_type, str(r.refers_to)) for r in rows) == [
        ("4", "revisit", "None"), ("4", "revisit", "None"), ("None", "response", "None")]
    place = scratch_path(spark, "warc-test")
    warc.write(spark.createDataFrame([], PAGES), place)
    assert warc.resolve(warc.read(spark, place)).collect() == []
