import random

import pytest

from outcomelens.llm import url_rules

URLS, RULES = "page_id long, url string", "host string, path string, verdict string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]


def brute(urls, rules, default="allow"):
    out = {}
    for key, url in urls:
        host, path = parts(url)
        fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, default))
        out[key] = (host, path, best[2], best[3])
    return out


@pytest.fixture(scope="module")
def urls():
    rnd = random.Random(4)
    hosts = ["example.net", "a.example.net", "b.a.example.net", "xexample.net", "net", "org", "q.org", "example.com", "EXAMPLE.Net", "", "net.", "a..b", "x:80"]
    paths = ["", "/", "/en", "/en/", "/en/a/b", "/de/x", "/fr/?q=/en/", "/%20", "?x", "#y", "/en/#z", "/ü/"]
    rows = [(i, f"{rnd.choice(['http', 'https', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}") for i in range(900)]
    return rows + [(2000, None), (2001, "no scheme"), (2002, ""), (2003, "a\n://net/x"), (2004, "http://x/y://net/")] + [
        (3000 + i, "http://hot.example.net/en/same") for i in range(900)]


HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.net", "", "block"),
              ("example.net", "/en/a", "block"), ("b.a.example.net", "/de", "allow"), ("q.org", "/", "block"), ("net.", "/", "block"), ("b", "/", "block")]


def judged(spark, urls, rules):
    df = url_rules.judge(spark.createDataFrame(urls, URLS), spark.createDataFrame(rules, RULES), "page_id", "url")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_against_brute_force(spark, urls):
    assert judged(spark, urls, HOST_RULES) == brute(urls, HOST_RULES)


def test_many_nested_rules(spark, urls):
    rnd = random.Random(8)
    labels = ["example", "net", "a", "b", "org", "q"]
    rules = {(".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4))), rnd.choice(["", "/", "/en", "/en/", "/de"])): rnd.choice(["allow", "block"]) for _ in range(300)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    assert judged(spark, urls, rules) == brute(urls, rules)


def test_ranges_and_cuts_do_not_matter(spark, urls, monkeypatch):
    for per_partition, sample in ((1, 5), (60, 20_000)):
        monkeypatch.setattr(url_rules, "RANGES_PER_PARTITION", per_partition)
        monkeypatch.setattr(url_rules, "SAMPLE", sample)
        assert judged(spark, urls, HOST_RULES) == brute(urls, HOST_RULES)


def test_a_hot_host_is_spread(spark):
    df = spark.createDataFrame([(i, "http://hot.example.net/en/same") for i in range(5000)], URLS)
    placed = df.select(url_rules.key_of(url_rules.host_of(df.url)).alias("_key"), url_rules.F.xxhash64("page_id").alias("_salt"))
    cuts = url_rules.cut_points(placed, 8)
    ranges = placed.withColumn("at", url_rules.range_of(cuts, placed["_key"], placed["_salt"]))
    sizes = ranges.groupBy("at").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 900


def test_nulls_repeated_rows_extra_columns_and_empty_tables(spark, clashing):
    urls = clashing(spark.createDataFrame([(None, None), (1, "http://net/"), (1, "http://net/")], URLS))
    rules = spark.createDataFrame([("net", "/", "block"), ("net", "/", "allow"), (None, None, "block"), ("NET", "/", "block")], RULES)
    got = sorted((repr(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(urls, rules, "page_id", "url").collect())
    assert got == [("1", "net", "/", "net/", "allow"), ("1", "net", "/", "net/", "allow"), ("None", "", "", "", "block")]
    assert {r.verdict for r in url_rules.judge(urls, rules.limit(0), "page_id", "url").collect()} == {"allow"}
    assert url_rules.judge(urls.limit(0), rules, "page_id", "url").collect() == []
