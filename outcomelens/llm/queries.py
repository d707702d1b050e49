"""The registered queries ``opN_<name>`` over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (byte_bpe, chat, collocations, decontamination, fertility, fill_in_middle, jaccard, line_templates, packing,
               pseudonyms, token_prefix, url_rules, warc)

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
TOKEN_LIMIT = 4096

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if oracle:
            ORACLES[build.__name__] = oracle
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Conversation -7 is added to the table: its texts hold the template's own marks and an escape.
CONFLICT = "\\### Assistant: </turn> ok"


@query(f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{CONFLICT}' UNION ALL SELECT -7, 1, 'assistant', '{CONFLICT}'),
e AS (
    SELECT *, CASE WHEN contains(body, chr(92)) OR contains(body, '### ') OR contains(body, '</turn>') THEN
        length(body) + (length(body) - length(replace(body, chr(92), '')))
        + (length(body) - length(replace(body, '</turn>', ''))) // 7 + (length(body) - length(replace(body, '### ', ''))) // 4
        ELSE length(body) END AS body_chars,
    CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role) ELSE 1 + length(role) END AS label_chars FROM c)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(body) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(body, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(4 + label_chars + 2 + body_chars + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op1_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONFLICT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    text = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chat.format_conversations(rows).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(text, ""), 256).alias("turns_sha256"),
        F.length(chat.trained_text()).cast("long").alias("loss_chars"), F.sha2(chat.trained_text(), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


#: Key of the query's pseudonyms; a real run takes its own, kept secret.
PII_KEY = "pseudonym-key-of-the-test-tables"


@query()
def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", PII_KEY)


@query()
def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring(docs).withColumnsRenamed({"_lines": "n_lines", "_dropped": "n_dropped"})


@query()
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_token_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_prefix.prefix_counts(table(spark, sf_dir, "documents"), "doc_id", "text", PIECE_MODEL)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query(r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
    FROM w),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
    SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
    WHERE 100 * common >= 80 * (len(x.shingles) + len(y.shingles) - common)),
r AS (
    WITH RECURSIVE reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
    SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id FROM s JOIN r ON r.a = doc_id""")
def op6_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


@query()
def op7_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), "doc_id", "text", BYTE_RANKS)


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
    CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest""")
def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, parsed = scratch_path(spark, "warc"), scratch_path(spark, "warc-headers")
    warc.write(table(spark, sf_dir, "pages"), archives)
    warc.read(spark, archives).write.parquet(parsed)
    return warc.resolve(spark.read.parquet(parsed)).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


#: Rules of the query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query(f"""
WITH u AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
m AS (
    SELECT page_id, max_by(struct_pack(rule := rule_host || rule_path, verdict := rule_verdict),
        length(rule_host) * 100000 + length(rule_path)) AS best
    FROM h JOIN r ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)""")
def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules, "page_id", "url")


@query()
def op10_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"), "doc_id", "text", PIECE_MODEL, "lang")


@query(r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d),
g AS (
    SELECT lang, 1 AS size, unnest(words) AS phrase FROM w
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(words)), lambda i: array_to_string(words[i:i + 1], ' '))) FROM w
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) FROM w),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1 AND f >= 10),
k AS (
    SELECT *, array_to_string(words[1:cut], ' ') AS head, array_to_string(words[cut + 1:], ' ') AS tail
    FROM c JOIN (VALUES (1), (2)) AS v(cut) ON cut < size),
s AS (
    SELECT k.*, x.f AS l, y.f AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS score,
    FROM k JOIN f x ON x.lang = k.lang AND x.phrase = head JOIN f y ON y.lang = k.lang AND y.phrase = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
    SELECT lang, array_to_string(words[i:i + 1], ' ') AS phrase, max(a) AS around
    FROM c, (VALUES (1), (2)) AS v(i) WHERE size = 3 GROUP BY ALL),
t AS (
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
    FROM b LEFT JOIN longer USING (lang, phrase) WHERE around IS NULL OR 100 * around < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM t JOIN n USING (lang) WHERE rank <= 2000""")
def op11_toivonen_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), "text", "lang", min_count=10, top=2000)


@query()
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", "byte_bpe_50k", end_id=2, capacity=1024)


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS digest FROM documents),
u AS (
    SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
        list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(digest, i, 8) AS BIGINT)) AS h FROM d),
f AS (
    SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50
        THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
        least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS low,
        greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS high FROM u),
p AS (
    SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
        array_to_string(units[high + 1:], '') AS suffix FROM f)
SELECT doc_id, CAST(len(units) AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"), "doc_id", "text", seed=42, rate=50, spm=80)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"))
