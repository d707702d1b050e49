import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from outcomelens.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back"]


def by_findall(doc_id, text):
    """One row of the result, unit by unit."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    low, high = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form, output = (("spm", "<S>" + suffix + "<P>" + prefix + "<M>" + middle) if h[3] % 100 < 80
                    else ("psm", "<P>" + prefix + "<S>" + suffix + "<M>" + middle))
    return doc_id, n, form, len(prefix), len(middle), output, text


def made(df):
    return fim.transform(df, "doc_id", "text").withColumn("back", fim.restored()).select(COLUMNS)


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85  aé😀<PSM>", max_size=60), st.integers(1, 9))
def test_ends_in_blocks(text, block):
    ends = [m.end() for m in UNIT.finditer(text)]
    assert fim.unit_ends(text) == ends
    assert fim.unit_ends(text, block=block) == ends


def test_against_units_one_by_one(spark, rows):
    texts = [None, "", " ", "a", " a ", "a  b\n\nc\t", "<P> x y z", "x <S y> <M z", "x<", "<<S", "a<M>b", "é 😀  ü x", "\n" * 9, "a\0b c", "one two three four"]
    data = [(i, t) for i in range(40) for t in texts] + [(None, "no id here"), (None, None), (3, "a"), (-5, "minus five is an id")]
    got = rows(made(spark.createDataFrame(data, "doc_id long, text string").repartition(3)))
    assert got == sorted((by_findall(*r) for r in data), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_long_texts(spark):
    data = [(i, t) for i in range(4, 8) for t in ("w " * 1_200_000 + "end", "x" * 2_500_000, " " * 1_500_000 + "y")]
    got = {tuple(r) for r in made(spark.createDataFrame(data, "doc_id long, text string")).withColumns(
        {"output": F.md5("output"), "back": F.md5("back")}).collect()}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert got == {(*r[:5], md5(r[5]), md5(r[6])) for r in (by_findall(*x) for x in data)}


def test_empty_table_and_clashing_names(spark, rows, clashing):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    more = clashing(df).withColumns({c: F.lit("x") for c in ("_digest", "_text", "form", "output", "prefix_chars")})
    assert rows(made(more)) == rows(made(df))
    assert made(df.limit(0)).count() == 0


def test_shares(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h").alias("text"))
    counts = {r["form"]: r["count"] for r in made(df).groupBy("form").count().collect()}
    assert abs(counts["plain"] - 1000) < 120 and abs(counts["spm"] - 800) < 120 and abs(counts["psm"] - 200) < 80
