import collections
import math
import re

import public_tokenizers
import pytest
import sentencepiece

from outcomelens.llm import fertility
from outcomelens.llm.queries import PIECE_MODEL

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    words = re.findall(WORD, text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i:i + 3])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def brute_measures(text):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_MODEL))
    words = re.findall(WORD, text)
    ids = [i for w in words for i in model.encode(w)]
    if not ids:
        return None, None, None
    n, times = len(ids), collections.Counter(ids)
    entropy = -sum(c / n * math.log2(c / n) for c in times.values())
    return (sum(map(len, words)) / n, sum(map(model.is_byte, ids)) / n, entropy / math.log2(n) if n > 1 else 1.0)


TEXTS = ["", None, " \n\t ", "one", "a b c a b c", "x\n\nx\n x\nx y z\x1cw", "a a a a", "#*$ %&|<> é中😀", "the end\r\nthe end\r\nthe end", "a b a b a", "word " * 300]


@pytest.fixture(scope="module")
def prose(spark):
    """Texts in two languages that differ in fertility, each with its own junk."""
    import random

    rnd = random.Random(5)
    plain = ["river", "stone", "under", "winter", "yellow", "people", "garden", "mother", "window", "letter", "summer", "evening"]
    rows = []
    for i in range(240):
        words = [rnd.choice(plain) for _ in range(120)]
        rows.append((i, " ".join(words) if i % 2 else " ".join(w[::-1] + "ñøß" for w in words), "en" if i % 2 else "xx"))
    rows.append((900, " ".join("".join(rnd.choice("qxzjkvw#%") for _ in range(7)) for _ in range(120)), "en"))
    rows.append((901, " ".join("ẞⱿꞮ" + str(i) for i in range(120)), "en"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_base_counts_and_measures(spark, clashing):
    df = clashing(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    rows = fertility.judge(df, "doc_id", "text", PIECE_MODEL).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        text = TEXTS[row.doc_id] or ""
        want = brute(text)
        assert tuple(row[c] for c in fertility.COUNTS) == want, text
        for c, w in zip(fertility.MEASURES, brute_measures(text)):
            assert row[c] == pytest.approx(w)
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_many_distinct_words_are_renumbered(monkeypatch):
    import numpy as np

    codes = np.array([0, 1, 2, 5, 0, 1, 2, 1 << 21, 7, 0, 1])
    assert fertility.repeated_words(codes) == 6 == brute(" ".join(map(str, codes)))[4]


def test_bands_keep_each_language_and_reject_debris(prose):
    rows = {r.doc_id: r for r in fertility.judge(prose, "doc_id", "text", PIECE_MODEL, "lang").collect()}
    assert all(rows[i].kept for i in range(240) if not rows[i].base_failed) and not rows[1].base_failed
    assert not rows[900].kept and not rows[901].kept and not rows[900].base_failed


def test_groups_by_script_where_no_language_is_given():
    assert fertility.script_of("привет abc") == "Cyrillic" and fertility.script_of("12 34") == "none" and fertility.script_of("ab中文") == "Han"


def test_small_groups_take_the_common_band(prose):
    from pyspark.sql import functions as F

    few = prose.withColumn("lang", F.when(F.col("doc_id") < 20, "rare").otherwise("en"))
    rows = fertility.judge(few, "doc_id", "text", PIECE_MODEL, "lang", least=100).collect()
    assert all(r.kept for r in rows if r.doc_id < 20 and not r.base_failed)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "x y"), (1, "x y")], "doc_id long, text string")
    assert [r.n_words for r in fertility.judge(df, "doc_id", "text", PIECE_MODEL).collect()] == [2, 2, 2]
    assert fertility.judge(df.limit(0), "doc_id", "text", PIECE_MODEL).collect() == []


def kinds(rnd, n=120):
    """Prose, tables of its words and the same prose with symbols on every word, as (kind, text)."""
    plain = ["river", "stone", "under", "winter", "yellow", "people", "garden", "mother", "window", "letter", "summer", "evening"]
    plain = [a + b + c for a in plain for b in plain for c in plain]
    marks = ["$$$", "&&&", "%%%", "###", "***"]
    for i in range(n):
        words = [rnd.choice(plain) + rnd.choice(["", "", "", "", ",", "."]) for _ in range(rnd.randint(60, 400))]
        yield "plain", " ".join(words)
        if i % 10 == 0:
            yield "table", " | ".join(words)
            yield "symbols", " ".join(w + rnd.choice(marks) for w in words)
            yield "separators", " ".join(w + " " + " ".join(rnd.choice("|=-*#&%$~+/:;<>@^_!?") for _ in range(9)) for w in words[:60])


def test_verdicts_by_kind_of_document(spark):
    import random

    rows = [(i, kind, text, "en") for i, (kind, text) in enumerate(kinds(random.Random(8)))]
    df = spark.createDataFrame(rows, "doc_id long, kind string, text string, lang string")
    judged = fertility.judge(df, "doc_id", "text", PIECE_MODEL, "lang").join(df.select("doc_id", "kind"), "doc_id").collect()
    found = collections.Counter((r.kind, r.kept) for r in judged)
    assert not any(r.base_failed for r in judged)
    assert found == {("plain", True): 120, ("table", True): 12, ("symbols", False): 12, ("separators", False): 12}


@pytest.mark.parametrize("few", [1, 3, 20, 99, 100])
def test_a_small_language_of_another_fertility_is_kept_at_every_size(spark, few):
    import random

    rnd = random.Random(9)
    rows = [(text, "en") for kind, text in kinds(rnd, 150) if kind == "plain"]
    letters = [chr(c) for c in range(0x13A0, 0x13E0)]  # Cherokee: not in the vocabulary
    rows += [(" ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(rnd.randint(60, 300))), "chr") for _ in range(few)]
    rows += [(text, "chr") for kind, text in kinds(rnd, 1) if kind == "symbols"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in fertility.judge(df, "doc_id", "text", PIECE_MODEL, "lang").collect()}
    assert all(got[i].byte_share > 0.8 and got[i].kept for i in range(150, 150 + few))
    assert not got[150 + few].kept
