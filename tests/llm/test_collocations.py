import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from outcomelens.llm import collocations as co

SMALL = dict(bits=1 << 12)


def pieces(text):
    for piece in re.split(r"[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
        yield re.findall(r"[^ \t]+", piece)


def all_counts(data):
    found = Counter()
    for lang, text in data:
        for words in pieces(text):
            found[lang or "und", 0, ""] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    found[lang or "und", size, " ".join(words[i:i + size])] += 1
    return found


def by_hand(data, min_count=10, top=2000):
    found = all_counts(data)
    out = {}
    for (lang, size, phrase), a in found.items():
        if size < 2 or a < min_count:
            continue
        words = phrase.split(" ")
        cuts = []
        for k in range(1, size):
            l, r = found[lang, k, " ".join(words[:k])], found[lang, size - k, " ".join(words[k:])]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        if size == 2 and any(100 * b >= 50 * a for (g, s, p), b in found.items()
                             if g == lang and s == 3 and b >= min_count and phrase in (p.rsplit(" ", 1)[0], p.split(" ", 1)[1])):
            continue
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, a, l, r, found[lang, 0, ""], score))
    return sorted((lang, i, *row[3:]) for lang, held in out.items() for i, row in enumerate(sorted(held)[:top], 1))


WORDS = ["New", "york", "the", "of", "city", "é", "ÉA", "a\x1cb", "1-2", "zz"]


def made(n, seed=5):
    random = np.random.default_rng(seed)
    data = [(None, None), ("en", ""), ("en", " \t "), ("fr", "x"), (None, "one two " * 12), ("en", ".;:!?\n\r\x0b\x0c,")]
    for i in range(n):
        words = random.choice(WORDS, random.integers(1, 30), p=[.2, .2, .15, .1, .1, .05, .05, .05, .05, .05])
        marks = random.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n"], len(words))
        data.append((["en", "fr", None][i % 7 % 3], "".join(w + m for w, m in zip(words, marks))))
    return data


@pytest.mark.parametrize("sampling", [dict(share=0.1), dict(share=0.0), dict(share=1.0, lowered=1), dict(share=0.5, lowered=40)])
def test_exact_whatever_the_sample(spark, rows, sampling):
    data = made(150)
    df = spark.createDataFrame(data, "lang string, text string").repartition(3)
    got = co.frequent(df, "text", "lang", 10, **SMALL, **sampling)
    want = sorted((lang, size, phrase, n) for (lang, size, phrase), n in all_counts(data).items() if (n >= 10 if size else n > 0))
    assert sorted((r.lang, r.size, bytes(r.phrase).decode(), r.n) for r in got.where("n > 0").collect()) == want


@pytest.mark.parametrize("top", [3, 2000])
def test_against_all_phrases(spark, rows, clashing, top):
    data = made(200) + made(20, seed=1) * 3
    df = spark.createDataFrame(data, "lang string, text string").repartition(4)
    want = by_hand(data, top=top)
    assert len(want) > 5 and rows(co.mine(clashing(df), "text", "lang", top=top, **SMALL)) == sorted(want, key=repr)


def test_large_counts_stay_exact(spark):
    big = 10 ** 12
    counts = [("en", 1, b"a", big), ("en", 1, b"b", big - 1), ("en", 2, b"a b", big - 2), ("en", 1, b"c", 3 * 10 ** 11), ("en", 2, b"b c", 10 ** 11),
              ("en", 3, b"a b c", 10 ** 11)]
    got = {r.phrase: r.score for r in co.scored(spark.createDataFrame(counts, co.COUNTS)).collect()}
    assert got == {"a b": 1_000_000 * (big - 2) ** 2 // (big * (big - 1)), "b c": 1_000_000 * 10 ** 22 // ((big - 1) * 3 * 10 ** 11),
                   "a b c": min(1_000_000 * 10 ** 22 // (big * 10 ** 11), 1_000_000 * 10 ** 22 // ((big - 2) * 3 * 10 ** 11))}


def test_long_texts_and_blocks(spark, rows):
    data = [("en", "alpha beta gamma, " * 90_000), ("en", "lone " * 300_000), ("en", "w" * 2_000_000 + " alpha beta")]
    got = rows(co.mine(spark.createDataFrame(data, "lang string, text string"), "text", "lang", **SMALL))
    assert got == sorted(by_hand(data), key=repr) and len(got) == 2


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="aB é.\n\t ,\x1c\x85", max_size=80), st.integers(1, 20))
def test_word_blocks(text, size):
    kept, co.BLOCK_BYTES = co.BLOCK_BYTES, size
    try:
        words = [w for block in co.word_blocks(text.encode()) for w in block]
    finally:
        co.BLOCK_BYTES = kept
    cut = [p.split() for p in b"\x00".join(words).replace(b"\x00", b" ").split(co.BORDER)]
    assert [p for p in cut if p] == [[w.encode() for w in p] for p in pieces(text) if p]


def test_empty_table(spark):
    assert co.mine(spark.createDataFrame([], "lang string, text string"), "text", "lang", **SMALL).collect() == []
