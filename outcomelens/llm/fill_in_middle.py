"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix, and the parts are set out so that the middle comes last.

Repeated-capture matching: one ``fullmatch`` of ``(unit)*`` by the regex library keeps every repetition of the unit, so the ends of
group 1 are the ends of all units. Their number is ``n`` and both cuts are looked up in them; no unit is visited in Python. A text
longer than ``BLOCK`` characters is matched block by block, each cut where a unit ends (a word character before a blank, where
every match has an end); the lists of ends are joined, so the units are those of the whole text.

A unit is a word with the blanks before it, or blanks at the end. The cuts and the form hang on a digest of ``seed`` and the id
alone: a rerun, another layout or another engine gives the same output.

Forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle. Texts that are empty or hold
a mark stay ``plain``, so the parts can always be read back (``restored``).

Cases: null text counts as empty; a null id is drawn as the empty id; rows with one id are cut by the same draw; repeated rows give
repeated results; texts of any length are taken whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from .arrow import id_field, map_rows

BLANK = r"\x20\x09-\x0D"
MARKS = ("<P>", "<S>", "<M>")
BLOCK = 1 << 20


def _patterns():
    import regex

    return (regex.compile(f"([{BLANK}]*[^{BLANK}]+|[{BLANK}]+)*"), regex.compile(f"[^{BLANK}](?=[{BLANK}])"))


def unit_ends(text: str, patterns=None, block: int = BLOCK) -> list[int]:
    """Ends of the units of ``text``, in code points."""
    units, border = patterns or _patterns()
    if len(text) <= block:
        return units.fullmatch(text).ends(1)
    ends: list[int] = []
    start = 0
    while start < len(text):
        found = border.search(text, start + block)
        end = found.end() if found else len(text)
        ends += units.fullmatch(text, start, end).ends(1)
        start = end
    return ends


def rearranged(text: str, digest: str, ends: list[int], rate: int, spm: int) -> tuple[str, int | None, int | None, str]:
    """(form, prefix length, middle length, output) of a text whose draws are the first four 8-digit groups of ``digest``."""
    first, second, chosen, shape = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or chosen % 100 >= rate or any(mark in text for mark in MARKS):
        return "plain", None, None, text
    low, high = sorted((first % (len(ends) + 1), second % (len(ends) + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if shape % 100 < spm:
        return "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def transform(df: DataFrame, id_col: str, text_col: str, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``id_col``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``, row by row.

    Of the texts that can be cut ``rate`` percent are; of these ``spm`` percent take the form that starts with the suffix.
    """
    drawn = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = df.select(F.col(id_col), F.sha2(drawn, 256).alias("_digest"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def run(batch: Iterable[tuple]) -> Iterator[tuple]:
        patterns = _patterns()
        for key, digest, text in batch:
            ends = unit_ends(text, patterns)
            yield key, len(ends), *rearranged(text, digest, ends, rate, spm)

    fields = [id_field(df, id_col), StructField("n", LongType()), StructField("form", StringType()),
              StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]
    return map_rows(rows, fields, run, lambda row: 4 * len(row[5]))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text an output was made of. Marks cannot arise across a border, for each starts with its only ``<``."""

    def cut(mark: str, part: int, of: Column) -> Column:
        return F.split_part(of, F.lit(mark), F.lit(part))

    whole = F.col(output)
    after = {"psm": cut("<S>", 2, whole), "spm": cut("<P>", 2, whole)}
    psm = F.concat(F.substr(cut("<S>", 1, whole), F.lit(4)), cut("<M>", 2, after["psm"]), cut("<M>", 1, after["psm"]))
    spm = F.concat(cut("<M>", 1, after["spm"]), cut("<M>", 2, after["spm"]), F.substr(cut("<P>", 1, whole), F.lit(4)))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(whole)
