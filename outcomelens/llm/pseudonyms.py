"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Found values are checked (calendar, octets, Luhn, IBAN check digits) and replaced by a keyed permutation of their own format: a Feistel network whose
round function is a keyed SHA-512. A permutation is one-to-one, so equal values get equal pseudonyms in every document and different values never
share one; nothing is stored, joined or shuffled for that. Separators, lengths and the kinds of characters stay; check digits are made
anew, so a pseudonym passes the same checks.

=============  ==================================================  ===========================================================
Kind           Found                                               Permuted
=============  ==================================================  ===========================================================
date           2021-03-04, 04.03.2021, 04/03/2021 (day first)      the day, in 1900-01-01 .. 2099-08-05; others are left alone
ip             four octets without leading zeros                   the 32 bits
card           13 to 19 digits, blanks or dashes between, Luhn     all digits but the first and the last; the last is made anew
iban           country, check digits, groups; modulo 97            all after the check digits; these are made anew
ssn            123-45-6789                                         all digits
phone          +country and groups, (123) 456-7890, 123-456-7890   all digits but the country's; places that never hold 0 or 1 keep to 2..9
email          local@domain                                        letters and digits of the local part
credential     AKIA..., value after password, token, secret, key   letters and digits; hexadecimal values stay hexadecimal
=============  ==================================================  ===========================================================

Dates are one value in all three notations. Numbers that fail their check stay as they are.

Cases: null text stays null with zero counts; empty text stays empty; texts of any length are one pass of one pattern; repeated rows give repeated results;
other columns pass through unchanged; a null key is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Notations of the kinds, in the order in which they are tried.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "credential": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?<=(?i:password|passwd|token|secret|api_?key)[ ]{0,2}[=:][ ]{0,2}[\"']?)[A-Za-z0-9_-]{8,}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
             r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
KINDS = list(PATTERNS)
ANY_KIND = "(?<![A-Za-z0-9])(?:" + "|".join(PATTERNS.values()) + ")"

# Alphabets by class of a place.
ALPHABETS = {"d": "0123456789", "n": "23456789", "z": "01", "l": "abcdefghijklmnopqrstuvwxyz",
             "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "0123456789abcdef"}
FIRST_DAY, DAY_SIDE = "1900-01-01", 270  # 270 * 270 days


def round_value(key: str, kind: str, number: Column, other: Column) -> Column:
    """128 hexadecimal digits from the key, the kind, the round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), other.cast("string")), 512)


def drawn(digits: Column, place: Column) -> Column:
    return F.conv(F.substring(digits, (place % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def permuted_number(left: Column, right: Column, side: int, key: str, kind: str) -> Column:
    """Feistel on two integers below ``side``: struct (a, b)."""
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, i: F.struct(
        s["b"].alias("a"),
        F.pmod(s["a"] + F.conv(F.substring(round_value(key, kind, i, s["b"]), 1, 12), 16, 10).cast("long"), F.lit(side)).alias("b")))


def permuted_text(text: Column, classes: Column, key: str, kind: str) -> Column:
    """Feistel on the characters of ``text``, each within the alphabet that ``classes`` names at its place; others stay."""
    half = F.ceil(F.length(text) / 2).cast("int")
    rest = F.lit(2_147_483_647)

    def shifted(part: Column, kinds: Column, digits: Column) -> Column:
        def one(char: Column, at: Column) -> Column:
            kind_here = F.substring(kinds, at + 1, F.lit(1))
            out = char
            for name, letters in ALPHABETS.items():
                place = F.pmod(F.instr(F.lit(letters), char) - 1 + drawn(digits, at), F.lit(len(letters)))
                out = F.when(kind_here == name, F.substring(F.lit(letters), place + 1, F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(part, ""), one), "")

    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(classes, F.lit(1), half).alias("ka"),
                     F.substring(text, half + 1, rest).alias("b"), F.substring(classes, half + 1, rest).alias("kb"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, i: F.struct(
        s["b"].alias("a"), s["kb"].alias("ka"),
        shifted(s["a"], s["ka"], round_value(key, kind, i, s["b"])).alias("b"), s["ka"].alias("kb")),
        lambda s: F.concat(s["a"], s["b"]))


def classes_of(text: Column) -> Column:
    # digits become d after lower-case letters have become l, as d is one
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        text, "[^0-9a-zA-Z]", "."), "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d")


def placed_digits(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits and capital letters replaced in order by the characters of ``digits``."""
    return F.aggregate(F.split(pattern, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda s, c: F.when(
        c.rlike("[0-9A-Z]"), F.struct(F.concat(s["out"], F.substring(digits, s["at"] + 1, F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))), lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum of Luhn, with the last digit of ``digits`` counted singly."""
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + (c.cast("int") * 2) % 10)), F.lit(0), lambda s, x: s + x)


def modulo_97(text: Column) -> Column:
    """Remainder of an IBAN's letters and digits, letters counted from 10."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda s, c: F.when(
        c.rlike("[0-9]"), (s * 10 + c.cast("long")) % 97).otherwise((s * 100 + F.ascii(c).cast("long") - 55) % 97))


def date_pseudonym(found: Column, key: str) -> Column:
    iso, dotted = found.rlike("^[0-9]{4}-"), F.contains(found, F.lit("."))
    day = F.when(iso, F.try_to_date(found, "yyyy-MM-dd")).when(dotted, F.try_to_date(found, "dd.MM.yyyy")).otherwise(
        F.try_to_date(found, "dd/MM/yyyy"))
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    new = permuted_number(F.floor(number / DAY_SIDE), number % DAY_SIDE, DAY_SIDE, key, "date")
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), (new["a"] * DAY_SIDE + new["b"]).cast("int"))
    text = F.when(iso, F.date_format(moved, "yyyy-MM-dd")).when(dotted, F.date_format(moved, "dd.MM.yyyy")).otherwise(
        F.date_format(moved, "dd/MM/yyyy"))
    return F.when((number >= 0) & (number < DAY_SIDE * DAY_SIDE), text)


def ip_pseudonym(found: Column, key: str) -> Column:
    octets = F.transform(F.split(found, r"\."), lambda x: x.cast("int"))
    valid = ~found.rlike(r"(^|\.)0[0-9]") & F.forall(octets, lambda x: x <= 255)
    new = permuted_number(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, key, "ip")
    return F.when(valid, F.concat_ws(".", *[y.cast("string") for h in ("a", "b") for y in (F.floor(new[h] / 256), new[h] % 256)]))


def parts_around(found: Column, start: Column, end: Column) -> tuple[Column, Column, Column]:
    """What stands before, from and after the places ``start`` to ``end`` (from 1, inclusive)."""
    return F.substr(found, F.lit(1), start - 1), F.substr(found, start, end - start + 1), F.substr(found, end + 1)


def group_ends(found: Column, separators: str) -> Column:
    """Places where a group of characters ends."""
    return F.filter(F.sequence(F.lit(1), F.length(found)), lambda p: (p == F.length(found)) | F.substr(found, p + 1, F.lit(1)).rlike(separators))


def group_starts(found: Column, separators: str) -> Column:
    return F.filter(F.sequence(F.lit(1), F.length(found)), lambda p: (p == 1) | F.substr(found, p - 1, F.lit(1)).rlike(separators))


def is_card(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0)


def card_pseudonym(found: Column, key: str) -> Column:
    """The card in ``found``: all of it, else the first run of its groups that is one, the longest of those that begin there."""
    runs = F.flatten(F.transform(group_starts(found, "[ -]"), lambda a: F.transform(
        F.filter(group_ends(found, "[ -]"), lambda b: b - a >= 12), lambda b: F.struct(a.alias("a"), (-b).alias("b")))))
    passing = F.filter(runs, lambda r: is_card(F.substr(found, r["a"], -r["b"] - r["a"] + 1)))
    chosen = F.when(is_card(found), F.struct(F.lit(1).alias("a"), (-F.length(found)).alias("b"))).otherwise(F.array_min(passing))

    def made(at: Column) -> Column:
        before, card, after = parts_around(found, at["a"], -at["b"])
        digits = F.regexp_replace(card, "[^0-9]", "")
        first, inner = F.substring(digits, 1, 1), F.substring(digits, F.lit(2), F.length(digits) - 2)
        # the first digit (the kind of card) and the length select the permutation
        new = F.concat(first, permuted_text(inner, F.repeat(F.lit("d"), F.length(inner)), key, "card"))
        check = F.pmod(-luhn_sum(F.concat(new, F.lit("0"))), F.lit(10))
        return F.concat(before, placed_digits(card, F.concat(new, check.cast("string"))), after)

    return F.get(F.transform(F.array(chosen), lambda at: F.when(at.isNotNull(), made(at))), F.lit(0))


def is_iban(text: Column) -> Column:
    plain = F.replace(text, F.lit(" "), F.lit(""))
    return F.length(plain).between(15, 34) & (modulo_97(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))) == 1)


def iban_pseudonym(found: Column, key: str) -> Column:
    """The IBAN at the beginning of ``found``: the longest run of groups that is one."""
    ends = F.filter(group_ends(found, " "), lambda b: is_iban(F.substr(found, F.lit(1), b)))
    chosen = F.when(is_iban(found), F.length(found)).otherwise(F.array_max(ends))

    def made(end: Column) -> Column:
        _, iban, after = parts_around(found, F.lit(1), end)
        plain = F.replace(iban, F.lit(" "), F.lit(""))
        country, rest = F.substring(plain, 1, 2), F.substring(plain, 5, 64)
        new = permuted_text(rest, classes_of(rest), key, "iban")
        check = F.lpad((98 - modulo_97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(placed_digits(iban, F.concat(country, check, new)), after)

    return F.get(F.transform(F.array(chosen), lambda end: F.when(end.isNotNull(), made(end))), F.lit(0))


def phone_pseudonym(found: Column, key: str) -> Column:
    country = F.regexp_extract(found, r"^\+[0-9]{1,3}(?=[ .(-])|^\+1(?=[0-9])", 0)
    rest = F.substring(found, F.length(country) + 1, F.lit(64))
    digits = F.regexp_replace(rest, "[^0-9]", "")

    def place(at: int) -> Column:  # area and exchange codes begin with 2 to 9; a 0 or 1 there stays one
        return F.when(F.substring(digits, at, 1).isin("0", "1"), "z").otherwise("n")

    american = F.concat(place(1), F.lit("dd"), place(4), F.lit("dddddd"))
    classes = F.when(F.length(digits) == 10, american).otherwise(F.repeat(F.lit("d"), F.length(digits)))
    return F.concat(country, placed_digits(rest, permuted_text(digits, classes, key, "phone")))


def pseudonym(kind: str, found: Column, key: str) -> Column:
    """The pseudonym of a value of a kind; null where the value fails its check."""
    if kind == "date":
        return date_pseudonym(found, key)
    if kind == "ip":
        return ip_pseudonym(found, key)
    if kind == "card":
        return card_pseudonym(found, key)
    if kind == "iban":
        return iban_pseudonym(found, key)
    if kind == "phone":
        return phone_pseudonym(found, key)
    if kind == "email":
        local = F.substring_index(found, "@", 1)
        return F.concat(permuted_text(local, classes_of(local), key, kind), F.substring(found, F.length(local) + 1, F.lit(2_147_483_647)))
    if kind == "credential":
        lead = F.regexp_extract(found, "^AKIA(?=[0-9A-Z]{16}$)", 0)
        rest = F.substring(found, F.length(lead) + 1, F.lit(2_147_483_647))
        classes = F.when(rest.rlike("^[0-9a-f]+$"), F.repeat(F.lit("h"), F.length(rest))).otherwise(classes_of(rest))
        return F.concat(lead, permuted_text(rest, classes, key, kind))
    return placed_digits(found, permuted_text(F.regexp_replace(found, "[^0-9]", ""), F.lit("d" * 9), key, kind))  # ssn


def replaced(found: Column, key: str) -> Column:
    """Struct (kind, text) of a found value: its pseudonym, or itself with a null kind where no check holds."""
    options = [F.when(found.rlike(f"^(?:{PATTERNS[k]})$"), k) for k in KINDS if k != "credential"]
    kind = F.coalesce(*options, F.lit("credential"))
    text = F.lit(None).cast("string")
    for k in KINDS:
        text = F.when(kind == k, pseudonym(k, found, key)).otherwise(text)
    return F.struct(kind.alias("kind"), text.alias("text"))


def pseudonymise(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """``df`` with the text's values replaced, and ``pii_<kind>`` (long) for the number of values replaced per kind."""
    if not key:
        raise ValueError("a key is needed")
    text = F.col(text_col).cast("string")
    at, made = _unused(df, "_found"), _unused(df, "_new")
    found = df.withColumn(at, F.regexp_extract_all(text, F.lit(ANY_KIND), F.lit(0)))
    found = found.withColumn(made, F.transform(at, lambda m: replaced(m, key)))
    new = F.zip_with(at, made, lambda m, n: F.coalesce(n["text"], m))
    parts = F.zip_with(F.split(text, ANY_KIND, -1), new, lambda gap, n: F.concat(gap, F.coalesce(n, F.lit(""))))

    def count(kind: str) -> Column:
        replaced_here = F.filter(made, lambda n: (n["kind"] == kind) & n["text"].isNotNull())
        return F.when(text.isNull(), 0).otherwise(F.size(replaced_here)).cast("long").alias(f"pii_{kind}")

    rewritten = F.when(F.size(at) > 0, F.array_join(parts, "")).otherwise(text)
    kept = [F.col(c) if c != text_col else rewritten.alias(text_col) for c in df.columns]
    return found.select(*kept, *map(count, KINDS))


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
