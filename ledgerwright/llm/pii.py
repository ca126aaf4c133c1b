"""Format-preserving pseudonyms for personal numbers, dates and addresses by keyed Feistel permutations.

Built-in functions only. Each found value is validated, permuted within its own format under a secret key, and
put back; the permutation depends on the value and the key alone, so equal values stay equal in all documents.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import unused

ROUNDS = 8
#: Formats that are looked for. Kinds earlier in the list win at the same place.
EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
WRITTEN_DATE = r"(?<![\d./])\d{1,2}([./])\d{1,2}\1\d{4}(?![\d/]|\.\d)"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|(?<=[\d) .-])\d{3}[ .-]|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{10,15}(?!\d)"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
_OTHERS = "|".join((ISO_DATE, WRITTEN_DATE.replace(r"\1", "[./]"), IPV4, SSN, PHONE))
#: Blocks of at most 19 digits joined by single separators, 13 digits in all, up to where another kind begins; cards are looked for within.
_BLOCK = r"\d{1,19}+(?!\d)"
CARDS = rf"(?<!\d)(?<!\d\.)(?=\d(?:(?:[ -](?!{_OTHERS}|{SECRET}))?\d){{12}})(?!{SECRET}){_BLOCK}(?:[ -](?!{_OTHERS}|{SECRET}){_BLOCK})*+"
_NUMBERS = f"{_OTHERS}|{CARDS}"
#: Numbers are only tried where a digit, "+" or "(" stands.
ANY = rf"{EMAIL}|(?=[\d+(])(?:{_NUMBERS})|(?=[0-9A-Fa-f]{{32}}){SECRET}"
#: Days from 1800-01-01 to 2199-12-31: 400 years of the calendar are 189 * 773 days.
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773
#: Most steps of a walk through the days; each step ends it with probability 0.39 at least, so 128 leave 1e-27.
WALK = 128


def digest(key: str, kind: str, turn: Column, other: Column) -> Column:
    """256 keyed bits as hexadecimal digits; the round function of all permutations."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), turn.cast("string"), other.cast("string")), 256)


def hex_number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def feistel_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A permutation of 0 .. a*b-1: the two mixed-radix digits are shifted in turn by a keyed function of the other one."""
    def turn(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        add = hex_number(F.substring(digest(key, kind, r, F.when(even, acc["y"]).otherwise(acc["x"])), 1, 14))
        return F.struct(F.when(even, (acc["x"] + add) % a).otherwise(acc["x"]).alias("x"), F.when(even, acc["y"]).otherwise((acc["y"] + add) % b).alias("y"))

    start = F.struct((value.cast("long") / b).cast("long").alias("x"), (value.cast("long") % b).alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: acc["x"] * b + acc["y"])


#: Alphabets within which characters are moved.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
BASE16, MIXED16 = ("0123456789abcdef",), ("0123456789", "abcdef", "ABCDEF")


def letters_between(first: int, last: int, kind: str) -> str:
    """The letters of one category (Ll or Lu) in a range of code points."""
    return "".join(chr(c) for c in range(first, last + 1) if unicodedata.category(chr(c)) == kind)


#: Lower and upper case letters of Latin-1 with Latin Extended-A, Greek, and Cyrillic: blocks that never gain letters.
WIDE = (*CLASSES, *(letters_between(a, b, kind) for a, b in ((0xC0, 0x17F), (0x386, 0x3CE), (0x400, 0x45F)) for kind in ("Ll", "Lu")))


def shifted(text: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character moved within its own one of the alphabets by 4 digits of `by`."""

    def move(alphabet: str, c: Column, n: Column) -> Column:
        size = len(alphabet)
        return F.substring(F.lit(alphabet), ((F.position(c, F.lit(alphabet)) - 1 + n % size) % size + 1).cast("int"), F.lit(1))

    def one(c: Column, i: Column) -> Column:
        n = hex_number(F.substring(F.sha2(F.concat_ws("\x1f", by, (i - i % 16).cast("string")), 256), (i % 16) * 4 + 1, F.lit(4)))
        moved = F
        for a in alphabets:
            moved = moved.when(F.position(c, F.lit(a)) > 0, move(a, c, n))
        return moved.otherwise(c)

    return F.when(text == "", "").otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def feistel_text(text: Column, key: str, kind: str, alphabets: tuple[str, ...] = CLASSES) -> Column:
    """A permutation of the strings with the same character classes; halves are shifted in turn by a keyed function of the other."""
    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("x"), F.substring(text, half + 1, F.length(text)).alias("y"))
    turn = lambda acc, r: F.struct(acc["y"].alias("x"), shifted(acc["x"], digest(key, kind, r, acc["y"]), alphabets).alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: F.concat(acc["x"], acc["y"]))


def into_format(format: Column, digits: Column) -> Column:
    """`format` with its digits replaced, in order, by `digits`."""
    def put(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["k"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(format, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put, lambda acc: acc["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn rule over a number that ends in its check digit."""
    def add(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 1, 2 * n - F.when(n > 4, 9).otherwise(0)).otherwise(n)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), add), F.lit(0), lambda a, x: a + x)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def card_pseudonym(value: Column, key: str) -> Column:
    """Payload permuted, check digit computed anew, so valid cards stay valid and separators stay in place."""
    digits = digits_of(value)
    payload = feistel_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = (10 - luhn_sum(F.concat(payload, F.lit("0"))) % 10) % 10
    return into_format(value, F.concat(payload, check.cast("string")))


def cards_pseudonym(value: Column, key: str) -> Column:
    """Cards within blocks of digits replaced: at each block the longest run of 13 to 19 digits that ends with a block and passes Luhn.

    Runs do not overlap and the leftmost wins, so a chance pass that ends inside a card takes only the card's first blocks.
    """
    def replaced(blocks: Column) -> Column:
        n = F.size(blocks)

        def step(acc: Column, i: Column) -> Column:
            run = lambda j: F.array_join(F.slice(blocks, i, j - i + 1), "")
            valid = lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0)
            ends = F.filter(F.sequence(F.least(n, i + 18), i, F.lit(-1)), lambda j: F.exists(F.array(digits_of(run(j))), valid))
            put = lambda j: F.struct(
                F.concat(acc["out"], F.when(j.isNull(), F.get(blocks, i - 1)).otherwise(card_pseudonym(run(j), key))).alias("out"), F.coalesce(j, i).alias("done"))
            return F.when(i <= acc["done"], acc).otherwise(F.transform(F.array(F.get(ends, F.lit(0))), put)[0])

        return F.aggregate(F.sequence(F.lit(1), n), F.struct(F.lit("").alias("out"), F.lit(0).alias("done")), step, lambda acc: acc["out"])

    return F.transform(F.array(F.regexp_extract_all(value, F.lit(r"\d+[ -]?"), F.lit(0))), replaced)[0]


def secret_pseudonym(value: Column, key: str) -> Column:
    """Permuted as a number in base 16 where all letters have one case; where cases are mixed, each place keeps its class."""
    lower = F.lower(value)
    return (
        F.when(value == lower, feistel_text(value, key, "secret", BASE16))
        .when(value == F.upper(value), F.upper(feistel_text(lower, key, "secret", BASE16)))
        .otherwise(feistel_text(value, key, "secret", MIXED16)))


def phone_pseudonym(value: Column, key: str) -> Column:
    """The last ten digits permuted; a country code before them stays."""
    digits = digits_of(value)
    keep = F.length(digits) - 10
    return into_format(value, F.concat(F.substring(digits, F.lit(1), keep), feistel_text(F.substring(digits, keep + 1, F.lit(10)), key, "phone")))


def ssn_pseudonym(value: Column, key: str) -> Column:
    """Permuted among valid numbers: area 001-899 without 666, group 01-99, serial 0001-9999."""
    area, group, serial = (F.substring(value, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    index = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1
    moved = feistel_number(index, 898 * 99, 9999, key, "ssn")

    def spell(m: Column) -> Column:
        a = (m / (99 * 9999)).cast("long")
        return F.format_string("%03d-%02d-%04d", a + 1 + (a >= 665).cast("long"), (m / 9999).cast("long") % 99 + 1, m % 9999 + 1)

    return F.transform(F.array(moved), spell)[0]


def ip_pseudonym(value: Column, key: str) -> Column:
    part = [F.split_part(value, F.lit("."), F.lit(k)).cast("long") for k in range(1, 5)]
    moved = feistel_number(((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3], 65536, 65536, key, "ip")
    return F.transform(F.array(moved), lambda m: F.concat_ws(".", *[F.shiftrightunsigned(m, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))[0]


def day_pseudonym(day: Column, key: str) -> Column:
    """A permutation of the days of 1800 to 2199 that moves days up to the 12th among themselves, and later ones too.

    So a written date keeps its reading: 31/12/1999 can only be day first, and its pseudonym can only be day first as well.
    The keyed permutation is repeated until it meets a day of the right kind.
    """
    at = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
    late = F.dayofmonth(day) > 12

    def walk(acc: Column, _: Column) -> Column:
        moved = F.transform(F.array(feistel_number(acc["n"], DAYS_A, DAYS_B, key, "date")), lambda m: F.struct(m.alias("n"), ((F.dayofmonth(at(m)) > 12) == late).alias("done")))[0]
        return F.when(acc["done"], acc).otherwise(moved)

    start = F.struct(F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long").alias("n"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, walk, lambda acc: at(acc["n"]))


def local_pseudonym(local: Column, key: str) -> Column:
    """The local part of an address, permuted within its character classes.

    Letters beyond ASCII move within the small or capital letters of their block (WIDE). A local part with a letter or
    digit of any other script is replaced wholly, by 16 hexadecimal digits of its keyed hash.
    """
    known = "".join(re.escape(c) for a in WIDE[len(CLASSES):] for c in a)
    return (
        F.when(local.rlike(r"^[\x00-\x7F]*$"), feistel_text(local, key, "email"))
        .when(local.rlike(rf"^[\x00-\x7F{known}]*$"), feistel_text(local, key, "email", WIDE))
        .otherwise(F.substring(digest(key, "email", F.lit("whole"), local), 1, 16)))


def calendar_day(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is none in 1800 to 2199."""
    known = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    return F.when(year.between(1800, 2199), known)


def date_parts(value: Column) -> tuple[Column, Column]:
    """(date, whether the month is written first) of d.m.yyyy, m/d/yyyy or, where that is no date, d/m/yyyy."""
    a, b, year = (F.regexp_extract(value, r"(\d+)\D(\d+)\D(\d+)", k).cast("int") for k in (1, 2, 3))
    first = value.contains("/") & calendar_day(year, a, b).isNotNull()
    return F.when(first, calendar_day(year, a, b)).otherwise(calendar_day(year, b, a)), first


def written_pseudonym(value: Column, key: str) -> Column:
    """The permuted date in the written order; a part is zero-padded if the original was or its two digits allow either."""
    day, _ = date_parts(value)
    sign = F.regexp_extract(value, r"\D", 0)
    wide = value.rlike(r"^0|\D0")

    def spell(d: Column) -> Column:
        first = date_parts(value)[1]
        style = lambda n: F.when(wide | (F.length(value) == 10), F.format_string("%02d", n)).otherwise(n.cast("string"))
        m, n = F.month(d), F.dayofmonth(d)
        return F.concat(style(F.when(first, m).otherwise(n)), sign, style(F.when(first, n).otherwise(m)), sign, F.year(d).cast("string"))

    return F.transform(F.array(day_pseudonym(day, key)), spell)[0]


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; a value that fails its kind's validation stays as it is."""
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    iso = F.transform(F.array(value), lambda v: calendar_day(*[F.split_part(v, F.lit("-"), F.lit(k)).cast("int") for k in (1, 2, 3)]))[0]
    local = F.substring_index(value, "@", 1)  # an address holds one @
    return (
        F.when(whole(EMAIL), F.concat(local_pseudonym(local, key), F.substring(value, F.length(local) + 1, F.length(value))))
        .when(whole(ISO_DATE), F.when(iso.isNull(), value).otherwise(F.date_format(day_pseudonym(iso, key), "yyyy-MM-dd")))
        .when(whole(WRITTEN_DATE), F.when(date_parts(value)[0].isNull(), value).otherwise(written_pseudonym(value, key)))
        .when(whole(IPV4), F.when(F.exists(F.split(value, r"\."), lambda p: p.cast("int") > 255), value).otherwise(ip_pseudonym(value, key)))
        .when(whole(SSN), F.when(value.rlike(r"^(?:000|666|9)|-00-|-0000$"), value).otherwise(ssn_pseudonym(value, key)))
        .when(whole(PHONE), phone_pseudonym(value, key))
        .when(whole(SECRET), secret_pseudonym(value, key))
        .when(whole(r"\d[\d -]*"), cards_pseudonym(value, key))
        .otherwise(value)
    )


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns with pseudonyms in `text_col`, plus n_found and n_changed int.

    Kinds: e-mail addresses (the local part), IPv4 addresses, phone numbers, social security numbers, payment
    cards (Luhn), dates of 1800 to 2199, hexadecimal secrets of 32 to 64 digits in either case. Numbers joined by
    single spaces or hyphens are one found value, in which every run of whole blocks may be a card. Values that fail validation
    (octets over 255, a wrong check digit, 30 February) stay. Null texts stay null, empty ones empty (0 found).
    Equal dates stay equal whatever format they're written in, and stay readable in one way only. Needs no shuffle. Columns named n_found or
    n_changed are replaced, all others stay whatever their names.
    """
    df = df.drop("n_found", "n_changed")
    text = F.col(text_col)

    def replaced(found: Column) -> Column:
        return F.transform(F.array(F.transform(found, lambda v: pseudonym(v, key))), lambda new: F.struct(
            F.array_join(F.zip_with(F.split(text, ANY), F.concat(new, F.array(F.lit(""))), lambda gap, v: F.concat(gap, v)), "").alias("text"),
            F.size(found).alias("n"), F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)).alias("m")))[0]

    got = F.transform(F.array(F.regexp_extract_all(text, F.lit(ANY), F.lit(0))), lambda found: F.when(F.size(found) > 0, replaced(found)))[0]
    (new,) = unused(df, "__new")
    out = df.withColumn(new, got)
    made = {text_col: F.coalesce(F.col(f"{new}.text"), text), "n_found": F.coalesce(F.col(f"{new}.n"), F.lit(0)), "n_changed": F.coalesce(F.col(f"{new}.m"), F.lit(0))}
    return out.select(*[(made[c] if c in made else F.col(f"`{c}`")).alias(c) for c in [*df.columns, "n_found", "n_changed"]])
