"""The keyed permutations written again in plain Python, with their inverses, and the cases that formats make hard."""

import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ledgerwright.llm import pii

KEY = "k"
FIRST, LAST = dt.date(1800, 1, 1), dt.date(2199, 12, 31)


def digest(kind, turn, other):
    return hashlib.sha256("\x1f".join((KEY, kind, str(turn), str(other))).encode()).hexdigest()


def number(n, a, b, kind, back=False):
    x, y = divmod(n, b)
    for r in reversed(range(8)) if back else range(8):
        sign = -1 if back else 1
        if r % 2 == 0:
            x = (x + sign * int(digest(kind, r, y)[:14], 16)) % a
        else:
            y = (y + sign * int(digest(kind, r, x)[:14], 16)) % b
    return x * b + y


def moved(text, by, alphabets, sign=1):
    out = ""
    for i, c in enumerate(text):
        n = int(hashlib.sha256(f"{by}\x1f{i - i % 16}".encode()).hexdigest()[i % 16 * 4 :][:4], 16)
        for a in alphabets:
            if c in a:
                c = a[(a.index(c) + sign * n) % len(a)]
                break
        out += c
    return out


def text(s, kind, alphabets=pii.CLASSES, back=False):
    half = len(s) // 2
    if not back:
        x, y = s[:half], s[half:]
        for r in range(8):
            x, y = y, moved(x, digest(kind, r, y), alphabets)
        return x + y
    x, y = s[:half], s[half:]  # eight turns leave the halves as long as they were
    for r in reversed(range(8)):
        x, y = moved(y, digest(kind, r, x), alphabets, -1), x
    return x + y


def day(d, back=False):
    n = (d - FIRST).days
    while True:
        n = number(n, pii.DAYS_A, pii.DAYS_B, "date", back)
        if ((FIRST + dt.timedelta(n)).day > 12) == (d.day > 12):
            return FIRST + dt.timedelta(n)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))


def card(value):
    digits = re.sub(r"\D", "", value)
    payload = text(digits[:-1], "card")
    new = iter(payload + str(-luhn(payload + "0") % 10))
    return re.sub(r"\d", lambda _: next(new), value)


def ssn(value):
    a, g, s = map(int, value.split("-"))
    n = number(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, "ssn")
    a = n // (99 * 9999)
    return f"{a + 1 + (a >= 665):03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"


def address(value):
    n = number(int.from_bytes(bytes(map(int, value.split("."))), "big"), 65536, 65536, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def phone(value):
    digits = re.sub(r"\D", "", value)
    new = iter(digits[:-10] + text(digits[-10:], "phone"))
    return re.sub(r"\d", lambda _: next(new), value)


def mail(value):
    local, host = value.split("@")
    if all(c.isascii() or any(c in a for a in pii.WIDE) for c in local):
        return text(local, "email", pii.CLASSES if local.isascii() else pii.WIDE) + "@" + host
    return digest("email", "whole", local)[:16] + "@" + host


def replaced(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(rows, KEY).orderBy("doc_id").collect()]


@pytest.mark.parametrize("make, values", [
    (card, ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "6011000990139424"]),
    (ssn, ["123-45-6789", "665-01-0001", "667-99-9999", "899-50-1234"]), (address, ["10.0.0.1", "255.255.255.255", "97.51.17.173"]),
    (phone, ["+1 (017) 555-7713", "212-555-0123", "+442071234567"]),
    (mail, ["an.34@mail4.example.com", "X@y.org", "josé.gärtner@x.com", "иван.Петров@mail.ru", "νίκη7@x.gr", "é@x.com", "田中.taro@x.jp", "josé@x.com"])])
def test_pseudonyms_equal_plain_python(spark, make, values):
    assert replaced(spark, values) == [make(v) for v in values]


def test_no_letter_of_an_address_stays_by_design(spark):
    for value, got in zip(values := ["иван@mail.ru", "é@x.com", "田中@x.jp", "josé@x.com"], replaced(spark, values)):
        assert got != value and got.split("@")[1] == value.split("@")[1]
    assert pii.WIDE[3].count("é") == 1 and all(len(set(a)) == len(a) for a in pii.WIDE)


def test_dates_keep_their_reading(spark):
    days = [FIRST, LAST, dt.date(1999, 12, 31), dt.date(2021, 3, 4), dt.date(2000, 2, 29), dt.date(2024, 5, 13), dt.date(2024, 5, 12)]
    written = [x for d in days for x in (d.isoformat(), f"{d.day:02d}.{d.month:02d}.{d.year}", f"{d.month:02d}/{d.day:02d}/{d.year}", f"{d.day:02d}/{d.month:02d}/{d.year}")]
    got = dict(zip(written, replaced(spark, written)))

    def read(v):  # month first where that is a date
        a, b, y = map(int, v.split("/"))
        return dt.date(y, a, b) if a <= 12 else dt.date(y, b, a)

    for d in days:
        new = day(d)
        assert day(new, back=True) == d
        assert got[d.isoformat()] == new.isoformat() and got[f"{d.day:02d}.{d.month:02d}.{d.year}"] == f"{new.day:02d}.{new.month:02d}.{new.year}"
        for v in (f"{d.month:02d}/{d.day:02d}/{d.year}", f"{d.day:02d}/{d.month:02d}/{d.year}"):
            assert read(got[v]) == day(read(v))
    assert len(set(got[f"{d.day:02d}/{d.month:02d}/{d.year}"] for d in days)) == len(days)


def test_days_are_permuted_one_to_one_within_their_kind(spark):
    n = pii.DAYS_A * pii.DAYS_B
    d = F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int"))
    out = spark.range(0, n, 7).select(d.alias("d"), pii.day_pseudonym(d, KEY).alias("x"))
    assert out.agg(F.count_distinct("x"), F.count_if((F.dayofmonth("d") > 12) != (F.dayofmonth("x") > 12))).first() == (-(-n // 7), 0)


def test_inverses():
    for s in ("", "a", "ab", "4111", "An.34x", "иван"):
        assert text(text(s, "email", pii.WIDE), "email", pii.WIDE, back=True) == s
    for n in (0, 1, 898 * 99 * 9999 - 1):
        assert number(number(n, 898 * 99, 9999, "ssn"), 898 * 99, 9999, "ssn", back=True) == n
