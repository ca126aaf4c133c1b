import re

import pytest

from ledgerwright.llm import pii

CARD = "4111 1111 1111 1111"
PLAIN = CARD.replace(" ", "")
BESIDE = [
    f"{CARD} 12/27", f"{PLAIN} 123", f"order 12 {PLAIN}", f"no.{PLAIN}", f"{CARD.replace(' ', '-')}-x", f"x-{PLAIN}.", f"{PLAIN} {PLAIN[::-1]}", f"77 {PLAIN} 2021-03-04", f"{CARD} 555-123-4567",
    f"{PLAIN} 123-45-6789", f"9 {CARD} 9", f"12345678901234567890 {PLAIN}"]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_cards_beside_other_numbers(spark):
    rows = [*BESIDE, f"{CARD} 555-123-4567", "555-123-4567", "2021-03-04", "123-45-6789", PLAIN, "1 " * 20_000]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    phone, day, ssn, card = got[-5:-1]
    spaced = " ".join(re.findall("....", card))
    assert luhn(card) and card != PLAIN
    for text, new in zip(BESIDE, got):
        assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", text)
        assert PLAIN not in re.sub(r"[ -]", "", new), text
    assert got[0] == f"{spaced} 12/27" and got[3] == f"no.{card}" and got[4] == f"{spaced.replace(' ', '-')}-x" and got[5] == f"x-{card}."
    assert got[7].endswith(day) and got[8] == got[12] and got[8] == f"{spaced} {phone.replace('(', '')}" and got[9] == f"{card} {ssn}" and got[11] == f"12345678901234567890 {card}"


@pytest.mark.parametrize("case", ["lower", "upper", "mixed"])
def test_secrets_keep_their_case(spark, case):
    value = {"lower": "9233a8ecdd0911f0aa33bb44cc55dd66ee77ff88", "upper": "9233A8ECDD0911F0AA33BB44CC55DD66EE77FF88", "mixed": "9233a8ECdd0911f0AA33bb44cc55dd66ee77ff88"}[case]
    new = pii.pseudonymise(spark.createDataFrame([(f'TOKEN = "{value}" 12 {value}',)], "text string"), "k").first().text
    a, b = re.fullmatch(r'TOKEN = "([0-9A-Fa-f]{40})" 12 ([0-9A-Fa-f]{40})', new).groups()
    assert a == b != value and (case == "mixed" or a == getattr(a, case)())
