import hashlib
import heapq
import random
import re
import zlib

from ledgerwright.llm import conversation_repair as repair

SHAPE = re.compile(r"(s?(ua)+)?")


def brute(codes):
    """Cheapest (cost, audit): all edits tried, cheapest and then ASCII-least first, kept only while the roles may still fit."""
    rows = [codes[i:i + 2] for i in range(0, len(codes), 2)]
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(rows) and SHAPE.fullmatch(roles):
            return cost, audit
        if (audit, at) in seen or len(roles) > len(rows) + 4 or not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        seen.add((audit, at))
        for x in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", at, roles + x))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles))
            if fault not in "bd":
                more = 3 if fault == "t" else 0
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + initial))
                for x in "ua":
                    heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, roles + x))
    raise AssertionError


def test_cheapest_edits_by_brute_force():
    dice = random.Random(5)
    for n in range(0, 7):
        for _ in range(60 if n else 1):
            codes = "".join(dice.choice("suax" if dice.random() < 0.3 else "ua") + dice.choice("bdt-----") for _ in range(n))
            assert repair.cheapest(codes) == brute(codes), codes
    cost, audit = repair.cheapest("u-a-" * 1500 + "a-")
    assert (cost, audit) == (3, "K" * 3000 + "IK")


ROWS = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes"), (1, 2, "assistant", "Yes"), (1, None, None, None), (2, 5, "user", " \t\n"), (2, 9, "tool", "x."),
        (None, 1, "user", "Who?"), (None, 2, "assistant", "I."), (3, 0, "user", "a" * 70_000 + "!\n "), (4, None, "assistant", "Ça!")]


def report(rows):
    out = {}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        codes, seen, illegal = "", set(), 0
        for _, role, text in turns:
            tail = text.strip(" \t\n\v\f\r")
            fault = "b" if not tail else "d" if (role, text) in seen else "t" if tail[-1] not in ".!?" else "-"
            seen.add((role, text))
            codes += (role[:1] if role[:1] in ("s", "u", "a") else "x") + fault
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = brute(codes)
        lines, at, roles = [], 0, ""
        for i, letter in enumerate(audit):
            if letter == "D":
                at += 1
                continue
            initial = turns[at][1][0] if letter == "K" else "a" if roles[-1:] == "u" else "u"
            roles += initial
            named = turns[at][1] if letter == "K" else {"u": "user", "a": "assistant"}[initial]
            lines.append(f"{named}:" + ("" if letter == "I" else turns[at][2]))
            at += letter != "I"
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *(codes[1::2].count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_report_of_nulls_ties_and_repeats(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, pos string, fault int").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_report(df, df).collect()}
    assert got == report(ROWS)
    whole = df.selectExpr("conv_id").union(spark.range(70, 71).selectExpr("id"))
    assert {r.conv_id: r.audit for r in repair.repair_report(df.where("conv_id = 3"), whole).collect()}[70] == ""
    assert repair.repair_report(df.where("false"), df.where("false")).count() == 0
    turns = repair.repaired_turns(*(lambda f: (f, repair.plan_repairs(f)))(repair.with_faults(df))).where("conv_id = 2").orderBy("pos", "k").collect()
    assert [(t.role, t.text) for t in turns] == []


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(12) for t in (0, 1, 2, None)]
    got = sorted(map(repr, (tuple(r) for r in repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())))
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want += [repr(row)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want)
