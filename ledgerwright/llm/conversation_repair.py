"""Conversation structure repair: the cheapest edits that give every conversation the shape system?, (user, assistant)*.

Faults are found with windows. A conversation then is a short string of two letters a row, and the cheapest edits are the
least whole number of an ordinary shortest-path recursion: its high digits are the cost, its low digits the edits' letters, the
first edit highest, with zeros behind the last, so that one comparison of numbers settles cost and ties alike.

Cases: null conversations, turns, roles and texts: a null conversation is one of its own, null turns come first, null roles
and texts count as one space; rows of one turn are taken by role, then text; repeated rows are duplicates; an empty table
gives empty results; other columns aren't read, whatever their names. The numbers have 9 bits a row, so time grows with
the square of a conversation's rows: a second at 20,000 rows. Texts never reach Python at once: they are hashed row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Edits in ASCII order; their digits are 1 to 4 and 0 ends an audit.
LETTERS = "DIKR"
DIGIT_BITS = 3
#: What the roles so far allow next: nothing yet, a system turn, an open user turn, an answered one.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = ["u", "u", "a", "u"]
NO_BLANK = r"[^\x20\x09-\x0D]"


@lru_cache(65_536)
def cheapest(codes: str) -> tuple[int, str]:
    """(cost, audit) for rows given as role initial (s, u, a or x) and fault (b, d, t or -), two letters each."""
    rows = [codes[i:i + 2] for i in range(0, len(codes), 2)]
    width = DIGIT_BITS * (3 * len(rows) + 2)  # a letter a row, and never more than two inserts before one or at the end
    low, top = (1 << width) - 1, width - DIGIT_BITS

    def edit(letter: str, cost: int, rest: int) -> int:
        """The number of an edit followed by those of `rest`."""
        tail = rest & low
        return (rest - tail) + (cost << width) + (LETTERS.index(letter) + 1 << top) + (tail >> DIGIT_BITS)

    def with_inserts(direct: list[int | None]) -> list[int]:
        """Each state's least number when turns may be inserted first: after two of them the same states follow again."""
        found = []
        for state in range(4):
            options, at = [], state
            for inserts in range(3):
                value = direct[at]
                if value is not None:
                    for _ in range(inserts):
                        value = edit("I", INSERT, value)
                    options.append(value)
                at = NEXT[at, WANTED[at]]
            found.append(min(options))
        return found

    best = with_inserts([0, None, None, 0])
    for initial, fault in reversed(rows):
        direct = []
        for state in range(4):
            options = [edit("D", DELETE, best[state])]
            if fault not in "bd":
                extra = TRUNCATED if fault == "t" else 0
                if (state, initial) in NEXT:
                    options.append(edit("K", KEEP + extra, best[NEXT[state, initial]]))
                options.append(edit("R", REROLE + extra, best[NEXT[state, WANTED[state]]]))
            direct.append(min(options))
        best = with_inserts(direct)
    number, audit = best[START], []
    for at in range(top, -1, -DIGIT_BITS):
        digit = number >> at & (1 << DIGIT_BITS) - 1
        if not digit:
            break
        audit.append(LETTERS[digit - 1])
    return number >> width, "".join(audit)


def laid_out(codes: str, audit: str) -> tuple[list[str], list[str]]:
    """Per row, and once more behind the last: initials of the turns inserted before it; and k, u, a or nothing for the row itself."""
    before, own, state, inserted = [], [], START, ""
    for letter in audit:
        initial = codes[2 * len(own)] if letter == "K" else WANTED[state]
        if letter == "I":
            inserted += initial
        else:
            before.append(inserted)
            own.append({"K": "k", "R": initial, "D": ""}[letter])
            inserted = ""
        if letter != "D":
            state = NEXT[state, initial]
    return [*before, inserted], [*own, ""]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with deterministic damage by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 removes
    its closing signs, 3 repeats it, 4 makes it a user's. Nulls count as one space there."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(spaced("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    struck = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    return struck.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, pos (from 1), initial, fault (b, d, t or -) and illegal (its role can't follow the one before)."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    w = W.partitionBy("conv_id")
    placed = rows.select("conv_id", "turn", spaced("role"), spaced("text")).withColumn("pos", F.row_number().over(w.orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    earlier = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    ends = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(NO_BLANK), "b").when(earlier, "d").when(~ends.isin(".", "!", "?"), "t").otherwise("-")
    first = F.substring("role", 1, 1)
    pair = F.concat(F.lag(first).over(w.orderBy("pos")), first)
    return placed.withColumns({"initial": F.when(first.isin("s", "u", "a"), first).otherwise("x"), "fault": fault, "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))})


def plan_repairs(faulty: DataFrame) -> DataFrame:
    """Per conversation of with_faults(): cost, audit, and per row what to insert before it and what becomes of it."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("initial", "fault").alias("code")))), lambda x: x["code"])
    codes = faulty.groupBy("conv_id").agg(F.array_join(listed, "").alias("codes"))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1).to_pylist()
            found = [cheapest(c) for c in given]
            spread = [laid_out(c, audit) for c, (_, audit) in zip(given, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string()),
                 pa.array([b for b, _ in spread], pa.list_(pa.string())), pa.array([o for _, o in spread], pa.list_(pa.string()))],
                ["conv_id", "cost", "audit", "before", "own"])

    kind = faulty.schema["conv_id"].dataType.simpleString()
    return codes.mapInArrow(repair, f"conv_id {kind}, cost long, audit string, before array<string>, own array<string>")


def repaired_turns(faulty: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, pos and k (their order within a conversation), role, text."""
    edits = plans.select("conv_id", F.posexplode(F.arrays_zip("before", "own")).alias("at", "e")).select("conv_id", (F.col("at") + 1).alias("pos"), "e.before", "e.own")
    f, e = faulty.alias("f"), edits.alias("e")
    joined = e.join(f, F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("e.pos") == F.col("f.pos")), "left")

    def named(initial: Column) -> Column:
        return F.when(initial == "u", "user").otherwise("assistant")

    made = F.transform(F.filter(F.split("e.before", ""), lambda x: x != ""), lambda x: F.struct(named(x).alias("role"), F.lit("").alias("text")))
    role = F.when(F.col("e.own") == "k", F.col("f.role")).otherwise(named(F.col("e.own")))
    kept = F.when(F.col("e.own") != "", F.array(F.struct(role.alias("role"), F.coalesce("f.text", F.lit("")).alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return joined.select("e.conv_id", "e.pos", F.posexplode(F.concat(made, kept)).alias("k", "t")).select("conv_id", "pos", "k", "t.role", "t.text")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its role:text lines, joined by newlines. Rows stream through sorted; no conversation is gathered."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, open_, key, sum_ = None, False, None, None

        def out(keys: list, sums: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(sums, pa.string())], ["conv_id", "repaired_sha256"])

        for batch in batches:
            kind, keys, sums = batch.schema.field(0).type, [], []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if open_ and conv == key:
                    sum_.update(b"\n")
                else:
                    if open_:
                        keys.append(key)
                        sums.append(sum_.hexdigest())
                    open_, key, sum_ = True, conv, hashlib.sha256()
                sum_.update(line.encode())
            yield out(keys, sums)
        if open_:
            yield out([key], [sum_.hexdigest()])

    lines = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "k").select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    return lines.mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string")


def repair_report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row a conversation of `conversations` (a table with conv_id): faults of its `rows`, cost and edits of the repair, digest of the result.

    A conversation without rows has zeros, an empty audit and the digest of the empty text.
    """
    faulty = staged(with_faults(rows))
    plans = staged(plan_repairs(faulty))
    sums = digests(repaired_turns(faulty, plans))
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    of = lambda kind: F.count_if(F.col("fault") == kind)
    counts = faulty.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"), of("b").alias("blank"), of("d").alias("duplicate"), of("t").alias("truncated"), F.count_if("illegal").alias("illegal"))
    out = conversations.select("conv_id").distinct().alias("c")
    for name, part in {"n": counts, "p": plans.select("conv_id", "cost", "audit"), "h": sums}.items():
        out = out.join(part.alias(name), F.col("c.conv_id").eqNullSafe(F.col(f"{name}.conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "c.conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
