"""Chat formatting by prefix-target expansion.

A turn is written `### role: text</turn>` and a line break. Control strings and backslashes inside roles and texts
are broken up by backslashes, so a formatted example can always be parsed back. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "### ", "</turn>\n"
#: role up to the first colon without a backslash before it; then the text
_HEAD = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): (.*)$"


def escape(text: Column) -> Column:
    """Doubles backslashes, turns `### ` into `#\\## ` and `</turn>` into `<\\/turn>`."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"#(?=## )|<(?=/turn>)", r"$0\\")


def unescape(text: Column) -> Column:
    """Exact inverse of escape(): a backslash stands before every character that must be taken as it is."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_prefix_targets(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """One example for every turn of role `target`: all turns up to it, with only this reply trainable.

    Returns conv_col, target_no int (from 1, by order in the conversation), n_turns int (turns in the example),
    formatted string, loss_start int and loss_chars int (code points of the escaped reply in `formatted`, its
    closing mark not included), complete boolean (the example holds the whole conversation). A conversation that
    doesn't end with a target turn gives one more example with all its turns, loss_chars 0 and target_no null,
    so no turn is lost. Turns are ordered by (turn, role, text), nulls first; null roles and texts are empty; rows
    with a null conversation id form a conversation. Repeated rows are repeated turns. An empty table gives none.
    Only the four named columns are read, so other columns may be called anything.
    A conversation is one value by nature: each of its examples holds all that precedes. Its rows meet in one group.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    head = F.concat(F.lit(OPEN), F.regexp_replace(escape(role), ":", r"\\:"), F.lit(": "))
    body = escape(text)
    turns = df.select(
        F.col(conv_col).alias("__conv"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.length(head).alias("skip"), F.length(body).alias("size"), F.concat(head, body, F.lit(CLOSE)).alias("out")).alias("t"),
    )
    whole = turns.groupBy("__conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    picked = F.filter(F.transform("ts", lambda t, i: F.struct((i + 1).alias("k"), t["role"].alias("role"))), lambda x: x["role"] == target)
    listed = whole.select("__conv", "ts", F.transform(picked, lambda x, i: F.struct((i + 1).alias("target_no"), x["k"].cast("int").alias("k"))).alias("picks"))
    ends = F.when(F.coalesce(F.try_element_at("picks", F.lit(-1))["k"], F.lit(0)) < n, F.array(F.struct(F.lit(None).cast("int").alias("target_no"), n.alias("k"))))
    each = listed.withColumn("p", F.explode(F.concat("picks", F.coalesce(ends, F.slice("picks", 1, 0)))))
    formatted = F.array_join(F.transform(F.slice("ts", F.lit(1), F.col("p.k")), lambda t: t["out"]), "")
    last = F.element_at("ts", F.col("p.k"))
    trains = F.col("p.target_no").isNotNull()
    made = each.select("__conv", F.col("p.target_no").alias("target_no"), F.col("p.k").alias("n_turns"), formatted.alias("formatted"), last["skip"].alias("skip"), last["size"].alias("size"), trains.alias("trains"), (F.col("p.k") == n).alias("complete"))
    before = F.length("formatted") - F.col("size") - len(CLOSE)
    return made.select(
        F.col("__conv").alias(conv_col), "target_no", "n_turns", "formatted",
        F.when(F.col("trains"), before).otherwise(F.length("formatted")).cast("int").alias("loss_start"),
        F.when(F.col("trains"), F.col("size")).otherwise(0).cast("int").alias("loss_chars"), "complete",
    )


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted example."""
    pieces = F.filter(F.split(formatted, r"</turn>\n"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, _HEAD, 1)).alias("role"), unescape(F.regexp_extract(p, _HEAD, 2)).alias("text")))


def loss_text(formatted: Column, loss_start: Column, loss_chars: Column) -> Column:
    """Unescaped text under the loss mask."""
    return unescape(F.substring(formatted, loss_start + 1, loss_chars))


def conversation_digests(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples."""
    back = parse_turns(F.col("formatted"))
    rows = examples.select(
        F.col(conv_col).alias("__conv"), "target_no", F.length("formatted").cast("long").alias("size"),
        F.when(F.col("complete"), back).alias("turns"),
        F.when(F.col("target_no").isNotNull(), loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))).alias("reply"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select("__conv", "target_no", "size", "reply", F.size("turns").alias("k"), F.when(F.col("turns").isNotNull(), F.sha2(lines, 256)).alias("sha"))
    by = rows.groupBy("__conv").agg(
        F.max("k").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sum("size").alias("formatted_chars"), F.count("*").alias("n_examples"),
        F.sort_array(F.collect_list(F.when(F.col("target_no").isNotNull(), F.struct("target_no", "reply")))).alias("replies"),
    )
    joined = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    by = by.withColumn("loss", joined)
    return by.select(F.col("__conv").alias(conv_col), "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars", "n_examples")
