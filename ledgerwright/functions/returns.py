"""Meaning of a return record: stage, progress, bank evidence, review rules. Each takes a DataFrame and adds columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import schema, text

REF_TIME = "23:59:59"


def stage_column(stage: Column, status: Column, status_text: Column) -> Column:
    """Stage of a record: its own if it is a known name (old spelling unified), else by status, else by the words of its status text."""
    named = F.lower(stage)
    own = F.when(named == "refunded", "refund_issued").when(named.isin(schema.STAGE_NAMES), named)
    by_status = F.when(status == "refunded", "refund_issued").when(status == "returned_pending_refund", "received")
    words = F.concat_ws("\n", status_text, status)
    said = lambda p: words.rlike("(?im)" + p)
    by_text = (
        F.when(said(text.CREDITED), "credited").when(said(text.ISSUED), "refund_issued").when(said(text.RECEIVED), "received")
        .when(said(text.SHIPPED) & ~said(text.SHIPPED_LATER), "shipped").when(said(text.STARTED), "started"))
    return F.coalesce(own, by_status, by_text, F.lit("unknown"))


def with_stage(df: DataFrame) -> DataFrame:
    """Adds stage and rank from return_stage, status, status_text."""
    return df.withColumn("stage", stage_column(F.col("return_stage"), F.col("status"), F.col("status_text"))).withColumn("rank", schema.stage_rank(F.col("stage")))


def return_progress(df: DataFrame) -> DataFrame:
    """Adds percent int and done_started .. done_credited; bank evidence never moves them."""
    percent = F.get(F.array(*map(F.lit, schema.STAGE_PERCENT)), F.col("rank"))
    return df.withColumns({"percent": percent, **{f"done_{n}": F.col("rank") >= k for k, n in enumerate(schema.STAGE_NAMES) if k}})


def parse_loose_date(value: Column, ref_year: int) -> Column:
    """'Sep 7', 'Sep 7, 2026' (end of that day; the reference year if none is written) or any ISO form; else null."""
    short = F.regexp_replace(F.initcap(F.trim(value)), r"^([A-Za-z]{3})[a-z]*\.?\s+", "$1 ")
    dated = F.when(short.rlike(r"^[A-Z][a-z]{2} \d{1,2}$"), F.concat(short, F.lit(f", {ref_year}"))).otherwise(F.regexp_replace(short, r",\s*", ", "))
    day = F.try_to_timestamp(F.when(dated.rlike(r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"), F.concat(dated, F.lit(" " + REF_TIME))), F.lit("MMM d, yyyy HH:mm:ss"))
    return F.coalesce(day, value.try_cast("timestamp"))


def with_issue_date(returns: DataFrame, ref_year: int) -> DataFrame:
    """Adds refund_issued_at from the milestones, where there is none: the date of the issued step, as parse_loose_date reads it."""
    said = parse_loose_date(F.col("return_milestones.refund_issued.date"), ref_year)
    known = F.col("refund_issued_at").cast("timestamp") if "refund_issued_at" in returns.columns else F.lit(None).cast("timestamp")
    return returns.withColumn("refund_issued_at", F.coalesce(known, said))


def bank_columns(df: DataFrame) -> DataFrame:
    """Adds bank_confirmed, credit_confirmed, bank_conflict from rank, bank_status, manual_state.

    Reconciled by hand counts as confirmed; a confirmation before the shop has issued the refund is a conflict.
    """
    confirmed = F.coalesce(F.col("manual_state") == "reconciled", F.lit(False)) | F.coalesce(F.col("bank_status") == "confirmed", F.lit(False))
    return df.withColumns({"bank_confirmed": confirmed, "credit_confirmed": confirmed | (F.col("rank") >= 5), "bank_conflict": confirmed & (F.col("rank") < 4)})


def needs_credit_review(df: DataFrame, now: str) -> DataFrame:
    """Adds credit_review: whether a return waits for its credit without an explanation, as of the literal `now`.

    Rules in order: identity conflict yes; reconciled by hand no; bank conflict yes; credited or confirmed by the bank no;
    refund not issued yes; bank ambiguous or to be reviewed yes; no expected date no; else whether a day has passed
    since the expected date. Needs the columns of bank_columns(), bank_status, manual_state, identity_conflict, expected_credit_at.
    """
    late = F.lit(now).cast("timestamp") > F.col("expected_credit_at") + F.expr("INTERVAL 24 HOURS")
    rule = (
        F.when(F.coalesce("identity_conflict", F.lit(False)), True).when(F.col("manual_state") == "reconciled", False)
        .when(F.col("bank_conflict"), True).when(F.col("credit_confirmed"), False).when(F.col("rank") < 4, True)
        .when(F.col("bank_status").isin("ambiguous", "needs_review"), True).when(F.col("expected_credit_at").isNull(), False).otherwise(late))
    return df.withColumn("credit_review", rule)


def effective_state(df: DataFrame) -> DataFrame:
    """Adds effective_state: reconciled, credited, needs_review, refunded or purchase."""
    rule = (
        F.when(F.col("manual_state") == "reconciled", "reconciled").when(F.col("credit_confirmed"), "credited")
        .when(F.col("credit_review"), "needs_review").when(F.col("rank") >= 4, "refunded").otherwise("needs_review"))
    if "record_type" in df.columns:
        rule = F.when((F.col("record_type") == "order") & ~F.coalesce(F.col("manual_state") == "reconciled", F.lit(False)), "purchase").otherwise(rule)
    return df.withColumn("effective_state", rule)


def confirmed_returns(df: DataFrame) -> DataFrame:
    """Returns that the shop has received."""
    return df.where("rank >= 3")
