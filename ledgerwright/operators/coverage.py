"""Audit of how completely the order history was covered, over append-only tables of scanned pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import schema

SESSION = ["account_id", "session_id"]


def page_fingerprint(pages: DataFrame) -> DataFrame:
    """Adds fingerprint: the sorted distinct order ids (or those of the links) joined by '|'; '' without any."""
    ids = F.when(F.size("order_ids") > 0, F.col("order_ids")).otherwise(F.coalesce("detail_link_ids", F.array().cast("array<string>")))
    return pages.withColumn("fingerprint", F.array_join(F.sort_array(F.array_distinct(ids)), "|"))


def page_progress(pages: DataFrame) -> DataFrame:
    """Adds advanced: both this page and the one before in its session show orders, and different ones."""
    fp = page_fingerprint(pages)
    before = F.lag("fingerprint").over(W.partitionBy(*SESSION).orderBy("seq"))
    return fp.withColumn("advanced", F.coalesce((F.col("fingerprint") != "") & (before != "") & (before != F.col("fingerprint")), F.lit(False)))


def page_key() -> Column:
    return F.concat_ws(":", F.col("session_id").cast("string"), F.col("year").cast("string"), F.col("page").cast("string"))


def overlap_hits(pages: DataFrame, examples: int = schema.MAX_EXAMPLES) -> DataFrame:
    """Order ids seen on a page other than the one that showed them first: account_id, order_id, first_page, again_page, seq.

    A rescan of the same page isn't an overlap. n_hits counts them all for the account; the `examples` earliest are listed.
    """
    seen = pages.select("account_id", "session_id", "seq", page_key().alias("page_key"), F.explode(F.array_distinct("order_ids")).alias("order_id"))
    first = F.first_value("page_key").over(W.partitionBy("account_id", "order_id").orderBy("session_id", "seq"))
    hits = seen.withColumn("first_page", first).where("page_key <> first_page")
    n = hits.groupBy("account_id").agg(F.count("*").alias("n_hits"))
    w = W.partitionBy("account_id").orderBy("session_id", "seq", "order_id")
    top = hits.withColumn("k", F.row_number().over(w)).where(F.col("k") <= examples)
    return top.join(n, "account_id").select("account_id", "order_id", "first_page", F.col("page_key").alias("again_page"), "session_id", "seq", "n_hits")


def missing_detail_links(pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Visible order ids without a detail link on any page, without a stored one, and not terminal."""
    ids = lambda c: pages.select("account_id", F.explode(c).alias("order_id")).distinct()
    stored = ledger.where("order_details_url IS NOT NULL OR terminal_cancelled").select("account_id", "order_id").distinct()
    covered = ids("detail_link_ids").unionByName(ids("terminal_ids")).unionByName(stored)
    return ids("order_ids").join(covered, ["account_id", "order_id"], "left_anti")


def completed_orders(details: DataFrame, pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Order ids that are done, each once: detail captures that completed, terminal ones on pages, complete ones in the ledger that pages show."""
    shown = pages.select("account_id", F.explode("order_ids").alias("order_id")).distinct()
    done = details.where("complete").select("account_id", "order_id")
    ended = pages.select("account_id", F.explode("terminal_ids").alias("order_id"))
    adopted = ledger.where("order_data_complete OR terminal_cancelled").select("account_id", "order_id").join(shown, ["account_id", "order_id"], "left_semi")
    return done.unionByName(ended).unionByName(adopted).distinct()


def page_completion(pages: DataFrame, completed: DataFrame) -> DataFrame:
    """Per page: number of its orders, how many are done, and whether all are."""
    keys = ["account_id", "session_id", "year", "page"]
    ids = pages.select(*keys, F.explode("order_ids").alias("order_id")).distinct()
    j = ids.join(completed.select("account_id", "order_id", F.lit(1).alias("done")), ["account_id", "order_id"], "left")
    return j.groupBy(*keys).agg(F.count("*").alias("n_orders"), F.count("done").alias("n_done"), (F.count("*") == F.count("done")).alias("page_done"))


def refresh_due(ledger: DataFrame, returns: DataFrame, now: str) -> DataFrame:
    """Orders to scan again as of the literal `now`: incomplete ones, and complete ones older than 7 days, or 24 hours with a return."""
    back = returns.select("account_id", "order_id").distinct().withColumn("has_return", F.lit(True))
    j = ledger.join(back, ["account_id", "order_id"], "left").withColumn("has_return", F.coalesce("has_return", F.lit(False)))
    age = F.when(F.col("has_return"), F.expr(f"INTERVAL {schema.REFRESH_HOURS_RETURN_ORDER} HOURS")).otherwise(F.expr(f"INTERVAL {24 * schema.REFRESH_DAYS_ORDER} HOURS"))
    due = F.when(~F.coalesce("order_data_complete", F.lit(False)), "incomplete").when(F.col("last_scanned_at") + age <= F.lit(now).cast("timestamp"), "stale")
    return j.withColumn("reason", due).where("reason IS NOT NULL").select("account_id", "order_id", "has_return", "reason")


def pages_due(pages: DataFrame, now: str, hours: int = schema.REFRESH_HOURS_HISTORY) -> DataFrame:
    """History (24 h) or return pages (6 h) whose newest capture is older than `hours`."""
    newest = pages.groupBy("account_id", "year", "page").agg(F.max("captured_at").alias("captured_at"))
    return newest.where(F.col("captured_at") + F.expr(f"INTERVAL {int(hours)} HOURS") <= F.lit(now).cast("timestamp"))


def work_list(candidates: DataFrame, active: DataFrame, recent: DataFrame) -> DataFrame:
    """Jobs to do, once a job key: neither open nor recently done; smallest priority number, then oldest request first."""
    key = F.concat_ws(":", "type", F.coalesce("order_id", "url"))
    keyed = candidates.withColumn("job_key", key)
    w = W.partitionBy("account_id", "job_key").orderBy("priority", "queued_at", F.coalesce("order_id", "url"))
    once = keyed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    busy = active.select("account_id", "job_key").unionByName(recent.select("account_id", "job_key")).distinct()
    return once.join(busy, ["account_id", "job_key"], "left_anti").orderBy("account_id", "priority", "queued_at", "job_key")


def session_refresh_set(pages: DataFrame, completed: DataFrame) -> DataFrame:
    """Orders already complete, once for each session that shows them."""
    shown = pages.select(*SESSION, F.explode("order_ids").alias("order_id")).distinct()
    return shown.join(completed.select("account_id", "order_id"), ["account_id", "order_id"], "left_semi").select(*SESSION, "order_id")


def year_status(years: DataFrame, current_year: Column | None = None) -> DataFrame:
    """Per account: current year, the newest discovered year below it that isn't completed, and whether none is left."""
    cur = F.coalesce(current_year if current_year is not None else F.col("current_year"), F.lit(9999))
    by = years.groupBy("account_id").agg(F.max(F.when((F.col("year") < cur) & ~F.col("completed"), F.col("year"))).alias("next_year"), F.count("*").alias("n_years"), F.count_if("completed").alias("n_completed"))
    return by.withColumn("done", F.col("next_year").isNull())


def deepest_frontier(pages: DataFrame) -> DataFrame:
    """Per account the oldest year reached and the largest page of it."""
    g = pages.groupBy("account_id").agg(F.min(F.struct("year", (-F.col("page")).alias("p"))).alias("m"))
    return g.select("account_id", F.col("m.year").alias("year"), (-F.col("m.p")).alias("page"))


def newest_keys(df: DataFrame, n: int, order: list[Column], by: str = "account_id") -> DataFrame:
    """The newest n rows of each account; Spark limits each task's rows before the shuffle."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def recent_keys(keys: DataFrame, n: int = schema.MAX_KEYS) -> DataFrame:
    return newest_keys(keys, n, [F.col("at").desc(), F.col("job_key")])


def crawl_counters(attempts: DataFrame) -> DataFrame:
    """Per account and year: attempts by type, errors, rate-limited ones."""
    kinds = ["history", "detail", "return"]
    return attempts.groupBy("account_id", "year").agg(
        *[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds], F.count_if(F.col("outcome") == "error").alias("n_errors"), F.count_if(F.col("outcome") == "rate_limited").alias("n_rate_limited"))


def pending_seed(ledger: DataFrame, returns: DataFrame) -> DataFrame:
    """Jobs for what the ledger lacks: detail pages of incomplete orders with a link, status pages of returns."""
    d = ledger.where("NOT coalesce(order_data_complete, false) AND order_details_url IS NOT NULL").select("account_id", F.lit("detail").alias("type"), "order_id", F.col("order_details_url").alias("url"))
    r = returns.where("return_status_url IS NOT NULL").select("account_id", F.lit("return").alias("type"), "order_id", F.col("return_status_url").alias("url"))
    return d.unionByName(r).distinct()
