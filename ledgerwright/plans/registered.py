"""Registered queries of the ledger over the test tables, each with DuckDB SQL of its own making."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import returns as R, schema
from ..functions.arrays import array_union_ci
from ..operators import bank, coverage, merge, queries as Q, rows as B
from ..sources import io
from .adapters import spark_view
from .oracle import NOW, chain, label, rank as rank_sql, replacement_label

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is one."""
    def put(f):
        SPARK[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return put


def joined(df: DataFrame, *lists: str) -> DataFrame:
    """String arrays as text, since the comparison takes flat columns only."""
    return df.withColumns({c: F.array_join(c, "|") for c in lists})


# --- the order row ----------------------------------------------------------------------------------------------------


class Views:
    """Adapters and derived tables of one test directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.orders, self.items, self.returns = (spark_view(spark, sf_dir, f"v_{n}") for n in ("orders", "items", "returns"))

    @property
    def prepared(self) -> DataFrame:
        return B.prepared_returns(self.returns, NOW)

    @property
    def deduped(self) -> DataFrame:
        return B.dedupe_returns(self.prepared)

    @property
    def groups(self) -> DataFrame:
        return B.group_returns(self.deduped)

    @property
    def matches(self) -> DataFrame:
        return B.match_items_to_groups(self.items, self.groups)

    @property
    def rows(self) -> DataFrame:
        return B.order_rows(self.orders, self.returns, self.items, NOW)

    @property
    def used(self) -> DataFrame:
        return B.used_returns(self.orders, self.returns, NOW)


ROW_COLUMNS = [
    "account_id", "order_id", "data_complete", "cancelled", "processing_error", "purchase_cents", "card_last4", "n_groups", "n_unmatched", "n_items", "n_returned_items",
    "n_replacements", "replacement_stage", "refund_cents", "returns_cents", "review_cents", "amount_mismatch", "identity_conflict", "amount_conflict", "bank_conflict",
    "strong_unmatched", "any_review", "all_issued", "all_credited", "all_bank_confirmed", "reconciled", "low_rank", "high_rank", "order_year", "sort_at", "needs_review", "state", "label"]
_ROWS = ", ".join(ROW_COLUMNS)
_KEYS = "account_id, order_id, state, refund_cents"


def short(df: DataFrame) -> DataFrame:
    return df.select("account_id", "order_id", "state", "refund_cents")


@query(chain(f"SELECT {_ROWS} FROM orows"))
def order_rows(s, d):
    return Views(s, d).rows.select(*ROW_COLUMNS)


@query(chain("SELECT order_id, record_id, purchase_cents, last_scanned_at, detail_scan_complete FROM cur"))
def current_orders(s, d):
    return B.current_orders(Views(s, d).orders).select("order_id", "record_id", "purchase_cents", "last_scanned_at", "detail_scan_complete")


@query(chain("SELECT order_id, record_id, identity, rank, last_scanned_at FROM ded"))
def dedupe_returns(s, d):
    return Views(s, d).deduped.select("order_id", "record_id", "identity", "rank", "last_scanned_at")


_USED = ["account_id", "order_id", "record_id", "rank", "credit_review"]


@query(chain(f"SELECT {', '.join(_USED)} FROM used"))
def used_returns(s, d):
    return Views(s, d).used.select(*_USED)


_GROUP = [
    "account_id", "order_id", "group_key", "n_records", "record_id", "stage", "rank", "bank_status", "manual_state", "expected_credit_at", "item_names", "asins", "identity_conflict",
    "bank_conflict", "credit_review", "reconciled", "all_confirmed", "all_bank_confirmed", "authoritative", "low_rank", "last_scanned_at"]
_LISTS = ("item_names", "asins")


@query(chain(f"SELECT {', '.join(f'''array_to_string({c}, '|') AS {c}''' if c in _LISTS else c for c in _GROUP)} FROM dgrp"))
def group_returns(s, d):
    return joined(Views(s, d).groups.select(*_GROUP), *_LISTS)


@query(chain("SELECT order_id, group_key, amount_cents, amount_conflict, flagged_cents FROM dgrp"))
def group_refund_amount(s, d):
    return Views(s, d).groups.select("order_id", "group_key", "amount_cents", "amount_conflict", "flagged_cents")


@query(chain("SELECT order_id, group_key, record_id, rank FROM dgrp"))
def group_representative(s, d):
    return Views(s, d).groups.select("order_id", "group_key", "record_id", "rank")


@query(chain("SELECT order_id, group_key, item_key, score FROM dmatched"))
def match_items(s, d):
    return Views(s, d).matches.select("order_id", "group_key", "item_key", "score")


@query(chain("SELECT order_id, group_key, strong_identity FROM dunmatched"))
def unmatched_groups(s, d):
    v = Views(s, d)
    return B.unmatched_groups(v.groups, v.matches).select("order_id", "group_key", "strong_identity")


_STATES = "order_id, item_key, n_groups, best_rank, returned_products"


@query(chain(f"SELECT {_STATES} FROM dstates"))
def item_states(s, d):
    v = Views(s, d)
    return B.item_states(v.items, v.groups, v.matches).select(*_STATES.split(", "))


@query(chain(f"""
SELECT order_id, item_key, item_name, CASE WHEN w = '' THEN 'Not returned' ELSE w END AS workflow FROM (
  SELECT *, concat_ws(' · ', {replacement_label('replacement_stage')},
    CASE WHEN n_groups > 0 THEN CASE WHEN n_groups > 1 THEN n_groups || ' returns · ' ELSE '' END || {label('best_rank')} END) AS w FROM dstates) q"""))
def product_status(s, d):
    v = Views(s, d)
    return Q.product_status_table(B.item_states(v.items, v.groups, v.matches)).drop("account_id")


@query(chain("SELECT order_id, n_replacements, replacement_stage FROM repl"))
def replacement_rollup(s, d):
    return B.replacement_rollup(Views(s, d).items).drop("account_id")


@query(chain("SELECT order_id, needs_review, any_review, amount_mismatch, strong_unmatched FROM orows WHERE n_groups > 0"))
def needs_review(s, d):
    return Views(s, d).rows.where("n_groups > 0").select("order_id", "needs_review", "any_review", "amount_mismatch", "strong_unmatched")


@query(chain("SELECT order_id, state, label FROM orows"))
def state_label(s, d):
    return Views(s, d).rows.select("order_id", "state", "label")


@query(chain("SELECT order_id, all_issued, all_credited, any_review, reconciled FROM orows WHERE n_groups > 0"))
def return_predicates(s, d):
    return Views(s, d).rows.where("n_groups > 0").select("order_id", "all_issued", "all_credited", "any_review", "reconciled")


@query(chain("SELECT order_id, refund_cents, amount_mismatch FROM orows WHERE n_groups > 0 OR refund_cents IS NOT NULL"))
def refund_rollup(s, d):
    return Views(s, d).rows.where("n_groups > 0 OR refund_cents IS NOT NULL").select("order_id", "refund_cents", "amount_mismatch")


@query(chain("""
SELECT order_id, group_key, step, CASE step WHEN 1 THEN 'started' WHEN 2 THEN 'shipped' WHEN 3 THEN 'received' WHEN 4 THEN 'refund_issued' ELSE 'credited' END AS name, nullif(trim(step_dates[step]), '') AS date,
  CASE WHEN step = 5 AND rank < 5 AND expected_credit_at IS NOT NULL THEN strftime(expected_credit_at, 'Expected %Y-%m-%d') WHEN step = 1 THEN 'Initiated' WHEN step = 2 THEN 'Dropped off' WHEN step = 3 THEN 'Return received' WHEN step = 4 THEN 'Refund issued' ELSE 'Refund credited' END AS label, step <= rank AS done,
  CASE WHEN step = 5 AND rank < 5 THEN expected_credit_at END AS expected_at, CASE WHEN step = 5 THEN bank_status END AS bank_status
FROM dgrp, (VALUES (1), (2), (3), (4), (5)) AS t(step)"""))
def lifecycle_steps(s, d):
    return B.lifecycle_steps(Views(s, d).groups).drop("account_id")


_DESCRIBED = ["order_id", *B.ROW_DESCRIPTORS]


@query(chain(f"SELECT {', '.join(_DESCRIBED)} FROM orows"))
def row_descriptors(s, d):
    return joined(B.row_descriptors(Views(s, d).rows).select(*_DESCRIBED), "item_names", "returned_names", "asins")


# --- questions of order rows --------------------------------------------------------------------------------------------


@query(chain(f"SELECT {_KEYS} FROM orows WHERE data_complete AND n_groups > 0"))
def view_returns(s, d):
    return short(Q.view(Views(s, d).rows, "returns"))


@query(chain(f"SELECT {_KEYS} FROM orows WHERE data_complete AND needs_review"))
def view_needs_review(s, d):
    return short(Q.view(Views(s, d).rows, "needs_review"))


@query(chain(f"SELECT {_KEYS} FROM orows WHERE processing_error IS NOT NULL"))
def view_errors(s, d):
    return short(Q.view(Views(s, d).rows, "errors"))


_FILTERS = ["all", "no_return", "needs_review", "replacement", "cancelled", *schema.STATUS_FILTERS]


@query(chain("""
SELECT value, order_id FROM orows, (VALUES ('all'), ('no_return'), ('needs_review'), ('replacement'), ('cancelled'), ('return_started'), ('dropped_off'),
  ('return_received'), ('refund_issued'), ('refund_credited')) AS f(value)
WHERE CASE value WHEN 'all' THEN true WHEN 'no_return' THEN data_complete AND n_groups = 0 AND NOT cancelled WHEN 'needs_review' THEN needs_review
  WHEN 'replacement' THEN n_replacements > 0 WHEN 'cancelled' THEN cancelled WHEN 'return_started' THEN list_contains(ranks, 1) WHEN 'dropped_off' THEN list_contains(ranks, 2)
  WHEN 'return_received' THEN list_contains(ranks, 3) WHEN 'refund_issued' THEN list_contains(ranks, 4) ELSE list_contains(ranks, 5) END"""))
def filter_status(s, d):
    """All ten filters in one pass over the rows."""
    held = F.array(*[F.when(Q.status_condition(v), v) for v in _FILTERS])
    return Views(s, d).rows.select("order_id", F.explode(held).alias("value")).where("value IS NOT NULL").select("value", "order_id")


@query(chain(f"SELECT {_KEYS} FROM orows WHERE order_year = 1995 AND card_last4 = '0004'"))
def filter_year_card(s, d):
    return short(Q.filter_year_card(Views(s, d).rows, 1995, "0004"))


@query(chain("SELECT DISTINCT order_year FROM orows WHERE order_year IS NOT NULL"))
def year_options(s, d):
    return Q.year_options(Views(s, d).rows)


@query(chain("SELECT DISTINCT card_last4 FROM orows WHERE card_last4 IS NOT NULL"))
def card_options(s, d):
    return Q.card_options(Views(s, d).rows)


_HAY = r"""lower(concat_ws(' ', order_id, replace(search_names, '|', ' '), replace(asins, '|', ' '), card_last4, label, shop_status, processing_error,
  regexp_replace(printf('%.2f', purchase_cents / 100), '\.?0+$', ''), regexp_replace(printf('%.2f', refund_cents / 100), '\.?0+$', '')))"""


def _search(text: str) -> str:
    return chain(f"SELECT {_KEYS} FROM orows WHERE contains({_HAY}, '{text}')")


@query(_search("shipped"))
def search(s, d):
    return short(Q.search(Views(s, d).rows, " SHIPPED "))


@query(_search("red widget"))
def search_names(s, d):
    return short(Q.search(Views(s, d).rows, "Red Widget"))


@query(_search("b0000001"))
def search_asins(s, d):
    return short(Q.search(Views(s, d).rows, "B0000001"))


@query(_search("return number 1"))
def search_status(s, d):
    return short(Q.search(Views(s, d).rows, "Return number 1"))


@query(_search("7.5"))
def search_money(s, d):
    return short(Q.search(Views(s, d).rows, "7.5"))


def _sorted(order: str) -> str:
    return chain(f"SELECT {_KEYS}, row_number() OVER (ORDER BY {order}) AS place FROM orows ORDER BY place LIMIT 100")


def _top(s, d, mode: str) -> DataFrame:
    """The first hundred rows of a sort, with their places."""
    top = short(Q.sort_rows(Views(s, d).rows, mode, 100)).agg(F.collect_list(F.struct("account_id", "order_id", "state", "refund_cents")).alias("r"))
    return top.select(F.posexplode("r").alias("k", "x")).select("x.*", (F.col("k") + 1).cast("long").alias("place"))


@query(_sorted("sort_at DESC NULLS LAST, order_id"))
def sort_newest_topk(s, d):
    return _top(s, d, "newest")


@query(_sorted("sort_at NULLS FIRST, order_id"))
def sort_oldest_topk(s, d):
    return _top(s, d, "oldest")


@query(_sorted("purchase_cents DESC NULLS LAST, order_id"))
def sort_order_high_topk(s, d):
    return _top(s, d, "order_high")


@query(_sorted("purchase_cents NULLS FIRST, order_id"))
def sort_order_low_topk(s, d):
    return _top(s, d, "order_low")


@query(_sorted("refund_cents DESC NULLS LAST, order_id"))
def sort_refund_high_topk(s, d):
    return _top(s, d, "refund_high")


@query(_sorted("refund_cents NULLS FIRST, order_id"))
def sort_refund_low_topk(s, d):
    return _top(s, d, "refund_low")


@query(_sorted("lower(label), order_id"))
def sort_status_topk(s, d):
    return _top(s, d, "status")


@query(_sorted("order_id"))
def sort_order_id_topk(s, d):
    return _top(s, d, "order_id")


@query(chain("""
SELECT count(*) FILTER (data_complete) AS n_orders, CAST(coalesce(sum(purchase_cents) FILTER (data_complete), 0) AS BIGINT) AS order_cents,
  count(*) FILTER (data_complete AND n_groups > 0) AS n_return_orders, CAST(coalesce(sum(refund_cents) FILTER (data_complete AND n_groups > 0), 0) AS BIGINT) AS expected_cents,
  count(*) FILTER (needs_review) AS n_review, CAST(coalesce(sum(review_cents) FILTER (needs_review), 0) AS BIGINT) AS review_cents, count(processing_error) AS n_errors,
  count(*) FILTER (data_complete AND n_groups > 0 AND all_issued) AS n_issued, count(*) FILTER (data_complete AND n_groups > 0 AND all_bank_confirmed) AS n_bank_credited
FROM orows"""))
def dashboard_stats(s, d):
    return Q.dashboard_stats(Views(s, d).rows)


@query(chain("SELECT order_id, review_cents FROM orows WHERE needs_review"))
def review_expected(s, d):
    return Q.review_expected(Views(s, d).rows).drop("account_id")


_SUMMARY = """SELECT (SELECT count(*) FROM (SELECT order_id FROM v_orders UNION SELECT order_id FROM prep) q) AS lifetime,
  (SELECT count(DISTINCT order_id) FROM v_orders WHERE detail_scan_complete) AS detailed, count(DISTINCT order_id) AS returned,
  count(DISTINCT order_id) FILTER (rank >= 3) AS confirmed, count(DISTINCT order_id) FILTER (rank >= 4) AS refunded,
  count(DISTINCT order_id) FILTER (credit_confirmed) AS credited, count(DISTINCT order_id) FILTER (NOT credit_confirmed) AS unresolved,
  (SELECT count(*) FROM v_orders) AS order_records, count(*) AS return_records FROM prep"""


@query(chain(_SUMMARY))
def ledger_summary(s, d):
    v = Views(s, d)
    return Q.ledger_summary(v.orders, v.prepared)


@query(chain("""
SELECT CAST((SELECT count(*) FROM (SELECT order_id FROM v_orders UNION SELECT order_id FROM prep) q)
    - (SELECT count(*) FROM (SELECT order_id FROM v_orders UNION SELECT order_id FROM prep WHERE authoritative) q) AS BIGINT) AS lifetime_delta,
  CAST(count(DISTINCT order_id) - count(DISTINCT order_id) FILTER (authoritative) AS BIGINT) AS returned_delta,
  CAST(count(DISTINCT order_id) FILTER (rank >= 4) - count(DISTINCT order_id) FILTER (rank >= 4 AND authoritative) AS BIGINT) AS refunded_delta,
  CAST(count(DISTINCT order_id) FILTER (credit_confirmed) - count(DISTINCT order_id) FILTER (credit_confirmed AND authoritative) AS BIGINT) AS credited_delta
FROM prep"""))
def summary_delta(s, d):
    v = Views(s, d)
    return Q.summary_delta(Q.ledger_summary(v.orders, v.prepared.where("authoritative")), Q.ledger_summary(v.orders, v.prepared))


@query(chain("""
SELECT count(*) AS n_all, CAST(coalesce(sum(purchase_cents), 0) AS BIGINT) AS all_cents, count(has) AS n_returns,
  CAST(coalesce(sum(coalesce(canonical_refund_cents, total)) FILTER (has), 0) AS BIGINT) AS return_cents,
  count(*) FILTER (review AND NOT by_hand) AS n_review, CAST(coalesce(sum(waiting) FILTER (review AND NOT by_hand), 0) AS BIGINT) AS review_cents
FROM (
  SELECT account_id, order_id, purchase_cents, canonical_refund_cents FROM v_orders
  QUALIFY row_number() OVER (PARTITION BY account_id, order_id ORDER BY detail_scan_complete DESC, last_scanned_at DESC, record_id) = 1) o
FULL OUTER JOIN (
  SELECT f.account_id, f.order_id, true AS has, bool_or(credit_review) AS review, bool_or(coalesce(manual_state = 'reconciled', false)) AS by_hand,
    sum(amount) FILTER (nth = 1) AS total, sum(amount) FILTER (credit_review AND flagged_nth = 1) AS waiting
  FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id, order_id, return_token ORDER BY amount IS NULL, last_scanned_at DESC, record_id DESC) AS nth,
      row_number() OVER (PARTITION BY account_id, order_id, return_token, credit_review ORDER BY amount IS NULL, last_scanned_at DESC, record_id DESC) AS flagged_nth
    FROM (SELECT *, coalesce(refund_cents, refund_subtotal_cents) AS amount FROM prep) p) f
  GROUP BY f.account_id, f.order_id) r ON o.account_id = r.account_id AND o.order_id = r.order_id"""))
def compact_summary(s, d):
    v = Views(s, d)
    return Q.compact_summary(v.orders, v.prepared)


@query(chain("""
SELECT record_id, rank, CAST(CASE rank WHEN 0 THEN 0 WHEN 1 THEN 20 WHEN 2 THEN 40 WHEN 3 THEN 60 WHEN 4 THEN 80 ELSE 100 END AS INTEGER) AS percent,
  rank >= 3 AS done_received, rank >= 5 AS done_credited FROM prep"""))
def return_progress(s, d):
    return R.return_progress(Views(s, d).prepared).select("record_id", "rank", "percent", "done_received", "done_credited")


@query(chain("SELECT record_id, bank_confirmed, credit_confirmed, bank_conflict, credit_review FROM prep"))
def credit_review(s, d):
    return Views(s, d).prepared.select("record_id", "bank_confirmed", "credit_confirmed", "bank_conflict", "credit_review")


@query(chain("""
SELECT record_id, CASE WHEN manual_state = 'reconciled' THEN 'reconciled' WHEN credit_confirmed THEN 'credited' WHEN credit_review THEN 'needs_review'
  WHEN rank >= 4 THEN 'refunded' ELSE 'needs_review' END AS effective_state FROM prep"""))
def effective_state(s, d):
    return R.effective_state(Views(s, d).prepared).select("record_id", "effective_state")


@query(chain("SELECT record_id, rank FROM prep WHERE rank >= 3"))
def confirmed_returns(s, d):
    return R.confirmed_returns(Views(s, d).prepared).select("record_id", "rank")


# --- merging ----------------------------------------------------------------------------------------------------------

_CAP = {
    "ranked": f"SELECT *, {rank_sql('return_stage')} AS rank, batch_id * 1000000000 + seq AS tick FROM v_captures",
    "mono": "SELECT *, coalesce(max(rank) OVER (PARTITION BY record_id ORDER BY batch_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best_before FROM ranked",
    "acc": "SELECT *, rank >= best_before AS accepted FROM mono"}


@query(chain("SELECT record_id, seq, rank, best_before, accepted FROM acc", **_CAP))
def monotonic_stage(s, d):
    return merge.monotonic_stage(spark_view(s, d, "v_captures")).select("record_id", "seq", "rank", "best_before", "accepted")


# a status only gives way to one of at least its own rank
_MERGED = """
SELECT record_id, arg_max(return_stage, tick) FILTER (accepted) AS return_stage,
  arg_max(status, CASE status WHEN 'return_in_progress' THEN 1 ELSE 0 END * 1000000000000000 + tick) FILTER (accepted) AS status,
  arg_max(status_text, tick) FILTER (accepted AND trim(status_text) <> '') AS status_text, arg_max(refund_cents, tick) FILTER (refund_cents IS NOT NULL) AS refund_cents,
  arg_max(card_last4, tick) FILTER (card_last4 IS NOT NULL) AS card_last4, arg_max(captured_at, tick) AS captured_at FROM acc GROUP BY record_id"""
_MERGED_COLUMNS = ["record_id", "return_stage", "status", "status_text", "refund_cents", "card_last4", "captured_at"]


@query(chain(_MERGED, **_CAP))
def merge_latest(s, d):
    return merge.merge_latest(spark_view(s, d, "v_captures")).select(*_MERGED_COLUMNS)


@query(chain(_MERGED, **_CAP))
def merge_in_two_batches(s, d):
    """Merging batches 0-2 first and the others into the result gives what one merge gives."""
    c = spark_view(s, d, "v_captures")
    return merge.merge_latest(c.where("batch_id > 2"), merge.merge_latest(c.where("batch_id <= 2"))).select(*_MERGED_COLUMNS)


@query(chain("""
SELECT record_id, CASE max(rank) WHEN 0 THEN 'unknown' WHEN 1 THEN 'started' WHEN 2 THEN 'shipped' WHEN 3 THEN 'received' ELSE 'refund_issued' END AS stage,
  bool_or(rank >= 3) AS received_done, arg_max(status_text, tick) FILTER (rank >= 3 AND status_text <> '') AS received_date FROM acc GROUP BY record_id""", **_CAP))
def merge_milestones(s, d):
    c = spark_view(s, d, "v_captures").withColumn("rank", schema.stage_rank(F.col("return_stage")))
    step = lambda k, n: F.struct((F.col("rank") >= k).alias("done"), F.when(F.col("rank") >= k, F.col("status_text")).alias("date")).alias(n)
    m = F.struct(F.col("return_stage").alias("stage"), F.lit(None).cast("string").alias("expected_credit_date"), *[step(k, n) for k, n in enumerate(schema.STAGE_NAMES) if k])
    out = merge.merge_milestones(c.withColumn("return_milestones", m))
    return out.select("record_id", *[F.col(f"return_milestones.{x}").alias(n) for x, n in (("stage", "stage"), ("received.done", "received_done"), ("received.date", "received_date"))])


@query("""WITH w AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS x FROM events),
f AS (SELECT user_id, lower(x) AS l, arg_min(x, event_id) AS x, min(event_id) AS pos FROM w GROUP BY user_id, lower(x))
SELECT user_id, string_agg(x, '|' ORDER BY pos) AS names FROM f GROUP BY user_id""")
def array_union(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    x = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", x.alias("x")))).alias("l"))
    names = F.transform("l", lambda y: y["x"])
    return g.select("user_id", F.array_join(array_union_ci(F.slice(names, 1, 3), names), "|").alias("names"))


# a return goes if an authoritative capture of its order and token is in the batch, and it isn't in the batch itself
@query(chain("""
SELECT r.record_id FROM v_returns r LEFT JOIN (SELECT DISTINCT order_id, return_token FROM v_returns WHERE l_partkey % 4 = 0 AND authoritative) b
  ON r.order_id = b.order_id AND r.return_token = b.return_token WHERE r.l_partkey % 4 = 0 OR b.order_id IS NULL"""))
def supersede(s, d):
    r = spark_view(s, d, "v_returns").withColumn("record_type", F.lit("return"))
    return merge.supersede_provisional(r, r.where("l_partkey % 4 = 0")).select("record_id")


@query(chain("""
SELECT record_id, CASE WHEN l_partkey % 5 = 1 THEN 'removed' WHEN l_partkey % 5 = 2 THEN 'inserted' WHEN l_partkey % 5 = 3 AND refund_cents IS NOT NULL THEN 'updated'
  ELSE 'unchanged' END AS change FROM v_returns"""))
def ledger_diff(s, d):
    r = spark_view(s, d, "v_returns")
    raised = F.when(F.col("l_partkey") % 5 == 3, F.col("refund_cents") + 5).otherwise(F.col("refund_cents"))
    after = r.where("l_partkey % 5 <> 1").withColumn("refund_cents", raised).withColumn("last_scanned_at", F.lit(NOW).cast("timestamp"))
    return merge.diff_ledger(r.where("l_partkey % 5 <> 2"), after).select("record_id", "change")


@query(chain("""
SELECT order_id, record_id, purchase_cents, order_details_url FROM v_orders WHERE o_orderkey % 6 <> 0 OR order_details_url IS NULL
UNION ALL SELECT DISTINCT order_id, 'order:' || order_id, NULL, order_details_url FROM v_orders WHERE o_orderkey % 6 = 0 AND order_details_url IS NOT NULL"""))
def reset_orders(s, d):
    o = spark_view(s, d, "v_orders").withColumn("first_seen_at", F.col("last_scanned_at"))
    out, _ = merge.reset_orders(o, o.where("o_orderkey % 6 = 0"))
    return out.select("order_id", "record_id", "purchase_cents", "order_details_url")


@query(chain("""
SELECT record_id, CASE WHEN l_partkey % 4 = 0 THEN 'confirmed' ELSE bank_status END AS bank_status,
  CASE WHEN l_partkey % 4 = 0 AND l_partkey % 3 = 0 THEN 'reconciled' ELSE manual_state END AS manual_state FROM v_returns"""))
def patch_records(s, d):
    r = spark_view(s, d, "v_returns")
    manual = F.when(F.col("l_partkey") % 3 == 0, "reconciled").alias("manual_state")
    patches = r.where("l_partkey % 4 = 0").select("account_id", "record_id", F.lit("confirmed").alias("bank_status"), manual)
    return merge.patch_records(r, patches).select("record_id", "bank_status", "manual_state")


@query(chain("""
SELECT order_id, CASE WHEN order_data_complete AND 0 >= expected_returns THEN 'complete' WHEN o_orderkey % 5 >= 3 OR (o_orderkey % 5 = 2 AND o_orderkey % 7 = 0) THEN 'error'
  WHEN o_orderkey % 5 > 0 THEN 'retrying' ELSE 'pending' END AS processing_state, CAST(o_orderkey % 5 AS BIGINT) AS n_failed FROM cur"""))
def processing_state(s, d):
    o = B.current_orders(spark_view(s, d, "v_orders"))
    tries = o.select("account_id", "order_id", "o_orderkey", F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 5).cast("int"))).alias("seq")).where("seq > 0")
    blocked = (F.col("o_orderkey") % 7 == 0) & (F.col("seq") == 2)
    tries = tries.withColumn("ok", F.lit(False)).withColumn("outcome", F.when(blocked, "blocked").otherwise("error"))
    return merge.order_processing_state(o.withColumn("n_authoritative", F.lit(0)), tries).select("order_id", "processing_state", "n_failed")


# --- bank -------------------------------------------------------------------------------------------------------------

_BANK = {
    "c": """
  SELECT r.account_id, request_id, txn_id, txn_state, 4 * CAST(card_last4 = txn_last4 AS INTEGER) + 2 * CAST(merchant_match AS INTEGER) + CAST(txn_state = 'posted' AS INTEGER) AS score
  FROM v_requests r JOIN v_transactions t ON r.account_id = t.account_id AND abs(expected_cents - amount_cents) <= 1 AND posted_at >= refund_issued_at""",
    "b": "SELECT *, max(score) OVER (PARTITION BY account_id, request_id) AS rb, max(score) OVER (PARTITION BY account_id, txn_id) AS tb, count(*) OVER (PARTITION BY account_id, request_id) AS n FROM c",
    "m": "SELECT *, count(*) FILTER (score = rb) OVER (PARTITION BY account_id, request_id) AS rt, count(*) FILTER (score = tb) OVER (PARTITION BY account_id, txn_id) AS tt FROM b",
    "h": """
  SELECT account_id, request_id, max(n) AS n_candidates, max(txn_id) FILTER (score = rb AND rt = 1 AND score = tb AND tt = 1) AS txn_id,
    max(txn_state) FILTER (score = rb AND rt = 1 AND score = tb AND tt = 1) AS st FROM m GROUP BY account_id, request_id""",
    "first": """
  SELECT r.account_id, r.request_id, CASE WHEN n_candidates IS NULL THEN 'not_found' WHEN txn_id IS NULL THEN 'ambiguous' WHEN st = 'posted' THEN 'confirmed' ELSE 'pending' END AS status,
    txn_id, coalesce(n_candidates, 0) AS n_candidates FROM v_requests r LEFT JOIN h ON r.account_id = h.account_id AND r.request_id = h.request_id"""}


@query(chain("SELECT * FROM first", **_BANK))
def reconcile_credits(s, d):
    return bank.reconcile_credits(spark_view(s, d, "v_requests"), spark_view(s, d, "v_transactions"))


@query(chain("SELECT account_id, request_id, txn_id, score FROM c", **_BANK))
def candidate_credits(s, d):
    return bank.candidate_credits(spark_view(s, d, "v_requests"), spark_view(s, d, "v_transactions")).select("account_id", "request_id", "txn_id", "score")


def _in_rounds(requests: str, credits: str, c: str, select: str, **more: str) -> str:
    """SQL that takes the pairs c of two views apart round by round, recursively: `done` has each request's outcome."""
    views = chain("SELECT * FROM c", c=c.replace("v_requests", requests).replace("v_transactions", credits)).rsplit("\n", 1)[0]
    own = {"rounds": """
  SELECT 0 AS k, account_id, request_id, txn_id, txn_state, score, false AS won FROM c
  UNION ALL
  SELECT k + 1, account_id, request_id, txn_id, txn_state, score, mutual FROM (
    SELECT *, bool_or(mutual) OVER (PARTITION BY account_id, request_id) OR bool_or(mutual) OVER (PARTITION BY account_id, txn_id) AS used, bool_or(mutual) OVER () AS any_won
    FROM (
      SELECT *, score = rb AND score = tb AND count(*) FILTER (score = rb) OVER (PARTITION BY account_id, request_id) = 1 AND count(*) FILTER (score = tb) OVER (PARTITION BY account_id, txn_id) = 1 AS mutual
      FROM (SELECT *, max(score) OVER (PARTITION BY account_id, request_id) AS rb, max(score) OVER (PARTITION BY account_id, txn_id) AS tb FROM rounds WHERE NOT won) x) y) z
  WHERE any_won AND (mutual OR NOT used)""",
        "done": f"""
  SELECT r.account_id, r.request_id, CASE w.txn_state WHEN 'posted' THEN 'confirmed' WHEN 'pending' THEN 'pending' ELSE CASE WHEN o.request_id IS NULL THEN 'not_found' ELSE 'ambiguous' END END AS status,
    w.txn_id, coalesce(n, 0) AS n_candidates
  FROM {requests} r LEFT JOIN (SELECT account_id, request_id, count(*) AS n FROM c GROUP BY ALL) n ON r.account_id = n.account_id AND r.request_id = n.request_id
    LEFT JOIN (SELECT * FROM rounds WHERE won) w ON r.account_id = w.account_id AND r.request_id = w.request_id
    LEFT JOIN (SELECT DISTINCT account_id, request_id FROM rounds WHERE NOT won AND k = (SELECT max(k) FROM rounds)) o ON r.account_id = o.account_id AND r.request_id = o.request_id"""} | more
    return views.replace("WITH ", "WITH RECURSIVE ", 1) + "".join(f",\n{n} AS ({q})" for n, q in own.items()) + "\n" + select


@query(_in_rounds("v_requests", "v_transactions", _BANK["c"], "SELECT * FROM done"))
def reconcile_rounds(s, d):
    return bank.reconcile_rounds(spark_view(s, d, "v_requests"), spark_view(s, d, "v_transactions"))


@query(_in_rounds("v_requests_by_token", "v_credits", _BANK["c"], """
SELECT d.account_id, d.request_id, coalesce(g.status, d.status) AS status, coalesce(g.txn_id, d.txn_id) AS txn_id, n_candidates
FROM done d LEFT JOIN open_requests o ON d.account_id = o.account_id AND d.request_id = o.request_id LEFT JOIN whole g ON o.account_id = g.account_id AND o.return_token = g.return_token""",
    open_requests="SELECT r.* FROM v_requests_by_token r JOIN done d ON r.account_id = d.account_id AND r.request_id = d.request_id WHERE status IN ('not_found', 'ambiguous')",
    sums="""SELECT account_id, return_token, sum(expected_cents) AS cents, max(refund_issued_at) AS since, max(card_last4) AS card FROM open_requests GROUP BY account_id, return_token
  HAVING count(*) > 1 AND count(expected_cents) = count(*)""",
    gc="""
  SELECT s.account_id, return_token, t.txn_id, txn_state, 4 * CAST(card = txn_last4 AS INTEGER) + 2 * CAST(merchant_match AS INTEGER) + CAST(txn_state = 'posted' AS INTEGER) AS score
  FROM sums s JOIN v_credits t ON s.account_id = t.account_id AND abs(cents - amount_cents) <= 1 AND posted_at >= since
  LEFT JOIN done d ON t.account_id = d.account_id AND t.txn_id = d.txn_id WHERE d.txn_id IS NULL""",
    gb="SELECT *, max(score) OVER (PARTITION BY account_id, return_token) AS rb, max(score) OVER (PARTITION BY account_id, txn_id) AS tb FROM gc",
    gm="SELECT *, count(*) FILTER (score = rb) OVER (PARTITION BY account_id, return_token) AS rt, count(*) FILTER (score = tb) OVER (PARTITION BY account_id, txn_id) AS tt FROM gb",
    whole="SELECT account_id, return_token, txn_id, CASE txn_state WHEN 'posted' THEN 'confirmed' ELSE 'pending' END AS status FROM gm WHERE score = rb AND rt = 1 AND score = tb AND tt = 1"))
def reconcile_grouped(s, d):
    requests, credits = spark_view(s, d, "v_requests_by_token"), spark_view(s, d, "v_credits")
    return bank.reconcile_grouped(requests, credits, bank.reconcile_rounds(requests, credits))


@query(chain("""
SELECT u.account_id, record_id AS return_record_id, u.order_id, u.refund_issued_at, coalesce(u.refund_cents, refund_subtotal_cents) AS expected_cents, coalesce(u.card_last4, o.card_last4) AS card_last4,
  stage, coalesce(u.status_text, u.status) AS shop_status, expected_credit_at
FROM used u JOIN orows o ON u.order_id = o.order_id WHERE rank >= 4 AND NOT bank_confirmed AND o.data_complete"""))
def bank_request(s, d):
    v = Views(s, d)
    r = bank.bank_request(v.used, v.rows)
    return r.select("account_id", "return_record_id", "order_id", "expected_cents", "card_last4", "stage", "shop_status", "expected_credit_at", "refund_issued_at")


_RESULTS = """
  SELECT account_id, record_id AS return_record_id, CASE l_partkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'pending' WHEN 2 THEN 'maybe' ELSE 'ambiguous' END AS status,
    coalesce(refund_cents, refund_subtotal_cents, 0) + l_partkey % 3 AS c FROM v_returns WHERE l_partkey % 2 = 0 OR l_partkey % 3 = 0"""


def bank_results(v: Views) -> DataFrame:
    k = F.col("l_partkey")
    status = F.when(k % 4 == 0, "Confirmed").when(k % 4 == 1, "pending").when(k % 4 == 2, "maybe").otherwise("ambiguous")
    amount = (F.coalesce("refund_cents", "refund_subtotal_cents", F.lit(0)) + k % 3) / 100
    texts = {"posted_date": "2001-01-01", "account_last4": "12345", "account_name": "Checking", "merchant_name": "Shop", "reason": "ok"}
    return v.returns.where("l_partkey % 2 = 0 OR l_partkey % 3 = 0").select(
        "account_id", F.col("record_id").alias("return_record_id"), F.lit(None).cast("string").alias("status"), status.alias("outcome"), amount.alias("matched_amount"),
        *[F.lit(x).alias(c) for c, x in texts.items()])


@query(chain("SELECT account_id, return_record_id, status, CAST(c AS BIGINT) AS matched_cents, '2345' AS account_last4 FROM results WHERE status <> 'maybe'", results=_RESULTS))
def validate_bank_results(s, d):
    return bank.validate_bank_results(bank_results(Views(s, d)))[0].select("account_id", "return_record_id", "status", "matched_cents", "account_last4")


@query(chain("""
SELECT r.account_id, record_id, CASE WHEN q.status IN ('confirmed', 'pending', 'ambiguous') AND NOT coalesce(q.status = 'confirmed' AND abs(c - coalesce(refund_cents, refund_subtotal_cents)) > 1, false)
  THEN q.status ELSE bank_status END AS bank_status FROM v_returns r LEFT JOIN results q ON r.account_id = q.account_id AND record_id = return_record_id""", results=_RESULTS))
def apply_bank_results(s, d):
    v = Views(s, d)
    good = bank.validate_bank_results(bank_results(v))[0].withColumn("checked_at", F.lit(NOW).cast("timestamp"))
    return bank.apply_bank_results(v.returns, good)[0].select("account_id", "record_id", "bank_status")


# --- coverage ---------------------------------------------------------------------------------------------------------


def history_pages(s, d) -> DataFrame:
    h = spark_view(s, d, "v_history_rows")
    k = F.col("o_orderkey")
    ids = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("order_id"))))
    pages = h.groupBy("account_id", "session_id", "year", "page").agg(
        ids(F.lit(True)).alias("order_ids"), ids(k % 9 != 0).alias("detail_link_ids"), ids(k % 50 == 0).alias("terminal_ids"), F.max("placed_at").alias("captured_at"))
    return pages.withColumn("seq", F.col("year") * 100000 + F.col("page"))


_PAGE = "account_id, session_id, year, page"
_HIST = {
    "pg": f"""
  SELECT {_PAGE}, year * 100000 + page AS seq, string_agg(order_id, '|' ORDER BY order_id) AS fingerprint, max(placed_at) AS captured_at FROM v_history_rows GROUP BY {_PAGE}""",
    "done": """
  SELECT DISTINCT order_id FROM v_history_rows WHERE o_orderkey % 50 = 0 UNION SELECT order_id FROM v_orders_once WHERE order_data_complete OR terminal_cancelled""",
    "seen": "SELECT account_id, order_id, session_id, year * 100000 + page AS seq, session_id || ':' || year || ':' || page AS page_key FROM v_history_rows",
    "firsts": "SELECT *, first_value(page_key) OVER (PARTITION BY account_id, order_id ORDER BY session_id, seq) AS first_page FROM seen",
    "hits": """
  SELECT *, count(*) OVER (PARTITION BY account_id) AS n_hits, row_number() OVER (PARTITION BY account_id ORDER BY session_id, seq, order_id) AS k FROM firsts WHERE page_key <> first_page""",
    "years": """
  SELECT account_id, h.year, count(*) = count(d.order_id) AS completed FROM v_history_rows h LEFT JOIN done d ON h.order_id = d.order_id GROUP BY account_id, h.year"""}


@query(chain(f"SELECT {_PAGE}, fingerprint FROM pg", **_HIST))
def page_fingerprint(s, d):
    return coverage.page_fingerprint(history_pages(s, d)).select(*_PAGE.split(", "), "fingerprint")


@query(chain(f"""
SELECT {_PAGE}, coalesce(fingerprint <> '' AND before <> '' AND before <> fingerprint, false) AS advanced
FROM (SELECT *, lag(fingerprint) OVER (PARTITION BY account_id, session_id ORDER BY seq) AS before FROM pg) q""", **_HIST))
def page_progress(s, d):
    return coverage.page_progress(history_pages(s, d)).select(*_PAGE.split(", "), "advanced")


@query(chain("SELECT account_id, order_id, first_page, page_key AS again_page, n_hits FROM hits WHERE k <= 50", **_HIST))
def overlap_hits(s, d):
    return coverage.overlap_hits(history_pages(s, d)).select("account_id", "order_id", "first_page", "again_page", "n_hits")


@query(chain("SELECT order_id FROM v_orders_once WHERE o_orderkey % 9 = 0 AND o_orderkey % 50 <> 0 AND o_orderkey % 4 <> 0"))
def missing_links(s, d):
    stored = spark_view(s, d, "v_orders_once").where("o_orderkey % 4 = 0").withColumn("order_details_url", F.lit("x"))
    return coverage.missing_detail_links(history_pages(s, d), stored).select("order_id")


def _completed(s, d) -> DataFrame:
    o = spark_view(s, d, "v_orders_once")
    return coverage.completed_orders(o.select("account_id", "order_id", F.lit(False).alias("complete")), history_pages(s, d), o)


@query(chain("SELECT order_id FROM done", **_HIST))
def completed_orders(s, d):
    return _completed(s, d).select("order_id")


@query(chain(f"""
SELECT {_PAGE}, count(*) AS n_orders, count(d.order_id) AS n_done, count(*) = count(d.order_id) AS page_done
FROM v_history_rows h LEFT JOIN done d ON h.order_id = d.order_id GROUP BY {_PAGE}""", **_HIST))
def page_completion(s, d):
    return coverage.page_completion(history_pages(s, d), _completed(s, d))


@query(chain("SELECT DISTINCT account_id, session_id, h.order_id FROM v_history_rows h JOIN done d ON h.order_id = d.order_id", **_HIST))
def session_refresh(s, d):
    return coverage.session_refresh_set(history_pages(s, d), _completed(s, d))


@query(chain("""
SELECT o.order_id, b.order_id IS NOT NULL AS has_return, CASE WHEN NOT order_data_complete THEN 'incomplete' ELSE 'stale' END AS reason
FROM v_orders_once o LEFT JOIN (SELECT DISTINCT order_id FROM v_returns) b ON o.order_id = b.order_id
WHERE NOT order_data_complete OR last_scanned_at + CASE WHEN b.order_id IS NOT NULL THEN INTERVAL 24 HOUR ELSE INTERVAL 168 HOUR END <= TIMESTAMP '1999-01-01'"""))
def refresh_due(s, d):
    return coverage.refresh_due(spark_view(s, d, "v_orders_once"), spark_view(s, d, "v_returns"), "1999-01-01 00:00:00").drop("account_id")


@query(chain("SELECT account_id, year, page, max(captured_at) AS captured_at FROM pg GROUP BY account_id, year, page HAVING max(captured_at) + INTERVAL 24 HOUR <= TIMESTAMP '1996-01-01'", **_HIST))
def pages_due(s, d):
    return coverage.pages_due(history_pages(s, d), "1996-01-01 00:00:00")


_JOBS = {
    "jobs": "SELECT 'U' || CAST(user_id AS VARCHAR) AS account_id, event_type || ':O' || CAST(event_id % 40 AS VARCHAR) AS job_key, event_id % 3 AS priority, ts AS queued_at, event_id FROM events",
    "busy": "SELECT DISTINCT account_id, job_key FROM jobs WHERE event_id % 5 = 0",
    "once": "SELECT *, row_number() OVER (PARTITION BY account_id, job_key ORDER BY priority, queued_at) AS n FROM jobs WHERE event_id % 5 <> 0"}


@query(chain("""
SELECT o.account_id, o.job_key, priority, queued_at FROM once o LEFT JOIN busy b ON o.account_id = b.account_id AND o.job_key = b.job_key WHERE n = 1 AND b.job_key IS NULL""", **_JOBS))
def work_list(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    j = e.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("account_id"), F.col("event_type").alias("type"), F.concat(F.lit("O"), (F.col("event_id") % 40).cast("string")).alias("order_id"),
        F.lit(None).cast("string").alias("url"), (F.col("event_id") % 3).alias("priority"), F.col("ts").alias("queued_at"), "event_id")
    busy = j.where("event_id % 5 = 0").withColumn("job_key", F.concat_ws(":", "type", "order_id"))
    return coverage.work_list(j.where("event_id % 5 <> 0"), busy.where("event_id % 10 = 0"), busy.where("event_id % 10 = 5")).select("account_id", "job_key", "priority", "queued_at")


@query(chain("""
SELECT account_id, max(year) FILTER (year < 1998 AND NOT completed) AS next_year, count(*) AS n_years, count(*) FILTER (completed) AS n_completed,
  max(year) FILTER (year < 1998 AND NOT completed) IS NULL AS done FROM years GROUP BY account_id""", **_HIST))
def year_status(s, d):
    done = coverage.page_completion(history_pages(s, d), _completed(s, d))
    years = done.groupBy("account_id", "year").agg(F.bool_and("page_done").alias("completed"))
    return coverage.year_status(years, F.lit(1998))


@query(chain("SELECT p.account_id, year, max(page) AS page FROM pg p JOIN (SELECT account_id, min(year) AS least FROM pg GROUP BY account_id) l ON p.account_id = l.account_id AND year = least GROUP BY p.account_id, year", **_HIST))
def deepest_frontier(s, d):
    return coverage.deepest_frontier(history_pages(s, d))


@query("""
SELECT 'U' || CAST(user_id AS VARCHAR) AS account_id, CAST(event_id % 4 AS INTEGER) AS year, count(*) FILTER (event_type = 'view') AS n_history,
  count(*) FILTER (event_type = 'click') AS n_detail, count(*) FILTER (event_type = 'purchase') AS n_return, count(*) FILTER (value < 5) AS n_errors,
  count(*) FILTER (value > 300) AS n_rate_limited FROM events GROUP BY user_id, event_id % 4""")
def crawl_counters(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "view", "history").when(F.col("event_type") == "click", "detail").when(F.col("event_type") == "purchase", "return").otherwise("other")
    outcome = F.when(F.col("value") < 5, "error").when(F.col("value") > 300, "rate_limited").otherwise("ok")
    return coverage.crawl_counters(e.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("account_id"), (F.col("event_id") % 4).cast("int").alias("year"), kind.alias("type"), outcome.alias("outcome")))


@query(chain("""
SELECT 'detail' AS type, order_id, order_details_url AS url FROM v_orders_once WHERE NOT order_data_complete AND order_details_url IS NOT NULL
UNION SELECT 'return', order_id, 'https://shop.example.com/returns/status?rmaId=' || return_token FROM v_returns"""))
def pending_seed(s, d):
    r = spark_view(s, d, "v_returns").withColumn("return_status_url", F.concat(F.lit("https://shop.example.com/returns/status?rmaId="), F.col("return_token")))
    return coverage.pending_seed(spark_view(s, d, "v_orders_once"), r).drop("account_id")


@query(chain("SELECT account_id, event_id, logged_at FROM v_event_log QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY logged_at DESC, event_id DESC) <= 5"))
def latest_events(s, d):
    log = spark_view(s, d, "v_event_log").withColumnRenamed("logged_at", "at")
    return io.latest_events(log, 5).select("account_id", "event_id", F.col("at").alias("logged_at"))


@query(chain("""
SELECT account_id, 'K' || CAST(event_id AS VARCHAR) AS job_key FROM v_event_log
QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY logged_at DESC, 'K' || CAST(event_id AS VARCHAR)) <= 3"""))
def recent_keys(s, d):
    log = spark_view(s, d, "v_event_log").withColumnRenamed("logged_at", "at")
    return coverage.recent_keys(log.withColumn("job_key", F.concat(F.lit("K"), F.col("event_id").cast("string"))), 3).select("account_id", "job_key")

