"""Registered queries of the composed merge, stored ledgers and their change feed; the SQL folds captures one by one, recursively."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import schema
from ..operators import merge
from ..sources import ledger_store
from ..sources.shared import fresh_folder
from .adapters import duck_ctes, spark_view

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        SPARK[f.__name__], SQL[f.__name__] = f, sql
        return f
    return add


def _clean(x: str) -> str:
    return f"list_filter(list_transform(coalesce({x}, []), lambda t: trim(t)), lambda t: t <> '')"


def _once(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position(list_transform({x}, lambda u: lower(u)), lower(v)) = i)"


_STAGES = "CASE {0} WHEN 'started' THEN 1 WHEN 'shipped' THEN 2 WHEN 'received' THEN 3 WHEN 'refund_issued' THEN 4 ELSE 0 END"
_STATUS = "CASE {0} WHEN 'return_in_progress' THEN 1 WHEN 'returned_pending_refund' THEN 3 WHEN 'refunded' THEN 4 ELSE 0 END"


def folded(where: str = "true", name: str = "folded") -> str:
    """CTEs that fold the captures of v_evidence with `where`, one after another, into one row a record."""
    return f"""
{name}_in AS (SELECT * FROM v_evidence WHERE {where}),
{name}_token AS (SELECT account_id, order_id, return_token, batch_id, list(DISTINCT record_id) AS who FROM {name}_in WHERE authoritative GROUP BY ALL),
{name}_since AS (
  SELECT r.record_id, max(t.batch_id) AS since FROM (SELECT DISTINCT account_id, order_id, record_id, return_token FROM {name}_in WHERE record_type = 'return') r
  JOIN {name}_token t ON t.account_id = r.account_id AND t.order_id = r.order_id AND t.return_token = r.return_token
  WHERE NOT list_contains(who, r.record_id) AND r.record_id IN (SELECT record_id FROM {name}_in WHERE authoritative OR provisional) GROUP BY r.record_id),
{name}_caps AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.record_id ORDER BY batch_id, seq) AS n FROM {name}_in c LEFT JOIN {name}_since s ON c.record_id = s.record_id
  WHERE s.since IS NULL OR c.batch_id >= s.since),
{name}_fold AS (
  SELECT DISTINCT record_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS asins, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS item, false AS conflict,
    CAST(NULL AS VARCHAR) AS conflict_asins, CAST(NULL AS VARCHAR) AS return_stage, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS status_text, CAST(NULL AS BIGINT) AS refund_cents,
    CAST(NULL AS VARCHAR) AS card_last4, false AS details, false AS authoritative, false AS provisional, CAST([] AS VARCHAR[]) AS items, CAST([] AS VARCHAR[]) AS urls, CAST(NULL AS TIMESTAMP) AS first_seen_at,
    CAST(NULL AS TIMESTAMP) AS last_scanned_at, false AS received_done, CAST(NULL AS VARCHAR) AS received_date,
    CAST(NULL AS VARCHAR) AS told, CAST(NULL AS VARCHAR) AS evidence, 0 AS top, CAST(NULL AS VARCHAR) AS d1, CAST(NULL AS VARCHAR) AS d2, CAST(NULL AS VARCHAR) AS d4
  FROM {name}_caps
  UNION ALL
  SELECT record_id, n,
    CASE WHEN item_names IS NULL OR bound THEN o.names WHEN auth THEN {_once('c_names')} ELSE {_once('list_concat(o.names, c_names)')} END,
    CASE WHEN c.asins IS NULL OR (bound AND len(o.asins) > 0) THEN o.asins WHEN auth THEN {_once('c_asins')} ELSE {_once('list_concat(o.asins, c_asins)')} END,
    CASE WHEN bound THEN o.source ELSE coalesce(nullif(item_identity_source, ''), o.source) END, coalesce(return_item_id, o.item), o.conflict OR odd,
    CASE WHEN odd THEN array_to_string({_once('c_asins')}, '|') ELSE o.conflict_asins END,
    CASE WHEN falls THEN o.return_stage ELSE c.return_stage END,
    CASE WHEN falls OR c.status = '' OR {_STATUS.format('c.status')} < {_STATUS.format('o.status')} THEN o.status ELSE c.status END,
    CASE WHEN falls OR c.status_text = '' THEN o.status_text ELSE c.status_text END, coalesce(c.refund_cents, o.refund_cents), coalesce(c.card_last4, o.card_last4),
    o.details OR detail_scan_complete, o.authoritative OR auth, c.provisional,
    CASE WHEN order_items IS NULL THEN o.items WHEN detail_scan_complete OR len(o.items) = 0 THEN order_items ELSE o.items END,
    {_once('list_concat(o.urls, c_urls)')}, coalesce(o.first_seen_at, captured_at), captured_at,
    o.received_done OR {_STAGES.format('c.return_stage')} >= 3, CASE WHEN {_STAGES.format('c.return_stage')} >= 3 AND c.status_text <> '' THEN c.status_text ELSE o.received_date END,
    CASE WHEN odd THEN array_to_string({_once('c_names')}, '|') || '/' || array_to_string({_once('c_asins')}, '|') || '/' || coalesce(item_identity_source, '-') ELSE o.told END,
    coalesce(item_asin_evidence_source, o.evidence), greatest(o.top, {_STAGES.format('c.return_stage')}),
    {', '.join(f"CASE WHEN {_STAGES.format('c.return_stage')} >= {k} AND c.status_text <> '' THEN c.status_text ELSE o.d{k} END" for k in (1, 2, 4))}
  FROM (
    SELECT *, bound AND (item_identity_source = 'order-detail-return-link' OR item_asin_evidence_source LIKE 'return-item%') IS TRUE AND len(o.asins) > 0 AND len(c_asins) > 0
      AND NOT list_has_any(list_transform(o.asins, lambda x: upper(x)), list_transform(c_asins, lambda x: upper(x))) AS odd
    FROM (
      SELECT c.record_id, c.n, c, o, c.item_names, c.item_identity_source, c.item_asin_evidence_source, c.return_item_id, c.detail_scan_complete, c.order_items, c.captured_at, c.authoritative AS auth,
        {_clean('c.item_names')} AS c_names, {_clean('c.asins')} AS c_asins, {_clean('c.return_urls')} AS c_urls,
        coalesce(o.source = 'order-detail-return-link' AND o.item = c.return_item_id AND c.record_type = 'return', false) AS bound,
        c.record_type = 'return' AND {_STAGES.format('c.return_stage')} < {_STAGES.format('o.return_stage')} AS falls
      FROM {name}_fold o JOIN {name}_caps c ON c.record_id = o.record_id AND c.n = o.n + 1) x) y),
{name} AS (SELECT * FROM {name}_fold QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY n DESC) = 1)"""


_SHOWN = """record_id, return_stage, status, status_text, refund_cents, card_last4, array_to_string(names, '|') AS item_names, array_to_string(asins, '|') AS asins, source AS item_identity_source,
  conflict AS identity_conflict, conflict_asins, details AS detail_scan_complete, authoritative, provisional AND NOT authoritative AS provisional, array_to_string(items, '|') AS order_items,
  array_to_string(urls, '|') AS return_urls, first_seen_at, last_scanned_at, received_done, received_date"""


def with_milestones(captures: DataFrame) -> DataFrame:
    """Captures with milestones that follow from their stage and status text."""
    rank = schema.stage_rank(F.col("return_stage"))
    step = lambda k, n: F.struct((rank >= k).alias("done"), F.when(rank >= k, F.col("status_text")).alias("date")).alias(n)
    steps = [step(k, n) for k, n in enumerate(schema.STAGE_NAMES) if k]
    return captures.withColumn("return_milestones", F.struct(F.col("return_stage").alias("stage"), F.lit(None).cast("string").alias("expected_credit_date"), *steps))


def evidence(s: SparkSession, d: str) -> DataFrame:
    return with_milestones(spark_view(s, d, "v_evidence"))


def shown(ledger: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "|").alias(c)
    return ledger.select(
        "record_id", "return_stage", "status", "status_text", "refund_cents", "card_last4", joined("item_names"), joined("asins"), "item_identity_source", "identity_conflict",
        F.array_join("identity_conflict_incoming.asins", "|").alias("conflict_asins"), "detail_scan_complete", "authoritative", "provisional", joined("order_items"), joined("return_urls"), "first_seen_at",
        "last_scanned_at", F.col("return_milestones.received.done").alias("received_done"), F.col("return_milestones.received.date").alias("received_date"))


_ALL = f"WITH RECURSIVE {duck_ctes('v_evidence')},{folded()}"


@query(f"{_ALL}\nSELECT {_SHOWN} FROM folded")
def merge_captures(s, d):
    return shown(merge.merge_captures(evidence(s, d)))


def _stored(s: SparkSession, d: str, feed: bool) -> str:
    """A stored ledger of v_evidence: its batches arrive in three parts, the last ones first, and are compacted in between."""
    path, rows = fresh_folder(s, "ledger"), evidence(s, d)
    for epoch in range(3):
        part = rows.where(F.floor(F.col("batch_id") / 2) == (epoch if feed else 2 - epoch))
        ledger_store.append_captures(part, path, epoch, buckets=4, feed=feed)
        if epoch == 1:
            ledger_store.compact_ledger(s, path)
    return path


@query(f"{_ALL}\nSELECT {_SHOWN} FROM folded")
def stored_ledger(s, d):
    return shown(ledger_store.read_ledger_store(s, _stored(s, d, feed=False)))


_SAID = """order_id, return_stage, status, status_text, refund_cents, card_last4, list_sort(names) AS names, list_sort(asins) AS asins, source, told, details, authoritative,
  provisional AND NOT authoritative AS provisional, items, list_sort(urls) AS urls, received_date, evidence, top, d1, d2, d4"""


def _changes(epoch: int) -> str:
    return f"""
SELECT CAST({epoch} AS INTEGER) AS epoch, coalesce(a.record_id, b.record_id) AS record_id,
  CASE WHEN b.record_id IS NULL THEN 'inserted' WHEN a.record_id IS NULL THEN 'removed' WHEN a.said IS NOT DISTINCT FROM b.said THEN 'unchanged' ELSE 'updated' END AS change,
  CASE WHEN a.said IS DISTINCT FROM b.said OR whole THEN captured_at END AS scanned_at
FROM (SELECT * FROM s{epoch}) a FULL JOIN ({f"SELECT * FROM s{epoch - 1}" if epoch else "SELECT * FROM s0 WHERE false"}) b ON a.record_id = b.record_id
LEFT JOIN (SELECT record_id, max(captured_at) AS captured_at, bool_or(detail_scan_complete) AS whole FROM v_evidence WHERE floor(batch_id / 2) = {epoch} GROUP BY record_id) n
  ON n.record_id = coalesce(a.record_id, b.record_id)
WHERE coalesce(a.order_id, b.order_id) IN (SELECT order_id FROM v_evidence WHERE floor(batch_id / 2) = {epoch})"""


_FEED = (
    f"WITH RECURSIVE {duck_ctes('v_evidence')},\norders_of AS (SELECT DISTINCT record_id, order_id FROM v_evidence),"
    + ",".join(folded(f"batch_id < {2 * k + 2}", f"f{k}") for k in range(3))
    + "".join(f",\ns{k} AS (SELECT f.record_id, o.order_id, f AS said FROM (SELECT record_id, {_SAID.replace('order_id, ', '')} FROM f{k}) f JOIN orders_of o ON o.record_id = f.record_id)" for k in range(3))
    + " UNION ALL ".join(_changes(k) for k in range(3)))


@query(_FEED)
def ledger_changes(s, d):
    return ledger_store.read_changes(s, _stored(s, d, feed=True)).select(F.col("epoch").cast("int").alias("epoch"), "record_id", "change", "scanned_at")
