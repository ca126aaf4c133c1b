"""DuckDB SQL of the order row, as named views that build on each other; a query takes only the views that it needs."""

from __future__ import annotations

import re

from .adapters import VIEWS, duck_view

NOW = "2002-01-01 00:00:00"


def rank(c: str) -> str:
    return f"CASE {c} WHEN 'started' THEN 1 WHEN 'shipped' THEN 2 WHEN 'received' THEN 3 WHEN 'refund_issued' THEN 4 WHEN 'refunded' THEN 4 WHEN 'credited' THEN 5 ELSE 0 END"


def label(c: str) -> str:
    return f"""CASE {c} WHEN 0 THEN 'Return detected' WHEN 1 THEN 'Return started' WHEN 2 THEN 'Dropped off / shipped'
    WHEN 3 THEN 'Return received' WHEN 4 THEN 'Refund issued' WHEN 5 THEN 'Credited' END"""


def replacement_label(c: str) -> str:
    return f"CASE {c} WHEN 'requested' THEN 'Replacement requested' WHEN 'shipped' THEN 'Replacement shipped' WHEN 'delivered' THEN 'Replacement delivered' END"


def title(c: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace(coalesce({c}, ''), '\d{{3}}-\d{{7}}-\d{{7}}', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"


#: Whether one of two titles, 24 characters and four words long at least, starts the other.
NEAR = """len(list_filter(g.titles, lambda t: CASE WHEN length(i.title) <= length(t)
      THEN length(i.title) >= 24 AND len(string_split(i.title, ' ')) >= 4 AND starts_with(t, i.title)
      ELSE length(t) >= 24 AND len(string_split(t, ' ')) >= 4 AND starts_with(i.title, t) END)) > 0"""


def amount(only: str) -> str:
    """The amount of a group over the records that fulfil a condition."""
    return f"""CAST(coalesce(arg_max(explicit, tick) FILTER ({only} AND explicit IS NOT NULL), sum(refund) FILTER ({only} AND refund_scope = 'item'),
    arg_max(refund, tick) FILTER ({only} AND refund IS NOT NULL)) AS BIGINT)"""


def groups(source: str) -> str:
    """Return groups of the records of a view."""
    return f"""
  SELECT account_id, order_id, group_key, count(*) AS n_records, arg_max(record_id, front) AS record_id, arg_max(stage, front) AS stage, max(rank) AS rank,
    max(CASE WHEN front = foremost THEN bank_status END) AS bank_status, max(CASE WHEN front = foremost THEN manual_state END) AS manual_state,
    max(CASE WHEN front = foremost THEN expected_credit_at END) AS expected_credit_at, arg_max(step_dates, front) AS step_dates, coalesce(any_value(names), []) AS item_names, coalesce(any_value(name_titles), []) AS titles,
    any_value(found_asins) AS asins, {amount('true')} AS amount_cents, count(DISTINCT explicit) > 1 AS amount_conflict, {amount('credit_review')} AS flagged_cents,
    bool_or(identity_conflict) AS identity_conflict, bool_or(bank_conflict) AS bank_conflict, bool_or(credit_review) AS credit_review,
    bool_or(coalesce(manual_state = 'reconciled', false)) AS reconciled, bool_and(credit_confirmed) AS all_confirmed, bool_and(bank_confirmed) AS all_bank_confirmed,
    bool_or(authoritative) AS authoritative, min(rank) AS low_rank, max(last_scanned_at) AS last_scanned_at
  FROM (SELECT *, max(front) OVER (PARTITION BY order_id, group_key) AS foremost FROM (
    SELECT *, CAST(last_scanned_at AS VARCHAR) || record_id AS tick, rank || CAST(last_scanned_at AS VARCHAR) || record_id AS front,
      coalesce(refund_cents, refund_subtotal_cents) AS refund,
      coalesce(group_refund_cents, CASE WHEN refund_scope = 'return' THEN coalesce(refund_cents, refund_subtotal_cents) END) AS explicit FROM {source}) a) b
  LEFT JOIN (
    SELECT order_id, group_key, list(name ORDER BY first) AS names, list({title('name')} ORDER BY first) AS name_titles
    FROM (SELECT order_id, group_key, arg_min(item_name, record_id) AS name, min(record_id) AS first FROM {source}_believed WHERE item_name IS NOT NULL GROUP BY order_id, group_key, lower(item_name)) n
    GROUP BY order_id, group_key) names USING (order_id, group_key)
  LEFT JOIN (
    SELECT order_id, group_key, list(asin ORDER BY first) AS found_asins
    FROM (SELECT order_id, group_key, asin, min(record_id) AS first FROM {source}_believed GROUP BY order_id, group_key, asin) n GROUP BY order_id, group_key) asins USING (order_id, group_key)
  GROUP BY account_id, order_id, group_key"""


def believed(source: str) -> str:
    """The records that name a group's items: trusted ones where the group has any."""
    return f"""
  SELECT * FROM (SELECT *, bool_or(trusted) OVER (PARTITION BY order_id, group_key) AS any_trusted
    FROM (SELECT *, coalesce(item_identity_source = 'order-detail-return-link', false) AS trusted FROM {source}) t) a WHERE trusted OR NOT any_trusted"""


def matched(group: str) -> str:
    """Groups with their single best item of at least 70."""
    return f"""
  SELECT order_id, group_key, item_key, score FROM (
    SELECT *, count(*) FILTER (score = best) OVER (PARTITION BY order_id, group_key) AS n_best FROM (
      SELECT *, max(score) OVER (PARTITION BY order_id, group_key) AS best FROM (
        SELECT i.order_id, g.group_key, i.item_key,
          CASE WHEN list_contains(g.asins, upper(i.asin)) THEN 100 WHEN list_contains(g.titles, i.title) THEN 80 WHEN {NEAR} THEN 70 ELSE 0 END AS score
        FROM (SELECT *, {title('item_name')} AS title FROM v_items) i JOIN {group} g ON i.order_id = g.order_id) s) t) u
  WHERE score = best AND n_best = 1 AND score >= 70"""


def unmatched(group: str, match: str) -> str:
    return f"SELECT g.order_id, g.group_key, len(g.asins) > 0 AS strong_identity FROM {group} g LEFT JOIN {match} m ON g.order_id = m.order_id AND g.group_key = m.group_key WHERE m.item_key IS NULL"


def states(group: str, match: str) -> str:
    """Purchased items with what became of them."""
    return f"""
  SELECT i.*, coalesce(m.n_groups, 0) AS n_groups, m.best_rank, count(m.n_groups) OVER (PARTITION BY i.order_id) AS returned_products
  FROM v_items i LEFT JOIN (
    SELECT b.order_id, b.item_key, count(*) AS n_groups, max(g.rank) AS best_rank FROM {match} b JOIN {group} g ON b.order_id = g.order_id AND b.group_key = g.group_key
    GROUP BY b.order_id, b.item_key) m ON i.order_id = m.order_id AND i.item_key = m.item_key"""


def listed(pairs: str, sep: str) -> str:
    """Per order, the distinct values (in any case) of rows (order_id, value, place), in order of place."""
    return f"""
  SELECT order_id, string_agg(value, '{sep}' ORDER BY place) AS listed FROM (
    SELECT order_id, arg_min(value, place) AS value, min(place) AS place FROM ({pairs}) p WHERE value IS NOT NULL GROUP BY order_id, lower(value)) d
  GROUP BY order_id"""


RETURN_NAMES = "SELECT order_id, item_name AS value, '2' || group_key || record_id AS place FROM used_believed"
ITEM_NAMES = "SELECT order_id, item_name AS value, '1' || item_key AS place FROM v_items"

OWN = {
    "cur": "SELECT * FROM v_orders QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY detail_scan_complete DESC, last_scanned_at DESC NULLS LAST, record_id) = 1",
    "staged": f"""
  SELECT *, {rank('stage')} AS rank FROM (
    SELECT *, coalesce(return_stage, CASE status WHEN 'refunded' THEN 'refund_issued' WHEN 'returned_pending_refund' THEN 'received' END,
      CASE WHEN status_text = 'We have received your return' THEN 'received' END, 'unknown') AS stage FROM v_returns) s""",
    "banked": """
  SELECT *, coalesce(manual_state = 'reconciled', false) OR coalesce(bank_status = 'confirmed', false) AS bank_confirmed FROM staged""",
    "prep": f"""
  SELECT *, bank_confirmed AND rank < 4 AS bank_conflict, bank_confirmed OR rank >= 5 AS credit_confirmed,
    CASE WHEN identity_conflict THEN true WHEN coalesce(manual_state = 'reconciled', false) THEN false WHEN bank_confirmed AND rank < 4 THEN true
      WHEN bank_confirmed OR rank >= 5 THEN false WHEN rank < 4 THEN true WHEN coalesce(bank_status IN ('ambiguous', 'needs_review'), false) THEN true
      WHEN expected_credit_at IS NULL THEN false ELSE TIMESTAMP '{NOW}' > expected_credit_at + INTERVAL 24 HOUR END AS credit_review
  FROM banked""",
    "ded": """
  SELECT *, return_token AS group_key FROM (SELECT *, lower(return_token || ':' || asin) AS identity FROM prep) p
  QUALIFY row_number() OVER (PARTITION BY order_id, identity ORDER BY rank DESC, last_scanned_at DESC NULLS LAST, record_id) = 1""",
    "known": """
  SELECT cur.*, terminal_cancelled OR (order_data_complete AND coalesce(n_authoritative, 0) >= expected_returns) AS data_complete
  FROM cur LEFT JOIN (SELECT order_id, count(*) FILTER (authoritative) AS n_authoritative FROM ded GROUP BY order_id) c ON cur.order_id = c.order_id""",
    "used": """
  SELECT ded.* FROM ded LEFT JOIN known ON ded.order_id = known.order_id
  WHERE ded.authoritative OR NOT coalesce(known.data_complete AND known.expected_returns > 0, false)""",
    "ded_believed": believed("ded"), "used_believed": believed("used"), "dgrp": groups("ded"), "grp": groups("used"),
    "dmatched": matched("dgrp"), "matched": matched("grp"), "dunmatched": unmatched("dgrp", "dmatched"), "unmatched": unmatched("grp", "matched"),
    "dstates": states("dgrp", "dmatched"), "states": states("grp", "matched"),
    "repl": """
  SELECT order_id, count(*) AS n_replacements, arg_min(replacement_stage, CASE replacement_stage WHEN 'requested' THEN '2' WHEN 'shipped' THEN '3' ELSE '4' END || item_key) AS replacement_stage
  FROM v_items WHERE replacement_stage IS NOT NULL GROUP BY order_id""",
    "per_record": """
  SELECT order_id, bool_and(rank >= 5) AS all_credited, bool_and(rank >= 4) AS all_issued, bool_and(bank_confirmed) AS all_bank_confirmed,
    bool_or(coalesce(manual_state = 'reconciled', false)) AS reconciled, bool_or(credit_review) AS any_review, bool_or(bank_conflict) AS bank_conflict, min(rank) AS low_rank,
    max(last_scanned_at) AS returns_scanned_at, list(DISTINCT rank ORDER BY rank) AS ranks, arg_min(card_last4, group_key || record_id) FILTER (card_last4 IS NOT NULL) AS card
  FROM used GROUP BY order_id""",
    "per_group": """
  SELECT g.order_id, count(*) AS n_groups, sum(amount_cents) AS returns_cents, sum(flagged_cents) AS flagged_cents, max(rank) AS high_rank, bool_or(identity_conflict) AS identity_conflict,
    bool_or(amount_conflict) AS amount_conflict, count(u.group_key) AS n_unmatched, coalesce(bool_or(u.strong_identity), false) AS strong_unmatched
  FROM grp g LEFT JOIN unmatched u ON g.order_id = u.order_id AND g.group_key = u.group_key GROUP BY g.order_id""",
    "per_item": f"""
  SELECT order_id, count(*) AS n_items, count(*) FILTER (n_groups > 0) AS n_returned_items,
    string_agg(item_name || ' => ' || coalesce({label('best_rank')}, 'Not returned'), '|' ORDER BY item_key) AS product_statuses
  FROM states GROUP BY order_id""",
    "item_list": listed(ITEM_NAMES, "|"), "returned_list": listed(RETURN_NAMES, "|"), "search_list": listed(f"{ITEM_NAMES} UNION ALL {RETURN_NAMES}", "|"),
    "asin_list": listed("SELECT order_id, upper(asin) AS value, '1' || item_key AS place FROM v_items UNION ALL SELECT order_id, asin, '2' || group_key || record_id FROM used", "|"),
    "status_list": listed(
        f"SELECT order_id, coalesce(replacement_status_text, {replacement_label('replacement_stage')}) AS value, '1' || item_key AS place FROM v_items "
        "UNION ALL SELECT order_id, status_text, '2' || group_key || record_id FROM used", " · "),
    "base": """
  SELECT coalesce(k.account_id, r.account_id) AS account_id, k.order_id, coalesce(k.data_complete, false) AS data_complete, coalesce(terminal_cancelled, false) AS cancelled,
    processing_error, processing_state, purchase_cents, coalesce(k.card_last4, p.card) AS card_last4, coalesce(n_groups, 0) AS n_groups, coalesce(n_unmatched, 0) AS n_unmatched,
    coalesce(n_items, 0) AS n_items, coalesce(n_returned_items, 0) AS n_returned_items, coalesce(n_replacements, 0) AS n_replacements, replacement_stage,
    CAST(coalesce(canonical_refund_cents, returns_cents) AS BIGINT) AS refund_cents, CAST(returns_cents AS BIGINT) AS returns_cents, coalesce(flagged_cents, 0) AS flagged_cents,
    coalesce(returns_cents > canonical_refund_cents + 1, false) AS amount_mismatch, coalesce(identity_conflict, false) AS identity_conflict, coalesce(amount_conflict, false) AS amount_conflict,
    coalesce(bank_conflict, false) AS bank_conflict, coalesce(strong_unmatched, false) AS strong_unmatched, coalesce(any_review, false) AS any_review, coalesce(all_issued, false) AS all_issued,
    coalesce(all_credited, false) AS all_credited, coalesce(all_bank_confirmed, false) AS all_bank_confirmed, coalesce(reconciled, false) AS reconciled, low_rank, high_rank, coalesce(ranks, []) AS ranks,
    CAST(year(order_date) AS INTEGER) AS order_year, CAST(order_date AS TIMESTAMP) AS sort_at, greatest(last_scanned_at, returns_scanned_at) AS last_scanned_at,
    coalesce(il.listed, rl.listed, '') AS item_names, coalesce(rl.listed, '') AS returned_names, coalesce(se.listed, '') AS search_names, coalesce(al.listed, '') AS asins,
    coalesce(sl.listed, k.status_text, k.status, '—') AS shop_status, k.status_text, coalesce(detail_scan_complete, false) AS detail_complete, coalesce(order_details_url, '') AS open_url,
    coalesce(product_statuses, '') AS product_statuses
  FROM known k LEFT JOIN (SELECT order_id, any_value(account_id) AS account_id FROM used GROUP BY order_id) r ON k.order_id = r.order_id
    LEFT JOIN per_record p ON k.order_id = p.order_id LEFT JOIN per_group g ON k.order_id = g.order_id LEFT JOIN per_item i ON k.order_id = i.order_id LEFT JOIN repl ON k.order_id = repl.order_id
    LEFT JOIN item_list il ON k.order_id = il.order_id LEFT JOIN returned_list rl ON k.order_id = rl.order_id LEFT JOIN search_list se ON k.order_id = se.order_id
    LEFT JOIN asin_list al ON k.order_id = al.order_id LEFT JOIN status_list sl ON k.order_id = sl.order_id""",
    "reviewed": """
  SELECT *, data_complete AND n_groups > 0 AND NOT reconciled
    AND (any_review OR amount_mismatch OR identity_conflict OR amount_conflict OR strong_unmatched OR bank_conflict) AS needs_review FROM base""",
    # an error only shows while the order is incomplete; a cancelled order with a return is judged by its return
    "stated": """
  SELECT *, CASE WHEN NOT data_complete AND processing_error IS NOT NULL THEN 'error' WHEN NOT data_complete THEN 'processing' WHEN cancelled AND n_groups = 0 THEN 'cancelled'
    WHEN reconciled THEN 'reconciled' WHEN needs_review THEN 'needs_review' WHEN all_credited THEN 'credited' WHEN all_issued THEN 'refund_issued' WHEN n_groups > 0 THEN 'return'
    WHEN n_replacements > 0 THEN 'replacement' ELSE 'purchase' END AS state,
    CASE WHEN NOT needs_review THEN NULL WHEN (amount_mismatch OR identity_conflict OR amount_conflict OR strong_unmatched) AND refund_cents IS NOT NULL THEN refund_cents
      ELSE CAST(flagged_cents AS BIGINT) END AS review_cents
  FROM reviewed""",
    "orows": f"""
  SELECT *, CASE state WHEN 'error' THEN 'Processing error' WHEN 'processing' THEN CASE WHEN processing_state = 'retrying' THEN 'Retrying' ELSE 'Processing' END
    WHEN 'cancelled' THEN 'Cancelled' WHEN 'reconciled' THEN 'Reconciled'
    WHEN 'needs_review' THEN CASE WHEN amount_mismatch THEN 'Refund amount mismatch' WHEN identity_conflict THEN 'Item needs review' WHEN amount_conflict THEN 'Return refund needs review'
      WHEN strong_unmatched THEN 'Returned item needs matching' WHEN bank_conflict THEN 'Bank/shop status conflict' ELSE {label('low_rank')} END
    WHEN 'credited' THEN 'Shop credited' WHEN 'refund_issued' THEN 'Refund issued' WHEN 'return' THEN {label('low_rank')} WHEN 'replacement' THEN {replacement_label('replacement_stage')}
    ELSE coalesce(status_text, CASE WHEN detail_complete THEN 'Order details captured' ELSE 'Order discovered' END) END AS label
  FROM stated""",
}


def chain(select: str, **extra: str) -> str:
    """`select` behind a WITH clause of the views that it uses, directly or through others; `extra` names more views."""
    known = VIEWS | OWN | extra
    order: list[str] = []

    def need(sql: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                own = duck_view(name) if name in VIEWS else known[name]
                need(own)
                order.append(name)

    need(select)
    return "WITH " + ",\n".join(f"{n} AS ({duck_view(n) if n in VIEWS else known[n]})" for n in order) + "\n" + select
