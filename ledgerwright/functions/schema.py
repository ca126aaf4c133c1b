"""Fixed vocabulary, limits and column types of the ledger. Money is whole cents; unknown money is null, never 0."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Lifecycle of a return, by rank; "refunded" is an old spelling of refund_issued.
RETURN_STAGES = {"unknown": 0, "started": 1, "shipped": 2, "received": 3, "refund_issued": 4, "refunded": 4, "credited": 5}
STAGE_NAMES = ["unknown", "started", "shipped", "received", "refund_issued", "credited"]
STAGE_PERCENT = [0, 20, 40, 60, 80, 100]
STAGE_LABELS = ["Return detected", "Return started", "Dropped off / shipped", "Return received", "Refund issued", "Credited"]
# Ranks of a record's status and of a replacement's stage, and the labels of the latter.
STATUS_RANKS = {"unknown": 0, "purchase": 0, "return_in_progress": 1, "refund_expected": 1, "returned_pending_refund": 3, "refunded": 4}
REPLACEMENT_RANKS = {"unknown": 0, "detected": 1, "requested": 2, "ordered": 2, "shipped": 3, "delivered": 4, "complete": 5}
REPLACEMENT_LABELS = {
    "detected": "Replacement", "requested": "Replacement requested", "ordered": "Replacement ordered",
    "shipped": "Replacement shipped", "delivered": "Replacement delivered", "complete": "Replacement complete"}
# An identity that came by an order's own return link, and evidence that binds an ASIN strongly.
TRUSTED_SOURCE = "order-detail-return-link"
STRONG_EVIDENCE = ("return-item-data-asin", "return-item-direct-product-anchor")
# Status filters of the order table and the return stage that some of them name.
STATUS_FILTERS = {
    "return_started": "started", "dropped_off": "shipped", "return_received": "received", "refund_issued": "refund_issued", "refund_credited": "credited"}
# Limits.
TOLERANCE_CENTS = 1
REFRESH_DAYS_ORDER, REFRESH_HOURS_RETURN_ORDER, REFRESH_HOURS_RETURN, REFRESH_HOURS_HISTORY = 7, 24, 6, 24
MAX_ITEMS, MAX_NAMES, MAX_EVENTS, MAX_KEYS, MAX_EXAMPLES = 60, 30, 1600, 6000, 50

ORDER_ITEM = T.StructType([T.StructField(n, k) for n, k in [
    ("item_key", T.StringType()), ("asin", T.StringType()), ("item_name", T.StringType()), ("quantity", T.IntegerType()),
    ("item_amount_cents", T.LongType()), ("fulfillment_status", T.StringType()), ("replacement_stage", T.StringType()),
    ("replacement_status_text", T.StringType()), ("replacement_no_return_required", T.BooleanType()),
    ("replacement_source", T.StringType()), ("source", T.StringType())]])
MILESTONE = T.StructType([T.StructField("done", T.BooleanType()), T.StructField("date", T.StringType())])
MILESTONES = T.StructType([T.StructField("stage", T.StringType()), T.StructField("expected_credit_date", T.StringType())] + [
    T.StructField(n, MILESTONE) for n in ("started", "shipped", "received", "refund_issued", "credited")])
PAGE_CAPTURE = T.StructType([T.StructField(n, k) for n, k in [
    ("account_id", T.StringType()), ("page_id", T.LongType()), ("url", T.StringType()), ("title", T.StringType()), ("text", T.StringType()), ("captured_at", T.TimestampType())]])
CAPTURE = T.StructType([T.StructField(n, k) for n, k in [
    ("account_id", T.StringType()), ("record_id", T.StringType()), ("record_type", T.StringType()), ("order_id", T.StringType()),
    ("batch_id", T.LongType()), ("seq", T.LongType()), ("captured_at", T.TimestampType()), ("status", T.StringType()),
    ("return_stage", T.StringType()), ("status_text", T.StringType()), ("refund_cents", T.LongType()), ("card_last4", T.StringType())]])
BANK_RESULTS = T.StructType([
    T.StructField("schema", T.StringType()), T.StructField("requestId", T.StringType()), T.StructField("accountId", T.StringType()), T.StructField("checkedAt", T.StringType()), T.StructField("generatedAt", T.StringType()), T.StructField("_corrupt_record", T.StringType()),
    T.StructField("matches", T.ArrayType(T.StructType([T.StructField(n, k) for n, k in [
        ("returnRecordId", T.StringType()), ("status", T.StringType()), ("outcome", T.StringType()), ("matchedAmount", T.DoubleType()),
        ("postedDate", T.StringType()), ("accountLast4", T.StringType()), ("accountName", T.StringType()), ("merchantName", T.StringType()),
        ("confidence", T.StringType()), ("reason", T.StringType()), ("checkedAt", T.StringType())]])))])


#: Columns that the row operators read, with their types; a table without one of them counts as holding nulls there.
ORDER_COLUMNS = {
    "record_id": "string", "purchase_cents": "bigint", "canonical_refund_cents": "bigint", "card_last4": "string", "order_date": "date",
    "status": "string", "status_text": "string", "item_names": "array<string>", "asins": "array<string>", "order_details_url": "string",
    "order_data_complete": "boolean", "detail_scan_complete": "boolean", "terminal_cancelled": "boolean", "expected_returns": "bigint",
    "processing_error": "string", "processing_state": "string", "last_scanned_at": "timestamp"}
RETURN_COLUMNS = {
    "record_id": "string", "return_token": "string", "return_status_url": "string", "return_item_id": "string", "item_names": "array<string>",
    "asins": "array<string>", "item_identity_source": "string", "identity_conflict": "boolean", "refund_cents": "bigint",
    "refund_subtotal_cents": "bigint", "refund_scope": "string", "group_refund_cents": "bigint", "return_stage": "string", "status": "string",
    "status_text": "string", "card_last4": "string", "authoritative": "boolean", "bank_status": "string", "manual_state": "string",
    "expected_credit_at": "timestamp", "refund_issued_at": "timestamp", "step_dates": "array<string>", "last_scanned_at": "timestamp"}
ITEM_COLUMNS = {
    "pos": "int", "item_key": "string", "asin": "string", "item_name": "string", "quantity": "int", "item_amount_cents": "bigint",
    "fulfillment_status": "string", "replacement_stage": "string", "replacement_status_text": "string"}


def completed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with all of `columns` in their types. Lists may be given as one value: item_name for item_names, asin for asins."""
    single = {"item_names": "item_name", "asins": "asin"}
    made = {}
    for c, kind in columns.items():
        one = single.get(c)
        if c in df.columns:
            made[c] = F.col(c).cast(kind)
        elif one in df.columns:
            # a filter, which Spark keeps out of the generated method of an aggregate below: that one would grow past what the JVM compiles
            made[c] = F.filter(F.array(F.col(one).cast("string")), lambda x: x.isNotNull())
        else:
            made[c] = F.lit(None).cast(kind)
    return df.withColumns(made)


def ranked(col: Column, ranks: dict[str, int]) -> Column:
    """Rank of a name by a fixed table; unknown names and null rank 0."""
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(col)), F.lit(0))


def stage_rank(col: Column) -> Column:
    return ranked(col, RETURN_STAGES)


def stage_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, STAGE_NAMES)), rank)
