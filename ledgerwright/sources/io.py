"""Reading and writing of captures, ledgers, bank files, exports and event logs."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import schema
from ..operators.coverage import newest_keys
from ..operators.merge import diff_ledger
from ..operators.queries import money_text
from .shared import brief_shuffles


def read_page_captures(spark: SparkSession, path: str, streaming: bool = False, format: str = "parquet") -> DataFrame:
    """Captured pages with a fixed schema, as a table or as a stream of arriving files."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema.PAGE_CAPTURE).format(format).load(path)


def bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """df with the bucket of its (account, order)."""
    return df.withColumn("bucket", F.pmod(F.xxhash64("account_id", "order_id"), F.lit(buckets)).cast("int"))


def write_ledger(df: DataFrame, path: str, before: DataFrame | None = None, buckets: int = 64, tasks: int | None = None) -> bool:
    """Writes a new whole version of the ledger, partitioned by a bucket of (account, order); skipped if nothing changed from `before`.

    Versions are folders `v=<millis>`; readers take the newest complete one, so a failed write is never seen. `tasks`
    (all shuffle partitions by default) spread over the buckets, so a bucket may have several files and the number of
    buckets bounds nothing. drop_old_versions() removes old ones.
    """
    if before is not None and diff_ledger(before, df).where("change <> 'unchanged'").isEmpty():
        return False
    tasks = tasks or max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = F.pmod(F.xxhash64("record_id"), F.lit(-(-tasks // buckets)))
    bucketed(df, buckets).repartition(tasks, "bucket", spread).write.partitionBy("bucket").parquet(f"{path.rstrip('/')}/v={int(time.time() * 1000)}")
    return True


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all but the newest `keep` complete versions of a ledger, and failed writes older than these; how many went.

    Readers of an older version must have ended.
    """
    fs, p = _hadoop(spark, path)
    jvm = spark.sparkContext._jvm
    versions = sorted((s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")), key=str, reverse=True)
    done = [v for v in versions if fs.exists(jvm.org.apache.hadoop.fs.Path(v, "_SUCCESS"))][:keep]
    gone = [v for v in versions if done and str(v) < str(done[-1])]
    for v in gone:
        fs.delete(v, True)
    return len(gone)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The newest version whose write ended (it holds _SUCCESS)."""
    fs, p = _hadoop(spark, path)
    jvm = spark.sparkContext._jvm
    names = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")]
    done = [str(x) for x in names if fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    if not done:
        raise FileNotFoundError(f"no complete ledger version under {path}")
    return spark.read.parquet(max(done)).drop("bucket")


def read_bank_results(spark: SparkSession, path: str, request_id: str, tag: str = "bank-reconciliation-result/1", account_id: str = "main") -> tuple[DataFrame, DataFrame]:
    """(matches, rejects) of JSON documents; documents that are malformed, of another schema or request, or without an array are rejected.

    A document names its account in accountId, as the request does; one that names none belongs to `account_id`. All its matches were
    checked at its checkedAt, else its generatedAt, else their own.
    """
    docs = spark.read.schema(schema.BANK_RESULTS).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    problem = (
        F.when(F.col("_corrupt_record").isNotNull(), "malformed").when(~F.col("schema").eqNullSafe(tag), "schema")
        .when(~F.col("requestId").eqNullSafe(request_id), "request").when(F.col("matches").isNull(), "matches"))
    judged = docs.withColumn("problem", problem)
    m = judged.where("problem IS NULL").select("requestId", F.coalesce("accountId", F.lit(account_id)).alias("account_id"), F.coalesce("checkedAt", "generatedAt").alias("at"), F.explode("matches").alias("m"))
    matches = m.select(
        "account_id", F.col("requestId").alias("request_id"), F.col("m.returnRecordId").alias("return_record_id"), "m.status", "m.outcome", F.col("m.matchedAmount").alias("matched_amount"), F.col("m.postedDate").alias("posted_date"),
        F.col("m.accountLast4").alias("account_last4"), F.col("m.accountName").alias("account_name"), F.col("m.merchantName").alias("merchant_name"), "m.confidence", "m.reason", F.coalesce("at", "m.checkedAt").try_cast("timestamp").alias("checked_at"))
    return matches, judged.where("problem IS NOT NULL").select("schema", "requestId", "problem")


# Names of a request's fields.
REQUEST_FIELDS = {
    "return_record_id": "returnRecordId", "return_token": "returnToken", "order_id": "orderId", "item_names": "itemNames", "expected_cents": "expectedRefund", "card_last4": "paymentCardLast4",
    "refund_issued_at": "refundIssuedDate", "expected_credit_at": "expectedCreditDate", "stage": "stage", "shop_status": "shopStatus"}


def _request_field(c: str) -> Column:
    """A column as the document shows it: money in units, times as dates."""
    return F.col(c) / 100 if c == "expected_cents" else F.date_format(c, "yyyy-MM-dd") if c in ("refund_issued_at", "expected_credit_at") else F.col(c)


def write_bank_requests(requests: DataFrame, path: str, request_id: str, tag: str = "bank-reconciliation-request/1", most: int = 10_000, generated_at: str | None = None) -> None:
    """JSON documents of policy and returns to look for: one an account, more where an account has over `most` returns.

    So no document, and no row that a task holds, grows with an account; all of an account's documents share the request id.
    """
    policy = F.struct(F.lit(schema.TOLERANCE_CENTS).alias("toleranceCents"), F.lit(True).alias("postedOnlyConfirms"), F.lit(True).alias("oneCreditOneRefund"), F.lit(True).alias("preferSameCardLast4"), F.lit(True).alias("preferMerchantEvidence"))
    at = F.date_format(F.lit(generated_at).cast("timestamp") if generated_at else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    own = F.struct(*[_request_field(c).alias(REQUEST_FIELDS.get(c, c)) for c in requests.columns if c != "account_id"])
    parts = F.ceil(F.count("*").over(W.partitionBy("account_id")) / most)
    dealt = requests.withColumn("__part", F.pmod(F.xxhash64("return_record_id"), parts))
    doc = dealt.groupBy("account_id", "__part").agg(F.array_sort(F.collect_list(own)).alias("returns"))
    doc.select(F.lit(tag).alias("schema"), F.lit(request_id).alias("requestId"), at.alias("generatedAt"), policy.alias("policy"), F.col("account_id").alias("accountId"), "returns").write.json(path)


# Columns of the export, in order.
EXPORT_COLUMNS = (
    "status", "order_id", "product_count", "returned_product_count", "items", "product_statuses", "order_total", "expected_refund",
    "card_last4", "shop_status", "detail_complete", "order_details_url", "last_scanned_at")


def ledger_export(rows: DataFrame) -> DataFrame:
    """Complete order rows in the 13 columns of the export, all as text: lists joined by ' | ', money in units, unknown values empty."""
    money = lambda c: F.coalesce(money_text(F.col(c)), F.lit(""))
    values = [
        F.col("label"), F.col("order_id"), F.when(F.col("n_items") > 0, F.col("n_items")).otherwise(F.size("item_names")).cast("string"), F.col("n_returned_items").cast("string"),
        F.array_join("item_names", " | "), F.array_join("product_statuses", " | "), money("purchase_cents"), money("refund_cents"), F.coalesce("card_last4", F.lit("")), F.col("shop_status"),
        F.col("detail_complete").cast("string"), F.col("open_url"), F.coalesce(F.date_format("last_scanned_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))]
    return rows.where("data_complete").select(*[v.alias(c) for v, c in zip(values, EXPORT_COLUMNS)])


def export_ledger_csv(rows: DataFrame, path: str) -> None:
    """ledger_export() as CSV with a header a file: every cell quoted, quotes doubled. Needs a UTC session for last_scanned_at."""
    ledger_export(rows).write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def export_ledger_json(rows: DataFrame, ledger: DataFrame, path: str, compression: str = "gzip") -> None:
    """Rows and ledger as JSON lines with all their columns. Names are repeated in each line, so files are compressed unless `compression` is "none"."""
    with brief_shuffles(rows.sparkSession):
        rows.write.json(f"{path.rstrip('/')}/rows", compression=compression)
        ledger.write.json(f"{path.rstrip('/')}/ledger", compression=compression)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def latest_events(events: DataFrame, n: int = schema.MAX_EVENTS) -> DataFrame:
    """The newest n events of each account."""
    return newest_keys(events, n, [F.col("at").desc(), F.col("event_id").desc()])
