"""Matching issued refunds with bank credits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import schema
from ..functions.arrays import array_union_ci
from ..sources.shared import fresh_folder
from .rows import KEY, filled

#: What a result tells beside status, amount and time, and all columns that an applied result fills.
RESULT_COLUMNS = {
    "posted_date": "date", "account_last4": "string", "account_name": "string", "merchant_name": "string", "confidence": "string", "reason": "string", "request_id": "string"}
BANK_COLUMNS = {
    "bank_status": "string", "bank_cents": "bigint", "bank_verified_at": "timestamp", "bank_checked_at": "timestamp"} | {f"bank_{c}": t for c, t in RESULT_COLUMNS.items()}
STATUSES = ["confirmed", "pending", "not_found", "ambiguous", "needs_review"]


def bank_request(returns: DataFrame, rows: DataFrame) -> DataFrame:
    """What to look for at the bank, one row a record: the returns of complete orders whose refund is issued and not confirmed yet.

    returns are those that count (rows.used_returns), rows the order rows. Unknown amounts stay null, a refund falls
    back to its subtotal; names are those of the record, then of the order; the card is the record's, else the order's.
    """
    own = rows.where("data_complete").select(*KEY, F.col("item_names").alias("__names"), F.col("card_last4").alias("__card"))
    due = returns.where((F.col("rank") >= 4) & ~F.col("bank_confirmed")).join(own, KEY)
    optional = {"refund_issued_at": "timestamp"}
    due = due.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in due.columns})
    out = due.select(
        "account_id", F.col("record_id").alias("return_record_id"), "order_id", "return_token", array_union_ci(F.col("item_names"), F.col("__names")).alias("item_names"),
        F.coalesce("refund_cents", "refund_subtotal_cents").alias("expected_cents"), F.coalesce(filled(F.col("card_last4")), F.col("__card")).alias("card_last4"),
        "refund_issued_at", "expected_credit_at", "stage", F.coalesce(filled(F.col("status_text")), filled(F.col("status"))).alias("shop_status"))
    return out.dropDuplicates(["account_id", "return_record_id"])


def validate_bank_results(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): status from status or outcome, one of five, in any case; a finite amount or none; a record id.

    The last four characters of the account, and texts cut at fixed lengths, are kept. Columns that matches lacks
    (account_id among them) are null.
    """
    texts = ["account_id", "return_record_id", "status", "outcome", "posted_date", "account_last4", "account_name", "merchant_name", "confidence", "reason", "request_id"]
    full = schema.completed(matches, {c: "string" for c in texts} | {"matched_amount": "double", "checked_at": "timestamp"})
    status, amount = F.lower(F.coalesce(filled(F.col("status")), F.col("outcome"))), F.col("matched_amount")
    problem = (
        F.when(~F.coalesce(status.isin(STATUSES), F.lit(False)), "status").when(amount.isNotNull() & (F.isnan(amount) | (F.abs(amount) >= 1e13)), "amount is no number")
        .when(filled(F.col("return_record_id")).isNull(), "no record id"))
    out = full.select(
        "account_id", "return_record_id", status.alias("status"), F.when(~F.isnan(amount) & (F.abs(amount) < 1e13), F.round(amount * 100).cast("long")).alias("matched_cents"),
        F.try_to_date("posted_date", "yyyy-MM-dd").alias("posted_date"), F.right(filled(F.col("account_last4")), F.lit(4)).alias("account_last4"),
        *[F.substring(c, 1, n).alias(c) for c, n in (("account_name", 120), ("merchant_name", 160), ("confidence", 40), ("reason", 500))], "checked_at", "request_id", problem.alias("problem"))
    return out.where("problem IS NULL").drop("problem"), out.where("problem IS NOT NULL")


def apply_bank_results(returns: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(returns with bank columns, rejects). All rows are checked first, then the good ones applied together.

    A result belongs to the record of its account and record id. Rejected: a record that the ledger lacks, and a confirmed
    amount further than the tolerance from the expected one (refund, else subtotal; an unknown one is not checked). Of
    several results of a record counts the one with the newest checked_at, then the first by status and amount. A record
    with a result takes all of it, in columns that begin with bank_; all other records keep what they had.
    """
    key = ["account_id", "return_record_id"]
    w = W.partitionBy(*key).orderBy(F.col("checked_at").desc_nulls_last(), "status", "matched_cents")
    one = results.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    full = schema.completed(returns, {"refund_cents": "bigint", "refund_subtotal_cents": "bigint"})
    known = full.select("account_id", F.col("record_id").alias("return_record_id"), F.coalesce("refund_cents", "refund_subtotal_cents").alias("__expected"), F.lit(True).alias("__known"))
    seen = one.join(known, key, "left")
    off = F.coalesce((F.col("status") == "confirmed") & (F.abs(F.col("matched_cents") - F.col("__expected")) > schema.TOLERANCE_CENTS), F.lit(False))
    judged = seen.withColumn("problem", F.when(F.col("__known").isNull(), "missing").when(off, "amount"))
    good = judged.where("problem IS NULL").select(
        "account_id", F.col("return_record_id").alias("record_id"), F.struct(
            F.col("status").alias("bank_status"), F.col("matched_cents").alias("bank_cents"), F.when(F.col("status") == "confirmed", F.col("checked_at")).alias("bank_verified_at"),
            F.col("checked_at").alias("bank_checked_at"), *[(F.col(c) if c in results.columns else F.lit(None).cast(t)).alias(f"bank_{c}") for c, t in RESULT_COLUMNS.items()]).alias("__bank"))
    held = schema.completed(returns, BANK_COLUMNS)
    laid = {c: F.when(F.col("__bank").isNotNull(), F.col(f"__bank.{c}")).otherwise(F.col(c)) for c in BANK_COLUMNS}
    applied = held.join(good, ["account_id", "record_id"], "left").withColumns(laid).drop("__bank")
    return applied, judged.where("problem IS NOT NULL").select(*key, "status", "matched_cents", "problem")


def import_counters(results: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row: results, applied, confirmed, to review, missing."""
    a = results.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "confirmed").alias("c"), F.count_if(F.col("status").isin("ambiguous", "needs_review")).alias("r"))
    b = rejects.agg(F.count("*").alias("x"), F.count_if(F.col("problem") == "missing").alias("m"), F.count_if((F.col("problem") == "amount") & (F.col("status") == "confirmed")).alias("xc"))
    both = a.select("n", "c", "r", F.lit(0).alias("x"), F.lit(0).alias("m"), F.lit(0).alias("xc")).unionByName(b.select(F.lit(0).alias("n"), F.lit(0).alias("c"), F.lit(0).alias("r"), "x", "m", "xc"))
    s = both.agg(*[F.sum(c).alias(c) for c in ("n", "c", "r", "x", "m", "xc")])
    return s.select((F.col("n") - F.col("x")).alias("n_applied"), (F.col("c") - F.col("xc")).alias("n_confirmed"), F.col("r").alias("n_review"), F.col("m").alias("n_missing"))


def candidate_credits(requests: DataFrame, transactions: DataFrame) -> DataFrame:
    """Pairs within the tolerance and not posted before the refund was issued, with a score.

    The band on cents becomes an equality: each request looks for its amount and its neighbours, so this is a hash join with
    one residual condition. Score: same card 4, merchant evidence 2, posted rather than pending 1.
    """
    keys = F.array(*[F.lit(d) for d in range(-schema.TOLERANCE_CENTS, schema.TOLERANCE_CENTS + 1)])
    r = requests.where("expected_cents IS NOT NULL").withColumn("__c", F.explode(F.transform(keys, lambda d: F.col("expected_cents") + d)))
    j = r.join(transactions.withColumnRenamed("amount_cents", "__c"), ["account_id", "__c"])
    j = j.where(F.col("posted_at") >= F.coalesce("refund_issued_at", "posted_at"))
    score = 4 * F.coalesce((F.col("card_last4") == F.col("txn_last4")).cast("int"), F.lit(0)) + 2 * F.coalesce(F.col("merchant_match").cast("int"), F.lit(0)) + (F.col("txn_state") == "posted").cast("int")
    return j.select("account_id", "request_id", "txn_id", F.col("__c").alias("amount_cents"), "posted_at", "txn_state", score.alias("score"))


#: What a row of _places() stands for: a request or a credit; the other's id is null.
ENTITY = ["account_id", "credit", "request_id", "txn_id"]


def _places(requests: DataFrame, transactions: DataFrame) -> DataFrame:
    """Requests at their amount and its neighbours, and credits at theirs, as one table of places (account, cents).

    worth is a credit's score without the card. Null accounts and amounts have no place.
    """
    near = F.array(*[F.lit(d) for d in range(-schema.TOLERANCE_CENTS, schema.TOLERANCE_CENTS + 1)])
    worth = 2 * F.coalesce(F.col("merchant_match").cast("int"), F.lit(0)) + (F.col("txn_state") == "posted").cast("int")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    r = requests.where("account_id IS NOT NULL AND expected_cents IS NOT NULL").select(
        "account_id", F.explode(F.transform(near, lambda d: F.col("expected_cents") + d)).alias("cents"), F.lit(False).alias("credit"), "request_id", none(transactions, "txn_id"),
        F.col("refund_issued_at").alias("at"), F.col("card_last4").alias("card"), F.lit(None).cast("int").alias("worth"))
    t = transactions.where("account_id IS NOT NULL AND amount_cents IS NOT NULL AND posted_at IS NOT NULL").select(
        "account_id", F.col("amount_cents").alias("cents"), F.lit(True).alias("credit"), none(requests, "request_id"), "txn_id", F.col("posted_at").alias("at"), F.col("txn_last4").alias("card"), worth.alias("worth"))
    return r.unionByName(t)


def _only_bests(places: DataFrame) -> DataFrame:
    """Requests and credits that have candidates, each with its only best one: account_id, credit, request_id, txn_id, sole, posted, n_candidates.

    Unless sole, the other's id means nothing. n_candidates is that of requests. No pair is formed, so this grows with the rows: in a place, running counts of
    the credits from a request's time on, and of the requests up to a credit's time, tell how many candidates have each score.
    The card outweighs all else, so counts within a card and over all cards suffice. A credit of unknown state is a candidate, never a best.
    """
    from_then = [F.col("at").desc_nulls_last(), F.col("credit").desc()]
    until_then = [F.col("at").asc_nulls_first(), F.col("credit").asc()]
    counts = {}
    for name, by in (("all", ["account_id", "cents"]), ("own", ["account_id", "cents", "card"])):
        later, sooner = (W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow) for order in (from_then, until_then))
        for k in range(4):
            such = F.col("worth") == k
            counts |= {f"n_{name}_{k}": F.count(F.when(such, 1)).over(later), f"id_{name}_{k}": F.max(F.when(such, F.col("txn_id"))).over(later)}
        counts |= {f"n_{name}": F.count(F.when(~F.col("credit"), 1)).over(sooner), f"id_{name}": F.max("request_id").over(sooner)}
        if name == "all":
            counts["n_credits"] = F.count(F.when(F.col("credit"), 1)).over(later)
    x = places.withColumns(counts)
    carded = F.col("card").isNotNull()
    found = lambda cond, score, n, r, t: F.when(cond & (F.col(n) > 0), F.struct(score.cast("int").alias("score"), F.col(n).alias("n"), F.col(r).alias("r"), F.col(t).alias("t")))
    of_request = [found(cond, F.lit(top + k), f"n_{name}_{k}", "request_id", f"id_{name}_{k}") for name, top, cond in (("own", 4, carded), ("all", 0, F.lit(True))) for k in (3, 2, 1, 0)]
    of_credit = [found(cond & F.col("worth").isNotNull(), F.col("worth") + top, f"n_{name}", f"id_{name}", "txn_id") for name, top, cond in (("own", 4, carded), ("all", 0, F.lit(True)))]
    x = x.where(F.when(F.col("credit"), F.col("n_all")).otherwise(F.col("n_credits")) > 0)
    x = x.select(*ENTITY, F.when(F.col("credit"), F.coalesce(*of_credit)).otherwise(F.coalesce(*of_request)).alias("b"), "n_credits")
    ties = [F.sum(F.when(F.col("b.score") == k, F.col("b.n"))).alias(f"t{k}") for k in range(8)]
    g = x.groupBy(*ENTITY).agg(F.max(F.struct("b.score", "b.r", "b.t")).alias("top"), F.sum("n_credits").alias("n"), *ties)
    sole = F.coalesce(F.get(F.array(*[f"t{k}" for k in range(8)]), F.col("top.score")) == 1, F.lit(False))
    return g.select(
        "account_id", "credit", F.when(F.col("credit"), F.col("top.r")).otherwise(F.col("request_id")).alias("request_id"), F.when(F.col("credit"), F.col("txn_id")).otherwise(F.col("top.t")).alias("txn_id"),
        sole.alias("sole"), (F.col("top.score") % 2 == 1).alias("posted"), F.when(~F.col("credit"), F.col("n")).alias("n_candidates"))


def _matched(places: DataFrame) -> DataFrame:
    """Requests with candidates: account_id, request_id, n_candidates, won (whether a credit and it are each other's only best), and that credit's txn_id, posted."""
    views = _only_bests(places).where("sole OR NOT credit").withColumns({c: F.when(F.col("sole"), F.col(c)) for c in ("txn_id", "posted")})
    both = views.groupBy("account_id", "request_id", "txn_id", "sole").agg(F.max("n_candidates").alias("n_candidates"), F.count("*").alias("views"), F.bool_or("posted").alias("posted"))
    won = F.col("sole") & (F.col("views") == 2)
    return both.where("n_candidates IS NOT NULL").select(
        "account_id", "request_id", F.when(won, F.col("txn_id")).alias("txn_id"), F.when(won, F.col("posted")).alias("posted"), won.alias("won"), "n_candidates")


def reconcile_credits(requests: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row a request: status, txn_id, n_candidates.

    A credit and a request belong together if each is the other's only best (by score) candidate. A request whose best
    credits tie, or whose best credit prefers another request, is ambiguous; without candidates it is not found. Only a
    posted credit confirms; a pending one gives pending. A credit thus serves one request at most.
    """
    out = requests.select("account_id", "request_id").join(_matched(_places(requests, transactions)), ["account_id", "request_id"], "left")
    status = F.when(F.col("n_candidates").isNull(), "not_found").when(~F.col("won"), "ambiguous").when(F.col("posted"), "confirmed").otherwise("pending")
    return out.select("account_id", "request_id", status.alias("status"), "txn_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def reconcile_rounds(requests: DataFrame, transactions: DataFrame) -> DataFrame:
    """reconcile_credits() again and again among the requests and credits that are left, until no pair is each other's only best.

    A request whose best credit went to another one can so take its next. What is left with candidates ties: ambiguous. A
    request whose candidates all went to others, or that had none, is not found. n_candidates counts what it had at first.
    Each round writes its outcome and the requests and credits that are left to the shared folder; only whether a round matched
    anything reaches the driver. Null accounts and amounts have no candidates.
    """
    spark, at = requests.sparkSession, fresh_folder(requests.sparkSession, "rounds")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    left, n, rounds = stored(_places(requests, transactions), "left-0"), 0, []
    while True:
        n += 1
        rounds.append(stored(_matched(left), f"round-{n}"))
        won = rounds[-1].where("won")
        if won.isEmpty():
            break
        ids = F.array(F.struct(F.lit(False).alias("credit"), "request_id", F.lit(None).cast(left.schema["txn_id"].dataType).alias("txn_id")), F.struct(F.lit(True).alias("credit"), F.lit(None).cast(left.schema["request_id"].dataType).alias("request_id"), "txn_id"))
        gone = won.select("account_id", F.explode(ids).alias("e")).select("account_id", "e.*").alias("g")
        left = stored(left.alias("l").join(gone, [F.col(f"l.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ENTITY], "left_anti"), f"left-{n}")
    key = ["account_id", "request_id"]
    hits = reduce(DataFrame.unionByName, [x.where("won").select(*key, "txn_id", "posted") for x in rounds]).withColumn("won", F.lit(True))
    outcome = rounds[0].select(*key, "n_candidates").join(hits, key, "left").join(rounds[-1].select(*key, F.lit(True).alias("open")), key, "left")
    out = requests.select(*key).join(outcome, key, "left")
    status = F.when(F.col("won") & F.col("posted"), "confirmed").when(F.col("won"), "pending").when(F.col("open"), "ambiguous").otherwise("not_found")
    return out.select(*key, status.alias("status"), "txn_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def reconcile_grouped(requests: DataFrame, transactions: DataFrame, first: DataFrame) -> DataFrame:
    """A second pass: requests left over by `first` that share a return token are matched as one with the sum of their amounts."""
    left = requests.join(first.where("status IN ('not_found', 'ambiguous')").select("account_id", "request_id"), ["account_id", "request_id"], "left_semi").where("return_token IS NOT NULL")
    sums = left.groupBy("account_id", "return_token").agg(F.sum("expected_cents").alias("expected_cents"), F.count("*").alias("n"), F.count("expected_cents").alias("k"), F.max("refund_issued_at").alias("refund_issued_at"), F.max("card_last4").alias("card_last4")).where("n > 1 AND n = k")
    free = transactions.join(first.where("txn_id IS NOT NULL").select("account_id", "txn_id"), ["account_id", "txn_id"], "left_anti")
    hit = reconcile_credits(sums.withColumn("request_id", F.col("return_token")), free).where("txn_id IS NOT NULL").select("account_id", F.col("request_id").alias("return_token"), F.col("status").alias("g_status"), F.col("txn_id").alias("g_txn"))
    members = left.select("account_id", "request_id", "return_token").join(hit, ["account_id", "return_token"]).drop("return_token")
    return first.join(members, ["account_id", "request_id"], "left").select("account_id", "request_id", F.coalesce("g_status", "status").alias("status"), F.coalesce("g_txn", "txn_id").alias("txn_id"), "n_candidates")
