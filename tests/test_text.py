"""Text and URL facts on small pages."""

import pytest
from pyspark.sql import functions as F

from ledgerwright.functions import text as X

ORDER = "112-1234567-7654321"


@pytest.fixture(scope="module")
def ev(spark):
    def run(make, *values):
        df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
        got = df.select(make(*[F.col(c) for c in df.columns]).alias("x")).first().x
        return got.asDict(True) if hasattr(got, "asDict") else got
    return run


@pytest.mark.parametrize("text, cents", [("Order Total: $1,234.50", 123450), ("Grand total\n$9", 900), ("Order Summary\nItems: $3\nTotal: $7.25", 725), ("Total $4.00", None), ("", None), (None, None)])
def test_purchase(ev, text, cents):
    assert ev(X.purchase_cents, text) == cents


def test_refunds(ev):
    assert ev(X.refund_cents, "Refund has been issued for $74.76 today") == 7476
    assert ev(X.refund_cents, "$5.00 will be credited") == 500
    assert ev(X.canonical_refund_cents, "x\nRefund Total $12.50\ny") == 1250
    assert ev(X.canonical_refund_cents, "Your Refund Total is $12.50") is None
    assert ev(X.refund_cents, "nothing here") is None


@pytest.mark.parametrize("text, card", [
    ("Payment method\nVisa ending in 1234", "1234"), ("Mastercard\nending in 5678", "5678"), ("Refund method\n**** 4321", "4321"), ("Gift card ending in 1111", None), ("Card ending in 2222", None), ("Total 3333", None)])
def test_card(ev, text, card):
    assert ev(X.card_last4, text) == card


def test_payment_lines(ev):
    assert ev(X.payment_evidence, "a\nPayment method\nb\nc\nd\ne") == ["Payment method", "b", "c", "d"]


@pytest.mark.parametrize("text, stage", [
    ("Return started\nDropped off\nReturn received\nRefund issued\nRefund credited", "started"), ("We have received your return", "received"), ("Please drop off your return by Friday", "started"), ("Your return was dropped off", "shipped"),
    ("Your refund has been issued", "refund_issued"), ("Your refund was credited to your card", "credited"), ("Delivered Monday", "unknown"), (None, "unknown")])
def test_stage(ev, text, stage):
    assert ev(X.milestones, text)["stage"] == stage


def test_timeline_dates(ev):
    m = ev(X.milestones, "Sep 1\nInitiated\nSep 2\nDropped off\nYour refund has been issued\nSep 4\nRefund issued\nSep 7\nRefund credited")
    assert m["stage"] == "refund_issued" and m["expected_credit_date"] == "Sep 7"
    assert (m["started"]["date"], m["shipped"]["date"], m["refund_issued"]["date"]) == ("Sep 1", "Sep 2", "Sep 4") and m["credited"] == {"done": False, "date": None}
    assert ev(X.expected_credit_date, "It will be credited to your card by Jun 2, 2026") == "Jun 2, 2026"


def test_status_text(ev):
    assert ev(lambda t: X.status_text(F.lit("received"), t), "Hello\nWe received your return\nx") == "We received your return"
    assert ev(lambda t: X.status_text(F.lit("unknown"), t), "Refund issued\nArriving Tuesday") == "Arriving Tuesday"


@pytest.mark.parametrize("text, want", [
    ("Replacement ordered", ("ordered", False)), ("Your replacement has been delivered\nReplacement ordered", ("delivered", False)), ("There's no need to return your item\nA replacement was arranged", ("detected", True)), ("A replacement exists", (None, False))])
def test_replacement(ev, text, want):
    got = ev(X.replacement, text)
    assert (got["stage"], got["no_return_required"]) == want


def test_urls(ev):
    u = f"https://shop.example.com/returns/status?orderId={ORDER}&rmaId=RMA-1234567&itemId=i9&ref=x#time/2024/pagination/3"
    assert ev(X.url_order_id, u) == ORDER and ev(X.url_return_token, u) == "RMA-1234567"
    assert ev(X.history_year, u) == 2024 and ev(X.history_page, u) == 3
    assert ev(X.location_key, u) == u.replace("&ref=x", "")
    assert ev(X.location_key, "https://a.example.com/x?ref_=1&tag=2#top") == "https://a.example.com/x"
    assert ev(X.history_page, "https://a.example.com/orders?startIndex=20") == 3 and ev(X.history_page, "https://a.example.com/orders") == 1
    assert ev(X.url_return_token, "https://a.example.com/returns/label/ABCD12345678") == "ABCD12345678"
    assert ev(X.sanitized_url, "https://a.example.com/x?orderId=1&secret=2") == "https://a.example.com/x?orderId=1"


def test_gates_and_types(ev):
    assert ev(X.page_gate, "please type the characters you see") == "blocked"
    assert ev(X.page_gate, "Sign in\nx") == "sign_in" and ev(X.page_gate, f"Sign in\n{ORDER}") == "ok"
    assert ev(lambda t: X.page_gate(t, F.lit(503)), "fine") == "rate_limited"
    kind = lambda u, t: ev(X.page_type, u, t)
    assert kind("https://a.example.com/your-orders/order-details?orderID=1", "") == "order_detail"
    assert kind("https://a.example.com/your-orders/orders?x=1", "") == "order_history"
    assert kind("https://a.example.com/returns/status", "") == "return" and kind("https://a.example.com/", "Return summary\nRefund method") == "return"
    ready = lambda job, u, t: ev(lambda a, b, c: X.page_ready(a, b, c, F.lit(ORDER), F.lit(True)), job, u, t)
    assert ready("detail", f"https://a.example.com/order-details?orderID={ORDER}", "Order Summary") and not ready("detail", "https://a.example.com/x", "Order Summary")
    assert ready("history", "", ORDER) and not ready("history", "", "none")


def test_terminal_and_complete(ev):
    done = lambda t: ev(lambda c: X.terminal_cancelled(c, F.lit(ORDER), F.lit(False)), t)
    assert done(f"{ORDER}\nCancelled\nTotal\n$0.00") and not done(f"{ORDER}\nCancelled\nTotal\n$1.00") and not done(f"{ORDER}\nCancellation requested\nTotal\n$0.00")
    full = lambda total: ev(lambda u: X.detail_complete(u, F.lit(ORDER), F.lit("Jun 2"), F.lit(total).cast("long"), F.lit(1)), f"https://a.example.com/order-details?orderID={ORDER}")
    assert full(5) and not full(None)


def test_record_ids(ev):
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    made = lambda **k: ev(lambda o: X.record_id(F.lit("return"), o, F.lit("T 1"), k.get("item", none), k.get("asins", empty), k.get("names", empty), F.lit(k.get("prov", False)), F.lit(k.get("cents")).cast("long")), ORDER)
    assert made(item=F.lit("i1")) == f"return:{ORDER}:t-1:i1" and made(asins=F.array(F.lit("B1"))) == f"return:{ORDER}:t-1:B1"
    assert made(names=F.array(F.lit("A Big Thing!"))) == f"return:{ORDER}:t-1:a-big-thing" and made(prov=True) == f"return:{ORDER}:t-1:pending"
    assert made(cents=500) == f"return:{ORDER}:t-1:500" and made() == f"return:{ORDER}:t-1:unknown"
