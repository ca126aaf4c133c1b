"""Facts from captured page text and URLs, as column expressions. All take and give columns; no Python runs on rows.

Functions of a page's text take a text column, or a Page: the normalised text and its lines as columns of their own
(with_page), so that many facts of one page share them.
"""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .arrays import bound

# Formats and phrases that pages use.
ORDER_ID = r"\b\d{3}-\d{7}-\d{7}\b"
#: The same ids, found by their digits first: a search for word boundaries looks at every character.
ORDER_ID_FAST = r"\d(?<=\b\d)\d{2}-\d{7}-\d{7}\b"
MONEY = r"\$\s*([0-9,]+(?:\.\d{2})?)"
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE = MONTH + r"\s+\d{1,2}(?:,\s*\d{4})?"
PURCHASE_LABELS = ["Order total", "Grand total", "Total charged", "Amount charged"]
REFUND_LABELS = ["Total refund", "Total estimated refund*", "Total estimated refund", "Estimated refund", "Refund amount", "Refund total", "Refund subtotal"]
CARD_BRANDS = r"(?:visa|master\s*card|american express|amex|discover|business card|store card|credit card|debit card)"
CARD_MARKS = r"(?:ending in|ending|last four|last 4|\*{2,}|[•·xX]{2,})"
GIFT = r"(?i)gift\s*card|gift certificate"
BLOCKED = r"(?i)sorry,? we just need to make sure|not a robot|enter the characters you see below|type the characters you see|captcha"
SIGN_IN = r"(?i)(?:^|\n)sign in(?:\n|$)|email or mobile phone number|enter your password"
THROTTLED = r"(?i)too many requests|request throttled|temporarily unavailable|service unavailable|please try again later"
CREDITED = r"your refund (?:has been|was) credited|we (?:have )?credited your refund|refund (?:has been|was) credited to|credited to your (?:original )?payment method on"
ISSUED = r"we (?:have )?issued your refund|your refund (?:has been|was) issued|refund has been issued|refund issued\s+(?:on|\$)"
RECEIVED = r"we (?:have )?received your return|your return (?:has been|was) received|received your return|item (?:has been|was) received|return processed|your return is complete|return (?:has been|was) completed|return received\s+(?:on|at)\b"
SHIPPED = r"your return (?:has been|was) dropped off|you (?:have )?dropped off your return|drop-?off complete|return (?:is|has been) in transit|on the way back|return (?:has been|was) shipped|shipped back|carrier (?:has )?received (?:your )?return|dropped off\s+(?:on|at)\b"
SHIPPED_LATER = r"drop.off your return by|please drop off|once you drop off|when you drop off|time you have dropped off|after you drop off|before you drop off"
STARTED = r"return request (?:is )?(?:confirmed|accepted)|return initiated|return started|accepted your return|drop.off your return by|return code|return summary|refund will be issued|estimated refund|refund method|refund subtotal|^initiated$"
STARTED_SAID = r"return request (?:is )?(?:confirmed|accepted)|return initiated|return started|accepted your return"
REFUND_WORDS = r"(?i)refund will be issued|estimated refund|refund method|refund subtotal"
BARE_LABELS = r"(?i)^(?:refund issued|refund credited|return received|drop off|dropped off|credited|initiated|credit pending)$"
NO_RETURN = r"(?i)(?:there['’]s|there is) no need to return (?:your )?(?:item|product)|(?:you (?:do not|don['’]t) need to|no need to) return (?:the |your )?(?:original )?(?:item|product)|no return (?:is )?required"
REPLACEMENT_RULES = [
    ("complete", r"replacement (?:is |has been |was )?completed?"),
    ("delivered", r"replacement (?:has been |was |is )?delivered"),
    ("shipped", r"replacement (?:has been |was |is )?shipped|replacement is on the way"),
    ("ordered", r"replacement (?:has been |was |is )?ordered|replacement order (?:has been|was) placed|replacement approved"),
    ("requested", r"replacement (?:has been |was |is )?requested|replacement request (?:is )?(?:confirmed|approved)|we(?:['’]ll| will) send (?:you )?a replacement|replacement (?:is )?being prepared|replacement arriving"),
]
STEP_LABELS = {
    "started": ["Initiated", "Return initiated", "Return started"], "shipped": ["Dropped off", "Drop off", "Return shipped", "Shipped"],
    "received": ["Return received", "Received"], "refund_issued": ["Refund issued"], "credited": ["Refund credited", "Credited"]}
DETAIL_ROUTE = r"(?i)order-?details?|/gp/css/summary/edit\.html(?:[/?#]|$)"
HISTORY_ROUTE = r"(?i)/gp/your-account/order-history|/gp/css/order-history|/your-orders/orders(?:[/?#]|$)"
RETURN_ROUTE = r"(?i)/spr/returns/(?:prep|label|cart)|/returns?/(?:status|details)|return-status|/refund(?:/|\?|$)"
SUMMARY_WORDS = r"(?i)Order Summary|Grand Total|Item\(s\) Subtotal|Total before tax|Order total"
CHECK_STATUS = r"(?i)check return (?:&|and) refund status"
LIFECYCLE_WORDS = r"(?i)Initiated|Return request|Drop off|Dropped off|Return received|Refund issued|Refund credited|Replacement"


def quoted(label: str) -> str:
    """A label as a literal of a regular expression."""
    return r"\Q" + label + r"\E"


def normalize(text: Column) -> Column:
    """NBSP to blank, CR removed, runs of blanks to one, three or more line breaks to two, trimmed; null to ''."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), " ", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\r", ""), r"[\t ]+", " ")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def split_lines(normalised: Column) -> Column:
    return F.filter(F.transform(F.split(normalised, "\n"), lambda x: F.trim(x)), lambda x: x != "")


class Page(NamedTuple):
    """Normalised text and its non-empty lines."""

    text: Column
    lines: Column


def page(text: "Column | Page") -> Page:
    return text if isinstance(text, Page) else Page(normalize(text), split_lines(normalize(text)))


def with_page(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, Page]:
    """df with the columns __text and __lines, and the Page that they make up."""
    out = df.withColumn("__text", normalize(F.col(text_col))).withColumn("__lines", split_lines(F.col("__text")))
    return out, Page(F.col("__text"), F.col("__lines"))


def any_label(labels: list[str]) -> str:
    return "(?i)" + "|".join(quoted(label) for label in labels)


def first_line(ls: Column, *patterns: str, but: str | None = None) -> Column:
    ok = lambda x: reduce(lambda a, b: a | b, [x.rlike("(?i)" + p) for p in patterns]) & (~x.rlike(but) if but else F.lit(True))
    return F.get(F.filter(ls, ok), F.lit(0))


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)


def cents(amount: Column) -> Column:
    """'1,234.50' or '12' -> whole cents."""
    plain = F.regexp_replace(amount, ",", "")
    return (F.try_to_number(F.when(plain.contains("."), plain).otherwise(F.concat(plain, F.lit(".00"))), F.lit("999999999999.99")) * 100).cast("long")


# --- gates and routes ---------------------------------------------------------------------------------------------


def page_gate(text: Column, http_status: Column | None = None, fetched: bool = False) -> Column:
    """ok, blocked, sign_in or rate_limited. A rendered page with an order id is neither a sign-in nor a throttle page."""
    body = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>", " ") if fetched else text
    no_order = F.lit(True) if fetched else ~text.rlike(ORDER_ID)
    limited = body.rlike(THROTTLED) & no_order
    if http_status is not None:
        limited = limited | F.coalesce(http_status.isin(429, 503), F.lit(False))
    return F.when(body.rlike(BLOCKED), "blocked").when(body.rlike(SIGN_IN) & no_order, "sign_in").when(limited, "rate_limited").otherwise("ok")


def page_type(url: Column, text: Column) -> Column:
    """order_detail, order_history, return or order: the route decides first, then a return summary in the text."""
    summary = text.rlike(r"(?i)return summary") & text.rlike(r"(?i)refund method|refund subtotal|total refund|return instructions")
    listed = text.rlike(r"(?i)your orders") & text.rlike(r"(?i)viewing\s+[0-9,]+\s+orders?\s+placed\s+in|(?:^|\n)order placed(?:\n|$)")
    return F.when(url.rlike(DETAIL_ROUTE), "order_detail").when(url.rlike(HISTORY_ROUTE), "order_history").when(url.rlike(RETURN_ROUTE), "return").when(summary, "return").when(listed, "order_history").otherwise("order")


def page_ready(job: Column, url: Column, text: Column, order_id: Column, has_product: Column) -> Column:
    """Whether a page shows the evidence that its kind of job needs."""
    right = order_id.isNull() | (order_id == "") | text.contains(order_id) | url.contains(order_id)
    detail = url.rlike(DETAIL_ROUTE) & right & text.rlike(SUMMARY_WORDS) & (has_product | text.rlike(r"(?i)cancell?ed"))
    back = url.rlike(RETURN_ROUTE) & right & text.rlike(LIFECYCLE_WORDS)
    return F.when(job.isin("history", "advance"), text.rlike(ORDER_ID)).when(job == "detail", detail).when(job == "return", back).otherwise(F.length(page(text).text) >= 80)


def order_ids(text: "Column | Page") -> Column:
    ids = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(ORDER_ID_FAST), F.lit(0)))
    if isinstance(text, Page):
        return ids(text.text)
    # of all that is normalised, only a CR that goes can make or unmake an id
    raw = F.coalesce(text, F.lit(""))
    return F.when(raw.contains("\r"), ids(normalize(raw))).otherwise(ids(raw))


def url_param(url: Column, *names: str) -> Column:
    return F.coalesce(*[found(url, rf"(?i)[?&]{n}=([^&#]+)") for n in names])


def url_order_id(url: Column) -> Column:
    return F.coalesce(found(url_param(url, "order_?id"), ORDER_ID, 0), found(url, ORDER_ID, 0))


def url_return_token(url: Column) -> Column:
    path = found(url, r"(?i)/(?:returns?|spr/returns)/[a-z-]+/([A-Za-z0-9-]{8,})")
    return F.coalesce(url_param(url, "rmaId"), url_param(url, "contractId"), url_param(url, "returnId"), path)


def history_year(url: Column) -> Column:
    return F.coalesce(found(url, r"#time/(\d{4})/pagination/\d+"), found(url, r"(?i)[?&](?:orderFilter|timeFilter)=(?:year-)?(\d{4})")).cast("int")


def history_page(url: Column) -> Column:
    hashed = F.coalesce(found(url, r"#time/\d{4}/pagination/(\d+)"), found(url, r"#pagination/(\d+)")).cast("int")
    start = (found(url, r"(?i)[?&]startIndex=(\d+)").cast("int") / 10).cast("int") + 1
    return F.coalesce(hashed, start, found(url, r"(?i)[?&]page(?:Number)?=(\d+)").cast("int"), F.lit(1))


def location_key(url: Column) -> Column:
    """Canonical URL for keys: without ref, ref_ and tag, with a pagination hash only; query order stays."""
    base, query, mark = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"#(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"(?i)^(?:ref|ref_|tag)(?:=|$)")), "&")
    page = F.when(mark.rlike(r"^(?:time/\d{4}/)?pagination/\d+"), F.concat(F.lit("#"), F.regexp_extract(mark, r"^((?:time/\d{4}/)?pagination/\d+)", 1))).otherwise("")
    return F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), page)


def sanitized_url(url: Column, keep: str = r"(?i)^(?:order_?id|page|startIndex|timeFilter|orderFilter|rmaId|contractId|returnId|itemId)$", longest: int = 300, most: int = 80) -> Column:
    """Origin and path with the query parameters whose name matches, at most `most`, values up to `longest` characters."""
    base, query = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    named = F.filter(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1).rlike(keep) & (F.length(p) <= longest + F.length(F.substring_index(p, "=", 1)) + 1))
    kept = F.array_join(F.slice(named, 1, most), "&")
    return F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


# --- money, dates, cards ------------------------------------------------------------------------------------------


def labelled_money(text: "Column | Page", labels: list[str]) -> Column:
    """The amount behind the first of the labels, in order of the list, that has one."""
    t = page(text).text
    each = F.coalesce(*[cents(found(t, rf"(?i){quoted(label)}\s*:?\s*{MONEY}")) for label in labels])
    return F.when(t.rlike(any_label(labels)), each)


def purchase_cents(text: "Column | Page") -> Column:
    t = page(text).text
    scoped = found(t, rf"(?is)(?:order summary|payment information).{{0,1400}}?(?:^|\n)\s*Total\s*:?\s*{MONEY}")
    return F.coalesce(labelled_money(text, PURCHASE_LABELS), cents(scoped))


def history_total_cents(text: "Column | Page") -> Column:
    return cents(found(page(text).text, rf"(?i)(?:^|\n) ?Total\s*{MONEY} ?(?:\n|$)"))


def canonical_refund_cents(text: "Column | Page") -> Column:
    """Only a line of its own, "Refund Total: $..."; refund prose is refund_cents()."""
    return cents(found(page(text).text, rf"(?i)(?:^|\n) ?Refund Total ?:? ?{MONEY} ?(?:\n|$)"))


def refund_cents(text: "Column | Page") -> Column:
    t = page(text).text
    issued = r"refund (?:has been |was )?issued"
    prose = [rf"(?i){MONEY}\s+{issued}", rf"(?i){issued}[^$]{{0,100}}{MONEY}", rf"(?i){MONEY}\s+(?:will be|was|has been)\s+credited"]
    return F.coalesce(labelled_money(text, REFUND_LABELS), *[cents(found(t, p)) for p in prose])


def refund_subtotal_cents(text: "Column | Page") -> Column:
    return labelled_money(text, ["Refund subtotal"])


def labelled_date(text: "Column | Page", labels: list[str]) -> Column:
    t = page(text).text
    return F.when(t.rlike(any_label(labels)), F.coalesce(*[found(t, rf"(?i){quoted(label)}\s*:?\s*({DATE})") for label in labels]))


def milestone_date(text: "Column | Page", labels: list[str]) -> Column:
    """A date right before or right after a label; labels in order."""
    t = page(text).text
    each = [found(t, p) for label in labels for p in (rf"(?i)({DATE})\s*{quoted(label)}", rf"(?i){quoted(label)}\s*({DATE})")]
    return F.when(t.rlike(any_label(labels)), F.coalesce(*each))


def expected_credit_date(text: "Column | Page") -> Column:
    t = page(text).text
    said = [
        rf"(?i)(?:will|should|expected to)\s+be\s+credited[^\n]{{0,160}}?\bby\s+({DATE})",
        rf"(?i)(?:refund|credit)[^\n]{{0,100}}?(?:expected|estimated)[^\n]{{0,80}}?({DATE})",
        rf"(?i)credit(?:ed)?[^\n]{{0,100}}?\bby\s+({DATE})"]
    return F.when(t.rlike("(?i)credit|refund"), F.coalesce(*[found(t, p) for p in said], milestone_date(text, STEP_LABELS["credited"])))


def card_last4(text: "Column | Page") -> Column:
    """Last four digits next to a card brand within three lines, or a mask right under a payment heading; gift cards never count."""
    def windows(ls: Column) -> Column:
        span = lambda i, n: F.when(i + n - 1 < F.size(ls), F.array_join(F.slice(ls, i + 1, n), "\n"))
        each = F.transform(ls, lambda x, i: F.array(x, span(i, 2), span(i, 3)))
        return F.filter(F.flatten(each), lambda w: w.isNotNull() & ~w.rlike(GIFT))

    def first(ws: Column, pattern: str) -> Column:
        return F.get(F.filter(F.transform(ws, lambda w: F.regexp_extract(w, pattern, 1)), lambda d: d != ""), F.lit(0))

    branded = rf"(?i){CARD_BRANDS}[^\d]{{0,100}}?{CARD_MARKS}\s*[:#-]?\s*(\d{{4}})\b"
    masked = r"(?i)(?:payment\s+(?:method|information)|refund method)\s*[:#-]?\s*(?:\*{2,}|[•·xX]{2,})\s*[:#-]?\s*(\d{4})\b"
    p = page(text)
    # one window holds a whole match, so a page without a match has no window with one
    named, hidden = p.text.rlike(branded), p.text.rlike(masked)
    got = bound(windows(p.lines), lambda ws: F.coalesce(F.when(named, first(ws, branded)), F.when(hidden, first(ws, masked))))
    return F.when(named | hidden, got)


def payment_evidence(text: "Column | Page", blocks: Column | None = None) -> Column:
    """Lines that may name the payment instrument: a payment heading and three lines after it, or instrument lines of payment blocks."""
    heading = r"payment\s+(?:method|information)|refund method"
    none = F.array().cast("array<string>")
    p = page(text)
    around = lambda ls: F.array_distinct(F.flatten(F.transform(ls, lambda x, i: F.when(x.rlike("(?i)" + heading), F.slice(ls, i + 1, 4)).otherwise(none))))
    whole = F.when(p.text.rlike("(?i)" + heading), bound(p.lines, around)).otherwise(none)
    if blocks is None:
        return whole
    own = F.flatten(F.transform(blocks, lambda b: F.filter(split_lines(normalize(b)), lambda x: x.rlike(rf"(?i){heading}|{CARD_BRANDS}"))))
    return F.when(F.size(own) > 0, F.array_distinct(own)).otherwise(whole)


# --- return lifecycle ---------------------------------------------------------------------------------------------


def milestones(text: "Column | Page") -> Column:
    """struct<stage, expected_credit_date, started, shipped, received, refund_issued, credited: struct<done, date>>.

    Only sentences that say an event has happened count, line by line; a later step implies the earlier ones.
    """
    p = page(text)

    def said(ls: Column, pattern: str, but: str | None = None) -> Column:
        hit = F.exists(ls, lambda x: x.rlike("(?i)" + pattern) & (~x.rlike("(?i)" + but) if but else F.lit(True)))
        # a line is part of the text, so a text without the pattern needs no look at its lines
        return F.when(p.text.rlike("(?im)" + pattern), hit).otherwise(False)

    def flags(ls: Column) -> Column:
        return F.struct(said(ls, CREDITED).alias("c"), said(ls, ISSUED).alias("i"), said(ls, RECEIVED).alias("r"), said(ls, SHIPPED, SHIPPED_LATER).alias("s"), said(ls, STARTED).alias("t"))

    def build(f: Column) -> Column:
        done, so_far = {}, F.lit(False)
        for step, flag in (("credited", "c"), ("refund_issued", "i"), ("received", "r"), ("shipped", "s"), ("started", "t")):
            so_far = so_far | f[flag]
            done[step] = so_far
        stage = (
            F.when(done["credited"], "credited").when(done["refund_issued"], "refund_issued").when(done["received"], "received")
            .when(done["shipped"], "shipped").when(done["started"], "started").otherwise("unknown"))
        dated = p.text.rlike("(?i)" + DATE)
        steps = [F.struct(done[s].alias("done"), F.when(done[s] & dated, milestone_date(p, STEP_LABELS[s])).alias("date")).alias(s) for s in ("started", "shipped", "received", "refund_issued", "credited")]
        return F.struct(stage.alias("stage"), F.when(~done["credited"] & dated, expected_credit_date(p)).alias("expected_credit_date"), *steps)

    return bound(flags(p.lines), build)


def affirmed_stage(text: "Column | Page", stage: Column) -> Column:
    """The stage as far as a sentence says it: 'started' only counts if the request itself is confirmed, not by page furniture."""
    said = F.exists(page(text).lines, lambda x: x.rlike("(?i)" + STARTED_SAID))
    return F.when((stage == "started") & ~said, "unknown").otherwise(stage)


def record_status(stage: Column, text: "Column | Page", record_type: Column) -> Column:
    back = (
        F.when(stage.isin("credited", "refund_issued"), "refunded").when(stage == "received", "returned_pending_refund")
        .when(stage.isin("shipped", "started"), "return_in_progress").when(page(text).text.rlike(REFUND_WORDS), "refund_expected").otherwise("unknown"))
    return F.when(record_type == "return", back).otherwise("purchase")


def status_text(stage: Column, text: "Column | Page") -> Column:
    ls = page(text).lines
    proof = (
        F.when(stage == "credited", first_line(ls, CREDITED)).when(stage == "refund_issued", first_line(ls, ISSUED)).when(stage == "received", first_line(ls, RECEIVED))
        .when(stage == "shipped", first_line(ls, SHIPPED, but="(?i)" + SHIPPED_LATER)).when(stage == "started", first_line(ls, STARTED)))
    other = F.get(F.filter(ls, lambda x: x.rlike(r"(?i)delivered|arriving|shipped") & ~x.rlike(BARE_LABELS) & ~x.rlike(r"(?i)refund issued|refund credited")), F.lit(0))
    return F.substring(F.coalesce(proof, other), 1, 500)


def replacement(text: "Column | Page") -> Column:
    """struct<stage, status_text, no_return_required> by the strongest rule with a line; 'detected' needs a no-return sentence."""
    p = page(text)
    hits = [F.struct(F.lit(stage).alias("stage"), F.substring(first_line(p.lines, rule), 1, 220).alias("line")) for stage, rule in REPLACEMENT_RULES]
    free = F.exists(p.lines, lambda x: x.rlike(NO_RETURN))
    weak = F.struct(F.lit("detected").alias("stage"), F.substring(F.when(free, first_line(p.lines, "replacement")), 1, 220).alias("line"))
    best = F.get(F.filter(F.array(*hits, weak), lambda h: h["line"].isNotNull()), F.lit(0))
    named = p.text.rlike("(?i)replacement")
    return bound(F.when(named, best), lambda b: F.struct(b["stage"].alias("stage"), b["line"].alias("status_text"), (b.isNotNull() & free).alias("no_return_required")))


def record_id(record_type: Column, order_id: Column, token: Column, item_id: Column, asins: Column, names: Column, provisional: Column, refund: Column) -> Column:
    """order:<id>, or return:<id>:<token>:<item>; the item part is its id, first ASIN, name, 'pending', amount or 'unknown'."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    item = F.coalesce(blank(item_id), blank(F.get(asins, F.lit(0))), blank(slug(F.get(names, F.lit(0)))), F.when(provisional, "pending"), refund.cast("string"), F.lit("unknown"))
    return F.when(record_type == "order", F.concat(F.lit("order:"), order_id)).otherwise(F.concat_ws(":", F.lit("return"), order_id, slug(token), item))


def terminal_cancelled(text: Column, order_id: Column, has_detail_link: Column) -> Column:
    """Exactly this order id, a line that only says cancelled, a history total of exactly 0, and no detail link."""
    ids, said = order_ids(text), F.exists(page(text).lines, lambda x: x.rlike(r"(?i)^cancell?ed$"))
    return (F.size(ids) == 1) & (F.get(ids, F.lit(0)) == order_id) & said & F.coalesce(history_total_cents(text) == 0, F.lit(False)) & ~has_detail_link


def detail_complete(url: Column, order_id: Column, order_date: Column, total_cents: Column, n_items: Column) -> Column:
    return F.coalesce(url.rlike(DETAIL_ROUTE) & (url_order_id(url) == order_id), F.lit(False)) & order_date.isNotNull() & total_cents.isNotNull() & (n_items >= 1)


def strong_return_evidence(text: Column) -> Column:
    return (milestones(text)["stage"] != "unknown") | page(text).text.rlike(CHECK_STATUS)


def page_signature(text: Column) -> Column:
    """Hash of the lines that matter to the ledger, 450 at most."""
    worth = F.filter(page(text).lines, lambda x: x.rlike(rf"(?i){ORDER_ID}|return|refund|replacement|deliver|total|cancel|credit"))
    return F.sha2(F.array_join(F.slice(worth, 1, 450), "\n"), 256)
