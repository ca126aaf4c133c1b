"""Array columns with set semantics."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import schema


def bound(column: Column, then: Callable[[Column], Column]) -> Column:
    """then(x) with x = column computed once a row, however often `then` uses it."""
    return F.transform(F.array(column), then)[0]


def clean_strings(col: Column) -> Column:
    """Trimmed, non-empty elements; null array -> empty."""
    return F.filter(F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def distinct_ci(col: Column) -> Column:
    """Case-insensitive distinct; first spelling and order stay."""
    first = lambda xs: bound(F.transform(xs, F.lower), lambda low: F.filter(xs, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))
    return bound(clean_strings(col), lambda xs: F.when(F.size(xs) < 2, xs).otherwise(first(xs)))


def array_union_ci(a: Column, b: Column) -> Column:
    """Ordered, case-insensitive union of two string arrays."""
    return distinct_ci(F.concat(clean_strings(a), clean_strings(b)))


def order_items_from_legacy(names: Column, asins: Column) -> Column:
    """Items of records that only hold names and ASINs: paired when the lists are equally long, names alone otherwise."""
    pair = lambda name, asin: F.struct(F.coalesce(asin, name).alias("item_key"), asin.alias("asin"), name.alias("item_name"))
    paired = F.zip_with(names, asins, pair)
    return F.when(F.size(names) == F.size(asins), paired).otherwise(F.transform(names, lambda n: pair(n, F.lit(None).cast("string"))))


def normalize_order_items(items: Column) -> Column:
    """Cleans array<struct<item_key, asin, item_name, quantity, item_amount_cents, ..., replacement_stage, ...>>.

    Items need a key and a name, the first item of a key stays, at most MAX_ITEMS; ASINs have 10 characters, quantities are
    positive, amounts not negative, replacement stages known; other values become null. Texts are cut at 500 characters.
    """
    known = list(schema.REPLACEMENT_RANKS)[1:]

    def tidy(x: Column) -> Column:
        stage = F.lower(x["replacement_stage"])
        return F.struct(
            F.trim(x["item_key"]).alias("item_key"),
            F.when(F.upper(x["asin"]).rlike("^[A-Z0-9]{10}$"), F.upper(x["asin"])).alias("asin"),
            F.substring(F.trim(x["item_name"]), 1, 500).alias("item_name"),
            F.when(x["quantity"] > 0, x["quantity"]).cast("int").alias("quantity"),
            F.when(x["item_amount_cents"] >= 0, x["item_amount_cents"]).alias("item_amount_cents"),
            F.when(stage.isin(known), stage).alias("replacement_stage"),
            (F.coalesce(x["replacement_no_return_required"], F.lit(False)) & stage.isin(known)).alias("replacement_no_return_required"))

    good = F.filter(F.transform(items, tidy), lambda x: (F.length(x["item_key"]) > 0) & (F.length(x["item_name"]) > 0))
    keys = F.transform(F.array(good), lambda g: F.struct(g.alias("g"), F.transform(g, lambda x: x["item_key"]).alias("k")))[0]
    first = F.transform(F.array(keys), lambda b: F.filter(b["g"], lambda x, i: F.array_position(b["k"], x["item_key"]) == i + 1))[0]
    return F.slice(first, 1, schema.MAX_ITEMS)
