"""The order row: narrow rows, one aggregation of an order's records, titles read only where ASINs decide nothing."""

from pyspark.sql import functions as F

from ledgerwright.operators import rows as B
from ledgerwright.plans import adapters, registered

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_order_row_lists_its_records_once(spark):
    text = plan(registered.view_returns(spark, SF))
    # one list of the records and one of the items, no distinct aggregate, and no titles beside the items
    assert text.count("collect_list(") == 2 and "collect_set(" not in text and "count(distinct" not in text and "AS title" not in text, text


def test_views_write_numbers_without_a_formatter(spark):
    for name in ("v_orders", "v_items", "v_returns"):
        assert "format_string" not in plan(adapters.spark_view(spark, SF, name))
    numbers = [0, 7, 999, 1234567, 12345678, 54000000]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select(F.expr(adapters._padded("n", 7)).alias("p"))
    assert [r.p for r in df.collect()] == [f"{n:07d}" for n in numbers]


def test_items_states_take_the_ranks_of_matches(spark):
    v = registered.Views(spark, SF)
    text = plan(B.item_states(v.items, v.groups, v.matches))
    assert text.count("max(struct(rank") <= 1 and text.count("Window [row_number()") == 1, text


def test_titles_count_only_without_a_shared_asin(spark):
    long = "Stainless Steel Water Bottle 32oz Blue with Straw Lid"
    items = spark.createDataFrame([("a", "o", "P0", "b000000001", "Lamp"), ("a", "o", "P1", "B000000002", "Desk"), ("a", "o", "P2", None, long)], "account_id string, order_id string, item_key string, asin string, item_name string")
    groups = [("asin_wins", ["B000000001"], ["Desk"]), ("title", ["B000000009"], ["desk"]), ("start", [], [long[:38]]), ("two", ["b000000001", "B000000002"], ["Lamp"]), ("none", ["B000000009"], []), ("low", [], ["Chair"])]
    g = spark.createDataFrame([("a", "o", *x, k) for k, x in enumerate(groups)], "account_id string, order_id string, group_key string, asins array<string>, item_names array<string>, rank int")
    got = {(r.group_key, r.item_key, r.score, r["rank"]) for r in B.match_items_to_groups(items, g).collect()}
    assert got == {("asin_wins", "P0", 100, 0), ("title", "P1", 80, 1), ("start", "P2", 70, 2)}


def test_runs_and_totals(spark):
    x = spark.sql("SELECT array(named_struct('k', 'a', 'v', 1L), named_struct('k', 'a', 'v', NULL), named_struct('k', NULL, 'v', 5L), named_struct('k', 'b', 'v', NULL)) AS x UNION ALL SELECT array()")
    got = x.select(F.transform(B.runs(F.col("x"), "k"), lambda g: B.total(F.transform(g, lambda y: y["v"]))).alias("t")).collect()
    assert [r.t for r in got] == [[1, 5, None], []]
