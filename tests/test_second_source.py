"""``monthly_second_source_join`` on rows of its own."""

import datetime as dt

from daygrid import catalog


def test_second_source_is_filtered_and_joined_by_month(spark, tmp_path):
    day = dt.datetime
    orders = [
        (1, day(2000, 1, 3), "F", "1-URGENT", 2_000_000.0),
        (2, day(2000, 1, 9), "F", "1-URGENT", 500_000.0),
        (3, day(2000, 1, 9), "O", "1-URGENT", 9_000_000.0),  # another status
        (4, day(2000, 2, 1), "F", "5-LOW", 9_000_000.0),  # another priority: February has no filtered order
        (5, day(2000, 3, 2), "F", "1-URGENT", None),
        (6, day(2000, 3, 4), "F", "1-URGENT", 1_000_000.0),
        (7, day(2000, 3, 4), None, "1-URGENT", 9_000_000.0),
        (8, day(2001, 1, 5), "F", "1-URGENT", 250_000.0),  # the month of another year
    ]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp, o_orderstatus string, o_orderpriority string, "
                          "o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    found = catalog.QUERIES["monthly_second_source_join"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.select("month", "y", "consumption").collect()) == [
        (dt.date(2000, 1, 1), 3, 2.5), (dt.date(2000, 3, 1), 3, 1.0), (dt.date(2001, 1, 1), 1, 0.25)]
