"""Inputs are read by the names of their headers; lines that don't fit are told and set aside."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from mercato.plans import inventory
from mercato.sources import m5
from pyspark.sql import functions as F

CALENDAR = ",".join(m5.CALENDAR_SCHEMA.names)
DAY = "2011-01-{d:02d},11101,Saturday,1,1,2011,d_{d},,,,,0,0,1"


@pytest.fixture
def raw(tmp_path):
    (tmp_path / "sales_train_validation.csv").write_text(
        "id,item_id,dept_id,cat_id,store_id,state_id,d_1,d_2\n"
        "A_1,A,D,C,S_1,CA,3,4\nB_1,B,D,C,S_1,CA,many,2\nC_1,C,D,C,S_1,CA,,1\n")
    (tmp_path / "calendar.csv").write_text("\n".join([CALENDAR, *(DAY.format(d=d) for d in (1, 2))]) + "\n")
    # another order of columns, and one more
    (tmp_path / "sell_prices.csv").write_text(
        "sell_price,note,wm_yr_wk,item_id,store_id\n1.25,x,11101,A,S_1\n2.50,y,11101,B,S_1\nfree,z,11101,C,S_1\n")
    return tmp_path


def test_columns_are_read_by_name(spark, raw):
    prices = m5.read_prices(spark, str(raw / "sell_prices.csv"))
    assert prices.columns == m5.PRICES_SCHEMA.names
    got = {r["item_id"]: (r["store_id"], r["wm_yr_wk"], r["sell_price"]) for r in prices.collect()}
    assert got == {"A": ("S_1", 11101, Decimal("1.25")), "B": ("S_1", 11101, Decimal("2.50")), "C": ("S_1", 11101, None)}
    days = m5.read_calendar(spark, str(raw / "calendar.csv")).collect()
    assert [(r["date"], r["d"], r["snap_WI"]) for r in days] == [(date(2011, 1, 1), "d_1", 1), (date(2011, 1, 2), "d_2", 1)]


def test_missing_and_repeated_columns_are_refused(spark, raw):
    (raw / "sell_prices.csv").write_text("store_id,item_id,wm_yr_wk\nS_1,A,11101\n")
    with pytest.raises(ValueError, match="sell_price"):
        m5.read_prices(spark, str(raw / "sell_prices.csv"))
    (raw / "calendar.csv").write_text(CALENDAR + ",d\n")
    with pytest.raises(ValueError, match="repeated"):
        m5.read_calendar(spark, str(raw / "calendar.csv"))
    (raw / "sales_train_validation.csv").write_text("")
    with pytest.raises(ValueError, match="item_id"):
        m5.read_wide(spark, str(raw / "sales_train_validation.csv"))


def test_broken_lines_are_counted_and_set_aside(spark, raw):
    out = str(raw / "broken")
    assert m5.quarantine_broken(spark, str(raw), out) == {"sales": 1, "calendar": 0, "prices": 1}
    assert [r[0] for r in spark.read.text(f"{out}/sales").collect()] == ["B_1,B,D,C,S_1,CA,many,2"]
    assert [r[0] for r in spark.read.text(f"{out}/prices").collect()] == ["free,z,11101,C,S_1"]
    wide, _, prices = m5.load_raw(spark, str(raw), whole_rows=True)
    # an empty cell is no broken one
    assert sorted(r["item_id"] for r in wide.select("item_id").collect()) == ["A", "C"]
    assert sorted(r["item_id"] for r in prices.collect()) == ["A", "B"]
    every, _, _ = m5.load_raw(spark, str(raw))
    assert every.count() == 3 and every.where(F.col("d_1").isNull()).count() == 2


def test_money_is_the_same_in_any_order(spark):
    rows = [("A", 0.1 + k * 0.01, 1) for k in range(1000)] + [("A", 1e9 + 0.05, 1), ("B", 0.3, 2)]
    abc = spark.createDataFrame(rows, "abc_class string, total_revenue double, revenue_pct int")
    sums = {tuple(sorted((r["abc_class"], r["total_revenue"]) for r in inventory.abc_summary(abc.repartition(n)).collect())) for n in (1, 3, 7)}
    assert sums == {(("A", 1000005095.05), ("B", 0.3))}
