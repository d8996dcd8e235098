"""Calendar column expressions (M5 conventions).

M5 numbers weekdays from Saturday: wday 1 = Saturday ... 7 = Friday, and a
retail week (``wm_yr_wk``) starts on Saturday. Spark's ``dayofweek`` is
1 = Sunday ... 7 = Saturday, hence ``dayofweek % 7 + 1``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the test-data calendar adapter (not taken from any data):
# yearly events by (month, day), and SNAP days of the month per state.
# The DuckDB oracle spells the same values out in SQL, in a list of its own.
# ---------------------------------------------------------------------------
FIXED_EVENTS = [
    # (month, day, event_name, event_type)
    (1, 1, "NewYear", "National"),
    (1, 7, "OrthodoxChristmas", "Religious"),
    (2, 7, "SuperBowl", "Sporting"),
    (2, 14, "ValentinesDay", "Cultural"),
    (3, 17, "StPatricksDay", "Cultural"),
    (5, 5, "Cinco De Mayo", "Cultural"),
    (7, 4, "IndependenceDay", "National"),
    (10, 31, "Halloween", "Cultural"),
    (11, 11, "VeteransDay", "National"),
    (12, 25, "Christmas", "National"),
]

SNAP_DAYS = {
    "CA": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
    "TX": [1, 3, 5, 6, 7, 9, 11, 12, 15],
    "WI": [2, 3, 5, 6, 8, 9, 11, 12, 14, 15],
}

STATES = ["CA", "TX", "WI"]

WEEKDAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
                 "Saturday", "Sunday"]


def m5_wday(date: Column) -> Column:
    """1 = Saturday, 2 = Sunday, ..., 7 = Friday."""
    return (F.dayofweek(date) % 7 + 1).cast("int")


def week_start(date: Column) -> Column:
    """The Saturday that opens the retail week of ``date``."""
    return F.date_sub(date, m5_wday(date) - 1)


def wm_yr_wk(date: Column) -> Column:
    """Retail week key ``yyyyWW``: year of the week's Saturday, then the
    1-based index of that Saturday within its year. One key per week and
    increasing in time."""
    ws = week_start(date)
    return (F.year(ws) * 100 + F.floor((F.dayofyear(ws) - 1) / 7) + 1).cast("int")


def event_name(date: Column) -> Column:
    return _event_field(date, 2)


def event_type(date: Column) -> Column:
    return _event_field(date, 3)


def _event_field(date: Column, idx: int) -> Column:
    m, d = F.month(date), F.dayofmonth(date)
    expr = None
    for ev in FIXED_EVENTS:
        cond = (m == ev[0]) & (d == ev[1])
        expr = F.when(cond, F.lit(ev[idx])) if expr is None else expr.when(cond, F.lit(ev[idx]))
    return expr.otherwise(F.lit(None).cast("string"))


def snap_flag(date: Column, state: str) -> Column:
    return F.dayofmonth(date).isin(SNAP_DAYS[state]).cast("int")


def month_label(date: Column) -> Column:
    """``TO_CHAR(date, 'Mon YYYY')``."""
    return F.date_format(date, "MMM yyyy")


def month_name_padded(month: Column) -> Column:
    """``TO_CHAR(TO_DATE(m, 'MM'), 'Month')``: full name blank-padded to 9."""
    return F.rpad(F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM"), 9, " ")


def month_short_name(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMM")


def week_ending_sunday(date: Column) -> Column:
    """pandas ``resample('W')`` label: the Sunday closing the week."""
    return F.next_day(F.date_sub(date, 1), "Sun")
