from mercato.functions.calendar import (  # noqa: F401
    m5_wday, week_start, wm_yr_wk, event_name, event_type, snap_flag,
    month_label, month_name_padded, month_short_name, week_ending_sunday,
)
from mercato.functions.rounding import sql_round, pd_round, money, ratio  # noqa: F401
