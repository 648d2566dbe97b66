"""Column-level functions: dates, keys, flags and null-aware aggregates."""

from sitewise.functions.dates import (  # noqa: F401
    parse_2digit_date, year_end, month_start, month_end, days_in_month,
    with_calendar_parts,
)
from sitewise.functions.keys import with_station, site_of, station_key  # noqa: F401
from sitewise.functions.flags import drop_flag_rows, with_flag_id, is_flag  # noqa: F401
from sitewise.functions.nulls import (  # noqa: F401
    r_sum, r_mean, r_median, r_sd, r_min, r_max, all_present,
)
