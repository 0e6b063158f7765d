"""Dates as printed, and ticks of local midnight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import col, norm_text, once

# Month names in order.
MONTHS = ("јануари", "февруари", "март", "април", "мај", "јуни", "јули", "август", "септември", "октомври", "ноември", "декември")
#: 100-nanosecond ticks from year 1 to 1970.
EPOCH_TICKS = 621_355_968_000_000_000


def printed_date(text: Column | str, months: tuple[str, ...] = MONTHS) -> Column:
    """dd.mm.yyyy of a numeric or worded date, else null; a month's prefix or an extension of it will do."""
    numeric, worded = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})\.?$", r"^(\d{1,2})\s+([^\s\d]+?)\.*\s+(\d{4})$"
    two = lambda x: F.lpad(x, 2, "0")

    def read(t: Column) -> Column:
        part = lambda pattern, i: F.regexp_extract(t, pattern, i)
        stem = part(worded, 2)
        number = F.lit(None).cast("string")
        for i in range(len(months), 0, -1):
            number = F.when(F.lit(months[i - 1]).startswith(stem) | stem.startswith(months[i - 1]), F.lit(f"{i:02d}")).otherwise(number)
        return F.when(t.rlike(numeric), F.concat_ws(".", two(part(numeric, 1)), two(part(numeric, 2)), part(numeric, 3))).when(
            t.rlike(worded), F.when(number.isNotNull(), F.concat_ws(".", two(part(worded, 1)), number, part(worded, 3)))
        )

    return once(norm_text(text), read)


def date_ticks(day: Column | str, zone: str = "Europe/Skopje") -> Column:
    """Ticks of the day's local midnight in UTC; the time zone database knows summer time."""
    midnight = F.to_utc_timestamp(F.to_timestamp(col(day), "dd.MM.yyyy"), zone)
    return F.unix_micros(midnight) * F.lit(10) + F.lit(EPOCH_TICKS)


def revision_from_name(name: Column | str) -> Column:
    """ISO date cut from a file name's d.m.yyyy; not checked to be a day of the calendar."""
    n, pattern = col(name), r"(\d{1,2})\.(\d{1,2})\.(\d{4})"
    part = lambda i: F.regexp_extract(n, pattern, i)
    return F.when(part(3) != "", F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))
