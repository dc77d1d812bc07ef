"""Time text: canonical dateTime, 14-digit keys and padded partial timestamps.

All work is on zone-free timestamps, so results do not depend on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegraph.functions import fixed
from pagegraph.functions.text import strip


def ntz_text(moment: Column) -> Column:
    """Zone-free timestamp as ``yyyy-MM-ddTHH:mm:ssZ``; fractions are dropped."""
    plain = F.substring(moment.cast("timestamp_ntz").cast("string"), 1, 19)
    return F.concat(F.replace(plain, F.lit(" "), F.lit("T")), F.lit("Z"))


def digits14(moment: Column) -> Column:
    """Zone-free timestamp as 14 digits."""
    plain = F.substring(moment.cast("timestamp_ntz").cast("string"), 1, 19)
    return F.regexp_replace(plain, "[^0-9]", "")


_DAY = r"(?!0000)\d{4}-\d{2}-\d{2}"
_STEPS = [
    # basic date, basic time, missing minutes, missing seconds, fractions, basic offset, no offset
    (r"^(\d{4})(\d{2})(\d{2})(?=\D|$)", "$1-$2-$3"),
    (r"^(\d{4}-\d{2}-\d{2}).(\d{2})(\d{2})(\d{2})?(?=[Z.,+-]|$)", "$1T$2:$3:$4"),
    (r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00"),
    (r"^(\d{4}-\d{2}-\d{2}).(\d{2})(?=[Z+-]|$)", "$1T$2:00"),
    (r"^(\d{4}-\d{2}-\d{2}).(\d{2}:\d{2}):?(?=[Z+-]|$)", "$1T$2:00"),
    (r"(:\d{2})[.,]\d+", "$1"),
    (r"([+-]\d{2}):?(\d{2})?:?(\d{2})?$", "$1:$2:$3"),
    (r"([+-]\d{2})::$", "$1:00:00"),
    (r"([+-]\d{2}:\d{2}):$", "$1:00"),
    (r"^(.{10}).(\d{2}:\d{2}:\d{2})Z?$", "$1T$2+00:00:00"),
    (r"^(.{10}).", "$1T"),
]
_FULL = "^" + _DAY + r"T\d{2}:\d{2}:\d{2}[+-]([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"


def _week_date(text: Column) -> Column:
    """Week date (``2024-W05-3``) as a calendar date, with what follows it."""
    pattern = r"^(\d{4})-?W(\d{2})-?(\d)?"
    year = F.regexp_extract(text, pattern, 1)
    week = F.regexp_extract(text, pattern, 2).try_cast("int")
    day = F.coalesce(F.regexp_extract(text, pattern, 3).try_cast("int"), F.lit(1))
    fourth = F.concat(year, F.lit("-01-04")).try_cast("date")
    monday = F.date_sub(fourth, F.weekday(fourth))
    last = F.weekofyear(F.concat(year, F.lit("-12-28")).try_cast("date"))
    date = F.date_add(monday, (week - 1) * 7 + day - 1).cast("string")
    rest = F.regexp_replace(text, pattern, "")
    return F.when(week.between(F.lit(1), last) & day.between(1, 7), F.concat(date, rest))


def xsd_datetime(value: Column) -> Column:
    """Canonical UTC dateTime from 14 digits or ISO text; anything else is null.

    Text without an offset counts as UTC. Date-only, basic and week dates are accepted. Offsets
    reach to 18 hours.
    """
    text = strip(value.cast("string"))
    dashed = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6")
    compact = F.regexp_extract(dashed, "^" + _DAY + r" \d{2}:\d{2}:\d{2}$", 0).try_cast("timestamp_ntz")
    iso = F.when(text.rlike(r"^\d{4}-?W"), _week_date(text)).otherwise(text)
    for pattern, form in _STEPS:
        iso = F.regexp_replace(iso, pattern, form)
    seconds = F.unix_seconds(F.regexp_extract(iso, _FULL, 0).try_cast("timestamp"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    moment = epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.when(text.rlike(r"^\d{14}$"), ntz_text(compact)).otherwise(ntz_text(moment))


def numeric_time(value: Column) -> Column:
    """14-digit whole number of a time text, for ordering and for floors; null if unreadable."""
    text = strip(value.cast("string"))
    return F.when(text.rlike(r"^\d{14}$"), text.cast("bigint")).otherwise(
        F.regexp_replace(xsd_datetime(text), "[^0-9]", "").cast("bigint")
    )


def padded_timestamp(value: Column) -> Column:
    """Partial timestamp of 4 to 14 digits, right-padded with zeros; other shapes are null."""
    text = strip(value.cast("string"))
    ok = text.rlike(r"^\d+$") & F.length(text).isin(*fixed.TIMESTAMP_LENGTHS)
    return F.when(ok, F.rpad(text, 14, "0"))


def lower_bound_time(padded: Column) -> Column:
    """Earliest moment a padded timestamp can mean: month and day zero count as one."""
    month = F.greatest(F.substring(padded, 5, 2), F.lit("01"))
    day = F.greatest(F.substring(padded, 7, 2), F.lit("01"))
    return xsd_datetime(F.concat(F.substring(padded, 1, 4), month, day, F.substring(padded, 9, 6)))
