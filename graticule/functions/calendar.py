"""Calendar keys, time decoding and time labels."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date
from math import floor

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month labels, January first.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Microseconds per time unit. A plural "s" is stripped before the lookup.
UNIT_MICROS = {
    "microsecond": 1, "us": 1,
    "millisecond": 1_000, "ms": 1_000, "msec": 1_000,
    "second": 1_000_000, "sec": 1_000_000, "s": 1_000_000,
    "minute": 60_000_000, "min": 60_000_000,
    "hour": 3_600_000_000, "hr": 3_600_000_000, "h": 3_600_000_000,
    "day": 86_400_000_000, "d": 86_400_000_000,
}

MIXED_CALENDARS = {"standard", "gregorian"}
SUPPORTED_CALENDARS = MIXED_CALENDARS | {"proleptic_gregorian"}

JULIAN_DAYS_TO_1970 = 719_470                # from 1 March of year 0, Julian, to 1 January 1970
GREGORIAN_START = -12_219_292_800_000_000   # 1582-10-15 in microseconds since 1970
YEAR_1 = -62_135_596_800_000_000            # 0001-01-01
YEAR_10000 = 253_402_300_800_000_000        # 10000-01-01

_SINCE = re.compile(
    r"^\s*(?P<unit>[a-z]+)\s+since\s+(?P<date>\d{1,4}-\d{1,2}-\d{1,2})"
    r"(?:[t\s]+(?P<time>\d{1,2}(?::\d{1,2}(?::\d{1,2}(?:\.\d+)?)?)?))?\s*(?P<zone>z|utc|gmt|[+-]\d{1,2}(?::?\d{2})?)?\s*$",
    re.IGNORECASE,
)


def days_since_1970(year: int, month: int, day: int, calendar: str) -> int:
    """Days of a reference date. The mixed calendars count dates before 15 October 1582 as Julian ones."""
    if calendar in MIXED_CALENDARS and (year, month, day) < (1582, 10, 15):
        march_month, march_year = (month - 3) % 12, year - (month < 3)
        since_march = (153 * march_month + 2) // 5 + day - 1
        return 365 * march_year + march_year // 4 + since_march - JULIAN_DAYS_TO_1970
    return date(year, month, day).toordinal() - date(1970, 1, 1).toordinal()


def parse_units(units: str | None, calendar: str | None = None) -> tuple[int, int] | None:
    """(microseconds per unit, reference time in microseconds since 1970) of "days since 2000-01-01"; None if unreadable."""
    found = _SINCE.match(units or "")
    if not found:
        return None
    unit = found["unit"].lower()
    micros = UNIT_MICROS.get(unit) or UNIT_MICROS.get(unit.removesuffix("s"))
    if micros is None:
        return None
    year, month, day = (int(p) for p in found["date"].split("-"))
    clock = [float(p) for p in (found["time"] or "0").split(":")] + [0.0, 0.0]
    zone = (found["zone"] or "").lower()
    offset = 0
    if zone[:1] in ("+", "-"):
        digits = zone[1:].replace(":", "")
        hours, minutes = (int(digits[:-2]), int(digits[-2:])) if len(digits) > 2 else (int(digits), 0)
        offset = (hours * 60 + minutes) * (-1 if zone[0] == "-" else 1)
    try:
        days = days_since_1970(year, month, day, (calendar or "standard").lower())
    except ValueError:
        return None
    seconds = (days * 24 + int(clock[0])) * 3600 + (int(clock[1]) - offset) * 60
    return micros, seconds * 1_000_000 + round(clock[2] * 1_000_000)


def decodable_range(calendar: str | None) -> tuple[int, int] | None:
    """Microseconds that a calendar shares with the ordinary one; None for model calendars such as noleap."""
    calendar = (calendar or "standard").lower()
    if calendar not in SUPPORTED_CALENDARS:
        return None
    return (GREGORIAN_START if calendar in MIXED_CALENDARS else YEAR_1), YEAR_10000


# Days of the months, January first.
MONTH_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
MODEL_CALENDARS = {
    "noleap": "noleap", "365_day": "noleap", "all_leap": "all_leap", "366_day": "all_leap", "360_day": "360_day", "julian": "julian",
}
DAY_MICROS = 86_400_000_000


def month_days(year: int, calendar: str) -> list[int]:
    if calendar == "360_day":
        return [30] * 12
    leap = calendar == "all_leap" or calendar == "julian" and year % 4 == 0
    return [d + (leap and m == 1) for m, d in enumerate(MONTH_DAYS)]


def year_start(year: int, calendar: str) -> int:
    """Days of a model calendar before the first of January, counted from that of year 0."""
    if calendar == "julian":
        return 365 * year + (year + 3) // 4
    return year * sum(month_days(1, calendar))


def parse_model_units(units: str | None, calendar: str | None) -> tuple[int, int, str] | None:
    """(microseconds per unit, reference time in microseconds since year 0, calendar) in a model calendar; None if the
    units do not parse, the date is none of that calendar, or it is the ordinary one."""
    model, found = MODEL_CALENDARS.get((calendar or "").lower()), _SINCE.match(units or "")
    if model is None or not found:
        return None
    year, month, day = (int(p) for p in found["date"].split("-"))
    if not (1 <= month <= 12 and 1 <= day <= month_days(year, model)[month - 1]):
        return None
    # The clock and the zone are read as in the ordinary calendar, on a day that both have.
    clock = parse_units(units.replace(found["date"], "1970-01-01", 1), "proleptic_gregorian")
    if clock is None:
        return None
    days = year_start(year, model) + sum(month_days(year, model)[: month - 1]) + day - 1
    return clock[0], days * DAY_MICROS + clock[1], model


def fields_of(offsets: Iterable[float], units: str | None, calendar: str | None) -> list[tuple[int, int, int, int] | None] | None:
    """(year, month, day, microseconds of the day) of each offset in a model calendar, where 30 February may be a day. None
    for the ordinary calendar and for units that do not parse; years before 0 and after 9999 are not decoded."""
    parsed = parse_model_units(units, calendar)
    if parsed is None:
        return None
    step, start, model = parsed
    found: list[tuple[int, int, int, int] | None] = []
    for offset in offsets:
        if offset != offset or abs(offset * step) > 4e17:
            found.append(None)
            continue
        whole = floor(offset)
        day, micros = divmod(whole * step + round((offset - whole) * step) + start, DAY_MICROS)
        year = int(day // (365.25 if model == "julian" else sum(month_days(1, model))))
        while year_start(year, model) > day:
            year -= 1
        while year_start(year + 1, model) <= day:
            year += 1
        rest, month = day - year_start(year, model), 0
        for length in month_days(year, model):
            if rest < length:
                break
            rest, month = rest - length, month + 1
        found.append((year, month + 1, rest + 1, micros) if 0 <= year <= 9999 else None)
    return found


def clock_text(fields: tuple[int, int, int, int]) -> str:
    """Date and clock of a model calendar, in the form of ``time_text``."""
    year, month, day, micros = fields
    seconds, fraction = divmod(micros, 1_000_000)
    text = f"{year:04d}-{month:02d}-{day:02d} {seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
    return f"{text}.{fraction:06d}" if fraction else text


def days_in_model(offset: float | None, units: str | None, calendar: str | None) -> float | None:
    """Days from a fixed day of the same calendar, to put the files of a dataset in order; None if not decodable."""
    if offset is None or offset != offset:
        return None
    model = parse_model_units(units, calendar)
    parsed = model[:2] if model else parse_units(units, calendar) if decodable_range(calendar) else None
    return (offset * parsed[0] + parsed[1]) / DAY_MICROS if parsed else None


def decode_time(offset: Column, units: str, calendar: str = "standard") -> Column:
    """Time of a numeric offset such as hours since a date. What cannot be decoded is NULL, never a wrong date."""
    parsed, limits = parse_units(units, calendar), decodable_range(calendar)
    if parsed is None or limits is None:
        return F.lit(None).cast("timestamp_ntz")
    step, start = parsed
    number = offset.cast("double")
    rough = F.when(~F.isnan(number), number * float(step) + float(start))
    inside = (rough >= float(limits[0])) & (rough < float(limits[1]))
    whole = F.floor(F.when(inside, number))
    micros = whole * F.lit(step).cast("bigint") + F.round((number - whole) * float(step)).cast("bigint") + F.lit(start)
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def parse_time(text: Column) -> Column:
    """Time of a string; NULL when it does not parse."""
    return text.try_cast("timestamp_ntz")


def utc_time(stamp: Column) -> Column:
    """Date and clock in UTC of an instant, whatever the session's zone."""
    seconds = (F.unix_micros(stamp).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def time_text(time: Column) -> Column:
    """Date and clock, with six fraction digits only where there is a fraction; "NaT" for an unknown time."""
    stamp = time.cast("timestamp_ntz")
    whole = F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")
    fraction = F.date_format(stamp, "SSSSSS")
    text = F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))
    return F.coalesce(text, F.lit("NaT"))


def fields_text(time: Column, fields: Column) -> Column:
    """The same text for a time that may be one of a model calendar instead."""
    micros = fields["micros"]
    fraction = F.pmod(micros, F.lit(1_000_000))
    whole = F.floor(micros / 1_000_000)
    clock = F.format_string(
        "%04d-%02d-%02d %02d:%02d:%02d", fields["year"], fields["month"], fields["day"],
        F.floor(whole / 3600), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60)),
    )
    text = F.when(fraction == 0, clock).otherwise(F.concat(clock, F.lit("."), F.format_string("%06d", fraction)))
    return F.when(fields.isNotNull(), text).otherwise(time_text(time))


def month_name(month: Column) -> Column:
    """Locale-independent month label of 1..12."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month)


def period(year: Column, baseline_until: int = 2010, current_until: int = 2040) -> Column:
    """Baseline up to and including the first bound, Current up to and including the second, Future after it."""
    # The labels.
    return (
        F.when(year <= baseline_until, F.lit("Baseline"))
        .when(year <= current_until, F.lit("Current"))
        .when(year > current_until, F.lit("Future"))
    )
