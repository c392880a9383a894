"""Date headers. Hour and weekday are the sender's own, so the zone is not applied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings, tried in this order after clean-up.
ZONE = r"\s*(?:[+-]\d{2}:?\d{2}|\b(?:Z|UT|UTC|GMT|EST|EDT|CST|CDT|MST|MDT|PST|PDT))\s*$"
MONTH = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
FORMATS = (
    "d MMM yyyy H:mm:ss", "d MMM yyyy H:mm", "d MMM yyyy",
    "MMM d yyyy H:mm:ss", "MMM d yyyy H:mm", "MMM d yyyy",
    "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yyyy",
)


def local_time(header: Column) -> Column:
    """The wall-clock time written in a date header as TIMESTAMP_NTZ, or null."""
    value = F.trim(F.regexp_replace(F.coalesce(header, F.lit("")), r"\([^)]*\)", ""))
    value = F.regexp_replace(value, r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    value = F.regexp_replace(value, ZONE, "")
    value = F.regexp_replace(F.regexp_replace(value, r"(?<=[A-Za-z\d]),", ""), r"\s+", " ")
    value = F.regexp_replace(value, MONTH, "$1")
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), value)
    spelled = [
        F.try_to_timestamp(value, F.lit(fmt)).cast("timestamp_ntz") for fmt in FORMATS
    ]
    return F.coalesce(iso.try_cast("timestamp_ntz"), *spelled, free_form(header))


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_TIME = r"(?i)\b(\d{1,2})(?:(?::|h)(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*(?:([ap])\.?m\b\.?)?|\s*([ap])\.?m\b\.?)"
_OFFSET = r"(?i)(?<=:\d{2}|\s|m)\s*(?:(?:gmt|utc)?[+-]\d{2}:?\d{2}|\b(?:z|ut|utc|gmt|[ecmp][sd]t|cest|cet|bst|msk))\s*(?=$|\d{4}\s*$)"


def free_form(header: Column) -> Column:
    """The wall-clock time of a date in whatever order it is written, or null.

    A time is what has a colon, an h or am and pm. Of the other numbers: a month may be a name;
    a number of four digits, over 31 or after an apostrophe is the year, two digits below 69
    belong to 2000; three numbers are year first where the first must be one, else month
    first where that is possible, else day first; eight digits are year, month and day. The day
    may be an ordinal. A date without a year, a month or a day is none.
    """
    value = F.trim(F.regexp_replace(F.coalesce(header, F.lit("")), r"\([^)]*\)", " "))
    value = F.regexp_replace(value, r"^(\d{4})-?(\d{2})-?(\d{2})[T ](\d{2}):?(\d{2}):?(\d{2})?", "$1-$2-$3 $4:$5:$6")
    value = F.regexp_replace(F.regexp_replace(value, r":(?=\s|$|[+-]|Z)", ""), r"^(\d{4})(\d{2})(\d{2})(?=\s|$)", "$1-$2-$3")
    value = F.regexp_replace(value, _OFFSET, " ")
    part = lambda i: F.regexp_extract(value, _TIME, i)
    half = F.lower(F.concat(part(4), part(5)))
    hour = F.coalesce(F.try_to_number(F.nullif(part(1), F.lit("")), F.lit("99")).cast("int"), F.lit(0))
    hour = F.when(half == "p", F.when(hour < 12, hour + 12).otherwise(hour)).when((half == "a") & (hour == 12), 0).otherwise(hour)
    number = lambda text: F.coalesce(F.nullif(text, F.lit("")).try_cast("int"), F.lit(0))
    rest = F.regexp_replace(F.regexp_replace(value, _TIME, " "), r"(?i)(?<=\d)(?:st|nd|rd|th)\b", "")
    name = F.lower(F.substring(F.regexp_extract(rest, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*", 0), 1, 3))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")
    numbers = F.regexp_extract_all(rest, F.lit(r"'?\d+"), 0)
    marked = F.transform(numbers, lambda x: F.struct(
        F.coalesce(F.replace(x, F.lit("'"), F.lit("")).try_cast("int"), F.lit(0)).alias("n"),
        (x.startswith("'") | (F.char_length(x) == 4) | (F.coalesce(F.replace(x, F.lit("'"), F.lit("")).try_cast("int"), F.lit(0)) > 31)).alias("year"),
    ))
    at = lambda i: F.get(marked, F.lit(i))
    full = lambda n: F.when(n < 69, n + 2000).when(n < 100, n + 1900).otherwise(n)
    by_name = F.when(at(0)["year"], F.struct(at(0)["n"].alias("y"), month.alias("m"), at(1)["n"].alias("d"))).otherwise(
        F.struct(at(1)["n"].alias("y"), month.alias("m"), at(0)["n"].alias("d")))
    day_first = (at(0)["n"] > 12) & (at(1)["n"] <= 12)
    by_number = F.when(at(0)["year"], F.struct(at(0)["n"].alias("y"), at(1)["n"].alias("m"), at(2)["n"].alias("d"))).otherwise(
        F.struct(at(2)["n"].alias("y"), F.when(day_first, at(1)["n"]).otherwise(at(0)["n"]).alias("m"), F.when(day_first, at(0)["n"]).otherwise(at(1)["n"]).alias("d")))
    day = F.when((month > 0) & (F.size(numbers) == 2), by_name).when((month == 0) & (F.size(numbers) == 3), by_number)
    return F.try_make_timestamp_ntz(full(day["y"]), day["m"], day["d"], hour, number(part(2)), number(part(3)).cast("decimal(8,6)"))


#: Hours and minutes of zones that a header may name. Fixed values.
NAMED_ZONES = {"Z": "+00:00", "UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00",
               "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}


def iso_text(moment: Column, header: Column) -> Column:
    """The moment in ISO form with the offset the header writes; null without a moment."""
    bare = F.trim(F.regexp_replace(F.coalesce(header, F.lit("")), r"\([^)]*\)", ""))
    number = F.regexp_extract(bare, r"([+-]\d{2}):?(\d{2})$", 0)
    named = F.create_map(*[F.lit(x) for pair in NAMED_ZONES.items() for x in pair])
    offset = F.when(number == "-0000", "").when(
        number != "", F.concat(F.substring(number, 1, 3), F.lit(":"), F.substring(number, -2, 2))
    ).otherwise(F.coalesce(F.try_element_at(named, F.regexp_extract(bare, r"[A-Z]+$", 0)), F.lit("")))
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def hour_of_day(moment: Column) -> Column:
    return F.coalesce(F.hour(moment), F.lit(-1))


def day_of_week(moment: Column) -> Column:
    """Monday is 0; -1 when there is no date."""
    return F.coalesce(F.weekday(moment), F.lit(-1))


def is_weekend(day: Column) -> Column:
    return day.isin(5, 6).cast("int")


def display_date(date: Column, created_at: Column) -> Column:
    return F.date_format(F.coalesce(date, created_at), "dd MMM yyyy HH:mm")
