"""Seventeen ways to write a date, recognised by shape and calendar arithmetic.

Java's date patterns read several of these differently from ``strptime`` (two-digit years,
signs, year zero), so a value is matched by a regular expression for its shape, split into
fields, and each possible reading is checked by casting an ISO string to a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.steps import Steps, read_with
from plumbline.functions.text import WS, trim

# The formats in bit order, bit 0 first.
DATE_FORMATS = (
    "YYYY-MM-DD (ISO)",
    "DD/MM/YYYY",
    "MM/DD/YYYY",
    "DD-MM-YYYY",
    "YYYY/MM/DD",
    "DD.MM.YYYY",
    "DD Mon YYYY",
    "Mon DD, YYYY",
    "DD Month YYYY",
    "Month DD, YYYY",
    "YYYYMMDD",
    "DD/MM/YY",
    "MM/DD/YY",
    "YYYY-MM-DD HH:MM:SS",
    "ISO 8601 datetime",
    "DD/MM/YYYY HH:MM",
    "MM/DD/YYYY HH:MM",
)
ALL_FORMATS = (1 << len(DATE_FORMATS)) - 1
#: Formats that carry a time of day.
TIMED_FORMATS = sum(1 << bit for bit in (13, 14, 15, 16))

# English month names.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
)
_SHORT_MONTHS = tuple(month[:3] for month in MONTHS)

_CLOCK = r"(?:2[0-3]|[01]?[0-9]):[0-5]?[0-9](?::[0-5]?[0-9])?"
_NUMERIC = (
    rf"\A[0-9]{{1,4}}([-/.])( [1-9]|[0-9]{{1,2}})\1( [1-9]|[0-9]{{1,4}})"
    rf"(?:(?:{WS}+|[Tt]){_CLOCK})?\z"
)
_DAY_NAME_YEAR = rf"\A[0-9]{{1,2}}{WS}+[A-Za-z]{{3,9}}{WS}+[0-9]{{4}}\z"
_NAME_DAY_YEAR = rf"\A[A-Za-z]{{3,9}}{WS}+[0-9]{{1,2}},{WS}+[0-9]{{4}}\z"
_COMPACT = r"\A[0-9]{8}\z"
_FIELD_BREAK = rf"(?:[-/.:,]|(?<=[0-9])[Tt](?=[0-9])|{WS})+"


def _day(year: Column, month: Column, day: Column) -> Column:
    """A calendar date, or null when it does not exist. Year zero does not."""
    return F.when(year != "0000", F.concat_ws("-", year, month, day).try_cast("date"))


def _field(fields: Column, index: int) -> Column:
    return F.get(fields, F.lit(index))


def date_steps(text: Column) -> Steps:
    """Projections giving the formats that read ``text`` and its value.

    ``mask`` has a bit per format, 0 for none; ``moment`` is a zone-less timestamp. The text
    must already be trimmed. When several readings are possible ISO wins over day-first, and
    day-first over month-first.
    """

    def part(name: str) -> str:
        return f"__date_{name}"

    shape, fields = F.col(part("shape")), F.col(part("fields"))
    shaped = (
        F.when(text.rlike(_NUMERIC), 1)
        .when(text.rlike(_COMPACT), 2)
        .when(text.rlike(_DAY_NAME_YEAR), 3)
        .when(text.rlike(_NAME_DAY_YEAR), 4)
    )
    compact = F.array(F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    split = F.when(shape == 2, compact).when(shape.isNotNull(), F.split(text, _FIELD_BREAK))

    first, second, third = (_field(fields, i) for i in range(3))
    year_first = F.length(first) == 4
    year_last = (F.length(first) <= 2) & F.length(third).isin(2, 4)
    long_year = F.when(F.length(third) == 4, third).otherwise(
        F.concat(F.when(third >= "69", "19").otherwise("20"), third)
    )
    # One blank may stand for the leading zero of a day, never of a month.
    blank_second = text.rlike(r"\A[0-9]+[-/.] ")
    blank_third = text.rlike(r"\A[0-9]+[-/.] ?[0-9]+[-/.] ")
    month_word = F.lower(F.when(shape == 3, second).when(shape == 4, first))
    month_number = F.floor(
        (F.instr(F.lit("".join(_SHORT_MONTHS)), F.substring(month_word, 1, 3)) + 2) / 3
    ).cast("string")
    named_day = F.when(shape == 3, first).otherwise(second)
    known_month = month_word.isin(*_SHORT_MONTHS, *MONTHS)
    numeric = shape == 1
    readings = {
        part("ymd"): F.when(
            numeric & year_first & (F.length(third) <= 2) & ~blank_second, _day(first, second, third)
        ).when(shape == 2, _day(first, second, third)),
        part("dmy"): F.when(
            numeric & year_last & ~blank_second & ~blank_third, _day(long_year, second, first)
        ),
        part("mdy"): F.when(numeric & year_last & ~blank_third, _day(long_year, first, second)),
        part("word"): F.when(shape.isin(3, 4) & known_month, _day(third, month_number, named_day)),
    }

    ymd, dmy, mdy, word = (F.col(part(name)) for name in ("ymd", "dmy", "mdy", "word"))
    separator = F.substring(text, F.length(first) + 1, F.lit(1))
    size = F.size(fields)
    plain, minutes, seconds = size == 3, size == 5, size == 6
    joined_by_t = text.rlike("[Tt]")
    four = F.length(third) == 4
    short_word, full_word = month_word.isin(*_SHORT_MONTHS), month_word.isin(*MONTHS)
    iso = numeric & ymd.isNotNull()
    rules = (
        iso & plain & (separator == "-"),
        dmy.isNotNull() & plain & (separator == "/") & four,
        mdy.isNotNull() & plain & (separator == "/") & four,
        dmy.isNotNull() & plain & (separator == "-") & four,
        iso & plain & (separator == "/"),
        dmy.isNotNull() & plain & (separator == ".") & four,
        word.isNotNull() & (shape == 3) & short_word,
        word.isNotNull() & (shape == 4) & short_word,
        word.isNotNull() & (shape == 3) & full_word,
        word.isNotNull() & (shape == 4) & full_word,
        (shape == 2) & ymd.isNotNull(),
        dmy.isNotNull() & plain & (separator == "/") & ~four,
        mdy.isNotNull() & plain & (separator == "/") & ~four,
        iso & seconds & (separator == "-") & ~joined_by_t,
        iso & seconds & (separator == "-") & joined_by_t,
        dmy.isNotNull() & minutes & (separator == "/") & four & ~joined_by_t,
        mdy.isNotNull() & minutes & (separator == "/") & four & ~joined_by_t,
    )
    bits = F.lit(0)
    for bit, rule in enumerate(rules):
        bits = bits + F.when(rule, 1 << bit).otherwise(0)

    day = F.coalesce(ymd, dmy, mdy, word).cast("string")
    clock = F.concat_ws(
        ":", _field(fields, 3), _field(fields, 4), F.coalesce(_field(fields, 5), F.lit("0"))
    )
    stamp = F.when(plain, day).otherwise(F.concat_ws(" ", day, clock))
    return [
        {part("shape"): shaped},
        {part("fields"): split},
        readings,
        {"mask": F.when(shape.isNull(), 0).otherwise(bits)},
        {"moment": F.when(F.col("mask") != 0, stamp.try_cast("timestamp_ntz"))},
    ]


def with_dates(df: DataFrame, value: Column, mask: str, moment: str) -> DataFrame:
    """Add the format mask and the moment of the text ``value``."""
    return read_with(df, trim(value), date_steps, mask=mask, moment=moment)


def format_labels(mask: Column) -> Column:
    """The sorted names of the formats whose bits are set."""
    names = [F.when(mask.bitwiseAND(1 << bit) != 0, label) for bit, label in enumerate(DATE_FORMATS)]
    return F.array_sort(F.array_compact(F.array(*names)))
