"""Numbers as people write them: currency signs, separators of both conventions, percent
signs and accounting brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.steps import Steps, read_with
from plumbline.functions.text import WS, WS_INNER, trim

# Currency signs and the kinds of space removed inside a number.
CURRENCY = "€$£¥₹"
INNER_SPACES = " \t\xa0\N{FIGURE SPACE}\N{NARROW NO-BREAK SPACE}"

#: Any other character rules a number out, which spares prose the patterns below.
_POSSIBLE = rf"\A[0-9.,+()%eE{CURRENCY}{WS_INNER}-]+\z"
_BRACKETED = r"\A\(([^\n]*)\)\z"
_PERCENT = rf"(?s)\A(~?){WS}*(.*?){WS}*%?{WS}*\z"
#: A lone separator with one to three characters before and three after, or a repeated one.
_THOUSANDS = r"\A(?:[^.,]{1,3}[.,][^.,]{3}|[^.,]*(?:,[^.,]*){2,}|[^.,]*(?:\.[^.,]*){2,})\z"
_DOT_IS_LAST = r"(?s),.*\.[^,]*\z"
_NUMBER = r"\A[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?\z"


def _bare(value: Column) -> Column:
    """Digits, separators and sign only; a leading ``~`` marks accounting brackets."""
    marked = F.regexp_replace(trim(value), _BRACKETED, "~$1")
    inner = F.regexp_replace(marked, _PERCENT, "$1$2")
    return F.when(value.rlike(_POSSIBLE), F.translate(inner, CURRENCY + INNER_SPACES, ""))


def _unsigned(bare: Column) -> Column:
    return F.regexp_replace(bare, r"\A~?[+-]?", "")


def _with_point(body: Column) -> Column:
    """Drop thousands separators and write the decimal separator as a point."""
    return (
        F.when(body.rlike(_THOUSANDS), F.translate(body, ",.", ""))
        .when(body.rlike(_DOT_IS_LAST), F.translate(body, ",", ""))
        .when(body.contains(","), F.translate(body, ",.", "."))
        .otherwise(body)
    )


def _signed(bare: Column, point: Column) -> Column:
    # The pattern is checked first: a cast alone would also accept '1d' and 'NaN'.
    size = F.when(point.rlike(_NUMBER), point.try_cast("double"))
    return F.when(bare.rlike(r"\A[~-]"), -size).otherwise(size)


def number_steps(value: Column) -> Steps:
    """Projections that read text as a double, ``number``; null when it is no number."""
    bare, body, point = "__bare", "__body", "__point"
    return [
        {bare: _bare(value)},
        {body: _unsigned(F.col(bare))},
        {point: _with_point(F.col(body))},
        {"number": _signed(F.col(bare), F.col(point))},
    ]


def with_number(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Add ``out``: the text ``value`` as a double."""
    return read_with(df, value, number_steps, number=out)
