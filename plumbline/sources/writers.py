"""Corrected tables and audit logs as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import is_text, neutralise_formula
from plumbline.operators.dataset import Dataset, col


def for_export(data: Dataset, sanitise: bool = True) -> DataFrame:
    """The table without row ids; text a spreadsheet would run as a formula is quoted."""
    return data.frame.select(
        *[
            (neutralise_formula(col(f.name)) if sanitise and is_text(f.dataType) else col(f.name)).alias(f.name)
            for f in data.fields
        ]
    )


def write_csv(data: Dataset, path: str, sanitise: bool = True, mode: str = "errorifexists") -> None:
    """A folder of UTF-8 CSV files with headers."""
    for_export(data, sanitise).write.mode(mode).csv(
        path, header=True, quote='"', escape='"', emptyValue="", encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_parquet(data: Dataset, path: str, sanitise: bool = False, mode: str = "errorifexists") -> None:
    for_export(data, sanitise).write.mode(mode).parquet(path)


def write_audit_log(log: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The one JSON document of an audit log as a text file."""
    log.select(F.col("value")).coalesce(1).write.mode(mode).text(path)
