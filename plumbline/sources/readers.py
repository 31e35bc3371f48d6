"""Tables from CSV, TSV and Parquet files."""

from __future__ import annotations

import csv
from collections import Counter
from dataclasses import dataclass
from itertools import chain, count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import CP1252_BYTES, CP1252_CHARACTERS, WHITESPACE
from plumbline.operators.dataset import ROW_ID, Dataset, ShapeError, col
from plumbline.sources.split_csv import read_split

# Encodings and delimiters tried, in order.
ENCODINGS = ("UTF-8", "windows-1252", "ISO-8859-1")
DELIMITERS = (",", ";", "\t", "|")
HEADER_LINES = 25
#: Bytes that code page 1252 leaves undefined, as a pattern over Latin-1 text.
_UNDEFINED_1252 = r"[\x81\x8D\x8F\x90\x9D]"
_OVERFLOW = "__overflow"


@dataclass(frozen=True)
class CsvLayout:
    """What was found out about a CSV file before reading it."""

    encoding: str
    delimiter: str
    header: tuple[str, ...]


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding that decodes every file under ``path``.

    Lines are read as single-byte text and checked in parallel, so a large file is split
    like any other and never held in one piece. A byte order mark passes as UTF-8.
    """
    lines = spark.read.option("encoding", "ISO-8859-1").option("header", "false").schema("line string").option(
        "sep", "\x00"
    ).option("quote", "").csv(path)
    verdict = lines.agg(
        F.coalesce(F.bool_and(F.is_valid_utf8(F.encode("line", "ISO-8859-1").cast("string"))), F.lit(True)).alias("utf8"),
        F.coalesce(F.bool_and(~F.col("line").rlike(_UNDEFINED_1252)), F.lit(True)).alias("windows"),
    ).first()
    return ENCODINGS[0] if verdict.utf8 else ENCODINGS[1] if verdict.windows else ENCODINGS[2]


def _charset(encoding: str) -> str:
    """The charset a file is read with. Spark has no code page 1252; it is read as Latin-1,
    which keeps every byte, and the characters that differ are exchanged afterwards."""
    return "ISO-8859-1" if encoding == ENCODINGS[1] else encoding


def _decoded_1252(text: str, encoding: str) -> str:
    if encoding != ENCODINGS[1]:
        return text
    return text.translate(str.maketrans(CP1252_BYTES, CP1252_CHARACTERS))


def _first_lines(spark: SparkSession, path: str, encoding: str) -> list[str]:
    rows = (
        spark.read.option("encoding", _charset(encoding)).option("header", "false").option("sep", "\x00").option("quote", "")
        .schema("line string").csv(path).limit(HEADER_LINES * 4).collect()
    )
    lines = [_decoded_1252(row.line or "", encoding).lstrip("\N{ZERO WIDTH NO-BREAK SPACE}") for row in rows]
    return [line for line in lines if line.strip()][:HEADER_LINES]


def detect_delimiter(lines: list[str]) -> str:
    """The delimiter that gives most of the first lines as many cells as the header has.

    Only characters of the header line take part; otherwise a single column of numbers with
    thousands separators would fall apart. Of equal ones, the one with more cells is taken.
    """

    def rating(mark: str) -> tuple[float, int]:
        widths = [len(cells) for cells in csv.reader(lines, delimiter=mark) if cells]
        return Counter(widths)[widths[0]] / len(widths), widths[0]

    rated = {mark: rating(mark) for mark in DELIMITERS if lines and mark in lines[0]}
    return max((mark for mark, (_, cells) in rated.items() if cells > 1), key=rated.get, default=DELIMITERS[0])


def repair_header(header: list[str]) -> tuple[list[str], list[str]]:
    """Usable column names, no two of them equal in any letter case, and a note for each repair.

    A name that is taken gets the first free number as a suffix.
    """
    names, notes, taken = [], [], set()
    for position, raw in enumerate(header, start=1):
        given = raw.strip(WHITESPACE)
        wanted = given or f"column_{position}"
        choices = chain([wanted], (f"{wanted}_{number}" for number in count(1)))
        name = next(choice for choice in choices if choice.lower() not in taken)
        taken.add(name.lower())
        names.append(name)
        if given != raw:
            notes.append(f"Header {position} had white space around it.")
        if not given:
            notes.append(f"Header {position} was empty and is now called '{wanted}'.")
        if name != wanted:
            notes.append(f"Header {position} repeats '{wanted}' and is now called '{name}'.")
    return names, notes


def csv_layout(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None) -> CsvLayout:
    encoding = encoding or detect_encoding(spark, path)
    lines = _first_lines(spark, path, encoding)
    if not lines:
        raise ShapeError("The file holds no readable text.")
    delimiter = delimiter or detect_delimiter(lines)
    header = next(csv.reader(lines, delimiter=delimiter))
    return CsvLayout(encoding, delimiter, tuple(header))


def read_csv(
    spark: SparkSession,
    path: str,
    name: str | None = None,
    encoding: str | None = None,
    delimiter: str | None = None,
    max_rows: int | None = None,
    max_columns: int | None = None,
    multi_line: bool | None = None,
    with_hash: bool = False,
) -> Dataset:
    """A CSV or TSV file with every cell as text; nothing is turned into a null.

    Words such as ``N/A`` stay words, empty cells stay empty text. A row with more fields
    than the header is an error. Where a line holds an odd number of quotes, cells may go on in
    the next line; such files are read in splits all the same (:mod:`split_csv`). ``multi_line``
    says that they do or do not; if they do, each file is read in one piece by Spark's own reader.
    ``with_hash`` records the SHA-256 of the content, reading each file in one piece.
    """
    layout = csv_layout(spark, path, encoding, delimiter)
    names, notes = repair_header(list(layout.header))
    if max_columns is not None and len(names) > max_columns:
        raise ShapeError(f"{len(names):,} columns exceed the limit of {max_columns:,}.")
    in_splits = multi_line is None and _breaks_in_quotes(spark, path)
    raw = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*raw, _OVERFLOW]])
    if in_splits:
        df = read_split(spark, path, schema, layout.delimiter, _charset(layout.encoding))
    else:
        df = spark.read.csv(
            path, schema=schema, header=True, sep=layout.delimiter, encoding=_charset(layout.encoding), quote='"', escape='"',
            multiLine=bool(multi_line), enforceSchema=True,
        ).withColumn(ROW_ID, F.monotonically_increasing_id())
    # A short row is filled up, as if its last cells were empty; a long one spills over.
    if not df.filter(F.col(_OVERFLOW).isNotNull()).isEmpty():
        raise ShapeError("Some rows have more fields than the header.")

    def cell(name: str):
        text = F.coalesce(F.col(name), F.lit(""))
        return F.translate(text, CP1252_BYTES, CP1252_CHARACTERS) if layout.encoding == ENCODINGS[1] else text

    frame = df.select(*[cell(r).alias(n) for r, n in zip(raw, names)], ROW_ID)
    data = Dataset(
        frame, name or path.rstrip("/").rsplit("/", 1)[-1], tuple(notes), content_hash(spark, path) if with_hash else None,
        size_of(spark, path), layout.encoding, layout.delimiter,
    )
    data.check_shape(max_rows, None)
    return data


def _breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes, so that a cell may go on in the next."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.filter(quotes % 2 == 1).isEmpty()


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path, without reading them."""
    return spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0


def read_parquet(spark: SparkSession, path: str, name: str | None = None, row_id: str | None = None) -> Dataset:
    """A Parquet table. In a single file the row ids are the positions of the rows.

    With several files, ids follow the order of the scan.
    """
    df = spark.read.parquet(path)
    if row_id is not None:
        df = df.withColumn(ROW_ID, col(row_id).cast("bigint"))
    elif len(df.inputFiles()) == 1:
        df = df.select("*", F.col("_metadata.row_index").alias(ROW_ID))
    else:
        df = df.withColumn(ROW_ID, F.monotonically_increasing_id())
    return Dataset(df, name or path.rstrip("/").rsplit("/", 1)[-1], size_bytes=size_of(spark, path))


def open_view(spark: SparkSession, path: str, view: str, name: str | None = None, max_columns: int | None = None) -> Dataset:
    """A CSV, TSV or Parquet file as a temporary SQL view."""
    lowered = path.lower().rstrip("/")
    if lowered.endswith((".csv", ".tsv")):
        data = read_csv(spark, path, name, delimiter="\t" if lowered.endswith(".tsv") else None, max_columns=max_columns)
    elif lowered.endswith(".parquet"):
        data = read_parquet(spark, path, name)
    else:
        raise ValueError("Only .csv, .tsv and .parquet can be opened.")
    data.frame.drop(ROW_ID).createOrReplaceTempView(view)
    return data


def content_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of the content; of the sorted file hashes when there are several files."""
    hashes = (
        spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("hash")).orderBy("path")
    )
    listed = hashes.agg(F.array_sort(F.collect_list("hash")).alias("hashes")).select(
        F.when(F.size("hashes") == 1, F.get("hashes", F.lit(0))).otherwise(F.sha2(F.array_join("hashes", ","), 256)).alias("h")
    )
    return listed.first().h
