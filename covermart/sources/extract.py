"""Reading a policy extract and resolving its columns to the canonical schema."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covermart.fixed_values import (
    COLUMN_ALIASES,
    DATE_COLUMNS,
    DELIMITERS,
    INTEGER_COLUMNS,
    NUMBER_COLUMNS,
    REQUIRED_COLUMNS,
    TIMESTAMP_COLUMNS,
)
from covermart.functions.clean import (
    clean_text,
    parse_date,
    parse_integer,
    parse_number,
    parse_timestamp,
)

TEXT_SUFFIXES = (".csv", ".tsv", ".txt")
PARQUET_SUFFIXES = (".parquet", ".pq")
OPEN_QUOTE = "A quoted field does not end on its line; read the extract with multiline=True."
_PARSERS = {
    **dict.fromkeys(NUMBER_COLUMNS, (parse_number, "double")),
    **dict.fromkeys(INTEGER_COLUMNS, (parse_integer, "int")),
    **dict.fromkeys(DATE_COLUMNS, (parse_date, "date")),
    **dict.fromkeys(TIMESTAMP_COLUMNS, (parse_timestamp, "timestamp_ntz")),
}
CANONICAL_COLUMNS = tuple(
    [c for c in COLUMN_ALIASES if c not in _PARSERS] + list(_PARSERS)
)


def delimiter_of(line: Column) -> Column:
    """The delimiter that occurs most in a header line; equal counts go to the earlier."""
    counts = [F.length(line) - F.length(F.translate(line, d, "")) for d in DELIMITERS]
    most = F.greatest(*counts)
    choice = F.lit(DELIMITERS[-1])
    for delimiter, count in reversed(list(zip(DELIMITERS, counts))):
        choice = F.when(count == most, F.lit(delimiter)).otherwise(choice)
    return choice


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter of a text extract, from its first line that is not blank."""
    lines = spark.read.text(path).where(F.trim(F.translate("value", "\t\ufeff", "")) != "")
    found = lines.select(delimiter_of(F.col("value")).alias("delimiter")).first()
    if found is None:
        return "\t" if path.lower().endswith(".tsv") else ","
    return found["delimiter"]


def _distinct_names(fields: list[str | None]) -> list[str]:
    """Header names for reading; a repeated name keeps its first place."""
    seen: set[str] = set()
    names = []
    for place, field in enumerate(fields):
        name = (field or "").lstrip("\ufeff") or f"column{place}"
        if name.lower() in seen:
            name = f"{name}_{place}"
        seen.add(name.lower())
        names.append(name)
    return names


def read_delimited(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Text extract with a header, every column text; short rows are filled with NULL.

    Files are split between tasks, line by line; a line that ends inside a quoted field stops
    the job, so that no row is read shifted. Set ``multiline`` when quoted fields hold line
    breaks; a file is then read by one task.
    """
    options = {
        "sep": sniff_delimiter(spark, path),
        "quote": '"',
        "escape": '"',
        "mode": "PERMISSIVE",
    }
    reader = spark.read.options(**options, multiLine=multiline)
    names = _distinct_names(list(reader.csv(path, header=False).first() or []))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if multiline or not names:
        return reader.schema(schema).csv(path, header=True)
    lines = spark.read.text(path).where(F.trim(F.translate("value", "\t\ufeff", "")) != "")
    header, line = lines.first()["value"], F.col("value")
    open_quote = F.raise_error(F.lit(OPEN_QUOTE)).cast("string")
    whole = F.when(line.rlike(_closed_line(options["sep"])), line).otherwise(open_quote)
    places = [f"c{i}" for i in range(len(names))]
    rows = lines.where(line != header).select(
        F.from_csv(whole, ", ".join(f"{c} string" for c in places), options).alias("row")
    )
    return rows.select(*[F.col(f"row.{c}").alias(n) for c, n in zip(places, names)])


def _closed_line(separator: str) -> str:
    """A pattern for lines whose quoted fields all end on the line."""
    sep = re.escape(separator)
    quoted = f'"(?:[^"]++|"")*+"[^{sep}]*+'
    return f'^(?:(?:{quoted}|[^"{sep}][^{sep}]*+|)(?:{sep}|$))*+$'


def read_extract(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A delimited or Parquet extract; any other file type is an error."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in TEXT_SUFFIXES:
        return read_delimited(spark, path, multiline)
    if suffix in PARQUET_SUFFIXES:
        return spark.read.parquet(path)
    raise ValueError(f"Cannot read {suffix or 'this type of'} files; use CSV, TSV, TXT or Parquet.")


def normalize_name(name: str) -> str:
    """Lower case, with every run of other characters as one underscore."""
    return re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def normalize_headers(raw: DataFrame) -> DataFrame:
    """Columns under normalised names; of columns that end up alike, the last is kept."""
    names = [normalize_name(c) for c in raw.columns]
    by_place = raw.toDF(*[f"c{i}" for i in range(len(names))])
    last = {name: i for i, name in enumerate(names)}
    return by_place.select(*[F.col(f"c{i}").alias(n) for n, i in last.items()])


def source_names(raw: DataFrame) -> dict[str, str]:
    """Canonical column -> source column, for the canonical columns the source has."""
    present = {normalize_name(c) for c in raw.columns}
    found = {}
    for column, aliases in COLUMN_ALIASES.items():
        match = next((a for a in map(normalize_name, aliases) if a in present), None)
        if match:
            found[column] = match
    return found


def validate_required(raw: DataFrame) -> None:
    """Raise when a column that every analysis needs is missing."""
    found = source_names(raw)
    missing = [c for c in REQUIRED_COLUMNS if c not in found]
    if missing:
        raise ValueError(f"The source lacks required columns: {', '.join(missing)}.")


def resolve_aliases(raw: DataFrame) -> DataFrame:
    """The canonical columns as the source holds them; absent ones are NULL text."""
    found = source_names(raw)
    named = normalize_headers(raw)
    return named.select(
        *[
            (F.col(found[c]) if c in found else F.lit(None).cast("string")).alias(c)
            for c in CANONICAL_COLUMNS
        ]
    )


def typed_projection(raw: DataFrame) -> DataFrame:
    """All canonical columns, cleaned and typed, in one projection."""
    validate_required(raw)
    resolved = resolve_aliases(raw)
    return resolved.select(
        *[
            _PARSERS[c][0](F.col(c)).cast(_PARSERS[c][1]).alias(c)
            if c in _PARSERS
            else clean_text(F.col(c)).alias(c)
            for c in CANONICAL_COLUMNS
        ]
    )
