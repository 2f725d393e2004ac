"""Flat files: the raw registry extract and the clean flat file."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialbraid import vocab
from trialbraid.functions import rules
from trialbraid.functions.text import name
from trialbraid.operators import cleaning
from trialbraid.schema import INGEST_POS
from trialbraid.sources import records

_FLAGS = ["pre_covid_start", "date_error", cleaning.IN_STAR]


#: Faults of records by the number of their cells, besides those of their quotes.
TOO_FEW, TOO_MANY = "too few fields", "too many fields"
_PARSE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_fault", "quote": '"', "escape": '"'}


def _parsed(spark: SparkSession, path: str, multi_line: bool) -> list[tuple[list[str], DataFrame]]:
    """Per header: its names, and (place, text, fault) with the cells of every record as one struct.

    The files are grouped by header, and each file is scanned in one group.
    The driver has one entry per file, as Spark's own list of files has.
    """
    if multi_line:
        heads, places = records.find_places(spark, path)
    else:
        heads, places = records.first_lines(spark, path), None
    groups: dict[str, list[str]] = {}
    for file, head in sorted(heads.items()):
        groups.setdefault(head.removeprefix("\ufeff").rstrip("\r"), []).append(file)
    out = []
    for header, paths in groups.items():
        if records.spans_lines(header):
            raise ValueError(f"the header of {paths[0]} spans lines")
        names = next(csv.reader([header]))
        # The reader reports file names as parts of a URI.
        lines = records.read_lines(spark, [unquote(p) for p in paths])
        found = records.records(lines, places and places.of(paths))
        schema = ", ".join(f"{name(n)} STRING" for n in [*names, "_fault"])
        cells = F.from_csv(F.expr(r"rtrim('\r', text)"), schema, _PARSE)
        # A generated column, so that no filter on it parses the text a second time.
        found = found.withColumn("cells", cells).selectExpr(
            "concat_ws(':', file, lpad(block, 15, '0'), lpad(line, 19, '0')) AS place",
            "text",
            "fault",
            "explode(array(cells)) AS cells",
        )
        # Commas outside of quotes tell whether cells are missing.
        commas = """length(regexp_replace(regexp_replace(text, '"[^"]*"', ''), '[^,]', ''))"""
        number = f"if({commas} < {len(names) - 1}, '{TOO_FEW}', '{TOO_MANY}')"
        reason = f"CASE WHEN fault IS NOT NULL THEN fault WHEN cells._fault IS NOT NULL THEN {number} END"
        out.append((names, found.withColumn("fault", F.expr(reason))))
    return out


def scan_csv(
    spark: SparkSession, path: str, multi_line: bool = True, faults: str = "raise"
) -> DataFrame:
    """All columns of CSV files with headers, as text, under the names in the headers.

    Each file is mapped by its own header; a column that some files lack is
    NULL there. No inference pass over the data. ``multi_line`` is right for
    every file and takes one more pass over the text, which finds the quoted
    cells at the ends of splits (see ``sources.records``); an extract without
    line breaks inside cells may be read with ``multi_line=False``. Both read
    a large file in many tasks.

    A record with too few or too many fields, an unclosed quote or text behind
    a closing quote is an error by default. With ``faults="reject"`` such
    records are left out here and stand, whole, in :func:`rejected_csv`.
    """
    if faults not in ("raise", "reject"):
        raise ValueError("faults is 'raise' or 'reject'")
    scans = []
    for names, found in _parsed(spark, path, multi_line):
        if faults == "raise":
            told = "raise_error(concat(fault, ' at ', place))"
            found = found.filter(f"if(fault IS NULL, true, cast({told} AS boolean))")
        else:
            found = found.filter("fault IS NULL")
        own = [c for c in names if c != INGEST_POS]
        kept = f"cells.{name(INGEST_POS)}" if INGEST_POS in names else "place"
        scans.append(
            found.selectExpr(f"{kept} AS {INGEST_POS}", *[f"cells.{name(c)} AS {name(c)}" for c in own])
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def rejected_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(place, text, reason): the records that :func:`scan_csv` leaves out, unchanged.

    Of a record that never closes, each physical line is one row here, so the
    lines behind it are listed and not lost in one cell.
    """
    parts = [
        found.filter("fault IS NOT NULL").selectExpr("place", "text", "fault AS reason")
        for _, found in _parsed(spark, path, multi_line)
    ]
    return reduce(DataFrame.union, parts)


def scan_raw_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    multi_line: bool = True,
    faults: str = "raise",
) -> DataFrame:
    """The raw registry extract, with the cells that mean "missing" as NULL.

    The ingest position is a text that orders the rows as they stand in the
    files; a position that an earlier scan has written is kept. A wanted
    column that no file has is an error.
    """
    raw = scan_csv(spark, path, multi_line, faults)
    wanted = list(columns) if columns else [c for c in raw.columns if c != INGEST_POS]
    return raw.select(
        INGEST_POS, *[F.expr(rules.nullify_tokens(name(c))).alias(c) for c in wanted]
    )


def write_flat(flat: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the clean flat file, replacing an earlier one.

    Parquet keeps the types and lets later readers prune; CSV is for exchange.
    """
    writer = flat.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def scan_clean_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The clean flat file from CSV: dates, numbers and flags typed again."""
    text_frame = scan_raw_csv(spark, path, multi_line=multi_line)
    typed = cleaning.parse_dates(text_frame, vocab.STUDY_DATE_COLUMNS)
    typed = cleaning.with_enrollment_number(typed)
    return typed.withColumns({c: F.col(c).try_cast("boolean") for c in _FLAGS if c in typed.columns})


def scan_clean(spark: SparkSession, path: str) -> DataFrame:
    """The clean flat file from Parquet."""
    return spark.read.parquet(path)
