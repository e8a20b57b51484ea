"""CSV in and out: delimiter, names, missing values and types are told from the file."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StatError
from .records import records

# Cells that mean missing, in lower case and without blanks at the ends.
MISSING = ("", "na", "n/a", "nan", ".", "null", "none")
#: A number as text. Spark's cast alone would take 1d and 1f.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity)$"
CATEGORIES = 10
#: Rows that are looked at first; what they can't settle of a column is asked of all rows.
FIRST_ROWS = 1000


@dataclass
class ImportReport:
    rows: int
    columns: int
    delimiter: str
    issues: list[str] = field(default_factory=list)


def guess_delimiter(line: str) -> str:
    """Of tab, semicolon and comma, the one that the line has most of outside quotes."""
    bare = re.sub(r'"[^"]*("|$)', "", line)
    tabs, semicolons, commas = (bare.count(c) for c in "\t;,")
    if tabs > commas and tabs > semicolons:
        return "\t"
    return ";" if semicolons > commas else ","


def clean_names(names: list[str]) -> tuple[list[str], list[str]]:
    """Lower-case names of letters, digits and _, told apart; and what was changed for that."""
    out: list[str] = []
    issues: list[str] = []
    for i, raw in enumerate(names, 1):
        name = re.sub(r"[^a-z0-9_]", "", re.sub(r"[ \-.]", "_", (raw or "").strip().lower()))
        name = name or f"v{i}"
        name = f"v{name}" if name[0].isdigit() else name
        if name in out:
            k = 2
            while f"{name}_{k}" in out:
                k += 1
            issues.append(f"Column {i}: the name '{name}' repeats; it is '{name}_{k}' now.")
            name = f"{name}_{k}"
        out.append(name)
    return out, issues


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> tuple[DataFrame, ImportReport]:
    """The table and what was noticed. Columns are double or string; metadata has the semantic role.

    The first line gives names. Extra fields of a row are dropped, lacking ones
    are missing. A column is text if one of its cells is neither a number nor
    missing; its cells stay as they are then. Files are read in splits, those
    with line breaks inside quotes, too: their records are found first.
    multi_line: True has each file read by one task, as files whose lines end in
    carriage returns alone are.
    """
    if not path.lower().endswith(".csv"):
        raise StatError("io", f"'{path}' isn't a CSV file.", "Tables are read from .csv (or by read_parquet).", "Convert the file first.")
    first = spark.read.text(path).first()
    if first is None:
        raise StatError("invalid_request", "The file is empty.", "A header line is needed.", "Check the file.")
    head = first[0].lstrip("\ufeff").rstrip("\r")
    sep = guess_delimiter(head)
    found, across = records(spark, path, sep) if multi_line is None else (None, False)
    if multi_line is None:
        multi_line = found is None and across
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": str(multi_line).lower(), "mode": "PERMISSIVE"}
    header = spark.read.options(**options | {"multiLine": "true"} if found is not None else options).csv(path).first()
    names, issues = clean_names([(x or "").lstrip("\ufeff") for x in header])
    schema = ", ".join(f"`{n}` string" for n in names) + ", __bad string"
    if found is not None:
        raw = found.select(F.from_csv("text", schema, options | {"columnNameOfCorruptRecord": "__bad"}).alias("r")).select("r.*")
    else:
        raw = spark.read.options(**options, header="true", enforceSchema="true", columnNameOfCorruptRecord="__bad").schema(schema).csv(path)
    cell = {n: F.lower(F.trim(F.col(n))) for n in names}
    missing = {n: F.col(n).isNull() | cell[n].isin(*MISSING) for n in names}
    numeric = {n: cell[n].rlike(NUMBER) for n in names}
    value = {n: F.when(~missing[n] & numeric[n], cell[n].try_cast("double")) for n in names}
    first = raw.limit(FIRST_ROWS).agg(*(f for i, n in enumerate(names) for f in (F.bool_and(missing[n] | numeric[n]).alias(f"n{i}"), F.slice(F.collect_set(F.when(~missing[n], F.col(n))), 1, CATEGORIES + 1).alias(f"v{i}")))).first()
    # A column is text by one text, and has many values by some; all rows are asked for the rest only, and only by sums that compile.
    text = {n for i, n in enumerate(names) if first[f"n{i}"] is False}
    known = {n: first[f"v{i}"] for i, n in enumerate(names) if len(first[f"v{i}"]) <= CATEGORIES}
    checks = [F.count("*").alias("__rows"), F.count("__bad").alias("__ragged")]
    checks += [F.bool_and(numeric[n] | missing[n]).alias(f"{n}__number") for n in names if n not in text]
    for n, values in known.items():
        checks.append(F.bool_and(missing[n] | F.col(n).isin(*values)).alias(f"{n}__known"))
        if n not in text:
            checks += [F.bool_and(F.when(~missing[n] & numeric[n], value[n] == F.rint(value[n]))).alias(f"{n}__whole"), F.max(F.abs(value[n])).alias(f"{n}__most")]
    got = raw.agg(*checks).first()
    if got["__ragged"]:
        issues.append(f"{got['__ragged']} rows have more or fewer fields than the header.")
    out = []
    for n in names:
        few = n in known and (got[f"{n}__known"] is not False or raw.where(~missing[n]).select(n).distinct().limit(CATEGORIES + 1).count() <= CATEGORIES)
        if n not in text and got[f"{n}__number"] is not False:  # every cell that isn't missing is a number
            few = few and got[f"{n}__whole"] and (got[f"{n}__most"] or 0) < 2**53
            out.append(F.when(~missing[n], cell[n].try_cast("double")).alias(n, metadata={"semantic": "categorical" if few else "continuous"}))
        else:
            out.append(F.when(~missing[n], F.col(n)).alias(n, metadata={"semantic": "categorical" if few else "identifier"}))
    return raw.select(*out), ImportReport(got["__rows"], len(names), sep, issues)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A table whose numbers are doubles and whose other columns are text or dates as they are."""
    df = spark.read.parquet(path)
    return df.select(*(F.col(f"`{n}`").cast("double").alias(n) if t in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or t.startswith("decimal") else F.col(f"`{n}`") for n, t in df.dtypes))


def csv_cell(name: str, kind: str):
    """Whole numbers under 1e15 have no decimals; missing is empty."""
    c = F.col(f"`{name}`")
    if kind == "double":
        return F.when((c == F.rint(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string")).alias(name)
    return c.cast("string").alias(name)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with a header each; quotes only where a cell needs them."""
    df.select(*(csv_cell(n, t) for n, t in df.dtypes)).write.mode("overwrite").options(header="true", quote='"', escape='"', nullValue="", emptyValue="").csv(path)


def export(df: DataFrame, path: str) -> None:
    """By the path's ending: .csv, .parquet or .json."""
    end = path.rsplit(".", 1)[-1].lower()
    if end == "csv":
        write_csv(df, path)
    elif end in ("parquet", "json"):
        getattr(df.write.mode("overwrite"), end)(path)
    else:
        raise StatError("invalid_request", f"'.{end}' is no known format.", "Tables are written as csv, parquet or json.", "Change the ending.")
