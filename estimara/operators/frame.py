"""Rows and columns of the working table: generate, replace, keep, drop, rename, label, sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StatError, text_variable, unknown_variable
from ..functions.expr import finite

#: Variables beyond which complete rows are told by one expression.
MANY = 16


def check_names(df: DataFrame, names: list[str]) -> None:
    for name in names:
        if name not in df.columns:
            raise unknown_variable(name, df.columns)


def taken(df: DataFrame, name: str, but: str | None = None) -> bool:
    """Whether a column has this name, in any case: columns that differ in case only couldn't be told apart."""
    return name.lower() in {c.lower() for c in df.columns if c != but}


def fresh(columns: list[str], *stems: str) -> list[str]:
    """Names made of the stems that none of the columns has."""
    known, out = {c.lower() for c in columns}, []
    for stem in stems:
        while stem.lower() in known:
            stem += "_"
        known.add(stem.lower())
        out.append(stem)
    return out


def is_text(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] == "string"


def check_numeric(df: DataFrame, names: list[str]) -> None:
    check_names(df, names)
    for name in names:
        if is_text(df, name):
            raise text_variable(name)


def numeric_names(df: DataFrame) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in df.dtypes if t in kinds or t.startswith("decimal")]


def has_value(df: DataFrame, name: str) -> Column:
    """Not null, not NaN, and not an empty text."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind == "string":
        return c.isNotNull() & (c != "")
    return c.isNotNull() & ~F.isnan(c) if kind in ("float", "double") else c.isNotNull()


def complete_cases(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows in which all of these variables have a value, with these columns only.

    Of many variables, nulls and NaN are counted by one expression: a condition for
    each makes a method that the JVM doesn't compile, and takes twenty times as long.
    """
    check_names(df, names)
    names = list(dict.fromkeys(names))
    out, apart = df.select(*names), names
    if len(names) > MANY:
        out, apart = out.na.drop(subset=[f"`{name}`" for name in names]), [name for name in names if is_text(df, name)]
    for name in apart:
        out = out.where(has_value(df, name))
    return out


def generate(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A new variable; names that differ in case only count as equal."""
    if taken(df, name):
        raise StatError("invalid_request", f"'{name}' exists already.", "generate makes new variables, and names that differ in case only can't be told apart.", "Use replace, or another name.")
    return df.withColumn(name, finite(value.cast("double")))


def replace(df: DataFrame, name: str, value: Column, where: Column | None = None) -> DataFrame:
    """The value is that of all rows; it is taken over where the condition holds, missing or not."""
    check_numeric(df, [name])
    new = finite(value.cast("double"))
    return df.withColumn(name, new if where is None else F.when(F.coalesce(where, F.lit(False)), new).otherwise(F.col(name).cast("double")))


def drop_vars(df: DataFrame, names: list[str]) -> DataFrame:
    check_names(df, names)
    return df.drop(*names)


def keep_vars(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns keep their order."""
    if not names:
        raise StatError("syntax", "keep needs variables.", "Keeping none would delete all data.", "Name the variables to keep.")
    check_names(df, names)
    return df.select(*(c for c in df.columns if c in names))


def drop_if(df: DataFrame, where: Column) -> DataFrame:
    """A row whose condition is missing stays."""
    return df.where(~F.coalesce(where, F.lit(False)))


def keep_if(df: DataFrame, where: Column) -> DataFrame:
    """A row whose condition is missing goes."""
    return df.where(where)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """A new name; it may be the old one in another case, but no other variable's in any case."""
    if taken(df, new, but=old) or new == old:
        raise StatError("invalid_request", f"'{new}' exists already.", "Names must differ, not only in case.", "Choose another name.")
    check_names(df, [old])
    return df.toDF(*(new if c == old else c for c in df.columns)) if new.lower() == old.lower() else df.withColumnRenamed(old, new)


def label_variable(df: DataFrame, name: str, label: str) -> DataFrame:
    check_names(df, [name])
    return df.withMetadata(name, dict(df.schema[name].metadata) | {"label": label})


def sort_keys(df: DataFrame, keys: list[tuple[str, bool]]) -> list[Column]:
    """(name, descending) as orders in which missing values come last either way."""
    check_names(df, [n for n, _ in keys])
    values = [(F.col(f"`{n}`") if is_text(df, n) else F.when(has_value(df, n), F.col(f"`{n}`")), down) for n, down in keys]
    return [c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in values]


def sort(df: DataFrame, name: str, descending: bool = False, ties: list[str] | None = None) -> DataFrame:
    """Missing values come last either way; ``ties`` orders rows with equal values."""
    return df.orderBy(*sort_keys(df, [(name, descending)]), *(ties or []))


def describe(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """name, storage, semantic and label of each variable, from the schema alone."""
    check_names(df, names or [])
    fields = [df.schema[n] for n in (names or df.columns)]
    rows = [(i, f.name, "text" if f.dataType.simpleString() == "string" else "numeric", f.metadata.get("semantic", "unknown"), f.metadata.get("label", "")) for i, f in enumerate(fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, storage string, semantic string, label string")
