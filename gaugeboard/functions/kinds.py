"""Column kinds: which columns count as numeric, categorical, and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
TEMPORAL = "temporal"
BOOLEAN = "boolean"
OTHER = "other"

_KIND_OF_TYPE = {
    T.FloatType: NUMERIC,
    T.DoubleType: NUMERIC,
    T.IntegerType: NUMERIC,
    T.LongType: NUMERIC,
    T.StringType: CATEGORICAL,
    T.DateType: TEMPORAL,
    T.TimestampType: TEMPORAL,
    T.TimestampNTZType: TEMPORAL,
    T.BooleanType: BOOLEAN,
}


def kind(data_type: T.DataType, decimals: bool = False) -> str:
    """The kind of a type; narrow integers and decimals are not numeric.

    ``decimals=True`` counts ``DecimalType`` as numeric too.
    """
    if decimals and isinstance(data_type, T.DecimalType):
        return NUMERIC
    return _KIND_OF_TYPE.get(type(data_type), OTHER)


def columns_of_kind(df: DataFrame, wanted: str, decimals: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields if kind(f.dataType, decimals) == wanted]


def numeric_cols(df: DataFrame, decimals: bool = False) -> list[str]:
    """Numeric columns in schema order."""
    return columns_of_kind(df, NUMERIC, decimals)


def categorical_cols(df: DataFrame) -> list[str]:
    """String columns in schema order."""
    return columns_of_kind(df, CATEGORICAL)


def default_xy(df: DataFrame) -> tuple[str | None, str | None]:
    """Bar and line axes: first string column, first numeric column.

    Without one, x falls back to the first column and y to the second.
    """
    names = df.columns
    x = next(iter(categorical_cols(df)), names[0] if names else None)
    y = next(iter(numeric_cols(df)), names[1] if len(names) > 1 else None)
    return x, y


def default_xyz(df: DataFrame) -> tuple[str, str, str] | None:
    """Scatter axes: first three numeric columns, missing ones repeat the first."""
    cols = numeric_cols(df)
    if not cols:
        return None
    return tuple(cols[i] if i < len(cols) else cols[0] for i in range(3))


def quoted(name: str) -> str:
    """Column name as it is written in a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(text: str) -> str:
    """A string literal in a SQL expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double_literal(value: float | None) -> str:
    """A double literal in a SQL expression."""
    return "CAST(NULL AS DOUBLE)" if value is None else f"CAST('{float(value)!r}' AS DOUBLE)"


def number_sql(df: DataFrame, name: str) -> str:
    """``number`` as text; wide aggregates are much faster to build from text."""
    value = f"CAST({quoted(name)} AS DOUBLE)"
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return f"nanvl({value}, CAST(NULL AS DOUBLE))"
    return value


def number(df: DataFrame, name: str) -> Column:
    """Column as double, with NaN read as missing."""
    return F.expr(number_sql(df, name))


def present(df: DataFrame, name: str) -> Column:
    """Column in its own type, with NaN read as missing."""
    value = F.col(quoted(name))
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.nanvl(value, F.lit(None).cast(data_type))
    return value


def decimals_as_numbers(df: DataFrame) -> DataFrame:
    """The same columns with decimals as doubles, so that every operator counts them as numeric."""
    return df.select(*[F.col(quoted(f.name)).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(quoted(f.name)) for f in df.schema.fields])
