"""Column helpers driven by the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    """Integer, floating and decimal columns; booleans and times are not numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def holds_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.MapType):
        return True
    if isinstance(data_type, T.ArrayType):
        return holds_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(holds_map(f.dataType) for f in data_type.fields)
    return False


def nan_to_null(df: DataFrame) -> DataFrame:
    """Both NaN and NULL mean "missing"; keep only NULL so aggregates skip them."""
    if not any(is_floating(f.dataType) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
            if is_floating(f.dataType)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def groupable(df: DataFrame) -> DataFrame:
    """Maps cannot be grouped on; write them as JSON text."""
    if not any(holds_map(f.dataType) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.to_json(col(f.name)).alias(f.name) if holds_map(f.dataType) else col(f.name)
            for f in df.schema.fields
        ]
    )


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def round_cents(value: Column) -> Column:
    """Two decimals by binary arithmetic, so 0.575 (stored below .575) gives 0.57."""
    return F.floor(value * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)
