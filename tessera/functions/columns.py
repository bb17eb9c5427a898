"""Schema-time helpers: column roles by type, name handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric as the reference sees it: ints, floats, decimals and booleans."""
    return isinstance(dt, INTEGRAL + FRACTIONAL + (T.BooleanType,))


def is_integral_type(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL)


def is_float_type(dt: T.DataType) -> bool:
    return isinstance(dt, FRACTIONAL)


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    ex = _as_set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in ex]


def dtype_name(dt: T.DataType) -> str:
    """Short, stable dtype label used in profile tables."""
    return dt.simpleString()


def _as_set(x) -> set:
    """Accept None, one name or a list of names (the reference documents a
    list but compares with ``==``; we honour both)."""
    if x is None:
        return set()
    if isinstance(x, str):
        return {x}
    return set(x)


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)


def normalized_name(name: str) -> str:
    """Lower-case, spaces to underscores (CLN1)."""
    return name.lower().replace(" ", "_")
