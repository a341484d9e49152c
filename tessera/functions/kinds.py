"""Kinds of columns, and the one rule for what is missing and what is finite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("numeric", "boolean", "datetime", "categorical", "text", "other")
#: Average characters beyond which a string column is text.
TEXT_LENGTH = 50


def kind_of(data_type: T.DataType, average_length: float | None = None) -> str:
    """The kind of a column by its type, and of a string column by its average length too."""
    match data_type:
        case T.BooleanType():
            return "boolean"
        case T.NumericType():
            return "numeric"
        case T.DateType() | T.TimestampType() | T.TimestampNTZType():
            return "datetime"
        case T.StringType() | T.BinaryType():
            return "text" if (average_length or 0) > TEXT_LENGTH else "categorical"
    return "other"


def may_be_fractional(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType)) or (isinstance(data_type, T.DecimalType) and data_type.scale > 0)


def is_float(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def finite(c: Column, data_type: T.DataType) -> Column:
    """True for numbers other than NaN and the infinities; false or null for all else."""
    return F.abs(c) < F.lit(float("inf")) if is_float(data_type) else c.isNotNull()


def finite_double(c: Column, data_type: T.DataType) -> Column:
    """c as a double where it is finite, else null."""
    return F.when(finite(c, data_type), c.cast("double"))


def nan_to_null(c: Column, data_type: T.DataType) -> Column:
    return F.when(~F.isnan(c), c) if is_float(data_type) else c
