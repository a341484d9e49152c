"""Anonymising streams: the kinds that depend on seed and value alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import column
from tessera.operators.anonymize import DatetimeJitter, NumericJitter, RandomString, coerce, replaced


def anonymize_stream(df: DataFrame, spec: dict, seed: int) -> DataFrame:
    """df, a stream or not, with columns replaced by stateless expressions.

    Takes numeric jitter (say ``whole`` for a float column of whole numbers),
    datetime jitter, and random strings: the same values get the same strings
    in every batch, but two values that draw the same one keep it, since telling them
    apart needs all values.  Use 16 characters or more where that matters.
    """
    new = {}
    for name, given in spec.items():
        if name not in df.columns:
            raise KeyError(name)
        a, t = coerce(given), df.schema[name].dataType
        match a:
            case NumericJitter():
                new[name] = NumericJitter(a.pct, a.round_to, bool(a.whole) if a.whole is not None else None).expression(column(name), t, name, seed)
            case DatetimeJitter():
                new[name] = a.expression(column(name), t, name, seed)
            case RandomString():
                new[name] = F.when(column(name).isNotNull(), a.candidate(column(name), name, seed))
            case _:
                raise TypeError(f"{name}: {type(a).__name__} needs all values and can't run on a stream")
    return replaced(df, new)
