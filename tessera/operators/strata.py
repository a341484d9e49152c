"""Choosing columns to stratify by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import column
from tessera.functions.kinds import TEXT_LENGTH, finite, kind_of, may_be_fractional, nan_to_null
from tessera.operators.profile import CATEGORY_LIMIT, CATEGORY_SHARE, NUMERIC_LIMIT, NUMERIC_SHARE

#: A sketch's estimate may be this much over a limit before a column is given up without an exact count.
SLACK = 1.3


def candidate_columns(df: DataFrame, rows: int, exclude: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(column, distinct values) that could make strata, fewest values first, ties in column order.

    One pass screens all columns by sketch; the few that pass are counted
    exactly in another, whose shuffle has a row for each of their few values
    and task.  Nulls are not counted.
    """
    fields = [f for f in df.schema.fields if f.name not in exclude and kind_of(f.dataType) != "other"]
    if not fields or not rows:
        return []
    screen = []
    for i, f in enumerate(fields):
        c = column(f.name)
        screen.append(F.approx_count_distinct(nan_to_null(c, f.dataType)).alias(f"d{i}"))
        if kind_of(f.dataType) == "categorical":
            screen.append(F.avg(F.length(c.cast("string"))).alias(f"l{i}"))
        if may_be_fractional(f.dataType):
            screen.append(F.bool_or(F.when(finite(c, f.dataType), c != F.rint(c))).alias(f"f{i}"))
    got = df.agg(*screen).first().asDict()
    limits = {}
    for i, f in enumerate(fields):
        limit = min(CATEGORY_LIMIT, CATEGORY_SHARE * rows)
        if kind_of(f.dataType) == "numeric":
            limit = min(limit, NUMERIC_LIMIT, NUMERIC_SHARE * rows)
        if got[f"d{i}"] <= SLACK * limit + 1 and not got.get(f"f{i}") and (got.get(f"l{i}") or 0) <= TEXT_LENGTH:
            limits[i] = limit
    if not limits:
        return []
    values = F.array(*[F.struct(F.lit(i).alias("i"), nan_to_null(column(fields[i].name), fields[i].dataType).cast("string").alias("v")) for i in limits])
    counted = df.select(F.explode(values).alias("p")).select("p.*").where("v is not null").distinct().groupBy("i").count().collect()
    exact = {r.i: r["count"] for r in counted}
    out = [(fields[i].name, exact.get(i, 0)) for i, limit in limits.items() if 2 <= exact.get(i, 0) <= limit]
    return sorted(out, key=lambda x: x[1])


def find_stratification_columns(df: DataFrame, n: int, rows: int | None = None, exclude: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """Candidates taken greedily, fewest values first, while the joint number of strata is at most n."""
    chosen, joint = [], 1
    for name, distinct in candidate_columns(df, df.count() if rows is None else rows, tuple(exclude)):
        if joint * distinct <= n:
            chosen.append((name, distinct))
            joint *= distinct
    return chosen
