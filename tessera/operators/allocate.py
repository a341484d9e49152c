"""Proportional allocation by largest remainders, in whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import column


def allocate(sizes: DataFrame, strata: list[str], n: int, size: str = "size") -> DataFrame:
    """sizes with ``alloc``: floor(size * n / total), and one more for the largest remainders.

    Equal remainders go by stratum, ascending with nulls last.  The windows see
    one row a stratum.
    """
    everything = Window.partitionBy()
    share = sizes.withColumn("__total", F.sum(size).over(everything))
    share = share.withColumn("__q", F.expr(f"cast({size} * cast({n} as decimal(20,0)) div __total as bigint)")).withColumn("__r", F.expr(f"cast({size} * cast({n} as decimal(20,0)) % __total as bigint)"))
    order = Window.orderBy(F.col("__r").desc(), *[column(c).asc_nulls_last() for c in strata])
    share = share.withColumn("__rank", F.row_number().over(order)).withColumn("__left", F.lit(n) - F.sum("__q").over(everything))
    return share.withColumn("alloc", (F.col("__q") + (F.col("__rank") <= F.col("__left")).cast("bigint")).cast("bigint")).drop("__total", "__q", "__r", "__rank", "__left")
