"""Exact-size samples, random or proportional to strata, that depend on the seed and not on partitioning."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import column, digest, pick_seed
from tessera.functions.kinds import nan_to_null
from tessera.operators.allocate import allocate
from tessera.operators.strata import find_stratification_columns
from tessera.sources.readers import file_identity, row_count

#: Rows beyond which bringing a result to the driver is warned of.
LARGE = 5_000_000
#: Strata that a broadcast may have.
BROADCAST_STRATA = 200_000


@dataclass
class SampleResult:
    """A sample, lazily; how it was drawn; and of a stratified one the strata with size and alloc."""

    data: DataFrame
    method: str
    requested: int
    strat_cols: list[str] = field(default_factory=list)
    allocation: DataFrame | None = None
    seed: int | None = None
    notes: list[str] = field(default_factory=list)


def _free(df: DataFrame, *names: str) -> list[str]:
    """Helper names that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def _key(df: DataFrame, key: list[str] | None) -> list[Column]:
    """What tells rows apart: the named columns, else file and row number, else all columns that can be written as strings."""
    if key:
        unknown = [k for k in key if k not in df.columns]
        if unknown:
            raise ValueError(f"Unknown key column(s): {', '.join(unknown)}")
        return [column(k) for k in key]
    found = file_identity(df)
    if found:
        return found
    return [column(f.name) if isinstance(f.dataType, T.AtomicType) else F.to_json(column(f.name)) for f in df.schema.fields if not isinstance(f.dataType, T.NullType)]


def random_sample(df: DataFrame, n: int, *, seed: int, key: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """n rows: those with the least digest of seed and key.

    Digests are uniform, so the n least of a known number of rows reach hardly
    further than their share: one pass keeps what is below that and eight
    deviations more, about n rows, and only those are sorted.  They are kept
    (``persist``) once drawn, and counted: should they be too few, which has less than one
    chance in 10^14, a count by the digest's first digits tells how far the n least reach.
    """
    h, k = _free(df, "__h", "__k")
    keys = _key(df, key)
    if n == 0:
        return df.limit(0)
    hexes = digest(seed, "random", *keys)
    rows = row_count(df) if rows is None else rows
    base = df.withColumns({h: hexes, k: F.struct(*keys)})
    bound = min(1.0, (n + 8 * math.sqrt(n) + 40) / max(rows, 1))
    few = base.where(F.substring(h, 1, 12) <= f"{min((1 << 48) - 1, int(bound * (1 << 48))):012x}").persist()
    if few.count() < min(n, rows):
        few.unpersist()
        counts, at, upto = df.select(F.substring(hexes, 1, 3).alias("b")).groupBy("b").count().collect(), 0, "fff"  # 4096 rows at most
        for r in sorted(counts):
            at += r["count"]
            if at >= n:
                upto = r.b
                break
        few = base.where(F.substring(h, 1, 3) <= upto)
    return few.orderBy(h, k).limit(n).drop(h, k)


def _strata(df: DataFrame, strata: list[str]) -> list[Column]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [nan_to_null(column(c), types[c]).alias(c) for c in strata]


def stratum_sizes(df: DataFrame, strata: list[str]) -> DataFrame:
    """(strata..., size): rows of each combination; null, and NaN with it, is a value of its own."""
    return df.select(*_strata(df, strata)).groupBy(*[column(c) for c in strata]).agg(F.count(F.lit(1)).alias("size"))


def stratified_sample(df: DataFrame, n: int, strata: list[str], *, seed: int, key: list[str] | None = None, narrow: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sample, strata with size and alloc): of each stratum the rows with the least digests, proportionally.

    Rows are counted by stratum and the first two digits of their digest: that
    gives the sizes, the allocation, and for each stratum the digits up to
    which its quota reaches.  Rows beyond are filtered out by a join with this
    small table, and only about n rows are ranked.  ``narrow`` ranks keys and
    strata alone and fetches whole rows by key afterwards, which pays for wide
    tables.
    """
    names = [f"s{i}" for i in range(len(strata))]
    h, k, alloc, bound, rank, won_h, won_k, *own = _free(df, "__h", "__k", "__alloc", "__bound", "__rn", "__wh", "__wk", *(f"__{x}" for x in names))
    keys, hexes = _key(df, key), digest(seed, "stratified", *_key(df, key))
    typed = [c.alias(x) for c, x in zip(_strata(df, strata), names, strict=True)]
    counts = df.select(*typed, F.substring(hexes, 1, 2).alias("b")).groupBy(*names, "b").agg(F.count(F.lit(1)).alias("c"))
    reached = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*names).orderBy("b")))
    sizes = reached.groupBy(*names).agg(F.sum("c").alias("size"), F.sort_array(F.collect_list(F.struct("b", "upto"))).alias("u"))  # 256 to a stratum at most
    table = allocate(sizes, names, n)
    table = table.withColumn("bound", F.expr("element_at(filter(u, x -> x.upto >= alloc), 1).b")).drop("u")
    spark = df.sparkSession
    if (rows := table.limit(BROADCAST_STRATA + 1).collect()) and len(rows) <= BROADCAST_STRATA:
        table = F.broadcast(spark.createDataFrame(rows, table.schema))
    quota = table.where("alloc > 0").select(*[F.col(x).alias(y) for x, y in zip(names, own, strict=True)], F.col("alloc").alias(alloc), F.col("bound").alias(bound))
    base = df.withColumns({h: hexes, k: F.struct(*keys)})
    match = None
    for c, x in zip(_strata(df, strata), own, strict=True):
        same = c.eqNullSafe(F.col(x))
        match = same if match is None else match & same
    ranked_from = base.select(h, k, *[column(c) for c in strata]) if narrow else base
    few = ranked_from.join(quota, match).where(F.substring(h, 1, 2) <= F.col(bound))
    order = Window.partitionBy(*[F.col(x) for x in own]).orderBy(h, k)
    winners = few.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= F.col(alloc))
    allocation = table.select(*[F.col(x).alias(c) for x, c in zip(names, strata, strict=True)], "size", "alloc")
    if narrow:
        # n rows of the sample: the caller's own bound.
        won = winners.select(F.col(h).alias(won_h), F.col(k).alias(won_k))
        won = F.broadcast(won) if n <= BROADCAST_STRATA else won
        return base.join(won, (F.col(h) == F.col(won_h)) & F.col(k).eqNullSafe(F.col(won_k)), "left_semi").drop(h, k), allocation
    return winners.select(*[column(c) for c in df.columns]), allocation


def sample(
    df: DataFrame, n: int, *, use_random: bool = False, exclude: tuple[str, ...] = (), strat_cols: list[str] | None = None, seed: int | None = None, key: list[str] | None = None, narrow: bool | None = None
) -> SampleResult:
    """n rows of df: all if it has no more, at random if asked or without strata, else proportionally.

    Strata are ``strat_cols``, or found (``find_stratification_columns``).  The
    same seed gives the same rows under any partitioning.  A drawn sample is
    marked to be kept (``persist``); ``unpersist`` it, or the session, when done.
    """
    if n < 0:
        raise ValueError("the number of rows can't be negative")
    for c in [*(strat_cols or []), *exclude]:
        if c not in df.columns:
            raise ValueError(f"Unknown column: {c}")
    rows = row_count(df)
    if n >= rows:
        notes = [f"Requested {n:,} rows of {rows:,}: all rows are returned."]
        if rows >= LARGE:
            notes.append(f"WARNING: {rows:,} rows; keep them on the cluster rather than collecting them.")
        return SampleResult(df, "all", n, notes=notes)
    seed, notes = pick_seed(seed)
    if use_random:
        return SampleResult(random_sample(df, n, seed=seed, key=key, rows=rows), "random", n, seed=seed, notes=[*notes, f"Random sample of {n:,} of {rows:,} rows."])
    strata = list(strat_cols) if strat_cols else [c for c, _ in find_stratification_columns(df, n, rows, exclude)]
    if not strata:
        return SampleResult(random_sample(df, n, seed=seed, key=key, rows=rows), "random", n, seed=seed, notes=[*notes, "No column makes strata; sampled at random."])
    wide = len(df.columns) > 50 if narrow is None else narrow
    data, allocation = stratified_sample(df, n, strata, seed=seed, key=key, narrow=wide)
    # Reports, mappings and reductions read the sample again and again: it is kept once drawn.
    return SampleResult(data.persist(), "stratified", n, strata, allocation, seed, [*notes, f"Stratified by {', '.join(strata)}."])


def to_pandas(df: DataFrame):
    """df on the driver, with a warning if that is a lot."""
    rows = row_count(df)
    if rows >= LARGE:
        warnings.warn(f"collecting {rows:,} rows to the driver", stacklevel=2)
    return df.toPandas()
