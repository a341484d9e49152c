"""Column statistics: one pass for all scalars, one shuffle for all frequencies, one for all histograms."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import column
from tessera.functions.kinds import finite, finite_double, kind_of, may_be_fractional
from tessera.functions.textbars import number

#: Numbers count as categories up to this many, and this share of the rows.
NUMERIC_LIMIT, NUMERIC_SHARE = 20, 0.3
CATEGORY_LIMIT, CATEGORY_SHARE = 100, 0.5
#: Values that one task may hold for an exact median, and bins of a step towards it.
HELD, STEPS = 1_000_000, 256
#: Characters beyond which values are grouped by a digest instead.
LONG = 64


@dataclass
class ColumnStats:
    """What is known of one column; numbers are of finite values, counts of all that isn't null."""

    name: str
    dtype: str
    kind: str
    count: int = 0
    missing: int = 0
    missing_pct: float = 0.0
    unique: int = 0
    unique_pct: float = 0.0
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    std: float | None = None
    median: float | None = None
    mode: str | None = None
    top_values: list[tuple[str, int]] = field(default_factory=list)
    histogram: list[int] = field(default_factory=list)
    histogram_labels: list[str] = field(default_factory=list)
    stratifiable: bool = False
    approximate: bool = False
    average_length: float | None = None
    fractional: bool = False

    def summary(self) -> str:
        """The column in a few words."""
        if self.kind == "numeric" and self.min is not None:
            return f"{number(self.min)} … {number(self.max)}  μ={number(self.mean)}"
        if self.top_values:
            value, n = self.top_values[0]
            return f"top: {value[:20]} ({n / self.count * 100 if self.count else 0:.0f}%)"
        return ""


def as_text(c: Column, data_type: T.DataType) -> Column:
    """c as a string that tells its values apart, nested ones as JSON."""
    return F.to_json(c) if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")


def _grouped(value: Column) -> Column:
    """What stands for a value when values are counted: itself, or a marked digest of a long one."""
    return F.when(F.length(value) <= LONG, value).otherwise(F.concat(F.lit("\0"), F.sha2(value, 256)))


def _pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), as_text(column(c), types[c]).alias("value")) for c in columns])).alias("p")
    return df.select(pairs).select("p.*").where("value is not null")


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of the values, as strings, of several columns; nulls are left out.

    Rows are counted map-side before the one shuffle, whatever the number of
    columns.  Values of more than ``LONG`` characters stand as digests
    (``whole_values`` has them again).
    """
    return _pairs(df, columns).withColumn("value", _grouped(F.col("value"))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def whole_values(df: DataFrame, rows: list) -> dict[tuple[str, str], str]:
    """(column, digest) -> value for the rows of ``frequencies`` that are digests; few rows, one pass."""
    wanted = sorted({(r.column, r.value) for r in rows if r.value.startswith("\0")})
    if not wanted:
        return {}
    table = df.sparkSession.createDataFrame(wanted, "column string, key string")
    found = _pairs(df, sorted({c for c, _ in wanted})).where(F.length("value") > LONG).withColumn("key", _grouped(F.col("value")))
    return {(r.column, r.key): r.value for r in found.join(F.broadcast(table), ["column", "key"], "left_semi").groupBy("column", "key").agg(F.min("value").alias("value")).collect()}


def top_values(counted: DataFrame, top: int) -> DataFrame:
    """The ``top`` most frequent values of each column (ties: least value), with their rank."""
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def medians(df: DataFrame, ends: dict[str, tuple[float, float, int]], held: int = HELD) -> dict[str, float]:
    """The median of the finite values of numeric columns, from least, greatest and number of each.

    Columns of up to ``held`` values are sorted by an aggregation.  Others are
    narrowed first: counts in bins tell in which the middle lies, all columns in a pass,
    until that bin has few values or is a single one.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    x = {c: finite_double(column(c), types[c]) for c in ends}
    # Of each column: the bounds that hold both middle values, and how many values are below them.
    state = {c: (low, high, n, 0) for c, (low, high, n) in ends.items() if n}
    while wide := {c: s for c, s in state.items() if s[2] > held and s[0] < s[1]}:
        which = {c: F.when((x[c] >= low) & (x[c] <= high), F.floor((x[c] - low) / ((high - low) / STEPS))) for c, (low, high, _, _) in wide.items()}
        parts = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), which[c].alias("b"), x[c].alias("x")) for c in wide])).alias("p")
        bins: dict = {}
        for r in df.select(parts).select("p.*").where("b is not null").groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect():  # STEPS + 1 rows a column
            bins.setdefault(r.c, []).append((r.b, r.n, r.low, r.high))
        for c, (_, _, _, below) in wide.items():
            total, at, new = ends[c][2], below, None
            first, last = (total - 1) // 2, total // 2  # ranks of the middle values
            for _, n, low, high in sorted(bins[c]):
                if at + n > first and new is None:
                    new = [low, high, n, at]
                elif new is not None and new[3] + new[2] <= last:
                    new[1], new[2] = high, new[2] + n
                at += n
            state[c] = state[c][:2] + (held, below) if tuple(new) == state[c] else tuple(new)
    if not state:
        return {}
    inside = {c: F.when((x[c] >= low) & (x[c] <= high), x[c]) for c, (low, high, _, _) in state.items()}
    asked = []
    for i, (c, (low, high, n, below)) in enumerate(state.items()):
        total = ends[c][2]
        if low == high:
            asked.append(F.lit(low).alias(str(i)))
            continue
        # The middle of all values, as a place among those inside.
        place = [((total - 1) // 2 - below) / max(n - 1, 1), (total // 2 - below) / max(n - 1, 1)]
        asked.append((F.aggregate(F.percentile(inside[c], place), F.lit(0.0), lambda a, v: a + v) / 2).alias(str(i)))
    row = df.agg(*asked).first()
    return {c: row[str(i)] for i, c in enumerate(state)}


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """0 to bins - 1; values on the last edge are in the last bin."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((x - F.lit(low)) / F.lit((high - low) / bins)).cast("int")))


def edges(low: float, high: float, bins: int) -> list[float]:
    """Equal widths from low to high; half a unit about a constant."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    return [low + (high - low) * i / bins for i in range(bins)] + [high]


def histograms(df: DataFrame, ranges: dict[str, tuple[float, float]], bins: int) -> DataFrame:
    """(column, bin, n) of finite values of numeric columns between given ends; empty bins are left out."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c, (low, high) in ranges.items():
        ends = edges(low, high, bins)
        x = finite_double(column(c), types[c])
        inside = F.when((x >= ends[0]) & (x <= ends[-1]), bin_of(x, ends[0], ends[-1], bins))
        parts.append(F.struct(F.lit(c).alias("column"), inside.alias("bin")))
    return df.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where("bin is not null").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))


def scalar_aggregates(df: DataFrame, columns: list[str], approximate: bool) -> list[Column]:
    """All scalars of all columns, for one ``agg``; column i's are named {what}_{i}."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        c, t = column(name), types[name]
        out.append(F.count(c).alias(f"count_{i}"))
        if approximate:
            out.append(F.approx_count_distinct(as_text(c, t) if kind_of(t) == "other" else c).alias(f"distinct_{i}"))
        if kind_of(t) == "numeric":
            x = finite_double(c, t)
            out += [F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}"), F.avg(x).alias(f"mean_{i}"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"std_{i}")]
            out.append((F.percentile_approx(x, 0.5) if approximate else F.count(x)).alias(f"median_{i}" if approximate else f"finite_{i}"))
            if may_be_fractional(t):
                out.append(F.coalesce(F.bool_or(F.when(finite(c, t), c != F.rint(c))), F.lit(False)).alias(f"fractional_{i}"))
        elif kind_of(t) in ("categorical", "text"):
            out.append(F.avg(F.length(c.cast("string"))).alias(f"length_{i}"))
    return out


def is_stratifiable(s: ColumnStats, rows: int) -> bool:
    """Few enough categories to make strata of, and whole numbers only."""
    if not 2 <= s.unique <= min(CATEGORY_LIMIT, CATEGORY_SHARE * rows) or s.kind in ("text", "other"):
        return False
    return s.kind != "numeric" or (s.unique <= min(NUMERIC_LIMIT, NUMERIC_SHARE * rows) and not s.fractional)


def profile(df: DataFrame, columns: list[str] | None = None, *, approximate: bool = False, bins: int = 10, top: int = 5, distributions: bool = True) -> list[ColumnStats]:
    """Statistics of df's columns (all, or those named).

    Exact by default: distinct counts, modes and top values come from one
    grouped count of all columns' values, which is kept meanwhile; medians from
    passes that no task has to hold a whole column for.  ``approximate`` takes distinct
    counts and medians from sketches in the scalar pass; ``distributions=False``
    skips modes, top values and histograms, so that an approximate profile is a
    single pass without a shuffle of values.
    """
    missing = [c for c in columns or [] if c not in df.columns]
    if missing:
        raise ValueError(f"Unknown column(s): {', '.join(missing)}")
    names = list(columns or df.columns)
    if not names:
        return []
    types = {f.name: f.dataType for f in df.schema.fields}
    got = df.select(*[column(c) for c in names]).agg(*scalar_aggregates(df, names, approximate)).first()
    rows, stats = got["rows"], []
    get = got.asDict().get
    for i, c in enumerate(names):
        length = get(f"length_{i}")
        s = ColumnStats(c, types[c].simpleString(), kind_of(types[c], length), get(f"count_{i}"), approximate=approximate, average_length=length, fractional=bool(get(f"fractional_{i}")))
        s.missing = rows - s.count
        s.missing_pct = s.missing / rows * 100 if rows else 0.0
        s.unique = min(get(f"distinct_{i}") or 0, s.count)
        s.min, s.max, s.mean, s.median = (get(f"{x}_{i}") for x in ("min", "max", "mean", "median"))  # the exact median comes later
        s.std = get(f"std_{i}") if s.mean is not None else None
        stats.append(s)
    by_name = {s.name: s for s in stats}
    if not approximate:
        for c, x in medians(df, {s.name: (s.min, s.max, get(f"finite_{i}")) for i, s in enumerate(stats) if s.min is not None}).items():
            by_name[c].median = x
    if not approximate or distributions:
        counted = frequencies(df, names).persist()
        order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
        if not approximate:
            for r in counted.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect():
                by_name[r.column].unique = r.n
        if distributions:
            best = top_values(counted, top).orderBy("column", "rank").collect()
            whole = whole_values(df, best)
            for r in best:
                by_name[r.column].top_values.append((whole.get((r.column, r.value), r.value), r.n))
            for s in stats:
                if s.kind == "numeric":
                    s.top_values = []
                elif s.top_values:
                    s.mode = s.top_values[0][0]
            numeric = [s.name for s in stats if s.kind == "numeric"]
            if numeric:
                best = counted.where(F.col("column").isin(numeric)).withColumn("x", F.expr("try_cast(value as double)"))
                order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("x").asc_nulls_last())
                for r in best.withColumn("rank", F.row_number().over(order)).where("rank = 1").collect():
                    by_name[r.column].mode = r.value
        counted.unpersist()
    for s in stats:
        s.unique_pct = s.unique / s.count * 100 if s.count else 0.0
        s.stratifiable = is_stratifiable(s, rows)
    if distributions:
        ranges = {s.name: (s.min, s.max) for s in stats if s.kind == "numeric" and s.min is not None}
        if ranges:
            for s in stats:
                if s.name in ranges:
                    ends = edges(*ranges[s.name], bins)
                    s.histogram = [0] * bins
                    s.histogram_labels = [f"{number(ends[j])} – {number(ends[j + 1])}" for j in range(bins)]
            for r in histograms(df, ranges, bins).collect():
                by_name[r.column].histogram[r.bin] = r.n
    return stats


PROFILE_SCHEMA = (
    "name string, dtype string, kind string, count bigint, missing bigint, missing_pct double, unique bigint, unique_pct double, min double, max double, mean double, std double, "
    "median double, mode string, top_values array<struct<value: string, count: bigint>>, histogram array<bigint>, histogram_labels array<string>, stratifiable boolean, approximate boolean"
)


def profile_table(df: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """``profile`` as a table with a row for each column."""
    fields = [f.name for f in T._parse_datatype_string(PROFILE_SCHEMA).fields]
    return df.sparkSession.createDataFrame([tuple(asdict(s)[f] for f in fields) for s in profile(df, columns, **options)], PROFILE_SCHEMA)
