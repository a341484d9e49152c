"""Anonymisation: equal values get equal replacements, nulls stay, and results don't depend on partitioning or order of columns."""

from __future__ import annotations

import math
import re
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import column, digest, integer, pick_seed, uniform
from tessera.functions.kinds import finite, is_float, kind_of
from tessera.operators.names import library
from tessera.operators.sample import _free, _key

#: Distinct values up to which a mapping is broadcast; larger ones are joined by shuffle.
BROADCAST_VALUES = 200_000
#: Distinct values that one task numbers, and ranges at most that more of them are dealt into.
NUMBERED, RANGES = 1_000_000, 256
#: Distinct values of a column that a mapping may be suggested for.
SUGGESTED = 10_000

# Values of gender columns (fixed values).
MALE = ("m", "male", "man", "men", "boy", "1", "männlich", "mannlich", "homme", "hombre", "masculino", "maschio", "erkek", "мужской", "男", "남")
FEMALE = ("f", "female", "woman", "women", "girl", "2", "weiblich", "femme", "mujer", "feminino", "femmina", "kadin", "kadın", "женский", "女", "여")
THIRD = ("x", "o", "other", "nonbinary", "non-binary", "non binary", "nb", "enby", "third", "third gender", "genderqueer", "diverse", "divers", "d", "3")
UNDISCLOSED = ("", "u", "unknown", "undisclosed", "not disclosed", "prefer not to say", "prefer not", "n/a", "na", "none", "null", "nan", "0", "9", "?")
GENDERS = ("male", "female", "third", "undisclosed")


class Anonymizer(ABC):
    """Replaces one column; subclasses say how."""

    @abstractmethod
    def apply(self, df: DataFrame, name: str, seed: int, key: list[str] | None) -> DataFrame:
        """df with the column replaced in its place."""


def replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with columns replaced in their places."""
    return df.select(*[new[c].alias(c) if c in new else column(c) for c in df.columns])


class ExpressionAnonymizer(Anonymizer):
    """A replacement that is a function of seed and value alone: no shuffle, and it works on streams."""

    @abstractmethod
    def expression(self, c: Column, data_type: T.DataType, name: str, seed: int) -> Column: ...

    def apply(self, df, name, seed, key):
        return replaced(df, {name: self.expression(column(name), df.schema[name].dataType, name, seed)})


class MappingAnonymizer(Anonymizer):
    """A replacement for each distinct value, made from all of them and joined back.

    Subclass it with ``replacements``: from (value, first), each distinct value
    and the least row key it has, to (value, replacement).
    """

    needs_order = False

    @abstractmethod
    def replacements(self, values: DataFrame, name: str, seed: int) -> DataFrame: ...

    def apply(self, df, name, seed, key):
        first = F.min(F.struct(*_key(df, key))) if self.needs_order else F.lit(None)
        values = df.where(column(name).isNotNull()).groupBy(column(name).alias("value")).agg(first.alias("first"))
        return join_mapping(df, name, self.replacements(values, name, seed))


def join_mapping(df: DataFrame, name: str, mapping: DataFrame) -> DataFrame:
    """df with the column gathered from (value, replacement); null stays null."""
    value, new = _free(df, "__value", "__new")
    mapping = mapping.select(F.col("value").alias(value), F.col("replacement").alias(new))
    if mapping.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES:
        mapping = F.broadcast(mapping)
    joined = df.join(mapping, column(name) == F.col(value), "left")
    return joined.select(*[F.col(new).alias(c) if c == name else column(c) for c in df.columns])


def _text(c: Column) -> Column:
    return c.cast("string")


def ranked(values: DataFrame, order: Column, by: list[str] | None = None, into: str = "i") -> DataFrame:
    """values with ``into``, 0 and on in the order of a digest (ties by value), within ``by``.

    Digests are spread evenly, so ranks are counted in 4096 ranges of them that
    are ranked apart and moved by how many come before: no task sees all values.
    """
    by = by or []
    some = values.withColumn("__o", order).withColumn("__r", F.substring("__o", 1, 3))
    counts = some.groupBy(*by, "__r").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.withColumn("__before", F.sum("__c").over(Window.partitionBy(*by).orderBy("__r")) - F.col("__c")).drop("__c")
    within = F.row_number().over(Window.partitionBy(*by, "__r").orderBy("__o", _text(F.col("value"))))
    same = F.col("a.__r") == F.col("b.__r")
    for c in by:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = some.withColumn("__n", within).alias("a").join(before.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}") for c in values.columns], (F.col("b.__before") + F.col("a.__n") - 1).cast("bigint").alias(into))


def numbered(values: DataFrame, order: list[str], into: str = "i", most: int = NUMBERED) -> DataFrame:
    """values with ``into``, 0 and on in the order of some columns.

    More than ``most`` rows are dealt into ranges of the first of them, whose ends come
    from a sample of their values; ranges are counted, numbered apart and
    moved by how many come before.  What the driver holds is some ends and counts.
    """
    rows = values.count()
    if rows <= most:
        return values.withColumn(into, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    ranges = min(RANGES, 1 + rows // most)
    drawn = sorted(r[0] for r in values.select(order[0]).sample(min(1.0, 50 * ranges / rows), seed=1).where(F.col(order[0]).isNotNull()).collect())
    ends = sorted(set(drawn[len(drawn) * i // ranges] for i in range(1, ranges))) if drawn else []
    kind = values.schema[order[0]].dataType
    literal = lambda v: F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(v, kind.fields, strict=True)]) if isinstance(kind, T.StructType) else F.lit(v).cast(kind)
    which = F.lit(0)
    for e in ends:
        which = which + F.coalesce((F.col(order[0]) >= literal(e)).cast("int"), F.lit(0))
    dealt = values.withColumn("__range", which)
    before, at = {}, 0
    for r in sorted(dealt.groupBy("__range").count().collect()):  # a row a range
        before[r["__range"]], at = at, at + r["count"]
    moved = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("__range"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn(into, (inside + moved).cast("bigint")).drop("__range")


def distinct_names(mapping: DataFrame) -> DataFrame:
    """(value, replacement) with repeated replacements numbered: the k-th by value gets " k" from the second on."""
    k = F.row_number().over(Window.partitionBy("replacement").orderBy(F.col("value").asc()))
    return mapping.withColumn("__k", k).select("value", F.when(F.col("__k") == 1, F.col("replacement")).otherwise(F.concat("replacement", F.lit(" "), F.col("__k").cast("string"))).alias("replacement"))


@dataclass
class SequentialId(MappingAnonymizer):
    """start, start + interval, ... by first appearance; a prefix or width makes strings.

    First appearance is the least row key; very many values are numbered over ranges of it.
    """

    start: int = 1
    interval: int = 1
    prefix: str = ""
    width: int = 0
    needs_order = True

    def __post_init__(self):
        if not self.interval:
            raise ValueError("interval can't be 0")

    def replacements(self, values, name, seed):
        values = numbered(values.select("value", "first", _text(F.col("value")).alias("text")), ["first", "text"])
        n = (F.lit(self.start) + F.lit(self.interval) * F.col("i")).cast("bigint")
        if self.prefix or self.width:
            digits = F.abs(n).cast("string")
            sign = F.when(n < 0, "-").otherwise("")
            pad = F.greatest(F.lit(0), F.lit(self.width) - F.length(digits) - F.length(sign))
            n = F.concat(F.lit(self.prefix), sign, F.repeat(F.lit("0"), pad), digits)
        return values.select("value", n.alias("replacement"))


@dataclass
class NumericJitter(ExpressionAnonymizer):
    """Numbers within pct of what they were; a column of whole numbers stays whole."""

    pct: float = 0.2
    round_to: int | None = None
    whole: bool | None = None

    def __post_init__(self):
        if not 0 < self.pct < 1:
            raise ValueError("pct must be between 0 and 1")

    def expression(self, c, data_type, name, seed):
        if kind_of(data_type) != "numeric":
            raise TypeError(f"{name}: numeric jitter needs numbers, not {data_type.simpleString()}")
        x = c.cast("double")
        u = uniform(digest(seed, name, c))
        moved = F.when(x == 0, x).otherwise(x * (1 - self.pct + 2 * self.pct * u))
        whole = not (is_float(data_type) or isinstance(data_type, T.DecimalType)) if self.whole is None else self.whole
        if whole:
            return F.rint(moved).cast("bigint")
        if is_float(data_type):
            moved = F.when(finite(c, data_type), moved).otherwise(x)
        return moved if self.round_to is None else F.when(moved.isNull() | F.isnan(moved) | (F.abs(moved) == float("inf")), moved).otherwise(F.bround(moved, self.round_to))

    def apply(self, df, name, seed, key):
        t = df.schema[name].dataType
        if self.whole is None and (is_float(t) or isinstance(t, T.DecimalType)):
            c = column(name)
            same = F.coalesce(F.bool_and(F.when(c.isNotNull(), F.coalesce((c == F.rint(c)) & (finite(c, t) if is_float(t) else F.lit(True)), F.lit(False)))), F.lit(False))
            return NumericJitter(self.pct, self.round_to, bool(df.agg(same).first()[0])).apply(df, name, seed, key)
        return super().apply(df, name, seed, key)


UNITS = {"D": 86400.0, "d": 86400.0, "h": 3600.0, "H": 3600.0, "m": 60.0, "min": 60.0, "T": 60.0, "s": 1.0, "S": 1.0, "ms": 0.001, "us": 0.000001, "W": 604800.0}


def seconds(text: str) -> float:
    """Seconds in a duration such as "7D", "12h" or "1D 6h"."""
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*([A-Za-z]+)", text)
    unknown = [u for _, u in parts if u not in UNITS and u.rstrip("s") not in ("day", "hour", "minute", "second", "week")]
    if not parts or unknown:
        raise ValueError(f"not a duration: {text!r}")
    long = {"day": 86400.0, "hour": 3600.0, "minute": 60.0, "second": 1.0, "week": 604800.0}
    return sum(float(n) * (UNITS[u] if u in UNITS else long[u.rstrip("s")]) for n, u in parts)


@dataclass
class DatetimeJitter(ExpressionAnonymizer):
    """Dates and times moved by a whole number of units, at most max_delta either way; date strings are parsed."""

    max_delta: str = "7D"
    unit: str = "s"

    def __post_init__(self):
        self.unit_seconds = seconds(f"1{self.unit}")
        self.span = int(seconds(self.max_delta) // self.unit_seconds)
        if self.span < 1:
            raise ValueError("max_delta must be one unit at least")

    def expression(self, c, data_type, name, seed):
        when = F.try_to_timestamp(c) if isinstance(data_type, T.StringType) else c
        if not isinstance(data_type, T.StringType) and kind_of(data_type) != "datetime":
            raise TypeError(f"{name}: datetime jitter needs dates, not {data_type.simpleString()}")
        steps = F.floor(uniform(digest(seed, name, c)) * (2 * self.span + 1)) - self.span
        moved = when.cast("timestamp") if isinstance(data_type, T.DateType) else when
        moved = moved + F.make_dt_interval(secs=(steps * F.lit(self.unit_seconds)).cast("decimal(18,6)"))
        return moved.cast("date") if isinstance(data_type, T.DateType) else moved

    def apply(self, df, name, seed, key):
        if isinstance(df.schema[name].dataType, T.StringType):
            c = column(name)
            if df.agg(F.bool_or(c.isNotNull() & F.try_to_timestamp(c).isNull())).first()[0]:
                raise TypeError(f"{name}: not all values are dates")
        return super().apply(df, name, seed, key)


CHARSETS = {"alphanumeric": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "digits": "0123456789", "hex": "0123456789abcdef"}


@dataclass
class RandomString(MappingAnonymizer):
    """Strings of random characters, one for each value and no two alike."""

    length: int = 8
    charset: str = "alphanumeric"
    prefix: str = ""

    def __post_init__(self):
        if self.length < 1 or self.charset not in CHARSETS:
            raise ValueError(f"length must be 1 at least, and charset one of {sorted(CHARSETS)}")

    def candidate(self, c: Column, name: str, seed: int) -> Column:
        """The value's own string, before those that coincide are told apart."""
        if self.charset == "hex":
            parts = [digest(seed, name if i == 0 else f"{name}#{i}", c) for i in range(-(-self.length // 32))]
            return F.concat(F.lit(self.prefix), F.substring(F.concat(*parts), 1, self.length))
        chars = CHARSETS[self.charset]
        out = [F.lit(self.prefix)]
        for i in range(self.length):
            h = digest(seed, name if i < 8 else f"{name}#{i // 8}", c)
            out.append(F.substring(F.lit(chars), (integer(h, 1 + 4 * (i % 8), 4) % len(chars) + 1).cast("int"), F.lit(1)))
        return F.concat(*out)

    def replacements(self, values, name, seed):
        return distinct_names(values.select("value", self.candidate(F.col("value"), name, seed).alias("replacement")))


def gender_of(c: Column) -> Column:
    """male, female, third, undisclosed, or null where a value isn't known."""
    s = F.lower(F.trim(c.cast("string")))
    starts = lambda *p: F.greatest(*[s.startswith(x).cast("int") for x in (*p, p[0])]) == 1
    return (
        F.when(s.isin(*MALE), "male").when(s.isin(*FEMALE), "female").when(s.isin(*THIRD), "third").when(s.isin(*UNDISCLOSED) | s.isNull(), "undisclosed")
        .when(starts("male", "man"), "male").when(starts("female", "woman", "fem"), "female")
    )


def ethnicity_of(value) -> str | None:
    """The group, or family of groups, that a raw value names."""
    s = str(value).strip().lower().replace(" ", "_").replace("-", "_")
    return s if s and any(g == s or g.startswith(s + "_") for g in library().groups) else None


def _few(df: DataFrame, name: str) -> list:
    """A column's distinct values; ValueError if there are more than ``SUGGESTED``: those are no categories."""
    values = df.select(column(name).alias("v")).distinct()
    found = values.select("v", gender_of(F.col("v")).alias("g")).limit(SUGGESTED + 1).collect()
    if len(found) > SUGGESTED:
        raise ValueError(f"{name} has more than {SUGGESTED:,} distinct values; a mapping is for categories")
    return found


def suggest_gender_mapping(df: DataFrame, name: str) -> dict:
    """Raw value -> gender (None: to be chosen) for the distinct values of a column of categories."""
    return {r.v: r.g for r in _few(df, name)}


def suggest_ethnicity_mapping(df: DataFrame, name: str) -> dict:
    """Raw value -> group of names (None: to be chosen) for the distinct values of a column of categories."""
    return {r.v: ethnicity_of(r.v) for r in _few(df, name)}


def _step(capacity: int, seed: int) -> tuple[int, int]:
    """Multiplier and offset of a permutation of range(capacity)."""
    a = max(1, int(capacity * 0.6180339887) + seed % 97)
    while math.gcd(a, capacity) != 1:
        a += 1
    return a % capacity or 1, (seed * 7919) % capacity


@dataclass
class Names(MappingAnonymizer):
    """Plausible names, one for each value and no two alike.

    Values are ranked by digest within their pool (gender and ethnicity), and a
    rank takes the slot that a permutation of all combinations of the pool's
    names gives it: the first half of the slots as the style says, then with a
    middle name, then numbered.
    """

    style: str = "first_last"
    gender: str | None = None
    ethnicity: str | None = None
    gender_column: str | None = None
    ethnicity_column: str | None = None
    gender_map: dict | None = None
    ethnicity_map: dict | None = None
    randomize_gender: bool = False
    STYLES = ("first", "last", "first_last", "first_middle_last", "last_first")

    def __post_init__(self):
        if self.style not in self.STYLES:
            raise ValueError(f"Unknown name style {self.style!r}; one of {', '.join(self.STYLES)}")
        if self.gender is not None and self.gender not in GENDERS:
            raise ValueError(f"Unknown gender {self.gender!r}")

    def replacements(self, values, name, seed):
        return self.named(values.select("value", F.lit(self.gender).cast("string").alias("gender"), F.lit(self.ethnicity).cast("string").alias("ethnicity")), name, seed).select("value", "replacement")

    def named(self, values: DataFrame, name: str, seed: int) -> DataFrame:
        """(value, gender, ethnicity) with ``replacement``."""
        ranked_values = ranked(values, digest(seed, name, F.col("value")), ["gender", "ethnicity"])
        pools = self._pools(values.select("gender", "ethnicity").distinct().collect(), seed)
        keys = "gender string, ethnicity string"
        table = values.sparkSession.createDataFrame(pools, f"{keys}, first array<string>, last array<string>, middle array<string>, half bigint, cap bigint, a bigint, b bigint, cap3 bigint, a3 bigint, b3 bigint")
        p = F.broadcast(table.withColumnsRenamed({"gender": "g2", "ethnicity": "e2"}))  # one row a pair of gender and group
        joined = ranked_values.join(p, F.col("gender").eqNullSafe(F.col("g2")) & F.col("ethnicity").eqNullSafe(F.col("e2")))
        slot = F.expr("if(i < half, (cast(a as decimal(38,0)) * i + b) % cap, (cast(a3 as decimal(38,0)) * (i - half) + b3) % cap3)").cast("bigint")
        joined = joined.withColumn("s", slot).withColumn("round", F.expr("if(i < half, 0, (i - half) div cap3)"))
        one = F.expr("element_at(first, cast(s % size(first) as int) + 1)")
        two = F.expr("element_at(last, cast((s div size(first)) % size(last) as int) + 1)")
        mid = F.expr("element_at(middle, cast(s div (size(first) * size(last)) as int) + 1)")
        plain = {"first": one, "last": two, "first_last": F.concat_ws(" ", one, two), "last_first": F.concat_ws(" ", two, one)}.get(self.style)
        more = {"first": F.concat_ws(" ", one, mid), "last": F.concat_ws(" ", two, mid), "last_first": F.concat_ws(" ", two, one, mid)}.get(self.style, F.concat_ws(" ", one, mid, two))
        long = F.when(F.col("round") == 0, more).otherwise(F.concat(more, F.lit(" "), (F.col("round") + 1).cast("string")))
        new = long if plain is None else F.when(F.col("i") < F.col("half"), plain).otherwise(long)
        unique = distinct_names(joined.select("value", new.alias("replacement")))
        return joined.select("value", "gender", "ethnicity").join(unique, "value")

    def _pools(self, pairs, seed: int) -> list[tuple]:
        lib, out = library(), []
        for r in pairs:
            group = None if r.gender == "undisclosed" else r.ethnicity
            gender = r.gender if r.gender in ("male", "female") else None
            first = lib.first_names(gender, group) if self.style != "last" else [""]
            last = lib.last_names(gender, group) if self.style != "first" else [""]
            cap = len(first) * len(last)
            half = 0 if self.style == "first_middle_last" else cap if cap == 1 else cap // 2 + 1
            cap3 = cap * len(lib.middle)
            out.append((r.gender, r.ethnicity, first, last, lib.middle, half, cap, *_step(cap, seed), cap3, *_step(cap3, seed + 1)))
        return out

    def apply(self, df, name, seed, key, linked_from: DataFrame | None = None):
        if not (self.gender_column or self.ethnicity_column or self.randomize_gender):
            return super().apply(df, name, seed, key)
        keys, aggs = F.struct(*_key(df, key)), []
        for alias, c in (("graw", self.gender_column), ("eraw", self.ethnicity_column)):
            if c:
                aggs.append(F.min_by(column(c), F.when(column(c).isNotNull(), keys)).alias(alias))
        values = df.where(column(name).isNotNull()).groupBy(column(name).alias("value")).agg(*(aggs or [F.lit(None).alias("none")]))
        gender = F.lit(self.gender).cast("string")
        if self.gender_column:
            gender = F.coalesce(_mapped("graw", self.gender_map), gender_of(F.col("graw")), gender)
        if self.randomize_gender:
            gender = F.when(uniform(digest(seed, f"{name}|gender", F.col("value"))) < 0.5, "male").otherwise("female")
        ethnicity = F.lit(self.ethnicity).cast("string")
        if self.ethnicity_column:
            s = F.regexp_replace(F.lower(F.trim(F.col("eraw").cast("string"))), "[ -]", "_")
            groups = sorted({p for g in library().groups for p in ["_".join(g.split("_")[: i + 1]) for i in range(len(g.split("_")))]})
            ethnicity = F.coalesce(_mapped("eraw", self.ethnicity_map), F.when(s.isin(*groups), s), ethnicity)
        made = self.named(values.select("value", gender.alias("gender"), ethnicity.alias("ethnicity")), name, seed)
        rewrite = self.randomize_gender and self.gender_column
        v, r, g = _free(df, "__value", "__new", "__gender")
        made = made.select(F.col("value").alias(v), F.col("replacement").alias(r), F.col("gender").alias(g))
        made = F.broadcast(made) if made.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES else made
        joined = df.join(made, column(name) == F.col(v), "left")
        return joined.select(*[F.col(r).alias(c) if c == name else F.col(g).alias(c) if rewrite and c == self.gender_column else column(c) for c in df.columns])


def _mapped(raw: str, table: dict | None) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (str(k), v)]), F.col(raw).cast("string"))


KINDS = {
    "names": Names, "name": Names,
    "sequential_id": SequentialId, "sequential": SequentialId, "seq": SequentialId,
    "numeric_jitter": NumericJitter, "numbers": NumericJitter, "jitter": NumericJitter,
    "datetime_jitter": DatetimeJitter, "datetime": DatetimeJitter, "dates": DatetimeJitter,
    "random_string": RandomString, "string": RandomString, "hex": RandomString,
}


def make_anonymizer(kind: str, **options) -> Anonymizer:
    """An anonymizer by kind and options."""
    name = kind.strip().lower()
    if name not in KINDS:
        raise ValueError(f"Unknown anonymizer kind {kind!r}; one of {', '.join(sorted(KINDS))}")
    return KINDS[name](**({"charset": "hex"} if name == "hex" else {}) | options)


def coerce(spec) -> Anonymizer:
    """An anonymizer from itself, a kind, (kind, options) or a dict with a kind."""
    match spec:
        case Anonymizer():
            return spec
        case str():
            return make_anonymizer(spec)
        case (str() as kind, dict() as options):
            return make_anonymizer(kind, **options)
        case {"kind": kind, **options}:
            return make_anonymizer(kind, **options)
    raise TypeError(f"not an anonymizer: {spec!r}")


def anonymize(df: DataFrame, spec: dict, seed: int | None = None, key: list[str] | None = None) -> DataFrame:
    """df with the columns of spec replaced.

    Every column has a salt of its own, so the order of spec doesn't matter;
    gender and ethnicity columns are read as they are in df, which is why names
    linked to them are made first.
    """
    made = {c: coerce(s) for c, s in spec.items()}
    for c, a in made.items():
        for used in (c, getattr(a, "gender_column", None), getattr(a, "ethnicity_column", None)):
            if used is not None and used not in df.columns:
                raise KeyError(used)
    seed, _ = pick_seed(seed)
    names = list(df.columns)
    if any(isinstance(a, MappingAnonymizer) for a in made.values()):
        # The row key as it is before anything is replaced.
        first, = _free(df, "__key")
        df = df.withColumn(first, F.struct(*_key(df, key)))
        key = [first]
    for c, a in sorted(made.items(), key=lambda x: not isinstance(x[1], Names)):
        df = a.apply(df, c, seed, key)
    return df.select(*[column(c) for c in names])
