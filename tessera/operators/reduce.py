"""Column reduction by principal components: moments in one pass, eigenvectors on the driver, scores as expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import column
from tessera.functions.kinds import finite, kind_of, may_be_fractional
from tessera.plans.plan import ID_HINTS, has_token

#: Components with less of the variance than this are none.
LEAST_VARIANCE = 1e-12
#: Columns whose cross products go into one aggregation at most.
PRODUCTS = 400


@dataclass
class ReductionResult:
    """The reduced table, lazily, and what a report needs; no components where there was nothing to reduce."""

    data: DataFrame
    n_components: int = 0
    source_columns: list[str] = field(default_factory=list)
    component_names: list[str] = field(default_factory=list)
    explained_variance_ratio: list[float] = field(default_factory=list)
    cumulative_variance_ratio: list[float] = field(default_factory=list)
    total_variance_retained: float = 0.0
    standardized: bool = True
    components: np.ndarray | None = None
    correlation_matrix: np.ndarray | None = None
    column_groups: list[list[str]] = field(default_factory=list)
    dropped_columns: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def _choose(df: DataFrame, columns, exclude) -> list[str]:
    """The numeric columns to reduce, in order."""
    one = lambda x: [x] if isinstance(x, str) else list(x or [])
    named, left_out = one(columns), one(exclude)
    unknown = [c for c in [*named, *left_out] if c not in df.columns]
    if unknown:
        raise ValueError(f"Unknown column(s): {', '.join(unknown)}")
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    wrong = [c for c in named if kinds[c] in ("boolean", "datetime")]
    if wrong:
        raise ValueError(f"not numeric: {', '.join(wrong)}")
    return [c for c in df.columns if c not in left_out and (c in named if named else kinds[c] == "numeric")]


def _numeric(df: DataFrame, name: str) -> Column:
    """The column as a finite double; null where it isn't one."""
    t = df.schema[name].dataType
    x = column(name).cast("double") if kind_of(t) == "numeric" else F.expr(f"try_cast({'`' + name.replace('`', '``') + '`'} as double)")
    return F.when(finite(x, T.DoubleType()), x)


def correlated_groups(names: list[str], r: np.ndarray, least: float) -> list[list[str]]:
    """Connected components, of two columns or more, of pairs with |r| of at least ``least``."""
    groups, seen = [], set()
    for i in range(len(names)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            near = {int(j) for j in np.flatnonzero(np.abs(r[todo.pop()]) >= least)} - group
            group |= near
            todo += near
        seen |= group
        if len(group) > 1:
            groups.append([names[j] for j in sorted(group)])
    return groups


def _covariance(df: DataFrame, z: list[Column]) -> np.ndarray:
    """Sample covariance of columns; products of all pairs are summed map-side, in passes of at most ``PRODUCTS``."""
    p = len(z)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    block = df.select(*[x.alias(f"z{i}") for i, x in enumerate(z)])
    out = np.zeros((p, p))
    for at in range(0, len(pairs), PRODUCTS):
        some = pairs[at : at + PRODUCTS]
        row = block.agg(*[F.covar_samp(f"z{i}", f"z{j}").alias(f"c{n}") for n, (i, j) in enumerate(some)]).first()
        for n, (i, j) in enumerate(some):
            out[i, j] = out[j, i] = row[n] or 0.0
    return out


def reduce_columns(
    df: DataFrame, *, n_components: int | None = None, variance_ratio: float | None = None, columns=None, exclude=None, standardize: bool = True, group_threshold: float = 0.7, prefix: str = "PC", seed: int | None = None
) -> ReductionResult:
    """Replace the numeric columns by their first principal components, at the first one's place.

    Exactly one of ``n_components`` (at most the rank is made) and
    ``variance_ratio`` (as few as reach it) is given.  Cells that aren't finite
    numbers count as the column's mean; columns without variance, or without
    numbers, stay as they are.  Each component's largest loading is positive
    (ties within 1e-9: the first column's).  ``seed`` is accepted for symmetry;
    nothing here is random.
    """
    if (n_components is None) == (variance_ratio is None):
        raise ValueError("give one of n_components and variance_ratio")
    if n_components is not None and (isinstance(n_components, bool) or int(n_components) != n_components or n_components < 1):
        raise ValueError("n_components must be a whole number from 1 on")
    if variance_ratio is not None and not 0 < variance_ratio < 1:
        raise ValueError("variance_ratio must be between 0 and 1")
    if not 0 < group_threshold <= 1:
        raise ValueError("group_threshold must be above 0 and at most 1")
    chosen, notes = _choose(df, columns, exclude), []
    if not chosen:
        return ReductionResult(df, standardized=standardize, notes=["No numeric columns to reduce."])
    x = {c: _numeric(df, c) for c in chosen}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(chosen):
        aggs += [F.count(x[c]).alias(f"n{i}"), F.avg(x[c]).alias(f"m{i}"), F.min(x[c]).alias(f"a{i}"), F.max(x[c]).alias(f"b{i}")]
        aggs.append(F.approx_count_distinct(column(c)).alias(f"d{i}"))
        aggs.append(F.bool_and(x[c] == F.rint(x[c])).alias(f"w{i}"))
    got = df.agg(*aggs).first()
    rows, usable, dropped = got["rows"], [], []
    for i, c in enumerate(chosen):
        (usable if got[f"n{i}"] and got[f"a{i}"] != got[f"b{i}"] else dropped).append(c)
    if dropped:
        notes.append(f"Left as they are, for want of variance or numbers: {', '.join(dropped)}.")
    if len(usable) < 2:
        return ReductionResult(df, source_columns=usable, standardized=standardize, dropped_columns=dropped, notes=[*notes, "Fewer than two usable numeric columns: nothing to reduce."])
    place = {c: i for i, c in enumerate(chosen)}
    suspects = [c for c in usable if got[f"d{place[c]}"] >= 0.8 * rows and (has_token(c, ID_HINTS) or got[f"w{place[c]}"])]
    for c in suspects:
        exact = df.agg(F.count_distinct(column(c))).first()[0]
        whole = got[f"w{place[c]}"] or not may_be_fractional(df.schema[c].dataType)
        if (has_token(c, ID_HINTS) and exact >= 0.9 * rows) or (whole and exact >= 0.99 * rows):
            notes.append(f"{c} looks like an identifier; exclude it unless it is a measurement.")
    # Columns are centred, and scaled by their largest magnitude so that products can't overflow.
    mean = np.array([got[f"m{place[c]}"] for c in usable])
    size = np.array([max(abs(got[f"a{place[c]}"]), abs(got[f"b{place[c]}"])) or 1.0 for c in usable])
    scale = size if standardize else np.full(len(usable), size.max())
    z = [F.coalesce(x[c] / F.lit(float(s)) - F.lit(float(m / s)), F.lit(0.0)) for c, m, s in zip(usable, mean, scale, strict=True)]
    cov = _covariance(df, z)
    std = np.sqrt(np.diag(cov))
    safe = np.where(std > 0, std, 1.0)
    corr = np.clip(cov / np.outer(safe, safe), -1, 1)
    np.fill_diagonal(corr, 1.0)
    values, vectors = np.linalg.eigh(corr if standardize else cov)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
    total = values.sum()
    if not total > 0:
        return ReductionResult(df, source_columns=usable, standardized=standardize, dropped_columns=dropped, notes=[*notes, "The columns have no variance to keep."])
    ratio = values / total
    cumulative = np.minimum(np.cumsum(ratio), 1.0)
    most = min(len(usable), rows)
    k = min(int(n_components), most) if n_components is not None else min(int(np.searchsorted(cumulative, variance_ratio)) + 1, most)
    if n_components is not None and n_components > most:
        notes.append(f"{n_components} components asked for; there are {most}.")
    loadings = vectors[:k].copy()
    for row in loadings:
        lead = int(np.flatnonzero(np.abs(row) >= np.abs(row).max() - 1e-9)[0])
        if row[lead] < 0:
            row *= -1
    names = [f"{prefix}{i + 1}" for i in range(k)]
    clash = set(names) & (set(df.columns) - set(usable))
    if clash:
        raise ValueError(f"columns already exist: {', '.join(sorted(clash))}; choose another prefix")
    unit = [zi / F.lit(float(s)) for zi, s in zip(z, safe, strict=True)] if standardize else [zi * F.lit(float(s)) for zi, s in zip(z, scale, strict=True)]
    scores = [sum((u * F.lit(float(w)) for u, w in zip(unit, row, strict=True)), F.lit(0.0)).alias(n) for n, row in zip(names, loadings, strict=True)]
    out, put = [], False
    for c in df.columns:
        if c not in usable:
            out.append(column(c))
        elif not put:
            out, put = [*out, *scores], True
    return ReductionResult(
        df.select(*out), k, usable, names, ratio[:k].tolist(), cumulative[:k].tolist(), float(cumulative[k - 1]), standardize, loadings, corr, correlated_groups(usable, corr, group_threshold), dropped, notes
    )
