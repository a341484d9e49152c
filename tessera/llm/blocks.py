"""Exact links inside candidate components: members are dealt into blocks, and each pair of blocks is one group.

A component's blocks hold BLOCK sets or BLOCK_TOKENS tokens, whichever is
reached first, so no task holds a whole component, and what leaves a group is
one row for each of its sets, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrowtext import hashes_of, mix
from tessera.llm.shared import bounded, sorted_groups

#: Sets and tokens of a block, and columns of the dense slices that are multiplied.
BLOCK = 256
BLOCK_TOKENS = 1 << 19
COLUMNS = 2048
#: Groups of so many sets at most have their pairs compared all together, and tokens that are sorted at once for that.
SMALL = 6
SMALL_TOKENS = 1 << 16

LINKS = T.StructType([T.StructField("key", T.LongType()), T.StructField("to", T.LongType()), T.StructField("links", T.LongType())])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of arrays of distinct values, from products of dense slices."""
    m = len(sets)
    if m == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    out = np.zeros((m, m))
    values, who = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    if not len(values):
        return out.astype(np.int64)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, who = column[shared], who[shared]
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        column, who = column[order], who[order]
        for low in range(0, int(column[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            dense = np.zeros((m, COLUMNS), np.float32)
            dense[who[a:b], column[a:b] - low] = 1
            out += dense @ dense.T
    out = out.astype(np.int64)
    out[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    return out


def shared_tokens(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a and b, pair by pair: what stands twice among a pair's tokens."""
    out, size = np.zeros(len(a), np.int64), np.array([len(x) for x in sets], np.int64)
    before = np.cumsum(size[a] + size[b])
    low = 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(before, (before[low - 1] if low else 0) + SMALL_TOKENS, "right")))
        x, y = a[low:high], b[low:high]
        values = np.concatenate([sets[i] for i in np.concatenate([x, y])]).view(np.uint64)
        pair = np.repeat(np.tile(np.arange(high - low), 2), size[np.concatenate([x, y])])
        key = values ^ mix(pair.astype(np.uint64))
        order = np.argsort(key)
        key, pair = key[order], pair[order]
        out[low:high] = np.bincount(pair[1:][(key[1:] == key[:-1]) & (pair[1:] == pair[:-1])], minlength=high - low)
        low = high
    return out


def roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component under the links a-b."""
    up = list(range(m))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return np.array([top(x) for x in range(m)], np.int64)


def in_blocks(members: DataFrame) -> DataFrame:
    """members (root, key, n, ...) with columns i, j and side: one row for each pair of blocks that its block takes part in.

    n: tokens of the set.  Blocks are dealt by a hash of the key.
    """
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("m"), F.count(F.lit(1)).alias("many"))
    sizes = sizes.where("m > 1").select("root", F.least("m", "many").cast("int").alias("m"))
    dealt = members.join(bounded(sizes), "root", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("key"), "m").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return dealt.select(*members.columns, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("side"))


def links(members: DataFrame, percent: int, prefixes: bool = False, sets: bool = True) -> DataFrame:
    """(key, to, links) of each set in each group of ``in_blocks``.

    members: root, i, j, side, key, copies, n, and, if ``sets``, tokens (64-bit
    values in binary); if ``prefixes``, level and prefix (array of bigint).
    Two sets link if 100 * intersection >= percent * union; with prefixes, only
    pairs that share as many prefix tokens as the lower of their levels are
    verified at all, and without ``sets`` those are the links.  ``to`` is the
    least key that the group's links lead to, ``links`` the copies of all
    linked sets.
    """

    def make() -> Callable[[pa.Table], list[pa.RecordBatch]]:
        return lambda table: _links(table, percent, prefixes, sets)

    return sorted_groups(members, ["root", "i", "j"], make, LINKS, order=["key"])


def _links(table: pa.Table, percent: int, prefixes: bool, sets: bool) -> list[pa.RecordBatch]:
    get = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    root, i, j, side, key, copies, n = (get(c) for c in ("root", "i", "j", "side", "key", "copies", "n"))
    tokens = hashes_of(table.column("tokens")) if sets else None
    if prefixes:
        level, lists = get("level"), table.column("prefix").combine_chunks()
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        prefix = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    new = np.ones(len(root), bool)
    new[1:] = (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (key[1:] != key[:-1])
    row = np.flatnonzero(new)  # repeated members count once
    same = np.ones(len(row), bool)
    same[1:] = (root[row[1:]] != root[row[:-1]]) | (i[row[1:]] != i[row[:-1]]) | (j[row[1:]] != j[row[:-1]])
    starts = np.append(np.flatnonzero(same), len(row))
    out_key, out_to, out_links = [], [], []
    begins, ends = starts[:-1], starts[1:]
    if sets and not prefixes and SMALL > 1:
        many = ends - begins
        small = [(begins[many == m], *np.triu_indices(m, 1)) for m in range(2, SMALL + 1)]
        x, y = (np.concatenate([(at[:, None] + pair[side_]).reshape(-1) for at, *pair in small]) for side_ in (0, 1))
        u, v = row[x], row[y]
        ok = (100 * np.minimum(n[u], n[v]) >= percent * np.maximum(n[u], n[v])) & ((i[u] == j[u]) | (side[u] != side[v]))
        x, y, u, v = x[ok], y[ok], u[ok], v[ok]
        ok = (100 + percent) * shared_tokens(tokens, u, v) >= percent * (n[u] + n[v])
        x, y, u, v = x[ok], y[ok], u[ok], v[ok]
        if len(x):
            linked = (np.bincount(x, copies[v], minlength=len(row)) + np.bincount(y, copies[u], minlength=len(row))).astype(np.int64)
            to = key[row][roots(len(row), x, y)]
            some = linked > 0
            out_key.append(key[row][some]), out_to.append(to[some]), out_links.append(linked[some])
        begins, ends = begins[many > SMALL], ends[many > SMALL]
    for a, b in zip(begins, ends, strict=True):
        r = row[a:b]
        if len(r) < 2:
            continue
        size = n[r]
        ok = np.triu(np.ones((len(r), len(r)), bool), 1) & (100 * np.minimum.outer(size, size) >= percent * np.maximum.outer(size, size))
        if i[r[0]] != j[r[0]]:
            ok &= side[r][:, None] != side[r][None, :]
        if prefixes:
            ok &= overlaps([prefix[x] for x in r]) >= np.minimum.outer(level[r], level[r])
        use = np.flatnonzero(ok.any(0) | ok.any(1))
        if len(use) < 2:
            continue
        ok = ok[np.ix_(use, use)]
        if sets:
            ok &= (100 + percent) * overlaps([tokens[x] for x in r[use]]) >= percent * np.add.outer(size[use], size[use])
        x, y = np.nonzero(ok)
        if len(x):
            k, c = key[r][use], copies[r][use]
            many = np.bincount(x, c[y], minlength=len(use)) + np.bincount(y, c[x], minlength=len(use))
            to = k[roots(len(use), x, y)]
            some = many > 0
            out_key.append(k[some]), out_to.append(to[some]), out_links.append(many[some].astype(np.int64))
    if not out_key:
        return []
    return [pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (out_key, out_to, out_links)], names=LINKS.fieldNames())]
