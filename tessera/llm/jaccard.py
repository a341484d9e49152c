"""n-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import blocks
from tessera.llm.arrowtext import pieces, set_key, word_sets
from tessera.llm.shared import bounded, components, discard, map_arrow, materialize, sorted_groups

#: Share of the hash space whose tokens are counted exactly (see ``prefix_tokens``).
COUNTED = 4
#: Prefix levels that a document may choose from.
LEVELS = 3
#: A token's count is told apart up to this many documents.
MOST = 1000
#: Tokens in more than one of so many documents of a slice are looked at as frequent.
FREQUENT = 50
#: Tokens that a task holds before it passes them on.
EMITTED = 100_000
#: Postings of up to so many sets have their pairs counted; larger ones are spanned by forests.
SMALL = 16
#: Sets of a block of a larger posting.
POSTINGS = 1000

SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.LongType()), T.StructField("token", T.LongType()), T.StructField("many", T.LongType())])
TOKENS = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "n", "counted")] + [T.StructField("tokens", T.ArrayType(T.LongType()))])
SHARED = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "n", "counted", "rank", "token", "df")])
PREFIX = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("level", T.LongType()), T.StructField("token", T.ArrayType(T.LongType())), T.StructField("at", T.ArrayType(T.LongType())), T.StructField("df", T.ArrayType(T.LongType()))])
EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
TEXTS = T.StructType([T.StructField("key", T.LongType()), T.StructField("tokens", T.BinaryType())])


def _need(n, percent: int):
    """Overlap that a set of n tokens has with any set it links to, at least."""
    return -(-percent * n // 100)


def document_sets(docs: DataFrame, id: str, text: str, k: int) -> DataFrame:
    """(id, n, key) of each row's set, and (token, many) of tokens that are frequent in some slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b)):
            n, key = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            all_tokens = []
            for i, tokens in word_sets(batch.column(1), k):
                n[i], key[i] = len(tokens), set_key(tokens)
                all_tokens.append(tokens[: np.searchsorted(tokens, np.uint64((1 << 64) // COUNTED))])
            none = lambda m: pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(key), none(len(n)), none(len(n))], names=SETS.fieldNames())
            if all_tokens:
                token, many = np.unique(np.concatenate(all_tokens), return_counts=True)
                often = many >= max(16, batch.num_rows // FREQUENT)
                token, many = token[often].view(np.int64), many[often].astype(np.int64)
                yield pa.RecordBatch.from_arrays([none(len(token)), none(len(token)), none(len(token)), pa.array(token), pa.array(many)], names=SETS.fieldNames())

    return map_arrow(docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")), run, SETS)


def prefix_tokens(docs: DataFrame, text: str, k: int, percent: int, frequent: list[int]) -> DataFrame:
    """(key, n, level, token[], at[], df[]): the prefix of each distinct set, without what no other set has.

    The order of tokens: first those whose hash is in the lowest quarter of the
    hash space and that aren't frequent, by document frequency (counted exactly
    up to ``MOST``; ties by hash), then all others by hash.  Any total order
    gives the same links; rare tokens first leave most sets with a prefix of
    tokens of their own, and such a set is dropped here.

    A set's level, 1 to ``LEVELS`` and at most the overlap that a link needs, is
    the one of least estimated cost: reading the postings of its prefix plus
    verifying the candidates that share as many tokens as the level.  A prefix
    of level l is l - 1 tokens longer, and two linked sets share at least the
    lower of their levels in tokens of their prefixes.
    """
    limit = np.uint64((1 << 64) // COUNTED)
    sc = docs.sparkSession.sparkContext
    often = sc.broadcast(np.array(sorted(np.array(frequent, np.int64).view(np.uint64)), np.uint64))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = often.value
        for batch in batches:
            seen, rows, size = set(), [], 0
            for tokens in (t for piece in pieces(batch) for _, t in word_sets(piece.column(0), k)):
                if size > EMITTED:
                    yield _rows(rows)
                    rows, size = [], 0
                n = len(tokens)
                if not n or (key := set_key(tokens)) in seen:
                    continue
                seen.add(key)
                low = tokens[: np.searchsorted(tokens, limit)]
                is_hot = np.isin(low, hot, assume_unique=True) if len(hot) else np.zeros(len(low), bool)
                counted, length = low[~is_hot], n - int(_need(n, percent)) + LEVELS
                more = np.zeros(0, np.uint64)
                if (m := min(length, n) - len(counted)) > 0:
                    more = np.concatenate([low[is_hot], tokens[len(low) :][:m]])[:m]
                rows.append((key, n, len(counted), np.concatenate([counted, more]).view(np.int64)))
                size += len(rows[-1][3])
            if rows:
                yield _rows(rows)

    emitted = map_arrow(docs.select(F.col(f"`{text}`").alias("text")), emit, TOKENS).select("key", "n", "counted", F.posexplode("tokens").alias("at", "token"))
    emitted = emitted.select("token", "key", "n", "counted", F.when(F.col("at") < F.col("counted"), -1).otherwise(F.col("at") - F.col("counted")).cast("bigint").alias("rank"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams rows sorted by token and key; at most MOST rows of a token are held."""
        held, past, last = None, None, None
        for batch in batches:
            c = [batch.column(x).to_numpy() for x in range(5)]
            if not len(c[0]):
                continue
            if held is not None:
                c = [np.concatenate([h, x]) for h, x in zip(held, c, strict=True)]
            new = np.ones(len(c[0]), bool)
            new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
            if last is not None and held is None:
                new[0] = (c[0][0], c[1][0]) != last
            c = [x[new] for x in c]
            last = (batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py())
            held = None
            if not len(c[0]):
                continue
            begin = np.flatnonzero(np.append(True, c[0][1:] != c[0][:-1]))
            size = np.diff(np.append(begin, len(c[0])))
            df = np.repeat(np.minimum(size, MOST), size)
            if past is not None and c[0][0] == past:
                df[: size[0]] = MOST
            cut = len(df)
            if df[-1] < MOST:
                cut = int(begin[-1])
                held = [x[cut:] for x in c]
            past = int(c[0][-1]) if cut == len(df) else None
            yield _shared([x[:cut] for x in c], df[:cut])
        if held is not None:
            yield _shared(held, np.full(len(held[0]), len(held[0])))

    counted = map_arrow(emitted.repartition("token").sortWithinPartitions("token", "key"), count, SHARED)

    def make() -> Callable[[pa.Table], list[pa.RecordBatch]]:
        return lambda table: _choose(table, percent)

    return sorted_groups(counted, ["key"], make, PREFIX)


def _rows(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    key, n, counted, tokens = zip(*rows, strict=True)
    ends = pa.array(np.append(0, np.cumsum([len(t) for t in tokens])).astype(np.int32))
    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tokens)))
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key, n, counted)), lists], names=TOKENS.fieldNames())


def _shared(c: list[np.ndarray], df: np.ndarray) -> pa.RecordBatch:
    token, key, n, counted, rank = (x[df > 1] for x in c)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, n, counted, rank, token, df[df > 1])], names=SHARED.fieldNames())


def _choose(table: pa.Table, percent: int) -> list[pa.RecordBatch]:
    key, n, counted, rank, token, df = (table.column(c).combine_chunks().to_numpy() for c in SHARED.fieldNames())
    order = np.lexsort((token.view(np.uint64), np.where(rank < 0, df, 0), rank, key))
    key, n, counted, rank, token, df = (x[order] for x in (key, n, counted, rank, token, df))
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, len(key)))
    group = np.repeat(np.arange(len(begin)), size)
    mine = np.bincount(group, rank < 0, minlength=len(begin)).astype(np.int64)  # counted tokens that are shared
    at = np.where(rank < 0, (counted - mine[group]) + (np.arange(len(key)) - begin[group]), counted + rank)
    length = n - _need(n, percent) + 1
    best, level = np.full(len(begin), np.inf), np.ones(len(begin), np.int64)
    for l in range(1, LEVELS + 1):
        inside = at < length + l - 1
        cost = np.bincount(group, df * inside, minlength=len(begin)) + n[begin] * np.bincount(group, (df - 1) * inside, minlength=len(begin)) / l
        better = (cost < best) & (l <= np.maximum(1, _need(n[begin], percent)))
        best[better], level[better] = cost[better], l
    keep = at < length + level[group] - 1
    group, at, token, df = group[keep], at[keep], token[keep], df[keep]
    size = np.bincount(group, minlength=len(begin))
    some = size > 0
    if not some.any():
        return []
    offsets = pa.array(np.append(0, np.cumsum(size[some])).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (token, at, df)]
    return [pa.RecordBatch.from_arrays([pa.array(key[begin][some]), pa.array(n[begin][some]), pa.array(level[some]), *lists], names=PREFIX.fieldNames())]


def _candidates(table: pa.Table, percent: int) -> list[pa.RecordBatch]:
    """Edges of a forest that spans the candidate pairs of each posting block."""
    token, i, j, side, key, n, level, at = (table.column(c).combine_chunks().to_numpy() for c in ("token", "i", "j", "side", "key", "n", "level", "at"))
    begin = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    size = np.diff(np.append(begin, len(token)))
    begin, size = begin[size > 1], size[size > 1]
    found = []
    step = max(1, 500_000 // (int(size.max()) ** 2 or 1)) if len(size) else 1
    for g in range(0, len(size), step):
        b, s = begin[g : g + step], size[g : g + step]
        rows = np.repeat(np.arange(len(b)), s)
        first = np.arange(len(rows)) - np.repeat(np.cumsum(s) - s, s)
        n_later = s[rows] - first - 1
        x = np.repeat(b[rows] + first, n_later)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n_later) - n_later, n_later)
        ok = (key[x] != key[y]) & ((i[x] == j[x]) | (side[x] != side[y]))
        ok &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        x, y = x[ok], y[ok]
        need = -(-percent * (n[x] + n[y]) // (100 + percent))
        ok = np.minimum(n[x] - at[x], n[y] - at[y]) > need - np.minimum(level[x], level[y])
        pairs = np.stack([np.minimum(key[x[ok]], key[y[ok]]), np.maximum(key[x[ok]], key[y[ok]])], 1)
        if len(pairs):
            found.append(_forest(pairs))
    if not found:
        return []
    pairs = _forest(np.concatenate(found))
    return [pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c])) for c in (0, 1)], names=["a", "b"])]


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Stars that join the same nodes as the pairs do."""
    nodes, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(pairs.shape)
    up = blocks.roots(len(nodes), at[:, 0], at[:, 1])
    child = np.flatnonzero(up != np.arange(len(nodes)))
    return np.stack([nodes[child], nodes[up[child]]], 1)


def candidate_edges(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets that may link.

    Pairs are counted token by token in postings of up to ``SMALL`` sets, and
    those that share as many tokens as the lower of their levels are edges: so
    many rows at most go out for each row of a posting.  In larger postings one
    token is enough; each is spanned by a forest, so its pairs don't leave the
    task, and ``refined`` counts what they share.  A pair whose shared tokens are
    few in small postings has one in a large one.  In either kind a token counts
    only if it leaves enough tokens behind it, in both sets, for the overlap
    that linking needs when level - 1 tokens are shared before it.  Postings of
    more than ``POSTINGS`` sets are dealt into pairs of blocks.
    """
    rows = prefixes.select("key", "n", "level", F.explode(F.arrays_zip("token", "at", "df")).alias("p")).select("key", "n", "level", "p.token", "p.at", "p.df")
    lists = rows.where(F.col("df") <= SMALL).groupBy("token").agg(F.collect_list(F.struct("key", "n", "level", "at")).alias("l")).where("size(l) > 1")
    pairs = lists.select(F.expr("inline(flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x, y)))))")).where(f"""
        x.key <> y.key and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
        and least(x.n - x.at, y.n - y.at) > ({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent} - least(x.level, y.level)""")
    pairs = pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"), F.least("x.level", "y.level").alias("level"))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("level").alias("level")).where("shared >= level").select("a", "b")
    rows = rows.where(F.col("df") > SMALL)
    large = rows.where(F.col("df") >= MOST).groupBy("token").agg(F.ceil(F.count(F.lit(1)) / POSTINGS).cast("int").alias("m")).where("m > 1")
    rows = rows.join(bounded(large), "token", "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("key"), "m").cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("token", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("side"), "key", "n", "level", "at")

    def make() -> Callable[[pa.Table], list[pa.RecordBatch]]:
        return lambda table: _candidates(table, percent)

    return sorted_groups(rows, ["token", "i", "j"], make, EDGES).unionAll(pairs)


def refined(members: DataFrame, percent: int) -> DataFrame:
    """members with the components of more than a block parted into those of pairs that share enough prefix tokens.

    Only prefixes are dealt into blocks here; sets that no pair needs drop out.
    """
    large = members.groupBy("root").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > blocks.BLOCK).select("root")
    large = bounded(materialize(large, "jaccard-large", 1))
    group = blocks.in_blocks(members.join(large, "root", "left_semi").select("root", "key", "copies", F.size("prefix").cast("bigint").alias("weight"), F.col("n").alias("size"), "level", "prefix").withColumnRenamed("weight", "n"))
    found = blocks.links(group.drop("n").withColumnRenamed("size", "n"), percent, prefixes=True, sets=False)
    parts = materialize(components(found.select(F.col("key").alias("a"), F.col("to").alias("b")), "jaccard-refined"), "jaccard-parted", few=True)
    rest = members.join(large, "root", "left_anti")
    return rest.unionByName(members.drop("root").join(parts.withColumnRenamed("node", "key"), "key").select(*members.columns))


def tokens_of(docs: DataFrame, text: str, k: int) -> DataFrame:
    """(key, tokens) of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b)):
            key, data, size = [], [], 0
            for _, tokens in word_sets(batch.column(0), k):
                key.append(set_key(tokens))
                data.append(tokens.tobytes())
                size += len(data[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(data, pa.binary())], names=TEXTS.fieldNames())
                    key, data, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(data, pa.binary())], names=TEXTS.fieldNames())

    return map_arrow(docs.select(F.col(f"`{text}`").alias("text")), run, TEXTS)


def jaccard_join(docs: DataFrame, id: str = "doc_id", text: str = "text", *, k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: (id, n_shingles, component_id, n_links).

    A text's set is its distinct shingles of k words (A-Z lower-cased; fewer
    words are one shingle; without words the set is empty).  Two rows link if
    100 * intersection >= percent * union of their sets.  ``component_id`` is
    the least id that links lead to, its own included; ``n_links`` the number of other rows
    that the row links with.  An empty set links with nothing, and its
    component is its own id.  A null id counts as greater than all; repeated
    rows link as any copies do; an empty table gives an empty one.

    Copies are collapsed first: sets are known by a 64-bit hash of all their
    tokens and by their size.  Prefixes (``prefix_tokens``) meet in postings
    and pairs that share as many tokens as their levels ask for become
    candidates (``candidate_edges``, ``refined``); components of candidates are
    dealt into blocks in which such pairs are verified on whole sets
    (``blocks.links``).  Texts are read three times rather than kept: what is
    shuffled is a quarter of the tokens, once, and the sets in candidate
    components.
    """
    # By few tasks: processes that set the modes of new files share the executor's memory until they run.
    files = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    sets = materialize(document_sets(docs, id, text, k), "jaccard-sets", files)
    rows = sets.where("n is not null").select("id", "n", "key")
    # Tokens in over a fiftieth of all documents: at most fifty times the mean set size of them.
    total = rows.where("n > 0").count()
    often = sets.where("token is not null").groupBy("token").agg(F.sum("many").alias("many")).where(F.col("many") >= total // FREQUENT)
    prefixes = materialize(prefix_tokens(docs, text, k, percent, [r.token for r in often.select("token").collect()]), "jaccard-prefixes", few=True)
    keys = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    parts = components(candidate_edges(prefixes, percent), "jaccard-candidates")
    members = parts.withColumnRenamed("node", "key").join(prefixes.select("key", "n", "level", F.col("token").alias("prefix")), "key").join(keys, "key")
    whole = materialize(members, "jaccard-members", few=True)
    members = materialize(refined(whole, percent), "jaccard-refined-members", few=True)
    discard(prefixes, whole)
    wanted = members.select(F.col("least").alias("__id")).distinct()
    chosen = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")).join(bounded(wanted, 1_000_000), F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    tokens = tokens_of(chosen, "text", k).join(bounded(members.select("key").distinct(), 1_000_000), "key", "left_semi").dropDuplicates(["key"])
    group = blocks.in_blocks(members.select("root", "key", "copies", "n", "level", "prefix")).join(tokens, "key")
    found = materialize(blocks.links(group, percent, prefixes=True), "jaccard-links", few=True)
    final = components(found.select(F.col("key").alias("a"), F.col("to").alias("b")), "jaccard-final")
    final = final.join(keys, F.col("node") == F.col("key")).select("node", "root", "least")
    least = final.groupBy("root").agg(F.min("least").alias("component"))
    n_links = found.groupBy("key").agg(F.sum("links").alias("links"))
    classes = final.join(least, "root").select(F.col("node").alias("key"), "component").join(n_links, "key")
    classes = keys.join(classes, "key", "left").where("copies > 1 or component is not null").select("key", "copies", F.coalesce("component", "least").alias("component"), "links")
    # Written, so that a set with very many copies meets a plain table that Spark can split or broadcast.
    classes = materialize(classes, "jaccard-classes", few=True)
    discard(members, found)
    joined = rows.join(bounded(classes), "key", "left")
    return joined.select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
    )


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and links, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join(docs, k=3, percent=90)


OP5_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 90 * (x.n + y.n - c)),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(doc_id, (select min(b) from r where r.a = doc_id))::bigint as component_id,
  (select count(*) from l where l.a = doc_id)::bigint as n_links from d left join n using (doc_id)
"""
