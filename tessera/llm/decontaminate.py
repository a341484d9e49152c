"""Benchmark decontamination: SimHashes of item-sized windows, a multi-index of Hamming blocks, exact verification."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import SEPARATORS, bounded, materialize

#: Bits of a fingerprint, in two longs, and those in which a window and an item may differ.  At a similarity of 0.8 they differ in 19.4 +- 4.1.
BITS, RADIUS = 128, 31
#: Blocks of a fingerprint; within the radius, some block differs in RADIUS // BLOCKS bits at most.
BLOCKS, BLOCK_BITS = 16, 8


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), SEPARATORS), "")


def _shingles(words: str, k: int) -> str:
    """SQL for the hashes of all shingles of k words."""
    hashed = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return f"if(size({words}) >= {k}, transform(sequence(0, size({words}) - {k}), i -> xxhash64({hashed})), cast(array() as array<bigint>))"


def _simhash(shingles: str) -> str:
    """SQL for the 64-bit fingerprint: a bit is set where most shingles, each as often as it stands, have it.

    Bit b is counted in 16 bits of the long b % 16, so one step for a shingle
    counts all bits; arrays that could overflow that are counted bit by bit.
    """
    lanes = ", ".join(f"a[{j}] + (shiftrightunsigned(x, {j}) & {0x0001000100010001}L)" for j in range(16))
    counts = f"aggregate({shingles}, array_repeat(0L, 16), (a, x) -> array({lanes}))"
    bits = "aggregate(sequence(0, 63), 0L, (f, b) -> if(2 * ({count}) > size(" + shingles + "), f | shiftleft(1L, b), f))"
    fast = bits.format(count="shiftrightunsigned(c[b % 16], 16 * (b div 16)) & 65535")
    slow = bits.format(count=f"aggregate({shingles}, 0, (n, x) -> n + cast(shiftrightunsigned(x, b) & 1 as int))")
    return f"if(size({shingles}) < 65536, transform(array({counts}), c -> {fast})[0], {slow})"


def _prints(shingles: str) -> str:
    """SQL for the fingerprint: two longs, the second of shingles hashed again."""
    return f"array({_simhash(shingles)}, {_simhash(f'transform({shingles}, y -> xxhash64(y))')})"


def _block(prints: str) -> str:
    """SQL for block b of a fingerprint."""
    return f"cast(shiftrightunsigned({prints}[b div {BLOCKS // 2}], {BLOCK_BITS} * (b % {BLOCKS // 2})) & {(1 << BLOCK_BITS) - 1} as int)"


def _multiset(shingles: str) -> str:
    """SQL for distinct hashes that tell the n-th equal shingle apart; an array without equal ones stays as it is."""
    numbered = f"transform(array(array_sort({shingles})), o -> transform(o, (x, i) -> xxhash64(x, i - array_position(o, x))))[0]"
    return f"if(size(array_distinct({shingles})) = size({shingles}), transform({shingles}, x -> xxhash64(x, -1L)), {numbered})"


def contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", *, k: int = 5, percent: int = 80) -> DataFrame:
    """(id, item, start_word, n_words, similarity) of the best window of each text for each item that it holds.

    A window has as many words as the item (all words of a shorter text); its
    similarity is the weighted Jaccard of the shingles of k words of both, each
    weighing as often as it stands (lower-cased; an item with fewer words is
    one shingle).  Pairs with ``percent`` or more are returned; of equal windows the
    first one.

    Windows of an item's length start where a text has some shingle of an item
    of that length: a window without any has similarity 0, and moving a window's start
    to the next such place loses none.  Each window's SimHash looks its blocks
    up among the items' blocks, filed under all values within RADIUS // BLOCKS
    bits; that finds all fingerprints within RADIUS, and only those are verified
    exactly.

    Null and empty texts and items hold nothing.  Rows with the same id and
    text are one, and a null id is an id; items with the same id are told apart by their words, and the
    best is returned.  Other columns are not read.  Empty tables give an empty result.  Item tables are
    broadcast up to a checked size and shuffled beyond it.  Of a long text only
    shingle hashes and windows are held, never the text beside each window.
    """
    least = items.select(F.col(f"`{item}`").alias("item"), _words(item_text).alias("w")).where("size(w) > 0").distinct()
    least = least.withColumn("k", F.least(F.lit(k), F.size("w")))
    shingled = F.expr("case k " + " ".join(f"when {j} then {_shingles('w', j)}" for j in range(1, k + 1)) + " end")
    table = least.select("item", F.size("w").alias("n"), "k", shingled.alias("g"))
    table = materialize(table.select("item", "n", "k", F.explode(F.array("g")).alias("g")).select("*", F.expr(_prints("g")).alias("fp"), F.expr(_multiset("g")).alias("set")), "items", few=True)
    sizes = sorted(r.k for r in table.select("k").distinct().collect()) or [k]  # at most k rows
    vocabulary = table.select("n", "k", F.explode("g").alias("h")).distinct()
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("t"))
    per_k = lambda w: F.array(*[F.struct(F.lit(j).alias("k"), F.expr(_shingles(w, j)).alias("g")) for j in sizes])
    places = rows.select("id", "t", _words("text").alias("w")).select("id", "t", F.size("w").alias("m"), F.explode(per_k("w")).alias("s")).select("id", "t", "m", "s.k", F.posexplode("s.g").alias("p", "h"))
    hits = places.join(bounded(materialize(vocabulary, "item-shingles", few=True)), ["k", "h"])
    starts = hits.groupBy("id", "t", "n", "k").agg(F.collect_set(F.expr("greatest(0, least(p, m - n))")).alias("s"))
    starts = materialize(starts.groupBy("id", "t").agg(F.collect_list(F.struct("n", "k", "s")).alias("starts")), "window-starts", few=True)
    texts = rows.join(bounded(starts.select(F.col("id").alias("i2"), F.col("t").alias("t2"), "starts"), 50_000), F.col("id").eqNullSafe(F.col("i2")) & (F.col("t") == F.col("t2"))).dropDuplicates(["id", "t"])
    texts = texts.select("id", "t", "starts", _words("text").alias("w")).select("id", "t", "starts", F.size("w").alias("m"), F.explode(F.array(per_k("w"))).alias("by_k"))
    texts = texts.select("id", "t", "m", "by_k", F.explode("starts").alias("x")).select("id", "t", "m", "x.n", "x.k", "x.s", F.expr("filter(by_k, y -> y.k = x.k)[0].g").alias("g"))
    windows = texts.select("id", "t", "n", F.expr("least(n, m)").alias("length"), F.explode(F.expr("transform(s, i -> struct(i as s, slice(g, i + 1, least(n, m) - k + 1) as g))")).alias("x")).select("id", "t", "n", "length", "x.s", "x.g")
    windows = materialize(windows.where("size(g) > 0").select("*", F.expr(_prints("g")).alias("fp")), "window-prints", few=True)
    masks = [0, *(sum(1 << b for b in c) for r in range(1, RADIUS // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), r))]
    every = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("b")
    index = table.select("item", "n", F.col("set").alias("set2"), F.col("fp").alias("fp2"), "fp", every)
    index = index.select("item", "n", "set2", "fp2", "b", F.explode(F.expr(f"transform(array({', '.join(map(str, masks))}), x -> {_block('fp')} ^ x)")).alias("v"))
    looked = windows.select("*", every).withColumn("v", F.expr(_block("fp"))).join(bounded(index), ["n", "b", "v"])
    near = "aggregate(sequence(0, b - 1), true, (a, b) -> a and bit_count(" + _block("fp") + " ^ " + _block("fp2") + f") > {RADIUS // BLOCKS})"
    looked = looked.where(f"bit_count(fp[0] ^ fp2[0]) + bit_count(fp[1] ^ fp2[1]) <= {RADIUS}").where(f"b = 0 or {near}")  # each pair once: at the first block that is near
    both = looked.select("id", "item", F.col("s").cast("bigint").alias("start_word"), F.col("length").cast("bigint").alias("n_words"), F.explode(F.array(F.expr(f"size(array_intersect({_multiset('g')}, set2))"))).alias("o"), F.expr("size(g) + size(set2)").alias("sum"))  # exploded, so that it is computed once
    good = both.where(100 * F.col("o") >= percent * (F.col("sum") - F.col("o"))).withColumn("similarity", F.round(F.col("o") / (F.col("sum") - F.col("o")), 6))
    best = good.groupBy("id", "item").agg(F.min_by(F.struct("start_word", "n_words", "similarity"), F.struct(-F.col("similarity"), "start_word", "n_words")).alias("x"))
    return best.select(F.col("id").alias(id), F.col("item").alias(item), "x.*")


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items held by any document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as w from documents),
b as (select distinct item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as w from benchmark),
i as (select item_id, w, len(w) as n, least(5, len(w)) as k from b where len(w) > 0),
ig as (select item_id, n, k, n - k + 1 as total, unnest(list_transform(range(1, n - k + 2), lambda x: array_to_string(w[x : x + k - 1], ' '))) as g from i),
ic as (select item_id, n, k, total, g, count(*) as c from ig group by all),
dg as (select doc_id, k, len(w) as m, unnest(range(0, len(w) - k + 1)) as p, unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x : x + k - 1], ' '))) as g from d, (select distinct k from i) where len(w) >= k),
hit as (select distinct doc_id, item_id, m, n, k, total, p from dg join ic using (k, g)),
few as (select doc_id, item_id from hit group by doc_id, item_id, total having 100 * count(*) >= 80 * total),
s as (select distinct doc_id, item_id, m, n, k, total, greatest(0, least(p, m - n)) as s from hit join few using (doc_id, item_id)),
wc as (select s.doc_id, s.item_id, s.m, s.n, s.total, s.s, dg.g, count(*) as c from s join dg on s.doc_id = dg.doc_id and s.k = dg.k and dg.p between s.s and s.s + least(s.n, s.m) - s.k group by all),
o as (select wc.doc_id, wc.item_id, wc.s, wc.m, wc.n, wc.total + sum(wc.c) as both_sizes, sum(least(wc.c, coalesce(ic.c, 0))) as o from wc left join ic on wc.item_id = ic.item_id and wc.g = ic.g group by wc.doc_id, wc.item_id, wc.s, wc.m, wc.n, wc.total),
ok as (select *, round(o::double / (both_sizes - o)::double, 6) as similarity from o where 100 * o >= 80 * (both_sizes - o))
select doc_id, item_id, s::bigint as start_word, least(n, m)::bigint as n_words, similarity from ok qualify row_number() over (partition by doc_id, item_id order by similarity desc, s) = 1
"""
