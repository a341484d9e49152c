"""Mixing sources to target weights: exact block quotas, split over shards by a multivariate-hypergeometric tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import RANKED, SEPARATORS, bounded, discard, materialize, numbered

#: Weights of the sources in order, repeating (fixed values of the contract).
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    t = F.coalesce(text, F.lit(""))
    edge = lambda c: F.when(c.rlike(r"[\x20\x09-\x0D]"), 1).otherwise(0)
    n = F.size(F.split(t, SEPARATORS)) - edge(F.substring(t, 1, 1)) - edge(F.substring(t, -1, 1))
    return F.when(t == "", 0).otherwise(n).cast("bigint")


def targets(sources: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """sources (name, s, weight) with ``target``: by weight up to ``most`` times s, what is over shared anew by weight.

    A round finds the words a unit of weight gets from the sources that aren't
    full yet, and which of those it fills; each round is one sum over the table.
    """
    total = sources.agg(F.sum("s")).first()[0] or 0
    level, many = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("s") * most
        r = sources.agg(F.coalesce(F.sum(F.when(full, F.col("s") * most)), F.lit(0)).alias("full"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("left"), F.sum(full.cast("bigint")).alias("many")).first()
        if r.many == many or not r.left:
            break
        level, many = (share * total - r.full) / r.left, r.many
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    given = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(given > F.col("s") * most, (F.col("s") * most).cast("double")).otherwise(given))


def split_tree(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """(name, shard, many): how many block draws of each source each shard takes.

    draws: name, idx; one row a block draw.  A node of the tree halves its
    shards and gives the left half a fair share of its draws, any of them alike:
    those of least hash, with a salt of its own.  A source's draws on the left
    are then multivariate hypergeometric, and shards' totals differ by one at
    most.  A level is a written table; ranks within a node are counted by the
    first digits of the hash, so no task ranks a whole node.
    """
    rows = draws.count()
    files = 1 + rows // RANKED
    state = materialize(draws.select("name", "idx", F.lit(0).alias("first"), F.lit(shards).alias("n")), "mix-tree", files)
    while state.where("n > 1").limit(1).count():
        hashed = state.withColumn("h", F.md5(F.concat_ws("|", F.lit(f"{seed}|tree"), "first", "n", "name", "idx"))).withColumn("d", F.substring("h", 1, 2))
        sizes = hashed.groupBy("first", "d").agg(F.count(F.lit(1)).alias("c"))
        sizes = sizes.withColumn("before", F.sum("c").over(Window.partitionBy("first").orderBy("d")) - F.col("c")).withColumn("total", F.sum("c").over(Window.partitionBy("first"))).drop("c")
        rank = F.row_number().over(Window.partitionBy("first", "d").orderBy("h")) - 1 + F.col("before")
        ranked = hashed.join(bounded(sizes), ["first", "d"]).withColumn("half", F.expr("n div 2"))
        ranked = ranked.withColumn("left", (F.col("n") > 1) & (rank < F.expr("total * half div n")))
        new = ranked.select("name", "idx", F.expr("if(n = 1 or left, first, first + half)").cast("int").alias("first"), F.expr("if(n = 1, 1, if(left, half, n - half))").cast("int").alias("n"))
        old, state = state, materialize(new, "mix-tree", files)
        discard(old)
    return state.groupBy("name", F.col("first").alias("shard")).agg(F.count(F.lit(1)).alias("many"))


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def plan_mix(
    docs: DataFrame, source: str = "source", size: str = "size", key: str = "key", *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block_words: int = 100_000_000, shard_words: int = 1_000_000_000, least_shards: int = 32, seed: int = 42
) -> DataFrame:
    """Plan what a mixture takes of each row, and into which shards.

    Sources in order (null last) have the weights in turn; their targets are
    ``targets()``.  A source's rows are dealt into blocks by a hash of the key,
    a string that should tell rows apart: blocks of 1000 words up to 64 of them,
    and more where they would have over ``block_words`` words.
    The quota (the target, rounded) is whole passes over the source, then the
    first blocks of a seeded permutation; the block at the edge gives its rows
    in hashed order, the last of them cut, so that a source's words meet its
    quota exactly.  ``split_tree`` deals the drawn blocks out to shards
    (``least_shards``, doubled until one has ``shard_words`` words at most):
    shard by shard takes the next of the permuted blocks, so no two shards
    share a draw.

    Returns columns ``doc`` (a struct of all columns of docs, whatever their
    names), ``source_size``, ``target``, ``taken`` and ``draws``, an array of
    (pass, shard, words, place); sorting a shard by place shuffles it.  A row of
    size 0 or null has nothing to take.  Rows that repeat a key and size are
    interchangeable; null keys are one key.  An empty table gives an empty one.
    Sources and blocks are tables, joined by broadcast up to a checked size; rows are
    dealt out anew only where a block lies on the edge of a quota.
    """
    name = F.concat(F.when(F.col(f"`{source}`").isNull(), "0").otherwise("1"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("bigint").alias("words"), name.alias("name"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"))
    sources = rows.groupBy("name").agg(F.sum("words").alias("s")).select("name", "s", (F.substring("name", 1, 1) == "0").alias("none"))
    sources = numbered(sources, ["none", "name"], "i", "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights)).cast("int") + 1)
    sources = materialize(sources.select("name", "s", weight.alias("weight")), "mix-weights", few=True)
    sources = targets(sources, share, most).withColumn("quota", F.floor(F.col("target") + 0.5))
    plan = sources.select(
        "name", F.col("s").alias("source_size"), "target",
        F.greatest(F.least(F.lit(64), F.expr("(s + 999) div 1000")), F.expr(f"(s + {block_words - 1}) div {block_words}"), F.lit(1)).alias("blocks"),
        F.expr("if(s = 0, 0, quota div s)").alias("passes"), F.expr("if(s = 0, 0, quota % s)").alias("rest"),
    )
    plan = bounded(materialize(plan, "mix-plan", few=True))
    rows = rows.join(plan, "name").withColumn("block", _number(F.concat(F.lit(f"{seed}|block|"), "key")) % F.col("blocks"))
    permuted = Window.partitionBy("name").orderBy(F.md5(F.concat_ws("|", F.lit(f"{seed}|order"), "name", "block")), "block")
    cut = rows.groupBy("name", "block").agg(F.sum("words").alias("in_block"), F.first("rest").alias("r"), F.first("passes").alias("p"))
    cut = cut.withColumn("rank", F.row_number().over(permuted) - 1).withColumn("before", F.sum("in_block").over(permuted.rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_block"))
    cut = materialize(cut.withColumn("drawn", F.col("before") < F.col("r")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name"))), "mix-blocks", few=True)
    draws = cut.select("name", F.explode(F.expr("transform(sequence(0L, p + cast(drawn as bigint)), x -> if(x < p + cast(drawn as bigint), x * n + rank, -1L))")).alias("idx")).where("idx >= 0")
    words = int(plan.agg(F.sum("target")).first()[0] or 0)
    shards = least_shards
    while shards * shard_words < words:
        shards *= 2
    tree = split_tree(draws, shards, seed)
    ends = F.sum("many").over(Window.partitionBy("name").orderBy("shard"))
    ends = tree.withColumn("end", ends).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("shard", "end"))).alias("ends"))
    ends = materialize(ends, "mix-ends", few=True)
    cut = cut.select("name", "block", "in_block", "before", "rank", "drawn", "n").join(bounded(ends), "name", "left")
    rows = rows.join(bounded(materialize(cut, "mix-cuts", few=True)), ["name", "block"]).withColumn("hash", F.md5(F.concat(F.lit(f"{seed}|row|"), "key")))
    edge = F.col("drawn") & (F.col("before") + F.col("in_block") > F.col("rest"))
    inside = Window.partitionBy("name", "block").orderBy("hash", "words").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = rows.where(edge).withColumn("part", F.least("words", F.greatest(F.lit(0), F.col("rest") - F.col("before") - F.sum("words").over(inside) + F.col("words"))))
    rows = rows.where(~edge).withColumn("part", F.when(F.col("drawn"), F.col("words")).otherwise(0)).unionByName(at_edge)
    draws = F.expr("""filter(transform(sequence(0L, passes), p -> named_struct('pass', p, 'shard', get(filter(ends, e -> e.end > p * n + rank), 0).shard,
        'words', if(p < passes, words, part), 'place', substr(md5(concat(hash, '|', cast(p as string))), 1, 16))), d -> d.words > 0)""")
    return rows.select("doc", "source_size", "target", (F.col("words") * F.col("passes") + F.col("part")).alias("taken"), draws.alias("draws"))


def mixture(planned: DataFrame, text: str | None = None) -> DataFrame:
    """One row a draw (doc, source_size, target, taken, pass, shard, words, place), sorted by shard and, shuffled, by place.

    A range of shards and places goes to each task, so a shard may take several.  If
    ``text`` names a column of doc, the rows also have ``text``: a draw that is
    cut short has its first ``words`` words, single blanks between them.
    """
    drawn = planned.select("doc", "source_size", "target", "taken", F.explode("draws").alias("d")).select("doc", "source_size", "target", "taken", "d.*")
    if text:
        own = F.col("doc").getField(text)
        short = F.array_join(F.slice(F.filter(F.split(own, SEPARATORS), lambda w: w != ""), 1, F.col("words").cast("int")), " ")
        drawn = drawn.withColumn("text", F.when(F.col("words") < word_count(own), short).otherwise(own))
    return drawn.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")


def sized(docs: DataFrame, columns: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """Some columns of docs, written, with ``size`` (words) and ``key`` (the id, or a hash of the text where that is null)."""
    key = F.coalesce(F.col(f"`{id}`").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    return materialize(docs.select(*[f"`{c}`" for c in columns], word_count(F.col(f"`{text}`")).alias("size"), key.alias("key")), "mix-sizes")


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards and places of every row of docs, summed from the mixture.

    The mixture (each draw in its shard, shuffled there) is written first;
    ``taken`` adds up its words, ``shards`` and ``places`` are the shards and places of a
    row's draws by pass, comma-joined (empty if it has none).  A null text has size 0.
    """
    rows = sized(docs.select("doc_id", "source", "text"), ["doc_id", "source"])
    planned = plan_mix(rows.withColumn("row", F.monotonically_increasing_id()))
    planned = materialize(planned.select("doc", "source_size", "target", "draws", "taken"), "mix-planned")
    mixed = materialize(mixture(planned), "mix-shards")
    sums = mixed.groupBy(F.col("doc.row").alias("row")).agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("pass", "shard", "place"))).alias("d"))
    out = planned.select("doc.doc_id", "doc.size", "source_size", "target", F.col("doc.row").alias("row")).join(sums, "row", "left")
    joined = lambda c: F.array_join(F.coalesce(F.col(f"d.{c}").cast("array<string>"), F.array()), ",").alias(f"{c}s")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), joined("shard"), joined("place"))


def mix_texts(docs: DataFrame) -> DataFrame:
    """The mixture itself: shard, place, pass, the columns of documents (text cut where a draw is), words, taken and target."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    planned = plan_mix(sized(docs, columns))
    drawn = mixture(planned, "text")
    return drawn.select("shard", "place", "pass", *[F.col("text") if c == "text" else F.col(f"doc.{c}") for c in columns if c != "n_chars"], F.length("text").cast("bigint").alias("n_chars"), "words", "taken", "target")


def op8_mixing_sources(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, shards and places over all documents."""
    return mix_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LEVEL = """t{b} as (select name, idx, first + case when rank < total * {half} // {n} then 0 else {half} end as first from (
    select name, idx, first, row_number() over (partition by first order by md5('42|tree|' || first || '|{n}|' || name || '|' || idx)) - 1 as rank, count(*) over (partition by first) as total from t{a})),
"""
OP8_SQL = r"""
with d as (select doc_id, coalesce(doc_id::varchar, 't' || md5(coalesce(text, ''))) as key, row_number() over () as k, case when source is null then '0' else '1' end || coalesce(source, '') as name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select name, sum(size)::bigint as n from d group by name),
w as (select name, n, [5, 2, 1][((row_number() over (order by name[1] = '0', name[2:]) - 1) % 3)::int + 1] as w from s),
c as (select *, sum(n) over () as total, coalesce(sum(2 * n) over before, 0) as filled, sum(w) over () - coalesce(sum(w) over before, 0) as rest
  from w window before as (order by 2 * n / w, name rows between unbounded preceding and 1 preceding)),
l as (select *, (1.5 * total - filled)::double / rest::double as level from c),
f as (select min_by(level, filled * 1000 - rest) as level from l where level * w <= 2 * n),
t as (select name, n, case when f.level is null or w * f.level > 2 * n then (2 * n)::double else w * f.level end as target from l left join f on true),
q as (select *, case when n = 0 then 0 else floor(target + 0.5)::bigint // n end as passes, case when n = 0 then 0 else floor(target + 0.5)::bigint % n end as rest,
  greatest(least(64, (n + 999) // 1000), (n + 99999999) // 100000000, 1) as blocks from t),
r as (select d.*, n, target, passes, q.rest, ('0x' || substr(md5('42|block|' || key), 1, 8))::bigint % blocks as block, md5('42|row|' || key) as h from d join q using (name)),
b as (select name, block, sum(size) as words from r group by name, block),
o as (select name, block, words, sum(words) over p - words as before, row_number() over p - 1 as rank, count(*) over (partition by name) as m
  from b window p as (partition by name order by md5('42|order|' || name || '|' || block), block rows unbounded preceding)),
t0 as (select name, (p * m + rank)::bigint as idx, 0 as first from (select o.*, unnest(range(0, passes + case when before < rest then 1 else 0 end)) as p from o join q using (name))),
LEVELS
ends as (select name, first, sum(count(*)) over (partition by name order by first) as e from t5 group by name, first),
e as (select r.*, before, words, rank, m, sum(r.size) over (partition by r.name, r.block order by h, r.size rows unbounded preceding) - r.size as ahead from r join o using (name, block)),
y as (select *, greatest(0, least(size, rest - before - ahead))::bigint as part from e),
x as (select k, name, p, substr(md5(h || '|' || p), 1, 16) as place, p * m + rank as idx from (select *, unnest(range(0, passes + 1)) as p from y) where case when p < passes then size else part end > 0),
z as (select x.k, string_agg(shard::varchar, ',' order by p) as shards, string_agg(place, ',' order by p) as places
  from (select x.*, (select min(first) from ends where ends.name = x.name and e > x.idx) as shard from x) x group by x.k)
select doc_id, size, n as source_size, target, (size * passes + part)::bigint as taken, coalesce(shards, '') as shards, coalesce(places, '') as places from y left join z using (k)
""".replace("LEVELS\n", "".join(_LEVEL.format(a=i, b=i + 1, n=32 >> i, half=16 >> i) for i in range(5)))
