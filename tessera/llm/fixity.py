"""WARC fixity: Merkle trees over records and offset ranges; audits descend only where replicas differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import materialize

#: Bytes of a leaf range, and ranges that a range of the next level holds.
LEAF_BYTES, FANOUT = 1 << 16, 16
#: Pages of an archive made by ``warc_records``.
ARCHIVE_PAGES = 1000


def warc_payload(url: Column, html: Column) -> Column:
    """The bytes of a response record; null url and html are empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def warc_records(pages: DataFrame, stored: Column | None = None, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(archive, offset, length, record, digest) of the records that pages make, in archives of ``ARCHIVE_PAGES`` ids.

    Offsets are those of the records laid out by id in each archive; ``stored``
    is what a replica has in a record's place (null: nothing; by default the
    record itself), and ``digest`` its SHA-256.  Texts are hashed in the scan
    and not shuffled.  Null ids make archives below zero, by the MD5 of their url;
    rows that repeat an id stand one behind the other.  Both replicas are laid
    out by the archive's own index, as copies of one file are: a lost record leaves
    a hole and doesn't move the others.  Other columns of pages are not read.
    """
    whole = warc_payload(F.col(f"`{url}`"), F.col(f"`{html}`"))
    rows = pages.select(
        F.coalesce(F.floor(F.col(f"`{id}`") / ARCHIVE_PAGES), -1 - F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{url}`"), F.lit(""))), 1, 3), 16, 10).cast("bigint")).cast("bigint").alias("archive"),
        F.col(f"`{id}`").alias("record"),
        F.octet_length(whole).cast("bigint").alias("length"),
        F.sha2(whole, 256).alias("__own"),
        F.sha2(whole if stored is None else stored, 256).alias("digest"),
    )
    order = Window.partitionBy("archive").orderBy(F.col("record").asc_nulls_first(), "__own").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("offset", F.sum("length").over(order) - F.col("length")).where("digest is not null").select("archive", "offset", "length", "record", "digest")


def merkle_tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (archive, node, hash, parts): the first has the record at each offset, the second ranges of ``LEAF_BYTES``, and so on.

    A node's hash is the SHA-256 of its parts' places and hashes in order, so
    it tells whether anything below differs.  Records at one offset (repeats)
    are one part, by their number and the sum of their hashes.  A node has at
    most ``FANOUT`` parts, on the second level the records that begin in its range.
    """
    many = F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(F.xxhash64("digest", "length").cast("decimal(38,0)")).cast("string"))
    level = records.groupBy("archive", F.col("offset").alias("node")).agg(F.when(F.count(F.lit(1)) == 1, F.sha2(F.concat_ws("|", F.min("length").cast("string"), F.min("digest")), 256)).otherwise(F.sha2(many, 256)).alias("hash"), F.count(F.lit(1)).alias("parts"))
    tree = [materialize(level, "merkle")]
    for n in range(1, levels + 1):
        width = LEAF_BYTES if n == 1 else FANOUT
        level = tree[-1].groupBy("archive", F.floor(F.col("node") / width).alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("p"), F.count(F.lit(1)).alias("parts"))
        level = level.select("archive", "node", F.sha2(F.array_join(F.transform("p", lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["hash"])), ","), 256).alias("hash"), "parts")
        tree.append(materialize(level, "merkle", few=True))
    return tree


def levels_for(*records: DataFrame) -> int:
    """Levels whose top has one node for each archive."""
    top = max((r.agg(F.max("offset")).first()[0] or 0) for r in records)
    n, width = 1, LEAF_BYTES
    while top >= width:
        n, width = n + 1, width * FANOUT
    return n


def fixity_audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(archive, offset, record, fault, nodes): where replicas a and b, tables as of ``warc_records``, differ.

    Archive roots are compared first; then, level by level, only the parts of
    nodes that differ, down to single offsets.  ``fault`` is ``missing`` (a
    has it, b doesn't), ``extra`` (the other way round) or ``changed``;
    ``record`` the least id at the offset; ``nodes`` the differing ranges on the
    way down.  Equal replicas, or two empty ones, give no rows.  A level is a
    table of its own and one join on (archive, node), whose rows are as many as
    differ above it.
    """
    a, b = materialize(a, "replica"), materialize(b, "replica")
    levels = levels_for(a, b)
    ta, tb = merkle_tree(a, levels), merkle_tree(b, levels)
    suspects = None
    for n in range(levels, -1, -1):
        x = ta[n].select("archive", "node", F.col("hash").alias("ha"))
        y = tb[n].select("archive", "node", F.col("hash").alias("hb"))
        if suspects is not None:
            width = LEAF_BYTES if n == 0 else FANOUT
            above = suspects.select("archive", F.col("node").alias("up"), "nodes")
            x = x.withColumn("up", F.floor(F.col("node") / width)).join(above, ["archive", "up"]).drop("up")
            y = y.withColumn("up", F.floor(F.col("node") / width)).join(above, ["archive", "up"]).drop("up").withColumnRenamed("nodes", "nodes2")
        else:
            x, y = x.withColumn("nodes", F.lit(0).cast("bigint")), y.withColumn("nodes2", F.lit(0).cast("bigint"))
        both = x.join(y, ["archive", "node"], "full").where(~F.col("ha").eqNullSafe(F.col("hb")))
        suspects = materialize(both.select("archive", "node", "ha", "hb", (F.coalesce("nodes", "nodes2") + (1 if n else 0)).alias("nodes")), "suspects", few=True)
    names = a.unionByName(b).join(suspects.select("archive", F.col("node").alias("offset")), ["archive", "offset"], "left_semi").groupBy("archive", "offset").agg(F.min("record").alias("record"))
    fault = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("changed")
    return suspects.select("archive", F.col("node").alias("offset"), fault.alias("fault"), "nodes").join(names, ["archive", "offset"]).select("archive", "offset", "record", "fault", "nodes")


def faulty(pages: DataFrame) -> tuple[Column, Column]:
    """What two replicas have of each page when faults are planted by the first digits of the id's MD5: 00 a changed byte, 01 and 02 a lost record."""
    whole = warc_payload(F.col("url"), F.col("html"))
    sign = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    text = F.lit(None).cast("string")
    return F.when(sign == "02", text).otherwise(whole), F.when(sign == "01", text).when(sign == "00", F.concat(F.lit("w"), F.substring(whole, 2, 2**31 - 1))).otherwise(whole)


def op10_merkle_fixity(spark, sf_dir: str) -> DataFrame:
    """Faults planted in two replicas of the archives of all pages, as the audit locates them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    a, b = faulty(pages)
    return fixity_audit(warc_records(pages, a), warc_records(pages, b)).withColumnRenamed("record", "page_id").drop("nodes")


OP10_SQL = r"""
with r as (select page_id, coalesce(floor(page_id / 1000)::bigint, -1 - ('0x' || substr(md5(coalesce(url, '')), 1, 3))::bigint) as archive, substr(md5(coalesce(page_id::varchar, '')), 1, 2) as sign,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::varchar || repeat(chr(13) || chr(10), 2) || coalesce(html, '') || repeat(chr(13) || chr(10), 2) as x from pages),
o as (select page_id, archive, sign, (sum(strlen(x)) over (partition by archive order by page_id nulls first, sha256(x) rows unbounded preceding) - strlen(x))::bigint as "offset" from r)
select archive, "offset", page_id, case sign when '00' then 'changed' when '01' then 'missing' else 'extra' end as fault from o where sign in ('00', '01', '02')
"""
