"""What several operators share: tables that cut lineage, checked broadcasts, components, sorted groups."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The word separators of all the contracts here, as a regular expression.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Rows that a broadcast side may have; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Rows of a task where a table is ranked.
RANKED = 200_000
#: For tables whose rows are large: pages are measured from their first row on, not after a hundred, since what compresses them keeps a page's size outside the heap.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8", "parquet.block.size": str(16 << 20)}
#: Bytes of an Arrow batch that goes to Python where rows are large: the JVM builds it outside its heap, twice while it grows, and the worker holds it too.
BATCH_BYTES = 4 << 20
#: Edges of a task, and of a file, of a round of ``components``.
EDGES_A_TASK = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; unset, a temporary one on a single machine and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/tessera-checkpoints"
    return folder.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send Python batches of BATCH_BYTES at most, and a row more; a lower bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    bound = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(key, str(min(bound, BATCH_BYTES) if bound > 0 else BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, files: int | None = None, few: bool = False, large_rows: bool = False) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: later jobs reread it when executors are lost.

    ``files``: so many tasks write it at most, for tables of a known size; ``few``:
    an eighth of the shuffle's partitions (2 at least), for tables much smaller
    than what is shuffled to make them, so that small files don't pile up;
    ``large_rows``: rows may hold a megabyte each.
    """
    spark = df.sparkSession
    if few:
        files = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    path = f"{shared_folder(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark deletes the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted); else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, order: list[str], as_: str, name: str) -> DataFrame:
    """df, written, with the number of each row in ``order`` (from 0): ranges are sorted apart and their sizes added up."""
    parts = 1 + df.count() // RANKED
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), name, parts)
    before = dealt.groupBy("__part").count().withColumn("__before", F.sum("count").over(Window.orderBy("__part")) - F.col("count"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn(as_, inside).join(F.broadcast(before.drop("count")), "__part").withColumn(as_, (F.col(as_) + F.col("__before")).cast("bigint")).drop("__part", "__before")


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """df.mapInArrow whose function carries this package's code: executors need no copy of it."""
    import tessera.llm

    cloudpickle.register_pickle_by_value(tessera.llm)
    try:
        return df.mapInArrow(run, schema)
    finally:
        cloudpickle.unregister_pickle_by_value(tessera.llm)


def sorted_groups(df: DataFrame, keys: list[str], make: Callable[[], Callable[[pa.Table], list[pa.RecordBatch]]], schema: T.StructType, order: list[str] | None = None) -> DataFrame:
    """Run over df dealt by ``keys`` and sorted by them and ``order``.

    ``make()`` gives, for each task, a function of a table of whole groups; the
    group that a batch ends in is held until it is complete, so callers bound
    the size of a group.
    """
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        work, held, last = make(), [], None
        whole = lambda parts: pa.Table.from_batches(parts).combine_chunks()
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in names]
            same = np.logical_and.reduce([c == c[-1] for c in columns])
            cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))  # the last group begins here
            first = tuple(c[0] for c in columns)
            if cut:
                yield from work(whole([*held, batch.slice(0, cut)]))
                held = []
            elif held and first != last:
                yield from work(whole(held))
                held = []
            held.append(batch.slice(cut))
            last = tuple(c[-1] for c in columns)
        if held:
            yield from work(whole(held))

    return map_arrow(df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *(order or [])), run, schema)


def _edges_written(e: DataFrame, name: str, rows: int | None) -> tuple[DataFrame, tuple]:
    """e written and read again, with its count and checksum as observed on the way; a file for EDGES_A_TASK of ``rows``."""
    seen = Observation()
    e = e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    e = materialize(e, name, rows and 1 + rows // EDGES_A_TASK, few=rows is None)
    return e, (seen.get["n"], seen.get["s"])


def components(edges: DataFrame, name: str = "components", limit: int = 60) -> DataFrame:
    """Connected components of edges (a, b), two columns of one orderable type.

    Alternates the large-star and small-star steps of Kiveris et al. (2014);
    each round is a written table, so the plan stays short and lost executors
    only cost the round; the round before it is deleted.  The least neighbours
    of a large-star step are a table too: both sides of its join are then dealt
    out as they are, and Spark can split a node with very many neighbours.
    Returns (node, root) for each node that has an edge; the root is the
    component's least node.  Self-loops and nulls are ignored.
    """
    e, state = _edges_written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name, None)
    for _ in range(limit):
        n = state[0]
        if not n:
            break
        files = 1 + n // EDGES_A_TASK
        turned = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = materialize(e.unionAll(turned).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least", files)
        large = turned.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        center = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(center, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(center.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, old, (e, state) = state, e, _edges_written(small, name, n)
        discard(old, least)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select("v", "v").distinct().toDF("node", "root"))
