"""A training corpus from raw documents: five stages, each of which sees all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, mixing, pii, quality
from tessera.llm.shared import bounded, discard, materialize

#: A row's key in the stages that decide by pairs: rows that repeat an id, or have none, are told apart by their texts.
KEY = "__row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def _with_text(docs: DataFrame, judged: DataFrame, text: str) -> DataFrame:
    """docs' columns of judged rows with another text, and its length where docs has one."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    return judged.select(*[(new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    return _with_text(docs, quality.clean_lines(docs).where("kept"), "clean_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the least id (null ids are greatest; ties: least key).

    Documents link at a Jaccard similarity of 0.8 of five-word shingles; op5's own contract is narrower.  Rows that repeat id and text are one; texts without words stay.
    """
    keyed = _keyed(docs)
    classes = materialize(jaccard.jaccard_join(keyed, id=KEY, k=5, percent=80).where("component_id <> " + KEY + " or n_links > 0"), "pipeline-classes", few=True)
    ids = keyed.select("doc_id", KEY).join(bounded(classes.select(KEY, "component_id").distinct(), 1_000_000), KEY)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(KEY).alias("key"))
    stays = materialize(ids.groupBy("component_id").agg(F.min(order).alias("o")).select(F.col("o.key").alias(KEY)), "pipeline-stays", few=True)
    gone = classes.select(KEY).distinct().join(bounded(stays), KEY, "left_anti")
    gone = bounded(materialize(gone, "pipeline-gone", few=True), 1_000_000)
    kept = keyed.join(gone, KEY, "left_anti")
    twice = classes.join(bounded(stays), KEY, "left_semi").groupBy(KEY).count().where("count > 1").select(KEY)
    twice = bounded(materialize(twice, "pipeline-twice", few=True))
    once = kept.join(twice, KEY, "left_anti")
    return once.unionByName(kept.join(twice, KEY, "left_semi").dropDuplicates([KEY])).select(*[f"`{c}`" for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = _keyed(docs)
    found = decontaminate.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id=KEY)
    leaked = bounded(materialize(found.select(KEY).distinct(), "pipeline-leaks", few=True), 1_000_000)
    return keyed.join(leaked, KEY, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    return _with_text(docs, pii.find_pii(docs, redact=True), "redacted")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row a draw, by shard and shuffled in it, its text cut where the quota ends."""
    return mixing.mix_texts(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing_sources),
]

#: EM and a trained classifier have no SQL; tests hold each stage against SQL or brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's result written and read again by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{i}")
            if before:
                discard(before)
            before = docs
    return docs
