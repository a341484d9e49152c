"""Reading tables: by extension, with a guard for JSON by columns, and stable row identity."""

from __future__ import annotations

import io
import json
import urllib.parse
import urllib.request
import weakref
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUPPORTED_EXTENSIONS = (".csv", ".tsv", ".json", ".xlsx", ".xls", ".parquet")
#: Schemes that the driver downloads from, and those that Spark's file systems open, with the connector in place.
DOWNLOADED = ("http://", "https://", "ftp://")
REMOTE = (*DOWNLOADED, "s3://", "s3a://", "gs://", "gcs://", "az://", "abfs://", "abfss://", "hdfs://", "viewfs://", "dbfs://")


def is_remote(path: str) -> bool:
    return path.lower().startswith(REMOTE)


def is_download(path: str) -> bool:
    return path.lower().startswith(DOWNLOADED)


def extension(path: str) -> str:
    """The lower-case extension; of a remote path without its query."""
    name = urllib.parse.urlsplit(path).path if is_remote(path) else path
    return PurePosixPath(name.rstrip("/")).suffix.lower()


def _located(path: str) -> str:
    for alias, scheme in (("s3://", "s3a://"), ("gcs://", "gs://"), ("az://", "abfs://")):
        if path.startswith(alias):
            return scheme + path[len(alias) :]
    return path


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The table at a path, glob or folder; the extension tells the format.

    CSV and TSV have a header and their types are inferred; JSON is an array of
    records or a record a line.  JSON by columns (one record, all of whose
    fields are objects) is refused, since it would read as a single row.
    Files at http, https and ftp addresses are downloaded to the driver.
    """
    path, kind = str(path), extension(str(path))
    if is_download(path) and kind in SUPPORTED_EXTENSIONS:
        return _downloaded(spark, path, kind, sheet)
    where = _located(path)
    if kind in (".csv", ".tsv"):
        return spark.read.csv(where, header=True, inferSchema=True, multiLine=True, escape='"', sep="\t" if kind == ".tsv" else ",")
    if kind == ".parquet":
        return spark.read.parquet(where)
    if kind == ".json":
        return _read_json(spark, where, path)
    if kind in (".xlsx", ".xls"):
        pandas = _excel()
        return spark.createDataFrame(pandas.read_excel(path, sheet_name=sheet or 0))
    raise ValueError(f"Unsupported file type {kind or path!r}; supported: {', '.join(SUPPORTED_EXTENSIONS)}")


def _downloaded(spark: SparkSession, url: str, kind: str, sheet: str | None) -> DataFrame:
    """A table from a web address: fetched and parsed on the driver, so it is one that fits there."""
    import pandas

    with urllib.request.urlopen(url) as answer:
        data = io.BytesIO(answer.read())
    if kind in (".csv", ".tsv"):
        return spark.createDataFrame(pandas.read_csv(data, sep="\t" if kind == ".tsv" else ","))
    if kind == ".parquet":
        import pyarrow.parquet

        return spark.createDataFrame(pyarrow.parquet.read_table(data))
    if kind == ".json":
        text = data.read().decode()
        try:
            records = json.loads(text)
        except ValueError:
            records = [json.loads(x) for x in text.splitlines() if x.strip()]
        if isinstance(records, dict):
            raise ValueError(f"{url} looks like JSON by columns; write records instead")
        return spark.createDataFrame(pandas.DataFrame(records))
    return spark.createDataFrame(_excel().read_excel(data, sheet_name=sheet or 0))


def _read_json(spark: SparkSession, where: str, path: str) -> DataFrame:
    lines = spark.read.json(where)
    df = lines if lines.columns != ["_corrupt_record"] and "_corrupt_record" not in lines.columns else spark.read.json(where, multiLine=True)
    nested = df.schema.fields and all(isinstance(f.dataType, (T.StructType, T.MapType)) for f in df.schema.fields)
    if nested and df.limit(2).count() == 1:
        raise ValueError(f"{path} looks like JSON by columns; write records instead")
    return df


def _excel():
    try:
        import openpyxl  # noqa: F401
        import pandas
    except ImportError as missing:
        raise ImportError("Excel files need pandas and openpyxl") from missing
    return pandas


def list_sheets(path: str) -> list[str]:
    """Sheet names of an Excel file; none for other formats."""
    return list(_excel().ExcelFile(path).sheet_names) if extension(path) in (".xlsx", ".xls") else []


def resolve(spark: SparkSession, source, sheet: str | None = None) -> DataFrame:
    """A DataFrame as it is, a pandas one through Arrow, a path through ``read_table``."""
    if isinstance(source, DataFrame):
        return source
    if hasattr(source, "iloc"):
        return spark.createDataFrame(source)
    return read_table(spark, str(source), sheet)


def file_identity(df: DataFrame) -> list[Column] | None:
    """File and row number of each row, where df is a scan of files that have them; else None."""
    try:
        key = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
        df.select(*key).schema
    except AnalysisException:
        return None
    return key


_counts: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def row_count(df: DataFrame) -> int:
    """Rows of df, counted once for each DataFrame object."""
    if df not in _counts:
        _counts[df] = df.count()
    return _counts[df]
