"""Writing results next to their source, in its format."""

from __future__ import annotations

import csv
import json
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path, PurePosixPath
from urllib.parse import urlsplit

from pyspark.sql import DataFrame

from tessera.functions.hashing import column
from tessera.sources.readers import _excel, _located, extension, is_download, is_remote


def tag(n: int, anonymized: bool = False, components: int = 0) -> str:
    """sample_{n}, then _anon and _pca{k} as they apply."""
    return f"sample_{n}" + "_anon" * anonymized + (f"_pca{components}" if components else "")


def output_path(source: str, label: str, folder: str | None = None) -> str:
    """{stem}_{label}{extension} in folder, by default the source's (the working folder for a source read over http or ftp)."""
    name = PurePosixPath(urlsplit(source).path if is_remote(source) else source)
    if folder:
        where = folder.rstrip("/") or "/"
    elif is_download(source):
        where = str(Path.cwd())
    elif is_remote(source):
        where = source[: source.rindex("/")]
    else:
        where = str(Path(source).parent)
    return f"{where}/{name.stem}_{label}{extension(source)}"


def _on_spark(df: DataFrame, path: str) -> bool:
    """Whether Spark's tasks can write there: a file system they all see, or this machine's disk if all of Spark is here."""
    master = df.sparkSession.sparkContext.master
    return is_remote(path) or master == "local" or master.startswith("local[")


def _single_file(df: DataFrame, path: str, write: Callable) -> None:
    """Have one task write a folder beside path, and rename its part file: all through the path's own file system."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(_located(path))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    work = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    try:
        write(df.coalesce(1).write, work.toString())
        part = next(f.getPath() for f in files.listStatus(work) if f.getPath().getName().startswith("part-"))
        files.delete(target, False)
        if not files.rename(part, target):
            raise OSError(f"{part.toString()} could not be renamed to {path}")
    finally:
        files.delete(work, True)


def _json_rows(df: DataFrame) -> Iterator[str]:
    """Records as lines of an indented array, one at a time."""
    fields, first = df.columns, True
    yield "["
    for line in df.toJSON().toLocalIterator():
        record = json.loads(line)
        text = json.dumps({f: record.get(f) for f in fields}, indent=2, ensure_ascii=False)
        yield ("\n" if first else ",\n") + "\n".join("  " + x for x in text.split("\n"))
        first = False
    yield "]" if first else "\n]"


def save_output(df: DataFrame, source: str, label: str, folder: str | None = None) -> Path | str:
    """Write df as one file in the source's format; returns its path (a string if it is remote).

    Meant for samples, which fit one file.  CSV, TSV and Parquet go through one
    Spark task and the file system of the path, whatever it is; on a cluster, for
    a folder of the driver's own disk, rows come to the driver instead, batch by
    batch.  JSON (an indented array of records) is written by the driver record by
    record, Excel as a whole.  Larger results are better written with ``write_table``.
    """
    path, kind = output_path(source, label, folder), extension(source)
    remote, separator = is_remote(path), "\t" if kind == ".tsv" else ","
    if not remote:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
    if kind in (".csv", ".tsv", ".parquet"):
        if _on_spark(df, path):
            target = path if remote else Path(path).absolute().as_uri()
            _single_file(df, target, (lambda w, p: w.parquet(p)) if kind == ".parquet" else lambda w, p: w.csv(p, header=True, sep=separator, escape='"'))
        elif kind == ".parquet":
            _local_parquet(df, path)
        else:
            with open(path, "w", newline="", encoding="utf-8") as out:
                writer = csv.writer(out, delimiter=separator)
                writer.writerow(df.columns)
                writer.writerows(df.select(*[column(c).cast("string") for c in df.columns]).toLocalIterator())
    elif kind == ".json":
        if remote:
            _write_remote(df, path, _json_rows(df))
        else:
            with open(path, "w", encoding="utf-8") as out:
                out.writelines(_json_rows(df))
    elif kind in (".xlsx", ".xls"):
        if remote:
            raise ValueError("Excel files are written to the driver's disk; name a folder there")
        _excel()
        df.toPandas().to_excel(path, index=False)
    else:
        raise ValueError(f"Unsupported file type {kind!r}")
    return path if remote else Path(path)


def _local_parquet(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """One file on the driver's disk, from batches of rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    with pq.ParquetWriter(path, schema) as out:
        batch: list[dict] = []
        for r in df.toLocalIterator():
            batch.append(r.asDict(recursive=True))
            if len(batch) == rows:
                out.write_table(pa.Table.from_pylist(batch, schema))
                batch = []
        out.write_table(pa.Table.from_pylist(batch, schema))


def _write_remote(df: DataFrame, path: str, lines: Iterator[str]) -> None:
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(_located(path))
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for x in lines:
            out.write(bytearray(x.encode()))
    finally:
        out.close()


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write df as a folder of part files, one for each task."""
    writer = df.write.mode("error")
    {"parquet": writer.parquet, "json": writer.json, "csv": lambda p: writer.csv(p, header=True), "tsv": lambda p: writer.csv(p, header=True, sep="\t")}[kind](path)


def save_report(text: str, source: str, folder: str | None = None) -> Path:
    """Write a report as {stem}_report.txt on the driver's disk."""
    here = folder or (str(Path.cwd()) if is_remote(source) else None)
    path = Path(output_path(source, "report", here)).with_suffix(".txt")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path
