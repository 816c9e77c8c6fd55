"""Sources and sinks: distributed formats in, distributed formats out."""

from __future__ import annotations

import datetime as _dt
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.constants import UNSAFE_FILENAME_CHARS
from tablelens.sources.schema import quote

_FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".orc": "orc"}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL on float columns so NaN is never a value (§1.3).

    Not applied by :func:`load_table`: a projection over the scan keeps
    range filters from being pushed into Parquet.  The operators already
    read NaN as missing; use this (after filtering) only to hand a clean
    table to other code.
    """
    fixes = {
        f.name: F.when(F.isnan(F.col(quote(f.name))), F.lit(None).cast(f.dataType)).otherwise(F.col(quote(f.name)))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixes) if fixes else df


def _detect_format(path: str) -> str:
    p = path.rstrip("/")
    ext = os.path.splitext(p)[1].lower()
    if ext in _FORMATS:
        return _FORMATS[ext]
    raise ValueError(f"unsupported file type {ext or '(none)'!r} for {path!r}")


def load_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None,
               **options) -> DataFrame:
    """A1: read one table; format from the lower-cased extension unless given.

    With a ``schema`` (a struct type or DDL text) CSV and JSON are read once,
    without the pass that infers types.
    """
    fmt = (fmt or _detect_format(path)).lower()
    if fmt not in {"parquet", "csv", "json", "orc"}:
        raise ValueError(f"unsupported format {fmt!r}")
    if fmt == "csv":
        options = {"header": "true", "inferSchema": "false" if schema is not None else "true"} | options
    reader = spark.read.options(**options)
    return (reader if schema is None else reader.schema(schema)).format(fmt).load(path)


def _folder_entries(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table name -> path of every table in a folder, on any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))
    parts = [os.path.splitext(n) for n in names]
    return {stem: f"{folder.rstrip('/')}/{stem}{ext}" for stem, ext in parts if ext.lower() in _FORMATS}


def list_tables(spark: SparkSession, folder: str | None = None) -> list[str]:
    """A2: names of the tables in a folder (one file or folder per table), or
    of the catalog's current database and temporary views without a folder."""
    if folder is None:
        return sorted(t.name for t in spark.catalog.listTables())
    return list(_folder_entries(spark, folder))


def load_named_table(spark: SparkSession, folder: str | None = None, name: str | None = None, **options) -> DataFrame:
    """A2: load the only table, or the one named, of a folder or (without one)
    of the catalog; several and no name is an error."""
    places = _folder_entries(spark, folder) if folder is not None else {n: n for n in list_tables(spark)}
    where = repr(folder) if folder is not None else "the catalog"
    if name is None:
        if len(places) != 1:
            raise ValueError(f"{len(places)} tables in {where}; name one of {list(places)}")
        (name,) = places
    if name not in places:
        raise ValueError(f"no table {name!r} in {where}")
    return load_table(spark, places[name], **options) if folder is not None else spark.table(name)


def dataset_info(df: DataFrame, source: str, table: str | None = None) -> DataFrame:
    """Rows, columns, source and table name (one aggregate job)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("int").alias("n_columns"),
        F.lit(source).alias("source"),
        F.lit(table).cast("string").alias("table_name"),
    )


def export_name(stem: str, sheet: str | None = None, ts: _dt.datetime | None = None) -> str:
    """``{stem}[_{sheet}]_filtered_{yyyyMMdd_HHmmss}`` with unsafe runs → ``_``."""
    ts = ts or _dt.datetime.now()
    base = f"{stem}_{sheet}" if sheet else stem
    name = f"{base}_filtered_{ts:%Y%m%d_%H%M%S}"
    return re.sub("[" + re.escape(UNSAFE_FILENAME_CHARS) + "]+", "_", name)


EXPORT_ROWS = 5_000_000


def content_mark(df: DataFrame) -> tuple[int, int]:
    """(rows, sum of the rows' 64-bit hashes): equal for equal multisets of rows, whatever their order or files."""
    names = [quote(c) for c in df.columns]
    whole = F.xxhash64(*[F.to_json(F.struct(F.col(n))) if isinstance(f.dataType, (T.MapType,)) else F.col(n) for n, f in zip(names, df.schema.fields)])
    rows, mark = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(whole.cast("decimal(38,0)")), F.lit(0))).first()
    return int(rows), int(mark)


def export_dataset(df: DataFrame | None, dest_dir: str | None, stem: str, sheet: str | None = None,
                   ts: _dt.datetime | None = None, fmt: str = "parquet", sort_by=None, rows_per_file: int = EXPORT_ROWS,
                   verify: bool = False) -> str:
    """Write the current table beside its source; never overwrite.

    The write is distributed and no file holds more than ``rows_per_file``
    rows.  With ``sort_by``, rows are cut into ranges of these columns, about
    one a file, and sorted within, so a reader's filter on them skips files
    (a value that fills more than a file spans several); else the table's own
    partitions are kept, without a shuffle.  ``verify`` reads the files back
    and compares the rows' number and hashes with the table's; CSV and JSON,
    which don't keep types, are read with the table's schema.
    """
    if df is None:
        raise ValueError("nothing to export")
    if not dest_dir:
        raise ValueError("no source folder to export beside")
    if rows_per_file < 1:
        raise ValueError("rows_per_file must be at least 1")
    path = f"{dest_dir.rstrip('/')}/{export_name(stem, sheet, ts)}.{fmt}"
    expected = content_mark(df) if verify or sort_by else None
    out = df
    if sort_by:
        columns = [F.col(quote(c)) for c in sort_by]
        out = df.repartitionByRange(max(1, -(-expected[0] // rows_per_file)), *columns).sortWithinPartitions(*columns)
    writer = out.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)
    if verify:
        found = content_mark(read_export(df.sparkSession, path, df.schema))
        if found != expected:
            raise RuntimeError(f"{path} holds {found[0]} rows, not the {expected[0]} exported ones, or others")
    return path


def read_export(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """An exported table, CSV and JSON with the given schema."""
    return load_table(spark, path, schema=None if _detect_format(path) in ("parquet", "orc") else schema)


def export_files(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """Per file of an export: its rows and, of ``column``, the least and greatest value (one aggregate over that column)."""
    f = F.input_file_name().alias("file")
    if column is None:
        return load_table(spark, path).select(f).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))
    c = F.col(quote(column)).alias("c")
    return load_table(spark, path).select(f, c).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.min("c").alias("least"), F.max("c").alias("greatest"))
