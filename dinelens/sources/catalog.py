"""Table jobs: materialise, ensure, append-new, counts, source choice
(A2-A5, A7, A8) and the CSV ingest (A1).

Tables live as Parquet directories (or catalog tables). Writes are whole
Spark jobs: a failed task is retried by Spark and the output commit is
atomic per job, so a lost executor does not leave half a table behind.
"""

from __future__ import annotations

import os
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the text the raw CSV files use for a missing value.
CSV_NULL = ""


def ingest_csv(spark: SparkSession, path: str, schema: T.StructType, null_value: str = CSV_NULL) -> DataFrame:
    """A1: read a CSV file (or directory) with a header and a fixed schema;
    empty fields become NULL, padding blanks are kept (as pandas does).

    Columns are matched by the header's names, whatever their order; further
    columns are left out, a missing one is an error, and so is a bad record or
    a file with another header (``quarantine.ingest`` sets these aside).
    """
    options = {"header": "true", **csv_options(null_value)}
    names = spark.read.options(**options).csv(path).columns
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"{path}: the header lacks {missing}")
    types = {f.name: f.dataType for f in schema}
    as_read = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
    return spark.read.schema(as_read).options(enforceSchema="false", **options).csv(path).select(*schema.names)


def csv_options(null_value: str = CSV_NULL) -> dict[str, str]:
    return {
        "nullValue": null_value,
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "mode": "FAILFAST",
    }


def parse_csv_lines(lines: DataFrame, column: str, schema: T.StructType, null_value: str = CSV_NULL) -> DataFrame:
    """A1 for lines that are rows of a table already: the same rules as
    ``ingest_csv``, without a header."""
    row = F.from_csv(F.col(column), schema.simpleString()[len("struct<") : -1].replace(":", " "), csv_options(null_value))
    return lines.select(row.alias("row")).select("row.*")


def scan(spark: SparkSession, path_or_table: str) -> DataFrame:
    """A2: a table by catalog name, or a Parquet directory by path."""
    if _is_path(path_or_table):
        return spark.read.parquet(path_or_table)
    return spark.table(path_or_table)


def materialize(
    df: DataFrame, path: str, partition_by: list[str] | None = None, files_per_partition: int = 8
) -> DataFrame:
    """A3: create-or-replace a Parquet table from a query; returns a scan of
    the written table (the lineage ends at the files).

    A partitioned table is dealt by partition value and a salt first, so a
    value has at most ``files_per_partition`` files and a value with most of
    the rows is written by as many tasks, instead of a file per task and value.
    """
    if partition_by:
        salt = F.floor(F.rand(17) * files_per_partition).cast("int")
        df = df.repartition(*partition_by, salt)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_bucketed(
    df: DataFrame, name: str, key: str, buckets: int, path: str | None = None
) -> DataFrame:
    """A3 for tables that are joined on one key: a catalog table bucketed
    and sorted on ``key`` (external at ``path`` when given). Tables written
    with the same ``buckets`` on the same key join, anti-join and group on
    it without a shuffle, so e.g. review texts never move to meet their
    labels or their gold rows. Returns a scan of the table."""
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A4: the Parquet table at ``path``, created empty with ``schema`` if
    absent."""
    if not _exists(spark, path):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def ensure_database(spark: SparkSession, name: str) -> None:
    """``CREATE DATABASE IF NOT EXISTS`` (the reference's schemas)."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def ensure_catalog_table(
    spark: SparkSession, name: str, schema: T.StructType, path: str | None = None
) -> DataFrame:
    """A4 for catalog tables: ``CREATE TABLE IF NOT EXISTS name (...) USING
    parquet`` (external at ``path`` when given)."""
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=path, source="parquet", schema=schema)
    return spark.table(name)


def _is_path(target: str) -> bool:
    return os.sep in target or target.startswith(("file:", "s3", "hdfs:", "gs:", "abfs"))


def new_rows(rows: DataFrame, existing: DataFrame | None, keys: list[str]) -> DataFrame:
    """A5's plan: ``rows`` with one row per key, without the keys of ``existing``.

    NULL is a key like any other, so rows without one are added once."""
    new = rows.dropDuplicates(keys)
    if existing is not None:
        known = existing.select(*[F.col(k).alias(f"_known_{i}") for i, k in enumerate(keys)])
        same = [new[k].eqNullSafe(known[f"_known_{i}"]) for i, k in enumerate(keys)]
        new = new.join(known, reduce(and_, same), "left_anti")
    return new.select(*rows.columns)


def append_new(rows: DataFrame, target: str, key: str | list[str]) -> int:
    """A5: append the rows whose key is not yet in ``target`` (a Parquet path
    or a catalog table name).

    Rows are de-duplicated on the key, then anti-joined against the
    table, so appending the same rows twice adds them once (the PRIMARY KEY
    the reference relies on). One writer per table at a time.
    Returns the number of rows appended.
    """
    keys = [key] if isinstance(key, str) else list(key)
    spark = rows.sparkSession
    if _is_path(target):
        existing = spark.read.schema(rows.schema).parquet(target) if _exists(spark, target) else None
    else:
        existing = spark.table(target) if spark.catalog.tableExists(target) else None
    new = new_rows(rows, existing, keys).persist()
    try:
        n = new.count()
        if n:
            if _is_path(target):
                new.write.mode("append").parquet(target)
            elif existing is not None:
                new.select(*existing.columns).write.insertInto(target)
            else:
                new.write.format("parquet").saveAsTable(target)
    finally:
        new.unpersist()
    return n


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count)`` for each table, as one union of
    one-row aggregates."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def enriched_or_raw(spark: SparkSession, enriched: str, raw: DataFrame) -> tuple[str, DataFrame]:
    """``("enriched", table)`` when the enriched table exists (catalog
    name or Parquet path), else ``("raw", raw)``."""
    if _is_path(enriched):
        if _exists(spark, enriched):
            return "enriched", spark.read.parquet(enriched)
    elif spark.catalog.tableExists(enriched):
        return "enriched", spark.table(enriched)
    return "raw", raw
