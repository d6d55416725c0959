"""Exactly-once appends by a ledger of batches (A5, streams).

``append_batch`` writes a batch's new rows to a partition of its own,
``data/batch_id=<id>``, and then one record to ``ledger/batch_id=<id>`` with the
number of rows and the files written. Readers see the batches that the ledger
names. So whatever step a crash interrupts, running the batch again ends in the
same table: before the record, its partition is written anew and was never
seen; after it, the batch is skipped.

Keys are compared null-safely: NULL is a key like any other and is appended
once. One writer per table at a time, as with a stream's ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinelens.sources import catalog

RECORD = T.StructType(
    [
        T.StructField("row_count", T.LongType()),
        T.StructField("files", T.ArrayType(T.StringType())),
        T.StructField("batch_id", T.LongType()),
    ]
)


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def batches(spark: SparkSession, target: str) -> DataFrame:
    """The committed batches: ``row_count, files, batch_id``."""
    path = f"{target}/ledger"
    if not catalog._exists(spark, path):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).parquet(path)


def read_table(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The rows of the committed batches, with their ``batch_id``."""
    path = f"{target}/data"
    if not catalog._exists(spark, path):
        return spark.createDataFrame([], _with_batch(schema))
    rows = spark.read.schema(_with_batch(schema)).parquet(path)
    return rows.join(batches(spark, target).select("batch_id"), "batch_id", "left_semi").select(*schema.names, "batch_id")


def write_batch(rows: DataFrame, target: str, keys: list[str], batch_id: int) -> None:
    """First half: the batch's new rows into its own partition (not visible yet)."""
    known = read_table(rows.sparkSession, target, rows.schema).filter(F.col("batch_id") != batch_id)
    new = catalog.new_rows(rows, known, keys).withColumn("batch_id", F.lit(batch_id).cast("long"))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{target}/data")


def record_batch(spark: SparkSession, target: str, schema: T.StructType, batch_id: int) -> int:
    """Second half: the record that makes the batch visible; its rows."""
    written = spark.read.schema(_with_batch(schema)).parquet(f"{target}/data").filter(F.col("batch_id") == batch_id)
    per_file = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    record = per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.sort_array(F.collect_list("file")).alias("files"))
    record = record.withColumn("batch_id", F.lit(batch_id).cast("long"))
    record.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{target}/ledger")
    return batches(spark, target).filter(F.col("batch_id") == batch_id).first()["row_count"]


def append_batch(rows: DataFrame, target: str, key: str | list[str], batch_id: int) -> int:
    """Append the batch's rows whose key is not in the table; the number appended.

    A batch that the ledger holds already is left alone: its number is returned.
    """
    target = target.rstrip("/")
    spark = rows.sparkSession
    done = batches(spark, target).filter(F.col("batch_id") == batch_id).first()
    if done is not None:
        return done["row_count"]
    write_batch(rows, target, [key] if isinstance(key, str) else list(key), batch_id)
    return record_batch(spark, target, rows.schema, batch_id)
