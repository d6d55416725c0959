"""CSV ingest that sets bad records aside instead of failing.

Columns are matched by the names in each file's header, so files may hold them
in any order and may have more. A record that has another number of fields than
its header, or a value that isn't of its column's type, goes to the rejects with
its file, its number in the file (1 is the first below the header), a reason and
its text. Every record is in exactly one of the two results. A file whose header
lacks a column, or has one twice, is rejected as a whole, record by record.

Files with the same header are read together, by Spark's CSV reader; the headers
themselves come from one pass over the lines. Record numbers are worked out
for rejects alone: a split's records are counted, and a reject's number is its
place in its split behind the splits before it.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinelens.sources.catalog import CSV_NULL, csv_options

MAX_HEADERS = 1000  # different headers of one ingest; more are an error
REJECTS = "file string, record long, reason string, text string"


@dataclass
class Ingest:
    rows: DataFrame
    rejects: DataFrame


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of each header line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    first = lines.filter("at = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "n").alias("header"))
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).limit(MAX_HEADERS + 1).collect()
    if len(found) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers under {path}")
    return {r["header"]: r["files"] for r in sorted(found, key=lambda r: r["header"])}


def _names(header: str) -> list[str]:
    return [n.strip() for n in next(csv.reader([header.lstrip("﻿")]), [])]


def _of_header(spark: SparkSession, header: str, files: list[str], schema: T.StructType, null_value: str, multi_line: bool) -> Ingest:
    names = _names(header)
    lacking = [f.name for f in schema if f.name not in names]
    double = sorted({f.name for f in schema if names.count(f.name) > 1})
    read_as = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("_bad", T.StringType())])
    options = csv_options(null_value) | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "header": "true", "multiLine": str(multi_line).lower()}
    options["columnPruning"] = "false"  # a record's fields are counted only where all of them are parsed
    raw = spark.read.schema(read_as).options(**options).csv(files)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    raw = raw.select("*", *place).withColumn("_n", F.monotonically_increasing_id())

    if lacking or double:
        reason = F.lit("header lacks: " + ", ".join(lacking) if lacking else "header repeats: " + ", ".join(double))
        values = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    else:
        source = {f.name: F.col(f"_c{names.index(f.name)}") for f in schema}
        cast = {f.name: source[f.name].try_cast(f.dataType) for f in schema}
        wrong = [F.when(source[f.name].isNotNull() & cast[f.name].isNull(), F.lit(f.name)) for f in schema if f.dataType != T.StringType()]
        wrong_names = F.concat_ws(", ", *wrong) if wrong else F.lit("")
        reason = F.when(F.col("_bad").isNotNull(), "wrong number of fields").when(wrong_names != "", F.concat(F.lit("bad value: "), wrong_names))
        values = [cast[f.name].alias(f.name) for f in schema]
    text = F.coalesce("_bad", F.to_csv(F.struct(*[f"_c{i}" for i in range(len(names))]), csv_options(null_value)))
    judged = raw.select(*values, reason.alias("_reason"), "_file", "_block", "_n", text.alias("_text"))

    splits = raw.groupBy("_file", "_block").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_size")
    rejects = judged.filter(F.col("_reason").isNotNull()).join(splits, ["_file", "_block"])
    record = F.col("_before") + F.col("_n") - F.col("_first") + 1
    rejects = rejects.select(F.col("_file").alias("file"), record.alias("record"), F.col("_reason").alias("reason"), F.col("_text").alias("text"))
    return Ingest(judged.filter(F.col("_reason").isNull()).select(*schema.names), rejects)


def ingest(spark: SparkSession, path: str, schema: T.StructType, null_value: str = CSV_NULL, multi_line: bool = False) -> Ingest:
    """Good rows (``schema``) and rejects of the CSV files under ``path``.

    ``multi_line`` allows line breaks inside quotes; such a file is read by one
    task.
    """
    parts = [_of_header(spark, h, files, schema, null_value, multi_line) for h, files in headers(spark, path).items()]
    rows, rejects = spark.createDataFrame([], schema), spark.createDataFrame([], REJECTS)
    for p in parts:
        rows, rejects = rows.unionByName(p.rows), rejects.unionByName(p.rejects)
    return Ingest(rows, rejects)
