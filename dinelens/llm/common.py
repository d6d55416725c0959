"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    local session (one machine, one JVM) gets a temporary folder; any other
    master is an error.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs one read and not the jobs
    before it, and gives Catalyst the real size of the table: joins with it
    are broadcast only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fields(df: DataFrame, **named: str) -> DataFrame:
    """The given columns under new names; extra and clashing columns go."""
    return df.select(*[df[old].alias(new) for new, old in named.items()])


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids`` (column ``doc_id``, NULL matches NULL).

    All columns of ``docs`` are returned; the one column of ``ids`` is renamed
    first, so names can't clash.
    """
    gone = ids.select(F.col("doc_id").alias("_llm_gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_llm_gone"]), "left_anti")


def computed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and the columns, each row's computed once.

    Catalyst writes the expression of a column wherever the column is used,
    inside lambdas too, but not below a generator.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


BLOCK = 256


def running(items: Column, at: Column, out_type: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """The outputs of a pass over the array column ``items`` with a running value.

    ``step(at, item)`` gives the next value, whether there is an output, and the
    output. Appending copies an array, so outputs are appended within blocks,
    and blocks to each other: the copies stay few for very long arrays.
    ``items`` must be a plain column (``computed``).
    """
    none, no_blocks = F.expr(f"cast(array() as {out_type})"), F.expr(f"cast(array() as array<{out_type}>)")

    def one(acc: Column, x: Column) -> Column:
        after, keep, out = step(acc["at"], x)
        return F.struct(after.alias("at"), F.when(keep, F.array_append(acc["out"], out)).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, number: Column) -> Column:
        of = F.aggregate(F.slice(items, number * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return F.struct(of["at"].alias("at"), F.array_append(acc["out"], of["out"]).alias("out"))

    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    found = F.aggregate(numbers, F.struct(at.alias("at"), no_blocks.alias("out")), block, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(items) > 0, found).otherwise(none)
