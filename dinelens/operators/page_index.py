"""Random access to the pages of a sorted listing.

The listing is sorted once by ranges of its order and written, one partition
per range, with every row's place in its partition. Beside it lies a table with
each partition's row count and the number of rows before it. A page is then the
few partitions that hold its row numbers, found in that table, and of these
only the row groups whose places overlap: page 1,000,000 costs what page 1 does,
and the total count is a sum over the partitions.

The order must be total, as for ``paging.page_rows``. The table of starts is
written last, so a build that was cut short can't be opened. A build makes a new
folder; an opened index reads that one state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from dinelens.operators.paging import Page

PART, PLACE = "_part", "_place"
STARTS = "part int, n long, first long"
_PLACE_BITS = 33  # of ``monotonically_increasing_id``: the row's place in its partition


@dataclass(frozen=True)
class PageIndex:
    spark: SparkSession
    path: str
    schema: T.StructType
    order: tuple[Column, ...]

    @classmethod
    def build(cls, df: DataFrame, order: list[Column], path: str, parts: int | None = None) -> PageIndex:
        """Write ``df`` by ``order`` under ``path``; ``parts`` partitions, or as many as Spark's sort makes."""
        spark = df.sparkSession
        ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order) if parts else df.orderBy(*order)
        numbered = ranged.withColumn("_id", F.monotonically_increasing_id())
        part = F.shiftright("_id", _PLACE_BITS).cast("int")
        place = F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
        rows = numbered.select(*df.columns, place.alias(PLACE), part.alias(PART))
        rows.write.partitionBy(PART).parquet(f"{path}/rows")
        index = cls(spark, path, df.schema, tuple(order))
        counts = index._rows().groupBy(F.col(PART).alias("part")).agg(F.count(F.lit(1)).alias("n"))
        # One row per partition of the sort, so the ordered window over all is small.
        before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
        counts.select("part", "n", F.coalesce(before, F.lit(0)).alias("first")).coalesce(1).write.parquet(f"{path}/starts")
        return index

    def _rows(self) -> DataFrame:
        names = T.StructType([*self.schema.fields, T.StructField(PLACE, T.LongType()), T.StructField(PART, T.IntegerType())])
        return self.spark.read.schema(names).parquet(f"{self.path}/rows")

    def _starts(self) -> DataFrame:
        return self.spark.read.schema(STARTS).parquet(f"{self.path}/starts")

    def page(self, page: Page) -> DataFrame:
        """The page's rows in order, with their ``row_number`` from 1."""
        first, end = page.offset, page.offset + page.size
        held = self._starts().filter((F.col("first") < end) & (F.col("first") + F.col("n") > first))
        # At most ``page.size`` partitions: each of them holds a row of the page.
        parts = [(r["part"], r["first"]) for r in held.collect()]
        rows = self._rows().filter(F.col(PART).isin([p for p, _ in parts]))
        inside, number = F.lit(False), F.lit(None).cast("long")
        for p, at in parts:
            here = F.col(PART) == p
            inside = inside | (here & (F.col(PLACE) >= max(0, first - at)) & (F.col(PLACE) < end - at))
            number = F.when(here, F.col(PLACE) + (at + 1)).otherwise(number)
        rows = rows.filter(inside).select(number.alias("row_number"), *self.schema.names)
        return rows.orderBy("row_number").limit(page.size)

    def info(self, page: Page) -> DataFrame:
        """As ``paging.page_info``, without counting the rows again."""
        return self._starts().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_count")).select(
            "total_count",
            F.greatest(F.lit(1), F.ceil(F.col("total_count") / F.lit(page.size))).alias("total_pages"),
            F.lit(page.page).alias("page"),
            F.lit(page.size).alias("page_size"),
        )
