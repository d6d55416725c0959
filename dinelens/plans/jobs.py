"""Batch jobs that write tables: the warehouse build and the two review
pipelines (A3-A5, E8, E9, E15).

Each pipeline: read what is already done, pick the pending work with a
left-anti join, score, parse, append only new keys. Model replies are
expensive and need not be deterministic, so the scored frame is
checkpointed (reliably, into ``spark.checkpoint.dir``) before it is used
twice (report + append): a lost executor then re-reads the checkpoint
instead of calling the model again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinelens import schemas
from dinelens.operators import insights as ins
from dinelens.operators import reviews
from dinelens.operators.scoring import Scorer
from dinelens.plans.warehouse import BUILT_TABLES, Warehouse
from dinelens.session import checkpoint_dir
from dinelens.sources import catalog


@dataclass
class RunReport:
    processed: int
    failed: int
    appended: int


def build_warehouse(w: Warehouse, out_dir: str) -> dict[str, DataFrame]:
    """A3: write staging, marts and gold as Parquet tables under ``out_dir``
    (``Warehouse.from_built`` opens them).

    ``stg_orders`` is partitioned by order year so that trend queries over
    a date range prune files. Returns scans of the written tables.
    """
    out = out_dir.rstrip("/")
    written = {}
    for name in BUILT_TABLES:
        df, by = getattr(w, name), None
        if name == "stg_orders":
            df, by = df.withColumn("order_year", F.year("order_date")), ["order_year"]
        written[name] = catalog.materialize(df, f"{out}/{name}", by)
    return written


def stable(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint, so that its rows (model replies)
    stay the same after the loss of an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def run_review_enrichment(
    raw: DataFrame, gold_path: str, scorer: Scorer, batch_size: int | None = None
) -> RunReport:
    """E8 + E9 as a job: enrich all pending reviews (or one batch, if a size
    is given) into ``gold_path``."""
    spark = raw.sparkSession
    gold = catalog.ensure_table(spark, gold_path, schemas.GOLD_REVIEW_SENTIMENTS)
    enriched = stable(reviews.enrich_reviews(raw, scorer, done=gold, batch_size=batch_size))
    counts = reviews.enrich_report(enriched).first()
    appended = catalog.append_new(reviews.sentiment_rows(enriched), gold_path, "review_id")
    return RunReport(counts["enriched"] + counts["failed"], counts["failed"], appended)


def run_restaurant_insights(
    restaurants: DataFrame,
    raw_reviews: DataFrame,
    insights_path: str,
    scorer: Scorer,
    min_reviews: int = ins.MIN_REVIEWS,
    top_n: int | None = None,
    per_request: int = ins.REVIEWS_PER_REQUEST,
    max_themes: int | None = None,
    template: str = ins.DEFAULT_TEMPLATE,
) -> RunReport:
    """E15 as a job: analyse all pending restaurants into ``insights_path``
    (only the ``top_n`` with most comments, if asked for).

    A failed restaurant is only reported; the next run retries it, since
    it is still missing from the table.
    """
    spark = restaurants.sparkSession
    done = catalog.ensure_table(spark, insights_path, schemas.GOLD_RESTAURANT_INSIGHTS)
    built = stable(
        ins.insights_build(restaurants, raw_reviews, scorer, done, min_reviews, top_n, per_request, max_themes, template)
    )
    counts = ins.insights_report(built).first()
    appended = catalog.append_new(ins.insight_rows(built), insights_path, "restaurant_id")
    return RunReport(counts["analyzed"] + counts["failed"], counts["failed"], appended)
