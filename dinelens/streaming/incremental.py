"""Review enrichment as an incremental Structured Streaming job.

New raw review files land in a directory; the stream picks up only files
it has not seen (tracked in its checkpoint), and each micro-batch runs the
batch enrichment step: anti-join against the gold table, score, parse,
append. ``trigger(availableNow=True)`` processes everything pending and
stops, so the same job serves scheduled runs; the gold table's key check
keeps a replayed micro-batch from adding rows twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dinelens import schemas
from dinelens.operators import reviews
from dinelens.operators.scoring import Scorer
from dinelens.plans.jobs import stable
from dinelens.session import checkpoint_dir
from dinelens.sources import catalog, ledger


def enrich_micro_batch_once(batch: DataFrame, target: str, scorer: Scorer, batch_id: int) -> int:
    """One micro-batch into a table with a ledger (``ledger.read_table``): a
    batch that was recorded isn't scored again, one that was cut off before is
    written anew."""
    spark = batch.sparkSession
    done = ledger.batches(spark, target).filter(F.col("batch_id") == batch_id).first()
    if done is not None:
        return done["row_count"]
    schema = T.StructType([f for f in schemas.GOLD_REVIEW_SENTIMENTS if f.name != "processed_at"])
    gold = ledger.read_table(spark, target, schema)
    enriched = stable(reviews.enrich_reviews(batch, scorer, done=gold))
    return ledger.append_batch(reviews.sentiment_rows(enriched, with_timestamp=False), target, "review_id", batch_id)


def enrich_micro_batch(batch: DataFrame, gold_path: str, scorer: Scorer) -> int:
    """One micro-batch: enrich the batch's pending reviews; rows appended."""
    spark = batch.sparkSession
    gold = catalog.ensure_table(spark, gold_path, schemas.GOLD_REVIEW_SENTIMENTS)
    enriched = stable(reviews.enrich_reviews(batch, scorer, done=gold))
    return catalog.append_new(reviews.sentiment_rows(enriched), gold_path, "review_id")


def start_review_enrichment(
    spark: SparkSession,
    raw_dir: str,
    gold_path: str,
    scorer: Scorer,
    schema: T.StructType = schemas.RAW_REVIEWS,
    checkpoint_location: str | None = None,
    max_files_per_trigger: int | None = None,
    exactly_once: bool = False,
) -> StreamingQuery:
    """Start the stream over Parquet files in ``raw_dir``.

    The checkpoint goes to ``checkpoint_location`` or a folder under the
    session's ``spark.checkpoint.dir`` (shared storage on a cluster). With
    ``exactly_once``, ``gold_path`` is a table with a ledger of batches.
    """
    location = checkpoint_location or checkpoint_dir(spark).rstrip("/") + "/review_enrichment"
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(raw_dir)

    def each(batch: DataFrame, epoch_id: int) -> None:
        if exactly_once:
            enrich_micro_batch_once(batch, gold_path, scorer, epoch_id)
        else:
            enrich_micro_batch(batch, gold_path, scorer)

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", location)
        .trigger(availableNow=True)
        .start()
    )
