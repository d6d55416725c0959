"""Operator 5: exact deduplication by a 128-bit content hash.

Rows are grouped on (128-bit hash, text). The hash decides the shuffle
partition and settles nearly every key comparison; the text in the key makes
the byte comparison part of the grouping, so two texts whose hashes collide
stay in different groups. Copies are combined on the map side: of a text that
holds a third of all rows, every map task sends one row.

Defined cases: NULL text counts as empty; NULL ids lose to any other id and
are the ``keep_id`` only of a group that has nothing else; rows that repeat an
id and a text all count in ``group_size`` and share one decision; an empty
table gives an empty result; extra columns are ignored by ``exact_groups``
and returned unchanged by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinelens.llm.common import materialise, text_or_empty


def md5_128(text: Column) -> Column:
    """The 16 bytes of the MD5 digest of the UTF-8 text."""
    return F.unhex(F.md5(text.cast("binary")))


def _hashed(docs: DataFrame, id_col: str, text_col: str, hash128: Callable[[Column], Column]) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), hash128(text).alias("h"), text.alias("text"))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128: Callable[[Column], Column] = md5_128
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The largest id of equal texts stays. The groups are written without their
    texts; a document finds its group by the hash alone, in a join of narrow
    rows whose hot keys AQE splits. Only hashes that two different texts share
    (none, unless ``hash128`` is weak) are joined on hash and text.
    """
    rows = _hashed(docs, id_col, text_col, hash128)
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    groups = materialise(_grouped(rows).select("h", "keep_id", "group_size", digest), "groups")
    texts = groups.groupBy("h").agg(F.count(F.lit(1)).alias("n_texts"))
    collided = materialise(texts.filter("n_texts > 1").select("h"), "collided")

    single = groups.join(collided, "h", "left_anti")
    members = rows.select("doc_id", "h").join(single, "h")
    doubtful = rows.join(collided, "h", "left_semi")
    exact = doubtful.join(_grouped(doubtful).withColumn("text_sha256", digest), ["h", "text"])
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return members.select(*columns).unionByName(exact.select(*columns))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128: Callable[[Column], Column] = md5_128
) -> DataFrame:
    """The whole row that stays of each group, with the columns of ``docs``.

    Same groups as ``exact_groups``; rows that tie on the id as well are
    ordered by a hash of the whole row, so exactly one row stays.
    """
    whole = F.struct(*[docs[c] for c in docs.columns])
    text = text_or_empty(text_col)
    order = F.struct(docs[id_col].isNotNull(), docs[id_col], F.xxhash64(F.to_json(whole)))
    rest = F.struct(*[F.when(docs[text_col].isNotNull(), True).alias(c) if c == text_col else docs[c] for c in docs.columns])
    rows = docs.select(hash128(text).alias("h"), text.alias("t"), order.alias("o"), rest.alias("r"))
    best = rows.groupBy("h", "t").agg(F.max_by("r", "o").alias("r"))
    back = {c: F.when(F.col("r")[c], F.col("t")).cast(docs.schema[c].dataType) if c == text_col else F.col("r")[c] for c in docs.columns}
    return best.select(*[expr.alias(c) for c, expr in back.items()])
