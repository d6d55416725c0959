"""Operator 4: benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document may be long, so the similarity is the
containment |item & document| / |item| of distinct five-word shingles. Both
sides are partitioned by size: a document of ``n`` shingles lies in class
``floor(log2(n))`` and meets only items whose least overlap fits that class.
The sketch of an item is its ``q - ceil(t q) + 1`` smallest shingle hashes (a
bottom-k MinHash). A document that contains ``ceil(t q)`` of ``q`` shingles
misses too few to miss the whole sketch, so the search loses nothing; exact
containment of the shingle texts then decides.

Only DataFrame functions: shingles are five shifted slices of the word array,
exploded together and hashed inside whole-stage codegen. The sketches are
written first, so Spark broadcasts them only if they are small.

Words are lower-cased runs of letters and digits. Fewer than five words make
one shingle of the whole sequence; no words make none, and match nothing.

Defined cases: NULL text counts as empty; rows that share id and text share
one decision, rows that share an id alone don't; NULL ids are ids like others;
NULL item ids too; equal items are all reported; extra columns are ignored;
an empty table on either side gives no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dinelens.llm.common import materialise, text_or_empty

NOT_WORD = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD, -1), lambda w: w != "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), _words(text).alias("words"))


def _shingles(rows: DataFrame, keep: list[str], width: int) -> DataFrame:
    """A row for each shingle: ``keep`` and the words ``w0`` .. of it."""
    count = F.greatest(F.size("words") - (width - 1), F.lit(1))
    shifted = [F.slice("words", F.lit(i + 1), count).alias(f"w{i}") for i in range(width)]
    return rows.select(*keep, F.inline(F.arrays_zip(*shifted)))


def _size_class(shingles: Column) -> Column:
    return F.floor(F.log2(shingles)).cast("int")


def _of(width: int) -> list[Column]:
    return [F.col(f"w{i}") for i in range(width)]


def item_sketches(items: DataFrame, threshold: float, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct shingles of every item, and the sketch rows among them."""
    rows = items.select(F.col(id_col).alias("item_id"), _words(text_or_empty(text_col)).alias("words"))
    found = _shingles(rows, ["item_id"], width).select(
        "item_id", F.concat_ws(" ", *_of(width)).alias("shingle"), F.xxhash64(*_of(width)).alias("hash")
    )
    each = found.distinct()
    per_item = W.partitionBy("item_id")
    sized = each.withColumn("q", F.count(F.lit(1)).over(per_item))
    # ceil() of a binary product may lie one too high (0.8 * 5 = 4.000...); a
    # little less first keeps the bound safe.
    least = F.greatest(F.ceil(F.col("q") * F.lit(threshold) - F.lit(1e-9)), F.lit(1))
    sized = sized.withColumn("least", least)
    ranked = sized.withColumn("rank", F.row_number().over(per_item.orderBy("hash", "shingle")))
    all_shingles = materialise(ranked.select("item_id", "shingle", "hash", "q", "least", "rank"), "item_shingles")
    sketch = all_shingles.filter("rank <= q - least + 1").select("item_id", "hash", _size_class(F.col("least")).alias("min_class"))
    return all_shingles, materialise(sketch, "item_sketches")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    width: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``id, t, item_id, shared, q, containment``: every item whose shingles the document holds.

    ``t`` is a hash of the document's text, so that rows repeating an id with
    another text stay apart.
    """
    shingles, sketch = item_sketches(items, threshold, width, item_id_col, item_text_col)
    rows = _keyed(docs, id_col, text_col)
    rows = rows.withColumn("size_class", _size_class(F.greatest(F.size("words") - (width - 1), F.lit(1))))
    hashed = _shingles(rows, ["id", "t", "size_class"], width).select("id", "t", "size_class", F.xxhash64(*_of(width)).alias("hash"))
    hits = hashed.join(sketch, "hash").filter("size_class >= min_class")
    c = hits.groupBy(F.col("id").alias("cid"), F.col("t").alias("ct")).agg(F.collect_set(F.struct("item_id")).alias("item_ids"))
    c = materialise(c, "candidates")

    # The documents with a candidate come again, this time with the words.
    again = _keyed(docs, id_col, text_col)
    again = again.join(c, again["id"].eqNullSafe(c["cid"]) & (again["t"] == c["ct"]))
    texts = _shingles(again, ["id", "t", "item_ids"], width)
    texts = texts.select("id", "t", "item_ids", F.concat_ws(" ", *_of(width)).alias("shingle"))
    s = shingles.select(F.col("item_id").alias("sid"), F.col("shingle").alias("stext"), "q", "least")
    same = texts.join(s, F.col("shingle") == F.col("stext"))
    same = same.filter(F.array_contains("item_ids", F.struct(F.col("sid").alias("item_id"))))
    shared = same.select("id", "t", "sid", "q", "least", "shingle").distinct()
    counted = shared.groupBy("id", "t", "sid", "q", "least").agg(F.count(F.lit(1)).alias("shared"))
    return counted.filter("shared >= least").select(
        "id", "t", F.col("sid").alias("item_id"), "shared", "q", (F.col("shared") / F.col("q")).alias("containment")
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, contaminated, n_items, item_ids, max_containment``.

    ``item_ids`` lists the contained items in ascending order, comma-joined.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = materialise(contained_items(docs, items, **options), "contained")
    per_doc = found.groupBy(F.col("id").alias("fid"), F.col("t").alias("ft")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("items"),
        F.max("containment").alias("most"),
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("t"))
    joined = rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["fid"]) & (rows["t"] == per_doc["ft"]), "left")
    return joined.select(
        "doc_id",
        F.col("n").isNotNull().alias("contaminated"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.lit("")).alias("item_ids"),
        F.coalesce("most", F.lit(0.0)).alias("max_containment"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = contained_items(docs, items, **options).select(F.col("id").alias("_llm_id"), F.col("t").alias("_llm_t")).distinct()
    bad = materialise(bad, "contaminated")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_llm_id"]) & (F.xxhash64(text) == bad["_llm_t"]), "left_anti")
