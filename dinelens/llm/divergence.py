"""Source divergence audit by chunk factorization.

White-space chunks are counted per document and combined per task; every
globally distinct chunk, with its counts, is cut into terms once; these are
added up per language and source. A term is kept if at least
three documents of its language hold it. How a source's share of the kept terms
departs from the others' and from the language's is then integer arithmetic.

Documents are rows: repeated rows count each. NULL text, language or source
reads as ''. A document without terms still makes its group known. An empty
table gives no rows. Extra columns are ignored.

Exact at any size: a chunk's row knows how many documents of its group hold it
and the first and last of them. Three or more settle it; rows of one or two
documents name them all, so a term has a third document exactly if some row
names one that is neither the first nor the last of the term's rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dinelens.llm.common import materialise, text_or_empty

# Fixed values of the audit.
LEAST_DOCS = 3
SCALE = 1_000_000_000
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MAX_HELD = 1_000_000  # counts held by a task before it writes them out
MAX_CELLS = 1_000_000  # terms x sources of one block of the pair sums
MANY = -1


def chunk_counts(docs: DataFrame) -> DataFrame:
    """Counts of chunks as tasks found them: ``place, chunk, n, seen``.

    ``place`` spells language and source. ``seen`` is the number of a document
    with the chunk, or ``MANY`` where a task has met three; of two documents
    each has a row. A document's number is its place in the scan, so ``docs``
    must be a stored table, which a lost task reads again alike.
    """
    schema = pa.schema([("place", pa.string()), ("chunk", pa.string()), ("n", pa.int64()), ("seen", pa.int64())])
    low = (1 << 40) - 1

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for place, (found, again) in held.items():
            keys = list(found)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                codes = [found[c] for c in part]
                seen = [MANY if again.get(c) == MANY else code >> 40 for c, code in zip(part, codes, strict=True)]
                yield pa.record_batch([pa.array([place] * len(part), pa.string()), pa.array(part, pa.string()), pa.array([c & low for c in codes]), pa.array(seen)], schema=schema)
            two = [(c, number) for c, number in again.items() if number != MANY]
            if two:
                yield pa.record_batch(
                    [pa.array([place] * len(two), pa.string()), pa.array([c for c, _ in two], pa.string()), pa.array([0] * len(two)), pa.array([x for _, x in two])],
                    schema=schema,
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        # By place: chunk -> number of its first document and count in one integer; chunk -> its second document.
        held: dict[bytes, tuple[dict[bytes, int], dict[bytes, int]]] = {}
        size = 0
        for batch in batches:
            texts, places = (batch.column(i).cast(pa.binary()).to_pylist() for i in range(2))
            for text, place in zip(texts, places, strict=True):
                number += 1
                first = number << 40
                if place not in held:
                    held[place] = {}, {}
                found, again = held[place]
                size -= len(found)
                # Bytes split at ASCII white space alone; other white space is part of terms.
                for chunk, n in Counter(text.split()).items():
                    if chunk in found:
                        found[chunk] += n
                        again[chunk] = MANY if chunk in again else number
                    else:
                        found[chunk] = first | n
                size += len(found)
                if size > MAX_HELD:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    lang, source = text_or_empty("lang"), text_or_empty("source")
    place = F.concat(F.length(lang).cast("string"), F.lit(":"), lang, source)
    return docs.select(text_or_empty().alias("text"), place.alias("place")).mapInArrow(count, "place string, chunk string, n long, seen long")


def _cut(chunks: DataFrame) -> DataFrame:
    """Rows of ``chunk``, once for each of its terms (``term``)."""
    cut = F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return chunks.select("*", F.explode(cut).alias("term"))


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """``chunk, term, times`` of distinct chunks: each is cut into terms once."""
    return _cut(chunks.select("chunk").distinct()).groupBy("chunk", "term").agg(F.count(F.lit(1)).alias("times"))


def kept_terms(counts: DataFrame) -> DataFrame:
    """``lang, source, term, n, n_lang, first`` of the kept terms.

    ``n`` is the term's occurrences in the group, ``n_lang`` in the language;
    ``first`` marks one row per language and term.

    The counts are dealt by chunk once: that shuffle serves the sums per group
    and the distinct chunks.
    """
    one = F.when(F.col("seen") != MANY, F.col("seen"))
    sums = counts.repartition("chunk").groupBy("place", "chunk")
    sums = sums.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("seen") == MANY, LEAST_DOCS).otherwise(1)).alias("docs"), F.min(one).alias("least"), F.max(one).alias("most"))
    # A chunk's places are put into one row, at most one for each group, so each chunk is cut into terms once.
    chunks = sums.groupBy("chunk").agg(F.collect_list(F.struct("place", "n", "docs", "least", "most")).alias("of"))
    # A term that a chunk has repeatedly has a row for each time; only n is summed.
    rows = _cut(chunks).select("term", F.inline("of"))
    size = F.substring_index("place", ":", 1).cast("int")
    start = F.instr("place", ":") + 1
    rows = rows.select(
        F.substring("place", start, size).alias("lang"),
        F.substring("place", start + size, F.length("place")).alias("source"),
        "term",
        "n",
        "docs",
        "least",
        "most",
    )
    term = Window.partitionBy("lang", "term")
    rows = rows.repartition("lang", "term").withColumn("a", F.min("least").over(term)).withColumn("b", F.max("most").over(term))
    other = (F.col("docs") >= LEAST_DOCS) | ~F.col("least").isin(F.col("a"), F.col("b")) | ~F.col("most").isin(F.col("a"), F.col("b"))
    groups = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.max(F.coalesce(other, F.lit(False))).alias("enough"))
    groups = groups.withColumn("n_lang", F.sum("n").over(term)).withColumn("enough", F.max("enough").over(term))
    groups = groups.withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    return groups.filter("enough").select("lang", "source", "term", "n", "n_lang", "first")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), in decimals: long products overflow."""
    wide = "decimal(19,0)"
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast(wide), (total + terms).cast(wide))).cast("long")


def _pairs_of_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of floor((p-q)^2 / q) over the terms of a block, for each two sources.

    Rows without a term name a source and its share of an absent term. The
    squares stay below 2^63: shares add up to little more than SCALE, and so
    do the sums of their squares to SCALE^2.
    """
    known = rows[rows["term"].isna()].sort_values("source")
    sources, absent = known["source"].to_numpy(object), known["p"].to_numpy(np.int64)
    held = rows[rows["term"].notna()]
    codes, terms = pd.factorize(held["term"])
    p = np.repeat(absent[:, None], max(len(terms), 1), axis=1)
    if len(held):
        place = pd.Series(np.arange(len(sources)), index=sources)
        p[place[held["source"]].to_numpy(), codes] = held["p"].to_numpy(np.int64)
    made = []
    for j in range(len(sources)):
        gap = p - p[j]
        gap *= gap
        gap //= p[j]
        value = gap.sum(axis=1) if len(held) else np.zeros(len(sources), np.int64)
        other = np.arange(len(sources)) != j
        made.append(pd.DataFrame({"source": sources[other], "item": sources[j], "value": value[other]}))
    out = pd.concat(made, ignore_index=True) if made else pd.DataFrame({"source": [], "item": [], "value": []})
    out.insert(0, "lang", rows["lang"].iloc[0])
    return out.astype({"value": "int64"})


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the divergence of each source from each other of its language.

    The terms of a language are dealt into blocks of at most about
    ``MAX_CELLS`` terms x sources; a block returns one sum per two sources.
    """
    blocks = F.ceil(F.col("v") * F.col("sources") / F.lit(MAX_CELLS)).cast("int")
    known = groups.withColumn("blocks", F.greatest(blocks, F.lit(1)))
    markers = known.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), share(F.lit(0), F.col("total"), F.col("v")).alias("p"))
    cells = kept.join(known, ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p")
    )
    sums = markers.unionByName(cells).groupBy("lang", "block").applyInPandas(_pairs_of_block, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of the terms that a source has more of than its language."""
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("n_lang"), F.col("total_lang"), F.col("v"))
    rows = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    gap = F.col("p") - F.col("q")
    return rows.filter("p > q").select("lang", "source", "item", F.call_function("div", gap * gap, F.col("q")).alias("value"))


def audit(docs: DataFrame, top_terms: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: all pairs of sources, and the ``top_terms`` of each source."""
    kept = materialise(kept_terms(chunk_counts(docs)), "kept_terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count_if("first").alias("v"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")).distinct()
    many = known.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = known.join(many, "lang").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "total_lang"])
    # A language without kept terms has no shares; its sums are 0 whatever these are.
    groups = materialise(groups.withColumn("total", F.when(F.col("v") == 0, 1).otherwise(F.col("total"))), "groups")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair_values(kept, groups).withColumn("part", F.lit("pair")).withColumn("rank", rank)
    terms = term_values(kept, groups).withColumn("rank", rank).filter(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    return pairs.select(*columns).unionByName(terms.select(*columns))
