"""Operator 2: language identification by fusing evidence, naive Bayes style.

For a record (a page, a document) and a language l

    log P(l | all) = log P(text | l) + log P(declared | l) + log P(address | l) + log P(l | host) + c

* text: hashed byte-trigram model, trained on a bounded sample of labelled
  documents (held-out ones excluded), applied to the whole text and tempered
  to at most ``EVIDENCE`` trigrams, since trigrams are not independent;
* declared: the ``lang`` attribute of the markup;
* address: suffix of the host (two labels where a generic one stands before a
  country's, as in ``co.uk``) and a language-like first path segment;
* host: prior smoothed towards the host's domain, and that towards all records.

How reliable a declaration or an address is comes from grouped sums of the
text posteriors of all records (``P(value | l)``), as do host and domain
priors. These tables are written first; records join them by broadcast while
they are small and by shuffles with AQE's skew splitting when not.

Defined cases: NULL or empty text gives no text evidence; a missing attribute,
address or host gives none of that kind; with no evidence the overall prior
decides, ties go to the first language in alphabetical order; NULL ids and
repeated rows are records of their own; extra columns are ignored; an empty
table gives an empty result; without any labelled text all languages are
NULL.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinelens.llm.common import materialise
from dinelens.llm.html_text import host_of

TABLE = 1 << 16
MAX_TRAIN_ROWS = 30_000
EVIDENCE = 60.0
SMOOTH = 0.5
PULL = 20.0  # records that a wider prior counts for

HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", re.S | re.I)
TAGS = re.compile(r"<[^<>]*>")
# Labels under which countries' registries hand out names.
GENERIC = "ac co com edu go gob gov mil ne net nom or org sch".split()
SUFFIX = rf"(?:(?:{'|'.join(GENERIC)})\.[a-z]{{2}}|[a-z][a-z0-9-]*)"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trigram_codes(text: str) -> np.ndarray:
    """Hashes of the byte trigrams of the lower-cased text with white space runs made one space."""
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return ((code ^ (code >> np.uint32(15))) & np.uint32(TABLE - 1)).astype(np.int64)


def markup_text(source: str) -> str:
    return html_lib.unescape(TAGS.sub(" ", HIDDEN.sub(" ", source)))


# -------------------------------------------------------------- the text model


def train_text(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of trigram codes, from rows of ``doc_id, text, lang``.

    The sample is taken by a hash of the id, at most ``max_rows`` rows in
    expectation; the driver gets at most ``TABLE`` counts for each language of
    the sample, all of which are kept (a quarter of a megabyte each).
    """
    rows = docs.filter(docs["lang"].isNotNull() & docs["text"].isNotNull() & ~held_out(docs["doc_id"]))
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    n = rows.count()
    share = F.abs(F.xxhash64("doc_id", F.lit(3)) / F.lit(2.0**63)) <= min(1.0, max_rows / max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = trigram_codes(text)
                if lang not in counts:
                    counts[lang] = np.zeros(TABLE, np.int64)
                counts[lang] += np.bincount(codes, minlength=TABLE)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "code", "n"])

    counted = rows.filter(share).select("lang", "text").mapInArrow(run, "lang string, code int, n long")
    summed = materialise(counted.groupBy("lang", "code").agg(F.sum("n").alias("n")), "trigrams")
    names = sorted(r["lang"] for r in summed.select("lang").distinct().collect())
    table = np.zeros((TABLE, len(names)))
    if names:
        got = summed.toArrow()
        place = {x: i for i, x in enumerate(names)}
        column = np.array([place[x] for x in got.column("lang").to_pylist()], int)
        table[got.column("code").to_numpy(), column] = got.column("n").to_numpy()
        table = np.log((table + SMOOTH) / (table.sum(axis=0) + SMOOTH * TABLE))
    return names, table.astype(np.float32)


def text_evidence(records: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """Replaces ``text`` (with ``is_markup``) by ``logs``: tempered log-likelihoods, the largest zero."""
    shared = records.sparkSession.sparkContext.broadcast(table)
    keep = [c for c in records.columns if c not in ("text", "is_markup")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            logs = []
            for text, markup in zip(batch.column("text").to_pylist(), batch.column("is_markup").to_pylist(), strict=True):
                total, n = np.zeros(model.shape[1]), 0
                codes = trigram_codes(markup_text(text) if markup else text)
                for at in range(0, len(codes), 1 << 16):  # long texts in slices
                    part = codes[at : at + (1 << 16)]
                    total += model[part].sum(axis=0, dtype=np.float64)
                    n += len(part)
                if n > EVIDENCE:
                    total *= EVIDENCE / n
                logs.append((total - total.max()).tolist() if len(total) else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(logs, pa.list_(pa.float64()))], [*keep, "logs"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in records.schema if f.name in keep]
    return records.mapInArrow(run, ", ".join([*kinds, "logs array<double>"]))


# ------------------------------------------------------------------- the fusion


def _soft(logs: Column) -> Column:
    """Probabilities from logs whose largest is zero."""
    e = F.transform(logs, F.exp)
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def _sums(records: DataFrame, by: list[str], languages: int) -> DataFrame:
    """``by`` and ``sums``: the summed text posteriors, combined before the shuffle."""
    sums = [F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in range(languages)]
    grouped = records.groupBy(*by).agg(*sums) if by else records.agg(*sums)
    return grouped.select(*by, F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(languages)]).alias("sums"))


def _smoothed(sums: Column, prior: Column) -> Column:
    n = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(sums, prior, lambda s, p: (s + PULL * p) / (n + PULL))


def _reliability(records: DataFrame, value: str, languages: int, overall: Column) -> DataFrame:
    """``value, logs``: smoothed log P(value | language)."""
    sums = _sums(records.filter(F.col(value).isNotNull()), [value], languages)
    sums = materialise(sums, f"{value}_sums")
    kinds = sums.count()
    logs = F.zip_with("sums", overall, lambda s, t: F.log((s + SMOOTH) / (t + SMOOTH * (kinds + 1))))
    return sums.select(F.col(value).alias("v"), logs.alias("found"))


def identify(records: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """Adds ``lang, probability, text_lang`` to records of ``text, is_markup, declared, address, host, domain``.

    ``text`` and ``is_markup`` are replaced; all other columns stay.
    """
    given = [c for c in records.columns if c not in ("text", "is_markup", "declared", "address", "host", "domain")]
    k = len(names)
    if not k:
        empty = records.select(*given, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
        return empty.withColumn("text_lang", F.lit(None).cast("string"))
    scored = materialise(text_evidence(records, names, table), "text_evidence").withColumn("p", _soft(F.col("logs")))

    total = _sums(scored, [], k).collect()[0]["sums"]
    overall = F.array(*[F.lit(float(x)) for x in total])
    whole = sum(total)
    prior = F.array(*[F.lit((float(x) + SMOOTH) / (whole + SMOOTH * k)) for x in total])
    hosts = materialise(_sums(scored.filter(F.col("host").isNotNull()), ["host", "domain"], k), "hosts")
    domains = hosts.groupBy("domain").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(k)])
    domains = domains.select(F.col("domain").alias("d"), _smoothed(F.array(*[f"s{i}" for i in range(k)]), prior).alias("wide"))
    by_host = hosts.join(domains, F.col("domain").eqNullSafe(F.col("d")), "left")
    by_host = by_host.select(F.col("host").alias("h"), F.col("domain").alias("hd"), F.transform(_smoothed(F.col("sums"), F.coalesce("wide", prior)), F.ln).alias("host_logs"))
    by_host = materialise(by_host, "host_priors")

    fused = scored.join(by_host, (F.col("host") == F.col("h")) & F.col("domain").eqNullSafe(F.col("hd")), "left")
    for value in ("declared", "address"):
        found = materialise(_reliability(scored, value, k, overall), f"{value}_logs")
        found = found.select(F.col("v").alias(f"{value}_v"), F.col("found").alias(f"{value}_logs"))
        fused = fused.join(found, F.col(value) == F.col(f"{value}_v"), "left")
    zero = F.array_repeat(F.lit(0.0), k)
    logs = F.col("logs")
    for extra in (F.coalesce("host_logs", F.transform(prior, F.ln)), F.coalesce("declared_logs", zero), F.coalesce("address_logs", zero)):
        logs = F.zip_with(logs, extra, lambda a, b: a + b)
    fused = fused.select(*given, F.col("logs").alias("text_logs"), logs.alias("all_logs"))
    fused = fused.withColumn("posterior", _soft(F.transform("all_logs", lambda x: x - F.array_max("all_logs"))))
    label = F.array(*[F.lit(x) for x in names])

    def best(of: str) -> Column:
        return F.get(label, F.array_position(of, F.array_max(of)).cast("int") - 1)

    return fused.select(*given, best("posterior").alias("lang"), F.round(F.array_max("posterior"), 6).alias("probability"), best("text_logs").alias("text_lang"))


# -------------------------------------------------------------------- records


def page_records(pages: DataFrame) -> DataFrame:
    """``page_id, url`` and the evidence of pages."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    none = F.lit(None).cast("string")
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    segment = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[/?#-]|$)", 1))
    host = host_of(F.col("url"))
    suffix = F.regexp_extract(host, rf"\.({SUFFIX})$", 1)
    domain = F.regexp_extract(host, rf"([^.]+\.{SUFFIX})$", 1)
    address = F.concat_ws("/", suffix, segment)
    return pages.select(
        "page_id",
        "url",
        html.alias("text"),
        F.lit(True).alias("is_markup"),
        F.when(declared != "", declared).otherwise(none).alias("declared"),
        F.when(address != "/", address).otherwise(none).alias("address"),
        F.when(host != "", host).otherwise(none).alias("host"),
        F.when(domain != "", domain).otherwise(host).alias("domain"),
    )


def document_records(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the evidence of plain documents: the text, and the source as host."""
    none = F.lit(None).cast("string")
    return docs.select(
        "doc_id",
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.lit(False).alias("is_markup"),
        none.alias("declared"),
        none.alias("address"),
        F.col("source").cast("string").alias("host"),
        none.alias("domain"),
    )
