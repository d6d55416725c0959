r"""Operator 7: secret scan with character Markov models.

Three base patterns give spans (their matches, leftmost and non-overlapping
per kind; too short ones dropped afterwards). Two first-order character models
add more: one of random strings, one of ordinary identifiers. A run of token
characters outside the base spans is reported as kind ``markov`` if its mean
log-likelihood ratio per transition lies above a threshold.

The models are trained from labelled samples: values that the base patterns
find are random strings, long plain words of the same rows are ordinary
identifiers. Counting runs over a hash sample of at most ``train_rows`` rows
(in expectation); scanning covers every row and the whole text.

Only DataFrame functions. Spark has no function for match positions, but
``split`` and ``regexp_extract_all`` by one pattern alternate, so running sums
of their lengths are the positions, in code points. The model is a table of
128 x 128 ratios (a bound independent of the data), put into the plan as one
constant array.

Defined cases: NULL text counts as empty; empty texts have no span; rows that
repeat an id get a row each; extra columns are ignored; an empty table gives
an empty result, and without samples of both kinds every ratio is zero and
nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinelens.llm.common import text_or_empty

# The base patterns, the least length and the part it counts.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
RUN = r"[A-Za-z0-9+/_-]{16,}"
WORD = r"[A-Za-z_]{8,}"
ASCII = 128
DEFAULT_TRAIN_ROWS = 50_000
DEFAULT_THRESHOLD = 1.0
SPAN_TYPE = "array<struct<begin:bigint,end:bigint,kind:int,value:string>>"


def _matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """``array<struct<begin, end, kind, value>>`` of a pattern's matches, code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    zipped = F.zip_with(
        between, F.zip_with(whole, part, lambda w, p: F.struct(w.alias("w"), p.alias("p"))), lambda b, m: F.struct(F.length(b).alias("gap"), m.alias("m"))
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as {SPAN_TYPE})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = (acc["at"] + x["gap"]).cast("bigint")
        end = (begin + F.length(x["m"]["w"])).cast("bigint")
        span = F.struct(begin.alias("begin"), end.alias("end"), F.lit(kind).alias("kind"), x["m"]["p"].alias("value"))
        keep = F.coalesce(F.length(x["m"]["p"]) >= least, F.lit(False))
        return F.struct(
            F.coalesce(end, acc["at"]).alias("at"),
            F.when(keep, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    found = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as {SPAN_TYPE})"))


def base_spans(text: Column) -> dict[str, Column]:
    """The span array of each base kind."""
    return {name: _matches(text, p, group, least, i) for i, (name, (p, group, least)) in enumerate(KINDS.items())}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = DEFAULT_TRAIN_ROWS) -> list[float]:
    """Log-likelihood ratios of the 128 x 128 transitions, row by row.

    The driver receives at most two counts for each pair of token characters.
    """
    n = docs.count()
    share = min(1.0, train_rows / n) if n else 1.0
    # A hash of id and text picks the rows, alike in every run and layout.
    rows = docs.select(F.xxhash64(F.col(id_col), text_or_empty(text_col), F.lit(7)).alias("r"), text_or_empty(text_col).alias("text"))
    rows = rows.filter(F.abs(F.col("r") / F.lit(2.0**63)) <= share).select("text")
    spans = rows.select("text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    rest = F.col("text")
    for p, _, _ in KINDS.values():
        rest = F.regexp_replace(rest, F.lit(p), F.lit(" "))
    random = F.transform(F.concat(*KINDS), lambda s: s["value"])
    labelled = spans.select(
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("label"), random.alias("samples")),
                F.struct(F.lit(0).alias("label"), F.regexp_extract_all(rest, F.lit(WORD), F.lit(0)).alias("samples")),
            )
        ).alias("x")
    )
    samples = labelled.select("x.label", F.explode("x.samples").alias("s")).groupBy("label", "s").agg(F.count(F.lit(1)).alias("n"))
    chars = _characters(F.col("s"))
    pair = F.zip_with(F.slice(chars, F.lit(1), F.length("s") - 1), F.slice(chars, F.lit(2), F.length("s") - 1), lambda a, b: F.concat(a, b))
    counted = samples.filter(F.length("s") >= 2).select("label", "n", F.explode(pair).alias("pair")).groupBy("label", "pair").agg(F.sum("n").alias("n"))
    counts = {0: {}, 1: {}}
    for r in counted.collect():
        counts[r["label"]][(ord(r["pair"][0]), ord(r["pair"][1]))] = r["n"]
    return _ratios(counts)


def _ratios(counts: dict[int, dict[tuple[int, int], int]], smooth: float = 0.5, pull: float = 2.0) -> list[float]:
    """Transition probabilities pulled towards the frequency of the second character, which is smoothed itself."""
    alphabet = sorted({c for m in counts.values() for pair in m for c in pair})
    log_p: dict[int, dict[tuple[int, int], float]] = {}
    for label, m in counts.items():
        starts: dict[int, float] = {}
        ends: dict[int, float] = {}
        for (a, b), n in m.items():
            starts[a] = starts.get(a, 0.0) + n
            ends[b] = ends.get(b, 0.0) + n
        whole = sum(ends.values()) + smooth * len(alphabet)
        single = {b: (ends.get(b, 0.0) + smooth) / whole for b in alphabet}
        log_p[label] = {(a, b): math.log((m.get((a, b), 0) + pull * single[b]) / (starts.get(a, 0.0) + pull)) for a in alphabet for b in alphabet}
    out = [0.0] * (ASCII * ASCII)
    if counts[0] and counts[1]:
        for a, b in log_p[1]:
            if a < ASCII and b < ASCII:
                out[a * ASCII + b] = round(log_p[1][a, b] - log_p[0][a, b], 5)
    return out


def _characters(text: Column) -> Column:
    """The text's characters in one pass; a substring for each would start anew at the front."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def _mean_ratio(token: Column, ratios: Column) -> Column:
    codes = F.transform(_characters(token), lambda c: F.ascii(c))
    last = F.length(token) - 1
    steps = F.zip_with(F.slice(codes, F.lit(1), last), F.slice(codes, F.lit(2), last), lambda a, b: a * ASCII + b)
    total = F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + F.coalesce(F.get(ratios, k), F.lit(0.0)))
    return total / last


def _joined(spans: Column, names: list[str]) -> Column:
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["begin"], s["end"])), ",")


def scan(
    docs: DataFrame,
    ratios: list[float],
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """One row per document: ``doc_id, base, added``, sorted arrays of ``(begin, end, kind, value)``."""
    table = F.split(F.lit(",".join(f"{x:g}" for x in ratios)), ",").cast("array<double>")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = rows.select("doc_id", "text", F.array_sort(F.concat(*base_spans(F.col("text")).values())).alias("base"))
    runs = found.withColumn("runs", _matches(F.col("text"), RUN, 0, 0, len(KINDS))).drop("text")
    added = F.filter(
        "runs",
        lambda r: ~F.exists("base", lambda b: (b["begin"] < r["end"]) & (r["begin"] < b["end"]))
        & (_mean_ratio(r["value"], table) >= threshold),
    )
    return runs.select("doc_id", "base", added.alias("added"))


def span_digests(found: DataFrame) -> DataFrame:
    names = [*KINDS, "markov"]

    def of_kind(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    count = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *count,
        F.sha2(_joined(_by_place("base"), names).cast("binary"), 256).alias("base_sha256"),
        _joined(_by_place(F.concat("base", "added")), names).alias("spans"),
    )


def _by_place(spans: Column | str) -> Column:
    """By begin, then by kind as listed."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"], s["kind"], s["end"])))
    return ordered
