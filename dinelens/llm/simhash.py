"""Operator 6: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits from three-word shingles (Arrow batches, whole texts,
long ones in slices). Equal fingerprints are one node, so copies cost nothing.

Search: the 64 bits are put into ``m`` parts, bits that agree often in the
same part, so that the correlation between parts is low. If two fingerprints
differ in at most ``d`` bits and thresholds ``t_i >= -1`` satisfy
``sum(t_i + 1) = d + 1``, some part differs in at most ``t_i`` bits. For every
``m`` a dynamic programme picks the thresholds with the least estimated number
of candidates; the number of probe rows is added and the cheapest ``m`` wins.
Both correlation and estimates come from a bounded hash sample; they decide
only the cost, never the result.

Probing: a fingerprint goes to the bucket of its value in each part, and, for
a threshold of 1 or 2, to the buckets that clearing one or two set bits give,
or changing one pair. A bucket with more than ``MAX_BUCKET`` rows is split
again on all bits outside its part, by the plain pigeonhole principle, until
buckets are small: no task ever holds a large one. Inside a bucket numpy
compares in blocks and reports a spanning forest of the links, not all pairs.

Components are joined over these links by ``connected_components``.

Defined cases: NULL text counts as empty; no words give fingerprint zero,
linked like any other; NULL ids lose to other ids and are the component only
where no other id exists; rows repeating an id get a row each; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinelens.llm.common import materialise, text_or_empty
from dinelens.llm.components import connected_components

BITS = 64
SEED = 42
SLICE = 1 << 15
MAX_BUCKET = 4096
SAMPLE = 4096
PART_COUNTS = (2, 3, 4)
PROBE_COST = 400.0  # a probe row weighs as much as so many compared pairs


def fingerprint(text: str, shingle: int = 3, bits: int = BITS) -> int:
    """SimHash of the XXH64 values of word shingles; ASCII letters folded, ASCII white space splits."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    line = b" ".join(words)
    votes = np.zeros(bits, np.int64)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    for at in range(0, n, SLICE):
        spans = zip(starts[at : min(at + SLICE, n)].tolist(), last[at : at + SLICE].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    ones = np.packbits(votes * 2 > n, bitorder="little")
    return int(ones.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, t, fp``: the signed 64-bit fingerprint; ``t`` hashes the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("t"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "t", "fp"])

    return rows.mapInArrow(run, "doc_id long, t long, fp long")


# ---------------------------------------------------------------- planning


def _bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about equal size, correlated ones together."""
    if len(sample) < 2:
        return [list(map(int, x)) for x in np.array_split(np.arange(BITS), parts)]
    b = _bit_matrix(sample).astype(float)
    b -= b.mean(axis=0)
    spread = np.sqrt((b * b).sum(axis=0)) + 1e-9
    near = np.abs(b.T @ b) / np.outer(spread, spread)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        room = BITS // parts + (k < BITS % parts)
        group = [max(sorted(free), key=lambda i: near[i, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < room:
            best = max(sorted(free), key=lambda i: near[i, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> int:
    return sum(1 << i for i in bits)


def _probes(width: int, t: int) -> float:
    """Rows that a fingerprint sends for a part of ``width`` bits."""
    one = width / 2
    return 0.0 if t < 0 else [1.0, 1 + one, 1 + one + one * (one - 1) / 2 + one * one][t]


def allocate(sample: np.ndarray, n: int, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Least estimated cost, and the threshold of each part (dynamic programme)."""
    pairs = n * (n - 1) / 2
    share = []
    k = len(sample)
    for g in groups:
        v = sample & np.uint64(_mask(g))
        if k < 2:
            share.append([0.0] * 3)
            continue
        i = np.random.default_rng(1).integers(0, k, (2, 200_000))
        i = i[:, i[0] != i[1]]
        d = np.bitwise_count(v[i[0]] ^ v[i[1]])
        floor = [sum(_choose(len(g), e) for e in range(t + 1)) / 2.0 ** len(g) for t in range(3)]
        share.append([max(float((d <= t).mean()), floor[t]) for t in range(3)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g, s in zip(groups, share, strict=True):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, 3):
                if used + t + 1 > distance + 1:
                    break
                c = cost + (pairs * s[t] if t >= 0 else 0.0) + PROBE_COST * n * _probes(len(g), t)
                if used + t + 1 not in nxt or c < nxt[used + t + 1][0]:
                    nxt[used + t + 1] = (c, [*ts, t])
        best = nxt
    return best.get(distance + 1, (float("inf"), []))


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def plan(sample: np.ndarray, n: int, distance: int) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds with the least estimated cost."""
    options = []
    for m in PART_COUNTS:
        groups = group_bits(sample, m)
        cost, ts = allocate(sample, n, groups, distance)
        if ts:
            options.append((cost, m, groups, ts))
    _, _, groups, ts = min(options, key=lambda x: x[:2])
    return groups, ts


# ----------------------------------------------------------------- probing


def _flips(v: int, group: list[int], t: int) -> Iterator[int]:
    """Buckets besides its own that a value is sent to.

    Of two values in one bucket distance the pair meets once: with one bit
    changed, the value that has the bit clears it; with two, both are cleared
    by the value that has both, or swapped by the one with the lower set bit.
    """
    ones = [1 << i for i in group if v >> i & 1]
    zeros = [1 << i for i in group if not v >> i & 1]
    if t >= 1:
        yield from (v ^ a for a in ones)
    if t >= 2:
        yield from (v ^ a ^ b for a, b in combinations(ones, 2))
        yield from (v ^ a ^ b for a in ones for b in zeros if a < b)


def _signatures(groups: list[list[int]], ts: list[int]):
    """``fp -> part, key, probe, fp`` rows; ``key`` is the value of the part's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            out = []
            for part, (g, t) in enumerate(zip(groups, ts, strict=True)):
                if t < 0:
                    continue
                v = fps & np.uint64(_mask(g))
                out.append((part, v, fps, False))
                if t >= 1:
                    sent = [(w, f) for x, f in zip(v.tolist(), fps.tolist(), strict=True) for w in _flips(x, g, t)]
                    if sent:
                        a = np.array(sent, np.uint64)
                        out.append((part, a[:, 0], a[:, 1], True))
            for part, key, f, probe in out:
                n = len(f)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(key.view(np.int64)),
                        pa.array(np.zeros(n, np.int64)),
                        pa.array(np.full(n, np.uint64(_mask(groups[part]))).view(np.int64)),
                        pa.array(np.full(n, probe)),
                        pa.array(np.ascontiguousarray(f).view(np.int64)),
                    ],
                    ["part", "key", "path", "used", "probe", "fp"],
                )

    return run


SIGNATURE = "part int, key long, path long, used long, probe boolean, fp long"


def _refine(distance: int):
    """Rows of a large bucket, once for each block of the bits not used so far.

    All members agree (or nearly) in the used bits; of ``distance + 1`` blocks
    of the others at least one is equal in any linked pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, key, path, used, probe, fp = (batch.column(i) for i in range(6))
            masks = used.to_numpy(zero_copy_only=False).view(np.uint64)
            f = fp.to_numpy(zero_copy_only=False).view(np.uint64)
            p = path.to_numpy(zero_copy_only=False).view(np.uint64)
            for mask in np.unique(masks):
                rows = np.where(masks == mask)[0]
                free = [i for i in range(BITS) if not int(mask) >> i & 1]
                for k, block in enumerate(np.array_split(np.array(free, int), distance + 1)):
                    b = np.uint64(_mask(block.tolist()))
                    # Which block, and the value there, become part of the bucket's name.
                    name = np.fromiter(
                        (xxhash.xxh64_intdigest(np.array([q, k, v], "<u8").tobytes(), SEED) for q, v in zip(p[rows], f[rows] & b, strict=True)),
                        np.uint64,
                        len(rows),
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.take(pa.array(rows)),
                            key.take(pa.array(rows)),
                            pa.array(name.view(np.int64)),
                            pa.array(np.full(len(rows), mask | b).view(np.int64)),
                            probe.take(pa.array(rows)),
                            fp.take(pa.array(rows)),
                        ],
                        ["part", "key", "path", "used", "probe", "fp"],
                    )

    return run


class _Forest:
    """Union-find over the positions of one bucket."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def bucket_links(fps: np.ndarray, probe: np.ndarray, distance: int, block: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links between a bucket's rows, at least one of them no probe."""
    base = np.where(~probe)[0]
    forest, out = _Forest(len(fps)), []
    for at in range(0, len(base), block):
        rows = base[at : at + block]
        near = np.bitwise_count(fps[rows][:, None] ^ fps[None, :]) <= distance
        i, j = np.nonzero(near)
        i = rows[i]
        keep = (probe[j] | (j > i)) & (fps[i] != fps[j])
        for a, b in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            if forest.join(a, b):
                out.append((a, b))
    return out


def _verify(distance: int):
    """Links inside the buckets of a partition sorted by bucket; a bucket may cross batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None
        names: np.ndarray | None = None

        def links(names: np.ndarray, rows: np.ndarray) -> pa.RecordBatch | None:
            cut = np.flatnonzero(np.any(names[1:] != names[:-1], axis=1)) + 1
            bounds = np.concatenate(([0], cut, [len(rows)]))
            size = np.diff(bounds)
            found = []
            for k in np.flatnonzero(size > 1):
                a, b = bounds[k], bounds[k + 1]
                fps, probe = rows[a:b, 0].astype(np.uint64), rows[a:b, 1].astype(bool)
                if size[k] == 2:
                    if not probe.all() and fps[0] != fps[1] and (int(fps[0]) ^ int(fps[1])).bit_count() <= distance:
                        found.append((fps[0], fps[1]))
                else:
                    found.extend((fps[i], fps[j]) for i, j in bucket_links(fps, probe, distance))
            if not found:
                return None
            pair = np.array(found, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair.min(axis=1)), pa.array(pair.max(axis=1))], ["a", "b"])

        for batch in batches:
            part, key, path, _, probe, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            now = np.column_stack([part.astype(np.int64), key, path])
            row = np.column_stack([fp.view(np.uint64), probe.astype(np.uint64)])
            if rest is not None:
                now, row = np.concatenate([names, now]), np.concatenate([rest, row])
            start = len(now) - int(np.argmax(np.any(now[::-1] != now[-1], axis=1))) if np.any(now != now[-1]) else 0
            if start and (found := links(now[:start], row[:start])) is not None:
                yield found
            names, rest = now[start:], row[start:]
        if rest is not None and (found := links(names, rest)) is not None:
            yield found

    return run


def hamming_links(fps: DataFrame, distance: int = 3, max_bucket: int = MAX_BUCKET, sample: int = SAMPLE) -> DataFrame:
    """``a, b``: links that connect all distinct values of ``fp`` (column of longs) within ``distance`` bits."""
    n = fps.count()
    share = F.abs(F.xxhash64("fp", F.lit(5)) / F.lit(2.0**63)) <= min(1.0, sample / max(1, n))
    some = fps.filter(share).limit(4 * sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    groups, ts = plan(some, n, distance)
    rows = fps.select("fp").mapInArrow(_signatures(groups, ts), SIGNATURE)
    bucket = ["part", "key", "path"]
    found = None
    while True:
        rows = materialise(rows, "signatures")
        sizes = rows.groupBy(*bucket, "used").agg(F.count(F.lit(1)).alias("n"))
        # A bucket whose members agree in all bits can't be large: values are distinct.
        large = materialise(sizes.filter((F.col("n") > max_bucket) & (F.col("used") != -1)).select(*bucket), "large")
        small = rows.join(large, bucket, "left_anti")
        spread = small.repartition(*bucket).sortWithinPartitions(*bucket)
        links = spread.mapInArrow(_verify(distance), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if large.isEmpty():
            return found
        rows = rows.join(large, bucket, "left_semi").mapInArrow(_refine(distance), SIGNATURE)


# --------------------------------------------------------------- operators


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id, t, kept``.

    ``component_id`` is the smallest id of the component. ``kept`` marks the
    row with that id (among rows that share it, the one whose text hash ``t``
    is smallest).
    """
    rows = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first"))
    nodes = materialise(nodes, "nodes")
    comps = connected_components(hamming_links(nodes.select("fp"), distance))
    comps = materialise(comps, "components")
    linked = nodes.join(comps, nodes["fp"] == comps["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    linked = materialise(linked, "linked")
    head = linked.groupBy("c").agg(F.min("first").alias("head"))
    labels = materialise(linked.join(head, "c").select("fp", "head"), "labels")
    out = rows.join(labels, "fp")
    return out.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"),
        "t",
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("t") == F.col("head.t"))).alias("kept"),
    )


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay; of rows equal in id and text all stay or go together."""
    found = near_duplicates(docs, shingle, distance, id_col, text_col)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_llm_id"), F.col("t").alias("_llm_t")).distinct()
    gone = materialise(gone, "gone")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    same = docs[id_col].cast("long").eqNullSafe(gone["_llm_id"]) & (F.xxhash64(text) == gone["_llm_t"])
    return docs.join(gone, same, "left_anti")
