"""Operator 1: best-fit packing by a grouping genetic algorithm on islands.

Documents of one length are interchangeable, so the problem is its histogram
of piece lengths: at most ``capacity`` numbers, whatever the corpus. A solution
is a list of bin patterns with multiplicities; patterns, too, are bounded by
the number of lengths, as filling takes whole groups of equal bins at a time.

Islands (Spark groups) evolve populations of such solutions. Crossover injects
whole well-filled bins of one parent into the other, dissolves bins of the
other whose documents are thereby placed twice, and best-fits the displaced
documents by falling length. After each epoch every island's best solution
also moves to the next island.

Placing the documents is a distributed numbering of the pieces of each length
(salted, so that a length that a third of all pieces have is split) and a
lookup of that number among the slots of the best solution.

Defined cases: NULL text counts as empty and is one piece with the end id
alone; NULL ids are ids like others; rows repeating an id are packed each;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dinelens.llm.common import materialise, text_or_empty
from dinelens.llm.tokens import encoder

ISLANDS, EPOCHS, GENERATIONS, POPULATION = 6, 3, 5, 6
WELL_FILLED = 0.98
ROWS_PER_SALT = 5000

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it), falling lengths
Solution = list[tuple[Pattern, int]]  # pattern and number of such bins

# ------------------------------------------------------- the genetic algorithm


def _filled(p: Pattern) -> int:
    return sum(n * a for n, a in p)


def _plus(p: Pattern, length: int, count: int = 1) -> Pattern:
    """The pattern with ``count`` more pieces of ``length``."""
    d = dict(p)
    d[length] = d.get(length, 0) + count
    return tuple(sorted(d.items(), reverse=True))


def best_fit(bins: Solution, left: dict[int, int], capacity: int, noise: float = 0.0, rng: random.Random | None = None) -> Solution:
    """Put the pieces ``left`` (length to count) into the fullest bins that take them, long ones first.

    Equal bins are filled together: one step places as many pieces of a length
    as there are bins of a pattern. ``noise`` disturbs the order of lengths.
    """
    open_: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]
    mask = 0

    def put(p: Pattern, m: int) -> None:
        nonlocal mask
        room = capacity - _filled(p)
        open_[room].append((p, m))
        mask |= 1 << room

    for p, m in bins:
        put(p, m)
    order = sorted((n for n, c in left.items() if c), key=lambda n: n * (1 + noise * rng.uniform(-1, 1)) if rng else n, reverse=True)
    for n in order:
        c = left[n]
        while c:
            fits = mask >> n
            if not fits:
                break
            room = n + (fits & -fits).bit_length() - 1
            p, m = open_[room].pop()
            if not open_[room]:
                mask &= ~(1 << room)
            k = min(m, c)
            put(_plus(p, n), k)
            if m > k:
                put(p, m - k)
            c -= k
        each = capacity // n
        if c >= each:
            put(((n, each),), c // each)
        if c % each:
            put(((n, c % each),), 1)
    merged: dict[Pattern, int] = {}
    for group in open_:
        for p, m in group:
            merged[p] = merged.get(p, 0) + m
    return list(merged.items())


def fitness(s: Solution, capacity: int) -> tuple[int, float]:
    """Number of bins, then minus the mean squared fill; less is better."""
    n = sum(m for _, m in s)
    return n, -sum(m * (_filled(p) / capacity) ** 2 for p, m in s) / max(1, n)


def crossover(a: Solution, b: Solution, counts: dict[int, int], capacity: int, rng: random.Random) -> Solution:
    """A child of ``a`` with some whole well-filled bins of ``b``."""
    left = dict(counts)
    child: dict[Pattern, int] = {}

    def keep(p: Pattern, m: int) -> None:
        k = min([m, *(left[n] // x for n, x in p)])
        if k:
            child[p] = child.get(p, 0) + k
            for n, x in p:
                left[n] -= k * x

    well = [(p, m) for p, m in b if _filled(p) >= WELL_FILLED * capacity] or b
    for p, m in rng.sample(well, rng.randint(1, max(1, len(well) // 20))):
        keep(p, m)
    for p, m in sorted(a, key=lambda x: (-_filled(x[0]), x[0])):
        keep(p, m)  # bins beyond that hold documents already placed: dissolved
    return best_fit(list(child.items()), left, capacity)


def mutate(s: Solution, capacity: int, rng: random.Random) -> Solution:
    """Dissolve the worst-filled bins and some others; best-fit their documents in a disturbed order."""
    ordered = sorted(s, key=lambda x: (_filled(x[0]), x[0]))
    cut = max(1, len(ordered) // 10)
    gone = ordered[:cut] + [x for x in ordered[cut:] if rng.random() < 0.1]
    stay = [x for x in ordered if x not in set(gone)]
    left: dict[int, int] = {}
    for p, m in gone:
        for n, x in p:
            left[n] = left.get(n, 0) + m * x
    return best_fit(stay, left, capacity, 0.1, rng)


def evolve(population: list[Solution], counts: dict[int, int], capacity: int, rng: random.Random, generations: int, size: int) -> list[Solution]:
    total = sum(n * c for n, c in counts.items())
    bound = -(-total // capacity)
    rank = lambda s: fitness(s, capacity)
    while len(population) < size:
        population.append(best_fit([], counts, capacity, 0.15 * len(population) / size, rng))
    population = sorted(population, key=rank)[:size]
    for _ in range(generations):
        if rank(population[0])[0] == bound:
            break
        children = []
        for _ in range(size - 1):
            a, b = (min(rng.sample(population, min(2, len(population))), key=rank) for _ in range(2))
            child = crossover(a, b, counts, capacity, rng)
            children.append(mutate(child, capacity, rng) if rng.random() < 0.3 else child)
        population = sorted(population + children, key=rank)[:size]
    return population


def _pack(s: Solution) -> bytes:
    return zlib.compress(json.dumps(s).encode())


def _unpack(b: bytes) -> Solution:
    return [(tuple((n, x) for n, x in p), m) for p, m in json.loads(zlib.decompress(b))]


def solve(spark, counts: dict[int, int], capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> Solution:
    """The best solution after ``epochs`` of evolution on ``islands`` and migration between them."""
    if not counts:
        return []
    schema = "island long, place int, genome binary, bins long, fill double"

    def epoch(number: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            island = int(rows["island"].iloc[0])
            rows = rows.sort_values(["bins", "fill", "genome"])
            given = [_unpack(g) for g in rows["genome"] if g is not None]
            rng = random.Random(1000 * number + island)
            found = evolve(given, counts, capacity, rng, GENERATIONS, POPULATION)
            return pd.DataFrame([(island, k, _pack(s), *fitness(s, capacity)) for k, s in enumerate(found)], columns=["island", "place", "genome", "bins", "fill"])

        return run

    state = spark.range(islands).select(F.col("id").alias("island"), F.lit(0).alias("place"), F.lit(None).cast("binary").alias("genome"), F.lit(0).cast("long").alias("bins"), F.lit(0.0).alias("fill"))
    for number in range(epochs):
        if number:
            moved = state.filter("place = 0").withColumn("island", (F.col("island") + 1) % islands)
            state = state.unionByName(moved)
        state = state.groupBy("island").applyInPandas(epoch(number), schema)
        state = materialise(state, f"epoch{number}")
    best = state.orderBy("bins", "fill", "island", "place").limit(1).collect()[0]
    return _unpack(bytes(best["genome"]))


# -------------------------------------------------------------------- placing


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: whole texts tokenised, cut into pieces.

    Of a document of more than ``capacity`` ids all pieces but the first are full.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(enc.encode(batch.column(1).to_pylist())):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def slots(solution: Solution) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first number, first sequence, pieces per sequence and first offset of its slots."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for p, m in solution:
        offset = 0
        for n, x in p:
            found.setdefault(n, []).append((used.get(n, 0), sequence, x, offset))
            used[n] = used.get(n, 0) + m * x
            offset += n * x
        sequence += m
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in found.items()}


def place(numbered: DataFrame, solution: Solution) -> DataFrame:
    """Adds ``sequence_id, offset`` to rows with ``length`` and ``number`` (0, 1, .. within a length)."""
    # A slot for each length of each pattern: bounded by the lengths, not the data.
    shared = numbered.sparkSession.sparkContext.broadcast(slots(solution))
    names = [c for c in numbered.columns if c != "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, seq, each, off = shared.value[int(n)]
                at = np.searchsorted(first, number[rows], "right") - 1
                k = number[rows] - first[at]
                sequence[rows] = seq[at] + k // each[at]
                offset[rows] = off[at] + k % each[at] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number"]
    return numbered.mapInArrow(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
    cut = materialise(cut, "pieces")
    histogram = {int(r["length"]): r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    solution = solve(spark, histogram, capacity)

    salts = max(1, sum(histogram.values()) // ROWS_PER_SALT)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    sizes = materialise(sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before")), "sizes")
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    numbered = salted.withColumn("within", within).join(sizes, ["length", "salt"])
    numbered = numbered.select(*cut.columns, (F.col("before") + F.col("within") - 1).alias("number"))
    return place(numbered, solution)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, from documents with unique ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            row, start, ids = [], [], []
            for i, b in enumerate(enc.encode(batch.column(1).to_pylist())):
                v = np.frombuffer(b + end, "<u4").astype(np.int32)
                cuts = [0, *range((len(v) - 1) % capacity + 1, len(v) + 1, capacity)]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    row.append(i)
                    start.append(x)
                    ids.append(v[x:y])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(start, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    cut = rows.mapInArrow(run, f"doc_id {kind}, start long, ids array<int>")
    joined = placed.join(cut, ["doc_id", "start"])
    in_order = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))
