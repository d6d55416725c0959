"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Nodes: rows with the same vector are one node, known by its smallest id and by
the ``copies`` smallest ids, which are all that a search for ``copies - 1`` can
return. For the graph, every vector is divided by the largest norm and gets a
further component that brings its norm to one; largest inner products with a
vector whose further component is zero are then smallest distances. Norms above
``LONG`` times the median count as that there, or a few long vectors would leave
the others alike; the search multiplies by what was cut off.

Graph: nodes whose random projections have like signs are compared in blocks of
some thousands, and each block's best links start the graph. A round of NN-descent joins the nodes
whose links meet at the same node, compares these neighbours of neighbours with
each other and joins what beats a node's worst link back to that node. Rounds
end when few links change. The compared vectors are rounded to eight bits.

Search: each distinct query vector starts at its own node, or at a few entry
nodes, and keeps the ``beam`` best nodes seen. Each hop joins the nodes to look
at with the index, sends back the ones that beat the beam's worst together with
their links, and goes on with the links not yet seen. It ends when a hop improves
nothing. Inner products of the nodes kept are then taken in double precision on
the original vectors.

The graph covers every row; the answers are approximate (tests and README give
the recall). State of a search is one row per distinct query vector. Vectors
that are NULL, zero or hold NULL or non-finite components take no part, nor
rows without id or with another number of components than most rows. Of rows
that share an id, the one with the smallest vector stays. An empty table, or no
usable query, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dinelens.llm.common import materialise

LINKS = 32
SAMPLE = 40  # links of a node compared in a round
OLD_TURN = 4  # an old link is compared in one round of so many
BEST = 4  # better links that a comparison reports for each node
BLOCK = 4096
STARTS = 10
CODE_BITS = 62
MAX_ROUNDS = 12
STILL = 0.02  # share of links that may still change when the rounds end
BEAM = 64
ENTRIES = 24
LONG = 8.0
FIRST = 4  # nodes whose links the first hop follows


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, vec`` of the rows that take part, one per id."""
    vec = F.col("vec")
    whole = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter(F.col("id").isNotNull() & vec.isNotNull())
    found = found.filter(F.coalesce(whole, F.lit(False)) & F.exists(vec, lambda x: x != 0))
    sizes = found.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes:
        found = found.filter(F.size("vec") == sizes["d"])
    return found.groupBy("id").agg(F.min("vec").alias("vec"))


def distinct_nodes(rows: DataFrame, copies: int) -> DataFrame:
    """``node, vec, ids``: distinct vectors with their ``copies`` smallest ids."""
    same = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("at", F.row_number().over(same)).filter(F.col("at") <= copies)
    return few.groupBy("vec").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids")).select("node", "vec", "ids")


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as rows of doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _pack(rows: np.ndarray) -> pa.Array:
    """Rows rounded to eight bits, each behind its scale."""
    scale = np.maximum(np.abs(rows).max(axis=1, initial=0), 1e-30).astype("<f4") / np.float32(127)
    out = np.empty((len(rows), 4 + rows.shape[1]), np.uint8)
    out[:, :4] = scale[:, None].view(np.uint8)
    out[:, 4:] = np.rint(rows / scale[:, None]).astype(np.int8).view(np.uint8)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * out.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(out.tobytes())])


def _unpack(packed: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1) if len(packed) else np.zeros((0, 5), np.uint8)
    return flat[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(flat[:, :4]).view("<f4")


def packed_nodes(nodes: DataFrame) -> DataFrame:
    """``node, norm, stretch, packed``: vectors of norm one; ``stretch`` is the norm over the one used for them."""
    # Divided by a vector's largest component first: squares of very large or small ones would not be numbers.
    largest = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / largest, 2))
    normed = nodes.select("node", "vec", (F.sqrt(squares) * largest).alias("norm"))
    found = normed.agg(F.max("norm"), F.percentile_approx("norm", 0.5)).first()
    top = min(found[0] or 1.0, LONG * (found[1] or 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, norm = _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
                rows = rows / np.abs(rows).max(axis=1)[:, None]
                used = np.minimum(norm / top, 1.0)
                rows *= (used / np.linalg.norm(rows, axis=1))[:, None]
                packed = _pack(np.column_stack([rows, np.sqrt(1.0 - used * used)]))
                yield pa.record_batch([batch.column(0), batch.column(2), pa.array(norm / np.maximum(used, 1e-300)), packed], names=["node", "norm", "stretch", "packed"])

    return normed.select("node", "vec", "norm").mapInArrow(run, "node long, norm double, stretch double, packed binary")


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row."""
    k = min(k, sims.shape[-1])
    return np.argpartition(-sims, k - 1, axis=-1)[..., :k]


def start_links(packed: DataFrame, nodes: int, links: int, seed: int) -> DataFrame:
    """``node, id, s``: the best links inside blocks of nodes whose projections have like signs.

    As many signs are taken as give ``BLOCK`` nodes on average; a larger block
    is cut in the order of further signs.
    """
    bits = max(0, math.ceil(math.log2(max(1, nodes) / BLOCK)))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _unpack(batch.column(1))
            planes = np.random.default_rng(seed).standard_normal((rows.shape[1], CODE_BITS)).astype(np.float32)
            code = (rows @ planes > 0).astype(np.int64) @ (np.int64(1) << np.arange(CODE_BITS, dtype=np.int64))
            yield pa.record_batch([pa.array(code >> (CODE_BITS - bits)), pa.array(code), *batch.columns], names=["block", "code", "node", "packed"])

    def best_of(ids: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), 512):
            sims = rows[at : at + 512] @ rows.T
            own = np.arange(len(sims))
            sims[own, at + own] = -np.inf
            best = _best(sims, min(links, max(1, len(ids) - 1)))
            s = np.take_along_axis(sims, best, 1)
            good = np.isfinite(s).ravel()
            node = np.repeat(ids[at : at + 512], best.shape[1])[good]
            yield pa.record_batch({"node": pa.array(node), "id": pa.array(ids[best].ravel()[good]), "s": pa.array(s.ravel()[good].astype(np.float32))})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, blocks, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            blocks = np.concatenate([blocks, batch.column(0).to_numpy(zero_copy_only=False)])
            ids = np.concatenate([ids, batch.column(2).to_numpy(zero_copy_only=False)])
            new = _unpack(batch.column(3))
            rows = new if rows is None else np.concatenate([rows, new])
            while len(ids):
                end = int(np.searchsorted(blocks, blocks[0], "right"))
                if end == len(ids) and end < 3 * BLOCK:
                    break  # the block may go on
                if end > 2 * BLOCK:
                    end = BLOCK
                yield from best_of(ids[:end], rows[:end])
                ids, blocks, rows = ids[end:], blocks[end:], rows[end:]
        if len(ids):
            yield from best_of(ids, rows)

    coded = packed.select("node", "packed").mapInArrow(codes, "block long, code long, node long, packed binary")
    return coded.repartition("block").sortWithinPartitions("block", "code", "node").mapInArrow(compare, "node long, id long, s float")


def keep_best(found: DataFrame, links: int) -> DataFrame:
    """``node, packed, links``: each node's best links of ``node, id, s, fresh``; a link already known isn't fresh.

    A row without ``id`` carries the node's vector. A node has a bounded number
    of rows: it is in at most ``links`` lists, and each reports a few.
    """
    one = found.repartition("node").groupBy("node", "id").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"), F.first("packed", True).alias("packed"))
    order = Window.partitionBy("node").orderBy(F.col("id").isNotNull(), F.desc("s"), "id")
    one = one.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= links + 1)
    of = F.collect_list(F.when(F.col("id").isNotNull(), F.struct("s", "id", "fresh"))).alias("links")
    return one.groupBy("node").agg(F.first("packed", True).alias("packed"), of)


def carriers(packed: DataFrame) -> DataFrame:
    """Rows for ``keep_best`` that carry the vectors."""
    none = F.lit(None)
    return packed.select("node", none.cast("long").alias("id"), none.cast("float").alias("s"), F.lit(False).alias("fresh"), "packed")


def improved(graph: DataFrame, number: int, links: int, sample: int | None = None) -> DataFrame:
    """A round of NN-descent: ``graph`` with the better links among neighbours of neighbours.

    A node's vector travels along its links; those that meet at a node are
    neighbours of a neighbour of each other. New links all go, old ones in
    turn; where more than ``sample`` meet, new ones and then a hash decide.
    """
    worst = F.when(F.size("links") >= links, F.array_min(F.transform("links", lambda x: x["s"]))).otherwise(F.lit(float("-inf")).cast("float"))
    sent = graph.select("node", "packed", worst.alias("worst"), F.explode("links").alias("x"))
    chance = F.xxhash64("at", "id", F.lit(number))
    sent = sent.select(F.col("x.id").alias("at"), F.col("node").alias("id"), "x.s", "x.fresh", "worst", "packed").filter(F.col("fresh") | (F.pmod(chance, F.lit(OLD_TURN)) == 0))
    some = sent.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("fresh"), chance))).filter(F.col("rank") <= (sample or SAMPLE))
    lists = some.groupBy("at").agg(F.collect_list(F.struct("id", "s", "fresh", "worst", "packed")).alias("of"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                of = whole.column(1).slice(start, 1024)
                centre = whole.column(0).slice(start, 1024).to_numpy(zero_copy_only=False)
                sizes = np.diff(of.offsets.to_numpy())
                flat = of.flatten()
                ids, near, fresh, worst = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                row = np.repeat(np.arange(len(sizes)), sizes)
                at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                wide = int(sizes.max())
                rows = _unpack(flat.field(4))
                table = np.zeros((len(sizes), wide, rows.shape[1]), np.float32)
                name = np.full((len(sizes), wide), -1, np.int64)
                new, limit = np.zeros((len(sizes), wide), bool), np.full((len(sizes), wide), np.inf, np.float32)
                table[row, at], name[row, at], new[row, at], limit[row, at] = rows, ids, fresh, worst
                sims = table @ table.transpose(0, 2, 1)
                held = np.zeros((len(sizes), wide), bool)
                held[row, at] = True
                good = (new[:, :, None] | new[:, None, :]) & held[:, None, :] & (name[:, :, None] != name[:, None, :]) & (sims > limit[:, :, None])
                sims[~good] = -np.inf
                best = _best(sims, BEST)
                s = np.take_along_axis(sims, best, 2)
                real = np.isfinite(s)
                owner = np.broadcast_to(name[:, :, None], best.shape)[real]
                other = np.take_along_axis(np.broadcast_to(name[:, None, :], sims.shape), best, 2)[real]
                # New links are offered to the node they lead to; those compared here are new no more.
                back, to = centre[row][fresh], ids[fresh]
                yield pa.record_batch(
                    {
                        "node": pa.array(np.concatenate([owner, back, ids])),
                        "id": pa.array(np.concatenate([other, to, centre[row]])),
                        "s": pa.array(np.concatenate([s[real], near[fresh], near]).astype(np.float32)),
                        "fresh": pa.array(np.repeat([True, False], [len(owner) + len(back), len(ids)])),
                    }
                )

    none = F.lit(None).cast("binary").alias("packed")
    better = lists.select("at", "of").mapInArrow(compare, "node long, id long, s float, fresh boolean").withColumn("packed", none)
    known = graph.select("node", F.explode("links").alias("x")).select("node", "x.id", "x.s", "x.fresh", none)
    return keep_best(better.unionByName(known).unionByName(carriers(graph)), links)


def build_graph(packed: DataFrame, links: int = LINKS, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``node, packed, links``: the neighbour graph; only counts reach the driver."""
    nodes = packed.count()
    start = start_links(packed, nodes, links // 2, 0)
    for seed in range(1, STARTS):
        start = start.unionByName(start_links(packed, nodes, links // 2, seed))
    start = start.withColumn("fresh", F.lit(True)).withColumn("packed", F.lit(None).cast("binary"))
    graph = materialise(keep_best(start.unionByName(carriers(packed)), links), "graph")
    total = graph.select(F.sum(F.size("links"))).first()[0] or 0
    for number in range(rounds):
        graph = materialise(improved(graph, number, links), "graph")
        changed = graph.select(F.sum(F.size(F.filter("links", lambda x: x["fresh"])))).first()[0] or 0
        if changed <= STILL * total:
            break
    return graph


def build_index(packed: DataFrame, graph: DataFrame, links: int = LINKS) -> DataFrame:
    """``node, stretch, packed, near``: the best ``2 x links`` links of both directions."""
    edges = graph.select("node", F.explode("links").alias("x")).select("node", "x.id", "x.s")
    both = edges.unionByName(edges.select(F.col("id").alias("node"), F.col("node").alias("id"), "s"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("id").isNotNull(), F.desc("s"), "id"))
    none = F.lit(None)
    both = both.select("*", none.cast("double").alias("stretch"), none.cast("binary").alias("packed"))
    own = packed.select("node", none.cast("long").alias("id"), none.cast("float").alias("s"), "stretch", "packed")
    some = both.unionByName(own).withColumn("at", rank).filter(F.col("at") <= 2 * links + 1)
    return some.groupBy("node").agg(F.first("stretch", True).alias("stretch"), F.first("packed", True).alias("packed"), F.collect_set("id").alias("near"))


STATE = "q long, packed binary, pool array<struct<s: double, id: long>>, seen array<long>, todo array<long>, worst double"


def greedy_search(index: DataFrame, queries: DataFrame, entries: list[int], beam: int = BEAM) -> DataFrame:
    """``q, pool``: the ``beam`` best nodes found for each of ``queries`` (``q, packed, start``).

    ``packed`` has a last component of zero, ``start`` is a node or NULL.
    """
    first = F.array_distinct(F.filter(F.concat(F.array("start"), F.array(*map(F.lit, entries)).cast("array<long>")), lambda x: x.isNotNull()))
    none = F.lit(float("-inf"))
    state = queries.select("q", "packed", F.array().cast("array<struct<s: double, id: long>>").alias("pool"), first.alias("seen"), first.alias("todo"), none.alias("worst"))
    state = materialise(state, "state")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.einsum("ij,ij->i", _unpack(batch.column(3)), _unpack(batch.column(4))) * batch.column(5).to_numpy(zero_copy_only=False)
            good = s > batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.record_batch([*batch.columns[:2], pa.array(s), batch.column(6)], names=["q", "id", "s", "near"]).filter(pa.array(good))

    def follow(limit: int):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Few rows at a time: as Python objects, the links of many queries would fill the memory.
            for batch in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
                made: list[tuple] = []
                for pool, seen, found in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)], strict=True):
                    old = [(x["s"], x["id"]) for x in pool]
                    near = {x["id"]: x["near"] for x in found or ()}
                    best = sorted(old + [(x["s"], x["id"]) for x in found or ()], key=lambda x: (-x[0], x[1]))[:beam]
                    new = [i for _, i in best if i in near][:limit]
                    known = set(seen)
                    todo = [i for i in dict.fromkeys(j for n in new for j in near[n]) if i not in known]
                    worst = best[-1][0] if len(best) == beam else -float("inf")
                    made.append(([{"s": s, "id": i} for s, i in best], seen + todo, todo, worst))
                pools, seens, todos, worsts = ([m[i] for m in made] for i in range(4))
                pool_type = pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())]))
                ids = pa.list_(pa.int64())
                yield pa.record_batch(
                    [*batch.columns[:2], pa.array(pools, pool_type), pa.array(seens, ids), pa.array(todos, ids), pa.array(worsts, pa.float64())],
                    names=["q", "packed", "pool", "seen", "todo", "worst"],
                )

        return step

    done: list[DataFrame] = []
    limit = FIRST
    while True:
        look = state.select("q", "packed", "worst", F.explode("todo").alias("id"))
        met = look.join(index.select(F.col("node").alias("id"), F.col("packed").alias("of"), "stretch", "near"), "id").select("q", "id", "worst", "packed", "of", "stretch", "near")
        better = met.mapInArrow(score, "q long, id long, s double, near array<long>")
        # The states and what was found for them meet in one shuffle.
        none = F.lit(None)
        better = better.select("q", *[none.cast(state.schema[c].dataType).alias(c) for c in ("packed", "pool", "seen")], F.struct("s", "id", "near").alias("x"))
        own = state.select("q", "packed", "pool", "seen", none.cast(better.schema["x"].dataType).alias("x"))
        of_query = better.unionByName(own).repartition("q").groupBy("q")
        of_query = of_query.agg(*[F.first(c, True).alias(c) for c in ("packed", "pool", "seen")], F.collect_list("x").alias("found"))
        moved = of_query.mapInArrow(follow(limit), STATE)
        moved = materialise(moved, "state")
        done.append(moved.filter(F.size("todo") == 0).select("q", "pool"))
        state = moved.filter(F.size("todo") > 0)
        limit = beam
        if state.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def nearest(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", links: int = LINKS, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of every row whose id ``every`` divides."""
    given = usable(rows, id_col, vec_col)
    nodes = materialise(distinct_nodes(given, k + 1), "nodes")
    packed = materialise(packed_nodes(nodes), "packed")
    index = materialise(build_index(packed, build_graph(packed, links), links), "index")
    entries = [r["node"] for r in packed.orderBy(F.desc("norm"), F.xxhash64("node")).limit(ENTRIES).collect()]
    asked = given.filter(F.col("id") % every == 0).join(nodes.select("node", "vec"), "vec").select("id", "node")
    asked = materialise(asked, "asked")

    def as_query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = _unpack(batch.column(1))
            vecs[:, -1:] = 0
            yield pa.record_batch([batch.column(0), _pack(vecs), batch.column(0)], names=["q", "packed", "start"])

    queries = packed.select("node", "packed").join(asked.select("node").distinct(), "node", "left_semi").mapInArrow(as_query, "q long, packed binary, start long")
    pools = greedy_search(index, queries, entries, max(beam, k + 1))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", _matrix(batch.column(1)), _matrix(batch.column(2)))
                yield pa.record_batch([batch.column(0), pa.array(s), batch.column(3)], names=["q", "score", "ids"])

    ends = pools.select("q", F.explode("pool.id").alias("node")).join(nodes, "node")
    ends = ends.join(nodes.select(F.col("node").alias("q"), F.col("vec").alias("of")), "q").select("q", "of", "vec", "ids")
    scored = ends.mapInArrow(exact, "q long, score double, ids array<long>").select("q", "score", F.explode("ids").alias("id"))
    best = scored.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("at") <= k + 1)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("at", "id", "score"))).alias("of"))
    own = asked.join(lists, asked["node"] == lists["q"]).select("id", F.slice(F.filter("of", lambda x: x["id"] != F.col("id")), 1, k).alias("of"))
    return own.select(F.col("id").alias("query_id"), F.posexplode("of").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
