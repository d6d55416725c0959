"""Operator 9: token ids in binary files, coded by a context-mixing range coder.

Documents are range-partitioned by id and sorted; each task tokenises its
documents in order and writes segments. A segment has a directory (ids and
token counts of whole documents) and blocks of ``BLOCK`` token ids. Every
block starts from a reset model, has a checksum and can be read alone.

Order-0: a segment counts its ids, sorts them by count and cuts the list into
classes of about 1/256 of all counts, so ids of a class are about equally
frequent. The segment's header lists the ids of each class. A block starts from
the segment's shares of the classes and adapts them to its own ids; within a
class all ids get the same share. Order-1 and order-2: a context (the one or two
ids before) predicts one id with a confidence; their table starts empty in each
block, and a slot of it has both orders' cells of an id side by side. Adaptive weights per confidence mix the three. All arithmetic is on
integers, so writer and reader agree on any machine. A range coder with 56-bit
state and 16-bit output codes the result. The blocks of a segment are coded in
lock-step, one numpy lane per block; a step's calls cost much the same for few
lanes as for many, so a task's last ids join the segment before.

Segments are rows of a Parquet table (``part, number, first, n_ids, data``),
so any store that Spark writes to can hold them and a lost task leaves no half
file behind.

Defined cases: NULL text counts as empty (the end id alone); a NULL id comes
first; rows repeating an id are documents of their own, ordered by a hash of
their text; extra columns are ignored; an empty table gives an empty result.
A token id must be below 1,048,575 (checked).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dinelens.llm.common import materialise, shared_folder, text_or_empty
from dinelens.llm.tokens import encoder

MAGIC = b"TID3"
HEAD = "<4sIQIIII"
BLOCK = 1024
LANES = 3072  # of a segment; its last may have half as many more, so that few lanes are rare
SLOT_BITS = 9  # of the context table
SLOTS = 1 << SLOT_BITS
SHIFT = np.uint32(32 - SLOT_BITS)  # takes a 32-bit hash to a slot
CELL_BITS = 2  # a slot has a cell for the id before, the others are for that id and the one before it
ID_BITS = 20
NONE = (1 << ID_BITS) - 1
ONE = 4096  # what the shares of the three orders sum to
LEAST = 64  # of a prediction's weight, and of what lies above it
WEIGHTS = (64, 800, 2000, 3200)  # at first, by confidence
CLASSES = 256
PLACE_BITS = 15
LARGEST = 1 << PLACE_BITS  # ids of a class, so that an id's share is never empty
PRIOR = 1024  # ids of a block that the segment's shares of the classes count for
TOTAL_BITS = 12
TOTAL = 1 << TOTAL_BITS  # of the class frequencies
FULL = 1 << 40  # the coder's width stays at or above this
LOW = FULL - 1
WORDS = 800_000  # remembered by a worker's encoder
ROOM_STEPS = 32  # between looks at the room for code words


class Classes:
    """Ids of a segment by falling count, cut into classes of about equal weight."""

    def __init__(self, ranked: np.ndarray, starts: np.ndarray, weights: np.ndarray):
        self.ranked, self.starts, self.weights = ranked, starts, weights
        self.sizes = np.diff(np.append(starts, len(ranked)))
        order = np.repeat(np.arange(len(starts)), self.sizes)
        place = np.arange(len(ranked)) - starts[order]
        top = int(ranked.max()) + 1
        self.class_of, self.place_of = np.zeros(top, np.int64), np.zeros(top, np.int64)
        self.class_of[ranked], self.place_of[ranked] = order, place
        self.both_of = (self.class_of << PLACE_BITS | self.place_of).astype(np.int32)

    @classmethod
    def count(cls, ids: np.ndarray) -> Classes:
        n = np.bincount(ids)
        ranked = np.flatnonzero(n)
        ranked = ranked[np.argsort(-n[ranked], kind="stable")]
        weight = n[ranked]
        share = (np.cumsum(weight) - weight) * CLASSES // weight.sum()
        starts = np.flatnonzero(np.diff(share, prepend=-1))
        ends = np.append(starts[1:], len(ranked))
        starts = np.concatenate([np.arange(a, b, LARGEST) for a, b in zip(starts, ends, strict=True)])
        # Within a class the order doesn't matter; rising ids pack better.
        ranked = ranked[np.lexsort((ranked, np.searchsorted(starts, np.arange(len(ranked)), "right")))]
        weights = np.add.reduceat(weight, starts)
        return cls(ranked, starts, np.maximum(1, weights * PRIOR // weights.sum()))

    def to_bytes(self) -> bytes:
        steps = np.diff(self.ranked, prepend=0)
        numbers = np.concatenate([self.sizes, self.weights, steps]).astype("<i4")
        planes = numbers.view(np.uint8).reshape(-1, 4).T  # alike bytes side by side
        packer = zlib.compressobj(9, strategy=zlib.Z_RLE)
        return struct.pack("<I", len(self.starts)) + packer.compress(planes.tobytes()) + packer.flush()

    @classmethod
    def from_bytes(cls, data: bytes) -> Classes:
        (k,) = struct.unpack_from("<I", data)
        planes = np.frombuffer(zlib.decompress(data[4:]), np.uint8).reshape(4, -1).T
        numbers = np.ascontiguousarray(planes).view("<i4").ravel().astype(np.int64)
        sizes, weights, steps = numbers[:k], numbers[k : 2 * k], numbers[2 * k :]
        return cls(np.cumsum(steps), np.cumsum(sizes) - sizes, weights)


def _refreshes(step: int) -> bool:
    """Class frequencies are renewed at 32, 64, 128, 256 and then every 256 ids."""
    return step >= 32 and (step & (step - 1) == 0 or step % 256 == 0)


class _Model:
    """The predictions of ``lanes`` blocks at once."""

    def __init__(self, lanes: int, classes: Classes):
        self.lanes, self.k = lanes, len(classes.starts)
        # Of both orders, order 2 first. Alike slots of all lanes lie together, so those in much use stay in the processor's cache.
        self.lane = np.arange(lanes)
        self.row, self.cells = self.lane * self.k, np.stack([self.lane, self.lane + len(WEIGHTS) * lanes])
        # A context's entry is its predicted id and, above that, the confidence.
        self.entries = np.full((SLOTS << CELL_BITS) * lanes, NONE, np.int32)
        self.weights = np.tile(np.repeat(np.array(WEIGHTS, np.int32), lanes), 2)  # at first by confidence
        self.before1, self.hashed2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.hashes = np.zeros((2, lanes), np.uint32)
        self.counts = np.tile(classes.weights.astype(np.int32), (lanes, 1))
        self.seen: list[np.ndarray] = []
        self.step = 0
        self._frequencies()

    def _frequencies(self) -> None:
        if self.seen:
            self.counts += np.bincount(np.concatenate(self.seen), minlength=self.counts.size).reshape(self.counts.shape)
            self.seen = []
        freq = 1 + self.counts * (TOTAL - self.k) // self.counts.sum(axis=1, keepdims=True, dtype=np.int32)
        freq[:, 0] += TOTAL - freq.sum(axis=1, dtype=np.int32)
        self.freq = freq
        # Of each class: where its share begins and, above 16 bits, how large it is.
        self.shares = (np.cumsum(freq, axis=1, dtype=np.int32) - freq + (freq << 16)).ravel()

    def inverse(self) -> np.ndarray:
        """The class of each of the ``TOTAL`` places, lane by lane."""
        return np.repeat(np.tile(np.arange(self.k, dtype=np.uint8 if self.k <= 256 else np.uint16), self.lanes), self.freq.ravel())

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two predicted ids, and the ends of their shares of ``ONE``."""
        hashes = self.hashes
        np.multiply(self.before1, np.uint32(2246822519), out=hashes[0])
        hashes[0] ^= self.hashed2
        np.multiply(self.before1, np.uint32(2654435761), out=hashes[1])
        hashes[0] >>= 16
        hashes[0] *= (1 << CELL_BITS) - 1
        hashes[0] >>= 16
        hashes[1] >>= SHIFT
        self.at = at = hashes.astype(np.int64)
        at[1] *= self.lanes
        at[1] += self.lane
        at[1] <<= CELL_BITS
        at[0] += at[1]
        at[0] += 1
        self.entry = self.entries.take(self.at)
        self.cell = (self.entry >> ID_BITS).astype(np.int64)
        self.cell *= self.lanes
        self.cell += self.cells
        self.w = self.weights.take(self.cell)
        w2, w1 = self.w
        return self.entry & NONE, w2.astype(np.int64), (w2 + ((ONE - w2) * w1 >> 12)).astype(np.int64)

    def update(self, ids: np.ndarray, place: np.ndarray, hits: np.ndarray) -> None:
        """``place``: of the ids' classes in all lanes' shares; ``hits``: whether the order-2 and the order-1 prediction were right."""
        right = hits.astype(np.int32)
        step = right * (ONE - 2 * LEAST)
        step += LEAST
        step -= self.w
        step >>= 4
        step += self.w
        self.weights[self.cell.ravel()] = step.ravel()
        surer = self.entry
        surer += 1 << ID_BITS
        np.minimum(surer, ids | 3 << ID_BITS, out=surer)
        surer -= ids
        surer *= right
        surer += ids
        self.entries[self.at.ravel()] = surer.ravel()
        self.seen.append(place)
        self.hashed2 = self.before1 * np.uint32(3266489917)
        self.before1 = ids.view(np.uint32) + np.uint32(1)
        self.step += 1
        if _refreshes(self.step):
            self._frequencies()


def turned(a: np.ndarray) -> np.ndarray:
    """The transposed array, made by a few rows at a time, as rows of 4,096 bytes share places in a processor's cache."""
    out = np.empty(a.shape[::-1], a.dtype)
    for i in range(0, len(a), 8):
        out[:, i : i + 8] = a[i : i + 8].T
    return out


def encode_blocks(ids: np.ndarray, classes: Classes) -> list[bytes]:
    """Code words of each row of a (lanes, steps) array of ids."""
    lanes, steps = ids.shape
    model = _Model(lanes, classes)
    low, width = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    # Words of all lanes lie together. An id takes three at most, mostly half of one; more room is made as it is needed.
    room = steps // 2 + 3 * ROOM_STEPS + 5
    out = np.zeros(lanes * room, np.uint32)
    lane = np.arange(lanes)
    at = lane.copy()
    for step, x in enumerate(turned(ids).view(np.int32)):
        if step % ROOM_STEPS == 0 and int(at.max()) // lanes + 3 * ROOM_STEPS + 5 > room:
            more = steps // 4 + 3 * ROOM_STEPS
            out = np.concatenate([out, np.zeros(lanes * more, np.uint32)])
            room += more
        predicted, a, b = model.predict()
        hits = predicted == x
        right2, right1 = hits
        hit1 = right1 & ~right2 & (b > a)  # a share may be too small to code
        hit = right2 | hit1
        unit = width >> 12
        end2, end1 = a * unit, b * unit
        both = classes.both_of.take(x)
        cls = (both >> PLACE_BITS).astype(np.int64)
        place = model.row + cls
        share = model.shares.take(place).astype(np.int64)
        unit = (width - end1) >> TOTAL_BITS
        part = (share >> 16) * unit // classes.sizes.take(cls)
        share &= 0xFFFF
        share *= unit
        share += end1
        share += (both & LARGEST - 1) * part
        first, either = -right2.astype(np.int64), -hit.astype(np.int64)  # masks; a choice by them is faster than np.where
        begin = end2 & ~first
        low += share ^ (share ^ begin) & either
        end1 ^= (end1 ^ end2) & first
        end1 -= begin
        width = part ^ (part ^ end1) & either
        model.update(x, place, hits)
        # Words may have 17 bits; the carry is passed on at the end. A lane that
        # need not move writes its next place in vain.
        need = width < FULL
        out[at] = (low >> 40).astype(np.uint32)
        need = need.astype(np.int64)
        low &= (need - 1) | LOW
        at += need * lanes
        need <<= 4
        low <<= need
        width <<= need
        k = np.flatnonzero(width < FULL)
        while len(k):
            out[at[k]] = low[k] >> 40
            low[k] = (low[k] & LOW) << 16
            width[k] <<= 16
            at[k] += lanes
            k = k[width[k] < FULL]
    # The width is at least one word's unit, so one word names a place inside it.
    out[at] = (low + LOW) >> 40
    at += lanes
    out = out.reshape(room, lanes)
    at //= lanes
    for j in range(int(at.max()) - 1, 0, -1):
        out[j - 1] += out[j] >> 16
    words = turned((out & 0xFFFF).astype(">u2"))
    # The first byte is always zero: the width began at 48 of 56 bits.
    return [words[i, : at[i]].tobytes()[1:] for i in range(lanes)]


def decode_blocks(blocks: list[bytes], steps: int, classes: Classes) -> np.ndarray:
    """Inverse of ``encode_blocks``."""
    lanes = len(blocks)
    room = max(len(b) for b in blocks) // 2 + 5
    words = np.zeros((lanes, room), np.uint16)
    for i, b in enumerate(blocks):
        words[i, : (len(b) + 1) // 2] = np.frombuffer(b + b"\0" * (len(b) % 2), ">u2")
    words = turned(words)
    model = _Model(lanes, classes)
    inverse, step_of = model.inverse(), 0
    code = (words[0].astype(np.int64) << 32) | (words[1].astype(np.int64) << 16) | words[2]
    width = np.full(lanes, 1 << 48, np.int64)
    lane = np.arange(lanes)
    at, last = lane + 3 * lanes, lane + (room - 1) * lanes
    words = words.ravel()
    lane *= TOTAL
    out = np.zeros((steps, lanes), np.int32)
    for s in range(steps):
        if model.step != step_of and _refreshes(model.step):
            inverse, step_of = model.inverse(), model.step
        predicted, a, b = model.predict()
        unit = width >> 12
        end2, end1 = a * unit, b * unit
        hit2, hit = code < end2, code < end1
        unit = (width - end1) >> TOTAL_BITS
        c = code - end1
        # Below zero where a prediction was right; what comes of it then isn't used.
        cls = inverse.take(lane + np.minimum(np.maximum(c // unit, 0), TOTAL - 1)).astype(np.int64)
        place = model.row + cls
        share = model.shares.take(place).astype(np.int64)
        sizes = classes.sizes.take(cls)
        part = (share >> 16) * unit // sizes
        share &= 0xFFFF
        share *= unit
        c -= share
        rest = np.minimum(np.maximum(c // part, 0), sizes - 1)
        first, either = -hit2.astype(np.int64), -hit.astype(np.int64)  # masks, as in encode_blocks
        p2, p1 = predicted
        x = classes.ranked.take(classes.starts.take(cls) + rest).astype(np.int32)
        x ^= (x ^ p1 ^ (p1 ^ p2) & first.astype(np.int32)) & either.astype(np.int32)
        begin = end2 & ~first
        rest *= part
        c -= rest
        code -= begin
        code = c ^ (c ^ code) & either
        end1 ^= (end1 ^ end2) & first
        end1 -= begin
        width = part ^ (part ^ end1) & either
        # A damaged block may name an id that the segment doesn't have; its checksum tells.
        model.update(x, model.row + (classes.both_of.take(x, mode="clip") >> PLACE_BITS), predicted == x)
        out[s] = x
        need = width < FULL
        need = need.astype(np.int64)
        word = words.take(at) * need
        at += need * lanes
        np.minimum(at, last, out=at)
        need <<= 4
        code <<= need
        code |= word
        width <<= need
        k = np.flatnonzero(width < FULL)
        while len(k):
            code[k] = code[k] << 16 | words[at[k]]
            width[k] <<= 16
            at[k] = np.minimum(at[k] + lanes, last[k])
            k = k[width[k] < FULL]
    return turned(out).view(np.uint32)


def check_ids(ids: np.ndarray) -> None:
    if ids.max(initial=0) >= NONE:
        raise ValueError(f"a token id does not fit {ID_BITS} bits")


def pack_segment(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    """One segment: header, directory, classes, block table, blocks."""
    n = len(ids)
    steps = min(BLOCK, max(1, n))
    lanes = max(1, -(-n // steps))
    padded = np.full(lanes * steps, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    rows = padded.reshape(lanes, steps)
    classes = Classes.count(padded)
    blocks = encode_blocks(rows, classes)
    sums = [zlib.crc32(rows[i].astype("<u4").tobytes()) for i in range(lanes)]
    ranked = classes.to_bytes()
    null = np.array([d is None for d in doc_ids], np.uint8)
    directory = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(counts, "<u8").tobytes() + null.tobytes())
    head = struct.pack(HEAD, MAGIC, len(doc_ids), n, lanes, steps, len(directory), len(ranked))
    table = np.array([[len(b) for b in blocks], sums], "<u4").tobytes()
    return b"".join([head, directory, ranked, table, *blocks])


def read_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their token counts, and all token ids; raises if a checksum fails."""
    magic, n_docs, n, lanes, steps, size, ranked = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = struct.calcsize(HEAD)
    directory = zlib.decompress(data[at : at + size])
    at += size
    classes = Classes.from_bytes(data[at : at + ranked])
    at += ranked
    doc_ids = np.frombuffer(directory, "<i8", n_docs).tolist()
    counts = np.frombuffer(directory, "<u8", n_docs, 8 * n_docs).astype(np.int64)
    null = np.frombuffer(directory, np.uint8, n_docs, 16 * n_docs)
    table = np.frombuffer(data, "<u4", 2 * lanes, at).reshape(2, lanes)
    at += 8 * lanes
    ends = np.concatenate([[0], np.cumsum(table[0], dtype=np.int64)]) + at
    rows = decode_blocks([data[ends[i] : ends[i + 1]] for i in range(lanes)], steps, classes)
    rows = rows.astype("<u4")
    for i in range(lanes):
        if zlib.crc32(rows[i].tobytes()) != table[1, i]:
            raise ValueError(f"checksum of block {i} differs")
    return [None if z else d for d, z in zip(doc_ids, null.tolist(), strict=True)], counts, rows.reshape(-1)[:n]


def segments(docs: Iterator[tuple[int | None, np.ndarray]]) -> Iterator[tuple[list, list[int], np.ndarray]]:
    """Whole documents for one segment after another: their ids, token counts and token ids.

    Each has ``BLOCK * LANES`` token ids or a document's more. The last has half to one and a half times as many, if it isn't the only one.
    """
    names: list = []
    held: list[np.ndarray] = []
    size, cut, full = 0, 0, BLOCK * LANES

    def taken(n: int) -> tuple[list, list[int], np.ndarray]:
        nonlocal size
        some = names[:n], [len(v) for v in held[:n]], np.concatenate(held[:n])
        del names[:n], held[:n]
        size -= len(some[2])
        return some

    for name, v in docs:
        names.append(name)
        held.append(v)
        size += len(v)
        if not cut and size >= full:
            cut = len(names)
        if 2 * size >= 3 * full:
            yield taken(cut)
            cut = len(names) if size >= full else 0
    if names:
        yield taken(len(names))


FILE = "part int, number int, first long, n_ids long, data binary"


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, in ascending id order, as segments under ``path``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("t", F.xxhash64("text")).repartitionByRange("doc_id", "t").sortWithinPartitions("doc_id", "t")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, WORDS)
        part = TaskContext.get().partitionId()
        first = 0

        def coded() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for name, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                    v = np.frombuffer(ids + end, "<u4")
                    check_ids(v)
                    yield name, v

        for number, (names, counts, ids) in enumerate(segments(coded())):
            data = pack_segment(names, counts, ids)
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())]
            first += len(ids)
            yield pa.RecordBatch.from_arrays(row, ["part", "number", "first", "n_ids", "data"])

    rows.select("doc_id", "text").mapInArrow(run, FILE).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: every document's ids (little-endian unsigned 32-bit), read from the files."""
    files = spark.read.schema(FILE).parquet(path)
    # One row per writing task, so the ordered window over all is small.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = materialise(totals.select(F.col("part").alias("base_part"), F.coalesce(before, F.lit(0)).alias("base")), "bases")
    rows = files.join(bases, F.col("part") == F.col("base_part")).select((F.col("base") + F.col("first")).alias("first"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, counts, ids = read_segment(data.as_py())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                for at in range(0, len(names), 4096):
                    to = min(at + 4096, len(names))
                    spans = [(int(e - c), int(e)) for e, c in zip(ends[at:to], counts[at:to], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names[at:to], pa.int64()),
                            pa.array([first + a for a, _ in spans], pa.int64()),
                            pa.array([b - a for a, b in spans], pa.int64()),
                            pa.array([bytes(raw[4 * a : 4 * b]) for a, b in spans], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/token_files"
