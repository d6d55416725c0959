"""Spelling variant grouping by a frequency-vector trie.

Words: maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, ASCII
letters folded. A document and run whose crc32 a divisor divides lose one code
point, which plants misspellings to find. Words of ``least_chars`` code points
and ``least_count`` occurrences are kept.

Trie: letters are dealt into groups; level i of the trie is the number of a
word's letters in group i. One inserted, deleted or replaced code point raises
at most one count by one and lowers at most one by one, so a depth-first search
from a word's counts spends a surplus of one and a deficit of one, and the
words of the leaves it reaches are verified.

Spark deals the trie by its first levels, as many as are needed for subtrees of
at most ``max_subtree`` words. A word goes to the subtree of its own counts and
to every existing one within the budget, in one direction of the two. If even
whole vectors are shared by more words, their subtree is dealt into cells of a
block of its words and a block of its visitors. No task holds more.

Defined cases: NULL and empty texts hold no words; a NULL id reads as '' where
words are hashed; repeated rows count each; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinelens.llm.common import materialise

LEVELS = 16
MAX_SUBTREE = 20_000
MAX_HELD = 400_000  # words counted by a task before it writes them out
MAX_PAIRS = 200_000  # candidates verified at once
WIDE = 64  # letters of a word that fits the verification's table; longer words are compared singly
BASE = 48  # character of a count of 0 in a vector string


def word_counts(docs: DataFrame, least_chars: int = 6, least_count: int = 5, divisor: int = 199) -> DataFrame:
    """``word, n``: words of at least ``least_chars`` code points and ``least_count`` occurrences."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_chars)

    def flush(held: dict[str, int]) -> Iterator[pa.RecordBatch]:
        words = list(held)
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.record_batch({"word": pa.array(part, pa.string()), "n": pa.array([held[w] for w in part], pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                start = zlib.crc32(key.encode() + b":")
                # Bytes fold ASCII letters alone. A shorter run can't become long enough.
                for run, n in Counter(runs.findall(text.lower().decode())).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % divisor == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_chars:
                            continue
                    held[run] = held.get(run, 0) + n
                if len(held) > MAX_HELD:
                    yield from flush(held)
                    held = {}
        yield from flush(held)

    given = docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = given.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least_count)


def letter_groups(words: DataFrame, levels: int = LEVELS) -> dict[str, int]:
    """Group of each letter of the alphabet, by the words that hold it.

    The most frequent letters get a group each, which cuts best at the trie's
    top; the others share the last groups in turn. At most 90 rows are collected.
    """
    counted = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    rows = sorted((-r["n"], r["c"]) for r in counted.collect() if r["c"])
    alone = max(1, levels - 4)
    return {c: i if i < alone else alone + (i - alone) % (levels - alone) if levels > alone else i % levels for i, (_, c) in enumerate(rows)}


def with_vectors(words: DataFrame, groups: dict[str, int], levels: int = LEVELS) -> DataFrame:
    """``word, n, vec``: ``vec`` spells the counts of the groups, a character each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for word in batch.column(0).to_pylist():
                counts = [0] * levels
                for c in word:
                    counts[groups[c]] += 1
                # Surrogates are no characters: very long words share the highest count.
                made.append("".join(chr(BASE + min(k, 50_000)) for k in counts))
            yield pa.record_batch({"word": batch.column(0), "n": batch.column(1), "vec": pa.array(made, pa.string())})

    return words.select("word", "n").mapInArrow(run, "word string, n long, vec string")


def shard_levels(vectors: DataFrame, levels: int = LEVELS, max_subtree: int = MAX_SUBTREE) -> tuple[int, int]:
    """The fewest first levels that give subtrees of at most ``max_subtree`` words, and the largest's words."""
    depth, largest = 0, 0
    while depth < levels:
        depth += 1
        largest = vectors.groupBy(F.substring("vec", 1, depth)).agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
        if largest <= max_subtree:
            break
    return depth, largest


def within_budget(prefix: str) -> list[str]:
    """The prefixes that a surplus of one and a deficit of one reach, not below the given one."""
    out = [prefix]
    ups = [prefix[:i] + chr(ord(c) + 1) + prefix[i + 1 :] for i, c in enumerate(prefix)]
    for i, c in enumerate(prefix):
        if ord(c) > BASE:
            less = chr(ord(c) - 1)
            out.append(prefix[:i] + less + prefix[i + 1 :])
            out += [up[:i] + less + up[i + 1 :] for j, up in enumerate(ups) if j != i]
    return [p for p in out + ups if p >= prefix]


def visits(vectors: DataFrame, depth: int) -> DataFrame:
    """``key, word, n, vec``: every word in each subtree that it searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [within_budget(v[:depth]) for v in batch.column(2).to_pylist()]
            row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            flat = pa.array([k for of in keys for k in of], pa.string())
            yield pa.record_batch([flat, *[batch.column(i).take(pa.array(row)) for i in range(3)]], names=["key", "word", "n", "vec"])

    return vectors.select("word", "n", "vec").mapInArrow(run, "key string, word string, n long, vec string")


def cells(vectors: DataFrame, depth: int, largest: int, max_subtree: int = MAX_SUBTREE) -> DataFrame:
    """``cell, visitor, word, n, vec``: the words of a subtree, then those that visit it."""
    own = vectors.withColumn("key", F.substring("vec", 1, depth))
    size = own.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    guests = visits(vectors, depth).join(size, "key", "left_semi")
    if largest <= max_subtree:
        one = F.col("key").alias("cell")
        return own.select(one, F.lit(False).alias("visitor"), "word", "n", "vec").unionByName(guests.select(one, F.lit(True).alias("visitor"), "word", "n", "vec"))
    guests = materialise(guests, "visits")
    size = size.join(guests.groupBy("key").agg(F.count(F.lit(1)).alias("g")), "key")
    size = size.select("key", F.ceil(F.col("m") / max_subtree).alias("rows"), F.ceil(F.col("g") / max_subtree).alias("columns"))

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("word"), F.col(mine)).alias("mine")
        rows = df.join(size, "key").select("key", "word", "n", "vec", block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"))
        at = ["mine", "other"] if mine == "rows" else ["other", "mine"]
        return rows.select(F.concat_ws(" ", "key", *at).alias("cell"), F.lit(mine == "columns").alias("visitor"), "word", "n", "vec")

    return dealt(own, "rows", "columns").unionByName(dealt(guests, "columns", "rows"))


class Trie:
    """Vectors of equal length as nested dicts; a leaf holds the place of its vector."""

    def __init__(self, vectors: list[str]):
        self.root: dict = {}
        for place, vec in enumerate(vectors):
            node = self.root
            for c in vec[:-1]:
                node = node.setdefault(ord(c), {})
            node[ord(vec[-1])] = place

    def search(self, vec: str) -> list[int]:
        """Places of the vectors with at most one count one higher and at most one count one lower."""
        found: list[int] = []
        counts, last = [ord(c) for c in vec], len(vec) - 1
        stack = [(self.root, 0, 1, 1)]
        while stack:
            node, level, surplus, deficit = stack.pop()
            at = counts[level]
            steps = ((at, surplus, deficit),)
            if surplus:
                steps += ((at + 1, 0, deficit),)
            if deficit:
                steps += ((at - 1, surplus, 0),)
            for count, more, less in steps:
                below = node.get(count)
                if below is None:
                    continue
                if level == last:
                    found.append(below)
                else:
                    stack.append((below, level + 1, more, less))
        return found


class Letters:
    """Words as rows of code points, aligned at the left and at the right; those above ``WIDE`` letters as text only."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        size = np.where(self.size <= WIDE, self.size, 0)
        wide = int(size.max(initial=0)) + 1
        self.left, self.right = np.zeros((len(words), wide), np.uint8), np.zeros((len(words), wide), np.uint8)
        flat = np.frombuffer("".join(w for w in words if len(w) <= WIDE).encode("latin-1"), np.uint8)
        row = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        self.left[row, at] = flat
        self.right[row, wide - size[row] + at] = flat


def one_apart(a: Letters, b: Letters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether word ``i`` of ``a`` and ``j`` of ``b`` differ by exactly one insertion, deletion or replacement.

    So they do if the letters that both begin with and those that both end
    with leave one letter of the longer word.
    """
    n, m = a.size[i], b.size[j]
    out = np.abs(n - m) <= 1
    for k in np.flatnonzero(out & (np.maximum(n, m) > WIDE)).tolist():
        out[k] = _one_apart(a.words[i[k]], b.words[j[k]])
    short = np.flatnonzero(out & (np.maximum(n, m) <= WIDE))
    if len(short):
        i, j, n, m = i[short], j[short], n[short], m[short]
        wide = min(a.left.shape[1], b.left.shape[1])  # one more than the longest word of either
        heads, tails = a.left[i, :wide] != b.left[j, :wide], (a.right[i, -wide:] != b.right[j, -wide:])[:, ::-1]
        out[short] = heads.any(axis=1) & (heads.argmax(axis=1) + tails.argmax(axis=1) >= np.maximum(n, m) - 1)
    return out


def _one_apart(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    head = len(os.path.commonprefix((a, b)))
    return a[head + (len(a) >= len(b)) :] == b[head + (len(b) >= len(a)) :]


def near_in_cell(own: list[tuple[str, int, str]], guests: list[tuple[str, int, str]]) -> tuple[list[str], list[str], list[int], list[int]]:
    """Near pairs of a word that visits and a word of the subtree: words and counts.

    Visitors of the subtree's own key meet each pair twice; the lower word counts.
    """
    out: tuple[list[str], list[str], list[int], list[int]] = ([], [], [], [])
    if not own or not guests:
        return out
    own.sort(key=lambda r: r[2])
    guests.sort(key=lambda r: r[2])
    leaves = _runs([r[2] for r in own])
    trie = Trie([own[a][2] for a, _ in leaves])
    left, right = Letters([r[0] for r in guests]), Letters([r[0] for r in own])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def verify() -> None:
        i, j = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        for at in range(0, len(i), MAX_PAIRS):
            some_i, some_j = i[at : at + MAX_PAIRS], j[at : at + MAX_PAIRS]
            good = one_apart(left, right, some_i, some_j)
            for x, y in zip(some_i[good].tolist(), some_j[good].tolist(), strict=True):
                (a, n, va), (b, m, vb) = guests[x], own[y]
                if (va, a) < (vb, b):
                    for column, value in zip(out, (a, b, n, m), strict=True):
                        column.append(value)

    for a, b in _runs([r[2] for r in guests]):
        for leaf in trie.search(guests[a][2]):
            c, d = leaves[leaf]
            for at in range(a, b, max(1, MAX_PAIRS // (d - c))):
                end = min(b, at + max(1, MAX_PAIRS // (d - c)))
                held.append((np.repeat(np.arange(at, end), d - c), np.tile(np.arange(c, d), end - at)))
                size += (end - at) * (d - c)
                if size > MAX_PAIRS:
                    verify()
                    held, size = [], 0
    if held:
        verify()
    return out


def _runs(keys: list[str]) -> list[tuple[int, int]]:
    starts = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
    return list(zip(starts, [*starts[1:], len(keys)], strict=True))


def near_pairs(words: DataFrame, levels: int = LEVELS, max_subtree: int = MAX_SUBTREE) -> DataFrame:
    """``a, b, na, nb``: every two words (and their counts) that are one edit apart, once."""
    vectors = materialise(with_vectors(words, letter_groups(words, levels), levels), "vectors")
    depth, largest = shard_levels(vectors, levels, max_subtree)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own, guests = None, [], []

        def done() -> pa.RecordBatch:
            a, b, na, nb = near_in_cell(own, guests)
            return pa.record_batch({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "na": pa.array(na, pa.int64()), "nb": pa.array(nb, pa.int64())})

        for batch in batches:
            for key, visitor, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != cell:
                    if cell is not None:
                        yield done()
                    cell, own, guests = key, [], []
                (guests if visitor else own).append(tuple(row))
        if cell is not None:
            yield done()

    dealt = cells(vectors, depth, largest, max_subtree).repartition("cell").sortWithinPartitions("cell")
    return dealt.select("cell", "visitor", "word", "n", "vec").mapInArrow(search, "a string, b string, na long, nb long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of the chain of forms of each word that has one.

    Counts grow along a chain by a factor, so chains are short; each round
    doubles the steps that a word has taken.
    """
    step = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = materialise(moved, "roots")
        step = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return step


def variants(docs: DataFrame, least_chars: int = 6, least_count: int = 5, divisor: int = 199, factor: int = 5, levels: int = LEVELS, max_subtree: int = MAX_SUBTREE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word.

    A form is the near word with the largest count (ties: the first in code-point
    order) if that is at least ``factor`` times the word's.
    """
    words = materialise(word_counts(docs, least_chars, least_count, divisor), "words")
    pairs = materialise(near_pairs(words, levels, max_subtree), "near")
    one = F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.struct((-F.col("nb")).alias("order"), F.col("b").alias("form")).alias("near"))
    two = F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.struct((-F.col("na")).alias("order"), F.col("a").alias("form")).alias("near"))
    ends = pairs.select(F.explode(F.array(one, two)).alias("x")).select("x.*")
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"), F.min("near").alias("near"))
    good = -F.col("near.order") >= factor * F.col("n")
    best = materialise(best.select("word", "n_near", F.when(good, F.col("near.form")).alias("form"), F.when(good, -F.col("near.order")).alias("form_n")), "forms")
    ends_at = roots(best.filter("form IS NOT NULL"))
    found = words.join(best, "word", "left").join(ends_at, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
