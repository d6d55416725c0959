"""Search index for the explorer: trigram posting lists.

A listing's search is a case-insensitive regular expression over a text column.
Without an index every text is read and matched. The index holds, for each
trigram of the folded texts, the places of the rows that contain it. A search
takes the trigrams that every match must contain from the pattern, intersects
their posting lists and runs the exact expression on the rows that are left.
Nothing is lost: a pattern whose trigrams can't be told runs over all rows.

Places: rows are numbered when the index is written; a part is
``rows_per_part`` consecutive numbers. A posting row is one trigram in one
part, so no list is longer than a part, however frequent its trigram is, and
lists are intersected part by part. The postings are sorted by trigram and the
texts by part, so Parquet's statistics skip what a search doesn't need.

Folding: only trigrams of printable ASCII and of scripts without case are kept.
Four other letters match an ASCII letter when case is ignored; they are folded
to it. So any text that matches a run of such characters has its trigrams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dinelens.functions.search import rx_search

ROWS_PER_PART = 8192
MAX_PUSHED_PARTS = 1000  # parts named in the scan's filter; beyond them the join alone picks the rows

# Characters whose trigrams are kept, as a class of regular
# expressions, and the letters that are folded to lower-case ASCII.
SAFE = r"\x20-\x40\x5B-\x7E؀-࿿぀-鿿가-힣"
FOLD_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "ſKıİ"
FOLD_TO = "abcdefghijklmnopqrstuvwxyz" + "skii"
META = set("\\^$.|?*+()[]{}")
BREAKING_ESCAPES = set("dDwWsSbBAzZGhHvVR")  # one character of a class, or none

_SAFE_RANGES = ((0x20, 0x40), (0x5B, 0x7E), (0x600, 0xFFF), (0x3040, 0x9FFF), (0xAC00, 0xD7A3))


def folded(text: str | Column) -> Column:
    return F.translate(F.col(text) if isinstance(text, str) else text, FOLD_FROM, FOLD_TO)


def text_grams(text: str | Column) -> Column:
    """Distinct trigrams of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit(f"(?=([{SAFE}]{{3}}))"), F.lit(1)))


def _fold_char(c: str) -> str | None:
    """The folded character if its trigrams are kept, else None."""
    at = FOLD_FROM.find(c)
    c = FOLD_TO[at] if at >= 0 else c
    return c if any(a <= ord(c) <= b for a, b in _SAFE_RANGES) else None


def _literal_runs(pattern: str) -> list[list[str]] | None:
    """For each top-level alternative the runs of characters that every match holds.

    None where the pattern has something that this reading doesn't know.
    """
    alternatives: list[list[str]] = [[]]
    run: list[str] = []

    def end() -> None:
        if run:
            alternatives[-1].append("".join(run))
            run.clear()

    i = 0
    while i < len(pattern):
        c = pattern[i]
        atom = None  # a literal character, if one was read
        if c == "\\":
            if i + 1 == len(pattern):
                return None
            c = pattern[i + 1]
            if c.isalnum():
                if c not in BREAKING_ESCAPES:
                    return None
                end()
            else:
                atom = c
            i += 2
        elif c == "[":
            i = _after_class(pattern, i)
            if i < 0:
                return None
            end()
        elif c == "(":
            i = _after_group(pattern, i)
            if i < 0:
                return None
            end()
        elif c == "|":
            end()
            alternatives.append([])
            i += 1
            continue
        elif c in ".^$":
            end()
            i += 1
        elif c in META and c not in "]}":
            return None  # a quantifier of nothing, or an unopened bracket
        else:
            atom = c
            i += 1
        kept = None if atom is None else _fold_char(atom)
        if atom is not None and kept is None:
            end()
        quantifier = pattern[i : i + 1]
        if quantifier in ("*", "?", "{"):
            if quantifier == "{":
                close = pattern.find("}", i)
                if close < 0 or not all(x.isdigit() or x == "," for x in pattern[i + 1 : close]):
                    return None
                i = close
            i += 1
            end()  # the repeated atom may be missing
        elif quantifier == "+":
            if kept:
                run.append(kept)
            i += 1
            end()
        elif kept:
            run.append(kept)
            continue
        else:
            continue
        if pattern[i : i + 1] in ("?", "+") and pattern[i : i + 1]:
            i += 1
    end()
    return alternatives


def _after_class(pattern: str, i: int) -> int:
    """Behind a plain ``[...]``; -1 for nested classes and intersections."""
    i += 2 if pattern[i + 1 : i + 2] == "^" else 1
    if pattern[i : i + 1] == "]":
        return -1
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 2
        elif pattern[i] == "[" or pattern.startswith("&&", i):
            return -1
        elif pattern[i] == "]":
            return i + 1
        else:
            i += 1
    return -1


def _after_group(pattern: str, i: int) -> int:
    """Behind a plain group; -1 for ``(?`` and anything unbalanced."""
    depth = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1 : i + 2] in ("Q", "E"):
                return -1
            i += 2
            continue
        if c == "[":
            i = _after_class(pattern, i)
            if i < 0:
                return -1
            continue
        if c == "(":
            if pattern[i + 1 : i + 2] == "?":
                return -1
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return -1


def pattern_grams(pattern: str, literal: bool = False) -> list[set[str]] | None:
    """Sets of trigrams, of which every matching text holds one set whole; None if there is no such promise."""
    if literal:
        kept = [_fold_char(c) for c in pattern]
        runs = [["".join(c or "\0" for c in kept)]]
    else:
        found = _literal_runs(pattern)
        if found is None:
            return None
        runs = found
    sets = [{r[i : i + 3] for r in of for i in range(len(r) - 2) if "\0" not in r[i : i + 3]} for of in runs]
    return sets if all(sets) else None


@dataclass(frozen=True)
class TextIndex:
    """An index under ``path``: the rows, and the postings of their column ``text``."""

    spark: SparkSession
    path: str
    text: str

    @classmethod
    def build(cls, rows: DataFrame, text: str, path: str, rows_per_part: int = ROWS_PER_PART) -> TextIndex:
        """Write the rows and their postings. The numbers of rows are stored, so the postings stay true to them."""
        at = path.rstrip("/")
        number = F.monotonically_increasing_id()
        numbered = rows.withColumn("_number", number)
        placed = numbered.withColumn("_part", F.floor(F.col("_number") / rows_per_part)).withColumn("_at", F.pmod("_number", F.lit(rows_per_part)).cast("int"))
        placed.drop("_number").write.mode("overwrite").parquet(f"{at}/texts")
        index = cls(rows.sparkSession, at, text)
        grams = index.texts.select(F.explode(text_grams(text)).alias("gram"), "_part", "_at")
        postings = grams.groupBy("gram", "_part").agg(F.sort_array(F.collect_list("_at")).alias("rows"))
        postings.repartitionByRange("gram", "_part").sortWithinPartitions("gram", "_part").write.mode("overwrite").parquet(f"{at}/postings")
        return index

    @property
    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def places(self, grams: list[set[str]]) -> DataFrame:
        """``_part, _at`` of the rows that hold all trigrams of one of the sets."""

        def of_all(some: set[str]) -> DataFrame:
            lists = self.postings.filter(F.col("gram").isin(sorted(some))).groupBy("_part").agg(F.collect_list("rows").alias("lists"))
            lists = lists.filter(F.size("lists") == len(some))
            rest = F.slice("lists", 2, len(some))
            return lists.select("_part", F.explode(F.aggregate(rest, F.element_at("lists", 1), F.array_intersect)).alias("_at"))

        found = of_all(grams[0])
        for some in grams[1:]:
            found = found.unionByName(of_all(some))
        return found.distinct() if len(grams) > 1 else found

    def survivors(self, pattern: str, literal: bool = False) -> DataFrame:
        """The rows that may match: all of them where the pattern promises no trigram."""
        grams = pattern_grams(pattern, literal)
        if grams is None:
            return self.texts
        places, texts = self.places(grams), self.texts
        parts = [r["_part"] for r in places.select("_part").distinct().limit(MAX_PUSHED_PARTS + 1).collect()]
        if len(parts) <= MAX_PUSHED_PARTS:
            texts = texts.filter(F.col("_part").isin(parts)) if parts else texts.filter(F.lit(False))
        return texts.join(places, ["_part", "_at"], "left_semi")

    def search(self, pattern: str, literal: bool = False) -> DataFrame:
        """The rows that match, with their own columns."""
        found = self.survivors(pattern, literal).drop("_part", "_at")
        return found.filter(rx_search(self.text, pattern, literal))
