"""Operator 3: main text of web pages by consensus paths per host.

First pass: every page scores its containers (``div``, ``article`` ...) by the
share of its plain text they hold, by how little boilerplate and link text
lies inside, and by semantic tags. From the best one it climbs to the ancestor
as long as that adds a title or more plain text than link text (titles, leads
and closing paragraphs beside an inner container); it climbs to the body for
a title, for text of the body's own or for more than ``MINOR`` of its text.
The container reached is the page's own and gets its vote. A container is
named by its generalised path: tags with classes from the body down, digits
replaced, kept as a 64-bit key so that deep nesting takes linear memory. Per host and path Spark sums the votes, the pages that have the path
and those where it lies beside the page's own container; a path that lies
beside it on most of several pages is outvoted.

Second pass: every page is read again and its text taken from the containers
on the first path of its host that holds nearly all text of the page's own
container, outvoted paths aside, and not less than a third of it with them;
without such a path it is the page's own container. So a host's further paths
beyond ``MAX_PATHS`` and ``MAX_OUTVOTED`` cost a page no text.

The pass over pages is repeated instead of stored, and the table of winning
paths is written first, so Spark joins it by broadcast while it is small and
by a shuffle whose hot hosts AQE splits when it is not.

Boilerplate is left out by tag (``nav``, ``footer``, ``aside``, ``form`` ...),
by words of class, id or role (menu, sidebar, advert, notice, comments ...) and
if hidden. A ``header`` counts as boilerplate outside an article only. Words
mark an element, and what it holds is judged when the whole page is read: a
mark counts only if the element does not hold the page's largest ``article``
or ``main``, and if all elements of that name hold a minor part of the plain
text: up to ``WHOLE_SHARE`` for names wholly of such words (``comments``), up
to ``PART_SHARE`` of what is then left for others (``comments-open``, but an
``article`` or ``main`` is never marked by these). Words after no, has, with
do not mark. If nothing is left, the name with most text does not count.

Defined cases: NULL html counts as empty and gives an empty text; a NULL url
has the empty host; rows repeating a page id get a row each (each votes);
broken markup never fails: what is no tag is text; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dinelens.llm.common import materialise

# Kinds of element.
CONTAINERS = frozenset("html body main article section div td th center header".split())
SEMANTIC = frozenset("article main".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr caption figure figcaption hr address "
    "details summary nav footer aside form fieldset menu dialog hgroup".split()
)
DROPPED = frozenset("nav footer aside form menu dialog button select option legend fieldset datalist input head".split())
RAW = frozenset("script style noscript template textarea iframe svg canvas title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset(
    "nav navbar navigation menu menubar topbar header masthead footer sidebar side aside widget ad ads advert adverts advertisement advertising "
    "banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay comment comments "
    "disqus respond replies reply share sharing social related recommended breadcrumb breadcrumbs pagination pager newsletter subscribe "
    "subscription signup login search toolbar complementary contentinfo".split()
)
MODIFIERS = frozenset("no not has have with without hide".split())
WHOLE_SHARE = 0.9
PART_SHARE = 0.5
MAX_PATHS = 32
MAX_OUTVOTED = 64
NEARLY = 0.9
LEAST = 1 / 3
MINOR = 0.05

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?/][^>]*>",
    re.S,
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
DIGITS = re.compile(r"[0-9]+")


def marked(value: str, in_article: bool) -> int:
    """2 if a name of the attribute is wholly of boilerplate words, 1 if a part of one is, else 0."""
    most = 0
    for name in value.split():
        words = [w.lower() for w in PARTS.findall(name) if not w.isdigit()]
        told = next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))
        found = [w in BOILERPLATE and not (in_article and w == "header") for w in words[:told]]
        if any(found):
            most = max(most, 2 if len(found) == len(words) and all(found) else 1)
    return most


def path_key(around: int, name: str) -> int:
    """A path's key from that of the path around it: 64 bits, so a page's paths take linear memory."""
    key = xxhash.xxh64_intdigest(name, around & (1 << 64) - 1)
    return key - (1 << 64) if key >> 63 else key


class Page:
    """Containers and text blocks of one page."""

    def __init__(self, source: str):
        self.paths, self.parents, self.semantic, self.depth = [path_key(0, "html")], [-1], [False], [0]
        self.blocks: list[tuple[int, str, int, bool]] = []  # container, text, characters of links, is it a title
        self.dropped = [0]
        self.marks: list[tuple[int, int, str]] = []  # of marked elements: mark around, ``marked``, name
        self.mark_of, self.block_marks = [-1], []  # innermost mark of containers and blocks
        self._read(source)
        if self.marks:
            self._settle()
        n = len(self.paths)
        self.text, self.links = [0] * n, [0] * n
        for c, t, linked, _ in self.blocks:
            self.text[c] += len(t) - linked
            self.links[c] += linked
        for c in range(n - 1, 0, -1):  # a container comes after its parent
            for of in (self.text, self.links, self.dropped):
                of[self.parents[c]] += of[c]

    def _settle(self) -> None:
        """Drop the blocks inside marks that count."""
        plain = [len(t) - linked for _, t, linked, _ in self.blocks]
        total = sum(plain)
        held = [0] * len(self.paths)
        for (c, *_), n in zip(self.blocks, plain, strict=True):
            held[c] += n
        for c in range(len(self.paths) - 1, 0, -1):
            held[self.parents[c]] += held[c]
        marks = self.marks

        def chain(k: int) -> Iterator[int]:
            while k >= 0:
                yield k
                k = marks[k][0]

        def off(counts: set[int]) -> list[bool]:
            """Of every mark: does it or one around it count. The last place is for no mark."""
            out = [False] * (len(marks) + 1)
            for k, (around, _, _) in enumerate(marks):
                out[k] = k in counts or out[around]
            return out

        nested: list[bool] = []  # is a mark inside one of the same name
        firm = [False] * (len(marks) + 1)  # is it or one around it wholly of boilerplate words
        opened: list[int] = []
        names_open: dict[str, int] = {}
        for k, (around, is_a, name) in enumerate(marks):
            while opened and opened[-1] != around:
                names_open[marks[opened.pop()][2]] -= 1
            nested.append(names_open.get(name, 0) > 0)
            firm[k] = is_a == 2 or firm[around]
            opened.append(k)
            names_open[name] = names_open.get(name, 0) + 1

        def texts(gone: list[bool]) -> tuple[dict[str, int], int]:
            """Plain characters left in the elements of each name, and on the page."""
            n = [0] * (len(marks) + 1)
            for m, x in zip(self.block_marks, plain, strict=True):
                n[m] += 0 if gone[m] else x
            rest, by_name = sum(n), {}
            for k in range(len(marks) - 1, -1, -1):
                n[marks[k][0]] += n[k]
            for k, (_, _, name) in enumerate(marks):
                if n[k] and not nested[k]:
                    by_name[name] = by_name.get(name, 0) + n[k]
            return by_name, rest

        largest = max(
            (c for c in range(len(self.paths)) if self.semantic[c] and held[c]),
            key=lambda c: (not firm[self.mark_of[c]], held[c], -c),
            default=-1,
        )
        safe = set(chain(self.mark_of[largest])) if largest >= 0 else set()
        counts: set[int] = set()
        whole, _ = texts(off(counts))
        for kind, share in ((2, WHOLE_SHARE), (1, PART_SHARE)):
            by_name, rest = texts(off(counts))
            counts |= {k for k, (_, is_a, name) in enumerate(marks) if is_a == kind and k not in safe and by_name.get(name, 0) <= share * rest}
        if total and counts:
            # While nothing is left, the name with most text does not count.
            names = sorted({marks[k][2] for k in counts}, key=lambda x: (whole.get(x, 0), x), reverse=True)
            place = {x: i for i, x in enumerate(names)}

            def without(n: int) -> set[int]:
                return {k for k in counts if place[marks[k][2]] >= n}

            counts = without(bisect_left(range(len(names)), 1, key=lambda n: texts(off(without(n)))[1]))
        gone = off(counts)
        keep = [not gone[m] for m in self.block_marks]
        for (c, t, _, _), k in zip(self.blocks, keep, strict=True):
            if not k:
                self.dropped[c] += len(t)
        self.blocks = [b for b, k in zip(self.blocks, keep, strict=True) if k]

    def _read(self, source: str) -> None:
        # (tag, does it drop, open elements of the same tag inside, container and mark around)
        stack: list[list] = [["html", False, 0, 0, -1]]
        places: dict[str, list[int]] = {}  # of a tag's open elements on the stack
        mark = -1
        at, here, dropping, links = 0, 0, 0, 0
        words: list[str] = []
        linked = 0
        title = False  # inside an h1, whose link text counts as plain

        def flush() -> None:
            nonlocal linked
            if words:
                text = " ".join(html_lib.unescape("".join(words)).split())
                words.clear()
                if text:
                    if dropping:
                        self.dropped[here] += len(text)
                    else:
                        self.blocks.append((here, text, 0 if title else min(linked, len(text)), title))
                        self.block_marks.append(mark)
            linked = 0

        def close(k: int) -> None:
            nonlocal here, dropping, mark
            flush()
            while len(stack) > k:
                tag, drops, _, here, mark = stack.pop()
                places[tag].pop()
                dropping -= drops

        def push(tag: str, drops: bool, around: int) -> None:
            nonlocal dropping
            places.setdefault(tag, []).append(len(stack))
            stack.append([tag, drops, 0, here, around])
            dropping += drops

        for m in TAG.finditer(source):
            if m.start() < at:  # inside a raw element
                continue
            if m.start() > at:
                piece = source[at : m.start()]
                words.append(piece)
                if links:
                    linked += len(piece)
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attrs = m[1] or m[4], m[3] or m[6] or ""
            if tag in RAW and not closing:
                words.append(" ")
                if not attrs.endswith("/"):
                    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                continue
            if tag == "a":
                links = 0 if closing else 1
                if not attrs:
                    continue
            if tag == "br":
                words.append(" ")
                continue
            if closing:
                if tag in BLOCKS:
                    flush()
                    title = False
                if places.get(tag):
                    k = places[tag][-1]
                    if stack[k][2]:
                        stack[k][2] -= 1
                    else:
                        close(k)
                continue
            if tag in BLOCKS:
                flush()
                title = tag == "h1"
                links = 0 if tag != "li" else links
                if stack[-1][0] in ("p", "li", "dt", "dd") and (tag == stack[-1][0] or stack[-1][0] == "p"):
                    close(len(stack) - 1)
            if tag in VOID or attrs.endswith("/"):
                continue
            drops, name = tag in DROPPED, tag
            in_article = (tag == "header" or bool(attrs)) and bool(places.get("article"))
            if tag == "header":
                drops = not in_article
            worded, names = 0, tag
            if attrs:
                if HIDDEN.search(attrs):
                    drops = True
                for found in NAMES.finditer(attrs):
                    value = found[2] or found[3] or found[4] or ""
                    if tag not in ("html", "body") and (tag not in SEMANTIC or found[1].lower() != "id"):
                        is_a = marked(value, in_article)
                        if is_a:
                            worded, names = max(worded, is_a), f"{names} {DIGITS.sub('#', value)}"
                    if found[1].lower() == "class" and value.strip():
                        name = tag + "." + DIGITS.sub("#", ".".join(sorted(value.split())))
            around = mark
            if worded == 2 or worded and tag not in SEMANTIC:
                flush()
                self.marks.append((mark, worded, names))
                mark = len(self.marks) - 1
            if tag in CONTAINERS and tag != "html":
                flush()
                push(tag, bool(drops), around)
                self.paths.append(path_key(self.paths[here], name))
                self.depth.append(self.depth[here] + 1)
                self.parents.append(here)
                self.semantic.append(tag in SEMANTIC)
                self.dropped.append(0)
                self.mark_of.append(mark)
                here = len(self.paths) - 1
            elif drops or mark != around:
                flush()
                push(tag, bool(drops), around)
            elif places.get(tag):
                stack[places[tag][-1]][2] += 1
        if at < len(source):
            words.append(source[at:])
        flush()

    def scored(self) -> list[tuple[float, int]]:
        """Containers with text, best first."""
        whole = max(self.text) if self.text else 0
        if whole <= 0:
            return []
        out = []
        for c, t in enumerate(self.text):
            if t <= 0:
                continue
            pure = t / (t + self.dropped[c] + self.links[c])
            out.append((t / whole * pure**0.5 + (0.2 if self.semantic[c] else 0.0) + 0.05 * min(self.depth[c], 10), c))
        return sorted(out, key=lambda x: (-x[0], -x[1]))

    def own(self) -> int:
        """The page's own container: the best one, widened; -1 without plain text."""
        best = self.scored()
        if not best:
            return -1
        at = best[0][1]
        up = self.parents[at]
        beside_of = self._beside(at)
        while up >= 0 and not self.semantic[at]:
            plain, linked = self.text[up] - self.text[at], self.links[up] - self.links[at]
            if plain or linked:
                beside = beside_of.get(up, [])
                if plain < linked and not any(title for _, _, title in beside):
                    break
                if self.depth[up] <= 1 and plain <= MINOR * self.text[up]:
                    titled = {child for child, _, title in beside if title}
                    if any(child >= 0 and child not in titled for child, _, _ in beside):
                        break
                at = up
            up = self.parents[up]
        return at

    def _beside(self, at: int) -> dict[int, list[tuple[int, int, bool]]]:
        """By container around ``at``, its blocks outside the next one on the way there:
        child container of it or -1, plain characters, is it a title."""
        way, up = set(), at
        while up >= 0:
            way.add(up)
            up = self.parents[up]
        top, child = [0] * len(self.paths), [-1] * len(self.paths)
        for c, around in enumerate(self.parents):
            if c in way:
                top[c] = c
            else:
                top[c], child[c] = top[around], c if around in way else child[around]
        out: dict[int, list[tuple[int, int, bool]]] = {}
        for c, t, linked, title in self.blocks:
            out.setdefault(top[c], []).append((child[c], len(t) - linked, title))
        return out

    def inside(self, roots: set[int]) -> list[bool]:
        """Of every container: is it one of the given or inside one."""
        inside = [False] * len(self.paths)
        for c in range(len(self.paths)):
            inside[c] = c in roots or (self.parents[c] >= 0 and inside[self.parents[c]])
        return inside

    def taken(self, roots: set[int]) -> str:
        """The blocks inside the given containers, in page order."""
        inside = self.inside(roots)
        return "\n".join(t for c, t, _, _ in self.blocks if inside[c])

    def votes(self) -> dict[int, tuple[int, int]]:
        """Per path with plain text: is it the own container's, and do all its containers lie beside that."""
        own = self.own()
        if own < 0:
            return {}
        inside, around, up = self.inside({own}), set(), own
        while up >= 0:
            around.add(up)
            up = self.parents[up]
        out: dict[int, tuple[int, int]] = {}
        for c, path in enumerate(self.paths):
            if self.text[c] > 0:
                won, beside = out.get(path, (0, 1))
                out[path] = (won | (path == self.paths[own]), beside & (not inside[c] and c not in around))
        return out

    def extract(self, ranked: list[int], outvoted: list[int] = ()) -> str:
        """Text by the first of the host's paths that holds nearly all, else of the page's own container."""
        own = self.own()
        if own < 0:
            # Link text alone is what the page has, if anything.
            return self.taken({0}) if self.blocks else ""
        lost = set(outvoted)
        off = self.inside({c for c, p in enumerate(self.paths) if p in lost}) if lost else [False] * len(self.paths)
        mine = self.inside({own})
        kept = [(c, len(t) - linked) for c, t, linked, _ in self.blocks if mine[c] and not off[c]]
        most = sum(n for _, n in kept)
        for path in ranked:
            roots = {c for c, p in enumerate(self.paths) if p == path}
            if roots and sum(self.text[c] for c in roots) >= LEAST * self.text[own]:
                inside = self.inside(roots)
                if sum(n for c, n in kept if inside[c]) >= NEARLY * most:
                    return self.taken(roots)
        return self.taken({own})


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple[str, int], list[int]] = {}
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for path, (won, beside) in Page(source).votes().items():
                n = seen.setdefault((host, path), [0, 0, 0])
                n[0] += won
                n[1] += 1
                n[2] += beside
        rows = sorted(seen.items())
        names = [pa.array([key[i] for key, _ in rows], kind) for i, kind in enumerate((pa.string(), pa.int64()))]
        counts = [pa.array([n[i] for _, n in rows], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*names, *counts], ["host", "path", "votes", "pages", "beside"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """``host, paths, outvoted``: the paths with most votes, best first, and the outvoted ones, from rows of ``host, html``."""
    counted = pages.select("host", "html").mapInArrow(_votes, "host string, path long, votes long, pages long, beside long")
    summed = counted.groupBy("host", "path").agg(*[F.sum(n).alias(n) for n in ("votes", "pages", "beside")])
    won = F.when(F.col("votes") > 0, F.struct(F.lit(0).alias("kind"), F.col("votes").alias("n")))
    lost = F.when((F.col("pages") > 1) & (2 * F.col("beside") > F.col("pages")), F.struct(F.lit(1).alias("kind"), F.col("pages").alias("n")))
    listed = summed.select("host", "path", F.explode(F.array_compact(F.array(won, lost))).alias("x")).select("host", "path", "x.kind", "x.n")
    rank = F.row_number().over(W.partitionBy("host", "kind").orderBy(F.desc("n"), "path"))
    first = listed.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("kind") == 0, MAX_PATHS).otherwise(MAX_OUTVOTED)).filter(F.col("rank") <= max(MAX_PATHS, MAX_OUTVOTED))

    def ordered(kind: int) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "path")))), lambda x: x["path"])

    return first.groupBy("host").agg(ordered(0).alias("paths"), ordered(1).alias("outvoted"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text``."""
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )
    best = materialise(winning_paths(rows), "paths").withColumnRenamed("host", "best_host")
    joined = rows.join(best, rows["host"] == best["best_host"], "left").select("page_id", "url", "html", "paths", "outvoted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, paths, outvoted = (batch.column(i).to_pylist() for i in (2, 3, 4))
            text = [Page(s).extract(p or [], o or []) for s, p, o in zip(html, paths, outvoted, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    url_kind = rows.schema["url"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url {url_kind}, text string")
