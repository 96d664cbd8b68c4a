"""Main content of web pages by wrapper induction.

Pages of a host are aligned with the host's pivot page by simple tree matching: the largest set of node pairs with equal
tags that keeps parents and the order of siblings. Each text node gets the slot of the pivot node that it is matched with;
what has no counterpart gets a slot named by its nearest matched ancestor and the tags between. A value that recurs in its
slot on enough pages of the host is constant and becomes template; all other values fill varying slots and are content.
Pages are counted by what else they hold: near copies count once on small hosts, and elsewhere about once, by a weighted
min-hash of the page's text.
Pages never meet in one place: alignments are counted as (host, slot, value), and only the recurring values go back.
"""

from __future__ import annotations

import html
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

#: A value is constant where it recurs on significantly more than this share of the differing pages that have its slot.
CONSTANT_SHARE = 0.05
#: The chance, by the Chernoff bound, of so many recurrences at that share. Two of two pages pass, two of three don't.
SIGNIFICANCE = 0.01
#: Pages of hosts of up to so many are compared in pairs; from this share of their words in common on, they are near copies.
SMALL_HOST = 8
COPY_SHARE = 0.5
#: Templates below this size are broadcast to the pages; larger ones are joined by host.
BROADCAST_BYTES = 64 << 20
SLICE = 4 << 20
_token = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title)\b([^>]*)>(.*?)(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[!?][^>]*>", re.S | re.I)
_void = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_inline = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var wbr".split())
_closes = {t: frozenset(["p"]) for t in "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
_closes |= {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
_scope = frozenset("html body table ul ol dl article section div nav main aside footer header select".split())
TEXT = "#text"


class Shapes:
    """Tree shapes numbered by (tag, shapes of the children), so that equal shapes have equal numbers; and their matchings."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.tag: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.weight: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def of(self, tag: str, children: tuple[int, ...]) -> int:
        got = self.number.get((tag, children))
        if got is None:
            got = self.number[(tag, children)] = len(self.tag)
            self.tag.append(tag)
            self.children.append(children)
            self.size.append(1 + sum(self.size[c] for c in children))
        return got

    def match(self, a: int, b: int) -> int:
        """The number of node pairs of the best simple tree matching of two shapes."""
        if self.tag[a] != self.tag[b]:
            return 0
        if a == b:
            return self.size[a]
        got = self.weight.get((a, b))
        if got is None:
            got = self.weight[(a, b)] = 1 + self._table(self.children[a], self.children[b])[0]
        return got

    def _table(self, x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, int, int, list[list[int]]]:
        """(best weight of matching two child lists, equal shapes at the front and at the end, the table of what is between)."""
        front = end = 0
        most = min(len(x), len(y))
        while front < most and x[front] == y[front]:
            front += 1
        while end < most - front and x[-1 - end] == y[-1 - end]:
            end += 1
        x2, y2 = x[front : len(x) - end], y[front : len(y) - end]
        table = [[0] * (len(y2) + 1)]
        for p in x2:
            last, row = table[-1], [0]
            for j, q in enumerate(y2):
                w = self.match(p, q)
                best = last[j] + w
                if last[j + 1] > best:
                    best = last[j + 1]
                if row[j] > best:
                    best = row[j]
                row.append(best)
            table.append(row)
        same = sum(self.size[c] for c in x[:front]) + sum(self.size[c] for c in x[len(x) - end :])
        return same + table[-1][-1], front, end, table

    def align(self, a: int, b: int) -> list[tuple[int, int]]:
        """(place in a, place in b) of the matched nodes, by document order within each; roots of equal tag pair up."""
        got = self.pairs.get((a, b))
        if got is not None:
            return got
        out: list[tuple[int, int]] = []
        todo = [(a, b, 0, 0)] if self.tag[a] == self.tag[b] else []
        while todo:
            p, q, at, to = todo.pop()
            if p == q:
                out.extend((at + k, to + k) for k in range(self.size[p]))
                continue
            out.append((at, to))
            x, y = self.children[p], self.children[q]
            _, front, end, table = self._table(x, y)
            chosen = [(k, k) for k in range(front)] + [(len(x) - 1 - k, len(y) - 1 - k) for k in range(end)]
            i, j = len(table) - 1, len(table[0]) - 1
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    chosen.append((front + i, front + j))
            begin_x, begin_y = self._begins(x, at), self._begins(y, to)
            todo.extend((x[i], y[j], begin_x[i], begin_y[j]) for i, j in chosen)
        if len(self.pairs) > 4096:
            self.pairs.clear()
        self.pairs[(a, b)] = out
        return out

    def _begins(self, children: tuple[int, ...], at: int) -> list[int]:
        out, at = [], at + 1
        for c in children:
            out.append(at)
            at += self.size[c]
        return out


class Page:
    """A parsed page: its shape, and for every node in document order its tag, parent, text and whether a block begins."""

    def __init__(self, source: str, shapes: Shapes):
        self.tag, self.parent, self.text, self.breaks = ["#root"], [-1], [None], [True]
        stack, fresh, at = [0], True, 0

        def say(piece: str) -> None:
            nonlocal fresh
            words = " ".join(html.unescape(piece).split()) if "&" in piece else " ".join(piece.split())
            if words:
                self.tag.append(TEXT)
                self.parent.append(stack[-1])
                self.text.append(words)
                self.breaks.append(fresh)
                fresh = False

        for m in _token.finditer(source):
            if m.start() > at:
                say(source[at : m.start()])
            at = m.end()
            raw, _, inner, slash, name = m.groups()
            if raw:
                name = raw.lower()
                fresh = True
                self._add(name, stack[-1])
                if name in ("title", "textarea"):
                    stack.append(len(self.tag) - 1)
                    say(inner)
                    stack.pop()
                    fresh = True
                continue
            if not name:
                continue
            name = name.lower()
            fresh |= name not in _inline
            if slash:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        del stack[k:]
                        break
                continue
            if shut := _closes.get(name):
                for k in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[k]]
                    if tag in shut:
                        del stack[k:]
                        break
                    if tag in _scope:
                        break
            self._add(name, stack[-1])
            if name not in _void and not m.group().endswith("/>"):
                stack.append(len(self.tag) - 1)
        if at < len(source):
            say(source[at:])
        below: list[list[int]] = [[] for _ in self.tag]
        shape = [0] * len(self.tag)
        for i in range(len(self.tag) - 1, -1, -1):
            shape[i] = shapes.of(self.tag[i], tuple(reversed(below[i])))
            if i:
                below[self.parent[i]].append(shape[i])
        self.shape = shape[0]

    def _add(self, tag: str, parent: int) -> None:
        self.tag.append(tag)
        self.parent.append(parent)
        self.text.append(None)
        self.breaks.append(False)


def layout(page: Page) -> str:
    """A page's tags in document order, each with the number of its children."""
    below = Counter(page.parent)
    return " ".join(f"{t}:{below[i]}" for i, t in enumerate(page.tag))


def tree(text: str, shapes: Shapes) -> tuple[int, list[str], list[int]]:
    """(shape, tags, parents) of a layout."""
    tags, counts = [], []
    for part in text.split(" "):
        tag, _, n = part.rpartition(":")
        tags.append(tag)
        counts.append(int(n))
    parents, open_ = [-1] * len(tags), []
    for i, n in enumerate(counts):
        while open_ and not open_[-1][1]:
            open_.pop()
        if open_:
            parents[i] = open_[-1][0]
            open_[-1][1] -= 1
        open_.append([i, n])
    done: list[int] = []
    for tag, n in zip(reversed(tags), reversed(counts)):
        children = tuple(reversed(done[len(done) - n :])) if n else ()
        del done[len(done) - n :]
        done.append(shapes.of(tag, children))
    return done[0], tags, parents


def slots(shape: int, tags: list[str], parents: list[int], pivot: int, shapes: Shapes) -> list[str]:
    """The slot of every text node, in document order."""
    slot, out = [""] * len(tags), []
    for a, b in shapes.align(pivot, shape):
        slot[b] = str(a)
    for i in range(1, len(tags)):
        slot[i] = slot[i] or f"{slot[parents[i]]}/{tags[i]}"
        if tags[i] == TEXT:
            out.append(slot[i])
    return out


class Aligner:
    """Shapes and the pivots read into them, begun anew where they have grown large."""

    def __init__(self):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
        self.shapes, self.pivots = Shapes(), {}

    def renew(self) -> None:
        if len(self.shapes.tag) > 200_000 or len(self.shapes.weight) > 1_000_000:
            self.shapes, self.pivots = Shapes(), {}

    def pivot(self, text: str) -> int:
        if text not in self.pivots:
            self.pivots[text] = tree(text, self.shapes)[0]
        return self.pivots[text]


def value_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def sketch(values: list[int], words: list[int]) -> int | None:
    """The hash of one of a page's texts, drawn by number of words: two pages agree with the share of words in common."""
    if not values:
        return None
    v = np.array(values, np.int64)
    x = v.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return int(v[np.argmin(-np.log((x.astype(np.float64) + 1) / 2.0**64) / np.array(words))])


def families(pages: list[dict[int, int]]) -> list[int | None]:
    """The first near copy, by chains of pairs, of each page of value: words; None for a page without text."""
    of: list[int | None] = [i if p else None for i, p in enumerate(pages)]
    for j, b in enumerate(pages):
        for i, a in enumerate(pages[:j]):
            if a and b and of[i] != of[j]:
                both = sum(w for v, w in a.items() if v in b)
                if both >= COPY_SHARE * (sum(a.values()) + sum(b.values()) - both):
                    low, high = sorted((of[i], of[j]))
                    of = [low if x == high else x for x in of]
    return of


def _pages(pages: DataFrame) -> DataFrame:
    pages = K.only(pages, "page_id", "url", "html")
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(K.integer_id(pages, "page_id"), F.when(host != "", host).alias("host"), F.col("html").cast("string").alias("html"))


def wrappers(pages: DataFrame, share: float = CONSTANT_SHARE) -> DataFrame:
    """(host, pivot, constants): the layout of each host's pivot and its constant (slot, value hash) pairs.

    The pivot is the page whose number of nodes is nearest to the host's median, the smallest page_id of equals. Near copies
    count as one page: on hosts of up to SMALL_HOST pages by comparing pairs, on others pages count by distinct sketches. A
    value is constant if n, the count of the pages with it in its slot, is significantly more than share of the count of the
    pages with the slot, and at least 1 + log2 of the count of the host: passages copied to a few pages are content.
    """

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Aligner()
        for part in K.slices(batches, "html", SLICE):
            layouts, values, words, sizes, drawn = [], [], [], [], []
            for source in part.column(2).to_pylist():
                kept.renew()
                page = Page(source or "", kept.shapes)
                layouts.append(layout(page))
                texts = [t for t in page.text if t is not None]
                values.append([value_hash(t) for t in texts])
                sizes.append(len(page.tag))
                words.append([t.count(" ") + 1 for t in texts])
                drawn.append(sketch(values[-1], words[-1]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(layouts, pa.string()), pa.array(values, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(sizes, pa.int32()), pa.array(drawn, pa.int64())], ["page_id", "host", "layout", "values", "words", "nodes", "family"])

    known = _pages(pages).where("host is not null and html is not null")
    outlines = K.materialise(known.mapInArrow(outline, "page_id bigint, host string, layout string, values array<bigint>, words array<int>, nodes int, family bigint"))
    medians = outlines.groupBy("host").agg(F.percentile_approx("nodes", 0.5, 1000).alias("median"), F.count("*").alias("rows"))
    pivots = outlines.join(medians, "host").groupBy("host").agg(F.min_by("layout", F.struct(F.abs(F.col("nodes") - F.col("median")), "page_id", "layout")).alias("pivot"), F.first("rows").alias("rows"))
    pivots = K.materialise(pivots)

    def compare(pdf):
        return pdf[["host", "layout", "values", "pivot"]].assign(family=families([dict(zip(v.tolist(), w.tolist())) for v, w in zip(pdf["values"], pdf["words"])])).astype({"family": "Int64"})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Aligner()
        for part in K.slices(batches, "layout", SLICE >> 2):
            found: set[tuple] = set()
            for host, text, values, pivot, family in zip(*(part.column(k).to_pylist() for k in range(5))):
                kept.renew()
                shape, tags, parents = tree(text, kept.shapes)
                names = slots(shape, tags, parents, kept.pivot(pivot), kept.shapes)
                found.add((host, None, None, family))
                found.update((host, s, v, family) for s, v in zip(names, values))
                found.update((host, s, None, family) for s in names)
            keys = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(keys[2], pa.int64()), pa.array(keys[3], pa.int64())], ["host", "slot", "value", "family"])

    ready = outlines.where("family is not null").join(pivots, "host")
    small = ready.where(F.col("rows") <= SMALL_HOST).groupBy("host").applyInPandas(compare, "host string, layout string, values array<bigint>, pivot string, family bigint")
    ready = ready.where(F.col("rows") > SMALL_HOST).select("host", "layout", "values", "pivot", "family").unionAll(small)
    aligned = ready.mapInArrow(count, "host string, slot string, value bigint, family bigint")
    counts = K.materialise(aligned.groupBy("host", "slot", "value").agg(F.count_distinct("family").alias("n")).where("n > 1"))
    hosts = counts.where("slot is null").select("host", F.col("n").alias("pages"))
    totals = counts.where("slot is not null and value is null").select("host", "slot", F.col("n").alias("total")).join(hosts, "host")
    q = F.least(F.col("n") / F.col("total"), F.lit(1.0))
    excess = q * F.log(q / share) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0)
    constant = counts.where("value is not null").join(totals, ["host", "slot"]).where((q > share) & (F.col("total") * excess >= -math.log(SIGNIFICANCE)) & (F.col("n") >= 1 + F.log2("pages")))
    listed = constant.groupBy("host").agg(F.collect_list(F.struct("slot", "value")).alias("constants"))
    return pivots.drop("rows").join(listed, "host", "left")


def extract(pages: DataFrame, share: float = CONSTANT_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per page: page_id, host, content, n_content and n_template, the numbers of its content and template texts.

    Content keeps document order, a line for each block. Scripts, styles and comments are no text. A page whose url is null
    or names no host, and the only page of a host, has no template: all of its text is content. A null html gives null
    content and numbers of 0, an empty one empty content. Malformed markup is read leniently: unclosed elements end with
    their parents. Repeated rows are extracted alike and don't make each other constant; extra columns are ignored.
    """
    found = K.materialise(wrappers(pages, share))
    size = found.select(F.sum(F.length("pivot") + 40 * F.coalesce(F.size("constants"), F.lit(0)))).first()[0] or 0
    side = found.withColumnRenamed("host", "_host")
    base = _pages(pages)
    joined = base.join(F.broadcast(side) if size <= broadcast_bytes else side, F.col("host") == F.col("_host"), "left").select("page_id", "host", "html", "pivot", "constants")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, constants = Aligner(), {}
        for part in K.slices(batches, "html", SLICE):
            hosts, pivots = part.column(1).to_pylist(), part.column(3).to_pylist()
            out, good, bad = [], [], []
            for i, source in enumerate(part.column(2).to_pylist()):
                kept.renew()
                if source is None:
                    out.append(None)
                    good.append(0)
                    bad.append(0)
                    continue
                page = Page(source, kept.shapes)
                if pivots[i] is None:
                    fixed, names = frozenset(), [""] * page.tag.count(TEXT)
                else:
                    if hosts[i] not in constants:
                        if len(constants) > 1000:
                            constants.clear()
                        constants[hosts[i]] = frozenset((c["slot"], c["value"]) for c in part.column(4)[i].as_py() or ())
                    fixed = constants[hosts[i]]
                    names = slots(page.shape, page.tag, page.parent, kept.pivot(pivots[i]), kept.shapes)
                pieces, n, total, fresh = [], 0, 0, True
                texts = (k for k, t in enumerate(page.text) if t is not None)
                for k, name in zip(texts, names):
                    total += 1
                    fresh |= page.breaks[k]
                    if (name, value_hash(page.text[k])) in fixed:
                        continue
                    pieces.append("\n" if fresh and pieces else " " if pieces else "")
                    pieces.append(page.text[k])
                    fresh = False
                    n += 1
                out.append("".join(pieces))
                good.append(n)
                bad.append(total - n)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(good, pa.int32()), pa.array(bad, pa.int32())], ["page_id", "host", "content", "n_content", "n_template"])

    return joined.mapInArrow(apply, "page_id bigint, host string, content string, n_content int, n_template int")
