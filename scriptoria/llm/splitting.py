"""Cutting of oversized texts at natural boundaries, with overlap.

A text is a tree: sections nested by the level of their headings, paragraphs, list
items nested by indent, lines, and below them sentences, words and characters.  A
node that fits is one block; only a node that doesn't is opened.  Siblings that are
whole merge as long as the limit allows, from the bottom of the tree up; the pieces
of an opened node stay within it.  So a cut falls on the highest level of the tree
at which the pieces still fit, and no piece joins the end of one section with the
beginning of the next one above it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import require

#: Signs between the pieces that count as tokens.
SPACES = " \t\n\r"
_TOKEN = re.compile(rf"[^{SPACES}]+")
# Boundaries within a line, highest first; a match ends at the start of the next part.
_LEVELS: tuple[re.Pattern[str], ...] = (
    re.compile(r"[.!?…][\"'”»)\]]*[ \t]+(?=[^\W_a-z])|[;:][ \t]+"),
    re.compile(rf"[{SPACES}]+"),
)
_LINE = re.compile(r"[^\r\n]*(?:\r\n?|\n)|[^\r\n]+")
_HEADING = re.compile(r"[ \t]{0,3}(#{1,6})[ \t]+\S")
_LISTED = re.compile(r"([ \t]*)(?:[•◦▪·*+–—-]|\(?\w{1,3}[.)])[ \t]+\S")
_INDENT = re.compile(r"[ \t]*")

# Ranks of nodes: a new node ends all open ones of its own rank or above. Headings have their level.
_PARAGRAPH, _ITEM, _OF_LINE = 10, 20, 30
#: Open nodes at most; list items nested still deeper are siblings of the deepest.
DEPTH = 100


class Node:
    """A stretch of text with the stretches it consists of."""

    __slots__ = ("children", "end", "indent", "rank", "start")

    def __init__(self, rank: int, start: int, indent: int = 0):
        self.rank, self.start, self.end, self.indent = rank, start, start, indent
        self.children: list[Node] = []


def structure(text: str) -> Node:
    """Tree of sections, paragraphs, list items and lines, built in one pass over the lines.

    Blank lines belong to what is above them, a heading to the line below it.
    """
    root = Node(0, 0)
    path = [root]

    def close(at: int, ends) -> None:
        while len(path) > 1 and ends(path[-1]):
            path.pop().end = at

    def add(rank: int, at: int, indent: int = 0) -> None:
        node = Node(rank, at, indent)
        path[-1].children.append(node)
        path.append(node)

    blank = True  # the next line starts a paragraph
    under = False  # the next line belongs to the heading above
    for m in _LINE.finditer(text):
        at, line = m.start(), m.group()
        if not line.strip():
            blank = True
            continue
        if h := _HEADING.match(line):
            if not under:
                level = len(h[1])
                close(at, lambda n, level=level: n.rank >= level)
                add(level, at)
                add(_PARAGRAPH, at)
                add(_OF_LINE, at)
            blank, under = False, True
            continue
        if under:
            blank = under = False
            continue
        if blank:
            close(at, lambda n: n.rank >= _PARAGRAPH)
            add(_PARAGRAPH, at)
            blank = False
        indent = len(_INDENT.match(line)[0].expandtabs(4))
        if _LISTED.match(line):
            close(at, lambda n: n.rank == _OF_LINE or n.rank == _ITEM and (n.indent >= indent or len(path) > DEPTH))  # noqa: B023
            add(_ITEM, at, indent)
        else:
            close(at, lambda n: n.rank == _OF_LINE or n.rank == _ITEM and n.indent >= indent)  # noqa: B023
        add(_OF_LINE, at)
    close(len(text), lambda _: True)
    root.end = len(text)
    for first in _first_line(root):  # blank lines before the first line
        first.start = 0
    return root


def _first_line(node: Node) -> Iterator[Node]:
    while node.children:
        node = node.children[0]
        yield node


def _joined(text: str, i: int) -> bool:
    """True if a cut before character ``i`` would part signs that are read as one."""
    c, before = text[i], text[i - 1]
    if unicodedata.category(c)[0] == "M" or "\u200d" in (c, before) or 0x1F3FB <= ord(c) <= 0x1F3FF:
        return True
    if 0x1160 <= ord(c) <= 0x11FF:  # vowels and finals of a syllable
        return 0x1100 <= ord(before) <= 0x11FF
    if 0x1F1E6 <= ord(c) <= 0x1F1FF:  # flags are pairs
        n = 0
        while n < i and 0x1F1E6 <= ord(text[i - 1 - n]) <= 0x1F1FF:
            n += 1
        return n % 2 == 1
    return False


def _by_character(text: str, start: int, end: int, limit: int) -> list[tuple[int, int]]:
    out = []
    while start < end:
        cut = min(start + limit, end)
        if cut < end:
            while cut > start and (_joined(text, cut) or text[cut - 1 : cut + 1] == "\r\n"):
                cut -= 1
            if cut == start:  # one sign larger than the limit
                cut = start + limit
        out.append((start, cut))
        start = cut
    return out


def blocks(text: str, size: Callable[[int, int], int], limit: int, atomic: bool) -> list[tuple[int, int]]:
    """Consecutive ranges of ``text``, each within ``limit``.

    ``atomic``: words may not be cut (one word is one unit of size).
    """

    def packed(parts: list[tuple[int, int, Callable[[], list[tuple[int, int]]]]]) -> list[tuple[int, int]]:
        """Ranges of siblings: whole ones merge as long as they fit, others are opened."""
        out: list[tuple[int, int]] = []
        whole = False  # the last range is a run of whole siblings
        for a, b, opened in parts:
            if size(a, b) > limit:
                out += opened()
                whole = False
            elif whole and size(out[-1][0], b) <= limit:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
                whole = True
        return out

    def of_node(node: Node) -> list[tuple[int, int]]:
        if not node.children:
            return within(node.start, node.end, 0)
        return packed([(n.start, n.end, lambda n=n: of_node(n)) for n in node.children])

    def within(start: int, end: int, level: int) -> list[tuple[int, int]]:
        if level == len(_LEVELS):
            return [(start, end)] if atomic else _by_character(text, start, end, limit)
        cuts = [m.end() for m in _LEVELS[level].finditer(text, start, end) if start < m.end() < end]
        return packed([(a, b, lambda a=a, b=b: within(a, b, level + 1)) for a, b in zip([start, *cuts], [*cuts, end])])

    return [(0, len(text))] if size(0, len(text)) <= limit else of_node(structure(text))


def split_text(text: str, measure: str, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of the pieces of a text: each within ``max_size``, each after the first starting ``overlap`` units before the end of the one before.

    The pieces without their overlap follow one another and make up the whole
    text.  ``measure`` is ``tokens`` (runs without space, tab, line feed, carriage
    return) or ``chars`` (code points).  An overlap that would leave no room is
    cut to ``max_size - 1``; one that would begin inside a sign of several code
    points (a letter and its accent) begins after it.
    """
    if measure == "tokens":
        starts = [m.start() for m in _TOKEN.finditer(text)]
        size = lambda a, b: bisect_left(starts, b) - bisect_left(starts, a)
    elif measure == "chars":
        starts = []
        size = lambda a, b: b - a
    else:
        raise ValueError(f"unknown measure {measure!r}")
    if max_size < 1:
        raise ValueError("max_size must be positive")
    if size(0, len(text)) <= max_size:
        return [(0, len(text))]
    overlap = max(0, min(overlap, max_size - 1))
    own = blocks(text, size, max_size - overlap, measure == "tokens")

    def back(a: int) -> int:
        if measure == "chars" or not overlap:
            at = max(0, a - overlap)
            while 0 < at < a and _joined(text, at):
                at += 1
            return at
        n = bisect_left(starts, a) - overlap
        return starts[n] if n >= 0 else 0

    out = [(back(a) if a else 0, b) for a, b in own]
    while len(out) > 1 and out[1][0] == 0:  # a first piece no larger than the overlap is all in the second
        out.pop(0)
    return out


def text_size(text: Column, measure: Column) -> Column:
    """Size of a text in the units of its measure; null for null texts and unknown measures."""
    tokens = F.size(F.filter(F.split(text, f"[{SPACES}]+", -1), lambda t: t != ""))
    return F.when(text.isNull(), None).when(measure == "tokens", tokens).when(measure == "chars", F.length(text))


def with_limits(chunks: DataFrame, limits: DataFrame, id_col: str = "chunk_id", text_col: str = "text", heading_col: str = "heading", profile: Column | None = None) -> DataFrame:
    """Chunks with measure, limit and overlap of their profile, and their size in its units."""
    own = chunks.select(
        F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{heading_col}`").alias("heading"),
        (profile if profile is not None else F.col("metadata").getItem("profile")).alias("profile"),
    )
    rule = require(limits, "profile", "measure", "max_size", "overlap_size").dropDuplicates(["profile"])
    return own.join(rule, "profile", "left").withColumn("size", text_size(F.col("text"), F.col("measure")))


def split_oversized(chunks: DataFrame, limits: DataFrame, id_col: str = "chunk_id", text_col: str = "text", heading_col: str = "heading", profile: Column | None = None, oversized_only: bool = False) -> DataFrame:
    """Pieces of each chunk: ``id_col``, ``piece_no`` (from 0), ``n_pieces``, ``start``, ``end``, ``text``, ``heading``, ``oversized``.

    A chunk within the limit is one piece and never leaves the JVM; so are chunks
    without a known profile and null texts (null ``text``, ``end`` 0).  Offsets
    count code points of the stored text.  Chunks loaded twice with the same text,
    heading and profile count once.  ``oversized_only`` leaves out the chunks within their limit.
    """
    sized = with_limits(chunks, limits, id_col, text_col, heading_col, profile)
    once = ["item", "text", "heading", "profile"]
    large = F.coalesce(F.col("size") > F.col("max_size"), F.lit(False))
    kind = chunks.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece_no int, n_pieces int, `start` int, `end` int, text string, heading string, oversized boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, headings = batch.column(0), batch.column(2)
            texts, measures, sizes, overlaps = (batch.column(i).to_pylist() for i in (1, 3, 4, 5))
            take: list[int] = []
            rows: list[tuple] = []
            for i, (text, measure, most, overlap) in enumerate(zip(texts, measures, sizes, overlaps)):
                ranges = split_text(text, measure, most, overlap or 0)
                for n, (a, b) in enumerate(ranges):
                    take.append(i)
                    rows.append((n, len(ranges), a, b, text[a:b], True))
            cols = list(zip(*rows)) if rows else [()] * 6
            at = pa.array(take, pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            own = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([items.take(at), *own[:5], headings.take(at), own[5]], names=[id_col, "piece_no", "n_pieces", "start", "end", "text", "heading", "oversized"])

    cut = sized.filter(large).dropDuplicates(once).select("item", "text", "heading", "measure", "max_size", "overlap_size").mapInArrow(run, schema)
    if oversized_only:
        return cut
    whole = sized.filter(~large).dropDuplicates(once).select(
        F.col("item").alias(id_col), F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"),
        F.coalesce(F.length("text"), F.lit(0)).alias("end"), "text", "heading", F.lit(False).alias("oversized"),
    )
    return cut.unionByName(whole)


def find_oversized(chunks: DataFrame, limits: DataFrame, id_col: str = "chunk_id", **columns) -> DataFrame:
    """Ids of the chunks that had to be cut: distinct ``id_col``."""
    return split_oversized(chunks, limits, id_col, oversized_only=True, **columns).filter("piece_no = 0").select(id_col).distinct()
