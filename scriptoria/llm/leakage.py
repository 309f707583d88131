"""Evaluation texts inside training texts.

One Aho-Corasick automaton holds word blocks of all normalised test texts.  A
corpus text is normalised and scanned once; each block hit is extended word by
word in both directions, and runs of enough words are reported with offsets in
the original text.

Any run of ``min_words`` words contains a whole block of ``block`` words that
starts at a multiple of ``block``, as long as ``min_words >= 2 * block - 1``; so
the blocks at these places find every run, and the automaton stays small.  A test
text of fewer words is one block, found where it stands as a whole.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookalike import ALL, plain
from ..session import require, spread

WORD = re.compile(r"[^\W_]+")

#: Characters of test text in one automaton; larger test sets are scanned set by set.
AUTOMATON_CHARS = 20_000_000


def words_of(text: str) -> list[str]:
    """Words for comparison: runs of letters and digits, in one case, of plain characters."""
    return WORD.findall(plain(text).casefold())


def words_with_offsets(text: str) -> list[tuple[str, int, int]]:
    """The words of ``words_of`` with the span of each in the original text.

    The text is normalised cluster by cluster (a base character with the marks
    and widthless signs after it), so each normalised character keeps the start
    and end of its cluster.
    """
    chars: list[str] = []
    spans: list[tuple[int, int]] = []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and (unicodedata.combining(text[j]) or ALL.get(ord(text[j]), "") is None):
            j += 1
        for c in plain(text[i:j]).casefold():
            chars.append(c)
            spans.append((i, j))
        i = j
    return [(m.group(), spans[m.start()][0], spans[m.end() - 1][1]) for m in WORD.finditer("".join(chars))]


class TestTexts:
    """Automaton over the word blocks of test texts, and exact runs around its hits."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str, str]], min_words: int = 15, short: bool = False):
        self.min_words, self.block = min_words, (min_words + 1) // 2
        self.items = [(key, field, words_of(text or "")) for key, field, text in items]
        blocks: dict[str, list[tuple[int, int]]] = {}
        for n, (_, _, words) in enumerate(self.items):
            size = self.block if len(words) >= min_words else len(words) if short else 0
            for at in range(0, len(words) - size + 1, size) if size else ():
                blocks.setdefault(f" {' '.join(words[at : at + size])} ", []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for text, places in blocks.items():
            self.automaton.add_word(text, (len(text), text.count(" ") - 1, places))
        self.some = bool(blocks)
        self.fewest = min((min(min_words, len(self.items[n][2])) for places in blocks.values() for n, _ in places), default=min_words)
        if self.some:
            self.automaton.make_automaton()

    def runs(self, text: str) -> list[tuple[int, int, int, int]]:
        """Maximal runs (index of the test text, its first word, first word here, words) of enough words, or of a whole short text."""
        if not self.some:
            return []
        words = words_of(text)
        if len(words) < self.fewest:
            return []
        line = f" {' '.join(words)} "
        starts = [0, *accumulate(len(w) + 1 for w in words)]  # place of the blank before each word
        found: list[tuple[int, int, int, int]] = []
        done: dict[tuple[int, int], int] = {}  # test text and shift -> end of the last run there
        for end, (length, size, places) in self.automaton.iter(line):
            w = bisect_left(starts, end - length + 1)
            for n, at in places:
                if w + size <= done.get((n, w - at), 0):
                    continue  # within a run that another block found
                own = self.items[n][2]
                a, b, x, y = at, at + size, w, w + size
                while a > 0 and x > 0 and own[a - 1] == words[x - 1]:
                    a, x = a - 1, x - 1
                while b < len(own) and y < len(words) and own[b] == words[y]:
                    b, y = b + 1, y + 1
                done[n, w - at] = y
                if b - a >= min(self.min_words, len(own)):
                    found.append((n, a, x, b - a))
        return found


#: Automata of the latest test sets of this worker, by the name that the driver gave them.
_BUILT: dict[str, TestTexts] = {}


def _built(name: str, shared, min_words: int, short: bool) -> TestTexts:
    """Automaton of a broadcast test set, built once by each worker."""
    if name not in _BUILT:
        while len(_BUILT) >= 2:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[name] = TestTexts(shared.value, min_words, short)
    return _BUILT[name]


def find_leaks(documents: DataFrame, items: DataFrame, text_cols: tuple[str, ...] = ("passage",), min_words: int = 15, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", short: bool = False) -> DataFrame:
    """Runs of at least ``min_words`` words that a document shares with a test item.

    Columns: ``id_col``, ``item_col``, ``field``, ``n_words``, ``item_word`` (place
    in the item), ``start`` and ``end`` (offsets in the original text).  One row
    for each maximal run; repeated documents report each for itself.  Null and
    empty texts give no rows.  Test texts shorter than ``min_words`` give none
    either, unless ``short`` asks for the places where they stand as a whole.

    The test items, a stated query set, go to the workers in sets of bounded size
    (``AUTOMATON_CHARS``); the corpus is scanned once per set and never shuffled.
    """
    if min_words < 1:
        raise ValueError("min_words must be positive")
    own = require(items, item_col, *text_cols).filter(F.col(item_col).isNotNull())
    rows = [(r[0], field, r[field]) for r in own.distinct().toLocalIterator() for field in text_cols if r[field]]
    sets: list[list[tuple[int, str, str]]] = [[]]
    size = 0
    for row in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if size + len(row[2]) > AUTOMATON_CHARS and sets[-1]:
            sets.append([])
            size = 0
        sets[-1].append(row)
        size += len(row[2])
    doc_type = documents.schema[id_col].dataType.simpleString()
    item_type = items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {doc_type}, `{item_col}` {item_type}, field string, n_words int, item_word int, `start` int, `end` int"
    spark = documents.sparkSession
    docs = spread(require(documents, id_col, text_col).filter(F.col(text_col) != ""))
    parts = [docs.mapInArrow(_scanner(spark.sparkContext.broadcast(s), min_words, short, items.schema[item_col].dataType, id_col, item_col), schema) for s in sets]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _scanner(shared, min_words: int, short: bool, item_type, id_col: str, item_col: str):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_item = to_arrow_type(item_type)

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = _built(name, shared, min_words, short)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            take: list[int] = []
            rows: list[tuple] = []
            for i, text in enumerate(texts):
                hits = tests.runs(text)
                if hits:
                    spans = words_with_offsets(text)
                    for n, a, x, k in hits:
                        take.append(i)
                        rows.append((tests.items[n][0], tests.items[n][1], k, a, spans[x][1], spans[x + k - 1][2]))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [arrow_item, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(take, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[id_col, item_col, "field", "n_words", "item_word", "start", "end"])

    return run
