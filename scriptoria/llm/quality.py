"""Text quality statistics of documents, and what their text mostly is.

Long texts are cut into segments, which are dealt out over the cluster.  A segment
yields partial counts over its whole lines and, as boundary state, the unfinished
line at either end; merging two neighbours joins the left tail with the right head
and counts the line if it is now whole.  The merge is associative, so the segments
of a text are merged in Spark as a tree, block by block; the counts of chunks then
add up by document in partial aggregation.

The ratios of a document (words ended by a full stop, common words, signs, letters)
go through rules; its lines are prose, list, table or junk.  Both are needed for a
verdict, see ``document_statistics``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookalike import plain
from ..session import materialize, require, spread

#: Characters of a segment, and segments that are merged at once: two rounds hold any text (2**31 bytes); the result depends on neither.
SEGMENT, FAN_IN = 65_536, 256

#: Rules on the ratios of a document: the share of lines with an end, of common words among words, of signs and of letters among
#: characters that natural prose keeps.
RULES = {"few_ended": "ended_share < 0.25", "few_common": "common_share < 0.15", "many_symbols": "symbol_ratio > 0.12", "few_letters": "letter_ratio < 0.6"}
#: Failed rules without which no text is unnatural, and with which each text of so many words is.
SOME_RULES, MOST_RULES, ENOUGH_WORDS = 1, 3, 20

# Frequent words of the languages at hand.
COMMON_WORDS = {
    "en": "a an and are as at be been but by for from had has have if in into is it its must no not of on only or shall so such than that the their then this to was were when which while will with",
    "vi": "bị bởi cả cho có còn của cùng do đã đến để đo được ghi giữ hoặc khi không là làm lúc mà mỗi một nếu ở phải qua rồi sau sẽ tại theo thì trên trong trước từ và vẫn vì với",
    "de": "alle als am an auf aus bei bis das dem den der des die durch ein eine einem einen einer es für im in ist mit nach nicht oder sich sie sind so über um und vom von vor wenn werden wird zu zum zur",
}
COMMON = frozenset(w for words in COMMON_WORDS.values() for w in words.split())

# Signs that occur in ordinary technical text.
ORDINARY_SIGNS = ".,;:!?()[]'\"/%&+-–—°²³º℃℉µμ±×·•*|=©®$@“”‘’„…→≥≤"

KINDS = ("prose", "list", "table", "junk")
COUNTS = ("n_chars", "n_lines", "n_words", "word_chars", "n_common", "n_symbols", "n_ended", *(f"chars_{k}" for k in KINDS))

_WORD = re.compile(r"(?<![^\W_])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![^\W_])")
_ITEM = re.compile(r"(?:[•◦▪·*–—-]|\(\w{1,4}\)|\w{1,3}[.)]|\d+(?:\.\d+)+\.?)\s+\S")
_TAGGED = re.compile(r"[A-Za-z]{1,4}[ _‐-]?\d{2,5}[A-Za-z]?\s{2,}\S")
_GAPS = re.compile(r"\S\s{2,}(?=\S)")
_RUN = re.compile(r"(\S\S?)\1{5,}")
_ENDED = re.compile(r"[.!?:…][\"')\]»”]*$")
_SYMBOL = re.compile(r"[^\w\s]|_")
_ODD = re.compile(rf"(?:(?![{re.escape(ORDINARY_SIGNS)}])[^\w\s])|[_ÃÂÐÞ]")
_VOWEL = re.compile(r"[aeiouyäöüàáâãèéêìíòóôõùúýăđĩũơưạ-ỹ]", re.I)


class _ReadableLength(dict):
    """Length of a word if it can be read, else 0; remembered for words met before."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        fine = len(word) <= 24 and _VOWEL.search(word) and (word[1:].islower() or len(word) == 1 or word.isupper() or "-" in word or "'" in word)
        self[word] = n = len(word) if fine else 0
        return n


_LETTERS = _ReadableLength()


def line_kind(line: str, words: list[str] | None = None) -> str:
    """What one line is: prose, list, table or junk.  ``words`` are its words, where they are known.

    Rows of cells are tables, marked or tagged items lists; junk are lines in
    which odd signs, repeated signs or unreadable tokens prevail.
    """
    s = plain(line).strip()
    solid = sum(map(len, s.split()))
    words = _WORD.findall(s) if words is None else words
    if not solid:
        return "prose"
    if s.count("|") >= 2 and not s.strip("|-:+= \t"):
        return "table"  # the rule below a table head
    letters = sum(map(_LETTERS.__getitem__, words))
    odd = len(_ODD.findall(s))
    if odd >= 2 and odd > 0.06 * solid:
        return "junk"
    if letters < 0.75 * solid and sum(len(m.group()) for m in _RUN.finditer(s)) > 0.5 * solid:
        return "junk"
    ended = bool(_ENDED.search(s))
    if letters >= 0.15 * solid:
        if max(s.count("|"), s.count("\t")) >= 2 or s.count(";") >= 3 and not ended:
            return "table"
        gaps = len(_GAPS.findall(s)) if "  " in s else 0
        if gaps >= 2 and gaps < (len(s.split()) - 1) * 0.75 and not ended:
            return "table"
    if letters < (0.3 if len(words) >= 4 else 0.4) * solid:
        return "junk"
    if _ITEM.match(s) or _TAGGED.match(s):
        return "list"
    return "prose"


def _count(line: str, into: list[int]) -> None:
    size = len(line)
    into[0] += size
    if not line.strip():
        into[7] += size  # blank lines belong to no kind of their own
        return
    shown = plain(line)
    words = _WORD.findall(shown)
    into[1] += 1
    into[2] += len(words)
    into[3] += sum(map(len, words))
    into[4] += sum(map(COMMON.__contains__, " ".join(words).lower().split(" ")))
    into[5] += len(_SYMBOL.findall(line))
    into[6] += bool(_ENDED.search(line.rstrip()))
    into[7 + KINDS.index(line_kind(shown, words))] += size


class Partial:
    """Counts of the whole lines of a stretch of text, with the unfinished lines at its ends.

    ``head`` is the text before the first line feed; ``tail`` the text after the
    last one, or None where the stretch has no line feed (all of it is head).
    """

    __slots__ = ("counts", "head", "tail")

    def __init__(self, text: str = ""):
        self.counts = [0] * len(COUNTS)
        self.head, *rest = text.split("\n")
        self.tail = rest.pop() if rest else None
        for line in rest:
            _count(line, self.counts)
        self.counts[0] += text.count("\n")

    @classmethod
    def of(cls, counts: list[int], head: str, tail: str | None) -> Partial:
        out = cls()
        out.counts, out.head, out.tail = counts, head, tail
        return out

    def merge(self, right: Partial) -> Partial:
        """The counts of both stretches, ``right`` following this one."""
        out = Partial()
        out.counts = [a + b for a, b in zip(self.counts, right.counts)]
        if self.tail is None:
            out.head, out.tail = self.head + right.head, right.tail
        elif right.tail is None:
            out.head, out.tail = self.head, self.tail + right.head
        else:
            out.head, out.tail = self.head, right.tail
            _count(self.tail + right.head, out.counts)
        return out

    def finish(self) -> list[int]:
        """Counts with the lines at both ends."""
        counts = list(self.counts)
        for line in (self.head, self.tail):
            if line is not None:
                _count(line, counts)
        return counts


def _merged(level: list[Partial]) -> Partial:
    """Neighbouring partials as one, merged as a balanced tree."""
    while len(level) > 1:
        level = [a.merge(b) for a, b in zip(level[::2], level[1::2])] + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def text_counts(text: str, segment: int = SEGMENT) -> list[int]:
    """Counts of a text, measured segment by segment."""
    return _merged([Partial(text[i : i + segment]) for i in range(0, len(text), segment)] or [Partial()]).finish()


def chunk_counts(chunks: DataFrame, id_col: str = "chunk_id", doc_col: str = "doc_id", text_col: str = "text", recorded_col: str = "char_count", segment: int = SEGMENT) -> DataFrame:
    """Counts of each chunk, once for each id: ``id_col``, ``doc_col``, ``recorded_col`` and ``COUNTS``.

    Chunks loaded twice count once (the row of most characters, then of the larger
    record stands for the id); null and empty texts have counts of 0.  Rows with a
    null id are told apart by their document and text.  Texts of more than
    ``segment`` characters are counted by segments, in many tasks.
    """
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in (id_col, doc_col, recorded_col)}
    names = [id_col, doc_col, recorded_col]
    own = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    counts = ", ".join(f"{c} bigint" for c in COUNTS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a text within one segment; else its segments, uncounted."""
        for batch in batches:
            take: list[int] = []
            rows: list[tuple] = []
            for i, (item, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
                text = text or ""
                key = blake2b(text.encode(), digest_size=16).hexdigest() if item is None or len(text) > segment else None
                if len(text) <= segment:
                    take.append(i)
                    rows.append((key, None, None, *text_counts(text)))
                    continue
                for n, at in enumerate(range(0, len(text), segment)):
                    take.append(i)
                    rows.append((key, n, text[at : at + segment], *[0] * len(COUNTS)))
                    if len(rows) >= 256:
                        yield _measured(batch, names, take, rows)
                        take, rows = [], []
            yield _measured(batch, names, take, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            partials = [Partial(t) for t in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*names, "_key", "part")), *_columns(partials)], names=[*names, "_key", "part", *COUNTS, "head", "tail"])

    def merge(table: pa.Table) -> pa.Table:
        """The partials of neighbouring segments as one; segments of repeated rows count once."""
        rows = {r["part"]: r for r in table.to_pylist()}
        whole = _merged([Partial.of([r[c] for c in COUNTS], r["head"], r["tail"]) for _, r in sorted(rows.items())])
        same = table.slice(0, 1)
        return pa.table([*(same.column(c) for c in (*names, "_key")), pa.array([min(rows) // FAN_IN], pa.int64()), *_columns([whole])], names=[*names, "_key", "part", *COUNTS, "head", "tail"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [Partial.of([r[c] for c in COUNTS], r["head"], r["tail"]).finish() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*names, "_key")), *(pa.array([d[i] for d in done], pa.int64()) for i in range(len(COUNTS)))], names=[*names, "_key", *COUNTS])

    measured = materialize(spread(require(chunks, *names, text_col)).mapInArrow(measure, f"{own}, _key string, part bigint, piece string, {counts}"), "text-counts")
    partial = f"{own}, _key string, part bigint, {counts}, head string, tail string"
    parts = measured.filter("part is not null").select(*names, "_key", "part", "piece")
    parts = parts.repartition(F.col("_key"), F.col("part")).mapInArrow(count, partial)
    for _ in range(2):
        parts = parts.groupBy(*names, "_key", F.floor(F.col("part") / FAN_IN).alias("_block")).applyInArrow(merge, partial)
    long = parts.mapInArrow(finish, f"{own}, _key string, {counts}")
    every = measured.filter("part is null").select(*names, "_key", *COUNTS).unionByName(long.withColumn("_key", F.when(F.col(f"`{id_col}`").isNull(), F.col("_key"))))
    best = F.max(F.struct("n_chars", *COUNTS[1:], recorded_col)).alias("_m")
    return every.groupBy(id_col, doc_col, "_key").agg(best).select(id_col, doc_col, f"_m.{recorded_col}", *(f"_m.{c}" for c in COUNTS))


def _measured(batch: pa.RecordBatch, names: list[str], take: list[int], rows: list[tuple]) -> pa.RecordBatch:
    at = pa.array(take, pa.int64())
    cols = list(zip(*rows)) if rows else [()] * (3 + len(COUNTS))
    arrays = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), *[pa.int64()] * len(COUNTS)))]
    return pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), *arrays], names=[*names, "_key", "part", "piece", *COUNTS])


def _columns(partials: list[Partial]) -> list[pa.Array]:
    counts = [pa.array([p.counts[i] for p in partials], pa.int64()) for i in range(len(COUNTS))]
    return [*counts, pa.array([p.head for p in partials], pa.string()), pa.array([p.tail for p in partials], pa.string())]


def document_statistics(chunks: DataFrame, id_col: str = "chunk_id", doc_col: str = "doc_id", text_col: str = "text", recorded_col: str = "char_count") -> DataFrame:
    """Quality statistics of each document, from the texts of its chunks.

    Columns: the sums of ``COUNTS``, ``recorded_chars`` (sum of the recorded sizes,
    nulls left out), ``n_chunks``, ``n_wrong_size`` (chunks whose record is not the
    true length), ``mean_word_len``, ``symbol_ratio``, ``ended_share``,
    ``common_share``, ``letter_ratio``, the shares of the four kinds, whether each of
    ``RULES`` fails and ``n_failed``, and ``kind``.  Ratios without a base are null and
    fail no rule.

    A document is unnatural if more than half of the characters of its lines are no
    prose and its ratios fail at least one rule, or if the ratios of a text of enough
    words fail most of them.  ``kind`` then is what most of its other lines are (ties:
    table, list, junk), ``junk`` where all seem prose; else it is ``prose``, and null
    for documents without text.
    """
    per = chunk_counts(chunks, id_col, doc_col, text_col, recorded_col)
    sums = per.groupBy(doc_col).agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.sum(recorded_col).alias("recorded_chars"),
        F.count("*").alias("n_chunks"),
        F.sum(F.when(~F.col("n_chars").eqNullSafe(F.col(recorded_col)), 1).otherwise(0)).alias("n_wrong_size"),
    )
    part = {k: F.col(f"chars_{k}") for k in KINDS}
    other = part["list"] + part["table"] + part["junk"]
    total = other + part["prose"]
    most = F.greatest(part["list"], part["table"], part["junk"])
    ratios = sums.select(
        doc_col, *COUNTS, "recorded_chars", "n_chunks", "n_wrong_size",
        F.try_divide("word_chars", "n_words").alias("mean_word_len"),
        F.try_divide("n_symbols", "n_chars").alias("symbol_ratio"),
        F.try_divide("n_ended", "n_lines").alias("ended_share"),
        F.try_divide("n_common", "n_words").alias("common_share"),
        F.try_divide("word_chars", "n_chars").alias("letter_ratio"),
        *[F.try_divide(part[k], total).alias(f"share_{k}") for k in KINDS],
    )
    ruled = ratios.select("*", *[F.coalesce(F.expr(rule), F.lit(False)).alias(name) for name, rule in RULES.items()])
    ruled = ruled.withColumn("n_failed", sum((F.col(name).cast("int") for name in RULES), F.lit(0)))
    unnatural = ((other * 2 > total) & (F.col("n_failed") >= SOME_RULES)) | ((F.col("n_failed") >= MOST_RULES) & (F.col("n_words") >= ENOUGH_WORDS))
    kind = F.when(F.col("n_lines") == 0, None).when(~unnatural, "prose").when(other == 0, "junk").when(part["table"] == most, "table").when(part["list"] == most, "list").otherwise("junk")
    return ruled.withColumn("kind", kind)


def find_unnatural(chunks: DataFrame, **columns: str) -> DataFrame:
    """Documents most of whose text is no natural prose: document id and ``kind``."""
    doc_col = columns.get("doc_col", "doc_id")
    return document_statistics(chunks, **columns).filter(F.col("kind") != "prose").select(doc_col, "kind")
