"""Texts that stop before their end.

A text that is a strict prefix of a longer one elsewhere is found by hashed
prefixes.  Every text gives the hash of its beginning at each fixed length (the
powers of four up to its own); texts that agree there with another one form a
group, and only in such groups are the longer texts cut at the lengths of the
shorter ones and hashed again, now over the whole length.  Equal (length, hash) is
a prefix.  Texts are never sorted or paired, and only those of groups are read a
second time.

A text of which no longer copy exists is judged by its end: by what was put in
place of the rest, by the length at which its source cuts, and by whether its
last sentence is finished.  Which openings start sentences (that need a full
stop) and which start closing lines (that don't) is counted over the whole table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookalike import plain
from ..session import materialize, require, spread

# What is put in place of a missing rest.
MARKS = re.compile(r"(?:\.\.\.|…|�+|\[(?:\.\.\.|…|cut|more|truncated|gekürzt)\]|\((?:\.\.\.|…|cut|more|truncated|gekürzt)\)|<(?:cut|more|truncated)>|--+ ?(?:cut|more|truncated) ?--+)\s*$", re.I)

_CLOSERS = "\"')]»”"
_ENDED = re.compile(r"[.!?][\"')\]»”]*$")
_SENTENCES = re.compile(r"(?<=[.!?])[\"')\]»”]*[ \t]+(?=[^\W_a-z])|\n+")
_ITEM = re.compile(r"(?:[•◦▪·*–—-]|\(?\w{1,3}[.)])\s+\S")
_CELLS = re.compile(r"\S(?: {2,}|\t)(?=\S)|\S(?: {2,}|\t)$")
_CODE = "#"

#: A length is a field limit of a source if so many open texts stop there (fewer agree by chance), at least this share of
#: the source's texts, and at least this share of the texts of that length are open.
LIMIT_TEXTS, LIMIT_SHARE, LIMIT_OPEN = 3, 0.01, 0.9
#: Fixed lengths at which beginnings are hashed: no text has more characters than the last.
LEVELS = [4**k for k in range(16)]
#: Openings a worker counts before it sends them on; bounds memory, not results.
HELD_OPENINGS = 200_000


def structural(lines: list[str]) -> str:
    """What the last of the lines is: ``row`` for a list item or table row, ``short`` for a table row with fewer cells than the one above, else empty."""
    last = lines[-1].strip(" \r")
    above = lines[-2] if len(lines) > 1 else ""
    if _ITEM.match(last):
        return "row"
    if "|" not in last and (_ENDED.search(last) or re.search(r"[.!?] +[^\W\d_a-z]", last)):
        return ""
    for mark in ("|", "\t", ";"):
        n, most = last.count(mark), above.count(mark)
        if n >= 2 and (mark != ";" or n == most):
            return "short" if 0 < n < most else "row"
    return "row" if _CELLS.search(last) else ""


def openings(sentence: str) -> tuple[str, str]:
    """First word of a sentence, and its first two, for counting; numbers and codes count as one word.

    The pair is empty unless a third word follows, since a last word may be cut.
    """
    words = [_CODE if any(map(str.isdigit, w)) or w.isupper() and 2 <= len(w) <= 4 else w.casefold() for w in sentence.split(None, 3)[:3]]
    return words[0] if words else "", " ".join(words[:2]) if len(words) > 2 else ""


def tail_facts(text: str) -> tuple[str, str, str, str]:
    """How a text ends: verdict, first word and first pair of its last sentence, and where that sentence stands.

    Verdicts: ``marked`` (something stands for the rest), ``ended``, ``row`` (list
    item or table row), ``short`` (table row that lacks cells), ``open`` (no sign of
    an end).  Places: ``inside`` a line
    after other sentences, ``line`` (a line of its own), ``word`` (a line of one
    word).
    """
    s = plain(text).rstrip(" \r\n")
    if MARKS.search(s):
        return "marked", "", "", "inside"
    if _ENDED.search(s.rstrip()):
        return "ended", "", "", "inside"
    lines = s.split("\n")
    if kind := structural(lines):
        return kind, "", "", "line"
    last = _SENTENCES.split(lines[-1])
    fragment = last[-1].strip()
    return "open", *openings(fragment), "inside" if len(last) > 1 else "line" if " " in fragment else "word"


_COLUMNS = (
    ("what", pa.string()), ("id", None), ("source", pa.string()), ("chars", pa.int64()), ("bytes", pa.int64()), ("hash", pa.binary()), ("keys", pa.list_(pa.int64())),
    ("verdict", pa.string()), ("opening", pa.string()), ("pair", pa.string()), ("place", pa.string()), ("n", pa.int64()), ("n_ended", pa.int64()),
)


def level_keys(text: str) -> list[int]:
    """Hash of the beginning of a text at each fixed length up to its own."""
    return [xxhash.xxh3_64_intdigest(text[:n].encode()) - (1 << 63) for n in LEVELS[: own_level(len(text)) + 1]]


def own_level(chars: int) -> int:
    """Number of the largest fixed length that a text of so many characters has."""
    return bisect_left(LEVELS, chars + 1) - 1


def prefix_hashes(text: str, lengths: list[int]) -> Iterator[tuple[int, bytes]]:
    """Hash of the text's beginning at each of some ascending lengths, in one pass over the text."""
    h, at = md5(usedforsecurity=False), 0
    for n in lengths:
        h.update(text[at:n].encode())
        at = n
        yield n, h.copy().digest()


def _scanner(ids: pa.DataType):
    """Over texts in any order: facts of each text, and counts of openings."""
    schema = pa.schema([(name, kind or ids) for name, kind in _COLUMNS])

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], schema.field(c).type) for c in schema.names], schema=schema)

    def counted(counts: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
        rows = [{"what": "opening", "opening": w, "n": n, "n_ended": e} for w, (n, e) in counts.items()]
        for i in range(0, len(rows), 5000):
            yield batch_of(rows[i : i + 5000])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            out: list[dict] = []
            for key, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                verdict, word, pair, place = tail_facts(text)
                _count_openings(text, counts)
                raw = text.encode()
                out.append({"what": "text", "id": key, "source": source, "chars": len(text), "bytes": len(raw), "hash": md5(raw, usedforsecurity=False).digest(), "keys": level_keys(text), "verdict": verdict, "opening": word, "pair": pair, "place": place})
            if out:
                yield batch_of(out)
            if len(counts) > HELD_OPENINGS:
                yield from counted(counts)
        yield from counted(counts)

    return run


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lengths) to the (length, hash) of the beginnings that the text continues."""
    for batch in batches:
        rows: dict[tuple[int, bytes], None] = {}
        for text, lengths in zip(*(batch.column(i).to_pylist() for i in range(2))):
            lengths = sorted({n for n in lengths if n < len(text)})
            rows.update(((n, h), None) for n, h in prefix_hashes(text, lengths) if continues_at(text, n))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["chars", "hash"])


def continues_at(text: str, n: int) -> bool:
    """True if a text cut after its first ``n`` characters would lack the rest of a word or sentence."""
    i = n
    while i < len(text) and text[i].isspace():
        i += 1
    if i == len(text):
        return False
    last, gap = text[n - 1], text[n:i]
    if not gap and last.isalnum() and text[i].isalnum():
        return True
    end = n
    while end and text[end - 1].isspace():
        end -= 1
    while end and text[end - 1] in _CLOSERS:
        end -= 1
    ended = end > 0 and text[end - 1] in ".!?"
    return not (ended or "\n" in gap or last == "\n")


def continues(short: str, long: str) -> bool:
    """True if ``long`` starts with ``short`` and goes on within its last word or sentence."""
    return bool(short) and len(long) > len(short) and long.startswith(short) and continues_at(long, len(short))


def _count_openings(text: str, counts: dict[str, list[int]]) -> None:
    title, _, body = text.partition("\n")  # a first line may be a title
    for sentence in _SENTENCES.split(body if body and not _ENDED.search(title.strip()) else text)[:-1]:  # the last one may be cut
        s = sentence.strip()
        if s and "  " not in s and not _ITEM.match(s):
            for w in filter(None, openings(s)):
                c = counts.setdefault(w, [0, 0])
                c[0] += 1
                c[1] += bool(_ENDED.search(s))


def _continued(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct (``chars``, ``hash``) of the texts that a longer text continues within a word or sentence.

    A level's key is shared by all texts that begin alike, so a hot beginning meets
    only combined rows: the least and the largest hash of its texts, and the
    lengths of those that end before the next level.
    """
    keyed = facts.select("hash", "chars", F.size("keys").alias("_n"), F.posexplode("keys").alias("level", "key"))
    own = F.when(F.col("level") == F.col("_n") - 1, F.col("chars"))
    groups = keyed.groupBy("level", "key").agg(F.min("hash").alias("_a"), F.max("hash").alias("_b"), F.collect_set(own).alias("lengths"))
    groups = groups.filter((F.col("_a") < F.col("_b")) & (F.size("lengths") > 0)).select("level", "key", "lengths", F.array_min("lengths").alias("_least"))
    within = keyed.join(groups, ["level", "key"]).filter(F.col("chars") > F.col("_least"))
    wanted = materialize(within.groupBy("hash").agg(F.flatten(F.collect_set("lengths")).alias("lengths")), "prefix-lengths")
    again = texts.select("text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("hash")).join(wanted, "hash")
    return again.select("text", "lengths").mapInArrow(_cutter, "chars bigint, hash binary").groupBy("chars", "hash").agg(F.lit(True).alias("inside"))


def text_ends(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", partitions: int | None = None) -> DataFrame:
    """How each text ends: ``id_col``, ``source_col``, ``chars``, ``verdict``, ``cut``, ``evidence``.

    One row for each row with a text; null, empty and blank texts give none.
    Repeated texts are judged alike, whatever their ids; a null source is a source
    of its own.  ``evidence`` of a cut: ``prefix`` (a longer copy), ``mark`` (something
    stands for the rest), ``limit`` (it stops at a field limit of its source),
    ``sentence`` (its last word or sentence is not finished); null for texts that
    are whole.  ``partitions`` spreads the texts of a few large files.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ids = documents.schema[id_col].dataType
    own = require(documents, id_col, source_col, text_col).select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    texts = own.filter(F.col("text").rlike(r"(?U)\S"))
    texts = texts.repartition(partitions) if partitions else spread(texts)
    kinds = {"large_string": "string", "string": "string", "int64": "bigint", "bool": "boolean", "binary": "binary", "list<item: int64>": "array<bigint>"}
    schema = ", ".join(f"`{c}` {ids.simpleString() if k is None else kinds[str(k)]}" for c, k in _COLUMNS)
    scanned = materialize(texts.mapInArrow(_scanner(to_arrow_type(ids)), schema), "text-ends")
    facts = scanned.filter("what = 'text'").select("id", "source", "chars", "bytes", "hash", "keys", "verdict", "opening", "pair", "place")
    continued = _continued(texts, facts)

    # Openings: how many of the sentences that start so are finished by a full stop.
    words = scanned.filter("what = 'opening'").groupBy("opening").agg(F.sum("n_ended").alias("n_ended"), F.sum("n").alias("n")).withColumn("ended_share", F.col("n_ended") / F.col("n"))
    # Last lines of one word may stop inside it, so all first words that begin like it are counted together.
    lengths = facts.filter("verdict = 'open' and place = 'word'").select(F.length("opening").alias("k")).distinct()
    begins = (
        words.filter(~F.contains("opening", F.lit(" "))).join(F.broadcast(lengths), F.length("opening") >= F.col("k"))
        .groupBy(F.expr("left(opening, k)").alias("opening")).agg((F.sum("n_ended") / F.sum("n")).alias("begin_share"))
    )
    # Field limits, in characters or in bytes (where the last character may be lost): lengths at which the texts of a source stop again and again.
    key = F.coalesce("source", F.lit("\x00")).alias("source_key")
    stops = facts.select(key, F.col("verdict").isin("open", "marked").alias("open"), F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("size")))).alias("s"))
    stops = stops.groupBy("source_key", "s.measure", "s.size").agg(F.count("*").alias("n"), F.count_if("open").alias("n_open"))
    texts_of = facts.groupBy(key).agg(F.count("*").alias("n_all"))
    limits = (
        stops.filter((F.col("n_open") >= LIMIT_TEXTS) & (F.col("n_open") >= LIMIT_OPEN * F.col("n"))).join(texts_of, "source_key").filter(F.col("n_open") >= LIMIT_SHARE * F.col("n_all"))
        .groupBy("source_key").agg(F.collect_set(F.when(F.col("measure") == "chars", F.col("size"))).alias("_chars"), F.collect_set(F.when(F.col("measure") == "bytes", F.col("size"))).alias("_bytes"))
    )
    joined = (
        facts.drop("keys").join(words.select("opening", "ended_share"), "opening", "left").join(begins, "opening", "left").join(words.select(F.col("opening").alias("pair"), F.col("ended_share").alias("pair_share")), "pair", "left")
        .join(continued, ["chars", "hash"], "left").withColumn("source_key", key).join(limits, "source_key", "left")
    )
    at_limit = F.coalesce(F.array_contains("_chars", F.col("chars")) | F.exists("_bytes", lambda most: F.col("bytes").between(most - 3, most)), F.lit(False))
    # A line of its own whose beginning starts sentences is a cut sentence; one with a beginning of its own is a closing line.
    unfinished = (
        F.when((F.col("place") == "inside") | ((F.col("place") == "word") & at_limit), True)
        .when(F.col("place") == "word", F.coalesce(F.col("begin_share") >= 0.5, F.lit(True)))  # part of a word if no first word begins so
        .when(F.col("pair_share").isNotNull(), F.col("pair_share") >= 0.5)
        .when(F.length("pair") > 0, False)
        .when(F.col("ended_share").isNotNull(), F.col("ended_share") >= 0.5)
        .otherwise(at_limit)  # part of a word
    )
    open_end = F.when(F.col("verdict") == "short", at_limit).when(F.col("verdict") == "open", unfinished).otherwise(False)
    evidence = (
        F.when(F.col("inside"), "prefix").when(F.col("verdict") == "marked", "mark")
        .when(open_end & at_limit, "limit").when(open_end, "sentence")
    )
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "chars", "verdict", evidence.isNotNull().alias("cut"), evidence.alias("evidence"))


def find_truncated(documents: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """Ids of the texts that were cut: distinct ``id_col``."""
    return text_ends(documents, id_col, **columns).filter("cut").select(id_col).distinct()


def truncation_rates(documents: DataFrame, source_col: str = "source", **columns) -> DataFrame:
    """How often each source cuts: ``source_col``, ``n_texts``, ``n_cut``, ``n_cut`` by evidence, ``cut_share``; null sources form one row."""
    return (
        text_ends(documents, source_col=source_col, **columns).groupBy(source_col)
        .agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), *[F.count_if(F.coalesce(F.col("evidence") == e, F.lit(False))).alias(f"n_{e}") for e in ("prefix", "mark", "limit", "sentence")])
        .withColumn("cut_share", F.try_divide("n_cut", "n_texts"))
    )
