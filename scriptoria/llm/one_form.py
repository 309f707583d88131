"""One form for texts that look the same.

Compatibility forms (widths, fonts, ligatures, fixed spaces) are folded, signs that
show nothing deleted, split accents composed.  What remains are letters that have a
twin of the same shape in another script.  A token with such letters is a lattice:
every position offers all letters of the shapes that its letter can have, and a
Viterbi search picks the path: one script for the whole token where there is one
(Latin before the others), the best character bigram score within it, and as few
changes of script as possible where no script can write the whole token.

The path decides which texts are equal.  For letters with one shape that is the
same as comparing shapes; a letter with two shapes (the Cyrillic palochka looks like
``I`` and like ``l``) is equal to whichever the scores make of it in its token.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookalike import LETTERS, TWO_SHAPES, plain_signs
from ..session import distinct_by, materialize, require, spread

#: Letters of the scripts with Latin twins.
FOREIGN = "[\\u0370-\\u03ff\\u0400-\\u058f\\u13a0-\\u13ff\\u1f00-\\u1fff]"
_TOKEN = re.compile(r"\S+")
#: Cost of a change of script inside a token, in log units.
SWITCH = 8.0
#: First and last code points of the scripts, in their order of preference after Latin.
_SCRIPTS = (("C", 0x400, 0x52F), ("G", 0x370, 0x3FF), ("G", 0x1F00, 0x1FFF), ("A", 0x530, 0x58F), ("K", 0x13A0, 0x13FF))


def script(c: str) -> str:
    """Script of a letter: C(yrillic), G(reek), A(rmenian), K (Cherokee), L for Latin and all others; empty for all other signs."""
    if not c.isalpha():
        return ""
    o = ord(unicodedata.normalize("NFD", c)[0])
    return next((s for s, first, last in _SCRIPTS if first <= o <= last), "L")


#: Shapes that a letter can have, in order of preference; letters with the shape of another, by that one.
_SHAPES: dict[str, str] = {**LETTERS, **TWO_SHAPES}
_TWINS: dict[str, str] = {}
for _c, _own in _SHAPES.items():
    for _p in _own:
        _TWINS[_p] = _TWINS.get(_p, "") + _c


def options(c: str) -> tuple[str, ...]:
    """All letters that can stand for a letter: those of its shapes, itself among them."""
    return tuple(dict.fromkeys(x for shape in _SHAPES.get(c, c) for x in (shape, *_TWINS.get(shape, ""))))


def _bigrams(token: str) -> Iterator[str]:
    own = {script(c) for c in token} - {""}
    if len(own) == 1:
        letters = "".join(c if c.isalpha() else " " for c in f" {token.lower()} ")
        for a, b in zip(letters, letters[1:]):
            if a != " " or b != " ":
                yield a + b


def train_scores(texts: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Bigram log scores of tokens in one script, from all texts.

    The result is bounded by the alphabets: pairs of letters met at least twice.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        tokens: Counter = Counter()

        def flush() -> None:
            for token, n in tokens.items():
                for pair in _bigrams(token):
                    seen[pair] += n
            tokens.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens.update(_TOKEN.findall(plain_signs(text)))
                if len(tokens) > 100_000:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pair", "n"])

    known = spread(require(texts, text_col).filter(F.col(text_col).isNotNull()))
    pairs = known.mapInArrow(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = {r[0]: r[1] for r in pairs.collect()}
    first: Counter = Counter()
    for p, n in counts.items():
        first[p[0]] += n
    return {p: math.log((n + 1) / (first[p[0]] + 64)) for p, n in counts.items()}


class Forms:
    """Forms of texts under given bigram scores."""

    def __init__(self, scores: dict[str, float] | None = None):
        self.scores = scores or {}
        self.memo: dict[str, str] = {}

    def token(self, token: str) -> str:
        """Best path through the lattice of a token."""
        known = self.memo.get(token)
        if known is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            known = self.memo[token] = self._viterbi(token)
        return known

    def _viterbi(self, token: str) -> str:
        # Works on decomposed text: an accent stays with whichever letter is chosen.
        lattice = [options(c) for c in unicodedata.normalize("NFD", token)]
        scripts = [{script(x) for x in found} - {""} for found in lattice]
        whole = next((s for s in ("L", *dict.fromkeys(x[0] for x in _SCRIPTS)) if all(s in own for own in scripts if own)), None)
        if whole:
            lattice = [tuple(x for x in found if script(x) in ("", whole)) for found in lattice]
        best: dict[tuple[str, str], tuple[float, str]] = {("", " "): (0.0, "")}  # script so far and last letter -> score, path
        for found in lattice:
            after: dict[tuple[str, str], tuple[float, str]] = {}
            for option in found:
                s = script(option)
                for (was, last), (score, path) in best.items():
                    if s:
                        score += self.scores.get((last + option).lower(), math.log(1 / 4096))
                        score -= SWITCH * (was not in ("", s)) + 0.01 * (s != "L")
                    state = s or was, option if s else (last if unicodedata.combining(option) else " ")
                    if state not in after or score > after[state][0]:
                        after[state] = (score, path + option)
            best = after
        # Equal scores: the path whose last script and letter come first by code point counts.
        return unicodedata.normalize("NFC", min(best.items(), key=lambda x: (-x[1][0], x[0]))[1][1])

    def form(self, text: str) -> str:
        """The one form of a text."""
        own = plain_signs(text)
        if own.isascii() or not _SEARCHED.search(own):
            return own
        return _TOKEN.sub(lambda m: self.token(m.group()) if _SEARCHED.search(m.group()) else m.group(), own)


#: Signs that make a token one to be searched: letters of the other scripts and whatever else has another shape.
_SEARCHED = re.compile(f"{FOREIGN}|[{''.join(map(re.escape, _SHAPES))}]")


def one_form(rows: DataFrame, id_col: str, text_col: str = "text", keep: tuple[str, ...] = (), scores: dict[str, float] | None = None) -> DataFrame:
    """Rows with their text in one form: ``keep``, ``id_col``, ``form``.

    Null texts stay null, empty texts empty; repeated rows stay repeated.
    """
    return _formed(rows, id_col, text_col, keep, scores, hashed=False)


def _formed(rows: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...], scores, hashed: bool) -> DataFrame:
    names = [*keep, id_col]
    shared = rows.sparkSession.sparkContext.broadcast(scores or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms(shared.value)
        digest = lambda t: blake2b(t.encode(), digest_size=16).digest()
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            made = [None if t is None else forms.form(t) for t in texts]
            own = [batch.column(i) for i in range(len(names))]
            if hashed:
                raws = [digest(t) for t in texts]
                arrays = [pa.array([r if f == t else digest(f) for f, t, r in zip(made, texts, raws)], pa.binary()), pa.array(raws, pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *arrays], names=[*names, "form", "raw"])
            else:
                yield pa.RecordBatch.from_arrays([*own, pa.array(made, pa.string())], names=[*names, "form"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return spread(require(rows, *names, text_col)).mapInArrow(run, f"{kinds}, form binary, raw binary" if hashed else f"{kinds}, form string")


def _members(rows: DataFrame, id_col: str, text_col: str, group_col: str, scores) -> DataFrame:
    """Distinct (group, ``form``, ``raw``, id) of the rows whose form has several wordings."""
    formed = materialize(
        _formed(rows.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()), id_col, text_col, (group_col,), scores, hashed=True),
        "forms",
    )
    several = formed.groupBy(group_col, "form").agg(F.min("raw").alias("_a"), F.max("raw").alias("_b")).filter("_a < _b").select(group_col, "form")
    return distinct_by(formed.join(several, [group_col, "form"], "left_semi"), group_col, "form", "raw", id_col)


def lookalike_classes(rows: DataFrame, id_col: str, text_col: str = "text", group_col: str = "origin", scores: dict[str, float] | None = None) -> DataFrame:
    """Membership in classes of texts that look the same: ``group_col``, ``id_col``, ``class``, ``wording``.

    One row for each id and wording of a class with at least two wordings; its size
    grows with the rows, however many of them share a class, where
    ``find_lookalikes`` gives their pairs.  ``class`` and ``wording`` are hashes in
    hexadecimal of the form and of the text.  Null texts and null ids don't count.
    """
    return _members(rows, id_col, text_col, group_col, scores).select(group_col, id_col, F.lower(F.hex("form")).alias("class"), F.lower(F.hex("raw")).alias("wording"))


def find_lookalikes(rows: DataFrame, id_col: str, text_col: str = "text", group_col: str = "origin", scores: dict[str, float] | None = None) -> DataFrame:
    """Pairs of rows of one group whose texts look the same but differ: ``group_col``, ``id_a`` < ``id_b``.

    Distinct wordings are paired first and ids are put to them afterwards, so a
    wording that fills a third of the table meets only the wordings that differ
    from it, and nothing but result rows is made.  Null texts and null ids don't
    count; empty texts look alike only to empty-looking ones.
    """
    members = materialize(_members(rows, id_col, text_col, group_col, scores), "lookalikes")
    kinds = distinct_by(members, group_col, "form", "raw")
    pairs = kinds.withColumnRenamed("raw", "raw_a").join(kinds.withColumnRenamed("raw", "raw_b"), [group_col, "form"]).filter("raw_a <> raw_b").select(group_col, "raw_a", "raw_b")
    a = members.select(group_col, F.col("raw").alias("raw_a"), F.col(id_col).alias("id_a"))
    b = members.select(group_col, F.col("raw").alias("raw_b"), F.col(id_col).alias("id_b"))
    return pairs.join(a, [group_col, "raw_a"]).join(b, [group_col, "raw_b"]).filter("id_a < id_b").select(group_col, "id_a", "id_b").distinct()
