"""Quantities in texts, brought to the common unit of their dimension.

Three steps:

1. ``extract_mentions``: one pass over the texts finds every number with the
   spellings that stand where a unit can stand: the one to five words after the
   number, the label before it, the next cell, or the heading of its column.
   Spellings for which the bigram index proposes no unit are left out at once.
2. ``unit_aliases``: the distinct spellings are mapped to reference units: an
   inverted index of character bigrams proposes names, a weighted edit distance
   decides.  The result is the alias dictionary.
3. ``convert_mentions``: the dictionary is joined to all mentions, numbers are
   read with the decimal mark of their source, and values converted.

No spelling is left out that a name is near: the distance of a spelling to a name is
at least 0.05 for each sign it is longer, and at least 0.3 for each letter, so the
bounds of ``UnitIndex`` are exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookalike import plain
from ..session import distinct_by, materialize, require, spread

# Names under which a unit, or a part of a compound unit, is written.
PARTS = {
    "kg": ("kg", "kilogram", "kilogramme"),
    "t": ("t", "ton", "tonne", "tấn", "metric ton"),
    "lb": ("lb", "lbs", "pound", "pounds"),
    "m³": ("m³", "cubic metre", "cubic meter", "cu m", "Kubikmeter", "mét khối"),
    "L": ("L", "litre", "liter", "lít"),
    "US gal": ("US gal", "gal", "gallon", "US gallon"),
    "kgf": ("kgf", "kg", "kp", "kilogram-force"),
    "cm²": ("cm²", "sq cm", "square centimetre", "square centimeter"),
    "h": ("h", "hr", "hour", "giờ", "Stunde"),
    "s": ("s", "sec", "second", "giây", "Sekunde"),
    "min": ("min", "minute", "phút"),
}
NAMES = {
    "kPa": ("kPa", "kPa(a)", "kPa abs", "kilopascal"),
    "bar": ("bar", "bar(a)", "bar abs", "bar absolute"),
    "bar(g)": ("bar(g)", "bar gauge", "bar gage"),
    "MPa": ("MPa", "MPa(a)", "MPa abs", "megapascal"),
    "psi": ("psi", "psi(a)", "psi abs", "psi absolute", "lb/in²", "lbf/in²", "pound/square inch", "pound/sq in"),
    "psi(g)": ("psi(g)", "psi gauge", "psi gage", "pound/square inch gauge", "pound/square inch gage"),
    "mbar": ("mbar", "mbar(a)", "mbar abs", "millibar"),
    "°C": ("°C", "deg C", "degree C", "degrees C", "degree Celsius", "degrees Celsius", "Celsius", "độ C"),
    "°F": ("°F", "deg F", "degree F", "degrees F", "degree Fahrenheit", "degrees Fahrenheit", "Fahrenheit", "độ F"),
    "K": ("K", "kelvin", "deg K"),
    "L/min": ("lpm",),
    "US gpm": ("US gpm", "gpm", "USgpm"),
    "mm": ("mm", "millimetre", "millimeter"),
    "m": ("m", "metre", "meter", "mét"),
    "cm": ("cm", "centimetre", "centimeter"),
    "inch": ("inch", "inches", "Zoll"),
    "ft": ("ft", "foot", "feet", "Fuß"),
    "kW": ("kW", "kilowatt"),
    "MW": ("MW", "megawatt"),
    "hp": ("hp", "horsepower", "mã lực"),
    "W": ("W", "watt"),
    "kg": PARTS["kg"],
    "t": PARTS["t"],
    "lb": PARTS["lb"],
}
COMPOUND = {"US gpm": ("US gal", "min")}

_SAME = str.maketrans({"²": "2", "³": "3", "º": "°", "˚": "°"})
_PER = re.compile(r"\s+(?:per|pro)\s+|\s*/\s*", re.I)
_GLUE = " ._()[]-"
#: What a sign of a spelling, and a letter, costs at least that its name lacks; they bound the length of what can still be a unit.
GLUE_COST, PLURAL_COST = 0.05, 0.3


def spelling(text: str) -> str:
    """A spelling without what never tells units apart: one-sign degrees, superscripts, outer signs, ``per`` for a stroke."""
    s = _PER.sub("/", text.replace("℃", "°C").replace("℉", "°F").translate(_SAME)).strip(" \t*|")
    if s.rstrip(",;:") in ('"', "″") or s.lower().rstrip(",;:)") == "in.":  # with its sign or full stop only: "in" is a word
        return "inch"
    s = s.strip(".,;:!?\"'")
    while s[:1] in ("(", "[") and s[-1:] in (")", "]"):
        s = s[1:-1].strip()
    if s.count("(") < s.count(")"):
        s = s.rstrip(")")
    return s


def names_of(unit: str) -> list[str]:
    """All names of a reference unit: its own spelling, its other names, and the products of the names of its parts."""
    names = [unit, *NAMES.get(unit, ())]
    parts = COMPOUND.get(unit) or (tuple(unit.split("/")) if "/" in unit else ())
    if len(parts) == 2:
        a, b = (PARTS.get(p, (p,)) for p in parts)
        names += [f"{x}/{y}" for x, y in product(a, b)]
    return list(dict.fromkeys(spelling(n) for n in names))


def _letters(s: str) -> int:
    """Signs of a spelling that are no glue."""
    return len(s) - sum(map(s.count, _GLUE))


def bigrams(s: str) -> list[str]:
    """Distinct bigrams of a spelling without case and glue, with its ends marked."""
    bare = "^" + "".join(c for c in s.lower() if c not in _GLUE) + "$"
    return list(dict.fromkeys(bare[i : i + 2] for i in range(len(bare) - 1)))


def distance(a: str, b: str) -> float:
    """Weighted edit distance: case, glue and a plural cost little, any other sign 1."""

    def drop(s: str, i: int) -> float:
        c = s[i]
        if c in _GLUE:
            return GLUE_COST
        ends = i + 1 == len(s) or s[i + 1] == "/"
        return PLURAL_COST if c in "sS" and ends and i >= 2 and s[i - 1].isalpha() and s[i - 2].isalpha() else 1.0

    row = [0.0]
    for j in range(len(b)):
        row.append(row[-1] + drop(b, j))
    for i, x in enumerate(a):
        last, row = row, [row[0] + drop(a, i)]
        for j, y in enumerate(b):
            swap = 0.0 if x == y else 0.1 if x.lower() == y.lower() else 1.0
            row.append(min(last[j] + swap, last[j + 1] + drop(a, i), row[j] + drop(b, j)))
    return row[-1]


def allowed(name: str) -> float:
    """Largest distance at which a spelling still is the name: one slip in long words, none in short ones."""
    return 1.0 if sum(c not in _GLUE for c in name) >= 8 else 0.6


class UnitIndex:
    """Inverted index from character bigrams to the names of the reference units."""

    def __init__(self, units: list[str]):
        self.names = [(name, unit, len(bigrams(name)), allowed(name)) for unit in sorted(units) for name in names_of(unit)]
        self.posting: dict[str, list[int]] = {}
        for i, (name, *_) in enumerate(self.names):
            for gram in bigrams(name):
                self.posting.setdefault(gram, []).append(i)
        self.longest = max((len(name) + most / GLUE_COST for name, _, _, most in self.names), default=0)
        self.letters = max((_letters(name) + most / PLURAL_COST for name, _, _, most in self.names), default=0)

    def proposals(self, s: str) -> list[int]:
        """Names that share at least half of the bigrams of the richer of both; none for what is too long to be any name."""
        if not s or len(s) > self.longest or _letters(s) > self.letters:
            return []
        own = bigrams(s)
        shared = Counter(i for gram in own for i in self.posting.get(gram, ()))
        return [i for i, n in shared.items() if 2 * n >= max(len(own), self.names[i][2])]

    def unit(self, s: str) -> str | None:
        """Unit of the nearest of the proposed names within its distance; ties to the first unit by name."""
        near = [(cost, unit) for i in self.proposals(s) for name, unit, _, most in [self.names[i]] for cost in [distance(s, name)] if cost <= most]
        return min(near)[1] if near else None


def _index_of(units: DataFrame, unit_col: str = "unit") -> UnitIndex:
    """Index of a reference table, which has one row for each unit and is read by the driver."""
    return UnitIndex([r[0] for r in units.select(unit_col).distinct().collect() if r[0]])


def unit_aliases(spellings: DataFrame, units: DataFrame, spelling_col: str = "spelling", unit_col: str = "unit") -> DataFrame:
    """Alias dictionary: distinct ``spelling`` -> ``unit`` (nearest name; ties to the first unit in the reference's order by name).

    ``units`` is a fixed reference table; its names become an inverted index of
    bigrams, a few thousand entries.  Spellings near no name have no row.
    """
    index = _index_of(units, unit_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, u) for s in batch.column(0).to_pylist() if (u := index.unit(s)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["spelling", "unit"])

    return distinct_by(spellings.filter(F.col(spelling_col).isNotNull()).select(F.col(spelling_col).alias("spelling")), "spelling").mapInArrow(run, "spelling string, unit string")


# --- mentions -------------------------------------------------------------------------------------------------------

_NUM = r"(?:\d{1,3}(?:[ .,']\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)(?![\d])"
_TO = rf"(?:\s?(?:[-–—~]|\.\.+|to|bis|đến|tới)\s?(?P<to>[-−]?{_NUM}))?"
_WORD = r"[^\W\d_°][^\s|;]*"  # up to the end of the cell
_AFTER = re.compile(rf"(?<![\w.,/\-−–‐])(?P<from>[-−–]?{_NUM}){_TO} ?(?P<unit>(?:{_WORD}|[℃℉]|[°º˚]\s?[^\W\d_]\w*|[\x22″])(?: (?:{_WORD}|/[^\s|;]*)){{0,4}})")
_BEFORE = re.compile(
    rf"(?:\((?P<round>[^()\n]+(?:\([^()\n]*\))?)\)|\[(?P<square>[^\[\]\n]+)\]|,[ ](?P<comma>[^,:=|\n]+?))\s?[:=]\s?(?P<from>[-−–]?{_NUM}){_TO}"
)
_WHOLE = re.compile(rf"(?P<from>[-−–]?{_NUM}){_TO}$")
_HEAD_UNIT = re.compile(r"(?:\((?P<round>[^()]+(?:\([^()]*\))?)\)|\[(?P<square>[^\[\]]+)\]|,\s*(?P<comma>[^,]+))$")
_CELL_SPLIT = (("|", re.compile(r"\|")), ("\t", re.compile(r"\t")), (";", re.compile(r";")), ("  ", re.compile(r" {2,}")))
_NOTE = re.compile(r"\s*\((?:ref|note)\b[^()]*\)\s*", re.I)
_DIGIT = re.compile(r"\d")
_RULE = re.compile(r"[\s|:+=-]*$")


def cells_of(line: str) -> tuple[str, list[str]] | None:
    """Separator and cells of a table row; None for other lines."""
    for mark, pattern in _CELL_SPLIT:
        if line.count(mark) >= 2:
            cells = [c.strip() for c in pattern.split(line.strip(" ") if mark == "  " else line)]
            if mark == "|" and line.strip().startswith("|"):
                cells = cells[1:-1] if line.rstrip().endswith("|") else cells[1:]
            if len(cells) >= 3 and (mark != "  " or any(" " in c for c in cells)):  # where all gaps are wide, it's a widely set line
                return mark, cells
    return None


def mentions(text: str, index: UnitIndex, memo: dict[str, str] | None = None) -> list[tuple[str, tuple[str, ...]]]:
    """(number, spellings, the longest first) of every number beside which a unit stands by the bigrams of the index.

    ``memo`` keeps the spelling of texts met before, empty for those without a
    proposal.
    """
    memo = {} if memo is None else memo
    out: list[tuple[str, tuple[str, ...]]] = []

    def known(raw: str) -> str:
        s = memo.get(raw)
        if s is None:
            s = spelling(raw)
            s = memo[raw] = s if index.proposals(s) else ""
        return s

    def add(m: re.Match, *raws: str) -> None:
        if found := tuple(dict.fromkeys(s for raw in raws if (s := known(raw)))):
            out.append((m["from"], found))
            if m["to"]:
                out.append((m["to"], found))

    head: dict[tuple[str, int], list[str]] = {}
    for line in plain(text).split("\n"):
        if not _DIGIT.search(line):
            pass
        else:
            for m in _AFTER.finditer(line):
                words = m["unit"].split(" ")
                add(m, *(" ".join(words[:n]) for n in range(len(words), 0, -1)))
            for m in _BEFORE.finditer(line) if ":" in line or "=" in line else ():
                add(m, m["round"] or m["square"] or m["comma"])
        row = cells_of(line)
        if row is None or _RULE.match(line):
            continue
        mark, cells = row
        own = [_NOTE.sub("", c) for c in cells]
        numbers = [_WHOLE.match(c) for c in own]
        if not _DIGIT.search(own[0]) and not any(numbers) and not any(_AFTER.match(c) for c in own):
            units = [_HEAD_UNIT.search(c) for c in own]
            head[mark, len(own)] = [(u["round"] or u["square"] or u["comma"]) if u else "" for u in units]
            continue
        last_empty = mark == "  " and line.endswith("  ")  # gaps at the end of a widely set row stand for an empty cell
        units = head.get((mark, len(own))) or (head.get((mark, len(own) + 1)) if last_empty else None) or []
        for i, m in enumerate(numbers):
            if m and i:
                if i < len(units) and units[i]:
                    add(m, units[i])
                elif i + 1 < len(own) and own[i + 1] and not _DIGIT.match(own[i + 1]):
                    add(m, own[i + 1])
    return out


#: Spellings a worker remembers before it starts anew; bounds memory, not results.
REMEMBERED = 200_000


def extract_mentions(rows: DataFrame, units: DataFrame, id_col: str = "row_id", text_col: str = "text", keep: tuple[str, ...] = ("origin", "doc_id")) -> DataFrame:
    """Numbers with the spellings beside them: ``keep``, ``id_col``, ``number``, ``longest``, ``spelling``, ``rank``.

    One row for each spelling beside a number that could be a unit of ``units``;
    ``longest`` is the first of them and names the mention, ``rank`` 0 the first.
    Null and empty texts give no rows; repeated rows repeat their mentions.
    """
    names = [*keep, id_col]
    index = _index_of(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for batch in batches:
            take: list[int] = []
            found: list[tuple[str, str, str, int]] = []
            for i, text in enumerate(batch.column(len(names)).to_pylist()):
                if len(memo) > REMEMBERED:
                    memo.clear()
                for number, spellings in dict.fromkeys(mentions(text, index, memo)):
                    found += [(number, spellings[0], s, n) for n, s in enumerate(spellings)]
                    take += [i] * len(spellings)
            at = pa.array(take, pa.int64())
            cols = list(zip(*found)) if found else [()] * 4
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(names))), *map(pa.array, cols, kinds)], names=[*names, "number", "longest", "spelling", "rank"])

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return spread(require(rows, *names, text_col).filter(F.col(text_col).rlike(r"[0-9０-９]"))).mapInArrow(run, f"{types}, number string, longest string, spelling string, rank int")


def read_number(number: Column, decimal_mark: Column) -> Column:
    """Value of a number in the notation of its source; a null mark counts as a full stop."""
    unsigned = F.regexp_replace(number, r"^[-−–]", "")
    bare = F.when(F.coalesce(decimal_mark, F.lit(".")) == ",", F.replace(F.regexp_replace(unsigned, r"[ .']", ""), F.lit(","), F.lit("."))).otherwise(F.regexp_replace(unsigned, r"[ ,']", ""))
    value = bare.try_cast("double")
    return F.when(number.rlike(r"^[-−–]"), -value).otherwise(value)


#: Rows of the alias dictionary up to which it is sent to every executor; beyond, it is joined by a shuffle.
BROADCAST_ALIASES = 100_000


def convert_mentions(found: DataFrame, aliases: DataFrame, units: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Mentions one of whose spellings is a unit: ``keys``, ``number``, ``unit``, ``dimension``, ``factor``, ``shift``, ``is_common``.

    The longest spelling that is a unit counts; a mention of the same ``keys``
    counts once.  Aggregated by mention, so hot documents are spread.
    """
    reference = require(units, "unit", "dimension", "factor", "shift", "is_common").dropDuplicates(["unit"])
    known = aliases.join(F.broadcast(reference), "unit")
    if known.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES:
        known = F.broadcast(known)
    measured = known.select("spelling", F.struct("unit", "dimension", "factor", "shift", "is_common").alias("_u"))
    best = found.join(measured, "spelling").groupBy(*keys, "number", "longest").agg(F.min_by("_u", "rank").alias("_u"))
    return best.select(*keys, "number", "_u.*").distinct()


def quantities(rows: DataFrame, files: DataFrame, sites: DataFrame, units: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """Every quantity of ``rows`` (with ``origin`` and ``doc_id``) in its own and in the common unit.

    Columns: ``origin``, ``doc_id``, ``id_col``, ``number``, ``unit``,
    ``dimension``, ``value``, ``value_common``, ``is_common``.  The decimal mark is
    that of the document's site; documents without a site use a full stop.
    Repeated rows of one id count once, as do equal quantities of one text.
    """
    keys = ("origin", "doc_id", id_col)
    mark = distinct_by(require(files, "doc_id", "site").filter("doc_id is not null and site is not null"), "doc_id", "site").join(F.broadcast(require(sites, "site", "decimal_mark").dropDuplicates(["site"])), "site")
    mark = mark.groupBy("doc_id").agg(F.min("decimal_mark").alias("decimal_mark"))
    found = materialize(extract_mentions(rows, units, id_col, text_col), "mentions")
    aliases = materialize(unit_aliases(found.select("spelling"), units), "aliases")
    measured = convert_mentions(found, aliases, units, keys).join(mark, "doc_id", "left").withColumn("value", read_number(F.col("number"), F.col("decimal_mark"))).filter("value is not null")
    return measured.select(*keys, "number", "unit", "dimension", "value", (F.col("value") * F.col("factor") + F.col("shift")).alias("value_common"), "is_common")


def find_foreign_quantities(rows: DataFrame, files: DataFrame, sites: DataFrame, units: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """Distinct quantities not in the common unit: ``origin``, ``id_col``, ``dimension``, rounded ``value_common``."""
    return quantities(rows, files, sites, units, id_col, text_col).filter("not is_common").select("origin", id_col, "dimension", F.round("value_common").cast("bigint").alias("value_common")).distinct()
