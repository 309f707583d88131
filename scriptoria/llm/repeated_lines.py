"""Lines that a source repeats across its documents.

Lines are parsed into templates with fixed-depth token trees: the path to a leaf
is the number of tokens and the first tokens of the line, numbers are wildcard
slots, and a leaf keeps the templates of the lines that reached it.  Each
partition grows its own trees and gives them as rows of node, template and
document, so that merging trees is adding up the documents of equal nodes.

The merged trees are cut from the top: a node that covers too few documents of a
source holds no template that covers enough, so only the templates below the
remaining nodes are counted.  Those that cover many documents are the repeated
lines.

Tokens are blocks of letters, not words, because spacing and signs make no
difference here.  Generalising a template beyond its number slots would join
different wordings, so letters never become wildcards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookalike import plain
from ..session import distinct_by, materialize, require, spread

SLOT = "\x00"
_NUMBERS = re.compile(r"\d+")
_SIGNS = re.compile(r"[^\w\x00]+|_+")
#: Letters of a token, and tokens of the path to a leaf.
_BLOCK, _DEPTH = 4, 3
_TOKEN = re.compile(rf"\x00|[^\x00]{{1,{_BLOCK}}}")
#: Lines of a partition whose places are held before they are sent on; bounds memory, not results.
HELD_LINES = 200_000


def tokens_of(line: str) -> tuple[str, ...]:
    """Tokens of a line: blocks of letters without spacing and signs, cut at numbers; each run of digits is a slot.

    Empty for a line without a letter.
    """
    folded = _SIGNS.sub("", _NUMBERS.sub(SLOT, plain(line).casefold()))
    return tuple(_TOKEN.findall(folded)) if folded.strip(SLOT) else ()


def _name(parts: tuple[str, ...], size: int) -> bytes:
    return blake2b("\x01".join(parts).encode("utf-8", "surrogatepass"), digest_size=size).digest()


class TemplateTree:
    """Fixed-depth tree of line templates."""

    def __init__(self, depth: int = _DEPTH):
        self.depth = depth
        self.root: dict = {}

    def place(self, tokens: tuple[str, ...]) -> tuple[int, bytes]:
        """Ids of the leaf node and of the template of a line; the same in every tree of this depth that meets the same wording."""
        node = self.root
        path = (str(len(tokens)), *tokens[: self.depth])
        for key in path:
            node = node.setdefault(key, {})
        if (own := node.get("")) is None:
            own = node[""] = (int.from_bytes(_name(path, 8), "big", signed=True), {})
        leaf, templates = own
        rest = tokens[self.depth :]
        if (known := templates.get(rest)) is None:
            known = templates[rest] = _name(tokens, 16)
        return leaf, known

    def template(self, tokens: tuple[str, ...]) -> bytes:
        """Id of the template of a line; the same in every tree that meets the same wording."""
        return self.place(tokens)[1]


def _grow(id_col: str, doc_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TemplateTree()
        held: dict[tuple, list] = {}
        count = 0
        for batch in batches:
            ids, docs, texts = (batch.column(i).to_pylist() for i in range(3))
            for item, doc, text in zip(ids, docs, texts):
                for n, line in enumerate(text.split("\n")):
                    if tokens := tokens_of(line):
                        held.setdefault((doc, *tree.place(tokens)), []).append((item, n))
                        count += 1
            if count > HELD_LINES:
                yield _leaves(held, batch.schema, id_col, doc_col)
                tree, held, count = TemplateTree(), {}, 0
        if held:
            yield _leaves(held, batch.schema, id_col, doc_col)

    return run


def _leaves(held: dict[tuple, list], schema: pa.Schema, id_col: str, doc_col: str) -> pa.RecordBatch:
    place = pa.struct([pa.field(id_col, schema.field(0).type), pa.field("line_no", pa.int64())])
    docs = pa.array([k[0] for k in held], schema.field(1).type)
    nodes = pa.array([k[1] for k in held], pa.int64())
    templates = pa.array([k[2] for k in held], pa.binary())
    places = pa.array([[{id_col: i, "line_no": n} for i, n in v] for v in held.values()], pa.list_(place))
    return pa.RecordBatch.from_arrays([docs, nodes, templates, places], names=[doc_col, "node", "template", "places"])


def find_repeated_lines(chunks: DataFrame, sources: DataFrame, min_share: float = 0.05, min_documents: int = 5, id_col: str = "chunk_id", doc_col: str = "doc_id", text_col: str = "text", source_col: str = "site") -> DataFrame:
    """Places of the lines that their source repeats: distinct (``id_col``, ``line_no``).

    ``sources`` gives the source of each document.  A line is repeated if its
    template covers at least ``min_documents`` documents of the source and at
    least ``min_share`` of them; the documents of a source are the distinct
    ``doc_col`` of ``chunks``, those without any text included.  Documents without
    a source form none, and none of their lines is reported.  Null and empty texts
    have no lines; lines without a letter don't count; items loaded twice count
    once.  Lines end at line feeds, the first is 0.
    """
    site_of = distinct_by(require(sources, doc_col, source_col).filter(F.col(doc_col).isNotNull() & F.col(source_col).isNotNull()), doc_col, source_col)
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in (id_col, doc_col)}
    leaves = materialize(
        spread(require(chunks, id_col, doc_col, text_col).filter(F.col(text_col).isNotNull() & F.col(doc_col).isNotNull()))
        .mapInArrow(_grow(id_col, doc_col), f"`{doc_col}` {kinds[doc_col]}, node bigint, template binary, places array<struct<`{id_col}`: {kinds[id_col]}, line_no: bigint>>"),
        "template-leaves",
    )
    members = distinct_by(require(chunks, doc_col), doc_col).join(site_of, doc_col)
    totals = members.groupBy(source_col).agg(F.count("*").alias("n_docs"))

    def frequent(rows: DataFrame, key: str) -> DataFrame:
        """Keys that cover enough documents of a source: (``source_col``, ``key``)."""
        covered = distinct_by(rows.select(doc_col, key), doc_col, key).join(site_of, doc_col)
        counted = covered.groupBy(source_col, key).agg(F.count("*").alias("n")).filter(F.col("n") >= min_documents).join(totals, source_col)
        return counted.filter(F.col("n") >= F.col("n_docs") * F.lit(min_share) - F.lit(1e-9)).select(source_col, key)

    # Each source keeps few nodes and templates, a multiple of the lines of one document; written, their size is known to the optimizer.
    nodes = materialize(distinct_by(frequent(leaves, "node"), "node"), "frequent-nodes")
    below = leaves.join(nodes, "node", "left_semi")
    templates = materialize(frequent(below, "template"), "frequent-templates")
    placed = below.join(templates, "template").join(site_of, [doc_col, source_col])
    return placed.select(F.explode("places").alias("p")).select(f"p.`{id_col}`", "p.line_no").distinct()


def remove_lines(chunks: DataFrame, places: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``chunks`` with the lines at ``places`` taken out of each text; other columns as they are.

    Null and empty texts stay; a text of which every line is repeated becomes empty.
    """
    gone = places.groupBy(id_col).agg(F.collect_set("line_no").alias("_gone")).select(F.col(id_col).alias("_gone_id"), "_gone")
    lines = F.split(F.col(f"_c.{text_col}"), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_gone", i.cast("bigint"))), "\n")
    joined = chunks.alias("_c").join(gone, F.col(f"_c.{id_col}") == F.col("_gone_id"), "left")
    return joined.select(*[(F.when(F.col("_gone").isNull(), F.col(f"_c.`{c}`")).otherwise(kept) if c == text_col else F.col(f"_c.`{c}`")).alias(c) for c in chunks.columns])
