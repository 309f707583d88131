"""Counting of tokens with a public byte-level vocabulary, for chunk sizes."""

from __future__ import annotations

import base64
import uuid

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# How the vocabulary's texts are cut before merging.
CUTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODINGS: dict[str, object] = {}


def words(text: Column) -> Column:
    """Number of pieces between spaces, tabs and line ends: a count of tokens that needs no vocabulary."""
    return F.size(F.filter(F.split(text, r"[ \t\n\r]+", -1), lambda t: t != ""))


class TokenCounter:
    """Size function that counts the tokens of a text by a vocabulary of ranks (base64 token and rank a line).

    The driver reads the file; its lines, bounded by the vocabulary, go to the
    executors, each of whose workers builds the encoder once.  Null texts have no
    count, empty ones 0.  ``many`` counts all texts of an array, which is what sizes
    inside a fold over an array need.
    """

    def __init__(self, spark: SparkSession, path: str, cuts: str = CUTS):
        with open(path, "rb") as f:
            shared = spark.sparkContext.broadcast(f.read())
        name = uuid.uuid4().hex

        def encoder():
            if name not in _ENCODINGS:
                import tiktoken

                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
                _ENCODINGS[name] = tiktoken.Encoding(name, pat_str=cuts, mergeable_ranks=ranks, special_tokens={})
            return _ENCODINGS[name]

        def one(texts: pd.Series) -> pd.Series:
            own = encoder()
            return pd.Series([None if t is None else len(own.encode_ordinary(t)) for t in texts], dtype="Int32")

        def many(arrays: pd.Series) -> pd.Series:
            own = encoder()
            return pd.Series([None if a is None else [len(own.encode_ordinary(t or "")) for t in a] for a in arrays], dtype=object)

        self._one = F.pandas_udf(one, "int")
        self._many = F.pandas_udf(many, "array<int>")

    def __call__(self, text: Column) -> Column:
        return self._one(text)

    def many(self, texts: Column) -> Column:
        return self._many(texts)
