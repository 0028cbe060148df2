"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Vocabulary file of a byte-level BPE tokenizer; a parameter, never copied into the repository.
VOCABULARY = os.environ.get("TOKENIZER_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how the tokenizer splits texts before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def count(text: str, vocabulary: str = VOCABULARY) -> int:
    return len(encoder(vocabulary).encode_ordinary(text))


def sizes(df: DataFrame, key: str, text: str, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, the columns in `keep`, n_tokens of every non-empty text; null and empty texts have no row."""
    ship(df.sparkSession)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *keep)) + ", n_tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [count(t, vocabulary) for t in b[text]]
            yield b[[key, *keep]].assign(n_tokens=pd.Series(n, dtype="int64", index=b.index))

    return df.where(F.col(text) != "").select(key, *keep, text).mapInPandas(run, schema)
