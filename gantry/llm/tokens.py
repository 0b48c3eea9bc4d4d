"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The vocabulary file that sizes are measured with, and the fixed split pattern of its tokenizer.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, object] = {}


def encoding(path: str):
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; 0 for null and empty texts."""

    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(vocabulary)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, "bigint")(text)
