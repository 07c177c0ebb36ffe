"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vocabulary file (ranks of byte-level BPE merges), read on the driver; its size is fixed.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE of this family cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def token_count(df: DataFrame, col: str, path: str = TOKENIZER) -> Column:
    """A column with the number of tokens of `col`; 0 for null and empty texts. Whole texts, no cut."""
    with open(path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        e = encoder(ranks.value)
        return pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return size(F.col(f"`{col}`").cast("string"))
