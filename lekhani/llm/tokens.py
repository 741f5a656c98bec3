"""Lengths of texts in tokens of a public tokenizer whose files stay where they are."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Place of the ranks file; a parameter of every function here.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which byte-level BPE cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(ranks: str):
    import tiktoken

    pairs = (line.split() for line in Path(ranks).read_bytes().splitlines() if line.strip())
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def count_tokens(df: DataFrame, text: str, *keys: str, ranks: str = RANKS) -> DataFrame:
    """``keys, n_tokens`` for each row with a text; an empty text has 0 tokens, a null text no row."""
    kinds = dict(df.dtypes)
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks).encode_ordinary
        for batch in batches:
            yield batch[names].assign(n_tokens=[len(encode(t)) for t in batch["__text"]])

    rows = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text"))
    return rows.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_tokens int")
