"""Lengths of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Ranks of a byte-level BPE; on a cluster, a path that every executor can read.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern by which this vocabulary cuts a text into pieces before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(path: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer; a task makes its own. Strings of special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_lengths(df: DataFrame, text: str, keep: dict[str, str], path: str = VOCABULARY) -> DataFrame:
    """The columns of keep (new name: column) and n_tokens, for every row with a non-empty text."""
    rows = df.filter(F.length(text) > 0).select(*[F.col(c).alias(k) for k, c in keep.items()], F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            yield pdf.drop(columns="text").assign(n_tokens=[len(enc.encode_ordinary(t)) for t in pdf["text"]])

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "n_tokens long"]))
