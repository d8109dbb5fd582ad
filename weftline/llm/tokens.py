"""Token counts with a public byte-level BPE vocabulary, one tokenizer per Python worker."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_LOADED: dict = {}


def encoder(vocabulary: str):
    """The tokenizer of a vocabulary file; loaded once in a worker."""
    if vocabulary not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[vocabulary] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[vocabulary]


def token_count(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens of each whole text; null for a null text, 0 for an empty one."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary)
        for texts in batches:
            yield pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int64")

    return count(text)
