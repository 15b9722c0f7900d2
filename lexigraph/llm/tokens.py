"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigraph.session import cut

#: Folder of the vocabulary files, the same on all executors.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: how the vocabulary's words are cut, with possessive runs so that it works in one pass.
PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)
_ENCODERS: dict = {}


def _encoder(path: str):
    """One encoder a Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(
            "own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODERS[path]


def token_count(text: Column, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text: null for null, 0 for ''."""
    path = f"{tokenizers}/{vocabulary}"

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(path)
        for texts in batches:
            yield texts.map(lambda t: len(encoder.encode_ordinary(t)), na_action="ignore")

    return count(text)


def sized_documents(documents: DataFrame, *columns: str, **tokenizer: str) -> DataFrame:
    """(doc_id, *columns, n_tokens) of all documents with tokens, written once.

    Documents with a null or empty text have no tokens and are left out.
    """
    sized = documents.where("doc_id is not null and text <> ''").select(
        "doc_id", *columns, token_count(F.col("text"), **tokenizer).alias("n_tokens")
    )
    return cut(sized)
