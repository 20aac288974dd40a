"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie, unless a call names another place; every executor needs the file at that path.
VOCABULARY = os.environ.get("FACTLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are tokenized in pieces cut where the pattern cuts anyway, so that memory stays small.
PIECE = 1 << 20


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, made once in a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = VOCABULARY) -> int:
    """The number of tokens of the whole text; 0 for null and empty."""
    if not text:
        return 0
    e, total, at = encoding(path), 0, 0
    while len(text) - at > PIECE:
        # a line break between two non-spaces never joins tokens of both sides but the break itself; cut before it
        cut_at = next((i for i in range(at + PIECE, min(len(text) - 1, at + 2 * PIECE)) if text[i] == "\n" and not text[i - 1].isspace() and not text[i + 1].isspace()), None)
        if cut_at is None:
            break
        total += len(e.encode_ordinary(text[at:cut_at]))
        at = cut_at
    return total + len(e.encode_ordinary(text[at:]))


def token_sizes(documents: DataFrame, *, id: str, text: str, keep: list[str] | None = None, path: str = VOCABULARY, size: str = "n_tokens") -> DataFrame:
    """For every row ``id``, the columns ``keep`` and ``size``, the number of tokens of the whole text. Null and empty texts have 0. No shuffle."""
    keep = keep or []
    rows = documents.select(id, *keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema.add(size, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([count(t.as_py(), path) for t in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], size])

    return rows.mapInArrow(run, schema)
