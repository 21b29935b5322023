"""Token counts of texts with a public tokenizer, in Arrow batches. The vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import spread

#: A ranks file of byte pairs (tiktoken form), and the pattern that cuts text before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("docloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = VOCABULARY) -> int:
    """Tokens of one text, encoded as a whole; merging takes time in proportion to the text, unbroken stretches included."""
    return len(encoder(path).encode_ordinary(text))


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([count(t, path) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    return run


def sized(df: DataFrame, keep: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """The ``keep`` columns and n_tokens; a null or empty text has 0 tokens."""
    rows = spread(df.select(*keep, F.col(text).alias("_text")))
    schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in keep)
    return rows.mapInArrow(_count_batches(path), f"{schema}, n_tokens long")
