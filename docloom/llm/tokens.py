"""Sizes of texts in tokens of a public byte-level BPE vocabulary, counted on the executors."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoding, built once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, columns: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns`` of ``df`` and ``tokens`` long: the size of the whole text, 0 for null.

    The text itself ends here: no later stage carries it.
    """
    kept = df.select(*columns, text)
    types = dict(kept.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            *head, texts = batch.columns
            sizes = pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*head, sizes], [*columns, "tokens"])

    return kept.mapInArrow(run, schema)
