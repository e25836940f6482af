"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The tokenizer's vocabulary, a file of ranks; and the pattern of its pre-tokens, a fixed value of byte-level BPE.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_READY: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file, one for each Python worker."""
    if path not in _READY:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _READY[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _READY[path]


def token_counts(documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, out: str = "tokens") -> DataFrame:
    """documents with the length of their text in tokens in the column out, in place of the text; a null text has none.

    The vocabulary file must lie at the same path on every executor. No shuffle.
    """
    keep = [c for c in documents.columns if c not in (text, out)]
    at, place = documents.columns.index(text), [documents.columns.index(c) for c in keep]
    schema = T.StructType([*documents.select(*[F.col(c) for c in keep]).schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            counts = [len(encode(t)) if t else 0 for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in place), pa.array(counts, pa.int64())], names=[*keep, out])

    return documents.mapInArrow(run, schema)
