"""Lengths of texts in tokens of a public tokenizer. The vocabulary file is a parameter and is never copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits a text before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(f"public:{path}", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, carry: list[str], path: str = VOCABULARY) -> DataFrame:
    """``carry`` and ``tokens`` per row: the whole text counts, special tokens' strings as ordinary text. NULL text: NULL."""
    source = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(carry)], df[text].alias("x"))
    fields = T.StructType([T.StructField(c, df.schema[c].dataType) for c in carry] + [T.StructField("tokens", T.LongType())])
    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            n = [None if not x.is_valid else len(encode(x.as_py())) for x in batch["x"]]
            yield pa.RecordBatch.from_arrays([*(batch[f"c{i}"].cast(schema[i].type) for i in range(len(carry))), pa.array(n, pa.int64())], schema=schema)

    return source.mapInArrow(run, fields)


__all__ = ["VOCABULARY", "count_tokens", "encoding"]
