"""Token counts of whole texts with a public tokenizer whose files lie outside the package."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the vocabulary's texts were cut into pieces before merging: contractions, letters, figures, signs, blanks.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    return len(_encoding(path).encode_ordinary(text))


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """BIGINT number of tokens of the whole text; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if isinstance(t, str) else 0).astype("int64")

    return count(text)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: texts compress so well that a small file holds many.

    Inputs with enough partitions, as all large ones have, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
