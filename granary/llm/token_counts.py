"""Token counts by byte-pair merging (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import _bpe

_COUNTERS: dict[int, _bpe.Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """Count the tokens of each whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``vocabulary`` is the path of a byte-level .json vocabulary. A piece's count
    is its bytes less the merges that a heap of adjacent pairs and a linked
    list make; no identifiers are made. Rows stay where they are: no shuffle.

    Null and empty texts have 0 bytes and tokens; a null doc_id stays null;
    repeated rows give one row each; very long pieces take n log n steps.
    Further columns are not looked at. An empty table gives none.
    """
    raw = docs.sparkSession.sparkContext.broadcast(_bpe.vocabulary(vocabulary))

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = hash(raw.value)
        counter = _COUNTERS.get(key) or _COUNTERS.setdefault(key, _bpe.Counter(raw.value))
        for batch in texts:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
