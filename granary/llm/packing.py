"""Vector best-fit packing of documents into training sequences (operator 4)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import _bpe
from granary.llm._store import stage

_ENCODERS: dict[int, _bpe.Encoder] = {}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def _cut(raw: bytes, tokens: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = hash(raw.value)
        encoder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, _bpe.Encoder(raw.value))
        end = end_id.to_bytes(4, "little")
        for pdf in batches:
            rows: list[tuple] = []
            for doc, text, row in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["row"].tolist(), strict=True):
                ids = encoder.ids(text) + end
                n = len(ids) // 4
                ends = range((n - 1) % tokens + 1, n + 1, tokens)  # the first piece is what is over
                for k, stop in enumerate(ends):
                    start = max(0, stop - tokens)
                    part = ids[4 * start : 4 * stop]
                    rows.append((doc, k, start, stop - start, zlib.crc32(part), row))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "row"])
            yield out.astype({"doc_id": "Int64"})

    return run


def best_fit(sizes: np.ndarray, capacity: np.ndarray, select: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and the amount of the first resource that lay in the bin before it.

    ``sizes`` has a row per item and a column per resource. Items go in order of
    falling weighted size. An item goes to the open bin that has room in every
    resource and the least residual norm afterwards (``norm``), or the largest
    weighted dot-product of item and residual (``dot``); else to a new bin.
    """
    n, m = sizes.shape
    scale = weights / capacity
    order = np.lexsort((np.arange(n), -(sizes * scale).sum(1)))
    at, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    free = np.empty((m, n), np.float64)
    name = np.empty(n, np.int64)  # of the bin in each open slot
    least = np.minimum.accumulate(sizes[order][::-1], axis=0)[::-1]  # of each resource, over what is still to come
    slots = bins = 0
    for k, i in enumerate(order):
        item = sizes[i]
        left = free[:, :slots] - item[:, None]
        fits = np.flatnonzero((left >= 0).all(0))
        if len(fits):
            if select == "norm":
                score = ((left[:, fits] * scale[:, None]) ** 2).sum(0)
            else:
                score = -((free[:, :slots][:, fits] * item[:, None]) * (scale**2)[:, None]).sum(0)
            s = fits[score.argmin()]
        else:
            s, name[slots] = slots, bins
            free[:, s] = capacity
            slots, bins = slots + 1, bins + 1
        at[i], offset[i] = name[s], capacity[0] - free[0, s]
        free[:, s] -= item
        if k + 1 < n and (free[:, s] < least[k + 1]).any():  # nothing to come fits there
            slots -= 1
            free[:, s], name[s] = free[:, slots], name[slots]
    return at, offset


def pack(docs: DataFrame, vocabulary: str, tokens: int = 2048, max_docs: int | None = None, max_attention: float | None = None, select: str = "norm", weights: tuple[float, float, float] = (1.0, 0.0, 0.0), end_id: int = 0, cell_tokens: int = 4_000_000) -> DataFrame:
    """Pack all documents into sequences of at most ``tokens`` tokens.

    A document is the ids of its text and then ``end_id``. Only documents of
    more than ``tokens`` tokens are cut, from the end, into pieces of that
    size, so that the first piece may be shorter. Returns for each piece: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset (of its first token there).

    A sequence has three capacities: tokens, documents (``max_docs``, None: as
    many as tokens) and attention cost, the sum of squared piece lengths
    (``max_attention``, None: what one full piece costs); a piece goes to the
    sequence that fits best under all of them (see best_fit). Full pieces are
    sequences of their own. The rest is dealt by a hash of document and piece
    into cells of about ``cell_tokens`` tokens, whose number grows with the
    corpus, and each cell is packed by one task; a cell leaves about one
    sequence of some 2,000 not full, and no key decides how large it is.

    Null and empty texts are a document of ``end_id`` alone. Rows with a null
    doc_id and repeated rows are packed like any other. Further columns of
    ``docs`` are not looked at. An empty table gives none.
    """
    if select not in ("norm", "dot"):
        raise ValueError(f"select is 'norm' or 'dot', not {select!r}")
    raw = docs.sparkSession.sparkContext.broadcast(_bpe.vocabulary(vocabulary))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    pieces = stage(source.mapInPandas(_cut(raw, tokens, end_id), PIECES), "pieces")
    capacity = np.array([tokens, max_docs or tokens, max_attention or float(tokens) ** 2])

    total = pieces.where(F.col("length") < tokens).agg(F.sum("length")).first()[0] or 0
    cells = max(1, -(-total // cell_tokens))
    dealt = pieces.where(F.col("length") < tokens).withColumn("cell", F.pmod(F.xxhash64("row", "piece"), F.lit(cells)))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece"], ignore_index=True)
        n = pdf["length"].to_numpy(np.float64)
        at, offset = best_fit(np.stack([n, np.ones(len(n)), n**2], 1), capacity, select, np.array(weights))
        # The cell's sequences have the even ids of its own; those of full pieces are odd.
        pdf["sequence_id"], pdf["offset"] = (at * cells + int(key[0])) * 2, offset
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = dealt.groupBy("cell").applyInPandas(fill, out)
    full = pieces.where(F.col("length") == tokens).select("doc_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
