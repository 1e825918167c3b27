"""Removal of repeated byte strings in suffix order (operator 6)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import _rolling
from granary.llm._store import stage

BLOCK = 16
PLACE = ["doc", "text_key", "at"]


def _anchored(length: int, gram: int):
    """For each run of windows that have the same anchor: the anchor's hash, that of the whole run, its first and last window.

    A window of ``length`` bytes has as anchor its ``gram``-byte string of the
    least hash (the first of equals). Equal windows have equal anchors at equal
    places, so only windows whose anchors are equal have to be compared.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for doc, key, text in zip(pdf["doc"].tolist(), pdf["text_key"].tolist(), pdf["text"].tolist(), strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                if len(data) < length:
                    continue
                sums = _rolling.prefix(data)
                grams = _rolling.window_hash(sums, gram)
                place = _rolling.sliding_min((grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & np.uint64(0xFFFFFFFF)
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                last = np.r_[first[1:] - 1, len(place) - 1]
                anchor = place[first].astype(np.int64)
                whole = _rolling.span_hash(sums, first, last + length, (anchor - first).astype(np.uint64))
                parts.append(pd.DataFrame({"doc": doc, "text_key": key, "at": first, "last": last, "anchor": anchor, "group": grams[anchor].view(np.int64), "same": whole.view(np.int64)}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return run


def _blocks(length: int):
    """Each run again as blocks of BLOCK windows, counted from the anchor: the hash of the bytes common to all windows of the block, that of the whole block, and each window's own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for doc, key, text, runs in zip(pdf["doc"].tolist(), pdf["text_key"].tolist(), pdf["text"].tolist(), pdf["runs"].tolist(), strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                sums = _rolling.prefix(data)
                own = _rolling.window_hash(sums, length).view(np.int64)
                for run in runs:
                    lo, hi, anchor = run["at"], run["last"], run["anchor"]
                    start = np.arange(lo - (lo - anchor) % BLOCK, hi + 1, BLOCK)
                    a, b = np.maximum(start, lo), np.minimum(start + BLOCK - 1, hi)
                    core = _rolling.span_hash(sums, start + BLOCK - 1, start + length).view(np.int64)
                    whole = _rolling.span_hash(sums, a, b + length, (a - start).astype(np.uint64)).view(np.int64)
                    rows += [(doc, key, x, y, g, w, own[x : y + 1]) for x, y, g, w in zip(a.tolist(), b.tolist(), core.tolist(), whole.tolist(), strict=True)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "text_key", "at", "last", "group", "same", "windows"])

    return run


def _compared(rows: DataFrame, keep: str) -> DataFrame:
    """``rows`` of groups with more than one place, with ``gone`` (it repeats as a whole) and ``next`` (parts of it may repeat).

    Rows with equal ``same`` are equal, only rows with equal ``group`` can have
    equal windows. One place of each class, the first where that is to stay, stands
    for it in what follows.
    """
    place = F.struct(*PLACE) if keep == "first" else F.xxhash64(*PLACE)  # any one place will do where none stays
    classes = rows.groupBy("group", "same").agg(F.count("*").alias("n"), F.min(place).alias("head"))
    groups = classes.groupBy("group").agg(F.count("*").alias("kinds"), F.sum("n").alias("places")).where("places > 1")
    known = classes.join(groups, "group").select("group", "same", "n", "head", "kinds")
    found = rows.join(known.hint("shuffle_hash"), ["group", "same"])
    leads = place == F.col("head")
    gone = (F.col("n") > 1) & (F.lit(keep == "none") | ~leads)
    return found.withColumn("gone", gone).withColumn("next", leads & (F.col("kinds") > 1)).drop("n", "head", "kinds", "group", "same")


def repeated_spans(docs: DataFrame, length: int = 400, keep: str = "none", gram: int = 100) -> DataFrame:
    """Windows of ``length`` bytes that also start elsewhere, as runs: doc, text_key, at, last (first bytes, 0-based).

    ``docs`` has doc, text_key and text. With ``keep`` none, every place of a
    repeated window; with ``first``, those whose longest previous factor reaches
    ``length``, so that the first place by doc and position stays.

    Suffixes are ordered no further than this takes: windows come together by
    their anchors, then whole runs of equal windows, blocks of BLOCK windows and
    single windows are compared in turn, each only where the step before leaves
    it open. A place in the order of equal windows that has a smaller neighbour
    has an earlier match; minima and counts give this without a sorted array in
    any one task.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is 'none' or 'first', not {keep!r}")
    if not 0 < gram <= length - BLOCK:
        raise ValueError("gram must be positive and shorter than length by a block")
    shape = "doc long, text_key long, at int, last int, "
    runs = stage(docs.mapInPandas(_anchored(length, gram), shape + "anchor int, group long, same long"), "anchors")
    runs = stage(_compared(runs, keep), "runs")
    again = runs.where("next").groupBy("doc", "text_key").agg(F.collect_list(F.struct("at", "last", "anchor")).alias("runs"))
    blocks = docs.join(again, ["doc", "text_key"]).dropDuplicates(["doc", "text_key"]).mapInPandas(_blocks(length), shape + "group long, same long, windows array<long>")
    blocks = stage(_compared(stage(blocks, "blocks"), keep), "compared")
    windows = stage(blocks.where("next").select("doc", "text_key", "at", F.posexplode("windows").alias("k", "group")).select("doc", "text_key", (F.col("at") + F.col("k")).alias("at"), "group"), "windows")
    singles = _compared(windows.withColumn("same", F.lit(0)), keep).where("gone").select("doc", "text_key", "at", F.col("at").alias("last"))
    return runs.where("gone").select("doc", "text_key", "at", "last").unionByName(blocks.where("gone").select("doc", "text_key", "at", "last")).unionByName(singles)


def _kept(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, spans in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["spans"].tolist(), strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                n, gone = len(data), np.zeros(len(data) + 1, np.int64)
                if spans is not None:
                    for s in spans:
                        gone[s["at"]] += 1
                        gone[s["last"] + length] -= 1
                hidden = np.cumsum(gone[:n]) > 0
                starts = np.flatnonzero(hidden & ~np.r_[False, hidden[:-1]]) if n else hidden
                rows.append((doc, n, int(hidden.sum()), len(starts), data[~hidden].tobytes()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
            yield out.astype({"doc_id": "Int64"})

    return run


def remove_repeats(docs: DataFrame, length: int = 400, keep: str = "none", gram: int = 100, text: bool = True) -> DataFrame:
    """Remove each byte that a ``length``-byte string covers which also starts elsewhere in the corpus.

    Texts are their UTF-8 bytes; matches don't cross documents, overlaps in one
    document count, and strings are judged on the input. Returns for each row:
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and,
    with ``text``, kept (the remaining bytes, which may part a character).
    ``keep`` first leaves each string's first place (by doc_id, nulls first).

    Null and empty texts have 0 bytes. A null doc_id stays null. Rows equal in
    doc_id and text count as different places for ``keep`` none and as one for
    first. Further columns are not looked at. An empty table gives none.
    """
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = source.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    spans = repeated_spans(source.select("doc", "text_key", "text"), length, keep, gram)
    spans = stage(spans, "spans").groupBy("doc", "text_key").agg(F.collect_set(F.struct("at", "last")).alias("spans"))
    found = source.join(spans, ["doc", "text_key"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    found = found.mapInPandas(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    out = found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *["kept"] * text)
    return out
