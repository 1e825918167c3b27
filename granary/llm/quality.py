"""Importance resampling of documents by hashed n-gram models (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import _words
from granary.llm._store import stage

WORD_BITS, PAIR_BITS = 18, 15
BUCKETS = (1 << WORD_BITS) + (1 << PAIR_BITS)
TARGET, POOR, TOXIC = 0, 1, 2
KINDS = 3
#: Letters and digits in lower case (and all bytes beyond ASCII), or punctuation alone; the rest becomes space.
_WORD = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
_MARK = bytes(32 if b <= 32 or 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 else b for b in range(256))
_SEEDS = np.random.default_rng(1).integers(1, 2**63, 4, dtype=np.uint64)
_REPEAT = np.uint64(0x1234567890ABCDEF)


def _hashes(memo: _words.WordHashes, text: str | None, table: bytes) -> np.ndarray:
    return memo.array((text or "").encode("utf-8", "surrogatepass").translate(table).split())


def _buckets(memo: _words.WordHashes, text: str | None) -> np.ndarray:
    """Buckets of a text's words, runs of punctuation and word pairs, each once, so that its own repeated words don't stand for its kind.

    A text of which a sixteenth of the words or more repeat the word before has one n-gram that says so.
    """
    words, marks = _hashes(memo, text, _WORD), _hashes(memo, text, _MARK)
    single = [words, marks]
    if len(words) > 1 and 16 * int((words[1:] == words[:-1]).sum()) >= len(words):
        single.append(np.array([_REPEAT]))
    out = np.unique(_words.mix(np.concatenate(single)) >> np.uint64(64 - WORD_BITS))
    if len(words) > 1:
        out = np.concatenate([out, np.unique(_words.shingles(words, 2) >> np.uint64(64 - PAIR_BITS)) + np.uint64(1 << WORD_BITS)])
    return out.astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each bucket occurs in a partition: in all its texts, and in those of each labelled kind."""
    memo, total = _words.WordHashes(), np.zeros((KINDS + 1, BUCKETS), np.int64)
    for pdf in batches:
        for text, kind in zip(pdf["text"].tolist(), pdf["kind"].tolist(), strict=True):
            own = _buckets(memo, text)
            total[KINDS][own] += 1
            if kind >= 0:
                total[kind][own] += 1
    at = np.flatnonzero(total[KINDS])
    yield pd.DataFrame({"bucket": at, **{f"n{k}": total[k][at] for k in range(KINDS + 1)}})


def labelled_kinds(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, kind) of at most ``most`` labelled documents, chosen by a hash of their ids; of several rows for one document the worst counts."""
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    kind = F.when(F.col("t") == 1, TOXIC).when(F.col("q") == 0, POOR).when(F.col("q") == 1, TARGET)
    return known.select("doc_id", kind.alias("kind")).where("kind is not null").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(most)


def _distinct(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """``kinds`` without documents that share a min-hash over three words in a row with a smaller doc_id of their kind, so that copies count once."""

    @F.pandas_udf("array<long>")
    def signed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _words.WordHashes()
        for batch in texts:
            grams = (_words.shingles(_hashes(memo, t, _WORD), 3) for t in batch)
            yield pd.Series([[int(_words.mix(g ^ s).min(initial=2**64 - 1).view(np.int64)) for s in _SEEDS] for g in grams])

    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(kinds), "doc_id")
    each = stage(labelled.select("doc_id", "kind", F.posexplode(signed("text")).alias("at", "least")).distinct(), "signed")
    first = each.groupBy("kind", "at", "least").agg(F.min("doc_id").alias("doc_id"))
    return first.groupBy("doc_id", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= len(_SEEDS)).select("doc_id", "kind")


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 40_000, prior: float = 1.0, sure: float = 5.0, strong: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each bucket under each kind's model, and the log of each kind's share.

    Counts are taken over all documents. They are the base measure to which the
    models of the labelled kinds are smoothed (near copies among the labelled
    count once): as many observations as the smallest kind has, times ``prior``. Buckets in which a kind's count is within ``sure`` standard
    deviations of what the target's would give, or whose log-ratio is under
    ``strong``, have the target's probability: many small chances, or a topic or
    language that one kind has more of, don't add up over a long text. The labelled rows are a sample of at most ``most_labelled``,
    which fixes the size of what is broadcast.
    """
    kinds = stage(labelled_kinds(labels, most_labelled), "labelled")
    share = np.zeros(KINDS)
    share[TARGET] = 1
    for k, n in kinds.groupBy("kind").count().collect():
        share[k] += n
    kinds = stage(_distinct(docs, kinds), "distinct")
    source = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(kinds), "doc_id", "left")
    counted = source.select("text", F.coalesce("kind", F.lit(-1)).alias("kind")).mapInPandas(_count, "bucket int, " + ", ".join(f"n{k} long" for k in range(KINDS + 1)))
    rows = counted.groupBy("bucket").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(KINDS + 1)]).collect()  # BUCKETS rows at most
    n = np.zeros((KINDS + 1, BUCKETS))
    for r in rows:
        n[:, r[0]] = r[1:]
    base = (n[KINDS] + 1) / (n[KINDS].sum() + BUCKETS)
    seen = n[:KINDS].sum(1)
    alpha = prior * max(1.0, seen[seen > 0].min(initial=np.inf) if seen.any() else 1.0) * base
    model = np.log((n[:KINDS] + alpha) / (n[:KINDS].sum(1, keepdims=True) + alpha.sum()))
    size = n[:KINDS].sum(1)
    for k in (POOR, TOXIC):
        part = size[k] / max(1.0, size[k] + size[TARGET])
        expected = (n[k] + n[TARGET]) * part
        plain = np.abs(n[k] - expected) < sure * np.sqrt(expected * (1 - part) + 1)
        plain |= np.abs(model[k] - model[TARGET]) < strong
        model[k][plain] = model[TARGET][plain]
    with np.errstate(divide="ignore"):
        return model, np.log(share / share.sum())  # a kind without labels has no share


def importance(docs: DataFrame, model: np.ndarray, shares: np.ndarray, seed: int = 1) -> DataFrame:
    """``docs`` with log_weight, the log of its probability as target text over that as raw text, and gumbel_key.

    Raw text is the mixture of the kinds' models by their shares, so the weight
    of a text that only the target explains is one over the target's share.
    """
    context = docs.sparkSession.sparkContext.broadcast((model.astype(np.float32), shares))

    @F.pandas_udf("double")
    def weigh(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo, (logp, share) = _words.WordHashes(), context.value
        for batch in texts:
            score = np.array([logp[:, _buckets(memo, t)].sum(1, dtype=np.float64) for t in batch]).reshape(-1, KINDS)
            yield pd.Series(score[:, TARGET] - np.logaddexp.reduce(score + share, axis=1))

    uniform = (F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(2**52 - 1) + 0.5) / float(2**52)
    return docs.withColumn("log_weight", weigh(F.col("text").cast("string"))).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(values: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest of the doubles of one column, by histograms of ever narrower ranges; minus infinity if there are fewer.

    Each step counts in all partitions and brings at most ``bins`` counts to the driver.
    """
    (name,) = values.columns
    low, high, n = values.agg(F.min(name), F.max(name), F.count(name)).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    while low < high:
        width = (high - low) / bins
        at = F.least(F.floor((F.col(name) - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        found = values.where(F.col(name).between(low, high)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).orderBy(F.desc("b")).collect()
        for row in found:
            if k <= row["n"]:
                if (row["lo"], row["hi"]) == (low, high):
                    return high
                low, high = row["lo"], row["hi"]
                break
            k -= row["n"]
    return high


def _drawn(scored: DataFrame, size: int | None) -> tuple[DataFrame, float]:
    """``scored`` with the least gumbel_key of the ``size`` largest (None: as many as are more probably target text than not)."""
    if size is None:
        size = scored.where("target_probability >= 0.5").count()
    return scored, kth_largest(scored.select("gumbel_key"), size)


def weights(docs: DataFrame, labels: DataFrame, most_labelled: int = 40_000, prior: float = 1.0, seed: int = 1) -> DataFrame:
    """``docs`` with log_weight, target_probability and gumbel_key in place of columns of those names."""
    model, shares = fit(docs, labels, most_labelled, prior)
    clean = docs.drop("log_weight", "target_probability", "gumbel_key")
    sure = F.least(F.lit(1.0), F.exp(F.col("log_weight") + float(shares[TARGET])))
    return importance(clean, model, shares, seed).withColumn("target_probability", sure)


def resampled_ids(docs: DataFrame, labels: DataFrame, size: int | None = None, **options) -> DataFrame:
    """doc_id, log_weight, target_probability and gumbel_key of what resample draws, each text weighed once."""
    scored, least = _drawn(stage(weights(docs.select("doc_id", "text"), labels, **options).drop("text"), "weights"), size)
    return scored.where(F.col("gumbel_key") >= least).select("doc_id", "log_weight", "target_probability", "gumbel_key")


def resample(docs: DataFrame, labels: DataFrame, size: int | None = None, most_labelled: int = 40_000, prior: float = 1.0, seed: int = 1) -> DataFrame:
    """The documents that importance resampling draws: their columns, log_weight, target_probability and gumbel_key.

    The target is labelled text of quality 1 that isn't toxic; the raw text is
    all of ``docs``, as a mixture of the target and of what was labelled poor or
    toxic. Weights are ratios of hashed n-gram models (see fit, importance).
    ``size`` documents are drawn without replacement: those of the largest
    log_weight plus Gumbel noise that depends on ``seed`` and doc_id alone.
    ``size`` None draws as many as are more probably target text than not.

    A null or empty text has a weight of 1, as nothing tells it from the
    target; a null doc_id draws noise like any other. Rows with the same doc_id
    and text have equal keys and are drawn or left together, so ties at the
    last place can make the draw larger. Without labels all weights are equal.
    Clashing columns of ``docs`` (log_weight, target_probability, gumbel_key)
    are replaced. An empty table gives none.
    """
    # Written once, as a text is costlier to weigh than to write.
    scored, least = _drawn(stage(weights(docs, labels, most_labelled, prior, seed), "weights"), size)
    return scored.where(F.col("gumbel_key") >= least)
