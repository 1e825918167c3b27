"""Benchmark decontamination by spaced seeds (operator 9), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of the words under a mask, those at 1 are compared and those at 0 may differ. Wherever two of 13 words are
#: substituted, one of the masks lies on words that aren't.
MASKS = ("11101011", "110100111")
#: The same for items of 5 to 12 words, of which one, or two from 10 on, are substituted.
SHORT = ("111", "1101")
LEAST = 5
AROUND = 32
#: Seeds (of 24 bytes or so) up to which the benchmark's side is broadcast.
MOST_BROADCAST = 1_000_000
#: Bytes of the benchmark's words up to which these are broadcast too.
MOST_LETTERS = 32_000_000


def _words(text: str) -> Column:
    """Letters and digits in lower case, by words; punctuation and white space part them."""
    plain = F.trim(F.regexp_replace(F.lower(F.col(text).cast("string")), r"[^\p{L}\p{N}]+", " "))
    return F.split(plain, " ")


def _seeds(rows: DataFrame, masks: tuple[str, ...], *carry: str) -> DataFrame:
    """``carry``, pos and key for each place of each mask in the array w."""
    n = F.size("w")
    least = min(map(len, masks))
    at = rows.where(n >= least).select(*carry, "w", F.explode(F.sequence(F.lit(0), F.size("w") - least)).alias("pos"))
    keys = []
    for k, mask in enumerate(masks):
        picked = [F.col("w")[F.col("pos") + i] for i, c in enumerate(mask) if c == "1"]
        keys.append(F.when(F.col("pos") + len(mask) <= n, F.xxhash64(F.lit(k), *picked)))
    return at.select(*carry, "w", "pos", F.explode(F.array(*keys)).alias("key")).where("key is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, overlap: int = 13, percent: int = 80, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """Documents that hold a passage of a benchmark item: doc_id, item_id, n_hits, start_word, matched.

    Words are letters and digits in lower case. Seeds of the fixed masks are
    taken at every word of both sides and joined. A hit lays document and item
    over each other; it counts if within AROUND words of it some ``overlap``
    words (all of an item that has fewer) agree in ``percent`` % of their
    places, so words may be substituted. ``matched`` is the most that agree
    around a hit, start_word the first hit's place.

    The benchmark's seeds and words are broadcast if both are few, after
    counting them; else both sides are shuffled, and hot seeds are split
    as skewed. Null and empty texts, items of fewer than five words and those with a null
    item_id meet nothing. Null doc_ids stay. Repeated rows are found once. Further columns are
    not looked at. An empty table on either side gives none.
    """
    items = benchmark.select("item_id", _words("text").alias("w")).where(F.size("w") >= LEAST)
    span = max(map(len, masks))
    few = items.where(F.size("w") < max(span, overlap))
    wanted, every = _seeds(items, masks, "item_id"), masks
    if not few.isEmpty():
        every = (*masks, *SHORT)  # the masks keep their places, and so their keys
        wanted = wanted.union(_seeds(few, every, "item_id"))
    wanted = wanted.select("key", "item_id", F.col("pos").alias("at")).distinct()
    text = items.select("item_id", F.col("w").alias("item"))
    letters = text.agg(F.sum(F.octet_length(F.array_join("item", " ")))).first()[0] or 0
    small = wanted.count() <= MOST_BROADCAST and letters <= MOST_LETTERS
    item_side = F.broadcast(wanted) if small else wanted
    hits = _seeds(docs.select("doc_id", _words("text").alias("w")), every, "doc_id").join(item_side, "key")

    before = F.least("pos", "at", F.lit(AROUND))
    context = F.slice("w", F.col("pos") - before + 1, before + AROUND)
    hits = hits.select("doc_id", "pos", "item_id", "at", before.alias("before"), context.alias("context"))
    hits = hits.join(F.broadcast(text) if small else text, "item_id")
    other = F.slice("item", F.col("at") - F.col("before") + 1, F.size("context"))
    length = F.least(F.size("context"), F.size(other))
    same = F.zip_with(F.slice("context", F.lit(1), length), F.slice(other, F.lit(1), length), lambda a, b: F.when(a == b, 1).otherwise(0))
    hits = hits.select("doc_id", "item_id", "pos", same.alias("same"), F.least(F.lit(overlap), F.size("item")).alias("run"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    need = F.ceil(F.col("run") * percent / 100.0 - 1e-9)
    hits = hits.withColumn("matched", total(F.col("same"))).where(F.col("matched") >= need)
    # The condition is in the expression, as Spark may work out parts of a filter in any order, and a sequence to 0 counts down.
    starts = F.sequence(F.lit(1), F.greatest(F.size("same") - F.col("run") + 1, F.lit(1)))
    fits = F.exists(starts, lambda i: total(F.slice("same", i, F.col("run"))) >= need)
    found = hits.where(F.when(F.size("same") >= F.col("run"), fits).otherwise(False))
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_hits"), F.min("pos").cast("long").alias("start_word"), F.max("matched").cast("long").alias("matched"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that leaks names; its columns are kept, and so are rows with a null doc_id and null or empty texts.

    Of rows that repeat a doc_id with other texts all go if one leaks.
    """
    gone = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_gone")).where("_gone is not null").distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
