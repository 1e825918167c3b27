"""Secret scan: fixed patterns and character Markov models (operator 2), in DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds with their patterns, in the order in which spans that start together are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "model")
#: What the models judge: long runs of the characters that keys are made of.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A run is a secret if its transitions speak for a random string by so much each in the mean, and by ``least`` in all.
MEAN = 0.5
CHUNK = 256
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _places(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Spans of the leftmost matches of ``pattern`` that don't overlap, in code points; ``keep``: group of which 8 characters are needed.

    The text between matches and the matches alternate, so adding up their lengths gives places.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))
    if keep is not None:
        rows = F.zip_with(rows, keep, lambda r, k: F.struct(r["gap"].alias("gap"), r["hit"].alias("hit"), (F.length(k) >= 8).alias("ok")))
    else:
        rows = F.transform(rows, lambda r: F.struct(r["gap"].alias("gap"), r["hit"].alias("hit"), F.lit(True).alias("ok")))
    none = F.from_json(F.lit("[]"), SPAN)

    def step(state: Column, r: Column) -> Column:
        begin = state["at"] + r["gap"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + r["hit"]).alias("end"))
        return F.struct((begin + r["hit"]).alias("at"), F.when(r["ok"], F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def chunk(state: Column, rows: Column) -> Column:
        zero = F.struct(state["at"].alias("at"), none.alias("out"))
        return F.aggregate(rows, zero, step, lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], F.array(s["out"])).alias("out")))

    # An array that grows by one is copied each time; in chunks, a text of very many matches stays linear.
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / CHUNK).cast("int")), lambda i: F.slice(rows, i * CHUNK + 1, F.lit(CHUNK)))
    start = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), f"array<{SPAN}>").alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(chunks, start, chunk, lambda s: F.flatten(s["out"]))).otherwise(none)


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def _codes(value: Column) -> Column:
    """The code of each character, 0 for those beyond ASCII."""
    return F.transform(F.split(value, ""), lambda c: F.when(F.ascii(c) < 128, F.ascii(c)).otherwise(F.lit(0)))


def _transitions(samples: DataFrame) -> dict[tuple[int, str], int]:
    """How often each pair of neighbouring characters occurs in the samples (label, value) of each label: at most twice the alphabet's square."""
    coded = samples.where(F.length("value") >= 2).select("label", _codes(F.col("value")).alias("c"))
    pairs = coded.select("label", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * 128 + b)).alias("pair"))
    return {(r["label"], chr(r["pair"] >> 7) + chr(r["pair"] & 127)): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}


def train(samples: DataFrame, prior: float = 0.5) -> list[float]:
    """Log-ratio of each pair of characters under two first-order Markov models, random strings' over identifiers'.

    ``samples`` has label (1 random, 0 ordinary) and value, of characters of ALPHABET.
    ``prior`` observations are added for each pair: without samples all ratios
    are 0. The ratios are laid out by both characters' codes, 128 to a row.
    """
    n = _transitions(samples.where(F.col("value").rlike(rf"^[{ALPHABET}]+$")))
    logs = {}
    for label in (0, 1):
        for a in ALPHABET:
            row = [n.get((label, a + b), 0) + prior for b in ALPHABET]
            whole = math.log(sum(row))
            logs.update({(label, a + b): math.log(x) - whole for b, x in zip(ALPHABET, row, strict=True)})
    out = [0.0] * (128 * 128)
    for a in ALPHABET:
        for b in ALPHABET:
            out[ord(a) * 128 + ord(b)] = round(logs[1, a + b] - logs[0, a + b], 6)
    return out


def score(value: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a string under the trained models, in time that grows with its length."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    # One fold over the characters, which remembers the one before.
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
    step = lambda s, c: F.struct((s["sum"] + F.when(s["last"] < 0, 0.0).otherwise(F.element_at(table, s["last"] * 128 + c + 1))).alias("sum"), c.alias("last"))
    return F.aggregate(_codes(value), zero, step, lambda s: s["sum"])


def _based(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    values = F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))
    assign = _places(F.col("text"), ASSIGN, 0, values)
    return rows.withColumn("base", F.array_sort(F.concat(assign, _places(F.col("text"), ACCESS, 1), _places(F.col("text"), HEX, 2))))


def labelled_samples(docs: DataFrame, most: int = 20_000) -> DataFrame:
    """(label, value): strings that the base patterns find, as random, and ordinary identifiers.

    These are made as programs and paths make them, of three words in a row of 3 letters or more
    with no string among them: joined by _, / or -, in camel case, in capitals,
    with a number in the middle or at the end, run together; and rulers of one
    mark. They come from the whole texts of about ``most`` documents, chosen by a hash of their ids.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    share = max(1, docs.count() // most)
    rows = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(share)) == 0).select(text.alias("text"))
    strings = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    found = rows.where(F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}"))
    random = found.select(F.lit(1).alias("label"), F.explode(strings).alias("value")).where(F.length("value") >= 12)
    words = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9])[A-Za-z][a-z]{2,}(?![A-Za-z0-9])"), F.lit(0))
    three = rows.select(words.alias("w")).select(F.explode(F.arrays_zip("w", F.slice("w", 2, 1 << 30).alias("x"), F.slice("w", 3, 1 << 30).alias("y"))).alias("t"))
    three = three.select(F.array("t.w", "t.x", "t.y").alias("t")).where(F.col("t")[2].isNotNull())
    kind, low = F.pmod(F.xxhash64("t"), F.lit(10)), F.transform("t", lambda w: F.lower(w))
    number = F.pmod(F.xxhash64("t", F.lit(3)), F.element_at(F.array(*[F.lit(10**k) for k in (1, 1, 2, 4)]), (F.pmod(F.xxhash64("t", F.lit(4)), F.lit(4)) + 1).cast("int"))).cast("string")
    camel = F.array_join(F.transform("t", lambda w: F.initcap(w)), "")
    shapes = [F.array_join(low, "_"), F.array_join(low, "/"), F.array_join(low, "-"), camel, F.upper(F.array_join(low, "_")), F.concat(F.array_join(low, "_"), F.lit("_"), number), F.concat(F.lit("/"), F.array_join(low, "/"), number), F.concat_ws("-", F.element_at(low, 1), number, F.element_at(low, 2)), F.array_join(low, ""), F.concat(F.element_at(low, 1), number, F.lit("/"), F.element_at(low, 2), F.lit("_"), F.element_at(low, 3))]
    made = three.select(F.lit(0).alias("label"), F.element_at(F.array(*shapes), (kind + 1).cast("int")).alias("value"))
    rulers = docs.sparkSession.createDataFrame([(0, c * 400) for c in "=-_/+0123456789xX"], "label int, value string")
    return random.union(made).union(rulers)


def scan(docs: DataFrame, ratios: list[float], least: float = 15.0) -> DataFrame:
    """Secrets of each whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model.

    The base spans are those of the fixed patterns. To them come runs of 20 or
    more key characters that touch no base span and whose log-likelihood ratio
    (see train) is ``least`` or more. Spans are kind:start:end in code points,
    the end exclusive, by start and then kind, joined by commas.

    A null text counts as empty, and an empty text has no span (the hash is
    that of nothing). A null doc_id stays; repeated rows give one row each.
    Further columns are not looked at. An empty table gives none.
    """
    rows = _based(docs)
    hits = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    places = _places(F.col("text"), CANDIDATE, 3)
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    judged = F.transform(F.zip_with(places, hits, lambda s, h: F.struct(s.alias("s"), h.alias("h"))), lambda x: F.struct(x["s"].alias("s"), (score(x["h"], ratios) >= F.greatest(F.lit(least), MEAN * (F.length(x["h"]) - 1))).alias("ok")))
    more = F.transform(F.filter(judged, lambda x: x["ok"] & apart(x["s"])), lambda x: x["s"])
    rows = rows.withColumn("more", F.when(F.col("text").rlike(CANDIDATE), more).otherwise(F.from_json(F.lit("[]"), SPAN)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    every = F.array_sort(F.concat("base", "more"))
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"), F.size("more").cast("long").alias("n_model"))


def find_secrets(docs: DataFrame, least: float = 15.0, most_samples: int = 20_000) -> DataFrame:
    """``scan`` with models trained on labelled samples of ``docs`` itself."""
    return scan(docs, train(labelled_samples(docs, most_samples)), least)
