"""Near-duplicate embeddings by spherical-cap filters (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._graph import components
from granary.llm._store import stage

PARTS = 4


def _code(dim: int, size: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation and, for each of PARTS runs of dimensions, ``size`` random directions."""
    rng = np.random.default_rng([seed, dim, size])
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    words = [rng.standard_normal((size, len(p))) for p in np.array_split(np.arange(dim), PARTS)]
    return q * np.sign(np.diag(r)), [w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12) for w in words]


def decode(x: np.ndarray, code: tuple[np.ndarray, list[np.ndarray]], threshold: float) -> list[np.ndarray]:
    """Of each unit vector, all filter directions of the product code whose inner product with it is ``threshold`` or more.

    A filter's direction is one direction of each part, so its product is the
    sum of the parts'. The sums of the first and of the last two parts are
    sorted; each of the first needs a run of the last.
    """
    rotation, words = code
    size = len(words[0])
    y = x @ rotation
    parts = np.array_split(np.arange(y.shape[1]), PARTS)
    s = [y[:, p] @ w.T / PARTS**0.5 for p, w in zip(parts, words, strict=True)]
    out = []
    for k in range(len(x)):
        a, b = ((s[i][k][:, None] + s[i + 1][k][None, :]).ravel() for i in (0, 2))
        i = np.flatnonzero(a + b.max() >= threshold)
        j = np.flatnonzero(b + a.max() >= threshold)
        j = j[np.argsort(-b[j])]
        run = np.searchsorted(-b[j], -(threshold - a[i]), "right")
        out.append(np.repeat(i, run) * size**2 + j[np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)])
    return out


def _tuned(dim: int, size: int, expected: float, seed: int) -> tuple[tuple, float]:
    """A code and the threshold at which a random vector has as many filters as expected."""
    code = _code(dim, size, seed)
    draw = np.random.default_rng(seed).standard_normal((300, dim))
    draw /= np.linalg.norm(draw, axis=1, keepdims=True)
    low, high = 0.0, 1.0
    for _ in range(14):
        mid = (low + high) / 2
        low, high = (mid, high) if np.mean([len(f) for f in decode(draw, code, mid)]) > expected else (low, mid)
    return code, low


def _filters(size: int, expected: float, rotations: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, list] = {}
        for pdf in batches:
            dims = pdf["embedding"].map(len)
            for dim, part in pdf.groupby(dims):
                if dim not in codes:
                    codes[dim] = [_tuned(dim, size, expected / rotations, seed + r) for r in range(rotations)]
                x = np.array(part["embedding"].tolist(), np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                each = [[f * rotations + r for f in decode(x, *codes[dim][r])] for r in range(rotations)]
                found = [np.concatenate(f) for f in zip(*each, strict=True)]
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "dim": dim, "filters": found}).astype({"dim": "int32"})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, expected: float = 96.0, rotations: int = 6, seed: int = 3) -> DataFrame:
    """Link vectors whose cosine in double precision is ``cosine`` or more: vec_id, n_links, component_id, kept.

    Filters are the directions of ``rotations`` random product codes; their number
    grows with that of the vectors, so that a filter holds a few. Each vector is
    list-decoded to all filters whose direction exceeds a code's threshold, at
    which a random vector has ``expected`` in all. Vectors with a filter in common are verified, so no
    link is false; one is missed when both ends share no filter. Equal vectors are
    one class and never meet: a class links to a class, and counts as its rows.
    Beyond classes every link is found once, as n_links counts them.

    Null and zero vectors and those with null or non-finite components have no
    links. Vectors of different lengths don't link. Rows with a null vec_id are
    left out; rows that repeat a vec_id count as other vectors and give one row
    each. Further columns are not looked at. An empty table gives none.
    """
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    sound = F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda e: e != 0.0), F.lit(False))
    valid = source.where(sound)
    classes = stage(valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("rep", "n", "embedding"), "classes")
    size = int(np.clip(np.ceil((8 * max(1, classes.count())) ** (1 / PARTS)), 8, 128))
    filters = classes.select("rep", "embedding").mapInPandas(_filters(size, expected, rotations, seed), "rep long, dim int, filters array<long>")
    filters = stage(filters.select("rep", "dim", F.explode("filters").alias("filter")), "filters")
    a, b = filters.toDF("src", "dim", "filter"), filters.toDF("dst", "dim", "filter")
    met = a.join(b, ["dim", "filter"]).where("src < dst").select("src", "dst").distinct()
    x = classes.select(F.col("rep").alias("src"), F.col("embedding").alias("a"), F.col("n").alias("m"))
    y = classes.select(F.col("rep").alias("dst"), F.col("embedding").alias("b"), "n")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    linked = met.join(x, "src").join(y, "dst").where(dot("a", "b") >= cosine * F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b"))).select("src", "dst", "m", "n")
    linked = stage(linked, "links")
    degree = linked.select(F.col("src").alias("rep"), F.col("n").alias("d")).union(linked.select("dst", "m")).groupBy("rep").agg(F.sum("d").alias("d"))
    groups = components(linked.select("src", "dst"))
    known = classes.join(degree, "rep", "left").join(groups.toDF("rep", "component"), "rep", "left")
    known = known.select("embedding", (F.coalesce("d", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = source.withColumn("embedding", F.when(sound, F.col("embedding"))).join(known, "embedding", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
