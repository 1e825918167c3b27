"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode alone a folder under /tmp where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        base = "/tmp/checkpoints/granary"
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Shuffle files of a write go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, tag: str, **settings: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    The lineage ends at the table, so a lost executor costs no recomputation
    of what came before, and the table is computed once however often it is used.
    The write's shuffle files are removed with its end. ``settings`` of the session hold for
    the write alone, by names with _ for the dots.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    settings = {CLEANUP: "true"} | {name.replace("_", "."): value for name, value in settings.items()}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few longs, 100 MB or so in memory, up to which a side of a join is broadcast.
SMALL = 1_000_000


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """``df``, a staged table of ids, marked for broadcast if a count of its rows shows that it is small; beyond, both sides are shuffled."""
    return F.broadcast(df) if df.count() <= SMALL else df


def look_up(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", tag: str | None = None) -> DataFrame:
    """``left`` joined with ``right``, a staged table with a row for each key, by broadcasts of SMALL rows or so: ``left``, which is wide, is never shuffled.

    With a ``tag`` the parts are staged one by one where there are several, so that one broadcast is held at a time.
    """
    n = -(-right.count() // SMALL)
    if n <= 1:
        return left.join(F.broadcast(right), on, how)
    own = lambda df, k: df.where(F.pmod(F.xxhash64(*on), F.lit(n)) == k)
    parts = (own(left, k).join(F.broadcast(own(right, k)), on, how) for k in range(n))
    return reduce(DataFrame.union, (stage(part, tag) if tag else part for part in parts))
