"""Helpers that keep jobs flat on a cluster: hot join keys, lineage cuts and scratch folders."""

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one key that one task may take; a key with more of them on either side is dealt over several.
HOT_ROWS = 100_000
# Pairs of one key that one task of a range join may compare; a key with more of them is dealt as well.
HOT_PAIRS = 4_000_000


def hot_keys(
    left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, hot_pairs: int | None = None, weights: tuple[str, str] | None = None
) -> DataFrame:
    """Keys with more than ``hot_rows`` rows on a side, or more than ``hot_pairs`` pairs, and over how many salts each
    side of them is dealt. With ``weights``, a column of each side, a row counts as so many pairs' ends.

    Counting combines on the map side. How many keys are hot grows with the data, so the optimizer chooses how to
    join them.
    """
    if hot_pairs:
        count = lambda df, k, n: df.groupBy(*keys).agg((F.sum(weights[k]) if weights else F.count(F.lit(1))).alias(n))
        # sides are often rows repeated over cells, which the optimizer takes for few and would broadcast
        met = count(left, 0, "_na").join(count(right, 1, "_nb").hint("merge"), keys)
        many, edge = F.col("_na") * F.col("_nb") > hot_pairs, math.isqrt(hot_pairs)
        parts = lambda c: F.when(many, F.ceil(F.col(c) / F.lit(min(edge, hot_rows)))).otherwise(F.ceil(F.col(c) / F.lit(hot_rows))).cast("int")
        return met.select(*keys, parts("_na").alias("_salts_a"), parts("_nb").alias("_salts_b")).filter("_salts_a > 1 or _salts_b > 1")
    sides = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.lit(k).alias("_side"), "_n") for k, df in enumerate((left, right))]
    salts = [F.ceil(F.coalesce(F.max(F.when(F.col("_side") == k, F.col("_n"))), F.lit(1)) / F.lit(hot_rows)).cast("int").alias(f"_salts_{n}") for k, n in ((0, "a"), (1, "b"))]
    hot = sides[0].unionByName(sides[1]).filter(F.col("_n") > hot_rows)
    return hot.groupBy(*keys).agg(*salts)


def salted_pairs(
    left: DataFrame, right: DataFrame, keys: list[str], spread_by: str, hot_rows: int = HOT_ROWS, hot_pairs: int | None = None,
    weights: tuple[str, str] | None = None,
) -> DataFrame:
    """Inner equi-join in which hot keys of either side are dealt over salts.

    With ``hot_pairs`` a key is hot by its pairs too, and both sides are dealt over all shuffle partitions: few bytes
    can make many pairs there, so the size of a partition says nothing about its work. ``weights`` names a column of each
    side with the records that a row stands for, where pairs of rows unfold to pairs of records.

    A row picks one salt of its own side by hash and is repeated for every salt of the other side, so every pair
    meets exactly once. Keys that are not hot have a single salt and are not repeated.
    """
    wa, wb = ([w] for w in weights) if weights else ([], [])
    hot = hot_keys(left.select(*keys, *wa), right.select(*keys, *wb), keys, hot_rows, hot_pairs, weights)
    a, b = (F.coalesce(F.col(f"_salts_{n}"), F.lit(1)) for n in ("a", "b"))
    own = lambda by, n: F.pmod(by, n.cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    one = left.join(hot, keys, "left").withColumn("_a", own(F.xxhash64(spread_by), a)).withColumn("_b", every(b)).drop("_salts_a", "_salts_b")
    other = right.join(hot, keys, "left").withColumn("_b", own(F.xxhash64(*right.columns), b)).withColumn("_a", every(a)).drop("_salts_a", "_salts_b")
    if hot_pairs:
        parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        one, other = (df.repartition(parts, *keys, "_a", "_b") for df in (one, other))
    return one.join(other.hint("merge"), [*keys, "_a", "_b"]).drop("_a", "_b")


def in_parts(rows: DataFrame, by: list[str], spread: str, most: int = 1000) -> DataFrame:
    """Rows with a column ``_part`` that deals each group over parts of about ``most`` rows."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64(spread), F.greatest(F.lit(1), F.ceil(F.col("_n") / most)))
    return rows.join(counts, by).withColumn("_part", part).drop("_n")


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder the cluster names in ``spark.checkpoint.dir``; a fresh local one only where Spark itself is local
    and none is set, as in tests."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="fuelspark-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder for an intermediate table, below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For results used several times: they are computed once, survive lost executors, stay columnar, and
    give the optimizer a size to choose join strategies by.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
