"""Raw zone and daily snapshots as partitioned Parquet tables.

Only whole partitions are ever rewritten, readers select by partition columns, and nothing here pulls rows
to the driver. Catalogue questions read partition values, not data.
"""

from datetime import date as date_type
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuelspark.operators.scale import scratch_path

DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"


def write_raw(df: DataFrame, path: str, source: str, date: str, batch_id: str) -> None:
    """Append one immutable batch below source, date and batch."""
    tagged = df.withColumns({"source": F.lit(source), "date": F.lit(date), "batch_id": F.lit(batch_id)})
    tagged.write.mode("append").option("compression", "snappy").partitionBy("source", "date", "batch_id").parquet(path)


def _zone(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", False).parquet(path)


def partitions(spark: SparkSession, path: str, *columns: str) -> list[tuple[str, ...]]:
    """Partition values of a table, read from the names of its folders through its file system; no file is opened."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path("/".join([path, *[f"{c}=*" for c in columns]]))
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    decode = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    parts = [status.getPath().toString().split("/")[-len(columns):] for status in found]
    return sorted(tuple(decode(x.split("=", 1)[1]) for x in part) for part in parts)


def list_batches(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Batches of a source, newest first."""
    rows = [(d, b) for s, d, b in partitions(spark, path, "source", "date", "batch_id") if s == source]
    return spark.createDataFrame(rows[::-1], "date string, batch_id string")


def read_batch(spark: SparkSession, path: str, source: str, batch_id: str) -> DataFrame:
    return _zone(spark, path).filter((F.col("source") == source) & (F.col("batch_id") == batch_id))


def read_latest(spark: SparkSession, path: str, source: str, date: str | None = None) -> DataFrame:
    """Newest batch of a source, of one date or of any; the other partitions are not opened."""
    batches = [(d, b) for s, d, b in partitions(spark, path, "source", "date", "batch_id") if s == source and date in (None, d)]
    rows = _zone(spark, path).filter(F.col("source") == source)
    if not batches:
        return rows.limit(0)
    newest = max(batches)
    return rows.filter((F.col("date").cast("string") == newest[0]) & (F.col("batch_id").cast("string") == newest[1]))


def split_rejects(df: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the condition and those that do not (unknown counts as not)."""
    ok = F.coalesce(valid, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def write_dead_letters(df: DataFrame, path: str, reason) -> None:
    df.withColumn("reject_reason", reason).write.mode("append").parquet(path)


# --- snapshots --------------------------------------------------------------------------------------


def write_snapshots(df: DataFrame, path: str) -> None:
    """Write daily snapshots; a date that is written again replaces its partition only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read_snapshots(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path).withColumn("date", F.to_date("date"))
    return rows.filter(F.col("date") == F.to_date(F.lit(date))) if date else rows


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Dates with a snapshot, newest first."""
    return spark.createDataFrame(partitions(spark, path, "date")[::-1], "date string").select(F.to_date("date").alias("date"))


def _drop_partitions(spark: SparkSession, path: str, dates: list[str]) -> int:
    """Remove date partitions through the file system of the table; returns how many were there."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    dropped = 0
    for date in dates:
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/date={date}")
        dropped += bool(target.getFileSystem(hadoop).delete(target, True))
    return dropped


def delete_snapshot(spark: SparkSession, path: str, date: str) -> int:
    return _drop_partitions(spark, path, [date])


def retain_snapshots(spark: SparkSession, path: str, as_of: str, keep_days: int = 90) -> int:
    """Drop partitions older than the number of days; dates are compared as they are written."""
    oldest = str(date_type.fromisoformat(as_of) - timedelta(days=keep_days))
    return _drop_partitions(spark, path, [d for (d,) in partitions(spark, path, "date") if d < oldest])


def snapshot_statistics(spark: SparkSession, path: str) -> DataFrame:
    dates = [d for (d,) in partitions(spark, path, "date")]
    return spark.createDataFrame([(len(dates), min(dates, default=None), max(dates, default=None))], "snapshot_count bigint, oldest string, newest string")


SNAPSHOT_FILE = "date string, stationCount long, stations array<struct<id:string,master_id:string,prices:struct<regular:double,premium:double,diesel:double>>>"


def import_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots, one per line, as (accepted station rows, rejects with the reason).

    A snapshot without date or stations is rejected whole; a station without id is rejected by itself.
    """
    raw = spark.read.schema(SNAPSHOT_FILE).json(path)
    reason = (
        F.when(F.col("date").isNull(), "date missing")
        .when(~F.regexp_like("date", F.lit(DATE_PATTERN)), "date format")
        .when(F.col("stations").isNull(), "stations missing").when(F.size("stations") == 0, "stations empty")
    )
    whole = raw.withColumn("reject_reason", reason)
    rows = whole.select("date", "reject_reason", F.explode_outer("stations").alias("s"))
    rows = rows.withColumn("id", F.coalesce("s.id", "s.master_id"))
    good, bad = split_rejects(rows, F.col("reject_reason").isNull() & F.col("id").isNotNull())
    accepted = good.select(F.to_date("date").alias("date"), "id", "s.prices.*")
    return accepted, bad.select("date", F.coalesce("reject_reason", F.lit("station id missing")).alias("reject_reason"))


def rewrite_in_place(df: DataFrame, path: str) -> None:
    """Replace a table by a result that reads it: written aside first, then read back and swapped in."""
    spark = df.sparkSession
    aside = scratch_path(spark, "rewrite")
    df.write.parquet(aside)
    spark.read.parquet(aside).write.mode("overwrite").parquet(path)
