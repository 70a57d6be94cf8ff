"""Streaming jobs over price files, community reports and alerts.

The source publishes no late-data policy; these jobs accept rows up to two days late. Every job runs with
``availableNow`` (a scheduled catch-up) or continuously, and keeps its progress below the shared folder.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fuelspark.functions.geo import haversine_km
from fuelspark.operators.scale import materialize
from fuelspark.sources.zones import delete_snapshot, partitions, read_snapshots, write_snapshots

LATENESS = "2 days"


def file_stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Stream of Parquet files of one folder; the schema is that of the files already there."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def run_batches(stream: DataFrame, work: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{work}/progress")
        .trigger(availableNow=True).foreachBatch(handle).start()
    )
    query.awaitTermination()


def run_append(stream: DataFrame, work: str) -> DataFrame:
    """Append the rows of the stream to a Parquet table and return that table."""
    target = f"{work}/table"
    query = (
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{work}/progress")
        .trigger(availableNow=True).format("parquet").start(target)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_version(spark: SparkSession, root: str, batch: int, build: Callable[[DataFrame | None], DataFrame]) -> None:
    """Write version ``batch`` of a small keyed table from the one before, and drop those no replay can ask for.

    A repeated batch starts from the same earlier version, so it changes nothing.
    """
    before = [int(v) for (v,) in partitions(spark, root, "version") if int(v) < batch]
    previous = spark.read.parquet(f"{root}/version={max(before)}") if before else None
    build(previous).write.mode("overwrite").parquet(f"{root}/version={batch}")
    for old in sorted(before)[:-1]:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version={old}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def newest_version(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/version={max(int(v) for (v,) in partitions(spark, root, 'version'))}")


def run_updates(stream: DataFrame, work: str, keys: list[str]) -> DataFrame:
    """Keep the latest row per key of an aggregation in update mode: one row per key, however many batches ran."""
    spark, root = stream.sparkSession, f"{work}/table"

    def save(rows: DataFrame, batch: int) -> None:
        write_version(spark, root, batch, lambda old: rows if old is None else rows.unionByName(old.join(rows.select(*keys), keys, "left_anti")))

    run_batches(stream, work, save, mode="update")
    return newest_version(spark, root)


# --- snapshots --------------------------------------------------------------------------------------


def ingest_snapshots(prices: DataFrame, work: str, force: bool = False) -> DataFrame:
    """At most one snapshot per date: the batch that first brings a date stores all its rows, whatever number of files
    they come in. Rows of a date that an earlier batch stored go to the table ``late``, unless ``force`` replaces the date.

    ``prices`` is a stream of (id, date, regular, premium, diesel).
    """
    spark, target, late = prices.sparkSession, f"{work}/snapshots", f"{work}/late"

    def save(rows: DataFrame, batch: int) -> None:
        if force:
            write_snapshots(rows.withColumn("batch", F.lit(batch)), target)
            return
        if exists(spark, target):
            # a date counts as stored if another batch did it: a repeated batch writes its own dates again
            stored = read_snapshots(spark, target).filter(F.col("batch") != batch).select("date").distinct()
            known = rows.join(stored, "date", "left_semi")
            known.select(rows.columns).write.mode("overwrite").parquet(f"{late}/batch={batch}")
            rows = rows.join(stored, "date", "left_anti")
        write_snapshots(rows.withColumn("batch", F.lit(batch)), target)

    run_batches(prices, work, save)
    return read_snapshots(spark, target).drop("batch")


def rolling_history(events: DataFrame, work: str, days: int = 7) -> DataFrame:
    """Last price per station, fuel and day, for the newest days; a later report of a day replaces it.

    ``events`` is a stream of (ts, id, fuel, price). A batch renews the partitions of its days and drops those that are
    no longer among the newest, so the table never holds more than these days.
    """
    spark, target = events.sparkSession, f"{work}/history"
    last = F.max(F.struct("ts", "price"))

    def save(rows: DataFrame, batch: int) -> None:
        found = rows.select(F.to_date("ts").alias("date"), "id", "fuel", "ts", "price").filter("price is not null")
        if exists(spark, target):
            own = found.select("date").distinct()
            found = found.unionByName(read_snapshots(spark, target).join(own, "date", "left_semi").select(found.columns))
        daily = found.groupBy("date", "id", "fuel").agg(last.alias("v")).select("date", "id", "fuel", "v.*")
        write_snapshots(materialize(daily, "history"), target)  # it reads what it replaces: written aside first
        dates = sorted(d for (d,) in partitions(spark, target, "date"))
        for date in dates[:-days]:
            delete_snapshot(spark, target, date)

    run_batches(events, work, save)
    return read_snapshots(spark, target).select("date", "id", "fuel", "price")


def price_change_events(snapshots: DataFrame, work: str) -> DataFrame:
    """Changes of the price of a station and fuel against its snapshot before, as a table of events.

    ``snapshots`` is a stream of (id, fuel, date, price), one row per snapshot. The newest snapshot of each key is a small
    versioned table; rows that are not newer than it come late and make no event.
    """
    spark, events, state = snapshots.sparkSession, f"{work}/events", f"{work}/last"
    keys = ["id", "fuel"]

    def save(rows: DataFrame, batch: int) -> None:
        def build(last: DataFrame | None) -> DataFrame:
            fresh = rows.select(*keys, "date", "price").filter("price is not null").groupBy(*keys, "date").agg(F.max("price").alias("price"))
            if last is not None:
                newest = last.select(*keys, F.col("date").alias("_last"))
                fresh = fresh.join(newest, keys, "left").filter("_last is null or date > _last").drop("_last")
                fresh = fresh.unionByName(last.join(fresh.select(*keys).distinct(), keys, "left_semi"))
            previous = F.lag("price").over(W.partitionBy(*keys).orderBy("date"))
            moves = fresh.withColumn("previous", previous).filter("previous is not null and previous <> price")
            moves = moves.withColumn("direction", F.when(F.col("price") > F.col("previous"), "up").otherwise("down"))
            moves.select(*keys, "date", "previous", "price", "direction").write.mode("overwrite").parquet(f"{events}/batch={batch}")
            now = fresh if last is None else fresh.unionByName(last)
            return now.groupBy(*keys).agg(F.max(F.struct("date", "price")).alias("v")).select(*keys, "v.*")

        write_version(spark, state, batch, build)

    run_batches(snapshots, work, save)
    return spark.read.parquet(events).drop("batch")


# --- community reports ------------------------------------------------------------------------------


def accept_reports(reports: DataFrame, stations: DataFrame, price_low: float = 5.0, price_high: float = 50.0,
                   reach_km: float = 0.6) -> DataFrame:
    """Reports with a plausible price from within 600 m of the station, each report once.

    ``reports`` is a stream of (report_id, ts, user_id, id, fuel, price, lat, lng).
    """
    places = stations.select("id", F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    near = haversine_km(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng")) <= reach_km
    plausible = reports.filter(F.col("price").between(price_low, price_high))
    seen_once = plausible.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["report_id"])
    return seen_once.join(places, "id").filter(near).drop("s_lat", "s_lng")


def newest_reports(accepted: DataFrame, n: int | None = None) -> DataFrame:
    """Reports, newest first; the application shows the first 200."""
    ordered = accepted.orderBy(F.col("ts").desc(), F.col("report_id").desc())
    return ordered.limit(n) if n else ordered


def latest_per_station(accepted: DataFrame) -> DataFrame:
    """Newest accepted price per station and fuel (streaming aggregation, update mode)."""
    newest = F.max_by(F.struct("price", "ts", "user_id"), F.struct("ts", "report_id"))
    return accepted.groupBy("id", "fuel").agg(newest.alias("v")).select("id", "fuel", "v.*")


def active_alerts(alerts: DataFrame) -> DataFrame:
    """One alert per user, station and fuel: the newest replaces older ones."""
    newest = F.max_by("threshold", F.struct("created_at", "threshold"))
    return alerts.groupBy("user_id", "id", "fuel").agg(newest.alias("threshold"))


def fire_alerts(prices: DataFrame, alerts: DataFrame) -> DataFrame:
    """Stream of prices against the alert table: a price below the threshold fires."""
    watch = active_alerts(alerts).withColumnRenamed("user_id", "alert_user")
    return prices.join(watch, ["id", "fuel"]).filter("price < threshold")


def contributor_points(accepted: DataFrame, per_report: int = 10) -> DataFrame:
    """Running points per contributor with the badge at 50 and 200 (update mode)."""
    points = accepted.groupBy("user_id").agg((F.count(F.lit(1)) * per_report).alias("points"))
    badge = F.when(F.col("points") >= 200, "expert").when(F.col("points") >= 50, "regular").otherwise("new")
    return points.withColumn("badge", badge)
