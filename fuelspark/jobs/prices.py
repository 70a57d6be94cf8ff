"""The daily price run: prices of one or more days to snapshots, changes and statistics, with a retention.

A run renews the partitions of the dates it brings in every table, so it can be repeated, and days may be caught up
together or one by one with the same result as long as they come in order. A price is compared with the station's newest
one before it, which is looked up in the table of last prices and not in past snapshots.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fuelspark.functions.lookups import FUELS
from fuelspark.jobs.store import Store
from fuelspark.operators.prices import price_statistics, sane_price
from fuelspark.operators.scale import materialize
from fuelspark.sources import zones

KEYS = ["id", "fuel"]
SCHEMAS = {
    "snapshots": "id bigint, fuel string, price double, date date",
    "changes": "id bigint, fuel string, previous_date date, previous double, price double, direction string, date date",
    "statistics": "fuel string, min double, max double, avg double, p10 double, p25 double, median double, p75 double, p90 double, std_dev double, count bigint, date date",
}


def sane_prices(feed: DataFrame) -> DataFrame:
    """id, date, fuel and price of a wide feed; a station that a day repeats counts by its larger price, and prices out of
    range are left out."""
    wide = feed.select("id", F.to_date("date").alias("date"), *[sane_price(F.col(f)).alias(f) for f in FUELS])
    long = wide.unpivot(["id", "date"], FUELS, "fuel", "price").filter("price is not null and id is not null and date is not null")
    return long.groupBy("id", "date", "fuel").agg(F.max("price").alias("price"))


def price_changes(fresh: DataFrame, last: DataFrame | None) -> DataFrame:
    """Prices of the new days that differ from the one before them."""
    if last is not None:
        # only stations with a new price are compared
        fresh = fresh.withColumn("_new", F.lit(True)).unionByName(last.join(fresh.select(*KEYS).distinct(), KEYS, "left_semi").withColumn("_new", F.lit(False)))
    else:
        fresh = fresh.withColumn("_new", F.lit(True))
    w = W.partitionBy(*KEYS).orderBy("date")
    rows = fresh.withColumns({"previous": F.lag("price").over(w), "previous_date": F.lag("date").over(w)})
    moved = rows.filter("_new and previous <> price")
    return moved.select(*KEYS, "date", "previous_date", "previous", "price", F.when(F.col("price") > F.col("previous"), "up").otherwise("down").alias("direction"))


def price_run(feed: DataFrame, root: str, run: str, keep_days: int = 90) -> Store:
    """One run over a feed (id, date, a column per fuel). Days that are older than the newest stored day are left to the
    table ``late``. Returns the store; snapshots, changes and statistics are partitioned tables below it."""
    spark = feed.sparkSession
    store = Store(spark, root)
    if run in store.runs():
        return store
    before = store.before(run)
    last = store.read("last", before) if before else None
    fresh = materialize(sane_prices(feed), "prices")
    if last is not None:
        newest = last.agg(F.max("date")).scalar()
        store.write("late", run, fresh.filter(F.col("date") <= newest))
        fresh = materialize(fresh.filter(F.coalesce(F.col("date") > newest, F.lit(True))), "prices")
    zones.write_snapshots(fresh, table(store, "snapshots"))
    zones.write_snapshots(price_changes(fresh, last), table(store, "changes"))
    zones.write_snapshots(price_statistics(fresh, "date", "fuel"), table(store, "statistics"))
    known = fresh if last is None else fresh.unionByName(last)
    store.write("last", run, known.groupBy(*KEYS).agg(F.max(F.struct("date", "price")).alias("v")).select(*KEYS, "v.*"))
    newest = fresh.agg(F.max("date")).first()[0]
    if newest:
        for name in ("snapshots", "changes", "statistics"):
            zones.retain_snapshots(spark, table(store, name), str(newest), keep_days)
    store.commit(run)
    return store


def table(store: Store, name: str) -> str:
    return f"{store.root}/_{name}"


def read(store: Store, name: str) -> DataFrame:
    """One of the partitioned tables, without rows where no run had any."""
    path, files = store.folder(table(store, name))
    if not files.exists(path):
        return store.spark.createDataFrame([], SCHEMAS[name])
    return store.spark.read.schema(SCHEMAS[name]).parquet(table(store, name))
