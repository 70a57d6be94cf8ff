"""Price tables, statistics and group averages.

Long prices are (id, fuel, price). Statistics start from a histogram (fuel, price) -> count: prices are
whole cents inside a fixed band, so a group has at most 9,501 distinct values however many rows it holds.
That histogram is what crosses the network, and every statistic is exact.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fuelspark.functions.lookups import FUELS, PRICE_MAX, PRICE_MIN
from fuelspark.functions.numeric import cents, js_round, mean_price, pop_std

PERCENTILES = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}


def sane_price(price: Column) -> Column:
    return F.when(price.between(PRICE_MIN, PRICE_MAX), js_round(price, 2))


def latest_price(prices: DataFrame, version: str) -> DataFrame:
    """One row per station when a feed repeats it: the last version wins."""
    return prices.groupBy("id").agg(*[F.max_by(f, version).alias(f) for f in FUELS])


def has_any_price() -> Column:
    return F.coalesce(*[F.col(f) for f in FUELS]).isNotNull()


def merge_prices(stations: DataFrame, prices_wide: DataFrame) -> DataFrame:
    """Stations with their prices; ``has_data`` when any fuel is priced."""
    return stations.join(prices_wide, "id", "left").withColumn("has_data", has_any_price())


def merge_prices_fallback(masters: DataFrame, prices: DataFrame) -> DataFrame:
    """Prices by ``place_id``, else by ``cre_id``. Null keys never match."""
    values = F.struct(*FUELS)
    by_place = prices.filter("place_id is not null").select(F.col("place_id").alias("cre_place_id"), values.alias("_p"))
    by_permit = prices.filter("cre_id is not null").select("cre_id", values.alias("_q"))
    joined = masters.join(by_place, "cre_place_id", "left").join(by_permit, "cre_id", "left")
    return joined.select(*masters.columns, *[F.coalesce("_p", "_q")[f].alias(f) for f in FUELS])


def histogram(prices: DataFrame, *groups: str) -> DataFrame:
    return prices.groupBy(*groups, "price").agg(F.count(F.lit(1)).alias("n"))


def price_statistics(prices: DataFrame, *groups: str) -> DataFrame:
    """Min, max, mean, median, percentiles, population deviation and count per group."""
    c, n = cents(F.col("price")), F.col("n")
    points = F.percentile(c, F.array(*[F.lit(p) for p in PERCENTILES.values()]), n)
    stats = histogram(prices, *groups).groupBy(*groups).agg(
        F.min("price").alias("min"), F.max("price").alias("max"), F.sum("n").alias("count"),
        F.sum(c * n).alias("_s"), F.sum((c * c).cast("double") * n).alias("_ss"), points.alias("_p"),
    )
    std = F.when(F.col("min") == F.col("max"), F.lit(0.0)).otherwise(
        js_round(pop_std(F.col("_ss"), F.col("_s"), F.col("count")) / 100.0, 3)
    )
    return stats.select(
        *groups, "min", "max", mean_price(F.col("_s"), F.col("count")).alias("avg"),
        *[(F.floor(F.col("_p")[i] + 0.5) / 100.0).alias(k) for i, k in enumerate(PERCENTILES)],
        std.alias("std_dev"), "count",
    )


def average_by(prices: DataFrame, *groups: str) -> DataFrame:
    """Average, lowest and highest price and number of stations per group."""
    return prices.groupBy(*groups).agg(
        mean_price(F.sum(cents(F.col("price"))), F.count("price")).alias("avg"),
        F.min("price").alias("min"), F.max("price").alias("max"), F.count("price").alias("station_count"),
    )


def averages_by_place_and_brand(prices: DataFrame) -> DataFrame:
    """City, brand and state averages in one pass (grouping sets)."""
    level = F.when(F.grouping("city") == 0, "city").when(F.grouping("brand") == 0, "brand").otherwise("state")
    fuel, city, state, brand = (F.col(c) for c in ("fuel", "city", "state", "brand"))
    return prices.groupingSets([[fuel, city, state], [fuel, state], [fuel, brand]], fuel, city, state, brand).agg(
        level.alias("level"),
        mean_price(F.sum(cents(F.col("price"))), F.count("price")).alias("avg"),
        F.min("price").alias("min"), F.max("price").alias("max"), F.count("price").alias("station_count"),
    )


def coverage(merged: DataFrame) -> DataFrame:
    total, with_data = F.count(F.lit(1)), F.count_if("has_data")
    return merged.agg(
        total.alias("total_stations"), with_data.alias("stations_with_data"),
        F.when(total > 0, js_round(with_data / total * 100)).otherwise(F.lit(0.0)).alias("coverage_pct"),
    )


def national_summary(merged: DataFrame) -> DataFrame:
    """Statistics per fuel with the share of stations that have data (scalar subqueries)."""
    long = merged.unpivot(["id"], FUELS, "fuel", "price").filter("price is not null")
    fuels = merged.sparkSession.createDataFrame([(f,) for f in FUELS], "fuel string")
    stats = F.broadcast(price_statistics(long, "fuel"))
    totals = coverage(merged)
    return fuels.join(stats, "fuel", "left").select("*", *[totals.select(c).scalar().alias(c) for c in totals.columns])


def app_statistics(long: DataFrame, flagged_ids: DataFrame) -> DataFrame:
    """Per fuel statistics and the cheapest station that is not flagged as anomalous."""
    tagged = long.join(flagged_ids.select("id").distinct().withColumn("_flag", F.lit(True)), "id", "left")
    best = F.min(F.when(F.col("_flag").isNull(), F.struct("price", "id")))
    stats = tagged.groupBy("fuel").agg(
        F.sum(cents(F.col("price"))).alias("_s"), F.count("price").alias("count"),
        F.min("price").alias("min"), F.max("price").alias("max"), best.alias("_best"),
    )
    return stats.select(
        "fuel", mean_price(F.col("_s"), F.col("count")).alias("avg"), "min", "max", "count",
        F.col("_best.id").alias("cheapest_id"), F.col("_best.price").alias("cheapest_price"),
    )


def counts_of(stations: DataFrame, column: str, missing: str) -> DataFrame:
    return stations.groupBy(F.coalesce(column, F.lit(missing)).alias("name")).agg(F.count(F.lit(1)).alias("count"))


def distinct_values(stations: DataFrame, column: str, leave_out: str | None = None) -> DataFrame:
    kept = stations.filter(F.col(column) != "")
    if leave_out:
        kept = kept.filter(F.col(column) != leave_out)
    return kept.select(F.col(column).alias("name")).distinct()


def best_in_set(long: DataFrame, set_column: str) -> DataFrame:
    """Lowest price per fuel among the compared stations and whether a row holds it."""
    best = long.groupBy(set_column, "fuel").agg(F.min("price").alias("best_price"))
    return long.join(best, [set_column, "fuel"]).withColumn("is_best", F.col("price") == F.col("best_price"))


def cheapest(long: DataFrame, n: int = 10) -> DataFrame:
    return long.orderBy(F.col("price").asc(), F.col("id").asc()).limit(n)


def dearest(long: DataFrame, n: int = 10) -> DataFrame:
    return long.orderBy(F.col("price").desc(), F.col("id").asc()).limit(n)


def cheapest_decile(long: DataFrame) -> DataFrame:
    """Flag prices up to the value at position floor(n / 10) of the sorted prices of the fuel.

    The position is found on the histogram, which has a few thousand rows per fuel.
    """
    running = W.partitionBy("fuel").orderBy("price").rowsBetween(W.unboundedPreceding, 0)
    bins = histogram(long, "fuel").withColumn("_upto", F.sum("n").over(running))
    bins = bins.withColumn("_total", F.sum("n").over(W.partitionBy("fuel")))
    limit = bins.filter(F.col("_upto") > F.floor(F.col("_total") / 10)).groupBy("fuel").agg(
        F.min("price").alias("decile_price")
    )
    flagged = long.join(F.broadcast(limit), "fuel")
    return flagged.withColumn("is_cheapest", F.col("price") <= F.col("decile_price"))


def price_band(long: DataFrame) -> DataFrame:
    """Low, middle or high third of the range of the fuel; one fuel row per fuel is broadcast."""
    ends = F.broadcast(long.groupBy("fuel").agg(F.min("price").alias("_lo"), F.max("price").alias("_hi")))
    share = (F.col("price") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    band = (
        F.when(F.col("_hi") == F.col("_lo"), "flat").when(share <= 0.33, "low")
        .when(share <= 0.66, "middle").otherwise("high")
    )
    return long.join(ends, "fuel").withColumn("band", band).drop("_lo", "_hi")


def versus_average(long: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Difference to the average of the fuel in money and percent, and its direction."""
    means = F.broadcast(
        long.groupBy("fuel").agg(mean_price(F.sum(cents(F.col("price"))), F.count("price")).alias("avg"))
    )
    value = F.col("price") - F.col("avg")
    return long.join(means, "fuel").select(
        *[F.col(c) for c in long.columns], "avg",
        js_round(value, 2).alias("value"), js_round(value / F.col("avg") * 100, 1).alias("pct"),
        F.when(value > tolerance, "above").when(value < -tolerance, "below").otherwise("equal").alias("direction"),
    )
