"""Export tables for the applications and reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuelspark.functions.lookups import FUELS, STATE_REGIONS
from fuelspark.functions.numeric import cents, js_round, mean_price
from fuelspark.functions.text import literal_map
from fuelspark.operators.trends import price_history

CSV_COLUMNS = [
    "master_id", "pl_number", "canonical_name", "canonical_brand", "canonical_address", "canonical_municipality",
    "canonical_state", "canonical_zip", "lat", "lng", "status", "confidence_score", "primary_source",
    "last_confirmed_at", "precio_regular", "precio_premium", "precio_diesel",
]


def region_of(state: Column) -> Column:
    return F.coalesce(literal_map(STATE_REGIONS)[state], F.lit("Otro"))


def app_stations(masters_with_prices: DataFrame) -> DataFrame:
    """Active masters in the nested shape of the application: prices are a struct or null."""
    m = masters_with_prices.filter("status = 'active'")
    some = F.coalesce(*[F.col(f) for f in FUELS]).isNotNull()
    blank = lambda c, other="": F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    return m.select(
        F.col("master_id").alias("id"), blank("canonical_name").alias("name"), blank("canonical_brand", "OTRO").alias("brand"),
        blank("canonical_address").alias("address"), blank("canonical_municipality").alias("city"),
        blank("canonical_state").alias("state"), blank("canonical_zip").alias("zipCode"), "lat", "lng",
        some.alias("hasData"), F.when(some, F.struct(*FUELS)).alias("prices"), "pl_number",
        js_round(F.coalesce("confidence_score", F.lit(0.0)), 4).alias("confidence"), "primary_source", "source_ids",
    )


def write_app_json(df: DataFrame, path: str) -> None:
    """One station per line, in as many files as the data needs."""
    app_stations(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def flat_export(masters_with_prices: DataFrame) -> DataFrame:
    renamed = masters_with_prices.filter("status = 'active'").withColumnsRenamed({f: f"precio_{f}" for f in FUELS})
    return renamed.select(*[c for c in CSV_COLUMNS if c in renamed.columns])


def write_flat_csv(df: DataFrame, path: str) -> None:
    """Files in order of state, municipality and name; the sort is by range over many files."""
    ordered = flat_export(df).orderBy("canonical_state", "canonical_municipality", "canonical_name", "master_id")
    ordered.write.mode("overwrite").option("header", True).csv(path)


def station_report(merged: DataFrame, report_date: str) -> DataFrame:
    return merged.select(
        F.lit(report_date).alias("report_date"), F.col("id").alias("station_id"), "name", "brand",
        F.col("city").alias("municipality"), "state", region_of(F.col("state")).alias("region"),
        F.col("lat").alias("latitude"), F.col("lng").alias("longitude"), F.col("has_data").cast("int").alias("has_data"),
        *[F.col(f).alias(f"{f}_price") for f in FUELS],
    )


def price_history_export(snapshots: DataFrame, stations: DataFrame, anomalies: DataFrame, days: int = 90) -> DataFrame:
    """One row per date, fuel and station with the national average of the day and the anomaly flag.

    The averages have one row per date and fuel, which bounds the broadcast side.
    """
    rows = price_history(snapshots, days)
    means = rows.groupBy("date", "fuel").agg(mean_price(F.sum(cents(F.col("price"))), F.count("price")).alias("national_avg"))
    flags = anomalies.select("id", "fuel", "date", F.col("z_score").alias("anomaly_zscore"))
    joined = rows.join(F.broadcast(means), ["date", "fuel"]).join(stations, "id").join(flags, ["id", "fuel", "date"], "left")
    return joined.select(
        F.col("date").cast("string").alias("date"), F.col("id").alias("station_id"), "name", "brand", "city", "state",
        region_of(F.col("state")).alias("region"), F.col("fuel").alias("fuel_type"), F.col("price").alias("price_mxn"),
        "national_avg", ((cents(F.col("price")) - cents(F.col("national_avg"))) / 100.0).alias("delta_from_avg"),
        F.col("anomaly_zscore").isNotNull().cast("int").alias("is_anomaly"), "anomaly_zscore",
    )


def anomaly_export(anomalies: DataFrame, detection_date: str) -> DataFrame:
    deviation = js_round((F.col("price") - F.col("local_avg")) / F.col("local_avg") * 100, 1)
    return anomalies.select(
        F.lit(detection_date).alias("detection_date"), F.col("id").alias("site_id"), F.col("name").alias("site_name"),
        "brand", "city", "state", region_of(F.col("state")).alias("region"), F.col("fuel").alias("product"), "price",
        "local_avg", "z_score", F.when(F.col("local_avg") > 0, deviation).alias("deviation_pct"), "direction", "severity",
        F.col("nearby_count").alias("neighbor_count"),
    )


def list_export(filtered: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Filtered stations with Y or N for data and for a local anomaly."""
    flags = anomalies.select("id").distinct().withColumn("_flag", F.lit("Y"))
    return filtered.join(flags.hint("merge"), "id", "left").select(
        "id", "name", "brand", "city", "state", "lat", "lng", *FUELS,
        F.when(F.col("has_data"), "Y").otherwise("N").alias("has_data"), F.coalesce("_flag", F.lit("N")).alias("is_anomaly"),
    )
