"""Driver tables seen as stations, prices, snapshots, transactions, routes and staging records.

The tables hold no coordinates, so positions are a fixed formula of the key.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuelspark.functions.lookups import FUELS
from fuelspark.functions.numeric import cents, mean_price

FLAG_OF_FUEL = {"regular": "A", "premium": "N", "diesel": "R"}
EVENTS_OF_FUEL = {"regular": ("view", "signup"), "premium": ("click", "error"), "diesel": ("purchase",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fuel_from(column: str, codes: dict[str, str | tuple[str, ...]]):
    expr = None
    for fuel, code in codes.items():
        hit = F.col(column).isin(*code)
        expr = F.when(hit, fuel) if expr is None else expr.when(hit, fuel)
    return expr


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    key = F.col("s_suppkey")
    # a planned station per country: on the register, but no feed prices it yet
    planned = nation.select((F.col("n_nationkey") + 1_000_000).alias("s_suppkey"), F.concat(F.lit("Planned "), "n_name").alias("s_name"), F.col("n_nationkey").alias("s_nationkey"))
    supplier = supplier.select("s_suppkey", "s_name", "s_nationkey").unionByName(planned)
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("BRAND_"), key % 7).alias("brand"),
            F.concat(F.lit("CITY_"), key % 12).alias("city"),
            F.col("n_name").alias("state"),
            F.col("r_name").alias("region"),
            (19.0 + ((key * 37) % 100) / 500.0).alias("lat"),
            (-99.4 + ((key * 53) % 97) / 480.0).alias("lng"),
        )
    )


def prices_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per station with a price per fuel: a single aggregation over the line items."""
    items = table(spark, sf_dir, "lineitem")
    amount = cents(F.col("l_extendedprice"))
    sums = []
    for fuel, flag in FLAG_OF_FUEL.items():
        hit = F.col("l_returnflag") == flag
        sums += [F.sum(F.when(hit, amount)).alias(f"s_{fuel}"), F.count_if(hit).alias(f"n_{fuel}")]
    wide = items.groupBy(F.col("l_suppkey").alias("id")).agg(*sums)
    # one station in 41 asks three tenths more: the outliers that the global rule is for
    tenths = F.when(F.col("id") % 41 == 7, 13).otherwise(10)
    return wide.select(
        "id", *[mean_price(F.col(f"s_{f}") * tenths, F.col(f"n_{f}") * F.lit(20000.0)).alias(f) for f in FUELS]
    )


def to_long(wide: DataFrame, *keys: str) -> DataFrame:
    """Wide prices to one row per fuel; missing prices are left out."""
    return wide.unpivot(list(keys), FUELS, "fuel", "price").filter(F.col("price").isNotNull())


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(prices_wide(spark, sf_dir), "id")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price per station and fuel."""
    events = table(spark, sf_dir, "events").withColumn("fuel", _fuel_from("event_type", EVENTS_OF_FUEL))
    return (
        events.filter("fuel is not null")
        .groupBy((F.col("user_id") % 15).alias("id"), F.to_date("ts").alias("date"), "fuel")
        .agg(mean_price(F.sum(cents(F.col("value"))), F.count("value")).alias("price"))
    )


def snapshots_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = snapshots(spark, sf_dir)
    return long.groupBy("id", "date").agg(*[F.max(F.when(F.col("fuel") == f, F.col("price"))).alias(f) for f in FUELS])


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("tx_id"),
        F.col("o_custkey").alias("vehicle_id"),
        F.col("l_suppkey").alias("station_id"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").alias("liters"),
        (F.floor(F.col("l_extendedprice") * 100 / 2000.0 + 0.5) / 100.0).alias("charged_price"),
        _fuel_from("l_returnflag", FLAG_OF_FUEL).alias("fuel"),
    )


def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines: customers in blocks of ten points-of-departure, 15 points per route."""
    key = F.col("c_custkey")
    block, row = F.floor(key / 150), key % 150
    return table(spark, sf_dir, "customer").select(
        (block * 10 + row % 10).alias("route_id"),
        F.floor(row / 10).alias("seq"),
        (19.0 + 0.025 * F.floor(row / 10) + 0.001 * (block % 10)).alias("lat"),
        (-99.4 + 0.04 * (row % 10)).alias("lng"),
    )


# Spellings of the brand per source, by brand number modulo 8
BRAND_SPELLINGS = {
    "cre": ["PEMEX", "OXXO GAS", "SHELL", "BP", "TOTALENERGIES", "GAS 500", "INDEPENDIENTE", "HIDROSINNA"],
    "osm": ["Pemex", "Oxxogas", "Shell México", "BP Mexico", "Total Energies", "Green Gas", None, "Hidrosina"],
    "denue": ["PETRO 7", "OXXO", "SHEL", "AM PM", "TOTAL", "G-500", "LA LOMA", "HIDROSINA"],
}


def raw_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three registers that describe the same stations: part keys 3k, 3k+1 and 3k+2 are one station."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    lead = part.select(
        key.alias("lead_key"), F.col("p_name").alias("lead_name"), F.col("p_type").alias("lead_type"),
        F.col("p_size").alias("lead_size"), F.substring("p_brand", 7, 3).cast("int").alias("lead_brand"),
    )
    rows = part.select(key.alias("key"), (key % 3).alias("part_of"), F.floor(key / 3).alias("group"))
    # the file is small for its rows, so its size would have the driver hold all of them for a broadcast
    rows = rows.join(lead.hint("merge"), F.col("lead_key") == F.col("key") - F.col("part_of"))
    part_of, size, kind, name = F.col("part_of"), F.col("lead_size"), F.col("lead_type"), F.col("lead_name")
    alone = (part_of == 0) & (F.col("group") % 50 == 7)  # a regulator record that no other register knows
    source = F.when(part_of == 0, "cre").when(part_of == 1, "osm").otherwise("denue")
    spelled = {
        s: F.element_at(F.array(*[F.lit(x).cast("string") for x in names]), (F.col("lead_brand") % 8 + 1).cast("int"))
        for s, names in BRAND_SPELLINGS.items()
    }
    return rows.select(
        F.concat(source, F.lit("_"), F.lpad(F.col("key").cast("string"), 12, "0")).alias("id"),
        source.alias("source"),
        F.when(part_of == 0, F.concat(F.lit("GASOLINERA "), name))
        .when((part_of == 1) & (size % 4 == 0), F.concat(F.lit("Gaso. "), F.replace(name, F.lit("e"), F.lit(""))))
        .when(part_of == 1, F.concat(F.lit("Gaso. "), name))
        .when(size % 3 == 0, F.concat(F.lit("EST. DE SERV. "), name, F.lit(" NORTE 12, S.A. DE C.V.")))
        .otherwise(F.concat(F.lit("GASOLINERA "), name, F.lit(" S.A. DE C.V."))).alias("raw_name"),
        F.when(part_of == 0, spelled["cre"]).when(part_of == 1, spelled["osm"])
        .when(size % 2 == 0, spelled["denue"]).alias("raw_brand"),
        F.when(part_of == 0, F.concat(F.lit("AV. "), kind, F.lit(" No. "), size, F.lit(" COL. "), name))
        .when(part_of == 1, F.concat(F.lit("Avenida "), kind, F.lit(" "), size))
        .when(size % 5 != 0, F.concat(F.lit("CALLE "), kind, F.lit(" #"), size, F.lit(", COLONIA "), name))
        .alias("raw_address"),
        F.when(alone, F.concat(F.lit("Isla "), F.col("key"))).otherwise(
            F.concat(F.lit("Mún "), size, F.when(part_of == 1, F.lit(", Jal.")).otherwise(F.lit("")))).alias("raw_municipality"),
        F.when(part_of == 1, F.lower(kind)).otherwise(kind).alias("raw_state"),
        F.when(part_of == 1, F.concat(F.lit("C.P. "), size + 1000)).otherwise((size + 1000).cast("string")).alias("raw_zip"),
        F.when((part_of == 2) & (size % 10 == 0), F.lit(None)).otherwise(
            19.0 + ((F.col("group") * 37) % 1000) / 500.0 + part_of * 0.0005 + F.when(alone, 5.0).otherwise(0.0)
        ).alias("lat"),
        F.when((part_of == 2) & (size % 10 == 0), F.lit(None)).otherwise(
            -100.0 + ((F.col("group") * 53) % 997) / 500.0
        ).alias("lng"),
        F.when(part_of == 0, F.concat(F.lit("PL/"), F.floor(F.col("group") / 2), F.lit("/EXP/ES/2015"))).alias("cre_id"),
        F.timestamp_add("DAY", -F.col("group") % 40, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).alias("fetched_at"),
    )


AS_OF = "2024-01-31"
MASTER_STATES = [
    "CIUDAD DE MEXICO", "JALISCO", "NUEVO LEON", "BAJA CALIFORNIA", "CHIAPAS", "YUCATAN", "SONORA", "PUEBLA", None,
]


def masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers seen as master stations, with every defect the quality rules look for."""
    k = F.col("c_custkey")
    state = F.element_at(F.array(*[F.lit(s).cast("string") for s in MASTER_STATES]), (k % 9 + 1).cast("int"))
    day = F.lit(AS_OF).cast("timestamp_ntz")
    sources = F.transform(
        F.sequence(F.lit(0), (k % 4).cast("int")),
        lambda i: F.struct(F.concat(F.lit("source_"), i).alias("source"), F.concat_ws("_", i, k).alias("id")))
    point = (k % 13) != 0
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("mst_"), F.lpad(k.cast("string"), 12, "0")).alias("master_id"),
        F.when(k % 4 != 0, F.concat(F.lit("PL/"), F.floor(k / 3), F.lit("/EXP/ES/2015"))).alias("pl_number"),
        F.when(k % 50 == 0, F.lit(None)).when(k % 51 == 0, "").otherwise(F.upper("c_name")).alias("canonical_name"),
        F.when(k % 5 != 0, F.concat(F.lit("BRAND_"), k % 7)).alias("canonical_brand"),
        F.when(k % 6 != 0, F.concat(F.lit("CALLE "), k % 97)).alias("canonical_address"),
        F.concat(F.lit("MUN "), k % 40).alias("canonical_municipality"), state.alias("canonical_state"),
        F.lpad((k % 99999).cast("string"), 5, "0").alias("canonical_zip"),
        F.when(point, 14.0 + ((k * 37) % 1000) / 50.0).alias("lat"),
        F.when(point & (k % 17 != 0), -119.0 + ((k * 53) % 997) / 30.0).alias("lng"),
        F.when(k % 6 == 0, "closed").otherwise("active").alias("status"),
        (F.floor((F.col("c_acctbal") + 1000) / 11000 * 10000 + 0.5) / 10000.0).alias("confidence_score"),
        F.concat(F.lit("source_"), k % 4).alias("primary_source"), sources.alias("source_ids"),
        k.cast("string").alias("cre_place_id"),
        F.when(k % 2 == 0, F.concat(F.lit("PL/"), k)).alias("cre_id"),
        F.timestamp_add("DAY", -(k % 200).cast("int"), day).alias("last_refreshed_at"),
        F.timestamp_add("DAY", -(k % 120).cast("int"), day).alias("last_confirmed_at"),
        (k % 23 == 0).alias("name_drift_flag"), (k % 5 == 0).alias("review_flag"),
        F.when(k % 46 == 0, "renamed by owner").alias("review_reason"),
    )


def reports(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events seen as community reports: the user is the station's, up to a kilometre away."""
    e = (events if events is not None else table(spark, sf_dir, "events")).withColumn(
        "fuel", _fuel_from("event_type", EVENTS_OF_FUEL))
    station, off = F.col("user_id"), F.col("event_id") % 10
    return e.filter("fuel is not null").select(
        F.col("event_id").alias("report_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 40).alias("user_id"), station.alias("id"), "fuel",
        F.col("value").alias("price"),
        (19.0 + ((station * 37) % 100) / 500.0 + off * 0.001).alias("lat"),
        (-99.4 + ((station * 53) % 97) / 480.0).alias("lng"),
    )
