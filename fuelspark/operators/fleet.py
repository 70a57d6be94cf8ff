"""Fleet spend, fuel-card checks, savings, trips and routes, each over a whole table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fuelspark.functions.geo import haversine_km
from fuelspark.functions.numeric import cents, js_round, mean_price


def card_abuse(transactions: DataFrame, prices: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Transactions charged well above the reference price of the station and fuel (regular if unknown)."""
    tx = transactions.withColumn("fuel", F.coalesce("fuel", F.lit("regular")))
    reference = prices.select(F.col("id").alias("station_id"), "fuel", F.col("price").alias("reference_price"))
    delta = (cents(F.col("charged_price")) - cents(F.col("reference_price"))) / 100.0
    flagged = tx.join(reference, ["station_id", "fuel"]).withColumn("delta", delta).filter(F.col("delta") > threshold)
    risk = F.least(F.lit(1.0), F.col("delta") / (threshold * 3))
    return flagged.select(
        *transactions.columns, "reference_price", "delta", js_round(risk, 2).alias("risk_score"),
        F.when(risk > 0.66, "high").when(risk > 0.33, "medium").otherwise("low").alias("severity"),
        js_round(F.col("delta") * F.coalesce("liters", F.lit(0.0)), 2).alias("total_overcharge"),
    )


def fleet_spend(transactions: DataFrame) -> DataFrame:
    """Money, litres and fills by vehicle, by station and in total.

    Rows are first added up per vehicle and station, so the grouping sets expand the sums and not the
    transactions, and a station that takes a third of all fills is already compact.
    """
    liters = F.coalesce("liters", F.lit(0.0))
    micros = F.floor(cents(F.coalesce("charged_price", F.lit(0.0))) * liters * 10000 + 0.5)
    base = transactions.groupBy("vehicle_id", "station_id").agg(
        F.sum(micros).alias("c"), F.sum(liters).alias("l"), F.count(F.lit(1)).alias("n")
    )
    vehicle, station = F.col("vehicle_id"), F.col("station_id")
    level = F.when(F.grouping("vehicle_id") == 0, "vehicle").when(F.grouping("station_id") == 0, "station").otherwise("total")
    sums = base.groupingSets([[vehicle], [station], []], vehicle, station).agg(
        level.alias("level"), F.sum("c").alias("c"), F.sum("l").alias("liters"), F.sum("n").alias("tx_count")
    )
    return sums.select(
        "level", "vehicle_id", "station_id", (F.col("c") / 1_000_000.0).alias("pesos"), "liters", "tx_count",
        F.when(F.col("liters") > 0, js_round(F.col("c") / F.col("liters") / 1_000_000.0, 2)).alias("price_per_liter"),
    )


def fill_savings(priced: DataFrame, tank_liters: float = 40.0, rate: float = 17.5, fills_per_month: float = 4.0) -> DataFrame:
    """Saving of one fill against the mean of the fuel, in pesos, dollars and percent, with projections."""
    means = F.broadcast(priced.groupBy("fuel").agg(
        mean_price(F.sum(cents(F.col("price"))), F.count("price")).alias("avg_price")
    ))  # one row per fuel
    gap = (cents(F.col("avg_price")) - cents(F.col("price"))) / 100.0
    rows = priced.select("id", "fuel", "price").join(means, "fuel").withColumn("saved_pesos", js_round(gap * tank_liters, 2))
    rows = rows.withColumn("saved_usd", js_round(F.col("saved_pesos") / rate, 2))
    rows = rows.withColumn("percent_saved", F.when(F.col("avg_price") > 0, js_round(gap / F.col("avg_price") * 100, 1)).otherwise(0.0))
    rows = rows.withColumn("monthly_pesos", js_round(F.col("saved_pesos") * fills_per_month, 2))
    rows = rows.withColumn("monthly_usd", js_round(F.col("saved_usd") * fills_per_month, 2))
    return rows.withColumn("annual_pesos", js_round(F.col("monthly_pesos") * 12, 2)).withColumn(
        "annual_usd", js_round(F.col("monthly_usd") * 12, 2)
    )


def tank_saving(price: Column, avg: Column, tank_liters: float = 50.0) -> Column:
    """Saving of a full tank when it is above half a peso."""
    saving = (avg - price) * tank_liters
    return F.when(saving > 0.5, saving)


def rank_options(options: DataFrame, default_consumption: float = 10.0) -> DataFrame:
    """Total fuel cost of each option of a trip and its saving against the dearest one.

    ``options`` has trip_id, option_id, distance_km, fuel_price and consumption (nullable).
    """
    use = F.coalesce("consumption", F.lit(default_consumption))
    rows = options.withColumn("liters", js_round(F.col("distance_km") * use / 100, 2))
    rows = rows.withColumn("total_cost", js_round(F.col("liters") * F.col("fuel_price"), 2))
    worst = rows.groupBy("trip_id").agg(F.max("total_cost").alias("worst"))
    return rows.join(worst, "trip_id").select(
        "trip_id", "option_id", "distance_km", "fuel_price", "liters", "total_cost",
        js_round(F.col("worst") - F.col("total_cost"), 2).alias("savings_vs_worst"),
    )


def fleet_monthly(vehicles: DataFrame) -> DataFrame:
    """Cost and litres per fleet for a day, 30 days and a year.

    ``vehicles`` has fleet_id, km_per_day, consumption and price, one row per vehicle; litres and cost are
    summed in units of 0.0001 so that the result does not depend on the order of addition.
    """
    liters = F.col("km_per_day") * F.col("consumption") / 100
    unit = lambda col: F.floor(col * 10000 + 0.5)
    sums = vehicles.groupBy("fleet_id").agg(
        F.count(F.lit(1)).alias("vehicles"), (F.sum(unit(liters)) / 10000.0).alias("_l"),
        (F.sum(unit(liters * F.col("price"))) / 10000.0).alias("_c"),
    )
    monthly = js_round(F.col("_c") * 30, 2)
    return sums.select(
        "fleet_id", "vehicles", js_round(F.col("_c"), 2).alias("daily_cost"), monthly.alias("monthly_cost"),
        js_round(monthly * 12, 2).alias("annual_cost"), js_round(F.col("_l") * 30, 2).alias("liters_per_month"),
    )


def trip_fill(trips: DataFrame, priced: DataFrame) -> DataFrame:
    """Litres to fill before a trip and their cost at the lowest and the mean price of the fuel.

    ``trips`` has trip_id, fuel, distance_km, km_per_liter, tank_liters and level_pct.
    """
    means = F.broadcast(priced.groupBy("fuel").agg(
        F.min("price").alias("lowest"), (F.sum(cents(F.col("price"))) / F.count("price") / 100.0).alias("mean")
    ))  # one row per fuel
    needed = F.col("distance_km") / F.col("km_per_liter")
    on_board = F.col("tank_liters") * (F.col("level_pct") / 100.0)
    rows = trips.join(means, "fuel", "left").withColumn("_fill", F.greatest(F.lit(0.0), needed - on_board))
    fill = F.col("_fill")
    return rows.select(
        "trip_id", js_round(needed, 1).alias("needed_liters"), js_round(fill, 1).alias("fill_liters"),
        js_round(on_board * F.col("km_per_liter"), 0).alias("range_km"),
        F.when(fill > 0, js_round(fill * F.col("lowest"), 2)).alias("cost_lowest"),
        F.when(fill > 0, js_round(fill * F.col("mean"), 2)).alias("cost_mean"),
        (fill <= 0).alias("enough"),
    )


def route_length(route_points: DataFrame) -> DataFrame:
    """Length of each route: distances between consecutive points, added in whole millimetres."""
    back = W.partitionBy("route_id").orderBy("seq")
    leg = haversine_km(F.lag("lat").over(back), F.lag("lng").over(back), F.col("lat"), F.col("lng"))
    legs = route_points.withColumn("_mm", F.floor(leg * 1_000_000 + 0.5))
    return legs.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("points"), js_round(F.coalesce(F.sum("_mm"), F.lit(0)) / 1_000_000.0, 3).alias("length_km")
    )


def _folded(corridor_rows: DataFrame) -> bool:
    return "routes" in corridor_rows.columns


def route_summary(corridor_rows: DataFrame, tank_liters: float = 50.0) -> DataFrame:
    """Stations along the route, lowest and mean price, and the saving on a tank when there are two or more.

    Of a folded corridor the figures of its places are added up; no pair of route and station is formed."""
    if _folded(corridor_rows):
        parts = corridor_rows.groupBy("routes").agg(F.sum("count").alias("count"), F.min("lowest").alias("lowest"), F.sum("total").alias("total"))
        rows = parts.select(F.explode("routes").alias("_r"), "count", "lowest", "total").select("_r.route_id", "count", "lowest", "total")
        n, lowest, total = F.sum("count"), F.min("lowest"), F.sum("total")
    else:
        rows, n, lowest, total = corridor_rows, F.count("price"), F.min("price"), F.sum(cents(F.col("price")))
    mean = total / n / 100.0
    return rows.groupBy("route_id").agg(
        n.alias("stations"), lowest.alias("lowest_price"), js_round(mean, 2).alias("mean_price"),
        F.when(n >= 2, js_round((mean - lowest) * tank_liters, 2)).otherwise(0.0).alias("estimated_savings"),
    )


def route_top(corridor_rows: DataFrame, n: int = 5) -> DataFrame:
    """The n cheapest stations of each route; of a folded corridor, those of each place and each list of routes come first."""
    def first(rows: DataFrame, by: str) -> DataFrame:
        order = W.partitionBy(by).orderBy("price", "id")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)

    if _folded(corridor_rows):
        few = corridor_rows.select("routes", F.explode(F.slice("stations", 1, n)).alias("_s"), "snap_km")
        few = first(few.select("routes", "_s.id", "_s.price", "snap_km"), "routes").drop("rank")
        corridor_rows = few.select(F.explode("routes").alias("_r"), "id", "price", "snap_km").select("_r.route_id", "id", "price", "snap_km")
    return first(corridor_rows, "route_id")


def route_trip_cost(corridor_rows: DataFrame, lengths: DataFrame, km_per_liter: float = 12.0, n: int = 3) -> DataFrame:
    """Cost of driving the whole route on the fuel of each of its cheapest stations."""
    top = route_top(corridor_rows, n).join(lengths, "route_id")
    needed = F.col("length_km") / km_per_liter
    return top.select(
        "route_id", "rank", "id", "price", js_round(needed, 2).alias("needed_liters"),
        js_round(needed * F.col("price"), 2).alias("trip_cost"),
    )


def weekly_digest(snapshots: DataFrame, stations: DataFrame) -> DataFrame:
    """National averages per week and fuel, change to the week before, cheapest city and coverage."""
    week = F.date_trunc("WEEK", F.col("date").cast("timestamp_ntz")).cast("date")
    rows = snapshots.withColumn("week", week)
    c = cents(F.col("price"))
    national = rows.groupBy("week", "fuel").agg(mean_price(F.sum(c), F.count("price")).alias("avg"))
    previous = F.lag("avg").over(W.partitionBy("fuel").orderBy("week"))  # one row per week and fuel
    national = national.withColumn("previous_avg", previous)
    placed = rows.join(stations.select("id", "city"), "id")
    cities = placed.groupBy("week", "fuel", "city").agg(mean_price(F.sum(c), F.count("price")).alias("city_avg"))
    best = cities.groupBy("week", "fuel").agg(F.min(F.struct("city_avg", "city")).alias("b"))
    seen = rows.groupBy("week").agg(F.countDistinct("id").alias("stations_with_data"))
    change = (cents(F.col("avg")) - cents(F.col("previous_avg"))) / 100.0
    return national.join(best, ["week", "fuel"], "left").join(seen, "week").select(
        F.col("week").cast("string").alias("week"), "fuel", "avg", change.alias("change"),
        F.when(change > 0, "▲").when(change < 0, "▼").when(change.isNotNull(), "=").alias("arrow"),
        F.col("b.city").alias("cheapest_city"), F.col("b.city_avg").alias("cheapest_city_avg"), "stations_with_data",
    )
