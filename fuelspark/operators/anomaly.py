"""Price anomalies: against the neighbourhood, and against the whole country."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuelspark.functions.geo import cell_degrees
from fuelspark.functions.histograms import STATISTICS, TILE_SCHEMA, statistics_of_others, tile_histograms
from fuelspark.functions.numeric import cents, js_round, mean_price, pop_std


TILE_PLACES, TILE_BINS = 500, 300_000  # of one task: places, and histogram bins around them


def _tiles(places: DataFrame, bins: DataFrame, radius_km: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Places in their cell and bins in the nine cells around theirs, both dealt over salts by what a cell holds: every
    place meets every bin that can be near in one tile."""
    height, width = cell_degrees(radius_km)
    cell, salts = ["_cy", "_cx"], ["_a", "_b"]
    steps = F.sequence(F.lit(-1), F.lit(1))
    at = {"_cy": F.floor(F.col("lat") / height), "_cx": F.floor(F.col("lng") / width)}
    here = places.withColumns(at)
    around = bins.withColumns(at).withColumn("_y", F.explode(steps)).withColumn("_x", F.explode(steps)).withColumns(
        {"_cy": F.col("_cy") + F.col("_y"), "_cx": F.col("_cx") + F.col("_x")}).drop("_y", "_x")
    parts = lambda df, most, n: df.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(n))
    sizes = parts(here, TILE_PLACES, "_na").join(parts(around, TILE_BINS, "_nb").hint("merge"), cell)
    own = lambda n: F.pmod(F.xxhash64("lat", "lng"), F.col(n).cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # bins around are nine times what the optimizer takes them for: as a broadcast they would fill the driver
    here = here.join(sizes.hint("merge"), cell).withColumn("_a", own("_na")).withColumn("_b", every("_nb"))
    around = around.join(sizes.hint("merge"), cell).withColumn("_b", own("_nb")).withColumn("_a", every("_na"))
    count = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # under fresh names, as both sides come from the same bins
    here, around = (df.select(*[F.col(c).alias(c) for c in df.columns if c not in ("_na", "_nb")]).repartition(count, *cell, *salts) for df in (here, around))
    return here, around, [*cell, *salts]


def _local_statistics(priced: DataFrame, radius_km: float) -> DataFrame:
    """Neighbour statistics per coordinate, fuel and price.

    Distances are taken between coordinates only. Each coordinate carries the histogram of its own prices (fuel, price,
    count); those of the neighbouring coordinates are added up within tiles of bounded size, so what is shuffled is one
    histogram per coordinate, fuel and tile, never a pair. Every price at the coordinate is held against the sum of its
    tiles. A station does not count itself.
    """
    here = ["lat", "lng", "fuel"]
    located = priced.filter("lat is not null and lng is not null and price is not null")
    prices = located.groupBy(*here, "price").agg(F.count(F.lit(1)).alias("n")).withColumn("cents", cents(F.col("price")))
    bins = prices.groupBy(*here, "cents").agg(F.sum("n").alias("n"))
    places, around, tile = _tiles(bins.select("lat", "lng").distinct(), bins, radius_km)
    summed = places.groupBy(*tile).cogroup(around.groupBy(*tile)).applyInPandas(
        lambda a, b: tile_histograms(a, b, radius_km), TILE_SCHEMA)
    whole = summed.groupBy(*here).agg(F.collect_list(F.struct("cents", "n")).alias("_h"))
    own = prices.groupBy(*here).agg(F.collect_list(F.struct("price", "cents")).alias("_own"))
    stats = whole.join(own.hint("merge"), here).withColumn(
        "_s", statistics_of_others(F.flatten("_h.cents"), F.flatten("_h.n"), F.col("_own.cents")))
    each = stats.select(*here, F.explode(F.arrays_zip(F.col("_own.price").alias("price"), *[F.col(f"_s.{f}").alias(f) for f in STATISTICS])).alias("_r"))
    return each.select(
        *here, "_r.price", F.col("_r.n").alias("nearby_count"), F.col("_r.s").alias("_s"), F.col("_r.ss").alias("_ss"),
        F.col("_r.lo").alias("_lo"), F.col("_r.hi").alias("_hi"), F.array("_r.q1", "_r.q3").alias("_q"),
    ).filter("nearby_count >= 2")


def local_anomalies(priced: DataFrame, method: str = "both", threshold: float = 1.5, radius_km: float = 10.0) -> DataFrame:
    """Stations whose price stands out among the neighbours within the radius.

    ``priced`` has id, fuel, price, lat, lng and descriptive columns. Fuels with fewer than three priced
    stations are left out. With ``both`` the interquartile fence is asked only when the z-score is silent.
    """
    many = F.broadcast(priced.groupBy("fuel").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 3").select("fuel"))
    stats = _local_statistics(priced.join(many, "fuel", "left_semi"), radius_km)
    c, n = cents(F.col("price")), F.col("nearby_count")
    mean = F.col("_s") / n
    flat = F.col("_lo") == F.col("_hi")
    std = pop_std(F.col("_ss"), F.col("_s"), n)
    share = F.abs(c - mean) / mean
    sign = F.when(c > mean, 1.0).otherwise(-1.0)
    z = F.when(~flat, (c - mean) / std).when(c == F.col("_lo"), 0.0).when(share > 0.05, sign * (threshold + 1))
    iqr = F.col("_q")[1] - F.col("_q")[0]
    outside = (c < F.col("_q")[0] - 1.5 * iqr) | (c > F.col("_q")[1] + 1.5 * iqr)
    by_z = F.abs(F.coalesce(z, F.lit(0.0))) >= threshold
    if method == "zscore":
        fired, score = by_z, F.coalesce(z, F.lit(0.0))
    else:
        fired = outside if method == "iqr" else by_z | outside
        score = F.coalesce(z, sign * threshold)  # an equal-price neighbourhood left by 5 % or less
    found = stats.withColumn("_z", score).filter(fired).select(
        "lat", "lng", "fuel", "price", "nearby_count", mean_price(F.col("_s"), n).alias("local_avg"),
        js_round(F.col("_z"), 2).alias("z_score"),
        F.when(F.col("_z") > 0, "high").otherwise("low").alias("direction"),
        F.when(F.abs("_z") > 3, "severe").when(F.abs("_z") > 2, "moderate").otherwise("mild").alias("severity"),
    )
    return priced.join(found.hint("merge"), ["lat", "lng", "fuel", "price"])


def severity_rank() -> Column:
    return F.when(F.col("severity") == "severe", 0).when(F.col("severity") == "moderate", 1).otherwise(2)


def ordered(anomalies: DataFrame) -> DataFrame:
    return anomalies.orderBy(severity_rank(), F.abs("z_score").desc(), "id")


def summary(anomalies: DataFrame) -> DataFrame:
    """Totals and counts by direction, severity, city and brand.

    One scan: every anomaly yields its five labels, and equal labels combine on the map side.
    """
    labels = F.array(
        F.struct(F.lit("total").alias("measure"), F.lit("all").alias("name")),
        *[F.struct(F.lit(c).alias("measure"), F.col(c).alias("name")) for c in ("direction", "severity", "city", "brand")],
    )
    return anomalies.select(F.explode(labels).alias("l")).groupBy("l.measure", "l.name").agg(
        F.count(F.lit(1)).alias("count")
    )


def global_outliers(long: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Flag per station: any fuel more than three deviations from its mean, for fuels with over 10 prices."""
    c = cents(F.col("price"))
    fuels = long.groupBy("fuel").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(c).alias("_s"), F.sum((c * c).cast("double")).alias("_ss")
    )
    far = F.abs(c - F.col("_s") / F.col("_n")) > sigmas * pop_std(F.col("_ss"), F.col("_s"), F.col("_n"))
    marked = long.join(F.broadcast(fuels), "fuel")  # one row per fuel
    return marked.groupBy("id").agg(F.bool_or((F.col("_n") > 10) & far).alias("is_global_anomaly"))


def tag_stations(stations: DataFrame, anomalies: DataFrame) -> DataFrame:
    flags = anomalies.select("id").distinct().withColumn("is_local_anomaly", F.lit(True))
    return stations.join(flags.hint("merge"), "id", "left").fillna(False, ["is_local_anomaly"])
