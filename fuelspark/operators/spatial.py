"""Neighbourhoods: range joins on grid cells, and what the analytics derive from them.

Each row of one side sits in one cell, each row of the other side is repeated in the nine cells around it,
and cells are at least as large as the radius, so one equi-join finds every pair exactly once. Where only
an aggregate or a top-k of the neighbours is wanted, the neighbour side is first reduced to what one
coordinate can contribute, so a crowd of records at one place costs a handful of rows.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fuelspark.functions.geo import EARTH_KM, cell_degrees, geohash, haversine_km, manhattan_km
from fuelspark.functions.lookups import BOUNDS
from fuelspark.functions.numeric import cents, js_round, mean_price
from fuelspark.operators.scale import HOT_PAIRS, HOT_ROWS, in_parts, salted_pairs


def within_radius(
    left: DataFrame, right: DataFrame, radius_km: float, rounded: bool = True, keys: tuple[str, ...] = (),
    strict: bool = False, max_abs_lat: float = BOUNDS[1], hot_rows: int = HOT_ROWS, hot_pairs: int = HOT_PAIRS,
    weights: tuple[str, str] | None = None,
) -> DataFrame:
    """All pairs within the radius with their distance ``km``.

    Both sides carry ``lat`` and ``lng``; the right ones come back as ``lat_b`` and ``lng_b``. ``rounded``
    compares the distance after rounding to 2 decimals. ``keys`` are further columns both sides must share, ``weights`` a
    column of each side with the records its rows stand for.
    """
    height, width = cell_degrees(radius_km, max_abs_lat)
    cy, cx = F.floor(F.col("lat") / height), F.floor(F.col("lng") / width)
    # the box is read from the cell width, wide enough for both ends of the pair
    near = left.filter("lat is not null and lng is not null").withColumn("_cy", cy).withColumn("_cx", cx)
    offsets = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
    far = (
        right.filter("lat is not null and lng is not null")
        .withColumn("_o", F.explode(offsets))
        .withColumn("_cy", cy + F.col("_o.y")).withColumn("_cx", cx + F.col("_o.x"))
        .drop("_o").withColumnsRenamed({"lat": "lat_b", "lng": "lng_b"})
    )
    spread = "_spread"
    near = near.withColumn(spread, F.xxhash64(*[c for c in left.columns]))
    pairs = salted_pairs(near, far, ["_cy", "_cx", *keys], spread, hot_rows, hot_pairs, weights).drop("_cy", "_cx", spread)
    box = (F.abs(F.col("lat") - F.col("lat_b")) <= height) & (F.abs(F.col("lng") - F.col("lng_b")) <= width)
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("lat_b"), F.col("lng_b"))
    pairs = pairs.filter(box).withColumn("km", js_round(km, 2) if rounded else km)
    return pairs.filter(F.col("km") < radius_km if strict else F.col("km") <= radius_km)


def _as_b(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(name) for c, name in columns.items()], "lat", "lng")


def distance_matrix(stations: DataFrame, radius_km: float, self_pairs: bool = True, rounded: bool = True,
                    km_per_degree: float = 111.32) -> DataFrame:
    """Directed pairs of stations within the radius with great-circle and city-block distance."""
    block = manhattan_km(F.col("lat"), F.col("lng"), F.col("lat_b"), F.col("lng_b"), km_per_degree)
    digits = 2 if rounded else 4
    measures = {"haversine_km": js_round(F.col("km"), digits), "manhattan_km": js_round(block, digits)}
    pairs = _station_pairs(stations, stations, radius_km, measures, rounded)
    if not self_pairs:
        pairs = pairs.filter("id_a <> id_b")
    return pairs


def _at_places(stations: DataFrame, name: str, most: int = 1000) -> DataFrame:
    """Coordinates with the ids of their stations as a list; a crowded one has several rows of about ``most`` ids."""
    dealt = in_parts(stations.select("id", "lat", "lng"), ["lat", "lng"], "id", most)
    ids = F.collect_list(F.struct("id"))  # a struct, as a list of bare values leaves out nulls
    return dealt.groupBy("lat", "lng", "_part").agg(ids.alias(name)).drop("_part")


def _station_pairs(left: DataFrame, right: DataFrame, radius_km: float, measures: dict, rounded: bool = True) -> DataFrame:
    """Pairs of ids within the radius. Distances are taken once per pair of coordinates, then each side's ids unfold
    in place, so no pair of stations is shuffled; tasks are dealt by pairs of stations."""
    a, b = (_at_places(df, f"_ids_{s}").withColumn(f"_w{s}", F.size(f"_ids_{s}")) for df, s in ((left, "a"), (right, "b")))
    near = within_radius(a, b, radius_km, rounded=rounded, weights=("_wa", "_wb"))
    near = near.select("_ids_a", "_ids_b", *[c.alias(n) for n, c in measures.items()])
    pairs = near.select(F.explode("_ids_a").alias("_a"), "_ids_b", *measures).select("_a", F.explode("_ids_b").alias("_b"), *measures)
    return pairs.select(F.col("_a.id").alias("id_a"), F.col("_b.id").alias("id_b"), *measures)


def matrix_summary(stations: DataFrame, radii: tuple[int, ...] = (5, 20, 50)) -> DataFrame:
    """Station count, pairs per radius and coordinate coverage.

    Pairs are counted between distinct coordinates with their multiplicities; none is written out.
    """
    places = stations.filter("lat is not null and lng is not null").groupBy("lat", "lng").agg(
        F.count(F.lit(1)).alias("n")
    )
    pairs = within_radius(places, places.withColumnRenamed("n", "n_b"), max(radii))
    product = F.col("n") * F.col("n_b")
    counts = pairs.agg(*[
        F.coalesce(F.sum(F.when(F.col("km") <= r, product)), F.lit(0)).alias(f"pairs_{r}km") for r in radii
    ])
    located = F.count_if((F.col("lat") != 0) & (F.col("lng") != 0))
    totals = stations.agg(
        F.count(F.lit(1)).alias("station_count"),
        js_round(located / F.count(F.lit(1)) * 100).alias("coverage_pct"),
    )
    return counts.select(*[totals.select(c).scalar().alias(c) for c in totals.columns], *counts.columns)


def neighbours(stations: DataFrame, radius_km: float = 10.0, wanted: DataFrame | None = None) -> DataFrame:
    """Neighbours of the wanted stations (all by default), without the station itself."""
    left = stations if wanted is None else stations.join(wanted.select("id").distinct(), "id", "left_semi")
    block = manhattan_km(F.col("lat"), F.col("lng"), F.col("lat_b"), F.col("lng_b"))
    pairs = _station_pairs(left, stations, radius_km, {"distance_km": F.col("km"), "manhattan_km": js_round(block, 2)})
    return pairs.filter("id_a <> id_b").withColumnsRenamed({"id_a": "id", "id_b": "neighbour_id"})


def around_points(points: DataFrame, stations: DataFrame, radius_km: float) -> DataFrame:
    """Stations within the radius of each point (point_id, lat, lng)."""
    pairs = within_radius(points.select("point_id", "lat", "lng"), _as_b(stations, {"id": "id"}), radius_km)
    block = manhattan_km(F.col("lat"), F.col("lng"), F.col("lat_b"), F.col("lng_b"))
    return pairs.select("point_id", "id", F.col("km").alias("distance_km"), js_round(block, 2).alias("manhattan_km"))


def corridor(route_points: DataFrame, priced: DataFrame, snap_km: float = 5.0, step: int = 8,
             strict: bool = False, folded: bool = False) -> DataFrame:
    """Priced stations (id, lat, lng, price) near every ``step``-th point of a route, with the least distance.

    A route stands once in each cell around its points, with those of them that can reach into the cell, and a place in
    one cell, so each route meets a place once and no pair is shuffled. Routes with the same points there share the
    distances. ``folded`` leaves it at that: a list of ``routes``, a list of the ``stations`` of a place by price and id,
    their count, lowest price and total in cents, and the distance ``snap_km``; every pair of the lists is a row of the corridor.
    """
    height, width = cell_degrees(snap_km)
    cell, steps = ["_cy", "_cx"], F.sequence(F.lit(-1), F.lit(1))
    at = {"_cy": F.floor(F.col("lat") / height), "_cx": F.floor(F.col("lng") / width)}
    located = "lat is not null and lng is not null"
    sampled = route_points.filter(F.col("seq") % step == 0).filter(located).select("route_id", "lat", "lng", *[c.alias(n) for n, c in at.items()])
    around = sampled.withColumn("_y", F.explode(steps)).withColumn("_x", F.explode(steps))
    around = around.withColumns({"_cy": F.col("_cy") + F.col("_y"), "_cx": F.col("_cx") + F.col("_x")})
    points = around.groupBy("route_id", *cell).agg(F.sort_array(F.collect_set(F.struct("lat", "lng"))).alias("_points"))
    same = [*cell, "_points"]
    routes = in_parts(points, same, "route_id", 200).groupBy(*same, "_part").agg(F.collect_list(F.struct("route_id")).alias("routes"))
    dealt = in_parts(priced.filter(located).select("id", "price", "lat", "lng"), ["lat", "lng"], "id")
    places = dealt.groupBy("lat", "lng", "_part").agg(
        F.sort_array(F.collect_list(F.struct("price", "id"))).alias("stations"), F.count("price").alias("count"),
        F.min("price").alias("lowest"), F.sum(cents(F.col("price"))).alias("total"),
    ).withColumns(at)
    routes = routes.withColumns({"_wa": F.size("routes"), "_spread": F.xxhash64("routes")}).drop("_part")
    met = salted_pairs(routes, places.withColumn("_wb", F.size("stations")).drop("_part"), cell, "_spread", HOT_ROWS, HOT_PAIRS, ("_wa", "_wb"))
    km = F.array_min(F.transform("_points", lambda p: haversine_km(p["lat"], p["lng"], F.col("lat"), F.col("lng"))))
    met = met.withColumn("km", km).filter(F.col("km") < snap_km if strict else F.col("km") <= snap_km)
    near = met.select("routes", "stations", "count", "lowest", "total", js_round(F.col("km"), 4).alias("snap_km"))
    if folded:
        return near
    unfolded = near.select(F.explode("routes").alias("_r"), "stations", "snap_km").select("_r", F.explode("stations").alias("_s"), "snap_km")
    return unfolded.select("_r.route_id", "_s.id", "_s.price", "snap_km")


def _first(df: DataFrame, by: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group; the limit is applied on the map side before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)


_PARTS = 16  # cells of a cheapest search per radius: small enough that many lie wholly within it


def _cell_gap(height: float, width: float) -> tuple[Column, Column]:
    """Least and greatest distance in km between points of cell (_qy, _qx) and points of cell (_qy + _oy, _qx + _ox).

    Both grow with the difference in latitude, in longitude and with the cosines, so they follow from the extremes of each.
    """
    def km(dy: Column, dx: Column, cos_q: Column, cos_d: Column) -> Column:
        y, x = (F.pow(F.sin(F.radians(d) / 2), 2) for d in (dy * height, dx * width))
        return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(y + cos_q * cos_d * x)))

    def cosines(row: Column) -> tuple[Column, Column]:
        ends = [F.cos(F.radians(row * height)), F.cos(F.radians((row + 1) * height))]
        # a cell row that holds the equator ends on it, as rows are counted from there
        return F.least(*ends), F.greatest(*ends)

    q, d, dy, dx = cosines(F.col("_qy")), cosines(F.col("_qy") + F.col("_oy")), F.abs("_oy"), F.abs("_ox")
    zero = F.lit(0)
    least = km(F.greatest(dy - 1, zero), F.greatest(dx - 1, zero), q[0], d[0])
    return least, km(dy + 1, dx + 1, q[1], d[1])


def _cells_around(cells: DataFrame, reach: int) -> DataFrame:
    """Every cell with those up to ``reach`` rows and columns away, as _oy and _ox."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return cells.withColumn("_oy", F.explode(steps)).withColumn("_ox", F.explode(steps)).withColumns(
        {"_dy": F.col("_qy") + F.col("_oy"), "_dx": F.col("_qx") + F.col("_ox")})


def cheapest_within(points: DataFrame, offers: DataFrame, radius_km: float, n: int, keys: tuple[str, ...] = (),
                    degrees: float | None = None) -> DataFrame:
    """Pairs of points and offers (id, price) within the radius, with all offers that can be among the n cheapest of a point.

    The n cheapest offers of the cells that lie wholly within the radius of every point of a cell bound what any of its
    points can want: whatever costs more than the last of them is left out before points meet offers. Ties at that
    price stay. With ``degrees`` the radius is a straight line in degrees, shorter than ``radius_km``.
    """
    height, width = (x / _PARTS for x in cell_degrees(radius_km))
    cell = lambda y, x: {y: F.floor(F.col("lat") / height), x: F.floor(F.col("lng") / width)}
    placed = points.filter("lat is not null and lng is not null").withColumns(cell("_qy", "_qx"))
    offered = offers.filter("lat is not null and lng is not null").withColumns(cell("_dy", "_dx"))
    # cells are few bytes before they are repeated, so dealt over all tasks; their repetition is what the optimizer does not see
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = placed.select("_qy", "_qx", *keys).distinct().repartition(parts, "_qy", "_qx", *keys)
    around = _cells_around(cells, _PARTS + 1)
    least, most = _cell_gap(height, width)
    if degrees is None:
        sure, open_ = most < radius_km - 0.01, least <= radius_km + 0.02
    else:
        far = F.sqrt(F.pow((F.abs("_oy") + 1) * height, 2) + F.pow((F.abs("_ox") + 1) * width, 2))
        near = F.sqrt(F.pow(F.greatest(F.abs("_oy") - 1, F.lit(0)) * height, 2) + F.pow(F.greatest(F.abs("_ox") - 1, F.lit(0)) * width, 2))
        sure, open_ = far < degrees * 0.9999, near < degrees * 1.0001
    on = ["_dy", "_dx", *keys]
    here = _first(offered, on, ["price", "id"], n).select(*on, "price", "id")
    query = ["_qy", "_qx", *keys]
    sure_cells = around.filter(sure).drop("_oy", "_ox")
    wanted = _first(sure_cells.join(here.hint("shuffle_hash"), on), query, ["price", "id"], n)
    bound = wanted.filter(F.col("rank") == n).select(*query, F.col("price").alias("_most"))
    bounded = cells.join(bound.hint("merge"), query, "left")
    open_cells = _cells_around(bounded, _PARTS + 1).filter(open_).drop("_oy", "_ox")
    few = open_cells.join(offered.hint("merge"), on).filter("_most is null or price is null or price <= _most").drop("_most", "_dy", "_dx")
    few = few.withColumnsRenamed({"lat": "lat_b", "lng": "lng_b"})
    pairs = salted_pairs(placed.withColumn("_spread", F.xxhash64(*points.columns)), few, ["_qy", "_qx", *keys], "_spread", HOT_ROWS, HOT_PAIRS)
    pairs = pairs.drop("_qy", "_qx", "_spread")
    km = js_round(haversine_km(F.col("lat"), F.col("lng"), F.col("lat_b"), F.col("lng_b")), 2)
    return pairs.withColumn("km", km).filter(F.col("km") <= radius_km)


def nearest_within(points: DataFrame, offers: DataFrame, radius_km: float, n: int, finest_km: float = 0.1) -> DataFrame:
    """Pairs of points and offers within the radius, with all offers that can be among the n nearest of a point.

    Cells halve from a sixteenth of the radius down. A point searches by the finest cells of which its own holds n offers:
    these lie within the cell's diagonal, so none of the n nearest is more than two cells away. Points in thin country look at
    the cells of the first size: the nearest ones that together hold n offers bound how far theirs can be.
    """
    coarse = 16
    levels = max(0, min(3, math.floor(math.log2(radius_km / coarse / finest_km)) if radius_km > coarse * finest_km else 0))
    height, width = (x / coarse for x in cell_degrees(radius_km))
    fine = lambda y, x: {y: F.floor(F.col("lat") / (height / 2**levels)), x: F.floor(F.col("lng") / (width / 2**levels))}
    placed = points.filter("lat is not null and lng is not null").withColumns(fine("_fy", "_fx"))
    offered = offers.filter("lat is not null and lng is not null").withColumns(fine("_fy", "_fx"))
    up = {"_dy": F.expr("shiftright(_fy, _level)"), "_dx": F.expr("shiftright(_fx, _level)")}
    every = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    on, here = ["_level", "_dy", "_dx"], ["_qy", "_qx"]
    leveled = offered.withColumn("_level", every).withColumns(up).drop("_fy", "_fx")
    counts = leveled.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    cells = placed.select("_fy", "_fx").distinct().withColumn("_level", every).withColumns(up)
    fit = cells.join(counts.filter(F.col("_n") >= n).drop("_n"), on, "left_semi").groupBy("_fy", "_fx").agg(F.min("_level").alias("_level"))
    # a level too many marks thin country, on the cells of the first size
    level = F.coalesce(F.col("_level"), F.lit(levels + 1))
    at = placed.join(fit, ["_fy", "_fx"], "left").withColumns({
        "_level": level, **{d: F.expr(f"shiftright({f}, least(coalesce(_level, {levels}), {levels}))") for d, f in (("_qy", "_fy"), ("_qx", "_fx"))}}).drop("_fy", "_fx")
    searched = at.select("_level", *here).distinct()
    crowd = _cells_around(searched.filter(F.col("_level") <= levels), 2).join(leveled, on).drop("_oy", "_ox", "_dy", "_dx")
    first = leveled.filter(F.col("_level") == levels).drop("_level")
    least, most = _cell_gap(height, width)
    around = _cells_around(searched.filter(F.col("_level") > levels), coarse + 1).withColumns({"_least": least, "_most": most}).drop("_oy", "_ox")
    around = around.filter(F.col("_least") <= radius_km + 0.02).join(counts.filter(F.col("_level") == levels).drop("_level"), ["_dy", "_dx"])
    held = F.sum("_n").over(W.partitionBy(*here).orderBy("_most"))
    enough = F.min(F.when(F.col("_held") >= n, F.col("_most"))).over(W.partitionBy(*here))
    open_cells = around.withColumn("_held", held).withColumn("_far", enough).filter("_far is null or _least <= _far + 0.02")
    thin = open_cells.select("_level", *here, "_dy", "_dx").join(first, ["_dy", "_dx"]).drop("_dy", "_dx")
    few = crowd.unionByName(thin).withColumnsRenamed({"lat": "lat_b", "lng": "lng_b"})
    by = ["_level", *here]
    pairs = salted_pairs(at.withColumn("_spread", F.xxhash64(*points.columns)), few, by, "_spread", HOT_ROWS, HOT_PAIRS).drop(*by, "_spread")
    km = js_round(haversine_km(F.col("lat"), F.col("lng"), F.col("lat_b"), F.col("lng_b")), 2)
    return pairs.withColumn("km", km).filter(F.col("km") <= radius_km)


def fuel_stops(waypoints: DataFrame, priced: DataFrame, radius_km: float = 10.0, n: int = 5) -> DataFrame:
    """Cheapest stations within the radius of each waypoint; rank 1 is the cheapest."""
    best_here = _first(priced, ["lat", "lng"], ["price", "id"], n).drop("rank")
    near = cheapest_within(waypoints, best_here, radius_km, n)
    top = _first(near, ["route_id", "seq"], ["price", "id"], n)
    return top.select("route_id", "seq", "rank", "id", "price", F.col("km").alias("distance_km"))


def cheaper_alternatives(priced: DataFrame, degrees: float = 0.028, n: int = 3) -> DataFrame:
    """For each priced station the cheapest others that cost less, are not anomalous and lie within a
    straight-line distance in degrees. ``priced`` has id, fuel, price, lat, lng, is_anomaly.

    The best n of the area are found once per coordinate and fuel: whatever is cheaper than a station
    there is a prefix of them.
    """
    usable = priced.filter("not is_anomaly")
    best_here = _first(usable, ["lat", "lng", "fuel"], ["price", "id"], n).select("id", "price", "fuel", "lat", "lng")
    places = priced.select("lat", "lng", "fuel").distinct()
    gap = F.sqrt(F.pow(F.col("lat") - F.col("lat_b"), 2) + F.pow(F.col("lng") - F.col("lng_b"), 2))
    reach_km = degrees * 111.2  # a degree is never longer than this on the sphere used here
    near = cheapest_within(places, best_here, reach_km, n, ("fuel",), degrees).filter(gap < degrees)
    near = near.withColumnsRenamed({"id": "alt_id", "price": "alt_price"})
    area = _first(near, ["lat", "lng", "fuel"], ["alt_price", "alt_id"], n)
    area = area.groupBy("lat", "lng", "fuel").agg(F.collect_list(F.struct("rank", "alt_id", "alt_price")).alias("_best"))
    found = priced.join(area.hint("merge"), ["lat", "lng", "fuel"]).select("id", "fuel", "price", F.explode("_best").alias("b"))
    return found.filter("b.alt_price < price").select("id", "fuel", "price", "b.rank", "b.alt_id", "b.alt_price")


def nearest_cheapest(points: DataFrame, priced: DataFrame, radius_km: float = 5.0) -> DataFrame:
    """Cheapest station that is not anomalous within the radius of each point."""
    best_here = _first(priced.filter("not is_anomaly"), ["lat", "lng"], ["price", "id"], 1).select("id", "price", "lat", "lng")
    near = cheapest_within(points, best_here, radius_km, 1)
    return near.groupBy("point_id").agg(
        F.min(F.struct("price", "id", F.col("km").alias("distance_km"))).alias("b")
    ).select("point_id", "b.id", "b.price", "b.distance_km")


def nearby_rankings(points: DataFrame, stations: DataFrame, radius_km: float = 10.0, n: int = 5) -> DataFrame:
    """The n nearest and the n cheapest stations within the radius of each point.

    ``stations`` has id, lat, lng and a price that may be null.
    """
    def ranked(rows: DataFrame, here: list, there: list, kind: str, search) -> DataFrame:
        best_here = _first(rows, ["lat", "lng"], here, n).drop("rank")
        top = _first(search(points, best_here, radius_km, n), ["point_id"], there, n)
        return top.select("point_id", F.lit(kind).alias("ranking"), "rank", "id", "price", F.col("km").alias("distance_km"))

    nearest = ranked(stations, ["id"], ["km", "id"], "nearest", nearest_within)
    cheapest = ranked(stations.filter("price is not null"), ["price", "id"], ["price", "km", "id"], "cheapest", cheapest_within)
    return nearest.unionByName(cheapest)


def station_cards(stations: DataFrame, radius_km: float = 5.0, n: int = 5) -> DataFrame:
    """Cheapest and dearest of the n nearest neighbours of each station, and its price against the mean.

    ``stations`` has id, lat, lng, price (nullable). One more than n is kept per coordinate because the
    station itself is among the nearest and is then left out.
    """
    best_here = _first(stations, ["lat", "lng"], ["id"], n + 1).select(
        F.col("id").alias("id_b"), F.col("price").alias("price_b"), "lat", "lng"
    )
    places = stations.select("lat", "lng").distinct()
    area = _first(within_radius(places, best_here, radius_km), ["lat", "lng"], ["km", "id_b"], n + 1)
    area = area.groupBy("lat", "lng").agg(F.array_sort(F.collect_list(F.struct("rank", "id_b", "price_b"))).alias("_near"))
    others = F.slice(F.filter("_near", lambda x: x["id_b"] != F.col("id")), 1, n)
    priced = F.transform(F.filter("_others", lambda x: x["price_b"].isNotNull()), lambda x: F.struct(x["price_b"], x["id_b"]))
    falling = F.transform("_priced", lambda x: F.struct((-x["price_b"]).alias("k"), x["id_b"].alias("id_b")))
    mean = stations.agg(mean_price(F.sum(cents(F.col("price"))), F.count("price")).alias("national_avg")).scalar()
    cards = stations.join(area, ["lat", "lng"], "left").withColumn("_others", others).withColumn("_priced", priced)
    return cards.withColumn("national_avg", mean).select(
        "id", "price", F.coalesce(F.size("_others"), F.lit(0)).alias("nearby"),
        F.array_min("_priced")["id_b"].alias("cheapest_id"), F.array_min("_priced")["price_b"].alias("cheapest_price"),
        F.array_min(falling)["id_b"].alias("dearest_id"), (-F.array_min(falling)["k"]).alias("dearest_price"),
        "national_avg", js_round(F.col("price") - F.col("national_avg"), 2).alias("vs_national"),
    )


def cell_rollup(stations: DataFrame, precision: int) -> DataFrame:
    """Count, lowest price and most frequent brand per geohash cell.

    Brands are counted first, so a crowded cell is a few rows when its dominant brand is chosen.
    """
    cells = stations.withColumn("cell", geohash(F.col("lat"), F.col("lng"), precision)).filter("cell is not null")
    by_brand = cells.groupBy("cell", F.coalesce("brand", F.lit("OTRO")).alias("brand")).agg(
        F.count(F.lit(1)).alias("n"), F.min("price").alias("lowest")
    )
    top = F.min(F.struct((-F.col("n")).alias("k"), F.col("brand").alias("brand")))
    return by_brand.groupBy("cell").agg(
        F.sum("n").alias("station_count"), F.min("lowest").alias("min_price"), top["brand"].alias("top_brand")
    )


def price_grid(priced: DataFrame, precision: int = 6) -> DataFrame:
    """Average price and number of priced stations per geohash cell."""
    cells = priced.withColumn("cell", geohash(F.col("lat"), F.col("lng"), precision)).filter("cell is not null")
    return cells.groupBy("cell", "fuel").agg(
        mean_price(F.sum(cents(F.col("price"))), F.count("price")).alias("avg_price"), F.count("price").alias("n")
    )


def add_distances(stations: DataFrame, lat: float, lng: float) -> DataFrame:
    here = (F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    return stations.withColumn("distance_km", js_round(haversine_km(*here), 2)).withColumn(
        "manhattan_km", js_round(manhattan_km(*here), 2)
    )


def nearest_place(masters: DataFrame, places: DataFrame, radius_m: float = 50.0, below: float = 0.70) -> DataFrame:
    """Nearest place within a tight radius for masters of low confidence."""
    wanted = masters.filter(F.col("confidence_score") < below).select("master_id", "lat", "lng")
    here = places.groupBy("lat", "lng").agg(F.min("place_id").alias("place_id"))
    near = within_radius(wanted, here, radius_m / 1000.0, rounded=False, max_abs_lat=60.0)
    best = near.groupBy("master_id").agg(F.min(F.struct("km", "place_id")).alias("b"))
    return best.select("master_id", "b.place_id", js_round(F.col("b.km") * 1000, 1).alias("distance_m"))
