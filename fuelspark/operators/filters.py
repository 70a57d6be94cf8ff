"""Station filters, text search and list views over merged stations.

Merged stations carry id, name, brand, address, city, state, zip_code, the three prices, has_data and,
where asked, distance_km and is_anomaly. Every predicate is a plain column condition.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TEXT_COLUMNS = ["name", "brand", "city", "state", "address"]


def matches_text(query: str, columns: list[str], exact_case: tuple[str, ...] = ("zip_code",)) -> Column:
    """Substring search, case-insensitive but for the listed columns; a missing field does not match."""
    q = query.lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    for c in exact_case:
        hit = hit | F.coalesce(F.contains(F.col(c), F.lit(q)), F.lit(False))
    return hit


def filter_stations(
    df: DataFrame, brands: list[str] = (), states: list[str] = (), cities: list[str] = (),
    max_distance_km: float | None = None, price_range: tuple[float, float] | None = None, fuel: str = "regular",
    anomalies_only: bool = False, missing_data_only: bool = False, text: str | None = None,
) -> DataFrame:
    if brands:
        df = df.filter(F.upper("brand").isin([b.upper() for b in brands]))
    if states:
        df = df.filter(F.col("state").isin(list(states)))
    if cities:
        df = df.filter(F.col("city").isin(list(cities)))
    if max_distance_km:
        df = df.filter(F.col("distance_km") <= max_distance_km)
    if price_range:
        df = df.filter(F.col("has_data") & F.col(fuel).between(*price_range))
    if anomalies_only:
        df = df.filter("is_anomaly")
    if missing_data_only:
        df = df.filter("not has_data")
    if text:
        df = df.filter(matches_text(text, TEXT_COLUMNS))
    return df


def filter_app(
    df: DataFrame, fuel: str = "regular", brands: list[str] = (), states: list[str] = (), price_min: float | None = None,
    price_max: float | None = None, max_distance_km: float | None = None, anomalies_only: bool = False,
    open_24h: bool = False, with_data_only: bool = False,
) -> DataFrame:
    """Filter of the second front end: exact brand, open-ended price bounds, the 24-hour amenity."""
    if brands:
        df = df.filter(F.col("brand").isin(list(brands)))
    if states:
        df = df.filter(F.col("state").isin(list(states)))
    if anomalies_only:
        df = df.filter("is_anomaly")
    if max_distance_km is not None:
        df = df.filter(F.col("distance_km") <= max_distance_km)
    if price_min is not None:
        df = df.filter(F.col(fuel) >= price_min)
    if price_max is not None:
        df = df.filter(F.col(fuel) <= price_max)
    if open_24h:
        df = df.filter("amenities.open24h")
    if with_data_only:
        df = df.filter("has_data")
    return df


def suggestions(df: DataFrame, text: str) -> DataFrame:
    """Up to 6 stations, 4 cities and 3 brands for a search text, ranked."""
    q = text.lower()
    found = df.filter(matches_text(text, ["name", "city", "address"]))
    stations = found.select(F.lit("station").alias("kind"), F.col("name").alias("label"), F.col("id").alias("_k"))
    stations = _top(stations, [F.col("_k")], 6)
    cities = df.filter(F.contains(F.lower("city"), F.lit(q))).groupBy(F.col("city").alias("label")).agg(F.min("id").alias("_k"))
    cities = _top(cities.select(F.lit("city").alias("kind"), "label", "_k"), [F.col("_k")], 4)
    brands = df.filter(F.contains(F.lower("brand"), F.lit(q))).groupBy(F.col("brand").alias("label")).agg(
        F.count(F.lit(1)).alias("_k")
    )
    brands = _top(brands.select(F.lit("brand").alias("kind"), "label", "_k"), [F.col("_k").desc(), F.col("label")], 3)
    return stations.unionByName(cities).unionByName(brands)


def _top(df: DataFrame, order: list, n: int) -> DataFrame:
    """First n rows with their rank: the limit comes first, so the numbering sees n rows only."""
    few = df.orderBy(*order).limit(n)
    rank = F.row_number().over(W.partitionBy("kind").orderBy(*order))
    return few.select("kind", rank.alias("rank"), "label")


def sort_page(df: DataFrame, field: str, descending: bool = False, page: int = 1, size: int = 50) -> DataFrame:
    """One page of the sorted list: missing values last ascending and first descending."""
    key = F.col(field).desc_nulls_first() if descending else F.col(field).asc_nulls_last()
    return df.orderBy(key, F.col("id")).offset((page - 1) * size).limit(size)


def favourites(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_semi")


def open_24h_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("amenities.open24h").alias("open_24h"))
