"""From raw source records to the staging table: one projection over all sources."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuelspark.functions import text
from fuelspark.functions.fuzzy import nearest_brand_udf
from fuelspark.functions.geo import (
    coordinate_precision, geohash, has_valid_point, haversine_km, valid_latitude, valid_longitude,
)
from fuelspark.functions.lookups import BRAND_ALIASES

RAW_FIELDS = ["raw_name", "raw_brand", "raw_address", "raw_municipality", "raw_state", "raw_zip"]
HASHED_FIELDS = sorted(["lat", "lng", *RAW_FIELDS])


def unify_sources(cre: DataFrame, osm: DataFrame, denue: DataFrame) -> DataFrame:
    """Three source schemas as one; identifiers are prefixed by source."""
    def null(name: str) -> Column:
        return F.lit(None).cast("string").alias(name)

    regulator = cre.select(
        F.concat(F.lit("cre_"), F.coalesce("place_id", "cre_id")).alias("id"), F.lit("cre").alias("source"),
        F.col("place_id").alias("cre_place_id"), "cre_id", null("osm_id"), null("denue_id"),
        F.coalesce("nombre", "razon_social").alias("raw_name"), F.col("marca").alias("raw_brand"),
        F.col("domicilio").alias("raw_address"), F.col("municipio").alias("raw_municipality"),
        F.col("estado").alias("raw_state"), F.col("cp").alias("raw_zip"),
        F.col("latitud").alias("lat"), F.col("longitud").alias("lng"),
    )
    open_map = osm.select(
        F.concat_ws("_", F.lit("osm"), "osm_type", "osm_id").alias("id"), F.lit("osm").alias("source"),
        null("cre_place_id"), null("cre_id"), "osm_id", null("denue_id"), F.col("name").alias("raw_name"),
        F.coalesce("brand", "operator").alias("raw_brand"), F.col("addr_street").alias("raw_address"),
        F.col("addr_city").alias("raw_municipality"), F.col("addr_state").alias("raw_state"),
        F.col("addr_postcode").alias("raw_zip"), "lat", "lng",
    )
    register = denue.select(
        F.concat(F.lit("denue_"), "denue_id").alias("id"), F.lit("denue").alias("source"),
        null("cre_place_id"), null("cre_id"), null("osm_id"), "denue_id",
        F.coalesce("nom_estab", "raz_social").alias("raw_name"), null("raw_brand"),
        full_address().alias("raw_address"), F.col("municipio").alias("raw_municipality"),
        F.col("entidad").alias("raw_state"), F.col("cod_postal").alias("raw_zip"),
        F.col("latitud").alias("lat"), F.col("longitud").alias("lng"),
    )
    return regulator.unionByName(open_map).unionByName(register)


def full_address() -> Column:
    """Street, number and settlement of the business register, joined by commas."""
    return F.concat_ws(
        ", ",
        F.when(F.col("nom_vial").isNotNull(), F.concat_ws(" ", "tipo_vial", "nom_vial")),
        F.when(F.col("numero_ext").isNotNull(), F.concat(F.lit("No. "), "numero_ext")),
        F.when(F.col("nomb_asent").isNotNull(), F.concat_ws(" ", "tipo_asent", "nomb_asent")),
    )


def _alias_contained(key: Column) -> Column:
    """Place of the first alias that contains the text or is contained in it, the shorter one of at least
    four characters; null when there is none."""
    hits = []
    for place, alias in enumerate(BRAND_ALIASES):
        inside = F.contains(key, F.lit(alias)) if len(alias) >= 4 else F.lit(False)
        around = F.contains(F.lit(alias), key) & (F.length(key) >= 4)
        hits.append(F.when(inside | around, F.lit(place)))
    return F.coalesce(*hits)


def canonical_brand(df: DataFrame, raw: str, out: str = "norm_brand", how: str | None = None) -> DataFrame:
    """Canonical brand: exact alias, contained alias, else the closest spelling.

    Each distinct spelling is resolved once and joined back as the optimizer likes; only spellings that no alias
    explains are compared in Python.
    """
    known = text.literal_map({a: b for a, b in BRAND_ALIASES.items() if b})
    by_place = F.array(*[F.lit(b).cast("string") for b in BRAND_ALIASES.values()])
    spelled = df.select(F.col(raw).alias("_raw")).filter("_raw is not null").distinct().withColumn("_key", text.brand_key(F.col("_raw")))
    spelled = spelled.withColumn("_exact", F.col("_key").isin(list(BRAND_ALIASES)))
    spelled = spelled.withColumn("_place", F.when(~F.col("_exact"), _alias_contained(F.col("_key"))))
    open_text = F.when(~F.col("_exact") & F.col("_place").isNull(), F.col("_key"))
    spelled = spelled.withColumn("_near", nearest_brand_udf(open_text))
    brand = (F.when(F.col("_exact"), known[F.col("_key")]).when(F.col("_place").isNotNull(), F.element_at(by_place, F.col("_place") + 1)).otherwise(F.col("_near")))
    score = F.when(F.col("_exact"), 1.0).when(F.col("_place").isNotNull(), 0.85).otherwise(0.70)
    spelled = spelled.select("_raw", brand.alias("_brand"), score.alias("_score"))
    joined = df.join(spelled, F.col(raw) == F.col("_raw"), "left").withColumn(out, F.col("_brand"))
    if how:
        joined = joined.withColumn(how, F.when(F.col("_brand").isNull(), 0.0).otherwise(F.col("_score")))
    return joined.drop("_raw", "_brand", "_score")


def content_hash() -> Column:
    """SHA-256 of the raw fields as JSON with sorted keys; nulls count."""
    return F.sha2(F.to_json(F.struct(*HASHED_FIELDS), {"ignoreNullFields": "false"}), 256)


def conform_stations(raw: DataFrame) -> DataFrame:
    """Normalised text, valid coordinates, grid keys and a content hash for every raw record."""
    df = raw.withColumns({"lat": valid_latitude(F.col("lat")), "lng": valid_longitude(F.col("lng"))})
    lat, lng = F.col("lat"), F.col("lng")
    df = canonical_brand(df, "raw_brand", "norm_brand", "brand_confidence")
    return df.withColumns({
        "norm_name": text.normalize_name(F.col("raw_name")),
        "norm_address": text.normalize_address(F.col("raw_address")),
        "norm_municipality": text.normalize_municipality(F.col("raw_municipality")),
        "norm_state": text.normalize_state(F.col("raw_state")),
        "norm_zip": text.normalize_zip(F.col("raw_zip")),
        "geohash6": geohash(lat, lng, 6),
        "geohash7": geohash(lat, lng, 7),
        "coord_precision": coordinate_precision(lat, lng),
        "content_hash": content_hash(),
    })


def upsert_latest(current: DataFrame, batch: DataFrame, key: str = "id", version: str = "batch_version") -> DataFrame:
    """Last write wins: the row of the highest version per key.

    The whole row travels as a struct through an aggregation, which combines on the map side, so a key
    written again and again does not pile up in one task.
    """
    rows = current.unionByName(batch)
    packed = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), version).alias("_row"))
    return packed.select(key, "_row.*")


def staging_by_ids(staging: DataFrame, ids: DataFrame) -> DataFrame:
    return staging.join(ids.select("id"), "id", "left_semi")


def staging_batch(staging: DataFrame, batch_id: str, source: str | None = None) -> DataFrame:
    rows = staging.filter(F.col("batch_id") == batch_id)
    return rows.filter(F.col("source") == source) if source else rows


def repair_coordinates(records: DataFrame, candidates: DataFrame, snap_m: float = 100.0) -> DataFrame:
    """Give records without a valid position that of their first valid candidate, and move valid ones to
    the nearest candidate when it is closer than 100 m.

    ``records`` has id, lat, lng; ``candidates`` has id, position, lat, lng (several per id).
    """
    ok = has_valid_point(F.col("lat"), F.col("lng"))
    points = candidates.filter(ok).select("id", "position", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    joined = records.join(points, "id", "left")
    metres = haversine_km(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")) * 1000
    place = F.struct(F.col("c_lat").alias("lat"), F.col("c_lng").alias("lng"))
    best = joined.groupBy("id", "lat", "lng").agg(
        F.min(F.when(F.col("c_lat").isNotNull(), F.struct(metres.alias("m"), "position", place.alias("p")))).alias("near"),
        F.min(F.when(F.col("c_lat").isNotNull(), F.struct("position", place.alias("p")))).alias("first"),
    )
    chosen = (
        F.when(ok & (F.col("near.m") < snap_m), F.col("near.p"))
        .when(~ok & F.col("first").isNotNull(), F.col("first.p"))
        .otherwise(F.struct("lat", "lng"))
    )
    return best.select("id", chosen.alias("_c")).select("id", F.col("_c.lat").alias("lat"), F.col("_c.lng").alias("lng"))
