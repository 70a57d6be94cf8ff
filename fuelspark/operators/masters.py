"""Master stations: build, confidence, upsert, change detection, drift and audit."""

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fuelspark.functions import text
from fuelspark.functions.geo import geohash, haversine_km
from fuelspark.functions.lookups import SOURCE_RELIABILITY
from fuelspark.functions.numeric import clamp01, round4
from fuelspark.operators.matching import primary_side

# Columns an upsert renews; all others keep the value of the first write
RENEWED = [
    "canonical_name", "canonical_brand", "canonical_address", "canonical_municipality", "canonical_state",
    "canonical_zip", "lat", "lng", "geohash", "confidence_score", "source_ids", "last_confirmed_at",
    "last_refreshed_at", "updated_at",
]
CANONICAL = ["name", "brand", "address", "municipality", "state", "zip"]


def confidence(
    base: Column, has_permit: Column, sources: Column, has_point: Column, confirmed_at: Column, as_of: str,
    drift: Column, review: Column,
) -> Column:
    age = F.floor(F.timestamp_diff("SECOND", confirmed_at, F.lit(as_of).cast("timestamp_ntz")) / 86400)
    stale = F.when(age > 90, -0.10).when(age > 30, -0.05).otherwise(0.0)
    score = (
        base + F.when(has_permit, 0.10).otherwise(0.0) + F.when(sources >= 3, 0.05).otherwise(0.0)
        + F.when(has_point, 0.03).otherwise(0.0) + F.coalesce(stale, F.lit(0.0))
        + F.when(drift, -0.05).otherwise(0.0) + F.when(review, -0.05).otherwise(0.0)
    )
    return round4(clamp01(score))


def permit_number(cre_id: Column) -> Column:
    """A permit as given, or an internal number marked as such; anything else is no permit."""
    return F.when(F.startswith(F.upper(cre_id), F.lit("PL/")), cre_id).when(
        F.regexp_like(cre_id, F.lit("^[0-9]+$")), F.concat(F.lit("CRE-"), cre_id)
    )


def _master(rows: DataFrame, canonical: dict[str, Column], as_of: str, base: Column) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    has_point = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    rows = rows.withColumns({f"canonical_{k}": v for k, v in canonical.items()})
    rows = rows.withColumn("canonical_name", F.coalesce("canonical_name", F.lit("UNKNOWN")))
    rows = rows.withColumn("pl_number", permit_number(F.col("cre_id")))
    score = confidence(base, F.col("pl_number").isNotNull(), F.size("source_ids"), has_point, now, as_of, F.lit(False), F.lit(False))
    return rows.select(
        "master_id", "pl_number", *[f"canonical_{k}" for k in CANONICAL], "lat", "lng",
        geohash(F.col("lat"), F.col("lng"), 7).alias("geohash"), F.lit("active").alias("status"),
        score.alias("confidence_score"), "primary_source", "source_ids", "cre_id",
        now.alias("first_seen_at"), now.alias("last_confirmed_at"), now.alias("last_refreshed_at"),
        F.lit(False).alias("name_drift_flag"), F.lit(False).alias("review_flag"), now.alias("created_at"), now.alias("updated_at"),
    )


def master_id(*ids: Column) -> Column:
    """Stable identifier: a rerun over the same members finds the same master."""
    return F.concat(F.lit("mst_"), F.sha2(F.array_join(F.array_sort(F.array(*ids)), "|"), 256))


def masters_from_pairs(decisions: DataFrame, staging: DataFrame, as_of: str) -> DataFrame:
    """One master per automatic match: fields of the primary record, then of the other one."""
    matched = decisions.filter("decision = 'auto_match'").select("id_a", "id_b", "composite")
    records = staging.select("id", F.struct(*staging.columns).alias("s"))
    both = matched.join(records.select(F.col("id").alias("id_a"), F.col("s").alias("a")), "id_a").join(
        records.select(F.col("id").alias("id_b"), F.col("s").alias("b")), "id_b"
    )
    side = primary_side()
    both = both.withColumn("p", F.when(side == "a", F.col("a")).otherwise(F.col("b"))).withColumn(
        "q", F.when(side == "a", F.col("b")).otherwise(F.col("a")))
    located = F.col("p.lat").isNotNull() & F.col("p.lng").isNotNull()
    rows = both.select(
        "*", master_id(F.col("id_a"), F.col("id_b")).alias("master_id"),
        F.when(located, F.col("p.lat")).otherwise(F.col("q.lat")).alias("lat"),
        F.when(located, F.col("p.lng")).otherwise(F.col("q.lng")).alias("lng"),
        F.col("p.source").alias("primary_source"), F.coalesce("a.cre_id", "b.cre_id").alias("cre_id"),
        F.array(F.struct(F.col("a.source").alias("source"), F.col("a.id").alias("id")),
                F.struct(F.col("b.source").alias("source"), F.col("b.id").alias("id"))).alias("source_ids"),
    )
    canonical = {k: F.coalesce(f"p.norm_{k}", f"q.norm_{k}", f"p.raw_{k}", f"q.raw_{k}") for k in CANONICAL}
    return _master(rows, canonical, as_of, F.col("composite"))


def masters_from_single(records: DataFrame, as_of: str) -> DataFrame:
    """One master per record of an authoritative source without a counterpart."""
    base = F.coalesce(text.literal_map(SOURCE_RELIABILITY)[F.col("source")], F.lit(0.5))
    rows = records.withColumns({
        "master_id": master_id(F.col("id")), "primary_source": F.col("source"),
        "source_ids": F.array(F.struct(F.col("source").alias("source"), F.col("id").alias("id"))),
    })
    canonical = {k: F.coalesce(f"norm_{k}", f"raw_{k}") for k in CANONICAL}
    return _master(rows, canonical, as_of, base)


def unmatched(staging: DataFrame, decisions: DataFrame, source: str = "cre") -> DataFrame:
    matched = decisions.filter("decision = 'auto_match'").select(F.explode(F.array("id_a", "id_b")).alias("id"))
    return staging.filter(F.col("source") == source).join(matched, "id", "left_anti")


def build_masters(decisions: DataFrame, staging: DataFrame, as_of: str) -> DataFrame:
    pairs = masters_from_pairs(decisions, staging, as_of)
    return pairs.unionByName(masters_from_single(unmatched(staging, decisions), as_of))


def upsert_masters(current: DataFrame, batch: DataFrame) -> DataFrame:
    """New masters are added; known ones get the renewed columns and keep permit, status, flags and dates."""
    old = current.select("master_id", F.struct(*current.columns).alias("old"))
    new = batch.select("master_id", F.struct(*current.columns).alias("new"))
    joined = old.join(new, "master_id", "full_outer")
    columns = []
    for c in current.columns:
        if c == "master_id":
            columns.append(F.col(c))
        elif c in RENEWED:
            columns.append(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c))
        else:
            columns.append(F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c))
    return joined.select(*columns)


def insert_new(current: DataFrame, batch: DataFrame, *keys: str) -> DataFrame:
    """Rows of the batch whose key is not there yet."""
    return batch.join(current.select(*keys), list(keys), "left_anti")


def active_masters(masters: DataFrame) -> DataFrame:
    return masters.filter("status = 'active'")


def pending_reviews(reviews: DataFrame, status: str = "pending") -> DataFrame:
    return reviews.filter(F.col("status") == status).orderBy("priority", "id_a", "id_b")


def changed_ids(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Records that are new or whose content hash differs from the batch before."""
    before = previous.select("id", F.col("content_hash").alias("_h"))
    joined = current.join(before, "id", "left")
    return joined.filter(F.col("_h").isNull() | (F.col("_h") != F.col("content_hash"))).select(
        "id", F.when(F.col("_h").isNull(), "new").otherwise("changed").alias("change")
    )


def coordinate_drift(current: DataFrame, previous: DataFrame, metres: float = 200.0) -> DataFrame:
    """Records that moved more than 200 m between two versions."""
    before = previous.select("id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    moved = haversine_km(F.col("_lat"), F.col("_lng"), F.col("lat"), F.col("lng")) * 1000
    joined = current.select("id", "lat", "lng").join(before, "id").withColumn("moved_m", moved)
    return joined.filter(F.col("moved_m") > metres).select("id", F.floor(F.col("moved_m") * 10 + 0.5).alias("_d")).select(
        "id", (F.col("_d") / 10.0).alias("moved_m"))


def name_drift(current: DataFrame, previous: DataFrame, least: float = 0.40) -> DataFrame:
    """Token overlap of the names of two versions and the flag raised below 0.40.

    Names are normalised on either side of the join: a filter on the overlap moves into the join, which would else
    normalise both names at each place that names them.
    """
    def named(df: DataFrame, name: str, tokens: str) -> DataFrame:
        words = F.when(text.blank_to_null(F.col("name")).isNotNull(), text.tokens(text.comparison_name(F.col("name"))))
        return df.select("id", F.col("name").alias(name), words.alias(tokens))

    rows = named(current, "name", "_now").join(named(previous, "previous_name", "_before"), "id")
    missing = F.col("_now").isNull() | F.col("_before").isNull()
    overlap = F.when(missing, 0.0).otherwise(text.overlap_of(F.col("_now"), F.col("_before")))
    return rows.withColumn("overlap", round4(overlap)).drop("_now", "_before").withColumn("name_drift_flag", F.col("overlap") < least)


def audited(spark: SparkSession, batch_id: str, as_of: str, work: Callable[[], DataFrame], path: str) -> DataFrame:
    """Run ``work``, append its audit rows with the seconds it took to the table at ``path``, and return that table. A run
    that fails leaves one row with its error, and the error goes on to the caller."""
    began = time.monotonic()
    seconds = lambda: F.lit(round(time.monotonic() - began, 3))
    try:
        rows = work().withColumn("error", F.lit(None).cast("string"))
        rows.persist().count()
        rows.withColumn("duration_seconds", seconds()).write.mode("append").parquet(path)
        rows.unpersist()
    except Exception as error:
        schema = "source string, records_fetched bigint, records_new bigint, records_updated bigint, records_unchanged bigint, records_failed bigint, batch_id string, run_at string, status string, error string"
        row = spark.createDataFrame([(None, 0, 0, 0, 0, 0, batch_id, as_of, "failed", str(error))], schema)
        row.withColumn("duration_seconds", seconds()).write.mode("append").parquet(path)
        raise
    return spark.read.parquet(path)


def audit_rows(current: DataFrame, previous: DataFrame, batch_id: str, as_of: str, failed: DataFrame | None = None) -> DataFrame:
    """One row per source: fetched, new, updated, unchanged and failed records of a batch."""
    before = previous.select("id", F.col("content_hash").alias("_h"))
    joined = current.join(before, "id", "left")
    new = F.count_if(F.col("_h").isNull())
    same = F.count_if(F.col("_h") == F.col("content_hash"))
    total = F.count(F.lit(1))
    rows = joined.groupBy("source").agg(
        total.alias("records_fetched"), new.alias("records_new"), (total - new - same).alias("records_updated"),
        same.alias("records_unchanged"),
    )
    bad = failed.groupBy("source").agg(F.count(F.lit(1)).alias("records_failed")) if failed is not None else None
    if bad is not None:
        rows = rows.join(bad, "source", "full_outer").fillna(0)
    else:
        rows = rows.withColumn("records_failed", F.lit(0).cast("bigint"))
    return rows.withColumns({
        "batch_id": F.lit(batch_id), "run_at": F.lit(as_of),
        "status": F.when(F.col("records_failed") > 0, "partial").otherwise("success"),
    })
