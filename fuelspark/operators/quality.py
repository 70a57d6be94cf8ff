"""Data-quality rules: each one is a query over the masters that yields issue rows.

Issues share one shape: rule, severity, master_id, detail and ``extra`` (map of strings). A rule is a
function of the table dictionary and a settings object, registered by its identifier.
"""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fuelspark.functions.geo import haversine_km
from fuelspark.functions.lookups import BOUNDS, STATE_LATITUDES
from fuelspark.functions.numeric import js_round
from fuelspark.operators.scale import HOT_ROWS, salted_pairs

Tables = dict[str, DataFrame]
# Rules are small jobs next to the cluster, so some run side by side.
RULES_AT_ONCE = 4
ISSUE_SCHEMA = "rule string, severity string, master_id string, detail string, extra map<string,string>"


@dataclass(frozen=True)
class Settings:
    as_of: str
    geo_threshold_m: float = 5000.0
    stale_days: int = 90
    low_confidence: float = 0.50
    brand_confidence: float = 0.70
    orphan_days: int = 14
    hot_rows: int = HOT_ROWS


@dataclass(frozen=True)
class Rule:
    rule_id: str
    description: str
    severity: str
    run: Callable[[Tables, Settings], DataFrame]


RULES: dict[str, Rule] = {}


def rule(rule_id: str, description: str, severity: str):
    """Register a rule; the function returns master_id, detail and extra."""
    def register(function):
        def run(tables: Tables, settings: Settings) -> DataFrame:
            rows = function(tables, settings)
            return rows.select(
                F.lit(rule_id).alias("rule"), F.lit(severity).alias("severity"),
                F.col("master_id").cast("string"), F.col("detail").cast("string"), "extra",
            )
        RULES[rule_id] = Rule(rule_id, description, severity, run)
        return function
    return register


def _extra(**columns: Column) -> Column:
    return F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))]).alias("extra")


@rule("QA-01", "Permit number on several masters", "high")
def duplicate_permits(tables: Tables, settings: Settings) -> DataFrame:
    """One row per master that shares its permit, with the count and the first master of the permit.

    The members are rows, not one concatenated text, so a permit carried by millions stays spread out.
    """
    named = tables["masters"].filter("pl_number <> ''").select("master_id", "pl_number")
    groups = named.groupBy("pl_number").agg(F.count(F.lit(1)).alias("n"), F.min("master_id").alias("first_id")).filter("n > 1")
    rows = salted_pairs(named, groups, ["pl_number"], "master_id", settings.hot_rows)
    return rows.select(
        "master_id", F.format_string("permit %s is on %d masters, the first is %s", "pl_number", "n", "first_id").alias("detail"),
        _extra(pl_number=F.col("pl_number"), count=F.col("n"), first_id=F.col("first_id")),
    )


@rule("QA-02", "Permit number on distant masters", "high")
def distant_permits(tables: Tables, settings: Settings) -> DataFrame:
    """Masters with another one of the same permit more than 5 km away: how many, and the farthest.

    A permit whose masters fit in a box with a diagonal below the threshold has no such pair and is
    dropped after one aggregation. Pairs are summed as they are formed, so a master is one row.
    """
    m = tables["masters"].filter("pl_number is not null and lat is not null and lng is not null")
    box = m.groupBy("pl_number").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"))
    flat = F.least(F.abs("s"), F.abs("n")) * F.when(F.signum("s") * F.signum("n") > 0, 1.0).otherwise(0.0)
    # sides of the box on the sphere, never shorter than the distance of any two points inside it
    bound_m = haversine_km(F.col("s"), F.lit(0.0), F.col("n"), F.lit(0.0)) + haversine_km(flat, F.col("w"), flat, F.col("e"))
    wide = box.filter(bound_m * 1000 > settings.geo_threshold_m).select("pl_number")
    few = m.select("pl_number", "master_id", "canonical_name", "lat", "lng").join(wide, "pl_number", "left_semi")
    other = few.withColumnsRenamed({"master_id": "master_b", "canonical_name": "name_b", "lat": "lat_b", "lng": "lng_b"})
    pairs = salted_pairs(few, other, ["pl_number"], "master_id", settings.hot_rows).filter("master_id <> master_b")
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("lat_b"), F.col("lng_b"))
    far = pairs.withColumn("km", km).filter(F.col("km") * 1000 > settings.geo_threshold_m)
    farthest = F.max(F.struct("km", "master_b"))
    far = far.groupBy("master_id", "pl_number").agg(F.count(F.lit(1)).alias("others"), farthest.alias("f"))
    return far.select(
        "master_id", F.format_string("permit %s is also %.1f km away on %s", "pl_number", js_round(F.col("f.km"), 1), "f.master_b").alias("detail"),
        _extra(pl_number=F.col("pl_number"), other=F.col("f.master_b"), others=F.col("others"), distance_km=js_round(F.col("f.km"), 2)),
    )


@rule("QA-03", "Possible brand conflict between sources", "medium")
def brand_conflicts(tables: Tables, settings: Settings) -> DataFrame:
    m = tables["masters"].filter("canonical_brand is not null").filter(
        (F.size("source_ids") >= 3) & (F.col("confidence_score") < settings.brand_confidence))
    return m.select(
        "master_id", F.format_string("%d sources with confidence %.2f", F.size("source_ids"), js_round(F.col("confidence_score"), 2)).alias("detail"),
        _extra(brand=F.col("canonical_brand"), sources=F.size("source_ids")),
    )


@rule("QA-04", "Position outside the country", "high")
def out_of_bounds(tables: Tables, settings: Settings) -> DataFrame:
    inside = F.coalesce(F.col("lat").between(BOUNDS[0], BOUNDS[1]), F.lit(True)) & F.coalesce(
        F.col("lng").between(BOUNDS[2], BOUNDS[3]), F.lit(True))
    return tables["masters"].filter(~inside).select(
        "master_id", F.concat(F.lit("position outside the bounding box, state "), F.coalesce("canonical_state", F.lit("unknown"))).alias("detail"),
        _extra(lat=F.col("lat"), lng=F.col("lng"), state=F.col("canonical_state")),
    )


def state_latitudes(spark: SparkSession) -> DataFrame:
    rows = [(s, lo, hi) for s, (lo, hi) in STATE_LATITUDES.items()]
    return spark.createDataFrame(rows, "canonical_state string, lat_min double, lat_max double")


@rule("QA-05", "Position does not fit the state", "medium")
def wrong_state(tables: Tables, settings: Settings) -> DataFrame:
    """Latitude outside the range of the state; the range table has one row per state (seven)."""
    m = tables["masters"].filter("lat is not null and lng is not null")
    ranges = F.broadcast(state_latitudes(m.sparkSession))
    return m.join(ranges, "canonical_state").filter("lat not between lat_min and lat_max").select(
        "master_id", F.format_string("%s has latitudes %.2f to %.2f, found %.4f", "canonical_state", "lat_min", "lat_max", "lat").alias("detail"),
        _extra(state=F.col("canonical_state"), lat=F.col("lat"), lng=F.col("lng")),
    )


@rule("QA-06", "Active but not refreshed for 90 days", "medium")
def stale_active(tables: Tables, settings: Settings) -> DataFrame:
    cutoff = F.timestamp_add("DAY", F.lit(-settings.stale_days), F.lit(settings.as_of).cast("timestamp_ntz"))
    rows = tables["masters"].filter("status = 'active'").filter(F.col("last_refreshed_at") < cutoff)
    day = F.date_format("last_refreshed_at", "yyyy-MM-dd")
    return rows.select("master_id", F.concat(F.lit("last refreshed "), day).alias("detail"), _extra(last_refreshed=day))


@rule("QA-07", "Name or position missing", "high")
def missing_fields(tables: Tables, settings: Settings) -> DataFrame:
    no_name = F.coalesce(F.col("canonical_name") == "", F.lit(True))
    no_point = F.col("lat").isNull() & F.col("lng").isNull()
    missing = F.array_join(F.array_compact(F.array(F.when(no_name, "canonical_name"), F.when(no_point, "coordinates"))), ", ")
    return tables["masters"].filter(no_name | no_point).select(
        "master_id", F.concat(F.lit("missing: "), missing).alias("detail"), _extra(missing=missing))


@rule("QA-08", "Name changed between refreshes", "medium")
def drifted_names(tables: Tables, settings: Settings) -> DataFrame:
    reason = F.coalesce("review_reason", F.lit("name changed significantly"))
    return tables["masters"].filter("name_drift_flag").select(
        "master_id", F.concat(F.lit("name drift: "), reason).alias("detail"), _extra(reason=F.col("review_reason")))


@rule("QA-09", "Low confidence without review flag", "low")
def low_confidence(tables: Tables, settings: Settings) -> DataFrame:
    rows = tables["masters"].filter("status = 'active' and not review_flag").filter(
        F.col("confidence_score") < settings.low_confidence)
    return rows.select(
        "master_id", F.format_string("confidence %.2f from source %s", js_round(F.col("confidence_score"), 2), "primary_source").alias("detail"),
        _extra(confidence=F.col("confidence_score"), source=F.col("primary_source")),
    )


@rule("QA-10", "Old staging record without candidate pair", "low")
def orphans(tables: Tables, settings: Settings) -> DataFrame:
    """Regulator records without any candidate pair after two weeks; a report may list the oldest."""
    cutoff = F.timestamp_add("DAY", F.lit(-settings.orphan_days), F.lit(settings.as_of).cast("timestamp_ntz"))
    old = tables["staging"].filter("source = 'cre'").filter(F.col("fetched_at") < cutoff)
    paired = tables["paired_ids"].select("id")
    rows = old.join(paired, "id", "left_anti")
    day = F.date_format("fetched_at", "yyyy-MM-dd")
    return rows.select(
        F.lit(None).cast("string").alias("master_id"), F.concat(F.lit("record "), "id", F.lit(" fetched "), day).alias("detail"),
        _extra(record=F.col("id"), fetched=day))


def run_rule(rule_id: str, tables: Tables, settings: Settings) -> DataFrame:
    return RULES[rule_id].run(tables, settings)


def run_all(tables: Tables, settings: Settings, path: str) -> DataFrame:
    """All rules into one issue table at ``path``, a few of them at a time. A rule that fails, be it when it is planned or
    while it runs, leaves one row of high severity with the whole error; the others are not touched."""
    spark = next(iter(tables.values())).sparkSession

    def run(r: Rule) -> None:
        target = f"{path}/rule_id={r.rule_id}"
        try:
            r.run(tables, settings).write.mode("overwrite").parquet(target)
        except Exception as error:  # noqa: BLE001 - any failure of a rule is reported as an issue
            row = (r.rule_id, "high", None, f"rule failed: {error}", {})
            spark.createDataFrame([row], ISSUE_SCHEMA).write.mode("overwrite").parquet(target)

    with ThreadPoolExecutor(RULES_AT_ONCE) as pool:
        list(pool.map(run, RULES.values()))
    return spark.read.schema(f"{ISSUE_SCHEMA}, rule_id string").parquet(path).drop("rule_id")


def write_report(issues: DataFrame, path: str) -> None:
    """Issues by rule and severity, and the issues themselves, as CSV."""
    report(issues).write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    issues.withColumn("extra", F.to_json("extra")).write.mode("overwrite").option("header", True).csv(f"{path}/issues")


def report(issues: DataFrame) -> DataFrame:
    """Issues by rule and severity."""
    return issues.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("issues"))


def severity_totals(issues: DataFrame) -> DataFrame:
    return issues.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])
