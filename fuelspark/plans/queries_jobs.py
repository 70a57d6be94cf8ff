"""Whole runs: a full station run, a refresh of an earlier state, and the daily price run, each into a store of its own."""

from pyspark.sql import functions as F

from fuelspark.functions.lookups import FUELS
from fuelspark.jobs import prices, stations
from fuelspark.jobs.store import Store
from fuelspark.operators.scale import scratch_path
from fuelspark.plans import bindings as b
from fuelspark.plans.catalogue import query
from fuelspark.plans.queries_stations import number_of
from fuelspark.plans.sqlviews import cents
from fuelspark.sources import exports

AS_OF, EARLIER = b.AS_OF, "2024-01-24"
_STORES: dict[tuple[str, str, str], Store] = {}


def shared(spark, d, name, build):
    """The store of a run, made once per application and input and read by all queries on it."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STORES:
        _STORES[key] = build()
    return _STORES[key]


def earlier(raw):
    """The records a week before: some not there yet, some with another name, place or municipality."""
    n = number_of("id")
    return raw.filter(n % 10 != 4).withColumns({
        "raw_name": F.when(n % 8 == 0, F.lit("X 1")).otherwise(F.col("raw_name")), "lat": F.when(n % 12 == 5, F.col("lat") + 0.3).otherwise(F.col("lat")),
        "raw_municipality": F.when(n % 14 == 3, F.lit("Otro")).otherwise(F.col("raw_municipality"))})


def feed(spark, d):
    """Prices of the regulator's stations by place id."""
    return b.prices_wide(spark, d).select(F.lpad(F.col("id").cast("string"), 12, "0").alias("place_id"), F.lit(None).cast("string").alias("cre_id"), *FUELS)


def full_run(spark, d):
    return shared(spark, d, "full", lambda: stations.station_run(b.raw_staging(spark, d), scratch_path(spark, "full-run"), "2024-01-31", AS_OF, feed(spark, d)))


def refreshed(spark, d):
    """The state of a week before, then a refresh to today's."""
    def build():
        raw, root = b.raw_staging(spark, d), scratch_path(spark, "refresh")
        stations.station_run(earlier(raw), root, EARLIER, EARLIER, feed(spark, d))
        return stations.station_run(raw, root, "2024-01-31", AS_OF, feed(spark, d))

    return shared(spark, d, "refresh", build)


_DECISIONS = "SELECT id_a, id_b, composite, decision FROM decisions"
_CURRENT = """SELECT 'mst_'||sha256(id_a||'|'||id_b) master_id FROM decisions WHERE decision='auto_match' UNION ALL SELECT 'mst_'||sha256(id) master_id FROM conformed WHERE source='cre'
 AND id NOT IN (SELECT id_a FROM decisions WHERE decision='auto_match' UNION SELECT id_b FROM decisions WHERE decision='auto_match')"""
query("job_01_full_decisions", _DECISIONS)(lambda s, d: full_run(s, d).read("decisions").select("id_a", "id_b", "composite", "decision"))
query("job_01_full_masters", f"SELECT master_id, 'active' status FROM ({_CURRENT})")(lambda s, d: full_run(s, d).read("masters").select("master_id", "status"))
query("job_02_refresh_decisions", _DECISIONS)(lambda s, d: refreshed(s, d).read("decisions").select("id_a", "id_b", "composite", "decision"))
query("job_02_refresh_staging", "SELECT id, norm_name, norm_brand, norm_municipality, lat, fetched_at::VARCHAR fetched_at FROM conformed")(
    lambda s, d: refreshed(s, d).read("staging").select("id", "norm_name", "norm_brand", "norm_municipality", "lat", F.col("fetched_at").cast("string").alias("fetched_at")))
query("job_02_refresh_active_masters", f"SELECT master_id FROM ({_CURRENT})")(lambda s, d: refreshed(s, d).read("masters").filter("status = 'active'").select("master_id"))
query("job_03_refresh_changes", """SELECT id, CASE WHEN k%10=4 THEN 'new' ELSE 'changed' END AS "change" FROM raw_staging WHERE k%10=4 OR k%8=0 OR (k%12=5 AND lat IS NOT NULL) OR k%14=3""")(
    lambda s, d: refreshed(s, d).read("changes"))
query("job_03_refresh_audit", f"""SELECT run_id, source, count(*) FILTER (there) records_fetched, count(*) FILTER (there AND is_new) records_new, count(*) FILTER (there AND NOT is_new AND moved) records_updated,
 count(*) FILTER (there AND NOT is_new AND NOT moved) records_unchanged, 0::BIGINT records_failed, 'success' status FROM (
 SELECT '{EARLIER}' run_id, source, k%10<>4 there, true is_new, false moved FROM raw_staging UNION ALL
 SELECT '{AS_OF}', source, true, k%10=4, k%8=0 OR coalesce(k%12=5 AND lat IS NOT NULL, false) OR k%14=3 FROM raw_staging) GROUP BY 1,2""")(
    lambda s, d: stations.audit(refreshed(s, d)).select(
        F.col("batch_id").alias("run_id"), "source", "records_fetched", "records_new", "records_updated", "records_unchanged", F.col("records_failed").cast("bigint").alias("records_failed"), "status"))


@query("job_04_refresh_csv", f"SELECT master_id FROM ({_CURRENT})")
def refresh_csv(spark, d):
    store = refreshed(spark, d)
    back = spark.read.option("header", True).csv(store.path("flat_csv", AS_OF))
    assert back.columns == exports.CSV_COLUMNS
    return back.select("master_id")


# --- daily prices -----------------------------------------------------------------------------------

HALF = "2024-01-16"


def price_store(spark, d):
    """The days of the events in two runs, the second of which also brings a day that is stored already."""
    def build():
        wide, root = b.snapshots_wide(spark, d), scratch_path(spark, "price-runs")
        prices.price_run(wide.filter(F.col("date") < HALF), root, "1")
        return prices.price_run(wide.filter(F.col("date") >= F.date_sub(F.lit(HALF).cast("date"), 1)), root, "2")

    return shared(spark, d, "prices", build)


_SANE = """(SELECT id, "date", fuel, floor(price*100+0.5e0)/100e0 price FROM snapshots WHERE price BETWEEN 5 AND 100)"""
query("job_05_price_snapshots", f'SELECT id, "date"::VARCHAR "date", fuel, price FROM {_SANE}')(
    lambda s, d: prices.read(price_store(s, d), "snapshots").select("id", F.col("date").cast("string").alias("date"), "fuel", "price"))
query("job_05_price_changes", f"""SELECT id, fuel, "date"::VARCHAR "date", previous_date::VARCHAR previous_date, previous, price, CASE WHEN price>previous THEN 'up' ELSE 'down' END direction
 FROM (SELECT *, lag(price) OVER w previous, lag("date") OVER w previous_date FROM {_SANE} WINDOW w AS (PARTITION BY id, fuel ORDER BY "date")) WHERE previous<>price""")(
    lambda s, d: prices.read(price_store(s, d), "changes").select("id", "fuel", *[F.col(c).cast("string").alias(c) for c in ("date", "previous_date")], "previous", "price", "direction"))
query("job_05_price_statistics", f"""SELECT "date"::VARCHAR "date", fuel, min(price) lowest, max(price) highest, count(*) n, floor(sum({cents('price')})/count(*)+0.5e0)/100e0 average FROM {_SANE} GROUP BY 1,2""")(
    lambda s, d: prices.read(price_store(s, d), "statistics").select(
        F.col("date").cast("string").alias("date"), "fuel", F.col("min").alias("lowest"), F.col("max").alias("highest"), F.col("count").alias("n"), F.col("avg").alias("average")))
query("job_06_late_prices", f"""SELECT id, fuel, price FROM {_SANE} WHERE "date"=DATE '{HALF}'-1""")(lambda s, d: price_store(s, d).read("late").select("id", "fuel", "price"))
