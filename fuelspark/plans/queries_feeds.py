"""Sources, sinks and streaming jobs: each query lands the tables as files in the shared folder and reads them back."""

from pyspark.sql import functions as F

from fuelspark.functions.lookups import FUELS, STATE_REGIONS
from fuelspark.operators.scale import scratch_path
from fuelspark.plans import bindings as b
from fuelspark.plans.catalogue import query
from fuelspark.plans.queries_prices import anomalies, merged, snapshots
from fuelspark.plans.sqlviews import avg_price, cents, jr, quote
from fuelspark.sources import exports, landed, zones
from fuelspark.streaming import jobs

AS_OF = b.AS_OF
# Stations that one imported snapshot line holds at most.
STATIONS_A_FILE = 5_000


def number():
    """The number in a record's id."""
    return F.substring_index("id", "_", -1).cast("bigint")


# --- sources ----------------------------------------------------------------------------------------


@query("src_01_places_xml", "SELECT k::VARCHAR place_id, raw_name AS name, cre_id, lng, lat FROM raw_staging WHERE source='cre'")
def places_xml(spark, d):
    path = scratch_path(spark, "places-xml")
    rows = b.raw_staging(spark, d).filter("source = 'cre'").select(
        number().cast("string").alias("_place_id"), F.col("raw_name").alias("name"), "cre_id",
        F.struct(F.col("lng").cast("string").alias("x"), F.col("lat").cast("string").alias("y")).alias("location"))
    rows.write.format("xml").option("rootTag", "places").option("rowTag", "place").save(path)
    return landed.read_places_xml(spark, path)


@query("src_02_prices_xml", """SELECT l_suppkey::VARCHAR place_id, arg_max(p, o) FILTER (l_returnflag='A') regular, arg_max(p, o) FILTER (l_returnflag='N') premium, arg_max(p, o) FILTER (l_returnflag='R') diesel
 FROM (SELECT *, l_extendedprice/2000e0 p, (l_orderkey, l_linenumber) o FROM lineitem) GROUP BY 1""")
def prices_xml(spark, d):
    path = scratch_path(spark, "prices-xml")
    kind = F.when(F.col("l_returnflag") == "A", " Magna ").when(F.col("l_returnflag") == "N", "premium").otherwise("DIESEL")
    rows = b.table(spark, d, "lineitem").orderBy("l_orderkey", "l_linenumber").select(
        F.col("l_suppkey").alias("_place_id"), F.array(F.struct((F.col("l_extendedprice") / 2000.0).alias("_VALUE"), kind.alias("_type"))).alias("gas_price"))
    rows.write.format("xml").option("rootTag", "places").option("rowTag", "place").save(path)
    return landed.read_prices_xml(spark, path)


query("src_03_normalized_places", """SELECT k::VARCHAR place_id, NULL::VARCHAR cre_id, raw_name nombre, nullif(trim(raw_brand),'') marca, raw_address domicilio, CASE WHEN k%10=0 THEN NULL ELSE lat END latitud, lng longitud FROM raw_staging""")(
    lambda s, d: landed.normalize_places(b.raw_staging(s, d).select(
        number().alias("ID"), F.lit("  ").alias("cre_id"), F.lit("").alias("nombre"), F.col("raw_name").alias("Nombre_Estacion"), F.col("raw_brand").alias("brand"), F.col("raw_address").alias("direccion"),
        F.when(number() % 10 == 0, "0,0").otherwise(F.replace(F.col("lat").cast("string"), F.lit("."), F.lit(","))).alias("LAT"), F.col("lng").cast("string").alias("lon"))
    ).select("place_id", "cre_id", "nombre", "marca", "domicilio", "latitud", "longitud"))
query("src_03_normalized_prices", f"""SELECT l_orderkey::VARCHAR cre_id, CASE WHEN p BETWEEN 5 AND 100 THEN {jr('p', 2)} END gasolina_regular, CASE WHEN p/2 BETWEEN 5 AND 100 THEN {jr('p/2', 2)} END diesel FROM (SELECT l_orderkey, l_extendedprice/500e0 p FROM lineitem)""")(
    lambda s, d: landed.normalize_prices(b.table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("id_estacion"), F.replace((F.col("l_extendedprice") / 500.0).cast("string"), F.lit("."), F.lit(",")).alias("Magna"),
        (F.col("l_extendedprice") / 500.0 / 2).alias("precio_diesel"))).select("cre_id", "gasolina_regular", "diesel"))


@query("src_04_open_map", """SELECT k::VARCHAR osm_id, CASE WHEN k%2=0 THEN 'node' ELSE 'way' END osm_type, raw_name AS name, raw_brand brand, raw_address addr_street, lat, lng FROM raw_staging WHERE source='osm' AND k%5<>0""")
def open_map(spark, d):
    path = scratch_path(spark, "open-map")
    k = number()
    node = k % 2 == 0
    point = F.struct("lat", F.col("lng").alias("lon"))
    tags = F.map_from_arrays(F.array(*[F.lit(x) for x in ("amenity", "name", "name:es", "operator", "addr:street")]), F.array(
        F.when(k % 5 == 0, "cafe").otherwise("fuel"), F.when(k % 3 == 0, "").otherwise(F.col("raw_name")), F.col("raw_name"), F.coalesce("raw_brand", F.lit("")), F.coalesce("raw_address", F.lit(""))))
    b.raw_staging(spark, d).filter("source = 'osm'").select(
        F.when(node, "node").otherwise("way").alias("type"), k.cast("string").alias("id"), F.when(node, F.col("lat")).alias("lat"), F.when(node, F.col("lng")).alias("lon"),
        F.when(~node, point).alias("center"), tags.alias("tags")).write.json(path)
    return landed.read_open_map(spark, path).select("osm_id", "osm_type", "name", "brand", "addr_street", "lat", "lng")


@query("src_05_register_csv", """SELECT k::VARCHAR denue_id, raw_name nom_estab, raw_address nom_vial, CASE WHEN k%3=0 THEN '464111' ELSE '46411' END codigo_act FROM raw_staging WHERE k%3<>1""")
def register_csv(spark, d):
    path = scratch_path(spark, "register-csv")
    k = number()
    b.raw_staging(spark, d).select(
        k.alias("CLEE"), F.col("raw_name").alias("Nombre_Establecimiento"), F.col("raw_address").alias(" Calle "), F.when(k % 3 == 0, "464111").when(k % 3 == 1, "722511").otherwise("46411").alias("SCIAN"),
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return landed.read_register_csv(spark, path)


query("src_06_services", """SELECT c_custkey id, array_to_string(list_filter([CASE WHEN c_custkey%2=0 THEN 'regular' END, CASE WHEN c_custkey%3=0 THEN 'diesel' END, CASE WHEN c_custkey%11=0 THEN 'car_wash' END, CASE WHEN c_custkey%5=0 OR c_custkey%7=0 THEN 'convenience_store' END], lambda x: x IS NOT NULL), ',') services FROM customer""")(
    lambda s, d: b.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(landed.services(F.map_from_arrays(
        F.array(*[F.lit(x) for x in ("gasolina_regular", "diesel", "tienda", "abarrotes", "lavado")]),
        F.array(*[F.when(F.col("c_custkey") % n == 0, yes).otherwise(no) for n, yes, no in ((2, "1", "0"), (3, "true", "false"), (5, "S", "N"), (7, "x", " "), (11, "1", ""))]))), ",").alias("services")))
query("src_07_place_address", """SELECT c_custkey id, 'State '||c_nationkey state, CASE WHEN c_custkey%2=0 THEN 'Town '||(c_custkey%50) WHEN c_custkey%3=0 THEN 'County '||(c_custkey%20) END municipality, CASE WHEN c_custkey%5<>0 THEN c_custkey::VARCHAR END zip_code FROM customer""")(
    lambda s, d: landed.place_address(b.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.filter(F.array(*[
        F.when(on, F.struct(F.concat(F.lit(word), value.cast("string")).alias("long_name"), F.array(F.lit("political"), F.lit(kind)).alias("types")))
        for on, word, value, kind in (
            (F.lit(True), "State ", F.col("c_nationkey"), "administrative_area_level_1"), (F.col("c_custkey") % 2 == 0, "Town ", F.col("c_custkey") % 50, "locality"),
            ((F.col("c_custkey") % 2 != 0) & (F.col("c_custkey") % 3 == 0), "County ", F.col("c_custkey") % 20, "administrative_area_level_2"), (F.col("c_custkey") % 5 != 0, "", F.col("c_custkey"), "postal_code"))]),
        lambda x: x.isNotNull()).alias("address_components"))).select("id", "state", "municipality", "zip_code"))


def raw_zone(spark, d):
    """Two sources over two dates; the last date of the first source has two batches."""
    path = scratch_path(spark, "raw-zone")
    rows = b.raw_staging(spark, d).select("id", "source", "raw_name", "lat", "lng")
    for date, batch, share in (("2024-01-01", "b1", 1), ("2024-01-02", "b2", 2), ("2024-01-02", "b3", 3)):
        zones.write_raw(rows.filter("source = 'cre'").drop("source").filter(number() % share == 0), path, "cre", date, batch)
    zones.write_raw(rows.filter("source = 'osm'").drop("source"), path, "osm", "2024-01-03", "b9")
    return path


query("src_08_raw_zone_batch", "SELECT id, raw_name, lat, lng FROM raw_staging WHERE source='cre' AND k%2=0")(
    lambda s, d: zones.read_batch(s, raw_zone(s, d), "cre", "b2").select("id", "raw_name", "lat", "lng"))
query("src_09_raw_zone_latest", "SELECT 'any' which, id FROM raw_staging WHERE source='cre' AND k%3=0 UNION ALL SELECT 'first', id FROM raw_staging WHERE source='cre'")(
    lambda s, d: (lambda p: zones.read_latest(s, p, "cre").select(F.lit("any").alias("which"), "id").unionByName(zones.read_latest(s, p, "cre", "2024-01-01").select(F.lit("first").alias("which"), "id")))(raw_zone(s, d)))
query("src_10_batches", "SELECT * FROM (VALUES ('2024-01-02','b3'),('2024-01-02','b2'),('2024-01-01','b1')) t(\"date\", batch_id) WHERE (SELECT count(*) FROM part)>0")(lambda s, d: zones.list_batches(s, raw_zone(s, d), "cre"))


@query("src_11_dead_letters", "SELECT id, 'no position' reject_reason FROM raw_staging WHERE lat IS NULL")
def dead_letters(spark, d):
    path = scratch_path(spark, "dead-letters")
    _, bad = zones.split_rejects(b.raw_staging(spark, d).select("id", "lat", "lng"), F.col("lat").isNotNull())
    zones.write_dead_letters(bad, path, F.lit("no position"))
    return spark.read.parquet(path).select("id", "reject_reason")


def snapshot_zone(spark, d):
    """Snapshots by date; one date is written again with one station in two, and the older half is dropped."""
    path = scratch_path(spark, "snapshots")
    rows = snapshots(spark, d)
    zones.write_snapshots(rows, path)
    zones.write_snapshots(rows.filter((F.col("date") == "2024-01-20") & (F.col("id") % 2 == 0)), path)
    zones.retain_snapshots(spark, path, "2024-01-25", 10)
    zones.delete_snapshot(spark, path, "2024-01-18")
    return path


_KEPT = "(SELECT * FROM snapshots WHERE \"date\">=DATE '2024-01-15' AND \"date\"<>DATE '2024-01-18' AND (\"date\"<>DATE '2024-01-20' OR id%2=0))"
query("src_12_snapshots", f'SELECT id, "date"::VARCHAR "date", fuel, price FROM {_KEPT}')(
    lambda s, d: zones.read_snapshots(s, snapshot_zone(s, d)).withColumn("date", F.col("date").cast("string")).select("id", "date", "fuel", "price"))
query("src_12_snapshot_dates", f'SELECT DISTINCT "date"::VARCHAR "date" FROM {_KEPT}')(lambda s, d: zones.list_snapshots(s, snapshot_zone(s, d)).select(F.col("date").cast("string").alias("date")))
query("src_14_snapshot_statistics", f'SELECT count(DISTINCT "date") snapshot_count, min("date")::VARCHAR oldest, max("date")::VARCHAR newest FROM {_KEPT}')(lambda s, d: zones.snapshot_statistics(s, snapshot_zone(s, d)))


@query("src_13_snapshot_import", """SELECT c_custkey%12 AS "day", CASE WHEN c_custkey%12=3 THEN 'date format' WHEN c_custkey%12=5 THEN 'date missing' WHEN c_custkey%7=0 THEN 'station id missing' ELSE 'ok' END outcome, count(*) n FROM customer GROUP BY 1,2
 UNION ALL SELECT 99, 'stations empty', 1""")
def snapshot_import(spark, d):
    path = scratch_path(spark, "snapshot-files")
    k = F.col("c_custkey")
    station = F.struct(F.when(k % 7 != 0, F.concat((k % 12).cast("string"), F.lit("-"), k)).alias("id"), F.struct(F.lit(20.0).alias("regular")).alias("prices"))
    date = F.when(F.col("day") == 3, "3/1/24").when(F.col("day") != 5, F.concat(F.lit("2024-01-"), F.lpad((F.col("day") + 1).cast("string"), 2, "0")))
    # a day comes in as many files of bounded size as its stations ask for
    dealt = b.table(spark, d, "customer").select(station.alias("station"), (k % 12).alias("day"), F.floor(k / (12 * STATIONS_A_FILE)).alias("part"))
    files = dealt.groupBy("day", "part").agg(F.collect_list("station").alias("stations")).select(date.alias("date"), "day", "stations")
    files.select("date", "stations").write.json(path)
    spark.range(1).select(F.lit("2024-02-01").alias("date"), F.array().cast("array<struct<id:string>>").alias("stations")).write.mode("append").json(path)
    good, bad = zones.import_snapshots(spark, path)
    ok = good.groupBy((F.dayofmonth("date") - 1).alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("ok"))
    by_reason = F.when(F.col("reject_reason") == "date format", 3).when(F.col("reject_reason") == "date missing", 5).when(F.col("reject_reason") == "stations empty", 99).otherwise(F.substring("date", 9, 2).cast("int") - 1)
    rejected = bad.groupBy(by_reason.alias("day"), F.col("reject_reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return ok.select("day", "outcome", "n").unionByName(rejected.select("day", "outcome", "n"))


# --- exports ----------------------------------------------------------------------------------------


def priced_masters(spark, d):
    k = F.substring_index("master_id", "_", -1).cast("bigint")
    priced = merged(spark, d).select(F.col("id").alias("_s"), *FUELS)
    return b.masters(spark, d).join(priced, k == F.col("_s"), "left").drop("_s")


_PM = "(SELECT m.*, regular, premium, diesel FROM masters m LEFT JOIN merged ON merged.id=k)"


@query("src_15_app_json", f"SELECT master_id id, coalesce(nullif(canonical_name,''),'') AS name, coalesce(canonical_brand,'OTRO') brand, coalesce(regular,premium,diesel) IS NOT NULL has_data, regular FROM {_PM} WHERE status='active' AND lat IS NOT NULL AND lng IS NOT NULL")
def app_json(spark, d):
    """Written for the application and read back through its own reader (SRC-21), which drops stations without position."""
    path = scratch_path(spark, "app-json")
    exports.write_app_json(priced_masters(spark, d), path)
    return landed.read_app_json(spark, path).select("id", "name", "brand", "has_data", "regular")


query("src_21_app_json_fallbacks", """SELECT 'm'||c_custkey id, CASE WHEN c_custkey%2=0 THEN c_name ELSE 'canon '||c_custkey END AS name, 'OTRO' brand, CASE WHEN c_custkey%3=0 THEN 21.5e0 END regular, c_custkey%3=0 has_data
 FROM customer WHERE c_custkey%5<>0 AND c_custkey%7<>0""")(lambda s, d: old_app_json(s, d))


def old_app_json(spark, d):
    path, k = scratch_path(spark, "old-app-json"), F.col("c_custkey")
    b.table(spark, d, "customer").select(
        F.when(k % 5 != 0, F.concat(F.lit("m"), k)).alias("master_id"), F.when(k % 2 == 0, F.col("c_name")).alias("name"), F.concat(F.lit("canon "), k).alias("canonical_name"),
        F.when(k % 7 == 0, 0.0).otherwise(19.5).alias("lat"), F.lit(-99.0).alias("lng"), F.when(k % 3 == 0, F.struct(F.lit(21.5).alias("gasolina_regular"))).alias("prices")).write.json(path)
    return landed.read_app_json(spark, path).select("id", "name", "brand", "regular", "has_data")


@query("src_16_flat_csv", f"SELECT master_id, pl_number, canonical_brand, lat, precio_regular FROM (SELECT *, regular precio_regular FROM {_PM}) WHERE status='active'")
def flat_csv(spark, d):
    path = scratch_path(spark, "flat-csv")
    exports.write_flat_csv(priced_masters(spark, d).drop("source_ids"), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == exports.CSV_COLUMNS
    return back.select("master_id", "pl_number", "canonical_brand", F.col("lat").cast("double").alias("lat"), F.col("precio_regular").cast("double").alias("precio_regular"))


_REGION = "CASE state " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in STATE_REGIONS.items()) + " ELSE 'Otro' END"
query("src_17_station_report", f"SELECT '{AS_OF}' report_date, id station_id, name, brand, city municipality, state, {_REGION} region, lat latitude, lng longitude, has_data::INT has_data, regular regular_price, premium premium_price, diesel diesel_price FROM merged")(
    lambda s, d: exports.station_report(merged(s, d), AS_OF))
query("src_18_price_history", f"""SELECT s."date"::VARCHAR "date", s.id station_id, name, brand, city, state, {_REGION} region, fuel fuel_type, price price_mxn, national_avg, ({cents('price')}-{cents('national_avg')})/100e0 delta_from_avg,
 (s.id%4=0 AND s."date"=DATE '2024-01-20')::INT is_anomaly, CASE WHEN s.id%4=0 AND s."date"=DATE '2024-01-20' THEN 2.5e0 END anomaly_zscore
 FROM snapshots s JOIN (SELECT "date", fuel, {avg_price()} national_avg FROM snapshots GROUP BY 1,2) USING("date", fuel) JOIN stations t ON t.id=s.id""")(
    lambda s, d: exports.price_history_export(snapshots(s, d), b.stations(s, d), snapshots(s, d).filter("id % 4 = 0 and date = '2024-01-20'").withColumn("z_score", F.lit(2.5))))
query("src_19_anomaly_export", f"""SELECT '{AS_OF}' detection_date, id site_id, name site_name, brand, city, state, {_REGION} region, fuel product, price, local_avg, z_score, CASE WHEN local_avg>0 THEN {jr('(price-local_avg)/local_avg*100', 1)} END deviation_pct,
 direction, severity, nearby_count neighbor_count FROM anomalies""")(lambda s, d: exports.anomaly_export(anomalies(s, d), AS_OF))
query("src_20_list_export", "SELECT id, name, brand, city, state, lat, lng, regular, premium, diesel, CASE WHEN has_data THEN 'Y' ELSE 'N' END has_data, CASE WHEN id IN (SELECT id FROM anomalies) THEN 'Y' ELSE 'N' END is_anomaly FROM merged WHERE brand='BRAND_3'")(
    lambda s, d: exports.list_export(merged(s, d).filter("brand = 'BRAND_3'"), anomalies(s, d)))
query("set_01_union_of_sources", "SELECT source, count(*) n FROM raw_staging GROUP BY 1")(lambda s, d: b.raw_staging(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")))

# --- streaming --------------------------------------------------------------------------------------


def event_stream(spark, d):
    return jobs.file_stream(spark, d, "events.parquet")


def report_stream(spark, d):
    return b.reports(spark, d, event_stream(spark, d))


def snapshot_stream(spark, d):
    """Daily snapshots landed as files. A date may span files, so all that have landed make one batch."""
    path = scratch_path(spark, "landed-snapshots")
    snapshots(spark, d).repartitionByRange("date", "id").sortWithinPartitions("date").write.parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def accepted_reports(spark, d):
    return jobs.accept_reports(report_stream(spark, d), b.stations(spark, d))


def work(spark):
    return scratch_path(spark, "stream")


query("str_01_snapshot_ingest", 'SELECT id, "date"::VARCHAR "date", fuel, price FROM snapshots')(
    lambda s, d: jobs.ingest_snapshots(snapshot_stream(s, d), work(s)).select("id", F.col("date").cast("string").alias("date"), "fuel", "price"))
query("str_02_community_reports", "SELECT report_id, user_id, id, fuel, price FROM reports_ok")(
    lambda s, d: jobs.newest_reports(jobs.run_append(accepted_reports(s, d), work(s))).select("report_id", "user_id", "id", "fuel", "price"))
query("str_03_latest_report", "SELECT id, fuel, arg_max(price, (ts, report_id)) price, arg_max(user_id, (ts, report_id)) user_id FROM reports_ok GROUP BY 1,2")(
    lambda s, d: jobs.run_updates(jobs.latest_per_station(accepted_reports(s, d)), work(s), ["id", "fuel"]).select("id", "fuel", "price", "user_id"))


def alerts(spark, d):
    k = F.col("c_custkey")
    fuel = F.element_at(F.array(*[F.lit(f) for f in FUELS]), (k % 3 + 1).cast("int"))
    made = b.table(spark, d, "customer").select((k % 30).alias("user_id"), (k % 15).alias("id"), fuel.alias("fuel"), k.alias("created_at"), (10.0 + k % 37).alias("threshold"))
    return made


_ALERTS = "(SELECT user_id, id, fuel, arg_max(threshold, created_at) threshold FROM (SELECT c_custkey%30 user_id, c_custkey%15 id, ['regular','premium','diesel'][c_custkey%3+1] fuel, c_custkey created_at, 10e0+c_custkey%37 threshold FROM customer) GROUP BY 1,2,3)"
query("str_04_price_alerts", f'SELECT s.id, s.fuel, s."date"::VARCHAR "date", price, threshold, user_id alert_user FROM snapshots s JOIN {_ALERTS} a ON a.id=s.id AND a.fuel=s.fuel WHERE price<threshold')(
    lambda s, d: jobs.run_append(jobs.fire_alerts(snapshot_stream(s, d), alerts(s, d)), work(s)).select("id", "fuel", F.col("date").cast("string").alias("date"), "price", "threshold", "alert_user"))
query("str_05_rolling_history", """SELECT "date"::VARCHAR "date", id, fuel, arg_max(price, (ts, price)) price FROM (SELECT CAST(ts AS DATE) "date", * FROM reports) WHERE "date" IN (SELECT DISTINCT CAST(ts AS DATE) FROM reports ORDER BY 1 DESC LIMIT 7) GROUP BY 1,2,3""")(
    lambda s, d: jobs.rolling_history(report_stream(s, d), work(s)).withColumn("date", F.col("date").cast("string")))
query("str_06_price_changes", """SELECT id, fuel, "date"::VARCHAR "date", previous, price, CASE WHEN price>previous THEN 'up' ELSE 'down' END direction FROM (SELECT *, lag(price) OVER (PARTITION BY id, fuel ORDER BY "date") previous FROM snapshots) WHERE previous<>price""")(
    lambda s, d: jobs.price_change_events(snapshot_stream(s, d), work(s)).withColumn("date", F.col("date").cast("string")))
query("str_07_contributors", "SELECT user_id, count(*)*10 points, CASE WHEN count(*)*10>=200 THEN 'expert' WHEN count(*)*10>=50 THEN 'regular' ELSE 'new' END badge FROM reports_ok GROUP BY 1")(
    lambda s, d: jobs.run_updates(jobs.contributor_points(accepted_reports(s, d)), work(s), ["user_id"]))
