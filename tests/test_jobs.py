"""Stores, runs that fail or are repeated, masters between runs, and daily prices."""

import datetime

import pytest
from pyspark.sql import functions as F

from fuelspark.jobs import prices, stations
from fuelspark.jobs.store import Store
from fuelspark.operators import conform, masters
from fuelspark.operators.masters import _master, master_id

FEED = "id bigint, date string, regular double, premium double, diesel double"


def test_store_shows_committed_runs_only(spark, tmp_path):
    store, df = Store(spark, f"{tmp_path}/s"), spark.range(3)
    assert store.runs() == [] and store.before("9") is None
    with pytest.raises(ValueError, match="no committed run"):
        store.read("t")
    for run in ("1", "2", "3"):
        assert store.write("t", run, df.filter(F.col("id") < int(run))).count() == int(run)
        store.commit(run)
    store.write("t", "4", df.limit(0))
    assert store.runs() == ["1", "2", "3"] and store.before("4") == "3" and store.before("3") == "2"
    assert store.read("t").count() == 3 and store.read("t", "2").count() == 2
    with pytest.raises(ValueError, match="no committed run 4"):
        store.read("t", "4")
    path, files = store.folder(store.path("t", "1"))
    assert not files.exists(path)  # older than the newest two


def test_failed_run_leaves_its_audit_and_nothing_else(spark, tmp_path, monkeypatch):
    raw = spark.createDataFrame([("cre_1", "cre", "A"), (None, "osm", "B")], "id string, source string, raw_name string").withColumns({
        **{c: F.lit(None).cast("string") for c in ("raw_brand", "raw_address", "raw_municipality", "raw_state", "raw_zip", "cre_id")},
        "lat": F.lit(19.0), "lng": F.lit(-99.0), "fetched_at": F.lit("2024-01-01").cast("timestamp_ntz")})
    real = conform.conform_stations

    def broken(records):
        raise RuntimeError("register is broken")

    monkeypatch.setattr(conform, "conform_stations", broken)
    root = f"{tmp_path}/s"
    with pytest.raises(RuntimeError, match="broken"):
        stations.station_run(raw, root, "1", "2024-01-01")
    store = Store(spark, root)
    assert store.runs() == []
    monkeypatch.setattr(conform, "conform_stations", real)
    for _ in range(2):  # the second time nothing happens
        stations.station_run(raw, root, "1", "2024-01-01")
    assert store.runs() == ["1"] and store.read("rejected").count() == 1
    assert sorted((r.status, r.source, r.records_failed, r.error) for r in stations.audit(store).collect()) == [
        ("failed", None, 0, "register is broken"), ("partial", "osm", 1, None), ("success", "cre", 0, None)]
    assert [r.status for r in store.read("masters").collect()] == ["active"]


def test_fetched_records_and_kept_ones(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    columns = "id string, source string, raw_name string, lat double, lng double, fetched_at timestamp_ntz"
    none = {c: F.lit(None).cast("string") for c in ("raw_brand", "raw_address", "raw_municipality", "raw_state", "raw_zip", "cre_id")}
    first = spark.createDataFrame([("a", "cre", "Uno", 19.0, -99.0, at(1)), ("b", "osm", "Dos", 0.0, -99.0, at(1)), ("c", "osm", "Tres", 20.0, -99.0, at(1))], columns).withColumns(none)
    second = spark.createDataFrame([("a", "cre", "Uno", 19.0, -99.0, at(3)), ("b", "osm", "Dos", 21.0, -99.0, at(2)), ("b", "osm", "Viejo", 21.0, -99.0, at(1)), ("d", None, "x", 1.0, 1.0, at(2))], columns).withColumns(none)
    old = conform.conform_stations(stations.fetched(first).records)
    taken = stations.fetched(second)
    assert [r.id for r in taken.rejected.collect()] == ["d"]
    changes = spark.createDataFrame([("b",)], "id string")
    got = {r.id: (r.raw_name, r.lat, r.fetched_at) for r in stations.renewed_staging(old, taken.records, changes).collect()}
    assert got == {"a": ("Uno", 19.0, at(3)), "b": ("Dos", 21.0, at(2)), "c": ("Tres", 20.0, at(1))}


def test_masters_that_drift_or_lose_their_records(spark):
    def masters(rows):
        df = spark.createDataFrame(rows, "id string, canonical string").withColumns({
            "master_id": master_id(F.col("id")), "source": F.lit("cre"), "cre_id": F.lit("PL/1"), "lat": F.lit(19.0), "lng": F.lit(-99.0), "primary_source": F.lit("cre"),
            "source_ids": F.array(F.struct(F.lit("cre").alias("source"), F.col("id").alias("id")))})
        blank = F.lit(None).cast("string")
        return _master(df, {"name": F.col("canonical"), **{k: blank for k in ("brand", "address", "municipality", "state", "zip")}}, "2024-01-08", F.lit(0.8)).withColumn("review_reason", blank)

    known = masters([("a", "PEMEX NORTE"), ("b", "PEMEX SUR"), ("c", "GASOLINERA ESTE")])
    batch = masters([("a", "PEMEX NORTE"), ("b", "COMBUSTIBLES UNIDOS"), ("d", "NUEVA")])
    got = {r.source_ids[0].id: (r.status, r.name_drift_flag, r.review_flag, r.review_reason, r.confidence_score) for r in stations.renewed_masters(known, batch, "2024-01-08").collect()}
    full = got["a"][4]
    assert got == {
        "a": ("active", False, False, None, full), "b": ("active", True, True, stations.DRIFTED, round(full - 0.1, 4)),
        "c": ("unknown", False, True, stations.DISSOLVED, full), "d": ("active", False, False, None, full)}


def test_names_are_normalised_before_they_meet(spark):
    names = [("a", "Gasolinera El Norte 5", "GASOLINERA NORTE"), ("b", None, "X"), ("c", " ", None), ("d", "12", "34"), ("e", "PEMEX SUR", "SHELL ESTE"), ("f", "5", "NORTE")]
    now, before = (spark.createDataFrame([(n[0], n[k]) for n in names], "id string, name string") for k in (1, 2))
    drift = masters.name_drift(now, before)
    assert {r.id: (r.overlap, r.name_drift_flag) for r in drift.collect()} == {
        "a": (1.0, False), "b": (0.0, True), "c": (0.0, True), "d": (1.0, False), "e": (0.0, True), "f": (0.0, True)}
    plan = drift.filter("name_drift_flag").select("id")._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert len(joins) == 1 and "regexp" not in joins[0]


def test_price_runs(spark, tmp_path):
    root = f"{tmp_path}/p"
    feed = lambda *rows: spark.createDataFrame(list(rows), FEED)
    prices.price_run(feed((1, "2024-01-01", 20.0, None, 200.0), (1, "2024-01-01", 19.0, None, None), (None, "2024-01-01", 20.0, 1.0, 1.0), (2, None, 20.0, 1.0, 1.0)), root, "1")
    store = Store(spark, root)
    assert prices.read(store, "changes").count() == 0
    for _ in range(2):
        prices.price_run(feed((1, "2024-01-03", 21.0, 22.0, None), (1, "2024-01-01", 30.0, None, None), (3, "2024-01-03", 20.0, None, None)), root, "2")
    prices.price_run(feed(), root, "3")
    prices.price_run(feed((1, "2024-04-30", 20.0, None, None)), root, "4", keep_days=90)
    changes = sorted((str(r.date), r.id, r.fuel, str(r.previous_date), r.previous, r.price, r.direction) for r in prices.read(store, "changes").collect())
    assert changes == [("2024-04-30", 1, "regular", "2024-01-03", 21.0, 20.0, "down")]  # the change of January is older than 90 days
    assert [(r.id, r.price) for r in store.spark.read.parquet(store.path("last", "4")).filter("fuel = 'premium'").collect()] == [(1, 22.0)]
    assert [str(r.date) for r in prices.read(store, "snapshots").collect()] == ["2024-04-30"]
    assert store.runs() == ["1", "2", "3", "4"]
