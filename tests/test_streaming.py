"""Streaming jobs over several files: late and out-of-order ones, and a second run."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fuelspark.operators import masters, quality
from fuelspark.streaming import jobs

SNAPSHOT = "id bigint, fuel string, date date, price double"
REPO = Path(__file__).resolve().parents[1]


def land(spark, folder, rows, schema=SNAPSHOT):
    text = schema.replace("date date", "date string").replace("ts timestamp", "ts string")
    df = spark.createDataFrame(rows, text)
    if "date date" in schema:
        df = df.withColumn("date", F.to_date("date"))
    if "ts timestamp" in schema:
        df = df.withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema=SNAPSHOT):
    return spark.readStream.schema(schema).parquet(folder)


def listed(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_snapshots_keep_the_first_batch_and_the_late_rows(spark, tmp_path):
    folder, work = f"{tmp_path}/in", f"{tmp_path}/work"
    land(spark, folder, [(1, "regular", "2024-01-01", 20.0)])
    land(spark, folder, [(2, "regular", "2024-01-01", 21.0)])  # the date's second file in the same batch
    assert listed(jobs.ingest_snapshots(stream(spark, folder), work).select("id")) == [("1",), ("2",)]
    land(spark, folder, [(3, "regular", "2024-01-01", 22.0), (1, "regular", "2024-01-02", 20.5)])
    for _ in range(2):  # the second run has nothing to do
        assert listed(jobs.ingest_snapshots(stream(spark, folder), work).select("id", "date")) == [("1", "2024-01-01"), ("1", "2024-01-02"), ("2", "2024-01-01")]
        assert listed(spark.read.parquet(f"{work}/late").select("id")) == [("3",)]


def test_price_changes_ignore_late_snapshots(spark, tmp_path):
    folder, work = f"{tmp_path}/in", f"{tmp_path}/work"
    land(spark, folder, [(1, "regular", "2024-01-01", 20.0), (1, "regular", "2024-01-03", 21.0), (1, "regular", "2024-01-02", 20.0)])
    first = [("1", "2024-01-03", "20.0", "21.0", "up")]
    columns = ["id", "date", "previous", "price", "direction"]
    assert listed(jobs.price_change_events(stream(spark, folder), work).select(columns)) == first
    land(spark, folder, [(1, "regular", "2024-01-02", 99.0)])  # older than what is known
    assert listed(jobs.price_change_events(stream(spark, folder), work).select(columns)) == first
    land(spark, folder, [(1, "regular", "2024-01-04", 19.0), (2, "regular", "2024-01-04", 30.0)])
    for _ in range(2):
        assert listed(jobs.price_change_events(stream(spark, folder), work).select(columns)) == [*first, ("1", "2024-01-04", "21.0", "19.0", "down")]


def test_rolling_history_keeps_seven_days(spark, tmp_path):
    schema = "ts timestamp, id bigint, fuel string, price double"
    folder, work = f"{tmp_path}/in", f"{tmp_path}/work"
    land(spark, folder, [(f"2024-01-{d:02d} 10:00:00", 1, "regular", 20.0 + d) for d in range(1, 9)], schema)
    assert len(listed(jobs.rolling_history(stream(spark, folder, schema), work))) == 7
    land(spark, folder, [("2024-01-08 12:00:00", 1, "regular", 50.0), ("2024-01-08 09:00:00", 1, "regular", 60.0), ("2024-01-01 09:00:00", 1, "regular", 1.0)], schema)
    got = {r.date.day: r.price for r in jobs.rolling_history(stream(spark, folder, schema), work).collect()}
    assert sorted(got) == [2, 3, 4, 5, 6, 7, 8] and got[8] == 50.0


def test_a_failing_rule_leaves_the_others(spark, tmp_path, monkeypatch):
    def broken(tables, settings):
        return tables["masters"].select("master_id", F.raise_error(F.lit("boom")).cast("string").alias("detail"), F.create_map(F.lit("a"), F.lit("b")).alias("extra"))

    rules = {k: r for k, r in quality.RULES.items() if k in ("QA-07", "QA-08")}
    monkeypatch.setattr(quality, "RULES", dict(rules))
    quality.rule("QA-99", "broken", "low")(broken)
    m = spark.createDataFrame([("m1", "", None, None, True, None)], "master_id string, canonical_name string, lat double, lng double, name_drift_flag boolean, review_reason string")
    got = {r.rule: (r.severity, r.detail) for r in quality.run_all({"masters": m}, quality.Settings("2024-01-31"), f"{tmp_path}/issues").collect()}
    assert set(got) == {"QA-07", "QA-08", "QA-99"} and got["QA-99"][0] == "high" and "boom" in got["QA-99"][1]


def test_a_failed_run_is_audited(spark, tmp_path):
    def work():
        raise ValueError("no feed")

    with pytest.raises(ValueError, match="no feed"):
        masters.audited(spark, "b1", "2024-01-31", work, f"{tmp_path}/audit")
    row = spark.read.parquet(f"{tmp_path}/audit").first()
    assert row.status == "failed" and row.error == "no feed" and row.duration_seconds >= 0


def test_the_rest_stands_without_the_training_data_part():
    """The entry module imports where that part is left out, and keeps every other query."""
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'fuelspark.llm' or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 150 and not [n for n in e.queries() if n.startswith('op1')]\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
