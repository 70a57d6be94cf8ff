"""The station run: fetched records of all registers to staging, matches, masters, quality issues and exports.

The first run, or one asked to be full, conforms and compares everything. Any other run is a refresh: content hashes tell
which records are new or changed; only these are conformed, and only pairs with one of them are blocked and scored. Scores
of other pairs come from the run before. One-to-one matching is then repeated over all pairs, as a changed record can free
one for a record that did not change; it reads identifiers and scores only. The tables of a refresh equal those of a full
run over the same staging records.

All steps are whole-table jobs that leave a table of the store, so a lost executor costs its tasks and a failed run only
itself. Audit rows, also those of failed runs, are appended next to the store's tables.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuelspark.functions.geo import valid_latitude, valid_longitude
from fuelspark.functions.lookups import FUELS
from fuelspark.functions.numeric import clamp01, round4
from fuelspark.jobs.store import Store
from fuelspark.operators import conform, masters, matching, quality
from fuelspark.operators.prices import merge_prices_fallback
from fuelspark.operators.scale import materialize
from fuelspark.sources import exports, zones

DISSOLVED = "its records belong to other masters"
DRIFTED = "name changed between runs"


@dataclass(frozen=True)
class Fetched:
    """Usable records, one per id, with validated coordinates and their content hash; and those without id or source."""

    records: DataFrame
    rejected: DataFrame


def fetched(raw: DataFrame) -> Fetched:
    """Of records with the same id the one fetched last counts, then the one with the larger hash."""
    usable, rejected = zones.split_rejects(raw, F.col("id").isNotNull() & F.col("source").isNotNull())
    hashed = usable.withColumns({"lat": valid_latitude(F.col("lat")), "lng": valid_longitude(F.col("lng"))}).withColumn("content_hash", conform.content_hash())
    packed = hashed.groupBy("id").agg(F.max_by(F.struct(*[c for c in hashed.columns if c != "id"]), F.struct("fetched_at", "content_hash")).alias("_row"))
    return Fetched(packed.select("id", "_row.*"), rejected)


def renewed_staging(old: DataFrame, records: DataFrame, changes: DataFrame) -> DataFrame:
    """The staging table after a fetch: changed records conformed anew, others kept with the time they were last seen."""
    fresh = materialize(conform.conform_stations(materialize(records.join(changes.select("id"), "id", "left_semi"), "changed")), "conformed")
    seen = records.select("id", F.col("content_hash").alias("_hash"), F.col("fetched_at").alias("_seen"))
    kept = old.join(seen, "id", "left").filter("_hash is null or _hash = content_hash")
    kept = kept.withColumn("fetched_at", F.coalesce("_seen", "fetched_at")).select(old.columns)
    return kept.unionByName(fresh.select(old.columns))


def renewed_scores(earlier: DataFrame, keys: DataFrame, changes: DataFrame) -> DataFrame:
    """Scored pairs after a fetch: those without a changed record as they were, the others blocked and scored anew."""
    ids = changes.select("id")
    kept = earlier
    for side in ("id_a", "id_b"):
        kept = kept.join(ids.withColumnRenamed("id", side), side, "left_anti")
    # written aside: scores are long expressions, which the optimizer would copy into every step that reads them
    candidates = materialize(matching.changed_pairs(keys, ids), "candidates")
    fresh = matching.score_pairs(candidates)
    return kept.select(earlier.columns).unionByName(fresh.select(earlier.columns))


def renewed_masters(known: DataFrame, batch: DataFrame, as_of: str) -> DataFrame:
    """Masters after a run. Those whose name has drifted are flagged for review and lose confidence for both; active ones
    that no decision supports any more, as their records went to other masters, become unknown and are flagged."""
    named = lambda df: df.select(F.col("master_id").alias("id"), F.col("canonical_name").alias("name"))
    drift = masters.name_drift(named(batch), named(known)).filter("name_drift_flag").select(F.col("id").alias("master_id"), F.lit(True).alias("_drift"))
    built = batch.select("master_id", F.lit(True).alias("_built"))
    rows = masters.upsert_masters(known, batch).join(drift, "master_id", "left").join(built, "master_id", "left")
    drifted = F.col("_drift").isNotNull()
    gone = F.col("_built").isNull() & (F.col("status") == "active")
    return rows.withColumns({
        "name_drift_flag": F.col("name_drift_flag") | drifted,
        "confidence_score": F.when(drifted, round4(clamp01(F.col("confidence_score") - 0.10))).otherwise(F.col("confidence_score")),
        "review_flag": F.col("review_flag") | drifted | gone,
        "review_reason": F.when(gone, DISSOLVED).when(drifted, DRIFTED).otherwise(F.col("review_reason")),
        "updated_at": F.when(gone, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("updated_at")),
        "status": F.when(gone, "unknown").otherwise(F.col("status")),
    }).select(known.columns)


def priced(rows: DataFrame, prices: DataFrame | None) -> DataFrame:
    """Masters with their prices, by the regulator's place id, else by the permit."""
    place = F.get(F.filter("source_ids", lambda s: s["source"] == "cre"), F.lit(0))["id"]
    keyed = rows.withColumn("cre_place_id", F.regexp_replace(place, "^cre_", ""))
    if prices is None:
        return keyed.withColumns({f: F.lit(None).cast("double") for f in FUELS})
    return merge_prices_fallback(keyed, prices)


def _run(raw: DataFrame, prices: DataFrame | None, store: Store, run: str, before: str | None, as_of: str) -> DataFrame:
    taken = fetched(raw)
    records = store.write("fetched", run, taken.records)
    rejected = store.write("rejected", run, taken.rejected)
    old = store.read("staging", before) if before else None
    if old is None:
        changes = store.write("changes", run, records.select("id", F.lit("new").alias("change")))
        staging = store.write("staging", run, conform.conform_stations(records))
    else:
        changes = store.write("changes", run, masters.changed_ids(records, old))
        staging = store.write("staging", run, renewed_staging(old, records, changes))

    keys = store.write("keys", run, matching.blocking_keys(staging))
    if old is None:
        scored = matching.score_pairs(matching.candidate_pairs(keys))
    else:
        scored = renewed_scores(store.read("decisions", before).drop("decision"), keys, changes)
    scored = materialize(scored, "scored")
    decisions = store.write("decisions", run, matching.decide(scored, matching.match_one_to_one(scored)))

    items = matching.review_items(decisions).withColumns({"status": F.lit("pending"), "run_id": F.lit(run)})
    if before:
        queue = store.read("reviews", before)
        items = queue.unionByName(masters.insert_new(queue, items, "id_a", "id_b"))
    store.write("reviews", run, items)

    batch = masters.build_masters(decisions, staging, as_of).withColumn("review_reason", F.lit(None).cast("string"))
    if before:
        batch = renewed_masters(store.read("masters", before), materialize(batch, "masters"), as_of)
    current = store.write("masters", run, batch)

    tables = {"masters": current, "staging": staging, "paired_ids": matching.paired_ids(keys)}
    quality.run_all(tables, quality.Settings(as_of), store.path("issues", run))
    sold = priced(current, prices)
    exports.write_app_json(sold, store.path("app_json", run))
    exports.write_flat_csv(sold, store.path("flat_csv", run))
    known = old if old is not None else records.limit(0)
    return materialize(masters.audit_rows(records, known, run, as_of, rejected.filter("source is not null")), "audit")


def station_run(raw: DataFrame, root: str, run: str, as_of: str, prices: DataFrame | None = None, full: bool = False) -> Store:
    """One run over all fetched records of the registers, as unified raw records; returns the store of its tables.

    A run that is committed already changes nothing. ``prices`` has place_id, cre_id and a column per fuel.
    """
    store = Store(raw.sparkSession, root)
    if run in store.runs():
        return store
    before = store.before(run)

    def work() -> DataFrame:
        rows = _run(raw, prices, store, run, None if full else before, as_of)
        store.commit(run)
        return rows

    masters.audited(store.spark, run, as_of, work, f"{store.root}/_audit")
    return store


def audit(store: Store) -> DataFrame:
    """Rows of all runs by source, failed ones included."""
    return store.spark.read.parquet(f"{store.root}/_audit")
