"""Conforming, entity resolution, masters and quality rules."""

from pyspark.sql import functions as F

from fuelspark.functions import text
from fuelspark.functions.geo import coordinate_precision, geohash, valid_latitude, valid_longitude
from fuelspark.operators import conform, masters, matching, quality, spatial
from fuelspark.operators.prices import sane_price
from fuelspark.operators.scale import scratch_path
from fuelspark.plans import bindings as b
from fuelspark.plans.catalogue import query, stage
from fuelspark.plans.sqlviews import comparison, geohash as geohash_sql, hav, jr, norm_zip, precision_class

AS_OF = b.AS_OF


def number_of(column):
    """The number in a record's id."""
    return F.substring_index(column, "_", -1).cast("bigint")


# --- conforming -------------------------------------------------------------------------------------


def conformed(spark, d):
    return stage(spark, d, "conformed", lambda: conform.conform_stations(b.raw_staging(spark, d)))


def three_sources(spark, d):
    """The raw records in the layouts of their three sources."""
    raw = b.raw_staging(spark, d).withColumn("n", F.substring_index("id", "_", -1))
    none = lambda c: F.lit(None).cast("string").alias(c)
    cre = raw.filter("source = 'cre'").select(
        F.col("n").alias("place_id"), "cre_id", F.col("raw_name").alias("nombre"), none("razon_social"), F.col("raw_brand").alias("marca"), F.col("raw_address").alias("domicilio"),
        F.col("raw_municipality").alias("municipio"), F.col("raw_state").alias("estado"), F.col("raw_zip").alias("cp"), F.col("lat").alias("latitud"), F.col("lng").alias("longitud"))
    osm = raw.filter("source = 'osm'").select(
        F.lit("node").alias("osm_type"), F.col("n").alias("osm_id"), F.col("raw_name").alias("name"), none("brand"), F.col("raw_brand").alias("operator"), F.col("raw_address").alias("addr_street"),
        F.col("raw_municipality").alias("addr_city"), F.col("raw_state").alias("addr_state"), F.col("raw_zip").alias("addr_postcode"), "lat", "lng")
    denue = raw.filter("source = 'denue'").select(
        F.col("n").alias("denue_id"), none("nom_estab"), F.col("raw_name").alias("raz_social"), none("tipo_vial"), F.col("raw_address").alias("nom_vial"), none("numero_ext"), none("tipo_asent"),
        none("nomb_asent"), F.col("raw_municipality").alias("municipio"), F.col("raw_state").alias("entidad"), F.col("raw_zip").alias("cod_postal"), F.col("lat").alias("latitud"), F.col("lng").alias("longitud"))
    return cre, osm, denue


query("con_01_unified_sources", """SELECT CASE source WHEN 'osm' THEN replace(id,'osm_','osm_node_') ELSE id END id, source, raw_name, CASE WHEN source<>'denue' THEN raw_brand END raw_brand,
 CASE WHEN source='denue' THEN coalesce(raw_address,'') ELSE raw_address END raw_address, raw_municipality, raw_state, raw_zip, lat, lng FROM raw_staging""")(
    lambda s, d: conform.unify_sources(*three_sources(s, d)).select("id", "source", *conform.RAW_FIELDS, "lat", "lng"))
_K = "c_custkey"
query("con_02_valid_coordinates", f"""SELECT {_K} id, CASE WHEN lat<>0 AND lat BETWEEN 14.5328e0 AND 32.7186e0 THEN lat END lat, CASE WHEN lng<>0 AND lng BETWEEN -118.5978e0 AND -86.7104e0 THEN lng END lng
 FROM (SELECT {_K}, ({_K}%80)*0.5e0 lat, -({_K}%260)*0.5e0 lng FROM customer)""")(
    lambda s, d: b.table(s, d, "customer").select(F.col(_K).alias("id"), valid_latitude((F.col(_K) % 80) * 0.5).alias("lat"), valid_longitude(-(F.col(_K) % 260) * 0.5).alias("lng")))
query("con_03_sane_prices", f"SELECT l_orderkey, l_linenumber, CASE WHEN p BETWEEN 5 AND 100 THEN {jr('p', 2)} END price FROM (SELECT l_orderkey, l_linenumber, l_extendedprice/500e0 p FROM lineitem)")(
    lambda s, d: b.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", sane_price(F.col("l_extendedprice") / 500.0).alias("price")))
_ZIP = "CASE c_custkey%4 WHEN 0 THEN 'C.P. '||(c_custkey%99999) WHEN 1 THEN c_custkey::VARCHAR WHEN 2 THEN (c_custkey+1234560)::VARCHAR ELSE 'none' END"
query("con_04_zip_codes", f"SELECT {_K} id, {norm_zip('z')} zip, CASE WHEN length(trim(z))<=5 THEN lpad(trim(z),5,'0') END register_zip FROM (SELECT {_K}, {_ZIP} z FROM customer)")(
    lambda s, d: b.table(s, d, "customer").select(F.col(_K).alias("id"), F.expr(_ZIP.replace("::VARCHAR", "::string")).alias("z")).select(
        "id", text.normalize_zip(F.col("z")).alias("zip"), text.register_zip(F.col("z")).alias("register_zip")))
query("con_05_assembled_address", """SELECT p_partkey id, concat_ws(', ', CASE WHEN nom IS NOT NULL THEN concat_ws(' ', tipo, nom) END, 'No. '||num, CASE WHEN asent IS NOT NULL THEN 'COLONIA '||asent END) address
 FROM (SELECT p_partkey, CASE WHEN p_size%3<>0 THEN 'CALLE' END tipo, CASE WHEN p_size%5<>0 THEN p_name END nom, CASE WHEN p_size%2=0 THEN p_size::VARCHAR END num, CASE WHEN p_size%7<>0 THEN p_brand END asent FROM part)""")(
    lambda s, d: b.table(s, d, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 != 0, "CALLE").alias("tipo_vial"), F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("nom_vial"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).alias("numero_ext"), F.lit("COLONIA").alias("tipo_asent"), F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("nomb_asent")
    ).select("id", conform.full_address().alias("address")))
for number, column in ((6, "norm_name"), (8, "norm_address"), (9, "norm_state"), (10, "norm_municipality")):
    query(f"con_{number:02d}_{column}", f"SELECT id, {column} FROM conformed")(lambda s, d, c=column: conformed(s, d).select("id", c))
query("con_07_comparison_name", f"SELECT id, {comparison('norm_name')} comparison_name FROM conformed")(
    lambda s, d: conformed(s, d).select("id", text.comparison_from_normalized(F.col("norm_name")).alias("comparison_name")))
query("con_11_canonical_brand", "SELECT id, raw_brand, norm_brand FROM conformed")(lambda s, d: conformed(s, d).select("id", "raw_brand", "norm_brand"))
query("con_12_brand_confidence", "SELECT id, brand_confidence FROM conformed")(lambda s, d: conformed(s, d).select("id", "brand_confidence"))
query("con_13_geohash", f"SELECT id, {geohash_sql('lat', 'lng', 6)} geohash6, {geohash_sql('lat', 'lng', 7)} geohash7 FROM raw_staging")(
    lambda s, d: b.raw_staging(s, d).select("id", geohash(F.col("lat"), F.col("lng"), 6).alias("geohash6"), geohash(F.col("lat"), F.col("lng"), 7).alias("geohash7")))
query("con_14_coordinate_precision", f"SELECT master_id, {precision_class('lat', 'lng')} AS \"precision\" FROM masters")(
    lambda s, d: b.masters(s, d).select("master_id", coordinate_precision(F.col("lat"), F.col("lng")).alias("precision")))
query("con_15_content_hash", """SELECT id, sha256(to_json({'lat':lat,'lng':lng,'raw_address':raw_address,'raw_brand':raw_brand,'raw_municipality':raw_municipality,'raw_name':raw_name,'raw_state':raw_state,'raw_zip':raw_zip})) content_hash FROM raw_staging""")(
    lambda s, d: b.raw_staging(s, d).select("id", conform.content_hash().alias("content_hash")))


def versions(spark, d):
    """The records as stored, and a batch that renames one in four, moves one in six and adds none."""
    old = b.raw_staging(spark, d).select("id", "source", "raw_name", "lat", "lng", F.lit(1).alias("batch_version"), F.lit("b1").alias("batch_id"))
    n = F.substring_index("id", "_", -1).cast("bigint")
    new = old.filter(n % 4 == 0).withColumns({
        "raw_name": F.when(n % 8 == 0, F.concat(F.lit("NUEVA "), F.col("raw_name"))).otherwise("X 1"), "lat": F.when(n % 12 == 0, F.col("lat") + 0.01).otherwise(F.col("lat")),
        "batch_version": F.lit(2), "batch_id": F.lit("b2")})
    return old, new


VERSIONS = """old AS (SELECT id, source, raw_name, lat, lng, 1 batch_version, 'b1' batch_id, k FROM raw_staging),
 new AS (SELECT id, source, CASE WHEN k%8=0 THEN 'NUEVA '||raw_name ELSE 'X 1' END raw_name, CASE WHEN k%12=0 THEN lat+0.01e0 ELSE lat END lat, lng, 2 batch_version, 'b2' batch_id, k FROM old WHERE k%4=0)"""
query("con_16_upsert", f"WITH {VERSIONS} SELECT id, raw_name, lat, lng, batch_version FROM new UNION ALL SELECT id, raw_name, lat, lng, batch_version FROM old WHERE k%4<>0")(
    lambda s, d: conform.upsert_latest(*versions(s, d)).select("id", "raw_name", "lat", "lng", "batch_version"))
query("con_17_staging_by_ids", "SELECT id, source FROM raw_staging WHERE k IN (SELECT c_custkey FROM customer)")(
    lambda s, d: conform.staging_by_ids(b.raw_staging(s, d).select("id", "source"), b.table(s, d, "customer").select(
        F.explode(F.array(*[F.concat(F.lit(f"{x}_"), F.lpad(F.col(_K).cast("string"), 12, "0")) for x in ("cre", "osm", "denue")])).alias("id"))))
query("con_17_staging_by_batch", f"WITH {VERSIONS} SELECT id FROM new WHERE source='cre'")(
    lambda s, d: conform.staging_batch(versions(s, d)[0].unionByName(versions(s, d)[1]), "b2", "cre").select("id"))


def repair_input(spark, d):
    k = F.col(_K)
    records = b.table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, 99.0).otherwise(19.0 + (k % 100) / 100.0).alias("lat"), (-99.0 - (k % 90) / 100.0).alias("lng"))
    tries = b.table(spark, d, "customer").select(k.alias("id"), F.posexplode(F.array(*[F.lit(x) for x in (0.0, 0.0005, 0.0002)])).alias("position", "off"))
    return records, tries.select("id", "position", F.when((F.col("position") == 0) & (F.col("id") % 2 == 0), 0.0).otherwise(19.0 + (F.col("id") % 100) / 100.0 + F.col("off")).alias("lat"),
                                 (-99.0 - (F.col("id") % 90) / 100.0).alias("lng"))


query("con_18_coordinate_repair", f"""
 WITH r AS (SELECT {_K} id, CASE WHEN {_K}%3=0 THEN NULL WHEN {_K}%3=1 THEN 99e0 ELSE 19e0+({_K}%100)/100e0 END lat, -99e0-({_K}%90)/100e0 lng FROM customer),
 t AS (SELECT * FROM (SELECT id, p position, CASE WHEN p=0 AND id%2=0 THEN 0e0 ELSE 19e0+(id%100)/100e0+[0e0,0.0005e0,0.0002e0][p+1] END lat, lng FROM r, range(3) x(p)) WHERE lat<>0),
 n AS (SELECT r.id, arg_min(t.lat, ({hav('r.lat', 'r.lng', 't.lat', 't.lng')}, position)) near_lat, min({hav('r.lat', 'r.lng', 't.lat', 't.lng')})*1000 m, arg_min(t.lat, position) first_lat FROM r JOIN t USING(id) GROUP BY 1)
 SELECT id, CASE WHEN lat BETWEEN 14 AND 33 THEN CASE WHEN m<100 THEN near_lat ELSE lat END ELSE coalesce(first_lat, lat) END lat, lng FROM r LEFT JOIN n USING(id)""")(
    lambda s, d: conform.repair_coordinates(*repair_input(s, d)))

# --- blocking and scores ----------------------------------------------------------------------------


def keys(spark, d):
    return stage(spark, d, "keys", lambda: matching.blocking_keys(conformed(spark, d)))


def scored(spark, d):
    return stage(spark, d, "scored", lambda: matching.score_pairs(matching.candidate_pairs(keys(spark, d))))


def accepted(spark, d):
    return stage(spark, d, "accepted", lambda: matching.match_one_to_one(scored(spark, d)))


def decisions(spark, d):
    return stage(spark, d, "decisions", lambda: matching.decide(scored(spark, d), accepted(spark, d)))


def changed(spark, d):
    return b.raw_staging(spark, d).filter(F.substring_index("id", "_", -1).cast("bigint") % 7 == 0).select("id")


PAIR = ["id_a", "id_b"]
query("joi_03_geohash_pairs", "SELECT id_a, id_b, distance_m FROM known_scores WHERE in_ring")(lambda s, d: matching.geo_pairs(keys(s, d), prune=False, fields=matching.PLACE).select(*PAIR, "distance_m"))
query("joi_04_admin_pairs", "SELECT id_a, id_b FROM blocked WHERE in_block")(lambda s, d: matching.admin_pairs(keys(s, d), prune=False, fields=matching.PLACE).select(*PAIR))
query("joi_05_candidate_pairs", "SELECT id_a, id_b, reason FROM candidates")(lambda s, d: matching.candidate_pairs(keys(s, d)).select(*PAIR, "reason"))
query("joi_05_all_blocked_pairs", "SELECT id_a, id_b, CASE WHEN in_ring THEN 'geohash' ELSE 'admin' END reason FROM blocked")(
    lambda s, d: matching.candidate_pairs(keys(s, d), prune=False, fields=matching.PLACE).select(*PAIR, "reason"))
query("joi_05_pair_counts", "SELECT count(*) FILTER (in_ring) geo_pairs, count(*) FILTER (in_ring AND in_block) both_pairs, count(*) FILTER (in_block) admin_pairs, count(*) total_pairs FROM blocked")(
    lambda s, d: matching.candidate_counts(keys(s, d)))
query("joi_06_changed_pairs", "SELECT id_a, id_b FROM candidates WHERE id_a IN (SELECT id FROM raw_staging WHERE k%7=0) OR id_b IN (SELECT id FROM raw_staging WHERE k%7=0)")(
    lambda s, d: matching.changed_pairs(keys(s, d), changed(s, d)).select(*PAIR))
query("er_02_geo_score", "SELECT id_a, id_b, geo_score, distance_m FROM candidates")(lambda s, d: scored(s, d).select(*PAIR, "geo_score", "distance_m"))
query("er_04_brand_score", "SELECT id_a, id_b, brand_score FROM candidates")(lambda s, d: scored(s, d).select(*PAIR, "brand_score"))
query("er_06_source_score", "SELECT id_a, id_b, source_score FROM candidates")(lambda s, d: scored(s, d).select(*PAIR, "source_score"))
query("er_03_distances", f"SELECT id_a, id_b, {jr('m', 1)} distance_m FROM blocked WHERE m IS NOT NULL")(
    lambda s, d: matching.candidate_pairs(keys(s, d).filter("cell_x is not null"), prune=False, fields=matching.PLACE).select(*PAIR, "distance_m"))
SCORES = ["name_score", "geo_score", "brand_score", "address_score", "source_score", "composite"]
query("er_08_scored_pairs", f"SELECT id_a, id_b, {', '.join(SCORES)} FROM scored")(lambda s, d: scored(s, d).select(*PAIR, *SCORES).orderBy(F.desc("composite"), *PAIR))
RESOLUTION = {
    "er_01_name_score": ("SELECT id_a, id_b, name_score FROM scored", lambda s, d: scored(s, d).select(*PAIR, "name_score")),
    "er_05_address_score": ("SELECT id_a, id_b, address_score FROM scored", lambda s, d: scored(s, d).select(*PAIR, "address_score")),
    "er_07_composite": ("SELECT id_a, id_b, composite FROM scored", lambda s, d: scored(s, d).select(*PAIR, "composite")),
    "er_09_classes": ("SELECT id_a, id_b, CASE WHEN composite>=0.85e0 THEN 'auto_match' WHEN composite>=0.65e0 THEN 'review_queue' ELSE 'rejected' END verdict FROM scored",
                      lambda s, d: scored(s, d).select(*PAIR, matching.classify(F.col("composite")).alias("verdict"))),
    "er_10_accepted": ("SELECT id_a, id_b FROM accepted", lambda s, d: accepted(s, d).select(*PAIR)),
    "er_10_decisions": ("SELECT id_a, id_b, decision FROM decisions", lambda s, d: decisions(s, d).select(*PAIR, "decision")),
    "er_11_review_items": ("""SELECT id_a, id_b, composite, greatest(1,least(9,round_even(10-(composite-0.65e0)/(0.85e0-0.65e0)*9,0)))::INT priority, CASE WHEN composite>=0.85e0 THEN 'auto_match' ELSE 'review' END recommendation
 FROM decisions WHERE decision='review_queue'""", lambda s, d: matching.review_items(decisions(s, d)).select(*PAIR, "composite", "priority", "recommendation")),
    "er_13_explanations": ("""SELECT id_a, id_b, CASE WHEN composite>=0.85e0 THEN 'auto' WHEN composite>=0.65e0 THEN 'review' ELSE 'no' END verdict, printf('%.2f', floor(name_score*100+0.5e0)/100) name_value,
 CASE WHEN distance_m IS NULL THEN 'missing' WHEN geo_score>=0.9 THEN 'same location' WHEN geo_score>=0.7 THEN 'very close' WHEN geo_score>=0.5 THEN 'nearby' WHEN geo_score>=0.2 THEN 'moderately distant' ELSE 'far apart' END geo FROM scored""",
                           lambda s, d: matching.explain(decisions(s, d)).select(
                               *PAIR, F.when(F.contains("reason_text", F.lit("is at least 0.85")), "auto").when(F.contains("reason_text", F.lit("is at least")), "review").otherwise("no").alias("verdict"),
                               F.regexp_extract("name_text", "name ([0-9.]+)", 1).alias("name_value"), F.substring_index("geo_text", ": ", -1).alias("geo"))),
    "er_14_summary": ("""SELECT (SELECT count(*) FROM blocked) total, count(*) FILTER (decision='auto_match') auto_matched, count(*) FILTER (decision='review_queue') review_queue,
 (SELECT count(*) FROM blocked)-count(*) FILTER (decision<>'rejected') rejected FROM decisions""", lambda s, d: matching.decision_summary(decisions(s, d), matching.candidate_counts(keys(s, d)))),
    "er_15_masters": ("""SELECT 'mst_'||sha256(id_a||'|'||id_b) master_id, coalesce(nullif(greatest(coalesce(x.cre_id,''),coalesce(y.cre_id,'')),''),NULL) pl_number, floor((least(1e0,composite
 +CASE WHEN x.cre_id IS NOT NULL OR y.cre_id IS NOT NULL THEN 0.1e0 ELSE 0e0 END+CASE WHEN coalesce(x.lat,y.lat) IS NOT NULL THEN 0.03e0 ELSE 0e0 END))*10000+0.5e0)/10000e0 confidence_score
 FROM decisions JOIN conformed x ON x.id=id_a JOIN conformed y ON y.id=id_b WHERE decision='auto_match'""",
                      lambda s, d: masters.masters_from_pairs(decisions(s, d), conformed(s, d), AS_OF).select("master_id", "pl_number", "confidence_score")),
    "er_16_promoted": ("""SELECT 'mst_'||sha256(id) master_id, coalesce(norm_name, raw_name) canonical_name, lat, lng FROM conformed WHERE source='cre'
 AND id NOT IN (SELECT id_a FROM decisions WHERE decision='auto_match' UNION SELECT id_b FROM decisions WHERE decision='auto_match')""",
                       lambda s, d: masters.masters_from_single(masters.unmatched(conformed(s, d), decisions(s, d)), AS_OF).select("master_id", "canonical_name", "lat", "lng")),
}
for _name, (_sql, _function) in RESOLUTION.items():
    query(_name, _sql)(_function)
# --- masters ----------------------------------------------------------------------------------------

query("er_12_primary_side", """SELECT id_a, id_b, CASE WHEN (ra, pa, ea)<=(rb, pb, eb) THEN 'a' ELSE 'b' END side FROM (SELECT id_a, id_b,
 CASE x.source WHEN 'cre' THEN 0 WHEN 'denue' THEN 1 WHEN 'osm' THEN 3 END ra, CASE y.source WHEN 'cre' THEN 0 WHEN 'denue' THEN 1 WHEN 'osm' THEN 3 END rb, (x.cre_id IS NULL)::INT pa, (y.cre_id IS NULL)::INT pb,
 (x.norm_name IS NULL)::INT+(x.norm_brand IS NULL)::INT+(x.norm_address IS NULL)::INT+(x.norm_state IS NULL)::INT+(x.norm_municipality IS NULL)::INT+(x.lat IS NULL)::INT+(x.lng IS NULL)::INT ea,
 (y.norm_name IS NULL)::INT+(y.norm_brand IS NULL)::INT+(y.norm_address IS NULL)::INT+(y.norm_state IS NULL)::INT+(y.norm_municipality IS NULL)::INT+(y.lat IS NULL)::INT+(y.lng IS NULL)::INT eb
 FROM candidates JOIN conformed x ON x.id=id_a JOIN conformed y ON y.id=id_b)""")(
    lambda s, d: scored(s, d).select(*PAIR).join(conformed(s, d).select(F.col("id").alias("id_a"), F.struct("*").alias("a")), "id_a").join(
        conformed(s, d).select(F.col("id").alias("id_b"), F.struct("*").alias("b")), "id_b").select(*PAIR, matching.primary_side().alias("side")))


def confidence_of(m):
    return masters.confidence(F.col("confidence_score"), F.col("pl_number").isNotNull(), F.size("source_ids"), F.col("lat").isNotNull() & F.col("lng").isNotNull(),
                              F.col("last_confirmed_at"), AS_OF, F.col("name_drift_flag"), F.col("review_flag"))


_AGE = f"date_diff('second', last_confirmed_at, TIMESTAMP '{AS_OF}')//86400"
query("er_17_confidence", f"""SELECT master_id, {jr(f'''greatest(0e0,least(1e0,confidence_score+CASE WHEN pl_number IS NOT NULL THEN 0.1e0 ELSE 0e0 END+CASE WHEN n_sources>=3 THEN 0.05e0 ELSE 0e0 END
 +CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN 0.03e0 ELSE 0e0 END+CASE WHEN {_AGE}>90 THEN -0.1e0 WHEN {_AGE}>30 THEN -0.05e0 ELSE 0e0 END+CASE WHEN name_drift_flag THEN -0.05e0 ELSE 0e0 END+CASE WHEN review_flag THEN -0.05e0 ELSE 0e0 END))''', 4)} confidence FROM masters""")(
    lambda s, d: b.masters(s, d).select("master_id", confidence_of(None).alias("confidence")))


def master_batch(spark, d):
    """A batch over the masters: one in three renewed under the same id, one in five new."""
    m = b.masters(spark, d)
    k = F.substring_index("master_id", "_", -1).cast("bigint")
    known = m.filter(k % 3 == 0).withColumns({"canonical_name": F.lit("RENEWED"), "status": F.lit("new"), "pl_number": F.lit("PL/0")})
    return m, known.unionByName(m.filter(k % 5 == 0).withColumns({"master_id": F.concat(F.lit("new_"), "master_id"), "status": F.lit("new")}))


query("er_18_upsert", """SELECT master_id, CASE WHEN k%3=0 THEN 'RENEWED' ELSE canonical_name END canonical_name, status, pl_number FROM masters
 UNION ALL SELECT 'new_'||master_id, canonical_name, 'new', pl_number FROM masters WHERE k%5=0""")(
    lambda s, d: masters.upsert_masters(*master_batch(s, d)).select("master_id", "canonical_name", "status", "pl_number"))
query("er_19_insert_new", "SELECT 'new_'||master_id master_id FROM masters WHERE k%5=0")(lambda s, d: masters.insert_new(*master_batch(s, d), "master_id").select("master_id"))


def hashed(spark, d):
    old, new = versions(spark, d)
    tag = lambda df: df.withColumn("content_hash", F.sha2(F.concat_ws("|", "raw_name", "lat"), 256))
    k = F.substring_index("id", "_", -1).cast("bigint")
    return tag(new.unionByName(old.filter(k % 4 != 0))), tag(old.filter(k % 10 != 0))


HASHED = VERSIONS + """, cur AS (SELECT id, source, raw_name, lat, k FROM new UNION ALL SELECT id, source, raw_name, lat, k FROM old WHERE k%4<>0), prev AS (SELECT * FROM old WHERE k%10<>0),
 cmp AS (SELECT c.id, c.source, p.id IS NULL is_new, coalesce(c.raw_name=p.raw_name AND c.lat IS NOT DISTINCT FROM p.lat, false) same FROM cur c LEFT JOIN prev p USING(id))"""
query("er_20_audit", f"""WITH {HASHED} SELECT source, count(*) records_fetched, count(*) FILTER (is_new) records_new, count(*) FILTER (NOT is_new AND NOT same) records_updated, count(*) FILTER (same) records_unchanged,
 0::BIGINT records_failed, 'b2' batch_id, '{AS_OF}' run_at, 'success' status FROM cmp GROUP BY 1""")(
    lambda s, d: masters.audited(s, "b2", AS_OF, lambda: masters.audit_rows(*hashed(s, d), "b2", AS_OF), scratch_path(s, "audit")).drop("error", "duration_seconds"))
query("er_21_active_masters", "SELECT master_id FROM masters WHERE status='active'")(lambda s, d: masters.active_masters(b.masters(s, d)).select("master_id"))


def reviews(spark, d):
    k = F.col(_K)
    return b.table(spark, d, "customer").select(k.cast("string").alias("id_a"), (k + 1).cast("string").alias("id_b"), (k % 9 + 1).alias("priority"), F.when(k % 3 == 0, "done").otherwise("pending").alias("status"))


query("er_21_pending_reviews", f"SELECT {_K}::VARCHAR id_a, ({_K}+1)::VARCHAR id_b, {_K}%9+1 priority, 'pending' status FROM customer WHERE {_K}%3<>0")(lambda s, d: masters.pending_reviews(reviews(s, d)))


def named_versions(spark, d):
    old, new = versions(spark, d)
    return new.select("id", F.col("raw_name").alias("name"), "lat", "lng"), old.select("id", F.col("raw_name").alias("name"), "lat", "lng")


_TOK = "CASE WHEN {0} IS NULL THEN [] ELSE string_split({0},' ') END"


def _overlap_sql():
    from fuelspark.plans.sqlviews import norm_name
    return f"""WITH {VERSIONS}, t AS (SELECT n.id, n.raw_name AS name, o.raw_name previous_name, {_TOK.format('(' + comparison(norm_name('n.raw_name')) + ')')} a, {_TOK.format('(' + comparison(norm_name('o.raw_name')) + ')')} b FROM new n JOIN old o USING(id))
 SELECT id, name, previous_name, overlap, overlap<0.4e0 name_drift_flag FROM (SELECT id, name, previous_name, {jr('CASE WHEN len(list_distinct(list_concat(a,b)))=0 THEN 1e0 ELSE len(list_intersect(list_distinct(a),list_distinct(b)))/len(list_distinct(list_concat(a,b))) END', 4)} overlap FROM t)"""


query("er_22_name_drift", _overlap_sql())(lambda s, d: masters.name_drift(*named_versions(s, d)).select("id", "name", "previous_name", "overlap", "name_drift_flag"))
query("er_23_changed_ids", f"WITH {HASHED} SELECT id, CASE WHEN is_new THEN 'new' ELSE 'changed' END AS \"change\" FROM cmp WHERE is_new OR NOT same")(lambda s, d: masters.changed_ids(*hashed(s, d)))
query("er_24_coordinate_drift", f"""WITH {VERSIONS} SELECT id, floor(m*10+0.5e0)/10e0 moved_m FROM (SELECT n.id, {hav('o.lat', 'o.lng', 'n.lat', 'n.lng')}*1000 m FROM new n JOIN old o USING(id)) WHERE m>200""")(
    lambda s, d: masters.coordinate_drift(*named_versions(s, d)))
query("joi_17_nearest_place", f"""SELECT master_id, arg_min(id, (km, id)) place_id, floor(min(km)*10000+0.5e0)/10e0 distance_m FROM (SELECT master_id, s.id, {hav('m.lat', 'm.lng', 's.lat', 's.lng')} km
 FROM masters m JOIN (SELECT c_custkey*3 id, 14e0+((c_custkey*37)%1000)/50e0+0.0003e0 lat, -119e0+((c_custkey*53)%997)/30e0 lng FROM customer WHERE c_custkey%2=0) s ON true WHERE confidence_score<0.7e0) WHERE km<=0.05e0 GROUP BY 1""")(
    lambda s, d: spatial.nearest_place(b.masters(s, d), b.table(s, d, "customer").filter(F.col(_K) % 2 == 0).select(
        (F.col(_K) * 3).alias("place_id"), (14.0 + ((F.col(_K) * 37) % 1000) / 50.0 + 0.0003).alias("lat"), (-119.0 + ((F.col(_K) * 53) % 997) / 30.0).alias("lng"))))

# --- quality rules ----------------------------------------------------------------------------------


def paired(spark, d):
    """Both sides of every pair that blocking meets, each once."""
    return matching.paired_ids(keys(spark, d))


def tables(spark, d):
    return {"masters": b.masters(spark, d), "staging": b.raw_staging(spark, d), "paired_ids": paired(spark, d)}


def issues(spark, d):
    return stage(spark, d, "issues", lambda: quality.run_all(tables(spark, d), quality.Settings(AS_OF), scratch_path(spark, "rules")))


_FAR = "{h}*1000>5000".format(h=hav("a.lat", "a.lng", "b.lat", "b.lng"))
STATE_SQL = ",".join(f"('{s}',{lo}e0,{hi}e0)" for s, (lo, hi) in quality.STATE_LATITUDES.items())
ISSUES = {
    "QA-01": ("high", "SELECT master_id, NULL o FROM (SELECT master_id, count(*) OVER (PARTITION BY pl_number) n FROM masters WHERE pl_number<>'') WHERE n>1"),
    "QA-02": ("high", f"SELECT a.master_id, NULL o FROM masters a JOIN masters b ON a.pl_number=b.pl_number AND a.master_id<>b.master_id AND {_FAR} GROUP BY 1"),
    "QA-03": ("medium", "SELECT master_id, NULL o FROM masters WHERE canonical_brand IS NOT NULL AND n_sources>=3 AND confidence_score<0.7"),
    "QA-04": ("high", "SELECT master_id, NULL o FROM masters WHERE lat NOT BETWEEN 14.5328 AND 32.7186 OR lng NOT BETWEEN -118.5978 AND -86.7104"),
    "QA-05": ("medium", f"SELECT master_id, NULL o FROM masters JOIN (VALUES {STATE_SQL}) s(st,lo,hi) ON st=canonical_state WHERE lng IS NOT NULL AND lat NOT BETWEEN lo AND hi"),
    "QA-06": ("medium", f"SELECT master_id, NULL o FROM masters WHERE status='active' AND last_refreshed_at<TIMESTAMP '{AS_OF}'-INTERVAL 90 DAY"),
    "QA-07": ("high", "SELECT master_id, NULL o FROM masters WHERE coalesce(canonical_name,'')='' OR (lat IS NULL AND lng IS NULL)"),
    "QA-08": ("medium", "SELECT master_id, NULL o FROM masters WHERE name_drift_flag"),
    "QA-09": ("low", "SELECT master_id, NULL o FROM masters WHERE status='active' AND NOT review_flag AND confidence_score<0.5"),
    "QA-10": ("low", f"SELECT NULL master_id, id o FROM raw_staging WHERE source='cre' AND fetched_at<TIMESTAMP '{AS_OF}'-INTERVAL 14 DAY AND id NOT IN (SELECT id_a FROM blocked UNION SELECT id_b FROM blocked)"),
}


NAMES = {
    "QA-01": "duplicate_permits", "QA-02": "distant_permits", "QA-03": "brand_conflicts", "QA-04": "out_of_bounds", "QA-05": "wrong_state", "QA-06": "stale_active",
    "QA-07": "missing_fields", "QA-08": "drifted_names", "QA-09": "low_confidence", "QA-10": "orphans",
}


def _rule(rule_id):
    return lambda s, d: quality.run_rule(rule_id, tables(s, d), quality.Settings(AS_OF)).select("rule", "severity", "master_id", F.col("extra")["record"].alias("record"))


for _id, (_severity, _sql) in ISSUES.items():
    query(f"qa_{_id[3:]}_{NAMES[_id]}", f"SELECT '{_id}' AS \"rule\", '{_severity}' severity, master_id::VARCHAR master_id, o::VARCHAR record FROM ({_sql})")(_rule(_id))
_ALL = " UNION ALL ".join(f"SELECT '{i}' AS \"rule\", '{sev}' severity FROM ({q})" for i, (sev, q) in ISSUES.items())
query("qa_11_severity_totals", f"SELECT count(*) total, {', '.join(f'''count(*) FILTER (severity='{x}') {x}''' for x in ('high', 'medium', 'low'))} FROM ({_ALL})")(lambda s, d: quality.severity_totals(issues(s, d)))
query("qa_12_report", f'SELECT "rule", severity, count(*) issues FROM ({_ALL}) GROUP BY 1,2')(lambda s, d: quality.report(issues(s, d)))


@query("qa_12_csv_report", f'SELECT "rule", severity, count(*) issues FROM ({_ALL}) GROUP BY 1,2')
def csv_report(spark, d):
    path = scratch_path(spark, "quality-report")
    quality.write_report(issues(spark, d), path)
    back = spark.read.option("header", True).csv(f"{path}/issues")
    return back.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("issues"))


query("joi_15_permit_pairs", f"SELECT a.master_id, count(*) others, max(floor({hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}*100+0.5e0)/100) farthest_km FROM masters a JOIN masters b ON a.pl_number=b.pl_number AND a.master_id<>b.master_id AND {_FAR} GROUP BY 1")(
    lambda s, d: quality.run_rule("QA-02", tables(s, d), quality.Settings(AS_OF)).select("master_id", F.col("extra")["others"].cast("bigint").alias("others"), F.col("extra")["distance_km"].cast("double").alias("farthest_km")))
query("joi_16_unpaired", "SELECT id FROM raw_staging WHERE id NOT IN (SELECT id_a FROM blocked UNION SELECT id_b FROM blocked)")(
    lambda s, d: b.raw_staging(s, d).select("id").join(paired(s, d), "id", "left_anti"))
query("set_02_paired_ids", "SELECT id_a id FROM blocked UNION SELECT id_b FROM blocked")(lambda s, d: paired(s, d))
query("set_03_token_sets", f"""SELECT id_a, id_b, len(list_intersect(list_distinct(a),list_distinct(b))) shared, len(list_distinct(list_concat(a,b))) all_tokens FROM (SELECT id_a, id_b, {_TOK.format('name_a')} a, {_TOK.format('name_b')} b FROM candidates)""")(
    lambda s, d: scored(s, d).select(*PAIR, F.size(F.array_intersect(text.tokens(F.col("name_key_a")), text.tokens(F.col("name_key_b")))).cast("bigint").alias("shared"),
                                     F.size(F.array_union(text.tokens(F.col("name_key_a")), text.tokens(F.col("name_key_b")))).cast("bigint").alias("all_tokens")))
