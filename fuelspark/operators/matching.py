"""Entity resolution: blocking, scoring, one-to-one decisions and their explanation.

Blocking meets every pair of records of different sources that share a geohash-6 neighbourhood or a
municipality. A pair is kept only if it can still reach the review threshold: distance, brand and source
are known before any text is compared, names and addresses are given their best value, and what stays
below the threshold even so is a rejection without further work. Those rejections are counted from block
sizes, never written out, so a municipality that holds a third of the country does not become a square.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuelspark.functions import text
from fuelspark.functions.fuzzy import address_similarity_udf, name_similarity_udf
from fuelspark.functions.geo import EARTH_KM, geohash_cell, has_valid_point, haversine_km
from fuelspark.functions.lookups import AUTO_MATCH, BOUNDS, NEUTRAL, REVIEW_MIN, SOURCE_RANK, SOURCE_RELIABILITY, WEIGHTS
from fuelspark.functions.numeric import clamp01, js_round, round4
from fuelspark.operators.scale import HOT_PAIRS, HOT_ROWS, cut_lineage, in_parts, materialize, salted_pairs

SCORED_FIELDS = ["id", "source", "lat", "lng", "name_key", "norm_brand", "addr_key", "block", "cell_x", "cell_y"]
# What pairs carry where only records and distances are wanted.
PLACE = ["id", "lat", "lng", "cell_x", "cell_y"]
# Pairs of one block or cell that one task may meet where all are wanted; the larger, the less often lists are repeated.
TILE_PAIRS = 16 * HOT_PAIRS
# Height of a geohash-6 cell, which is less than its width inside the country.
CELL_KM = math.pi * EARTH_KM / (1 << 15)


def blocking_keys(staging: DataFrame) -> DataFrame:
    """What blocking and scoring read of a staging record."""
    ix, iy = geohash_cell(F.col("lat"), F.col("lng"), 6)
    valid = has_valid_point(F.col("lat"), F.col("lng"))
    block = F.when(
        F.col("norm_state").isNotNull(),
        F.concat_ws("|", "norm_state", F.coalesce("norm_municipality", F.lit("__unknown__"))),
    )
    name = F.coalesce(text.comparison_from_normalized(F.col("norm_name")), F.upper(F.coalesce("norm_name", "raw_name")))
    return staging.select(
        "id", "source", F.when(valid, F.col("lat")).alias("lat"), F.when(valid, F.col("lng")).alias("lng"),
        name.alias("name_key"), "norm_brand", F.upper(F.coalesce("norm_address", "raw_address")).alias("addr_key"),
        block.alias("block"), F.when(valid, ix).alias("cell_x"), F.when(valid, iy).alias("cell_y"),
    )


# --- scores -----------------------------------------------------------------------------------------


def distance_m(suffixes=("_a", "_b"), cosines: tuple[Column, Column] | None = None) -> Column:
    """``cosines`` are those of both latitudes, where they are known already."""
    a, b = suffixes
    return haversine_km(F.col(f"lat{a}"), F.col(f"lng{a}"), F.col(f"lat{b}"), F.col(f"lng{b}"), cosines) * 1000.0


def geo_score(metres: Column) -> Column:
    near = F.lit(1.0) - metres / 500.0
    far = F.greatest(F.lit(0.0), F.lit(0.5) - (metres - 500.0) / 500.0)
    score = F.when(metres <= 500.0, near).when(metres <= 1000.0, far).otherwise(0.0)
    return F.when(metres.isNull(), NEUTRAL).otherwise(round4(score))


def brand_score(a: Column, b: Column) -> Column:
    """Of canonical brands; null means unknown."""
    return (
        F.when(a.isNull() & b.isNull(), 0.5).when(a.isNull() | b.isNull(), 0.3).when(a == b, 1.0).otherwise(0.0)
    )


def source_score(a: Column, b: Column) -> Column:
    table = text.literal_map(SOURCE_RELIABILITY)
    value = lambda c: F.coalesce(table[c], F.lit(0.5))
    return round4((value(a) + value(b)) / 2)


def composite(name: Column, geo: Column, brand: Column, address: Column, source: Column) -> Column:
    w = WEIGHTS
    total = name * w["name"] + geo * w["geo"] + brand * w["brand"] + address * w["address"] + source * w["source"]
    return round4(clamp01(total))


def _known_scores(pairs: DataFrame, once: bool) -> DataFrame:
    """Scores that need no text. With ``once`` the distance is an array's only element and so computed once per pair: where
    pairs are filtered by their scores, it would else be written out at each place that names it, and the join become a
    method too long for the JVM to compile."""
    if once:
        both = F.transform(F.array(distance_m()), lambda m: F.struct(geo_score(m).alias("geo"), js_round(m, 1).alias("metres")))
        pairs = pairs.withColumn("_d", F.get(both, F.lit(0)))
        known = {"geo_score": F.col("_d.geo"), "distance_m": F.col("_d.metres")}
    else:
        pairs = pairs.withColumn("_d", distance_m(cosines=(F.col("_cos_a"), F.col("_cos_b")))).drop("_cos_a", "_cos_b")
        known = {"geo_score": geo_score(F.col("_d")), "distance_m": js_round(F.col("_d"), 1)}
    if "norm_brand_a" in pairs.columns:
        brand, source = brand_score(F.col("norm_brand_a"), F.col("norm_brand_b")), source_score(F.col("source_a"), F.col("source_b"))
        known = {"brand_score": brand, "source_score": source, **known}
    return pairs.withColumns(known).drop("_d")


def _best_text(kind: str) -> Column:
    missing = F.col(f"{kind}_key_a").isNull() | F.col(f"{kind}_key_b").isNull()
    return F.when(missing, NEUTRAL).otherwise(1.0)


def can_reach_review() -> Column:
    """True when the composite reaches the review threshold if names and addresses agree fully."""
    best = composite(
        _best_text("name"), F.col("geo_score"), F.col("brand_score"), _best_text("addr"), F.col("source_score")
    )
    return best >= REVIEW_MIN


def score_pairs(pairs: DataFrame) -> DataFrame:
    """All five scores and the composite; pairs come from ``candidate_pairs``."""
    name = name_similarity_udf("name_key_a", "name_key_b")
    address = address_similarity_udf("addr_key_a", "addr_key_b")
    scored = pairs.withColumns({
        "name_score": F.coalesce(round4(name), F.lit(NEUTRAL)),
        "address_score": F.coalesce(round4(address), F.lit(NEUTRAL)),
    })
    parts = ["name_score", "geo_score", "brand_score", "address_score", "source_score"]
    return scored.withColumn("composite", composite(*[F.col(c) for c in parts]))


# --- blocking ---------------------------------------------------------------------------------------


_RING = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
# Of two opposite neighbours one, and the cell itself: all that two records in the same or adjacent cells need to meet once.
_HALF_RING = [o for o in _RING if o >= (0, 0)]


def _meet(
    left: DataFrame, right: DataFrame, keys: dict[str, tuple[Column, Column]], hot_rows: int, hot_pairs: int | None = None
) -> DataFrame:
    """Salted equi-join of two sets of records as structs ``x`` and ``y`` on the given key expressions; where records carry
    ``changed``, pairs without a changed one are left out."""
    marked = "changed" in left.columns
    record = F.struct(*SCORED_FIELDS, *(["changed"] if marked else []))
    x = left.select(record.alias("x"), *[k[0].alias(n) for n, k in keys.items()])
    y = right.select(record.alias("y"), *[k[1].alias(n) for n, k in keys.items()])
    met = salted_pairs(x, y, list(keys), "x.id", hot_rows, hot_pairs).filter("x.source <> y.source")
    return met.filter("x.changed or y.changed") if marked else met


def _as_pairs(met: DataFrame, first: Column, second: Column, prune: bool) -> DataFrame:
    flat = met.select(first.alias("a"), second.alias("b"))
    fields = [c for c in met.select("x.*").columns if c != "changed"]
    flat = flat.select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in ("a", "b") for c in fields])
    flat = _known_scores(flat, prune)
    return flat.filter(can_reach_review()) if prune else flat


def _lists(keys: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Records of each group and source as lists ``rows`` of about 32, as a join holds back all pairs of two lists at once;
    in order, so that a repeated task deals the same."""
    record = F.struct(*fields, F.cos(F.radians("lat")).alias("_cos"), *(["changed"] if "changed" in keys.columns else []))
    dealt = in_parts(keys.filter("id is not null"), [*by, "source"], "id", 32).groupBy(*by, "source", "_part")
    return dealt.agg(F.sort_array(F.collect_list(record)).alias("rows"), F.count(F.lit(1)).alias("n"))


def _meet_lists(left: DataFrame, right: DataFrame, keys: dict[str, tuple[Column, Column]], hot_rows: int) -> DataFrame:
    """What ``_meet`` gives, each pair once in any order, from ``_lists``. Only lists are shuffled and joined; their records
    unfold in place, so a pair costs little more than its row, and none is formed of equal sources. Tasks are dealt by pairs."""
    x = left.select(F.col("rows").alias("xs"), F.col("source").alias("_sx"), "_part", F.col("n").alias("_wa"), *[k[0].alias(n) for n, k in keys.items()])
    y = right.select(F.col("rows").alias("ys"), F.col("source").alias("_sy"), F.col("n").alias("_wb"), *[k[1].alias(n) for n, k in keys.items()])
    spread = x.withColumn("_spread", F.xxhash64("_sx", "_part")).drop("_part")
    met = salted_pairs(spread, y, list(keys), "_spread", hot_rows, TILE_PAIRS, ("_wa", "_wb")).filter("_sx < _sy")
    pairs = met.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y")).filter("x.id <> y.id")
    return pairs.filter("x.changed or y.changed") if "changed" in pairs.select("x.*").columns else pairs


def _in_order() -> tuple[Column, Column]:
    """Of ``x`` and ``y`` the one with the lower id, and the other."""
    low = F.col("x.id") < F.col("y.id")
    return F.when(low, F.col("x")).otherwise(F.col("y")), F.when(low, F.col("y")).otherwise(F.col("x"))


def _adjacent(x: str, y: str) -> Column:
    """In the same or an adjacent cell; ``x`` and ``y`` are patterns of the names of both sides' cells."""
    near = [F.abs(F.col(x.format(c)) - F.col(y.format(c))) <= 1 for c in ("cell_x", "cell_y")]
    return F.coalesce(near[0] & near[1], F.lit(False))


def _around(keys: DataFrame, cell_x: str, cell_y: str, offsets: list[tuple[int, int]] = _RING) -> DataFrame:
    """Every record once per neighbouring cell ``_nx``, ``_ny``: nine times, if not by other ``offsets``."""
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in offsets])
    return keys.withColumn("_o", F.explode(ring)).withColumns(
        {"_nx": F.col(cell_x) + F.col("_o.x"), "_ny": F.col(cell_y) + F.col("_o.y")})


def _reach_km(brand: float) -> float:
    """How far apart records of different sources can be and still reach review, by the score of their brands: names and
    addresses are given their best value, sources the two best ones."""
    best = sum(sorted(SOURCE_RELIABILITY.values())[-2:]) / 2
    given = WEIGHTS["name"] + WEIGHTS["address"] + WEIGHTS["source"] * best + WEIGHTS["brand"] * brand
    geo = (REVIEW_MIN - given) / WEIGHTS["geo"] - 0.001  # for the rounding of scores
    metres = 1000.0 if geo <= 0 else 500.0 + 500.0 * (0.5 - geo) if geo <= 0.5 else 500.0 * (1.0 - geo)
    return metres / 1000.0 + 0.001


def _within_reach() -> Column:
    """What located records must keep to, told before any distance is computed: on a plane as narrow as the country is in its
    north, where no distance is longer than it is, and by what their brands leave open."""
    degrees = lambda brand: (_reach_km(brand) / EARTH_KM * 180.0 / math.pi) ** 2
    a, b = F.col("x.norm_brand"), F.col("y.norm_brand")
    most = F.when(a == b, degrees(1.0)).when(a.isNotNull() & b.isNotNull(), degrees(0.0)).when(a.isNotNull() | b.isNotNull(), degrees(0.3)).otherwise(degrees(0.5))
    high, wide = F.col("x.lat") - F.col("y.lat"), (F.col("x.lng") - F.col("y.lng")) * math.cos(math.radians(BOUNDS[1]))
    return high * high + wide * wide <= most


def _once(same: Column) -> Column:
    """Of records that meet in the half ring: those of one cell meet twice."""
    return (F.col("x.id") < F.col("y.id")) | (~same & (F.col("x.id") > F.col("y.id")))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs with the lower id as ``a``."""
    low = F.col("id_a") < F.col("id_b")
    other = lambda c: {"_a": f"{c[:-2]}_b", "_b": f"{c[:-2]}_a"}[c[-2:]]
    return pairs.select(*[F.when(low, F.col(c)).otherwise(F.col(other(c))).alias(c) if c[-2:] in ("_a", "_b") else c for c in pairs.columns])


def geo_pairs(keys: DataFrame, prune: bool = True, hot_rows: int = HOT_ROWS, fields: list[str] = SCORED_FIELDS) -> DataFrame:
    """Pairs in the same or an adjacent geohash-6 cell. Only one side is repeated over the nine cells. Without ``prune`` they
    carry ``fields``; with fewer than those of scoring, distances are the only scores."""
    located = keys.filter("cell_x is not null")
    on = {"_cx": (F.col("cell_x"), F.col("_nx")), "_cy": (F.col("cell_y"), F.col("_ny"))}
    if not prune:
        lists = _lists(located, ["cell_x", "cell_y"], fields)
        return _as_pairs(_meet_lists(lists, _around(lists, "cell_x", "cell_y"), on, hot_rows), *_in_order(), False)
    met = _meet(located, _around(located, "cell_x", "cell_y", _HALF_RING), on, hot_rows, HOT_PAIRS)
    same = (F.col("x.cell_x") == F.col("y.cell_x")) & (F.col("x.cell_y") == F.col("y.cell_y"))
    return _ordered(_as_pairs(met.filter(_within_reach()).filter(_once(same)), F.col("x"), F.col("y"), True))


def admin_pairs(
    keys: DataFrame, prune: bool = True, hot_rows: int = HOT_ROWS, apart: bool = False, fields: list[str] = SCORED_FIELDS
) -> DataFrame:
    """Pairs in the same state and municipality; with ``prune`` only those that can still match, with ``apart`` only those
    that are no geographic ones.

    Records farther than 1 km apart cannot reach review whatever their texts, so located records meet
    on a grid of at least 1 km inside the municipality. When a position is missing, only equal brands, or
    two unknown ones, can still reach review, so the brand joins the key; and neither a name nor an address may
    be missing as well, so records without one are not met.
    """
    named = keys.filter("block is not null")
    block = (F.col("block"), F.col("block"))
    if not prune:
        lists = _lists(named, ["block"], fields)
        met = _meet_lists(lists, lists, {"_k": block}, hot_rows)
        return _as_pairs(met.filter(~_adjacent("x.{}", "y.{}")) if apart else met, *_in_order(), False)
    # a geohash-6 cell is 0.61 km high and at least 1.02 km wide inside the country: two cells cover 1 km
    coarse = named.filter("cell_x is not null").withColumns(
        {"_gx": F.shiftright("cell_x", 1), "_gy": F.shiftright("cell_y", 1)})
    on = {"_k": block, "_cx": (F.col("_gx"), F.col("_nx")), "_cy": (F.col("_gy"), F.col("_ny"))}
    if apart and max(map(_reach_km, (0.0, 0.3, 0.5))) < CELL_KM:
        # records that are not in adjacent cells are farther apart than any but those of one brand can be
        coarse, on["_b"] = coarse.filter("norm_brand is not null"), (F.col("norm_brand"), F.col("norm_brand"))
    met = _meet(coarse, _around(coarse, "_gx", "_gy", _HALF_RING), on, hot_rows, HOT_PAIRS)
    same = [F.shiftright(f"x.cell_{c}", 1) == F.shiftright(f"y.cell_{c}", 1) for c in "xy"]
    near = _ordered(_as_pairs(met.filter(_within_reach()).filter(_once(same[0] & same[1])), F.col("x"), F.col("y"), True))
    brand = F.coalesce("norm_brand", F.lit("__none__"))
    whole = named.filter("name_key is not null and addr_key is not null")
    lost = whole.filter("cell_x is null")
    met = _meet(lost, whole, {"_k": block, "_b": (brand, brand)}, hot_rows, HOT_PAIRS)
    met = met.filter("y.cell_x is not null or x.id < y.id")  # two lost records meet twice
    low, high = F.col("x.id") < F.col("y.id"), F.col("x.id") >= F.col("y.id")
    first = F.when(low, F.col("x")).otherwise(F.col("y"))
    second = F.when(high, F.col("x")).otherwise(F.col("y"))
    pairs = near.unionByName(_as_pairs(met, first, second, True))
    return pairs.filter(~_adjacent("{}_a", "{}_b")) if apart else pairs


def candidate_pairs(keys: DataFrame, prune: bool = True, hot_rows: int = HOT_ROWS, fields: list[str] = SCORED_FIELDS) -> DataFrame:
    """Union of both strategies; a pair found by both counts as geographic.

    Whether a municipality pair is also a geographic one is read from its cells, so the union needs no
    shuffle to remove duplicates.
    """
    geo = geo_pairs(keys, prune, hot_rows, fields).withColumn("reason", F.lit("geohash"))
    admin = admin_pairs(keys, prune, hot_rows, True, fields)
    return geo.unionByName(admin.withColumn("reason", F.lit("admin")))


def _ring_pairs(groups: DataFrame, within: list[str]) -> Column:
    """Pairs of records of different sources in the same or an adjacent cell that share ``within``, from the sizes ``n`` of
    groups by cell, ``within`` and source. Each group is added to the nine cells around it, so sizes meet by sums: no join,
    the optimizer would take the repeated groups for small and broadcast them."""
    rows = groups.filter(" and ".join(f"{c} is not null" for c in ("cell_x", "cell_y", "source", *within)))
    own = F.when((F.col("_o.x") == 0) & (F.col("_o.y") == 0), F.col("n"))
    here = ["_nx", "_ny", *within]
    sums = _around(rows, "cell_x", "cell_y").groupBy(*here, "source").agg(F.sum(own).alias("own"), F.sum("n").alias("ring"))
    sums = sums.withColumn("own", F.coalesce("own", F.lit(0)))
    # each pair counts from both of its ends
    ends = sums.groupBy(*here).agg((F.sum("own") * F.sum("ring") - F.sum(F.col("own") * F.col("ring"))).alias("ends"))
    return ends.agg((F.coalesce(F.sum("ends"), F.lit(0)) / 2).cast("bigint")).scalar()


def candidate_counts(keys: DataFrame) -> DataFrame:
    """Pairs of either strategy and of both, from block sizes alone."""
    groups = keys.groupBy("cell_x", "cell_y", "block", "source").agg(F.count(F.lit(1)).alias("n"))
    cells = keys.groupBy("cell_x", "cell_y", "source").agg(F.count(F.lit(1)).alias("n"))
    admin = admin_block_sizes(keys).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("admin_pairs"))
    joined = admin.select(
        _ring_pairs(cells, []).alias("geo_pairs"), _ring_pairs(groups, ["block"]).alias("both_pairs"), "admin_pairs")
    return joined.withColumn("total_pairs", F.col("geo_pairs") + F.col("admin_pairs") - F.col("both_pairs"))


def paired_ids(keys: DataFrame) -> DataFrame:
    """Records that blocking meets with a record of another source, told from the sources of their blocks and of
    the cells around them. No pair is written out, and pruning plays no part."""
    def others(groups: DataFrame, on: list[str]) -> DataFrame:
        return groups.groupBy(*on).agg(F.collect_set("source").alias("_sources"))  # a handful of sources

    block = others(keys.filter("block is not null"), ["block"]).withColumnRenamed("_sources", "_in_block")
    located = keys.filter("cell_x is not null").select("cell_x", "cell_y", "source").distinct()
    moved = _around(located, "cell_x", "cell_y").select(F.col("_nx").alias("cell_x"), F.col("_ny").alias("cell_y"), "source")
    ring = others(moved, ["cell_x", "cell_y"]).withColumnRenamed("_sources", "_in_ring")
    seen = keys.join(block, "block", "left").join(ring, ["cell_x", "cell_y"], "left")
    meets = lambda c: F.coalesce(F.exists(c, lambda x: x != F.col("source")), F.lit(False))
    return seen.filter(meets("_in_block") | meets("_in_ring")).select("id")


def admin_block_sizes(keys: DataFrame) -> DataFrame:
    """Records and cross-source pairs of every municipality block, by arithmetic."""
    per_source = keys.filter("block is not null").groupBy("block", "source").agg(F.count(F.lit(1)).alias("n"))
    n, squares = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    return per_source.groupBy("block").agg(n.alias("records"), ((n * n - squares) / 2).cast("bigint").alias("pairs"))


def changed_pairs(keys: DataFrame, changed: DataFrame, prune: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Candidate pairs with at least one changed record.

    Unchanged records that share no block or cell neighbourhood with a changed one are dropped before
    the self-join. What is left is written aside, as every side of the joins starts from it.
    """
    hit = keys.join(changed.select("id").distinct().withColumn("_changed", F.lit(True)), "id", "left")
    hit = hit.withColumn("changed", F.coalesce("_changed", F.lit(False))).drop("_changed")
    touched = hit.filter("changed")
    blocks = touched.select("block").filter("block is not null").distinct()
    cells = _around(touched.filter("cell_x is not null"), "cell_x", "cell_y").select(
        F.col("_nx").alias("cell_x"), F.col("_ny").alias("cell_y")).distinct()
    near = hit.join(cells, ["cell_x", "cell_y"], "left_semi").select(*hit.columns)
    same = hit.join(blocks, "block", "left_semi").select(*hit.columns)
    scope = materialize(near.unionByName(same).dropDuplicates(["id"]), "scope")
    return candidate_pairs(scope, prune, hot_rows)


# --- decisions --------------------------------------------------------------------------------------


def classify(score: Column) -> Column:
    return F.when(score >= AUTO_MATCH, "auto_match").when(score >= REVIEW_MIN, "review_queue").otherwise("rejected")


def match_one_to_one(edges: DataFrame) -> DataFrame:
    """Greedy matching by (composite desc, id_a, id_b), found in rounds.

    In each round the edges that are the best remaining one for both of their ends are accepted, and all
    edges at matched records are dropped. The result is that of the sequential rule, because the order is
    total. Each round is one aggregation per record and is checkpointed to the shared folder.
    """
    rank = F.struct((-F.col("composite")).alias("k"), "id_a", "id_b")
    left = cut_lineage(edges.filter(F.col("composite") >= AUTO_MATCH).select("id_a", "id_b", "composite"))
    accepted = left.limit(0).select("id_a", "id_b")
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("id_a", "id_b")).alias("id"), rank.alias("r"))
        best = ends.groupBy("id").agg(F.min("r").alias("r"))
        mutual = best.groupBy("r.id_a", "r.id_b").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n")
        mutual = cut_lineage(mutual)
        accepted = accepted.unionByName(mutual)
        taken = mutual.select(F.explode(F.array("id_a", "id_b")).alias("id"))
        left = left.join(taken.withColumnRenamed("id", "id_a"), "id_a", "left_anti")
        left = cut_lineage(left.join(taken.withColumnRenamed("id", "id_b"), "id_b", "left_anti").select("id_a", "id_b", "composite"))
    return accepted


def decide(scored: DataFrame, accepted: DataFrame) -> DataFrame:
    """Decision per scored pair: an automatic match that lost its record to a better one goes to review. Only pairs that
    reach the automatic threshold meet the accepted ones, which are shuffled: their number grows with the records."""
    reached = F.coalesce(F.col("composite") >= AUTO_MATCH, F.lit(False))
    won = accepted.withColumn("_won", F.lit(True)).hint("merge")
    held = scored.filter(reached).join(won, ["id_a", "id_b"], "left").withColumn(
        "decision", F.when(F.col("_won").isNull(), "review_queue").otherwise("auto_match")).drop("_won")
    return held.unionByName(scored.filter(~reached).withColumn("decision", classify(F.col("composite"))))


def decision_summary(decisions: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts by decision over all blocked pairs, those rejected without scoring included."""
    named = decisions.agg(
        F.count_if(F.col("decision") == "auto_match").alias("auto_matched"),
        F.count_if(F.col("decision") == "review_queue").alias("review_queue"),
    ).withColumn("total_pairs", counts.select("total_pairs").scalar())
    return named.select(
        F.col("total_pairs").alias("total"), "auto_matched", "review_queue",
        (F.col("total_pairs") - F.col("auto_matched") - F.col("review_queue")).alias("rejected"),
    )


def review_priority(score: Column) -> Column:
    share = (score - REVIEW_MIN) / (AUTO_MATCH - REVIEW_MIN)
    return F.greatest(F.lit(1), F.least(F.lit(9), F.rint(10 - share * 9).cast("int")))


def review_items(decisions: DataFrame) -> DataFrame:
    reason = F.format_string(
        "composite %.4f is %s", "composite",
        F.when(F.col("composite") >= AUTO_MATCH, "an automatic match whose record is taken").otherwise("in the review range"),
    )
    return decisions.filter("decision = 'review_queue'").select(
        "id_a", "id_b", "source_a", "source_b", "composite", review_priority(F.col("composite")).alias("priority"),
        "name_score", "geo_score", "brand_score", "address_score", "distance_m",
        F.when(F.col("composite") >= AUTO_MATCH, "auto_match").otherwise("review").alias("recommendation"),
        reason.alias("review_reason"),
    )


def _band(score: Column, bands: list[tuple[float, str]], last: str) -> Column:
    expr = None
    for low, label in bands:
        expr = F.when(score >= low, label) if expr is None else expr.when(score >= low, label)
    return expr.otherwise(last)


def explain(decisions: DataFrame) -> DataFrame:
    """Wording per dimension, the reason of the decision and the whole record as JSON."""
    c = F.col
    name = F.when(c("name_key_a").isNull() | c("name_key_b").isNull(), "missing").otherwise(
        _band(c("name_score"), [(0.90, "very high"), (0.75, "high"), (0.60, "moderate"), (0.40, "low")], "very low"))
    geo = F.when(c("distance_m").isNull(), "missing").otherwise(
        _band(c("geo_score"), [(0.90, "same location"), (0.70, "very close"), (0.50, "nearby"), (0.20, "moderately distant")], "far apart"))
    brand = (
        F.when(c("norm_brand_a").isNull() & c("norm_brand_b").isNull(), "unknown")
        .when(c("norm_brand_a").isNull() | c("norm_brand_b").isNull(), "partial")
        .when(c("norm_brand_a") == c("norm_brand_b"), "same").otherwise("different")
    )
    address = F.when(c("addr_key_a").isNull() | c("addr_key_b").isNull(), "missing").otherwise(
        _band(c("address_score"), [(0.85, "strong"), (0.65, "good"), (0.45, "moderate")], "weak"))
    verdict = classify(c("composite"))
    reason = F.format_string(
        "composite %.4f %s", "composite",
        F.when(verdict == "auto_match", f"is at least {AUTO_MATCH}")
        .when(verdict == "review_queue", f"is at least {REVIEW_MIN} and below {AUTO_MATCH}")
        .otherwise(f"is below {REVIEW_MIN}"),
    )
    rows = decisions.withColumns({
        "name_text": F.format_string("name %.2f: %s", js_round(F.col("name_score"), 2), name),
        "geo_text": F.format_string("geo %.2f: %s", js_round(F.col("geo_score"), 2), geo),
        "brand_text": F.format_string("brand %.2f: %s", js_round(F.col("brand_score"), 2), brand),
        "address_text": F.format_string("address %.2f: %s", js_round(F.col("address_score"), 2), address),
        "reason_text": reason,
    })
    scores = ["name_score", "geo_score", "brand_score", "address_score", "source_score", "composite", "distance_m"]
    texts = ["name_text", "geo_text", "brand_text", "address_text", "reason_text"]
    weights = F.struct(*[F.lit(v).alias(k) for k, v in WEIGHTS.items()]).alias("weights")
    document = F.to_json(F.struct("id_a", "id_b", "source_a", "source_b", *scores, weights, *texts))
    return rows.select("id_a", "id_b", *texts, document.alias("explanation"))


def primary_side(a: str = "a", b: str = "b") -> Column:
    """'a' or 'b': better source rank, then a regulator identifier, then fewer empty fields, then a."""
    ranks = text.literal_map(SOURCE_RANK)

    def order(side: str) -> Column:
        empty = sum(
            (F.col(f"{side}.{f}").isNull().cast("int") for f in
             ("norm_name", "norm_brand", "norm_address", "norm_state", "norm_municipality", "lat", "lng")), F.lit(0))
        return F.struct(
            F.coalesce(ranks[F.col(f"{side}.source")], F.lit(99)).alias("rank"),
            F.col(f"{side}.cre_id").isNull().cast("int").alias("no_permit"), empty.alias("empty"),
        )

    return F.when(order(a) <= order(b), "a").otherwise("b")
