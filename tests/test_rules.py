"""Boundary values of the rules, worked out by hand."""

import itertools
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fuelspark.functions import fuzzy, geo, text
from fuelspark.functions.fuzzy import indel_ratio, nearest_brand_udf, partial_ratio, token_set_ratio, token_sort_ratio
from fuelspark.operators import anomaly, conform, fleet, matching, scale, spatial, trends
from fuelspark.operators.prices import sane_price
from fuelspark.plans import bindings


def one(spark, expression, **values):
    names = list(values)
    kinds = {str: "string", float: "double", int: "bigint", bool: "boolean"}
    schema = ", ".join(f"{n} {kinds.get(type(v), 'string')}" for n, v in values.items()) or "x int"
    df = spark.createDataFrame([tuple(values.values()) or (1,)], schema)
    del names
    return df.select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "want"), [
    ("Carr. Km 45.5 Norte", "KILOMETRO 45"), ("C 5 DE MAYO", "CALLE 5 DE MAYO"), ("Calle 3 #12 Int 4", "NUMERO 12"), ("Av. Juárez S/N", "SIN NUMERO"), ("   ", None),
])
def test_address(spark, raw, want):
    got = one(spark, text.normalize_address(F.col("a")), a=raw)
    assert got is None if want is None else want in got


@pytest.mark.parametrize(("raw", "want"), [("Gasolinera S.A. DE C.V.", None), ("123", "00123"), ("C.P. 1234", "01234"), ("123456", None), ("", None)])
def test_zip_and_name(spark, raw, want):
    if want is None and raw.startswith("Gas"):
        assert one(spark, text.normalize_name(F.col("a")), a=raw) != raw
    else:
        assert one(spark, text.normalize_zip(F.col("a")), a=raw) == want


@pytest.mark.parametrize(("metres", "want"), [(0.0, 1.0), (250.0, 0.5), (500.0, 0.0), (500.1, 0.4998), (750.0, 0.0), (1000.0, 0.0), (1000.1, 0.0)])
def test_geo_score(spark, metres, want):
    assert one(spark, matching.geo_score(F.col("m")), m=metres) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize(("score", "want"), [(0.85, "auto_match"), (0.8499, "review_queue"), (0.65, "review_queue"), (0.6499, "rejected")])
def test_classes(spark, score, want):
    assert one(spark, matching.classify(F.col("s")), s=score) == want


@pytest.mark.parametrize(("price", "want"), [(5.0, 5.0), (4.99, None), (100.0, 100.0), (100.01, None), (23.456, 23.46)])
def test_sane_price(spark, price, want):
    assert one(spark, sane_price(F.col("p")), p=price) == want


def test_text_ratios():
    assert indel_ratio("abc", "abd") == pytest.approx(200 * 2 / 6) and indel_ratio("", "") == 100
    assert token_sort_ratio("b a", "a b") == 100 and partial_ratio("abc", "xxabcxx") == 100 and token_set_ratio("a b", "a b c") == 100


def priced(spark, prices):
    rows = [(i, f"s{i}", "B", "C", "S", "R", 19.0 + i * 0.001, -99.0, "regular", p) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "id bigint, name string, brand string, city string, state string, region string, lat double, lng double, fuel string, price double")


def test_equal_neighbours_and_the_five_percent_rule(spark):
    """Neighbours of one price: over 5 % away is an anomaly, up to 5 % is not by the z-score."""
    for price, fires in ((21.5, True), (20.5, False)):
        found = anomaly.local_anomalies(priced(spark, [20.0] * 10 + [price]), method="zscore").filter("id = 10").collect()
        assert bool(found) == fires
    assert found == [] or found[0]["direction"] == "high"


def test_three_sigma(spark):
    flags = {r.id: r.is_global_anomaly for r in anomaly.global_outliers(priced(spark, [20.0 + 0.01 * (i % 3) for i in range(40)] + [30.0])).collect()}
    assert flags[40] and not any(v for k, v in flags.items() if k != 40)
    few = {r.id: r.is_global_anomaly for r in anomaly.global_outliers(priced(spark, [20.0] * 9 + [90.0])).collect()}
    assert not any(few.values())  # ten prices are too few


def test_radius_join_equals_all_pairs(spark):
    stations = spark.createDataFrame([(i, 19 + (i * 37 % 100) / 200, -99 + (i * 53 % 97) / 200) for i in range(150)], "id bigint, lat double, lng double")
    got = {(r.id_a, r.id_b) for r in spatial.distance_matrix(stations, 5.0).collect()}
    a, b = stations.alias("a"), stations.alias("b")
    km = geo.haversine_km(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    want = {(r[0], r[1]) for r in a.crossJoin(b).filter(F.floor(km * 100 + 0.5) / 100 <= 5.0).select("a.id", "b.id").collect()}
    assert got == want and all((y, x) in got for x, y in got)


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_salted_join_meets_every_pair_once(spark, hot):
    left = spark.createDataFrame([(i, i % 4 if i % 3 else 0) for i in range(60)], "x bigint, k bigint")
    right = spark.createDataFrame([(i, i % 5 if i % 2 else 0) for i in range(50)], "y bigint, k bigint")
    got = sorted(map(tuple, scale.salted_pairs(left, right, ["k"], "x", hot).select("x", "y").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("x", "y").collect()))


def test_matching_is_one_to_one_and_best_first(spark):
    edges = [("a", "x", 0.9), ("a", "y", 0.95), ("b", "y", 0.99), ("b", "x", 0.86), ("c", "x", 0.9), ("d", "z", 0.84)]
    df = spark.createDataFrame(edges, "id_a string, id_b string, composite double")
    got = {tuple(r) for r in matching.match_one_to_one(df).collect()}
    left, want = sorted(edges, key=lambda e: (-e[2], e[0], e[1])), set()
    taken = set()
    for a, b, s in left:
        if s >= 0.85 and not {a, b} & taken:
            taken |= {a, b}
            want.add((a, b))
    assert got == want


def test_paired_ids_equal_the_sides_of_all_pairs(spark):
    rows = [(f"{'ab'[i % 2]}{i}", "ab"[i % 2], f"m{i % 3}", 19.0 + i * 0.01 if i % 5 else None) for i in range(12)] + [("a99", "a", "alone", 30.0)]
    keys = matching.blocking_keys(spark.createDataFrame(
        [(i, s, "N", None, "A", m, "S", lat, -99.0 if lat else None) for i, s, m, lat in rows],
        "id string, source string, raw_name string, norm_brand string, raw_address string, norm_municipality string, norm_state string, lat double, lng double",
    ).withColumns({"norm_name": F.col("raw_name"), "norm_address": F.col("raw_address")}))
    pairs = matching.candidate_pairs(keys, prune=False).select("id_a", "id_b").collect()
    assert sorted(r.id for r in matching.paired_ids(keys).collect()) == sorted({x for p in pairs for x in p})


def test_pair_counts_meet_by_sums(spark):
    """Counts of records that repeat, lack a cell, block or source, and stand beside other cells; no side is broadcast."""
    draw = random.Random(3)
    rows = [(draw.choice(["x", "y", "z", None]), draw.choice(["m", "n", None]), *draw.choice([(None, None), *itertools.product((5, 6, 7, 9), (1, 2, 4))])) for _ in range(80)]
    keys = spark.createDataFrame(rows, "source string, block string, cell_x bigint, cell_y bigint")
    geo_pairs = both = 0
    for (s, m, x, y), (t, n, v, w) in itertools.combinations(rows, 2):
        if s and t and s != t and x and v and abs(x - v) <= 1 and abs(y - w) <= 1:
            geo_pairs, both = geo_pairs + 1, both + (m is not None and m == n)
    admin = sum(r.pairs for r in matching.admin_block_sizes(keys).collect())
    counts = matching.candidate_counts(keys)
    assert counts.collect() == [(geo_pairs, both, admin, geo_pairs + admin - both)] and both
    assert "Broadcast" not in counts._jdf.queryExecution().executedPlan().toString()
    assert matching.candidate_counts(keys.limit(0)).collect() == [(0, 0, 0, 0)]


def test_brand_of_every_rule(spark):
    df = spark.createDataFrame([("PEMEX",), ("Gasolinera Pemex Centro",), ("HIDROSINNA",), (None,), ("",)], "raw string")
    got = {r.raw: (r.norm_brand, r.conf) for r in conform.canonical_brand(df, "raw", "norm_brand", "conf").collect()}
    assert got["PEMEX"][1] == 1.0 and got["Gasolinera Pemex Centro"][1] == 0.85 and got["HIDROSINNA"][1] == 0.70 and got[None] == (None, 0.0)


def test_trend_needs_three_points(spark):
    rows = [(1, f"2024-01-0{d}", "regular", 20.0 + d) for d in (1, 2)] + [(2, f"2024-01-0{d}", "regular", 20.0 + d) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "id bigint, date string, fuel string, price double").withColumn("date", F.to_date("date"))
    assert {r.id: r.trend for r in trends.trend_direction(df, ["id", "fuel"]).collect()} == {1: "stable", 2: "rising"}


def test_nearest_brand_in_small_batches(spark):
    """Partitions that are empty, all null or of one text, as many partitions make them."""
    rows = [(k, t) for k, t in enumerate(["PEMEXX", None, "PEMEX", None, None, "QQQQQQQQQ", "SHEL"])]
    df = spark.createDataFrame(rows, "k int, t string")
    want = {"PEMEXX": "PEMEX", "PEMEX": "PEMEX", "SHEL": "SHELL"}
    for parts in (1, 3, 20):
        got = df.repartition(parts, "k").select("k", "t", nearest_brand_udf("t").alias("b")).collect()
        assert sorted((r.k, r.b) for r in got) == [(k, want.get(t)) for k, t in rows]
    assert df.filter("k < 0").select(nearest_brand_udf("t")).count() == 0


def test_partial_ratio_equals_all_windows():
    """The best of every window, edges included, by a plain table; and few windows are compared in full."""
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for ch in x:
            before = row[:]
            for j, other in enumerate(y):
                row[j + 1] = before[j] + 1 if ch == other else max(before[j + 1], row[j])
        return row[-1]

    def plain(x, y):
        x, y = sorted((x, y), key=len)
        windows = [y[max(0, e - len(x)):min(e, len(y))] for e in range(1, len(x) + len(y))]
        if len(x) == len(y):
            windows += [x[max(0, e - len(x)):min(e, len(x))] for e in range(1, 2 * len(x))]
        return max(200.0 * max(lcs(x, w), lcs(y, w) if len(x) == len(y) else 0) / (len(x) + len(w)) for w in windows)

    draw = random.Random(5)
    for _ in range(300):
        a, b = ("".join(draw.choice("abcd ") for _ in range(draw.randint(1, 14))) for _ in "ab")
        if len(a) != len(b):
            assert partial_ratio(a, b) == pytest.approx(plain(a, b)), (a, b)
    calls, real = [], fuzzy._lcs
    fuzzy._lcs = lambda *x: calls.append(1) or real(*x)
    try:
        fuzzy.address_similarity("AVENIDA HIDALGO 12 COLONIA CENTRO", "CALLE MORELOS 40 BARRIO SAN JUAN DE LOS LAGOS NORTE")
    finally:
        fuzzy._lcs = real
    assert len(calls) < 50  # of 84 windows


def test_hot_pairs_are_dealt(spark):
    """A key of few rows but many pairs is dealt over salts; every pair still meets once."""
    left = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 99), (None, 5)], "k int, x int")
    right = spark.createDataFrame([(1, i) for i in range(30)] + [(3, 9), (None, 5)], "k int, y int")
    salts = {r.k: (r._salts_a, r._salts_b) for r in scale.hot_keys(left, right, ["k"], 100_000, 100).collect()}
    assert salts == {1: (4, 3)}
    got = sorted(map(tuple, scale.salted_pairs(left, right, ["k"], "x", 100_000, 100).select("x", "y").collect()))
    assert got == [(x, y) for x in range(40) for y in range(30)]


def km(a, b):
    half = [math.sin(math.radians(y - x) / 2) ** 2 for x, y in zip(a, b)]
    h = half[0] + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * half[1]
    return math.floor(2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) * 100 + 0.5) / 100


def test_searches_equal_brute_force_and_meet_few(spark):
    """A crowd, its edge and thin country: the cheapest and nearest of each point, from few of the pairs in reach."""
    draw = random.Random(7)
    at = lambda: (round(19 + draw.random() * (0.15 if draw.random() < 0.8 else 0.5), 4), round(-99.4 + draw.random() * (0.15 if draw.random() < 0.8 else 0.5), 4))
    stations = [(i, *at(), draw.choice([None, *[round(20 + draw.random() * 3, 2) for _ in range(9)]])) for i in range(600)]
    points = [(i, *at()) for i in range(150)]
    s = spark.createDataFrame(stations, "id bigint, lat double, lng double, price double")
    p = spark.createDataFrame(points, "point_id bigint, lat double, lng double")
    reach = {i: [(km((y, x), (b, c)), j, price) for j, b, c, price in stations if km((y, x), (b, c)) <= 10] for i, y, x in points}
    want = set()
    for i, rows in reach.items():
        want |= {(i, "nearest", k + 1, j) for k, (_, j, _) in enumerate(sorted((d, j, 0) for d, j, _ in rows)[:5])}
        want |= {(i, "cheapest", k + 1, j) for k, (_, _, j) in enumerate(sorted((price, d, j) for d, j, price in rows if price is not None)[:5])}
    got = spatial.nearby_rankings(p, s).select("point_id", "ranking", "rank", "id").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    near = sum(map(len, reach.values()))
    assert spatial.cheapest_within(p, s.filter("price is not null"), 10.0, 5).count() < near / 3
    assert spatial.nearest_within(p, s, 10.0, 5).count() < near / 3


def test_distances_and_anomalies_per_coordinate(spark):
    """Many stations at few coordinates: distances are taken between coordinates, results are of all stations."""
    rows = [(i % 40, "B", "C", "S", "R", 19.0 + i % 3 * 0.02, -99.0, "regular", 20.0 + i % 5 * 0.1 + (5 if i == 17 else 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, brand string, city string, state string, region string, lat double, lng double, fuel string, price double").withColumn("name", F.lit("s"))
    pairs = spatial.distance_matrix(df, 3.0)
    want = sorted((a[0], b[0]) for a in rows for b in rows if km((a[5], a[6]), (b[5], b[6])) <= 3)
    assert sorted((r.id_a, r.id_b) for r in pairs.select("id_a", "id_b").collect()) == want
    others = [r for k, r in enumerate(rows) if k != 17 and km((r[5], r[6]), (rows[17][5], rows[17][6])) <= 10]
    found = anomaly.local_anomalies(df).filter("price > 24").collect()
    assert [(r.nearby_count, r.local_avg) for r in found] == [(len(others), math.floor(sum(round(r[8] * 100) for r in others) / len(others) + 0.5) / 100)]
    stats = anomaly._local_statistics(df, 10.0)
    assert stats.groupBy("lat", "lng", "fuel", "price").count().filter("count > 1").isEmpty()


def test_parts_are_not_broadcast(spark, tmp_path):
    """The file of parts is small for its rows; a broadcast of them fills the driver."""
    spark.range(10).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("LARGE").alias("p_type"), F.lit(3).alias("p_size"), F.lit("Brand#1").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    df = bindings.raw_staging(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 10 and "BroadcastHashJoin" not in plan


def test_neighbourhood_histograms_in_tiles(spark, monkeypatch):
    """Statistics of all others within the radius equal brute force when places and their histograms are dealt over many tiles."""
    draw = random.Random(3)
    rows = [(i, round(19 + draw.random() * 0.3, 2), round(-99.3 + draw.random() * 0.3, 2), draw.choice(["regular", "diesel"]), 20 + draw.randrange(12) / 10) for i in range(250)]
    rows += rows[:20] + [(900, None, -99.1, "diesel", 20.0), (901, 25.0, -99.1, "diesel", 20.0)]
    df = spark.createDataFrame(rows, "id bigint, lat double, lng double, fuel string, price double")
    monkeypatch.setattr(anomaly, "TILE_PLACES", 6)
    monkeypatch.setattr(anomaly, "TILE_BINS", 25)
    got = {(r.lat, r.lng, r.fuel, r.price): r for r in anomaly._local_statistics(df, 10.0).collect()}
    want = 0
    for k, (_, lat, lng, fuel, price) in enumerate(rows):
        if lat is None:
            continue
        near = sorted(round(r[4] * 100) for j, r in enumerate(rows) if j != k and r[1] is not None and r[3] == fuel and km((lat, lng), r[1:3]) <= 10)
        if len(near) < 2:
            assert (lat, lng, fuel, price) not in got
            continue
        want, r = want + 1, got[lat, lng, fuel, price]
        assert (r.nearby_count, r._s, r._ss, r._lo, r._hi) == (len(near), sum(near), sum(c * c for c in near), near[0], near[-1])
        for share, q in zip((0.25, 0.75), r._q):
            at = share * (len(near) - 1)
            low, high = near[math.floor(at)], near[math.ceil(at)]
            assert q == pytest.approx(low + (at - math.floor(at)) * (high - low))
    assert want > 200
    places = df.filter("lat is not null").select("lat", "lng").distinct()
    here, around, tile = anomaly._tiles(places, df.filter("lat is not null").groupBy("lat", "lng", "fuel").agg(F.lit(1).alias("n")), 10.0)
    assert here.groupBy(*tile).count().agg(F.max("count")).first()[0] < 30 and here.select("_a", "_b").distinct().count() > 4


def test_corridor_folds_routes_and_stations(spark, monkeypatch):
    """Routes that share points, crowded places and salts: the corridor, its summary and its cheapest equal brute force, folded or not."""
    draw = random.Random(5)
    lines = [[(round(19 + draw.random() * 0.2, 3), round(-99.2 + draw.random() * 0.2, 3)) for _ in range(4)] for _ in range(4)]
    points = [(r, k, *p) for r in range(30) for k, p in enumerate(lines[r % 4])] + [(30, 0, None, -99.0), (30, 1, 19.1, None)]
    places = [(round(19 + draw.random() * 0.2, 3), round(-99.2 + draw.random() * 0.2, 3)) for _ in range(12)]
    priced = [(i, *places[i % 12], round(20 + draw.random(), 2)) for i in range(60)] + [(99, None, -99.1, 1.0)]
    p = spark.createDataFrame(points, "route_id bigint, seq bigint, lat double, lng double")
    s = spark.createDataFrame(priced, "id bigint, lat double, lng double, price double")
    exact = lambda a, b: 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2))
    want = {}
    for r, k, y, x in points:
        for i, b, c, price in priced:
            if k % 2 == 0 and None not in (y, x, b, c) and exact((y, x), (b, c)) <= 8:
                want[r, i] = (price, min(exact((y, x), (b, c)), want.get((r, i), (0, 99))[1]))
    monkeypatch.setattr(spatial, "HOT_PAIRS", 40)
    rows, folded = (spatial.corridor(p, s, 8.0, 2, folded=f) for f in (False, True))
    got = rows.collect()
    assert len(got) == len(want) > 300 and folded.count() < len(want) / 2
    assert all((r.price, r.snap_km) == (want[r.route_id, r.id][0], pytest.approx(want[r.route_id, r.id][1], abs=1e-4)) for r in got)
    of = lambda r: sorted((price, i) for (route, i), (price, _) in want.items() if route == r)
    for form in (rows, folded):
        assert {r.route_id: (r.stations, r.lowest_price) for r in fleet.route_summary(form).collect()} == {r: (len(of(r)), of(r)[0][0]) for r in range(30) if of(r)}
        top = sorted((r.route_id, r["rank"], r.price, r.id) for r in fleet.route_top(form, 3).collect())
        assert top == [(r, k + 1, *x) for r in range(30) for k, x in enumerate(of(r)[:3])]
    assert sorted(fleet.route_summary(rows).collect()) == sorted(fleet.route_summary(folded).collect())


def test_pairs_are_dealt_by_what_rows_stand_for(spark):
    """Few rows that stand for many records each are dealt as their records would be."""
    left, right = (spark.createDataFrame([(1, i, 20) for i in range(4)], f"k int, {n} int, w{n} int") for n in "xy")
    assert scale.hot_keys(left, right, ["k"], 100_000, 400).isEmpty()
    assert [(r._salts_a, r._salts_b) for r in scale.hot_keys(left, right, ["k"], 100_000, 400, ("wx", "wy")).collect()] == [(4, 4)]
    got = sorted(map(tuple, scale.salted_pairs(left, right, ["k"], "x", 100_000, 400, ("wx", "wy")).select("x", "y").collect()))
    assert got == [(x, y) for x in range(4) for y in range(4)]


def test_windows_of_many_pairs_side_by_side(monkeypatch):
    """Scores of a batch are exactly those of its pairs one by one, whatever the lengths; few comparisons are made one by one."""
    draw = random.Random(11)
    text_of = lambda: "".join(draw.choice(draw.choice(["ab", "ABCDEFG HIJKLMNÑOPÉ", "a\U0001f600ñ "])) for _ in range(draw.choice([0, 1, 5, 30, 62, 63, 80])))
    pairs = [(text_of(), text_of()) for _ in range(700)] + [("abc", "x" * 3000 + "ab")]
    least = [draw.choice([0.0, 40.0, 100.0]) for _ in pairs]
    monkeypatch.setattr(fuzzy, "_WINDOWS", 5000)
    assert fuzzy.partial_ratios(pairs, least) == [partial_ratio(*p, x) for p, x in zip(pairs, least)] and fuzzy.partial_ratios([], []) == []
    a = pd.Series(["GASOLINERA LA LOMA", None, "SHELL NORTE 12"] * 2)
    b = pd.Series(["EST DE SERV LOMA ALTA", "X", "SHEL NTE 21 SUR"] * 2)
    calls, real = [], fuzzy._best_window
    monkeypatch.setattr(fuzzy, "_best_window", lambda *x: calls.append(1) or real(*x))
    for similarity in (fuzzy.name_similarity, fuzzy.address_similarity):
        monkeypatch.setattr(fuzzy, "_SEEN", {})
        got = fuzzy._score_batch(a, b, similarity)
        assert not calls and got.isna().tolist() == [False, True, False] * 2
        assert got.dropna().tolist() == [similarity(x, y) / 100.0 for x, y in zip(a, b) if x]
        calls.clear()


def test_long_texts_and_words_are_compared_side_by_side(monkeypatch):
    """Texts of several machine words, and the ratios of words in order, are those of pairs one by one, without any call for one."""
    draw = random.Random(13)
    word = lambda: "".join(draw.choice("abcñ😀") for _ in range(draw.randint(1, 9)))
    text_of = lambda: " ".join(word() for _ in range(draw.choice([1, 2, 12, 20, 30])))[: draw.choice([63, 64, 65, 128, 129, 256])]
    pairs = [(text_of(), text_of()) for _ in range(300)]
    pairs += [(a, a[1:] + " " + b) for a, b in pairs[:40]] + [(" ".join(reversed(a.split())), a) for a, _ in pairs[:20]]
    pairs = [(a[:256], b[:256]) for a, b in pairs]
    want = {f: [f(*p) for p in pairs] for f in (fuzzy.name_similarity, fuzzy.address_similarity)}
    real = fuzzy._lcs
    calls = []
    monkeypatch.setattr(fuzzy, "_lcs", lambda *x: calls.append(1) or real(*x))
    for similarity in want:
        monkeypatch.setattr(fuzzy, "_SEEN", {})
        got = fuzzy._score_batch(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]), similarity)
        assert got.tolist() == [x / 100.0 for x in want[similarity]]
    assert not calls


def test_candidates_by_what_brands_leave_open(spark):
    """Candidates of every distance, brand and missing field are all pairs that can reach review; records of one cell or block
    that are too far apart for their brands are left out before distances are taken, and meet once."""
    draw = random.Random(17)
    rows = [(
        f"{k % 140:03}", draw.choice(["cre", "osm", "denue", "x"]), *draw.choice([(19 + draw.random() * 0.02, -99 + draw.random() * 0.02)] * 9 + [(None, None)]), draw.choice(["N", None]), draw.choice(["P", "S", None]),
        draw.choice(["A", None]), draw.choice(["JALISCO", None]), draw.choice(["TALA", "X", None])) for k in range(150)]
    names = "id string, source string, lat double, lng double, norm_name string, norm_brand string, norm_address string, norm_state string, norm_municipality string"
    keys = matching.blocking_keys(spark.createDataFrame(rows, names).withColumns({"raw_name": F.lit(None).cast("string"), "raw_address": F.lit(None).cast("string")})).cache()
    columns = ["id_a", "id_b", "source_a", "name_key_b", "distance_m", "geo_score", "brand_score", "source_score"]
    for found in (matching.geo_pairs, matching.admin_pairs, lambda k, **x: matching.admin_pairs(k, apart=True, **x), matching.candidate_pairs):
        want = found(keys, prune=False).filter(matching.can_reach_review()).select(columns)
        got = found(keys).select(columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.filter("id_a >= id_b").isEmpty()
    assert matching.geo_pairs(keys).count() > 50
    brands = spark.createDataFrame([(*x, *y) for x, y in itertools.product(((0.0, 0.0, "P"),), ((0.0019, 0.0, "S"), (0.002, 0.0, "S"), (0.0, 0.0067, "P"), (0.0, 0.009, "P"), (0.0, 0.005, None)))],
                                   "a double, b double, c string, d double, e double, f string")
    place = lambda lat, lng, brand: F.struct(F.col(lat).alias("lat"), F.col(lng).alias("lng"), F.col(brand).alias("norm_brand"))
    near = brands.select(place("a", "b", "c").alias("x"), place("d", "e", "f").alias("y")).select(matching._within_reach().alias("v"))
    assert [r.v for r in near.collect()] == [True, False, True, False, True]


def test_no_repeated_rows_are_broadcast(spark, tmp_path):
    """Rows repeated over cells count as one for the optimizer; none of them, nor what they meet, goes through the driver. What
    is broadcast is a row per fuel, or per key that is dealt over salts."""
    def stored(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    priced = stored("priced", [(i, "regular", 20.0 + i % 7, 19 + i % 5 * 0.01, -99 + i % 6 * 0.01, i % 9 == 0) for i in range(60)],
                    "id bigint, fuel string, price double, lat double, lng double, is_anomaly boolean")
    points = stored("points", [(i, 19 + i * 0.002, -99.0) for i in range(20)], "point_id bigint, lat double, lng double")

    def broadcasts(df):
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        joins = [x.split("BroadcastHashJoin ")[1] for x in lines if "BroadcastHashJoin" in x]
        return [x for x in joins if not x.startswith("[fuel#") or "LeftSemi" not in x]

    assert broadcasts(anomaly.local_anomalies(priced.drop("is_anomaly"))) == []
    for found in (spatial.nearest_cheapest(points, priced), spatial.cheaper_alternatives(priced)):
        assert all("LeftOuter" in x for x in broadcasts(found))
    left, right = (stored(n, [(1, i) for i in range(9)], f"k int, {n} int") for n in "xy")
    assert all("LeftOuter" in x for x in broadcasts(scale.salted_pairs(left, right, ["k"], "x", 100, 100)))


def _blocking_rows(spark):
    rows = []
    for k in range(30):
        source, here = ("cre", "osm", "denue")[k % 3], k % 5 != 0
        rows.append((
            f"{source}_{k:03}", source, 19.0 + (k % 7) * 0.0031 if here else None, -99.0 - (k % 4) * 0.0033 if here else None, "PEMEX CENTRO" if k % 4 else None,
            "PEMEX" if k % 2 else None, "CALLE UNO 5" if k % 3 else None, "JALISCO", "TALA"))
    names = "id string, source string, lat double, lng double, norm_name string, norm_brand string, norm_address string, norm_state string, norm_municipality string"
    return matching.blocking_keys(spark.createDataFrame(rows, names).withColumns({"raw_name": F.lit(None).cast("string"), "raw_address": F.lit(None).cast("string")}))


def test_pruned_pairs_are_all_that_can_reach_review(spark):
    keys = _blocking_rows(spark)
    want = matching.candidate_pairs(keys, prune=False).filter(matching.can_reach_review())
    got = matching.candidate_pairs(keys)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    reasons = {(r.reason, r.distance_m is None) for r in got.collect()}
    assert {("geohash", False), ("admin", True)} <= reasons


def test_a_pair_computes_its_distance_in_few_places(spark):
    plan = matching.geo_pairs(_blocking_rows(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("ATAN2") <= 2


def test_records_that_lack_place_and_text_are_not_met(spark, monkeypatch):
    met, real = [], matching.salted_pairs

    def spy(left, right, keys, *more):
        if "_b" in keys:
            met.append((left, right))
        return real(left, right, keys, *more)

    monkeypatch.setattr(matching, "salted_pairs", spy)
    matching.admin_pairs(_blocking_rows(spark))
    (left, right), = met
    text = "{0}.name_key is not null and {0}.addr_key is not null"
    assert left.count() > 0 and left.filter("not (" + text.format("x") + ")").count() == 0
    assert right.filter("not (" + text.format("y") + ")").count() == 0


def test_all_blocked_pairs_meet_as_lists(spark, monkeypatch):
    """Unpruned blocking joins lists of records, dealt by their pairs, and gives each pair of different sources once for each of
    its records' rows: ids that repeat or are null, lost places, blocks and sources included."""
    draw = random.Random(5)
    rows = []
    for k in range(90):
        source, here = draw.choice(["cre", "osm", "denue", None]), draw.random() < 0.8
        lat, lng = (19.0 + draw.randrange(5) * 0.0031, -99.0 - draw.randrange(5) * 0.0063) if here else (None, None)
        block = draw.choice(["S|A", "S|A", "S|B", None])
        rows.append((draw.choice([f"r{k:02}", f"r{k // 2:02}", "r50", None]), source, lat, lng, block))
    rows += rows[:7]
    raw = spark.createDataFrame(rows, "id string, source string, lat double, lng double, block string").repartition(3)
    cells = matching.geohash_cell(F.col("lat"), F.col("lng"), 6)
    none = {c: F.lit(None).cast("string") for c in ("name_key", "norm_brand", "addr_key")}
    keys = raw.withColumns({**none, "cell_x": cells[0], "cell_y": cells[1]})
    records, want = keys.collect(), []
    for x, y in itertools.product(records, records):
        if None in (x.id, y.id, x.source, y.source) or x.source == y.source or x.id >= y.id:
            continue
        placed = x.lat is not None and y.lat is not None
        ring = placed and abs(x.cell_x - y.cell_x) <= 1 and abs(x.cell_y - y.cell_y) <= 1
        if ring or (x.block is not None and x.block == y.block):
            a = placed and math.sin(math.radians(y.lat - x.lat) / 2) ** 2 + math.cos(math.radians(x.lat)) * math.cos(math.radians(y.lat)) * math.sin(math.radians(y.lng - x.lng) / 2) ** 2
            want.append((x.id, y.id, x.source, y.source, "geohash" if ring else "admin", round(12742000 * math.asin(math.sqrt(a)), 1) if placed else None))
    dealt, real = [], matching.salted_pairs
    monkeypatch.setattr(matching, "salted_pairs", lambda *a: dealt.append(a) or real(*a))
    monkeypatch.setattr(matching, "TILE_PAIRS", 200)
    columns = ["id_a", "id_b", "source_a", "source_b", "reason", "distance_m"]
    shown = lambda df, n: sorted(str(tuple(r)) for r in df.select(*columns[:2], *columns[n:]).collect())
    assert len(want) > 300 and shown(matching.candidate_pairs(keys, prune=False), 2) == sorted(map(str, want))
    assert [a[-2:] for a in dealt] == [(200, ("_wa", "_wb"))] * 2
    assert all(left.filter("size(xs) <> _wa").isEmpty() and left.agg(F.max("_wa")).first()[0] > 1 for left, *_ in dealt)
    assert shown(matching.candidate_pairs(keys, prune=False, fields=matching.PLACE), 4) == sorted(str(w[:2] + w[4:]) for w in want)
    changed = F.coalesce(F.col("id") < "r10", F.lit(False))
    some = matching.candidate_pairs(keys.withColumn("changed", changed), prune=False)
    assert shown(some, 2) == sorted(str(w) for w in want if w[0] < "r10")  # the lower id comes first
