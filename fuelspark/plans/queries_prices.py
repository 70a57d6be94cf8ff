"""Joins with prices, statistics, rankings, series, filters and fleet queries."""

from pyspark.sql import functions as F

from fuelspark.functions.lookups import FUELS, HOLIDAYS
from fuelspark.functions.numeric import js_round
from fuelspark.operators import anomaly, filters, fleet, prices, spatial, trends
from fuelspark.plans import bindings as b
from fuelspark.plans.catalogue import query, stage
from fuelspark.plans.sqlviews import avg_price, cents, geohash, hav, jr, man, mean, quote, std_cents

AS_OF = b.AS_OF
FLAGSHIP = "agg_02_to_04_in_one_pass"
LAST_DAY = "2024-01-30"
DESCRIPTIVE = ["id", "name", "brand", "city", "state", "region", "lat", "lng"]


# The feed, the snapshots and the anomalies are tables of the daily run: each is written once per input and read by all
# queries that start from it.


def prices_wide(spark, d):
    return stage(spark, d, "prices", lambda: b.prices_wide(spark, d))


def long_prices(spark, d):
    return b.to_long(prices_wide(spark, d), "id")


def snapshots(spark, d):
    return stage(spark, d, "snapshots", lambda: b.snapshots(spark, d))


def merged(spark, d):
    return stage(spark, d, "merged", lambda: prices.merge_prices(b.stations(spark, d), prices_wide(spark, d)))


def priced(spark, d):
    return b.to_long(merged(spark, d), *DESCRIPTIVE)


def anomalies(spark, d):
    return stage(spark, d, "anomalies", lambda: anomaly.local_anomalies(priced(spark, d)))


def dated(df):
    return df.withColumn("date", F.col("date").cast("string"))


def per_fuel(name, sql, function):
    """A query over each fuel in turn: ``{fuel}`` in the SQL, a third argument of the function."""
    text = " UNION ALL ".join(f"SELECT '{f}' fuel, * FROM ({sql.replace('{fuel}', f)})" for f in FUELS)

    def run(spark, d):
        parts = [function(spark, d, f).select(F.lit(f).alias("fuel"), "*") for f in FUELS]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    query(name, text)(run)


# --- joins ------------------------------------------------------------------------------------------

query("joi_01_stations_with_prices", "SELECT id, name, brand, city, state, regular, premium, diesel, has_data FROM merged")(
    lambda s, d: merged(s, d).select("id", "name", "brand", "city", "state", *FUELS, "has_data"))


@query("joi_02_prices_by_place_or_permit", """
 WITH feed AS (SELECT CASE WHEN id%2=0 THEN id::VARCHAR END place_id, CASE WHEN id%2=1 OR id%3=0 THEN 'PL/'||(id+1) END cre_id, regular, premium, diesel FROM pw)
 SELECT master_id, CASE WHEN p.place_id IS NOT NULL THEN p.regular ELSE q.regular END regular, CASE WHEN p.place_id IS NOT NULL THEN p.premium ELSE q.premium END premium,
  CASE WHEN p.place_id IS NOT NULL THEN p.diesel ELSE q.diesel END diesel
 FROM masters m LEFT JOIN feed p ON p.place_id=m.cre_place_id LEFT JOIN feed q ON q.cre_id=m.cre_id""")
def prices_by_place_or_permit(spark, d):
    i = F.col("id")
    feed = prices_wide(spark, d).select(
        F.when(i % 2 == 0, i.cast("string")).alias("place_id"),
        F.when((i % 2 == 1) | (i % 3 == 0), F.concat(F.lit("PL/"), i + 1)).alias("cre_id"), *FUELS)
    return prices.merge_prices_fallback(b.masters(spark, d), feed).select("master_id", *FUELS)


_CHANGE = """SELECT t.id, t.fuel, t.date::VARCHAR "date", t.price, y.price previous, ({ct}-{cy})/100e0 AS change, {pct} pct_change
 FROM snapshots t JOIN snapshots y ON t.id=y.id AND t.fuel=y.fuel AND y.date=t.date-{days}"""


def _change_sql(days):
    ct, cy = cents("t.price"), cents("y.price")
    return _CHANGE.format(ct=ct, cy=cy, days=days, pct=jr(f"(({ct}-{cy})/100e0)/y.price*100", 1))


query("joi_12_day_over_day_change", _change_sql(1))(lambda s, d: dated(trends.price_change(snapshots(s, d), 1)))
query("joi_13_week_over_week_change", _change_sql(7))(lambda s, d: dated(trends.price_change(snapshots(s, d), 7)))

query("joi_14_transactions_with_reference_price", f"""
 SELECT tx_id, vehicle_id, station_id, tx.fuel, charged_price, price reference_price, ({cents('charged_price')}-{cents('price')})/100e0 delta
 FROM tx JOIN prices p ON p.id=tx.station_id AND p.fuel=tx.fuel""")(
    lambda s, d: b.transactions(s, d).join(
        long_prices(s, d).select(F.col("id").alias("station_id"), "fuel", F.col("price").alias("reference_price")), ["station_id", "fuel"]
    ).select("tx_id", "vehicle_id", "station_id", "fuel", "charged_price", "reference_price",
             js_round(F.col("charged_price") - F.col("reference_price"), 2).alias("delta")))

# --- aggregations -----------------------------------------------------------------------------------


def _stats_sql(source, groups):
    c = cents("price")
    q = ", ".join(f"floor(quantile_cont({c}::DOUBLE,{p})+0.5e0)/100e0 {n}" for n, p in prices.PERCENTILES.items())
    return f"""SELECT {groups}, min(price) "min", max(price) "max", {avg_price()} "avg", {q},
 CASE WHEN min(price)=max(price) THEN 0e0 ELSE {jr(std_cents(c) + '/100e0', 3)} END std_dev, count(*) "count" FROM {source} GROUP BY {groups}"""


query("agg_01_price_statistics", _stats_sql("priced", "fuel"))(lambda s, d: prices.price_statistics(long_prices(s, d), "fuel"))
query("agg_01_price_statistics_by_state", _stats_sql("priced", "state, fuel"))(
    lambda s, d: prices.price_statistics(priced(s, d), "state", "fuel"))

_AVG = 'SELECT {g}, {a} "avg", min(price) "min", max(price) "max", count(*) station_count FROM priced GROUP BY {g}'
for name, groups in {"agg_02_by_city": ["city", "state", "fuel"], "agg_03_by_brand": ["brand", "fuel"], "agg_04_by_state": ["state", "fuel"]}.items():
    query(name, _AVG.format(g=", ".join(groups), a=avg_price()))(lambda s, d, g=groups: prices.average_by(priced(s, d), *g))

query("agg_02_to_04_in_one_pass", " UNION ALL BY NAME ".join(
    _AVG.format(g=g, a=avg_price()).replace("SELECT", f"SELECT '{lv}' AS \"level\", {nul},", 1)
    for g, lv, nul in [("fuel, city, state", "city", "NULL::VARCHAR brand"), ("fuel, state", "state", "NULL::VARCHAR brand, NULL::VARCHAR city"),
                       ("fuel, brand", "brand", "NULL::VARCHAR city, NULL::VARCHAR state")]))(
    lambda s, d: prices.averages_by_place_and_brand(priced(s, d)))

query("agg_05_national_summary", f"""
 WITH st AS ({_stats_sql('priced', 'fuel')}), f(fuel) AS (VALUES ('regular'),('premium'),('diesel')),
 t AS (SELECT count(*) total_stations, count(*) FILTER (has_data) stations_with_data, {jr('count(*) FILTER (has_data)/count(*)*100e0')} coverage_pct FROM merged)
 SELECT * FROM f LEFT JOIN st USING(fuel), t""")(lambda s, d: prices.national_summary(merged(s, d)))

query("agg_06_app_statistics", f"""
 SELECT fuel, {avg_price('p.price')} "avg", count(*) "count", min(p.price) "min", max(p.price) "max",
  arg_min(p.id, (p.price, p.id)) FILTER (p.id NOT IN (SELECT id FROM anomalies)) cheapest_id, min(p.price) FILTER (p.id NOT IN (SELECT id FROM anomalies)) cheapest_price
 FROM priced p GROUP BY fuel""")(lambda s, d: prices.app_statistics(priced(s, d), anomalies(s, d)))

query("agg_07_counts", """
 SELECT 'brand' kind, coalesce(brand,'OTRO') AS name, count(*) "count" FROM stations GROUP BY 2 UNION ALL
 SELECT 'state', coalesce(state,'—'), count(*) FROM stations GROUP BY 2 UNION ALL SELECT 'city', coalesce(city,'—'), count(*) FROM stations GROUP BY 2""")(
    lambda s, d: prices.counts_of(b.stations(s, d), "brand", "OTRO").withColumn("kind", F.lit("brand")).unionByName(
        prices.counts_of(b.stations(s, d), "state", "—").withColumn("kind", F.lit("state"))).unionByName(
        prices.counts_of(b.stations(s, d), "city", "—").withColumn("kind", F.lit("city"))))

query("agg_08_anomaly_summary", " UNION ALL ".join(
    [f"SELECT 'total' measure, 'all' AS name, count(*) \"count\" FROM anomalies"] +
    [f"SELECT '{c}', {c}, count(*) FROM anomalies GROUP BY {c}" for c in ("direction", "severity", "city", "brand")]))(
    lambda s, d: anomaly.summary(anomalies(s, d)))

_SPEND = f"""sum({cents('charged_price')}*liters)/100e0 pesos, sum(liters) liters, count(*) tx_count, {jr(f"sum({cents('charged_price')}*liters)/sum(liters)/100e0", 2)} price_per_liter"""
query("agg_09_fleet_spend", f"""
 SELECT 'vehicle' AS "level", vehicle_id, NULL::BIGINT station_id, {_SPEND} FROM tx GROUP BY vehicle_id UNION ALL
 SELECT 'station', NULL, station_id, {_SPEND} FROM tx GROUP BY station_id UNION ALL SELECT 'total', NULL, NULL, {_SPEND} FROM tx""")(
    lambda s, d: fleet.fleet_spend(b.transactions(s, d)))

query("agg_10_best_in_compared_set", """
 SELECT id%10 set_id, fuel, id, price, min(price) OVER (PARTITION BY id%10, fuel) best_price, price=min(price) OVER (PARTITION BY id%10, fuel) is_best FROM prices""")(
    lambda s, d: prices.best_in_set(long_prices(s, d).withColumn("set_id", F.col("id") % 10), "set_id"))

query("agg_14_distinct_lists", "SELECT 'brand' kind, brand AS name FROM stations WHERE brand<>'' AND brand<>'OTRO' GROUP BY 2 UNION ALL SELECT 'state', state FROM stations WHERE state<>'' GROUP BY 2")(
    lambda s, d: prices.distinct_values(b.stations(s, d), "brand", "OTRO").withColumn("kind", F.lit("brand")).unionByName(
        prices.distinct_values(b.stations(s, d), "state").withColumn("kind", F.lit("state"))))


def with_amenities(df):
    return df.withColumn("amenities", F.struct((F.col("id") % 3 == 0).alias("open24h")))


query("agg_15_open_24h", "SELECT count(*) FILTER (id%3=0) open_24h FROM stations")(
    lambda s, d: filters.open_24h_count(with_amenities(b.stations(s, d))))

# --- series -----------------------------------------------------------------------------------------

_RECENT = '(SELECT * FROM snapshots WHERE "date" IN (SELECT DISTINCT "date" FROM snapshots ORDER BY 1 DESC LIMIT {n}))'
query("ts_01_price_history", f'SELECT id, "date"::VARCHAR "date", fuel, price FROM {_RECENT.format(n=7)}')(
    lambda s, d: dated(trends.price_history(snapshots(s, d), 7)))
_DAILY = f'(SELECT "date", fuel, {avg_price()} price FROM {_RECENT.format(n=30)} GROUP BY 1,2)'
query("ts_02_daily_national_average", f'SELECT "date"::VARCHAR "date", fuel, price FROM {_DAILY}')(
    lambda s, d: dated(trends.daily_national_average(snapshots(s, d))))
query("ts_03_moving_average", f"""
 SELECT id, "date"::VARCHAR "date", fuel, price, {mean(f"sum({cents('price')}) OVER w", "count(*) OVER w")} ma FROM snapshots
 WINDOW w AS (PARTITION BY id, fuel ORDER BY "date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")(
    lambda s, d: dated(trends.moving_average(snapshots(s, d), ["id", "fuel"])))


def _fit_sql(source, keys):
    """Least squares by the SQL regression functions."""
    return f"""SELECT {keys}, count(*) n, regr_slope({cents('price')}::DOUBLE, x) slope, regr_intercept({cents('price')}::DOUBLE, x) icept,
 regr_r2({cents('price')}::DOUBLE, x) r2, arg_max(price, x) last_price, avg({cents('price')}) my FROM {source} GROUP BY {keys}"""


def _numbered(source, keys):
    return f'(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY "date")-1 x, row_number() OVER (PARTITION BY {keys} ORDER BY "date" DESC) bk FROM {source})'


def _trend_sql(source, keys):
    return f"""SELECT {keys}, n points, CASE WHEN n<3 OR slope IS NULL THEN 'stable' WHEN slope>2 THEN 'rising' WHEN slope<-2 THEN 'falling' ELSE 'stable' END trend
 FROM ({_fit_sql(f'(SELECT * FROM {_numbered(source, keys)} WHERE bk<=7)', keys)})"""


query("ts_04_trend_direction", _trend_sql("snapshots", "id, fuel"))(lambda s, d: trends.trend_direction(snapshots(s, d), ["id", "fuel"]))
query("ts_05_volatility", f"""SELECT id, fuel, count(*) n, CASE WHEN count(*)<2 OR min(price)=max(price) THEN 0e0 ELSE {jr(std_cents(cents('price')) + '/100e0', 3)} END volatility
 FROM snapshots GROUP BY 1,2""")(lambda s, d: trends.volatility(trends.price_history(snapshots(s, d)), ["id", "fuel"]))
query("ts_06_weekday_pattern", f"""
 SELECT k.id, k.fuel, dd::INT day_of_week, avg_price FROM (SELECT DISTINCT id, fuel FROM snapshots) k CROSS JOIN range(7) r(dd)
 LEFT JOIN (SELECT id, fuel, dayofweek("date") w, {avg_price()} avg_price FROM snapshots GROUP BY 1,2,3) a ON a.id=k.id AND a.fuel=k.fuel AND w=dd""")(
    lambda s, d: trends.weekday_pattern(snapshots(s, d), ["id", "fuel"]))
for falling in (True, False):
    per_fuel(f"ts_07_most_{'improved' if falling else 'worsened'}", f"""
 SELECT * EXCLUDE (fuel) FROM ({_change_sql(7)}) WHERE "date"='{LAST_DAY}' AND fuel='{{fuel}}' AND change{'<' if falling else '>'}0 ORDER BY change {'ASC' if falling else 'DESC'}, id LIMIT 10""",
             lambda s, d, fuel, f=falling: dated(trends.biggest_moves(snapshots(s, d), LAST_DAY, fuel, f)).drop("fuel"))


def _forecast_sql(source, keys):
    r2 = "CASE WHEN n<2 THEN 0e0 ELSE " + jr("coalesce(r2,1e0)", 3) + " END"
    return f"""SELECT {keys}, n data_points, last_price, CASE WHEN n<2 THEN 0e0 ELSE {jr('slope/100e0', 4)} END slope,
 {jr('CASE WHEN n<2 THEN my ELSE icept+slope*n END/100e0', 2)} predicted, {r2} r2, {jr(f'({r2})*least(1e0,n/30e0)*0.8e0', 2)} confidence, trend
 FROM ({_fit_sql(_numbered(source, keys), keys)}) JOIN ({_trend_sql(source, keys)}) t USING({keys})"""


query("ts_08_price_forecast", _forecast_sql("snapshots", "id, fuel"))(
    lambda s, d: trends.forecast(trends.price_history(snapshots(s, d)), ["id", "fuel"]))
query("ts_09_weekly_state_forecast", f"""
 WITH f AS ({_forecast_sql(_DAILY, 'fuel')}) SELECT state, fuel, {jr('(predicted+predicted+slope*7)/2', 2)} avg_predicted, '2024-02-01' week_start, '2024-02-07' week_end, trend, data_points
 FROM (SELECT DISTINCT state, fuel FROM priced) JOIN f USING(fuel)""")(
    lambda s, d: trends.weekly_state_forecast(snapshots(s, d), prices.average_by(priced(s, d), "state", "fuel"), AS_OF))


_HOLIDAYS = ",".join(f"({i},{quote(md)},{quote(n)})" for i, (md, n) in enumerate(HOLIDAYS))
query("ts_10_holiday_pressure", f"""
 WITH h(listed, md, holiday) AS (VALUES {_HOLIDAYS}), dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) "date" FROM orders),
 hits AS (SELECT "date", listed, days_until, holiday FROM (SELECT "date", unnest(range(8)) days_until FROM dates) JOIN h ON md=strftime("date"+days_until::INT,'%m-%d')),
 best AS (SELECT "date", arg_min(days_until, listed) days_until, arg_min(holiday, listed) holiday FROM hits GROUP BY 1)
 SELECT "date"::VARCHAR "date", days_until IS NOT NULL has_alert, days_until::INT days_until, holiday, CASE WHEN days_until<=2 THEN 'high' WHEN days_until<=4 THEN 'medium' WHEN days_until IS NOT NULL THEN 'low' ELSE 'none' END severity,
  CASE WHEN days_until<=2 THEN 12 WHEN days_until<=4 THEN 8 WHEN days_until IS NOT NULL THEN 5 END increase_pct FROM dates LEFT JOIN best USING("date")""")(
    lambda s, d: dated(trends.holiday_pressure(
        b.table(s, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct(), trends.holiday_table(s))))

_ARROW = "CASE WHEN {d}>5 THEN '▲' WHEN {d}<-5 THEN '▼' WHEN {d} IS NOT NULL THEN '→' END"
query("ts_11_change_arrows", f"""
 SELECT id, "date"::VARCHAR "date", fuel, price, previous, {_ARROW.format(d=f"({cents('price')}-{cents('previous')})")} arrow
 FROM (SELECT *, lag(price) OVER (PARTITION BY id, fuel ORDER BY "date") previous FROM snapshots)""")(
    lambda s, d: dated(trends.change_arrows(snapshots(s, d))))
query("ts_11_week_arrow", f"""
 SELECT id, fuel, points, first_price, last_price, CASE WHEN points>=2 THEN {_ARROW.format(d=f"({cents('last_price')}-{cents('first_price')})")} END arrow
 FROM (SELECT id, fuel, count(*) points, arg_min(price, "date") first_price, arg_max(price, "date") last_price FROM {_numbered('snapshots', 'id, fuel')} WHERE bk<=7 GROUP BY 1,2)""")(
    lambda s, d: trends.week_arrow(snapshots(s, d)))
query("ts_12_versus_average", f"""
 SELECT id, fuel, price, "avg", {jr('price-"avg"', 2)} AS "value", {jr('(price-"avg")/"avg"*100', 1)} pct, CASE WHEN price-"avg">0.005e0 THEN 'above' WHEN price-"avg"<-0.005e0 THEN 'below' ELSE 'equal' END direction
 FROM prices JOIN (SELECT fuel, {avg_price()} "avg" FROM prices GROUP BY 1) USING(fuel)""")(lambda s, d: prices.versus_average(long_prices(s, d)))
for name, op, order in (("cheapest", prices.cheapest, "price, id"), ("dearest", prices.dearest, "price DESC, id")):
    per_fuel(f"ts_13_{name}", f"SELECT id, price FROM prices WHERE fuel='{{fuel}}' ORDER BY {order} LIMIT 10",
             lambda s, d, fuel, op=op: op(long_prices(s, d).filter(F.col("fuel") == fuel)).drop("fuel"))
query("ts_14_cheapest_decile", """
 SELECT id, p.fuel, price, v[(len(v)//10)+1] decile_price, price<=v[(len(v)//10)+1] is_cheapest FROM prices p
 JOIN (SELECT fuel, list_sort(list(price)) v FROM prices GROUP BY 1) USING(fuel)""")(lambda s, d: prices.cheapest_decile(long_prices(s, d)))
query("ts_15_price_band", """
 SELECT id, fuel, price, CASE WHEN hi=lo THEN 'flat' WHEN (price-lo)/(hi-lo)<=0.33e0 THEN 'low' WHEN (price-lo)/(hi-lo)<=0.66e0 THEN 'middle' ELSE 'high' END band
 FROM prices JOIN (SELECT fuel, min(price) lo, max(price) hi FROM prices GROUP BY 1) USING(fuel)""")(lambda s, d: prices.price_band(long_prices(s, d)))
query("ts_16_missed_days", """SELECT datediff('day', max("date") FILTER ("date"<=DATE '2024-02-09'), DATE '2024-02-09')::INT missed_days FROM snapshots""")(
    lambda s, d: trends.missed_days(snapshots(s, d), [], "2024-02-10"))
query("ts_16_missed_days_by_station", """
 SELECT id, fuel, datediff('day', max("date") FILTER ("date"<=DATE '2024-01-30'), DATE '2024-01-30')::INT missed_days FROM snapshots GROUP BY 1,2""")(
    lambda s, d: trends.missed_days(snapshots(s, d), ["id", "fuel"], AS_OF))
query("ts_17_freshness", f"""
 SELECT master_id, CASE WHEN ds<1 THEN 'today' WHEN ds<7 THEN 'recent' WHEN ds<80 THEN 'ok' ELSE 'stale' END freshness,
  CASE WHEN ds*24<12 THEN 'fresh' WHEN ds*24<24 THEN 'recent' WHEN ds*24<48 THEN 'aging' ELSE 'stale' END feed_freshness
 FROM (SELECT master_id, date_diff('second', last_confirmed_at, TIMESTAMP '{AS_OF}')/86400e0 ds FROM masters)""")(
    lambda s, d: b.masters(s, d).select(
        "master_id", trends.freshness(F.col("last_confirmed_at"), AS_OF).alias("freshness"),
        trends.feed_freshness(F.col("last_confirmed_at"), AS_OF).alias("feed_freshness")))

# --- anomalies --------------------------------------------------------------------------------------

ANOMALY_COLUMNS = ["id", "name", "brand", "city", "state", "fuel", "price", "local_avg", "z_score", "direction", "nearby_count", "severity"]
query("ano_01_local_anomalies", f"SELECT {', '.join(ANOMALY_COLUMNS)} FROM anomalies")(
    lambda s, d: anomaly.ordered(anomalies(s, d)).select(*ANOMALY_COLUMNS))
query("ano_02_fence_only", f"""SELECT id, fuel, price, {mean('s', 'nearby_count')} local_avg, {jr('z', 2)} z_score, nearby_count FROM judged
 WHERE outside""")(
    lambda s, d: anomaly.local_anomalies(priced(s, d), method="iqr").select("id", "fuel", "price", "local_avg", "z_score", "nearby_count"))
query("ano_03_zscore_only", f"""SELECT id, fuel, price, {mean('s', 'nearby_count')} local_avg, {jr('z', 2)} z_score, nearby_count FROM judged
 WHERE by_z""")(
    lambda s, d: anomaly.local_anomalies(priced(s, d), method="zscore").select("id", "fuel", "price", "local_avg", "z_score", "nearby_count"))
query("ano_04_most_severe", f"""SELECT {', '.join(ANOMALY_COLUMNS)} FROM anomalies
 ORDER BY CASE severity WHEN 'severe' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, abs(z_score) DESC, id, fuel LIMIT 20""")(
    lambda s, d: anomalies(s, d).select(*ANOMALY_COLUMNS).orderBy(
        anomaly.severity_rank(), F.abs("z_score").desc(), "id", "fuel").limit(20))
query("ano_05_global_outliers", f"""
 SELECT id, bool_or(n>10 AND abs({cents('price')}-mu)>3*sd) is_global_anomaly FROM prices JOIN
 (SELECT fuel, count(*) n, sum({cents('price')})/count(*) mu, {std_cents(cents('price'))} sd FROM prices GROUP BY 1) USING(fuel) GROUP BY 1""")(
    lambda s, d: anomaly.global_outliers(long_prices(s, d)))
query("ano_06_tagged_stations", "SELECT id, name, id IN (SELECT id FROM anomalies) is_local_anomaly FROM stations")(
    lambda s, d: anomaly.tag_stations(b.stations(s, d), anomalies(s, d)).select("id", "name", "is_local_anomaly"))

# --- fleet ------------------------------------------------------------------------------------------

_RISK = "least(1e0, delta/4.5e0)"
query("flt_01_card_abuse", f"""
 SELECT tx_id, vehicle_id, station_id, "date"::VARCHAR "date", liters, charged_price, fuel, reference_price, delta, {jr(_RISK, 2)} risk_score,
  CASE WHEN {_RISK}>0.66e0 THEN 'high' WHEN {_RISK}>0.33e0 THEN 'medium' ELSE 'low' END severity, {jr('delta*liters', 2)} total_overcharge
 FROM (SELECT tx.*, price reference_price, ({cents('charged_price')}-{cents('price')})/100e0 delta FROM tx JOIN prices p ON p.id=station_id AND p.fuel=tx.fuel) WHERE delta>1.5""")(
    lambda s, d: dated(fleet.card_abuse(b.transactions(s, d), long_prices(s, d))))
_M = f"(SELECT fuel, {avg_price()} avg_price FROM prices GROUP BY 1)"
query("flt_02_fill_savings", f"""
 SELECT *, {jr('monthly_pesos*12', 2)} annual_pesos, {jr('monthly_usd*12', 2)} annual_usd FROM (SELECT *, {jr('saved_pesos*4', 2)} monthly_pesos, {jr('saved_usd*4', 2)} monthly_usd FROM (
 SELECT *, {jr('saved_pesos/17.5e0', 2)} saved_usd FROM (SELECT id, fuel, price, avg_price, {jr("gap*40", 2)} saved_pesos, {jr('gap/avg_price*100', 1)} percent_saved
 FROM (SELECT *, ({cents('avg_price')}-{cents('price')})/100e0 gap FROM prices JOIN {_M} USING(fuel)))))""")(lambda s, d: fleet.fill_savings(long_prices(s, d)))
query("flt_02_tank_saving", f"""SELECT id, fuel, CASE WHEN (avg_price-price)*50>0.5e0 THEN {jr('(avg_price-price)*50', 2)} END saving FROM prices JOIN {_M} USING(fuel)""")(
    lambda s, d: prices.versus_average(long_prices(s, d)).select("id", "fuel", js_round(fleet.tank_saving(F.col("price"), F.col("avg")), 2).alias("saving")))


def trip_options(spark, d):
    o, k = b.table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("trip_id"), k.alias("option_id"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("distance_km"),
        (20.0 + (k % 100) / 10.0).alias("fuel_price"), F.when(k % 3 != 0, (8 + k % 5).cast("double")).alias("consumption"))


query("flt_03_option_ranking", f"""
 SELECT trip_id, option_id, distance_km, fuel_price, liters, total_cost, {jr('max(total_cost) OVER (PARTITION BY trip_id)-total_cost', 2)} savings_vs_worst FROM (
 SELECT *, {jr('liters*fuel_price', 2)} total_cost FROM (SELECT *, {jr('distance_km*u/100', 2)} liters FROM (
  SELECT o_custkey trip_id, o_orderkey option_id, floor(o_totalprice/1000) distance_km, 20e0+(o_orderkey%100)/10e0 fuel_price, CASE WHEN o_orderkey%3<>0 THEN 8e0+o_orderkey%5 ELSE 10e0 END u FROM orders)))""")(
    lambda s, d: fleet.rank_options(trip_options(s, d)))


def vehicles(spark, d):
    k = F.col("c_custkey")
    return b.table(spark, d, "customer").select(
        F.col("c_nationkey").alias("fleet_id"), (50.0 + k % 200).alias("km_per_day"), (8.0 + k % 7).alias("consumption"), (22.0 + (k % 50) / 10.0).alias("price"))


query("flt_04_fleet_monthly", f"""
 SELECT fleet_id, vehicles, {jr('c', 2)} daily_cost, {jr('c*30', 2)} monthly_cost, {jr(jr('c*30', 2) + '*12', 2)} annual_cost, {jr('l*30', 2)} liters_per_month FROM (
 SELECT fleet_id, count(*) vehicles, sum(floor(l*10000+0.5e0)::BIGINT)/10000e0 l, sum(floor(l*p*10000+0.5e0)::BIGINT)/10000e0 c FROM (
  SELECT c_nationkey fleet_id, (50e0+c_custkey%200)*(8e0+c_custkey%7)/100 l, 22e0+(c_custkey%50)/10e0 p FROM customer) GROUP BY 1)""")(
    lambda s, d: fleet.fleet_monthly(vehicles(s, d)))


def trips(spark, d):
    k = F.col("c_custkey")
    fuel = F.element_at(F.array(*[F.lit(f) for f in FUELS]), (k % 3 + 1).cast("int"))
    return b.table(spark, d, "customer").select(
        k.alias("trip_id"), fuel.alias("fuel"), (100.0 + k % 900).alias("distance_km"), (8.0 + k % 9).alias("km_per_liter"),
        (40.0 + k % 21).alias("tank_liters"), (k % 101).cast("double").alias("level_pct"))


query("flt_05_trip_fill", f"""
 SELECT trip_id, {jr('need', 1)} needed_liters, {jr('fill', 1)} fill_liters, {jr('board*kl')} range_km, CASE WHEN fill>0 THEN {jr('fill*lowest', 2)} END cost_lowest,
  CASE WHEN fill>0 THEN {jr('fill*mean', 2)} END cost_mean, fill<=0 enough FROM (SELECT *, greatest(0e0,need-board) fill FROM (
  SELECT c_custkey trip_id, ['regular','premium','diesel'][c_custkey%3+1] fuel, (100e0+c_custkey%900)/(8e0+c_custkey%9) need, (40e0+c_custkey%21)*((c_custkey%101)/100e0) board, 8e0+c_custkey%9 kl FROM customer)
  LEFT JOIN (SELECT fuel, min(price) lowest, sum({cents('price')})/count(*)/100e0 mean FROM prices GROUP BY 1) USING(fuel))""")(
    lambda s, d: fleet.trip_fill(trips(s, d), long_prices(s, d)))
_LEN = f"""(SELECT route_id, count(*) points, {jr('coalesce(sum(floor(leg*1000000+0.5e0)::BIGINT),0)/1000000e0', 3)} length_km FROM (
 SELECT route_id, {hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} leg FROM route_points WINDOW w AS (PARTITION BY route_id ORDER BY seq)) GROUP BY 1)"""
query("flt_06_route_length", f"SELECT * FROM {_LEN}")(lambda s, d: fleet.route_length(b.route_points(s, d)))


def _corridor_sql(step, snap, strict=False, fuel="{fuel}"):
    return f"""(SELECT route_id, id, price, {jr('min(km)', 4)} snap_km FROM (SELECT r.route_id, p.id, p.price, {hav('r.lat', 'r.lng', 'p.lat', 'p.lng')} km
 FROM route_points r JOIN priced p ON r.seq%{step}=0 AND p.fuel='{fuel}') WHERE km{'<' if strict else '<='}{snap} GROUP BY 1,2,3)"""


def _priced_of(spark, d, fuel="regular"):
    return priced(spark, d).filter(F.col("fuel") == fuel)


def _corridor(spark, d, fuel, snap=5.0, step=8, strict=False, folded=False):
    return spatial.corridor(b.route_points(spark, d), _priced_of(spark, d, fuel).select("id", "lat", "lng", "price"), snap, step, strict, folded)


per_fuel("joi_10_route_corridor", f"SELECT * FROM {_corridor_sql(8, 5)}", _corridor)
per_fuel("joi_10_route_corridor_wide", f"SELECT * FROM {_corridor_sql(8, 20)}", lambda s, d, f: _corridor(s, d, f, 20.0))
per_fuel("joi_10_route_corridor_strict", f"SELECT * FROM {_corridor_sql(10, 5, True)}", lambda s, d, f: _corridor(s, d, f, 5.0, 10, True))
per_fuel("flt_07_route_summary", f"""
 SELECT route_id, count(*) stations, min(price) lowest_price, {jr(f"sum({cents('price')})/count(*)/100e0", 2)} mean_price,
  CASE WHEN count(*)>=2 THEN {jr(f"(sum({cents('price')})/count(*)/100e0-min(price))*50", 2)} ELSE 0e0 END estimated_savings FROM {_corridor_sql(8, 5)} GROUP BY 1""",
         lambda s, d, f: fleet.route_summary(_corridor(s, d, f, folded=True)))
per_fuel("flt_07_route_top", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY price, id) AS \"rank\" FROM {_corridor_sql(8, 5)}) WHERE \"rank\"<=5",
         lambda s, d, f: fleet.route_top(_corridor(s, d, f, folded=True)))
per_fuel("flt_07_route_trip_cost", f"""
 SELECT route_id, "rank", id, price, {jr('length_km/12e0', 2)} needed_liters, {jr('length_km/12e0*price', 2)} trip_cost FROM (
 SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY price, id) AS "rank" FROM {_corridor_sql(10, 5, True)}) JOIN {_LEN} USING(route_id) WHERE "rank"<=3""",
         lambda s, d, f: fleet.route_trip_cost(_corridor(s, d, f, 5.0, 10, True, True), fleet.route_length(b.route_points(s, d))))


def flagged(spark, d):
    """Priced stations with the local anomaly flag."""
    flags = anomalies(spark, d).select("id").distinct().withColumn("is_anomaly", F.lit(True))
    return stage(spark, d, "flagged", lambda: priced(spark, d).join(flags.hint("merge"), "id", "left").fillna(False, ["is_anomaly"]))


query("flt_08_cheaper_alternatives", """
 SELECT * FROM (SELECT a.id, a.fuel, a.price, row_number() OVER (PARTITION BY a.id, a.fuel ORDER BY b.price, b.id)::INT AS "rank", b.id alt_id, b.price alt_price
 FROM priced a JOIN priced b ON a.fuel=b.fuel AND b.price<a.price AND a.id<>b.id AND sqrt(pow(a.lat-b.lat,2)+pow(a.lng-b.lng,2))<0.028e0
 WHERE b.id NOT IN (SELECT id FROM anomalies)) WHERE "rank"<=3""")(lambda s, d: spatial.cheaper_alternatives(flagged(s, d)))


def user_points(spark, d):
    k = F.col("c_custkey")
    return b.table(spark, d, "customer").select(
        k.alias("point_id"), (19.0 + ((k * 29) % 100) / 250.0).alias("lat"), (-99.4 + ((k * 31) % 97) / 240.0).alias("lng"))


POINTS = "points AS (SELECT c_custkey point_id, 19e0+((c_custkey*29)%100)/250e0 lat, -99.4e0+((c_custkey*31)%97)/240e0 lng FROM customer)"
_PKM = jr(hav("o.lat", "o.lng", "s.lat", "s.lng"), 2)
query("joi_09_around_points", f"""WITH {POINTS} SELECT point_id, id, {_PKM} distance_km, {jr(man('o.lat', 'o.lng', 's.lat', 's.lng'), 2)} manhattan_km
 FROM points o JOIN stations s ON {_PKM}<=3""")(lambda s, d: spatial.around_points(user_points(s, d), b.stations(s, d), 3.0))
per_fuel("flt_09_nearest_cheapest", f"""WITH {POINTS}, n AS (SELECT point_id, id, price, {_PKM} distance_km, row_number() OVER (PARTITION BY point_id ORDER BY price, id) k
 FROM points o JOIN priced s ON s.fuel='{{fuel}}' AND {_PKM}<=5 WHERE id NOT IN (SELECT id FROM anomalies)) SELECT point_id, id, price, distance_km FROM n WHERE k=1""",
         lambda s, d, f: spatial.nearest_cheapest(user_points(s, d), flagged(s, d).filter(F.col("fuel") == f).select("id", "lat", "lng", "price", "is_anomaly")))
per_fuel("flt_10_nearby_rankings", f"""WITH {POINTS}, n AS (SELECT point_id, id, {{fuel}} price, {_PKM} distance_km FROM points o JOIN merged s ON {_PKM}<=10),
 r AS (SELECT point_id, 'nearest' ranking, row_number() OVER (PARTITION BY point_id ORDER BY distance_km, id)::INT AS "rank", id, price, distance_km FROM n UNION ALL
  SELECT point_id, 'cheapest', row_number() OVER (PARTITION BY point_id ORDER BY price, distance_km, id)::INT, id, price, distance_km FROM n WHERE price IS NOT NULL) SELECT * FROM r WHERE "rank"<=5""",
         lambda s, d, f: spatial.nearby_rankings(user_points(s, d), merged(s, d).select("id", "lat", "lng", F.col(f).alias("price"))))
per_fuel("flt_11_station_cards", f"""
 WITH n AS (SELECT a.id, b.id nb, b.{{fuel}} price, row_number() OVER (PARTITION BY a.id ORDER BY {jr(hav('a.lat', 'a.lng', 'b.lat', 'b.lng'), 2)}, b.id) k
  FROM merged a JOIN merged b ON a.id<>b.id AND {jr(hav('a.lat', 'a.lng', 'b.lat', 'b.lng'), 2)}<=5),
 c AS (SELECT id, count(*) nearby, arg_min(nb,(price,nb)) FILTER (price IS NOT NULL) cheapest_id, min(price) cheapest_price, arg_min(nb,(-price,nb)) FILTER (price IS NOT NULL) dearest_id, max(price) dearest_price FROM n WHERE k<=5 GROUP BY 1),
 m AS (SELECT {avg_price('{fuel}')} national_avg FROM merged)
 SELECT id, {{fuel}} price, coalesce(nearby,0)::INT nearby, cheapest_id, cheapest_price, dearest_id, dearest_price, national_avg, {jr('{fuel}-national_avg', 2)} vs_national FROM merged LEFT JOIN c USING(id), m""",
         lambda s, d, f: spatial.station_cards(merged(s, d).select("id", "lat", "lng", F.col(f).alias("price"))))
query("flt_12_weekly_digest", f"""
 WITH w AS (SELECT *, date_trunc('week',"date")::DATE AS week FROM snapshots), nat AS (SELECT week, fuel, {avg_price()} "avg" FROM w GROUP BY 1,2),
 nl AS (SELECT *, lag("avg") OVER (PARTITION BY fuel ORDER BY week) pv FROM nat), ci AS (SELECT week, fuel, city, {avg_price()} a FROM w JOIN stations USING(id) GROUP BY 1,2,3),
 bc AS (SELECT week, fuel, arg_min(city,(a,city)) cheapest_city, min(a) cheapest_city_avg FROM ci GROUP BY 1,2), sn AS (SELECT week, count(DISTINCT id) stations_with_data FROM w GROUP BY 1)
 SELECT week::VARCHAR AS week, fuel, "avg", ({cents('"avg"')}-{cents('pv')})/100e0 AS change, CASE WHEN {cents('"avg"')}>{cents('pv')} THEN '▲' WHEN {cents('"avg"')}<{cents('pv')} THEN '▼' WHEN pv IS NOT NULL THEN '=' END arrow,
  cheapest_city, cheapest_city_avg, stations_with_data FROM nl LEFT JOIN bc USING(week, fuel) JOIN sn USING(week)""")(
    lambda s, d: fleet.weekly_digest(snapshots(s, d), b.stations(s, d)))

# --- spatial joins ----------------------------------------------------------------------------------

_AB = ("a.lat", "a.lng", "b.lat", "b.lng")
for radius in (5, 20):
    query(f"joi_07_distance_matrix_{radius}km", f"""SELECT a.id id_a, b.id id_b, {jr(hav(*_AB), 2)} haversine_km, {jr(man(*_AB), 2)} manhattan_km
 FROM stations a JOIN stations b ON {jr(hav(*_AB), 2)}<={radius}""")(
        lambda s, d, r=radius: spatial.distance_matrix(b.stations(s, d), float(r)))
query("joi_07_distance_matrix_directed", f"""SELECT a.id id_a, b.id id_b, {jr(hav(*_AB), 4)} haversine_km, {jr(man(*_AB, '111e0'), 4)} manhattan_km
 FROM stations a JOIN stations b ON a.id<>b.id AND {hav(*_AB)}<=5""")(
    lambda s, d: spatial.distance_matrix(b.stations(s, d), 5.0, self_pairs=False, rounded=False, km_per_degree=111.0))
query("joi_08_neighbours", f"""SELECT a.id, b.id neighbour_id, {jr(hav(*_AB), 2)} distance_km, {jr(man(*_AB), 2)} manhattan_km
 FROM stations a JOIN stations b ON a.id<>b.id AND {jr(hav(*_AB), 2)}<=10""")(lambda s, d: spatial.neighbours(b.stations(s, d), 10.0))
query("joi_08_neighbours_of_brand", f"""SELECT a.id, b.id neighbour_id, {jr(hav(*_AB), 2)} distance_km, {jr(man(*_AB), 2)} manhattan_km
 FROM stations a JOIN stations b ON a.id<>b.id AND a.brand='BRAND_3' AND {jr(hav(*_AB), 2)}<=10""")(
    lambda s, d: spatial.neighbours(b.stations(s, d), 10.0, b.stations(s, d).filter("brand = 'BRAND_3'")))
per_fuel("joi_11_fuel_stops", f"""
 SELECT * FROM (SELECT route_id, seq, row_number() OVER (PARTITION BY route_id, seq ORDER BY price, id)::INT AS "rank", id, price, km distance_km FROM (
  SELECT r.route_id, r.seq, p.id, p.price, {jr(hav('r.lat', 'r.lng', 'p.lat', 'p.lng'), 2)} km FROM route_points r JOIN priced p ON p.fuel='{{fuel}}') WHERE km<=10) WHERE "rank"<=5""",
         lambda s, d, f: spatial.fuel_stops(b.route_points(s, d), _priced_of(s, d, f).select("id", "lat", "lng", "price")))
query("agg_11_map_cells", "WITH c AS (SELECT {g} cell, coalesce(brand,'OTRO') brand, regular FROM merged), n AS (SELECT cell, brand, count(*) k FROM c GROUP BY 1,2) SELECT cell, count(*) station_count, min(regular) min_price, (SELECT brand FROM n WHERE n.cell=c.cell ORDER BY k DESC, brand LIMIT 1) top_brand FROM c GROUP BY cell".replace("{g}", geohash("lat", "lng", 5)))(
    lambda s, d: spatial.cell_rollup(merged(s, d).withColumn("price", F.col("regular")), 5))
query("agg_12_price_grid", "SELECT {g} cell, fuel, {a} avg_price, count(*) n FROM priced GROUP BY 1,2".replace("{g}", geohash("lat", "lng", 5)).replace("{a}", avg_price()))(
    lambda s, d: spatial.price_grid(priced(s, d), 5))
query("agg_13_matrix_summary", f"""
 SELECT (SELECT count(*) FROM stations) station_count, 100e0 coverage_pct, {', '.join(f'count(*) FILTER (km<={r}) pairs_{r}km' for r in (5, 20, 50))}
 FROM (SELECT {jr(hav(*_AB), 2)} km FROM stations a, stations b)""")(lambda s, d: spatial.matrix_summary(b.stations(s, d)))

# --- filters ----------------------------------------------------------------------------------------

_KM0 = jr(hav("19.2e0", "-99.2e0", "lat", "lng"), 2)


def viewed(spark, d):
    """Merged stations with address columns, distances from one point, flags and amenities."""
    m = spatial.add_distances(with_amenities(merged(spark, d)), 19.2, -99.2)
    i = F.col("id")
    return m.withColumns({
        "address": F.concat(F.lit("Calle "), i % 90), "zip_code": F.lpad((i % 99999).cast("string"), 5, "0"), "is_anomaly": i % 11 == 0})


VIEWED = f"""viewed AS (SELECT *, {_KM0} distance_km, {jr(man('19.2e0', '-99.2e0', 'lat', 'lng'), 2)} manhattan_km, 'Calle '||(id%90) address, lpad((id%99999)::VARCHAR,5,'0') zip_code, id%11=0 is_anomaly FROM merged)"""
query("fil_01_station_filter", f"""WITH {VIEWED} SELECT id, name, regular, distance_km FROM viewed WHERE upper(brand) IN ('BRAND_1','BRAND_2','BRAND_3') AND distance_km<=25
 AND has_data AND regular BETWEEN 20 AND 27 AND (lower(name) LIKE '%supplier%')""")(
    lambda s, d: filters.filter_stations(viewed(s, d), brands=["brand_1", "Brand_2", "BRAND_3"], max_distance_km=25, price_range=(20.0, 27.0), text="SUPPLIER").select("id", "name", "regular", "distance_km"))
query("fil_01_missing_data", f"""WITH {VIEWED} SELECT id, name FROM viewed WHERE NOT has_data AND city IN ('CITY_1','CITY_3','CITY_5','CITY_9')""")(
    lambda s, d: filters.filter_stations(viewed(s, d), cities=["CITY_1", "CITY_3", "CITY_5", "CITY_9"], missing_data_only=True).select("id", "name"))
query("fil_02_app_filter", f"""WITH {VIEWED} SELECT id, premium FROM viewed WHERE brand IN ('BRAND_0','BRAND_3') AND premium>=24 AND premium<=28 AND id%3=0 AND has_data""")(
    lambda s, d: filters.filter_app(viewed(s, d), fuel="premium", brands=["BRAND_0", "BRAND_3"], price_min=24.0, price_max=28.0, open_24h=True, with_data_only=True).select("id", "premium"))
query("fil_03_text_search", f"""WITH {VIEWED} SELECT id, name, city, address FROM viewed WHERE lower(name) LIKE '%calle 1%' OR lower(brand) LIKE '%calle 1%' OR lower(city) LIKE '%calle 1%' OR lower(state) LIKE '%calle 1%' OR zip_code LIKE '%calle 1%' OR lower(address) LIKE '%calle 1%'""")(
    lambda s, d: viewed(s, d).filter(filters.matches_text("Calle 1", filters.TEXT_COLUMNS)).select("id", "name", "city", "address"))
query("fil_03_suggestions", f"""WITH {VIEWED}, q AS (SELECT 'station' kind, name AS label, row_number() OVER (ORDER BY id) k FROM viewed WHERE contains(lower(name),'1') OR contains(lower(city),'1') OR contains(zip_code,'1') OR contains(lower(address),'1')),
 c AS (SELECT 'city' kind, city AS label, row_number() OVER (ORDER BY min(id)) k FROM viewed WHERE contains(lower(city),'1') GROUP BY city), b AS (SELECT 'brand' kind, brand AS label, row_number() OVER (ORDER BY count(*) DESC, brand) k FROM viewed WHERE contains(lower(brand),'1') GROUP BY brand)
 SELECT kind, k::INT AS "rank", label FROM (SELECT * FROM q WHERE k<=6 UNION ALL SELECT * FROM c WHERE k<=4 UNION ALL SELECT * FROM b WHERE k<=3)""")(
    lambda s, d: filters.suggestions(viewed(s, d), "1"))
query("fil_04_distances", f"WITH {VIEWED} SELECT id, distance_km, manhattan_km FROM viewed")(lambda s, d: viewed(s, d).select("id", "distance_km", "manhattan_km"))
for descending in (False, True):
    query(f"fil_05_page_{'desc' if descending else 'asc'}", f"""WITH {VIEWED} SELECT id, name, regular FROM viewed ORDER BY regular {'DESC NULLS FIRST' if descending else 'ASC NULLS LAST'}, id LIMIT 20 OFFSET 20""")(
        lambda s, d, x=descending: filters.sort_page(viewed(s, d).select("id", "name", "regular"), "regular", x, page=2, size=20))
query("fil_06_favourites", "SELECT id, name, brand FROM stations WHERE id IN (SELECT c_custkey*3 FROM customer)")(
    lambda s, d: filters.favourites(b.stations(s, d).select("id", "name", "brand"), b.table(s, d, "customer").select((F.col("c_custkey") * 3).alias("id"))))
