"""Time series over daily snapshots (id, date, fuel, price).

Series windows are partitioned by station and fuel after the daily aggregation, so a partition holds one
row per day however many raw events a station has. Regressions are sums over whole cents.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fuelspark.functions.lookups import HOLIDAYS
from fuelspark.functions.numeric import cents, js_round, mean_price, pop_std

SERIES = ["id", "fuel"]


def recent_dates(snapshots: DataFrame, days: int) -> DataFrame:
    """The newest snapshot dates; at most ``days`` rows, which is why the result may be broadcast."""
    return F.broadcast(snapshots.select("date").distinct().orderBy(F.col("date").desc()).limit(days))


def price_history(snapshots: DataFrame, days: int = 30) -> DataFrame:
    return snapshots.filter("price is not null").join(recent_dates(snapshots, days), "date", "left_semi")


def daily_national_average(snapshots: DataFrame, days: int = 30) -> DataFrame:
    return price_history(snapshots, days).groupBy("date", "fuel").agg(
        mean_price(F.sum(cents(F.col("price"))), F.count("price")).alias("price")
    )


def moving_average(series: DataFrame, keys: list[str], window: int = 7) -> DataFrame:
    frame = W.partitionBy(*keys).orderBy("date").rowsBetween(1 - window, 0)
    total, n = F.sum(cents(F.col("price"))).over(frame), F.count("price").over(frame)
    return series.withColumn("ma", mean_price(total, n))


def _positions(series: DataFrame, keys: list[str], last: int | None = None) -> DataFrame:
    """Number the points of each series from 0, oldest first, optionally only the last ones."""
    if last:
        newest = W.partitionBy(*keys).orderBy(F.col("date").desc())
        series = series.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= last)
        count = F.count(F.lit(1)).over(W.partitionBy(*keys))
        return series.withColumn("_x", (count - F.col("_back")).cast("bigint"))
    return series.withColumn("_x", (F.row_number().over(W.partitionBy(*keys).orderBy("date")) - 1).cast("bigint"))


def _fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares sums per series: n, mean and the three cross sums, all from integers."""
    x, y = F.col("_x"), cents(F.col("price"))
    sums = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sx2"), F.sum(y * y).alias("sy2"),
        F.max_by("price", "_x").alias("last_price"),
    )
    n = F.col("n")
    return sums.select(
        *keys, "n", "sx", "sy", "last_price",
        (n * F.col("sxy") - F.col("sx") * F.col("sy")).alias("cxy"),
        (n * F.col("sx2") - F.col("sx") * F.col("sx")).alias("cxx"),
        (n * F.col("sy2") - F.col("sy") * F.col("sy")).alias("cyy"),
    )


def _direction(slope_cents: Column, n: Column) -> Column:
    return F.when((n < 3) | slope_cents.isNull(), "stable").when(slope_cents > 2, "rising").when(
        slope_cents < -2, "falling"
    ).otherwise("stable")


def trend_direction(series: DataFrame, keys: list[str]) -> DataFrame:
    """Rising or falling when the slope of the last 7 points is beyond 0.02 a day."""
    fit = _fit(_positions(series, keys, last=7), keys)
    slope = F.when(F.col("cxx") > 0, F.col("cxy") / F.col("cxx"))
    return fit.select(*keys, F.col("n").alias("points"), _direction(slope, F.col("n")).alias("trend"))


def volatility(history: DataFrame, keys: list[str]) -> DataFrame:
    c = cents(F.col("price"))
    sums = history.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(c).alias("_s"), F.sum((c * c).cast("double")).alias("_ss"),
        F.min(c).alias("_lo"), F.max(c).alias("_hi"),
    )
    std = js_round(pop_std(F.col("_ss"), F.col("_s"), F.col("n")) / 100.0, 3)
    flat = (F.col("n") < 2) | (F.col("_lo") == F.col("_hi"))
    return sums.select(*keys, "n", F.when(flat, F.lit(0.0)).otherwise(std).alias("volatility"))


def weekday_pattern(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Average by weekday, 0 is Sunday; every series has its seven rows from one aggregation."""
    day, c = F.dayofweek("date") - 1, cents(F.col("price"))
    sums = []
    for d in range(7):
        sums.append(mean_price(F.sum(F.when(day == d, c)), F.count_if(day == d)).alias(str(d)))
    wide = snapshots.groupBy(*keys).agg(*sums)
    long = wide.unpivot(keys, [str(d) for d in range(7)], "day_of_week", "avg_price")
    return long.withColumn("day_of_week", F.col("day_of_week").cast("int"))


def price_change(snapshots: DataFrame, days: int = 1) -> DataFrame:
    """Price of each snapshot against the one exactly ``days`` before, for the same station and fuel."""
    day_number = F.datediff("date", F.lit("1970-01-01"))
    before = W.partitionBy(*SERIES).orderBy(day_number).rangeBetween(-days, -days)
    both = snapshots.withColumn("previous", F.first("price").over(before)).filter("previous is not null")
    change = (cents(F.col("price")) - cents(F.col("previous"))) / 100.0
    return both.withColumn("change", change).withColumn(
        "pct_change", js_round(F.col("change") / F.col("previous") * 100, 1)
    )


def biggest_moves(snapshots: DataFrame, as_of: str, fuel: str, falling: bool, n: int = 10) -> DataFrame:
    """Stations whose price fell (or rose) most against a week before; reads the two days only."""
    today = F.to_date(F.lit(as_of))
    two_days = snapshots.filter((F.col("fuel") == fuel) & F.col("date").isin(today, F.date_sub(today, 7)))
    moves = price_change(two_days, days=7)
    moves = moves.filter(F.col("change") < 0 if falling else F.col("change") > 0)
    return moves.orderBy(F.col("change").asc() if falling else F.col("change").desc(), "id").limit(n)


def _regression(fit: DataFrame, keys: list[str]) -> DataFrame:
    n, slope = F.col("n"), F.col("cxy") / F.col("cxx")
    several = (n >= 2) & (F.col("cxx") > 0)
    next_value = (F.col("sy") / n + slope * (n - F.col("sx") / n)) / 100.0
    r2 = F.when(F.col("cyy") == 0, F.lit(1.0)).otherwise(
        F.col("cxy").cast("double") * F.col("cxy") / (F.col("cxx").cast("double") * F.col("cyy"))
    )
    return fit.select(
        *keys, n.alias("data_points"), "last_price",
        F.when(several, js_round(slope / 100.0, 4)).otherwise(F.lit(0.0)).alias("slope"),
        js_round(F.when(several, next_value).otherwise(F.col("sy") / n / 100.0), 2).alias("predicted"),
        F.when(several, js_round(r2, 3)).otherwise(F.lit(0.0)).alias("r2"),
    )


def forecast(history: DataFrame, keys: list[str]) -> DataFrame:
    """Next value of each series with confidence r2 * min(1, points / 30) * 0.80 and its trend."""
    result = _regression(_fit(_positions(history, keys), keys), keys)
    density = F.least(F.lit(1.0), F.col("data_points") / 30.0)
    result = result.withColumn("confidence", js_round(F.col("r2") * density * 0.80, 2))
    return result.join(trend_direction(history, keys).drop("points"), keys)


def weekly_state_forecast(snapshots: DataFrame, state_averages: DataFrame, as_of: str) -> DataFrame:
    """Mid-week value of the national series per priced state; the state average when history is short."""
    series = daily_national_average(snapshots)
    national = F.broadcast(forecast(series, ["fuel"]))  # one row per fuel
    mid = js_round((F.col("predicted") + F.col("predicted") + F.col("slope") * 7) / 2, 2)
    enough = F.coalesce(F.col("data_points") >= 3, F.lit(False))
    day = F.to_date(F.lit(as_of))
    return state_averages.join(national, "fuel", "left").select(
        "state", "fuel", F.when(enough, mid).otherwise(F.col("avg")).alias("avg_predicted"),
        F.when(enough, F.date_add(day, 1).cast("string")).alias("week_start"),
        F.when(enough, F.date_add(day, 7).cast("string")).alias("week_end"),
        F.when(enough, F.col("trend")).otherwise("stable").alias("trend"),
        F.when(enough, F.col("data_points")).otherwise(F.lit(0)).cast("bigint").alias("data_points"),
    )


def holiday_table(spark, holidays=HOLIDAYS) -> DataFrame:
    rows = [(i, md, name) for i, (md, name) in enumerate(holidays)]
    return spark.createDataFrame(rows, "listed int, month_day string, holiday string")


def holiday_pressure(dates: DataFrame, holidays: DataFrame, look_ahead: int = 7) -> DataFrame:
    """Price pressure of the first listed holiday within the look-ahead of each date.

    The holiday calendar is keyed by month and day (366 keys at most), so it may be broadcast.
    """
    ahead = dates.select("date", F.explode(F.sequence(F.lit(0), F.lit(look_ahead))).alias("days_until"))
    ahead = ahead.withColumn("month_day", F.date_format(F.date_add("date", F.col("days_until")), "MM-dd"))
    first = ahead.join(F.broadcast(holidays), "month_day").groupBy("date").agg(
        F.min(F.struct("listed", "days_until", "holiday")).alias("h")
    )
    until = F.col("h.days_until")
    level = F.when(until <= 2, "high").when(until <= 4, "medium").when(until.isNotNull(), "low").otherwise("none")
    pct = F.when(until <= 2, 12).when(until <= 4, 8).when(until.isNotNull(), 5)
    return dates.join(first, "date", "left").select(
        "date", until.isNotNull().alias("has_alert"), until.alias("days_until"), F.col("h.holiday").alias("holiday"),
        level.alias("severity"), pct.alias("increase_pct"),
    )


def _arrow(delta_cents: Column) -> Column:
    return F.when(delta_cents > 5, "▲").when(delta_cents < -5, "▼").when(delta_cents.isNotNull(), "→")


def change_arrows(snapshots: DataFrame) -> DataFrame:
    """Arrow against the previous load of the same station and fuel, threshold 0.05."""
    previous = F.lag("price").over(W.partitionBy(*SERIES).orderBy("date"))
    rows = snapshots.withColumn("previous", previous)
    return rows.withColumn("arrow", _arrow(cents(F.col("price")) - cents(F.col("previous"))))


def week_arrow(snapshots: DataFrame) -> DataFrame:
    """First against last of the newest 7 points; null with fewer than two."""
    points = _positions(snapshots, SERIES, last=7).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("points"), F.min_by("price", "_x").alias("first_price"),
        F.max_by("price", "_x").alias("last_price"),
    )
    delta = cents(F.col("last_price")) - cents(F.col("first_price"))
    return points.withColumn("arrow", F.when(F.col("points") >= 2, _arrow(delta)))


def missed_days(snapshots: DataFrame, keys: list[str], as_of: str, cap: int | None = None) -> DataFrame:
    """Consecutive days without a snapshot, counted back from the day before ``as_of``: of the whole table without keys,
    else per key. Without any earlier snapshot it is the cap, if there is one."""
    yesterday = F.date_sub(F.to_date(F.lit(as_of)), 1)
    newest = F.max(F.when(F.col("date") <= yesterday, F.col("date")))
    gap = F.datediff(yesterday, newest)
    if cap is not None:
        gap = F.least(F.lit(cap), F.coalesce(gap, F.lit(cap)))
    return snapshots.groupBy(*keys).agg(gap.alias("missed_days"))


def freshness(last_update: Column, as_of: str) -> Column:
    """Class by age in days: today, recent, ok or stale."""
    days = F.timestamp_diff("SECOND", last_update.cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz")) / 86400.0
    return (
        F.when(days.isNull(), "unknown").when(days < 1, "today").when(days < 7, "recent")
        .when(days < 80, "ok").otherwise("stale")
    )


def feed_freshness(exported_at: Column, as_of: str) -> Column:
    """Class by age in hours, used for a whole export."""
    hours = F.timestamp_diff("SECOND", exported_at.cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz")) / 3600.0
    return (
        F.when(hours.isNull(), "stale").when(hours < 12, "fresh").when(hours < 24, "recent")
        .when(hours < 48, "aging").otherwise("stale")
    )
