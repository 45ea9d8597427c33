"""Exchange calendar as DataFrames: holidays by rule, sessions, period ends, option expiries, payroll dates.

Dates come from date functions over a range of years; special closures are a fixed table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Closures outside the rules.
SPECIAL = ("1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")
#: Second days of the central bank's two-day meetings.
FOMC = (
    "2025-01-29 2025-03-19 2025-05-07 2025-06-18 2025-07-30 2025-09-17 2025-10-29 2025-12-10 "
    "2026-01-28 2026-03-18 2026-04-29 2026-06-17 2026-07-29 2026-09-16 2026-10-28 2026-12-09 "
    "2027-01-27 2027-03-17 2027-04-28 2027-06-09 2027-07-28 2027-09-15 2027-10-27 2027-12-08"
).split()


def nth_weekday(year: Column, month: int, day: str, n: int) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), day), 7 * (n - 1))


def last_weekday(year: Column, month: int, day: str) -> Column:
    return F.next_day(F.date_sub(F.last_day(F.make_date(year, F.lit(month), F.lit(1))), 7), day)


def observed(d: Column) -> Column:
    return F.when(F.dayofweek(d) == 7, F.date_sub(d, 1)).when(F.dayofweek(d) == 1, F.date_add(d, 1)).otherwise(d)


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday: the golden number and the century's corrections give the moon, then the next Sunday."""
    div = lambda x, n: F.floor(x / n)
    golden, century = year % 19, div(year, 100)
    moon = (19 * golden + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15) % 30
    sunday = (32 + 2 * (century % 4) + 2 * div(year % 100, 4) - moon - (year % 100) % 4) % 7
    late = div(golden + 11 * moon + 22 * sunday, 451)
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), (moon + sunday - 7 * late).cast("int"))


def years(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """date and name of each closure on a weekday."""
    y = F.col("year")
    day = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    new_year = F.when(F.dayofweek(day(1, 1)) == 1, day(1, 2)).when(F.dayofweek(day(1, 1)) != 7, day(1, 1))
    rules = {
        "new_year": new_year, "mlk": F.when(y >= 1998, nth_weekday(y, 1, "MON", 3)), "presidents": nth_weekday(y, 2, "MON", 3), "good_friday": F.date_sub(easter(y), 2), "memorial": last_weekday(y, 5, "MON"),
        "juneteenth": F.when(y >= 2022, observed(day(6, 19))), "independence": observed(day(7, 4)), "labor": nth_weekday(y, 9, "MON", 1), "thanksgiving": nth_weekday(y, 11, "THU", 4), "christmas": observed(day(12, 25)),
    }
    by_rule = years(spark, first, last).select(F.explode(F.array(*(F.struct(d.alias("date"), F.lit(n).alias("name")) for n, d in rules.items()))).alias("h")).select("h.*").filter("date is not null")
    special = spark.createDataFrame([(d,) for d in SPECIAL], "d string").select(F.to_date("d").alias("date"), F.lit("special").alias("name")).filter(F.year("date").between(first, last))
    both = by_rule.unionByName(special)
    return both.groupBy("date").agg(F.max_by("name", (F.col("name") == "special").cast("int")).alias("name"))


def week(d: Column) -> Column:
    """The Friday that ends the week of d; Saturday and Sunday belong to the next."""
    return F.next_day(F.date_sub(d, 1), "FRI")


def sessions(spark: SparkSession, first: int, last: int) -> DataFrame:
    """date, pos, is_week_end, is_month_end of each trading day of the years; the last day's flags look past the range."""
    days = years(spark, first, last + 1).select(F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias("date"))
    # closures are some ten a year: proven small
    open_days = days.filter(~F.dayofweek("date").isin(1, 7)).join(F.broadcast(holidays(spark, first, last + 1).select("date")), "date", "left_anti")
    w = Window.orderBy("date")
    d = open_days.withColumns({"pos": F.row_number().over(w), "next": F.lead("date").over(w)})
    d = d.withColumns({"is_week_end": week(F.col("next")) != week(F.col("date")), "is_month_end": F.last_day("next") != F.last_day("date")})
    return d.filter(F.year("date") <= last).select("date", "pos", "is_week_end", "is_month_end")


def opex(spark: SparkSession, first: int, last: int) -> DataFrame:
    """date and quad of each month's option expiry: the third Friday, or the session before if closed."""
    months = years(spark, first, last).select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    friday = F.date_add(F.next_day(F.date_sub(F.make_date("year", "month", F.lit(1)), 1), "FRI"), 14)
    shut = F.broadcast(holidays(spark, first, last).select(F.col("date").alias("closed")))
    got = months.withColumn("friday", friday).join(shut, F.col("friday") == F.col("closed"), "left")
    # no closure falls on a Thursday before a closed third Friday
    return got.select("year", "month", F.when(F.col("closed").isNull(), F.col("friday")).otherwise(F.date_sub("friday", 1)).alias("date"), F.col("month").isin(3, 6, 9, 12).alias("quad"))


def resample(df: DataFrame, label: Column, completed: bool) -> DataFrame:
    """Last close of each bucket of a series; ``completed`` drops the series' last bucket whatever the calendar says:
    ``events.completed_buckets`` supersedes it, which keeps that bucket where it is over."""
    got = df.withColumn("label", label).groupBy("series_id", "label").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("last_date"))
    if not completed:
        return got
    w = Window.partitionBy("series_id")
    return got.withColumn("end", F.max("label").over(w)).filter(F.col("label") < F.col("end")).drop("end")


def period_ends(df: DataFrame) -> DataFrame:
    """Whether the next observation of a series falls in another week and another month; null on the last."""
    w = Window.partitionBy("series_id").orderBy("date")
    nxt = F.lead("date").over(w)
    return df.withColumns({"is_week_end": week(nxt) != week(F.col("date")), "is_month_end": F.last_day(nxt) != F.last_day("date")})


def upcoming(events: DataFrame, calendar: DataFrame, asof: str, n: int) -> DataFrame:
    """Events (kind, date) within the next n sessions: effective session and sessions ahead."""
    # both sides are calendars: a few thousand rows at most
    now = calendar.filter(F.col("date") <= F.lit(asof).cast("date")).agg(F.max("pos").alias("at"))
    next_session = events.join(F.broadcast(calendar), calendar["date"] >= events["date"]).groupBy("kind", events["date"].alias("event_date")).agg(F.min("pos").alias("pos"))
    met = next_session.join(F.broadcast(now), F.col("pos").between(F.col("at") + 1, F.col("at") + n))
    return met.select("kind", "event_date", (F.col("pos") - F.col("at")).alias("sessions_ahead"))
