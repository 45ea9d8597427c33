"""Release and expiry dates, trading days around any day, completeness of periods: calendars joined, no loops over days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES
from tidemark.operators.sessions import FOMC, holidays, last_weekday, nth_weekday, observed, opex, week, years

#: Years whose meetings may still move, years whose payroll dates were compared with the published ones,
#: months whose payroll date is another than the rule's, and the order of kinds.
FOMC_TENTATIVE, NFP_CONFIRMED = (2027,), (2025, 2026)
NFP_OVERRIDES = {"2026-05": "2026-05-08", "2027-10": "2027-10-08"}
KINDS = ("FOMC", "OPEX", "QUAD", "NFP", "CPI")
WARN_DAYS = 60


def federal_holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """date of each federal holiday as observed: not the exchange's closures."""
    y = F.col("year")
    day = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    found = [
        *(observed(day(m, d)) for m, d in ((1, 1), (7, 4), (11, 11), (12, 25))), F.when(y >= 2021, observed(day(6, 19))), F.when(F.dayofweek(F.make_date(y + 1, F.lit(1), F.lit(1))) == 7, day(12, 31)),
        nth_weekday(y, 1, "MON", 3), nth_weekday(y, 2, "MON", 3), last_weekday(y, 5, "MON"), nth_weekday(y, 9, "MON", 1), nth_weekday(y, 10, "MON", 2), nth_weekday(y, 11, "THU", 4),
    ]
    # an observed new year may fall in the year before
    got = years(spark, first, last).select(y, F.explode(F.array(*found)).alias("date")).filter("date is not null")
    return got.filter(F.year("date") == y).select("date").distinct()


def months(spark: SparkSession, first: int, last: int) -> DataFrame:
    return years(spark, first, last).select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))


def _released(df: DataFrame, spark: SparkSession, first: int, last: int) -> DataFrame:
    """df with date moved: a week on from January's first three days, then back past federal holidays and weekends."""
    moved = F.when((F.col("month") == 1) & (F.dayofmonth("date") <= 3), F.date_add("date", 7)).otherwise(F.col("date"))
    shut = federal_holidays(spark, first - 1, last + 1).agg(F.collect_set("date").alias("shut"))  # a dozen a year
    before = lambda n: F.date_sub("date", n)
    open_day = lambda d: ~F.array_contains("shut", d) & F.dayofweek(d).between(2, 6)
    back = F.coalesce(*(F.when(open_day(before(n)), before(n)) for n in range(8)))
    return df.withColumn("date", moved).join(F.broadcast(shut)).withColumn("date", back).drop("shut")


def payrolls(spark: SparkSession, first: int, last: int, overrides: dict[str, str] = NFP_OVERRIDES) -> DataFrame:
    """year, month, date of the payroll report: the first Friday, moved, or a month's own date."""
    friday = F.next_day(F.date_sub(F.make_date("year", "month", F.lit(1)), 1), "FRI")
    got = _released(months(spark, first, last).withColumn("date", friday), spark, first, last)
    own = F.create_map(*(F.lit(x) for kv in overrides.items() for x in kv)) if overrides else F.lit(None).cast("map<string,string>")
    key = F.format_string("%04d-%02d", "year", "month")
    return got.withColumn("date", F.coalesce(F.to_date(F.try_element_at(own, key)), "date"))


def payrolls_by_reference_week(spark: SparkSession, first: int, last: int) -> DataFrame:
    """The same by the other rule: the third Friday after the week with the 12th of the month before."""
    twelfth = F.make_date(F.year("before"), F.month("before"), F.lit(12))
    saturday = F.next_day(F.date_sub(twelfth, 1), "SAT")
    got = months(spark, first, last).withColumn("before", F.add_months(F.make_date("year", "month", F.lit(1)), -1)).withColumn("date", F.date_add(saturday, 20)).drop("before")
    return _released(got, spark, first, last)


def payroll_discrepancies(spark: SparkSession, first: int, last: int) -> DataFrame:
    a, b = payrolls(spark, first, last), payrolls_by_reference_week(spark, first, last).withColumnRenamed("date", "by_week")
    return a.join(b, ["year", "month"]).filter("date <> by_week").withColumn("overridden", F.format_string("%04d-%02d", "year", "month").isin(*NFP_OVERRIDES))


def all_events(spark: SparkSession, first: int, last: int, cpi: tuple[str, ...] = ()) -> DataFrame:
    """kind, date, tentative; months of quadruple expiry have QUAD in place of OPEX. cpi: dates, if they are known."""
    table = [("FOMC", d) for d in FOMC] + [("CPI", d) for d in cpi]
    fixed = spark.createDataFrame(table, "kind string, d string").select("kind", F.to_date("d").alias("date")).filter(F.year("date").between(first, last))
    fixed = fixed.withColumn("tentative", (F.col("kind") == "FOMC") & F.year("date").isin(*FOMC_TENTATIVE))
    expiries = opex(spark, first, last).select(F.when(F.col("quad"), "QUAD").otherwise("OPEX").alias("kind"), "date", F.lit(False).alias("tentative"))
    jobs = payrolls(spark, first, last).select(F.lit("NFP").alias("kind"), "date", ~F.col("year").isin(*NFP_CONFIRMED))
    return fixed.unionByName(expiries).unionByName(jobs.toDF("kind", "date", "tentative"))


def around(days: DataFrame, calendar: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """days (date) with the session itself (null if none), the one strictly before and the one strictly after.

    A union and two windows over the calendar's days, which are some 250 a year.
    """
    both = days.select("date", F.lit(True).alias("asked")).distinct().unionByName(calendar.select("date", F.lit(False).alias("asked")))
    per_day = both.groupBy("date").agg(F.max("asked").alias("asked"), F.max(~F.col("asked")).alias("open"))
    session = F.when(F.col("open"), F.col("date"))
    order = Window.orderBy("date")
    got = per_day.withColumns({
        "prev_session": F.last(session, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "next_session": F.first(session, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
    })
    return got.filter("asked").select("date", session.alias("session"), "prev_session", "next_session")


def upcoming(spark: SparkSession, events: DataFrame, calendar: DataFrame, asof: str, n: int = 20) -> DataFrame:
    """Events after asof whose session (the next one, if closed) is among the next n, in the order of sessions and kinds."""
    day = F.lit(asof).cast("date")
    ahead = calendar.filter(F.col("date") > day).withColumn("k", F.row_number().over(Window.orderBy("date"))).filter(F.col("k") <= n)
    later = events.filter(F.col("date") > day)
    dates = around(later.select("date"), calendar).select("date", F.coalesce("session", "next_session").alias("effective"))
    # n rows
    met = later.join(dates, "date").join(F.broadcast(ahead.select(F.col("date").alias("effective"), F.col("k").alias("sessions_ahead"))), "effective")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return met.select("date", "kind", "sessions_ahead", "tentative", (F.col("effective") != F.col("date")).alias("moved")).orderBy("sessions_ahead", rank)


def table_horizon(days: DataFrame) -> DataFrame:
    """days (asof) with the last meeting of the table, the days left until it, and whether they are few."""
    last = days.withColumn("last_fomc", F.lit(max(FOMC)).cast("date"))
    left = F.datediff("last_fomc", "asof")
    return last.select("asof", "last_fomc", left.alias("days_left"), (left < WARN_DAYS).alias("warn"), F.year("last_fomc").isin(*FOMC_TENTATIVE).alias("tentative"))


def next_january(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """days (date) with the first January session after each: the first session of the next year."""
    first = calendar.groupBy(F.year("date").alias("year")).agg(F.min("date").alias("next_january"))
    return days.withColumn("year", F.year("date") + 1).join(first, "year", "left").drop("year")


def asof_status(days: DataFrame, calendar: DataFrame, last_bar: str) -> DataFrame:
    """days (now, a timestamp of exchange time): the session that a run may use, and why.

    current: today's bar is closed and there; pre_open and incomplete: today's session hasn't opened or closed; weekend
    and holiday: no session; stale: the last bar is older than the session that should be there.
    """
    d = days.withColumn("date", F.to_date("now"))
    met = d.join(around(d.select("date"), calendar), "date", "left")
    minute = F.hour("now") * 60 + F.minute("now") + F.second("now") / 60
    closed = F.col("session").isNotNull() & (minute > 16 * 60 + 5)
    asof = F.when(closed, F.col("session")).otherwise(F.col("prev_session"))
    status = (
        F.when(F.lit(last_bar).cast("date") < asof, "stale").when(closed, "current").when(F.col("session").isNotNull() & (minute < 9 * 60 + 30), "pre_open")
        .when(F.col("session").isNotNull(), "incomplete").when(F.dayofweek("date").isin(1, 7), "weekend").otherwise("holiday")
    )
    return met.select("now", F.least(asof, F.lit(last_bar).cast("date")).alias("asof"), status.alias("status"))


def complete_at(d: Column, next_session: Column, is_session: Column, month: bool) -> Column:
    """Whether an observation on d completes its week or month: the next session is in another, or d is its last day."""
    label = F.last_day(d) if month else week(d)
    return (is_session & (next_session > label)) | (d == label)


def completed_buckets(df: DataFrame, calendar: DataFrame, month: bool) -> DataFrame:
    """Last close of each week or month of a series; the last bucket only if the series' last day completes it."""
    label = F.last_day("date") if month else week(F.col("date"))
    got = df.withColumn("label", label).groupBy(SERIES, "label").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("last_date"))
    ends = df.groupBy(SERIES).agg(F.max("date").alias("date"))
    known = around(ends.select("date"), calendar)
    # one row a series
    ends = ends.join(known, "date").select(SERIES, (F.last_day("date") if month else week(F.col("date"))).alias("last_label"), complete_at(F.col("date"), F.col("next_session"), F.col("session").isNotNull(), month).alias("complete"))
    return got.join(ends, SERIES).filter((F.col("label") < F.col("last_label")) | F.col("complete")).drop("last_label", "complete")


def completed_daily(df: DataFrame, now: str) -> DataFrame:
    """Bars up to the last closed day: today's only after 16:05 of exchange time."""
    t = F.lit(now).cast("timestamp_ntz")
    last = F.when(F.date_format(t, "HH:mm:ss") > "16:05:00", F.to_date(t)).otherwise(F.date_sub(F.to_date(t), 1))
    return df.filter(F.col("date") <= last)


def period_flags(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Week and month ends of a series by its next observation, the last row by the calendar; and by the calendar's rule alone."""
    w = Window.partitionBy(SERIES).orderBy("date")
    d = df.withColumn("next", F.lead("date").over(w)).join(around(df.select("date"), calendar), "date")
    rule = lambda month: complete_at(F.col("date"), F.col("next_session"), F.col("session").isNotNull(), month)
    flag = lambda label, month: F.coalesce(label(F.col("next")) != label(F.col("date")), rule(month))
    return d.withColumns({
        "is_week_end": flag(week, False), "is_month_end": flag(F.last_day, True), "rule_week_end": F.col("session").isNotNull() & (F.col("next_session") > week(F.col("date"))),
        "rule_month_end": F.col("session").isNotNull() & (F.col("next_session") > F.last_day("date")),
    }).drop("next", "session", "prev_session", "next_session")
