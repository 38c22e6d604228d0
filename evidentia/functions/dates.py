"""Deadlines over a holiday calendar, and legal regimes by date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Holidays by month and day for all states and for some, and the states that keep Corpus
# Christi; days from Easter to the movable holidays of all states.
FIXED_ALL = ((1, 1), (5, 1), (10, 3), (12, 25), (12, 26))
FIXED_BY_STATE = {
    "NW": ((11, 1), (10, 31)), "BY": ((1, 6), (8, 15)), "BW": ((1, 6), (8, 15)), "ST": ((1, 6), (10, 31)), "RP": ((8, 15),), "SL": ((8, 15),), "SN": ((10, 31),), "TH": ((10, 31),),
    "BB": ((10, 31),), "MV": ((10, 31),), "HB": ((10, 31),), "SH": ((10, 31),), "NI": ((10, 31),), "HH": ((10, 31),), "HE": (), "BE": (),
}
MOVABLE_ALL, CORPUS_CHRISTI, CORPUS_CHRISTI_STATES = (-2, 1, 39, 50), 60, ("BY", "BW", "HE", "NW", "RP", "SL")
#: First days of the legal regimes, the oldest without one.
REGIMES = (("a.F._vor_2023", None), ("a.F._2023", "2023-07-01"), ("a.F._2025", "2025-01-01"), ("n.F._2026", "2026-07-01"))
#: Days from posting to assumed receipt.
RECEIPT_DAYS = 4


def easter(year: int) -> dt.date:
    """Easter Sunday in the Gregorian calendar: the Sunday after the first full moon of spring, from its epact."""
    century, golden = year // 100, year % 19
    moon = (19 * golden + 15 + century - century // 4 - (8 * century + 13) // 25) % 30
    if moon == 29 or (moon == 28 and golden > 10):  # the lunar months that are a day short
        moon -= 1
    full_moon = dt.date(year, 3, 21) + dt.timedelta(days=moon)
    return full_moon + dt.timedelta(days=7 - (full_moon.weekday() + 1) % 7)


def calendar(spark: SparkSession, first: str, last: str, states: tuple[str, ...] = tuple(FIXED_BY_STATE)) -> DataFrame:
    """(day, state, is_workday, next_workday) for every day and state.

    next_workday is the first workday on or after the day; days near the end look past it.
    """
    begin, end = dt.date.fromisoformat(first), dt.date.fromisoformat(last) + dt.timedelta(days=20)
    rows = set()
    for year in range(begin.year, end.year + 1):
        sunday = easter(year)
        for state in states:
            days = [dt.date(year, *md) for md in (*FIXED_ALL, *FIXED_BY_STATE[state])] + [sunday + dt.timedelta(days=k) for k in MOVABLE_ALL]
            if state in CORPUS_CHRISTI_STATES:
                days.append(sunday + dt.timedelta(days=CORPUS_CHRISTI))
            rows |= {(d, state) for d in days}
    holidays = spark.createDataFrame(sorted(rows), "day date, state string").withColumn("holiday", F.lit(True))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(begin), F.lit(end))).alias("day")).withColumn("state", F.explode(F.array(*[F.lit(s) for s in states])))
    work = (F.weekday("day") < 5) & F.col("holiday").isNull()
    ahead = Window.partitionBy("state").orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    out = days.join(F.broadcast(holidays), ["day", "state"], "left").withColumn("is_workday", work)
    out = out.withColumn("next_workday", F.min(F.when(F.col("is_workday"), F.col("day"))).over(ahead)).drop("holiday")
    return out.where(F.col("day") <= F.lit(dt.date.fromisoformat(last)))


def deadlines(notices: DataFrame, days: DataFrame) -> DataFrame:
    """Adds received, deadline, kind, rolled_over, disputed and other_deadline to notices.

    notices: dated, posted, received_on (dates, the last two may be null), instruction (korrekt, fehlerhaft
    or fehlt), is_act (boolean), state. Receipt is the known day, else four days after posting (or dating).
    The term is a month, or a year where the instruction is wrong or missing, and ends on the next workday.
    Where assumed receipt falls on no workday, the reading that moves it first is given as other_deadline.
    A letter that is no act ends with itself.
    """
    assumed = F.date_add(F.coalesce("posted", "dated"), RECEIPT_DAYS)
    known = F.col("received_on").isNotNull()
    out = notices.withColumn("receipt", F.coalesce("received_on", assumed)).withColumn("raw_end", F.when(F.col("instruction") == "korrekt", F.add_months("receipt", 1)).otherwise(F.add_months("receipt", 12)))
    at = lambda name: F.broadcast(days.select(F.col("day").alias(f"{name}_day"), F.col("state").alias(f"{name}_state"), F.col("next_workday").alias(f"{name}_next")))
    for name, on in (("end", "raw_end"), ("receipt", "receipt")):
        out = out.join(at(name), (F.col(on) == F.col(f"{name}_day")) & (F.col("state") == F.col(f"{name}_state")), "left")
    act, disputed = F.col("is_act"), F.col("is_act") & ~known & (F.col("receipt_next") != F.col("receipt"))
    return out.select(
        *notices.columns,
        F.when(act, F.col("receipt")).otherwise(F.col("dated")).alias("received"),
        F.when(act, F.col("end_next")).otherwise(F.col("dated")).alias("deadline"),
        F.when(~act, F.lit("kein_va")).when(F.col("instruction") == "korrekt", F.lit("monat")).otherwise(F.lit("jahr")).alias("kind"),
        (act & (F.col("end_next") != F.col("raw_end"))).alias("rolled_over"),
        disputed.alias("disputed"),
        F.when(disputed, F.add_months("receipt_next", 1)).alias("other_deadline"),
    )


def regime_of(day: Column) -> Column:
    out = F.lit(REGIMES[0][0])
    for name, first in REGIMES[1:]:
        out = F.when(day >= F.lit(first).cast("date"), F.lit(name)).otherwise(out)
    return out


def regime_segments(periods: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per period and regime it touches, cut at the regimes' first days; the dimension is four rows."""
    spark = periods.sparkSession
    dim = spark.createDataFrame([(n, i, REGIMES[i][1] or "0001-01-01", REGIMES[i + 1][1] if i + 1 < len(REGIMES) else "9999-12-31") for i, (n, _) in enumerate(REGIMES)], "regime string, ord int, lo string, hi string")
    dim = dim.select("regime", "ord", F.col("lo").cast("date").alias("lo"), F.when(F.col("hi") == "9999-12-31", F.col("hi").cast("date")).otherwise(F.date_sub(F.col("hi").cast("date"), 1)).alias("hi"))
    cut = periods.join(F.broadcast(dim), (F.col(start) <= F.col("hi")) & (F.col(end) >= F.col("lo")))
    return cut.select(*[c for c in periods.columns if c not in (start, end)], "regime", F.greatest(F.col(start), F.col("lo")).alias("segment_start"), F.least(F.col(end), F.col("hi")).alias("segment_end"))


def document_type(kind: Column, deadline: Column, as_of: Column) -> Column:
    """What to file: access to files, an objection within a month or a year, or a review once both are over."""
    return (
        F.when(kind.isNull() | (kind == "kein_va"), F.lit("akteneinsicht"))
        .when((deadline >= as_of) & (kind == "monat"), F.lit("widerspruch"))
        .when(kind == "jahr", F.lit("widerspruch_jahr"))
        .otherwise(F.lit("ueberpruefung"))
    )
