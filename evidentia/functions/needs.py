"""Needs of a household: base amounts by year and level, extra needs, and the four lines held against an authority's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
# Base amounts by year and level, and the level of each kind of person.
BASE_NEEDS = ((2025, 1, "563.00"), (2025, 2, "506.00"))
LEVELS = {"alleinstehend": 1, "alleinerziehend": 1, "partner": 2}
LINES = ("Gesamtbedarf", "Erwerbstätigenfreibetrag", "Anrechenbares Einkommen", "Anspruch (Leistung)")
#: Cents by which numbers of an authority may be off.
TOLERANCE = "0.02"


def base_need(year: Column, person: Column, table=BASE_NEEDS) -> Column:
    """The amount of the nearest year that the table has: the same or an earlier one, else its first.

    Null for an unknown kind of person and for a null year.
    """
    level = F.lit(None).cast("int")
    for name, k in LEVELS.items():
        level = F.when(person == name, F.lit(k)).otherwise(level)
    out = F.lit(None).cast(MONEY)
    for k in sorted({k for _, k, _ in table}):
        rows = sorted((y, a) for y, lv, a in table if lv == k)
        amount = F.lit(rows[0][1]).cast(MONEY)
        for y, a in rows[1:]:
            amount = F.when(year >= y, F.lit(a).cast(MONEY)).otherwise(amount)
        out = F.when((level == k) & year.isNotNull(), amount).otherwise(out)
    return out


def extras_total(items: Column) -> Column:
    """Sum of the amounts in an array of structs; items without one count nothing, no items give nothing."""
    zero = F.lit(0).cast(MONEY)
    amounts = F.transform(F.coalesce(items, F.array()), lambda x: F.coalesce(x["amount"].cast(MONEY), zero))
    return F.aggregate(amounts, zero, lambda acc, x: (acc + x).cast(MONEY))


def assembled(cases: DataFrame, table=BASE_NEEDS) -> DataFrame:
    """Adds base, extras, need and base_error to cases (year, person, shelter, items); need is null where base or shelter is."""
    out = cases.withColumns({"base": base_need(F.col("year"), F.col("person"), table), "extras": extras_total(F.col("items"))})
    need = (F.col("base") + F.col("shelter") + F.col("extras")).cast(MONEY)
    error = F.when(F.col("base").isNull(), F.concat(F.lit("Kein Regelbedarf für "), F.coalesce("person", F.lit("?"))))
    return out.withColumns({"need": need, "base_error": error})


def four_lines(cases: DataFrame, key: str) -> DataFrame:
    """(key, pos, label, authority, correct, difference) from need, allowance, net and the authority's need_a,
    allowance_a, income_a, claim_a; what is unknown on either side leaves the difference unknown."""
    zero = F.lit(0).cast(MONEY)
    floor0 = lambda x: F.when(x.isNotNull(), F.greatest(zero, x)).cast(MONEY)
    rows = cases.withColumn("income", floor0(F.col("net") - F.col("allowance")))
    rows = rows.withColumn("claim", floor0(F.col("need") - F.col("income")))
    lines = [F.struct(F.lit(label).alias("label"), F.col(f"{c}_a").cast(MONEY).alias("authority"), F.col(c).cast(MONEY).alias("correct")) for label, c in zip(LINES, ("need", "allowance", "income", "claim"), strict=True)]
    rows = rows.select(key, F.posexplode(F.array(*lines)).alias("pos", "x")).select(key, "pos", "x.*")
    return rows.withColumn("difference", (F.col("correct") - F.col("authority")).cast(MONEY))


def claim_is_off(need: Column, income: Column, claim: Column) -> Column:
    """Whether a claim is not need less income, at least nothing, to two cents; null if one of them is."""
    wanted = F.when((need - income).isNotNull(), F.greatest(F.lit(0).cast(MONEY), (need - income).cast(MONEY)))
    return F.abs(claim - wanted) > F.lit(TOLERANCE).cast(MONEY)


def stands_in(value: Column, text: Column) -> Column:
    """Whether an amount is written in a text: with two decimals after a point or comma, with one after a comma, or whole."""
    two = value.cast(MONEY).cast("string")
    one = F.round(value.cast(MONEY), 1).cast("decimal(18,1)").cast("string")
    whole = F.when(value.cast(MONEY) == F.floor(value.cast(MONEY)), F.floor(value.cast(MONEY)).cast("string"))
    forms = F.array_compact(F.array(two, F.replace(two, F.lit("."), F.lit(",")), F.replace(one, F.lit("."), F.lit(",")), whole))
    return F.exists(forms, lambda f: F.contains(text, f))
