"""Mixing sources to target weights by entropy balancing.

The mix keeps as close as it can, in relative entropy over tokens, to the corpus itself while every source
gives its target number of tokens, no document stands for more than MOST copies, and the tokens keep the corpus'
mean logarithm of document length: sources with other lengths must not drag the whole mix with them. The last
constraint joins all sources, so rates differ between the documents of one. The dual of this problem is convex
with one multiplier per constraint; its solution tilts each document's rate exponentially. Newton steps solve it:
the sums they need are Spark aggregates, the multipliers of sources stay in a table, and the driver sees one row
of sums a step. Rates are then rounded into whole copies so that the tokens a source gives stay near its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Copies of a document are at most so many; a source's target is at most so many times its size.
MOST = 3.0
#: Size classes of rounding, as a ratio of neighbouring bounds.
CLASS_RATIO = 1.1
#: How softly the mean length is held: this share of all tokens for each squared multiplier. It keeps the dual strictly
#: convex where sources leave no room, and steps few.
RIDGE = 0.1
#: Parts of copies are counted in units, so that their sums do not hang on the order they are taken in.
UNITS = 1 << 20


def targets(by_source: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """by_source (source, source_size) with target: all tokens shared by weight, none above MOST times its own.

    Sources stand by code point, null last, and take the weights in turn, again and again. One row a source is
    numbered in one task; nothing but sums reaches the driver.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    now = common.save(by_source.select("source", "source_size", weight.alias("weight"), F.lit(None).cast("double").alias("target")), "targets")
    while True:
        sums = now.agg(F.sum("source_size").alias("all"), F.coalesce(F.sum("target"), F.lit(0.0)).alias("given"), F.sum(F.when(F.col("target").isNull(), F.col("weight"))).alias("weights")).first()
        if not sums["weights"]:
            return now.select("source", "source_size", "target")
        wanted = F.col("weight") * F.lit((sums["all"] - sums["given"]) / sums["weights"])
        over = wanted > MOST * F.col("source_size")
        some_over = not now.where(F.col("target").isNull() & over).isEmpty()
        found = F.when(over, MOST * F.col("source_size")) if some_over else wanted
        now = common.save(now.withColumn("target", F.coalesce("target", found)), "targets")


def balance(cells: DataFrame, target: DataFrame, tolerance: float = 1e-9, most_steps: int = 40) -> tuple[DataFrame, float, float]:
    """(source, source_size, target, tilt) and the length multiplier and mean: a document's rate is
    min(MOST, exp(tilt + multiplier * (log(1 + size) - mean))).

    cells has source, size and n (documents of that source and size). Sources whose target is MOST times their
    size give every document MOST times, those without tokens or target none; neither has a multiplier to find.
    """
    tokens = F.col("n") * F.col("size")
    total, mean = cells.agg(F.sum(tokens), F.sum(tokens * F.log1p("size")) / F.sum(tokens)).first()
    total, mean = float(total or 0), float(mean or 0.0)
    fixed = F.when((F.col("source_size") == 0) | (F.col("target") <= 0), F.lit(-700.0)).when(F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12), F.lit(700.0))
    start = F.coalesce(fixed, F.log(F.col("target") / F.col("source_size")))
    now = common.save(target.select("source", "source_size", "target", fixed.isNotNull().alias("fixed"), start.alias("tilt")), "tilts")
    length, last, worst = 0.0, math.inf, 0.0
    for _ in range(most_steps):
        z = F.log1p("c.size") - mean
        raw = F.exp(F.least(F.col("t.tilt") + length * z, F.lit(700.0)))
        rate = F.least(F.lit(MOST), raw)
        free = F.when((raw < MOST) & ~F.col("t.fixed"), raw).otherwise(F.lit(0.0))
        mass = F.col("c.n") * F.col("c.size")
        sums = cells.alias("c").join(now.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).groupBy("t.source", "t.target", "t.fixed", "t.tilt", "t.source_size").agg(
            F.sum(mass * rate).alias("tokens"), F.sum(mass * rate * z).alias("m"), F.sum(mass * free).alias("h"), F.sum(mass * free * z).alias("c"), F.sum(mass * free * z * z).alias("q")
        )
        sums = common.save(sums.withColumn("g", F.when(F.col("fixed"), F.lit(0.0)).otherwise(F.col("tokens") - F.col("target"))), "sums")
        h = F.when(F.col("h") > 0, F.col("h"))
        step = sums.agg(
            F.sum("m").alias("m"), F.sum(F.coalesce(F.col("c") * F.col("g") / h, F.lit(0.0))).alias("cg"), F.sum("q").alias("q"), F.sum(F.coalesce(F.col("c") * F.col("c") / h, F.lit(0.0))).alias("cc"), F.max(F.abs("g") / F.greatest("target", F.lit(1e-9))).alias("worst")
        ).first()
        slope = (step["m"] or 0.0) + RIDGE * total * length
        worst = max(step["worst"] or 0.0, abs(slope) / max(total, 1.0))
        if worst <= tolerance:
            common.drop(sums)
            break
        bend = (step["q"] or 0.0) - (step["cc"] or 0.0) + RIDGE * total
        move = max(-0.5, min(0.5, -(slope - (step["cg"] or 0.0)) / bend)) if bend > 0 else 0.0
        move = move if worst < 2 * last else move / 2  # back off where the caps make a step overshoot
        shift = F.when(F.col("fixed"), F.lit(0.0)).when(F.col("h") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -(F.col("g") + F.col("c") * move) / F.col("h")))).otherwise(F.lit(-1.0))
        before, now = now, common.save(sums.select("source", "source_size", "target", "fixed", (F.col("tilt") + shift).alias("tilt")), "tilts")
        common.drop(before)
        common.drop(sums)
        length, last = length + move, worst
    if worst > 1e-6:
        raise ArithmeticError(f"sources are off their targets by {worst:.1e} after {most_steps} steps")
    return now, length, mean


def copies(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """doc_id, text_crc32, source, size, source_size, target, rate and n_copies for every row of docs.

    Size counts words between blanks (null text: 0). A document has the whole part of its rate, and one copy more
    if its turn comes: classes of size go from the largest documents to the smallest, each carries to the next the
    tokens it could not meet, and within a class the parts of copies are added up and evenly cut. Where a class is
    to give so many copies that the greatest part would come round twice, its documents count alike, so each gives
    one at most. All is added up over ranges of rows first, so that no task holds a whole class or source. The same rows give the same
    copies on every run; equal rows are interchangeable. Empty documents get the whole part alone.
    """
    spark = docs.sparkSession
    text = common.text_or_empty()
    sized = common.save(docs.select("doc_id", "source", F.crc32(text.cast("binary")).alias("text_crc32"), F.regexp_count(text, F.lit(common.WORD)).cast("long").alias("size")), "sized")
    cells = common.save(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    plan, length, mean = balance(cells, targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights))
    plan = plan.withColumnRenamed("source", "of")
    # sums of doubles hang on the order they are taken in: the digits that may differ are cut off
    rate = F.least(F.lit(MOST), F.exp(F.least(F.round("tilt", 8) + round(length, 8) * (F.log1p("size") - round(mean, 8)), F.lit(700.0))))
    rated = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "text_crc32", "source", "size", "source_size", "target", rate.alias("rate"))
    rated = rated.withColumns({"whole": F.floor(F.col("rate") + 1e-9), "class": F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / math.log(CLASS_RATIO)).cast("int")})
    rated = rated.withColumn("part", F.when(F.col("size") > 0, F.round(UNITS * F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))).cast("long")).otherwise(F.lit(0)))
    rated = rated.withColumn("turn", F.xxhash64("doc_id"))
    order = ["source", "class", "size", "turn", "doc_id", "text_crc32"]
    ranged = common.save(rated.repartitionByRange(common.shuffle_partitions(spark), *order).withColumn("range_id", F.spark_partition_id()), "ranges")
    key = ["source", "class"]
    one = (F.col("part") > 0).cast("long")
    by_range = ranged.groupBy("range_id", *key).agg(
        F.sum("part").alias("parts"), F.sum(one).alias("rows"), F.sum(F.col("part") * F.col("size")).cast("double").alias("mass"), F.sum(one * F.col("size")).cast("double").alias("words"), F.max("part").alias("most")
    )
    by_range = common.save(by_range, "range_sums")  # a row for every range and class that meet: ranges and classes together
    wanted = rounded(by_range.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("parts", "rows", "mass", "words")], F.max("most").alias("most")))
    before = Window.partitionBy(*key).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    begun = {f"base_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("parts", "rows")}
    bases = by_range.withColumns(begun).alias("b").join(wanted.alias("w"), [F.col(f"b.{c}").eqNullSafe(F.col(f"w.{c}")) for c in key])
    bases = bases.select("b.range_id", *[F.col(f"b.{c}").alias(f"of_{c}") for c in key], "w.alike", "w.extra", F.when(F.col("w.alike"), F.col("b.base_rows")).otherwise(F.col("b.base_parts")).alias("base"), F.when(F.col("w.alike"), F.col("w.rows")).otherwise(F.col("w.parts")).alias("all_parts"))
    within = Window.partitionBy("range_id", *key).orderBy(*order[2:]).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({"upto_parts": F.sum("part").over(within), "upto_rows": F.sum(one).over(within)}).withColumnRenamed("range_id", "in_range")
    picked = summed.join(bases, (F.col("in_range") == F.col("range_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("class") == F.col("of_class")))
    picked = picked.withColumns({"part": F.when(F.col("alike"), one).otherwise(F.col("part")), "upto": F.when(F.col("alike"), F.col("upto_rows")).otherwise(F.col("upto_parts"))})
    picked = picked.withColumns({"high": (F.col("base") + F.col("upto")).cast("decimal(38,0)"), "all_parts": F.col("all_parts").cast("decimal(38,0)")})
    extra = F.when(F.col("extra") > 0, F.expr("((2 * high * extra + all_parts) div (2 * all_parts)) - ((2 * (high - part) * extra + all_parts) div (2 * all_parts))")).otherwise(F.lit(0))
    return picked.select("doc_id", "text_crc32", "source", "size", "source_size", "target", "rate", (F.col("whole") + extra).cast("long").alias("n_copies"))


def rounded(classes: DataFrame) -> DataFrame:
    """extra: how many documents of each class get one copy more, what is left over carried on within the source;
    alike: whether they count alike, as so many copies would bring some part round twice.

    A source has some 150 classes at most, so its list is short whatever its documents. No more is dealt than
    gives every document with a part one at most.
    """

    def step(acc: Column, x: Column) -> Column:
        want = acc["carry"] + x["mass"] / UNITS
        size = x["mass"] / F.greatest(x["parts"], F.lit(1))
        by_part = F.round(F.try_divide(want, size))  # a class without a part has no size
        alike = by_part > F.floor(x["parts"] / F.greatest(x["most"], F.lit(1)))
        plain = x["words"] / F.greatest(x["rows"], F.lit(1))
        dealt = F.when(alike, F.least(x["rows"].cast("double"), F.round(F.try_divide(want, plain)))).otherwise(by_part)
        extra = F.when(x["mass"] > 0, F.greatest(F.lit(0.0), dealt)).otherwise(F.lit(0.0))
        out = F.struct(x["class"].alias("class"), x["parts"].alias("parts"), x["rows"].alias("rows"), F.coalesce(alike, F.lit(False)).alias("alike"), extra.cast("long").alias("extra"))
        return F.struct((want - extra * F.when(alike, plain).otherwise(size)).alias("carry"), F.concat(acc["out"], F.array(out)).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.from_json(F.lit("[]"), "array<struct<class:int,parts:bigint,rows:bigint,alike:boolean,extra:bigint>>").alias("out"))
    lists = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "parts", "rows", "mass", "words", "most")), asc=False).alias("classes"))
    return lists.select("source", F.explode(F.aggregate("classes", start, step)["out"]).alias("x")).select("source", "x.*")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """The mixed corpus: every document as many times as it has copies, with its own columns."""
    found = copies(docs, weights).groupBy("doc_id", "text_crc32").agg(F.sum("n_copies").alias("n_copies"), F.count(F.lit(1)).alias("n_rows")).where("n_copies > 0")
    found = common.save(found, "dealt")
    crc = F.crc32(F.coalesce(F.col("d.text"), F.lit("")).cast("binary"))

    def joined(part: DataFrame) -> DataFrame:
        both = docs.alias("d").join(part.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (crc == F.col("c.text_crc32")))
        return both.select(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"c.{c}") for c in part.columns])

    def copied(rows: DataFrame, times: Column) -> DataFrame:
        return rows.select("row", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("copy")).select("row.*")

    out = copied(joined(found.where("n_rows = 1")), F.col("n_copies"))
    repeated = found.where("n_rows > 1")
    if repeated.isEmpty():
        return out
    # equal rows share their copies evenly, the first ones get what is left over
    position = F.row_number().over(Window.partitionBy("doc_id", "text_crc32").orderBy(F.lit(1)))
    each = F.floor(F.col("n_copies") / F.col("n_rows")) + (F.col("position") <= F.col("n_copies") % F.col("n_rows")).cast("long")
    return out.unionByName(copied(joined(repeated).withColumn("position", position), each))


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, beside its source's size and target."""
    found = copies(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).cast("long").alias("taken"))
