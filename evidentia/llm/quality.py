"""Quality rules: fixed bounds, and robust multivariate outliers within each language and source.

Every document gives a vector of transformed statistics. For each language and source the minimum
covariance determinant estimate looks for the half of the documents whose covariance has the smallest
determinant, by concentration steps from several starts until none of them gets smaller, and is reweighted
once; documents far from it in Mahalanobis distance are rejected. Small groups are judged by their language,
and by all documents where that is small too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FEATURES = ("f_word", "f_symbol", "f_line", "f_repeat")
#: Spread of a feature that the chosen documents hardly vary in, in its own units; any larger spread is the
#: documents' own. At these a document of 50 words and 250 characters with one window of three words twice, one line
#: twice or five symbols is just within the cut-off.
RIDGES = (0.02, 0.16, 0.375, 0.184)
#: Squared distance beyond which a document is rejected, and that within which one counts at the reweighting:
#: the 0.999 and 0.975 quantiles of chi-square with four degrees of freedom.
CUTOFF, INNER = 18.47, 11.14
#: Most concentration steps, the half a step keeps, and the least documents that a group is judged by.
STEPS, HALF, LEAST = 30, 0.5, 30
#: Percentiles whose distance is the spread of a start (None: mean and covariance of all), and how many spreads of a normal lie between.
STARTS = ((0.25, 0.75, 1.349), (0.05, 0.95, 3.29), None)
#: By how much the covariance of a normal exceeds that of its inner half, by dimensions, and that of its inner 0.975 of four.
WIDER, WIDER_INNER = (1.0, 7.01, 3.26, 2.46, 2.11), 1.09


def window_hashes(words: Column) -> Column:
    """A hash of every three-word window, null where there are fewer than two windows."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(None)).otherwise(hashes)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of the base rules for every document.

    Words stand between blanks; a null text has none. Windows are compared by 64-bit hashes. Only a text
    that has a repeated window is sorted by them.
    """
    text = common.text_or_empty()
    one = docs.select("doc_id", "lang", "source", text.alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0)))
    one = one.withColumns({"n_words": F.size("words").cast("long"), "word_chars": F.length(F.regexp_replace("text", common.BLANK, "")).cast("long"), "hashes": window_hashes(F.col("words"))})
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(common.WORD))
    one = one.withColumns({"n_symbols": (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long"), "lines": lines})
    one = one.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    has = F.col("hashes").isNotNull() & (F.size(F.array_distinct("hashes")) < F.size("hashes"))
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    one = one.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(has, placed).alias("placed"))
    same = lambda p, k: F.coalesce(p["h"] == F.get(F.col("placed"), k)["h"], F.lit(False))
    marked = F.transform("placed", lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"]))
    one = one.withColumn("at", F.sort_array(F.array_compact(marked)))
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("at"), k + 1) - p, F.lit(3)))), F.lit(0), lambda acc, x: acc + x)
    return one.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def vectors(counts: DataFrame) -> DataFrame:
    """Adds the transformed statistics: logs of mean word length and of the shares of symbols, lines and repeats."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counts.withColumns({
        "f_word": F.log((F.col("word_chars") + 1) / n),
        "f_symbol": F.log(1 + 50 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "f_line": F.log(1 + 20 * F.col("n_dup_lines") / F.greatest(n / 10, F.lit(1.0))),
        "f_repeat": F.log(1 + 10 * F.col("n_repeat_words") / n),
    })


def factored(est: DataFrame) -> DataFrame:
    """Replaces the covariances s<i><j> by their Cholesky factor l<i><j>, one row of plain columns per group."""
    d = len(FEATURES)
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(f"s{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # column by column, so that no expression holds another's text
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return est.drop(*[f"s{i}{j}" for i in range(d) for j in range(i + 1)])


def outlying(rows: DataFrame) -> DataFrame:
    """Adds distance2 to every row: from the robust centre of its group, null where all rows together are too few.

    A group is a language and source, a language, or all rows: the first that has LEAST rows. Estimates are
    rows of sums, so that a hot group is summed in parallel and never gathered.
    """
    d, by = len(FEATURES), ("g_level", "g_lang", "g_source")
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    cells = common.save(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "groups")
    langs = cells.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    plan = cells.alias("c").join(langs.alias("l"), F.col("c.lang").eqNullSafe(F.col("l.lang"))).select("c.lang", "c.source", F.when(F.col("n") >= LEAST, 0).when(F.col("n_lang") >= LEAST, 1).otherwise(2).alias("g_level"))
    plan = plan.withColumns({"g_lang": F.when(F.col("g_level") < 2, F.col("lang")), "g_source": F.when(F.col("g_level") < 1, F.col("source"))})
    own = rows.alias("r").join(F.broadcast(plan.alias("p")), F.col("r.lang").eqNullSafe(F.col("p.lang")) & F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", *by)
    own = common.save(own, "grouped")
    # the rows that estimates are made of: each group's own, and whole languages or all rows where those judge
    part = own.where("g_level = 0").select(*by, *FEATURES)
    wanted = plan.where("g_level = 1").select(F.col("lang").alias("want")).distinct()
    part = part.unionByName(rows.alias("r").join(F.broadcast(wanted), F.col("r.lang").eqNullSafe(F.col("want")), "left_semi").select(F.lit(1).alias("g_level"), F.col("lang").alias("g_lang"), F.lit(None).cast("string").alias("g_source"), *FEATURES))
    if not plan.where("g_level = 2").isEmpty():
        part = part.unionByName(rows.select(F.lit(2).alias("g_level"), F.lit(None).cast("string").alias("g_lang"), F.lit(None).cast("string").alias("g_source"), *FEATURES))
    part = common.save(part, "estimated")

    def same(a: str, b: str, keys: tuple[str, ...]) -> list[Column]:
        return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys]

    def estimate(chosen: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        return chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *[F.avg(f).alias(f"mu{i}") for i, f in enumerate(FEATURES)], *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"s{i}{j}") for i, j in pairs])

    def ridged(est: DataFrame) -> DataFrame:
        # a larger diagonal keeps the matrix positive
        return est.withColumns({f"s{i}{i}": F.greatest(F.col(f"s{i}{i}"), F.lit(RIDGES[i] ** 2)) for i in range(d)})

    def with_distance(to: DataFrame, est: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        est = factored(est)
        joined = to.alias("r").join(F.broadcast(est.alias("e")), same("r", "e", keys), "left").select("r.*", *[f"e.{c}" for c in est.columns if c not in keys])
        for i, f in enumerate(FEATURES):
            rest = F.col(f) - F.col(f"mu{i}")
            for k in range(i):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
            joined = joined.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
        squared = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, d)), F.col("z0") * F.col("z0"))
        return joined.select(*to.columns, squared.alias("distance2"))

    def log_det(est: DataFrame) -> DataFrame:
        return factored(est).select(*by, "start", sum((2 * F.log(f"l{i}{i}") for i in range(1, d)), 2 * F.log("l00")).alias("log_det"))

    keyed = (*by, "start")
    points = sorted({0.5, *(p for s in STARTS if s for p in s[:2])})
    middle = part.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), *[F.percentile_approx(f, points, 1000).alias(f"q{i}") for i, f in enumerate(FEATURES)])
    at = lambda i, p: F.get(f"q{i}", F.lit(points.index(p)))
    est = None
    for k, start in enumerate(STARTS):
        if start is None:
            one = estimate(part, by)
        else:
            low, high, spreads = start
            one = middle.select(*by, "m", *[at(i, 0.5).alias(f"mu{i}") for i in range(d)], *[(F.pow((at(i, high) - at(i, low)) / spreads, 2) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in pairs])
        one = one.withColumn("start", F.lit(k))
        est = one if est is None else est.unionByName(one)
    est = common.save(ridged(est), "mcd_start")
    tried = part.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(len(STARTS))])))
    for step in range(STEPS):
        far = with_distance(tried, est, keyed)
        bound = far.groupBy(*keyed).agg(F.percentile_approx("distance2", HALF, 1000).alias("bound"))
        half = far.alias("r").join(F.broadcast(bound.alias("b")), same("r", "b", keyed)).where("r.distance2 <= b.bound").select("r.*")
        after = common.save(ridged(estimate(half, keyed)), f"mcd_{step}")
        # the start is no half's: it has no determinant to compare with
        less = step == 0 or log_det(after).alias("a").join(log_det(est).alias("b"), same("a", "b", keyed)).agg(F.max(F.col("b.log_det") - F.col("a.log_det"))).first()[0] or 0.0
        est = after
        if less is not True and less < 1e-4:
            break
    best = log_det(est).groupBy(*by).agg(F.min_by("start", F.struct("log_det", "start")).alias("best"))
    est = est.alias("e").join(best.alias("b"), same("e", "b", by) + [F.col("e.start") == F.col("b.best")]).select("e.*").drop("start")
    varied = sum((F.col(f"s{i}{i}") > RIDGES[i] ** 2).cast("int") for i in range(d))
    wider = F.get(F.array(*[F.lit(w) for w in WIDER]), varied)
    is_own = {(i, j): (F.col(f"s{i}{i}") > RIDGES[i] ** 2) & (F.col(f"s{j}{j}") > RIDGES[j] ** 2) for i, j in pairs}
    est = est.select(*by, "m", *[f"mu{i}" for i in range(d)], *[F.when(is_own[i, j], F.col(f"s{i}{j}") * wider).otherwise(F.col(f"s{i}{j}")).alias(f"s{i}{j}") for i, j in pairs])
    est = common.save(est, "mcd_raw")
    inner = with_distance(part, est, by).where(F.col("distance2") <= INNER)
    est = estimate(inner, by)
    est = common.save(ridged(est.select(*by, "m", *[f"mu{i}" for i in range(d)], *[(F.col(f"s{i}{j}") * WIDER_INNER).alias(f"s{i}{j}") for i, j in pairs])), "mcd")
    enough = middle.where(F.col("m") >= LEAST).select(*by)
    return with_distance(own, est.alias("e").join(enough.alias("n"), same("e", "n", by), "left_semi"), by).select(*rows.columns, "distance2")


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, distance2 and kept for every document.

    Documents that fail a base rule are not kept. Of the others, the estimates reject those far from their
    group (a null language or source makes a group like any other); only where fewer than LEAST documents
    pass the base rules in all is none rejected. Empty and null texts have no words and fail. Other columns
    are ignored.
    """
    rows = vectors(common.save(statistics(docs), "statistics"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", base)
    passed = outlying(rows.where("NOT base_failed")).withColumn("kept", F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True)))
    return passed.unionByName(rows.where("base_failed").withColumns({"distance2": F.lit(None).cast("double"), "kept": F.lit(False)}))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
