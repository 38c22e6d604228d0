"""Text kernels as column expressions; Java's regular expressions need (?U) to treat all scripts alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Articles, prepositions, pronouns and question words that are no keywords.
STOP_WORDS = (
    "der die das den dem des ein eine einer eines einem einen und oder aber auch als auf aus bei bis durch für gegen hat haben ich ihr ihre "
    "ist kann mein meine mit nach nicht noch nur sein sich sie sind über um von vor war was welche wenn werden wie wird wurde zum zur zwischen"
).split()


def collapsed(text: Column) -> Column:
    """No-break spaces and zero-width characters cleaned, every run of white space one blank, ends trimmed."""
    spaced = F.regexp_replace(text, "[\\u00A0\\u202F]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, "[\\u200B-\\u200D\\uFEFF\\u00AD]", ""), "[ \\t\\r\\n\\f\\x0B]+", " "))


def normalized(text: Column) -> Column:
    """Invisible characters dropped, blanks collapsed within lines, lines trimmed, at most one empty line."""
    out = F.regexp_replace(text, "[\\u200B-\\u200D\\uFEFF\\u00AD]", "")
    out = F.regexp_replace(out, "[ \\t\\u00A0]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, " ?\\n ?", "\n"), "\\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "^\\n+", ""), "\\n+$", ""))


def sentences(text: Column) -> Column:
    """Sentences: parted after . ! ? where white space and a capital follow; blank ones are dropped."""
    return F.filter(F.split(text, "(?<=[.!?])[ \\t\\r\\n]+(?=[A-ZÄÖÜ])"), lambda s: F.trim(s) != "")


def norm_references(text: Column) -> Column:
    """Citations such as ``§ 11b Abs. 2 SGB II``: arrays of paragraph (with its letter) and statute."""
    plain = F.regexp_replace(text, "\\s*[na]\\.\\s*F\\.", "")
    found = F.regexp_extract_all(plain, F.lit("(§§?\\s*[0-9]+[a-z]?(?:/[0-9]+[a-z]?)*(?:\\s*Abs\\.\\s*[0-9]+[a-z]?)?(?:\\s*S(?:atz|\\.)\\s*[0-9]+)?\\s+(?:SGB\\s+[IVX]+|BGB|VwGO|SGG|EStG|GG))"), F.lit(1))
    one = lambda m: F.transform(
        F.split(F.regexp_extract(m, "§§?\\s*([0-9a-z/]+)", 1), "/"),
        lambda p: F.concat(F.lit("§ "), p, F.lit(" "), F.regexp_replace(F.regexp_extract(m, "(SGB\\s+[IVX]+|BGB|VwGO|SGG|EStG|GG)$", 1), "\\s+", " ")),
    )
    return F.array_distinct(F.flatten(F.transform(found, one)))


def with_keywords(docs: DataFrame, most: int = 8) -> DataFrame:
    """Adds keywords: up to `most` alphabetic words of over two letters, no stop words, capitalised and longer ones first.

    Words that differ only in case count once, as they first stand. The steps are columns of their own, so
    that no list is sorted again for each of its words.
    """
    words = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-zÄÖÜäöüßÀ-ÿ]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*STOP_WORDS))
    out = docs.withColumn("_words", words)
    out = out.withColumn("_placed", F.array_sort(F.transform("_words", lambda w, i: F.struct(F.lower(w).alias("low"), i.alias("i"), w.alias("w")))))
    out = out.withColumn("_first", F.filter("_placed", lambda x, k: F.coalesce(F.get("_placed", k - 1)["low"] != x["low"], F.lit(True))))
    out = out.withColumn("_keyed", F.array_sort(F.transform("_first", lambda x: F.struct(F.when(F.rlike(x["w"], F.lit("^[A-ZÄÖÜÀ-Þ]")), F.lit(0)).otherwise(F.lit(1)).alias("kind"), (-F.length(x["w"])).alias("size"), x["i"].alias("i"), x["w"].alias("w")))))
    return out.withColumn("keywords", F.transform(F.slice("_keyed", 1, most), lambda x: x["w"])).drop("_words", "_placed", "_first", "_keyed")


def trimmed(text: Column, most: int) -> Column:
    """Text of at most `most` characters; a longer one ends in three dots."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def hierarchy_to_norm(path: Column) -> Column:
    """``A > § 1 > Abs. 2`` as ``§ 1 Abs. 2 A``; a path of one step stays."""
    steps = F.transform(F.split(path, ">"), lambda s: F.trim(s))
    return F.when(F.size(steps) < 2, path).otherwise(F.concat(F.array_join(F.slice(steps, F.lit(2), F.size(steps)), " "), F.lit(" "), F.element_at(steps, 1)))


def version_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def text_hash(text: Column) -> Column:
    return F.md5(text)


def contained(needle: Column, hay: Column) -> Column:
    """How a quote stands in its source: exact, with blanks collapsed or without hyphens, or null.

    What stands there with blanks collapsed does so without hyphens as well, so this is asked once.
    """
    bare = lambda c: F.replace(F.lower(collapsed(c)), F.lit("-"), F.lit(""))
    return (
        F.when(F.contains(hay, needle), F.lit("exakt"))
        .when(F.contains(bare(hay), bare(needle)), F.lit("normalisiert"))
    )
