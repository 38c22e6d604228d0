"""How readable a text is: shares of letters, garbage, known and plausible words, and marks of bad recognition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# German function words, weights of the score and its levels.
FUNCTION_WORDS = (
    "der die das den dem des ein eine einer eines einem einen und oder aber sondern doch ist sind war waren wird werden wurde würden hat haben hatte hatten "
    "in im an am auf aus bei mit nach von vom zu zum zur für über unter durch gegen ohne um bis seit nicht auch nur noch schon sich sie er es ich wir ihr als wie wenn dass"
).split()
WEIGHTS = {"letters": 0.30, "readable": 0.30, "german": 0.25, "structure": 0.15}
LEVELS = ((0.8, "good"), (0.5, "acceptable"), (0.3, "poor"))

SPECIALS = r"[@#$%^&*=_+{}\[\]|\\<>~`]"
# digits beside an O or after an l that is not the first character, and words parted at the end of a line; both are
# searched from their rarest character on, as five choices at every character took most of the time
ARTEFACTS = (r"[0-9](?:[Oo]|(?<=[Oo][0-9])|(?<=(?s:.)l[0-9]))", r"-(?<=[a-zäöüß]-)[ \t\r]*\n[a-zäöüß]")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def assessed(docs: DataFrame) -> DataFrame:
    """Adds letters, garbage, readable, german (shares), artefacts, language, score, level and gate to docs.

    Empty and null texts score nothing and fail the gate.
    """
    text = F.trim(F.coalesce(F.col("text"), F.lit("")))
    without = lambda chars: F.length(F.regexp_replace("_t", f"[{chars}]+", ""))
    words, low = F.regexp_extract_all("_t", F.lit("[a-zäöüßA-ZÄÖÜ]{2,}"), F.lit(0)), F.regexp_extract_all(F.lower("_t"), F.lit("[a-zäöüß]+"), F.lit(0))
    known = lambda w: w.isin(*FUNCTION_WORDS)
    out = docs.withColumn("_t", text).withColumns({"_solid": without(" \\n\\t"), "_words": F.transform(words, lambda w: F.lower(w)), "_low": low})
    out = out.withColumns({
        "letters": _share(F.col("_solid") - without("\\p{L} \\n\\t"), F.col("_solid")),
        "garbage": _share(without("[^@#$%^&*=_+{}\\[\\]|\\\\<>~`\\p{Cntrl}] \\n\\t"), F.col("_solid")),
        "readable": _share(F.size(F.filter("_words", lambda w: known(w) | ((F.length(w) > 2) & F.rlike(w, F.lit("[aeiouäöü]"))))), F.size("_words")),
        "german": _share(F.size(F.filter("_low", known)), F.size("_low")),
        "artefacts": F.rlike("_t", F.lit(SPECIALS)) | F.rlike("_t", F.lit(ARTEFACTS[0])) | F.rlike("_t", F.lit(ARTEFACTS[1])),
    })
    umlauts = F.rlike("_t", F.lit("[äöüßÄÖÜ]"))
    score = (
        WEIGHTS["letters"] * F.least(F.lit(1.0), F.col("letters") / 0.8) * F.greatest(F.lit(0.0), 1 - F.col("garbage") * 8)
        + WEIGHTS["readable"] * F.col("readable")
        + WEIGHTS["german"] * F.least(F.lit(1.0), F.col("german") / 0.25)
        + WEIGHTS["structure"] * F.when(F.rlike("_t", F.lit("[.!?]")), F.lit(1.0)).otherwise(F.lit(0.3)) * F.when(F.col("artefacts"), F.lit(0.6)).otherwise(F.lit(1.0))
    )
    out = out.withColumns({"language": F.when(umlauts & (F.size("_low") > 0) | (F.col("german") >= 0.15), F.lit("de")).otherwise(F.lit("unknown")), "score": F.when(F.length("_t") > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)).otherwise(F.lit(0.0))})
    level = F.lit("unusable")
    for bound, name in reversed(LEVELS):
        level = F.when(F.col("score") >= bound, F.lit(name)).otherwise(level)
    gate = F.when(F.col("score") < 0.3, F.lit("fail")).when(F.col("score") < 0.8, F.lit("warn")).otherwise(F.lit("pass"))
    return out.withColumns({"level": level, "gate": gate}).drop("_t", "_solid", "_words", "_low")
