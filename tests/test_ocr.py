"""Marks of bad recognition, against a plain pattern, and how long the search for them takes."""

import random
import re
import time

from pyspark.sql import functions as F

from evidentia.functions import ocr

PLAIN = re.compile(r"[0-9][Oo]|[Oo][0-9]|[^0-9]l[0-9]|[0-9]l[0-9]|[a-zäöüß]-[ \t\r]*\n[a-zäöüß]|[@#$%^&*=_+{}\[\]|\\<>~`]")


def test_artefacts(spark):
    pick = random.Random(7)
    texts = ["".join(pick.choices(["0", "5", "O", "o", "l", "-", "\n", "\r", " ", "\t", "a", "ß", "E", "😀", "#"], k=pick.randrange(8))) for _ in range(3000)] + [None, "", "l5", "xl5", "\nl5x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in ocr.assessed(docs).collect():
        text = (r.text or "").strip(" ")
        solid = [c for c in text if c not in " \n\t"]
        assert r.artefacts == bool(PLAIN.search(text)), repr(text)
        assert r.letters == (sum(map(str.isalpha, solid)) / len(solid) if solid else 0)
        assert r.garbage == (sum(c in "@#$%^&*=_+{}[]|\\<>~`" or c < " " for c in solid) / len(solid) if solid else 0)


def test_the_search_for_artefacts_is_no_slower_than_for_letters(spark):
    docs = spark.range(16, numPartitions=4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("Recht haben und Recht bekommen, sagt der Volksmund. "), 10_000).alias("text")).cache()
    docs.count()

    def seconds(column: str) -> float:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            ocr.assessed(docs).select(column).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds("artefacts") < 1.5 * seconds("letters") + 0.1
