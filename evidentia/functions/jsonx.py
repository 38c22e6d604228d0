"""JSON that models write: found in prose, read with defaults, merged and searched."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def first_json(text: str | None) -> str | None:
    """The whole text if it is JSON (fences aside), else its first balanced object or list that is, else None."""
    if not text:
        return None
    decoder = json.JSONDecoder()
    bare = text.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    try:
        json.loads(bare)
        return bare
    except ValueError:
        pass
    at = 0
    while (found := min((i for i in (bare.find("{", at), bare.find("[", at)) if i >= 0), default=-1)) >= 0:
        try:
            _, end = decoder.raw_decode(bare, found)
            return bare[found:end]
        except ValueError:
            at = found + 1
    return None


@F.pandas_udf(StringType())
def json_in(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """first_json() of every text; a balanced segment needs a scanner that built-in functions lack."""
    for batch in texts:
        yield batch.map(first_json)


def confidence(json_text: Column, path: str, default: float) -> Column:
    """A number at a path, within 0 and 1; the default where it is missing or no number."""
    value = F.coalesce(F.get_json_object(json_text, path).try_cast("double"), F.lit(default))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def merged_with_prefix(base: Column, other: Column, prefix: str) -> Column:
    """Two maps as one, the second's keys with a prefix and its nulls left out."""
    named = F.transform_keys(F.map_filter(other, lambda k, v: v.isNotNull()), lambda k, v: F.concat(F.lit(prefix), k))
    return F.map_concat(base, named)


def map_differences(expected: Column, actual: Column) -> Column:
    """Rows (key, expected, actual, delta) of two numeric maps for every key of either."""
    keys = F.array_sort(F.array_union(F.map_keys(expected), F.map_keys(actual)))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), expected[k].alias("expected"), actual[k].alias("actual"), (actual[k] - expected[k]).alias("delta")))


def strings_in(rows: DataFrame, column: str) -> DataFrame:
    """(row id columns, string) of every string anywhere in a JSON column, objects and lists opened to any depth."""

    def every(value):
        if isinstance(value, str):
            yield value
        elif isinstance(value, (list, dict)):
            for inner in value.values() if isinstance(value, dict) else value:
                yield from every(inner)

    @F.pandas_udf("array<string>")
    def found(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: list(every(json.loads(t))) if (t := first_json(t)) else [])

    return rows.withColumn("string", F.explode(found(F.col(column))))
