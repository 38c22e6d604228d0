"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

The kernel compares two strings by the three-character subsequences they share, each weighted down by the
length it spreads over; characters put between those of an insult only lower its weight. Strings are units of
sentences: runs of one to three words, whole sentences, parts between punctuation, stretches of long words.
Subsequences run across the words of a unit. Landmarks are units of the labelled sample. In the space they span
the machine is linear, and since the kernel has an explicit feature map, its weights fold back into one table
over subsequences. Sums of that table up to each place of a text give the exact value of any unit by a few
differences, so every unit of every sentence is scored.

Labels mark documents. A sentence of a toxic document counts as toxic if it holds a unit that stands out in
toxic documents; training goes on with each such sentence's highest unit against ordinary units and the highest
units of clean documents, as in multiple-instance learning. A document scores by its highest unit and by how
high its three highest words are together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: At most so many labelled documents of either label are learned from, those with the least hash of their id.
SAMPLE = 4000
#: Units of the sample that training looks at: so many that stand out, and so many ordinary ones.
STANDING_OUT, ORDINARY = 3000, 6000
#: Sentences of toxic documents learned from at most.
SENTENCES = 20_000
LANDMARKS, ROUNDS = 128, 3
DECAY = 0.6
#: Steps from one character of a subsequence to the next: up to two characters may stand between.
STEP = 3
STEPS = tuple((a, b) for a in range(1, STEP + 1) for b in range(1, STEP + 1))
#: Codes: 0 parts sentences, 1 begins a word, 2 to 27 are the letters a to z, other letters and digits share the rest.
CODES, APART = 64, 2 * STEP
#: Words in a unit at most; longer words are also scored by stretches of so many letters, each half of it on.
WORDS, STRETCH = 3, 28
CUTOFF = 0.7

_DROP, _BLANK, _STOP, _LINE = 255, 254, 253, 252


class Model(NamedTuple):
    """weights: over the codes of three characters; the rest: bias, and the three numbers of the score."""

    weights: np.ndarray
    bias: float
    curve: tuple[float, float, float] = (1.0, 0.0, 0.0)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What each character of the basic plane is, after lower-casing; others are dropped."""
    out = np.full(65_536, _DROP, np.uint8)
    for p in range(65_536):
        c = chr(p)
        if "a" <= c <= "z":
            out[p] = p - 95
        elif c in "\n\r":
            out[p] = _LINE
        elif c.isspace():
            out[p] = _BLANK
        elif c.isalnum():
            out[p] = 28 + p * 7 % 36
        elif c in ".!?":
            out[p] = _STOP
    return out


class Parsed(NamedTuple):
    """codes of a text; begin and end of its units, of which the first n_words are its words; sentence of each unit."""

    codes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    sentence: np.ndarray
    n_words: int


_NOTHING = Parsed(*[np.zeros(0, np.int64)] * 4, 0)


def _spelled(at: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Of words of one letter, four or more of them with up to three characters between: all but the first."""
    single = np.diff(np.append(heads, len(at))) == 1
    near = np.append(False, single[1:] & single[:-1] & (np.diff(at[heads]) <= 4))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], near, [0]])))
    begin, end = edges[::2], edges[1::2]
    runs = [np.arange(b, e) for b, e in zip(begin.tolist(), end.tolist(), strict=True) if e - b >= 3]
    return heads[np.concatenate(runs)] if runs else heads[:0]


def parsed(text: str) -> Parsed:
    """Letters and digits of a text, word by word, and its units. Punctuation within a word is left out;
    runs of single letters are closed up to one word; a sentence ends at a line feed or at one of .!? before a blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _kinds()[np.minimum(points, 65_535)]
    at = np.flatnonzero(kind < _LINE)
    if not len(at):
        return _NOTHING
    letters = kind[at]
    others = np.flatnonzero(kind >= _LINE)
    what = kind[others]
    after = kind[np.minimum(others + 1, len(kind) - 1)]
    ends = np.append(0, np.cumsum((what == _LINE) | ((what == _STOP) & ((after == _BLANK) | (after == _LINE)))))
    parts = np.append(0, np.cumsum((what == _LINE) | (what == _BLANK)))
    # between letter g and the next stand the others from low to high
    g = np.flatnonzero(np.diff(at) > 1)
    low, high = at[g] - g, at[g + 1] - g - 1
    first, opens, torn = np.zeros((3, len(at)), bool)
    first[g + 1] = parts[high] > parts[low]
    opens[g + 1] = ends[high] > ends[low]
    first[0] = opens[0] = True
    first |= opens
    heads = np.flatnonzero(first)
    spelled = _spelled(at, heads)
    if len(spelled):
        first[spelled] = opens[spelled] = False
        heads = np.flatnonzero(first)
    torn[g + 1] = True
    torn[spelled] = False
    torn &= ~first
    place = np.arange(len(at)) + np.cumsum(first + opens * APART)
    codes = np.zeros(int(place[-1]) + 1 + APART, np.int64)
    codes[place] = letters
    codes[place[first] - 1] = 1
    begin = place[first] - 1
    end = place[np.append(heads[1:], len(at)) - 1] + 1
    sentence = np.cumsum(opens)[first]
    n = len(begin)
    begins, all_ends, sentences = [begin], [end], [sentence]
    for k in range(2, WORDS + 1):
        same = np.flatnonzero(sentence[k - 1 :] == sentence[: n - k + 1]) if n >= k else np.zeros(0, np.int64)
        begins.append(begin[same])
        all_ends.append(end[same + k - 1])
        sentences.append(sentence[same])
    edge = np.flatnonzero(np.diff(sentence))
    whole_first, whole_last = np.append(0, edge + 1), np.append(edge, n - 1)
    longer = whole_last - whole_first >= WORDS
    begins.append(begin[whole_first[longer]])
    all_ends.append(end[whole_last[longer]])
    sentences.append(sentence[whole_first[longer]])
    if torn.any():  # parts between punctuation, of the words that have any
        cut = np.flatnonzero(first | torn)
        part_begin, part_end = place[cut] - first[cut], place[np.append(cut[1:], len(at)) - 1] + 1
        word = np.cumsum(first)[cut] - 1
        held = np.bincount(word, minlength=n)[word] > 1
        begins.append(part_begin[held])
        all_ends.append(part_end[held])
        sentences.append(sentence[word[held]])
    long = np.flatnonzero(end - begin > STRETCH + 1)
    if len(long):
        steps = (end[long] - begin[long] - STRETCH // 2) // (STRETCH // 2) + 1
        nth = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
        start = np.repeat(begin[long], steps) + nth * (STRETCH // 2)
        begins.append(start)
        all_ends.append(np.minimum(start + STRETCH, np.repeat(end[long], steps)))
        sentences.append(np.repeat(sentence[long], steps))
    return Parsed(codes, *(np.concatenate(x) for x in (begins, all_ends, sentences)), n)


@lru_cache(maxsize=1)
def _norms() -> np.ndarray:
    return np.array([sum(max(0, n - a - b) * DECAY ** (2 * (a + b + 1)) for a, b in STEPS) for n in range(4096)])


def norms(lengths: np.ndarray) -> np.ndarray:
    """Length of a unit's feature vector as if all its subsequences differed, which any string of its length has."""
    known = _norms()
    slope = known[-1] - known[-2]
    squared = np.where(lengths < len(known), known[np.minimum(lengths, len(known) - 1)], known[-1] + slope * (lengths - len(known) + 1))
    return np.sqrt(np.maximum(squared, 1e-12))


def features(units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, value) of each unit's subsequences, not yet added up: the kernel's feature map."""
    sizes = np.array([len(u) for u in units], np.int64)
    codes = np.frombuffer(b"".join(u + bytes(APART) for u in units), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(units)), sizes + APART)
    rows, keys, values = [], [], []
    for a, b in STEPS:
        x, y, z = codes[: -a - b], codes[a:-b], codes[a + b :]
        there = np.flatnonzero((x > 0) & (y > 0) & (z > 0))
        rows.append(owner[there])
        keys.append((x[there] * CODES + y[there]) * CODES + z[there])
        values.append(np.full(len(there), DECAY ** (a + b + 1)))
    row, key, value = map(np.concatenate, (rows, keys, values))
    return row, key, value / norms(sizes)[row]


def values_of(text: Parsed, model: Model) -> np.ndarray:
    """The machine's exact value of every unit; one too short for a subsequence gets the bias."""
    codes, begin, end = text.codes, text.begin, text.end
    out = np.zeros(len(begin))
    first, second, weights = codes * (CODES * CODES), codes * CODES, model.weights
    by_span: dict[int, np.ndarray] = {}
    for a, b in STEPS:
        n = len(codes) - a - b
        if n > 0:
            got = weights.take(first[:n] + second[a : a + n] + codes[a + b :])
            by_span[a + b] = by_span[a + b] + got if a + b in by_span else got
    for span, got in by_span.items():
        sums = np.concatenate([[0.0], np.cumsum(got, dtype=np.float64)])
        last = np.maximum(end - span, begin)
        out += DECAY ** (span + 1) * (sums[np.minimum(last, len(got))] - sums[np.minimum(begin, len(got))])
    return out / norms(end - begin) + model.bias


def evidence(text: str, model: Model) -> tuple[float, float]:
    """A text's highest value, and the mean of its three highest words; the bias stands for what it lacks."""
    one = parsed(text)
    if not one.n_words:
        return model.bias, model.bias
    found = values_of(one, model)
    words = found[: one.n_words]
    top = np.sort(words)[-3:] if len(words) <= 8 else np.partition(words, len(words) - 3)[-3:]
    return float(found.max()), float((top.sum() + (3 - len(top)) * model.bias) / 3)


def score_of(text: str, model: Model) -> float:
    best, mean = evidence(text, model)
    a, b, c = model.curve
    return float(1 / (1 + np.exp(-np.clip(a * best + b * mean + c, -40, 40))))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of a bounded sample of the rows to learn from, written once, and how many rows have either
    label; equal texts count once."""
    usable = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = common.save(usable, "labels")
    chosen = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    # at most twice `sample` rows of two numbers
    ids = F.broadcast(common.save(chosen[0].unionByName(chosen[1]), "sample_ids"))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(ids, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    return common.save(rows.repartition(common.shuffle_partitions(docs.sparkSession)), "sample"), dict(usable.groupBy("toxic").count().collect())


def units_of(one: Parsed) -> list[bytes]:
    raw = one.codes.astype(np.uint8).tobytes()
    return [raw[b:e] for b, e in zip(one.begin.tolist(), one.end.tolist(), strict=True)]


def standing_out(sample: DataFrame, bad: int, good: int) -> tuple[dict[bytes, float], list[bytes]]:
    """Units of one to three words that stand out in toxic documents with their log odds, and ordinary ones."""

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, k in zip(batch["text"], batch["toxic"], strict=True):
                found = {u for u in units_of(parsed(text)) if 3 < len(u) <= STRETCH}
                yield pd.DataFrame({"unit": pd.Series(list(found), dtype=object), "toxic": k})

    by_unit = sample.mapInPandas(units, "unit binary, toxic int").groupBy("unit").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all"))
    by_unit = common.save(by_unit.where("all > 1 OR (bad = 0 AND pmod(xxhash64(unit), 16) = 0)"), "units")
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("all") - F.col("bad") + 0.5) / (good + 1))
    out = by_unit.withColumn("odds", odds).where((F.col("bad") >= max(3, bad // 100)) & (F.col("odds") > 3)).orderBy(F.desc("bad"), "unit").limit(STANDING_OUT)
    frequent = by_unit.where(F.col("all") > 2 * F.col("bad")).orderBy(F.desc("all"), "unit").limit(ORDINARY // 2)
    others = by_unit.where("bad = 0").orderBy(F.xxhash64("unit"), "unit").limit(ORDINARY // 2)
    return {bytes(u): o for u, o in out.select("unit", "odds").collect()}, sorted({bytes(r.unit) for r in frequent.unionByName(others).select("unit").collect()})


def chosen_units(sample: DataFrame, odds: dict[bytes, float], model: Model | None) -> tuple[dict[bytes, int], list[bytes]]:
    """The highest unit of each toxic sentence, counted, and those of clean documents.

    A sentence of a toxic document is toxic if it holds a unit that stands out. Without a model, the unit that
    stands out most is a sentence's highest, and clean documents give none.
    """
    sent = sample.sparkSession.sparkContext.broadcast((odds, model))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, machine = sent.value
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                one = parsed(text)
                if not one.n_words or not (toxic or machine):
                    continue
                units = units_of(one)
                if not toxic:
                    out.append((units[int(np.argmax(values_of(one, machine)))], 0))
                    continue
                best: dict[int, tuple[float, bytes]] = {}
                values = values_of(one, machine) if machine else [known.get(u, -1.0) for u in units]
                marked = {s for s, u in zip(one.sentence.tolist(), units, strict=True) if u in known}
                for s, u, v in zip(one.sentence.tolist(), units, values, strict=True):
                    if s in marked:
                        best[s] = max(best.get(s, (v, u)), (v, u))
                out += [(u, 1) for _, u in best.values()]
            yield pd.DataFrame(out, columns=["unit", "toxic"]).astype({"toxic": "int32"})

    found = common.save(sample.mapInPandas(rows, "unit binary, toxic int"), "chosen")
    sent.unpersist()
    up = found.where("toxic = 1").orderBy(F.xxhash64("unit"), "unit").limit(SENTENCES).groupBy("unit").count().collect()
    down = found.where("toxic = 0").select("unit").distinct().collect()  # one a clean document of the sample at most
    return {bytes(u): n for u, n in sorted(up)}, sorted(bytes(r.unit) for r in down)


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on its active set; the bias is not penalised."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x1.shape[1])
    active = np.ones(len(y), bool)
    for _ in range(50):
        xs, c = x1[active], cost * weight[active]
        w = np.linalg.solve(ridge + (xs * c[:, None]).T @ xs, xs.T @ (c * y[active]))
        now = y * (x1 @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


class Landmarks:
    """Units that span the machine's space; only the codes that they hold have a column."""

    def __init__(self, units: list[bytes]):
        row, code, value = features(units)
        self.codes, column = np.unique(code, return_inverse=True)
        self.dense = np.zeros((len(units), len(self.codes)))
        np.add.at(self.dense, (row, column), value)
        eigen, vectors = np.linalg.eigh(self.dense @ self.dense.T)
        self.root = vectors / np.sqrt(np.maximum(eigen, 1e-6)) @ vectors.T

    def kernel(self, units: list[bytes]) -> np.ndarray:
        row, code, value = features(units)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        held = self.codes[at] == code
        row, at, value = row[held], at[held], value[held]
        return np.stack([np.bincount(row, value * one[at], len(units)) for one in self.dense], axis=1)

    def embedded(self, units: list[bytes]) -> np.ndarray:
        parts = [self.kernel(units[i : i + 1000]) for i in range(0, len(units), 1000)]
        return np.vstack(parts) @ self.root

    def folded(self, w: np.ndarray, bias: float) -> Model:
        weights = np.zeros(CODES**3)
        weights[self.codes] = (self.root @ w) @ self.dense
        return Model(weights.astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from a bounded sample of the labelled documents; None if it lacks one of the labels."""
    rows, rates = labelled(docs, labels, sample)
    counts = dict(rows.groupBy("toxic").count().collect())
    bad, good = counts.get(1, 0), counts.get(0, 0)
    odds, ordinary = standing_out(rows, bad, good) if bad and good else ({}, [])
    if not (odds and ordinary):
        return None
    up, _ = chosen_units(rows, odds, None)
    clean = [u for u in ordinary if u not in odds]
    # landmarks: the units that most sentences turn on, and ordinary units spread over the list
    marks = sorted(up, key=lambda u: (-up[u], u))[: LANDMARKS // 2]
    marks += clean[:: max(1, len(clean) // (LANDMARKS - len(marks)))][: LANDMARKS - len(marks)]
    space, against, model = Landmarks(marks), {u: 1 for u in clean}, None
    for k in range(ROUNDS):
        words, others = list(up), list(against)
        x = np.vstack([space.embedded(words), space.embedded(others)])
        y = np.array([1.0] * len(words) + [-1.0] * len(others))
        n = np.array(list(up.values()), float)
        w, bias = svm(x, y, np.concatenate([n * len(clean) / n.sum(), np.full(len(others), 2.0)]))
        model = space.folded(w, bias)
        if k + 1 < ROUNDS:
            up, down = chosen_units(rows, odds, model)
            against |= {u: 1 for u in down}
    return calibrated(model, rows, rates)


def calibrated(model: Model, sample: DataFrame, rates: dict[int, int]) -> Model:
    """A logistic curve through the sample's documents, either label weighing as often as labels have it."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [evidence(t, sent.value) for t in batch["text"]]
            yield pd.DataFrame({"best": [a for a, _ in found], "mean": [b for _, b in found], "toxic": batch["toxic"]})

    pairs = sorted(sample.select("text", "toxic").mapInPandas(best, "best double, mean double, toxic int").collect())
    sent.unpersist()
    x, y = np.array([[p.best, p.mean, 1.0] for p in pairs]), np.array([float(p.toxic) for p in pairs])
    share = rates[1] / (rates[0] + rates[1])
    w, each = np.zeros(3), np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (each * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w = w - np.linalg.solve(h, x.T @ (each * (p - y)) + 1e-2 * w)
    return model._replace(curve=tuple(map(float, w)))


def scored(docs: DataFrame, model: Model | None, keep_below: float | None = None) -> DataFrame:
    """docs with a score, whole texts read; with keep_below, the columns of docs and the rows that score less.

    Null and empty texts have no units and score low; without a model every row scores 0. Repeated rows
    score the same, other columns are never looked at, and rows stay where they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("scores", dict)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            scores = [score_of(t.as_py() or "", sent.value) if sent.value else 0.0 for t in texts]
            if keep_below is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])
            else:
                yield batch.filter(pa.array([s < keep_below for s in scores], pa.bool_()))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, score double") if keep_below is None else docs.mapInArrow(rows, docs.schema)


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def trained(spark: SparkSession, sf_dir: str) -> Model | None:
    """The model of the benchmark tables; rows whose remainder is 1 are held out."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder() != 1)
    return fit(common.table(spark, sf_dir, "documents"), labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a null doc_id is not held out and never learned from."""
    scores = scored(common.table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return scores.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
