"""Benchmark decontamination: every passage of the corpus is a BM25 query against the test items.

The inverted index holds the items, so it stays small while the corpus grows; it is sent to the tasks in
blocks of bounded size, while frequencies and lengths are those of all items. Its postings carry impacts divided
by the item's score for its own text: a passage that holds a whole item scores 1. Bounds of stretches tell which
passages any item could reach; for these, block-max WAND returns every item above the threshold, and of them the
ones whose question and answer both overlap the passage in five-word shingles are contamination.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage has to reach, and the share of shingles that question and answer each need.
THRESHOLD, OVERLAP = 0.6, 0.5
SHINGLE = 5
POSTINGS_PER_BLOCK = 64
#: What the commonest terms may add to a score altogether: they are left out when passages are first looked over.
SLACK = 0.15
#: Characters of item text in one broadcast index; more items make more blocks, each meeting all passages.
BLOCK_CHARS = 8_000_000

#: Bytes of ASCII that are no letter or digit part words; all beyond ASCII belong to them.
_APART = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_APART).split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def halves(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: parted at the sentence end nearest to its middle, else in the middle."""
    n = len(words_of(text))
    ends = [len(words_of(text[: m.end()])) for m in re.finditer(r"[.?!:](?=\s)", text)]
    cut = min([e for e in ends if 0 < e < n], key=lambda e: (abs(2 * e - n), e), default=(n + 1) // 2)
    words = words_of(text)
    return words[:cut], words[cut:]


class Statistics(NamedTuple):
    """Of all items: how many have words, how many words they have on average, and how many items each word is in."""

    items: int
    mean: float
    df: dict[bytes, int]


class Index:
    """Items of one length class: passages are twice as long as its longest item may be."""

    def __init__(self, items: list[tuple[int | None, str]], reach: int, known: Statistics):
        self.reach, self.ids = reach, [i for i, _ in items]
        lists = [words_of(t) for _, t in items]
        mean, df = known.mean, known.df
        postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for k, ws in enumerate(lists):
            own = {w: math.log(1 + (known.items - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean)) for w, tf in Counter(ws).items()}
            total = sum(own.values())
            for w, x in own.items():
                postings[w].append((k, x / total))
        self.terms = {w: t for t, w in enumerate(postings, 1)}  # 0: a word that no item has
        self.docs = [[]] + [[k for k, _ in p] for p in postings.values()]
        self.impacts = [[]] + [[x for _, x in p] for p in postings.values()]
        self.block_max = [[max(x[i : i + POSTINGS_PER_BLOCK]) for i in range(0, len(x), POSTINGS_PER_BLOCK)] for x in self.impacts]
        self.bound = np.array([max(x, default=0.0) for x in self.impacts])
        # the other terms' postings as sparse rows; the bounds of those left out sum to the slack at most
        order = sorted(range(1, len(self.docs)), key=lambda t: -len(self.docs[t]))
        rest = SLACK - np.cumsum([self.bound[t] for t in order])
        few = set(order[: int((rest >= 0).sum())])
        rows = [[] if t in few else self.docs[t] for t in range(len(self.docs))]
        self.slack = float(sum(self.bound[t] for t in few))
        self.row_at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        self.row_item = np.array([k for row in rows for k in row], np.int64)
        self.row_impact = np.array([x for t, row in enumerate(rows) if row for x in self.impacts[t]])
        self.parts = [tuple(map(shingles, halves(t))) for _, t in items]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose impacts over the distinct terms sum to the threshold or more: block-max WAND."""
        at = {t: 0 for t in terms}
        live = list(terms)
        out = []
        while live:
            live.sort(key=lambda t: self.docs[t][at[t]])
            total = 0.0
            for pivot, t in enumerate(live):
                total += self.bound[t]
                if total >= threshold:
                    break
            else:
                break
            doc = self.docs[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and self.docs[live[pivot + 1]][at[live[pivot + 1]]] == doc:
                pivot += 1
            # the blocks that hold the pivot may not reach the threshold: then skip to the first one's end
            limit, ends = 0.0, []
            for t in live[: pivot + 1]:
                block = bisect_left(self.docs[t], doc, at[t]) // POSTINGS_PER_BLOCK
                if block < len(self.block_max[t]):
                    limit += self.block_max[t][block]
                    ends.append(self.docs[t][min(len(self.docs[t]), (block + 1) * POSTINGS_PER_BLOCK) - 1])
            if limit < threshold:
                beyond = min(ends, default=doc) + 1
                if pivot + 1 < len(live):
                    beyond = min(beyond, self.docs[live[pivot + 1]][at[live[pivot + 1]]])
                self._advance(live[: pivot + 1], at, max(beyond, doc + 1))
            elif self.docs[live[0]][at[live[0]]] == doc:
                score = sum(self.impacts[t][at[t]] for t in live[: pivot + 1])
                if score >= threshold:
                    out.append((doc, score))
                self._advance(live[: pivot + 1], at, doc + 1)
            else:
                self._advance([t for t in live[:pivot] if self.docs[t][at[t]] < doc], at, doc)
            live = [t for t in live if at[t] < len(self.docs[t])]
        return out

    def _advance(self, terms: list[int], at: dict[int, int], doc: int) -> None:
        for t in terms:
            at[t] = bisect_left(self.docs[t], doc, at[t])

    def found(self, words: list[bytes], threshold: float, overlap: float) -> dict[int, tuple[float, float, float, int]]:
        """position of an item -> (score, question overlap, answer overlap, first word of the passage) for a whole document."""
        get = self.terms.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        starts = self.possible(ids, threshold)
        best: dict[int, tuple[float, float, float, int]] = {}
        for s in starts:
            terms = np.unique(ids[s : s + 2 * self.reach])
            hits = self.search(terms[terms > 0].tolist(), threshold)
            passage = shingles(words[s : s + 2 * self.reach]) if hits else set()
            for k, score in hits:
                # a half shorter than a shingle is its whole sequence, which a passage holds as words
                q, a = (self._share(part, passage, words[s : s + 2 * self.reach]) for part in self.parts[k])
                if q >= overlap and a >= overlap:
                    best[k] = max(best.get(k, (0.0, 0.0, 0.0, 0)), (score, q, a, -s))
        return {k: (x, q, a, -s) for k, (x, q, a, s) in best.items()}

    def possible(self, ids: np.ndarray, threshold: float) -> list[int]:
        """First words of the passages in which some item could reach the threshold.

        A passage is two stretches of `reach` words, and its bound the sum of theirs and the slack.
        """
        size, n_items = len(self.bound), len(self.ids)
        there = np.nonzero(self.row_at[ids + 1] - self.row_at[ids])[0]
        held = np.unique(there // self.reach * size + ids[there])
        stretch, term = held // size, held % size
        n = self.row_at[term + 1] - self.row_at[term]
        total = int(n.sum())
        if not total:
            return [] if self.slack < threshold else list(range(0, len(ids), self.reach))
        at = np.repeat(self.row_at[term] - (np.cumsum(n) - n), n) + np.arange(total)
        stretches = max(2, -(-len(ids) // self.reach))
        sums = np.bincount(np.repeat(stretch * n_items, n) + self.row_item[at], self.row_impact[at], stretches * n_items).reshape(stretches, n_items)
        reached = ((sums[:-1] + sums[1:]) >= threshold - self.slack - 1e-9).any(axis=1)
        return (np.nonzero(reached)[0] * self.reach).tolist()

    @staticmethod
    def _share(part: set, passage: set, words: list[bytes]) -> float:
        if not part:
            return 1.0
        short = next(iter(part))
        if len(part) == 1 and len(short) < SHINGLE:
            n = len(short)
            return float(any(tuple(words[i : i + n]) == short for i in range(len(words) - n + 1)))
        return len(part & passage) / len(part)


def statistics(lists: list[list[bytes]]) -> Statistics:
    return Statistics(len(lists), sum(map(len, lists)) / max(1, len(lists)), Counter(w for ws in lists for w in set(ws)))


def statistics_of(benchmark: DataFrame) -> Statistics:
    """statistics() of a table of items: a row for each of its words reaches the driver, however many items there are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [ws for ws in (words_of(t.as_py()) for t in batch.column(0)) if ws]
            found = Counter(w for ws in lists for w in set(ws))
            # the item count and the sum of lengths stand under words that no text can have
            keys, counts = [b"", b" ", *found], [len(lists), sum(map(len, lists)), *found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], names=["word", "n"])

    sums = distinct_items(benchmark).select("text").mapInArrow(rows, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = {bytes(w): n for w, n in sums.toLocalIterator()}
    items, words = df.pop(b"", 0), df.pop(b" ", 0)
    return Statistics(items, words / max(1, items), df)


def indexes(items: list[tuple[int | None, str]], known: Statistics | None = None) -> list[Index]:
    """One index for each class of lengths (up to 64 words, 128, 256, ...); items without words are left out."""
    known = known or statistics([ws for ws in (words_of(t or "") for _, t in items) if ws])
    classes = defaultdict(list)
    for i, t in items:
        if n := len(words_of(t or "")):
            classes[max(64, 1 << (n - 1).bit_length())].append((i, t))
    return [Index(x, reach, known) for reach, x in sorted(classes.items())]


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """The items, told apart by id and text: suites may share ids, and an item may have none."""
    return benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()


def index_blocks(benchmark: DataFrame) -> Iterator[list[Index]]:
    """Indexes of at most BLOCK_CHARS of item text (or of one longer item), one after another, so that what is
    broadcast and what the driver holds at once have a bound. An empty benchmark has one block without items."""
    known, held, size, some = statistics_of(benchmark), [], 0, False
    for i, t in distinct_items(benchmark).orderBy("item_id", "text").toLocalIterator():
        if held and size + len(t) > BLOCK_CHARS:
            yield indexes(held, known)
            held, size, some = [], 0, True
        held.append((i, t))
        size += len(t)
    if held or not some:
        yield indexes(held, known)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) for each contaminated document and item.

    Every word of every document is in two passages but those at its ends. Null and empty texts and items
    match nothing, items that share an id are reported each by it, equal items once, and repeated documents each.
    """
    spark, out = docs.sparkSession, None
    for block in index_blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    words = words_of(text.as_py() or "")
                    for index in sent.value:
                        out += [(doc_id.as_py(), index.ids[k], *x) for k, x in index.found(words, threshold, overlap).items()]
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)

        names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
        arrow = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()], strict=True)))
        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """docs without contaminated ones, all columns kept; documents stay where they are, with no shuffle."""
    for block in index_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def kept(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not any(index.found(words_of(t.as_py() or ""), threshold, overlap) for index in sent.value) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold."""
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
