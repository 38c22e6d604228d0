"""Periodic runs of words, by Crochemore's partition refinement.

Two positions are in one class of level p if the p words from either are the same. The classes of level p + 1 come
from those of level p: of the parts that a class falls into, all but a largest one (the smaller halves) are looked
at, and what stands one word before them parts from its class. So a position is looked at no more than a
logarithmic number of times. Members of a class are linked in the order of the text. Where neighbours are p words
apart at level p, the word sequence of length p from there is a square; squares of one period at consecutive
positions are merged into a run.

A level is worked off with array operations for all documents of a slice at once: words of different documents
are different, so no class goes over the end of a document, and a slice takes as many levels as a third of its
longest document has words, or fewer, once all classes have one member.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import common

#: A run has this many words and periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of a slice, unless one document has more.
SLICE = 1 << 19


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Classes:
    """Classes of equal factors: an order of the positions in which each class is a stretch, and in each class
    links between neighbours in the text."""

    def __init__(self, codes: np.ndarray):
        """Classes of level 1, by the codes alone; equal codes are equal words of one document."""
        n = len(codes)
        self.order = np.argsort(codes, kind="stable")
        first = np.empty(n, bool)
        first[:1] = True
        first[1:] = codes[self.order[1:]] != codes[self.order[:-1]]
        starts = np.flatnonzero(first)
        self.begin = np.zeros(n + 1, np.int64)  # of each class; a class has one position at least
        self.begin[: len(starts)] = starts
        self.size = np.zeros(n + 1, np.int64)
        self.size[: len(starts)] = np.diff(np.append(starts, n))
        self.n_classes = len(starts)
        self.of = np.empty(n, np.int64)
        self.of[self.order] = np.cumsum(first) - 1
        self.where = np.empty(n, np.int64)
        self.where[self.order] = np.arange(n)
        # stable sorting leaves each class in the order of the text
        self.after = np.full(n + 1, -1)
        self.after[self.order[:-1]] = np.where(first[1:], -1, self.order[1:])
        self.ahead = np.full(n + 1, -1)
        self.ahead[self.order[1:]] = np.where(first[1:], -1, self.order[:-1])
        self.since = np.ones(n, np.int64)  # the level at which a position got the neighbour that follows it
        self.moved = np.zeros(n, bool)
        self.small = np.arange(self.n_classes)

    def refine(self, level: int, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From classes of a level to those of the next; returns the squares (position, period) that end here.

        follows tells which positions have a predecessor in their document.
        """
        behind = self.order[_ranges(self.begin[self.small], self.size[self.small])]
        behind = behind[follows[behind]]
        gone = behind - 1
        gone = gone[self.size[self.of[gone]] > 1]  # classes of one position do not part any more
        if not len(gone):
            self.small = self.small[:0]
            return gone, gone
        old = self.of[gone]
        by = np.lexsort((gone, self.of[gone + 1], old))
        gone, old = gone[by], old[by]
        right = self.of[gone + 1]
        # groups of one old class and one following class; sections of one old class
        new_group = np.append(True, (old[1:] != old[:-1]) | (right[1:] != right[:-1]))
        new_section = np.append(True, old[1:] != old[:-1])
        group_at = np.flatnonzero(new_group)
        group_size = np.diff(np.append(group_at, len(gone)))
        section_at = np.flatnonzero(new_section)
        section_size = np.diff(np.append(section_at, len(gone)))
        section_old = old[section_at]
        rest = self.size[section_old] - section_size
        section_of_group = np.cumsum(new_section)[group_at] - 1
        # the largest group keeps its class where nothing else is left in it, else the rest does
        largest = np.maximum.reduceat(group_size, np.flatnonzero(new_section[group_at]))
        is_largest = group_size == largest[section_of_group]
        is_largest &= np.append(True, (section_of_group[1:] != section_of_group[:-1])) | ~_earlier(is_largest, section_of_group)
        keeps = is_largest & (rest[section_of_group] == 0)

        squares = self._unlink(gone, old, new_section, rest, section_size, level)
        self._to_the_end(gone, old, section_old, section_size, rest)
        # numbers for the groups that leave
        group_class = np.where(keeps, section_old[section_of_group], 0)
        n_new = int((~keeps).sum())
        group_class[~keeps] = np.arange(self.n_classes, self.n_classes + n_new)
        self.n_classes += n_new
        self.of[gone] = np.repeat(group_class, group_size)
        group_begin = self.begin[section_old[section_of_group]] + rest[section_of_group] + group_at - section_at[section_of_group]
        self.size[section_old] = rest
        self.begin[group_class], self.size[group_class] = group_begin, group_size
        squares = self._link(gone, new_group, level, squares)
        # small: all parts but a largest one of every class that has parted
        rest_is_largest = rest >= largest
        small = group_class[~(is_largest & ~rest_is_largest[section_of_group])]
        self.small = np.concatenate((small, section_old[(rest > 0) & ~rest_is_largest]))
        # a class that has not parted is no smaller half
        whole = (rest == 0) & (np.bincount(section_of_group, minlength=len(section_old)) == 1)
        if whole.any():
            self.small = self.small[~np.isin(self.small, section_old[whole])]
        return squares

    def _to_the_end(self, gone, old, section_old, section_size, rest) -> None:
        """Brings the positions that leave to the end of their class' stretch, in their order."""
        self.moved[gone] = True
        slots = _ranges(self.begin[section_old] + rest, section_size)
        there = self.order[slots]
        staying = there[~self.moved[there]]
        border = np.repeat(self.begin[section_old] + rest, section_size)
        vacated = self.where[gone[self.where[gone] < border]]
        self.order[vacated], self.where[staying] = staying, vacated
        self.order[slots], self.where[gone] = gone, slots
        self.moved[gone] = False

    def _ended(self, positions: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Those whose neighbour, up to this level, has stood as far off as a level that they have shared is long."""
        gap = self.after[positions] - positions
        true = (self.after[positions] >= 0) & (self.since[positions] <= gap) & (gap <= level)
        return positions[true], gap[true]

    def _unlink(self, gone, old, new_section, rest, section_size, level) -> list[tuple[np.ndarray, np.ndarray]]:
        """Takes positions out of their class' links; where all leave, the links are made anew by _link alone."""
        some = np.repeat(rest > 0, section_size)
        left = gone[some]
        squares = [self._ended(gone, level)]
        if len(left):
            # chains of positions that leave and are neighbours; left is sorted by class, then by group
            self.moved[left] = True
            heads = left[(self.ahead[left] < 0) | ~self.moved[self.ahead[left]]]
            tails = left[(self.after[left] < 0) | ~self.moved[self.after[left]]]
            self.moved[left] = False
            # within a class heads and tails alternate in the text
            heads = heads[np.lexsort((heads, self.of[heads]))]
            tails = tails[np.lexsort((tails, self.of[tails]))]
            before, behind = self.ahead[heads], self.after[tails]
            touched = before >= 0
            squares.append(self._ended(before[touched], level))
            self.after[before[touched]] = behind[touched]
            self.since[before[touched]] = level + 1
            self.ahead[behind[behind >= 0]] = before[behind >= 0]
        return squares

    def _link(self, gone, new_group, level, squares) -> tuple[np.ndarray, np.ndarray]:
        """Links the positions of each group, which stand in the order of the text."""
        to = np.where(np.append(new_group[1:], True), -1, np.append(gone[1:], -1))
        same = self.after[gone] == to
        position, period = squares[0]
        kept = gone[same]  # a neighbour that has come along is no new one
        self.moved[kept] = True
        squares[0] = position[~self.moved[position]], period[~self.moved[position]]
        self.moved[kept] = False
        self.since[gone[~same]] = level + 1
        self.after[gone] = to
        self.ahead[gone] = np.where(new_group, -1, np.append(-1, gone[:-1]))
        return np.concatenate([s[0] for s in squares]), np.concatenate([s[1] for s in squares])

    def remaining(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        return self._ended(np.flatnonzero(self.after[:-1] >= 0), level)


def _earlier(marked: np.ndarray, section: np.ndarray) -> np.ndarray:
    """Whether an element before this one, in the same section, is marked."""
    before = np.cumsum(marked) - marked
    first = np.append(True, section[1:] != section[:-1])
    return before > before[first][np.cumsum(first) - 1]


def squares(codes: np.ndarray, lengths: np.ndarray, periods: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of all primitive squares of several texts, one after the other in codes.

    codes of different texts differ. Only periods of which a text holds the given number are looked for.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # what reaches over the end of a text is a class of its own: a word that no other text has ends every text
    ends = np.cumsum(lengths) + np.arange(len(lengths))
    at = np.arange(n) + np.repeat(np.arange(len(lengths)), lengths)
    padded = np.empty(n + len(lengths), np.int64)
    padded[at] = codes
    padded[ends] = codes.max() + 1 + np.arange(len(lengths))
    first = np.zeros(len(padded), bool)
    first[np.append(0, ends[:-1] + 1)] = True
    classes, found, level, last = Classes(padded), [], 1, int(lengths.max()) // periods
    while level < last and len(classes.small):
        found.append(classes.refine(level, ~first))
        level += 1
    found.append(classes.remaining(last))
    position, period = (np.concatenate(part) for part in zip(*found, strict=True))
    return position - np.searchsorted(ends, position), period


def merged(position: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Runs (start, length, period) by start, then period, from the places of squares."""
    by = np.lexsort((position, period))
    position, period = position[by], period[by]
    new = np.append(True, (period[1:] != period[:-1]) | (position[1:] != position[:-1] + 1))[: len(position)]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(position)))
    runs = np.stack((position[at], count - 1 + 2 * period[at], period[at]), axis=1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands in each place where a document is given repeats, None where it is left as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of documents of about SLICE bytes of words, one document at least."""
    at = 0
    total = np.append(0, np.cumsum(sizes))
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + SLICE * 6, "right")) - 1)
        yield at, end
        at = end


COLUMNS = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def described(ids: pa.Array, texts: pa.Array, planted: bool) -> pa.RecordBatch:
    """One row for each text: its runs, and what is left when each run keeps its first period alone."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words, lengths = pc.list_flatten(split), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # blanks at an end leave an empty word
    document = np.repeat(np.arange(len(lengths)), lengths)
    words, lengths = words.filter(pa.array(full)), np.bincount(document[full], minlength=len(lengths))
    starts = np.append(0, np.cumsum(lengths))
    doc_ids = ids.to_pylist()
    if planted:
        places = np.arange(len(words))
        for k, (doc_id, n) in enumerate(zip(doc_ids, lengths.tolist(), strict=True)):
            if (own := planted_places(doc_id, n)) is not None:
                places[starts[k] : starts[k + 1]] = starts[k] + own
        words = words.take(pa.array(places))
    codes = words.dictionary_encode()
    codes = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(np.arange(len(lengths)) * max(1, len(codes.dictionary)), lengths)
    runs = merged(*squares(codes, lengths, LEAST_PERIODS))
    runs = runs[runs[:, 1] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * runs[:, 2])]
    # words that some run holds after its first period: a run adds one where that begins and takes it back at its end
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
    np.add.at(covered, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(covered[:-1]) == 0
    offsets = np.append(0, np.cumsum(kept))[starts]
    left = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.filter(pa.array(kept))), pa.scalar(" ", words.type))
    first = np.searchsorted(runs[:, 0], starts)
    out = []
    for k, (doc_id, text) in enumerate(zip(doc_ids, left, strict=True)):
        own = [Run(int(s) - int(starts[k]), int(n), int(q)) for s, n, q in runs[first[k] : first[k + 1]]]
        best = None
        for run in own:  # by start, then period: of equal ones the first stays
            if best is None or run.length * best.period > best.length * run.period:
                best = run
        listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in own)
        row = (*best, 1000 * best.length // best.period) if best else (None,) * 4
        out.append((doc_id, len(own), *row, _digest(listed.encode()), _digest(text.as_buffer() or b"")))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), COLUMNS, strict=True)], schema=COLUMNS)


def find(docs: DataFrame, planted: bool = False) -> DataFrame:
    """One row per document: number of runs, the one of the greatest exponent, and digests of all runs and of the
    words that are left when each run keeps its first period.

    Whole texts are read, parted at ASCII blanks alone; null and empty texts have no words and no runs. Rows that
    repeat give equal rows. Of equal exponents the smallest start comes first, then the smallest period. With
    ``planted``, every tenth document by its id's crc32 is first given repeats (a null id: never). Other columns
    are ignored, an empty table gives none. There is no shuffle: a task holds one slice of its documents, or one
    document.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for begin, end in _slices(sizes):
                yield described(ids[begin:end], texts[begin:end], planted)

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole document, a tenth of them with planted repeats."""
    return find(common.table(spark, sf_dir, "documents"), planted=True)
