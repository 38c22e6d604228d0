"""Exact Jaccard join of documents over word shingles, as a join in metric space.

1. Equal sets form a class, which goes on as its first document.
2. The number of elements in which two sets differ is a metric, and so is the number in which they differ
   within one part of the universe; these numbers add up over parts. If linked sets differ by at most D
   elements and the universe has D + m parts, they agree in m parts at least. The content of a part is a
   pivot at distance zero, and its region holds the sets that agree with it there. Sets that share no
   region cannot be linked, so connected regions can be joined apart from each other.
3. A connected group that is too large for one task is split by pivots from among its documents: each set
   belongs to the Voronoi region of its nearest pivot, and by the triangle inequality a set within twice the
   radius of the border has to be copied to the region beyond it. Regions are split again until they fit.
   One that pivots cannot split, as its sets are nearly all unlike each other, is compared by parity: the number
   of parts that hold an odd number of elements of one set and an even one of the other is at most the number of
   elements in which the sets differ. Sets that parity does not tell apart make the next regions; one that stays
   nearly whole is joined in pairs of blocks.
4. Groups that fit are joined exactly. Links within the group make sets one component, and only sets of
   different components still have to be compared.

Every step may look at too much but never misses a link; what counts as a link is decided on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import ceil, floor, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: What one task joins at once: documents, and elements of their sets (eight bytes each).
LEAF_DOCS, LEAF_ELEMENTS = 2000, 3_000_000
#: Pivots of a region that is split, and documents and elements of their sets that meet them at once; what meets them
#: may come out once for each pivot.
PIVOTS, CHUNK, CHUNK_ELEMENTS = 12, 256, 100_000
#: Rows up to which the documents that have candidates are sent to all tasks rather than shuffled with the texts.
SENT_ROWS = 500_000
#: Documents looked at for shingles that many have, how many of these must have one, and how many such
#: shingles are sent to the tasks at most. They only decide which parts say little; results are the same without.
COMMON_SAMPLE, COMMON_DOCS, COMMON_MOST = 5000, 3, 400_000
#: Sets whose parities one block holds, and bytes of these. Parities have a bit for every element or two.
PARITY_DOCS, PARITY_BYTES, PARITY_LEAST, PARITY_MOST = 8000, 2_000_000, 256, 1 << 20
#: Elements that are looked up at once, and bytes of a batch of sets or texts on its way to a worker.
LOOKED_UP, BATCH = 200_000, "4m"
#: Words whose hashes a worker remembers.
CACHE = 300_000

#: Documents of which one stands for the others that share a part, and parts of theirs, that are looked at at once.
SLICE, SLICE_PARTS = 4000, 500_000
#: Rows without a doc_id get numbers from here on.
NAMELESS = (1 << 63) - (1 << 42)

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_P = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P[1]
    x = (x ^ (x >> np.uint64(27))) * _P[2]
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > CACHE:
                self.clear()
            self[word] = value
        return value


class Shingler:
    """The set of a text: sorted 64-bit hashes of its distinct runs of `words` words.

    A text with fewer words has the one run of all of them; one without words has the empty set.
    """

    def __init__(self, words: int):
        self.words, self.hashes = words, _Hashes()

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        n = min(self.words, len(words))
        if not n:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for j in range(n):
            out = mixed(out * _P[0] + h[j : len(words) - n + 1 + j])
        return np.unique(out)


class Parts:
    """Contents of the parts of the universe, as one number for each part.

    Sets are taken by classes of size; a set whose size could be linked to one of the next class has the
    parts of that class too. Parts with few elements besides common ones say little and are left out, as
    long as a set has fewer such parts than linked sets must agree in; sets with more keep all of theirs.
    What is common depends on the content alone, so either way linked sets keep a part in common.
    """

    def __init__(self, threshold: float, least: int, common: np.ndarray | None = None):
        self.t, self.least, self.ladder, self.schemes = threshold, least, [1], []
        self.common = common if common is not None and len(common) else np.zeros(1, np.uint64)
        ratio = max(1.3, 1.02 / threshold)
        while self.ladder[-1] < 1 << 40:
            self.ladder.append(max(self.ladder[-1] + 1, int(self.ladder[-1] * ratio)))
        for s in self.ladder:
            apart = floor(2 * s * (1 - threshold) / (1 + threshold) + 1e-6)
            agree = 1
            for _ in range(4):  # few enough parts with little content, for a set of the class's least size
                mean = s / ratio / (apart + agree)
                low = (apart + agree) * np.exp(-mean) * (1 + mean * (least > 1))
                agree = 1 + ceil(low + 3 * sqrt(low))
            self.schemes.append((apart, min(agree, apart + 2)))

    def __call__(self, items: np.ndarray) -> np.ndarray:
        c = int(np.searchsorted(self.ladder, len(items)))
        out = [self._of(items, c)] if len(items) else []
        if len(items) and len(items) >= self.t * (self.ladder[c] + 1) - 1e-6:
            out.append(self._of(items, c + 1))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _of(self, items: np.ndarray, c: int) -> np.ndarray:
        apart, agree = self.schemes[c]
        if not apart:  # only equal sets could be linked, and these are one class
            return np.zeros(0, np.uint64)
        k = apart + agree
        part = (mixed(items ^ np.uint64(c + 1)) >> np.uint64(11)).astype(np.int64) % k
        order = np.argsort(part, kind="stable")
        sizes = np.bincount(part, minlength=k)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(items[order] * _P[0]), dtype=np.uint64)])
        ends = np.cumsum(sizes)
        content = mixed((sums[ends] - sums[ends - sizes]) ^ mixed(np.arange(k, dtype=np.uint64) * _P[0] + np.uint64(c)))
        own = self.common[np.minimum(np.searchsorted(self.common, items), len(self.common) - 1)] != items
        rich = np.bincount(part, own, minlength=k)
        return content[rich >= np.partition(rich, agree - 1)[agree - 1]]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of shingles that several of a bounded sample of documents have, the most frequent if many."""
    # as a share of all hashes, which does not end at any number of documents
    share = min(1.0, COMMON_SAMPLE / max(1, docs.count()))
    sample = docs.where((F.xxhash64("doc_id") / 2.0**64 + 0.5) < share).select("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_signed(shingler(text.as_py() or "")))], names=["h"])

    often = sample.mapInArrow(rows, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_DOCS)
    found = often.orderBy(F.desc("n"), "h").limit(COMMON_MOST).select("h").toArrow().column(0)
    return np.sort(found.to_numpy().astype(np.int64).view(np.uint64))


def sketched(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """doc_id, n (size of the set), two hashes of the set, and the contents of its parts."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, parts = common.held(("shingles", words), lambda: Shingler(words)), Parts(threshold, 2, sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingler(t.as_py() or "") for t in part.column(1)]
                ones = [int(mixed(s + _P[0]).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                twos = [int(mixed(s ^ _P[1]).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                contents = [parts(s) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(c) for c in contents])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(np.concatenate(contents))))], names=["doc_id", "n", "h1", "h2", "parts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n long, h1 long, h2 long, parts array<bigint>")


def contents(rows: DataFrame) -> DataFrame:
    """(part, id, leader) for every part of every set, which goes by its first hash.

    Equal sets of a slice count once; two sets with one hash would only share a region. Of the sets of a slice that share a part one stands for the others, which are led by it here and now; so
    a part that most sets share brings one row a slice to where its region is put together. A row that is led
    has its own number for a part, which keeps it out of any region's task.
    """

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("parts", dict)
        for batch in batches:
            step = max(1, min(SLICE, SLICE_PARTS * batch.num_rows // max(1, len(batch.column(1).flatten()))))
            for at in range(0, batch.num_rows, step):
                slice_ = batch.slice(at, step)
                slice_ = slice_.take(pa.array(np.unique(slice_.column(0).to_numpy(), return_index=True)[1]))
                lists = slice_.column(1)
                counts = np.diff(lists.offsets.to_numpy())
                ids = np.repeat(slice_.column(0).to_numpy(), counts)
                parts = lists.flatten().to_numpy()
                _, first, inverse = np.unique(parts, return_index=True, return_inverse=True)
                leaders = ids[first][inverse]
                follows = leaders != ids
                yield pa.RecordBatch.from_arrays([pa.array(np.where(follows, ids, parts)), pa.array(ids), pa.array(leaders, mask=~follows)], names=["part", "id", "leader"])

    return rows.select("h1", "parts").mapInArrow(led, "part long, id long, leader long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in edges (a, b): the least node that each can reach.

    Alternates large stars and small stars, which halves the depth of the graph each time; every round is
    written to the shared folder, and its sums tell when nothing changes any more.
    """
    now = common.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        small = small.select(F.col("b").alias("x"), "m").unionByName(small.select(F.col("a").alias("x"), "m")).where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
        after = common.save(small, "edges")
        common.drop(now)
        now = after
        sums = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sums == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last = sums


def _cuts(sizes: np.ndarray) -> np.ndarray:
    """Where to cut sets of these sizes, so that about LOOKED_UP elements stand between two cuts."""
    return np.nonzero(np.diff(np.cumsum(sizes) // LOOKED_UP))[0] + 1


def _shared(sets: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """How many elements of own each of the sets holds."""
    items, bounds = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    at = np.searchsorted(own, items)
    hit = own[np.minimum(at, len(own) - 1)] == items
    sums = np.concatenate([[0], np.cumsum(hit)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


class Group:
    """Sets to join, and the components that their links make."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], threshold: float, roots: list[int] | None = None):
        self.ids, self.sets, self.t = ids, sets, threshold
        self.sizes = np.array([len(s) for s in sets])
        self.root = np.arange(len(ids)) if roots is None else pd.factorize(np.array(roots))[0]
        self.links: list[tuple[int, int]] = []
        self.distances: list[np.ndarray] = []

    def compare(self, x: int, others: np.ndarray) -> None:
        """Links x to those of the others that it is not yet one component with."""
        near = others[(self.root[others] != self.root[x]) & (np.minimum(self.sizes[others], self.sizes[x]) >= self.t * np.maximum(self.sizes[others], self.sizes[x]) - 1e-6)]
        for d in self.distances:
            near = near[np.abs(d[near] - d[x]) <= 1 - self.t + 1e-6]
        if not len(near):
            return
        both = np.concatenate([_shared([self.sets[i] for i in some], self.sets[x]) for some in np.split(near, _cuts(self.sizes[near]))])
        linked = near[100 * both >= round(100 * self.t) * (self.sizes[near] + self.sizes[x] - both)]
        if len(near) == len(self.ids) - 1 and len(self.distances) < 3:  # x serves as a pivot for the rest
            d = np.zeros(len(self.ids))
            d[near] = 1 - both / (self.sizes[near] + self.sizes[x] - both)
            self.distances.append(d)
        for i in linked:
            if self.root[i] != self.root[x]:
                self.links.append((self.ids[x], self.ids[i]))
                self.root[self.root == self.root[i]] = self.root[x]

    def join(self) -> list[tuple[int, int]]:
        """Links that connect whatever the links within the group connect."""
        left = np.ones(len(self.ids), bool)
        while left.any():
            roots, counts = np.unique(self.root[left], return_counts=True)
            if len(roots) == 1:
                break
            # a document of the smallest component: when only the largest is left, all has been compared
            x = int(np.nonzero(left & (self.root == roots[np.argmin(counts)]))[0][0])
            left[x] = False
            self.compare(x, np.nonzero(left)[0])
        return self.links

    def join_across(self, first: int) -> list[tuple[int, int]]:
        """As join(), for pairs of one of the first sets with one of the others."""
        others = np.arange(first, len(self.ids))
        for x in range(first):
            self.compare(x, others)
        return self.links


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column]


def joined_leaves(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) within each region; rows has region, id and items, and its regions fit one task."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("links", dict)

        def every():
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    yield from zip(*(batch.column(i).slice(at, 200).to_pylist() for i in range(3)), strict=True)

        for _, group in groupby(every(), key=lambda r: r[0]):
            held = list(group)
            if len(held) > 1:
                found = Group([r[1] for r in held], _sets(r[2] for r in held), threshold).join()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    spark = rows.sparkSession
    dealt = rows.select("region", "id", "items").repartition(common.shuffle_partitions(spark), "region").sortWithinPartitions("region", "id")
    return dealt.mapInArrow(links, "a long, b long")


def sent(rows: DataFrame, n: int) -> DataFrame:
    """Rows whose number is known: sent to all tasks while they are few, joined by shuffle beyond."""
    return F.broadcast(rows) if n <= SENT_ROWS else rows


def split(rows: DataFrame, threshold: float, level: int) -> DataFrame:
    """Voronoi regions of pivots within each region of rows, and links to pivots.

    Returns region, id, n, h, from_region, root (the pivot it is linked to, else itself) for every region that
    a set belongs or has to be copied to; and rows with a region of null that hold links (id, root). The sets
    themselves stay where they are: of rows, (region, id, h) finds them again.
    """
    spark = rows.sparkSession
    # the least hashes of parts of a region first, so that no task orders a whole one
    turn = [F.xxhash64("id", F.lit(level)), F.col("id")]
    first = F.row_number().over(Window.partitionBy("region", F.pmod(F.xxhash64("id", F.lit(-3)), F.lit(256))).orderBy(*turn))
    few = rows.select("region", "id").distinct().withColumn("rank", first).where(F.col("rank") <= PIVOTS).drop("rank")
    ranks = few.withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy(*turn))).where(F.col("rank") <= PIVOTS).drop("rank")
    sizes = common.save(rows.groupBy("region").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("n") / CHUNK_ELEMENTS)).alias("chunks")), "chunks")
    n_regions = sizes.count()
    sizes, ranks = sent(sizes, n_regions), sent(ranks, PIVOTS * n_regions)
    pivots = rows.join(ranks, ["region", "id"]).join(sizes, "region").select("region", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("chunk"), "id", "items")
    # written, so that both sides of the grouping below have columns of their own
    pivots = common.save(pivots.withColumn("chunk", F.col("chunk").cast("int")), "pivots")
    dealt = rows.join(sizes, "region").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(-1)), F.col("chunks")).cast("int")).drop("chunks")

    def place(docs: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = []
        marks = sorted(zip(near["id"], _sets(near["items"]), strict=True), key=lambda p: p[0])
        for region, i, n, h, items in zip(docs["region"], docs["id"], docs["n"], docs["h"], docs["items"], strict=True):
            own = np.frombuffer(items, np.uint64)
            both = [len(np.intersect1d(own, p, assume_unique=True)) for _, p in marks]
            far = [1 - b / (len(own) + len(p) - b) for b, (_, p) in zip(both, marks, strict=True)]
            home = int(np.argmin(far))
            linked = [p for p, (b, (_, s)) in enumerate(zip(both, marks, strict=True)) if 100 * b >= round(100 * threshold) * (len(own) + len(s) - b)]
            root = marks[linked[0]][0] if linked else i
            for p in linked:
                if marks[p][0] != i:
                    out.append((None, i, n, h, region, marks[p][0]))
            for p, d in enumerate(far):
                if d <= far[home] + 2 * (1 - threshold) + 1e-6:
                    out.append((_region(region, marks[p][0]), i, n, h, region, root))
        return pd.DataFrame(out, columns=["region", "id", "n", "h", "from_region", "root"], dtype=object)

    placed = dealt.groupBy("region", "chunk").cogroup(pivots.groupBy("region", "chunk")).applyInPandas(place, "region long, id long, n long, h long, from_region long, root long")
    placed = common.save(placed, "regions")
    common.drop(pivots)
    return placed


def _region(region: int, pivot: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{region} {pivot}") - (1 << 63)


class Parity:
    """For the parts of the universe, whether each holds an odd number of a set's elements.

    Sets have as many parts as their class of size asks for. Linked sets are of one class or of two that follow
    each other; halves laid over each other give the parity of half as many parts.
    """

    def __init__(self, threshold: float):
        self.t, self.log = round(100 * threshold), np.log(max(1.3, 1.02 / threshold))

    def of_size(self, n: int) -> int:
        return int(np.log(n) / self.log)

    def __call__(self, items: np.ndarray) -> bytes:
        most = min(max(np.exp(self.log * (self.of_size(len(items)) + 1)), PARITY_LEAST), PARITY_MOST)
        parts = 1 << ceil(np.log2(most))
        part = (mixed(items ^ _P[2]) & np.uint64(parts - 1)).astype(np.int64)
        return np.packbits((np.bincount(part, minlength=parts) & 1).astype(bool), bitorder="little").tobytes()

    def near(self, left: tuple, right: tuple | None) -> Iterator[tuple[int, int]]:
        """Pairs that connect what parity does not tell apart, of (nodes, sizes, parities) of one class each."""
        sides = [x for x in (left, right) if x is not None]
        nodes = np.concatenate([np.array(x[0], np.int64) for x in sides])
        root = np.unique(nodes, return_inverse=True)[1]
        bits = [np.frombuffer(b"".join(x[2]), np.uint64).reshape(len(x[0]), -1) for x in sides]
        width = min(b.shape[1] for b in bits)
        for k, b in enumerate(bits):
            while b.shape[1] > width:
                b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
            bits[k] = b
        others = np.argsort(sides[-1][1], kind="stable")  # a set meets those of sizes that could be linked to its own
        sizes, at = np.array(sides[-1][1], np.int64)[others], others + (len(left[0]) if right is not None else 0)
        laid = np.ascontiguousarray(bits[-1][others].T)
        for x, n in enumerate(left[1]):
            lo, hi = np.searchsorted(sizes, ceil(n * self.t / 100 - 1e-6)), np.searchsorted(sizes, n * 100 / self.t + 1e-6, "right")
            if right is None:  # the larger one meets the smaller one, or an equal one
                hi = np.searchsorted(sizes, n, "right")
            apart = np.bitwise_count(laid[:, lo:hi] ^ bits[0][x][:, None]).sum(axis=0, dtype=np.int64)
            alike = at[lo:hi][apart * (100 + self.t) <= (sizes[lo:hi] + n) * (100 - self.t)]
            for y in alike[root[alike] != root[x]]:
                if root[y] != root[x]:
                    yield int(nodes[x]), int(nodes[y])
                    root[root == root[y]] = root[x]


def told_apart(rows: DataFrame, threshold: float) -> DataFrame:
    """Regions of sets within each region of rows that parity does not tell apart: region, from_region, id, n, h, items.

    Every set of a region meets every other of its size, but by parities alone: a bit or two for each element of
    eight bytes. What stands alone is left out.
    """
    spark = rows.sparkSession
    rows = rows.select("region", "id", "n", "h", "items", F.xxhash64("region", "id", "h").alias("node"))

    def parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("links", dict)
        parity = Parity(threshold)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = _sets(part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array([parity.of_size(len(s)) for s in sets], pa.int32()), pa.array([parity(s) for s in sets], pa.binary())], names=["region", "node", "n", "class", "bits"])

    bits = common.save(rows.where("n > 0").select("region", "node", "n", "items").mapInArrow(parities, "region long, node long, n long, class int, bits binary"), "parities")
    counts = bits.groupBy("region", "class").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PARITY_DOCS), F.ceil(F.sum(F.length("bits")) / PARITY_BYTES)).cast("int").alias("blocks"))
    counts = common.save(counts, "counts")
    blocks = counts.select("region", "class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    a, b = blocks.alias("a"), blocks.alias("b")
    meet = ((F.col("a.class") == F.col("b.class")) & (F.col("a.block") <= F.col("b.block"))) | (F.col("a.class") + 1 == F.col("b.class"))
    pairs = a.join(b, (F.col("a.region") == F.col("b.region")) & meet).select("a.region", F.col("a.class").alias("x_class"), F.col("a.block").alias("x"), F.col("b.class").alias("y_class"), F.col("b.block").alias("y"))
    pairs = common.save(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    known, listed = sent(counts, counts.count()), sent(pairs, pairs.count())
    dealt = bits.join(known, ["region", "class"]).select("region", "class", F.pmod(F.xxhash64("node", F.lit(-4)), F.col("blocks")).cast("int").alias("block"), "node", "n", "bits")

    def side(number: int, which: DataFrame, kind: str, block: str) -> DataFrame:
        on = (F.col("p.region") == F.col("d.region")) & (F.col(kind) == F.col("d.class")) & (F.col(block) == F.col("d.block"))
        return dealt.alias("d").join(which.alias("p"), on).select("pair", F.lit(number).alias("side"), "node", "n", "bits")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("links", dict)
        parity = Parity(threshold)
        every = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in groupby(every, key=lambda r: r[0]):
            sides = {number: list(zip(*(r[2:] for r in of), strict=True)) for number, of in groupby(group, key=lambda r: r[1])}
            found = list(parity.near(sides[0], sides.get(1))) if 0 in sides else []  # a block may be empty
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    both = side(0, listed, "x_class", "x").unionByName(side(1, listed.where("x_class <> y_class OR x <> y"), "y_class", "y"))
    met = both.repartition(common.shuffle_partitions(spark), "pair").sortWithinPartitions("pair", "side")
    found = components(met.mapInArrow(near, "a long, b long"))
    for done in (bits, counts, pairs):
        common.drop(done)
    found = sent(found.select(F.col("node").alias("of"), "component"), found.count())
    return rows.join(found, F.col("node") == F.col("of")).select(F.col("component").alias("region"), F.col("region").alias("from_region"), "id", "n", "h", "items")


def joined_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """Links within regions that neither pivots nor parity split, by pairs of blocks; rows has root besides.

    Sets linked to the same pivot are one component already, so blocks are made of one root's sets and only
    blocks that differ in root meet, or that hold sets without one.
    """
    spark = rows.sparkSession
    alone = F.when(F.col("root") == F.col("id"), F.lit(None)).otherwise(F.col("root"))
    keyed = rows.withColumn("key", F.coalesce(alone, F.lit(-1 << 62)))
    per = max(1, LEAF_DOCS // 4)
    sizes = keyed.groupBy("region", "key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / per), F.ceil(F.sum("n") / (LEAF_ELEMENTS // 4))).alias("blocks"))
    numbered = keyed.join(sizes, ["region", "key"]).withColumn("block", F.xxhash64("key", F.pmod(F.xxhash64("id", F.lit(-2)), F.col("blocks"))))
    numbered = common.save(numbered.select("region", "key", "block", "id", "items", "root"), "blocks")
    blocks = numbered.select("region", "key", "block").distinct()
    a, b = blocks.alias("a"), blocks.alias("b")
    pairs = a.join(b, (F.col("a.region") == F.col("b.region")) & (F.col("a.block") <= F.col("b.block")) & ((F.col("a.key") != F.col("b.key")) | (F.col("a.key") == -1 << 62))).select("a.region", F.col("a.block").alias("x"), F.col("b.block").alias("y"), F.xxhash64("a.region", "a.block", "b.block").alias("pair"))
    pairs = common.save(pairs, "pairs")
    listed, pairs = pairs, sent(pairs, pairs.count())
    left = pairs.alias("p").join(numbered.alias("n"), (F.col("p.region") == F.col("n.region")) & (F.col("x") == F.col("n.block"))).select("pair", F.lit(0).alias("side"), "id", "items", "root")
    right = pairs.where("x <> y").alias("p").join(numbered.alias("n"), (F.col("p.region") == F.col("n.region")) & (F.col("y") == F.col("n.block"))).select("pair", F.lit(1).alias("side"), "id", "items", "root")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("links", dict)

        def every():
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    yield from zip(*(batch.column(i).slice(at, 200).to_pylist() for i in range(5)), strict=True)

        for _, group in groupby(every(), key=lambda r: r[0]):
            held = list(group)
            one = Group([r[2] for r in held], _sets(r[3] for r in held), threshold, [r[4] for r in held])
            first = sum(r[1] == 0 for r in held)
            found = one.join() if first == len(held) else one.join_across(first)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    dealt = left.unionByName(right).repartition(common.shuffle_partitions(spark), "pair").sortWithinPartitions("pair", "side", "id")
    found = common.save(dealt.mapInArrow(links, "a long, b long"), "links")
    common.drop(numbered)
    common.drop(listed)
    return found


def joined_regions(rows: DataFrame, threshold: float) -> DataFrame:
    """Links that connect what all links connect, for rows of region, id, n and items.

    The links of a level are written before the next begins, so the sets of one level alone are on disk.
    """
    spark, out, level, held = rows.sparkSession, [], 0, None
    rows = rows.withColumn("h", F.xxhash64("items")).withColumn("told", F.lit(False))

    def found_again(rows: DataFrame, placed: DataFrame) -> DataFrame:
        """The sets of placed rows (from_region, id, h, ...)."""
        few = placed.withColumnsRenamed({"id": "of", "h": "of_h"})
        return rows.select(F.col("region").alias("at"), "id", "n", "h", "items").join(sent(few, few.count()), (F.col("at") == F.col("from_region")) & (F.col("id") == F.col("of")) & (F.col("h") == F.col("of_h")))

    while True:
        sizes = common.save(rows.groupBy("region").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("elements"), F.max("told").alias("told")), "sizes")
        n_regions = sizes.count()
        fits = (F.col("docs") <= LEAF_DOCS) & (F.col("elements") <= LEAF_ELEMENTS)
        within = lambda which, n=n_regions, sizes=sizes, rows=rows: rows.join(sent(sizes.where(which).select("region"), n), "region", "left_semi").select("region", "id", "n", "h", "items")
        out.append(common.save(joined_leaves(within(fits), threshold), "links"))
        common.tidy(spark)
        large = sizes.where(~fits)
        if large.isEmpty():
            break
        placed = split(within(~fits), threshold, level)
        common.tidy(spark)
        out.append(common.save(placed.where("region IS NULL").select(F.col("id").alias("a"), F.col("root").alias("b")), "links"))
        placed = placed.where("region IS NOT NULL")
        # where a part is nearly as large as the whole, pivots do not help
        parts = placed.groupBy("from_region", "region").agg(F.count(F.lit(1)).alias("part"))
        whole = large.select(F.col("region").alias("from_region"), "docs", "told")
        stuck = common.save(parts.join(whole, "from_region").where("10 * part > 7 * docs").select("from_region", "told").distinct(), "stuck")
        alike, unlike = stuck.where("told"), stuck.where("NOT told")
        following = found_again(rows, placed.join(sent(stuck, n_regions), "from_region", "left_anti").select("region", "from_region", "id", "h"))
        following = following.select("region", "id", "n", "h", "items", F.lit(False).alias("told"))
        if not unlike.isEmpty():
            of = sent(unlike.select(F.col("from_region").alias("region")), n_regions)
            closer = told_apart(rows.join(of, "region", "left_semi"), threshold)
            common.tidy(spark)
            # parity is not asked again where it leaves a region nearly whole
            kept = closer.groupBy("from_region", "region").agg(F.count(F.lit(1)).alias("part")).join(whole.drop("told"), "from_region").where("10 * part > 7 * docs")
            kept = common.save(kept.select(F.col("region").alias("whole")), "whole")
            closer = closer.join(sent(kept, n_regions), F.col("region") == F.col("whole"), "left")
            following = following.unionByName(closer.select("region", "id", "n", "h", "items", F.col("whole").isNotNull().alias("told")))
        if not alike.isEmpty():
            roots = common.save(placed.join(sent(alike, n_regions), "from_region", "left_semi").groupBy("from_region", "id", "h").agg(F.min("root").alias("root")), "roots")
            out.append(joined_blocks(found_again(rows, roots).select(F.col("from_region").alias("region"), "id", "n", "items", "root"), threshold))
            common.tidy(spark)
        following = common.save(following, "following")
        if held:
            common.drop(held)
        rows = held = following
        level += 1
    if held:
        common.drop(held)
    links = out[0]
    for more in out[1:]:
        links = links.unionByName(more)
    return links


def row_key():
    """The doc_id, or a number beyond all doc_ids made of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit((1 << 42) - 1)))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row of docs.

    Documents are linked when the Jaccard similarity of their shingle sets is at least the threshold (a
    whole number of hundredths). class_id is the least doc_id with the same set, component_id the least
    doc_id that links reach. Letters A-Z count as lower case, words stand between blanks, and a text with
    fewer words than a shingle is one shingle. Null and empty texts have the empty set and are linked with
    nothing; equal texts, and repeated rows of one doc_id, are of one class. Rows without a doc_id are joined by a
    number made of their text; they come back without one, and without a class or component that has no doc_id.
    doc_ids are below NAMELESS. Other columns are ignored.
    """
    named = lambda c: F.when(F.col(c) < NAMELESS, F.col(c)).alias(c)
    return joined(docs, words, threshold).select(named("doc_id"), "n_shingles", named("class_id"), named("component_id"))


def joined(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """As near_duplicates(), with row_key() for doc_id."""
    with common.arrow_batches(docs.sparkSession, BATCH):  # sets are large, and all of a batch is held twice
        return _joined(docs, words, threshold)


def _joined(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    docs = docs.select(row_key().alias("doc_id"), "text")
    rows = common.save(sketched(docs, words, threshold), "sketches")
    by_set = common.save(rows.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("class_id")), "classes")
    # regions: what stands first in a region leads it
    head = F.min(F.when(F.col("leader").isNull(), F.col("id"))).over(Window.partitionBy("part"))
    led = contents(rows.where("n > 0")).select("id", F.coalesce("leader", head).alias("b")).where("id <> b").select(F.col("id").alias("a"), "b")
    groups = common.save(components(led), "groups")
    common.tidy(docs.sparkSession)
    sketches, rows = rows, common.save(rows.select("doc_id", "n", "h1", "h2"), "sets")
    common.drop(sketches)
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("text IS NOT NULL")
    some = by_set.join(groups, F.col("h1") == F.col("node")).select(F.col("class_id").alias("id"), F.col("component").alias("region"))
    if groups.count() <= SENT_ROWS:
        some = F.broadcast(some)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = common.held(("shingles", words), lambda: Shingler(words))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [shingler(t.as_py()) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["region", "id", "n", "items"])

    active = texts.join(some, "id").select("region", "id", "text").mapInArrow(sets, "region long, id long, n long, items binary")
    active = common.save(active, "active")
    # repeated rows of one doc_id: one set each, all of them compared
    links = joined_regions(active, threshold)
    linked = components(links)
    common.drop(active)
    known = by_set.join(linked.withColumnRenamed("node", "class_id"), "class_id", "left").select("h1", "h2", "n", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = rows.select("doc_id", "n", "h1", "h2").join(known, ["h1", "h2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each component: the one with the least doc_id; all columns kept.

    A row without a doc_id goes if any document with one is in its component. Repeated rows of what stays stay.
    """
    found = joined(docs, words, threshold)
    gone = common.save(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    if gone.count() <= SENT_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, row_key() == F.col("gone"), "left_anti")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and component of every document by three-word shingles at a similarity of 0.9."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=3, threshold=0.9)
