"""Token-id output in directly addressable codes.

An id is cut into chunks of eight bits. Level k holds the k-th chunk of every id that has one, and a
bitmap that says for which of them a further chunk follows at level k+1. Ranks of the bitmap lead from a
position at one level to the position at the next; a directory holds the rank before every 512 bits, so a
single token is read in a few steps without decoding its block.

The files are Parquet rows, one per block of whole documents: Spark's own committer makes the write safe
against lost executors, and any store that Spark reaches can hold them.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RANK_BITS = 512
BLOCK_TOKENS = 1 << 18
#: Words up to this length are kept in a worker's memory, at most so many of them.
CACHE_CHARS, CACHE_WORDS = 40, 500_000
#: Bytes of text whose words are looked up together, new words that the tokenizer takes at once, and bytes of a batch of
#: texts on its way to a worker.
SLICE_BYTES, NEW_WORDS, BATCH = 4 << 20, 8192, "4m"

BLOCKS = "shard int, block int, start_in_shard long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids."""
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while len(rest) or not levels:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        per = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = (np.cumsum(per) - per).astype("<u4")
        levels.append(struct.pack("<I", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
    return struct.pack("<4sB", b"DAC1", len(levels)) + b"".join(levels)


class Codes:
    """A packed block; ``codes[i]`` is one token, ``codes.all()`` all of them."""

    def __init__(self, payload: bytes):
        magic, n = struct.unpack_from("<4sB", payload)
        if magic != b"DAC1":
            raise ValueError("not a block of directly addressable codes")
        at, self.levels = 5, []
        for _ in range(n):
            (count,) = struct.unpack_from("<I", payload, at)
            at += 4
            parts = []
            for kind, size in ((np.uint8, count), (np.uint8, -(-count // 8)), ("<u4", -(-count // RANK_BITS))):
                parts.append(np.frombuffer(payload, kind, size, at))
                at += parts[-1].nbytes
            self.levels.append(parts)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            whole = i // RANK_BITS * RANK_BITS // 8
            before = int.from_bytes(bits[whole : i // 8 + 1].tobytes(), "little") & ((1 << (i - whole * 8)) - 1)
            i = int(ranks[i // RANK_BITS]) + before.bit_count()
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(len(self), np.uint32)
        where = None
        for k, (chunks, bits, _) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(8 * k)
            if where is None:
                out[:], where = part, np.arange(len(part))
            else:
                out[where] |= part
            where = where[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


class WordEncoder:
    """Ids of whole texts, with a bounded memory of the words met before.

    The tokenizer drops white space and never joins what stands on both sides of it, so the ids of a text
    are those of its parts between blanks. Nor does it join letters with the ASCII marks that follow them,
    save for apostrophes; and a run of letters alone ends in the one token that ends a word, so new runs
    are encoded together and told apart by these tokens. The distinct words of a batch are looked up once;
    their ids lie end to end in one array, from which the ids of all texts are taken.
    """

    _LETTERS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, int] = {}
        self.begin, self.count, self.ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, "<u4")
        self.met = np.zeros(1 << 16, np.int32)

    def _forget(self) -> None:
        """Keeps the words met most often, less than half of all."""
        met = self.met[: len(self.known)]
        bar = np.sort(met)[len(met) // 2]
        held = np.flatnonzero(met > bar)
        count, begin = self.count[held], self.begin[held]
        sums = np.cumsum(count) - count
        self.ids = self.ids[np.repeat(begin - sums, count) + np.arange(int(count.sum()))]
        words = list(self.known)
        self.known = {words[i]: k for k, i in enumerate(held.tolist())}
        self.begin, self.count, self.met = sums.astype(np.int32), count, np.zeros(len(held), np.int32)

    def _each(self, words: list[str]) -> dict[str, bytes]:
        ids = (np.array(e.ids, "<u4").tobytes() for at in range(0, len(words), NEW_WORDS) for e in self.tokenizer.encode_batch_fast(words[at : at + NEW_WORDS], add_special_tokens=False))
        return dict(zip(words, ids, strict=True))

    def _runs(self, runs: list[str]) -> dict[str, bytes]:
        out = {}
        for at in range(0, len(runs), NEW_WORDS):
            out |= self._together(runs[at : at + NEW_WORDS])
        return out

    def _together(self, runs: list[str]) -> dict[str, bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(runs):
            return self._each(runs)
        raw = ids.tobytes()
        return {w: raw[a:b] for w, a, b in zip(runs, [0, *cuts], cuts, strict=False)}

    def _of(self, place: int) -> bytes:
        return self.ids[self.begin[place] : self.begin[place] + self.count[place]].tobytes()

    def _learned(self, missing: list[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Ids of new words and of what they are made of: those to keep, and those of this batch alone."""
        parted, others = [], []
        match = self._LETTERS.fullmatch
        for w in missing:
            m = match(w)
            run, tail = m.groups() if m else ("", "")
            if run.isascii() and m or (run.isalpha() and run.lower().isalpha()):
                parted.append((w, run, tail))
            else:
                others.append(w)
        runs = list({r for _, r, _ in parted if r not in self.known})
        marks = list({t for _, _, t in parted if t and t not in self.known})
        new = (self._runs(runs) if runs else {}) | (self._each(others + marks) if others or marks else {})
        get = lambda x: new[x] if x in new else self._of(self.known[x])
        # a run met for the first time is kept without its marks
        fresh = set(runs)
        ends = {t: get(t) for t in {t for _, _, t in parted if t}}
        once = {w: new[run] + ends[tail] for w, run, tail in parted if tail and run in fresh}
        new |= {w: self._of(self.known[run]) + ends[tail] for w, run, tail in parted if tail and run not in fresh}
        long = [w for w in new if len(w) > CACHE_CHARS]
        once |= {w: new.pop(w) for w in long}
        return new, once

    def _placed(self, words: list[str]) -> np.ndarray:
        """Where in begin and count each of the distinct words stands."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        known = self.known
        place = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(place < 0).tolist()
        if missing:
            kept, once = self._learned([words[i] for i in missing])
            n, used = len(known), int(self.begin[len(known) - 1] + self.count[len(known) - 1]) if known else 0
            found = [*kept.values(), *once.values()]
            ids = np.frombuffer(b"".join(found), "<u4")
            count = np.fromiter(map(len, found), np.int64, len(found)) // 4
            self.ids = _room(self.ids, used + len(ids))
            self.begin, self.count, self.met = (_room(x, n + len(found)) for x in (self.begin, self.count, self.met))
            self.met[n : n + len(found)] = 0
            self.ids[used : used + len(ids)] = ids
            self.count[n : n + len(found)] = count
            self.begin[n : n + len(found)] = used + np.cumsum(count) - count
            known.update(zip(kept, range(n, n + len(kept)), strict=True))
            # what is not kept lies beyond, where the next batch writes
            beyond = dict(zip(once, range(n + len(kept), n + len(found)), strict=True))
            place[missing] = [known[words[i]] if words[i] in known else beyond[words[i]] for i in missing]
        self.met[place] += 1
        return place

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each has); a null text has none."""
        flat = pc.fill_null(texts.cast(pa.string()), "")
        for blank in "\n\t\r":
            flat = pc.replace_substring(flat, blank, " ")
        split = pc.split_pattern(flat, " ")
        words = split.flatten().dictionary_encode()
        offsets = split.offsets.to_numpy().astype(np.int64)
        place = self._placed(words.dictionary.to_pylist())[words.indices.to_numpy()]
        n = self.count[place]
        sums = np.append(0, np.cumsum(n, dtype=np.int64))
        at = np.repeat((self.begin[place] - sums[:-1]).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        offsets -= offsets[0]
        return self.ids[at], sums[offsets[1:]] - sums[offsets[:-1]]


def _room(held: np.ndarray, size: int) -> np.ndarray:
    if size <= len(held):
        return held
    out = np.zeros(max(size, 2 * len(held)), held.dtype)
    out[: len(held)] = held
    return out


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder, which keeps its words from one task to the next."""
    return common.held(("words", path), lambda: WordEncoder(path))


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of the batch whose texts have `most` bytes together, or one longer text alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, width, ids) of every row where it lies: the ids of the whole text and the end id, little-endian and
    unsigned, of two bytes each where the vocabulary allows, else of four."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = encoder(tokenizer_path)
        width = 2 if max(end_id, len(words.ends)) < 1 << 16 else 4
        for batch in batches:
            for part in _slices(batch, SLICE_BYTES):
                ids, n = words.batch(part.column(1))
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id)
                offsets = width * np.append(0, ends + np.arange(1, len(n) + 1))
                raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype(f"<u{width}"))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([width] * len(n), pa.int32()), raw.cast(pa.binary())], names=["doc_id", "width", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, width int, ids binary")


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of token ids, in ascending doc_id order, written to the shared folder.

    Every text is encoded whole, where it lies, and written; only ids are shuffled. A null text counts as
    empty and has the end id alone. Rows with the same doc_id stand together, ordered by ids; a null doc_id
    comes first. Columns other than doc_id and text are ignored. An empty table gives an empty file table.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, parts, held = [], [], [], 0

        def flush():
            payload = pack(np.concatenate(parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([at], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["shard", "block", "start_in_shard", "n_tokens", "doc_ids", "lengths", "payload"],
            )

        for batch in batches:
            for doc_id, width, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                doc_ids.append(doc_id)
                parts.append(np.frombuffer(ids.as_py(), f"<u{width}"))
                lengths.append(len(parts[-1]))
                held += lengths[-1]
                if held >= block_tokens:
                    yield flush()
                    at, start = at + 1, start + held
                    doc_ids, lengths, parts, held = [], [], [], 0
        if doc_ids:
            yield flush()

    spark = docs.sparkSession
    with common.arrow_batches(spark, BATCH):  # a worker holds a batch besides its words
        ids = common.save(encoded(docs, tokenizer_path, end_id), "token_ids", compression="zstd")
    ordered = ids.repartitionByRange(common.shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    out = common.save(ordered.mapInArrow(blocks, BLOCKS), "token_blocks", compression="zstd")
    common.drop(ids)
    return out


def bases(files: DataFrame) -> list[tuple[int, int]]:
    """(shard, ids in all shards before it): one row per shard, as many as encode() had partitions."""
    out, at = [], 0
    for shard, n in sorted(files.groupBy("shard").agg(F.sum("n_tokens")).collect()):
        out.append((shard, at))
        at += n
    return out


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the blocks.

    start counts the ids of all documents before it. Only one total per shard passes through a broadcast:
    as many rows as encode() had partitions, whatever the number of documents.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for row in range(batch.num_rows):
                base, doc_ids, lengths, payload = (batch.column(i)[row] for i in range(4))
                ids = Codes(payload.as_py()).all().astype("<u4").tobytes()
                n = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(n)
                crcs = [zlib.crc32(ids[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(base.as_py() + ends - n), pa.array(n), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    of_shard = F.broadcast(files.sparkSession.createDataFrame(bases(files), "shard int, base long"))
    return files.join(of_shard, "shard").select((F.col("base") + F.col("start_in_shard")).alias("base"), "doc_ids", "lengths", "payload").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(files: DataFrame, position: int) -> int:
    """The token id at a place in the whole output: one block row is read, and none of it decoded."""
    shard, base = max((x for x in bases(files) if x[1] <= position), default=(-1, 0))
    place = position - base
    row = files.where((F.col("shard") == shard) & (F.col("start_in_shard") <= place) & (F.col("start_in_shard") + F.col("n_tokens") > place)).select("start_in_shard", "payload").first()
    if row is None:
        raise IndexError(position)
    return Codes(bytes(row.payload))[place - row.start_in_shard]


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, read back from the written codes."""
    import public_tokenizers

    files = encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_documents(files)
