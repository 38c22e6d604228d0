"""Secret scans that look through layers of encoding.

A worklist starts with the text itself. Each layer is scanned for secrets and for encoded runs: percent
escapes, Unicode escapes, text of two bytes a character, base64 at any of its four alignments and over line ends, and compressed bytes anywhere
in decoded ones, compressed ones included (gzip, zlib, bzip2, xz, LZMA, several members of these, bare deflate). Runs are
decoded into further layers, bytes that are no text replaced one by one, until nothing new comes out; a layer
whose content was met before is not opened again, so cycles end. Layers are opened depth first, so what is held grows
with the depth. What comes out of compressed bytes stands in a temporary file beyond HELD bytes, or, if nothing
compressed can begin in it, is worked off in pieces; of these, a run that no piece ends stands in such a file, whole.
A decoded layer keeps, for each of its characters, the span of the document that it came from, down to the first
base64 or compressed run; what comes out of that stays bytes, as all of it has the run's span.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import mmap
import re
import zlib
from collections.abc import Callable, Generator, Iterable, Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import chain
from tempfile import SpooledTemporaryFile
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The base patterns.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
#: What an assignment cannot do without; a search for these is much faster than the pattern.
HINT = re.compile(r"(?ai:passw|secret|token|api_?key)")

# Stretches that may hold escapes; nothing in them is tried twice, so an unbroken text takes time in proportion.
PERCENT = re.compile(r"(?:[A-Za-z0-9._~+/=:&?-]++|%[0-9A-Fa-f]{2})++")
UNICODE = re.compile(r"(?:[\x21-\x5B\x5D-\x7E]++|\\u[0-9A-Fa-f]{4})++")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, whose ends may be escaped themselves.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:\r?\n|(?:\\r)?\\n)[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE_END = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*")
#: Lines of base64 at the end of bytes that stand backwards, and text of two bytes a character there.
WRAPPED_END = re.compile(rb"\r?[A-Za-z0-9+/_\\-]*+(?:[\x20\t]*+\n\r?[A-Za-z0-9+/_\\-]++)*+(?:[\x20\t]*+(?:\n\r?)?\Z)?")
WIDE_END = re.compile(rb"[\t\n\r\x20-\x7E]?(?:\0[\t\n\r\x20-\x7E])*+\0?")
#: Compressed bytes that are opened at once, and bytes that come out at once, however many there may be.
FEED, PIECE = 1 << 16, 1 << 22
#: Bytes of an unbroken run that are held in memory; longer ones stand in a temporary file.
HELD = 1 << 24
#: Heads of zlib: method 8, any window, two bytes that 31 divides, no dictionary.
ZLIB = [bytes((method, flags)) for method in range(0x08, 0x80, 0x10) for flags in range(256) if (method << 8 | flags) % 31 == 0 and not flags & 0x20]
#: Where compressed bytes may begin: gzip, zlib, bzip2, xz, LZMA.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh|\xfd7zXZ\x00|\]\x00\x00|" + b"|".join(map(re.escape, ZLIB)))
#: A deflate stream without a head is tried over so many bytes. One of fixed codes, in which many arbitrary bytes have a
#: meaning as well, is sure if it ends after so many, or gives text alone, LEAST bytes at least, twice that without an end.
TRIAL, LEAST, SURE = 16, 16, 128
#: Bytes that are few enough to try every place.
SHORT = 1 << 8
#: Streams without a head are compared after so many bytes each: what gave the same goes on the same.
STEP, ALIKE = 1 << 8, 64
#: Controls, which text has none of.
CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")
UTF8 = codecs.getincrementaldecoder("utf-8")
#: Text of two bytes a character, either way round, as far as it is printable ASCII, of which all secrets are.
WIDE = (re.compile(r"(?:[\t\n\r\x20-\x7E]\0){12,}"), re.compile(r"(?:\0[\t\n\r\x20-\x7E]){12,}"))


def _of_bytes(pattern: re.Pattern) -> re.Pattern:
    """The same pattern over bytes: all of them are about ASCII alone."""
    return re.compile(pattern.pattern.replace("(?ai:", "(?i:").encode())


HINT_B, ASSIGN_B, ACCESS_B, HEX_B = map(_of_bytes, (HINT, ASSIGN, ACCESS, HEX))
PERCENT_B, UNICODE_B, BASE64_B, WRAPPED_B = map(_of_bytes, (PERCENT, UNICODE, BASE64, WRAPPED))
WIDE_B = tuple(map(_of_bytes, WIDE))
# What a run consists of, in stretches of bounded length.
PERCENT_PART = re.compile(rb"(?:%[0-9A-Fa-f]{2}){1,16384}|[^%]{1,65536}")
UNICODE_PART = re.compile(rb"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|[^\\]{1,65536}")
BASE64_PART = re.compile(LINE_END.pattern.encode() + rb"|([A-Za-z0-9+/_-]{1,65536})|=+")
#: The alphabet of base64 for names of files, as the usual one.
URL = bytes.maketrans(b"-_", b"+/")

#: Bytes in memory or in a file that is gone with them.
Held = bytes | mmap.mmap


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and non-overlapping for each kind."""
    found = []
    if HINT.search(text):
        found += [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(found + [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def _readable(data: bytes) -> str:
    """The bytes as text, one replacement character for each byte that is not UTF-8."""
    return re.sub("[\udc80-\udcff]", "\ufffd", data.decode("utf-8", "surrogateescape"))


def _unfinished(piece: bytes) -> int:
    """Where in the piece the run begins that what follows it may carry on.

    But for lines of base64 and text of two bytes a character, no pattern reaches over anything but printable ASCII
    and zeros, nor over more than two stretches of blanks.
    """
    backwards = piece[::-1]
    broken = re.search(rb"[^\x00\x20-\x7e]", backwards)
    at = len(piece) - broken.start() if broken else 0
    blanks = [m.end() for m in re.finditer(rb"\x20+", piece[at:])]
    lines = max(WRAPPED_END.match(backwards).end(), WIDE_END.match(backwards).end())
    return min(at + blanks[-3] if len(blanks) >= 3 else at, len(piece) - lines)


def _all(run: SpooledTemporaryFile) -> Held:
    """What was written to the run."""
    if run.tell() > HELD:
        run.flush()
        return mmap.mmap(run.fileno(), 0, access=mmap.ACCESS_READ)
    run.seek(0)
    return run.read()


def _gathered(pieces: Iterable[bytes]) -> Held:
    run = SpooledTemporaryFile(HELD)
    for piece in pieces:
        run.write(piece)
    return _all(run)


def _texts(pieces: Generator[bytes, None, int | None]) -> Generator[Held, None, int | None]:
    """The pieces, each beginning with the run that the one before left unfinished; returns what they return.

    Pieces that end nothing belong to one run and come out together, however long it gets.
    """
    run, new = SpooledTemporaryFile(HELD), False
    while True:
        try:
            piece = next(pieces)
        except StopIteration as end:
            if new:
                yield _all(run)
            return end.value
        cut = _unfinished(piece)
        run.write(piece)
        new = True
        if cut:
            yield _all(run)
            run, new = SpooledTemporaryFile(HELD), False
            run.write(piece[cut:])


def _stream(data: memoryview, at: int, new: Callable) -> Generator[bytes, None, int | None]:
    """What a compressed stream holds, piece by piece; returns where it ends, None if it is broken off or damaged.

    A decoder keeps what it has decoded when it comes upon damage or a wrong checksum, so what had come out by then is
    passed over by a new one, which gives the rest byte by byte.
    """
    start, done, careful = at, 0, False
    while True:
        opened, at, n = new(), start, 0
        try:
            while not opened.eof:
                wants = getattr(opened, "needs_input", True)  # zlib keeps nothing that it has not read
                near = careful and n >= done
                fed = data[at : at + (1 if near else FEED)] if wants else b""
                piece = opened.decompress(fed, 1 if near else min(PIECE, done - n) if careful else PIECE)
                at += len(fed) - len(getattr(opened, "unconsumed_tail", b""))
                n += len(piece)
                if piece and n > done:
                    yield piece
                elif not piece and wants and not len(fed):
                    return None
                if not careful:
                    done = n
        except (zlib.error, OSError, lzma.LZMAError, EOFError, MemoryError):
            if careful:
                return None
            careful = True
            continue
        return at - len(opened.unused_data)


def _members(data: memoryview, at: int) -> Generator[bytes, None, int | None]:
    """What all streams from a place on hold that follow one another; returns where the last whole one ends."""
    end = None
    while head := MAGIC.match(data[at : at + 6]):
        first = head[0][:1]
        new = bz2.BZ2Decompressor if first == b"B" else lzma.LZMADecompressor if first in b"\xfd]" else lambda: zlib.decompressobj(47)
        done = yield from _stream(data, at, new)
        if done is None:
            break
        end = at = done
    return end


def _fixed_codes() -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length of the fixed code that nine bits of a stream begin with."""
    symbols, sizes = np.zeros(512, np.int64), np.zeros(512, np.int64)
    for first, last, code, size in ((0, 143, 0x30, 8), (144, 255, 0x190, 9), (256, 279, 0, 7), (280, 287, 0xC0, 8)):
        for s in range(first, last + 1):
            bits = int(f"{code + s - first:0{size}b}"[::-1], 2)
            symbols[bits :: 1 << size], sizes[bits :: 1 << size] = s, size
    return symbols, sizes


SYMBOLS, SIZES = _fixed_codes()
#: Further bits of lengths, by symbol, and the least distance that five bits of a stream mean.
LENGTH_BITS = np.array([0] * 257 + [0] * 8 + [k // 4 for k in range(4, 24)] + [0] * 3)
DISTANCES = np.array([(1, 2, 3, 4, 5, 7, 9, 13, *(99,) * 24)[int(f"{k:05b}"[::-1], 2)] for k in range(32)])
#: Room that four code lengths of three bits each take up, of 128 in all.
ROOM = np.array([sum(128 >> (k >> b & 7) for b in (0, 3, 6, 9) if k >> b & 7) for k in range(1 << 12)])


def _bare_starts(data: Held | memoryview) -> Iterator[int]:
    """Where a deflate stream without a head may begin: all places but those that its first bits rule out."""
    n = len(data)
    at = 0
    while n - at >= SHORT:
        part = bytes(data[at : at + FEED])
        m = len(part) - 40  # what follows these is looked at
        b = np.frombuffer(part, np.uint8)
        window = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        kind = b[:m] & 6
        stored = np.flatnonzero((kind == 0) & (b[1 : m + 1] ^ b[3 : m + 3] == 255) & (b[2 : m + 2] ^ b[4 : m + 4] == 255))
        own = np.flatnonzero((kind == 4) & (b[:m] >> 3 <= 29) & (b[1 : m + 1] & 31 <= 29))
        lengths = window[own + 2] >> np.uint64(1)
        count = (window[own] >> np.uint64(13) & np.uint64(15)).astype(np.int64) + 4
        lengths = lengths.astype(np.int64) & ((1 << 3 * count) - 1)
        own = own[sum(ROOM[lengths >> k & 4095] for k in range(0, 57, 12)) == 128]
        found, left = [stored, own], np.flatnonzero(kind == 2)
        bit = np.full(len(left), 3)
        for made in range(12):  # literals so far
            bits = (window[left + (bit >> 3)] >> (bit & 7).astype(np.uint64)).astype(np.int64)
            symbol, size = SYMBOLS[bits & 511], SIZES[bits & 511]
            back = (symbol > 256) & (symbol < 286)
            near = DISTANCES[bits >> size + LENGTH_BITS[symbol] & 31] <= made
            found.append(left[(symbol == 256) | back & near])
            literal = symbol < 256
            left, bit = left[literal], (bit + size)[literal]
        yield from (at + np.sort(np.concatenate([*found, left]))).tolist()
        at += m
    yield from (p for p in range(at, n) if data[p] & 6 != 6)


def _tried(data: Held | memoryview, at: int):
    """A decoder of deflate that has read TRIAL bytes from a place on, and what it gave; None if they are no stream."""
    opened = zlib.decompressobj(-15)
    try:
        return opened, opened.decompress(data[at : at + TRIAL])
    except zlib.error:
        return None


def _to_damage(data: memoryview, at: int, begin: int, stop: int) -> tuple[bytes, int]:
    """What a stream without a head gives from a place within it on, up to damage before `stop`, and where that is."""
    opened, out = zlib.decompressobj(-15), []
    for k in range(at, begin, FEED):
        opened.decompress(data[k : min(k + FEED, begin)])
    with suppress(zlib.error):
        while begin < stop:
            out.append(opened.decompress(data[begin : begin + 1], 1))
            begin += 1 - len(opened.unconsumed_tail)
    return b"".join(out), begin


class _Text:
    """Whether bytes that come piece by piece are UTF-8 without controls."""

    def __init__(self):
        self.decoder, self.holds = UTF8(), True

    def add(self, piece: bytes) -> None:
        if self.holds:
            try:
                self.holds = not CONTROL.search(piece) and self.decoder.decode(piece) is not None
            except UnicodeDecodeError:
                self.holds = False


class _Passed:
    """What streams without a head gave at the places where they are compared, by place, and of those that were not
    followed any further what they read, gave and met."""

    def __init__(self):
        self.at: dict[int, dict[bytes, list[bool]]] = {}
        self.read: dict[bytes, tuple[bytes, bool]] = {}

    def again(self, read: bytes, stop: int) -> bool:
        """Whether a stream read the same up to where it was compared and met the same."""
        last, counted = self.read.get(read, (b"", False))
        return bool(last) and (earlier := self.at.get(stop, {}).get(last)) is not None and earlier[0] == counted


def _bare(data: memoryview, at: int, passed: _Passed) -> Held | None:
    """What a deflate stream without a head holds, if the bytes from the place on are one.

    Nothing but the stream itself tells it from arbitrary bytes. Codes of its own are hardly ever complete by chance; one
    of fixed codes has to give text alone, or come to its end after SURE bytes or where the data ends that it began. As
    streams that begin at different places come to read the same codes, one that gives what an earlier one gave at the
    same place is not followed any further.
    """
    first, n = (at + TRIAL) // STEP * STEP + STEP, len(data)
    if first < n and passed.again(bytes(data[at:first]), first) or not (tried := _tried(data, at)):
        return None
    (opened, piece), counts = tried, data[at] & 6 != 2
    stop, kept, long, last, text, this = min(at + TRIAL, n), [], None, b"", _Text(), [False]
    while True:
        kept.append(piece)
        text.add(piece)
        if len(kept) > 64:  # a long one
            long = long or SpooledTemporaryFile(HELD)
            long.write(b"".join(kept))
            kept.clear()
        read = stop - len(opened.unused_data)
        if opened.eof:
            counts = counts or read - at >= SURE or at == 0 and read == n
        if opened.eof or stop == n:
            break
        last = (last + piece)[-ALIKE:]
        if stop % STEP == 0 and len(last) == ALIKE and (earlier := passed.at.setdefault(stop, {}).setdefault(last, this)) is not this:
            if stop == first:
                passed.read[bytes(data[at:first])] = last, earlier[0]
            counts = counts or earlier[0]
            break
        begin, stop = stop, min(stop // STEP * STEP + STEP, n)
        try:
            piece = opened.decompress(data[begin:stop])
        except zlib.error:
            if counts or text.holds:
                piece, read = _to_damage(data, at, begin, stop)
                kept.append(piece)
                text.add(piece)
            break
    this[0] = counts = counts or text.holds and read - at >= (LEAST if opened.eof else 2 * LEAST)
    if counts and long:
        long.write(b"".join(kept))
        return _all(long)
    return b"".join(kept) if counts else None


def _may_hold(pieces: Iterable[bytes]) -> bool:
    """Whether compressed bytes may begin in what comes in pieces."""
    before = b""
    for piece in pieces:
        for k in range(0, len(piece), FEED):
            part = before + piece[k : k + FEED]
            if MAGIC.search(part) or any(_tried(part, p) for p in _bare_starts(part)):
                return True
            before = part[-64:]
    return False


def _contents(pieces: Callable[[], Generator[bytes, None, int | None]]) -> Generator[Held, None, int | None]:
    """What comes in pieces, whole; beyond HELD bytes its texts alone if nothing compressed can begin in it.
    Returns what the pieces return."""
    held, n, coming = [], 0, pieces()
    while n <= HELD:
        try:
            held.append(next(coming))
        except StopIteration as end:
            if held:
                yield b"".join(held)
            return end.value
        n += len(held[-1])
    more = _may_hold(chain(held, coming))
    held.clear()
    if not more:
        return (yield from _texts(pieces()))
    end: list[int | None] = []

    def noted() -> Iterator[bytes]:
        end.append((yield from pieces()))

    yield _gathered(noted())
    return end[0]


@lru_cache(1 << 14)
def _opens(data: bytes) -> bool:
    return next(_within_bytes(data), None) is not None


def _opened(data: Held) -> Iterator[Held]:
    """The contents of every compressed stretch in the bytes. Of short ones, which many texts repeat, it is known whether there are any."""
    if len(data) >= SHORT or _opens(bytes(data)):
        yield from _within_bytes(data)


def _within_bytes(data: Held) -> Iterator[Held]:
    view, at, whole = memoryview(data), 0, []
    while m := MAGIC.search(data, at):
        end = yield from _contents(lambda start=m.start(): _members(view, start))
        if end:
            whole.append((m.start(), end))
        at = end or m.start() + 1
    passed = _Passed()
    for start in _bare_starts(data):
        while whole and whole[0][1] <= start:
            del whole[0]
        if not whole or start < whole[0][0]:
            if content := _bare(view, start, passed):
                yield content


def _kinds(data: Held) -> Iterator[int]:
    """The kinds of secrets that the bytes hold."""
    if HINT_B.search(data) and any(m.end(1) - m.start(1) >= 12 for m in ASSIGN_B.finditer(data)):
        yield 0
    if ACCESS_B.search(data):
        yield 1
    if HEX_B.search(data):
        yield 2


def _unescaped(data: Held, start: int, end: int) -> Iterator[bytes]:
    for m in UNICODE_PART.finditer(data, start, end):
        if m[1]:
            yield chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00).encode()
        else:
            yield chr(int(m[3], 16)).encode("utf-8", "replace") if m[3] else m[0]


def _from_base64(data: Held, start: int, end: int, skipped: int) -> Iterator[bytes]:
    left = b""
    for m in BASE64_PART.finditer(data, start, end):
        if m[1]:
            part = left + m[1][skipped:]
            skipped = max(0, skipped - len(m[1]))
            whole = len(part) - len(part) % 4
            yield base64.b64decode(part[:whole].translate(URL))
            left = part[whole:]
    if len(left) > 1:
        yield base64.b64decode(left.translate(URL) + b"=" * (4 - len(left)))


def _inner(data: Held) -> Iterator[Held]:
    """What every encoded run in the bytes holds."""
    if data.find(b"\0") >= 0:
        for wide in WIDE_B:
            for m in wide.finditer(data):
                yield _gathered(data[k : min(k + FEED, m.end())].replace(b"\0", b"") for k in range(m.start(), m.end(), FEED))
    if data.find(b"%") >= 0:
        for m in PERCENT_B.finditer(data):
            if data.find(b"%", m.start(), m.end()) >= 0:
                yield _gathered(unquote_to_bytes(part[0]) for part in PERCENT_PART.finditer(data, m.start(), m.end()))
    if data.find(b"\\u") >= 0:
        for m in UNICODE_B.finditer(data):
            if data.find(b"\\u", m.start(), m.end()) >= 0:
                yield _gathered(_unescaped(data, m.start(), m.end()))
    for m in chain(BASE64_B.finditer(data), WRAPPED_B.finditer(data)):
        for skipped in range(4):
            yield _gathered(_from_base64(data, m.start(), m.end(), skipped))
    yield from _opened(data)


def unwrapped(text: str) -> Iterator[tuple[int, int, str | Held, list[tuple[int, int]] | None]]:
    """(start, end, decoded, bounds) of every encoded run; bounds has each decoded character's place in text,
    or is None, and decoded bytes, where the characters of the run cannot be told apart."""
    if "\0" in text:
        for wide in WIDE:
            for m in wide.finditer(text):
                yield m.start(), m.end(), m[0].replace("\0", ""), [(k, k + 2) for k in range(m.start(), m.end(), 2)]
    if "%" in text:
        for m in PERCENT.finditer(text):
            if "%" not in m[0]:
                continue
            data = unquote_to_bytes(m[0])
            yield m.start(), m.end(), _readable(data), _percent_places(m[0], m.start(), data)
            for opened in _opened(data):
                yield m.start(), m.end(), opened, None
    if "\\u" in text:
        for m in UNICODE.finditer(text):
            if "\\u" not in m[0]:
                continue
            out, places = [], []
            for part in re.finditer(r"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|[\s\S]", m[0]):
                if part[1]:  # a surrogate pair is one character; half a pair is none
                    out.append(chr(0x10000 + ((int(part[1], 16) - 0xD800) << 10) + int(part[2], 16) - 0xDC00))
                else:
                    c = chr(int(part[3], 16)) if part[3] else part[0]
                    out.append("\ufffd" if "\ud800" <= c <= "\udfff" else c)
                places.append((m.start() + part.start(), m.start() + part.end()))
            yield m.start(), m.end(), "".join(out), places
    for m in chain(BASE64.finditer(text), WRAPPED.finditer(text)):
        run = LINE_END.sub("", m[0]).rstrip("=").replace("-", "+").replace("_", "/")
        for skipped in range(4):  # what stands before the encoded part may belong to the alphabet as well
            part = run[skipped:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            yield m.start(), m.end(), base64.b64decode(part + "=" * (-len(part) % 4)), None


def _percent_places(run: str, start: int, data: bytes) -> list[tuple[int, int]]:
    by_byte = []
    for part in re.finditer(r"%[0-9A-Fa-f]{2}|[\s\S]", run):
        by_byte.append((start + part.start(), start + part.end()))
    out, at = [], 0
    for c in data.decode("utf-8", "surrogateescape"):
        n = 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
        out.append((by_byte[at][0], by_byte[at + n - 1][1]))
        at += n
    return out


def scan_text(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans of the text, and those that only its decoded layers show, mapped to the text.

    A secret in a base64 or compressed run is given the run's whole span. A decoded secret that lies where
    a base span of its kind is already gives no new one.
    """
    base = base_spans(text)
    found, met = set(base), set()
    work = [unwrapped(text)]  # the layers that are open, innermost last: each is taken up where it was left
    while work:
        at = next(work[-1], None)
        if at is None:
            work.pop()
            continue
        start, end, layer, places = at
        key = (start, end, places is None, hashlib.blake2b(layer if places is None else layer.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if key in met:
            continue
        met.add(key)
        if places is None:
            found.update(Span(start, kind, end) for kind in _kinds(layer))
        else:
            for s in base_spans(layer):
                a, b = _here(at, s.start, s.end)
                found.add(Span(a, s.kind, b))
        work.append(_within(at))
    return base, sorted(found)


def _here(layer, a: int, b: int) -> tuple[int, int]:
    """The span of the document that a stretch of a layer with places came from."""
    return layer[3][a][0], layer[3][b - 1][1]


def _within(layer) -> Iterator[tuple[int, int, str | Held, list[tuple[int, int]] | None]]:
    """The layers in a layer, with their places in the document."""
    start, end, content, places = layer
    if places is None:
        for inner in _inner(content):
            yield start, end, inner, None
    else:
        for a, b, inner, inside in unwrapped(content):
            yield *_here(layer, a, b), inner, None if inside is None else [_here(layer, *p) for p in inside]


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans.

    Whole texts are read; null counts as empty and has no spans. Repeated rows give equal results each; null ids stay.
    Other columns are ignored. A worker holds one Arrow batch of documents, and of compressed layers a piece each;
    unbroken runs beyond HELD bytes take room in its temporary folder while they are open.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show = lambda spans: ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                base, every = scan_text(text.as_py() or "")
                out.append((*(sum(s.kind == k for s in base) for k in range(len(KINDS))), hashlib.sha256(show(base).encode()).hexdigest(), show(every)))
            kinds = (pa.int64(),) * len(KINDS) + (pa.string(),) * 2
            columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document."""
    return scan(common.table(spark, sf_dir, "documents"))
