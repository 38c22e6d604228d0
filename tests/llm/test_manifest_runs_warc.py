"""The manifest, the periodic runs and the archives against brute force, SQL and planted damage."""

import base64
import collections
import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import common, merkle, queries, runs, warc

SF = "/root/testdata/sf0.001"


def same(found, want):
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, want), key=repr)


@pytest.mark.parametrize("name, table", [("op11_merkle_manifest", "documents"), ("op13_warc_salvage", "pages")])
def test_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    same(queries.QUERIES[name](spark, SF).select(*columns).collect(), want.fetchall())


# manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def grown(nodes):
    """(root, siblings before and after each node and its ancestors), by the definition."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = nodes[i // 2 * 2 : i // 2 * 2 + 2]
            path.append((run[: i % 2], run[i % 2 + 1 :]))
        at = [i // 2 for i in at]
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def manifest(rows):
    by_lang = collections.defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))):
        by_lang[row[2]].append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: grown([leaf(*r) for r in by_lang[x]]) for x in langs}
    root, tops = grown([trees[x][0] for x in langs])
    for x, top in zip(langs, tops, strict=True):
        for row, path in zip(by_lang[x], trees[x][1], strict=True):
            doc_id, source, lang, n_chars, text = row
            hit = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            node = leaf(doc_id, source, lang, n_chars + hit, text) if n_chars is not None else leaf(*row)
            for before, after in path + top:
                node = digest(*before, node, *after)
            yield doc_id, leaf(*row), trees[x][0], root, digest(*(h for level in path + top for side in level for h in side)), node, node == root


@pytest.mark.parametrize("levels, most", [(6, 100_000), (3, 0)])
def test_manifest(spark, monkeypatch, levels, most):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "MOST_RUNS", most)
    rng = random.Random(levels)
    rows = [(i, rng.choice(["a", "é", None]), rng.choice(["en"] * 8 + ["ü", None, ""]), rng.choice([None, i, 0]), rng.choice([None, "", "x" * 40_000, f"tëxt {i}"])) for i in range(120)]
    rows += [(3, "a", "de", 1, "once"), rows[5], rows[5], (None, "a", "en", 1, "no id"), (None, None, None, None, None), (-7, "a", "fr", 2, "lone"), (7, "-", "en", 1, "1:-")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("x") for c in ("group", "idx", "n", "hash", "path", "root", "block", "leaf")})
    got = merkle.documents_manifest(docs.repartition(5)).collect()
    same(got, manifest(rows))
    assert any(not r.verified for r in got) and sum(r.verified for r in got) > 60
    same(merkle.documents_manifest(docs.limit(0)).collect(), [])


# runs


def brute_runs(words, least, periods):
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q) and j > i:
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def texts_with_repeats(rng):
    for _ in range(rng.randint(1, 5)):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange((n - a) // 3 + 1)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        yield words


def test_squares_make_all_runs():
    rng = random.Random(8)
    for _ in range(700):
        texts = list(texts_with_repeats(rng))
        lengths = np.array([len(t) for t in texts])
        codes = np.array([w + 10 * k for k, t in enumerate(texts) for w in t], np.int64)
        starts = np.append(0, np.cumsum(lengths)).tolist()
        for periods, least in ((2, 1), (3, 6)):
            got = [tuple(map(int, r)) for r in runs.merged(*runs.squares(codes, lengths, periods)) if r[1] >= max(least, periods * r[2])]
            assert got == [(s + starts[k], n, q) for k, t in enumerate(texts) for s, n, q in brute_runs(t, least, periods)]


def test_squares_of_special_words():
    a, b = [0], [1, 0]
    while len(b) < 400:  # as many runs as a text can have
        a, b = b, b + a
    powers = [0]
    for k in range(1, 8):
        powers = powers + [k] + powers + powers
    for text in (b, powers, [0] * 300, list(range(200)) * 4):
        got = [tuple(map(int, r)) for r in runs.merged(*runs.squares(np.array(text, np.int64), np.array([len(text)])))]
        assert got == brute_runs(text, 1, 2)


def described(doc_id, text, planted):
    words = (text or "").encode().split()  # bytes part at ASCII blanks alone
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 24, 3)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("slice_words, planted", [(1 << 19, True), (50, True), (50, False)])
def test_runs(spark, monkeypatch, slice_words, planted):
    rng = random.Random(slice_words)
    rows = []
    for i in range(150):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 120))]
        if i % 3 == 0 and words:
            words = words[: rng.randint(1, 9)] * rng.randint(1, 30)
        rows.append((i, "".join(w + rng.choice([" ", "\n", "\t ", "\x0b", "  "]) for w in words)))
    rows += [(150, None), (151, ""), (152, " \n\t"), (None, "x y " * 20), (153, "é é " * 30), (154, "\x1c " * 30), (155, "na " * 3_000), rows[3], rows[3], (39, rows[8][1]), (-5, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("start", "length", "period", "n_runs")})
    monkeypatch.setattr(runs, "SLICE", slice_words)
    same(runs.find(docs.repartition(3), planted).collect(), [described(*r, planted) for r in rows])
    same(runs.find(docs.limit(0)).collect(), [])


# archives

PAGES = [(i, f"http://x/{i}", "a" if i % 3 == 0 else f"p{i % 7}é\r\n\r\nWARC/1.1\r\nx") for i in range(50)]
PAGES += [(9, "u", "a"), (48, "http://x/1", "a"), (48, None, "a"), (None, "x\r\ny z", None), (None, None, ""), (60, "u", None), (None, "w", "lone"), (61, "v", "long" * 200_000)]


def dealt(rows):
    """Types and references by the definition; of rows with the greatest id, one is the response."""
    by_payload = collections.defaultdict(list)
    for page_id, _, html in rows:
        by_payload[(html or "").encode()].append(page_id)
    for payload, ids in by_payload.items():
        ids.sort(key=lambda p: (p is None, -(p or 0)))
        for k, page_id in enumerate(ids):
            yield page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if k else "response", ids[0] if k else None


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("digest", "size", "copy", "response", "n_same", "place", "payload")}).repartition(3)


@pytest.mark.parametrize("sent, size", [(200_000, 1 << 24), (10, 300), (20, 1)])
def test_archives(spark, monkeypatch, sent, size):
    monkeypatch.setattr(warc, "MOST_SENT", sent)
    path = common.new_path(spark, "archives")
    warc.write(pages_of(spark, PAGES), path)
    found = warc.read(spark, path)
    assert warc.gaps(found).isEmpty()
    got = warc.records(found).where("record_type <> 'warcinfo'").collect()
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], dealt(PAGES))
    texts = {(p, h or "") for p, _, h in PAGES}
    assert all((r.page_id, bytes(r.payload).decode()) in texts for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    assert {r.url for r in got} >= {None, "http://x/1", "x%0D%0Ay%20z"}


def test_archives_of_no_pages(spark):
    path = common.new_path(spark, "archives")
    warc.write(pages_of(spark, PAGES).limit(0), path)
    assert warc.read(spark, path).isEmpty()


def archive(n, packed):
    """(bytes, page ids by the places of their records)"""
    out, places = b"", {}
    for i in range(n):
        payload = f"page {i} WARC/1.1\r\n\x1f\x8b\x08 ".encode() * (i % 5 + 1)
        rec = warc.page_record(i, 0, f"u{i}", payload, len(payload), hashlib.sha1(payload).digest(), None, False)
        rec = warc.member(rec) if packed else rec
        block = 10 if packed else rec.index(b"\r\n\r\n") + 4  # the headers of a plain record have no checksum
        places[i] = (len(out), len(out) + len(rec), len(out) + block)
        out += rec
    return out, places


def read_ids(data):
    found = list(warc.salvaged(data))
    ids = [int(r.headers["warc-record-id"].split(":")[2]) for r in found if isinstance(r, warc.Found)]
    return ids, [g for g in found if not isinstance(g, warc.Found)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    whole, places = archive(12, packed)
    assert read_ids(whole) == (list(range(12)), [])
    rng = random.Random(packed)
    for _ in range(300):
        data, hit = bytearray(whole), set()
        for _ in range(rng.randint(1, 3)):  # bytes changed within records
            i = rng.randrange(12)
            at = rng.randrange(places[i][2], places[i][1])
            new = rng.randrange(256)
            if data[at] != new:
                data[at] = new
                hit.add(i)
        ids, gaps = read_ids(bytes(data))
        assert set(range(12)) - hit <= set(ids)
        for i in set(range(12)) - set(ids):  # what is lost lies in a gap, and no whole record does
            assert any(a <= places[i][0] and places[i][1] <= b for a, b, _ in gaps)
        assert all(not (a <= places[i][0] and places[i][1] <= b) for i in ids for a, b, _ in gaps)


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_of_cut_and_joined_archives(packed):
    whole, places = archive(6, packed)
    for cut in range(places[3][0] + 1, places[4][0]):
        ids, gaps = read_ids(whole[:cut])
        assert ids == [0, 1, 2] and gaps[0][:2] == (places[3][0], cut) or whole[cut - 1 : cut] == b"\0" or cut > places[4][0] - 5
    ids, gaps = read_ids(whole[: places[3][0] + 40] + whole)  # broken off and begun anew
    assert ids == [0, 1, 2, 0, 1, 2, 3, 4, 5] and [g[:2] for g in gaps] == [(places[3][0], places[3][0] + 40)]
    junk = b"\x1f\x8b\x08junk WARC/1.0\r\n" * 50
    ids, gaps = read_ids(junk + whole)
    assert ids == list(range(6)) and [g[:2] for g in gaps] == [(0, len(junk))] and gaps[0][2]
    assert read_ids(b"") == ([], []) and read_ids(b"\0\r\n") == ([], [])
    assert read_ids(b"no archive")[1] == [(0, 10, "no version line")]


def test_salvage_of_damaged_files(spark, tmp_path):
    whole, places = archive(8, True)
    begin, end, _ = places[5]
    (tmp_path / "broken.warc.gz").write_bytes(whole[:begin] + b"\0" * 20 + whole[begin + 20 :])
    (tmp_path / "plain.warc").write_bytes(archive(3, False)[0])
    found = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in found if r.reason is None) == sorted([0, 1, 2, 0, 1, 2, 3, 4, 6, 7])
    (gap,) = warc.gaps(warc.read(spark, str(tmp_path))).collect()
    assert gap.archive.endswith("broken.warc.gz") and begin <= gap.begin < gap.end == end and gap.reason
