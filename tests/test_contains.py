"""Substring search against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest

from evidentia.operators import contains, verify
from evidentia.plans import catalogue


def test_pairs(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(120, None), (121, ""), (122, "a"), (123, "ab" * 5000 + "xyz")]
    patterns = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 7)] + ["xyz", "bxyz", "q", "abq", "", None, "xyz", "%", "a_"]
    rows = spark.createDataFrame(texts, "id long, text string")
    got = contains.pairs(spark.createDataFrame([(p,) for p in patterns], "pattern string"), rows)
    assert sorted(map(tuple, got.collect())) == sorted((p, i) for p in {p for p in patterns if p} for i, t in texts if t and p in t)
    assert contains.pairs(spark.createDataFrame([("",)], "pattern string"), rows).isEmpty()
    assert contains.pairs(spark.createDataFrame([("a",)], "pattern string"), rows.limit(0)).isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_word_hits(spark):
    texts = [(1, "Mehrbedarf und Bedarf"), (2, "BEDARFSGEMEINSCHAFT, Straße"), (3, None), (4, "be-darf"), (5, "Kelvin: Kurz")]
    terms = [(1, "bedarf"), (1, "mehr"), (2, "straße"), (9, "bedarf"), (9, "raß"), (9, "kurz")]
    got = contains.word_hits(spark.createDataFrame(terms, "query_id long, term string"), spark.createDataFrame(texts, "chunk_id long, text string"))
    want = {}
    for q, t in terms:
        for c, text in texts:
            if text and t in text.lower():
                want[q, c] = want.get((q, c), 0) + 1
    assert {(r.query_id, r.chunk_id): r.hits for r in got.collect()} == want
    ranked = contains.keyword_hits(spark.createDataFrame(terms, "query_id long, term string"), spark.createDataFrame(texts, "chunk_id long, text string"), k=1)
    assert {(r.query_id, r.chunk_id) for r in ranked.collect()} == {(9, 2)} | {(1, 2)}


def test_keyword_hits_against_a_plain_count(spark, monkeypatch):
    rng = random.Random(8)
    words = ["alpha", "alphabet", "beta", "gamma", "gammaray", "straße", "delta", "epsilon", "q", "zu"]
    texts = [(i * 5 % 301, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(301)] + [(900, None)]
    terms = sorted({(q, t) for q in (0, 7, 100, 900, 5000) for t in rng.sample(["alpha", "bet", "gamma", "aße", "lta", "epsilon", "q", "z", "none"], 5)})
    want = []
    for q in sorted({q for q, _ in terms}):
        hits = [(-sum(t in text for p, t in terms if p == q), c) for c, text in texts if text and c != q]
        want += [(q, c, -n, rank) for rank, (n, c) in enumerate(sorted(h for h in hits if h[0])[:5], 1)]
    monkeypatch.setattr(contains, "QUERY_BLOCK", 2)
    got = contains.keyword_hits(spark.createDataFrame(terms, "query_id long, term string"), spark.createDataFrame(texts, "chunk_id long, text string"))
    assert sorted((r.query_id, r.chunk_id, r.hits, r["rank"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("query_id" in line and "term" in line for line in plan.splitlines() if "Join" in line)  # no row for every pair


def test_blocks_of_texts_end_with_a_text(monkeypatch):
    rng = np.random.default_rng(2)
    known = pa.array(["a", "b", "c", "d"])
    ids, terms = np.sort(rng.integers(0, 60, 500)), rng.choice(["a", "b", "c", "d", "e"], 500)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[k : k + 7]), pa.array(terms[k : k + 7], pa.string())], names=["chunk_id", "term"]) for k in range(0, 500, 7)]
    queries = [(int(q), np.array(t)) for q, t in ((3, [0, 1, 2]), (4, [3]), (99, [0, 3]))]
    want = []
    for q, t in queries:
        hits = {c: len({x for i, x in zip(ids, terms) if i == c} & {known[k].as_py() for k in t}) for c in set(ids.tolist()) - {q}}
        want.append(sorted((-n, c) for c, n in hits.items() if n)[:5])
    for texts, held in ((1, 10**6), (7, 10**6), (10**6, 20), (10**6, 10**6)):
        monkeypatch.setattr(contains, "TEXTS", texts)
        monkeypatch.setattr(contains, "HELD", held)
        blocks = list(contains._blocks(iter(batches), known))
        assert all(a[-1] < b[0] for (a, _), (b, _) in zip(blocks, blocks[1:]))
        assert contains._best(queries, 4, iter(blocks), 5) == want


def test_phrases(spark):
    rng = random.Random(6)
    some = ["a", "ab", "b", "", "ba.", "é"]
    texts = [(i, " ".join(rng.choices(some, k=rng.randint(0, 30)))) for i in range(150)] + [(150, None), (151, "")]
    patterns = [" ".join(rng.choices(some, k=n)) for n in (1, 2, 3, 3, 3, 4, 4, 5, 6, 8) for _ in range(4)] + ["", None, "a", " ", "  "]
    for asked in (patterns, [p for p in patterns if p and p.count(" ") > 1]):
        got = contains.phrases(spark.createDataFrame([(p,) for p in asked], "pattern string"), spark.createDataFrame(texts, "id long, text string"))
        assert sorted(map(tuple, got.collect())) == sorted((p, i) for p in {p for p in asked if p} for i, t in texts if t and p in t)
    assert "arrays_zip" not in got._jdf.queryExecution().optimizedPlan().toString()  # no grams where words do


def test_quotes_are_compared_once_a_pair(spark):
    docs = spark.createDataFrame([(1, "One two  three four-teen five six seven."), (2, "one two three"), (3, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "wo two three fourteen fi"), (2, "ne two  three four-teen five six"), (3, "two three four"), (4, "six two one of them all"), (5, None)], "item_id long, text string")
    got = verify.quotes_in(quotes, docs)
    assert sorted(map(tuple, got.collect())) == [(2, 1, "exakt"), (3, 1, "normalisiert")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp_replace" in line for line in plan.splitlines() if "Join" in line)


def test_keyword_hits_of_any_texts(spark, monkeypatch):
    """Ids in any order, some given to several texts, long terms, few texts at a time; no word or term of a text is a row."""
    for name, value in (("TEXTS", 40), ("WORDS", 300), ("LOOKED", 7), ("REMEMBERED", 20), ("HELD", 100)):
        monkeypatch.setattr(contains, name, value)
    rng = random.Random(9)
    words = ["alpha", "Alphabetsuppe", "beta", "a×b", "gamma", "Straßenverkehrsordnung", "verkehrsordnungen", "delta", "ÿ", "aaaa"] + ["".join(rng.choices("abg", k=3)) for _ in range(40)]
    texts = [(i * 7 % 300, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(320)] + [(None, "alpha"), (400, None)]
    asked = ["alpha", "alphabetsupp", "bet", "×", "a×b", "gam", "verkehrsordnung", "straßenverkehrsordnung", "ÿ", "aa", "ab", "g", "none", "a b", "é"]
    terms = sorted({(q, t) for q in (0, 7, 14, 299, 5000, 5001, 5002) for t in rng.sample(asked, 9)}) + [(6000, "a b"), (None, "a"), (6001, "")]
    whole = {}
    for c, text in texts:
        if c is not None and text is not None:
            whole[c] = f"{whole.get(c, '')} {text.lower()}"
    want = []
    for q in sorted({q for q, _ in terms if q is not None}):
        hits = [(-sum(t in text for p, t in terms if p == q and t and t != "a b"), c) for c, text in whole.items() if c != q]
        want += [(q, c, -n, rank) for rank, (n, c) in enumerate(sorted(h for h in hits if h[0])[:5], 1)]
    got = contains.keyword_hits(spark.createDataFrame(terms, "query_id long, term string"), spark.createDataFrame(texts, "chunk_id long, text string"))
    assert sorted((r.query_id, r.chunk_id, r.hits, r["rank"]) for r in got.collect()) == sorted(want)
    unique = contains.keyword_hits(spark.createDataFrame(terms, "query_id long, term string"), spark.createDataFrame(sorted(whole.items()), "chunk_id long, text string"))
    assert sorted(map(tuple, unique.select("query_id", "chunk_id", "hits", "rank").collect())) == sorted(want)
    plan = unique._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Join" not in plan


def test_best_counts_blocks_in_any_order(monkeypatch):
    rng = np.random.default_rng(5)
    for held in (3, 10**6):
        monkeypatch.setattr(contains, "HELD", held)
        for share in (2, 40):  # frequent and rare terms
            texts = rng.permutation(400)
            blocks, has = [], {}
            for at in range(0, 400, 90):
                chosen = np.sort(texts[at : at + 90])
                rows = [(c, t) for c in chosen for t in range(30) if rng.integers(share if t % 3 else 2) == 0 for _ in range(2)]
                for c, t in rows:
                    has.setdefault(int(c), set()).add(t)
                blocks.append((np.array([c for c, _ in rows]), np.array([t for _, t in rows])))
            queries = [(int(q), np.sort(rng.choice(30, rng.integers(1, 9), replace=False))) for q in rng.integers(0, 500, 40)]
            want = [sorted((-n, c) for c, t in has.items() if c != q and (n := len(t & set(asked.tolist()))))[:5] for q, asked in queries]
            assert contains._best(queries, 30, iter(blocks), 5) == want


@pytest.mark.parametrize("name", ["keyword_search", "hybrid_rrf", "fallback_merge"])
def test_keyword_legs_have_no_row_for_a_word(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "MapInArrow" in plan
