"""DuckDB SQL for those queries whose rows plain SQL can give, over whole tables and by plainer ways.

jaccard() finds candidates by a prefix of each set's rarest shingles, which leaves out no link; all else counts
every candidate.
"""

from .licenses import BASE, TEMPLATES, THRESHOLD

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{_ALPHABET}', '{_ALPHABET.lower()}')"
_TOKENS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _phrase(phrase: str) -> str:
    """The places of a phrase's words, words counted from 0."""
    equal = " AND ".join(f"w[i + {k}] = {_text(word)}" for k, word in enumerate(phrase.split(), 1))
    return f"list_filter(range(len(w)), lambda i: {equal})"


def licenses() -> str:
    templates = ", ".join(f"({k}, {_text(label)}, {_text(text)})" for k, (label, text) in enumerate(TEMPLATES))
    places = ", ".join(f"{_phrase(phrase)} AS p{k}" for k, (phrase, _) in enumerate(BASE))
    every = "list_concat(" * (len(BASE) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(BASE)))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN {_text(label)} END" for k, (_, label) in enumerate(BASE))
    return f"""
WITH words AS (SELECT row_number() OVER () AS row_id, doc_id, {_TOKENS.format(_LOWER)} AS w FROM documents),
template (id, label, text) AS (VALUES {templates}),
cut AS (SELECT id, label, {_TOKENS.format(_LOWER)} AS w FROM template),
token AS (SELECT id, label, len(w) AS n, len(list_distinct(w)) AS size, unnest(list_distinct(w)) AS word FROM cut),
place AS (SELECT row_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM words),
met AS (SELECT row_id, id, label, n, size, word, i FROM place JOIN token USING (word)),
block AS (
    SELECT a.row_id, a.id, a.label, count(DISTINCT b.word) / any_value(a.size) AS containment
    FROM met a JOIN met b ON b.row_id = a.row_id AND b.id = a.id AND b.i >= a.i AND b.i < a.i + 2 * a.n
    GROUP BY a.row_id, a.id, a.label, a.i HAVING count(DISTINCT b.word) / any_value(a.size) >= {THRESHOLD}::DOUBLE - 1e-9),
matched AS (SELECT row_id, list(label) AS labels, max(containment) AS score FROM block GROUP BY row_id),
base AS (SELECT row_id, doc_id, w, {places} FROM words),
named AS (SELECT *, {every} AS every_place, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM base)
SELECT doc_id, len(w)::BIGINT AS n_words, len(every_place)::BIGINT AS n_base,
    list_min(every_place)::BIGINT AS first_word, list_max(every_place)::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ','), '') AS labels,
    coalesce(score, 0.0)::DOUBLE AS score
FROM named LEFT JOIN matched USING (row_id)"""


def jaccard(words: int = 3, hundredths: int = 90) -> str:
    """Classes and components; sets linked at so many hundredths keep one in common of the rarest shingles looked at."""
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {run})) END AS s
    FROM words),
class AS (SELECT min(doc_id) AS id, list_sort(s) AS s FROM sets GROUP BY list_sort(s)),
shingle AS (SELECT id, len(s) AS n, unnest(s) AS g FROM class),
seen AS (SELECT g, count(*) AS f FROM shingle GROUP BY g),
ranked AS (SELECT id, n, g, row_number() OVER (PARTITION BY id ORDER BY f, g) AS place FROM shingle JOIN seen USING (g)),
rarest AS (SELECT id, n, g FROM ranked WHERE place <= n * {100 - hundredths} // 100 + 1),
pair AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM rarest a JOIN rarest b USING (g) WHERE a.id < b.id AND 100 * least(na, nb) >= {hundredths} * greatest(na, nb)),
link AS (
    SELECT a, b FROM pair JOIN shingle x ON x.id = a JOIN shingle y ON y.id = b AND y.g = x.g
    GROUP BY a, b, na, nb HAVING 100 * count(*) >= {hundredths} * (na + nb - count(*))),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reached (id, least_id) AS (SELECT id, id FROM class UNION SELECT edge.b, least_id FROM reached JOIN edge ON edge.a = id WHERE least_id < edge.b),
component AS (SELECT id, min(least_id) AS component_id FROM reached GROUP BY id)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles,
    CASE WHEN len(sets.s) = 0 THEN doc_id ELSE id END AS class_id, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id
FROM sets JOIN class ON class.s = list_sort(sets.s) JOIN component USING (id)"""


#: Checksum of the bytes of a decimal number: a table of 256 steps, then one step a byte.
_CRC_TABLE = "SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))"
_CRC = "xor(list_reduce(list_transform(string_split({}::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)"


def _tree(name: str, leaves: str) -> str:
    """Every node of the trees over leaves (g, i, h, n): level, n nodes of its level."""
    return f"""{name} (level, g, i, h, n) AS (SELECT 0, g, i, h, n FROM {leaves} UNION ALL
    SELECT level + 1, g, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM {name} WHERE n > 1 GROUP BY level, g, i // 2),
{name}_path AS (SELECT leaf.g, leaf.i, list({{'b': CASE WHEN above.i & 1 = 1 THEN other.h ELSE '' END, 'a': CASE WHEN above.i & 1 = 0 THEN coalesce(other.h, '') ELSE '' END}} ORDER BY above.level) AS p
    FROM {leaves} leaf JOIN {name} above ON above.g = leaf.g AND above.i = leaf.i >> above.level AND above.n > 1
    LEFT JOIN {name} other ON other.g = above.g AND other.level = above.level AND other.i = xor(above.i, 1) GROUP BY leaf.g, leaf.i)"""


def merkle() -> str:
    framed = lambda v: f"coalesce(strlen(({v})::VARCHAR)::VARCHAR || ':' || ({v})::VARCHAR, '-')"
    leaf = lambda n: "sha256(" + " || ".join(map(framed, ("doc_id", "source", "lang", n, "text"))) + ")"
    return f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("n_chars")} AS h,
    CASE WHEN {_CRC.format("doc_id")} % 7 = 0 AND n_chars IS NOT NULL THEN {leaf("n_chars + 1")} END AS tampered FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed),
{_tree("low", "leaves")},
heads AS (SELECT 0 AS g, g AS of, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
{_tree("high", "heads")},
whole AS (SELECT leaves.*, heads.h AS subroot, list_concat(coalesce(l.p, []), coalesce(u.p, [])) AS p
    FROM leaves JOIN heads ON heads.of = leaves.g LEFT JOIN low_path l ON l.g = leaves.g AND l.i = leaves.i LEFT JOIN high_path u ON u.i = heads.i),
fold (g, i, k, node) AS (SELECT g, i, 1, coalesce(tampered, h) FROM leaves UNION ALL
    SELECT fold.g, fold.i, k + 1, sha256(p[k].b || node || p[k].a) FROM fold JOIN whole ON whole.g = fold.g AND whole.i = fold.i WHERE k <= len(p))
SELECT doc_id, whole.h AS leaf, subroot, high.h AS root, sha256(array_to_string(list_transform(p, lambda s: s.b || s.a), '')) AS proof_sha256,
    node AS folded_root, node = high.h AS verified
FROM whole JOIN fold ON fold.g = whole.g AND fold.i = whole.i AND fold.k = len(p) + 1, high WHERE high.n = 1"""


def warc() -> str:
    digest = "array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31), 1)), '')"
    return f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
ranked AS (SELECT *, max(page_id) OVER same AS response, row_number() OVER (PARTITION BY hex, payload_bytes ORDER BY page_id DESC NULLS LAST) AS place
    FROM hashed WINDOW same AS (PARTITION BY hex, payload_bytes))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {digest} AS payload_digest,
    CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN response END AS refers_to FROM ranked"""
