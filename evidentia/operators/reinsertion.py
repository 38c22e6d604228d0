"""Putting masked values back where placeholders came back damaged, and how much of a text survived that."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from evidentia.functions import batches, pii

# a placeholder as it was written, with an age that was added to it; or with a bracket lost, blanks inside or in lower case
_TOLERANT = re.compile(f"(?:({pii.PLACEHOLDER})|(?<![\\[{pii._JOINER}])\\[\\[? *([A-Za-z_]+_[0-9]+) *\\]\\]?)(?:{pii._ADDED})?")
_ESCAPED = re.compile(f"{pii._JOINER}({pii._JOINER})|(?<=\\[){pii._JOINER}(?=\\[)")


def restored_text(text: str, mapping: dict[str, str]) -> tuple[str, list[str]]:
    """The text with the mapping's values, and the placeholders in double brackets that no value is known of.

    One pass, so values that look like placeholders stay. An ending that was put behind a placeholder stays behind the
    value. A bracketed word of the original that equals a known placeholder with a bracket missing is taken for it.
    """
    unknown, pieces, at = [], [], 0
    for m in _TOLERANT.finditer(text):
        name = m[1] or f"[[{m[2].upper()}]]"
        if name not in mapping and m[1]:
            unknown.append(name)
        pieces += [_ESCAPED.sub(lambda e: e[1] or "", text[at : m.start()]), mapping.get(name, m[0])]
        at = m.end()
    pieces.append(_ESCAPED.sub(lambda e: e[1] or "", text[at:]))
    return "".join(pieces), unknown


def _longest(a: Sequence[int], a0: int, a1: int, b: Sequence[int], b0: int, b1: int) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest run that both ranges hold; of equal ones the first in a, then in b.

    A suffix automaton of the range of b is walked with the range of a, so both are passed once.
    """
    steps: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for j in range(b0, b1):
        new = len(steps)
        steps.append({})
        link.append(0)
        size.append(size[last] + 1)
        first.append(j)
        p = last
        while p >= 0 and b[j] not in steps[p]:
            steps[p][b[j]] = new
            p = link[p]
        if p >= 0:
            q = steps[p][b[j]]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                while p >= 0 and steps[p].get(b[j]) == q:
                    steps[p][b[j]] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    state, length, best = 0, 0, (a0, b0, 0)
    for i in range(a0, a1):
        while state and a[i] not in steps[state]:
            state = link[state]
            length = size[state]
        if a[i] in steps[state]:
            state, length = steps[state][a[i]], length + 1
        if length > best[2]:
            # the strings of a state end at the same places; a shorter one than the state's longest ends there first as well
            best = (i + 1 - length, first[state] + 1 - length, length)
    return best


def match_ratio(a: Sequence[str], b: Sequence[str]) -> float:
    """Twice the tokens in matching blocks over all tokens: the longest block first, then left and right of it likewise.

    Nothing against nothing is 1, nothing against something 0.
    """
    if not a or not b or a == b:
        return 1.0 if a == b else 0.0
    ids: dict[str, int] = {}
    x, y = ([ids.setdefault(t, len(ids)) for t in side] for side in (a, b))
    todo, met = [(0, len(x), 0, len(y))], 0
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 < a1 and b0 < b1:
            i, j, n = _longest(x, a0, a1, y, b0, b1)
            if n:
                met += n
                todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return 2 * met / (len(a) + len(b))


def reinserted(rows: DataFrame) -> DataFrame:
    """restored, unknown and integrity in place of text, mapping and original: the text with its values put back, its
    placeholders without any, and the share of the original's tokens that match, blanks left out. Other columns stay.
    Null texts and mappings count as empty."""
    new = StructType.fromDDL("restored string, unknown array<string>, integrity double")
    kept = [f for f in rows.schema.fields if f.name not in ("text", "mapping", "original", *new.names)]

    def each(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for part in batches.slices(batch, ("text", "original")):
                out = []
                for text, mapping, original in zip(*(part.column(c).to_pylist() for c in ("text", "mapping", "original")), strict=True):
                    restored, unknown = restored_text(text or "", dict(mapping or ()))
                    out.append((restored, unknown, match_ratio((original or "").split(), restored.split())))
                columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.list_(pa.string()), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), *new.names])

    return rows.select(*(f.name for f in kept), "text", "mapping", "original").mapInArrow(each, StructType([*kept, *new.fields]))
