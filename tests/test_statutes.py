"""Statute pages: the usual form, broken ones, and random tags against a plain reading."""

import datetime
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.sources import statutes

LAW = """<html><head><title>SGB II</title></head><body>
<div class="jnnorm" title="Einzelnorm"><div class="jnheader"><h3><span class="jnenbez">§ 31</span> <span class="jnentitel">Pflichten</span></h3></div>
<div class="jnhtml"><div class="jurAbsatz">(1) Der Anspruch besteht.</div><div class="jurAbsatz">(2) Er wird gewahrt. Er ruht nicht.</div></div></div>
<div class="jnnorm"><span class="jnenbez">§ 32</span><div class="jurAbsatz">(1a) Bei Pflichtverletzung.</div></div></body></html>"""


def test_pages_of_the_usual_form():
    rows = list(statutes.parsed(LAW))
    assert [(r[1], r[5], r[6]) for r in rows] == [
        ("absatz", "SGB II > § 31 > Abs. 1", "(1) Der Anspruch besteht."),
        ("satz", "SGB II > § 31 > Abs. 1 > Satz 1", "Der Anspruch besteht."),
        ("absatz", "SGB II > § 31 > Abs. 2", "(2) Er wird gewahrt. Er ruht nicht."),
        ("satz", "SGB II > § 31 > Abs. 2 > Satz 1", "Er wird gewahrt."),
        ("satz", "SGB II > § 31 > Abs. 2 > Satz 2", "Er ruht nicht."),
        ("absatz", "SGB II > § 32 > Abs. 1a", "(1a) Bei Pflichtverletzung."),
        ("satz", "SGB II > § 32 > Abs. 1a > Satz 1", "Bei Pflichtverletzung."),
    ]
    assert [r[0] for r in rows] == list(range(1, 8)) and rows[0][7] is None
    assert not list(statutes.parsed("<html><body><p>Just an index page</p></body></html>"))


def test_dates_and_laws():
    page = '<meta name="date" content="{}"><meta name="fundstelle" content="BGBl 2023/4/5"><h1>Law <i>X</i></h1>' + LAW
    assert next(statutes.parsed(page.format("2024-02-30")))[5:8:2] == ("Law X > § 31 > Abs. 1", datetime.date(2023, 4, 5))
    assert next(statutes.parsed(page.format("2024-02-29T1"), "BGB"))[5:8:2] == ("BGB > § 31 > Abs. 1", datetime.date(2024, 2, 29))


def test_rows_of_a_table(spark):
    rows = [(1, LAW, None), (2, None, "x"), (None, LAW, "BGB"), (1, "", None), (3, LAW[:330], None)]
    got = statutes.statute_rows(spark.createDataFrame(rows, "page_id long, html string, law string")).collect()
    want = [(i, *r) for i, html, law in rows for r in statutes.parsed(html, law)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and {r.page_id for r in got} == {1, None, 3}


def plain(parts):
    """What subsections hold, by counting open elements of each kind over a list of tags and texts."""
    stack, out = [], []  # (tag, kind, texts, table)
    norm = None

    def close(tag):
        if tag is not None and all(e[0] != tag for e in stack):
            return
        while stack:
            element = stack.pop()
            inside = any(e[1] == "norm" for e in stack)
            if element[1] == "sub" and inside and not element[3][0] and element[2]:
                holder = [e for e in stack if e[1] == "norm"][-1]
                holder[2].append(" ".join(element[2]))
            if tag is not None and element[0] == tag:
                return

    for part in parts:
        if part in ("N", "S", "P", "T"):
            kind = {"N": "norm", "S": "sub"}.get(part)
            tag = {"N": "div", "S": "div", "P": "p", "T": "table"}[part]
            if part == "T":
                for e in stack:
                    e[3][0] = True
            stack.append((tag, kind, [], [False]))
            if part == "N":
                out.append(stack[-1])
                for e in stack:  # its label is text of what it stands in
                    if e[1] == "sub":
                        e[2].append("§ 5")
        elif part.startswith("/"):
            close(part[1:])
        else:
            for e in stack:
                if e[1] == "sub":
                    e[2].append(part)
    close(None)
    return [t for e in out for t in e[2]]


PRINTED = {"N": '<div class="a jnnorm"><span class="jnenbez">§ 5</span>', "S": '<div class="jurAbsatz">', "P": "<p>", "T": "<table>"}


@given(st.lists(st.sampled_from(["N", "S", "S", "P", "T", "/div", "/div", "/p", "/table", "/b", "eins", "zwei"]), max_size=30))
@settings(max_examples=400, deadline=None)
def test_broken_nesting(parts):
    html = "".join(PRINTED.get(p) or (f"<{p}>" if p.startswith("/") else f" {p} <!-- c -->") for p in parts)
    assert [r[6] for r in statutes.parsed(html) if r[1] == "absatz"] == plain(parts)


def test_no_page_raises():
    rng = random.Random(1)
    for _ in range(500):
        cut = "".join(rng.choice([LAW[i : i + 40] for i in range(0, len(LAW), 40)] + ["<", ">", "</", '"', "&#x0;", "<!", "]]>", "\0"]) for _ in range(rng.randint(0, 12)))
        list(statutes.parsed(cut))
