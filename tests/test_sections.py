"""Golden cases of section building."""

from __future__ import annotations

import pytest

from lodestone.operators import sections
from lodestone.operators.sections import PARSED


def parsed(spark, nodes, pages):
    made = [(n, (rest[0] if rest else 0), t, a, ids) for n, (t, a, ids, *rest) in enumerate(nodes)]
    return spark.createDataFrame([("d", "x", pages, made)], PARSED)


def page(number, *items, text=""):
    return (number, text, [tuple(i) for i in items])


def rows(df):
    return [(r["index"], r["text"], r["start_page"], r["end_page"]) for r in df.orderBy("index").collect()]


P, H1, H2, H3 = "P", "H1", "H2", "H3"
PAGES = [page(1, (1, "Intro text"), (2, "Alpha"), (3, "Alpha body")), page(2, (4, "Sub"), (5, "Sub body  with  spaces"), (6, "Beta")), page(3, (7, "Beta body"))]


def test_sectioning(spark):
    nodes = [(P, None, [1]), (H1, None, [2]), (P, None, [3]), (H2, None, [4]), (P, None, [5]), (H1, None, [6]), (P, None, [7])]
    assert rows(sections.logical_parents(parsed(spark, nodes, PAGES))) == [(0, "Alpha body\n\n## Sub\n\nSub body with spaces", 1, 2), (1, "Beta body", 2, 3)]


def test_fallback(spark):
    df = parsed(spark, [(P, None, [1])], [page(None, text="one"), page(None, text="  "), page(None, text="three")])
    assert rows(sections.logical_parents(df)) == [(0, "one", 1, 1), (2, "three", 3, 3)]


def test_first_heading_is_deeper(spark):
    nodes = [(H3, "X", []), (P, "x", []), (H2, "Y", []), (P, "y", []), (H1, "Z", []), (P, "z", [])]
    assert [r[:2] for r in rows(sections.logical_parents(parsed(spark, nodes, PAGES)))] == [(0, "x\n\n## Y\n\ny"), (1, "z")]


def test_reused_id(spark):
    df = parsed(spark, [(H1, "T", []), (P, None, [0])], [page(1, (0, "a")), page(2, (0, "b"))])
    assert rows(sections.logical_parents(df)) == [(0, "a b", 1, 1)]
    assert {(r["page"], r["text"]) for r in sections.marked_content(df, by_page=True).collect()} == {(1, "a"), (2, "b")}


def test_empty_section_and_empty_actual_text(spark):
    assert rows(sections.logical_parents(parsed(spark, [(H1, "A", []), (H1, "B", []), (P, "b", [])], PAGES))) == [(0, "b", 1, 1)]
    nodes = [(H1, "A", []), (P, "a", []), (H2, "", [4])]
    assert rows(sections.logical_parents(parsed(spark, nodes, PAGES)))[0][1] == "a\n\n##"


@pytest.mark.parametrize(("depth", "second"), [(1, (4, 4)), (0, (1, 1))])
def test_page_fallback(spark, depth, second):
    pages = [page(4, (9, "a"))]
    nodes = [("Div", None, [], 0), (H1, "A", [], depth), (P, None, [9], depth), (H1, "B", [], depth), (P, "b", [], depth)]
    assert [r[2:] for r in rows(sections.logical_parents(parsed(spark, nodes, pages)))] == [(1, 4), second]
