"""Small tables on which a partial job shows."""

from __future__ import annotations

from pathlib import Path

import oracle
import pytest

from lodestone.functions.markup import elements
from lodestone.plans import catalogue


def run(spark, folder, name, query, columns, rows):
    spark.createDataFrame(rows, columns).write.mode("overwrite").parquet(str(folder / f"{name}.parquet"))
    return catalogue.QUERIES[query](spark, str(folder))


PAGE = '<h1 id="a">T &amp; U</h1><p><b>Lead</b> text<br>goes on<p class="x">one <i>two</i> three</p><H2>Sub</H2><div>no</div><p>last<script>var t="</p>"</script> end<ul><li>no</li></ul></p>'


def test_elements():
    assert elements(PAGE) == [("h1", "T & U"), ("p", "Lead text goes on"), ("p", "one two three"), ("h2", "Sub"), ("p", "last end")]
    assert elements("<p>a") == [("p", "a")] and elements("<h1><div>x</div></h1>y") == [("h1", " x ")] and not elements("") and not elements(None)


def test_section_parents(spark, tmp_path):
    df = run(spark, tmp_path, "pages", "section_parents", "page_id long, html string", [(1, PAGE), (2, "none"), (3, None)])
    assert df.toPandas()["text"].tolist() == ["Lead text goes on\n\none two three\n\n## Sub\n\nlast end"]
    assert oracle.same_rows(df, oracle.connect({"pages": spark.createDataFrame([(1, PAGE)], "page_id long, html string").toPandas()}), catalogue.ORACLE_SQL["section_parents"]) == 1


def test_vector_topk_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestone.operators.vector.QUERY_CELLS", 4)  # two queries a broadcast
    monkeypatch.setattr("lodestone.operators.vector.SCORE_CELLS", 1)
    rows = [(n, 0, [float(n % 7 + 1), float(n % 11)]) for n in range(260)]
    columns = "vec_id long, label int, embedding array<float>"
    frame = spark.createDataFrame(rows, columns).toPandas()
    for name in ("vector_topk_batch", "vector_topk_dot", "vector_topk_l2"):
        df = run(spark, tmp_path, "embeddings", name, columns, rows)
        assert {r["query_id"] for r in df.collect()} == {0, 50, 100, 150, 200, 250}
        assert oracle.same_rows(df, oracle.connect({"embeddings": frame}), catalogue.ORACLE_SQL[name]) == 30


def test_email_conflict(spark, tmp_path):
    rows = [(1, "a", "x"), (2, "b", "x"), (150, "c", "x"), (151, "c", "x"), (400, None, "x")]
    df = run(spark, tmp_path, "customer", "email_conflict", "c_custkey long, c_name string, c_mktsegment string", rows)
    assert sorted(r["id"] for r in df.collect()) == [1, 2, 150, 151]


def test_pages_all(spark, tmp_path):
    columns = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string, o_totalprice double"
    rows = [(n, n, "F" if n % 2 else "O", "d", 1.0) for n in range(1, 201)]
    assert run(spark, tmp_path, "orders", "pagination_meta", columns, rows).first()["total"] == 100
    assert [r["id"] for r in run(spark, tmp_path, "orders", "list_documents_page", columns, rows).collect()] == list(range(82, 122, 2))
