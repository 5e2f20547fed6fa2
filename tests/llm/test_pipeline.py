"""The pipeline stage by stage against plain versions, and the queries against their SQL."""

from __future__ import annotations

import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle

import corpus_pipeline
from lodestone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    assert oracle.same_rows(queries.QUERIES[name](spark, str(oracle.DATA)), oracle.connect(), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_gives_a_row_for_each_input(spark, name):
    out = queries.QUERIES[name](spark, str(oracle.DATA))
    key, table = {"op5_html_extraction": ("page_id", "pages"), "op4_nearest_vectors": ("query_id", "embeddings")}.get(name, ("doc_id", "documents"))
    rows = spark.read.parquet(str(oracle.DATA / f"{table}.parquet"))
    expected = {r[0] for r in rows.select(rows.columns[0]).collect() if table != "embeddings" or r[0] % 20 == 0}
    assert {r[0] for r in out.select(key).collect()} == expected


def test_pipeline_on_an_empty_table_and_with_more_columns(spark, tmp_path):
    docs = spark.read.parquet(str(oracle.DATA / "documents.parquet"))
    for folder, rows in (("empty", docs.limit(0)), ("wide", docs.selectExpr("*", "'x' AS content", "doc_id AS _row", "1 AS `row`", "array('a', NULL) AS sketch", "map('k', 1) AS leads"))):
        rows.write.parquet(str(tmp_path / folder / "documents.parquet"))
        spark.read.parquet(str(oracle.DATA / "labels.parquet")).write.parquet(str(tmp_path / folder / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    plain = sorted(map(tuple, corpus_pipeline.run(spark, str(oracle.DATA)).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path / "wide")).collect())) == plain


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages(spark):
    sf_dir = str(oracle.DATA)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        out[name] = docs.collect()
    ids = {name: {r["doc_id"] for r in rows} for name, rows in out.items()}
    assert all(before[r["doc_id"]] == r for rows in out.values() for r in rows)

    scored = {r["doc_id"]: r["score"] for r in queries.op8_toxicity(spark, sf_dir).collect()}
    assert ids["toxicity"] == {d for d, s in scored.items() if s < 0.5}

    groups = {}
    for d in ids["toxicity"]:
        groups.setdefault(bare(before[d]["text"]), []).append(d)
    assert ids["exact dedup"] == {min(g, key=lambda d: (-len(before[d]["text"] or ""), d)) for g in groups.values()}

    sets = {d: grams(before[d]["text"]) for d in ids["exact dedup"]}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert ids["n-gram jaccard join"] == {find(d) for d in sets}

    size = Counter()
    for d in ids["n-gram jaccard join"]:
        size[before[d]["source"]] += len((before[d]["text"] or "").split())
    took = Counter()
    for r in out["mixing"]:
        took[r["source"]] += len((r["text"] or "").split())
    assert all(took[s] <= 2 * size[s] for s in size) and abs(sum(took.values()) - 1.5 * sum(size.values())) < 0.05 * sum(size.values())
    assert max(Counter(r["doc_id"] for r in out["mixing"]).values()) <= 2

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in out["mixing"])
    used = Counter()
    for r in packed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048
    assert sorted(map(tuple, packed)) == sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
