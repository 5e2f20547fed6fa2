"""Adapters, stored versions and the ingest stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import adapters, store
from lodestone.streaming import ingest


class Failing:
    def __init__(self, *errors):
        self.errors, self.calls = list(errors), 0

    def __call__(self):
        self.calls += 1
        if self.errors:
            raise self.errors.pop(0)
        return "ok"


def test_retry():
    slept = []
    bad = Failing(adapters.ServiceError(400))
    with pytest.raises(adapters.ServiceError):
        adapters.with_retry(bad, sleep=slept.append)
    assert bad.calls == 1
    busy = Failing(*[adapters.ServiceError(429)] * 6)
    with pytest.raises(adapters.ServiceError):
        adapters.with_retry(busy, sleep=slept.append)
    assert busy.calls == 6
    slept.clear()
    assert adapters.with_retry(Failing(adapters.ServiceError(429, {"retry-after": "2"}), adapters.ServiceError(503)), sleep=slept.append, jitter=lambda: 499) == "ok"
    assert slept == [2.0, 2.499]
    assert 4000 <= adapters.retry_delay_ms(adapters.ServiceError(500), 2) <= 4499


def test_embedding_checks():
    small = adapters.Settings(dimensions=4)
    with pytest.raises(ValueError, match="count"):
        adapters.embed_texts(["a", "b"], lambda t: [[0.0] * 4], small)
    with pytest.raises(ValueError, match="dimension"):
        adapters.embed_texts(["a"], lambda t: [[0.0] * 3], small)
    with pytest.raises(ValueError, match="required"):
        adapters.embed_query(" ", adapters.HashEmbedder(4), small)
    assert adapters.embed_texts([], adapters.HashEmbedder(4), small) == []


TREE = {
    "text": "x",
    "pages": [{"pageNumber": 1, "textItems": [{"mcid": 1, "text": "Alpha"}, {"mcid": 2, "text": "body"}]}],
    "structure_tree": [{"type": "Document", "children": [{"type": "h1", "marked_content_ids": [1], "children": [{"type": "Span", "actualText": "skipped"}]}, {"type": "P", "markedContentIds": [2]}]}],
}


def test_files_to_parents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(TREE))
    parsed = adapters.parse_files(adapters.read_files(spark, str(tmp_path)), adapters.json_parser)
    small = adapters.Settings(dimensions=8, batch_delay_ms=0)
    parents, children = ingest.ingest(parsed, lambda: adapters.HashEmbedder(8), small)
    assert [(r["text"], r["start_page"]) for r in parents.collect()] == [("body", 1)]
    assert [len(r["embedding"]) for r in children.collect()] == [8]


def test_versions_and_deletes(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    docs = spark.createDataFrame([("1", "u", "a", "completed"), ("2", "u", "b", None)], "id string, user_id string, name string, status string")
    assert table.publish(docs) == 1
    assert table.publish(store.rename_document(table.read(), "1", "u", " new "), cluster_by="id") == 2
    assert [r["name"] for r in table.read().orderBy("id").collect()] == ["new", "b"] and table.read(1).where("name = 'a'").count() == 1
    assert store.rename_document(docs, "1", "other", "x").where("name = 'x'").count() == 0
    with pytest.raises(ValueError):
        store.rename_document(docs, "1", "u", " ")
    parts = spark.createDataFrame([("1", "p1"), ("2", "p2"), (None, "p3")], "document_id string, id string")
    marked, parents, children = store.delete_document(docs, parts, parts, docs.where("id = '1'").select("id"))
    assert [r["status"] for r in marked.orderBy("id").collect()] == ["deleted", None] and parents.count() == children.count() == 2
    assert store.patch(docs, spark.createDataFrame([("2", "z")], "id string, name string")).where("name = 'z'").count() == 1


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps(adapters.flatten_parsed("a", TREE)))
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out/parents/*")).collect()] == ["body"]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [(r["events"], r["total"]) for r in ingest.windowed_counts(events).collect()] == [(2, 3.0)]


def test_settings(spark):
    spark.conf.set("spark.lodestone.top_k", "7")
    spark.conf.set("spark.lodestone.candidates", "many")
    found = adapters.Settings.from_conf(spark)
    assert (found.top_k, found.candidates, found.dimensions) == (7, 50, 768)
    spark.conf.unset("spark.lodestone.top_k")


def test_spread_keeps_rows(spark, tmp_path):
    from lodestone.sources.layout import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spread(spark.read.parquet(str(tmp_path / "t")))
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows.count() == 100
    assert spread(spark.range(5)).count() == 5
