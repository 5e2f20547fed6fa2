"""Upload, reprocess and a chat turn."""

from __future__ import annotations

import pytest

from lodestone.operators.retrieve import NO_DOCUMENTS
from lodestone.operators.sections import PARSED
from lodestone.plans import service
from lodestone.sources.adapters import HashEmbedder, Settings

SMALL = Settings(dimensions=8, batch_delay_ms=0, top_k=2)


def parsed(spark, *docs):
    return spark.createDataFrame([(d, " ".join(t), [(n + 1, x, []) for n, x in enumerate(t)], []) for d, t in docs], PARSED)


def test_upload_and_reprocess(spark):
    documents = spark.createDataFrame([("a", "processing"), ("b", "processing"), ("c", "uploaded")], "id string, status string")
    corpus = service.upload(documents, parsed(spark, ("a", ["one", "two", "three"]), ("b", [" "])), lambda: HashEmbedder(8), SMALL)
    assert dict(corpus.documents.collect()) == {"a": "completed", "b": "failed", "c": "uploaded"}
    assert corpus.parents.count() == corpus.children.count() == 3
    other = service.upload(documents, parsed(spark, ("c", ["else"])), lambda: HashEmbedder(8), SMALL)
    corpus = service.Corpus(corpus.documents, corpus.parents.unionByName(other.parents), corpus.children.unionByName(other.children))
    after, counters = service.reprocess(corpus, parsed(spark, ("a", ["two", "one", "new"])), lambda: HashEmbedder(8), SMALL, refresh_pages=True)
    assert tuple(counters.first()) == ("a", 3, 2, 1, 1, 1)
    assert sorted((r["document_id"], r["index"], r["text"]) for r in after.parents.collect()) == [("a", 0, "two"), ("a", 1, "one"), ("a", 2, "new"), ("c", 0, "else")]
    assert sorted((r["text"], r["page_number"]) for r in after.children.collect()) == [("else", 1), ("new", 3), ("one", 2), ("two", 1)]
    before = {r["text"]: r["id"] for r in corpus.children.collect()}
    assert {r["text"]: r["id"] for r in after.children.collect()}["two"] == before["two"]


def test_turn(spark):
    documents = spark.createDataFrame([("a", "processing")], "id string, status string")
    corpus = service.upload(documents, parsed(spark, ("a", ["one", "two", "three"])), lambda: HashEmbedder(8), SMALL)
    messages = spark.createDataFrame([("s", 0, "user", "earlier", None)], "session_id string, seq int, role string, content string, created_at timestamp")
    seen = []
    turn = service.send_message(corpus, messages, "s", " two ", HashEmbedder(8), lambda contents, system, temperature: seen.append((contents, temperature)) or "fine", settings=SMALL)
    assert turn.reply == "fine" and (turn.retrieved_children, turn.retrieved_parents) == (2, 2) and turn.context.startswith("Parent section (1):\ntwo")
    assert [c["parts"][0]["text"] for c in seen[0][0]][1:] == ["earlier", "two"] and seen[0][1] == 0.2
    assert [(r["seq"], r["role"]) for r in turn.messages.orderBy("seq").collect()] == [(0, "user"), (1, "user"), (2, "assistant")]
    gone = service.Corpus(corpus.documents.selectExpr("id", "'deleted' AS status"), corpus.parents, corpus.children)
    assert service.send_message(gone, messages, "n", "x", None, lambda *a: "", settings=SMALL).context == NO_DOCUMENTS
    with pytest.raises(ValueError):
        service.send_message(corpus, messages, "s", " ", None, None)
