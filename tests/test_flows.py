"""Nothing gets lost: bad vectors, moved sections, failed parses, repeated patches; sessions and records from first to last."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import validation as V
from lodestone.operators import catalog, chunking, diff, sections, sessions, vector
from lodestone.operators.sections import PARSED
from lodestone.plans import service
from lodestone.sources import adapters, store

NOW = datetime(2024, 5, 6, 7, 8, 9)
SECTION = "document_id string, id string, content_hash string, index int, start_page int, end_page int, text string"
SESSION = "session_id string, user_id string, title string, status string, last_message_at timestamp, created_at timestamp, updated_at timestamp"
MESSAGE = "session_id string, seq int, role string, content string, created_at timestamp"
USER = "id string, name string, email string, password string, role string, is_active boolean"
SMALL = adapters.Settings(dimensions=8, batch_delay_ms=0, top_k=2)


def test_bad_vectors_hide_no_good_ones(spark):
    bad = [float("nan"), 1.0], [float("inf"), 0.0], [None, 1.0]
    rows = [(n, [1.0, n / 20]) for n in range(20)] + [(100 + n, bad[n % 3]) for n in range(6)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
    assert [r["id"] for r in vector.topk(df, [1.0, 0.0], 5).collect()] == [0, 1, 2, 3, 4]
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 0.0]), (3, None)], "id long, embedding array<double>")
    assert {r["query_id"] for r in vector.batch_topk(df, asked, 2).collect()} == {1}
    assert vector.batch_topk(df, [(7, [float("nan"), 0.0])], 2).count() == 0


def test_ids_stay_different_when_content_comes_back(spark):
    state = spark.createDataFrame([], SECTION)
    for version in ("ABCX", "XABC", "XABX", "X", "XX", "X", "XX", "ABCX"):
        new = spark.createDataFrame([("d", None, c, n, 1, 1, c) for n, c in enumerate(version)], SECTION).drop("id")
        before = {r["id"]: r["text"] for r in state.collect()}
        state = spark.createDataFrame(diff.apply(diff.classify(state, new), state).collect(), "id string, document_id string, index int, text string, content_hash string, start_page int, end_page int")
        rows = state.orderBy("index").collect()
        assert "".join(r["text"] for r in rows) == version and len({r["id"] for r in rows}) == len(version)
        assert all(before.get(r["id"], r["text"]) == r["text"] for r in rows)


def parsed(spark, *docs):
    return spark.createDataFrame([(d, " ".join(t), [(n + 1, x, []) for n, x in enumerate(t)], []) for d, t in docs], PARSED)


def test_a_failed_parse_keeps_what_there_was(spark):
    documents = spark.createDataFrame([("a", "u", "processing", 1), ("b", "u", "processing", 1), ("c", "v", "processing", 1)], "id string, user_id string, status string, size long")
    corpus = service.upload(documents, parsed(spark, ("a", ["one", "two"]), ("b", ["three"]), ("c", ["four"])))
    files = spark.createDataFrame([("a", 9), ("b", 9), ("c", 9)], "id string, size long")
    again = parsed(spark, ("a", [" "]), ("b", ["three", "more"]), ("c", ["other"]), ("gone", ["x"]))
    after, counters = service.reprocess(corpus, again, owner="u", files=files)
    assert {r["id"]: (r["status"], r["size"]) for r in after.documents.collect()} == {"a": ("failed", 1), "b": ("completed", 9), "c": ("completed", 1)}
    assert sorted((r["document_id"], r["text"]) for r in after.parents.collect()) == [("a", "one"), ("a", "two"), ("b", "more"), ("b", "three"), ("c", "four")]
    assert after.children.count() == 5 and [tuple(r) for r in counters.collect()] == [("b", 2, 1, 1, 0, 1)]
    marked = service.started(store.update_where(corpus.documents, F.col("id") == "b", status=F.lit("deleted")), corpus.documents.select("id"), "u")
    assert {r["id"]: r["status"] for r in marked.collect()} == {"a": "processing", "b": "deleted", "c": "completed"}


def test_unreadable_files_fail_alone(spark):
    files = spark.createDataFrame([("a", b'{"text": "x", "pages": [{"text": "x"}]}'), ("b", b"no json")], "path string, content binary")
    found = adapters.parse_files(files, adapters.json_parser)
    parents = sections.logical_parents(found)
    counts = chunking.ingest_counts(found, parents, chunking.child_chunks(parents))
    assert {r["document_id"]: (r["pages"], r["child_count"], bool(r["error"])) for r in counts.collect()} == {"a": (1, 1, False), "b": (0, 0, True)}
    meta = chunking.ingest_meta(counts, F.lit(NOW), F.lit(NOW) + F.expr("INTERVAL 2 SECONDS")).first()
    assert (meta["child_chunk_size"], meta["child_chunk_overlap"], meta["processing_ms"]) == (800, 120, 2000)


def test_repeated_patches(spark):
    now = F.lit(NOW).cast("timestamp")
    users = spark.createDataFrame([("1", "A", "a@b.co", "h", "user", True), ("2", "B", "b@b.co", "h", "user", True), ("3", "C", "c@b.co", "h", "user", True)], USER).withColumn("updated_at", now)
    patches = [("1", None, "new@b.co", None, None, None), ("2", None, "NEW@b.co", None, None, None), ("3", "x", None, None, None, None), ("3", "y", None, None, None, None), ("3", "x", None, None, None, None)]
    after, rejected = catalog.update_users(users, spark.createDataFrame(patches, USER), now)
    assert [(r["id"], r["name"], r["email"]) for r in after.orderBy("id").collect()] == [("1", "A", "new@b.co"), ("2", "B", "b@b.co"), ("3", "x", "c@b.co")]
    assert dict(rejected.collect()) == {"2": catalog.TAKEN, "3": catalog.REPEATED}
    twice = store.patch(users, spark.createDataFrame([("1", "p"), ("1", "q"), ("9", "r")], "id string, name string"))
    assert [r["name"] for r in twice.orderBy("id").collect()] == ["q", "B", "C"]


def test_titles_and_patterns(spark):
    row = spark.range(1).select(T.title(F.lit(" " * 50 + "x" * 45)), T.title(F.lit("😀" * 30)), T.title(F.lit("a" + "😀" * 30)), T.prefix(F.lit("ab"), 5)).first()
    assert tuple(row) == ("x" * 40, "😀" * 20, "a" + "😀" * 19, "ab")
    people = spark.createDataFrame([("a(b",)], "name string")
    with pytest.raises(ValueError):
        catalog.search(people, "a(b", ["name"])
    assert catalog.search(people, "A(b", ["name"], literal=True).count() == 1
    assert [r[0] for r in spark.createDataFrame([("0123456789abcdefABCDEF00",), ("x",), (None,)], "v string").select(V.object_id(F.col("v"))).collect()] == [True, False, False]


def test_section_path(spark):
    nodes = [("H1", "A"), ("H3", "C"), ("P", "c"), ("H2", "B"), ("H3", "D"), ("P", "d"), ("H1", "E"), ("P", "e")]
    rows = [(n, 0, kind, text, []) for n, (kind, text) in enumerate(nodes)]
    found = sections.section_parents(spark.createDataFrame([("d", "x", [], rows)], PARSED), with_path=True)
    assert [(r["section_path"], r["index"]) for r in found.orderBy("index").collect()] == [(["A", "B", "D"], 0), (["E"], 1)]


def test_chat_from_first_to_last(spark):
    users = spark.createDataFrame([("u", "Ann", "a@b.co", "h", "user", True)], USER)
    documents = service.add_document(spark.createDataFrame([], "id string, user_id string, name string, mime_type string, size long, path string, status string, created_at timestamp, updated_at timestamp"), "a", "u", {"name": " f.pdf ", "mime_type": "application/pdf", "size": 3}, NOW)
    assert documents.select("name", "status", "path").first() == ("f.pdf", "processing", "f.pdf")
    for file, owner, error in ((None, "u", ValueError), ({"name": "x"}, None, PermissionError)):
        with pytest.raises(error):
            service.add_document(documents, "b", owner, file, NOW)
    corpus = service.upload(documents, parsed(spark, ("a", ["one", "two"])), lambda: adapters.HashEmbedder(8), SMALL)
    chats = spark.createDataFrame([], SESSION)
    with pytest.raises(LookupError):
        sessions.create_session(chats, users, "nobody", NOW)
    chats, made = sessions.create_session(chats, users, "u", NOW)
    assert chats.select("title", "status", "last_message_at").first() == ("New chat", "active", NOW)
    messages = spark.createDataFrame([], MESSAGE)
    say = lambda text: lambda *a: text
    later = datetime(2024, 5, 6, 8, 0, 0)
    key, chats, turn = service.chat(corpus, chats, messages, "u", made, " two ", adapters.HashEmbedder(8), say("fine"), later, settings=SMALL)
    assert key == made and chats.select("title", "last_message_at", "updated_at", "created_at").first() == ("two", later, later, NOW)
    assert [(r["role"], r["created_at"]) for r in turn.messages.orderBy("seq").collect()] == [("user", later), ("assistant", later)]
    key, chats, turn = service.chat(corpus, chats, turn.messages, "u", "unknown", "next " * 20, adapters.HashEmbedder(8), say(""), later, settings=SMALL)
    assert key not in (made, "unknown") and chats.count() == 2 and sessions.get_session(chats, key, "u").first()["title"] == ("next " * 8).strip()
    assert turn.reply == sessions.GREETING and turn.messages.where(F.col("session_id") == key).count() == 2
    assert sessions.get_session(chats, key, "other").isEmpty() and [r["session_id"] for r in sessions.list_sessions(chats, "u").collect()] == sorted([key, made])
    with pytest.raises(PermissionError):
        service.chat(corpus, chats, messages, None, key, "x", None, None, NOW)


def test_template_and_required(spark, tmp_path):
    (tmp_path / "prompt.md").write_text("Today: {{TODAY_IST}}\nand {{TODAY_IST}}")
    assert sessions.system_prompt(sessions.load_template(spark, str(tmp_path / "prompt.md")), "Monday") == "Today: Monday\nand {{TODAY_IST}}"
    found = spark.range(1)
    assert service.required(found, "0123456789abcdefabcdef00").count() == 1
    for rows, key, error in ((found, "x", ValueError), (found.limit(0), "0123456789abcdefabcdef00", LookupError)):
        with pytest.raises(error):
            service.required(rows, key)


def plain_split(text, size=800, overlap=120, separators=("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")):
    """The splitter as its description has it, on strings."""
    units = lambda t: len(t.encode("utf-16-le")) // 2

    def merge(pieces):
        out, held, total = [], [], 0
        for p in pieces:
            if total + units(p) > size and held:
                out.append("".join(held))
                while total > overlap or (total + units(p) > size and total > 0):
                    total -= units(held.pop(0))
            held.append(p)
            total += units(p)
        return [t.strip(chunking._SPACES) for t in [*out, "".join(held)] if t.strip(chunking._SPACES)]

    at = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    sep, rest, pieces, start = separators[at], separators[at + 1 :], [], 0
    while start < len(text):
        end = text.find(sep, start + 1) if sep else start + 1
        end = len(text) if end < 0 else end
        pieces.append(text[start:end])
        start = end
    out, good = [], []
    for p in pieces:
        if units(p) < size:
            good.append(p)
        else:
            out += merge(good)
            good = []
            out += plain_split(p, size, overlap, rest) if sep and rest else [p]
    return [*out, *merge(good)]


def test_passages_of_all_documents_by_a_plain_splitter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("document_id"), "text", F.lit(1).alias("start_page"))
    got = {}
    for r in chunking.child_chunks(docs).orderBy("parent_id", "index").collect():
        got.setdefault(r["parent_id"], []).append(r["text"])
    texts = {r["id"]: r["text"] for r in docs.collect()}
    assert sum(len(t) > 800 for t in texts.values()) > 50
    for key, text in texts.items():
        assert got.get(key, []) == plain_split(text or ""), key
