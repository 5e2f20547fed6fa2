"""Golden and property tests of passages, diff, retrieval, catalogue, sessions and functions."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import validation as V
from lodestone.operators import catalog, chunking, diff, retrieve, sessions, vector


def split(text, size=10, overlap=3):
    return chunking.split_text(text, size, overlap)


def test_splitter_goldens():
    assert split("aaaa bbbb cccc") == ["aaaa bbbb", "cccc"]
    assert split("abcdefghij") == ["abcdefghij"]
    assert split("abcdefghijk") == ["abcdefghij", "hijk"]
    assert split("a. b") == ["a. b"]
    assert split("") == []
    assert [len(x) for x in chunking.split_text("x" * 801)] == [800, 121]
    assert [len(x) for x in chunking.split_text("x" * 799)] == [799]
    assert [len(x) for x in chunking.split_text("😀" * 500)] == [400, 160]  # UTF-16 units: 800, then the overlap and the rest


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n.;,?!é😀", max_size=300))
def test_splitter_properties(text):
    chunks = chunking.split_text(text, 20, 5)
    assert all(chunking.units(c) <= 20 and c in text and c.strip() for c in chunks)
    at = 0
    for c in chunks:  # in order, they cover all that isn't white space
        found = text.find(c, max(0, at - 20))
        assert found >= 0
        at = max(at, found + len(c))
    assert set(text.split()) == set() or "".join(text.split())[-1] == "".join(chunks[-1].split())[-1]


SECTION = "document_id string, id string, content_hash string, index int, start_page int, end_page int, text string"


def versions(spark):
    old = [("d", "o1", "A", 0, 1, 1, "A"), ("d", "o2", "A", 1, 2, 2, "A"), ("d", "o3", "B", 2, 3, 3, "B"), ("d", "o4", "C", 3, 4, 4, "C")]
    new = [("d", None, "A", 0, 1, 1, "A"), ("d", None, "B", 1, 2, 2, "B"), ("d", None, "A", 2, 3, 3, "A"), ("d", None, "D", 3, 4, 4, "D"), ("d", None, "A", 4, 5, 5, "A")]
    return spark.createDataFrame(old, SECTION), spark.createDataFrame(new, SECTION).drop("id")


def test_diff_golden(spark):
    old, new = versions(spark)
    found = diff.classify(old, new)
    by_id = {r["old_id"]: r["state"] for r in found.where("old_id IS NOT NULL").collect()}
    assert by_id == {"o1": "unchanged", "o2": "reposition", "o3": "reposition", "o4": "removed"}
    assert diff.counters(found).first()[1:] == (5, 3, 2, 1)
    after = diff.apply(found, old)
    key = lambda df: sorted((r["index"], r["content_hash"], r["start_page"]) for r in df.collect())
    assert key(after) == key(new)
    assert {r["state"] for r in diff.classify(old, old.drop("id")).collect()} == {"unchanged"}
    children = spark.createDataFrame([("o1",), ("o4",)], "parent_id string")
    assert [r[0] for r in diff.surviving_children(found, children).collect()] == ["o1"]


def test_retrieval_golden(spark):
    hits = spark.createDataFrame([(1, "p2", " c1 "), (2, "p1", "c2"), (3, "p2", "c3"), (4, "p9", "c4"), (5, "p1", " ")], "rank int, parent_id string, text string")
    parents = spark.createDataFrame([("p1", 7, "one"), ("p2", 8, "two")], "id string, index int, text string")
    row = retrieve.context(hits, parents).first()
    assert row["context_text"] == "Parent section (8):\ntwo\n\nRelevant child excerpts:\nc1\nc3\n\n---\n\nParent section (7):\none\n\nRelevant child excerpts:\nc2"
    assert (row["retrieved_children"], row["retrieved_parents"]) == (5, 2)
    assert retrieve.context(hits.limit(0), parents).first()["context_text"] == retrieve.NO_HITS
    gone = spark.createDataFrame([("d", "deleted")], "id string, status string")
    assert retrieve.context(hits, parents, gone).first()["context_text"] == retrieve.NO_DOCUMENTS


def test_pages():
    assert [catalog.clamp(*a) for a in ((None, None), (0, 0), (-3, -3), ("abc", 500), (2, 5), (1.5, "7"), (float("nan"), "x"))] == [(1, 20), (1, 20), (1, 1), (1, 100), (2, 5), (1, 7), (1, 20)]


def test_pagination_and_null_status(spark):
    rows = spark.range(41)
    assert catalog.pagination(rows, 1, 20).first()[2:] == (41, 3)
    assert catalog.pagination(rows.limit(0)).first()[2:] == (0, 0)
    status = spark.createDataFrame([(None,), ("deleted",), ("x",)], "status string")
    assert catalog.undeleted(status).count() == 2


def test_search_is_unicode_and_literal(spark):
    rows = spark.createDataFrame([("ÉA",), ("a.b",), ("axb",), (None,)], "name string")
    assert catalog.search(rows, "éa", ["name"]).count() == 1
    assert catalog.search(rows, "a.b", ["name"]).count() == 2
    assert catalog.search(rows, "a.b", ["name"], literal=True).count() == 1
    assert catalog.search(rows, " ", ["name"]).count() == 4


USER = "id string, name string, email string, password string, role string, is_active boolean"


def test_users(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    existing = spark.createDataFrame([("0", "Old", "old@x.org", "h", "user", True)], USER).withColumn("created_at", now).withColumn("updated_at", now)
    new = spark.createDataFrame([("1", " Ann ", " A@B.co ", "secret", None, None), ("2", "Bob", "a@b.co", "secret", None, None), ("3", " ", "c@d.e", "secret", None, None), ("4", "D", "a@b", "secret", None, None), ("5", "E", "e@f.g", "12345", None, None), ("6", "F", "OLD@x.org", "secret", None, False)], USER)
    good, bad = catalog.create_users(existing, new, now)
    row = good.collect()
    assert [(r["id"], r["name"], r["email"], r["role"], r["is_active"]) for r in row] == [("1", "Ann", "a@b.co", "user", True)]
    assert row[0]["password"] != "secret" and "password" not in catalog.without_password(good).columns
    assert {r["id"] for r in bad.collect()} == {"2", "3", "4", "5", "6"}
    users = existing.unionByName(good)
    patches = spark.createDataFrame([("1", None, None, None, "admin", False), ("0", None, "A@b.co", None, None, None), ("9", "x", None, None, None, None)], USER)
    after, rejected = catalog.update_users(users, patches, now)
    assert after.where("id = '1'").select("role", "is_active", "name").first() == ("admin", False, "Ann")
    assert dict(rejected.collect()) == {"0": "User with this email already exists.", "9": "User not found."}
    assert catalog.deactivate(users, "1").where("NOT is_active").count() == 1


def test_booleans(spark):
    rows = spark.createDataFrame([("false", "string"), ("false", "boolean"), ("0", "number"), ("", "string"), ("2", "number")], "v string, kind string")
    got = rows.select(V.active_on_create(F.col("v"), F.col("kind")), V.truthy(F.col("v"), F.col("kind"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (True, False), (True, False), (True, True)]


def test_text_functions(spark):
    rows = spark.createDataFrame([(" \t a  b﻿", "😀a")], "a string, b string")
    got = rows.select(T.trim(F.col("a")), T.collapse(T.trim(F.col("a"))), T.utf16_length(F.col("b")), T.title(F.lit("x" * 45)), T.title(F.lit("  "))).first()
    assert tuple(got) == ("a  b", "a b", 3, "x" * 40, "New chat")


def test_sessions(spark):
    messages = spark.createDataFrame([("s", n, "user" if n % 2 == 0 else "assistant", f"m{n}", None) for n in range(12)] + [("t", 0, "user", "hi", None)], "session_id string, seq int, role string, content string, created_at timestamp")
    tail = sessions.last_messages(messages)
    assert sorted(r["seq"] for r in tail.where("session_id = 's'").collect()) == list(range(2, 12)) and tail.where("session_id = 't'").count() == 1
    contents = sessions.prompts(messages, F.lit("ctx")).where("session_id = 's'").first()["contents"]
    assert contents[0]["text"].endswith("\n\nctx") and [c["text"] for c in contents[1:]] == [f"m{n}" for n in range(2, 12)]
    new = spark.createDataFrame([("t", "user", " more ", None, 0), ("t", "system", "x", None, 1), ("u", "user", " ", None, 0), ("v", "user", "first", None, 0)], "session_id string, role string, content string, created_at timestamp, order int")
    after = sessions.append_messages(messages, new)
    assert {(r["session_id"], r["seq"], r["content"]) for r in after.where("session_id in ('t','u','v')").collect()} == {("t", 0, "hi"), ("t", 1, "more"), ("v", 0, "first")}
    known = spark.createDataFrame([("s", "u1")], "session_id string, user_id string")
    asked = spark.createDataFrame([("u1", "s", "q"), ("u1", "zzz", "y" * 45), ("u2", "s", "q")], "user_id string, session_id string, message string")
    got = {(r["user_id"], r["is_new"], r["title"]) for r in sessions.resolve_sessions(asked, known).collect()}
    assert got == {("u1", False, None), ("u1", True, "y" * 40), ("u2", True, "q")}
    assert sessions.system_prompt("a {{TODAY_IST}} {{TODAY_IST}}", "x") == "a x {{TODAY_IST}}"
    replies = spark.createDataFrame([("t", []), ("", [(" a",), (None,), ("b ",)]), (None, [])], "text string, parts array<struct<text:string>>")
    assert [r[0] for r in replies.select(sessions.reply_text(F.col("text"), F.col("parts"))).collect()] == ["t", "ab", sessions.GREETING]


def test_topk_is_a_prefix_and_handles_gaps(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0])], "id long, embedding array<float>")
    more = [r["id"] for r in vector.topk(rows, [1.0, 0.1], 4).collect()]
    assert more == [1, 3, 2, 6]
    assert [r["id"] for r in vector.topk(rows, [1.0, 0.1], 2).collect()] == more[:2]
    assert vector.topk(rows.limit(0), [1.0, 0.1], 2).count() == 0
    assert [r["id"] for r in vector.topk(rows, [0.0, 2.0], 1, "l2").collect()] == [2]
