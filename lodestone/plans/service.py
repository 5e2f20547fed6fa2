"""Whole flows: upload, reprocess, and a chat turn, as functions from the tables before to the tables after."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import validation
from lodestone.functions.text import trim
from lodestone.operators import catalog, chunking, diff, retrieve, sections, sessions, vector
from lodestone.sources import store
from lodestone.sources.adapters import Embedder, Generator, Settings, embed_children, embed_query
from lodestone.sources.shared import stored


@dataclass(frozen=True)
class Corpus:
    """Documents (id, status), their sections, and the passages with embeddings."""

    documents: DataFrame
    parents: DataFrame
    children: DataFrame


def _embedded(children: DataFrame, embedder: Callable[[], Embedder] | None, settings: Settings) -> DataFrame:
    return embed_children(children, embedder, settings) if embedder else children


def upload(documents: DataFrame, parsed: DataFrame, embedder: Callable[[], Embedder] | None = None, settings: Settings = Settings()) -> Corpus:
    """Sections and passages of new documents, and the documents with their status.

    A document without text, sections or passages is ``failed`` and leaves no parts; the others are ``completed``.
    """
    parents = stored(sections.logical_parents(parsed))  # read several times below
    children = chunking.child_chunks(parents)
    counts = stored(chunking.ingest_counts(parsed, parents, children))
    done = counts.select(F.col("document_id").alias("done_id"), F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("done"))
    after = _with_status(documents, done)
    good = counts.where("error IS NULL").select("document_id")
    return Corpus(after, parents.join(good, "document_id", "left_semi"), _embedded(children.join(good, "document_id", "left_semi"), embedder, settings))


def started(documents: DataFrame, ids: DataFrame, owner=None) -> DataFrame:
    """Documents of which undeleted ones among ``ids`` (id), of the owner if one is given, are in process.

    Published before the long work, so that a run that dies leaves them so.
    """
    return _with_status(documents, _open(documents, owner).join(ids, "id", "left_semi").select(F.col("id").alias("done_id"), F.lit("processing").alias("done")))


def _open(documents: DataFrame, owner=None) -> DataFrame:
    found = catalog.undeleted(documents)
    return found if owner is None else catalog.owned(found, owner)


def _with_status(documents: DataFrame, done: DataFrame) -> DataFrame:
    """Documents with the status that (done_id, done) gives."""
    joined = documents.join(done, documents["id"] == done["done_id"], "left")
    return joined.select(*[F.coalesce("done", documents[c]).alias(c) if c == "status" else documents[c] for c in documents.columns])


def reprocess(
    corpus: Corpus, parsed: DataFrame, embedder: Callable[[], Embedder] | None = None, settings: Settings = Settings(), refresh_pages: bool = False, owner=None, files: DataFrame | None = None
) -> tuple[Corpus, DataFrame]:
    """The corpus after new versions of some documents, and the counters of those that worked (children_reembedded too).

    Only documents that exist, aren't deleted and are the owner's (if one is given) are looked at.  A version without
    text or sections, or that its parser couldn't read, changes nothing but the status, which is ``failed``; the
    others' is ``completed``, and ``files`` (id, mime_type, size, path) gives their new metadata where it isn't null.

    Only sections whose content is new are split and embedded; what moved keeps its id and its passages.  These keep the
    page that they had, unless ``refresh_pages`` gives them that of their section.
    """
    parsed = parsed.join(_open(corpus.documents, owner).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    sectioned = stored(sections.logical_parents(parsed).drop("id"))  # read several times below
    counts = stored(chunking.ingest_counts(parsed, sectioned, sectioned))  # a section isn't blank, so it has a passage
    status = counts.select(F.col("document_id").alias("done_id"), F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("done"))
    ids = counts.where("error IS NULL").select("document_id")
    old, others = corpus.parents.join(ids, "document_id", "left_semi"), corpus.parents.join(ids, "document_id", "left_anti")
    found = stored(diff.classify(old, sectioned.join(ids, "document_id", "left_semi")))
    after = diff.apply(found, old)
    kept = diff.surviving_children(found, corpus.children)
    if refresh_pages:
        pages = after.select(F.col("id").alias("parent_id"), "start_page")
        kept = kept.join(pages, "parent_id", "left").withColumn("page_number", F.coalesce("start_page", "page_number")).select(*corpus.children.columns)
    fresh = _embedded(chunking.child_chunks(after.join(old.select(F.col("id").cast("string").alias("id")), "id", "left_anti")), embedder, settings)
    embedded = fresh.groupBy("document_id").agg(F.count(F.lit(1)).alias("children_reembedded"))
    counters = diff.counters(found).join(embedded, "document_id", "left").fillna(0, ["children_reembedded"])
    documents = _with_status(corpus.documents, status)
    if files is not None:
        documents = store.patch(documents, files.join(ids, files["id"] == ids["document_id"], "left_semi"))
    return Corpus(documents, others.unionByName(after), kept.unionByName(fresh.select(*corpus.children.columns))), counters


@dataclass(frozen=True)
class Turn:
    """A chat turn: the reply, what was retrieved, and all messages after it."""

    reply: str
    context: str
    retrieved_children: int
    retrieved_parents: int
    messages: DataFrame


def send_message(corpus: Corpus, messages: DataFrame, session_id: str, text: str, embedder: Embedder, generator: Generator, system: str = "", settings: Settings = Settings(), now: datetime | None = None) -> Turn:
    """Retrieves, assembles the prompt, calls the model on the driver and appends both messages, stamped with ``now``.

    Without any undeleted document the query isn't embedded, and the context says so.
    """
    text = (text or "").strip()
    if not text:
        raise ValueError("no message")
    spark = messages.sparkSession
    kind = "session_id string, role string, content string, created_at timestamp, order int"
    asked = sessions.append_messages(messages, spark.createDataFrame([(session_id, "user", text, now, 0)], kind))
    if corpus.documents.where(~F.col("status").eqNullSafe("deleted")).isEmpty():
        found, children, parents = retrieve.NO_DOCUMENTS, 0, 0
    else:
        near = vector.topk(corpus.children, embed_query(text, embedder, settings), settings.top_k)
        hits = near.join(corpus.children.select("id", "parent_id", "text"), "id").select("rank", "parent_id", "text")
        found, children, parents = retrieve.context(hits, corpus.parents).first()
    contents = sessions.prompts(asked.where(F.col("session_id") == session_id), F.lit(found)).first()["contents"]
    raw = generator([{"role": c["role"], "parts": [{"text": c["text"]}]} for c in contents], system, 0.2)
    reply = spark.range(1).select(sessions.reply_text(F.lit(raw), F.array(F.struct(F.lit("").alias("text")))).alias("reply")).first()["reply"]
    answered = sessions.append_messages(asked, spark.createDataFrame([(session_id, "assistant", reply, now, 0)], kind))
    return Turn(reply, found, children, parents, answered)


def chat(
    corpus: Corpus, chats: DataFrame, messages: DataFrame, owner, session_id: str | None, text: str, embedder: Embedder, generator: Generator, now: datetime, system: str = "", settings: Settings = Settings()
) -> tuple[str, DataFrame, Turn]:
    """(session id, sessions after the turn, the turn) of a user's message.

    An unknown or foreign session id, or none, opens a session.  A session is titled by its first message, and is
    touched by each.  ``chats`` has session_id, user_id, title, status, last_message_at, created_at, updated_at.
    """
    if owner is None:
        raise PermissionError("no user")
    if not (text or "").strip():
        raise ValueError("no message")
    chats, key = sessions.find_or_create(chats, owner, session_id, text, now)
    first = messages.where(F.col("session_id") == F.lit(key)).isEmpty()
    turn = send_message(corpus, messages, key, text, embedder, generator, system, settings, now)
    named = chats.sparkSession.range(1).select(sessions.title(F.lit(text)).alias("title")).first()["title"] if first else None
    return key, sessions.touched(chats, key, now, named), turn


def add_document(documents: DataFrame, key, owner, file: dict | None, now: datetime) -> DataFrame:
    """The documents with a new one in process: file has name, mime_type, size, path (by default, the name)."""
    if not file:
        raise ValueError("no file")
    if owner is None:
        raise PermissionError("no user")
    name, stamp = str(file["name"]).strip(), F.lit(now).cast("timestamp")
    values = {"id": F.lit(key), "user_id": F.lit(owner), "name": F.lit(name), "status": F.lit("processing"), "created_at": stamp, "updated_at": stamp}
    values |= {"mime_type": F.lit(file["mime_type"]), "size": F.lit(file["size"]), "path": F.lit(file.get("path") or name)}
    row = documents.sparkSession.range(1).select(*[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in documents.dtypes])
    return documents.unionByName(row)


def required(found: DataFrame, key, as_object_id: bool = True) -> DataFrame:
    """The row that a request by id reached: an id of another form, or no row, is refused."""
    if as_object_id and not re.fullmatch(validation.OBJECT_ID, str(key)):
        raise ValueError(f"not an id: {key}")
    if found.isEmpty():
        raise LookupError(f"not found: {key}")
    return found


def titled(messages: DataFrame) -> DataFrame:
    """(session_id, title) by the first user message."""
    return sessions.session_view(messages).select("session_id", trim("title").alias("title"))
