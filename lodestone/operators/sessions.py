"""Chat sessions as append-only messages: tails, views, titles, and the prompt of a turn."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import title, trim

#: Turns of history in a prompt, the line before its context, and the answer in place of an empty one.
HISTORY = 10
PREAMBLE = "Use the following retrieved document context to answer the user question. If the context is empty or irrelevant, say you could not find it in the available documents.\n\n"
GREETING = "I’m here to help."


def last_messages(messages: DataFrame, n: int = HISTORY, session: str = "session_id", order: str = "seq") -> DataFrame:
    """The last n messages of each session."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return messages.withColumn("from_end", rank).where(F.col("from_end") <= n).drop("from_end")


def session_view(messages: DataFrame) -> DataFrame:
    """(session_id, messages, last_message_at, title): the nested form; the title is made from the first user message."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "role", "content", "created_at")))
    first = F.min_by(F.col("content"), F.when(F.col("role") == "user", F.col("seq")))
    return messages.groupBy("session_id").agg(ordered.alias("messages"), F.max("created_at").alias("last_message_at"), title(first).alias("title"))


def list_sessions(sessions: DataFrame, owner) -> DataFrame:
    """A user's sessions, newest update first."""
    return sessions.where(F.col("user_id") == F.lit(owner)).orderBy(F.desc("updated_at"), "session_id")


def create_session(sessions: DataFrame, users: DataFrame, owner, now, first_title: str = "New chat") -> tuple[DataFrame, str]:
    """(all sessions, the new one's id) of a user, who must exist."""
    if users.where(F.col("id") == F.lit(owner)).isEmpty():
        raise LookupError("user not found")
    return _opened(sessions, owner, "", first_title, now)


def _opened(sessions: DataFrame, owner, asked: str, first_title: str, now) -> tuple[DataFrame, str]:
    spark, stamp = sessions.sparkSession, F.lit(now).cast("timestamp")
    held = owned_count(sessions, owner)
    key = sha256("\x01".join(map(str, (owner, asked, held, now))).encode()).hexdigest()
    values = {"session_id": F.lit(key), "user_id": F.lit(owner), "title": F.lit(first_title.strip() or "New chat"), "status": F.lit("active"), "last_message_at": stamp, "created_at": stamp, "updated_at": stamp}
    row = spark.range(1).select(*[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in sessions.dtypes])
    return sessions.unionByName(row), key


def owned_count(sessions: DataFrame, owner) -> int:
    return sessions.where(F.col("user_id") == F.lit(owner)).count()


def get_session(sessions: DataFrame, key: str, owner) -> DataFrame:
    """A user's own session, one row or none."""
    return sessions.where((F.col("session_id") == F.lit(key)) & (F.col("user_id") == F.lit(owner))).limit(1)


def find_or_create(sessions: DataFrame, owner, key: str | None, text: str, now) -> tuple[DataFrame, str]:
    """(all sessions, the id reached): an unknown or foreign id, or none, opens a session titled by the message."""
    if key and not get_session(sessions, key, owner).isEmpty():
        return sessions, key
    first = sessions.sparkSession.range(1).select(title(F.lit(text)).alias("title")).first()["title"]
    return _opened(sessions, owner, key or "", first, now)


def touched(sessions: DataFrame, key: str, now, new_title: str | None = None) -> DataFrame:
    """The session with a message at ``now``, and a new title where one is given."""
    hit, stamp = F.col("session_id") == F.lit(key), F.lit(now).cast("timestamp")
    values = {"last_message_at": stamp, "updated_at": stamp} | ({"title": F.lit(new_title)} if new_title else {})
    return sessions.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """All messages after new ones (session_id, role, content, created_at, order) are put at the ends of their sessions.

    Content is trimmed; blank messages and unknown roles are left out.
    """
    last = messages.groupBy("session_id").agg(F.max("seq").alias("last"))
    good = new.withColumn("content", trim("content")).where((F.col("content") != "") & F.col("role").isin("user", "assistant"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("order"))
    added = good.join(last, "session_id", "left").withColumn("seq", (F.coalesce("last", F.lit(-1)) + place).cast("int"))
    return messages.unionByName(added.select(*messages.columns))


def prompts(messages: DataFrame, context: Column, n: int = HISTORY, session: str = "session_id", order: str = "seq", role: str = "role", content: str = "content") -> DataFrame:
    """(session_id, contents): the context turn first, then the last n messages in order, as (role, text)."""
    tail = last_messages(messages, n, session, order)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(role).alias("role"), F.col(content).alias("text"))))
    history = F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    first = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(PREAMBLE), context).alias("text")))
    return tail.groupBy(F.col(session).alias("session_id")).agg(history.alias("history")).select("session_id", F.concat(first, "history").alias("contents"))


def load_template(spark: SparkSession, path: str) -> str:
    """A template's text, from any store that Spark reads."""
    return spark.read.text(path, wholetext=True).first()["value"]


def system_prompt(template: str, today: str, mark: str = "{{TODAY_IST}}") -> str:
    """The first mark in the template gives way to the date."""
    return template.replace(mark, today, 1)


def reply_text(text: Column, parts: Column) -> Column:
    """A response's text; else its parts joined and trimmed; else a greeting."""
    joined = trim(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(joined, F.lit("")), F.lit(GREETING))


def resolve_sessions(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests (user_id, session_id, message) with the session that they reach, or a new one: is_new, title.

    An unknown or foreign session id gives a new session with an id of its own; blank messages are rejected by the caller.
    """
    from lodestone.functions.text import stable_id

    known = sessions.select(F.col("session_id").alias("known_id"), F.col("user_id").alias("known_user"))
    rows = requests.join(known, (requests["session_id"] == known["known_id"]) & (requests["user_id"] == known["known_user"]), "left")
    fresh = F.col("known_id").isNull()
    new_id = stable_id(requests["user_id"], F.coalesce(requests["session_id"], F.lit("")), requests["message"])
    return rows.select(requests["user_id"], F.when(fresh, new_id).otherwise(F.col("known_id")).alias("session_id"), requests["message"], fresh.alias("is_new"), F.when(fresh, title(requests["message"])).alias("title"))
