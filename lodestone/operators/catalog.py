"""Catalogue queries: search, scoping, pages, counts, lookups; user and document records as pure functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import validation as V
from lodestone.functions.text import not_equal, trim


#: What callers are told.
TAKEN = "User with this email already exists."
UNKNOWN = "User not found."
#: A batch has one update for a user.
REPEATED = "Another update of this user comes first."


def clamp(page=None, limit=None) -> tuple[int, int]:
    """Page from 1, limit from 1 to 100; what is missing, zero or no number gives 1 and 20."""

    def number(value, default: int) -> int:
        try:
            found = float(value)
        except (TypeError, ValueError):
            return default
        return default if not math.isfinite(found) or found == 0 else int(found)

    return max(number(page, 1), 1), min(max(number(limit, 20), 1), 100)


def page_of(df: DataFrame, order: Sequence[Column], page=None, limit=None) -> DataFrame:
    """One page in a total order: the caller's order needs a unique last column."""
    page, limit = clamp(page, limit)
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def pagination(df: DataFrame, page=None, limit=None) -> DataFrame:
    """One row: page, limit, total, total_pages."""
    page, limit = clamp(page, limit)
    total = F.count(F.lit(1))
    return df.agg(F.lit(page).alias("page"), F.lit(limit).alias("limit"), total.alias("total"), F.ceil(total / F.lit(limit)).cast("long").alias("total_pages"))


def search(df: DataFrame, text: str | None, columns: Sequence[str], literal: bool = False) -> DataFrame:
    """Rows where any of the columns matches, without regard to case in any script; an empty text takes all rows.

    A text that is no valid pattern is refused here, before a job starts.
    """
    text = (text or "").strip()
    if not text:
        return df
    quoted = text.replace(r"\E", r"\E\\E\Q")  # a quotation ends at \E, so that one is put outside
    pattern = rf"(?iu)\Q{quoted}\E" if literal else f"(?iu){text}"
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException) as error:
        raise ValueError(f"not a pattern: {text}") from error
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return df.where(hit)


def owned(df: DataFrame, owner, column: str = "user_id") -> DataFrame:
    return df.where(F.col(column) == F.lit(owner))


def undeleted(df: DataFrame, column: str = "status") -> DataFrame:
    """Null counts as not deleted."""
    return df.where(not_equal(F.col(column), "deleted"))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).orderBy(key).limit(1)


def with_count(df: DataFrame, key: str, parts: DataFrame, part_key: str, name: str = "parent_count") -> DataFrame:
    """Each row with the number of its parts, 0 without any; the counts combine before they are shuffled."""
    counts = parts.groupBy(F.col(part_key).alias("counted_key")).agg(F.count(F.lit(1)).alias("counted"))
    return df.join(counts, df[key] == counts["counted_key"], "left").select(*[df[c] for c in df.columns], F.coalesce("counted", F.lit(0)).alias(name))


def conflicts(candidates: DataFrame, existing: DataFrame, column: str, key: str) -> DataFrame:
    """Candidates whose value another row (of another key) has already."""
    taken = existing.select(F.col(column).alias("taken_value"), F.col(key).alias("taken_key"))
    return candidates.join(taken, (candidates[column] == taken["taken_value"]) & ~candidates[key].eqNullSafe(taken["taken_key"]), "left_semi")


def without_password(users: DataFrame) -> DataFrame:
    return users.drop("password")


def list_users(users: DataFrame, text: str | None = None, page=None, limit=None) -> tuple[DataFrame, DataFrame]:
    """(page of users, pagination), newest first; inactive ones too."""
    found = without_password(search(users, text, ("name", "email")))
    return page_of(found, [F.desc("created_at"), F.col("id")], page, limit), pagination(found, page, limit)


def list_documents(documents: DataFrame, owner, page=None, limit=None) -> tuple[DataFrame, DataFrame]:
    found = undeleted(owned(documents, owner))
    return page_of(found, [F.desc("created_at"), F.col("id")], page, limit), pagination(found, page, limit)


def read_document(documents: DataFrame, parents: DataFrame, key, owner) -> DataFrame:
    return with_count(lookup(undeleted(owned(documents, owner)), "id", key), "id", parents, "document_id")


def create_users(existing: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected rows with their error) of new users: id, name, email, password, role, is_active.

    A null is_active counts as true.  Of new rows with one e-mail, the smallest id is taken.
    """
    rows = new.select("id", trim("name").alias("name"), V.email(F.col("email")).alias("email"), F.col("password").alias("plain"), "role", "is_active", V.user_error(F.col("name"), F.col("email"), F.col("password"), F.col("role")).alias("error"))
    good = rows.where("error IS NULL")
    first = good.groupBy("email").agg(F.min("id").alias("first_id"))
    taken = existing.select(F.col("email").alias("held")).distinct()
    marked = good.join(first, "email").join(taken, F.col("email") == F.col("held"), "left")
    marked = marked.withColumn("error", F.when(F.col("held").isNotNull() | (F.col("id") != F.col("first_id")), TAKEN))
    accepted = marked.where("error IS NULL").select("id", "name", "email", F.sha2("plain", 256).alias("password"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("is_active", F.lit(True)).alias("is_active"), now.alias("created_at"), now.alias("updated_at"))
    rejected = rows.where("error IS NOT NULL").select("id", "email", "error").unionByName(marked.where("error IS NOT NULL").select("id", "email", "error"))
    return accepted, rejected


def update_users(users: DataFrame, patches: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(all users after the updates, rejected patches with their error); null fields of a patch stay as they are.

    Of patches with one id, the smallest in the order of their fields counts, and equal ones are one; of patches that
    give one e-mail, that of the smallest id.  An e-mail that any user holds before the updates is taken.
    """
    rows = patches.distinct().select("id", trim("name").alias("p_name"), F.when(F.col("email").isNotNull(), V.email(F.col("email"))).alias("p_email"), F.sha2("password", 256).alias("p_password"), F.col("role").alias("p_role"), F.col("is_active").alias("p_active"), V.patch_error(F.col("name"), F.col("email"), F.col("password"), F.col("role")).alias("error"))
    whole = [F.col(c).asc_nulls_last() for c in ("error", "p_email", "p_name", "p_password", "p_role", "p_active")]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.col("error").isNotNull(), *whole)))
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("nth") > 1, REPEATED)))
    valid = F.when(F.col("error").isNull(), F.col("id"))
    first = rows.where("p_email IS NOT NULL").groupBy(F.col("p_email").alias("first_email")).agg(F.min(valid).alias("first_id"))
    known = users.select(F.col("id").alias("known_id"))
    held = users.select(F.col("email").alias("held"), F.col("id").alias("held_id"))
    clash = rows.join(held, (F.col("p_email") == F.col("held")) & (F.col("id") != F.col("held_id")), "left_semi").select(F.col("id").alias("clash_id")).distinct()
    marked = rows.join(known, F.col("id") == F.col("known_id"), "left").join(clash, F.col("id") == F.col("clash_id"), "left")
    marked = marked.join(first, F.col("p_email") == F.col("first_email"), "left")
    error = F.coalesce("error", F.when(F.col("clash_id").isNotNull() | (F.col("id") != F.col("first_id")), TAKEN), F.when(F.col("known_id").isNull(), UNKNOWN))
    marked = marked.withColumn("error", error)
    good = marked.where("error IS NULL").select(F.col("id").alias("p_id"), "p_name", "p_email", "p_password", "p_role", "p_active")
    joined = users.join(good, users["id"] == good["p_id"], "left")
    fields = {"name": "p_name", "email": "p_email", "password": "p_password", "role": "p_role", "is_active": "p_active"}
    out = [F.coalesce(F.col(fields[c]), users[c]).alias(c) if c in fields else F.when(F.col("p_id").isNotNull(), now).otherwise(users[c]).alias(c) if c == "updated_at" else users[c] for c in users.columns]
    return joined.select(*out), marked.where("error IS NOT NULL").select("id", "error")


def deactivate(users: DataFrame, key) -> DataFrame:
    """The user is inactive afterwards, whether or not it was before."""
    return users.withColumn("is_active", F.when(F.col("id") == F.lit(key), False).otherwise(F.col("is_active")))
