"""Validation rules as columns: each gives the error of a row, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import trim

#: The domains of the schema, the form of an e-mail address and, below, the messages that callers get.
ROLES = ("user", "editor", "admin")
DOCUMENT_STATUS = ("uploaded", "processing", "completed", "failed", "deleted")
SESSION_STATUS = ("active", "archived")
MESSAGE_ROLES = ("user", "assistant")
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
OBJECT_ID = r"^[0-9a-fA-F]{24}$"


def email(column: Column) -> Column:
    return F.lower(trim(F.coalesce(column, F.lit(""))))


def blank(column: Column) -> Column:
    return F.coalesce(F.length(trim(column)) == 0, F.lit(True))


def object_id(column: Column) -> Column:
    """Whether a key has the form of an object id."""
    return F.coalesce(column.cast("string").rlike(OBJECT_ID), F.lit(False))


def user_error(name: Column, mail: Column, password: Column, role: Column) -> Column:
    """Of a new user: name, then e-mail, then password, then role."""
    return (
        F.when(blank(name), "Name is required.")
        .when(~email(mail).rlike(EMAIL), "A valid email is required.")
        .when(F.coalesce(F.length(password), F.lit(0)) < 6, "Password is required and must be at least 6 characters long.")
        .when(~F.coalesce(role, F.lit("user")).isin(*ROLES), "Invalid role.")
    )


def patch_error(name: Column, mail: Column, password: Column, role: Column) -> Column:
    """Of an update: only what is given (not null) is looked at."""
    return (
        F.when(name.isNotNull() & blank(name), "Name cannot be empty.")
        .when(mail.isNotNull() & ~email(mail).rlike(EMAIL), "A valid email is required.")
        .when(F.length(password) < 6, "Password must be at least 6 characters long.")
        .when(~role.isin(*ROLES), "Invalid role.")
    )


def active_on_create(value: Column, given_as: Column) -> Column:
    """Only real booleans count; ``given_as`` is the type that the caller sent ("boolean", "string", "number")."""
    return F.when(given_as == "boolean", value.cast("string") == "true").otherwise(True)


def truthy(value: Column, given_as: Column) -> Column:
    """Truthiness of a value sent as text: any non-empty string is true, 0 and NaN are false."""
    text = value.cast("string")
    return (
        F.when(value.isNull() | (given_as == "null"), False)
        .when(given_as == "boolean", text == "true")
        .when(given_as == "number", F.coalesce(F.try_to_number(text, F.lit("S999999999999999.999999")) != 0, text.try_cast("double") != 0, F.lit(False)))
        .otherwise(text != "")
    )


def quarantine(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Rows whose value is outside the domain, null included."""
    return df.where(~F.coalesce(F.col(column).isin(*domain), F.lit(False)))


def wrong_dimension(df: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is missing or hasn't ``dimension`` components."""
    return df.where(F.coalesce(F.size(vector), F.lit(-1)) != dimension)
