"""Text functions with the semantics of the service's own runtime: Unicode white space, UTF-16 lengths, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript defines it: controls, Unicode spaces, line and paragraph separators, byte order mark.
SPACE = r"[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(text, rf"{SPACE}+", " ")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_id(*parts: Column) -> Column:
    """An id that reruns give again, in place of a random one."""
    return F.sha2(F.concat_ws("\x01", *[p.cast("string") for p in parts]), 256)


def or_default(value: Column, default: Column) -> Column:
    """The default for null and for empty text; ``coalesce`` alone keeps empty text."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def present(text: Column) -> Column:
    """Neither null nor empty."""
    return text.isNotNull() & (text != "")


def prefix(text: Column, units: int) -> Column:
    """The first characters that take at most so many UTF-16 units; a surrogate pair isn't cut in two."""
    first = F.substring(text, 1, units)
    wide = F.regexp_count(first, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    last = F.aggregate(
        F.split(first, ""),
        F.struct(F.lit("").alias("text"), F.lit(0).alias("used")),
        lambda s, c: F.struct(F.when(s["used"] + utf16_length(c) <= units, F.concat(s["text"], c)).otherwise(s["text"]).alias("text"), (s["used"] + utf16_length(c)).alias("used")),
        lambda s: s["text"],
    )
    return F.when(wide == 0, first).otherwise(last)


def title(text: Column, default: str = "New chat") -> Column:
    """Of the trimmed text the first 40 UTF-16 units, trimmed again, or the default."""
    return or_default(trim(prefix(trim(text), 40)), F.lit(default))


def not_equal(column: Column, value) -> Column:
    """Not equal, true for null as well."""
    return ~column.eqNullSafe(F.lit(value))
