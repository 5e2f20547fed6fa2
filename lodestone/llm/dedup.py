"""Exact deduplication: a 128-bit content hash, then the bytes themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WHITE

_TOP = (1 << 63) - 1
_WORD = 1 << 64


def _preference(chars: Column, key: Column) -> Column:
    """One number that is larger for more characters, then for a smaller key; null for a null key.

    A fixed-width number keeps the aggregate on the hash path, which a struct would leave.
    """
    return chars.cast("decimal(10,0)") * F.lit(str(_WORD)).cast("decimal(20,0)") + (F.lit(_TOP).cast("decimal(19,0)") - key.cast("decimal(19,0)"))


def _preferred_key(preference: Column) -> Column:
    return (F.lit(_TOP).cast("decimal(19,0)") - preference % F.lit(str(_WORD)).cast("decimal(20,0)")).cast("long")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are, white space (space, tab to carriage return) aside; a null text counts as empty.
    Of equal rows, the one with the most code points in its original text, then the smallest key, is kept.  Rows that
    repeat a key share its fate; a null key is kept only where all keys of its group are null (keep_id is null then).

    Groups form on the 128-bit hash *and* the bytes, so a collision of ``content_hash`` can't merge two texts: the
    partial aggregate folds copies before the shuffle, so a group of any size sends one row from each input partition.
    What joins back to the rows is a narrow table, one row per distinct text.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.translate(raw, WHITE, "").alias("bare"), F.length(raw).alias("chars"))
    rows = rows.withColumn("content", content_hash(F.col("bare")))
    texts = rows.groupBy("content", "bare").agg(F.max(_preference(F.col("chars"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    texts = texts.select("content", F.sha2("bare", 256).alias("text_sha256"), _preferred_key(F.col("best")).alias("keep_id"), "group_size")
    members = rows.select("doc_id", "content", F.sha2("bare", 256).alias("text_sha256"))
    return members.join(texts, ["content", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each text, white space aside, with all its columns; a null text counts as empty.

    The row with the most code points in its original text stays, then that of the smallest key (null last), then that
    of the smallest hash of all columns; rows that are equal in all of them are one row afterwards.  The decision is on
    the row itself, so keys may be null, repeated, or shared by different texts.  Rows fold by hash and bytes before the
    shuffle, so a group of any size sends one row from each input partition.
    """
    raw = F.coalesce(docs[text], F.lit(""))
    bare = F.translate(raw, WHITE, "")
    tie = F.xxhash64(*[docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    preference = F.struct(F.length(raw), docs[key].isNotNull(), -docs[key].cast("decimal(19,0)"), tie)
    rows = docs.select(F.md5(bare).alias("content"), bare.alias("bare"), preference.alias("preference"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.groupBy("content", "bare").agg(F.max_by("row", "preference").alias("row")).select("row.*")


ORACLE = r"""
WITH b AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM b)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
