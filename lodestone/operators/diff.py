"""Incremental re-ingest: a multiset match of new sections with stored ones by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import stable_id

STATES = ("unchanged", "reposition", "changed", "removed")


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """(content_hash, occurrence, old_id, new_*, state) of old (id) and new sections of document_id, index, pages.

    Equal hashes of a document match in order, the first stored with the first new one, by their row numbers within a
    hash.  Both sides are dealt by document and hash once; the numbers and the match need no other exchange.
    """
    keys = ["document_id", "content_hash"]
    place = F.struct("index", "start_page", "end_page").alias("place")
    both = old.select(*keys, F.lit("old").alias("side"), "id", place, F.lit(None).cast("string").alias("text"))
    both = both.unionByName(new.select(*keys, F.lit("new").alias("side"), F.lit(None).cast(old.schema["id"].dataType).alias("id"), place, "text"))
    number = F.row_number().over(Window.partitionBy(*keys, "side").orderBy("place.index", "id"))
    of = lambda side, column: F.max(F.when(F.col("side") == side, F.col(column)))  # noqa: E731  one row at most
    both = both.repartition(*keys).withColumn("occurrence", number).groupBy(*keys, "occurrence")
    both = both.agg(of("old", "id").alias("old_id"), of("old", "place").alias("old_place"), of("new", "place").alias("new_place"), of("new", "text").alias("new_text"))
    state = F.when(F.col("old_id").isNull(), "changed").when(F.col("new_place").isNull(), "removed").when(F.col("old_place") == F.col("new_place"), "unchanged").otherwise("reposition")
    return both.withColumn("state", state)


def counters(classified: DataFrame) -> DataFrame:
    """By document: parents_total, parents_unchanged (moved ones too), parents_changed_or_added, parents_removed."""
    count = lambda *states: F.count_if(F.col("state").isin(*states))
    return classified.groupBy("document_id").agg(count("unchanged", "reposition", "changed").alias("parents_total"), count("unchanged", "reposition").alias("parents_unchanged"), count("changed").alias("parents_changed_or_added"), count("removed").alias("parents_removed"))


def apply(classified: DataFrame, old: DataFrame) -> DataFrame:
    """The stored sections after the match: removed ones gone, moved ones in their new place, new ones added.

    What stays keeps its id, and so its children; its text is the new one's, as their hashes are equal.  A new section's
    id is made of its content, its place and the ids that the document had before, so it differs from all of these, even
    where a section of the same content once was in this place and has moved since.
    """
    before = old.groupBy("document_id").agg(F.count("id").alias("held"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("lineage"))
    rows = classified.where("new_place IS NOT NULL").join(before, "document_id", "left")
    lineage = F.when(F.col("held") > 0, F.concat_ws("-", F.col("held").cast("string"), F.col("lineage").cast("string")))
    fresh = stable_id(F.col("document_id"), F.col("new_place.index"), F.col("content_hash"), lineage)
    return rows.select(
        F.coalesce(F.col("old_id").cast("string"), fresh).alias("id"), "document_id", F.col("new_place.index").alias("index"), F.col("new_text").alias("text"), "content_hash",
        F.col("new_place.start_page").alias("start_page"), F.col("new_place.end_page").alias("end_page"),
    )


def surviving_children(classified: DataFrame, children: DataFrame) -> DataFrame:
    """Children whose section wasn't removed."""
    gone = classified.where("state = 'removed'").select(F.col("old_id").alias("parent_id"))
    return children.join(gone, "parent_id", "left_anti")
