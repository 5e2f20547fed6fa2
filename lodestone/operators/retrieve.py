"""From hits to context: parents in order of their best hit, with the excerpts that hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import present, trim

#: What stands in for a context that can't be made, and the marks between its parts.
NO_DOCUMENTS = "No relevant document context was found in the knowledge base."
NO_HITS = "No relevant document context was found for this query."
RULE = "\n\n---\n\n"


def ranked_parents(hits: DataFrame) -> DataFrame:
    """(parent_id, rank): each parent once, at its first hit."""
    return hits.groupBy("parent_id").agg(F.min("rank").alias("rank"))


def excerpts(hits: DataFrame) -> DataFrame:
    """(parent_id, rank, snippets): trimmed excerpts in hit order, blank ones dropped, one to a line."""
    text = trim(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.when(present(text), F.struct("rank", text.alias("text")))))
    return hits.groupBy("parent_id").agg(F.min("rank").alias("rank"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("snippets"))


def sections(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent_id, rank, block): hits (rank, parent_id, text) with their parents (id, index, text); missing ones drop out.

    Hits are a top-k, so the join is that of a few rows with a table: Spark broadcasts them by their size.
    """
    found = excerpts(hits).join(parents.select(F.col("id").alias("parent_id"), F.col("index").cast("string").alias("place"), F.col("text").alias("parent_text")), "parent_id")
    block = F.concat(F.lit("Parent section ("), "place", F.lit("):\n"), "parent_text", F.lit("\n\nRelevant child excerpts:\n"), "snippets")
    return found.select("parent_id", "rank", block.alias("block"))


def context(hits: DataFrame, parents: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row: context_text, retrieved_children (hits), retrieved_parents (those found).

    Without any undeleted document, or without any hit, the text is one of two fixed messages.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    made = sections(hits, parents).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), RULE).alias("made"), F.count(F.lit(1)).alias("retrieved_parents"))
    counted = hits.agg(F.count(F.lit(1)).alias("retrieved_children"))
    text = F.when(F.col("retrieved_children") == 0, NO_HITS).otherwise(F.col("made"))
    if documents is not None and documents.where(~F.col("status").eqNullSafe("deleted")).isEmpty():
        return counted.select(F.lit(NO_DOCUMENTS).alias("context_text"), F.lit(0).cast("long").alias("retrieved_children"), F.lit(0).cast("long").alias("retrieved_parents"))
    both = made.unionByName(counted, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("made", "retrieved_parents", "retrieved_children")])
    return both.select(text.alias("context_text"), "retrieved_children", "retrieved_parents")
