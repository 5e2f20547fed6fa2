"""Recursive splitting of sections into overlapping passages."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import stable_id, trim, utf16_length
from lodestone.sources.layout import spread

#: Passage size and overlap in UTF-16 units, and separators from coarse to fine.
SIZE, OVERLAP = 800, 120
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")
_SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) if text.isascii() else len(text) + sum(c > "\uffff" for c in text)


class _Splitter:
    """Splits one text; pieces are spans of it, so passages are slices and nothing is joined."""

    def __init__(self, text: str, size: int, overlap: int):
        self.text, self.size, self.overlap = text, size, overlap
        self.wide = not text.isascii() and any(c > "\uffff" for c in text)

    def length(self, lo: int, hi: int) -> int:
        return units(self.text[lo:hi]) if self.wide else hi - lo

    def pieces(self, lo: int, hi: int, separator: str) -> list[tuple[int, int]]:
        """The span cut before each place where the separator stands; it stays at the start of what follows."""
        if not separator:
            return [(k, k + 1) for k in range(lo, hi)]
        out, start, at = [], lo, self.text.find(separator, lo + 1, hi)
        while at >= 0:
            out.append((start, at))
            start, at = at, self.text.find(separator, at + 1, hi)
        return [*out, (start, hi)]

    def passage(self, lo: int, hi: int) -> list[str]:
        text = self.text[lo:hi].strip(_SPACES)
        return [text] if text else []

    def merge(self, pieces: list[tuple[int, int]]) -> Iterator[str]:
        """Neighbouring pieces together up to the size; whole pieces of at most the overlap are carried over."""
        window: deque[tuple[int, int]] = deque()
        total = start = end = 0
        for lo, hi in pieces:
            n = self.length(lo, hi)
            if window and total + n > self.size:
                yield from self.passage(start, end)
                while total > self.overlap or (total + n > self.size and total > 0):
                    start, gone = window.popleft()
                    total -= gone
                    start = window[0][0] if window else lo
            if not window:
                start = lo
            window.append((lo, n))
            total, end = total + n, hi
        if window:
            yield from self.passage(start, end)

    def split(self, lo: int, hi: int, separators: tuple[str, ...]) -> list[str]:
        if self.length(lo, hi) <= self.size:
            return self.passage(lo, hi)
        at = next((k for k, s in enumerate(separators) if not s or self.text.find(s, lo, hi) >= 0), len(separators) - 1)
        rest = separators[at + 1 :] if separators[at] else ()
        out: list[str] = []
        short: list[tuple[int, int]] = []
        for piece in self.pieces(lo, hi, separators[at]):
            if self.length(*piece) < self.size:
                short.append(piece)
                continue
            out += self.merge(short)
            short = []
            out += self.split(*piece, rest) if rest else self.passage(*piece)
        return [*out, *self.merge(short)]


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Passages of at most ``size`` units where separators allow."""
    return _Splitter(text, size, overlap).split(0, len(text), separators)


def child_chunks(parents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Children of parents (id, document_id, text, start_page): id, document_id, parent_id, index, text, page_number.

    The index restarts in each parent; a blank passage is left out, but its index is used up.  A text within the size is
    its own passage; only longer ones go to Python.
    """

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap) if t else None)

    short = utf16_length(F.col("text")) <= size
    found = F.when(short, F.array(F.col("text"))).otherwise(split(F.when(~short, F.col("text"))))
    passages = spread(parents).select(F.col("id").alias("parent_id"), "document_id", "start_page", found.alias("passages"))
    rows = passages.select("parent_id", "document_id", "start_page", F.posexplode("passages").alias("index", "passage")).withColumn("text", trim("passage")).where("text <> ''")
    return rows.select(stable_id(F.col("parent_id"), F.col("index"), F.sha2("text", 256)).alias("id"), "document_id", "parent_id", "index", "text", F.col("start_page").alias("page_number"))


def ingest_counts(parsed: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """(document_id, pages, parent_count, child_count, error): a document without text, parents or children has an error,
    as has one that its parser couldn't read (its ``error``, if parsed rows have that column)."""
    p = parents.groupBy("document_id").agg(F.count(F.lit(1)).alias("parent_count"))
    c = children.groupBy("document_id").agg(F.count(F.lit(1)).alias("child_count"))
    unread = F.col("error") if "error" in parsed.columns else F.lit(None).cast("string")
    rows = parsed.select(F.col("doc_id").alias("document_id"), F.coalesce(F.size("pages"), F.lit(0)).alias("pages"), (trim(F.coalesce("text", F.lit(""))) == "").alias("no_text"), unread.alias("unread"))
    rows = rows.join(p, "document_id", "left").join(c, "document_id", "left").fillna(0, ["parent_count", "child_count"])
    error = F.coalesce("unread", F.when(F.col("no_text"), "no text").when(F.col("parent_count") == 0, "no parents").when(F.col("child_count") == 0, "no children"))
    return rows.select("document_id", "pages", "parent_count", "child_count", error.alias("error"))


def ingest_meta(counts: DataFrame, started: Column, ended: Column, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Counts with what is told of an ingest: child_chunk_size, child_chunk_overlap, processing_ms between two instants."""
    elapsed = F.unix_millis(ended) - F.unix_millis(started)
    return counts.withColumns({"child_chunk_size": F.lit(size), "child_chunk_overlap": F.lit(overlap), "processing_ms": elapsed})
