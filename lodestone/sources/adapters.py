"""Adapters to what stands outside: parsers, embedding and generation models."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.sections import PARSED

#: Statuses worth another call.
RETRYABLE = frozenset((429, 500, 502, 503, 504))


@dataclass(frozen=True)
class Settings:
    """What the environment configures.

    ``index_name`` and ``candidates`` are for an index outside; the exact search of ``vector`` needs neither.
    """

    dimensions: int = 768
    batch_size: int = 20
    batch_delay_ms: int = 250
    max_retries: int = 5
    initial_delay_ms: int = 1000
    index_name: str = "vector_index"
    candidates: int = 50
    top_k: int = 5

    @classmethod
    def from_conf(cls, spark: SparkSession) -> Settings:
        """Overrides from ``spark.lodestone.<field>``; a value that is empty or no number keeps the default."""
        found = {}
        for name, default in cls().__dict__.items():
            raw = spark.conf.get(f"spark.lodestone.{name}", None)
            if raw:
                try:
                    found[name] = type(default)(raw)
                except ValueError:
                    continue
        return cls(**found)


class Embedder(Protocol):
    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class Parser(Protocol):
    def __call__(self, content: bytes) -> dict: ...


class Generator(Protocol):
    def __call__(self, contents: list[dict], system: str, temperature: float) -> str: ...


class ServiceError(Exception):
    """A failed call, with its status and the response's headers."""

    def __init__(self, status: int | None, headers: dict | None = None):
        super().__init__(f"status {status}")
        self.status, self.headers = status, headers or {}


def retry_delay_ms(error: Exception, attempt: int, initial: int = 1000, jitter: Callable[[], int] = lambda: random.randrange(500)) -> float:
    """A positive, finite retry-after header (seconds) wins; else the delay doubles, with some jitter."""
    try:
        wait = float(getattr(error, "headers", {}).get("retry-after"))
    except (TypeError, ValueError):
        wait = 0.0
    return wait * 1000 if 0 < wait < float("inf") else initial * 2**attempt + jitter()


def with_retry(call: Callable[[], object], settings: Settings = Settings(), sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], int] = lambda: random.randrange(500)):
    attempt = 0
    while True:
        try:
            return call()
        except Exception as error:
            if getattr(error, "status", None) not in RETRYABLE or attempt >= settings.max_retries:
                raise
            sleep(retry_delay_ms(error, attempt, settings.initial_delay_ms, jitter) / 1000)
            attempt += 1


def embed_texts(texts: Sequence[str], embedder: Embedder, settings: Settings = Settings()) -> list[list[float]]:
    """One call; as many vectors as texts, each of the right dimension."""
    if not texts:
        return []
    vectors = with_retry(lambda: embedder(list(texts)), settings)
    if len(vectors) != len(texts):
        raise ValueError(f"vector count {len(vectors)} for a text count of {len(texts)}")
    for v in vectors:
        if len(v) != settings.dimensions:
            raise ValueError(f"vector dimension {len(v)} in place of {settings.dimensions}")
    return [list(map(float, v)) for v in vectors]


def embed_query(text: str, embedder: Embedder, settings: Settings = Settings()) -> list[float]:
    if not text or not text.strip():
        raise ValueError("a text is required")
    return embed_texts([text], embedder, settings)[0]


def embed_children(children: DataFrame, embedder: Callable[[], Embedder], settings: Settings = Settings(), workers: int | None = None) -> DataFrame:
    """Children with their embedding, batch by batch; vectors stay on the row of their text, so nothing is zipped.

    ``embedder`` makes one client for each task; ``workers`` bounds how many call at a time.
    """
    kinds = children.schema
    rows = children.repartition(workers) if workers else children

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, first = embedder(), True
        for batch in batches:
            vectors: list[list[float]] = []
            texts = batch.column("text").to_pylist()
            for lo in range(0, len(texts), settings.batch_size):
                if not first:
                    time.sleep(settings.batch_delay_ms / 1000)
                first = False
                vectors += embed_texts(texts[lo : lo + settings.batch_size], client, settings)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, "embedding"])

    return rows.mapInArrow(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", embedding array<float>")


def assign_batches(df: DataFrame, key: str, size: int = 20) -> DataFrame:
    """(key, batch): batches of ``size`` in key order, the last one partial.

    Ranks come from range partitions and their counts, so no task sees all rows.
    """
    ordered = df.select(key).repartitionByRange(key).sortWithinPartitions(key)
    rows = ordered.select(key, F.spark_partition_id().alias("part"))
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row per partition, whatever the rows
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return rows.withColumn("place", place).join(before, "part").select(key, F.floor((F.col("before") + F.col("place")) / size).cast("long").alias("batch"))


class HashEmbedder:
    """Unit vectors from a hash of the text: for tests and for runs without a model."""

    def __init__(self, dimensions: int = 768):
        self.dimensions = dimensions

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.random.default_rng(int.from_bytes(sha256(t.encode()).digest()[:8], "little")).standard_normal(self.dimensions)
            out.append((v / np.linalg.norm(v)).tolist())
        return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of uploaded files."""
    return spark.read.format("binaryFile").load(path)


def _first(node: dict, *names: str):
    return next((node[n] for n in names if node.get(n) is not None), None)


def flatten_parsed(doc_id: str, parsed: dict) -> dict:
    """A parser's result, in either spelling of its names, as one row: the tree becomes a preorder list of nodes.

    Nodes below a heading aren't visited.
    """
    pages = []
    for page in parsed.get("pages") or []:
        items = [{"mcid": _first(i, "mcid", "markedContentId", "marked_content_id"), "text": _first(i, "text", "actualText", "actual_text")} for i in _first(page, "textItems", "text_items") or []]
        pages.append({"page_num": _first(page, "pageNum", "pageNumber", "page"), "text": page.get("text"), "text_items": items})
    tree = _first(parsed, "structureTree", "structure_tree") or []
    stack = [(n, 0) for n in reversed(_first(tree, "roots", "children") or [] if isinstance(tree, dict) else tree)]
    nodes = []
    while stack:
        node, depth = stack.pop()
        kind = str(_first(node, "type", "role") or "")
        nodes.append({"seq": len(nodes), "depth": depth, "type": kind, "actual_text": _first(node, "actualText", "actual_text"), "mcids": _first(node, "markedContentIds", "marked_content_ids") or []})
        if not (len(kind) == 2 and kind[0] in "hH" and kind[1] in "123456"):
            stack += [(c, depth + 1) for c in reversed(node.get("children") or [])]
    return {"doc_id": doc_id, "text": parsed.get("text"), "pages": pages, "nodes": nodes}


def parse_files(files: DataFrame, parser: Callable[[], Parser]) -> DataFrame:
    """Files (path, content) as parsed documents, with an error column; ``parser`` makes one parser for each task.

    A file that the parser can't read has its error and nothing else: ingest marks its document as failed, and the
    others go on.
    """

    def read(parse: Parser, path: str, content: bytes) -> dict:
        try:
            return flatten_parsed(path, parse(content)) | {"error": None}
        except Exception as error:  # whatever a parser raises
            return {"doc_id": path, "text": None, "pages": None, "nodes": None, "error": f"{type(error).__name__}: {error}"}

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = parser()
        for frame in frames:
            yield pd.DataFrame([read(parse, path, bytes(content)) for path, content in zip(frame["path"], frame["content"], strict=True)], columns=["doc_id", "text", "pages", "nodes", "error"])

    return files.select("path", "content").mapInPandas(work, PARSED + ", error string")


def json_parser() -> Parser:
    """For files that hold a parser's JSON result already."""
    return lambda content: json.loads(content)
