"""Exact vector search: per-partition top-k in numpy blocks, then one small merge."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2")
#: Numbers of the queries that are broadcast at once; more queries are searched in groups.
QUERY_CELLS = 4_000_000
#: Scores that a task holds at once.
SCORE_CELLS = 4_000_000


def _scores(query: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    dot = query @ rows.T
    if metric == "dot":
        return dot
    q, r = (query * query).sum(1)[:, None], (rows * rows).sum(1)[None, :]
    if metric == "l2":
        return -np.sqrt(np.maximum(q + r - 2 * dot, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(q * r > 0, dot / np.sqrt(q * r), 0.0)


def finite(vector: str | Column) -> Column:
    """A vector that isn't null and has no null, NaN or infinite component."""
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def batch_topk(children: DataFrame, queries: DataFrame | Iterable[tuple[int, Sequence[float]]], k: int, metric: str = "cosine", key: str = "id", vector: str = "embedding") -> DataFrame:
    """Each query's k best rows: query_id, the key, score, rank; ties go to the smaller key.

    Larger is better for every metric (l2 is the negative distance).  Rows without a vector, of another dimension, or
    with a null, NaN or infinite component take no part; such a query has no result.  Each partition gives k rows for
    each query at most, so the merge doesn't grow with the rows.

    Queries are a frame (query id, vector) or pairs of these, of one dimension.  They are read one broadcast's worth
    (QUERY_CELLS numbers) at a time and each such group scans the rows once: a group holds thousands of queries, whose
    scores cost far more than the scan.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    key_type = children.schema[key].dataType.simpleString()
    schema = f"query_id long, {key} {key_type}, score double"
    spark = children.sparkSession
    found = None
    if isinstance(queries, DataFrame):
        asked, asked_vector = queries.columns
        queries = (tuple(r) for r in queries.where(F.col(asked).isNotNull() & finite(asked_vector)).toLocalIterator())
    queries = (q for q in queries if np.isfinite(np.array(q[1], float)).all())
    first = next(queries, None)
    step = max(1, QUERY_CELLS // max(1, len(first[1]))) if first else 1
    queries = chain([first] if first else [], queries)
    while part := list(islice(queries, step)):
        shared = spark.sparkContext.broadcast((np.array([q for q, _ in part]), np.array([v for _, v in part], float)))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, query = shared.value
            best: dict[int, tuple[list, np.ndarray]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(0).to_pylist()
                rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(keys), -1)
                block = max(1, SCORE_CELLS // len(keys))
                for lo in range(0, len(ids), block):
                    scores = _scores(query[lo : lo + block], rows, metric)
                    for n, score in enumerate(scores, lo):
                        cut = np.partition(score, -k)[-k] if len(keys) > k else -np.inf
                        near = np.flatnonzero(score >= cut)
                        held = best.get(n, ([], np.zeros(0)))
                        all_keys, all_scores = held[0] + [keys[j] for j in near], np.concatenate([held[1], score[near]])
                        order = sorted(range(len(all_keys)), key=lambda j: (-all_scores[j], all_keys[j]))[:k]
                        best[n] = [all_keys[j] for j in order], all_scores[order]
            for n, (keys, scores) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[n])] * len(keys), pa.int64()), pa.array(keys, type=pa_type), pa.array(scores)], names=["query_id", key, "score"])

        pa_type = pa.int64() if key_type == "bigint" else pa.int32() if key_type == "int" else pa.string()
        dimension = len(part[0][1])
        near = children.where(finite(vector) & (F.size(vector) == dimension)).select(key, vector).mapInArrow(work, schema)
        found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], schema + ", rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(children: DataFrame, query: Sequence[float], k: int = 5, metric: str = "cosine", key: str = "id", vector: str = "embedding", only: DataFrame | None = None, only_key: str = "document_id") -> DataFrame:
    """The k best rows of one query, best first; ``only`` keeps children of the given documents (default: all)."""
    if only is not None:
        children = children.join(only.select(only_key), only_key, "left_semi")
    return batch_topk(children, [(0, query)], k, metric, key, vector).drop("query_id").orderBy("rank")
