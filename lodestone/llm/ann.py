"""Nearest neighbours by inner product: inverted lists, scanned by blocks of rotated dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, cut
from lodestone.llm.streams import groups

#: Vectors that the index is fitted on, and queries that its probes are set by.
SAMPLE_ROWS = 20_000
TRIALS = 256
#: Lists: the square root of the number of vectors, up to this.
MOST_LISTS = 4096
#: Share of true neighbours that the probed lists hold in the sample.
RECALL = 0.97
#: Lists that a query scans first, for the distance which the others must beat.
FIRST = 3
#: Vectors and queries of one scan; dimensions of one block; standard deviations of the test that abandons a candidate.
VECTORS, QUERIES, STEP, DEVIATIONS = 1024, 1024, 16, 3.0


@dataclass
class Index:
    """Largest component, squared length of the longest vector in that unit, rotation, centroids (rotated) and how many
    lists a query probes."""

    unit: float
    longest: float
    rotation: np.ndarray
    centres: np.ndarray
    probes: int

    def place(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated points whose distances order as inner products do: a last dimension evens out the candidates' lengths."""
        x = vectors.astype(np.float64) / self.unit
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0.0))
        return (np.column_stack([x, last]) @ self.rotation).astype(np.float32)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def _nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(points[lo : lo + 4096], centres).argmin(1) for lo in range(0, len(points), 4096)]) if len(points) else np.zeros(0, int)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def fit_index(vectors: DataFrame, rows: int, size: int, unit: float, longest: float, k: int, seed: int = 4) -> Index:
    """Rotation, k-means centroids and probes from about SAMPLE_ROWS vectors, taken by a hash of their id.

    Probes grow until the lists that the sample's queries probe hold RECALL of their true neighbours in the sample;
    neighbours there are farther than among all vectors, so the share is higher then.
    """
    random = np.random.default_rng(seed)
    rotation = np.linalg.qr(random.standard_normal((size + 1, size + 1)))[0]
    share = int(min(1.0, SAMPLE_ROWS / max(rows, 1)) * (1 << 30))
    sample = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(1 << 30)) < share).select("vec_id", "x").orderBy("vec_id").toArrow()
    raw = _matrix(sample.column("x").combine_chunks(), size) if sample.num_rows else np.zeros((0, size), np.float32)
    index = Index(unit, longest, rotation, np.zeros((1, size + 1), np.float32), 1)
    lists = max(1, min(MOST_LISTS, int(rows**0.5), len(raw)))
    if lists < 2:
        return index
    points = index.place(raw)
    centres = points[random.choice(len(points), lists, replace=False)].copy()
    for _ in range(10):
        own = _nearest_centre(points, centres)
        count = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centres, np.float64)
        np.add.at(sums, own, points)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres).astype(np.float32)
    own = _nearest_centre(points, centres)
    trial = random.choice(len(points), min(TRIALS, len(points)), replace=False)
    query = index.place(raw[trial], query=True)
    near = _distances(query, points)
    near[np.arange(len(trial)), trial] = np.inf
    k = max(1, min(k, len(points) - 1))
    best = np.argpartition(near, k - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(_distances(query, centres), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[best], 1).ravel())
    index.centres, index.probes = centres, min(lists, int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1)
    return index


def scan(query: np.ndarray, vectors: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that may be nearer than each query's limit (a squared distance), block by block.

    After d of D rotated dimensions, a partial distance times D / d estimates the whole one; a pair is abandoned when
    that lies so far above the limit that the whole one is below it with small probability only.  Few pairs left are
    followed one by one, many as a matrix.
    """
    size = query.shape[1]
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    part = np.zeros((len(query), len(vectors)), np.float32)
    for lo in range(0, size, STEP):
        hi = min(lo + STEP, size)
        a, b = query[:, lo:hi], vectors[:, lo:hi]
        bound = limit * (1.0 + 1e-5 if hi == size else hi / size * (1 + DEVIATIONS / hi**0.5) ** 2) + 1e-5
        if pairs is None:
            part += np.maximum(_distances(a, b), 0)
            alive = part <= bound[:, None]
            if hi < size and alive.mean() > 0.1:
                continue
            pairs = np.nonzero(alive)
            kept = part[pairs]
        else:
            kept = kept + ((a[pairs[0]] - b[pairs[1]]) ** 2).sum(1)
            alive = kept <= bound[pairs[0]]
            pairs, kept = (pairs[0][alive], pairs[1][alive]), kept[alive]
    return pairs


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k nearest found: query_id, rank (from 1), vec_id, score (inner product in double precision).

    ``queries`` has rows of the same form; a query isn't its own candidate.  Ties go to the smaller vec_id.  Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do those with a null key or with another
    number of components than most have.  Rows that share a key are candidates each.

    Floats are kept as such and other numbers as doubles; scores are of the vectors as they are.  All vectors are indexed.  A list of any size is cut into blocks of about VECTORS, the queries that probe it into
    blocks of about QUERIES, and each pair of blocks is one unit of work; a query first scans FIRST lists, and the
    others only give what beats the k-th best of those.  A query probes more lists where these hold fewer than k + 1.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" == queries.schema[vector].dataType.simpleString() else "array<double>"
    x = F.col(vector).cast(kind)
    finite = F.forall(F.col("x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def usable(frame: DataFrame) -> DataFrame:
        return frame.select(F.col(key).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda v: v != 0))

    good = usable(vectors)
    largest = F.array_max(F.transform("x", lambda v: F.abs(v.cast("double"))))
    sizes = good.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("rows"), F.max(largest).alias("unit")).orderBy(F.desc("rows"), "size").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    size, rows, unit = sizes[0]
    good, asked = good.where(F.size("x") == size), usable(queries).where(F.size("x") == size)
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.pow(v.cast("double") / F.lit(unit), F.lit(2.0)))
    index = fit_index(good, rows, size, unit, good.agg(F.max(square)).first()[0], k)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _nearest_centre(shared.value.place(_matrix(batch.column("x"), size)), shared.value.centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["vec_id", "x", "list"])

    listed = cut(arrow_map(good, assign, f"vec_id long, x {kind}, list int"))
    held = np.zeros(len(index.centres), np.int64)
    for r in listed.groupBy("list").count().collect():  # one row per list, MOST_LISTS at most
        held[r["list"]] = r["count"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            order = np.argsort(_distances(index.place(_matrix(batch.column("x"), size), query=True), index.centres), axis=1, kind="stable")
            enough = (np.cumsum(held[order], axis=1) < k + 1).sum(1) + 1
            count = np.minimum(np.maximum(index.probes, enough), order.shape[1])
            probed = pa.array([o[:n] for o, n in zip(order.astype(np.int32), count, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, probed], names=["vec_id", "x", "lists"])

    probing = cut(arrow_map(asked, probe, f"vec_id long, x {kind}, lists array<int>"))
    first = _scan_lists(listed, probing.select("vec_id", "x", F.explode(F.slice("lists", 1, FIRST)).alias("list"), F.lit(None).cast("double").alias("least")), shared, held, size, k)
    first = cut(_best(first, k))
    least = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("least")).alias("least"))
    rest = probing.where(F.size("lists") > FIRST).join(least, "vec_id", "left").select("vec_id", "x", F.explode(F.slice("lists", FIRST + 1, len(index.centres))).alias("list"), "least")
    second = _scan_lists(listed, rest, shared, held, size, k)
    return _best(first.drop("rank").unionByName(second), k).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scan_lists(listed: DataFrame, asking: DataFrame, shared, held: np.ndarray, size: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best at most of each query in each unit of work."""
    spark = listed.sparkSession
    asked = {r["list"]: r["count"] for r in asking.groupBy("list").count().collect()}  # one row per list
    plan = [(int(c), int(-(-held[c] // VECTORS)), int(-(-n // QUERIES))) for c, n in asked.items() if held[c]]
    if not plan:
        return spark.createDataFrame([], "query_id long, vec_id long, score double")
    blocks = F.broadcast(spark.createDataFrame(plan, "list int, parts int, turns int"))  # MOST_LISTS rows at most
    to = lambda of, n: F.pmod(F.xxhash64(F.col(of), F.lit(7)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = listed.join(blocks, "list").select("list", to("vec_id", "parts").alias("part"), each("turns").alias("turn"), F.lit(0).alias("kind"), "vec_id", F.lit(None).cast("double").alias("least"), "x")
    right = asking.join(blocks, "list").select("list", each("parts").alias("part"), to("vec_id", "turns").alias("turn"), F.lit(1).alias("kind"), "vec_id", "least", "x")
    rows = left.unionByName(right).repartition("list", "part", "turn").sortWithinPartitions("list", "part", "turn", "kind", "vec_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch, lo, hi in groups(batches, ["list", "part", "turn"]):
            group = batch.slice(lo, hi - lo)
            kind = group.column("kind").to_numpy()
            at = int(np.searchsorted(kind, 1))
            if at in (0, len(kind)):
                continue
            raw, ids = _matrix(group.column("x"), size), group.column("vec_id").to_numpy()
            vectors, query = raw[:at], raw[at:]
            own, asking = ids[:at], ids[at:]
            least = group.column("least").to_numpy(zero_copy_only=False)[at:]
            placed, wanted = index.place(vectors), index.place(query, query=True)
            length = ((query.astype(np.float64) / index.unit) ** 2).sum(1)
            out: tuple[list, list, list] = ([], [], [])
            best = np.where(np.isnan(least), -np.inf, least)
            kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo_ in range(0, at, 512):  # the limit tightens from one part of the block to the next
                limit = np.where(np.isinf(best), np.inf, length + index.longest - 2 * (best / index.unit / index.unit))
                q, v = scan(wanted, placed[lo_ : lo_ + 512], limit)
                v = v + lo_
                score = np.einsum("ij,ij->i", query[q].astype(np.float64), vectors[v].astype(np.float64))
                fine = (score >= best[q]) & (own[v] != asking[q])
                kept.append((q[fine], v[fine], score[fine]))
                q, v, score = (np.concatenate(c) for c in zip(*kept, strict=True))
                order = np.lexsort((own[v], -score, q))
                q, v, score = q[order], v[order], score[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                top = place < k
                kept = [(q[top], v[top], score[top])]
                full = place == k - 1
                best[q[full]] = np.maximum(best[q[full]], score[full])
            for column, value in zip(out, (asking[kept[0][0]], own[kept[0][1]], kept[0][2]), strict=True):
                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    return arrow_map(rows, work, "query_id long, vec_id long, score double")
