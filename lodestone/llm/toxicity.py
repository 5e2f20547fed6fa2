"""Toxicity: a sentence classifier, regularised by counterfactual swaps of identity terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textvec
from lodestone.llm.common import arrow_map, bounded_batches, cut

#: Buckets of hashed features; how many of them the model weighs at most; by how many standard deviations, after a
#: correction for rare ones, texts of label 1 must have one more often than chance.
BITS = 20
FEATURES = 4096
LEAST = 3.0
#: A word's features: itself, and its first characters (bytes), which stand for inflected forms.
PREFIXES = (4, 5, 6)
#: The fit takes about so many labelled rows of class 0 and of class 1, with their whole texts.
SAMPLE_ROWS = (9_000, 3_000)
#: Of labelled sentences without an identity term, about one in so many gets one as a counterfactual pair.
AUGMENT = 8

#: Terms for groups of people, swapped within a set.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "citizens"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos"), ("femmes", "hommes"), ("musulmans", "chrétiens"), ("frauen", "männer"), ("muslime", "christen"),
)


@dataclass
class ToxicityModel:
    """Weights by feature bucket, and the bias; a sentence's logit is their sum, a text's that of its worst sentence."""

    weights: np.ndarray
    bias: float


def _features(words: textvec.Words) -> np.ndarray:
    """Bucket of each feature of each word; a word too short for a prefix repeats itself as a whole."""
    found = [words.hashes]
    for k in PREFIXES:
        found.append(words.spans(words.start, np.minimum(words.start + k, words.end)) ^ np.uint64(k << 40))
    return np.stack([(f >> np.uint64(64 - BITS)).astype(np.int64) for f in found], 1)


def _terms(groups: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each identity term, sorted, the features of the term that replaces it, and its own."""
    terms = [t for g in groups for t in g]
    other = [g[(i + 1) % len(g)] for g in groups for i in range(len(g))]
    if not terms:
        return np.zeros(0, np.uint64), np.zeros((0, 1 + len(PREFIXES)), np.int64), np.zeros((0, 1 + len(PREFIXES)), np.int64)
    own, swapped = next(textvec.chunks(pa.array(terms))), next(textvec.chunks(pa.array(other)))
    order = np.argsort(own.hashes)
    return own.hashes[order], _features(swapped)[order], _features(own)[order]


def _sample(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of about SAMPLE_ROWS labelled rows, by a hash threshold of their key; and all rows by label."""
    rows = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    take = F.lit(False)
    for label, n in counts.items():
        share = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS[label] / n) * (1 << 30))
        take = take | ((F.col("label") == label) & share)
    # what is broadcast has about sum(SAMPLE_ROWS) pairs of numbers
    return docs.join(F.broadcast(rows.where(take)), "doc_id").select(F.col("label").cast("int").alias("label"), "text"), counts


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, identity: Sequence[Sequence[str]] = IDENTITY_TERMS, penalty: float = 1.0) -> ToxicityModel:
    """Learns from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1; others and nulls take no part).

    ``learn`` is a predicate on doc_id.  Executors count in how many texts of each class a feature occurs; the FEATURES
    that stand out most for label 1 are kept, as are the words of all identity terms, and only sentences with kept features
    come to the driver.  A text scores as its worst sentence, in the fit too: the logistic loss is over texts, and each
    step moves the sentence that is a text's worst just then.

    ``penalty`` weighs the squared differences of scores within counterfactual pairs: each labelled sentence with an
    identity term and the same with the term swapped for another of its set; one in AUGMENT of the others with a term
    put in, and with another one of the set; and each term alone and nothing, as a mention by itself is neutral.

    Without labels of both classes the model gives the share of label 1, 0.5 without any.
    """
    rows, every = _sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, F.lit(True) if learn is None else learn)
    rows = cut(rows)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = 0.5 if not counts else float(next(iter(counts)))
        return ToxicityModel(np.zeros(1 << BITS, np.float32), float(np.log((share + 0.02) / (1.02 - share))))
    kept = np.union1d(_select(rows, counts), _terms(identity)[2][:, 0])
    label, starts, sentences, swaps = _examples(rows, kept, identity)
    weights, bias = _fit(len(kept), label, starts, sentences, counts, every, swaps, penalty)
    table = np.zeros(1 << BITS, np.float32)
    table[kept] = weights
    return ToxicityModel(table, bias)


def _select(rows: DataFrame, counts: dict[int, int]) -> np.ndarray:
    """The FEATURES buckets whose document frequencies are most above chance in class 1."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy()
            for words in textvec.chunks(batch.column("text")):
                found = np.unique(words.text[:, None] << BITS | _features(words))
                for k in (0, 1):
                    seen[k] += np.bincount(found[label[found >> BITS] == k] & ((1 << BITS) - 1), minlength=1 << BITS)
        bucket = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(seen[0][bucket]), pa.array(seen[1][bucket])], names=["bucket", "n0", "n1"])

    n0, n1 = counts[0], counts[1]
    sums = arrow_map(rows, frequencies, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = (F.col("n0") + F.col("n1")) / F.lit(float(n0 + n1))
    score = (F.col("n1") - share * n1 - 1) / F.sqrt(share * (1 - share) * n1 + 1)
    return np.sort([r["bucket"] for r in sums.where(score >= LEAST).orderBy(score.desc(), "bucket").limit(FEATURES).select("bucket").collect()]).astype(np.int64)


def _examples(rows: DataFrame, kept: np.ndarray, identity: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, _Sets, tuple[_Sets, _Sets, np.ndarray]]:
    """Labels of texts with kept features, where their sentences begin, these as sets of features; and counterfactual
    pairs of sentences with the number of times that each occurs.

    A text's number is that of its batch and place in a stored table, so reruns give it again.
    """

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int64)
        place[kept] = np.arange(len(kept))
        terms, swapped, mentions = _terms(identity)
        swapped, mentions = place[swapped], place[mentions]
        for number, batch in enumerate(batches):
            label = batch.column("label").to_numpy()
            out: list[tuple] = []
            for words in textvec.chunks(batch.column("text")):
                own, other, hashes = place[_features(words)], None, words.hashes
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                    hit = terms[at] == hashes
                    other = np.where(hit[:, None], swapped[at], own) if hit.any() else None
                first = np.flatnonzero(np.concatenate([[True], (words.sentence[1:] != words.sentence[:-1]) | (words.text[1:] != words.text[:-1])])) if len(own) else []
                for lo, hi in zip(first, [*first[1:], len(own)], strict=True):
                    of = int(words.text[lo])
                    mine = np.sort(own[lo:hi][own[lo:hi] >= 0]).astype(np.int32).tobytes()
                    theirs = np.sort(other[lo:hi][other[lo:hi] >= 0]).astype(np.int32).tobytes() if other is not None and hit[lo:hi].any() else None
                    drawn = int(hashes[lo])
                    if len(terms) and theirs is None and drawn % AUGMENT == 0:  # the sentence with a term put in, and with another one
                        term = drawn // AUGMENT % len(terms)
                        put = [np.sort(np.concatenate([own[lo:hi][own[lo:hi] >= 0], t[term][t[term] >= 0]])).astype(np.int32).tobytes() for t in (mentions, swapped)]
                        out.append((None, None, *put))
                    if mine or theirs:
                        out.append((int(label[of]), number << 32 | of, mine, theirs))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["label", "text", "own", "other"])

    found = arrow_map(rows, sentences, "label int, text long, own binary, other binary").withColumn("task", F.when(F.col("text").isNotNull(), F.spark_partition_id()))
    found = found.groupBy("task", "text", "label", "own", "other").agg(F.count(F.lit(1)).alias("times"))
    table = found.orderBy("task", "text", "label", "own", "other").toArrow()
    of_texts = table.filter(pc.is_valid(table["label"]))
    task, text = (of_texts[c].to_numpy() for c in ("task", "text"))
    starts = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (text[1:] != text[:-1])])) if len(task) else np.zeros(0, np.int64)
    kind = pa.schema([("own", pa.binary()), ("other", pa.binary()), ("times", pa.int64())])
    pairs = table.select(kind.names).cast(kind).filter(pc.and_(pc.is_valid(table["other"]), pc.not_equal(table["own"], pc.fill_null(table["other"], b""))))
    place = np.full(1 << BITS, -1, np.int64)
    place[kept] = np.arange(len(kept))
    alone = [np.sort(place[m][place[m] >= 0]).astype(np.int32).tobytes() for m in _terms(identity)[2]]
    pairs = pa.concat_tables([pairs, pa.table([pa.array(alone, pa.binary()), pa.array([b""] * len(alone), pa.binary()), pa.array([1] * len(alone), pa.int64())], schema=kind)])
    return of_texts["label"].to_numpy()[starts].astype(float), starts, _sets(of_texts["own"]), (_sets(pairs["own"]), _sets(pairs["other"]), pairs["times"].to_numpy().astype(float))


class _Sets:
    """Sets of features, one after the other; ``sums`` adds up their weights, ``spread`` values by feature."""

    def __init__(self, column: np.ndarray, size: np.ndarray):
        self.column, self.size = column, size
        self.filled = np.flatnonzero(size)
        self.first = np.cumsum(size) - size

    def sums(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.size))
        if len(self.filled):
            out[self.filled] = np.add.reduceat(weights[self.column], self.first[self.filled])
        return out

    def spread(self, value: np.ndarray, features: int) -> np.ndarray:
        """The sum of each feature's sets' values; sets of value 0 aren't looked at."""
        own = np.flatnonzero(value)
        size = self.size[own]
        place = np.repeat(self.first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.column[place], np.repeat(value[own], size), features)


def _sets(column: pa.ChunkedArray) -> _Sets:
    """Sets that are binary values of 32-bit numbers."""
    whole = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[: len(whole) + 1] // 4 if len(whole) else np.zeros(1, np.int64)
    data = whole.buffers()[2]
    return _Sets(np.frombuffer(data, np.int32)[: offsets[-1]] if data is not None and data.size >= 4 else np.zeros(0, np.int32), np.diff(offsets))


def _fit(features: int, label: np.ndarray, starts: np.ndarray, sentences: _Sets, counts: dict[int, int], every: dict[int, int], swaps: tuple[_Sets, _Sets, np.ndarray], penalty: float, steps: int = 600, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression over texts by Adam; texts without kept features count through the bias.

    A text's sentences begin at ``starts``.  Each sampled text stands for as many labelled ones as its class has for
    each sampled one.
    """
    total = len(sentences.size)
    bare = {y: counts[y] - int((label == y).sum()) for y in (0, 1)}
    n = every[0] + every[1]
    stands = {y: every[y] / counts[y] / n for y in (0, 1)}
    weight = np.where(label == 1, stands[1], stands[0])
    own, other, times = swaps
    times = times / max(1, times.sum())
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    weights, bias = np.zeros(features), float(np.log((every[1] + 1) / (every[0] + 1)))
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    for k in range(1, steps + 1):
        gradient = np.append(l2 * weights, bare[0] * stands[0] * sigmoid(bias) + bare[1] * stands[1] * (sigmoid(bias) - 1))
        if total:
            score = sentences.sums(weights) + bias
            worst = np.maximum.reduceat(score, starts)
            at = np.flatnonzero(score == np.repeat(worst, np.diff(np.append(starts, total))))
            owner = np.searchsorted(starts, at, "right") - 1
            wrong = weight * (sigmoid(worst) - label)
            share = np.zeros(total)
            share[at] = (wrong / np.bincount(owner, minlength=len(starts)))[owner]  # ties share their text's step
            gradient[:-1] += sentences.spread(share, features)
            gradient[-1] += wrong.sum()
        if len(times) and penalty:
            a, b = sigmoid(own.sums(weights) + bias), sigmoid(other.sums(weights) + bias)
            for sets, s, sign in ((own, a, 1), (other, b, -1)):
                slope = sign * 2 * penalty * (a - b) * s * (1 - s) * times
                gradient[:-1] += sets.spread(slope, features)
                gradient[-1] += slope.sum()
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        weights, bias = weights - step[:-1], bias - step[-1]
    return weights, float(bias)


def _logits(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Of each text's worst sentence; a text without words has that of an empty sentence."""
    worst = np.full(len(column), -np.inf)
    for words in textvec.chunks(column):
        if len(words.start):
            value = weights[_features(words)].sum(1, dtype=np.float64)
            first = np.flatnonzero(np.concatenate([[True], (words.sentence[1:] != words.sentence[:-1]) | (words.text[1:] != words.text[:-1])]))
            np.maximum.at(worst, words.text[first], np.add.reduceat(value, first))
    return np.where(np.isfinite(worst), worst, 0.0) + bias


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score >= 0.5), from its whole text.

    The score is that of the worst sentence; a text without words (null, empty) gets that of an empty sentence.  The
    broadcast table has 2**BITS numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(_logits(batch.column("text"), weights, bias), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return arrow_map(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), work, f"doc_id {docs.schema[key].dataType.simpleString()}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose whole text scores under 0.5, with all their columns; one pass, no shuffle.

    Only texts go to Python, and only scores come back.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.arrow_udf("double")
    def logit(texts: pa.Array) -> pa.Array:
        return pa.array(_logits(texts, *shared.value))

    return docs.where(logit(docs[text].cast("string")) < 0)
