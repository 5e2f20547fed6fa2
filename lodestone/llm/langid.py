"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map

#: Buckets of hashed n-grams, the n, the added count, and about how many texts of a language the fit reads.
BITS = 16
SIZES = (1, 2, 3)
ADDED = 0.5
SAMPLE_ROWS = 3000
#: Languages of a model at most: its table has a column for each, and more are an error.
MOST_LANGUAGES = 1000
#: Characters that one pass scores, times languages.
CELLS = 1 << 22

_letters: list[np.ndarray] = []


@dataclass
class LanguageModel:
    """Languages, their log shares, and log probabilities by bucket (a row each) and language."""

    languages: list[str]
    prior: np.ndarray
    table: np.ndarray


def _letter_table() -> np.ndarray:
    """Whether a code point is a letter; built once for each worker."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def _characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts and the text of each; other runs are one space, as are a text's ends."""
    lower = [f" {(t or '').lower()} " for t in texts]
    code = np.frombuffer("".join(lower).encode("utf-32-le", "replace"), np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
    letter = _letter_table()[code]
    first = np.concatenate([[True], of[1:] != of[:-1]])
    keep = letter | first | np.concatenate([[True], letter[:-1]])
    return np.where(letter, code, 32)[keep].astype(np.uint64), of[keep]


def _buckets(code: np.ndarray, of: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: (text, bucket) of the n-grams that start from lo to hi and lie inside one text."""
    for n in SIZES:
        end = min(hi, len(code) - n + 1)
        if end <= lo:
            continue
        hashed = np.full(end - lo, n, np.uint64)
        for k in range(n):
            hashed = (hashed ^ code[lo + k : end + k]) * np.uint64(0x9E3779B97F4A7C15)
        inside = of[lo:end] == of[lo + n - 1 : end + n - 1]
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        yield of[lo:end][inside], (hashed[inside] >> np.uint64(64 - BITS)).astype(np.int64)


def _groups(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` characters together; a longer text stands alone."""
    lo = held = 0
    for n, t in enumerate(texts):
        size = len(t or "")
        if n > lo and held + size > limit:
            yield lo, n
            lo, held = n, 0
        held += size
    if lo < len(texts):
        yield lo, len(texts)


def fit_languages(docs: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Counts n-grams by language on the executors, over about SAMPLE_ROWS texts of each language by a hash of the key.

    Rows with a null text or lang, and those for which ``learn`` isn't true, take no part.  What comes to the driver, and
    is broadcast, has languages * 2**BITS numbers, of MOST_LANGUAGES languages at most.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if learn is None else learn))
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    languages = sorted(counts)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((1 << BITS, 0)))
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(int(min(1.0, SAMPLE_ROWS / counts[name]) * (1 << 30))))])
    sample = rows.where(F.pmod(F.xxhash64(key, F.lit(6)), F.lit(1 << 30)) < share[F.col(lang)])
    place = {name: k for k, name in enumerate(languages)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _groups(texts, CELLS // 4):
                code, of = _characters(texts[lo:hi])
                language = np.array([place[x] for x in names[lo:hi]])
                for row, bucket in _buckets(code, of, 0, len(code)):
                    which = language[row]
                    for k in np.unique(which).tolist():
                        seen.setdefault(k, np.zeros(1 << BITS, np.int64))
                        seen[k] += np.bincount(bucket[which == k], minlength=1 << BITS)
        for k, n in seen.items():
            bucket = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), k, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n[bucket])], names=["lang", "bucket", "n"])

    grams = arrow_map(sample.select(F.col(text).alias("text"), F.col(lang).alias("lang")), work, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((1 << BITS, len(languages)), ADDED)
    for r in grams.toLocalIterator():
        table[r["bucket"], r["lang"]] += r["n"]
    prior = np.array([counts[x] for x in languages], float)
    return LanguageModel(languages, np.log(prior / prior.sum()), np.log(table / table.sum(0)))


def predict_language(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (the posterior of that language), from the whole text.

    A text that is null or has no letter, and any text where nothing was learned, is ``und`` with score 0.  Ties go to
    the language that sorts first.  A long text is scored in passes, so memory follows its characters, not its n-grams.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.table.astype(np.float32)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prior, table = shared.value
        step = max(1024, CELLS // max(1, len(languages)))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            name, score = ["und"] * len(texts), np.zeros(len(texts))
            for lo, hi in _groups(texts, step):
                code, of = _characters(texts[lo:hi])
                total = np.tile(prior, (hi - lo, 1))
                for at in range(0, len(code), step):
                    for row, bucket in _buckets(code, of, at, at + step):
                        if len(row):
                            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                            total[row[first]] += np.add.reduceat(table[bucket], first, axis=0, dtype=np.float64)
                lettered = np.bincount(of, code != 32, minlength=hi - lo) > 0
                if languages and lettered.any():
                    best = total.argmax(1)
                    posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                    for k in np.flatnonzero(lettered).tolist():
                        name[lo + k], score[lo + k] = languages[best[k]], posterior[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), work, f"doc_id {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")
