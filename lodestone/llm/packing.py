"""Best-fit packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textvec
from lodestone.llm.common import arrow_map

#: Stems and other words whose ids a worker keeps; when there are more it begins anew.
CACHED_WORDS = 100_000
#: Bytes of text whose words are looked up together.
GROUP_BYTES = 4 << 20
#: Words of Latin letters, perhaps with one mark after them.  Their lower case is that of each letter by itself.
MARKS = ".,!?;:"
PLAIN = rf"^[A-Za-z\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{12F}}\x{{131}}-\x{{24F}}]+[{MARKS}]?$"
#: Pieces of about so many documents are packed by one task.
DOCS_PER_TASK = 100_000
#: Sequences that a task holds open, and pieces that it looks at before it places them, the longest first.
OPEN_BINS = 4096
WINDOW = 8192

_tokenizers: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids of texts, by way of their distinct words.

    It holds for byte-level tokenizers with word ends whose pre-tokenizer never crosses ASCII white space, which their
    normaliser drops: the ids of a text are then those of its words, one after the other.  Arrow splits the texts and
    numbers their distinct words, and numpy lays the ids out again.  Of a PLAIN word the letters are one pre-token and
    the mark another, so its lower-case stem goes to the library's model and the mark's id comes after; other words go
    through the whole library, many in a call.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        self.model = self.inner.model
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelled = {bytewise.pre_tokenize_str(c)[0][0]: c for c in map(chr, range(128)) if c.isalpha()}
        assert all(a == b for a, b in spelled.items())  # ASCII letters stand for themselves
        two = {c.encode(): bytewise.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x80, 0x800))}
        self.bytewise = {data[k]: text[k] for data, text in two.items() for k in (0, 1)}
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.inner.get_vocab().values()) + 1)]
        self.stems: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        self.mark_ids = np.zeros(256, np.int64)
        for mark in MARKS:
            (self.mark_ids[ord(mark)],) = self.inner.encode(mark, add_special_tokens=False).ids

    def _stem(self, stem: str) -> bytes:
        if not stem.isascii():
            stem = stem.encode().decode("latin-1").translate(self.bytewise)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(stem)])

    def _known(self, cache: dict[str, bytes], texts: list[str], again: np.ndarray, make: Callable[[list[str]], Iterable[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct texts, one after the other, and how many each has; those that come again are kept."""
        if len(cache) > CACHED_WORDS:
            cache.clear()
        found = [cache.get(t) for t in texts]
        new = [n for n, f in enumerate(found) if f is None]
        for n, made, kept in zip(new, make([texts[n] for n in new]), again[new].tolist(), strict=True):
            found[n] = made
            if kept:
                cache[texts[n]] = made
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(f) // 4 for f in found], np.int64)

    def _words(self, words: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for distinct words, of which it is known how often they occur."""
        plain = pc.match_substring_regex(words, PLAIN)
        own = words.filter(plain)
        ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset + 1 : own.offset + len(own) + 1]
        mark = self.mark_ids[np.frombuffer(own.buffers()[2], np.uint8)[ends - 1]] if len(own) else np.zeros(0, np.int64)
        stems = pc.utf8_lower(pc.utf8_rtrim(own, characters=MARKS)).dictionary_encode()
        is_plain = plain.to_numpy(zero_copy_only=False)
        stem = stems.indices.to_numpy(zero_copy_only=False)
        flat, size = self._known(self.stems, stems.dictionary.to_pylist(), np.bincount(stem, times[is_plain], len(stems.dictionary)) > 1, lambda new: map(self._stem, new))
        odd = [w.decode("utf-8", "replace") for w in words.filter(pc.invert(plain)).cast(pa.large_binary()).to_pylist()]
        each = lambda new: [np.array(got.ids, "<u4").tobytes() for got in self.inner.encode_batch_fast(new, add_special_tokens=False)]
        odd_flat, odd_size = self._known(self.others, odd, times[~is_plain] > 1, each)

        count = np.empty(len(words), np.int64)
        count[is_plain], count[~is_plain] = size[stem] + (mark > 0), odd_size
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), "<u4")
        taken, at = _ranges(np.cumsum(size)[stem] - size[stem], first[is_plain], size[stem])
        out[at] = flat[taken]
        out[(first[is_plain] + size[stem])[mark > 0]] = mark[mark > 0]
        taken, at = _ranges(np.cumsum(odd_size) - odd_size, first[~is_plain], odd_size)
        out[at] = odd_flat[taken]
        return out, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin; null is empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = lists.flatten().dictionary_encode()
        word = words.indices.to_numpy(zero_copy_only=False)
        flat, size = self._words(words.dictionary, np.bincount(word, minlength=len(words.dictionary)))
        count = size[word]
        ends = np.concatenate([[0], np.cumsum(count)])
        taken, _ = _ranges((np.cumsum(size) - size)[word], ends[:-1], count)
        offsets = lists.offsets.to_numpy(zero_copy_only=False)
        return flat[taken], ends[offsets - offsets[0]]


def _ranges(start: np.ndarray, to: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs of ``count`` that begin at ``start``, and the places from ``to`` on that they go to."""
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(start, count) + step, np.repeat(to, count) + step


def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


_WHITE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def _runs(text: bytes, limit: int) -> list[bytes]:
    """The text cut at white space into runs of about ``limit`` bytes; a word that is longer stays whole."""
    out, at = [], 0
    while len(text) - at > limit:
        m = _WHITE.search(text, at + limit)
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]] if at < len(text) or not out else out


def token_pieces(docs: DataFrame, path: str, length: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document's ids: doc_id, piece, start, length, ids_crc32.  No shuffle; ids stay where they are."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for batch, lo, hi in ((b, *part) for b in batches for part in textvec.slices(b.column(1), GROUP_BYTES)):
            texts, keys = batch.column(1).slice(lo, hi - lo), batch.column(0).slice(lo, hi - lo)
            if hi - lo == 1 and len(whole := texts.cast(pa.binary())[0].as_py() or b"") > GROUP_BYTES:
                texts = pa.array(_runs(whole, GROUP_BYTES), pa.binary())
                parts = [words.encode(texts.slice(k, 1).cast(pa.string()))[0] for k in range(len(texts))]
                ids = np.concatenate(parts)
                starts = np.array([0, len(ids)])
            else:
                ids, starts = words.encode(texts)
            yield _cut(keys, ids, starts)

    def _cut(keys: pa.Array, ids: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        n = len(keys)
        ids = np.insert(ids, starts[1:], end).astype("<u4")  # each document's end id
        starts = starts + np.arange(n + 1)
        count = -(-np.diff(starts) // length)
        of = np.repeat(np.arange(n), count)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        first = starts[of] + piece * length
        last = np.minimum(first + length, starts[of + 1])
        data = memoryview(ids).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        columns = [keys.take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(piece * length), pa.array(last - first), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), pieces, schema)


class OpenBins:
    """Bounded-space best fit: at most ``most`` open bins, found through a bitset keyed by their free space."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.made = size, most, 0, 0
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """Bin and offset for an item: the open bin with the least free space that is enough, else a new one."""
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.size, self.made
            self.made += 1
        if left := free - length:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
        return bin_, self.size - free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_ = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_


def pack(pieces: DataFrame, tasks: int, length: int = 2048, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to pieces: sequences of at most ``length`` ids, no gaps inside.

    Only lengths matter, so narrow rows are dealt by a hash into ``tasks`` even streams, and each stream is packed
    online, in the order of that hash, which reruns repeat; within WINDOW pieces the longest come first.  A task's state
    is its open bins and one window.
    """
    schema = f"{', '.join(f'{n} {t}' for n, t in pieces.dtypes)}, sequence_id long, offset long"

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while (room := WINDOW - sum(b.num_rows for b in held)) <= batch.num_rows:
                yield pa.Table.from_batches([*held, batch.slice(0, room)]).combine_chunks().to_batches()[0]
                held, batch = [], batch.slice(room)
            if batch.num_rows:
                held.append(batch)
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, bins = TaskContext.get().partitionId() << 40, OpenBins(length, open_bins)
        for batch in windows(batches):
            size = batch.column("length").to_numpy()
            order = np.argsort(-size, kind="stable")
            places = np.empty((len(size), 2), np.int64)
            places[order] = [bins.put(n) for n in size[order].tolist()]
            batch = batch.drop_columns(["dealt"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + places[:, 0]), pa.array(places[:, 1])], names=[*batch.schema.names, "sequence_id", "offset"])

    dealt = pieces.withColumn("dealt", F.xxhash64("doc_id", "piece", "ids_crc32"))
    return arrow_map(dealt.repartition(tasks, "dealt").sortWithinPartitions("dealt", "doc_id", "piece", "start", "length", "ids_crc32"), fit, schema)


def pack_documents(docs: DataFrame, path: str, length: int = 2048, end: int = 0, open_bins: int = OPEN_BINS, docs_per_task: int = DOCS_PER_TASK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids by the tokenizer in ``path`` (special tokens' strings are ordinary text) and the ``end`` id;
    only documents longer than ``length`` are cut.  A null text is empty: its document is the ``end`` id alone.  Null
    and repeated keys are packed like others.  Streams have about ``docs_per_task`` documents each, so their number
    follows the input.
    """
    tasks = max(1, -(-docs.count() // docs_per_task))
    return pack(token_pieces(docs, path, length, end, key, text), tasks, length, open_bins)
