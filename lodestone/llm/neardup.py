"""N-gram Jaccard self-join by chosen paths: sets that share sampled tokens meet in small buckets and are compared there."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textvec
from lodestone.llm.common import arrow_map, cut, discard
from lodestone.llm.graph import components
from lodestone.llm.streams import groups

#: Sampled tokens of a set (min-wise hashes).  The first ones begin the runs; at least SPLITS others split on.
SKETCH = 64
SPLITS = 16
#: A bucket of at most so many sets is compared as it is; a larger one is split again, down to this depth, unless it
#: holds more than the share ALIKE of the bucket that it comes from: then its sets are too alike for splits.
LEAF = 256
DEPTH = 3
ALIKE = 0.5
#: Sets, and 8-byte shingles, of one side of a comparison task.
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
#: Bytes of texts that are hashed together; their shingles take a few times 8 bytes for each word.
PASS_BYTES = 1 << 20
#: Share of equal sampled tokens below the threshold at which two sets are no candidates (over 4 standard deviations).
SLACK = 0.22
#: Where a task compares fewer pairs than this share of all, it does so one by one, else by matrix products.
FEW = 0.02

_FACTORS = textvec.mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def run_count(threshold: float, recall: float) -> int:
    """Runs after which a link at the threshold is missed with a chance of 1 - recall at most, however deep its buckets.

    A link stays together in a bucket at depth d with probability threshold**d.
    """
    runs = math.ceil(math.log(1 - recall) / math.log(1 - threshold**DEPTH)) if threshold < 1 else 1
    if runs > SKETCH - SPLITS:
        raise ValueError(f"{SKETCH - SPLITS} runs miss more than {1 - recall:.2g} of the links at a similarity of {threshold}, which takes {runs}")
    return runs


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, text_key, text) to doc_id, text_key, w1 and w2 (a 128-bit hash of the word sequence), size (shingles) and
    sketch (null without words)."""
    schema = "doc_id long, text_key long, w1 long, w2 long, size int, sketch array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, hi - lo) for whole in batches for lo, hi in textvec.slices(whole.column("text"), PASS_BYTES)):
            of, word = textvec.word_hashes(batch.column("text"))
            n = batch.num_rows
            of_shingle, shingle = textvec.shingles(of, word, words)
            count = np.bincount(of_shingle, minlength=n)
            full = np.flatnonzero(count)
            first = (np.cumsum(count) - count)[full]
            out = np.empty((len(full), SKETCH), np.uint32)
            step = 1 << 18
            whole = np.zeros((2, n), np.uint64)
            if len(full):
                ends = np.append(first[1:], len(shingle))
                lo = 0
                while lo < len(full):  # whole texts, about ``step`` shingles at a time
                    hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + step, "right")))
                    part, at = shingle[first[lo] : ends[hi - 1]], first[lo:hi] - first[lo]
                    for j in range(SKETCH):
                        out[lo:hi, j] = np.minimum.reduceat(((part * _FACTORS[j]) >> np.uint64(32)).astype(np.uint32), at)
                    place = np.arange(len(part), dtype=np.uint64) - np.repeat(at.astype(np.uint64), np.diff(np.append(at, len(part))))
                    for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                        whole[k, full[lo:hi]] = np.add.reduceat(textvec.mix(part ^ (place * np.uint64(salt))), at)
                    lo = hi
            offsets = np.zeros(n + 1, np.int32)
            offsets[1:] = np.cumsum((count > 0) * SKETCH)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.reshape(-1).view(np.int32)), mask=pa.array(count == 0))
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(whole[0].view(np.int64)), pa.array(whole[1].view(np.int64)), pa.array(count.astype(np.int32)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "w1", "w2", "size", "sketch"])

    return arrow_map(docs.select("doc_id", "text_key", "text"), work, schema)


def chosen_paths(nodes: DataFrame, runs: int) -> DataFrame:
    """(node, size, sketch) to the buckets of two or more sets: node, run, path, blocks.

    A run splits all sets on a sampled token, buckets of over LEAF sets on another one, and so on; a path's own hash
    samples the token that splits it.  A bucket that stays large is compared all the same.  ``blocks`` is how many of a
    task's blocks a bucket's sets and shingles fill.  Counts combine before the shuffle and are written before the join,
    so that a hot path is a plain skewed exchange, which adaptive execution splits.
    """

    def deeper(path: Column) -> Column:
        return F.xxhash64(path, F.element_at("sketch", (F.pmod(path, F.lit(SKETCH - runs)) + runs + 1).cast("int")))

    each = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.xxhash64(F.lit(r), F.element_at("sketch", r + 1)).alias("p1")) for r in range(runs)])).alias("p")
    rows = nodes.select("node", "size", "sketch", each).select("node", "size", "sketch", "p.*").withColumn("p2", deeper(F.col("p1"))).withColumn("p3", deeper(F.col("p2"))).drop("sketch")
    found, held = None, []
    for depth in range(1, DEPTH + 1):
        path = f"p{depth}"
        counts = cut(rows.groupBy(path).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("n > 1"))
        shared = cut(rows.join(counts, path))  # with parent_n from the second depth on
        discard(counts)
        held.append(shared)
        leaf = F.lit(True) if depth == DEPTH else F.col("n") <= LEAF
        if depth > 1:
            leaf = leaf | (F.col("n") > ALIKE * F.col("parent_n"))
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
        leaves = shared.where(leaf).select("node", "run", F.col(path).alias("path"), blocks.alias("blocks"))
        found = leaves if found is None else found.unionByName(leaves)
        rows = shared.where(~leaf).drop("total", "parent_n").withColumnRenamed("n", "parent_n")
        if depth == DEPTH or rows.isEmpty():
            break
    made = cut(found)
    discard(*held)
    return made


def _tasks(rows: DataFrame) -> DataFrame:
    """Rows of buckets dealt to (path, low, high), which meet every pair of a bucket's blocks once, and sorted."""
    block = F.pmod(F.xxhash64(F.col("node"), F.lit(17)), F.col("blocks")).cast("int")
    dealt = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    return dealt.repartition("path", "low", "high").sortWithinPartitions("path", "low", "high", "node")


def _forest(node: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict[int, int]:
    """Each node of the linked pairs (by place) that isn't the smallest of its component here, with that one."""
    parent = np.arange(len(node))
    changed = True
    while changed:  # labels fall to the smallest place; nodes are in order
        low = np.minimum(parent[left], parent[right])
        before = parent.copy()
        np.minimum.at(parent, left, low)
        np.minimum.at(parent, right, low)
        parent = parent[parent]
        changed = not np.array_equal(before, parent)
    used = np.unique(np.concatenate([left, right]))
    used = used[parent[used] != used]
    return dict(zip(node[used].tolist(), node[parent[used]].tolist(), strict=True))


def _fresh(run: int, paths: np.ndarray, side: np.ndarray, across: bool) -> np.ndarray:
    """Pairs (upper half) that this task is the first to meet: of both blocks, and in no bucket of an earlier run."""
    n = len(paths)
    pairs = np.triu(np.ones((n, n), bool), 1)
    if across:
        pairs &= side[:, None] != side[None, :]
    for r in range(run):
        earlier = paths[:, r]
        if (earlier != 0).any():
            pairs &= (earlier[:, None] != earlier[None, :]) | (earlier == 0)[:, None]
    return pairs


def _column(batch: pa.RecordBatch, name: str, lo: int, hi: int) -> np.ndarray:
    return batch.column(name).slice(lo, hi - lo).to_numpy(zero_copy_only=False)


def _wide(batch: pa.RecordBatch, name: str, lo: int, hi: int, width: int) -> np.ndarray:
    return batch.column(name).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def candidates(leaves: DataFrame, nodes: DataFrame, threshold: float, runs: int) -> DataFrame:
    """(node, path, run, blocks, paths): sets that meet a candidate, by agreement of their sketches, for the first time.

    ``paths`` has the node's bucket in each run, 0 without one.
    """
    need = (threshold - SLACK) * SKETCH
    schema = "node long, path long, run int, blocks int, paths array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, picked in _picked(batches):
            yield batch.take(pa.array(picked)).select(["node", "path", "run", "blocks", "paths"])

    def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
        seen, out = None, []
        for batch, lo, hi in groups(batches, ["path", "low", "high"]):
            if batch is not seen:
                if out:
                    yield seen, out
                seen, out = batch, []
            if hi - lo < 2:
                continue
            part, across = _wide(batch, "sketch", lo, hi, SKETCH), batch.column("low")[lo].as_py() != batch.column("high")[lo].as_py()
            same = np.zeros((hi - lo, hi - lo), np.uint8)
            for j in range(SKETCH):
                same += part[:, j, None] == part[None, :, j]
            linked = (same >= need) & _fresh(batch.column("run")[lo].as_py(), _wide(batch, "paths", lo, hi, runs), _column(batch, "block", lo, hi), across)
            out += (lo + np.flatnonzero(linked.any(0) | linked.any(1))).tolist()
        if out:
            yield seen, out

    by_run = F.map_from_entries(F.transform("leaves", lambda x: F.struct(x["run"], x["path"])))
    placed = leaves.groupBy("node").agg(F.collect_list(F.struct("run", "path", "blocks")).alias("leaves"))
    placed = placed.withColumn("by_run", by_run).select("node", "leaves", F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(F.try_element_at("by_run", r), F.lit(0))).alias("paths"))
    rows = placed.join(nodes.select("node", "sketch"), "node").select("node", "paths", "sketch", F.explode("leaves").alias("leaf")).select("node", "paths", "sketch", "leaf.*")
    return arrow_map(_tasks(rows), work, schema)


def verified_links(met: DataFrame, docs: DataFrame, nodes: DataFrame, threshold: float, words: int, runs: int) -> DataFrame:
    """(node, links, star): exact Jaccard similarities of the pairs that meet for the first time in a bucket.

    ``met`` is from ``candidates``; ``nodes`` names the row of ``docs`` whose text is a node's.  A task meets one pair of blocks of one bucket; each of
    its sets gets the number of links that it found and the smallest set that they lead to.  Every pair counts in the
    first run whose bucket holds both, so no pair is written anywhere and none counts twice.
    """
    schema = "node long, links long, star long"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, hi - lo) for whole in batches for lo, hi in textvec.slices(whole.column("text"), PASS_BYTES)):
            of, shingle = textvec.shingles(*textvec.word_hashes(batch.column("text")), words)
            edges = np.searchsorted(of, np.arange(batch.num_rows + 1))
            packed = [np.unique(shingle[lo:hi]).tobytes() for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("paths"), batch.column("leaves"), pa.array(packed, pa.binary())], names=["node", "paths", "leaves", "set"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        for batch, lo, hi in groups(batches, ["path", "low", "high"]):
            node = _column(batch, "node", lo, hi)
            one = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))  # equal rows stand together
            if len(one) < 2:
                continue
            node, own = node[one], [np.frombuffer(batch.column("set")[lo + int(k)].as_buffer(), np.uint64) for k in one]
            across = batch.column("low")[lo].as_py() != batch.column("high")[lo].as_py()
            pairs = _fresh(batch.column("run")[lo].as_py(), _wide(batch, "paths", lo, hi, runs)[one], _column(batch, "block", lo, hi)[one], across)
            left, right = linked_pairs(own, pairs, threshold)
            if not len(left):
                continue
            links = np.bincount(left, minlength=len(node)) + np.bincount(right, minlength=len(node))
            star = _forest(node, left, right)
            for k in np.flatnonzero(links).tolist():
                for column, value in zip(out, (int(node[k]), int(links[k]), star.get(int(node[k]), int(node[k]))), strict=True):
                    column.append(value)
            if len(out[0]) > 50_000:
                yield made(out)
                out = ([], [], [])
        yield made(out)

    def made(out: tuple[list, list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["node", "links", "star"])

    asked = met.groupBy("node").agg(F.collect_set(F.struct("path", "run", "blocks")).alias("leaves"), F.first("paths").alias("paths"))
    asked = asked.join(nodes.select("node", F.col("rep_key").alias("row_key"), F.col("rep_text").alias("text_key")), "node")
    rows = arrow_map(docs.join(asked, ["row_key", "text_key"]).select("node", "paths", "leaves", "text"), sets, "node long, paths array<long>, leaves array<struct<path:long,run:int,blocks:int>>, set binary")
    rows = rows.select("node", "paths", "set", F.explode("leaves").alias("leaf")).select("node", "paths", "set", "leaf.*")
    return arrow_map(_tasks(rows), work, schema)


def linked_pairs(sets: list[np.ndarray], pairs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the given pairs (a matrix), those whose sorted sets have a Jaccard similarity of the threshold or more."""
    size = np.array([len(s) for s in sets], np.int64)
    least, most = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    pairs = pairs & (least >= threshold * most - 1e-9)
    left, right = np.nonzero(pairs)
    if not len(left):
        return left, right
    if len(left) <= max(4, FEW * len(sets) ** 2):
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist(), strict=True)])
    else:
        both = common_counts(sets)[left, right].astype(np.float64)
    good = (1 + threshold) * both >= threshold * (size[left] + size[right]) - 1e-9
    return left[good], right[good]


def common_counts(sets: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Matrix of the numbers of values that different sorted sets have in common; values are looked at by ranges of their hashes."""
    n = len(sets)
    both = np.zeros((n, n), np.float32)  # whole numbers, exact up to 2**24
    parts = max(1, sum(len(s) for s in sets) >> 18)
    edges = [int(k * (1 << 64) // parts) for k in range(1, parts)]
    cuts = [np.concatenate([[0], np.searchsorted(s, np.array(edges, np.uint64)), [len(s)]]).astype(np.int64) for s in sets]
    for k in range(parts):
        own = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        row = np.repeat(np.arange(n), [len(s) for s in own])
        token, place, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = count[place] > 1
        if not shared.any():
            continue
        place = (np.cumsum(count > 1) - 1)[place[shared]]
        order = np.argsort(place, kind="stable")
        place, row = place[order], row[shared][order]
        for lo in range(0, int(place[-1]) + 1, step):
            a, b = np.searchsorted(place, [lo, lo + step])
            part = np.zeros((n, step), np.float32)
            part[row[a:b], place[a:b] - lo] = 1
            both += part @ part.T
    return both


def _free(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column of ``docs`` has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def _text_key(docs: DataFrame, text: str) -> Column:
    return F.xxhash64(docs[text].cast("string"))


def _row_key(docs: DataFrame, key: str, text: str) -> Column:
    """A row's key, or the hash of its text where that is null."""
    return F.coalesce(docs[key].cast("long"), _text_key(docs, text))


def _classes(docs: DataFrame, threshold: float, words: int, recall: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, row_key, text_key, w1, w2), and one row per word sequence: w1, w2, rep_key, rep_text, copies,
    n_links, class_id and whether it leads its class."""
    runs = run_count(threshold, recall)
    base = docs.select(docs[key].cast("long").alias("doc_id"), _row_key(docs, key, text).alias("row_key"), _text_key(docs, text).alias("text_key"), docs[text].cast("string").alias("text"))
    rows = cut(sketches(base, words).withColumn("row_key", F.coalesce("doc_id", "text_key")))
    rep = F.min(F.struct("row_key", "text_key"))
    nodes = rows.where("sketch IS NOT NULL").groupBy("w1", "w2").agg(rep.alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    nodes = cut(nodes.select("w1", "w2", F.col("rep.row_key").alias("node"), F.col("rep.row_key").alias("rep_key"), F.col("rep.text_key").alias("rep_text"), "copies", "size", "sketch"))
    shared = cut(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("node", F.lit(True).alias("shared")))
    if odd := not shared.isEmpty():  # different texts share a key, so hashes of their words are their nodes
        plain = nodes
        nodes = cut(plain.join(shared, "node", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64("w1", "w2", "node")).otherwise(F.col("node"))).drop("shared"))
        discard(plain)
    discard(shared)
    leaves = chosen_paths(nodes, runs)
    met = cut(candidates(leaves, nodes, threshold, runs))
    discard(leaves)
    found = cut(verified_links(met, base, nodes, threshold, words, runs))
    discard(met)
    joined = components(found.select(F.col("node").alias("a"), F.col("star").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("n_links")).join(joined, "node")
    known = nodes.drop("sketch", "size").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = known.withColumn("n_links", F.coalesce("n_links", F.lit(0))).withColumn("class_id", F.col("component")).withColumn("leads", F.col("node") == F.col("component"))
    known = cut(known)
    discard(found, nodes)
    if odd:
        first = known.groupBy("component").agg(F.min(F.struct("rep_key", "rep_text")).alias("first"))
        plain = known.drop("class_id", "leads").join(first, "component")
        known = plain.withColumn("class_id", F.col("first.rep_key")).withColumn("leads", F.struct("rep_key", "rep_text") == F.col("first"))
    return rows.drop("size", "sketch"), known.select("w1", "w2", "rep_key", "rep_text", "copies", "n_links", "class_id", "leads")


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, words: int = 5, recall: float = 0.9999, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, rep_id, copies, n_links.

    Texts are linked when the Jaccard similarity of their sets of word 5-grams is at least ``threshold``.  Words are
    lower-case runs of letters and digits (ASCII punctuation and white space divide); a text of fewer words is one
    shingle of all its words, a text without words (null, empty) links to nothing and is its own class.

    Every row counts by its own text.  rep_id is the smallest key of a row with the same word sequence, copies their
    number; n_links counts the different word sequences that this one links to; class_id is the smallest rep_id of the
    connected component.  A row without a key has a null doc_id; where it comes into rep_id or class_id, a hash of its
    text stands for it.
    """
    rows, known = _classes(docs, threshold, words, recall, key, text)
    found = rows.join(known, ["w1", "w2"], "left")
    return found.select("doc_id", F.coalesce("class_id", "row_key").alias("class_id"), F.coalesce("rep_key", "row_key").alias("rep_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, words: int = 5, recall: float = 0.9999, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that of the smallest key, and of rows that share it that of the
    smallest hash of its text.  Rows that repeat it whole (key and text) go too.  Texts without words all stay."""
    rows, known = _classes(docs, threshold, words, recall, key, text)
    found = rows.join(known, ["w1", "w2"], "left")
    stays = F.coalesce(F.col("leads") & (F.col("row_key") == F.col("rep_key")) & (F.col("text_key") == F.col("rep_text")), F.col("leads").isNull())
    found = cut(found.select("row_key", "text_key", stays.alias("stays"), F.col("leads").isNotNull().alias("worded")))
    a, b = _free(docs, "row_key"), _free(docs, "text_key")
    named = found.select(F.col("row_key").alias(a), F.col("text_key").alias(b), "stays", "worded")
    again = cut(named.where("stays AND worded").groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(a, b))
    gone = named.where("NOT stays").select(a, b)
    same = (_row_key(docs, key, text) == F.col(a)) & (_text_key(docs, text) == F.col(b))
    if again.isEmpty():
        return docs.join(gone, same, "left_anti")
    once = docs.join(again, same).dropDuplicates([a, b]).select(*docs.columns)
    return docs.join(gone.unionByName(again), same, "left_anti").unionByName(once)
