"""Mixing sources to target weights by nested hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, cut, small

#: Bits of a row's hash that decide, and bits that one histogram resolves.
HASH_BITS = 60
LEVEL_BITS = 12
#: Sources that one task puts in order; more are put in order by ranges.
ONE_TASK = 100_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): ``share`` of all words dealt by weight under a cap.

    Sources, in code point order with null last, take the weights in turn.  No target exceeds ``cap`` times its
    source's size; the excess goes to the others by weight until none is above, which is the water level where
    sum(min(cap * size, level * weight)) meets the budget.  Only one row for each different ratio of size and weight
    comes to one task, and only the level to the driver.
    """
    ranked = cut(_ranked(sizes))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("full_at", F.col("most") / F.col("weight"))
    words = ranked.agg(F.sum("source_size")).first()[0] or 0
    steps = ranked.groupBy("full_at").agg(F.sum("most").alias("most"), F.sum("weight").alias("weight"))
    order = Window.orderBy("full_at")
    before = F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("most")
    weight_from = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    steps = steps.select("full_at", ((F.lit(words * float(share)) - before) / weight_from).alias("level"))
    level = steps.where("level <= full_at").agg(F.min_by("level", "full_at")).first()[0]
    target = F.col("most") if level is None else F.least(F.lit(level) * F.col("weight"), F.col("most"))
    return ranked.select("source", "source_size", target.alias("target"))


def _ranked(sizes: DataFrame) -> DataFrame:
    """Sources with their place n, from 0, in code point order with null last; of many sources no task sees all."""
    last = F.col("source").asc_nulls_last()
    if sizes.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return sizes.withColumn("n", F.row_number().over(Window.orderBy(last)) - 1)
    ordered = cut(sizes.repartitionByRange(last).withColumn("part", F.spark_partition_id()))
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # one row per partition
    before = parts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(last)) - 1
    return ordered.withColumn("place", place).join(before, "part").select("source", "source_size", (F.col("before") + F.col("place")).alias("n"))


def _row_hash(key: str, text: str) -> Column:
    """HASH_BITS bits of the key, or of the text where the key is null."""
    row_key = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(row_key), 1, HASH_BITS // 4), 16, 10).cast("long")


def _thresholds(light: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> tuple[DataFrame, int]:
    """One row per source: s, source_size, target, passes, edge, edge_in; and the number of sources.

    Words are summed by source and hash bucket; the bucket that crosses what passes leave of the target is split into
    finer buckets, and so on until it holds one hash value.  That value is taken or left, whichever comes nearer.
    """
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = source_targets(sizes, weights, share, cap).withColumn("passes", passes.cast("long")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    state = cut(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("under", F.lit(0).cast("long")).withColumn("edge", F.lit(None).cast("long")).withColumn("edge_size", F.lit(0).cast("long")))
    sources = state.count()

    for bits in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        open_ = state.where("edge IS NULL AND source_size > 0").select(F.col("source").alias("s"), "prefix", "rest", "under")
        if open_.isEmpty():
            break
        inside = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", HASH_BITS - bits + LEVEL_BITS) == F.col("prefix"))
        buckets = light.join(small(open_, sources), inside).groupBy("s", "rest", "under", F.shiftright("hash", HASH_BITS - bits).alias("bucket"))
        buckets = buckets.agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        crossing = buckets.withColumn("upto", F.col("under") + upto).where(F.col("upto") > F.col("rest"))
        crossing = crossing.groupBy("s").agg(F.min(F.struct("bucket", "upto", "words", "low", "high")).alias("b")).select("s", "b.*")
        found = state.join(small(crossing, sources), F.col("source").eqNullSafe(F.col("s")), "left")
        fresh = F.col("bucket").isNotNull()
        one = fresh & (F.col("low") == F.col("high"))
        state = cut(found.select(
            "source", "source_size", "target", "passes", "rest",
            F.when(fresh, F.col("bucket")).otherwise(F.col("prefix")).alias("prefix"),
            F.when(fresh, F.col("upto") - F.col("words")).otherwise(F.col("under")).alias("under"),
            F.when(one, F.col("low")).otherwise(F.col("edge")).alias("edge"),
            F.when(one, F.col("words")).otherwise(F.col("edge_size")).alias("edge_size"),
        ))
    nearer = F.col("under") + F.col("edge_size") - F.col("rest") < F.col("rest") - F.col("under")
    return state.select(F.col("source").alias("s"), "source_size", "target", "passes", "edge", nearer.alias("edge_in")), sources


def _copies() -> Column:
    more = (F.col("hash") < F.col("edge")) | ((F.col("hash") == F.col("edge")) & F.col("edge_in"))
    return F.col("passes") + F.coalesce(more, F.lit(False)).cast("long")


def _light(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return cut(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), _row_hash(key, text).alias("hash")))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (= copies * size).

    A source whose target is r whole passes and a rest takes each document r times, and once more each document whose
    hash lies under the source's threshold; no row is sorted.  Each level of the search reads only the rows of the
    boundary buckets, from a narrow table of ids, sizes and hashes.

    Size: runs of characters other than white space; null text: 0.  The hash is of the key, or of the text where the
    key is null; rows with equal hashes stand or fall together.  A source without words has target 0.
    """
    light = _light(docs, key, source, text)
    limits, sources = _thresholds(light, weights, share, cap)
    taken = light.join(small(limits, sources), F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", _copies())
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns; texts aren't shuffled where the
    thresholds are few enough to broadcast."""
    limits, sources = _thresholds(_light(docs, key, source, text), weights, share, cap)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source].alias("source"), _row_hash(key, text).alias("hash"))
    rows = rows.join(small(limits, sources), F.col("source").eqNullSafe(F.col("s")))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), _copies().cast("int"))).alias("copy")).select("row.*")


ORACLE = r"""
WITH b AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n
  FROM b GROUP BY source),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM s),
f AS (
  SELECT *, most / weight AS full_at,
         (sum(source_size) OVER () * 1.5::DOUBLE - (sum(most) OVER (ORDER BY most / weight, n ROWS UNBOUNDED PRECEDING) - most))
         / sum(weight) OVER (ORDER BY most / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
l AS (SELECT level FROM f WHERE level <= full_at ORDER BY full_at, n LIMIT 1),
t AS (SELECT source, source_size, coalesce(least((SELECT level FROM l) * weight, most), most) AS target FROM f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest
  FROM t),
c AS (
  SELECT b.doc_id, b.size, p.source_size, p.target, p.passes, p.rest,
         sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS here
  FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN upto <= rest OR (upto - here <= rest AND upto - rest < rest - (upto - here)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
