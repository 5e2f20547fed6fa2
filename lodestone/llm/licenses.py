"""Licence scan: whole texts, and single lines, against digests of known licences, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.licence_digests import DIGESTS
from lodestone.llm.licence_texts import LICENCES, NOTICES

#: Spellings that licence matching takes as equal.  Fixed values, from the public SPDX matching guidelines.
WORDS = (
    ("licence", "license"), ("licencing", "licensing"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"), ("organisation", "organization"), ("recognise", "recognize"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
#: The same, of two words, once hyphens are spaces.
PHRASES = (("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("copyright holder", "copyright owner"), ("per cent", "percent"))

#: A line that states a copyright: with a sign, a year, or a name and then a year.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}]*(copyright (\(c\)|©|[0-9])|\(c\)|©|all rights reserved|copyright .{1,80}[^0-9](19|20)[0-9][0-9]([^0-9]|$)).*$"
#: Without any of these a line states none.
COPYRIGHT_MARKS = ("copyright", "(c)", "©", "all rights reserved")
#: A licence's heading, with or without its article and its short name.
HEADING = r"^(the )?(mit|isc|zlib|bsd 2 clause|bsd 3 clause|bsd zero clause) license( mit| isc)?$"
#: What licences and notices begin with: a copyright statement on the same line ends there.
OPENINGS = "permission is hereby granted|permission to use|redistribution and use|this software is provided|this software is licensed|this work is licensed|licensed under|released under|distributed under|this program is free software|this is free and unencumbered"
#: A copyright statement before one of them, perhaps behind the licence's heading.
COPYRIGHT_CLAUSE = rf"(?s)^((?:(?:the )?(?:mit|isc|zlib|bsd [23]-clause|bsd zero clause) license|mit no attribution)?[^\p{{L}}\p{{N}}]*)(?:copyright (?:\(c\)|©|[0-9])|\(c\)|©|all rights reserved).*?(?=\b(?:{OPENINGS})\b)"
#: Known texts that are broadcast, at most.
MOST_KNOWN = 5000
#: What isn't a letter or a digit.
BETWEEN = r"[^\p{L}\p{N}]+"


def _phrases(plain: Column) -> Column:
    for variant, one in PHRASES:
        plain = F.replace(plain, F.lit(variant), F.lit(one))
    return plain


def canonical_lines(text: Column) -> Column:
    """Lines in lower case and one spelling, words of letters and digits with single spaces; empty for copyright lines.

    Of a line that goes on with a licence or a notice, the copyright statement alone is left out.  What can be done to the
    whole text is; what is done line by line is one step at a time, as a step that names a line twice computes it twice.
    """
    lower, marked = F.lower(text), F.lit(False)
    for mark in COPYRIGHT_MARKS:
        marked = marked | F.contains(lower, F.lit(mark))
    rest = F.transform(F.split(lower, "\n"), lambda line: F.regexp_replace(line, COPYRIGHT_CLAUSE, "$1 "))
    rest = F.transform(rest, lambda line: F.when(line.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(line))
    plain = F.regexp_replace(F.when(marked, F.array_join(rest, "\n")).otherwise(lower), r"[^\p{L}\p{N}\n]+", " ")
    for variant, one in WORDS:
        plain = F.replace(plain, F.lit(variant), F.lit(one))
    lines = F.transform(F.split(plain, "\n"), lambda line: F.trim(line))
    return F.transform(lines, lambda line: F.when(F.length(line) < 40, F.regexp_replace(line, HEADING, "$2 license")).otherwise(line))


def canonical(lines: Column) -> Column:
    """The canonical text of canonical lines."""
    return _phrases(F.array_join(F.filter(lines, lambda line: line != ""), " "))


def known_licences(spark, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, digest) of the given texts; by default, of the known licences, their notices and the full long licences.

    The first name wins where two texts have one canonical form.
    """
    full = DIGESTS if texts is None else {}
    texts = LICENCES | NOTICES if texts is None else texts
    rows = [F.struct(F.lit(name).alias("license_id"), F.lit(n).alias("n"), F.lit(text).alias("text")) for n, (name, text) in enumerate(texts.items())]
    frame = spark.range(1).select(F.inline(F.array(*rows))).select("license_id", "n", F.sha2(canonical(canonical_lines(F.col("text"))), 256).alias("digest"))
    if full:
        digests = [F.struct(F.lit(name).alias("license_id"), F.lit(len(texts) + n).alias("n"), F.lit(digest).alias("digest")) for n, (digest, name) in enumerate(full.items())]
        frame = frame.unionByName(spark.range(1).select(F.inline(F.array(*digests))))
    return frame.groupBy("digest").agg(F.min(F.struct("n", "license_id")).alias("first")).select(F.col("first.license_id").alias("license_id"), "digest")


def scan_licences(docs: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, digest (of the canonical text), license_id (null: no known licence as a whole),
    notices (sorted names of known texts that stand on a line of their own).

    A hash join with the digests of known licences.  Up to MOST_KNOWN of them, counted before, are broadcast, and lines
    are looked up in the same table as a map, which needs no shuffle; of more, lines are joined too.  A null or empty
    text, or one of copyright lines alone, has the digest of the empty text and no licence.
    """
    empty = F.sha2(F.lit(""), 256)
    known = (known_licences(docs.sparkSession) if known is None else known).where(F.col("digest") != empty)
    pairs = [(r["digest"], r["license_id"]) for r in known.limit(MOST_KNOWN + 1).collect()]
    rows = docs.select(F.col(key).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("raw"), canonical_lines(F.coalesce(F.col(text), F.lit(""))).alias("lines"))
    if len(pairs) > MOST_KNOWN:
        return _joined_licences(rows, known)
    by_line = F.create_map(*[F.lit(x) for pair in pairs for x in pair]) if pairs else F.create_map().cast("map<string,string>")
    notices = F.transform("lines", lambda line: F.try_element_at(by_line, F.sha2(_phrases(line), 256)))
    rows = rows.select("doc_id", F.sha2(canonical(F.col("lines")), 256).alias("digest"), F.array_sort(F.array_distinct(F.array_compact(notices))).alias("notices"))
    named = F.broadcast(known.select(F.col("digest").alias("known_digest"), "license_id"))
    return rows.join(named, rows["digest"] == named["known_digest"], "left").select("doc_id", "digest", "license_id", "notices")


def _joined_licences(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``scan_licences`` by joins alone: the notices of a text are found once for all rows that have it."""
    lines = rows.select("raw", F.explode("lines").alias("line")).where("line <> ''").select("raw", F.sha2(_phrases(F.col("line")), 256).alias("digest")).distinct()
    notices = lines.join(known, "digest").groupBy("raw").agg(F.array_sort(F.collect_set("license_id")).alias("notices"))
    whole = rows.select("doc_id", "raw", F.sha2(canonical(F.col("lines")), 256).alias("digest"))
    found = whole.join(known, "digest", "left").join(notices, "raw", "left")
    return found.select("doc_id", "digest", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def oracle(known: list[tuple[str, str]], extra: list[tuple[int, str]] = ()) -> str:
    """DuckDB SQL for ``scan_licences`` with (license_id, text) pairs, of documents and (doc_id, text) pairs."""
    line = f"CASE WHEN regexp_matches(lower(l), '{COPYRIGHT_LINE}') THEN '' ELSE trim(regexp_replace(lower(l), '{BETWEEN}', ' ', 'g'), ' ') END"
    for variant, one in WORDS:
        line = f"replace({line}, '{variant}', '{one}')"
    line = rf"regexp_replace({line}, '{HEADING}', '\2 license')"
    quoted = lambda t: t.replace("'", "''")
    documents = "documents" if not extra else f"(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f"({n}, '{quoted(t)}')" for n, t in extra)}))"

    def phrases(plain: str) -> str:
        for variant, one in PHRASES:
            plain = f"replace({plain}, '{variant}', '{one}')"
        return plain

    lines = f"list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: {line})"
    whole = phrases("array_to_string(list_filter(lines, lambda l: l <> ''), ' ')")
    values = ", ".join(f"({n}, '{quoted(name)}', '{quoted(text)}')" for n, (name, text) in enumerate(known))
    return f"""
WITH t(n, license_id, text) AS (VALUES {values}),
k AS (SELECT digest, arg_min(license_id, n) AS license_id FROM (SELECT n, license_id, sha256({whole}) AS digest FROM (SELECT n, license_id, {lines} AS lines FROM t)) WHERE digest <> sha256('') GROUP BY digest),
m AS (SELECT map(list(digest), list(license_id)) AS names FROM k),
d AS (SELECT doc_id, {lines} AS lines FROM {documents}),
s AS (SELECT doc_id, sha256({whole}) AS digest,
             list_sort(list_distinct(list_filter(list_transform(lines, lambda l: names[sha256({phrases("l")})]), lambda x: x IS NOT NULL))) AS notices FROM d, m)
SELECT s.doc_id, s.digest, k.license_id, s.notices
FROM s LEFT JOIN k ON s.digest = k.digest
"""
