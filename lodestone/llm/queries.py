"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import ann, dedup, html, langid, licenses, mixing, neardup, packing, pii, toxicity
from lodestone.llm.common import remainder, table, wide_table
from lodestone.llm.licence_texts import LICENCES, NOTICES


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1 and 150 % of all words."""
    return mixing.mix_sources(wide_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by a Jaccard similarity of 0.8 or more of their word 5-grams, in classes."""
    return neardup.jaccard_classes(wide_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with equal texts, white space aside."""
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract_main_text(wide_table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = wide_table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs, remainder(F.col("doc_id"), 3) != 1)
    return langid.predict_language(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each document is, and the notices that it holds."""
    return licenses.scan_licences(wide_table(spark, sf_dir, "documents"))


def _known_texts() -> list[tuple[int, str]]:
    """Every known licence as a document: capitals, another heading, copyright lines above and below it."""
    texts = []
    for n, text in enumerate(LICENCES.values(), 1):
        head, _, rest = text.partition("\n")
        title = f"The {head} ({head.split()[0]})" if head in ("MIT License", "ISC License") else head
        texts.append((-n, f"Copyright Jane Doe {1990 + n}\n{title}\n\n{rest.upper() if n % 2 else rest}\n(c) {2000 + n} J. Doe\n"))
    return texts


def license_texts_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan over all documents and over known licences, which it knows as a whole."""
    rows = F.array(*[F.struct(F.lit(n).cast("long").alias("doc_id"), F.lit(text).alias("text")) for n, text in _known_texts()])
    extra = spark.range(1).select(F.inline(rows))
    return licenses.scan_licences(wide_table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Learns from the labelled documents that aren't held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.fit_toxicity(table(spark, sf_dir, "documents"), labels, remainder(F.col("doc_id"), 5) != 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    scored = toxicity.score_toxicity(wide_table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op9_pack_sequences(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(wide_table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers, dates and addresses replaced by keyed pseudonyms.

    The key is that of ``spark.lodestone.pseudonym.key``; a session without one gets a random key of its own, which its
    later runs share and which goes with it.
    """
    name = "spark.lodestone.pseudonym.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return pii.pseudonymise_documents(wide_table(spark, sf_dir, "documents"), spark.conf.get(name).encode())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_nearest_vectors": op4_nearest_vectors,
    "op5_html_extraction": op5_html_extraction,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "license_texts_scan": license_texts_scan,
    "op8_toxicity": op8_toxicity,
    "op9_pack_sequences": op9_pack_sequences,
    "op10_pseudonyms": op10_pseudonyms,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op3_exact_dedup": dedup.ORACLE,
    "op7_license_scan": licenses.oracle(list((LICENCES | NOTICES).items())),
    "license_texts_scan": licenses.oracle(list((LICENCES | NOTICES).items()), _known_texts()),
}
