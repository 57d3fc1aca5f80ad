"""The registered queries of this subpackage: each applies one operator to its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, divergence, jaccard_join, langid, media, pages, pieces, pii, sharding, suffix_tree, toxicity, whitening
from riskloom.llm.common import fold_of
from riskloom.sources.tables import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the encoded and decoded text of every document."""
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", RANKS, "decoded"), "doc_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model that never saw a fifth of them."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold_of("doc_id") != 0), "doc_id", "text", "lang")
    return langid.predict(docs.withColumn("held_out", fold_of("doc_id") == 0), "text", model, ["doc_id", "held_out"])


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as an image, read back and hashed."""
    return media.media_features(media.text_images(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document."""
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return decontaminate.digest(found, "doc_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose four-word shingles agree to 0.85 or more."""
    return jaccard_join.group(table(spark, sf_dir, "documents"), "doc_id", "text")


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages"), "page_id", "url", "html").withColumn("n_chars", F.length("text").cast("long"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, "doc_id", "text", toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document lies after two arrivals and compaction, and the hash of its text as read from there."""
    held = sharding.shard(table(spark, sf_dir, "documents"), "doc_id", arrivals=2, facts="stored")
    return held.select("doc_id", *(F.col(f"stored.{c}").alias(c) for c in ("shard", "version", "tier", "shard_rows")), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a suffix tree that never saw a fifth of them."""
    docs = table(spark, sf_dir, "documents")
    model = suffix_tree.fit(docs.where(fold_of("doc_id") != 1), "text")
    model[0].condense()
    told = suffix_tree.score(docs, "doc_id", "text", model)
    return told.select("doc_id", (fold_of("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 32 strongest components of all."""
    rows = table(spark, sf_dir, "embeddings")
    return whitening.transform(rows, "vec_id", "embedding", whitening.fit(rows, "embedding"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the sources of each language, and the terms that set each source apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the pieces of every document and of the text they decode to."""
    return pieces.digest(pieces.encode(table(spark, sf_dir, "documents"), "doc_id", "text", PIECES, "decoded"), "doc_id")


QUERIES = {"op1_byte_bpe": op1_byte_bpe, "op2_language_id": op2_language_id, "op3_page_text": op3_page_text, "op4_media": op4_media, "op5_toxicity": op5_toxicity, "op6_decontamination": op6_decontamination, "op7_pii": op7_pii, "op8_sharding": op8_sharding, "op9_suffix_tree": op9_suffix_tree, "op10_jaccard_join": op10_jaccard_join, "op11_whitening": op11_whitening, "op12_source_divergence": op12_source_divergence, "op13_piece_bpe": op13_piece_bpe}
ORACLES = {"op6_decontamination": decontaminate.ORACLE, "op10_jaccard_join": jaccard_join.ORACLE, "op12_source_divergence": divergence.ORACLE}
