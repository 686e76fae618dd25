"""One query for each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import (ann, best_fit, fingerprint, langid, mixing, packing, quality_cnn, repair, simhash, substring, toxicity, trie,
                            urls)
from switchyard.llm.common import crc_mod, read_table

#: Hosts whose pages are listed as blocked, URL by URL.
LISTED_HOSTS = r"(^|\.)spam-"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return langid.identify(docs, model, "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def severity_grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 clean, 1 toxic, 2 toxic and of low quality."""
    worse = F.when(F.coalesce(F.col("quality"), F.lit(1)) == 0, 2).otherwise(1)
    return labels.select("doc_id", F.when(F.col("toxic") == 1, worse).when(F.col("toxic") == 0, 0).alias("grade"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, severity (expected grade), grade, p_toxic, toxic (from the threshold of rows kept out of the fit on)."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, severity_grades(read_table(spark, sf_dir, "labels")))
    out = toxicity.severity(docs, model, "doc_id")
    return out.select("doc_id", "severity", "grade", F.col("p_worse").alias("p_toxic"), (F.col("p_worse") >= model.cut).alias("toxic"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    out = substring.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, domain): the rows of ``docs`` that ``labels`` lists; their language is the domain."""
    listed = labels.where("doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(listed, "doc_id", "left_semi").select("doc_id", "text", F.col("lang").alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, posterior, rate, copies."""
    docs = read_table(spark, sf_dir, "documents")
    model = mixing.fit_domains(labelled_domains(docs, read_table(spark, sf_dir, "labels")))
    return mixing.mix(docs, model, None, "doc_id", "source")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.with_digest(packing.pack(read_table(spark, sf_dir, "documents"))).drop("ids")


def quality_network(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    """Network learned from the labelled rows that are not held out."""
    labels = read_table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 3) != 1)
    return quality_cnn.fit(docs, labels)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = read_table(spark, sf_dir, "documents")
    out = quality_cnn.scores(docs, quality_network(spark, docs, sf_dir), "doc_id")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, listed."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(urls.host_of(F.col("url")).rlike(LISTED_HOSTS)).select(urls.canonical(F.col("url")).alias("key"))
    return urls.judge(pages, listed)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of the rebuilt conversations' nodes."""
    return trie.nodes(trie.rebuilt_paths(read_table(spark, sf_dir, "conversations")))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the damaged conversations."""
    return repair.repair(repair.damage(read_table(spark, sf_dir, "conversations")), with_text=False)


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return best_fit.pack(read_table(spark, sf_dir, "documents"), with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_toxicity, op3_substring_dedup, op4_mixing, op5_fingerprint, op6_nearest, op7_packing,
             op8_quality, op9_url_filter, op10_simhash,
             op11_prefix_trie, op12_repair, op13_best_fit]
    return {f.__name__: f for f in found}
