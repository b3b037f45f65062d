"""The queries of this subpackage, each applying its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.llm import ann_search, embedding_dedup, html_extract, language_id, mixing, packing, quality_rules, secret_scan, simhash, substring_dedup, url_filter, vector_codes, whitening
from wavemill.llm.common import table


def op1_language_id(spark, sf_dir):
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op2_entropy_balancing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("mark")


def op3_hilbert_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash_pivots(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_host_suffix_array(spark, sf_dir):
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op6_prefix_free_parsing(spark, sf_dir):
    return substring_dedup.remove_repeated_strings(table(spark, sf_dir, "documents"))


def op7_itq_dedup(spark, sf_dir):
    return embedding_dedup.embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_multi_index(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return ann_search.nearest_neighbours(rows, rows.where("vec_id % 100 = 0"))


def op9_secret_scan(spark, sf_dir):
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op10_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op11_jacobi_whitening(spark, sf_dir):
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_delta_lloyd(spark, sf_dir):
    out = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", *(F.col(c).try_cast("long").alias(c) for c in ("error", "label_error")), "codebooks_sha256")


def op13_line_first_cleaning(spark, sf_dir):
    return quality_rules.clean_lines(table(spark, sf_dir, "documents")).drop("text")


def whitening_deviations(spark, sf_dir):
    """What of op11's result is exact: its first component's count and deviation."""
    return op11_jacobi_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


def mixing_targets(spark, sf_dir):
    """What the mix is held to: the columns of op2's result that don't depend on whole copies."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def secret_counts(spark, sf_dir):
    """How many base spans of each kind op9 finds."""
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_entropy_balancing": op2_entropy_balancing,
    "op3_hilbert_packing": op3_hilbert_packing,
    "op4_simhash_pivots": op4_simhash_pivots,
    "op5_host_suffix_array": op5_host_suffix_array,
    "op6_prefix_free_parsing": op6_prefix_free_parsing,
    "op7_itq_dedup": op7_itq_dedup,
    "op8_multi_index": op8_multi_index,
    "op9_secret_scan": op9_secret_scan,
    "op10_url_filter": op10_url_filter,
    "op11_jacobi_whitening": op11_jacobi_whitening,
    "op12_delta_lloyd": op12_delta_lloyd,
    "op13_line_first_cleaning": op13_line_first_cleaning,
    "whitening_deviations": whitening_deviations,
    "mixing_targets": mixing_targets,
    "secret_counts": secret_counts,
}
ORACLE_SQL = {
    "op6_prefix_free_parsing": substring_dedup.ORACLE_SQL,
    "op7_itq_dedup": embedding_dedup.ORACLE_SQL,
    "op10_url_filter": url_filter.ORACLE_SQL,
    "op12_delta_lloyd": vector_codes.ORACLE_SQL,
    "op13_line_first_cleaning": quality_rules.ORACLE_SQL,
    "whitening_deviations": whitening.DEVIATIONS_SQL,
    "mixing_targets": mixing.TARGETS_SQL,
    "secret_counts": secret_scan.COUNTS_SQL,
}
