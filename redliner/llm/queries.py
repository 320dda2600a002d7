"""The registered queries of the subpackage: one per operator, over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redliner.llm import byte_bpe, gam, huffman, metric_join, packing, pair_index, pseudonyms, setsketch, site_lines, term_pipeline, textcnn, threshold_topk, variants
from redliner.session import workers_find_package


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_huffman_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Start, length and checksum of every document's ids, read back from Huffman-coded files."""
    return huffman.digests(_table(spark, folder, "documents"))


def op2_setsketch_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Shingle count, component and verdict of every document."""
    return setsketch.near_duplicates(_table(spark, folder, "documents"))


def op3_additive_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, folder, "documents")
    return gam.score(docs, gam.fit(docs, _table(spark, folder, "labels")))


def op4_site_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that are boilerplate on their source."""
    return site_lines.drop_boilerplate(_table(spark, folder, "documents")).select("doc_id", "text", "lines_dropped")


def op5_threshold_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best rows of every query vector."""
    return threshold_topk.top_k(_table(spark, folder, "embeddings"))


def op6_text_cnn_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, folder, "documents")
    return textcnn.score(docs, textcnn.fit(docs, _table(spark, folder, "labels")))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's byte-level BPE ids and of the bytes decoded from them."""
    return byte_bpe.digests(_table(spark, folder, "documents"))


def op8_metric_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    return metric_join.near_vectors(_table(spark, folder, "embeddings"))


def op9_bin_completion_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    return packing.pack(_table(spark, folder, "documents"))


def op10_pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with personal values replaced by pseudonyms of the same format."""
    return pseudonyms.pseudonymise(_table(spark, folder, "documents")).select("doc_id", "text", "values_changed")


def op11_pair_index_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's ids by the pair occurrence index and of the text decoded from them."""
    return pair_index.digests(_table(spark, folder, "documents"))


def op12_term_pipeline_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return term_pipeline.rank(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_trie_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word with its form and root among the words one edit apart."""
    return variants.variants(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_huffman_token_files, op2_setsketch_near_dedup, op3_additive_quality, op4_site_line_dedup, op5_threshold_topk, op6_text_cnn_toxicity,
    op7_byte_bpe, op8_metric_near_dedup, op9_bin_completion_packing, op10_pii_pseudonyms,
    op11_pair_index_bpe, op12_term_pipeline_search, op13_trie_spelling_variants,
)}
SQL = {"op4_site_line_dedup": site_lines.oracle(), "op12_term_pipeline_search": term_pipeline.oracle(),
       "op13_trie_spelling_variants": variants.oracle()}
