"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from msgloom.llm import ann_graph, conversation_repair, decontaminate, divergence, hilbert_pack, langid_ppm, merkle_manifest, probminhash, rans_ids, suffix_dedup, url_filter, warc_fixity
from msgloom.llm.token_counts import token_counts


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc_fixity.audit(pages, warc_fixity.damaged(pages))


def op2_ann_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann_graph.usable(_table(spark, sf_dir, "embeddings"))
    return ann_graph.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op3_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(_table(spark, sf_dir, "documents"))


def op4_url_bloom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), url_filter.query_rules(spark))


def op5_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_pack.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_langid_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_ppm.identify(_table(spark, sf_dir, "documents"))


def op8_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans_ids.read_ids(*rans_ids.write_ids(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op9_probminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality(_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.tampered_proofs(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(conversation_repair.damaged(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_merkle_fixity, op2_ann_graph_search, op3_suffix_array_repeats, op4_url_bloom_filter, op5_spaced_seed_overlaps, op6_hilbert_packing, op7_langid_ppm, op8_rans_token_ids, op9_probminhash_near_duplicates, op10_token_counts, op11_distribution_divergence, op12_merkle_manifest, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op11_distribution_divergence": divergence.ORACLE_SQL, "op12_merkle_manifest": merkle_manifest.ORACLE_SQL, "op13_conversation_repair": conversation_repair.ORACLE_SQL, "op1_warc_merkle_fixity": warc_fixity.ORACLE_SQL, "op4_url_bloom_filter": url_filter.ORACLE_SQL}
