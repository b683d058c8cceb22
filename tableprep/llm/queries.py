"""The named queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableprep.llm.base import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tableprep.llm.pii import find_personal_data
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tableprep.llm.line_dedup import dedup_lines
    return dedup_lines(_table(spark, sf_dir, "documents"), with_text=False)


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tableprep.llm.hyperminhash import near_duplicates
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tableprep.llm.decontaminate import find_leaks
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tableprep.llm.toxicity import score
    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tableprep.llm.langid import identify
    return identify(_table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tableprep.llm.mixing import mix_sources
    table, _ = mix_sources(_table(spark, sf_dir, "documents"))
    return table.select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tableprep.llm.spotsigs import edited_fingerprints
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tableprep.llm.token_blocks import encode_documents
    docs = _table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op10_snapshot_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tableprep.llm.chat import collapse_and_render
    return collapse_and_render(_table(spark, sf_dir, "conversations"))

def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tableprep.llm.divergence import source_divergences
    return source_divergences(_table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tableprep.llm.licenses import scan_licenses
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))  # no Python in its tasks: nothing to ship


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tableprep.llm.trie import prefix_trie
    return prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_bootstrapped_pii": op1_bootstrapped_pii,
    "op2_line_dedup": op2_line_dedup,
    "op3_hyperminhash": op3_hyperminhash,
    "op4_spaced_seeds": op4_spaced_seeds,
    "op5_kneser_ney_toxicity": op5_kneser_ney_toxicity,
    "op6_rank_order_language": op6_rank_order_language,
    "op7_source_mix": op7_source_mix,
    "op8_spot_signatures": op8_spot_signatures,
    "op9_token_blocks": op9_token_blocks,
    "op10_snapshot_chats": op10_snapshot_chats,
    "op11_source_divergence": op11_source_divergence,
    "op12_license_scan": op12_license_scan,
    "op13_prefix_trie": op13_prefix_trie,
}
