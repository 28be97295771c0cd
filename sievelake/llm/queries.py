"""The queries of the numbered operators: each applies its operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import chat, crosstok, decontam, fim, langid, line_crf, packing, sharding, simhash, substring, token_counts, toxicity, url_filter
from sievelake.llm._session import is_held_out, shared_dir, table
from sievelake.llm._tokens import Source


def op1_viterbi_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~is_held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


def op2_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_number")


def op3_preference_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_rows(*chat.swapped_answers(table(spark, sf_dir, "conversations")))


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page takes the quality label of the document that it holds."""
    pages = table(spark, sf_dir, "pages")
    mined = url_filter.mine(url_filter.page_labels(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return url_filter.judge(pages, mined)


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.judge(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))


def op8_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the contract's columns: ``spans``, the removed byte ranges, and ``text``, what is left without repeated passages of 50 words too. Any 50
    words take 99 bytes or more, so passages are searched by strings of 96."""
    found = substring.remove_repeated(table(spark, sf_dir, "documents"), passage_bytes=96)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text")


def op9_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", is_held_out())
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


def _tokenizer(name: str, plain: bool = False) -> Source:
    import public_tokenizers

    return Source(public_tokenizers.path(name), plain)


def op11_group_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.align(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json", plain=True), _tokenizer("piece_bpe_32k.model"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.restore(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of a folder of tables lies in the shared folder: who counts the same tables again encodes what is new in them."""
    cache = f"{shared_dir(spark)}/sievelake-token-counts/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), cache)
    return token_counts.over_limit(counted, 4096)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_viterbi_toxicity,
        op2_feistel_sharding,
        op3_preference_prefix,
        op4_simhash_trie,
        op5_best_fit_packing,
        op6_url_association_rules,
        op7_line_crf,
        op8_bwt_repeats,
        op9_simhash_decontamination,
        op10_string_kernel_language,
        op11_group_dictionary,
        op12_fill_in_middle,
        op13_digest_cache,
    ]
    return {f.__name__: f for f in found}
