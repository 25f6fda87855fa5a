"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from costlens.llm import bpe_transducer, centroid_clusters, decontaminate, exact_dedup, fill_middle, jaccard_join, quality, simple8b, suffix_dedup, surrogates, token_counts, toxicity, warc
from costlens.llm.common import read


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Stands in for the secret that a user of the operator passes.
SURROGATE_KEY = "registered-query"


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymised(read(spark, sf_dir, "documents"), SURROGATE_KEY)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_components(read(spark, sf_dir, "documents"), 3, 90)


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    return bpe_transducer.round_trip(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.encoded_corpus(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.clusters(read(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.round_trip(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_surrogates": op2_surrogates,
    "op3_token_counts": op3_token_counts,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_bpe_transducer": op8_bpe_transducer,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_simple8b": op10_simple8b,
    "op11_warc": op11_warc,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_fill_middle": op13_fill_middle,
}
ORACLES: dict[str, str] = {
    "op7_jaccard_join": jaccard_join.oracle(3, 90),
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_warc": warc.ORACLE,
    "op12_centroid_clusters": centroid_clusters.oracle(),
    "op13_fill_middle": fill_middle.ORACLE,
}
