"""Corpus pipeline: documents through five corpus operators, stage by stage.

Toxic documents go; of documents equal but for white space one stays; of near copies (five-word shingles, similarity of
0.8 or more, linked groups) one stays; documents that contain a benchmark item go; what is left becomes token ids.

Every stage takes ``(spark, docs, sf_dir)``.  Defined results follow the operators': a null text counts as empty, an
empty table stays empty, extra columns pass through to the last stage, rows without ``doc_id`` are judged where a stage
looks at the text alone (toxicity, decontamination, encoding), go as copies of a text that stays (exact dedup), and stay
where it decides by id (near copies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from costlens.llm import bpe_transducer, decontaminate, exact_dedup, jaccard_join, toxicity
from costlens.llm.common import read
from costlens.llm.queries import tokenizer_file
from costlens.session import scratch_path, scratch_scope


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among them, calls toxic go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the one with the longest original stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar sets of five-word shingles, the one with the smallest id stays."""
    return jaccard_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of every document left."""
    import public_tokenizers

    return bpe_transducer.encoded(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", to_token_ids),
]

#: A trained classifier and token ids are not SQL; ``tests/llm`` hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; each is written to the shared folder and read again by the next one.  A stage's own tables are
    deleted once it is written, so at any time one stage's scratch and the stages' results are held."""
    docs = read(spark, sf_dir, "documents")
    path = scratch_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs
