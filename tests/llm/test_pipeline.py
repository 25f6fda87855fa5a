"""The pipeline's stages on the small tables, each against brute force on its own input."""

import os
import re

import pytest

import corpus_pipeline
from costlens.llm import toxicity
from costlens.llm.queries import tokenizer_file
from costlens.session import checkpoint_dir

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6, None, None, "en", 0), (10**6 + 1, "", "s", None, None), (10**6 + 2, " \n", "s", "en", 1), (None, "kept though without id", "s", "en", 3)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, source string, lang string, n_chars long")
    from pyspark.sql import functions as F

    return table.unionByName(odd.select(table.columns)).withColumn("score", F.lit("x")).withColumn("_kept_id", F.lit(1)).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_toxicity_stage_drops_what_the_classifier_rejects(spark, docs):
    out = stage("toxicity")(spark, docs, SF)
    assert out.columns == docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.scored(docs, model).filter("predicted = 1").collect()}
    assert bad and rows(out) == [r for r in rows(docs) if r[docs.columns.index("doc_id")] not in bad]


def test_exact_stage(spark, docs):
    out = stage("exact dedup")(spark, docs, SF)
    best = {}
    for r in docs.collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        rank = (-len(r.text or ""), r.doc_id is None, r.doc_id)
        best[key] = min(best.get(key, rank), rank)
    ids = {b[2] for b in best.values()}
    assert rows(out) == [tuple(r) for r in sorted((r for r in docs.collect() if r.doc_id in ids), key=lambda r: str(tuple(r)))]
    assert out.count() < docs.count() and out.columns == docs.columns


def test_near_copy_stage(spark, docs):
    out = stage("n-gram Jaccard join")(spark, docs, SF)
    found = docs.collect()
    sets = []
    for r in found:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(found)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(found)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(found):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    want = [r for i, r in enumerate(found) if r.doc_id is None or least[find(i)] == r.doc_id]
    assert rows(out) == sorted((tuple(r) for r in want), key=str) and len(want) < len(found)


def test_decontamination_stage(spark, docs):
    out = stage("benchmark decontamination")(spark, docs, SF)
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in docs.collect() if any(f" {i} " in f" {plain(r.text)} " for i in items)}
    assert gone and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - gone


def test_encoding_stage(spark, docs):
    import public_tokenizers
    import tiktoken

    from costlens.llm.bpe_transducer import read_ranks

    ranks = read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(((r.doc_id, r.ids, r.n_tokens) for r in stage("byte-level BPE")(spark, docs, SF).collect()), key=str)
    want = [(r.doc_id, model.encode_ordinary(r.text or "")) for r in docs.collect()]
    assert got == sorted(((d, i, len(i)) for d, i in want), key=str)


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, one in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(one(spark, docs, SF).collect(), one(spark, docs, SF).schema)
    base = checkpoint_dir(spark)
    held = set(os.listdir(base))
    got = corpus_pipeline.run(spark, SF)
    assert rows(got) == rows(docs) and got.count() > 0
    new = {n for n in set(os.listdir(base)) - held if not n.startswith("pipeline-")}
    assert not new, "a stage's own tables are still there"


def test_empty_tables_pass_through(spark, docs):
    nothing = docs.limit(0)
    for name, one in corpus_pipeline.STAGES:
        assert one(spark, nothing, SF).collect() == [], name
