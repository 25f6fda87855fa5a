"""Token counts with their cache, Simple-8b token files, byte-level BPE: held against the libraries."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from costlens.llm import simple8b, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
WORD = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    None, "", " ", "\n\t\x0b", "a", "the cat sat on the mat", "the cat sat on the mat", "It's THE end.It''s <|endoftext|> now",
    "<|ENDOFTEXT|>", "é é ́x Ünïcode ñandú, ¿qué? …!", "1234567890 3.14 ²½ Ⅷ", "中文字符 \U0001f600\U0001f600", "a b c",
    "!!!...,,, a.b,c;d", "İstanbul ΣΑΣ ς", "\x00\x1c\x7f control", "x" * 5000, "word " * 5000, "don't we'll I'd 's'", "of%%% the&&& a$$$",
]


def frame(spark, texts):
    rows = [(i * 3 - 5, t, i, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, digest string").repartition(3)


def test_counts_match_the_library_and_the_cache_is_used(spark, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    cache = f"file://{tmp_path}/cache"
    docs = frame(spark, ODD)
    rows = token_counts.token_counts(docs, PIECE, cache).collect()
    want = {i * 3 - 5: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(ODD)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want and len(rows) == len(ODD)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows) and any(r.over_limit for r in rows)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in ODD})
    more = frame(spark, [*ODD, "one new text", "one new text"])
    assert len(token_counts.token_counts(more, PIECE, cache).collect()) == len(ODD) + 2
    assert spark.read.parquet(cache).count() == stored.count() + 1 or spark.read.parquet(cache).count() == len({t or "" for t in ODD}) + 1


def test_counts_take_the_stored_number_and_not_that_of_another_tokenizer(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = frame(spark, ["some text", "some text"])
    token_counts.token_counts(docs, PIECE, cache).collect()
    from pyspark.sql import functions as F

    spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("long")).write.parquet(f"{cache}-2")
    assert {r.n_tokens for r in token_counts.token_counts(docs, PIECE, f"{cache}-2").collect()} == {77}
    assert 77 not in {r.n_tokens for r in token_counts.token_counts(docs, WORD, f"{cache}-2").collect()}


def test_counts_of_nothing(spark):
    assert token_counts.token_counts(frame(spark, ODD).limit(0), PIECE).collect() == []


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3) | st.integers(0, 70000) | st.sampled_from([2**60 - 1, 2**60, 2**53 + 1]), max_size=400))
@settings(max_examples=200, deadline=None)
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words = simple8b.pack(ids)
    assert np.array_equal(simple8b.unpack(words, len(ids)), ids)


def test_simple8b_packs_densely():
    assert len(simple8b.pack(np.ones(6000, np.uint64))) == 100
    assert len(simple8b.pack(np.full(300, 40000, np.uint64))) == 100
    assert len(simple8b.pack(np.full(400, 20000, np.uint64))) == 100


def brute_ids(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORD)
    return [[*model.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


@given(st.lists(st.text(st.characters(codec="utf-8") | st.sampled_from("ab 's.,!?éñ́\t\nİſΣ<|1")), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_give_the_ids_of_the_whole_text(texts):
    encode = simple8b.word_ids(WORD)
    for t in texts:
        assert encode(t.encode()).tolist() == encode.library.encode(t, add_special_tokens=False).ids


def test_full_memos_start_anew():
    encode = simple8b.WordIds(WORD, words=5, pieces=3)
    for t in ODD:
        assert encode((t or "").encode()).tolist() == encode.library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("block", [simple8b.BLOCK_IDS, 50])
def test_token_files(spark, tmp_path, block):
    texts = [*ODD, *(" ".join(random.Random(i).choices(["alpha", "beta", "of", "12"], k=i % 40)) for i in range(60))]
    path = f"file://{tmp_path}/ids"
    simple8b.write_ids(frame(spark, texts), WORD, path, block_ids=block)
    rows = sorted(simple8b.checksums(spark, path).collect(), key=lambda r: r.doc_id)
    start = 0
    for i, ids in enumerate(brute_ids(texts)):
        want = (i * 3 - 5, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert tuple(rows[i]) == want
        start += len(ids)
    assert len(rows) == len(texts)
    parts = sorted((r.file, r.block, r.offset, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in simple8b.read_ids(spark, path).collect())
    assert [x for p in parts for x in p[-1]] == [x for ids in brute_ids(texts) for x in ids]


def test_token_files_of_nothing(spark):
    assert simple8b.encoded_corpus(frame(spark, ODD).limit(0), WORD).collect() == []


def test_token_files_keep_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "b c"), (1, "b c"), (None, "x"), (None, None)], "doc_id long, text string")
    rows = simple8b.encoded_corpus(docs, WORD).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (0, 2), (1, 3), (1, 3)]
    assert sorted(r.start for r in rows)[0] == 0


BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library():
    import tiktoken

    from costlens.llm import bpe_transducer

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_transducer.read_ranks(BYTES), special_tokens={})


LIBRARY = library()


def through(texts):
    from costlens.llm import bpe_transducer as B

    encode, tables = B.coder(BYTES, public_tokenizers.PATTERN)
    for t in texts:
        ids = encode(t)
        assert ids.tolist() == LIBRARY.encode_ordinary(t), t
        assert "".join(B._stream(tables, ids)) == t


@given(st.lists(st.text(st.characters(codec="utf-8") | st.sampled_from("abcdeinrst 's.,!?éñ́\t\n 中文12")), max_size=8))
@settings(max_examples=300, deadline=None)
def test_transducer_equals_the_library(texts):
    through(texts)


def test_transducer_on_odd_and_long_texts():
    rng = random.Random(1)
    long_ = ["".join(rng.choices("abn", k=2000)), "a" * 3000, " " * 999 + "x", "-" * 700, "=+" * 400, "ñandú" * 300, "​" * 200, "ab" * 999, "Aa" * 500]
    through([t or "" for t in ODD] + long_)


def test_small_bounds_change_nothing():
    from costlens.llm import bpe_transducer as B

    ranks = B.read_ranks(BYTES)
    t = B.Transducer(ranks, states=3)
    for text in ("internationalisation", "aaaaaaaaaaaaaaa", "ththththeeee"):
        assert t.encode(text.encode()) == LIBRARY.encode_ordinary(text)


def test_pieces_remembered_stay_within_their_bound():
    """Full memos keep the newer half; pieces that are met again are not encoded again."""
    from costlens.llm import bpe_transducer as B

    made = []

    class Counted:
        @staticmethod
        def encode(piece):
            made.append(piece)
            return list(piece)

    pieces = B.Pieces(Counted, limit=10)
    for i in range(100):
        assert pieces["often"] == np.array(list(b"often"), "<u4").tobytes()
        assert pieces[f"{i}"] == np.array(list(b"%d" % i), "<u4").tobytes()
        assert len(pieces) + len(pieces.former) <= 10
    assert made.count(b"often") == 1


def test_token_lists_take_the_small_memo(monkeypatch):
    """Next to other operators' memory a worker's tables are small: at most a quarter of the pieces of the operator alone."""
    import pyarrow as pa

    from costlens.llm import bpe_transducer as B
    from costlens.llm import common

    monkeypatch.setattr(common, "_memos", {})
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})
    out = list(B._token_lists(BYTES, public_tokenizers.PATTERN)(iter([batch])))
    (encode, _), = common._memos.values()
    assert out[0].column("ids").to_pylist() == [LIBRARY.encode_ordinary("some words")]
    assert encode.pieces.limit <= B.MEMO_PIECES // 4 and encode.pieces.encode.__self__.limit <= B.MEMO_STATES // 2



@given(st.lists(st.integers(0, 50255), max_size=60), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_streaming_decoder_on_any_ids_in_any_portions(ids, step):
    from costlens.llm import bpe_transducer as B

    _, tables = B.coder(BYTES, public_tokenizers.PATTERN)
    decoder = B.StreamDecoder(tables)
    got = "".join(decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)) + decoder.finish()
    assert got == b"".join(tables.bytes_of[i] for i in ids).decode("utf-8", "replace")


@given(st.binary(max_size=40))
@settings(max_examples=500, deadline=None)
def test_utf8_machine(data):
    from costlens.llm import bpe_transducer as B

    state, out = b"", ""
    for b in data:
        text, state = B.utf8_step(state, b)
        out += text
    assert out + ("�" if state else "") == data.decode("utf-8", "replace")


def test_round_trip_query(spark):
    import hashlib

    from costlens.llm import bpe_transducer as B

    docs = frame(spark, ODD)
    rows = {r.doc_id: r for r in B.round_trip(docs, BYTES, public_tokenizers.PATTERN).collect()}
    assert len(rows) == len(ODD)
    for i, t in enumerate(ODD):
        ids = LIBRARY.encode_ordinary(t or "")
        r = rows[i * 3 - 5]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    tokens = B.encoded(docs, BYTES, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in B.decoded(tokens, BYTES, public_tokenizers.PATTERN).collect()} == {i * 3 - 5: t or "" for i, t in enumerate(ODD)}
    assert B.round_trip(docs.limit(0), BYTES, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_files_with_other_rules_equal_the_library(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), simple8b.WordIds(path)
    assert own.cuttable == (name == "word_bpe_49k.json")
    for text in [t or "" for t in ODD] + ["  two  blanks\n\nand lines ", "CASE matters Here"]:
        assert own(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids
