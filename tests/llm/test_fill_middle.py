"""Fill-in-middle against a plain reading of its rules."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from costlens.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "\t\n ", "one", " one", "one ", "one two  three\n", "a <P> b", "x<S>y", "<M>", "<P", "< P>", "<<P", "a<", "é", "é ü ß", "日本 語 の文 字", "😀 a 😀😀 b",
    " no break wide 　 spaces", "mixed ascii и кириллица 漢字 😀 end", "tail  ", "w " * 5000, "é" * 3000, "漢 字😀 " * 400, "\x00nul \x1f x", "<P <S <M> ",
]


def plain(doc_id, text, unit="token"):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * len(TEXTS) + j, t, "x") for i in range(12) for j, t in enumerate(TEXTS)]
    rows += [(None, "null id one two three", "x"), (None, None, "x"), (5, "one more with id five", "x"), (5, "one more with id five", "x"), (-3, "negative id of é", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, form string")
    return table.withColumn("output", F.lit("clash")).withColumn("_h", F.lit(1)).repartition(5)


@pytest.mark.parametrize("unit", ["token", "char"])
def test_equals_the_rules_and_restores(docs, unit):
    out = fill_middle.transformed(docs, unit=unit).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = sorted(map(tuple, out.collect()), key=str)
    want = sorted(((*plain(r.doc_id, r.text, unit), r.text or "") for r in docs.collect()), key=str)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_exception_index_both_ways():
    text = "aé漢😀b" * 7 + "plain"
    data = np.frombuffer(text.encode(), np.uint8)
    index = fill_middle.Exceptions(data)
    chars = np.arange(len(text) + 1)
    at = np.array([len(text[:k].encode()) for k in chars])
    assert (index.to_bytes(chars) == at).all() and (index.to_chars(at) == chars).all()
    assert len(fill_middle.Exceptions(np.frombuffer(b"ascii only", np.uint8)).bytes) == 0


def test_empty_table_and_odd_parameters(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.round_trip(empty).collect() == []
    for bad in (("", "b", "c"), ("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("ab", "ba", "<M>"), ("<M>", "<S>", "x<M>y")):
        with pytest.raises(ValueError):
            fill_middle.transformed(empty, sentinels=bad)
    with pytest.raises(ValueError):
        fill_middle.transformed(empty, unit="line")


def test_every_document_or_none(docs):
    assert {r.form for r in fill_middle.transformed(docs, rate=0).select("form").collect()} == {"plain"}
    forms = fill_middle.transformed(docs, rate=100, suffix_first=0).collect()
    assert {r.form for r in forms if r.n and "<" not in r.output[1:3]} >= {"psm"}
    assert not [r for r in forms if r.form == "spm"]
