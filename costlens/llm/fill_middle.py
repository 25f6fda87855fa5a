"""Fill-in-middle transformation: a text is cut in three and its middle moved to the end, behind sentinels.

Cuts are drawn in tokens (or code points), texts are cut in bytes, and the lengths reported are code points.  A text is
never decoded for that.  Its *exception index* holds the positions of the multibyte characters and the running number of
bytes they take beyond one; between two of them code points and bytes advance alike.  ``searchsorted`` in that index turns
a byte cut into code points and a code-point cut into bytes; a text in ASCII has an empty index and is plain arithmetic.

Whether and how a text is transformed hangs on a keyed hash of its ``doc_id`` alone, so a task that runs again, or another
layout of the table, gives the same rows.

Defined results: a null text counts as empty, an empty text stays plain with 0 tokens; a text that holds a sentinel stays
plain (it could not be restored); a null ``doc_id`` is hashed as the empty string; rows that repeat a ``doc_id`` are cut by
the same numbers, each by its own length; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import blocks, id_text, on_workers, small_batches

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts that could be transformed, so many are; of those, so many put the suffix first (spm).
TRANSFORMED, SUFFIX_FIRST = 50, 80
SEED = "42"
DRAWS = ("_h1", "_h2", "_h3", "_h4")
CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Exceptions:
    """Where characters of more than one byte begin, and how many bytes they take too many."""

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        byte = data[lead]
        extra = 1 + (byte >= 0xE0).astype(np.int64) + (byte >= 0xF0)
        self.total = np.concatenate([[0], np.cumsum(extra)])
        self.bytes = lead
        self.chars = lead - self.total[:-1]

    def to_chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte position (a character's beginning, or the end)."""
        return at - self.total[np.searchsorted(self.bytes, at, side="left")]

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        return at + self.total[np.searchsorted(self.chars, at, side="left")]


def token_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Byte positions at which tokens start: a text's first byte, and white space after anything else.

    The tokens are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`` from left to right.  ``begins``: first
    bytes of the texts that are not empty."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[begins] = True
    return np.flatnonzero(start)


def _holds(data: np.ndarray, ends: np.ndarray, mark: bytes) -> np.ndarray:
    """For each text, whether ``mark`` is in it; ``ends``: the texts' last positions plus one, ascending."""
    at = np.flatnonzero(data == mark[0])
    at = at[at + len(mark) <= len(data)]
    for k in range(1, len(mark)):
        at = at[data[at + k] == mark[k]]
    text = np.searchsorted(ends, at, side="right")
    inside = np.zeros(len(ends), bool)
    inside[text[at + len(mark) <= ends[text]]] = True
    return inside


def _cut(sentinels: tuple[str, str, str], transformed: int, suffix_first: int, unit: str):
    marks = [s.encode() for s in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            column = block.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            held = column.buffers()[2]
            data = np.frombuffer(held if held is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
            edge = offsets - offsets[0]
            begin, end = edge[:-1], edge[1:]
            index = Exceptions(data)
            first_char, last_char = index.to_chars(begin), index.to_chars(end)
            if unit == "token":
                starts = token_starts(data, begin[begin < end])
                first = np.searchsorted(starts, edge, side="left")
                n = np.diff(first)
            else:
                n = last_char - first_char
            h = [block.column(c).to_numpy(zero_copy_only=False) for c in DRAWS]
            low, high = np.minimum(h[0] % (n + 1), h[1] % (n + 1)), np.maximum(h[0] % (n + 1), h[1] % (n + 1))
            if unit == "token":
                place = np.append(starts, len(data))
                cuts = [np.where(k < n, place[first[:-1] + np.minimum(k, np.maximum(n - 1, 0))], end) for k in (low, high)]
            else:
                cuts = [index.to_bytes(first_char + k) for k in (low, high)]
            chars = [index.to_chars(cut) for cut in cuts]
            plain = (begin == end) | (h[2] % 100 >= transformed)
            for mark in marks:
                plain |= _holds(data, end, mark)
            spm = ~plain & (h[3] % 100 < suffix_first)
            whole, out = data.tobytes(), []
            p, s, m = marks
            for i, (a, x, y, z) in enumerate(zip(begin.tolist(), cuts[0].tolist(), cuts[1].tolist(), end.tolist())):
                if plain[i]:
                    out.append(whole[a:z])
                elif spm[i]:
                    out.append(b"".join((s, whole[y:z], p, whole[a:x], m, whole[x:y])))
                else:
                    out.append(b"".join((p, whole[a:x], s, whole[y:z], m, whole[x:y])))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string()),
                    pa.array(chars[0] - first_char, pa.int64(), mask=plain),
                    pa.array(chars[1] - chars[0], pa.int64(), mask=plain),
                    pa.array(out, pa.string()),
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def checked(sentinels: tuple[str, str, str]) -> None:
    """Marks must be findable: none empty, and none may end with what another (or itself) begins with."""
    for a in sentinels:
        for b in sentinels:
            if not a or any(b.startswith(a[i:]) for i in range(1, len(a))) or (a is not b and a in b):
                raise ValueError(f"sentinels {sentinels} overlap or are empty")
    if len(set(sentinels)) < 3:
        raise ValueError(f"sentinels {sentinels} repeat")


def transformed(
    docs: DataFrame,
    seed: str = SEED,
    rate: int = TRANSFORMED,
    suffix_first: int = SUFFIX_FIRST,
    unit: str = "token",
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """doc_id, n (units of the text), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    ``rate`` of 100 documents are transformed, ``suffix_first`` of 100 of those as suffix, prefix, middle; ``unit``:
    token or char, where cuts may fall."""
    if unit not in ("token", "char"):
        raise ValueError(f"unit {unit} is neither token nor char")
    checked(sentinels)
    spark = docs.sparkSession
    small_batches(spark)
    on_workers(spark)
    rows = id_text(docs)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.withColumn("_h", digest)
    draws = [F.conv(F.substring("_h", 1 + 8 * k, 8), 16, 10).cast("long").alias(c) for k, c in enumerate(DRAWS)]
    return rows.select("doc_id", "text", *draws).mapInArrow(_cut(sentinels, rate, suffix_first, unit), CUT)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text, rebuilt from output and form alone."""

    def pieces(marks: tuple[str, str, str]) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(marks[0]) + 1))
        one = F.substring_index(rest, marks[1], 1)
        rest = F.substr(rest, F.length(one) + len(marks[1]) + 1)
        two = F.substring_index(rest, marks[2], 1)
        return one, two, F.substr(rest, F.length(two) + len(marks[2]) + 1)

    p, s, m = sentinels
    prefix, suffix, middle = pieces((p, s, m))
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = pieces((s, p, m))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def round_trip(docs: DataFrame) -> DataFrame:
    """Digests of every document's output and of the text restored from it."""
    digest = [F.sha2(c, 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return transformed(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


_WORDS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
ORACLE = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w,
         sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (
  SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(w) + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS rate, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS spm
  FROM t),
c AS (
  SELECT doc_id, n, text,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR rate >= {TRANSFORMED}
              THEN 'plain' WHEN spm < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(w[1:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(w[greatest(a, b) + 1:], '') AS s
  FROM d)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""
