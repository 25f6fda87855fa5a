"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

*Encoding.*  A token sequence is the BPE encoding of its bytes exactly if every token is its own encoding and every
adjacent pair is the encoding of its two tokens' bytes (no merge ever crosses a boundary).  That makes BPE a
nondeterministic transducer reading bytes left to right: it extends an open token along the vocabulary's prefixes, or
closes it if the pair with the token before is allowed.  Every prefix of the input has exactly one closed hypothesis.
The transducer is determinised as bytes arrive: a state is the set of open hypotheses (open token, token before it), a
transition outputs the token that its byte closes.  A token is emitted when all open hypotheses agree on it; an open
token is no longer than the longest vocabulary entry, so the lookahead, and what is held back, is bounded by that length
whatever the length of the piece.  States and transitions are made when first needed and kept up to a bound.

Text is cut into pieces by the tokenizer's pattern; a piece that is itself a token is that token (the library's rule,
also where merges would not reach it).  Outputs of whole pieces are remembered up to a bound.

*Decoding.*  Ids become bytes that run through an incremental UTF-8 state machine: its state is the unfinished character
(at most three bytes), transitions by whole tokens are derived from those by bytes and remembered.  Ill-formed bytes
become U+FFFD, one for each maximal ill-formed part.

Defined results: a null text counts as empty (no tokens; digests of the empty string); rows that repeat a ``doc_id``
each have their row; a null ``doc_id`` is kept."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from costlens.llm.common import blocks, id_text, on_workers, remembered, small_batches

#: Bounds on what a worker remembers; beyond them it starts anew.
MEMO_STATES = 60_000
MEMO_PIECES = 900_000
#: The same where an executor's workers share their memory with a chain of other operators.
SMALL_STATES = 24_000
SMALL_PIECES = 200_000
#: Ids that the streaming decoder is fed at once.
FEED = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Low bits of a transition hold the next state, the others the token closed.
_STATE_BITS = 24


class Transducer:
    """Bytes of one piece to token ids.

    A state is a number; its hypotheses, longest first, are (bytes of the open token, token before it), the last one just
    closed.  Transitions are numbers by state and byte, so that the tables hold nothing the garbage collector must walk."""

    def __init__(self, ranks: dict[bytes, int], states: int = MEMO_STATES):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.prefixes = {b[:n] for b in ranks for n in range(1, len(b))}  # strictly shorter: can still grow
        self.pairs: dict[int, bool] = {}
        self.own: dict[int, bool] = {}
        self.limit = states
        self.hypotheses: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: dict[int, int] = {}
        self.reset()

    def reset(self) -> None:
        start = ((b"", -1),)
        self.hypotheses[:] = [start]
        self.number.clear()
        self.number[start] = 0
        self.moves.clear()

    def merged(self, data: bytes) -> list[int]:
        """The merges as defined: again and again the leftmost adjacent pair of lowest rank.  Used on two tokens' bytes."""
        never, get = 1 << 60, self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = [get(data[i : i + 2], never) for i in range(len(data) - 1)]
        while rank and (low := min(rank)) < never:
            at = rank.index(low)
            parts[at : at + 2] = (parts[at] + parts[at + 1],)
            del rank[at]
            if at < len(rank):
                rank[at] = get(parts[at] + parts[at + 1], never)
            if at:
                rank[at - 1] = get(parts[at - 1] + parts[at], never)
        return [self.ranks[p] for p in parts]

    def allowed(self, last: int, token: int) -> bool:
        if (own := self.own.get(token)) is None:
            own = self.own[token] = self.merged(self.bytes_of[token]) == [token]
        if last < 0 or not own:
            return own
        pair = last << 32 | token
        if (ok := self.pairs.get(pair)) is None:
            if len(self.pairs) >= 10 * self.limit:
                self.pairs.clear()
            data = self.bytes_of[last] + self.bytes_of[token]
            joined = self.ranks.get(data, -1)  # a token that merges reach would take the place of the two
            ok = (joined < 0 or not self.allowed(-1, joined)) and self.merged(data) == [last, token]
            self.pairs[pair] = ok
        return ok

    def move(self, state: int, byte: int) -> int:
        """Determinises a transition: the token closed by this byte, and the next state, in one number."""
        add, closed, follow = bytes((byte,)), -1, []
        for opened, last in self.hypotheses[state]:
            grown = opened + add
            if grown in self.prefixes:
                follow.append((grown, last))
            if closed < 0:  # exactly one hypothesis can close here
                token = self.ranks.get(grown, -1)
                if token >= 0 and self.allowed(last, token):
                    closed = token
        follow.append((b"", closed))
        key = tuple(follow)
        if (to := self.number.get(key)) is None:
            if len(self.number) >= self.limit:
                self.reset()
                state = -1  # its number now means another state
            to = self.number[key] = len(self.hypotheses)
            self.hypotheses.append(key)
        out = closed << _STATE_BITS | to
        if state >= 0:
            self.moves[state << 8 | byte] = out
        return out

    def back(self, closed: list[int], end: int) -> list[int]:
        """The tokens of the hypothesis that is closed before place ``end``; ``closed[i]``: the one closed by byte i."""
        out = []
        while end:
            token = closed[end - 1]
            out.append(token)
            end -= self.length[token]
        out.reverse()
        return out

    def agreed(self, closed: list[int], state: int) -> list[int]:
        """Tokens that all open hypotheses have in common, from the beginning."""
        paths = [self.back(closed, len(closed) - len(opened)) for opened, _ in self.hypotheses[state]]
        n, least = 0, min(map(len, paths))
        while n < least and all(p[n] == paths[0][n] for p in paths):
            n += 1
        return paths[0][:n]

    def emitted(self, piece: bytes) -> Iterator[int]:
        """Tokens as soon as no open hypothesis disagrees, looked for every few longest tokens' lengths."""
        state, closed, some = 0, [], (1 << _STATE_BITS) - 1
        for byte in piece:
            out = self.moves.get(state << 8 | byte, -1)
            if out < 0:
                out = self.move(state, byte)
            closed.append(out >> _STATE_BITS)
            state = out & some
            if len(closed) > 8 * self.longest:
                ready = self.agreed(closed, state)
                yield from ready
                del closed[: sum(self.length[t] for t in ready)]
        yield from self.back(closed, len(closed))

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 8 * self.longest:
            return list(self.emitted(piece))
        state, closed, some, known = 0, [], (1 << _STATE_BITS) - 1, self.moves.get
        for byte in piece:  # short enough to emit at its end
            out = known(state << 8 | byte)
            if out is None:
                out = self.move(state, byte)
            closed.append(out >> _STATE_BITS)
            state = out & some
        return self.back(closed, len(closed))


class Pieces(dict):
    """Id bytes (little-endian uint32) of a piece of text: the newest half of ``limit``, and the half before them, from
    which pieces that are met again come back."""

    def __init__(self, transducer: Transducer, limit: int = MEMO_PIECES):
        self.encode, self.limit = transducer.encode, limit
        self.former: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if 2 * len(self) >= self.limit:
            self.former = {}  # gone before the others are copied
            self.former = dict(self)
            self.clear()
        out = self.former.get(piece)
        if out is None:
            out = np.array(self.encode(piece.encode()), "<u4").tobytes()
        self[piece] = out
        return out


#: Letters, symbols and white space of texts that the plain form of the common pattern cuts.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_SYMBOLS = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_PLAIN = re.compile(rf"[{_LETTERS}0-9{_SYMBOLS} \t\n\r\x0b\x0c]*")


def plain_form(pattern: str):
    """``pattern`` with its Unicode classes spelled out for plain texts (the standard engine is twice as fast there);
    None if it uses others."""
    classes = (r"[^\s\p{L}\p{N}]", f"[{_SYMBOLS}]"), (r"\p{L}", f"[{_LETTERS}]"), (r"\p{N}", "[0-9]")
    for long_, short in classes:
        pattern = pattern.replace(long_, short)
    return None if r"\p" in pattern else re.compile(pattern).findall


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, states: int = MEMO_STATES, pieces: int = MEMO_PIECES):
        import regex

        self.any, self.plain = regex.compile(pattern).findall, plain_form(pattern)
        self.pieces = Pieces(Transducer(ranks, states), pieces)

    def cut(self, text: str) -> list[str]:
        return self.plain(text) if self.plain and _PLAIN.fullmatch(text) else self.any(text)

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.cut(text))), "<u4")


#: Second bytes that are narrower than 80-BF after these lead bytes (fixed by UTF-8).
_SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


def utf8_step(state: bytes, byte: int) -> tuple[str, bytes]:
    """One byte of the machine: (text completed, unfinished character)."""
    if not state:
        if byte < 0x80:
            return chr(byte), b""
        return ("", bytes((byte,))) if 0xC2 <= byte <= 0xF4 else ("�", b"")
    low, high = _SECOND.get(state[0], (0x80, 0xBF)) if len(state) == 1 else (0x80, 0xBF)
    if not low <= byte <= high:
        text, state = utf8_step(b"", byte)
        return "�" + text, state
    state += bytes((byte,))
    lead = state[0]
    if len(state) < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
        return "", state
    point = lead & (0x1F if lead < 0xE0 else 0x0F if lead < 0xF0 else 0x07)
    for b in state[1:]:
        point = point << 6 | b & 0x3F
    return chr(point), b""


class _Moves(dict):
    """Transitions of one state by token: (text, the next state's transitions)."""

    def __init__(self, state: bytes, all_: dict, bytes_of: dict[int, bytes]):
        self.state, self.all, self.bytes_of = state, all_, bytes_of

    def __missing__(self, token: int) -> tuple[str, _Moves]:
        state, text = self.state, []
        for byte in self.bytes_of[token]:
            out, state = utf8_step(state, byte)
            text.append(out)
        to = self.all.get(state)
        if to is None:
            to = self.all[state] = _Moves(state, self.all, self.bytes_of)
        self[token] = move = ("".join(text), to)
        return move


class Tables:
    """Transitions shared by the decoders of a worker, cleared when too many."""

    def __init__(self, bytes_of: dict[int, bytes], limit: int = 1_000_000):
        self.bytes_of, self.limit = bytes_of, limit
        self.all: dict[bytes, _Moves] = {}
        self.empty = self.all[b""] = _Moves(b"", self.all, bytes_of)

    def begin(self) -> _Moves:
        if sum(map(len, self.all.values())) > self.limit:
            self.__init__(self.bytes_of, self.limit)
        return self.empty


class StreamDecoder:
    """Feed ids in any portions; text comes out as soon as its characters are complete."""

    def __init__(self, tables: Tables):
        self.moves = tables.begin()

    def feed(self, ids: list[int]) -> str:
        out, moves = [], self.moves
        for i in ids:
            text, moves = moves[i]
            out.append(text)
        self.moves = moves
        return "".join(out)

    def finish(self) -> str:
        return "�" if self.moves.state else ""


def coder(path: str, pattern: str, states: int = MEMO_STATES, pieces: int = MEMO_PIECES) -> tuple[Encoder, Tables]:
    """One pair per Python worker, which serves many tasks."""

    def make() -> tuple[Encoder, Tables]:
        ranks = read_ranks(path)
        return Encoder(ranks, pattern, states, pieces), Tables({i: b for b, i in ranks.items()})

    return remembered(("byte-level BPE", path, pattern, states, pieces), make)


def _token_lists(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = coder(path, pattern, SMALL_STATES, SMALL_PIECES)
        for block in blocks(batches):
            ids = [encode(t) for t in block.column("text").to_pylist()]
            upto = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.ListArray.from_arrays(pa.array(upto), pa.array(flat)), pa.array(np.diff(upto), pa.int64())],
                names=["doc_id", "ids", "n_tokens"],
            )

    return run


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, n_tokens of every text.  ``path``: rank file, at one place on every executor."""
    small_batches(docs.sparkSession)
    on_workers(docs.sparkSession)
    return id_text(docs).mapInArrow(_token_lists(path, pattern), "doc_id long, ids array<int>, n_tokens long")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids), by the streaming decoder."""
    small_batches(tokens.sparkSession)
    on_workers(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tables = coder(path, pattern)
        for batch in batches:
            texts = ["".join(_stream(tables, np.asarray(i or [], np.int64))) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _stream(tables: Tables, ids: np.ndarray) -> Iterator[str]:
    decoder = StreamDecoder(tables)
    for at in range(0, len(ids), FEED):
        yield decoder.feed(ids[at : at + FEED].tolist())
    yield decoder.finish()


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tables = coder(path, pattern)
        decimal = [str(i) for i in range(max(tables.bytes_of) + 1)]
        for block in blocks(batches):
            counts, id_digests, text_digests = [], [], []
            for text in block.column("text").to_pylist():
                ids = encode(text)
                named, spelled = hashlib.sha256(), hashlib.sha256()
                for at in range(0, len(ids), FEED):
                    part = ids[at : at + FEED].tolist()
                    named.update(((b"," if at else b"") + ",".join(map(decimal.__getitem__, part)).encode()))
                for out in _stream(tables, ids):
                    spelled.update(out.encode())
                counts.append(len(ids))
                id_digests.append(named.hexdigest())
                text_digests.append(spelled.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 of every row of ``docs``."""
    small_batches(docs.sparkSession)
    on_workers(docs.sparkSession)
    return id_text(docs).mapInArrow(_digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
