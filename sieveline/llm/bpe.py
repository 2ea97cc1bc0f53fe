"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The merges (ranks of byte strings) are compiled into a transducer over bytes. A non-deterministic configuration is (node of the
vocabulary trie reached since the last token, that token). Reading a byte moves to the node's child; where that node is a
token which may stand after the last one, the token may be written. Two tokens may stand side by side when the merges,
run on their joined bytes, give just these two; a chain of such pairs is the encoding and there is exactly one, so of the ways to a
place one is left: the token that ends there. The subset construction runs on demand: a deterministic state is the set of
configurations at a place, and a transition, with the token that ends behind it, is built the first time it is needed. All pieces
that aren't tokens themselves go through it, and through nothing else. Tokens are written once all ways from the present place
back run through their end, which the longest token bounds; short pieces are written at their end. States are forgotten, all at
once and between pieces, beyond ``max_states``.

The decoder turns ids into bytes and bytes into text through an incremental UTF-8 state machine: a code point that is split
between tokens or chunks comes out once it is whole; malformed bytes become U+FFFD, one for each longest part that could have begun a
code point. The bytes themselves can be asked for too.

Defined cases: a null or empty text has no tokens; texts of any length are encoded whole, in slices of bounded size; null ids
decode to the empty text; repeated rows, and rows that share an id, are encoded each; an empty table gives no rows; columns of the
input pass through, and one that has the name of an output column is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import drop_names

_ROOT, _NEVER = 0, 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 of the bytes, then the rank, on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(ranks: dict[bytes, int], piece: bytes, stop: int = -1) -> list[int]:
    """The merges themselves, lowest rank first, up to before the token ``stop``; quadratic, for single tokens and tests."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], len(ranks) + 1), i))
        if ranks.get(parts[best] + parts[best + 1], stop) == stop:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """States are tuples of (node, last), oldest begun token first; a move is next state << TOKEN | the token that ends here."""

    TOKEN = 24

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000, flush: int = 256):
        self.ranks, self.max_states, self.flush = ranks, max_states, flush
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size_of = {rank: len(token) for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at, self.depth = [-1], [0]
        for token, rank in ranks.items():
            node = _ROOT
            for b in token:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token_at[node] = rank
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone."""
        self._ids: dict[tuple, int] = {}
        self._sets: list[tuple] = []
        #: By state << 8 | byte.
        self.moves: dict[int, int] = {}
        self._state(((_ROOT, -1),))
        if len(self._fits) > 4 * self.max_states:
            self._fits.clear()

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte and for what merges don't reach."""
        if token not in self._halves:
            parts = merge(self.ranks, self.bytes_of[token], stop=token)
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def fits(self, last: int, token: int) -> bool:
        """Whether the merges leave ``token`` alone after ``last`` (-1: at the start).

        Where two tokens meet, the right edge of the one faces the left edge of the other, at every stage of their merging.
        They stay apart if no facing pair merges before either of the pair is taken up by its own token. Undoing the merge
        that came last leads from each facing pair to the one before it.
        """
        if len(self.bytes_of[token]) > 1 and self.halves(token) is None:
            return False
        if last < 0:
            return True
        a, b, taken_a, taken_b = last, token, _NEVER, _NEVER
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], _NEVER)
            if joined < taken_a and joined <= taken_b and joined < _NEVER:
                return False
            of_a, of_b = self.halves(a), self.halves(b)
            if of_a and (not of_b or a > b):
                a, taken_a = of_a[1], a
            elif of_b:
                b, taken_b = of_b[0], b
            else:
                return True

    def _state(self, configs: tuple) -> int:
        known = self._ids.setdefault(configs, len(self._sets))
        if known == len(self._sets):
            self._sets.append(configs)
        return known

    def _move(self, state: int, b: int) -> int:
        """Determinises one more transition. Configurations stand in the order of where their token begins."""
        reached, whole = [], -1
        children, token_at, known = self.children, self.token_at, self._fits
        for node, last in self._sets[state]:
            nxt = children[node].get(b)
            if nxt is None:
                continue
            if children[nxt]:
                reached.append((nxt, last))
            if whole < 0 and (token := token_at[nxt]) >= 0:
                pair = (last + 1) << 32 | token
                fits = known.get(pair)
                if fits is None:
                    fits = known[pair] = self.fits(last, token)
                if fits:
                    whole = token
        if whole < 0:
            raise ValueError("the vocabulary lacks a byte")
        reached.append((_ROOT, whole))
        step = self.moves[state << 8 | b] = self._state(tuple(reached)) << self.TOKEN | whole
        return step

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece. A piece that is a token is that token, as in the library that reads these files."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self._sets) > self.max_states:
            self.forget()
        out: list[int] = []
        ended: list[int] = []  # the token that ends at each place since what was written out
        state, known, token, mask = 0, self.moves.get, self.TOKEN, (1 << self.TOKEN) - 1
        for b in piece:
            step = known(state << 8 | b)
            if step is None:
                step = self._move(state, b)
            ended.append(step & mask)
            state = step >> token
            if len(ended) > 2 * self.flush:
                self._write(out, ended, self._agreed(ended, state))
        self._write(out, ended, len(ended))
        return out

    def _agreed(self, ended: list[int], state: int) -> int:
        """The last place that every way from here back runs through; 0 is one."""
        places = {len(ended) - self.depth[node] for node, _ in self._sets[state]}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - self.size_of[ended[last - 1]])
        return places.pop()

    def _write(self, out: list[int], ended: list[int], place: int) -> None:
        """Writes the tokens of the way that leads to a place, and forgets the places before it."""
        way, at = [], place
        while at:
            way.append(ended[at - 1])
            at -= self.size_of[way[-1]]
        out += way[::-1]
        del ended[:place]


class _Known(dict):
    """A memo that learns what it is asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: str) -> int:
        n = self[piece] = self.learn(piece, len(self))
        return n


class Encoder:
    """Texts to ids. Pieces seen before come from a memo, as numbers of rows in one flat array of ids.

    The memo is bounded in pieces and in their characters, looked at after each text: what it holds beyond that is one text's.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 400_000, memo_chars: int = 1 << 22):
        self.fst, self.memo, self.memo_chars = Transducer(ranks), memo, memo_chars
        self.split = regex.compile(pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.known, self.chars = _Known(self._learn), 0
        self.flat = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1 << 16, np.int64)

    def _learn(self, piece: str, n: int) -> int:
        ids = self.fst.encode(piece.encode())
        self.chars += len(piece)
        start = int(self.ends[n])
        if start + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat) + len(ids), np.int32)])
        if n + 2 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
        self.flat[start : start + len(ids)] = ids
        self.ends[n + 1] = start + len(ids)
        return n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin and end."""
        done, found = [], []
        for text in texts:
            pieces = self.split(text)
            found.append(np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces)))
            if len(self.known) > self.memo or self.chars > self.memo_chars:
                done.append(self._looked_up(found))
                found = []
                self._clear()
        done.append(self._looked_up(found))
        if len(done) == 1:
            return done[0]
        ends = np.cumsum([0, *(len(ids) for ids, _ in done)])
        return np.concatenate([ids for ids, _ in done]), np.concatenate([[0], *(counts[1:] + end for (_, counts), end in zip(done, ends, strict=False))])

    def _looked_up(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of each text to all ids, and where each text's begin and end."""
        parts = np.concatenate(found) if found else np.empty(0, np.int64)
        begin = self.ends[parts]
        size = self.ends[parts + 1] - begin
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        counts = total[np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)]
        return ids, counts


#: A task takes up the encoder that the one before it left in its Python worker; it depends on the vocabulary alone.
_LAST: dict[tuple, Encoder] = {}


def encoder_of(ranks: dict[bytes, int], pattern: str) -> Encoder:
    key = (pattern, len(ranks), hash(frozenset(ranks.items())))
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Encoder(ranks, pattern)
    return _LAST[key]


def _utf8_rows() -> tuple[list[int], list[list[int]]]:
    """Classes of bytes, and the state after each class. 0: between code points, 1: malformed; the others name what must follow.

    The byte after E0, ED, F0 and F4 has a smaller range, which leaves out overlong forms, surrogates and what is too large.
    """
    starts = {"2": (0xC2, 0xDF), "E0": (0xE0, 0xE0), "3": (0xE1, 0xEC), "ED": (0xED, 0xED), "3b": (0xEE, 0xEF), "F0": (0xF0, 0xF0), "4": (0xF1, 0xF3), "F4": (0xF4, 0xF4)}
    #: By state: the range of the next byte, and the state after it.
    after = {2: (0x80, 0xBF, 0), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 2), 5: (0x80, 0x9F, 2), 6: (0x80, 0xBF, 3), 7: (0x90, 0xBF, 3), 8: (0x80, 0x8F, 3)}
    begins = {"2": 2, "E0": 4, "3": 3, "ED": 5, "3b": 3, "F0": 7, "4": 6, "F4": 8}
    edges = sorted({0, 0x80, *(x for a, b in starts.values() for x in (a, b + 1)), *(x for a, b, _ in after.values() for x in (a, b + 1))})
    class_of = [sum(e <= byte for e in edges) - 1 for byte in range(256)]
    rows = []
    for state in range(9):
        row = []
        for e in edges:
            if state == 0:
                row.append(0 if e < 0x80 else next((begins[k] for k, (a, b) in starts.items() if a <= e <= b), 1))
            else:
                row.append(after[state][2] if state > 1 and after[state][0] <= e <= after[state][1] else 1)
        rows.append(row)
    return class_of, rows


_CLASS, _NEXT = _utf8_rows()


def _run(data: bytes) -> int:
    """The state after bytes that begin a code point."""
    state = 0
    for byte in data:
        state = _NEXT[state][_CLASS[byte]]
    return state


class Utf8Stream:
    """Bytes in chunks to text: what is given out is made of whole code points only."""

    def __init__(self) -> None:
        self.begun = b""

    def feed(self, chunk: bytes) -> str:
        data = self.begun + chunk
        cut = self._open(data)
        head, self.begun = data[:cut], data[cut:]
        try:
            return head.decode()  # what the machine gives for well-formed bytes, all at once
        except UnicodeDecodeError:
            return self._mended(head)

    def close(self) -> str:
        rest, self.begun = self.begun, b""
        return "\ufffd" if rest else ""

    @staticmethod
    def _open(data: bytes) -> int:
        """Where a code point begins that the end of the data cuts; the end itself if there is none."""
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                return len(data) - back if _run(data[-back:]) > 1 else len(data)
        return len(data)

    @staticmethod
    def _mended(data: bytes) -> str:
        """Byte by byte; what is malformed becomes U+FFFD, and the byte that made it so is looked at anew unless it stood alone."""
        out, run, begin, at, state = [], 0, 0, 0, 0
        while at < len(data):
            nxt = _NEXT[state][_CLASS[data[at]]]
            if nxt == 1:
                out += [data[run:begin].decode(), "\ufffd"]
                at += state == 0
                run, begin, state = at, at, 0
                continue
            at, state = at + 1, nxt
            if not state:
                begin = at
        return "".join([*out, data[run:begin].decode(), "\ufffd" if state else ""])


def decode_ids(table: list[bytes], ids: list[int], chunk: int = 4096) -> tuple[str, bytes]:
    """Text and bytes of the ids; the text comes out of the stream ``chunk`` tokens at a time."""
    stream, out, raw = Utf8Stream(), [], []
    for i in range(0, len(ids), chunk):
        raw.append(b"".join(map(table.__getitem__, ids[i : i + chunk])))
        out.append(stream.feed(raw[-1]))
    return "".join([*out, stream.close()]), b"".join(raw)


def by_size(batch: pa.RecordBatch, sizes: Iterable[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of rows whose sizes add up to ``limit`` or so; a larger row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield start, batch.num_rows


def _ids_field(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType()))


def _with_columns(df: DataFrame, *more: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *more])


def _encode_batches(spread: Broadcast, batches: Iterator[pa.RecordBatch], text_col: str, ids_col: str, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Batches with the ids of ``text_col`` as a last column; spread holds the ranks and the pattern."""
    encoder = encoder_of(*spread.value)
    for batch in batches:
        kept = [c for c in batch.schema.names if keep_text or c != text_col]
        texts = [t or "" for t in batch.column(batch.schema.names.index(text_col)).to_pylist()]
        for a, b in by_size(batch, map(len, texts)):
            ids, ends = encoder.encode(texts[a:b])
            arrays = [batch.column(batch.schema.names.index(c)).slice(a, b - a) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], [*kept, ids_col])


def _decode_batches(spread: Broadcast, batches: Iterator[pa.RecordBatch], ids_col: str, out_col: str, raw: bool) -> Iterator[pa.RecordBatch]:
    """Batches with the text of ``ids_col``, or its bytes, as a last column."""
    ranks = spread.value[0]
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    for batch in batches:
        ids = batch.column(batch.schema.names.index(ids_col))
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        sizes = ids.value_lengths().fill_null(0).to_pylist()
        ends = np.cumsum([0, *sizes]).tolist()
        for a, b in by_size(batch, sizes, 1 << 18):
            read = [decode_ids(table, flat[ends[i] : ends[i + 1]].tolist()) for i in range(a, b)]
            out = pa.array([y for _, y in read], pa.binary()) if raw else pa.array([x for x, _ in read], pa.string())
            yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns], out], [*batch.schema.names, out_col])


def bpe_encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids", keep_text: bool = True) -> DataFrame:
    """``docs`` with the ids of every whole text. The vocabulary, of fixed size, is broadcast once."""
    docs = drop_names(docs, ids_col)
    spread = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    rest = docs if keep_text else drop_names(docs, text_col)
    return docs.mapInArrow(lambda batches: _encode_batches(spread, batches, text_col, ids_col, keep_text), _with_columns(rest, _ids_field(ids_col)))


def bpe_decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded", raw: bool = False) -> DataFrame:
    """``encoded`` with the text of its ids; raw: with their bytes, malformed ones as they are."""
    encoded = drop_names(encoded, out_col)
    spread = encoded.sparkSession.sparkContext.broadcast((ranks, ""))
    return encoded.mapInArrow(lambda batches: _decode_batches(spread, batches, ids_col, out_col, raw), _with_columns(encoded, T.StructField(out_col, T.BinaryType() if raw else T.StringType())))


def bpe_round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded", keep_text: bool = True, raw: bool = False) -> DataFrame:
    """``bpe_decode`` of ``bpe_encode``, in one pass through one Python worker."""
    docs = drop_names(docs, ids_col, out_col)
    spread = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    rest = docs if keep_text else drop_names(docs, text_col)
    schema = _with_columns(rest, _ids_field(ids_col), T.StructField(out_col, T.BinaryType() if raw else T.StringType()))
    return docs.mapInArrow(lambda batches: _decode_batches(spread, _encode_batches(spread, batches, text_col, ids_col, keep_text), ids_col, out_col, raw), schema)
