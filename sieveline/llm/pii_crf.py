"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find addresses, numbers and so on that are written as usual. The CRF adds spans that are written in other ways
("jo at mail dot com", "jo (at) mail (dot) com", "(030) 555-1234", "10[.]0[.]0[.]7"). It is trained on the small labelled table below:
features are shapes of a token and its neighbours (letters as a or A, digits as 9, runs shortened), labels are begin and inside
of each kind, and the weights maximise the likelihood of the table by gradient ascent with the forward-backward sums.

Every token of every text is read and scored: a slice of texts becomes arrays of shape numbers, and the scores of all labels are
sums of rows of dense tables. Lines are decoded by Viterbi over numpy batches of equal padded length. Most tokens can be
settled before: what a label other than O can gain over O, with the best move that leads to it, bounds what a run of such
labels can gain, and tokens that no run with a gain passes are O on the best way. That is a running sum with its minimum and
maximum; it changes no label, as the tests show, and nothing but the model says where to look.

Spans of the patterns stay as they are; a CRF span is added where it overlaps none of them and passes an exact check of its kind:
digits, parts, Luhn, and for addresses an at and a dot, which if both are plain words have to lead to a known top-level name.

Defined cases: a null text counts as empty and has no spans; texts and words of any length are read whole; repeated rows, and rows
that share an id, are read each; columns of the input pass through, and one with the output's name is replaced; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import by_size
from .common import drop_names

KINDS = ("email", "ip", "card", "phone")

# --- Patterns -------------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: No match of the pattern begins inside a run of digits, so looking behind changes nothing but the time it takes.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _part(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that don't overlap, less those that fail their check."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(map(_part, m[0].split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _DIGITS.sub("", m[0])) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


# --- The labelled table ---------------------------------------------------------------------------------------------

#: Marked as {kind|text}. Lines without marks teach what numbers are not personal.
EXAMPLES = """
write to {email|jo.brown (at) mail.example.com} today
mine is {email|jo at mail dot com} thanks
send to {email|anna dot weber at firma dot de}, please
ask {email|lee99 at box dot example dot org} about it
{email|kim at post dot net}
reach me at {email|max at shop dot fr} or by phone
old {email|Eva at server dot example dot com} here
his mail, {email|sam_b at home dot es}, is full
her {email|nora (at) mail dot com} there
from {email|pat at post7.example.org} with love
we met at noon and left at six
look at the dot on the map
a red dot at the end of the line
dot the i and cross the t at last
he works at home and at sea
at first, at last, at once
they arrived at the station at night
the dot and the dash at sea
polka dot dress at the ball
at the top. at the end.
mail {email|anna.77 (at) mail1 (dot) example (dot) com} or call
reach me: {email|kim[at]post.example.org}, thanks
{email|lee_3 [at] box9 [dot] example [dot] net} is mine
contact {email|max (at) firm (dot) de}.
{email|d.ray42(at)mail5.example.com}
the address {email|sam @ mail3.example.com} works
send it to {email|eva.ruiz88 @ mail7 . example . com} soon
old {email|pat(at)server(dot)example(dot)fr} and more text
her {email|Nora.Hill[at]mail2[dot]example[dot]com} there
call {phone|(030) 555-1234} now
phone {phone|(017) 555-7713} or write
my number is {phone|1 (826) 555-4081} at home
ring {phone|555-123-4567} after six
tel {phone|0049 30 1234567} bitte
{phone|(212) 555 0199} is the office
fax: {phone|030-555-87654}.
mobile {phone|0176 555 12345} please
dial {phone|1-800-555-0142} toll free
desk {phone|(555) 867-5309}, second floor
appel {phone|01 55 51 23 45} merci
llama {phone|(91) 555-3344} hoy
host {ip|10[.]0[.]0[.]7} was seen
from {ip|192[.]168[.]1[.]20} to there
blocked {ip|203 . 0 . 113 . 9} again
server {ip|172(.)16(.)4(.)250} down
card {card|4111.1111.1111.1111} expired
paid with {card|5500/0000/0000/0004} yesterday
number {card|4012_8888_8888_1881} on file
visa {card|4111  1111  1111  1111} thanks
there were 12 of them in 1999 and 4.5 percent more
on 2024-05-17 at 10:30 we met
chapter 3. the 4. of may
version 2.10.4 came out in 2011
it cost 1,299.00 or 45 euro
section 12.3 (see 14) and page 200
order 4812 has 3 items, total 77.20
the key "04dbebab91ab85687d33eeaaf9ac699e1188f962" was lost
hash 9233A8ECF7C5B09FE5949719B6B82BC439E9329B !!
id 9807915762804490 is no card
numbers 7536784127813050 4845168114407329 in a row
from 1914 to 1918 and 1939 - 1945
(12) and (3) are the notes
a 10% rise, then 20%*** and 7%%%
room 101, building 7, floor 2
3 x 4 = 12 and 1/2 of 8
isbn 0-306-40615-2 printed 1990
ids 17 and 18: see table 4.
$$$ 100 &&& 200 ### 300
and the | 5 | 6 | 7 | in a table
at 10 (at noon) and 20
the (dot) in it, the (at) sign
@ home and @ work
he scored 3-2 in 90 minutes
temperatures of 20.5 to 30.1 degrees
"""


def labelled_table(text: str = EXAMPLES) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(line, spans) from the marked lines."""
    rows = []
    for line in filter(None, text.split("\n")):
        plain, spans = "", []
        for part in re.split(r"(\{\w+\|[^}]*\})", line):
            if m := re.fullmatch(r"\{(\w+)\|([^}]*)\}", part):
                spans.append((KINDS.index(m[1]), len(plain), len(plain) + len(m[2])))
                plain += m[2]
            else:
                plain += part
        rows.append((plain, spans))
    return rows


# --- The model ------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
#: The same, and blanks, so that every character is in a token.
_ALL = re.compile(r"[^\W\d_]+|[0-9]+|\s+|\S").findall
_LABELS = 1 + 2 * len(KINDS)


def shape(token: str) -> str:
    """Letters as a or A, digits as 9 with their number up to five; 'at' and 'dot' and single signs stand for themselves."""
    if token[0].isdigit() and token.isascii():
        return "9" * min(len(token), 5) + ("+" if len(token) > 5 else "") + ("*" if len(token) > 12 else "")
    if token.isalpha():
        if token.lower() in ("at", "dot"):
            return token.lower()
        return "A" if token.isupper() else "Aa" if token[0].isupper() else "a"
    return token


_SPACE, _NEAR, _END = range(3)


def _features(shapes: list[str], near: list[bool]) -> list[tuple]:
    """Of each token: tuples of the feature's number and its parts. near: whether a token stands directly at the one before it."""
    s = ["<", "<", *shapes, ">", ">"]
    g = [_NEAR if x else _SPACE for x in near] + [_END]
    return [
        ((0, s[i]), (1, s[i - 1], g[i - 2], s[i]), (2, s[i], g[i - 1], s[i + 1]), (3, s[i - 2], s[i - 1], s[i]), (4, s[i], s[i + 1], s[i + 2]), (5, s[i - 1], s[i + 1]), (6, g[i - 2], g[i - 1]))
        for i in range(2, len(s) - 2)
    ]


def tokens(text: str) -> tuple[list[tuple[int, int]], list[tuple]]:
    """Of one line of the labelled table."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    near = [i > 0 and spans[i - 1][1] == a for i, (a, _) in enumerate(spans)]
    return spans, _features([shape(text[a:b]) for a, b in spans], near)


class _Shapes(dict):
    """Numbers of tokens' shapes, learnt when they are asked for: 0 a shape that the table lacks, 1 and 2 the ends of a line, -1
    a blank, -2 a blank with the end of a line. Bounded in tokens and in their length: longer ones are looked at anew."""

    def __init__(self, names: dict[str, int]):
        super().__init__()
        self.names = names

    def __missing__(self, token: str) -> int:
        n = (-2 if "\n" in token else -1) if token.isspace() else self.names.get(shape(token), 0)
        if len(token) <= 64:
            if len(self) > 400_000:
                self.clear()
            self[token] = n
        return n


@dataclass
class Crf:
    """weights: a row of label scores for each feature; moves: from label to label."""

    weights: dict[tuple, np.ndarray]
    moves: np.ndarray
    dense: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None}

    def emission(self, features: tuple) -> np.ndarray:
        return sum((self.weights[f] for f in features if f in self.weights), np.zeros(_LABELS))

    def tables(self) -> tuple[_Shapes, list[np.ndarray]]:
        """Shapes as numbers, and the weights of features, added up, by the numbers of their parts."""
        if self.dense is None:
            shapes = sorted({x for f in self.weights for x in f[1:] if isinstance(x, str)} - {"<", ">"})
            number = {x: i for i, x in enumerate(["", "<", ">", *shapes])}
            n = len(number)
            sizes = [(n,), (n, 3, n), (n, 3, n), (n, n, n), (n, n, n), (n, n), (3, 3)]
            tables = [np.zeros((*size, _LABELS)) for size in sizes]
            for (k, *parts), w in self.weights.items():
                tables[k][tuple(number[x] if isinstance(x, str) else x for x in parts)] = w
            t0, t1, t2, t3, t4, t5, t6 = tables
            #: What is read on the same side of a token is added up beforehand: (two before, one before, gap, token), (token, gap, next, next but one).
            before, behind = t3[:, :, None] + (t1 + t0)[None], t4[:, None] + t2[:, :, :, None]
            self.dense = _Shapes(number), [x.reshape(-1, _LABELS) for x in (before, behind, t5, t6)]
        return self.dense

    def scores(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens, with two marks at each end of each line: the score of every label, the place and the size (0: a mark)."""
        shapes, (before, behind, around, gaps) = self.tables()
        n = len(shapes.names)
        found = _ALL(text)
        size = np.fromiter(map(len, found), np.int64, len(found))
        s = np.fromiter(map(shapes.__getitem__, found), np.int64, len(found))
        at, blank = np.cumsum(size) - size, s < 0
        row = np.repeat(np.arange(len(s)), np.where(blank, np.where(s == -2, 4, 0), 1))
        mark = blank[row]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        x = np.concatenate([[1, 1], np.where(mark, np.where(nth < 2, 2, 1), s[row]), [2, 2]])
        after_blank = np.append(True, blank[:-1])[row] if len(row) else np.empty(0, bool)
        g = np.concatenate([[_END, _END], np.where(mark, _END, np.where(after_blank, _SPACE, _NEAR)), [_END, _END]])
        x0, left, right, g0, g1 = x[2:-2], x[1:-3], x[3:-1], g[2:-2], g[3:-1]
        score = before.take(((x[:-4] * n + left) * 3 + g0) * n + x0, 0)
        score += behind.take(((x0 * 3 + g1) * n + right) * n + x[4:], 0)
        score += around.take(left * n + right, 0)
        score += gaps.take(g0 * 3 + g1, 0)
        return score, at[row], np.where(mark, 0, size[row])

    def open_runs(self, score: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Begins and ends of the runs of tokens that may be something else than O on the best way."""
        enter, leave = self.moves[:, 1:].max(0) - self.moves[0, 0], max(0.0, float((self.moves[1:, 0] - self.moves[0, 0]).max()))
        gain = (score[:, 1:] + enter).max(1) - score[:, 0]
        gain[mark] = -1e4
        upto = np.concatenate([[0.0], np.cumsum(gain)])
        best = np.maximum.accumulate(upto[:0:-1])[::-1] - np.minimum.accumulate(upto[:-1])  # of all runs that pass here
        some = (best > -leave - 1e-6) & ~mark
        return np.flatnonzero(np.diff(np.concatenate([[False], some, [False]]))).reshape(-1, 2)

    def decode(self, stretches: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest labels of each stretch of scores, with O around it: Viterbi over batches padded to a common length."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(stretches)
        order = sorted((i for i, s in enumerate(stretches) if len(s)), key=lambda i: len(stretches[i]))
        sizes = np.array([len(stretches[i]) for i in order])
        k = 0
        while k < len(order):
            padded = np.arange(1, len(order) - k + 1) * sizes[k:]  # as many tokens a batch holds with its next stretch
            batch = order[k : k + max(8, int(np.searchsorted(padded, 1 << 14)))]
            length = sizes[k : k + len(batch)]
            k += len(batch)
            score = np.zeros((len(batch), length[-1], _LABELS))
            row = np.repeat(np.arange(len(batch)), length)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            score[row, nth] = np.concatenate([stretches[i] for i in batch])
            best = score[:, 0] + self.moves[0]
            back = np.zeros(score.shape, np.int8)
            ends = best.copy()
            for t in range(1, length[-1]):
                each = best[:, :, None] + self.moves
                back[:, t] = each.argmax(1)
                best = each.max(1) + score[:, t]
                ends = np.where((length > t)[:, None], best, ends)
            ends = ends + self.moves[:, 0]
            last = ends.argmax(1)
            plain = score[:, :, 0].sum(1) + (length + 1) * self.moves[0, 0]  # of O alone
            some = ends[np.arange(len(batch)), last] > plain + 1e-9
            for r, i in enumerate(batch):
                out[i] = np.zeros(length[r], np.int64)
                if some[r]:
                    labels = out[i]
                    labels[-1] = last[r]
                    for t in range(length[r] - 1, 0, -1):
                        labels[t - 1] = back[r, t, labels[t]]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _allowed() -> np.ndarray:
    """Inside follows only begin or inside of its kind."""
    ok = np.zeros((_LABELS, _LABELS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = -1e6
        ok[inside - 1, inside] = ok[inside, inside] = 0
    return ok


def fit_crf(table: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 150, rate: float = 0.3, decay: float = 0.02) -> Crf:
    """Full-batch Adagrad on the penalised log-likelihood; O stands before and after every line."""
    names: dict[tuple, int] = {}
    lines = []
    for text, spans in table:
        at, features = tokens(text)
        y = np.zeros(len(at), np.int64)
        for kind, a, b in spans:
            inside = [i for i, (s, e) in enumerate(at) if s >= a and e <= b]
            y[inside] = 2 + 2 * kind
            y[inside[0]] -= 1
        lines.append((np.array([[names.setdefault(f, len(names)) for f in fs] for fs in features]), y))
    w, moves, ok = np.zeros((len(names), _LABELS)), np.zeros((_LABELS, _LABELS)), _allowed()
    sum_w, sum_m = np.full_like(w, 1e-2), np.full_like(moves, 1e-2)
    for _ in range(steps):
        gw, gm = -decay * w, -decay * moves
        for f, y in lines:
            e, m, n = w[f].sum(1), moves + ok, len(y)
            a, b = np.zeros((n, _LABELS)), np.zeros((n, _LABELS))
            a[0] = e[0] + m[0]
            for t in range(1, n):
                a[t] = e[t] + _logsum(a[t - 1][:, None] + m, 0)
            b[-1] = m[:, 0]
            for t in range(n - 2, -1, -1):
                b[t] = _logsum(m + (e[t + 1] + b[t + 1])[None, :], 1)
            z = _logsum(a[-1] + m[:, 0], 0)
            p = np.exp(a + b - z)
            d = -p
            d[np.arange(n), y] += 1
            for j in range(f.shape[1]):
                np.add.at(gw, f[:, j], d)
            path = np.concatenate([[0], y, [0]])
            np.add.at(gm, (path[:-1], path[1:]), 1)
            gm[0] -= p[0]
            gm[:, 0] -= p[-1]
            for t in range(1, n):
                gm -= np.exp(a[t - 1][:, None] + m + (e[t] + b[t])[None, :] - z)
        sum_w += gw**2
        sum_m += gm**2
        w += rate * gw / np.sqrt(sum_w)
        moves += rate * gm / np.sqrt(sum_m)
    return Crf({f: w[i] for f, i in names.items()}, moves + ok)


# --- Texts ----------------------------------------------------------------------------------------------------------

#: What each of the patterns needs.
_PLAIN = re.compile(r"[0-9@]").search
_GROUPS = re.compile(r"[0-9]+").findall
_AT = re.compile(r"@|[(\[] ?at ?[)\]]", re.I).search
_DOT = re.compile(r"\.|\bdot\b", re.I).search
_SPOKEN = re.compile(r"[\w+-]+(?: dot [\w+-]+)* at [\w-]{2,}(?:(?: dot |\.)[\w-]{2,})*(?: dot |\.)[^\W\d_]{2,}", re.I).fullmatch


def _sound(kind: int, text: str) -> bool:
    """Whether a span of the CRF holds what its kind needs."""
    groups = _GROUPS(text)
    digits = sum(map(len, groups))
    if kind == 0:
        return len(text) >= 8 and bool(_DOT(text) if _AT(text) else _SPOKEN(text))
    if kind == 1:
        return len(groups) == 4 and all(map(_part, groups))
    if kind == 2:
        return 16 <= digits <= 19 and len(groups) > 1 and _luhn("".join(groups))
    return 8 <= digits <= 15 and len(groups) > 1


def crf_spans(texts: list[str], model: Crf, found: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the CRF adds to the spans found in each text. All of the texts are scored, as the lines of one."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    score, at, size = model.scores("\n".join(texts))
    runs = model.open_runs(score, size == 0)
    for (first, end), labels in zip(runs.tolist(), model.decode([score[a:b] for a, b in runs.tolist()]), strict=True):
        if not labels.any():
            continue
        i = int(np.searchsorted(begins, at[first], side="right")) - 1
        where, taken = at[first:end] - begins[i], found[i]
        t = 0
        while t < len(labels):
            if y := int(labels[t]):
                stop = t + 1
                while stop < len(labels) and labels[stop] == y + y % 2 and labels[stop] % 2 == 0:
                    stop += 1
                span = ((y - 1) // 2, int(where[t]), int(where[stop - 1] + size[first + stop - 1]))
                if _sound(span[0], texts[i][span[1] : span[2]]) and not any(span[1] < e and s < span[2] for _, s, e in taken):
                    out[i].append(span)
                t = stop
            else:
                t += 1
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, model: Crf, text_col: str = "text", out_col: str = "pii", keep_text: bool = True) -> DataFrame:
    """``docs`` with the spans of every whole text: kind (place in KINDS), start, end in code points, base; by kind and start."""
    docs = drop_names(docs, out_col)
    rest = docs if keep_text else drop_names(docs, text_col)
    kept, spread = rest.columns, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.names.index(text_col)).to_pylist()]
            for a, b in by_size(batch, map(len, texts), 1 << 19):
                own = texts[a:b]
                base = [pattern_spans(t) if _PLAIN(t) else [] for t in own]
                added = crf_spans(own, spread.value, base)
                spans = [sorted([(k, s, e, True) for k, s, e in x] + [(k, s, e, False) for k, s, e in y]) for x, y in zip(base, added, strict=True)]
                column = pa.array([[{"kind": k, "start": s, "end": e, "base": f} for k, s, e, f in x] for x in spans], _ARROW)
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)).slice(a, b - a) for c in kept], column], [*kept, out_col])

    return docs.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(out_col, SPAN)]))
