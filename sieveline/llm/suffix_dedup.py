"""Removal of repeated passages by a depth-limited radix sort of suffixes.

All suffixes of all texts (as UTF-8 bytes) are ordered, but only through their first ``WINDOW`` bytes, by most-significant-digit
passes; suffixes that are equal so far are exactly the repeated windows, and a suffix that is alone with its digits
drops out at once. Of equal windows the earliest (smaller id, then earlier start) stays; bytes of all others are removed.

Digit 1 is the anchor of a window: of the ``GRAM``-byte strings in it the one with the lowest hash, and its place. Equal
windows have equal anchors, and neighbouring windows mostly share theirs, so one row per anchor (a fortieth of the bytes or
so) stands for its whole stretch of suffixes. Stretches whose anchor occurs once drop out, and so do those that share it by chance: a
window holds the ``GRAM`` bytes at a fixed distance to the left of its anchor, or else those to the right, and a stretch that has
neither in common with another of its anchor has no window in common. Of the others the bytes are fetched, and
the bytes decide, eight at a time: first whole stretches are sorted within their anchor, which puts copies together, then the
suffixes of the stretches that differ, within anchor and place. Hashes deal the work and rule copies out; no window is taken for a copy without
a look at its bytes.

What is very common is split: copies in one slice of texts are one row from the start (their bytes are compared there); rows are put next
to one another by ranges of (anchor, row), which cut a common anchor; an anchor with more than ``STRETCHES`` stretches is
dealt by its windows, each to a group of its own, and a window that is itself that common goes through two rounds, parts of its
rows first, then what each part keeps.

Defined cases: null counts as empty; texts below ``WINDOW`` bytes lose nothing; matches never cross rows; texts of any length
are read whole; rows that share an id, null or not, are texts of their own, in the order of a hash of their text (64 bits, which
also tells them apart); of rows equal in id and text one is the first, and the others lose all if they have a window; a null id
comes before all others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, group_bounds, grouped, in_ranges, shuffle_partitions, tidied

WINDOW, GRAM = 100, 32
_SPAN = WINDOW - GRAM + 1
#: Windows with so many bytes before their anchor hold the gram that begins so far to its left; all others that which begins _SPAN - _LEFT to its right.
_LEFT = _SPAN // 2
#: Stretches with one anchor that one group of work sorts; beyond it their windows are dealt to several groups.
STRETCHES = 4_000
#: Part of all stretches whose bytes one round ships.
SHIPPED = 0.3
#: Rows of one anchor that are held to be compared; of more all stay open.
HELD = 1 << 16
#: Bytes whose places fit into an anchor's key.
LONG = 1 << 24
#: Bytes that are compared, and suffixes that are sorted, in one step.
COMPARED, SUFFIXES = 1 << 20, 1 << 19


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every place, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    size = 1
    while size < GRAM:
        h = (h[:-size] ^ (h[:-size] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[size:]
        size *= 2
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first and last window, sides) of every anchor in texts joined at ``starts`` (with the end); windows stay in a text.

    sides: 16 bits of the hashes of the grams to its left and right, as far as a window of the stretch holds them."""
    none = np.empty(0, np.int64)
    if len(data) < WINDOW:
        return none.astype(np.uint64), none, none, none, none.astype(np.int32)
    h = _gram_hashes(data)
    low = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while 2 * reach <= _SPAN:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < _SPAN:
        low = np.minimum(low[: len(low) - (_SPAN - reach)], low[_SPAN - reach :])
    size = np.maximum(np.diff(starts) - WINDOW + 1, 0)
    ends = np.cumsum(size)
    window = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[:-1] - (ends - size), size)
    if not len(window):
        return none.astype(np.uint64), none, none, none, none.astype(np.int32)
    at = (low[window] & np.uint64((1 << 24) - 1)).astype(np.int64)
    bounds = group_bounds(at, np.repeat(np.arange(len(size)), size))
    first, last = window[bounds[:-1]], window[bounds[1:] - 1]
    place = at[bounds[:-1]]
    left, right = _holds(place - first, last - first)
    sides = np.zeros(len(place), np.uint64)
    sides[left] = h[place[left] - _LEFT] >> np.uint64(48) << np.uint64(16)
    sides[right] |= h[place[right] + _SPAN - _LEFT] >> np.uint64(48)
    return h[place], place, first, last, sides.astype(np.uint32).view(np.int32)


def _holds(before: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether some windows of a stretch hold the left gram, and some the right one; before: bytes of its first window before the anchor."""
    return before >= _LEFT, before - width < _LEFT


_DECIDED, _OPEN, _COUNT, _AGAIN = range(4)
_ROWS = "kind int, anchor long, id long, h long, at long"
_FIRST = _ROWS + ", sides int"
_WORK = "anchor long, part long, salt int, salts int, id long, h long, at long, own binary"
_DONE = "kind int, anchor long, part long, id long, h long, at long, own binary"


def _merged(key: tuple[np.ndarray, ...], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each key, overlapping ones joined: a row of each, start and end."""
    if not len(a):
        return a, a, b
    order = np.lexsort((a, *key[::-1]))
    a, b = a[order], b[order]
    bounds = group_bounds(*[k[order] for k in key])
    number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    reach = np.maximum.accumulate(b + number * (1 << 32)) - number * (1 << 32)
    new = np.append(True, (number[1:] != number[:-1]) | (a[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return order[at], a[at], reach[np.append(at[1:], len(a)) - 1]


def _batch(schema: str, *columns: object) -> pa.RecordBatch:
    """Columns by a schema as Spark writes it; a number stands for all rows."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [part.split() for part in schema.split(", ")]
    n = next(len(c) for c in columns if not isinstance(c, int | None))
    arrays = [pa.nulls(n, kinds[k]) if c is None else pa.array(np.full(n, c) if isinstance(c, int) else c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in names])


def _cut_rows(ids: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, h and interval of what is removed; start and end share one number."""
    row, a, b = _merged((ids, h), a, b)
    return ids[row], h[row], a << 32 | b


def _later(group: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Rows for which the group has an earlier one, by the columns of place; rows at one place are one."""
    order = np.lexsort((*place[::-1], group))
    bounds = group_bounds(group[order])
    first = order[np.repeat(bounds[:-1], np.diff(bounds))]
    return order[np.logical_or.reduce([p[order] != p[first] for p in place])]


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of a size from two places are equal."""
    out = [np.empty(0, bool)]
    upto = np.cumsum(size)
    for some in np.split(np.arange(len(a)), np.flatnonzero(np.diff(upto // COMPARED)) + 1) if len(a) else ():
        begin = np.cumsum(size[some]) - size[some]
        nth = np.arange(int(size[some].sum())) - np.repeat(begin, size[some])
        out.append(np.logical_and.reduceat(data[np.repeat(a[some], size[some]) + nth] == data[np.repeat(b[some], size[some]) + nth], begin))
    return np.concatenate(out)


def _first_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, text) to a row for each distinct stretch of a slice, and the intervals that are decided in it."""
    for batch in batches:
        ids, h, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        k = 0
        while k < len(ids):
            parts, size, end = [], 0, k
            while end < len(ids) and (size < 1 << 20 or end == k):
                parts.append(texts[end].as_py().encode())
                size += len(parts[-1])
                end += 1
            yield from _slice_digits(ids[k:end], h[k:end], parts)
            k = end


def _slice_digits(ids: np.ndarray, hashes: np.ndarray, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
    joined = b"".join(parts)
    data = np.frombuffer(joined, np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    #: A text beyond 2 ** 24 bytes is taken in overlapping stretches, as places have 24 bits.
    step = LONG - WINDOW
    spans = [(0, starts)] if len(joined) < LONG else [(s + o, np.array([0, min(step + WINDOW - 1, e - s - o)])) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) for o in range(0, max(1, e - s - WINDOW + 1), step)]
    for offset, own in spans:
        h, place, first, last, sides = anchors(data[offset : offset + int(own[-1])], own)
        found.append((h, place + offset, first + offset, last + offset, sides))
    h, place, first, last, sides = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(h):
        return
    view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
    size = last - first + WINDOW
    mark = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (first + size).tolist(), strict=True)), np.uint64, len(h)).view(np.int64)
    text = np.searchsorted(starts, first, side="right") - 1
    begin = starts[text]
    doc, own, at = ids[text], hashes[text], (first - begin) << 16 | (last - first) << 8 | (place - first)
    #: Stretches with one digest are held against the first of them; those that differ after all stay.
    order = np.lexsort((at, own, doc, mark))
    bounds = group_bounds(mark[order])
    head = order[np.repeat(bounds[:-1], np.diff(bounds))]
    copy = np.flatnonzero((order != head) & (size[order] == size[head]))
    copy = copy[_same_bytes(data, first[order[copy]], first[head[copy]], size[order[copy]])]
    stay = np.ones(len(h), bool)
    stay[order[copy]] = False
    moved = (doc[order[copy]] != doc[head[copy]]) | (own[order[copy]] != own[head[copy]]) | (at[order[copy]] != at[head[copy]])
    gone = order[copy][moved]
    i, j, cut = _cut_rows(doc[gone], own[gone], (first - begin)[gone], (first - begin + size)[gone])
    yield _batch(_FIRST, _DECIDED, 0, i, j, cut, 0)
    yield _batch(_FIRST, _OPEN, h.view(np.int64)[stay], doc[stay], own[stay], at[stay], sides[stay])


def _met(group: np.ndarray, at: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Whether a stretch has a gram beside the anchor in common with another of its group."""
    out = np.zeros(len(group), bool)
    marks = sides.astype(np.int64)
    for has, mark in zip(_holds(at & 255, at >> 8 & 255), (marks >> 16 & 0xFFFF, marks & 0xFFFF), strict=True):
        rows = np.flatnonzero(has)
        _, key, count = np.unique(group[rows] << 16 | mark[rows], return_inverse=True, return_counts=True)
        out[rows] |= count[key] > 1
    return out


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range, sorted by anchor: those that another row of the anchor has a gram in common with, or may have in the next range; counts
    of long runs. What is held is a batch and the anchor it breaks off in, up to a bound: of more rows, as of what crosses a range, all stay."""
    held: list[np.ndarray] | None = None
    edges: list[int] = []  # anchors of which not all rows are seen at once: the first, and the last that was too long
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy() for i in range(5)]
        if held is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
        anchor = rows[0]
        edges = edges or [anchor[0]]
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if len(anchor) - cut > HELD:
            edges, cut = [edges[-1], anchor[-1]], len(anchor)
        yield from _still_open([r[:cut] for r in rows], edges)
        held = [r[cut:] for r in rows]
    if held is not None:
        yield from _still_open(held, [*held[0][:1]])


def _still_open(rows: list[np.ndarray], edges: list[int]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor those that stay open, and how many of an anchor; all of those in edges stay."""
    anchor = rows[0]
    if not len(anchor):
        return
    stay = np.isin(anchor, edges)
    bounds = group_bounds(anchor)
    size = np.diff(bounds)
    some = np.flatnonzero(np.repeat(size > 1, size) & ~stay)
    group = np.repeat(np.arange(len(size)), size)
    stay[some] = _met(group[some], rows[3][some], rows[4][some])
    count = np.bincount(group[stay], minlength=len(size))
    long = np.flatnonzero(count >= 32)
    yield _batch(_ROWS, _OPEN, *[r[stay] for r in rows[:4]])
    yield _batch(_ROWS, _COUNT, anchor[bounds[:-1]][long], 0, 0, count[long])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(own id, text, id, h, open rows of the text) to the bytes of stretches; for very common anchors to those of windows."""
    for batch in batches:
        texts, opened = batch.column(1), batch.column(4)
        out: list[tuple] = []
        held = 0
        for r, (i, h) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            data = texts[r].as_py().encode()
            for x in opened[r].as_py():
                anchor, at, several = x["anchor"], x["at"], x["several"]
                first, width = at >> 16, at >> 8 & 255
                if several is None:
                    out.append((anchor, 0, 0, 1, i, h, at, data[first : first + width + WINDOW]))
                else:
                    salts = -(-several // STRETCHES)
                    for start in range(first, first + width + 1):
                        own = data[start : start + WINDOW]
                        out.append((anchor, xxhash.xxh3_64_intdigest(own) >> 1 | 1, h % salts, salts, i, h, start << 16, own))
                held += width + WINDOW if several is None else WINDOW * width
                if held > 1 << 22:
                    yield _batch(_WORK, *map(list, zip(*out, strict=True)))
                    out, held = [], 0
        if out:
            yield _batch(_WORK, *map(list, zip(*out, strict=True)))


def radix_passes(data: np.ndarray, start: np.ndarray, group: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings within their groups by most-significant digits; rows of the equal ones, and their groups.

    Strings of a group have one size. Each pass takes the next eight bytes as the digit; groups of one drop out after it. data
    has eight bytes more than the strings.
    """
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    bounds = group_bounds(group[order := np.argsort(group, kind="stable")])
    count = np.diff(bounds)
    more = np.repeat(count > 1, count)
    rows, group = order[more], np.repeat(np.arange(len(count)), count)[more]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    depth, passed = 0, len(count)
    while len(rows):
        left = size[rows] - depth
        digit = eight[np.minimum(start[rows] + depth, len(eight) - 1)].view(">u8").ravel().astype(np.uint64)
        digit >>= (8 * np.maximum(8 - left, 0)).astype(np.uint64)
        order = np.lexsort((digit, group))
        bounds = group_bounds(group[order], digit[order])
        count = np.diff(bounds)
        number = np.repeat(np.arange(len(count)) + passed, count)
        passed += len(count)
        more = np.repeat(count > 1, count)
        rows, group = rows[order][more], number[more]
        depth += 8
        whole = size[rows] <= depth
        done.append((rows[whole], group[whole]))
        rows, group = rows[~whole], group[~whole]
    return (np.concatenate([r for r, _ in done]), np.concatenate([g for _, g in done])) if done else (np.empty(0, np.int64), np.empty(0, np.int64))


def _last_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches, or windows, in whole groups: copies of a stretch by its bytes, then the suffixes of those that differ."""
    for table in grouped(batches, "anchor", "part", "salt"):
        anchor, part, salt, salts, ids, h, at = (table[k].to_numpy() for k in ("anchor", "part", "salt", "salts", "id", "h", "at"))
        own = table["own"].combine_chunks()
        offsets = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64)
        data = np.concatenate([np.frombuffer(own.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.zeros(8, np.uint8)])
        offsets -= offsets[0]
        bounds = group_bounds(anchor, part, salt)
        number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        width = at >> 8 & 255
        k = 0
        upto = np.concatenate([[0], np.cumsum(width + 1)])[bounds]
        while k < len(bounds) - 1:
            end = max(k + 1, int(np.searchsorted(upto, upto[k] + SUFFIXES, side="right")) - 1)
            base = int(bounds[k])
            r = slice(base, int(bounds[end]))
            rows, equal = radix_passes(data, offsets[r], number[r] << 8 | width[r], width[r] + WINDOW)
            rows += base
            gone = rows[_later(equal, ids[rows], h[rows], at[rows])]
            yield _batch(_DONE, _DECIDED, 0, 0, *_cut_rows(ids[gone], h[gone], at[gone] >> 16, (at[gone] >> 16) + width[gone] + WINDOW), None)
            stay = np.ones(r.stop - base, bool)
            stay[gone - base] = False
            rest = np.flatnonzero(stay) + base
            again = rest[salts[rest] > 1]
            if len(again):
                yield _batch(_DONE, _AGAIN, anchor[again], part[again], ids[again], h[again], at[again], own.take(pa.array(again)))
            rest = rest[np.bincount(number[rest])[number[rest]] > 1]
            if len(rest):
                size = width[rest] + 1
                row = np.repeat(rest, size)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                place = (at[row] & 255) - nth  # of the anchor in this suffix
                found, equal = radix_passes(data, offsets[row] + nth, number[row] << 8 | place & 255, np.full(len(row), WINDOW))
                start = (at[row] >> 16) + nth
                gone = found[_later(equal, ids[row[found]], h[row[found]], start[found])]
                i = row[gone]
                yield _batch(_DONE, _DECIDED, 0, 0, *_cut_rows(ids[i], h[i], start[gone], start[gone] + WINDOW), None)
            k = end


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(own id, text, cuts, nth of the rows equal to it): what is removed, and the rest."""
    for batch in batches:
        n = batch.num_rows
        size, removed, spans = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        kept: list[bytes] = []
        for r, (text, cuts, nth) in enumerate(zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True)):
            data = text.as_py().encode()
            size[r] = len(data)
            if nth > 1 and len(data) >= WINDOW:
                spans[r], removed[r], data = 1, len(data), b""
            elif cuts.is_valid:
                each = cuts.values.to_numpy()
                _, a, b = _merged((np.zeros(len(each), np.int64),), each >> 32, each & (1 << 32) - 1)
                spans[r], removed[r] = len(a), (b - a).sum()
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(data)]
                data = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            kept.append(data)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(d).hexdigest() for d in kept]), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(own, text, id, h): id and h name a text. Texts without a window are never looked up, so they are dealt evenly."""
    own, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = F.when(F.octet_length(text) < WINDOW, F.monotonically_increasing_id()).otherwise(F.xxhash64(text))
    return docs.select(own.alias("own"), text.alias("text"), F.coalesce(own, F.lit(-(1 << 63))).alias("id"), h.alias("h"))


def _cuts(rows: DataFrame) -> DataFrame:
    """(id, h, cuts) of texts with repeated windows: intervals as start << 32 | end, in bytes of UTF-8.

    Each step is a written table, and what it shuffled goes with it. Texts with open stretches are written once; their bytes are
    dealt in rounds by anchor, so that what a round ships is a part of the texts, however much of them is repeated."""
    p = shuffle_partitions(rows.sparkSession)
    one = tidied(rows.select("id", "h", "text").mapInArrow(_first_digits, _FIRST), "digits1", by="kind")
    two = tidied(in_ranges(one.filter(F.col("kind") == _OPEN).select("anchor", "id", "h", "at", "sides"), "anchor", "h").mapInArrow(_shared, _ROWS), "digits2")
    most = one.filter(F.col("kind") == _OPEN).count() * SHIPPED
    forget(one, part=f"kind={_OPEN}")
    common = two.filter(F.col("kind") == _COUNT).groupBy("anchor").agg(F.sum("at").alias("several")).filter(F.col("several") > STRETCHES)
    marked = two.filter(F.col("kind") == _OPEN).join(F.broadcast(common), "anchor", "left")  # a row of common stands for STRETCHES at least
    ships = marked.agg(F.sum(F.when(F.col("several").isNull(), 1).otherwise(F.expr("(at >> 8 & 255) + 1")))).first()[0] or 0
    rounds = max(1, -int(-ships // max(most, 1)))
    opened = marked.groupBy("id", "h").agg(F.collect_list(F.struct("anchor", "several", "at")).alias("opened"))
    texts = tidied(rows.join(opened, ["id", "h"]).select("own", "text", "id", "h", "opened"), "opened", codec="zstd")
    forget(two)
    keys = ("anchor", "part", "salt")
    three = []
    for k in range(rounds):
        mine = texts.withColumn("opened", F.expr(f"filter(opened, x -> pmod(x.anchor, {rounds}L) = {k})")).filter(F.size("opened") > 0)
        work = mine.mapInArrow(_cut_out, _WORK)
        three.append(tidied(work.repartition(p, *keys).sortWithinPartitions(*keys).mapInArrow(_last_digits, _DONE), "digits3"))
    forget(texts)
    three = reduce(DataFrame.unionByName, three)
    again = three.filter(F.col("kind") == _AGAIN).select("anchor", "part", F.lit(0).alias("salt"), F.lit(1).alias("salts"), "id", "h", "at", "own")
    last = again.repartition(p, *keys).sortWithinPartitions(*keys).mapInArrow(_last_digits, _DONE)
    decided = [x.filter(F.col("kind") == _DECIDED).select("id", "h", "at") for x in (one, three, last)]
    return decided[0].unionByName(decided[1]).unionByName(decided[2]).groupBy("id", "h").agg(F.collect_list("at").alias("cuts"))


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept), a row for each of ``docs``; kept has the remaining bytes."""
    rows = _texts(docs, id_col, text_col)
    #: Both joins of the texts read one exchange by (id, h).
    nth = F.row_number().over(Window.partitionBy("id", "h").orderBy("own"))
    both = rows.withColumn("nth", nth).join(_cuts(rows), ["id", "h"], "left").select("own", "text", "cuts", "nth")
    return both.mapInArrow(_applied, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
