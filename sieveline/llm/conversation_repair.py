"""Conversation structure repair: the cheapest edits that give every conversation the shape ``(s?(ua)+)?`` of role initials.

Edits: keep a row (0), give it the role user or assistant (3), delete it (4; blank and duplicate rows must go), insert an empty
user or assistant row anywhere (3); a truncated row that stays adds 3. The weighted automaton that reads rows and writes roles has four
states (nothing yet, after s, after u, after a). It is determinised lazily: the costs of the four states, less the least of
them, are one state of the determinised automaton, and (state, kind of row) -> (state, what was taken off) is a table that
is filled when an entry is first needed. There are nine kinds of rows, so the table soon holds all that occurs, and a scan is
one lookup a row.

The scan runs from the last row to the first, so that its vectors are costs still to come; the trace runs against it, along
arcs that are tight (cost of the arc + cost to come = cost here), and thus meets the edits in the order in which ties are decided: the
ASCII-least tight arc is taken. What the trace does at a row depends on the determinised state and the state it is in only, so
it is a table too.

Rows are dealt by sampled ranges of (conversation, turn, role, text), so a conversation of any length is cut into pieces of
bounded size. One that lies in a piece is settled there. For the others every piece becomes a matrix (the scan from each of the four
unit vectors; ``min-plus``), a fold over the matrices gives the costs behind each piece, pieces are traced in parallel from
each of the four states, and the last step strings the chosen traces together. Duplicates across pieces are met by digest, with
a minimum that is combined before it is shuffled. The digest of a whole conversation is made in one task, as SHA-256
reads its bytes one after the other, but that task holds one piece at a time, and the audit.

Defined cases: a null role or text is one space; rows are ordered by turn (nulls first), then role, then text, in byte order;
equal rows are copies of one another; a null conv_id is a conversation; a role's initial is its first character, and only
s, u and a fit the shape; a conversation of which nothing is left has zeros, an empty audit and the digest of nothing; an empty
table gives an empty one; columns beside the four that are named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

NEVER = 1 << 40
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. What a state reads next when the role is chosen freely, and where
#: a conversation may end.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROLE = {2: "user", 3: "assistant"}
ENDS = (0, NEVER, NEVER, 0)
#: Rows and characters of a piece, at most (one row may be longer).
PIECE_ROWS, PIECE_CHARS = 4096, 1 << 20
#: Kinds of rows: 0 must go; 1 + 2 * place of the initial in INITIALS + (1 if truncated).
INITIALS = ("s", "u", "a", "")


def kind_of(initial: str, cut: bool) -> int:
    return 1 + 2 * (INITIALS.index(initial) if initial in "sua" and initial else 3) + cut


class Automaton:
    """The determinised automaton over vectors of costs to come, and its tables."""

    def __init__(self) -> None:
        self.ids: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.scan: list[list[tuple[int, int] | None]] = []
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}

    def state(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """(id of the normalised vector, what was taken off)."""
        least = min(costs)
        own = tuple(min(c - least, NEVER) for c in costs)
        if own not in self.ids:
            self.ids[own] = len(self.vectors)
            self.vectors.append(own)
            self.scan.append([None] * 9)
        return self.ids[own], least

    @staticmethod
    def inserted(costs: tuple[int, ...]) -> tuple[int, ...]:
        """With rows inserted first, where that is cheaper: once round the two states is enough."""
        c = list(costs)
        for q in (3, 2, 3, 1, 0):
            c[q] = min(c[q], INSERT + c[NEXT[q]])
        return tuple(c)

    @staticmethod
    def arcs(kind: int, q: int) -> list[tuple[str, int, int]]:
        """(edit, cost, next state) of the edits that use the row up."""
        out = [("D", DELETE, q)]
        if kind:
            initial, cut = INITIALS[(kind - 1) // 2], CUT * ((kind - 1) % 2)
            if (q, initial) in KEPT:
                out.append(("K", cut, KEPT[q, initial]))
            out.append(("R", REROLE + cut, NEXT[q]))
        return out

    def back(self, at: int, kind: int) -> tuple[int, int]:
        """The state before a row of this kind, and its cost."""
        known = self.scan[at][kind]
        if known is None:
            after = self.vectors[at]
            known = self.scan[at][kind] = self.state(self.inserted(tuple(min(w + after[r] for _, w, r in self.arcs(kind, q)) for q in range(4))))
        return known

    def edits(self, at: int, kind: int, q: int) -> tuple[str, int]:
        """The edits up to and with this row, from state q, where ``at`` is the state behind the row; and the next state."""
        known = self.traces.get((at, kind, q))
        if known is None:
            after, before = self.vectors[at], self.inserted(tuple(min(w + self.vectors[at][r] for _, w, r in self.arcs(kind, p)) for p in range(4)))
            done, now = "", q
            while True:
                tight = [(e, r) for e, w, r in self.arcs(kind, now) if w + after[r] == before[now]]
                if INSERT + before[NEXT[now]] == before[now]:
                    tight.append(("I", NEXT[now]))
                edit, now = min(tight)
                done += edit
                if edit != "I":
                    break
            known = self.traces[at, kind, q] = (done, now)
        return known

    def behind(self, kinds: bytes, end: tuple[int, ...]) -> tuple[list[int], tuple[int, ...]]:
        """The scan: the state behind each row, and the costs before the first."""
        at, total = self.state(end)
        states = []
        for kind in reversed(kinds):
            states.append(at)
            at, off = self.back(at, kind)
            total += off
        return states[::-1], tuple(min(c + total, NEVER) for c in self.vectors[at])

    def matrix(self, kinds: bytes) -> list[int]:
        """Costs from each state to each state, by rows."""
        unit = lambda q: self.inserted(tuple(0 if p == q else NEVER for p in range(4)))
        columns = [self.behind(kinds, unit(q))[1] for q in range(4)]
        return [columns[r][q] for q in range(4) for r in range(4)]

    def trace(self, kinds: bytes, states: list[int], q: int) -> tuple[str, int]:
        out = []
        for kind, at in zip(kinds, states, strict=True):
            edit, q = self.edits(at, kind, q)
            out.append(edit)
        return "".join(out), q


END = Automaton.inserted(ENDS)


def last_edits(q: int) -> str:
    """What is inserted behind the last row."""
    out = ""
    while ENDS[q]:
        out, q = out + "I", NEXT[q]
    return out


def repaired(audit: str, q: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """The rows that the edits leave, from state q."""
    at = 0
    for edit in audit:
        if edit != "I":
            role, text, at = roles[at], texts[at], at + 1
        if edit == "D":
            continue
        q = KEPT[q, role[:1]] if edit == "K" else NEXT[q]
        yield (role, text) if edit == "K" else (ROLE[q], "" if edit == "I" else text)


class Hash:
    """SHA-256 of role:text, newline-joined, as rows come."""

    def __init__(self) -> None:
        self.sha, self.any = hashlib.sha256(), False

    def add(self, rows: Iterator[tuple[str, str]]) -> None:
        for role, text in rows:
            self.sha.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.any = True


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows after damage, by crc32 of ``conv_id:turn`` modulo 20; dropped rows stay, marked as gone."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fate.alias("fate"))
    broken = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    gone = F.col("fate") == 0
    out = rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(gone, "").otherwise(broken).alias("text"), gone.alias("gone"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("n"))
    return out.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")


SUMS = ("blank", "duplicate", "truncated", "illegal")
_PIECE = "conv_id {c}, part int, nr int, open boolean, rows long, first_turn {t}, last_turn {t}, distinct_turns long, first_initial string, last_initial string, illegal long, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, cost long, audit string, repaired_sha256 string"


def _faults(roles: list[str], texts: list[str], repeats: set[int]) -> tuple[bytes, list[int]]:
    """Kinds of the rows, and how many are blank, duplicate, truncated."""
    kinds, n = bytearray(), [0, 0, 0]
    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        bare = text.rstrip(SPACE)
        if not bare:
            n[0] += 1
            kinds.append(0)
        elif i in repeats:
            n[1] += 1
            kinds.append(0)
        else:
            cut = bare[-1] not in ".!?"
            n[2] += cut
            kinds.append(kind_of(role[:1], cut))
    return bytes(kinds), n


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _pieces(schema: pa.Schema, piece_rows: int, piece_chars: int):
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, part = Automaton(), TaskContext.get().partitionId()
        held: dict = {}
        out: list[dict] = []

        def close(more: bool, edge: bool) -> None:
            """Ends the piece; ``more`` if the conversation goes on here, ``edge`` if it may go on in another task."""
            roles, texts, turns = held["roles"], held["texts"], held["turns"]
            initials = [r[:1] for r in roles]
            row = dict.fromkeys(names) | {"conv_id": held["conv"], "part": part, "nr": held["nr"], "open": bool(more or edge or held["nr"] or held["first"]), "rows": len(roles), "illegal": _illegal(initials)}
            row["distinct_turns"] = held["distinct"]
            if roles:
                known = [t for t in turns if t is not None]
                row |= {"first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "first_initial": initials[0], "last_initial": initials[-1]}
            if row["open"]:
                row |= {"roles": roles, "texts": texts}
            else:
                seen: set[tuple[str, str]] = set()
                repeats = {i for i, x in enumerate(zip(roles, texts, strict=True)) if x in seen or seen.add(x)}
                kinds, n = _faults(roles, texts, repeats)
                states, costs = auto.behind(kinds, END)
                audit, q = auto.trace(kinds, states, 0)
                audit += last_edits(q)
                sha = Hash()
                sha.add(repaired(audit, 0, roles, texts))
                row |= dict(zip(SUMS, n, strict=False)) | {"cost": costs[0], "audit": audit, "repaired_sha256": sha.sha.hexdigest()}
            out.append(row)

        def opened(conv: object, nr: int, first: bool) -> dict:
            return {"conv": conv, "nr": nr, "first": first, "roles": [], "texts": [], "turns": [], "distinct": 0, "chars": 0}

        for batch in batches:
            for conv, turn, role, text, gone in zip(*[batch.column(batch.schema.names.index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")], strict=True):
                if not held:
                    held = opened(conv, 0, True)
                elif conv != held["conv"]:
                    close(False, False)
                    held = opened(conv, 0, False)
                if gone:
                    continue
                if held["roles"] and (len(held["roles"]) >= piece_rows or held["chars"] + len(text) > piece_chars):
                    close(True, False)
                    held = opened(conv, held["nr"] + 1, held["first"])
                held["distinct"] += turn is not None and (not held["turns"] or held["turns"][-1] != turn)
                held["roles"].append(role)
                held["texts"].append(text)
                held["turns"].append(turn)
                held["chars"] += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if held:
            close(False, True)
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _fold(pdf):
    """The costs behind every piece of a conversation: four numbers a piece, from sixteen."""
    pdf = pdf.sort_values(["part", "nr"])
    end, ends = END, []
    for m in reversed(list(pdf["matrix"])):
        ends.append(list(end))
        end = tuple(min(NEVER, *(int(m[4 * q + r]) + end[r] for r in range(4))) for q in range(4))
    return pdf[["conv_id", "part", "nr"]].assign(end=ends[::-1], cost=int(end[0]))


def _joined(schema: pa.Schema):
    """Strings the pieces of each conversation together, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: dict = {}
        sha, q, audit, last = Hash(), 0, [], {}

        def closed() -> pa.RecordBatch:
            row["audit"] = "".join(audit) + last_edits(q)
            sha.add(repaired(last_edits(q), q, [], []))
            return pa.RecordBatch.from_pylist([row | {"repaired_sha256": sha.sha.hexdigest()}], schema)

        for batch in batches:
            for i in range(batch.num_rows):
                piece = {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}
                if not row or row["conv_id"] != piece["conv_id"]:
                    if row:
                        yield closed()
                    row = {"conv_id": piece["conv_id"], "first_turn": None, "last_turn": None, "distinct_turns": 0, "cost": piece["cost"]} | dict.fromkeys(SUMS, 0)
                    sha, q, audit, last = Hash(), 0, [], {}
                for k in (*SUMS, "distinct_turns"):
                    row[k] += piece[k]
                if piece["rows"]:
                    row["illegal"] += bool(last) and last["last_initial"] + piece["first_initial"] not in ("su", "ua", "au")
                    row["distinct_turns"] -= piece["first_turn"] is not None and row["last_turn"] == piece["first_turn"]
                    if row["first_turn"] is None:
                        row["first_turn"] = piece["first_turn"]
                    row["last_turn"] = piece["last_turn"] if piece["last_turn"] is not None else row["last_turn"]
                    last = piece
                own = piece["audits"][q]
                sha.add(repaired(own, q, piece["roles"] or [], piece["texts"] or []))
                audit.append(own)
                q = piece["exits"][q]
        if row:
            yield closed()

    return run


def repair(turns: DataFrame, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(conv_id, turn, role, text, gone), as ``damaged`` gives them, to a row for each conversation: faults, cost, audit, digest of the repair."""
    spark = turns.sparkSession
    types = dict(turns.dtypes)
    ddl = _PIECE.format(c=types["conv_id"], t=types["turn"])
    keys = ("conv_id", "turn", "role", "text")
    known = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], "gone")
    rows = known.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    pieces = written(rows.mapInArrow(_pieces(_arrow(spark, ddl), piece_rows, piece_chars), ddl), "pieces")
    whole = pieces.filter("not open")
    cut = pieces.filter("open")

    #: Copies across pieces: the first place of every (conversation, role, text), then the places that aren't the first.
    place = ["conv_id", "part", "nr"]
    digest = F.sha2(F.concat(F.length("e.role").cast("string"), F.lit(":"), "e.role", "e.text"), 256)
    each = cut.select(*place, F.posexplode(F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"))).alias("i", "e")).select(*place, "i", digest.alias("digest"))
    first = each.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "nr", "i")).alias("f"))
    firsts = first.select("conv_id", "f.*").groupBy(*place).agg(F.collect_list("i").alias("firsts"))
    same: Column = (F.col("p.conv_id").eqNullSafe(F.col("f.conv_id"))) & (F.col("p.part") == F.col("f.part")) & (F.col("p.nr") == F.col("f.nr"))
    known = cut.alias("p").join(firsts.alias("f"), same, "left").select("p.*", "f.firsts")

    kinds_ddl = f"conv_id {types['conv_id']}, part int, nr int, kinds binary, matrix array<long>, blank long, duplicate long, truncated long"
    kinds_schema = _arrow(spark, kinds_ddl)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                kinds, n = _faults(r["roles"], r["texts"], set(range(r["rows"])) - set(r["firsts"] or []))
                out.append({"conv_id": r["conv_id"], "part": r["part"], "nr": r["nr"], "kinds": kinds, "matrix": auto.matrix(kinds)} | dict(zip(SUMS, n, strict=False)))
            yield pa.RecordBatch.from_pylist(out, kinds_schema)

    marked = written(known.select(*place, "rows", "roles", "texts", "firsts").mapInArrow(coded, kinds_ddl), "kinds")
    ends = marked.select(*place, "matrix").groupBy("conv_id").applyInPandas(_fold, f"conv_id {types['conv_id']}, part int, nr int, end array<long>, cost long")
    on_piece = lambda a, b: (F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))) & (F.col(f"{a}.part") == F.col(f"{b}.part")) & (F.col(f"{a}.nr") == F.col(f"{b}.nr"))
    faced = marked.alias("m").join(ends.alias("e"), on_piece("m", "e")).select("m.conv_id", "m.part", "m.nr", "m.kinds", "m.blank", "m.duplicate", "m.truncated", "e.end", "e.cost")
    traced_ddl = f"conv_id {types['conv_id']}, part int, nr int, blank long, duplicate long, truncated long, cost long, audits array<string>, exits array<int>"
    traced_schema = _arrow(spark, traced_ddl)

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                states, costs = auto.behind(r["kinds"], tuple(r["end"]))
                both = [auto.trace(r["kinds"], states, q) if costs[q] < NEVER else ("", q) for q in range(4)]
                out.append({k: r[k] for k in ("conv_id", "part", "nr", "blank", "duplicate", "truncated", "cost")} | {"audits": [a for a, _ in both], "exits": [e for _, e in both]})
            yield pa.RecordBatch.from_pylist(out, traced_schema)

    traces = faced.mapInArrow(traced, traced_ddl)
    full = cut.drop("blank", "duplicate", "truncated", "cost", "audit", "repaired_sha256", "open").alias("p").join(traces.alias("t"), on_piece("p", "t"))
    full = full.select("p.*", "t.blank", "t.duplicate", "t.truncated", "t.cost", "t.audits", "t.exits").repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "part", "nr")
    out_ddl = f"conv_id {types['conv_id']}, first_turn {types['turn']}, last_turn {types['turn']}, distinct_turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    names = [c.split()[0] for c in out_ddl.split(", ")]
    strung = full.mapInArrow(_joined(_arrow(spark, out_ddl)), out_ddl)
    every = whole.select(*names).unionByName(strung)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct_turns"), F.lit(0)).cast("long")
    return every.select("conv_id", gaps.alias("gaps"), *SUMS, "cost", "audit", "repaired_sha256")
