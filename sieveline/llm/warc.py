"""WARC archives with an external index: sorted capture runs, merged by a loser tree into globally ordered capture histories.

Every task appends records (WARC/1.1, one gzip member each) to an archive file in the shared folder and notes them in a run: url key,
time, file, offset, length. A run is bounded; when it is full it is sorted and goes out, and the next file begins. Runs are a
written table, so what a lost or repeated task left behind is an archive that no run names.

The index is merged outside memory: sampled splitters of (url key, time, id, run, place in the run) cut the key space into ranges of
bounded size, every range gets its stretch of each run, and a loser tree of k leaves merges the k stretches, with one comparison a
level. Ranges follow one another, so the histories are globally ordered; a url with very many captures is cut by time. Records are read
back through that index, dealt by (file, offset), so each task reads stretches of files from front to end.

Of records with equal payloads (by SHA-256) of ``least_bytes`` or more the smallest id is stored, the others revisit it (profile
identical-payload-digest: HTTP headers only). The smallest ids are combined before they are shuffled; payloads meet them in a join that
Spark splits where a payload is hot.

Defined cases: a null payload is empty; rows that share the smallest id of a payload are responses all; a null id is larger than any
other, and where all are null all are responses; a null url is empty, and control characters and blanks in urls are percent-encoded; an
empty table gives an empty one; columns beside the three that are named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import folder, shuffle_partitions, written

#: Entries of a run and payload bytes of a file, at most (one record may be larger); entries of a range of the merge.
RUN_ROWS, FILE_BYTES, RANGE_ROWS = 20_000, 1 << 27, 100_000
EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)
# Names of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RUN_DDL = "run string, seq long, url_key string, time string, page_id string, url string, record_type string, digest string, file string, offset long, length long"
RECORD_DDL = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def url_key(url: str) -> str:
    """Sort-friendly: host from the top label down, without www, user and default port; path and query in lower case; no fragment."""
    scheme, host, path, query = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://)?([^/?#]*)([^?#]*)(\?[^#]*)?", url).groups()
    host = re.sub(r":(80|443)?$", "", host.rpartition("@")[2].lower()).rstrip(".")
    host = re.sub(r"^www\d*\.", "", host)
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (path.lower() or "/") + (query or "").lower()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def captured_at(ident: str | None) -> datetime:
    """Without a time of capture: seconds since 2000 as the id says, so that histories have an order."""
    return EPOCH + timedelta(seconds=int(ident) % 1_000_000_000 if ident and ident.lstrip("-").isdigit() else 0)


def _urn(ident: str | None) -> str:
    return "<urn:page>" if ident is None else f"<urn:page:{quote(ident, safe='')}>"


def _ident(urn: str) -> str | None:
    return unquote(urn[10:-1]) if urn.startswith("<urn:page:") else None


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"not a record: {lines[0]}")
    return fields, rest[:size]


class Archive:
    """A file that records are appended to, and the run that names them."""

    def __init__(self, path: str) -> None:
        self.name = uuid.uuid4().hex
        self.path, self.offset, self.bytes, self.entries = f"{path}/{self.name}.warc.gz", 0, 0, []
        files, at = fs.FileSystem.from_uri(self.path)
        self.out = files.open_output_stream(at, compression=None)
        self.write("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.UUID(self.name)}>", "WARC-Date": EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ"), "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")

    def write(self, kind: str, fields: dict[str, str], block: bytes) -> tuple[int, int]:
        member = record(kind, fields, block)
        self.out.write(member)
        at, self.offset = self.offset, self.offset + len(member)
        return at, len(member)

    def add(self, ident: str | None, url: str, payload: bytes, refers_to: str | None, revisit: bool) -> None:
        when, sha = captured_at(ident), digest(payload)
        uri = quote(url, safe="".join(map(chr, range(33, 127))))
        fields = {"WARC-Record-ID": _urn(ident), "WARC-Target-URI": uri, "WARC-Date": when.strftime("%Y-%m-%dT%H:%M:%SZ"), "WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": "application/http; msgtype=response"}
        if revisit:
            fields |= {"WARC-Refers-To": _urn(refers_to), "WARC-Profile": PROFILE}
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        kind = "revisit" if revisit else "response"
        at, size = self.write(kind, fields, head if revisit else head + payload)
        self.bytes += len(payload)
        self.entries.append((url_key(url), when.strftime("%Y%m%d%H%M%S"), ident, uri, kind, sha, at, size))

    def run(self, schema: pa.Schema) -> pa.RecordBatch:
        """Closes the file and gives its run, sorted."""
        self.out.close()
        rows = sorted(self.entries, key=lambda e: (e[0], e[1], e[2] is None, e[2] or "", e[6]))
        return pa.RecordBatch.from_pylist([{"run": self.name, "seq": i, "url_key": e[0], "time": e[1], "page_id": e[2], "url": e[3], "record_type": e[4], "digest": e[5], "file": self.path, "offset": e[6], "length": e[7]} for i, e in enumerate(rows)], schema)


def _schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, run_rows: int = RUN_ROWS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes (page_id, url, html) into archives under ``path``, a folder that executors share; returns their sorted runs, a written table."""
    spark = pages.sparkSession
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("sha", F.when(F.octet_length("payload") >= least_bytes, F.sha2("payload", 256)))
    first = keyed.filter("sha is not null").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    known = keyed.join(first, "sha", "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    known = known.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("first").cast("string").alias("refers_to"), revisit.alias("revisit"))
    schema = _schema(spark, RUN_DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for i in range(batch.num_rows):
                archive = archive or Archive(path)
                archive.add(*(batch.column(c)[i].as_py() for c in range(5)))
                if len(archive.entries) >= run_rows or archive.bytes >= file_bytes:
                    yield archive.run(schema)
                    archive = None
        if archive:
            yield archive.run(schema)

    return written(known.mapInArrow(run, RUN_DDL), "runs")


class LoserTree:
    """Merges k sorted sequences: inner nodes keep the loser of their match, so a new key plays one match a level."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.tree = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self.play(leaf)

    def before(self, a: int, b: int) -> bool:
        """Whether leaf a's key comes first; sequences at their end come last, equal keys go by leaf."""
        if self.at[a] == len(self.runs[a]) or self.at[b] == len(self.runs[b]):
            return self.at[b] == len(self.runs[b]) and (self.at[a] < len(self.runs[a]) or a < b)
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:  # while the tree is filled, the first to come waits
                self.tree[node] = winner
                return
            if self.before(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(leaf, place in its sequence), in the order of the keys."""
        for _ in range(sum(map(len, self.runs))):
            leaf = self.tree[0]
            yield leaf, self.at[leaf]
            self.at[leaf] += 1
            self.play(leaf)


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The runs (a written table) in one global order: ``place`` counts captures by url key, time and id from 0 on."""
    spark = runs.sparkSession
    ranges = max(shuffle_partitions(spark), -(-runs.count() // range_rows))
    schema = _schema(spark, f"{RUN_DDL}, part int, nr long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema(list(schema)[:-2]))  # one range, of bounded size
        if not table.num_rows:
            return
        cols = {c: table.column(c).to_pylist() for c in ("run", "url_key", "time", "page_id", "offset")}
        keys = [(k, t, i is None, i or "", o) for k, t, i, o in zip(cols["url_key"], cols["time"], cols["page_id"], cols["offset"], strict=True)]
        bounds = [0, *(i for i in range(1, len(keys)) if cols["run"][i] != cols["run"][i - 1]), len(keys)]
        tree = LoserTree([keys[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
        order = [bounds[leaf] + at for leaf, at in tree]
        merged = table.take(order).append_column("part", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32())).append_column("nr", pa.array(range(len(order)), pa.int64()))
        yield from merged.cast(schema).to_batches()

    # The order of the stretches is that of the runs, so ranges are cut by the same keys, in the same order.
    dealt = runs.repartitionByRange(ranges, "url_key", "time", F.col("page_id").isNull(), "page_id", "offset", "run").sortWithinPartitions("run", "seq")
    merged = written(dealt.mapInArrow(run, f"{RUN_DDL}, part int, nr long"), "captures")
    parts = merged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    ahead = parts.select("part", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part")) - F.col("n")).alias("before"))
    return merged.join(F.broadcast(ahead), "part").withColumn("place", F.col("before") + F.col("nr")).drop("part", "nr", "before")


def read_archives(captures: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records that an index names: place, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null unless kept).

    Length and digest are those of the whole payload, for revisits as their headers say. A record that doesn't hold what its index
    entry or its digest says is an error.
    """
    spark = captures.sparkSession
    ddl = f"place long, {RECORD_DDL}"
    schema = _schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            out, held = [], 0
            for e in batch.to_pylist():
                if e["file"] != name:
                    files, at = fs.FileSystem.from_uri(e["file"])
                    name, source = e["file"], files.open_input_file(at)
                source.seek(e["offset"])
                fields, block = parsed(source.read(e["length"]))
                head, _, payload = block.partition(b"\r\n\r\n")
                sha, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                size = int(re.search(rb"(?i)\ncontent-length: *(\d+)", head).group(1))
                if (kind, sha) != (e["record_type"], e["digest"]) or kind == "response" and (digest(payload) != sha or len(payload) != size):
                    raise ValueError(f"{name} at {e['offset']}: not the record of the index")
                refers = _ident(fields["warc-refers-to"]) if kind == "revisit" else None
                out.append({"place": e["place"], "page_id": _ident(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload_bytes": size, "payload_digest": sha, "record_type": kind, "refers_to": refers, "payload": payload if keep_payload else None})
                held += len(payload) * keep_payload
                if held > 1 << 24:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)

    dealt = captures.select("file", "offset", "length", "record_type", "digest", "place").repartitionByRange(shuffle_partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, ddl)


def archived(pages: DataFrame, least_bytes: int = 0, keep_payload: bool = False) -> DataFrame:
    """Writes pages into archives, merges their index, and reads the records back through it; ids have the type they had."""
    kind = dict(pages.dtypes)["page_id"]
    runs = write_archives(pages, folder(pages.sparkSession, "archives", made=True), least_bytes)
    out = read_archives(merge_runs(runs), keep_payload)
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
