"""WARC archives: one gzip member per record, written by Spark tasks and read again sequentially.

Archives lie in a folder that all executors reach, by any file system that pyarrow opens from its URI. Each writing
task streams to one archive of its own name; the list of archives that counts is the one the successful tasks return,
so a task that is repeated leaves a file that nothing reads.

Payloads: null is empty, text is UTF-8. Of records with equal payloads the one with the largest id is a response and the
others revisit it; rows that repeat that largest id are responses too, as are rows with a null id. An empty table
gives no archives and no records. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean, payload binary"
_BLOCK = 1 << 16
#: Fixed values of the format.
_VERSION, _END, _MAGIC = b"WARC/1.1\r\n", b"\r\n\r\n", b"\x1f\x8b\x08"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return "" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. refers_to: the id of the response that it revisits, or None."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id) or f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[2:2] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
    head = _VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + _END) + packer.flush()


class Members:
    """The bytes of a stream of gzip members, decompressed a piece at a time; take() and line() wait for as much as they need, but not beyond the member that begin() opened."""

    def __init__(self, stream):
        self.stream, self.raw, self.data, self.member = stream, b"", bytearray(), None
        self.opened = False

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(_BLOCK)
            if not self.raw:
                if self.member is not None:
                    raise ValueError("the archive ends within a gzip member")
                return False
        if self.member is None:
            if self.opened:
                raise ValueError("a record goes on beyond its gzip member")
            self.member, self.opened = zlib.decompressobj(31), True
        self.data += self.member.decompress(self.raw, _BLOCK)
        self.raw = self.member.unconsumed_tail or self.member.unused_data
        if self.member.eof:
            self.member = None
        return True

    def begin(self) -> bool:
        """Opens the next member; whether there is one."""
        self.opened = False
        return self._more()

    def finish(self) -> None:
        """Reads the end of the member, which must hold no more."""
        while self.member is not None and not self.data:
            self._more()
        if self.data:
            raise ValueError("a gzip member holds more than its record")

    def skip(self) -> None:
        """Goes to the end of a damaged member, or, where it can't be decompressed, to where the next seems to begin."""
        try:
            while self.member is not None:
                self.data.clear()
                self._more()
        except (ValueError, zlib.error):
            self.member, at = None, 1
            while (found := self.raw.find(_MAGIC, at)) < 0:
                more = self.stream.read(_BLOCK)
                if not more:
                    found = len(self.raw)
                    break
                self.raw, at = self.raw[-2:] + more, 0
            self.raw = self.raw[found:]
        self.data.clear()

    def line(self) -> bytes:
        at = 0
        while (end := self.data.find(b"\r\n", at)) < 0:
            at = max(0, len(self.data) - 1)
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.data[:end])
        del self.data[: end + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.data[:n])
        del self.data[:n]
        return out


def _record(members: Members) -> tuple[dict[str, str], bytes]:
    version = members.line()
    if not version.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields: dict[str, str] = {}
    while line := members.line():
        k, _, v = line.decode().partition(":")
        fields[k.strip().lower()] = v.strip()
    block = members.take(int(fields["content-length"]))
    if members.take(4) != _END:
        raise ValueError("a record is longer than its Content-Length")
    members.finish()
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"block digest of {fields.get('warc-record-id')} differs")
    return fields, block


def records(stream, damage: list[str] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, one to a gzip member, framed by its Content-Length, with the block digest verified.

    A damaged record raises an error; with a list, what is wrong goes there and reading goes on with the next member.
    """
    members = Members(stream)
    while True:
        try:
            if not members.begin():
                return
            fields, block = _record(members)
        except (ValueError, KeyError, zlib.error) as wrong:
            if damage is None:
                raise
            damage.append(f"{type(wrong).__name__}: {wrong}")
            members.skip()
            continue
        yield fields, block


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn.startswith("<urn:page:") else None


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the largest id with an equal payload, null for that row itself.

    Payloads are told apart by SHA-1. Only ids and keys take part in the grouping, which combines on the map side, and in the
    join on the key; a payload is shuffled once, by its id and key, so a page that is copied often sends its bytes to many tasks.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("key", F.sha1("payload"))
    last = rows.groupBy("key").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "last")
    revisits = rows.select("page_id", "key").join(last, "key").filter("page_id < last").select(F.col("page_id").alias("id"), F.col("key").alias("k"), F.col("last").alias("refers_to")).distinct()
    return rows.join(revisits, (F.col("page_id") == F.col("id")) & (F.col("key") == F.col("k")), "left").select("page_id", "url", "payload", "refers_to")


def write(marked: DataFrame, folder: str) -> DataFrame:
    """Writes archives into folder; returns (path, n_records, n_bytes), stored."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, out, n, size = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    out = out or system.open_output_stream(f"{root}/{name}", compression=None)
                    member = record(row["page_id"], row["url"], row["payload"], row["refers_to"])
                    out.write(member)
                    n, size = n + 1, size + len(member)
        finally:
            if out:
                out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [size]})

    return stored(marked.mapInArrow(task, "path string, n_records long, n_bytes long"), "warc-list")


def _payload(fields: dict[str, str], block: bytes) -> tuple:
    """The row (see RECORD) of a record; its payload's length and digest verified."""
    http, _, payload = block.partition(b"\r\n\r\n")
    told = fields["warc-payload-digest"].removeprefix("sha1:")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (digest(payload) != told or length != len(payload)):
        raise ValueError(f"payload digest of {fields['warc-record-id']} differs")
    return _page(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], _page(fields.get("warc-refers-to")), length, told, not revisit, None if revisit else payload


def damaged(archives: DataFrame) -> DataFrame:
    """(path, n_records, errors): what is wrong in archives (a column path), and how many records are whole in each. Reading goes on after a damaged record."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                wrong: list[str] = []
                n = 0
                with system.open_input_stream(at, compression=None) as stream:
                    for fields, block in records(stream, wrong):
                        try:
                            _payload(fields, block)
                            n += 1
                        except (ValueError, KeyError, StopIteration) as error:
                            wrong.append(f"{type(error).__name__}: {error}")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([wrong], pa.list_(pa.string()))], ["path", "n_records", "errors"])

    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(task, "path string, n_records long, errors array<string>")


def scan(archives: DataFrame, strict: bool = True) -> DataFrame:
    """The records of archives (a column path), see RECORD. A revisit has no payload; its bytes and digest are those of its header. A damaged record raises an error or, unless strict, is passed over; damaged() tells of it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_stream(at, compression=None) as stream:
                    rows: list[tuple] = []
                    held = 0
                    for fields, block in records(stream, None if strict else []):
                        try:
                            rows.append(_payload(fields, block))
                        except (ValueError, KeyError, StopIteration):
                            if strict:
                                raise
                            continue
                        held += len(block)
                        if len(rows) >= 1000 or held > 1 << 24:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in RECORD.split(", ")])

    # a rebalanced list: as many readers as archives allow, each taking whole archives
    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(task, RECORD)
