"""Operator 8: WARC archives written and read as a chunked record table.

Writing: equal payloads of 1000 bytes and more are found by length and digest,
without moving payloads; the record with the largest page id is the response,
the others revisit it. Each task streams its records into one archive, a gzip
member per record. Reading: records come as rows of (record, chunk number) with
the bytes and the digest so far, so a payload of any size takes one chunk of
memory; the last chunk's row has the record's whole length and digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import sliced, small_side, table, written
from reelsift.session import file_system, replace_file, shared_dir

LEAST = 1000
CHUNK = 1 << 20
READ = 1 << 18
ID = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SHARDS = "shard int, n_records long"
CHUNKS = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int64()),
        ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_()),
    ]
)
CHUNK_COLUMNS = "page_id long, url string, record_type string, refers_to long, chunk long, data binary, bytes_so_far long, sha1_so_far string, last boolean"


def decided(pages: DataFrame) -> DataFrame:
    """Adds ``_digest`` (hex SHA-1) and ``_refers_to`` (null: a response) to pages (page_id, url, html).

    ``_again`` and ``_target_again`` say that other rows have the row's id, or
    that of the response. Null html counts as empty. Rows without an id are
    responses and nothing refers to them; rows that repeat the largest id are
    responses, too.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    narrow = written(pages.select("page_id", F.sha1(html).alias("_digest"), F.octet_length(html).alias("_n")).where(F.col("_n") >= LEAST), "warc-digests")
    kept = narrow.groupBy("_digest", "_n").agg(F.max("page_id").alias("_refers_to"), F.count("*").alias("_c")).where("_c > 1")
    revisits = narrow.join(kept, ["_digest", "_n"]).where("page_id < _refers_to").select("page_id", "_digest", "_refers_to").distinct()
    revisits = small_side(written(revisits, "warc-revisits"))
    again = small_side(written(pages.groupBy("page_id").agg(F.count("*").alias("_c")).where("_c > 1 OR page_id IS NULL").select("page_id"), "warc-repeated"))
    own, target = (again.select(F.col("page_id").alias(c), F.lit(True).alias(f)) for c, f in (("_id", "_again"), ("_id2", "_target_again")))
    out = pages.withColumn("_digest", F.sha1(html)).join(revisits, ["page_id", "_digest"], "left")
    return out.join(own, F.col("page_id").eqNullSafe(F.col("_id")), "left").join(target, F.col("_refers_to") == F.col("_id2"), "left").drop("_id", "_id2")


def header(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, place: str = "", target_again: bool = False) -> bytes:
    """Header and HTTP head of a record; the payload follows if it is a response.

    place: what tells its id from those of other records of the page. A URI is
    written as it is but for characters that no header can hold; those are
    escaped for other readers, and the URI's own bytes follow in a field that
    ``read_chunks`` knows.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = len(http) + (size if refers_to is None else 0)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{page_id}{place}>"]
    if url is not None:
        shown = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {shown}")
        if shown != url:
            lines.append("X-Target-URI-Base64: " + base64.b64encode(url.encode()).decode())
    # The date is fixed, so equal inputs give equal archives.
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()]
    if refers_to is not None:
        lines += [f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {PROFILE}"]
        if not target_again:  # else no one record is meant
            lines.append(f"WARC-Refers-To: <{ID}{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}", "", ""]
    return "\r\n".join(lines).encode() + http


def write_record(out, page_id, url, payload: bytes, digest: str, refers_to, place: str = "", target_again: bool = False) -> None:
    """One gzip member; the payload is fed to it in slices."""
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    out.write(pack.compress(header(page_id, url, digest, len(payload), refers_to, place, target_again)))
    view = memoryview(payload)
    for at in range(0, len(view) if refers_to is None else 0, READ):
        out.write(pack.compress(view[at : at + READ]))
    out.write(pack.compress(b"\r\n\r\n"))
    out.write(pack.flush())


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of pages in ``folder``; one row per archive: shard, n_records.

    A task that is run again replaces its archive by the same records. Record
    ids are unique: where rows repeat an id, or have none, theirs name the shard
    and the place in it. Very long payloads are written in slices. Other columns
    are ignored. An empty table writes empty archives or none.
    """
    rows = decided(pages.select("page_id", "url", "html")).select("page_id", "url", "html", "_digest", "_refers_to", "_again", "_target_again")

    def run(batches):
        shard, n = TaskContext.get().partitionId(), 0
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        final = f"{path}/pages-{shard:06d}.warc.gz"
        temp = f"{final}.{uuid.uuid4().hex}"
        with fs.open_output_stream(temp, compression=None) as out:
            for batch in batches:
                for part in sliced(batch, 256):
                    columns = [part.column(0), part.column(1), part.column(2).cast(pa.binary()), *part.columns[3:]]
                    for page_id, url, html, digest, refers_to, again, target_again in zip(*(c.to_pylist() for c in columns), strict=True):
                        write_record(out, page_id, url, html or b"", digest, refers_to, f":{shard}-{n}" if again else "", bool(target_again))
                        n += 1
        replace_file(fs, temp, final)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "n_records": n}], pa.schema([("shard", pa.int32()), ("n_records", pa.int64())]))

    return rows.mapInArrow(run, SHARDS)


class Inflated:
    """Bytes of a file of gzip members, inflated a little at a time."""

    def __init__(self, file):
        self.file, self.unpack, self.raw, self.held = file, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.file.read(READ)
                if not self.raw:
                    return False
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            got = self.unpack.decompress(self.raw, CHUNK)
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the file."""
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends within a record")
                return None
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def take(self, n: int):
        """n bytes in pieces of ``CHUNK`` at most."""
        while n:
            while len(self.held) < min(n, CHUNK) and self._more():
                pass
            if not self.held:
                raise ValueError("the archive ends within a record")
            got = self.held[: min(n, CHUNK)]
            self.held = self.held[len(got) :]
            n -= len(got)
            yield got


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:]) if v}


def _page(record_id: str | None) -> int | None:
    text = (record_id or "").strip("<>").removeprefix(ID).partition(":")[0]
    return int(text) if re.fullmatch(r"-?\d+", text) else None


def read_chunks(file, data: bool = True):
    """Rows of ``CHUNKS`` of an archive; a digest that doesn't fit its record is an error."""
    source = Inflated(file)
    while (head := source.until(b"\r\n\r\n")) is not None:
        h = _fields(head)
        http = source.until(b"\r\n\r\n")
        kind, declared = h["warc-type"], base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
        url = base64.b64decode(h["x-target-uri-base64"]).decode() if "x-target-uri-base64" in h else h.get("warc-target-uri")
        row = {"page_id": _page(h["warc-record-id"]), "url": url, "record_type": kind, "refers_to": _page(h.get("x-refers-to-page") or h.get("warc-refers-to"))}
        if kind == "revisit":
            yield row | {"chunk": 0, "data": None, "bytes_so_far": int(_fields(http)["content-length"]), "sha1_so_far": declared, "last": True}
        else:
            left, so_far, digest = int(h["content-length"]) - len(http), 0, hashlib.sha1()
            if not left:
                yield row | {"chunk": 0, "data": b"" if data else None, "bytes_so_far": 0, "sha1_so_far": digest.hexdigest(), "last": True}
            for i, piece in enumerate(source.take(left)):
                digest.update(piece)
                so_far += len(piece)
                yield row | {"chunk": i, "data": piece if data else None, "bytes_so_far": so_far, "sha1_so_far": digest.hexdigest(), "last": so_far == left}
            if digest.hexdigest() != declared:
                raise ValueError(f"record {row['page_id']} has another digest than its header")
        if b"".join(source.take(4)) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it should")


def read(spark, folder: str, shards: list, data: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``shards`` (rows of ``write``, one for each file).

    Without ``data`` the bytes are read and hashed but not returned.
    """
    rows = [(s["shard"],) for s in shards if s["n_records"]]
    listed = spark.createDataFrame(rows, "shard int")
    listed = listed.repartitionByRange(len(rows), "shard") if rows else listed

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                fs, path = file_system(folder)
                held, size = [], 0
                with fs.open_input_stream(f"{path}/pages-{shard:06d}.warc.gz", compression=None) as file:
                    for row in read_chunks(file, data):
                        held.append(row)
                        size += len(row["data"] or b"") + 200
                        if size > 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(held, CHUNKS)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, CHUNKS)

    return listed.mapInArrow(run, CHUNK_COLUMNS)


def op8_warc(spark, sf_dir):
    folder = f"{shared_dir(spark)}/reelsift-warc-{uuid.uuid4().hex}"
    chunks = read(spark, folder, write(table(spark, sf_dir, "pages"), folder).collect(), data=False)
    return chunks.where("last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type", "refers_to"
    )


OP8_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY ALL
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id < k.keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < k.keep THEN k.keep END AS refers_to
FROM p LEFT JOIN k USING (payload_digest, payload_bytes)
"""
