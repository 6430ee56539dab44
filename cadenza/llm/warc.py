"""WARC archives: a writer with revisit records and a sequential reader.

A record is one gzip member.  The reader inflates a member piece by piece,
frames the record by its content length and verifies its digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import Scratch, pieces

#: Smaller payloads are always written in full.
REVISIT_BYTES = 1000
#: An archive is closed beyond so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 18
#: Fixed by the format.
VERSION = b"WARC/1.1"
PROFILE = ("http://netpreserve.org/warc/1.1/revisit/"
           "identical-payload-digest")
DATE = "2024-01-01T00:00:00Z"
URN = "urn:x-page:"


def plan_records(scratch: Scratch, pages: DataFrame, page_id: str = "page_id",
                 url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to) for every row.

    Equal payloads of at least REVISIT_BYTES form a group; the largest
    page_id is written in full, and the others refer to it.  A null html is
    an empty payload.  Rows that repeat the largest page_id are all written
    in full; a null page_id refers to it, or is written in full if the group
    has no id.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("payload")).withColumns({
            "digest": F.sha1("payload"),
            "size": F.octet_length("payload").cast("long")})
    # written, so that its size decides between broadcast and merge join
    groups = scratch.keep(
        rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(
            F.max("page_id").alias("full"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "full"), "payload-groups")
    return rows.join(groups, "digest", "left").select(
        "page_id", "url", "payload", "digest", "size",
        F.when(F.col("page_id").eqNullSafe(F.col("full")), None)
        .otherwise(F.col("full")).alias("refers_to"))


def write_archives(scratch: Scratch, records: DataFrame) -> DataFrame:
    """Write records into ``*.warc.gz`` files of the shared folder.

    Returns the written list (path, records, bytes).  Every attempt of a task
    writes files of its own names, and only those of the attempt that
    succeeded are in the list.
    """
    folder = scratch.path("warc")
    rows = records.select("page_id", "url", "payload", "digest", "size",
                          "refers_to")

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, count, size = None, "", 0, 0
        for batch in batches:
            for piece in pieces(batch):
                for row in piece.to_pylist():
                    if out is None:
                        path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(path,
                                                       compression=None)
                        count = size = 0
                    member = gzip_member(record(**row))
                    out.write(member)
                    count, size = count + 1, size + len(member)
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                        yield _listed(path, base, folder, count, size)
        if out is not None:
            out.close()
            yield _listed(path, base, folder, count, size)
    return scratch.stage(rows.mapInArrow(
        run, "path string, records bigint, bytes bigint"), "archives")


def _listed(path, base, folder, count, size):
    return pa.RecordBatch.from_pydict({
        "path": [folder + path[len(base):]], "records": [count],
        "bytes": [size]})


def gzip_member(content: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def _digest(content: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()


def _clean(value: str) -> str:
    """A header value; control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}"
                   for c in value)


def record(page_id, url, payload: str, digest: str, size: int,
           refers_to) -> bytes:
    """One response record, or a revisit that holds the HTTP head alone."""
    content = payload.encode("utf-8", "replace")
    head = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    block = head if refers_to is not None else head + content
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<{URN}{_name(page_id)}>"),
              ("WARC-Date", DATE),
              ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Block-Digest", _digest(block)),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(
                  bytes.fromhex(digest)).decode())]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{URN}{_name(refers_to)}>"),
                   ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _name(page_id) -> str:
    return "" if page_id is None else _clean(str(page_id))


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after the other."""
    inflate, parts, rest = None, [], b""
    while True:
        chunk = rest or stream.read(READ_BYTES)
        rest = b""
        if not chunk:
            if inflate is not None:
                raise ValueError("archive ends inside a record")
            return
        if inflate is None:
            inflate = zlib.decompressobj(31)
        parts.append(inflate.decompress(chunk))
        if inflate.eof:
            yield b"".join(parts)
            rest, inflate, parts = inflate.unused_data, None, []


def parse(member: bytes) -> dict:
    """The fields of a record; ``verified`` if all its digests hold."""
    head, mark, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode().lower()] = value.decode().strip()
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    block = rest[:length]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n")
                if line.lower().startswith(b"content-length:"))
    kind, digest = fields["warc-type"], fields["warc-payload-digest"]
    verified = _digest(block) == fields["warc-block-digest"] and (
        kind == "revisit" or len(payload) == size
        and _digest(payload) == digest)
    return {"page_id": _id(fields["warc-record-id"]),
            "url": fields.get("warc-target-uri"),
            "payload": payload if kind == "response" else None,
            "payload_bytes": size,
            "payload_digest": base64.b32decode(digest[5:]).hex(),
            "record_type": kind, "refers_to": _id(fields.get(
                "warc-refers-to")), "verified": verified}


def _id(urn: str | None) -> str | None:
    return (urn or "").strip("<>").removeprefix(URN) or None


def read_archives(archives: DataFrame, id_type: str = "bigint",
                  payloads: bool = True) -> DataFrame:
    """One row per record of the listed archives.

    ``archives`` has a column ``path``; an archive is read from its start to
    its end by one task, so write archives of moderate size.  A revisit has
    no payload of its own.  A broken archive is an error, a digest that does
    not hold is ``verified = false``; an empty list gives no row.
    """
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest",
             "record_type", "refers_to", "verified"]
    kinds = ["string", "string", "binary", "bigint", "string", "string",
             "string", "boolean"]
    if not payloads:
        del names[2], kinds[2]
    kind = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary(),
                           "boolean": pa.bool_()}.get(k, pa.string()))
                      for n, k in zip(names, kinds)])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as s:
                    rows, size = [], 0
                    for member in members(s):
                        rows.append(parse(member))
                        size += len(member)
                        if size > (8 << 20):
                            yield pa.RecordBatch.from_pylist(
                                [{n: r[n] for n in names} for r in rows],
                                kind)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(
                        [{n: r[n] for n in names} for r in rows], kind)
    count = max(1, archives.count())
    read = archives.select("path").repartition(count).mapInArrow(
        run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return read.withColumns({c: F.col(c).cast(id_type)
                             for c in ("page_id", "refers_to")})
