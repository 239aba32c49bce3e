"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

``write_monolithic`` writes pages as WARC records into files that are one gzip
stream each, as some crawlers leave them.  ``normalise`` inflates such a file once
from its start, rewrites every record as a gzip member of its own and writes a
sidecar index (``.idx``, one JSON line per record) beside the new file.
``read_records`` then reads single members by file, offset and length.

Pages with equal payloads (SHA-1 and length) are stored once: the page with the
largest id is the response, the others are revisits that refer to it and hold no
payload.  Rows that repeat that id and payload are all responses.  A null payload
is the empty payload; a null id is never the largest while another exists, and
records without any id are responses.  An empty table writes no files and gives
no rows; other columns are ignored whatever their names.

Files go to a folder that all executors share (any store that ``pyarrow.fs``
opens by URI).  A file is named by partition and task attempt and is used only if
its task succeeded, so a lost executor leaves nothing half-written in a result.
Records are streamed one by one and files roll over at ``FILE_BYTES``.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.merge_automaton import in_slices
from parcelgrid.llm.shipping import ship_package

FILE_BYTES = 128 << 20
CHUNK = 1 << 18
SEGMENT = 8 << 20  # bytes of archive that one reading task takes
LEVEL = 6
GZIP = 31  # zlib's window setting for gzip members
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, record_id string, record_type string"


def _record_id(page_id) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def make_record(page_id, url: str | None, payload: bytes, size: int, sha1: str, is_response: bool, refers_to) -> bytes:
    """One uncompressed record; ``size`` and ``sha1`` (hex) are those of the whole payload."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:x-page:unknown")
    block = b""
    head = [("WARC-Type", "response" if is_response else "revisit"), ("WARC-Record-ID", _record_id(page_id)),
            ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("X-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response")]
    if is_response:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
        block = http.encode() + payload
    else:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to))]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (the HTTP body of a response; empty for a revisit)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _task_name() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else "local-0"


def assign_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Pages with payload size, SHA-1, ``is_response`` and ``refers_to``; revisits carry no payload.

    Equal payloads are one in the task that reads them, so a payload that very many
    pages share is moved once a task; beside it only ids, URLs and digests move.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    stored = rows.groupBy("sha1", "size").agg(F.first("payload").alias("payload"), F.max("page_id").alias("largest"))
    held = rows.drop("payload").join(stored, ["sha1", "size"])
    is_response = F.col("page_id").eqNullSafe(F.col("largest"))
    return held.select("page_id", "url", F.when(is_response, F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
                       "size", "sha1", is_response.alias("is_response"),
                       F.when(~is_response, F.col("largest")).alias("refers_to"))


def write_monolithic(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write ``assign_records``' rows; (file) of each file written, one gzip stream each."""
    ship_package(records.sparkSession)

    def run(batches):
        store, root = _store(folder)
        out = packer = None
        written, number, name, files = 0, 0, _task_name(), []
        for batch in in_slices(batches):
            for row in batch.to_pylist():
                if out is None:
                    path = f"{root}/whole-{name}-{number}.warc.gz"
                    store.create_dir(root, recursive=True)
                    out, packer = store.open_output_stream(path, compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                    files.append(path.rsplit("/", 1)[1])
                record = make_record(row["page_id"], row["url"], row["payload"], row["size"], row["sha1"],
                                     row["is_response"], row["refers_to"])
                out.write(packer.compress(record))
                written += len(record)
                if written >= file_bytes:
                    out.write(packer.flush())
                    out.close()
                    out, written, number = None, 0, number + 1
        if out is not None:
            out.write(packer.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], ["file"])

    return records.mapInArrow(run, "file string").checkpoint()  # names of finished files only


def _inflated(stream) -> Iterator[bytes]:
    """Chunks of a gzip file, whatever the number of its members."""
    unpacker = zlib.decompressobj(GZIP)
    while data := stream.read(CHUNK):
        while data:
            chunk = unpacker.decompress(data, 1 << 22)
            if chunk:
                yield chunk
            data = unpacker.unconsumed_tail
            if unpacker.eof:
                data, unpacker = unpacker.unused_data, zlib.decompressobj(GZIP)
    tail = unpacker.flush()
    if tail:
        yield tail


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an uncompressed stream, by their ``Content-Length``."""
    held, need = bytearray(), None
    for chunk in chunks:
        held += chunk
        at = 0
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                size = re.search(rb"\r\nContent-Length: *(\d+)", held[at:end], re.IGNORECASE)
                if size is None:
                    raise ValueError("record without Content-Length")
                need = end + 4 + int(size[1]) + 4 - at
            if len(held) - at < need:
                break
            yield bytes(held[at:at + need])
            at, need = at + need, None
        del held[:at]
    if held.strip(b"\r\n"):
        raise ValueError("the archive ends inside a record")


def normalise(files: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite each file with a member per record; returns the index (also written beside each file)."""
    ship_package(files.sparkSession)
    parallel = files.sparkSession.sparkContext.defaultParallelism
    spread = files.repartition(max(1, min(files.count(), 4 * parallel)))

    def run(batches):
        store, root = _store(folder)
        name, number = _task_name(), 0
        for batch in batches:
            for whole in batch.column(0).to_pylist():
                entries, offset = [], 0
                file = f"members-{name}-{number}.warc.gz"
                number += 1
                with store.open_input_stream(f"{root}/{whole}", compression=None) as source, \
                        store.open_output_stream(f"{root}/{file}", compression=None) as out:
                    for record in split_records(_inflated(source)):
                        packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        member = packer.compress(record) + packer.flush()
                        out.write(member)
                        headers, _ = parse_record(record[:record.index(b"\r\n\r\n") + 4])
                        entries.append((file, offset, len(member), headers["WARC-Record-ID"], headers["WARC-Type"]))
                        offset += len(member)
                with store.open_output_stream(f"{root}/{file}.idx", compression=None) as sidecar:
                    for _, at, length, record_id, kind in entries:
                        line = {"offset": at, "length": length, "record_id": record_id, "record_type": kind}
                        sidecar.write(json.dumps(line).encode() + b"\n")
                columns = list(zip(*entries)) or [[]] * 5
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                                 ["file", "offset", "length", "record_id", "record_type"])

    return spread.mapInArrow(run, INDEX).checkpoint()


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Records by their index rows: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload).

    The payload of a response is hashed and measured again; a difference to the
    record's own header is an error.
    """
    ship_package(index.sparkSession)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # index rows are small but stand for whole records: tasks by bytes to read, not by bytes of index
    total = index.agg(F.sum("length")).first()[0] or 0
    n_tasks = max(1, -(-total // SEGMENT))
    spread = index.repartition(n_tasks, "file", F.floor(F.col("offset") / SEGMENT)).sortWithinPartitions("file", "offset")

    def run(batches):
        import hashlib

        store, root = _store(folder)
        opened, name = None, None
        for batch in in_slices(batches):
            rows, payloads = [], []
            for entry in batch.to_pylist():
                if entry["file"] != name:
                    if opened is not None:
                        opened.close()
                    name, opened = entry["file"], store.open_input_file(f"{root}/{entry['file']}")
                opened.seek(entry["offset"])
                headers, payload = parse_record(zlib.decompress(opened.read(entry["length"]), GZIP))
                digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                if headers["WARC-Type"] == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if (found, len(payload)) != (digest, size):
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its header")
                rows.append((_page_id(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"],
                             _page_id(headers.get("WARC-Refers-To"))))
                payloads.append(payload)
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            if with_payload:
                arrays, names = [*arrays, pa.array(payloads, pa.binary())], [*names, "payload"]
            yield pa.RecordBatch.from_arrays(arrays, names)
        if opened is not None:
            opened.close()

    return spread.mapInArrow(run, schema + (", payload binary" if with_payload else ""))


def archive_and_read(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                     html_col: str = "html") -> DataFrame:
    """Write, normalise and read back all pages."""
    files = write_monolithic(assign_records(pages, id_col, url_col, html_col), folder)
    return read_records(normalise(files, folder), folder)
