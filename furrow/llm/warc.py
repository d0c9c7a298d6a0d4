"""WARC archives, index first (operator 8).

``write_archives`` writes gzip-per-record WARC files and an index table with
file, offset, length, URL and digest per record.  Of equal payloads of at least
``MIN_REVISIT`` bytes the record of the largest page_id is a response, the
others are revisits that refer to it; shorter payloads are always responses.
``read_records`` takes index rows, sorts them by file and offset, and reads
neighbouring records with one coalesced byte range.

Scale.  Winners are found by an aggregate over (digest, length), kept only for
groups of two or more, and joined back; AQE splits a hot digest.  Each task
writes one file; a retried task writes under a new name and only files in the
committed index count.  Reading deals out pieces of ``RANGE_BYTES`` of a file
to as many tasks as the records' bytes ask for (``TASK_BYTES``; every core while
there are pieces), and one range holds ``READ_BYTES`` at most (or one record).

Defined cases: null html is an empty payload; a null url writes no target URI;
control characters and spaces in a url are percent-encoded in the header (the
index keeps the url itself); rows that share the largest page_id of their group
are all responses; a null page_id loses against any other; an empty table gives
an empty index; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import plain, staged, sub_batches, text_bytes
from furrow.session import scratch_path

MIN_REVISIT = 1000
RANGE_BYTES = 16 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
TASK_BYTES = 64 << 20

_INDEX = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long, length long"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(page_id, url, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    """One WARC record; a revisit carries the HTTP header without the payload."""
    kind = "response" if refers_to is None else "revisit"
    block = _HTTP + (payload if refers_to is None else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", size),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(("WARC-Target-URI", safe))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _PROFILE)]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        name, out, at = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for whole in batches:
                for b in sub_batches(whole, "payload"):
                    if out is None:
                        fs, path = pafs.FileSystem.from_uri(folder)
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    cols = [b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to")]
                    offsets, lengths = [], []
                    for row in zip(*cols):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(_record(*row, date)) + z.flush()
                        out.write(member)
                        offsets.append(at)
                        lengths.append(len(member))
                        at += len(member)
                    kind = ["response" if r is None else "revisit" for r in cols[5]]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("page_id"), b.column("url"), b.column("payload_bytes"), b.column("payload_digest"), pa.array(kind), b.column("refers_to"),
                         pa.array([f"{folder}/{name}"] * b.num_rows), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                        names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "offset", "length"])
        finally:
            if out is not None:
                out.close()
    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` as WARC files below ``folder`` (a fresh one in the shared
    checkpoint folder if None); returns the index table, read back from there."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    src = pages.select(plain(id_col)[0].cast("long").alias("page_id"), plain(url_col)[0].cast("string").alias("url"), text_bytes(f"`{html_col}`").alias("payload"))
    src = src.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    winners = staged(src.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest", "payload_bytes")
                     .agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-winners")
    rows = src.join(winners, ["payload_digest", "payload_bytes"], "left")
    refers = F.when(F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    rows.select("page_id", "url", "payload", "payload_digest", "payload_bytes", refers.alias("refers_to")) \
        .mapInArrow(_write(f"{folder}/archives", date), _INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _parse(member: bytes) -> tuple[dict[str, str], bytes]:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:20]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def _page(ref: str | None) -> int | None:
    return int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", ref or "")) else None


def _read(with_payload: bool):
    def flush(f, group: list[tuple[int, int]]) -> list[tuple]:
        """One byte range for neighbouring records."""
        base = group[0][0]
        f.seek(base)
        data = f.read(group[-1][0] + group[-1][1] - base)
        out = []
        for at, n in group:
            head, payload = _parse(data[at - base:at - base + n])
            digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
            size = int(head["WARC-Payload-Length"])
            if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"damaged record at {at}")
            out.append((_page(head["WARC-Record-ID"]), size, digest, kind, _page(head.get("WARC-Refers-To")), payload if kind == "response" else None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        keep = 6 if with_payload else 5

        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows))[:keep], types)], names=names[:keep])

        f, path, group = None, None, []
        for b in batches:
            for p, at, n in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length"))):
                far = group and (p != path or at - sum(group[-1]) > GAP_BYTES or at + n - group[0][0] > READ_BYTES)
                if far:
                    yield emit(flush(f, group))
                    group = []
                if p != path:
                    fs, local = pafs.FileSystem.from_uri(p)
                    f, path = fs.open_input_file(local), p
                if not group or group[-1] != (at, n):
                    group.append((at, n))
        if group:
            yield emit(flush(f, group))
    return run


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` rows point at, read from the archives; a
    record named twice is read once.  Columns: page_id, payload_bytes,
    payload_digest, record_type, refers_to and, if asked for, the payload
    (null for a revisit).  The tasks follow the bytes of the records, not those
    of the index rows."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    piece = F.floor(F.col("offset") / RANGE_BYTES)
    rows = index.select("path", "offset", "length").withColumn("piece", piece)
    size = rows.groupBy("path", "piece").agg(F.sum("length").alias("b")).agg(F.count(F.lit(1)).alias("pieces"), F.sum("b").alias("b")).first()
    n = max(1, math.ceil((size["b"] or 0) / TASK_BYTES), min(size["pieces"], index.sparkSession.sparkContext.defaultParallelism))
    return rows.repartition(n, "path", "piece") \
        .sortWithinPartitions("path", "offset").select("path", "offset", "length").mapInArrow(_read(with_payload), schema)
