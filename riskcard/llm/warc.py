"""WARC archives, Zstandard-compressed record by record with an embedded dictionary.

An archive file is a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built
from the archive's own records, then one frame per WARC record, so that any record can be read
by itself once the dictionary is known.  Payloads that occur more than once are stored once: of
records with equal payloads (SHA-1 and length) that with the smallest page_id is a ``response``,
the others are ``revisit`` records that refer to it.

Tasks fill archives of about ARCHIVE_BYTES of records and write them straight to the shared
folder through ``pyarrow.fs``.  File names carry the task attempt, and only files of attempts that
succeeded enter the manifest, a written table, so lost executors leave no doubtful archive.
Archives are read back from the manifest, as streams.

The dictionary is trained on records spread evenly over the archive, SAMPLE_TIMES times its size
in all; this bounds training and has no effect on what is stored.  Where these are fewer than
MIN_SAMPLE (few, long records), it is trained on pieces of all the records, as many bytes.  Archives
of less than 20 KiB and those with too little variety to train on have no dictionary frame.

Defined cases: null html is an empty payload; a null or empty url gets ``urn:page:<id>``; control
characters in a url are percent-encoded; rows that repeat the page_id and payload of a response are
responses too; rows without page_id come last; payloads below ``min_bytes`` are always responses; an
empty table gives no archives and no rows; only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskcard.llm.common import ready, written
from riskcard.session import scratch_path

# fixed values of the formats
SKIPPABLE = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MOST_TASKS = 100_000     # of reading archives
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_TIMES = 50
MIN_SAMPLE = 8              # records to train on
PIECE = 2 << 10             # bytes of a record to train on where records are fewer
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record.  ``refers_to``: the response's page_id for a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + (b"\r\n" if refers_to is not None else b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    uri = "".join(c if c > " " and c != "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in url or "")
    head = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", DATE), ("WARC-Target-URI", uri or f"urn:page:{page_id}"),
            ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
            ("X-Payload-Length", len(payload))]
    if page_id is not None:
        head.append(("X-Page-ID", page_id))
    if refers_to is not None:
        head += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE),
                 ("X-Refers-To-Page", refers_to)]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]):
    """A Zstandard dictionary from records spread evenly over the archive, or None."""
    import zstandard
    total = sum(map(len, records))
    size = min(DICTIONARY_BYTES, total // 20)
    step = max(1, -(-total // (SAMPLE_TIMES * max(size, 1))))
    if size < 1024:
        return None
    sample = records[::step]
    if len(sample) < MIN_SAMPLE:
        places = [(r, at) for r in records for at in range(0, len(r), PIECE)]
        sample = [r[at: at + PIECE] for r, at in places[::step]]
    try:
        return zstandard.train_dictionary(size, sample, k=256, d=8, f=20, accel=5, level=LEVEL)
    except zstandard.ZstdError:       # too little variety to train on
        return None


def archive(records: list[bytes]) -> bytes:
    import zstandard
    d = dictionary(records)
    out = [struct.pack("<II", SKIPPABLE, len(d.as_bytes())) + d.as_bytes()] if d else []
    press = zstandard.ZstdCompressor(level=LEVEL, **({"dict_data": d} if d else {}))
    out += [press.compress(r) for r in records]
    return b"".join(out)


def records_of(f):
    """(headers, block) of every record of an archive opened for reading."""
    import zstandard
    magic = f.read(8)
    if len(magic) < 8:
        return
    if struct.unpack("<I", magic[:4])[0] == SKIPPABLE:
        d = zstandard.ZstdCompressionDict(f.read(struct.unpack("<I", magic[4:])[0]))
        reader = zstandard.ZstdDecompressor(dict_data=d)
    else:
        f.seek(0)
        reader = zstandard.ZstdDecompressor()
    lines = io.BufferedReader(reader.stream_reader(f, read_across_frames=True), 1 << 20)
    while lines.readline():
        head = {}
        while (line := lines.readline().strip()):
            k, _, v = line.decode().partition(": ")
            head[k] = v
        block = lines.read(int(head["Content-Length"]))
        lines.read(4)
        yield head, block


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, html, refers_to): the response's page_id where the page is a revisit."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"),
                        F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("size"))
    first = (rows.where(F.col("size") >= min_bytes).groupBy("digest", "size")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
             .drop("n"))
    # written: a table of its own, so that a payload shared by many pages can be split in the join
    out = rows.join(written(first, "warc-first"), ["digest", "size"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return out.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per page into archives under ``folder`` (a URI or path that driver and
    executors share).  Returns the manifest: archive, records, bytes."""
    ready(pages.sparkSession)

    def run(batches):
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, no = TaskContext.get(), 0
        held, size, manifest = [], 0, []

        def flush():
            nonlocal held, size, no
            name = f"{root}/pages-{task.partitionId():06d}-{task.taskAttemptId()}-{no:04d}.warc.zst"
            data = archive(held)
            with store.open_output_stream(name, compression=None) as f:
                f.write(data)
            manifest.append((f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{no:04d}.warc.zst",
                             len(held), len(data)))
            held, size, no = [], 0, no + 1

        for b in batches:
            for page_id, url, html, refers in zip(*(b.column(i).to_pylist() for i in range(4))):
                r = record(page_id, url, html.encode(), refers)
                held.append(r)
                size += len(r)
                if size >= archive_bytes:
                    flush()
        if held:
            flush()
        cols = list(zip(*manifest)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
                                          pa.array(cols[2], pa.int64())], ["archive", "records", "bytes"])

    rows = with_revisits(pages, min_bytes)
    return written(rows.mapInArrow(run, "archive string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the manifest's archives; responses' bytes and digests are taken from
    the payloads read, revisits' from their headers."""

    def run(batches):
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for head, block in records_of(io.BytesIO(f.read())):
                        own, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page")
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        revisit = head["WARC-Type"] == "revisit"
                        rows.append((int(own) if own else None,
                                     int(head["X-Payload-Length"]) if revisit else len(payload),
                                     head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit
                                     else base32_sha1(payload), head["WARC-Type"], int(refers) if refers else None,
                                     head["WARC-Target-URI"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    # a numbered repartition is not coalesced: about one archive a task
    tasks = max(1, min(manifest.count(), MOST_TASKS))
    return manifest.select("archive").repartition(tasks).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
             "target_uri string")


def archive_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
