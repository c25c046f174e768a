"""WARC archives with a Zstandard dictionary.

An archive file holds one dictionary, built from its own records, in a leading
skippable frame; every record is one frame compressed with that dictionary, so
a reader needs nothing but the file and can start at any record.

Files go to a folder that all executors share; a query's own are deleted when
its session ends, so archives that are to last are written to a folder of the
caller's with ``write_warc``.  A task writes under a name of its own and only the
names that its committed output row lists are ever read, so a task that is lost
and run again leaves a file that nothing refers to.  On a file system that Python
cannot open, archives are kept whole in a table that Spark writes.

Payloads stay where they are read: digests that repeat are found by digests and
ids alone, and sent to the pages.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrove.llm._common import give_back, materialize, scratch_path, shuffle_partitions, table
from vectrove.llm._exchange import split_join

# Fixed values of the formats: the skippable frame that holds a dictionary, a
# Zstandard frame, and a trained dictionary.
SKIPPABLE_MAGIC, FRAME_MAGIC, DICTIONARY_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437

#: Payloads shorter than this are never revisits.
MIN_REVISIT_BYTES = 100
#: Bounds of an archive file (bytes of records before compression) and of its dictionary and the records it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 24 << 20, 64 << 10, 4 << 20
LEVEL = 6
#: Digests that repeat, up to which their table (about 100 bytes a row) is broadcast; beyond it only the most frequent ones are.
BROADCAST_DIGESTS = 1 << 18
#: Tasks that read archives, at most, for each of the session's shuffle partitions.
TASKS_A_PARTITION = 16

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def filesystem(path: str):
    """(file system, path) for a URI or a plain path, on the driver or an executor."""
    from pyarrow import fs

    for scheme in ("s3a://", "s3n://"):  # names that Hadoop gives to what others call s3
        path = "s3://" + path.removeprefix(scheme) if path.startswith(scheme) else path
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def opens(folder: str) -> bool:
    """Whether Python can write to ``folder``; Spark's own file systems may be more."""
    from pyarrow import lib

    try:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
    except (lib.ArrowException, OSError):
        return False
    return True


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record. A revisit has the HTTP head alone; digest and length always describe the full payload.

    The record's id is its own, as pages may repeat; the page's id has a field of
    its own.  A revisit names the page it repeats, and by its digest the payload.
    """
    block = _HTTP + (payload if record_type == "response" else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"X-Page-ID: {name(page_id)}", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.partition(": ")[::2] for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda s: int(s[len("<urn:page:") : -1]) if len(s) > len("<urn:page:>") else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {"page_id": number(fields["X-Page-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_digest": digest, "payload_bytes": int(fields["X-Payload-Length"]), "refers_to": number(fields["X-Refers-To-Page"]) if "X-Refers-To-Page" in fields else None, "payload": payload if fields["WARC-Type"] == "response" else None}


def build_dictionary(records: list[bytes]) -> bytes:
    """Trained on the archive's first records up to a bound; plain content where
    there are too few to train on (a raw dictionary is valid in the format)."""
    import zstandard

    samples, size = [], 0
    for r in records:
        samples.append(r[: 32 << 10])
        size += len(samples[-1])
        if size >= SAMPLE_BYTES:
            break
    if len(samples) >= 16 and size >= 16 << 10:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 8), samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # the samples have too little in common
            pass
    return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1"


def _dictionary(raw: bytes):
    import zstandard

    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == struct.pack("<I", DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(raw, dict_type=kind)


def write_archive(out, records: list[bytes]) -> None:
    import zstandard

    raw = build_dictionary(records)
    inner = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
    out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(inner)) + inner)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw), write_content_size=True)
    for r in records:
        out.write(compressor.compress(r))


def read_archive(data: bytes):
    """Raw records of an archive, one frame after another."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame")
    inner = data[8 : 8 + size]
    raw = zstandard.ZstdDecompressor().decompress(inner) if inner[:4] == struct.pack("<I", FRAME_MAGIC) else inner
    decompressor, at = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)), 8 + size
    view = memoryview(data)
    while at < len(data):
        frame = decompressor.decompressobj()
        parts = [frame.decompress(view[at : at + (1 << 16)])]
        end = at + (1 << 16)
        while not frame.eof:
            if end >= len(data):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(view[end : end + (1 << 20)]))
            end += 1 << 20
        at = min(end, len(data)) - len(frame.unused_data)
        yield b"".join(parts)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to per row.

    Of equal payloads of ``min_bytes`` or more, the row with the smallest id is
    the response and the others revisit it.  Rows that repeat that smallest id
    with the same payload are responses too.  A null payload is an empty one; a
    row without id can only be a revisit of one with, or a response.  Payloads are
    whole, whatever their length; repeated rows come back each; other columns are
    not read; an empty table gives no rows.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text(html_col).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    large = F.length("payload") >= min_bytes
    # Of the groups, only those of two or more rows matter for the join; partial sums keep a hot payload from one task.
    firsts = rows.where(large).groupBy(F.col("payload_digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts, "warc-repeated")
    n, total = firsts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # A digest of a short payload is never among them.
    if n <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(firsts), F.col("payload_digest") == F.col("d"), "left")
    else:
        joined = split_join(rows, firsts, [("payload_digest", "d")], "n", total, "left")
    revisit = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives under ``folder`` and return the table of those that count:
    path, n_records, n_bytes, and content where Python cannot open the folder.  A
    task holds one archive's records at a time."""
    as_files = opens(folder)

    def run(batches):
        if as_files:
            fs, base = filesystem(folder)
            fs.create_dir(base, recursive=True)
        records, size = [], 0

        def close():
            name = f"{uuid.uuid4().hex}.warc.zst"
            out = io.BytesIO()
            write_archive(out, records)
            if as_files:
                with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                    f.write(out.getvalue())
            made = {"path": [f"{folder}/{name}"], "n_records": [len(records)], "n_bytes": [out.tell()]}
            return pa.RecordBatch.from_arrays([*map(pa.array, made.values()), pa.array([None if as_files else out.getvalue()], pa.binary())], names=[*made, "content"])

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(6))):
                page_id, url, payload, digest, kind, first = (x.as_py() for x in row)
                records.append(record_bytes(page_id, url, payload, digest, kind, first))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield close()
                    records, size = [], 0
        if records:
            yield close()

    return materialize(planned.mapInArrow(give_back(run), "path string, n_records long, n_bytes long, content binary"), "warc-manifest")


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_warc(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that ``manifest`` lists, an archive to a task
    at a time; payloads are checked against their digests."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                if data is None:
                    fs, name = filesystem(path)
                    with fs.open_input_stream(name, compression=None) as f:
                        data = f.read()
                rows, size = [], 0
                for raw in read_archive(data):
                    row = parse_record(raw)
                    size += row["payload_bytes"] if payloads else 256
                    rows.append(row if payloads else row | {"payload": None})
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    # A number of its own, as the few bytes of a manifest would otherwise be merged into one task.
    tasks = max(1, min(manifest.count(), TASKS_A_PARTITION * shuffle_partitions(manifest.sparkSession)))
    spread = manifest.select("path", "content").repartition(tasks, "path")
    return spread.mapInArrow(give_back(run), "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to archives in the shared folder, read them back and
    return page_id, payload_bytes, payload_digest, record_type, refers_to."""
    manifest = write_warc(plan_records(table(spark, sf_dir, "pages")), scratch_path(spark, "warc"))
    return read_warc(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, MIN(page_id) AS first_id, COUNT(*) AS n FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, payload_bytes, p.payload_digest,
       CASE WHEN n > 1 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
