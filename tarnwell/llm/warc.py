"""WARC archives with a Zstandard dictionary.

Each archive is a .warc.zst file: a leading skippable frame with the dictionary, then a
Zstandard frame for each record. The dictionary is made from the archive's own records (a
bounded sample of them: the first 8192 bytes of dict_samples records spread over the
archive, dict_bytes result; records are compressed whole). Of records with equal
payloads of min_revisit bytes or more, the one with the largest id is stored as response;
the others are revisit records that refer to it.

Archives are rows (name, records, data) of a written table, since executors share no
folder but the work tables; `export` writes them as files. A task closes an archive
when it holds archive_bytes, so no archive grows with the input.

Null payloads count as empty. Rows whose id is null never win over others; if all ids of
equal payloads are null, all are responses. Rows that repeat the winner's id and payload
are responses as well. Null URLs leave the target out. Long payloads are kept whole;
other columns are passed by.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import Workspace, arrow

#: Repeated payloads up to which they are broadcast (some 100 bytes each); beyond, payloads are shuffled by digest.
BROADCAST_ROWS = 100_000
#: Fixed value: the magic number of the skippable frame that holds a dictionary.
DICT_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = pa.schema([("name", pa.string()), ("records", pa.int64()), ("data", pa.binary())])
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name_of(page_id, digest)}>", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{name_of(refers_to, digest)}>", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def name_of(page_id: int | None, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}/{digest}").urn


def pack(records: list[bytes], level: int, dict_bytes: int, dict_samples: int) -> bytes:
    """The bytes of an archive."""
    step = max(1, len(records) // dict_samples)
    samples = [r[:8192] for r in records[::step]][:dict_samples]
    try:
        trained = zstandard.train_dictionary(dict_bytes, samples, k=200, d=8)
    except zstandard.ZstdError:  # too few records to train on: their text itself is the dictionary
        trained = zstandard.ZstdCompressionDict(b"".join(samples)[:dict_bytes] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content = trained.as_bytes()
    trained.precompute_compress(level=level)
    compress = zstandard.ZstdCompressor(dict_data=trained, write_content_size=True).compress
    return b"".join([struct.pack("<II", DICT_MAGIC, len(content)), content, *map(compress, records)])


def unpack(data: bytes, chunk: int = 1 << 15) -> Iterator[bytes]:
    """The records of an archive, in order."""
    view, at, dictionary = memoryview(data), 0, None
    magic, size = struct.unpack_from("<II", data, 0)
    if magic == DICT_MAGIC:
        content = bytes(view[8 : 8 + size])
        if content[:4] == zstandard.FRAME_HEADER:  # dictionaries may themselves be compressed
            content = zstandard.ZstdDecompressor().decompress(content)
        kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == struct.pack("<I", 0xEC30A437) else zstandard.DICT_TYPE_RAWCONTENT
        dictionary, at = zstandard.ZstdCompressionDict(content, dict_type=kind), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        frame, out = reader.decompressobj(), []
        while not frame.eof and at < len(data):
            out.append(frame.decompress(view[at : at + chunk]))
            at += min(chunk, len(data) - at)
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields, payload length and payload (empty for a revisit) of a record; checks lengths and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if not first.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    if fields["WARC-Type"] == "response" and (len(payload) != length or "sha1:" + hashlib.sha1(payload).hexdigest() != fields["WARC-Payload-Digest"]):
        raise ValueError("payload and digest differ")
    return fields, length, payload


def plan(pages: DataFrame, min_revisit: int) -> DataFrame:
    """page_id, url, payload, digest and refers_to of each row. The largest id of each payload is found by partial maxima."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= min_revisit
    winners = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1 AND winner IS NOT NULL").drop("n")
    # written first: a join of two exchanges can split a frequent payload, and the number tells whether it is needed
    winners = Workspace(pages.sparkSession).table(winners, "winners")
    out = rows.join(F.broadcast(winners) if winners.count() <= BROADCAST_ROWS else winners, "digest", "left")
    refers = F.when(F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    return out.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, min_revisit: int = 1000, archive_bytes: int = 16 << 20, level: int = 3, dict_bytes: int = 1 << 15, dict_samples: int = 256, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives as rows (name, records, data), in a written table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            data = pack(held, level, dict_bytes, dict_samples)
            return arrow({"name": [f"{hashlib.sha1(data).hexdigest()}.warc.zst"], "records": [len(held)], "data": [data]}, ARCHIVES)

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*batch.columns):
                held.append(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    archives = plan(pages, min_revisit).mapInArrow(work, "name string, records long, data binary")
    return Workspace(pages.sparkSession).table(archives, "warc")


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of each record."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for raw in unpack(data.as_py()):
                    fields, length, _ = parse(raw)
                    number = lambda k, f=fields: int(f[k]) if k in f else None
                    rows.append((number("X-Page-Id"), length, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], number("X-Refers-To-Page"), fields.get("WARC-Target-URI")))
                if rows:
                    yield arrow(dict(zip(READ.names, zip(*rows))), READ)

    return archives.select("data").mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def export(archives: DataFrame, folder: str) -> list[str]:
    """Writes each archive as a file into a folder of any file system that Spark reaches; the driver holds one archive at a time."""
    context, names = archives.sparkSession.sparkContext, []
    for row in archives.toLocalIterator():
        path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{row['name']}")
        file = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
        try:
            file.write(bytearray(row["data"]))
        finally:
            file.close()
        names.append(row["name"])
    return names
