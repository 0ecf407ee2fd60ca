"""Zstandard WARC archives: one frame per record, dictionary in the leading skippable frame.

Layout of an archive: a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself compressed, then one Zstandard frame per WARC record.  Every
task trains the dictionary of its own archive on the first records it writes
(at most ``DICT_SAMPLE_BYTES``) and the archive is written by Spark's own
writer, through its commit protocol: the rows are frames and the "line
separator" is an empty skippable frame, which every Zstandard reader skips.

The reader works on any archives of this layout (dictionary frame optional,
dictionary compressed or plain): workers open an archive as a stream, walk its
frames, hold and decode one frame at a time and validate version line, mandatory fields, Content-Length, the
record's end and the digests.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefuse.llm.common import as_bytes
from tracefuse.session import cut_lineage, ensure_checkpoint_dir, hadoop_path

DICT_MAGIC = 0x184D2A5D
SKIP_MAGICS = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: an empty skippable frame: magic 0x184D2A50 and length 0
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
MIN_REVISIT_BYTES = 100
DICT_BYTES = 32 << 10
DICT_SAMPLE_BYTES = 2 << 20
LEVEL = 3
WARC_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: revisit decisions are broadcast up to this many repeated payloads (about 80 bytes each)
BROADCAST_ROWS = 200_000


class WarcError(ValueError):
    """A record or an archive that breaks the format."""


# ---- writing -------------------------------------------------------------------------

def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                 revisit: bool) -> bytes:
    """One WARC/1.1 record with an HTTP block; a revisit holds the HTTP head only."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http if revisit else http + payload
    page = "" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + page)}>"),
        ("WARC-Date", WARC_DATE),
        ("WARC-Target-URI", _clean(url) if url else "urn:unknown"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", page),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE),
                   ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + str(refers_to))}>"),
                   ("X-Refers-To-Page", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    """The leading skippable frame (empty without enough samples) and its dictionary."""
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:  # too few or too small samples to train on
        return b"", None
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
    return struct.pack("<II", DICT_MAGIC, len(packed)) + packed, trained


def encode_archive(records: Iterator[bytes]) -> Iterator[bytes]:
    """Frames of one archive; only the dictionary's sample is held in memory."""
    sample, size = [], 0
    for r in records:
        sample.append(r)
        size += len(r)
        if size >= DICT_SAMPLE_BYTES:
            break
    if not sample:
        return
    lead, trained = dictionary_frame(sample)
    if lead:
        yield lead
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
    for r in itertools.chain(sample, records):
        yield packer.compress(r)


def _frames(batches):
    def records():
        for b in batches:
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in b.columns)):
                revisit = first is not None and page_id != first
                yield build_record(page_id, url, payload or b"", digest, first, revisit)

    out, size = [], 0
    for frame in encode_archive(records()):
        out.append(frame)
        size += len(frame)
        if size >= 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])


def with_first_copy(pages: DataFrame, payload: Column, digest: Column) -> DataFrame:
    """page_id, url, payload, digest, first_id: the smallest page_id of a repeated payload, else NULL.

    Repeated payloads are counted by digest, so a payload that a third of all
    rows share is pre-aggregated.  Only digests met twice are joined back:
    broadcast when few, else a shuffle join whose skew Spark splits.
    """
    keyed = pages.select("page_id", F.octet_length(payload).alias("n"), digest.alias("digest"))
    repeated = cut_lineage(keyed.filter(F.col("n") >= MIN_REVISIT_BYTES).groupBy("digest")
                           .agg(F.count("*").alias("rows"), F.min("page_id").alias("first_id"))
                           .filter((F.col("rows") > 1) & F.col("first_id").isNotNull())
                           .select("digest", "first_id"))
    bounded = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = pages.select("page_id", "url", payload.alias("payload"), digest.alias("digest"))
    return (rows.join(F.broadcast(repeated) if bounded else repeated, "digest", "left")
            .select("page_id", "url", "payload", "digest", "first_id"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes one archive per input partition under ``path``.

    NULL html is an empty payload.  A NULL page_id is never the first copy of
    others unless all are NULL, in which case every copy is a response.
    """
    payload = as_bytes("html")
    rows = with_first_copy(pages, payload, F.sha2(payload, 256))
    frames = rows.mapInArrow(_frames, "frame binary")
    # bytes pass through the text writer unchanged
    (frames.select(F.col("frame").cast("string").alias("value")).write.mode("errorifexists")
     .option("lineSep", SEPARATOR).text(path))


# ---- reading -------------------------------------------------------------------------

#: file systems that workers open themselves; archives elsewhere come through Spark's binary reader
STREAMED = ("file", "hdfs", "s3", "gs")


def open_stream(path: str):
    """A byte stream of the file at ``path`` (as Spark names it), read in pieces and never decompressed by name."""
    if path.startswith("file:") or ":/" not in path:
        fs, at = pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        scheme, _, rest = path.partition("://")
        host, _, name = rest.partition("/")
        fs, root = pafs.FileSystem.from_uri(f"{scheme}://{host}/")
        at = f"{root.rstrip('/')}/{name}"
    return fs.open_input_stream(at, compression=None, buffer_size=1 << 20)


def _exactly(data, n: int, what: str = "frame") -> bytes:
    """The next ``n`` bytes of a stream."""
    parts, left = [], n
    while left:
        piece = data.read(min(left, 1 << 24))
        if not piece:
            raise WarcError(f"truncated {what}")
        parts.append(piece)
        left -= len(piece)
    return parts[0] if len(parts) == 1 else b"".join(parts)


def split_frames(source) -> Iterator[tuple[str, bytes]]:
    """('dict', bytes) at most once and first, then ('frame', bytes) per Zstandard frame.

    ``source`` is a stream or a bytes-like object; one frame is held at a time.
    """
    data = source if hasattr(source, "read") else io.BytesIO(source)
    first = True
    while lead := data.read(1):
        lead += _exactly(data, 3)
        magic = int.from_bytes(lead, "little")
        if magic in SKIP_MAGICS:
            left = int.from_bytes(_exactly(data, 4, "skippable frame"), "little")
            if magic == DICT_MAGIC:
                if not first:
                    raise WarcError("a dictionary frame must lead the archive")
                yield "dict", _exactly(data, left, "skippable frame")
            else:
                while left:
                    left -= len(_exactly(data, min(left, 1 << 20), "skippable frame"))
        elif lead == FRAME_MAGIC:
            yield "frame", _whole_frame(data)
        else:
            raise WarcError(f"no frame where {lead!r} stands")
        first = False


def _whole_frame(data) -> bytes:
    """The Zstandard frame whose magic number was just read, found by its block headers."""
    parts = [FRAME_MAGIC, _exactly(data, 1)]
    flag = parts[1][0]
    single, checksum = flag >> 5 & 1, flag >> 2 & 1
    fields = (0 if single else 1) + (0, 1, 2, 4)[flag & 3] + ((1 if single else 0), 2, 4, 8)[flag >> 6]
    parts.append(_exactly(data, fields) if fields else b"")
    last = False
    while not last:
        block = _exactly(data, 3)
        head = int.from_bytes(block, "little")
        size = 1 if head >> 1 & 3 == 1 else head >> 3
        parts += [block, _exactly(data, size) if size else b""]
        last = head & 1
    if checksum:
        parts.append(_exactly(data, 4))
    return b"".join(parts)


def load_dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    """A dictionary as stored: plain, or compressed as one frame."""
    if content[:4] == FRAME_MAGIC:
        content = zstandard.ZstdDecompressor().decompress(content, max_output_size=1 << 27)
    return zstandard.ZstdCompressionDict(content)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record; raises WarcError where it breaks the format."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not sep or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:60]!r}")
        if name in fields:
            raise WarcError(f"repeated field {name}")
        fields[name] = value.strip()
    for name in MANDATORY:
        if name not in fields:
            raise WarcError(f"field {name} is missing")
    if not re.fullmatch(r"\d+", fields["Content-Length"]):
        raise WarcError("Content-Length is not a number")
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length} does not fit a record of {len(rest)} bytes")
    block = rest[:length]
    if (d := fields.get("WARC-Block-Digest", "")).startswith("sha256:") and d[7:] != hashlib.sha256(block).hexdigest():
        raise WarcError("the block does not have its digest")
    return fields, block


def read_payload(fields: dict[str, str], block: bytes) -> tuple[bytes | None, int]:
    """Payload (None for a revisit) and full payload length of an HTTP record."""
    head, sep, body = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length: *(\d+)\r?$", head)
    if not sep or not m:
        raise WarcError("no HTTP head in the block")
    length = int(m[1])
    if fields["WARC-Type"] == "revisit":
        if body:
            raise WarcError("a revisit record holds a payload")
        return None, length
    if len(body) != length:
        raise WarcError(f"HTTP length {length} does not fit a body of {len(body)} bytes")
    digest = fields.get("WARC-Payload-Digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(body).hexdigest():
        raise WarcError("the payload does not have its digest")
    return body, length


def decode_archive(source) -> Iterator[tuple[dict[str, str], bytes | None, int]]:
    """(fields, payload, payload length) per record of one archive, a stream or a bytes-like object."""
    unpacker = zstandard.ZstdDecompressor()
    for kind, frame in split_frames(source):
        if kind == "dict":
            unpacker = zstandard.ZstdDecompressor(dict_data=load_dictionary(frame))
        else:
            fields, block = parse_record(unpacker.decompressobj().decompress(frame))
            payload, length = read_payload(fields, block)
            yield fields, payload, length


_READ = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
         "payload_digest string, payload binary")


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _decode_batches(with_payload: bool):
    names = [f.split()[0] for f in _READ.split(", ")]

    def decoded(source):
        rows, size = [], 0
        for fields, payload, length in decode_archive(source):
            rows.append((_number(fields.get("X-Page-ID")), fields.get("WARC-Target-URI"), fields["WARC-Type"],
                         _number(fields.get("X-Refers-To-Page")), length,
                         fields.get("WARC-Payload-Digest", "").removeprefix("sha256:"),
                         payload if with_payload else None))
            size += length if with_payload else 0
            if len(rows) >= 5000 or size >= 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names)

    def run(batches):
        for b in batches:
            for archive in b.column(0):
                if isinstance(value := archive.as_py(), str):
                    with open_stream(value) as source:
                        yield from decoded(source)
                else:
                    yield from decoded(value)
    return run


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives under ``path``: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest (of the full payload) and, if asked for, payload.

    Spark lists the archives (names and sizes, no content) and spreads them by
    size; a worker reads its archives as streams, one frame at a time, so their
    size is not limited.  Archives on a file system outside ``STREAMED`` come
    as rows of Spark's binary reader (below 2 GB each).  A broken record raises
    WarcError with what is wrong.
    """
    files = spark.read.format("binaryFile").load(path)
    scheme = hadoop_path(spark, path)[0].getUri().getScheme()
    return files.select("path" if scheme in STREAMED else "content").mapInArrow(_decode_batches(with_payload), _READ)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared checkpoint folder and reads them back.

    page_id, payload_bytes, payload_digest, record_type, refers_to per record.

    Edge cases: NULL html is an empty payload; payloads under 100 bytes are
    always responses; rows that repeat a page_id with an equal payload are all
    responses if it is the smallest; NULL page_ids stay NULL; a NULL url is
    written as ``urn:unknown``; an empty table writes nothing and reads back
    nothing; only page_id, url and html are read.
    """
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return (read_archives(spark, path, with_payload=False)
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
