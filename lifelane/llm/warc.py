"""WARC archives in Zstandard form: a dictionary in the leading skippable frame, then one frame for each record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (headers of the response only) if refers_to is given."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    heads = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:x-page:{page_id}>", "WARC-Date": DATE}
    if url:
        heads["WARC-Target-URI"] = re.sub(r"[\r\n]+", " ", url)
    heads["WARC-Payload-Digest"] = f"sha1:{sha1_base32(payload)}"
    heads["WARC-Block-Digest"] = f"sha1:{sha1_base32(block)}"
    if refers_to is not None:
        heads |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:x-page:{refers_to}>"}
    heads |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads.items()).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive: reads the dictionary, then decodes one frame after the other."""
    at, dictionary = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_MAGIC:
        (size,) = struct.unpack_from("<I", content, 4)
        raw = content[8 : 8 + size]
        if len(raw) != size:
            raise ValueError("the dictionary frame is cut off")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(content)
    while at < len(content):
        (magic,) = struct.unpack_from("<I", content, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # other skippable frames
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        one, parts = reader.decompressobj(), []
        while not one.eof:
            if at >= len(content):
                raise ValueError("a record's frame is cut off")
            fed = view[at : at + 16384]
            parts.append(one.decompress(fed))
            at += len(fed)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises if a header, a length or the block's digest is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    heads = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    if missing := [h for h in MANDATORY if h not in heads]:
        raise ValueError(f"a record has no {', '.join(missing)}")
    size = int(heads["Content-Length"])
    block = rest[:size]
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{heads['WARC-Record-ID']}: Content-Length {size} doesn't fit a frame that holds {len(rest) - 4}")
    if "WARC-Block-Digest" in heads and heads["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"{heads['WARC-Record-ID']}: the block has another digest")
    return heads, block


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _digested(pages: DataFrame) -> DataFrame:
    """page_id, url, html and digest, the payload's SHA-1."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"))


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to of the payloads, of least_bytes or more, that a page with a smaller id has too.

    Rows are known by page and digest, so of rows that share an id only those with the repeated payload are revisits.
    Payloads of over a thousandth of all rows, a thousand at most, are joined by broadcast, the others by a shuffle.
    """
    whole = _digested(pages)
    narrow = whole.where(F.col("page_id").isNotNull() & (F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes)).select("page_id", "digest")
    narrow = stored(narrow.distinct(), "digests")
    first = stored(narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "first")
    hot = F.broadcast(first.where(F.col("n") > max(1000, narrow.count() // 1000)).select("digest", F.col("refers_to").alias("hot")))
    marked = narrow.join(hot, "digest", "left")
    found = marked.where("hot IS NOT NULL").select("page_id", "digest", F.col("hot").alias("refers_to"))
    rest = marked.where("hot IS NULL").select("page_id", "digest").join(first.select("digest", "refers_to"), "digest").select("page_id", "digest", "refers_to")
    return found.unionByName(rest).where("page_id <> refers_to")


def train_dictionary(pages: DataFrame, *, pages_read: int = 200, sample_chars: int = 8192, size: int = 16384) -> bytes:
    """A dictionary from the first sample_chars characters of the pages_read pages with the lowest hashes; b"" if these are too few.

    A threshold of the hash, set by the number of pages, leaves about four times pages_read pages before any are ranked,
    so what tasks send to the driver doesn't grow with the table.
    """
    some = pages.where("html <> ''")
    share = min(1.0, 4 * pages_read / max(1, some.count()))
    x = F.xxhash64("page_id", "html")
    some = some.where(F.pmod(x, F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = some.select(F.substring("html", 1, sample_chars).alias("h"), x.alias("x")).orderBy("x", "h").limit(pages_read).collect()
    texts = [r.h.encode("utf-8", "replace") for r in sample]
    parts = [t[i : i + 1024] for t in texts for i in range(0, len(t), 1024)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, *, least_bytes: int = 0, archive_bytes: int = 8_000_000, level: int = 3) -> DataFrame:
    """archive (a name) and content (the bytes of a .warc.zst file): one record for each row of pages.

    Null html is an empty payload, a null url is left out. A row without page_id is a response always, and so are all
    rows of one page_id with one payload if no smaller id has it. Extra columns are ignored.
    """
    dictionary = train_dictionary(pages)
    rows = _digested(pages).join(revisits(pages, least_bytes), ["page_id", "digest"], "left").drop("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = b""
        trained = None
        if dictionary:
            lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
            trained = zstandard.ZstdCompressionDict(dictionary)
        writer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
        parts, size = [lead], 0

        def archive():
            content = b"".join(parts)
            return pa.RecordBatch.from_pydict({"archive": [f"{hashlib.sha256(content).hexdigest()[:32]}.warc.zst"], "content": pa.array([content], pa.binary())})

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                parts.append(writer.compress(record(page, url, (html or "").encode("utf-8", "replace"), refers)))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield archive()
                    parts, size = [lead], 0
        if size:
            yield archive()

    return rows.mapInArrow(run, "archive string, content binary")


def save(archives: DataFrame, folder: str) -> DataFrame:
    """Writes the archives as files to a folder that all executors reach (any URI that pyarrow opens); their names and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        to, path = fs.FileSystem.from_uri(folder)
        to.create_dir(path)
        for batch in batches:
            names, contents = (batch.column(c).to_pylist() for c in ("archive", "content"))
            for name, content in zip(names, contents, strict=True):
                # The frames are compressed already; a rerun writes the same file again.
                with to.open_output_stream(f"{path}/{name}", compression=None) as f:
                    f.write(content)
            yield pa.RecordBatch.from_pydict({"archive": names, "bytes": pa.array(map(len, contents), pa.int64())})

    return archives.mapInArrow(run, "archive string, bytes long")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_archives(archives: DataFrame, *, payloads: bool = False) -> DataFrame:
    """One row for each record of archives (a column content, as the binaryFile source gives): READ, and payload if asked.

    Headers, lengths and digests are validated; a broken record raises. A revisit's payload is null, its size and
    digest are those of the full payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for data in frames(content.as_py() or b""):
                    heads, block = parse(data)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = heads["WARC-Type"], heads.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    found = re.search(rb"(?im)^content-length: *(\d+)", http)
                    size = int(found[1]) if found else len(payload)
                    if kind == "revisit":
                        if payload or "WARC-Refers-To" not in heads:
                            raise ValueError(f"{heads['WARC-Record-ID']}: a revisit has a payload or refers to nothing")
                        payload = None
                    elif size != len(payload) or digest != sha1_base32(payload):
                        raise ValueError(f"{heads['WARC-Record-ID']}: the payload has another length or digest")
                    rows.append((page_of(heads["WARC-Record-ID"]), size, digest, kind, page_of(heads.get("WARC-Refers-To")), heads.get("WARC-Target-URI"), payload))
                    if len(rows) == 500:
                        yield _batch(rows, payloads)
                        rows = []
                if rows:
                    yield _batch(rows, payloads)

    return archives.select("content").mapInArrow(run, READ + ", payload binary" * payloads)


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [*(f.split()[0] for f in READ.split(", ")), "payload"]
    n = 7 if payloads else 6
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(n)], names=names[:n])


def op8_warc_zstd(spark, sf_dir: str) -> DataFrame:
    """Archives are written to a table in the shared folder and read back from there.

    One row per row of pages: null html counts as empty, repeated rows and ids are archived each, extra columns are ignored.
    """
    from .common import table

    return read_archives(stored(write_archives(table(spark, sf_dir, "pages")), "archives")).drop("url")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex FROM p),
d AS (SELECT page_id, n, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4),
        lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * g + 1, 5))::BIGINT >> (15 - 5 * k)) & 31)::INT + 1, 1)), '')), '') AS digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
