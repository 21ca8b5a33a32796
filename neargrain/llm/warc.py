"""WARC archives whose records are compressed one by one with an embedded Zstandard dictionary."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neargrain.llm.common import pieces, shared_folder

#: Magic number of the skippable frame that holds a dictionary (fixed by the public format).
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
#: Payloads of at least so many bytes become revisits when they repeat.
LEAST_REVISIT = 100
#: Records that the dictionary is trained on, at most, and bytes of each; bytes of the dictionary.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 32_768, 65_536
#: A writer goes on to its next archive after so many bytes.
ARCHIVE_BYTES = 256 << 20
#: The date in each record; a parameter, so that reruns write equal bytes.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3

_SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string"


def _header_text(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record or, with ``refers_to``, a revisit record without the payload."""
    revisit = refers_to is not None
    digest = hashlib.sha256(payload).hexdigest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    else:
        block += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The parts of a record; raises where lengths or the digest of a payload disagree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page = lambda urn: None if urn == _urn(None) else int(urn.removeprefix("<urn:page:").removesuffix(">"))
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload and digest differ in {fields['WARC-Record-ID']}")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": None if refers is None else page(refers)}


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _kind(dictionary: bytes) -> zstandard.ZstdCompressionDict:
    full = dictionary[:4] == struct.pack("<I", 0xEC30A437)
    return zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)


def archive_head(dictionary: bytes) -> bytes:
    """The leading skippable frame with the (itself compressed) dictionary."""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def open_archive(stream) -> Iterator[bytes]:
    """Records of an archive, one after the other; memory for a record and a chunk."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start")
    decoder = zstandard.ZstdDecompressor(dict_data=_kind(zstandard.ZstdDecompressor().decompress(stream.read(size), max_output_size=1 << 27)))
    rest = b""
    while chunk := rest or stream.read(1 << 20):
        frame, out = decoder.decompressobj(), []
        while True:
            out.append(frame.decompress(chunk))
            if frame.eof:
                break
            if not (chunk := stream.read(1 << 20)):
                raise ValueError("archive ends within a record")
        rest = frame.unused_data
        yield b"".join(out)


def _write(batches: Iterator[pa.RecordBatch], folder: str, dictionary: bytes, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Archives of one task. Each is written under a name of the attempt and moved when complete,
    so that a repeated task replaces whole archives."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    context = TaskContext.get()
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_kind(dictionary), write_content_size=True)
    head, out, name, made, count, size = archive_head(dictionary), None, "", 0, 0, 0
    done: list[tuple] = []

    def close() -> None:
        out.close()
        store.move(f"{root}/{name}.{context.taskAttemptId()}", f"{root}/{name}")
        done.append((name, count, size))

    for whole in batches:
        for batch in pieces(whole, "html"):
            for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    name = f"pages-{context.partitionId():06d}-{made:04d}.warc.zst"
                    out, made, count, size = store.open_output_stream(f"{root}/{name}.{context.taskAttemptId()}", compression=None), made + 1, 0, len(head)
                    out.write(head)
                packed = compressor.compress(record(page_id, url, (html or "").encode(), refers))
                out.write(packed)
                count, size = count + 1, size + len(packed)
                if size >= archive_bytes:
                    close()
                    out = None
    if out is not None:
        close()
    if done:
        yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["archive", "records", "bytes"]), preserve_index=False)


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    for batch in batches:
        for name in batch.column("archive").to_pylist():
            rows: list[dict] = []
            with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for raw in open_archive(stream):
                    rows.append(parse(raw) | {"archive": name})
                    if len(rows) == 2000:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)


def sample_records(pages: DataFrame, most: int = SAMPLE_RECORDS) -> list[bytes]:
    """Up to ``most`` archived records, by a hash of their ids, each cut to SAMPLE_BYTES: a
    bounded sample for the dictionary, which alters the size of archives alone."""
    ids = [r[0] for r in pages.select("page_id").filter("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most).collect()]
    rows = pages.filter(F.col("page_id").isin(ids)).select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html")).limit(2 * most).collect() if ids else []
    return [record(r["page_id"], r["url"], (r["html"] or "").encode(), None) for r in sorted(rows, key=lambda r: (r["page_id"], r["url"] or "", r["html"] or ""))]


def mark_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html and ``refers_to``: the smallest id with an equal payload of at least
    ``least`` bytes, for pages that aren't it. Digests are counted before the payloads move."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    digest = F.when(F.octet_length("html") >= least, F.sha2("html", 256))
    first = rows.select("page_id", digest.alias("digest")).filter("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # Pages too small to repeat get keys of their own, so that they don't meet in one task.
    own = F.concat(F.lit("small "), F.xxhash64("page_id", "url").cast("string"))
    repeated = rows.withColumn("digest", F.coalesce(digest, own)).join(first, "digest", "left")
    return repeated.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, dictionary: bytes | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages (page_id, url, html) as ``*.warc.zst`` below ``folder``, a URI that every
    executor can reach; the archives' names, record counts and sizes."""
    dictionary = train_dictionary(sample_records(pages)) if dictionary is None else dictionary
    made = mark_revisits(pages).mapInArrow(lambda b: _write(b, folder, dictionary, archive_bytes), "archive string, records bigint, bytes bigint")
    made.write.parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema("archive string, records bigint, bytes bigint").parquet(f"{folder}/_manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives that the manifest names. An archive is read by one task
    from end to end, and there are as many tasks as archives: a given number of partitions, which
    adaptive execution doesn't fold although the manifest is small."""
    spread = manifest.select("archive").coalesce(1).repartition(max(1, manifest.count()))  # names alone
    return spread.mapInArrow(lambda b: _read(b, folder), _SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives all pages and reads the archives back.

    A null html is an empty payload; a null url is left out of its record, control characters in
    a url are percent-encoded. A page of any length is one record; it is held in memory once. Of
    equal payloads of at least 100 bytes (UTF-8; 100 count, 99 don't), records with the smallest
    page_id are responses (all of them, where rows repeat that id), others revisit it; a null
    page_id is archived as such and only refers to pages that have one. An empty table writes no
    archive. Other columns are ignored.
    """
    folder = shared_folder(pages.sparkSession, f"warc-{uuid.uuid4().hex[:8]}")
    return read_archives(write_archives(pages, folder), folder)
