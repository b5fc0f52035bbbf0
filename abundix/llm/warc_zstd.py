"""WARC archives as seekable Zstandard bundles.

Records are gathered into independent Zstandard frames of about ``frame_bytes``; a bundle is a run of frames and
ends with the seek table of the public seekable format (a skippable frame: compressed and plain size of each
frame, number of frames, magic). An index row maps each record identifier to (bundle, frame, offset in the plain
frame, length), so that one record is read by one ranged read and one frame.

Of records with equal payloads of at least ``least`` bytes, that with the largest key is the response and the
others are revisits that name it.

Defined results: NULL html is the empty payload; a NULL key is never a revisit, and only a row without other
copies makes a NULL key the response of anything, so nothing refers to it; repeated rows that share the largest key
are all responses; NULL url leaves the target header out; an empty table gives no bundle; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundix.llm import files
from abundix.session import cut_lineage

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_ok boolean"


def record_id(key: int | None) -> str:
    return f"<urn:page:{'none' if key is None else key}>"


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}"]
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to)}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def key_of(identifier: str) -> int | None:
    name = identifier.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


class Bundle:
    """A bundle that is being written."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        self.uri, self.out, self.frame_bytes = uri, files.create(uri), frame_bytes
        self.press = zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int]] = []
        self.waiting: list[bytes] = []
        self.held = self.written = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset and length of the record."""
        if self.held and self.held + len(data) > self.frame_bytes:
            self._frame()
        place = (len(self.table), self.held, len(data))
        self.waiting.append(data)
        self.held += len(data)
        return place

    def _frame(self) -> None:
        packed = self.press.compress(b"".join(self.waiting))
        self.out.write(packed)
        self.table.append((len(packed), self.held))
        self.written += len(packed)
        self.waiting, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        entries = b"".join(struct.pack("<II", *sizes) for sizes in self.table)
        footer = entries + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(footer)) + footer)
        self.out.close()


class Frames:
    """Random access to the frames of a bundle."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end")
        source.seek(size - 9 - 8 * count)
        sizes = np.frombuffer(source.read(8 * count), dtype="<u4").reshape(count, 2).astype(np.int64)
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes[:, 0])])

    def plain(self, frame: int) -> bytes:
        self.source.seek(int(self.starts[frame]))
        packed = self.source.read(int(self.sizes[frame, 0]))
        plain = zstandard.ZstdDecompressor().decompressobj().decompress(packed)
        if len(plain) != self.sizes[frame, 1]:
            raise ValueError(f"frame {frame} has {len(plain)} bytes, its table says {self.sizes[frame, 1]}")
        return plain


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """Rows (page, digest, refers_to) that repeat a payload; payloads are equal if length, sha256 and sha1 are."""
    long = pages.where(F.col("payload_bytes") >= least)
    firsts = long.groupBy("payload_bytes", "digest256", "digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").drop("n")
    found = long.join(firsts, ["payload_bytes", "digest256", "digest"]).where("page_id < refers_to")
    return found.select(F.col("page_id").alias("r_page"), F.col("digest256").alias("r_digest"), "refers_to").distinct()


def write_bundles(
    df: DataFrame,
    *,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = 1000,
    bundle_bytes: int = 64 << 20,
    frame_bytes: int = 1 << 20,
    level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write all pages; returns the index of records, checkpointed."""
    folder = files.new_folder(df.sparkSession, "warc")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    pages = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    named = pages.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("digest256"))
    narrow = named.select("page_id", "digest", "digest256", F.octet_length("payload").cast("long").alias("payload_bytes"))
    again = cut_lineage(revisits(narrow, least))
    rows = named.join(again, (named["page_id"] == again["r_page"]) & (named["digest256"] == again["r_digest"]), "left")
    rows = rows.select("page_id", "url", "payload", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, index = None, []

        def done():
            out.close()
            columns = list(zip(*index))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            names = ["record_id", "page_id", "bundle", "frame", "offset", "length"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                page, link, data, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                out = out or Bundle(files.new_name(folder, "bundle", ".warc.zst"), frame_bytes, level)
                place = out.add(record(page, link, data, digest, refers_to, date))
                index.append((record_id(page), page, out.uri, *place))
                if out.written >= bundle_bytes:
                    yield done()
                    out, index = None, []
        if out is not None:
            yield done()

    return cut_lineage(rows.mapInArrow(write, INDEX))


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the index, read back from its frame and parsed."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by([("frame", "ascending"), ("offset", "ascending")])
        places = zip(*(rows.column(c).to_pylist() for c in ("frame", "offset", "length")))
        with files.open_at(key[0].as_py()) as source:
            frames, at, plain, out = Frames(source), -1, b"", []
            for frame, offset, length in places:
                if frame != at:
                    at, plain = frame, frames.plain(frame)
                fields, http, payload = parse(plain[offset : offset + length])
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                whole = kind == "revisit" or (
                    len(payload) == int(http["Content-Length"]) and hashlib.sha1(payload).hexdigest() == digest
                )
                refers = fields.get("WARC-Refers-To")
                own = key_of(fields["WARC-Record-ID"])
                out.append((own, int(http["Content-Length"]), digest, kind, key_of(refers) if refers else None, whole))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        names = [c.split()[0] for c in READ.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return index.groupBy("bundle").applyInArrow(run, READ)
