"""Media columns: Ogg files taken apart into the packets of their logical streams.

Each page's checksum is verified (a page that fails is skipped, and the search for the next capture
pattern goes on right behind its own), packets are put together from lacing values across pages, the
streams are separated by serial number (a page that begins a stream anew starts its next link), and
times come from granule positions: a page's position belongs to the last packet that ends on it, the
other packets that end there are spread evenly from the previous position on. Streams whose codec is
known by its first packet (Opus, Vorbis, Speex, FLAC) have times in seconds.

A lost page, seen by the page numbers, drops the packets that it held parts of and marks the next
packet of its stream with ``gap``. How long the lost packets were isn't known, so up to the next page with
a position only that page's last packet has a time; a stream that begins in the middle is alike. Defined cases: null or empty content and bytes without pages give
no packets; a packet that its file's end cuts off is dropped; a null id is carried along; repeated
rows give their packets again; a page without the end of a packet has no position; other columns are never read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4


def page_crc(page: bytes) -> int:
    """The checksum of a page whose checksum field is zero: CRC-32 of polynomial 04C11DB7, not reflected, begun at 0.

    The library's CRC is of the reflected kind, so bits are reversed before and after.
    """
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


class Page(NamedTuple):
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes


def pages_of(content: bytes) -> Iterator[Page]:
    """The pages whose checksum is right."""
    at = content.find(b"OggS")
    while at >= 0:
        end = at
        if at + 27 <= len(content):
            _, version, flags, granule, serial, number, crc, segments = _HEAD.unpack_from(content, at)
            lacing = content[at + 27 : at + 27 + segments]
            end = at + 27 + segments + sum(lacing)
            if version == 0 and len(lacing) == segments and end <= len(content) and page_crc(content[at : at + 22] + b"\0\0\0\0" + content[at + 26 : end]) == crc:
                yield Page(flags, granule, serial, number, lacing, content[at + 27 + segments : end])
                at = content.find(b"OggS", end)
                continue
        at = content.find(b"OggS", at + 4)


class Packet(NamedTuple):
    serial: int
    link: int
    codec: str | None
    packet: int
    header: bool
    granule: float | None
    seconds: float | None
    gap: bool
    payload: bytes


def _codec(first: bytes) -> tuple[str | None, float, int, int]:
    """(name, rate, samples to skip at the start, number of header packets)."""
    if first[:8] == b"OpusHead" and len(first) >= 19:
        return "opus", 48000.0, struct.unpack_from("<H", first, 10)[0], 2
    if first[:7] == b"\x01vorbis" and len(first) >= 30:
        return "vorbis", float(struct.unpack_from("<I", first, 12)[0]), 0, 3
    if first[:8] == b"Speex   " and len(first) >= 68:
        return "speex", float(struct.unpack_from("<I", first, 36)[0]), 0, 2 + struct.unpack_from("<I", first, 68)[0] if len(first) >= 72 else 2
    if first[:5] == b"\x7fFLAC" and len(first) >= 30:
        return "flac", float(int.from_bytes(first[27:30], "big") >> 4), 0, 1 + struct.unpack_from(">H", first, 7)[0]
    return None, 0.0, 0, 0


class _Stream:
    def __init__(self, link: int):
        self.link, self.codec, self.count = link, None, 0
        self.rate, self.skip, self.headers = 0.0, 0, 0
        self.parts: list[bytes] | None = None
        self.number: int | None = None
        self.granule: int | None = 0  # the last known position; None behind a gap
        self.gap = False

    def page(self, page: Page) -> Iterator[Packet]:
        if self.number is not None and page.number != (self.number + 1) & 0xFFFFFFFF or self.number is None and page.number and not page.flags & FIRST:
            self.parts, self.gap, self.granule = None, True, None
        self.number = page.number
        if not page.flags & CONTINUED:
            if self.parts is not None:
                self.gap, self.granule = True, None
            self.parts = None
        dropping = bool(page.flags & CONTINUED) and self.parts is None
        done, at = [], 0
        for value in page.lacing:
            if not dropping:
                self.parts = [] if self.parts is None else self.parts
                self.parts.append(page.body[at : at + value])
            at += value
            if value < 255:
                if not dropping:
                    done.append(b"".join(self.parts))
                self.parts, dropping = None, False
        known = page.granule >= 0
        for i, payload in enumerate(done):
            if self.count == 0:
                self.codec, self.rate, self.skip, self.headers = _codec(payload)
            header = self.count < self.headers
            granule = None
            if known and not header and (self.granule is not None or i + 1 == len(done)):
                granule = page.granule if i + 1 == len(done) else self.granule + (page.granule - self.granule) * (i + 1) / len(done)
            seconds = (granule - self.skip) / self.rate if granule is not None and self.rate else None
            yield Packet(page.serial, self.link, self.codec, self.count, header, granule, seconds, self.gap, payload)
            self.count, self.gap = self.count + 1, False
        if done and known:
            self.granule = page.granule


def packets_of(content: bytes) -> Iterator[Packet]:
    """The packets of every logical stream, in the order of their ends."""
    streams: dict[int, _Stream] = {}
    for page in pages_of(content):
        if page.flags & FIRST or page.serial not in streams:
            old = streams.get(page.serial)
            streams[page.serial] = _Stream(old.link + 1 if old else 0)
        yield from streams[page.serial].page(page)


_SCHEMA = "serial long, link int, codec string, packet long, header boolean, granule double, seconds double, gap boolean, payload binary"
_TYPES = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.bool_(), pa.binary())


def _demux_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found, size = [], [], 0
        for row in range(batch.num_rows):
            content = batch.column(1)[row].as_py()
            for packet in packets_of(content) if content else ():
                rows.append(row)
                found.append(packet)
                size += len(packet.payload)
            if found and (size > 1 << 22 or row + 1 == batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array([p[i] for p in found], t) for i, t in enumerate(_TYPES))], ["media_id", *Packet._fields])
                rows, found, size = [], [], 0


def demux(media: DataFrame, id_col: str = "media_id", content_col: str = "content") -> DataFrame:
    """(media_id, serial, link, codec, packet, header, granule, seconds, gap, payload): a row for each packet."""
    rows = media.select(F.col(id_col).alias("media_id"), F.col(content_col).cast("binary").alias("content"))
    return rows.mapInArrow(_demux_batches, f"media_id {rows.schema['media_id'].dataType.simpleString()}, {_SCHEMA}")


# ---------------------------------------------------------------- writing
def page_bytes(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = page_crc(head + lacing + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + lacing + body


def stream_pages(serial: int, headers: list[bytes], packets: list[bytes], step: int, segments: int = 20) -> list[bytes]:
    """The pages of a logical stream: a page for each header, then pages of at most ``segments`` lacing values; each packet advances the position by ``step``."""
    lay = lambda p: [(255, p[i : i + 255]) for i in range(0, len(p) - len(p) % 255, 255)] + [(len(p) % 255, p[len(p) - len(p) % 255 :])]
    out = []
    for h in headers:
        laid = lay(h)
        out.append((0, 0, laid))
    flat = [(value, part, k) for k, p in enumerate(packets) for value, part in lay(p)]
    for at in range(0, len(flat), segments):
        page = flat[at : at + segments]
        ends = [k for value, _, k in page if value < 255]
        out.append((CONTINUED if at and flat[at - 1][0] == 255 else 0, step * (ends[-1] + 1) if ends else -1, [x[:2] for x in page]))
    return [page_bytes(flags | (FIRST if i == 0 else 0) | (LAST if i + 1 == len(out) else 0), granule, serial, i, bytes(v for v, _ in laid), b"".join(p for _, p in laid)) for i, (flags, granule, laid) in enumerate(out)]


OPUS_HEADERS = [b"OpusHead" + struct.pack("<BBHIhB", 1, 1, 312, 48000, 0, 0), b"OpusTags" + struct.pack("<I", 0) + struct.pack("<I", 0)]
VORBIS_HEADERS = [b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 1, 44100, 0, 0, 0, 0xB8, 1), b"\x03vorbis" + struct.pack("<II", 0, 0) + b"\x01", b"\x05vorbis"]
CHUNK = 1000


def mux_text(text: str) -> bytes:
    """An Ogg file of two interleaved streams: the text in pieces of ``CHUNK`` characters, and each piece's MD5."""
    parts = [text[i : i + CHUNK].encode() for i in range(0, len(text), CHUNK)]
    one = stream_pages(1, OPUS_HEADERS, parts, 960)
    two = stream_pages(2, VORBIS_HEADERS, [hashlib.md5(p).hexdigest().encode() for p in parts], 1024)
    both = [page for i in range(max(len(one), len(two))) for page in (*one[i : i + 1], *two[i : i + 1])]
    return b"".join(both)


def _mux_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if t is None else mux_text(t) for t in part.column(1).to_pylist()], pa.binary())], ["media_id", "content"])


def media_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(media_id, content): each text as an Ogg file, for tables that have no media of their own; null for a null text."""
    rows = docs.select(F.col(id_col).alias("media_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_mux_batches, f"media_id {rows.schema['media_id'].dataType.simpleString()}, content binary")
