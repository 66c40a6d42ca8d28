"""Ogg containers of 8-bit samples: written, and read with every page checked.

A file has two logical streams that share the samples: packets alternate between them,
and so do the pages.  Reading verifies each page's checksum and order, joins packets
from lacing values (also across pages), demultiplexes the streams by serial number and
takes timestamps from granule positions, which count a stream's samples so far.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import prepare

FRAME, PAD, RATE = 576, 255, 8000
#: Samples of a packet: a few frames.
PACKET = 4 * FRAME
_PAGE = struct.Struct("<4sBBqIIIB")
_HEAD = struct.Struct("<8sIQH")
_NAME = b"SAMPLE8\0"
_FLIP = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))
_CONTINUED, _FIRST, _LAST = 1, 2, 4


def checksum(*parts: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04C11DB7, highest bit first, no inversions) by way of the reflected one on flipped bytes."""
    crc = 0xFFFFFFFF
    for p in parts:
        crc = zlib.crc32(p.translate(_FLIP), crc)
    return int(f"{crc ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = bytearray(_PAGE.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)))
    head[22:26] = struct.pack("<I", checksum(bytes(head), lacing, body))
    return bytes(head) + lacing + body


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of up to 255 lacing values after the stream's first; packets come with the granule at their end."""
    lacing, body, granule, number, open_packet = bytearray(), bytearray(), -1, 1, False
    for k, (packet, at) in enumerate(packets):
        sizes = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
        done = 0
        while sizes:
            room = 255 - len(lacing)
            if not room:
                yield _page(_CONTINUED * open_packet, granule, serial, number, bytes(lacing), bytes(body))
                lacing, body, granule, number, open_packet = bytearray(), bytearray(), -1, number + 1, done > 0
                continue
            part, sizes = sizes[:room], sizes[room:]
            size = sum(part)
            body += packet[done : done + size]
            lacing += part
            done += size
        granule = at
    yield _page(_CONTINUED * open_packet | _LAST, granule, serial, number, bytes(lacing), bytes(body))


def encode(samples: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """An Ogg file of 8-bit samples.  Serial numbers come from the samples, so equal samples give equal files."""
    seed = zlib.crc32(samples)
    serials = seed, seed ^ 0x5A5A5A5A
    cut = [samples[a : a + packet] for a in range(0, len(samples), packet)]
    out = [_page(_FIRST, 0, s, 0, b"\x16", _HEAD.pack(_NAME, rate, len(samples), k)) for k, s in enumerate(serials)]
    streams = []
    for k, s in enumerate(serials):
        own = cut[k::2]
        streams.append(_pages(s, list(zip(own, np.cumsum([len(x) for x in own]).tolist()))))
    # The pages of both streams in turn.
    while streams:
        for s in list(streams):
            if (page := next(s, None)) is None:
                streams.remove(s)
            else:
                out.append(page)
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream as it is read."""

    packets: list[bytes] = field(default_factory=list)
    stamps: list[tuple[int, int]] = field(default_factory=list)
    pending: bytearray = field(default_factory=bytearray)
    number: int = 0
    ended: bool = False


@dataclass
class Media:
    """What decode() found: samples in order, the rate, and of each stream its packets, pages and last timestamp in seconds."""

    samples: bytes
    rate: int
    streams: int
    pages: int
    packets: int
    seconds: list[float]


def decode(media: bytes) -> Media:
    """Read a file that encode() wrote; ValueError where a page, an order or a length is wrong."""
    streams: dict[int, Stream] = {}
    at, pages = 0, 0
    while at < len(media):
        if len(media) - at < _PAGE.size:
            raise ValueError(f"a page header is cut off at byte {at}")
        mark, version, kind, granule, serial, number, crc, n = _PAGE.unpack_from(media, at)
        if mark != b"OggS" or version:
            raise ValueError(f"no page begins at byte {at}")
        lacing = media[at + _PAGE.size : at + _PAGE.size + n]
        start, size = at + _PAGE.size + n, sum(lacing)
        body = media[start : start + size]
        if len(lacing) < n or len(body) < size:
            raise ValueError(f"the page at byte {at} is cut off")
        if checksum(media[at : at + 22], bytes(4), media[at + 26 : at + _PAGE.size], lacing, body) != crc:
            raise ValueError(f"the page at byte {at} has a wrong checksum")
        if kind & _FIRST:
            streams[serial] = Stream()
        s = streams.get(serial)
        if s is None or s.ended or number != s.number or bool(kind & _CONTINUED) != bool(s.pending):
            raise ValueError(f"the page at byte {at} is out of order")
        s.number += 1
        s.ended = bool(kind & _LAST)
        k = 0
        # Values under 255 end a packet.
        ends = np.flatnonzero(np.frombuffer(lacing, np.uint8) < 255)
        upto = np.cumsum(np.frombuffer(lacing, np.uint8), dtype=np.int64)
        for e in upto[ends].tolist():
            if s.pending:
                s.packets.append(bytes(s.pending) + body[k:e])
                s.pending.clear()
            else:
                s.packets.append(body[k:e])
            k = e
        s.pending += body[k:]
        if granule >= 0:
            s.stamps.append((pages, granule))
        at, pages = start + size, pages + 1
    order = sorted(streams.values(), key=lambda s: _HEAD.unpack(s.packets[0])[3])
    if not order or any(not s.ended or s.pending for s in order):
        raise ValueError("a stream has no last page")
    _, rate, total, _ = _HEAD.unpack(order[0].packets[0])
    body = [s.packets[1:] for s in order]
    samples = b"".join(body[k % len(body)][k // len(body)] for k in range(sum(map(len, body))))
    if len(samples) != total or any(s.stamps[-1][1] != sum(map(len, b)) for s, b in zip(order, body)):
        raise ValueError("the samples do not add up to the granule positions")
    return Media(samples, rate, len(order), pages, sum(map(len, body)), [s.stamps[-1][1] / rate for s in order])


def features(media: Media) -> str:
    """Container and signal figures as text."""
    x = np.frombuffer(media.samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256) - 128
    rms = float(np.sqrt((counts * level**2).sum() / max(1, len(x))))
    crossings = int(np.count_nonzero((x[1:] < 128) != (x[:-1] < 128)))
    ends = "/".join(f"{s:.4f}" for s in media.seconds)
    return f"streams={media.streams};pages={media.pages};packets={media.packets};rate={media.rate};ends={ends};rms={rms:.4f};crossings={crossings}"


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text (null: none) padded by 255 to a positive multiple of a frame; their number before."""
    raw = (text or "").encode()
    return len(raw), raw + bytes([PAD]) * (FRAME - len(raw) % FRAME if len(raw) % FRAME or not raw else 0)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, payload_bytes and media, the text as an Ogg file.  Null and empty texts have one frame of padding."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.chunks(batches, "_text"):
            made = [payload(t) for t in batch.column("_text").to_pylist()]
            media = pa.array([encode(p) for _, p in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([len(p) for _, p in made], pa.int64()), media], ["_id", "n_bytes", "payload_bytes", "media"])

    kind = T.StructField("_id", docs.schema[id_col].dataType)
    schema = T.StructType([kind, T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def from_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The same rows with samples and feature; a file that fails its checks, or is null, has nulls and says why in problem."""
    prepare(media.sparkSession)
    names = [*media.columns, "samples", "feature", "problem"]
    if len(set(names)) < len(names):
        raise ValueError("samples, feature and problem are columns of the result; rename those of the input")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.chunks(batches, media_col):
            samples, feature, problem = [], [], []
            for raw in batch.column(media_col).to_pylist():
                try:
                    if raw is None:
                        raise ValueError("no media")
                    m = decode(raw)
                    samples.append(m.samples)
                    feature.append(features(m))
                    problem.append(None)
                except (ValueError, struct.error, IndexError) as e:
                    samples.append(None)
                    feature.append(None)
                    problem.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(samples, pa.binary()), pa.array(feature, pa.string()), pa.array(problem, pa.string())], names)

    schema = T.StructType([*media.schema.fields, T.StructField("samples", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField("problem", T.StringType())])
    return media.mapInArrow(run, schema)
