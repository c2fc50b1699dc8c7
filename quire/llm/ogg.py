"""Operator 7: media columns in Ogg: pages, lacing, checksums, granule positions, multiplexed logical streams.

``write_ogg`` stores 8-bit samples losslessly: blocks of samples are dealt in turn to several logical streams
(voices), each with a header packet, and their pages are interleaved in one physical stream. ``read_ogg`` is a
general reader: it finds pages by their capture pattern, verifies every page checksum, joins lacing values to
packets (also across pages), separates the logical streams and derives packet times from granule positions.

Damaged input gives a defined result: a page whose checksum fails, or bytes that are no page, are counted and
skipped; a packet that began or ended in a lost page is dropped and counted.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_slices

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4
#: packet size, samples a second, logical streams of the writer
PACKET, RATE, VOICES = 4096, 8000, 2
HEADER = struct.Struct("<8sBBIQ")  # magic, version, voice, rate, samples of this voice
MAGIC = b"quirepcm"


def ogg_crc(data: bytes) -> int:
    """The format's CRC (0x04C11DB7, most significant bit first, no inversion), by way of zlib's reflected one."""
    raw = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = b"OggS" + struct.pack("<BBqIII", 0, kind, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    data = head + body
    return data[:22] + struct.pack("<I", ogg_crc(data)) + data[26:]


def pages(packets: list[bytes], granules: list[int], serial: int) -> list[bytes]:
    """The pages of one logical stream; its first packet, the header, has a page of its own."""
    out, number = [], 0
    lacing, body, granule, kind = bytearray(), [], -1, FIRST

    def flush(last: int = 0) -> None:
        nonlocal number, granule, kind
        out.append(page(kind | last, granule, serial, number, bytes(lacing), b"".join(body)))
        number, granule, kind = number + 1, -1, 0
        lacing.clear()
        body.clear()

    for i, (packet, at) in enumerate(zip(packets, granules)):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        done = 0
        while done < len(values):
            if len(lacing) == 255:
                flush()
                kind = CONTINUED if done else 0
            part = values[done : done + 255 - len(lacing)]
            lacing += part
            body.append(packet[done * 255 : (done + len(part)) * 255])
            done += len(part)
        granule = at
        if i == 0 and len(packets) > 1:
            flush()
    flush(LAST)
    return out


def write_ogg(samples: bytes, rate: int = RATE, voices: int = VOICES, packet: int = PACKET) -> bytes:
    """Samples as one physical stream; the same samples always give the same bytes."""
    blocks = [samples[i : i + packet] for i in range(0, len(samples), packet)]
    serial = zlib.crc32(samples)
    streams = []
    for v in range(voices):
        own = blocks[v::voices]
        ends = np.cumsum([len(b) for b in own], dtype=np.int64).tolist()
        head = HEADER.pack(MAGIC, voices, v, rate, ends[-1] if ends else 0)
        streams.append(pages([head, *own], [0, *ends], (serial + v) & 0xFFFFFFFF))
    out = [s[0] for s in streams]  # all first pages stand before any other
    for i in range(1, max(map(len, streams))):
        out += [s[i] for s in streams if i < len(s)]
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of each packet; -1: not known
    ended: bool = False
    lost: int = 0
    next: int = 0
    open: list[bytes] = field(default_factory=list)
    pending: bool = False

    def times(self, rate: int) -> list[float | None]:
        return [g / rate if g >= 0 else None for g in self.granules]


@dataclass
class Media:
    streams: dict[int, Stream]
    pages: int
    bad_pages: int
    skipped_bytes: int


def read_ogg(data: bytes) -> Media:
    streams: dict[int, Stream] = {}
    n = bad = skipped = at = 0
    while at < len(data):
        found = data.find(b"OggS", at)
        if found < 0:
            skipped += len(data) - at
            break
        skipped += found - at
        at = found
        if at + 27 > len(data) or at + 27 + data[at + 26] > len(data):
            skipped += len(data) - at
            break
        version, kind, granule, serial, number, crc, segments = struct.unpack_from("<BBqIIIB", data, at + 4)
        lacing = data[at + 27 : at + 27 + segments]
        begin = at + 27 + segments
        end = begin + sum(lacing)
        whole = data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]
        if version or end > len(data) or ogg_crc(whole) != crc:
            bad += 1
            at += 4
            skipped += 4
            continue
        n, at = n + 1, end
        s = streams.setdefault(serial, Stream(serial))
        gap, s.next = number != s.next, number + 1
        if gap or bool(kind & CONTINUED) != s.pending:  # pages lost: what was open can't be ended
            s.lost += s.pending
            s.open, s.pending = [], False
        skip = bool(kind & CONTINUED) and not s.pending
        pos, size, done = begin, 0, []
        for v in lacing:
            size += v
            if v < 255:
                s.open.append(data[pos : pos + size])
                if skip:
                    s.lost, skip = s.lost + 1, False
                else:
                    done.append(b"".join(s.open))
                s.open, pos, size = [], pos + size, 0
        s.pending = bool(lacing) and lacing[-1] == 255
        if s.pending:
            s.open.append(data[pos : pos + size])
            if skip:
                s.open, s.pending = [], False
        s.packets += done
        # a page's granule position is that of the last packet that ends on it
        s.granules += [-1] * (len(done) - 1) + [granule] * bool(done)
        s.ended |= bool(kind & LAST)
    for s in streams.values():
        s.lost += s.pending
    return Media(streams, n, bad, skipped)


def samples_of(media: Media) -> tuple[bytes, dict[str, float]]:
    """The samples that ``write_ogg`` stored, and features of them and of the container."""
    voices = {}
    rate = RATE
    for s in media.streams.values():
        if s.packets and s.packets[0][:8] == MAGIC:
            _, count, voice, rate, total = HEADER.unpack(s.packets[0])
            sizes = np.cumsum([len(p) for p in s.packets[1:]], dtype=np.int64).tolist()
            known = all(g in (-1, e) for g, e in zip(s.granules[1:], sizes))
            if not known or (sizes or [0])[-1] != total or not s.ended:
                raise ValueError("granule positions and samples differ")
            voices[voice] = s.packets[1:]
    blocks = [b for i in range(max(map(len, voices.values()), default=0)) for v in sorted(voices) for b in voices[v][i : i + 1]]
    out = b"".join(blocks)
    wave = np.frombuffer(out, dtype=np.uint8).astype(np.int16)
    seconds = max((s.granules[-1] / rate for s in media.streams.values() if s.granules), default=0.0)
    return out, {
        "streams": len(media.streams), "pages": media.pages, "packets": sum(len(s.packets) for s in media.streams.values()), "rate": rate, "seconds": seconds,
        "mean": float(wave.mean()) if len(wave) else 0.0, "peak": int(wave.max(initial=0)), "crossings": int(np.count_nonzero(np.diff(wave >= 128))) if len(wave) else 0,
    }


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, padded with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def media_column(docs: DataFrame, *, rate: int = RATE, voices: int = VOICES) -> DataFrame:
    """doc_id, n_bytes, media (the stored form): a row for each row of docs; null text is empty."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            rows = [payload_of(t) for t in part.column("text").to_pylist()]
            media = [write_ogg(p, rate, voices) for _, p in rows]
            yield pa.record_batch([part.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """What is read back from the stored bytes of ``media_column``: digests and features.

    Null media has no payload (0 bytes, feature ``none``). Of media whose samples can't all be read, the payload's columns
    are null and the feature is ``damaged``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "media"):
            rows = []
            for media in part.column("media").to_pylist():
                if media is None:
                    rows.append((0, hashlib.sha256(b"").hexdigest(), zlib.crc32(b""), 0, None, "none"))
                    continue
                read_back = read_ogg(media)
                try:
                    samples, f = samples_of(read_back)
                except (ValueError, struct.error):
                    rows.append((None, None, None, len(media), hashlib.sha256(media).hexdigest(), f"damaged;pages={read_back.pages};bad={read_back.bad_pages};skipped={read_back.skipped_bytes}"))
                    continue
                feature = f"ogg;streams={f['streams']};pages={f['pages']};packets={f['packets']};seconds={f['seconds']:.6f};mean={f['mean']:.4f};peak={f['peak']};crossings={f['crossings']}"
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", *names])

    return stored.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
