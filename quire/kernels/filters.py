"""Stream filters: Flate, LZW, ASCIIHex, ASCII85, RunLength and the TIFF and PNG predictors."""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np

from quire.kernels.syntax import hex_bytes

#: filters that hold images and are left to image operators
IMAGE = {"DCTDecode": "jpeg", "DCT": "jpeg", "JPXDecode": "jpx", "JBIG2Decode": "jbig2", "CCITTFaxDecode": "ccitt", "CCF": "ccitt"}
SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "RL": "RunLengthDecode"}
LARGEST = 1 << 28


def flate(data: bytes, limit: int = LARGEST, strict: bool = False) -> bytes | None:
    """Zlib or raw deflate; what was decoded before damage is kept unless strict."""
    zlib_like = len(data) > 1 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0
    for bits in (15, -15) if zlib_like or strict else (-15, 15):
        d = zlib.decompressobj(bits)
        out, at = [], 0
        total = 0
        try:
            while at < len(data) and not d.eof and total < limit:
                piece = d.decompress(data[at : at + 65536], limit - total)
                out.append(piece)
                total += len(piece)
                at += 65536
                while d.unconsumed_tail and total < limit:
                    piece = d.decompress(d.unconsumed_tail, limit - total)
                    out.append(piece)
                    total += len(piece)
            return b"".join(out)
        except zlib.error:
            if out and not strict and (total or bits == -15):
                tail = _bytewise(data, bits, limit)
                if tail:
                    return tail
    return None if strict else b""


def _bytewise(data: bytes, bits: int, limit: int) -> bytes:
    d, out = zlib.decompressobj(bits), bytearray()
    try:
        for i in range(len(data)):
            out += d.decompress(data[i : i + 1])
            if len(out) >= limit:
                break
    except zlib.error:
        pass
    return bytes(out[:limit])


def ascii_hex(data: bytes) -> bytes:
    return hex_bytes(data.split(b">", 1)[0])


_NOT_85 = bytes(c for c in range(256) if not 33 <= c <= 117 and c != 0x7A)
_POWERS_85 = np.array([85**4, 85**3, 85**2, 85, 1], np.uint64)


def ascii85(data: bytes) -> bytes:
    data = re.sub(rb"[\0\t\n\f\r ]", b"", data)
    if data.startswith(b"<~"):
        data = data[2:]
    data = data.split(b"~", 1)[0]
    runs = data.translate(None, _NOT_85).split(b"z")  # z stands for four zero bytes between groups; within one it is passed over
    data = runs[0]
    if len(runs) > 1:
        parts, size = [data], len(data)
        for run in runs[1:]:
            zero = b"!!!!!" if size % 5 == 0 else b""
            parts += [zero, run]
            size += len(zero) + len(run)
        data = b"".join(parts)
    n = len(data) % 5
    digits = np.frombuffer(data + b"u" * (-len(data) % 5), np.uint8).reshape(-1, 5).astype(np.uint64) - 33
    out = (digits @ _POWERS_85).astype(np.uint32).astype(">u4").tobytes()
    return out[: len(out) - (5 - n)] if n else out


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n == 128:
            break
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


@functools.lru_cache(4)
def _lzw_widths(early: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the codes after a clear code, and where each begins: the table's growth tells both."""
    sizes = np.minimum(257 + np.arange(4096), 4096) + early  # of the table before each code
    widths = np.where(sizes >= 2048, 12, np.where(sizes >= 1024, 11, np.where(sizes >= 512, 10, 9)))
    widths[0] = 9
    return widths, np.concatenate([[0], np.cumsum(widths)])


def _lzw_codes(data: np.ndarray, bits: int, at: int, first: int, count: int, early: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``count`` codes from the bit ``at`` on, the first of which is number ``first`` after a clear code, and where each ends."""
    widths, starts = _lzw_widths(early)
    k = np.arange(first, first + count)
    w = widths[np.minimum(k, 4095)]
    begins = at + np.cumsum(w) - w
    ends = begins + w
    fit = int(np.searchsorted(ends, bits, "right"))
    begins, ends, w = begins[:fit], ends[:fit], w[:fit]
    i = begins >> 3
    held = data[i] << 16 | data[i + 1] << 8 | data[i + 2]
    return held >> 24 - (begins & 7) - w & (1 << w) - 1, ends


def _lzw_bytes(data: bytes) -> bytes | None:
    """Data of nothing but bytes, with clear codes so close that no code is longer than nine bits; None for other data."""
    held = np.frombuffer(data + b"\0", np.uint8).astype(np.uint16)
    at = np.arange(0, 8 * len(data) - 8, 9)
    i = at >> 3
    codes = (held[i] << 8 | held[i + 1]) >> (7 - (at & 7)).astype(np.uint16) & 511
    stop = np.flatnonzero(codes == 257)[:1]
    codes = codes[: stop[0]] if len(stop) else codes
    clears = np.flatnonzero(codes == 256)
    runs = np.diff(np.concatenate([[-1], clears, [len(codes)]])) - 1
    return codes[codes < 256].astype(np.uint8).tobytes() if runs.max() <= 253 and not (codes > 256).any() else None


def lzw(data: bytes, early: int = 1, limit: int = LARGEST) -> bytes:
    short = _lzw_bytes(data)
    if short is not None:
        return short[:limit]
    out, size = [], 0
    bits, padded = 8 * len(data), np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    at = first = 0
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, last, count = base, None, 512
    while at < bits and size <= limit:
        codes, ends = _lzw_codes(padded, bits, at, first, count, early)
        if not len(codes):
            break
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(stops[0]) if len(stops) else len(codes)
        run = codes[:n]
        if n and (first or n == len(codes)) or n and int(run.max()) > 255:  # entries of the table, or more to come that may use them
            if table is base:
                table = list(base)
            for code in run.tolist():
                if code < len(table):
                    entry = table[code]
                elif last is not None and code == len(table):
                    entry = last + last[:1]
                else:
                    return b"".join(out)[:limit]
                out.append(entry)
                size += len(entry)
                if size > limit:
                    break
                if last is not None and len(table) < 4096:
                    table.append(last + entry[:1])
                last = entry
        elif n:  # up to the next clear code there are only bytes
            out.append(run.astype(np.uint8).tobytes())
            size += n
        if n == len(codes):
            at, first, count = int(ends[-1]), first + n, min(8 * count, 1 << 16)
        elif codes[n] == 257:
            break
        else:
            at, first, count = int(ends[n]), 0, max(256, n + 8)  # the next run is likely as long
            table, last = base, None
    return b"".join(out)[:limit]


def unpredict(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    if predictor < 2:
        return data
    bpp = max(1, colors * bits // 8)
    row = (colors * bits * columns + 7) // 8
    if row <= 0:
        return data
    if predictor == 2:
        rows = len(data) // row
        if bits != 8:
            return data
        a = np.frombuffer(data[: rows * row], np.uint8).reshape(rows, -1, colors)
        return np.cumsum(a, axis=1, dtype=np.uint8).tobytes()
    rows = len(data) // (row + 1)
    a = np.frombuffer(data[: rows * (row + 1)], np.uint8).reshape(rows, row + 1)
    kinds, out = a[:, 0], np.zeros((rows, row), np.uint8)
    before = np.zeros(row, np.uint8)
    for i in range(rows):
        line, kind = a[i, 1:], int(kinds[i])
        if kind == 0:
            now = line
        elif kind == 2:
            now = line + before
        elif kind == 1:
            pad = np.pad(line, (0, -row % bpp)).reshape(-1, bpp)
            now = np.cumsum(pad, axis=0, dtype=np.uint8).ravel()[:row]
        elif kind in (3, 4):
            now = bytearray(line.tobytes())
            up = before.tobytes()
            for x in range(row):
                left, above = now[x - bpp] if x >= bpp else 0, up[x]
                if kind == 3:
                    now[x] = now[x] + (left + above >> 1) & 255
                else:
                    corner = up[x - bpp] if x >= bpp else 0
                    p = left + above - corner
                    pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
                    now[x] = now[x] + (left if pa <= pb and pa <= pc else above if pb <= pc else corner) & 255
            now = np.frombuffer(bytes(now), np.uint8)
        else:
            now = line
        out[i] = before = now
    return out.tobytes()


def decode(data: bytes, filters: list[str], parms: list[dict], limit: int = LARGEST) -> tuple[bytes, str | None] | None:
    """Undo filters up to an image codec: (data, codec or None); None where a filter is unknown or data is broken."""
    for i, name in enumerate(filters):
        name, p = SHORT.get(name, name), parms[i] if i < len(parms) else {}
        if name in IMAGE:
            return (data, IMAGE[name]) if i == len(filters) - 1 else None
        if name == "FlateDecode":
            got = flate(data, limit, strict=i > 0)
            if got is None:
                return None
            data = got
        elif name == "LZWDecode":
            early = p.get("EarlyChange", 1)
            data = lzw(data, early if early in (0, 1) else 1, limit)
        elif name == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif name == "ASCII85Decode":
            data = ascii85(data)
        elif name == "RunLengthDecode":
            data = run_length(data)
        elif name == "Crypt":
            continue
        else:
            return None
        if name in ("FlateDecode", "LZWDecode"):
            numbers = [v if isinstance(v := p.get(k), int) and v > 0 else d for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1))]
            data = unpredict(data, *numbers)
    return data[:limit], None


# encoders, for writing and for tests
def encode_ascii85(data: bytes) -> bytes:
    import base64

    return base64.a85encode(data) + b"~>"


def encode_run_length(data: bytes) -> bytes:
    return b"".join(bytes([len(p) - 1]) + p for i in range(0, len(data), 128) if (p := data[i : i + 128])) + b"\x80"


def encode_lzw(data: bytes) -> bytes:
    """Nine-bit codes only, with a clear code before the table grows: valid for either EarlyChange."""
    raw = np.frombuffer(data, np.uint8)
    codes = np.append(np.insert(raw.astype(">u2"), np.arange(0, len(raw), 200), 256), 257).astype(">u2")
    return np.packbits(np.unpackbits(codes.view(np.uint8)).reshape(-1, 16)[:, 7:]).tobytes()
