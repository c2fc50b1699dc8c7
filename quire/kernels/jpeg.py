"""JPEG: headers, Exif removal, a baseline decoder and a baseline encoder."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np


@dataclass
class Info:
    width: int
    height: int
    components: int
    bits: int
    sof: int
    adobe: int | None
    rgb_ids: bool


def segments(data: bytes):
    """(marker, start of payload, end) up to the scan."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        m = data[at + 1]
        if m == 0xFF or m == 0 or 0xD0 <= m <= 0xD8 or m == 1:
            at += 1 if m == 0xFF else 2
            continue
        if m == 0xD9:
            return
        size = struct.unpack_from(">H", data, at + 2)[0]
        yield m, at + 4, at + 2 + size
        if m == 0xDA:
            return
        at += 2 + size


def sniff(data: bytes) -> Info | None:
    """Frame header, color transform and component ids; null where it is no JPEG."""
    if data[:2] != b"\xff\xd8":
        return None
    found, adobe = None, None
    for m, a, b in segments(data):
        if m == 0xEE and data[a : a + 5] == b"Adobe" and b - a >= 12:
            adobe = data[a + 11]
        if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC) and b - a >= 6:
            bits, h, w, n = struct.unpack_from(">BHHB", data, a)
            ids = bytes(data[a + 6 + 3 * i] for i in range(n) if a + 6 + 3 * i < len(data))
            found = Info(w, h, n, bits, m - 0xC0, None, ids == b"RGB")
    if found:
        found.adobe = adobe
    return found


def strip_exif(data: bytes) -> bytes:
    out, last = bytearray(), 0
    for m, a, b in segments(data):
        if m == 0xE1 and data[a : a + 6] == b"Exif\0\0":
            out += data[last : a - 4]
            last = b
    return bytes(out + data[last:])


# fixed values of the format: zigzag order, by its rule, and the standard tables
ZIGZAG = np.array([8 * y + x for s in range(15) for y, x in sorted(((i, s - i) for i in range(8) if 0 <= s - i < 8), reverse=s % 2 == 0)])
_LUMA = np.array([int(x) for x in "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99".split()])
_CHROMA = np.array([int(x) for x in "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99".split()] + [99] * 32)
_DCT = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


def _huffman(counts: list[int], values: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> value."""
    table, code, i = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = values[i]
            code, i = code + 1, i + 1
        code <<= 1
    return table


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def bits(self, n: int) -> int:
        while self.n < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            self.held, self.n = (self.held << 8 | byte) & 0xFFFFFFFFFF, self.n + 8
        self.n -= n
        return self.held >> self.n & (1 << n) - 1

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bits(1)
            v = table.get((length, code))
            if v is not None:
                return v
        raise ValueError("bad Huffman code")

    def value(self, size: int) -> int:
        v = self.bits(size) if size else 0
        return v if not size or v >> size - 1 else v - (1 << size) + 1


def decode(data: bytes) -> tuple[np.ndarray, Info] | None:
    """Samples (height, width, components) of a baseline file: gray, RGB (from YCbCr where it is that) or four components."""
    info = sniff(data)
    if info is None or info.sof > 1 or info.bits != 8:
        return None
    quant, dc, ac, comps, restart, scan = {}, {}, {}, [], 0, None
    for m, a, b in segments(data):
        if m == 0xDB:
            while a < b:
                wide, t = data[a] >> 4, data[a] & 15
                q = np.frombuffer(data, ">u2" if wide else np.uint8, 64, a + 1).astype(np.int64)
                quant[t] = q
                a += 1 + 64 * (1 + wide)
        elif m == 0xC4:
            while a < b:
                kind, t = data[a] >> 4, data[a] & 15
                counts = list(data[a + 1 : a + 17])
                (ac if kind else dc)[t] = _huffman(counts, list(data[a + 17 : a + 17 + sum(counts)]))
                a += 17 + sum(counts)
        elif m == 0xDD:
            restart = struct.unpack_from(">H", data, a)[0]
        elif 0xC0 <= m <= 0xC1:
            comps = [(data[a + 6 + 3 * i], data[a + 7 + 3 * i] >> 4, data[a + 7 + 3 * i] & 15, data[a + 8 + 3 * i]) for i in range(data[a + 5])]
        elif m == 0xDA:
            tables = {data[a + 1 + 2 * i]: (data[a + 2 + 2 * i] >> 4, data[a + 2 + 2 * i] & 15) for i in range(data[a])}
            scan = b
    if scan is None or not comps or len(tables) != len(comps):
        return None
    parts, at = [], scan
    body = bytearray()
    while at < len(data):
        c = data[at]
        if c == 0xFF:
            m = data[at + 1] if at + 1 < len(data) else 0xD9
            at += 2
            if m == 0:
                body.append(0xFF)
            elif 0xD0 <= m <= 0xD7:
                parts.append(bytes(body))
                body = bytearray()
            else:
                break
        else:
            nxt = data.find(b"\xff", at)
            nxt = len(data) if nxt < 0 else nxt
            body += data[at:nxt]
            at = nxt
    parts.append(bytes(body))
    hmax, vmax = max(c[1] for c in comps), max(c[2] for c in comps)
    mx, my = -(-info.width // (8 * hmax)), -(-info.height // (8 * vmax))
    planes = [np.zeros((my * v, mx * h, 64), dtype=np.int64) for _, h, v, _ in comps]
    done = 0
    for part in parts:
        reader, before = _Bits(part), [0] * len(comps)
        todo = min(restart or mx * my, mx * my - done)
        for mcu in range(done, done + todo):
            for i, (ident, h, v, _) in enumerate(comps):
                d, a = dc.get(tables[ident][0]), ac.get(tables[ident][1])
                for y in range(v):
                    for x in range(h):
                        block = planes[i][mcu // mx * v + y, mcu % mx * h + x]
                        before[i] += reader.value(reader.symbol(d))
                        block[0] = before[i]
                        k = 1
                        while k < 64:
                            rs = reader.symbol(a)
                            run, size = rs >> 4, rs & 15
                            if size == 0:
                                if run < 15:
                                    break
                                k += 16
                                continue
                            k += run
                            if k > 63:
                                break
                            block[ZIGZAG[k]] = reader.value(size)
                            k += 1
        done += todo
    out = []
    for (_, h, v, t), plane in zip(comps, planes):
        q = np.zeros(64, dtype=np.int64)
        q[ZIGZAG] = quant[t]
        blocks = (plane * q).reshape(*plane.shape[:2], 8, 8).astype(np.float64)
        pixels = np.einsum("ki,yxkl,lj->yxij", _DCT, blocks, _DCT) + 128
        full = pixels.transpose(0, 2, 1, 3).reshape(plane.shape[0] * 8, plane.shape[1] * 8)
        full = np.repeat(np.repeat(full, vmax // v, axis=0), hmax // h, axis=1)[: info.height, : info.width]
        out.append(full)
    a = np.stack(out, axis=2)
    if len(comps) == 3 and info.adobe != 0 and not info.rgb_ids:
        y, cb, cr = a[..., 0], a[..., 1] - 128, a[..., 2] - 128
        a = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.floor(a + 0.5), 0, 255).astype(np.uint8), info


# a code for every symbol: lengths by rule, common symbols first
def _flat_table(values: list[int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Counts, values and codes of a prefix code: four short symbols, the others of equal length."""
    short, rest = values[:4], values[4:]
    length = 3 + max(1, (len(rest)).bit_length()) if rest else 3
    counts = [0] * 16
    counts[2] = len(short)
    if rest:
        counts[length - 1] = len(rest)
    codes, code = {}, 0
    i = 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            codes[values[i]] = (n, code)
            code, i = code + 1, i + 1
        code <<= 1
    return counts, values, codes


def encode(samples: np.ndarray, quality: int = 75) -> bytes:
    """A baseline file of 8-bit samples (height, width, 1 or 3), without subsampling; tables fit the image."""
    h, w, n = samples.shape
    a = samples.astype(np.float64)
    if n == 3:
        r, g, b = a[..., 0], a[..., 1], a[..., 2]
        a = np.stack([0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b], axis=2)
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip((t * scale + 50) // 100, 1, 255).astype(np.int64) for t in (_LUMA, _CHROMA)[: 1 + (n == 3)]]
    ph, pw = -h % 8, -w % 8
    a = np.pad(a, ((0, ph), (0, pw), (0, 0)), mode="edge") - 128
    coded = []
    for c in range(n):
        blocks = a[..., c].reshape((h + ph) // 8, 8, (w + pw) // 8, 8).transpose(0, 2, 1, 3)
        f = np.einsum("ki,yxij,lj->yxkl", _DCT, blocks, _DCT).reshape(-1, 64)
        coded.append(np.floor(f / tables[min(c, len(tables) - 1)] + 0.5).astype(np.int64)[:, ZIGZAG])
    symbols: list[list[tuple[int, int, int, int]]] = []  # (is ac, symbol, value, size)
    count: dict[tuple[int, int], int] = {}
    before = [0] * n
    for i in range(len(coded[0])):
        for c in range(n):
            row, out = coded[c][i], []
            d = int(row[0]) - before[c]
            before[c] = int(row[0])
            out.append((0, abs(d).bit_length(), d))
            run = 0
            last = np.flatnonzero(row[1:])
            for k in last.tolist():
                v = int(row[k + 1])
                zeros = k - run
                while zeros > 15:
                    out.append((1, 0xF0, 0))
                    zeros -= 16
                out.append((1, zeros << 4 | abs(v).bit_length(), v))
                run = k + 1
            if not len(last) or last[-1] != 62:
                out.append((1, 0, 0))
            symbols.append(out)
            for kind, s, _ in out:
                count[kind, s] = count.get((kind, s), 0) + 1
    huff = [_flat_table([s for (k, s), _ in sorted(((x, m) for x, m in count.items() if x[0] == kind), key=lambda z: (-z[1], z[0]))]) for kind in (0, 1)]
    bits, size, body = 0, 0, bytearray()
    for out in symbols:
        for kind, s, v in out:
            length, code = huff[kind][2][s]
            extra = s & 15 if kind else s
            value = v if v >= 0 else v + (1 << extra) - 1
            bits, size = bits << length | code, size + length
            if extra:
                bits, size = bits << extra | value, size + extra
            while size >= 8:
                byte = bits >> size - 8 & 255
                body.append(byte)
                if byte == 255:
                    body.append(0)
                size -= 8
            bits &= (1 << size) - 1
    if size:
        byte = (bits << 8 - size | (1 << 8 - size) - 1) & 255
        body += bytes([byte]) + (b"\0" if byte == 255 else b"")

    def segment(marker: int, payload: bytes) -> bytes:
        return bytes([255, marker]) + struct.pack(">H", len(payload) + 2) + payload

    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for i, t in enumerate(tables):
        head += segment(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist()))
    head += segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, 0x11, min(c, len(tables) - 1)]) for c in range(n)))
    for kind in (0, 1):
        head += segment(0xC4, bytes([kind << 4]) + bytes(huff[kind][0]) + bytes(huff[kind][1]))
    head += segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + b"\0\x3f\0")
    return head + bytes(body) + b"\xff\xd9"
