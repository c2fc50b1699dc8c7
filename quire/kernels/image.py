"""Samples to 8-bit gray or RGB, area downscaling, fitting and eligibility."""

from __future__ import annotations

import math

import numpy as np

from quire.kernels.syntax import Name, Str, Stream


def unpack(data: bytes, width: int, height: int, components: int, bits: int) -> np.ndarray | None:
    """Samples as an array (height, width, components) of their own range."""
    row = (width * components * bits + 7) // 8
    a = np.frombuffer(data.ljust(row * height, b"\0")[: row * height], np.uint8).reshape(height, row)
    n = width * components
    if bits == 8:
        out = a[:, :n]
    elif bits == 16:
        out = a[:, : 2 * n : 2]
    elif bits in (1, 2, 4):
        spread = np.unpackbits(a, axis=1).reshape(height, -1, bits)[:, :n]
        out = (spread * (1 << np.arange(bits - 1, -1, -1, dtype=np.uint8))).sum(axis=2, dtype=np.uint8)
    else:
        return None
    return out.reshape(height, width, components)


def pixels(doc, d: dict, data: bytes, width: int, height: int, bits: int) -> tuple[bytes, int] | None:
    """8-bit gray or RGB samples of an uncompressed image; null for color spaces that need more than that."""
    mask = doc.get(d.get("ImageMask")) is True
    cs = doc.get(d.get("ColorSpace"))
    head = doc.get(cs[0]) if isinstance(cs, list) and cs else cs
    n, lookup = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "DeviceCMYK": 4, "CMYK": 4, "Indexed": 1, "I": 1}.get(str(head)), None
    if mask:
        n = 1
    if head == "ICCBased":
        n = doc.dict(cs[1]).get("N")
    if head in ("Indexed", "I") and isinstance(cs, list) and len(cs) >= 4:
        base, table = doc.get(cs[1]), doc.get(cs[3])
        raw = table.data if isinstance(table, Str) else doc.decoded(table) if isinstance(table, Stream) else b""
        size = {"DeviceGray": 1, "DeviceRGB": 3}.get(str(base) if isinstance(base, Name) else "", doc.dict(base[1]).get("N") if isinstance(base, list) and doc.get(base[0]) == "ICCBased" else None)
        if size not in (1, 3):
            return None
        lookup = np.frombuffer((raw or b"").ljust(256 * size, b"\0")[: 256 * size], np.uint8).reshape(256, size)
    if n not in (1, 3, 4):
        return None
    a = unpack(data, width, height, n, bits)
    if a is None:
        return None
    if lookup is not None:
        a = lookup[a[:, :, 0]]
    elif bits < 8:
        a = (a.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    decode = [doc.get(x) for x in doc.list(d.get("Decode"))]
    if lookup is None and len(decode) == 2 * a.shape[2] and all(decode[2 * i] == 1 and decode[2 * i + 1] == 0 for i in range(a.shape[2])):
        a = 255 - a
    if a.shape[2] == 4:
        c = a.astype(np.float32) / 255
        a = np.floor(255 * (1 - c[:, :, :3]) * (1 - c[:, :, 3:]) + 0.5).astype(np.uint8)
    return np.ascontiguousarray(a).tobytes(), a.shape[2]


def fit_inside(width: int, height: int, most_width: float, most_height: float) -> tuple[int, int]:
    """Size that keeps the aspect and fits; never larger, at least 1."""
    s = min(1.0, most_width / width, most_height / height)
    return max(1, math.floor(width * s + 0.5)), max(1, math.floor(height * s + 0.5))


def _weights(n: int, m: int) -> np.ndarray:
    """Rows: how much of each of n source cells a target cell covers, in target cells."""
    edges = np.arange(m + 1) * n / m
    cells = np.arange(n)
    return np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None) * m / n


def downscale(data: bytes, width: int, height: int, components: int, to_width: int, to_height: int) -> bytes:
    """Area-weighted mean of 8-bit samples."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, components).astype(np.float64)
    out = np.einsum("ih,jw,hwc->ijc", _weights(height, to_height), _weights(width, to_width), a, optimize=True)
    return np.clip(np.floor(out + 0.5 + 1e-9), 0, 255).astype(np.uint8).tobytes()
