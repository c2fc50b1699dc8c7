"""PDF syntax: values, a tokenizer over bytes, and serialization. No Spark here.

Values: None, bool, int, float, Name (str subclass), Str (raw bytes with their decoded form), Ref, list, dict (keys are str),
Stream. Unknown words read as null; broken syntax never raises, it ends the value.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field


class Name(str):
    __slots__ = ()


@dataclass(frozen=True, slots=True)  # there are several to a page
class Ref:
    num: int
    gen: int = 0


@dataclass(frozen=True, slots=True)
class Str:
    data: bytes


class Word(str):
    """An operator or other bare word."""


@dataclass(slots=True)
class Stream:
    dict: dict
    data: bytes = field(repr=False, default=b"")  # encoded


DEEPEST = 100
_TOKEN = re.compile(
    rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*"
    rb"(?:(?P<num>[+-]*(?:\d+\.?\d*|\.\d+)(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z))"
    rb"|/(?P<name>[^\0\t\n\f\r ()<>\[\]{}/%]*)"
    rb"|(?P<mark><<|>>|[\[\]{}>)])"
    rb"|(?P<paren>\()"
    rb"|<(?P<hex>[^>]*)(?:>|\Z)"
    rb"|(?P<word>[^\0\t\n\f\r ()<>\[\]{}/%]+))"
)
_REF = re.compile(rb"[\0\t\n\f\r ]+(\d{1,10})[\0\t\n\f\r ]+R(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z)")
_BLANK, _ENDS = rb"[\0\t\n\f\r ]", rb"(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z)"
# what most entries of dictionaries and most arrays are; anything else is read token by token
_PAIR = re.compile(rb"%b*+/([^\0\t\n\f\r ()<>\[\]{}/%%]*+)%b*+(?:/([^\0\t\n\f\r ()<>\[\]{}/%%]*+)|(\d{1,10})%b++(\d{1,10})%b++R%b|(\d{1,18})%b(?!%b++\d{1,10}%b++R%b)|\(([^()\\\r]*+)\))" % (_BLANK, _BLANK, _BLANK, _BLANK, _ENDS, _ENDS, _BLANK, _BLANK, _ENDS))
_REFS = re.compile(rb"(?:%b*+\d{1,10}%b++\d{1,10}%b++R%b)++%b*+\]" % (_BLANK, _BLANK, _BLANK, _ENDS, _BLANK))
_NUMBERS = re.compile(rb"((?:%b*+-?\d++(?:\.\d*+)?%b)++)%b*+\]" % (_BLANK, _ENDS, _BLANK))
_DIGITS = re.compile(rb"\d+")
_HEXNAME = re.compile(rb"#([0-9A-Fa-f]{2})")
_LITERAL = re.compile(rb"[()\\]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
END = object()


@functools.lru_cache(1 << 13)
def decode_name(raw: bytes) -> Name:
    if b"#" in raw:
        raw = _HEXNAME.sub(lambda m: bytes([int(m[1], 16)]), raw)
    return Name(raw.decode("latin-1"))


@functools.lru_cache(1 << 13)
def _key(raw: bytes) -> str:
    return str(decode_name(raw))


def hex_bytes(raw: bytes) -> bytes:
    try:
        return bytes.fromhex(raw.decode("ascii"))
    except ValueError:  # blanks within a pair, odd marks, half a pair
        pass
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def unescape(raw: bytes) -> bytes:
    """Body of a literal string to its bytes."""
    if b"\\" not in raw and b"\r" not in raw:
        return raw
    out = bytearray()
    i, n = 0, len(raw)
    while i < n:
        c = raw[i : i + 1]
        i += 1
        if c == b"\r":
            out += b"\n"
            i += raw[i : i + 1] == b"\n"
        elif c != b"\\":
            out += c
        else:
            e = raw[i : i + 1]
            i += 1
            if e in _ESCAPES:
                out += _ESCAPES[e]
            elif e and e in b"01234567":
                digits = e
                while len(digits) < 3 and raw[i : i + 1] and raw[i : i + 1] in b"01234567":
                    digits += raw[i : i + 1]
                    i += 1
                out.append(int(digits, 8) & 255)
            elif e == b"\r":
                i += raw[i : i + 1] == b"\n"
            elif e != b"\n":
                out += e
    return bytes(out)


class Reader:
    """Reads values and words from bytes, at ``pos``."""

    def __init__(self, data: bytes, pos: int = 0, end: int | None = None):
        self.data, self.pos, self.end = data, pos, len(data) if end is None else end

    def _literal(self) -> Str:
        depth, i = 1, self.pos
        while depth:
            m = _LITERAL.search(self.data, i, self.end)
            if not m:
                i = self.end + 1
                break
            i = m.end()
            if m[0] == b"(":
                depth += 1
            elif m[0] == b")":
                depth -= 1
            else:
                i += 1
        body = self.data[self.pos : i - 1]
        self.pos = min(i, self.end)
        return Str(unescape(body))

    def next(self, depth: int = 0):
        """The next value or Word; END at the end; closing marks come as Words."""
        m = _TOKEN.match(self.data, self.pos, self.end)
        if not m:
            self.pos = self.end
            return END
        self.pos = m.end()
        kind = m.lastgroup
        if kind == "num":
            raw = m["num"]
            if raw.isdigit():
                r = _REF.match(self.data, self.pos, self.end)
                if r:
                    self.pos = r.end()
                    return Ref(int(raw), int(r[1]))
                return int(raw)
            if b"." in raw:
                sign = -1 if raw.startswith(b"-") else 1
                return sign * float(raw.lstrip(b"+-"))
            sign = -1 if raw.startswith(b"-") else 1
            value = sign * int(raw.lstrip(b"+-"))
            if raw[:1].isdigit():
                r = _REF.match(self.data, self.pos, self.end)
                if r:
                    self.pos = r.end()
                    return Ref(value, int(r[1]))
            return value
        if kind == "name":
            return decode_name(m["name"])
        if kind == "paren":
            return self._literal()
        if kind == "hex":
            return Str(hex_bytes(m["hex"]))
        if kind == "word":
            w = m["word"].decode("latin-1")
            return {"true": True, "false": False, "null": None}.get(w, Word(w)) if w in ("true", "false", "null") else Word(w)
        mark = m["mark"]
        if depth > DEEPEST:
            return None
        if mark == b"[":
            if m := _REFS.match(self.data, self.pos, self.end):
                self.pos = m.end()
                numbers = list(map(int, _DIGITS.findall(m[0])))
                return list(map(Ref, numbers[::2], numbers[1::2]))
            if m := _NUMBERS.match(self.data, self.pos, self.end):
                self.pos = m.end()
                return [float(x) if b"." in x else int(x) for x in m[1].replace(b"\0", b" ").split()]
            out = []
            while True:
                before = self.pos
                v = self.next(depth + 1)
                if v is END or isinstance(v, Word):
                    if v is not END and v != "]":
                        if v in ("endobj", "endstream", "stream", ">>"):
                            self.pos = before
                            break
                        out.append(None)
                        continue
                    break
                out.append(v)
            return out
        if mark == b"<<":
            out: dict = {}
            while True:
                before = self.pos
                if m := _PAIR.match(self.data, before, self.end):
                    self.pos = m.end()
                    k = _key(m[1])
                    if k not in out:
                        at = m.lastindex
                        out[k] = decode_name(m[2]) if at == 2 else Ref(int(m[3]), int(m[4])) if at == 4 else int(m[5]) if at == 5 else Str(m[6])
                    continue
                k = self.next(depth + 1)
                if k is END or (isinstance(k, Word) and k in (">>", "endobj", "stream", "endstream")):
                    if k is not END and k != ">>":
                        self.pos = before
                    break
                if not isinstance(k, Name):
                    continue
                before = self.pos
                v = self.next(depth + 1)
                if v is END:
                    break
                if isinstance(v, Word):
                    if v in (">>", "endobj", "stream"):
                        self.pos = before
                    v = None
                out.setdefault(str(k), v)
            return out
        return Word(mark.decode())

    def value(self):
        """A value; a word reads as null."""
        v = self.next()
        return None if v is END or isinstance(v, Word) else v


@functools.lru_cache(1 << 13)
def encode_name(name: str) -> bytes:
    raw = name.encode("latin-1", "replace")
    return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in raw)


def number(x: float) -> bytes:
    if isinstance(x, int) or float(x).is_integer() and abs(x) < 1e15:
        return b"%d" % int(x)
    return (f"{x:.6f}".rstrip("0").rstrip(".") or "0").encode()


def serialize(v) -> bytes:
    kind = type(v)
    if kind is dict:
        return b"<<" + b" ".join([encode_name(k) + b" " + serialize(x) for k, x in v.items()]) + b">>"
    if kind is Ref:
        return b"%d %d R" % (v.num, v.gen)
    if kind is Name:
        return encode_name(v)
    if kind is int:
        return b"%d" % v
    if v is None:
        return b"null"
    if v is True or v is False:
        return b"true" if v else b"false"
    if isinstance(v, (int, float)):
        return number(v)
    if isinstance(v, Name):
        return encode_name(v)
    if isinstance(v, Ref):
        return b"%d %d R" % (v.num, v.gen)
    if isinstance(v, Str):
        if v.data.isascii() and v.data.decode().isprintable():
            return b"(" + v.data.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
        return b"<" + v.data.hex().encode() + b">"
    if isinstance(v, list):
        return b"[" + b" ".join(map(serialize, v)) + b"]"
    if isinstance(v, dict):
        return b"<<" + b" ".join(encode_name(k) + b" " + serialize(x) for k, x in v.items()) + b">>"
    if isinstance(v, Stream):
        d = {k: x for k, x in v.dict.items() if k != "Length"} | {"Length": len(v.data)}
        return serialize(d) + b"\nstream\n" + v.data + b"\nendstream"
    if isinstance(v, str):
        return serialize(encode_text(v))
    if isinstance(v, bytes):  # serialized already
        return bytes(v)
    raise TypeError(type(v).__name__)


# fixed values: PDFDocEncoding where it differs from Latin-1
PDFDOC = dict(zip(range(0x18, 0x20), "˘ˇˆ˙˝˛˚˜")) | dict(zip(range(0x80, 0xA1), "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž�€"))


def decode_text(data: bytes) -> str:
    """A text string: UTF-16 or UTF-8 by its mark, else PDFDocEncoding."""
    if data[:2] == b"\xfe\xff":
        return re.sub("\x1b[^\x1b]*\x1b", "", data[2:].decode("utf-16-be", "replace"))
    if data[:2] == b"\xff\xfe":
        return data[2:].decode("utf-16-le", "replace")
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8", "replace")
    return data.decode("latin-1").translate(PDFDOC)


def encode_text(s: str) -> Str:
    return Str(s.encode() if s.isascii() and s.isprintable() else b"\xfe\xff" + s.encode("utf-16-be", "surrogatepass"))


def text_of(v) -> str | None:
    return decode_text(v.data) if isinstance(v, Str) else str(v) if isinstance(v, Name) else None


def uri_of(data: bytes) -> str:
    if data[:2] == b"\xfe\xff" or data[:3] == b"\xef\xbb\xbf":
        return decode_text(data)
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")
