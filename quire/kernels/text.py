"""Page text in drawing order: fonts to Unicode, and an interpreter that tells words and lines apart by geometry."""

from __future__ import annotations

import codecs
import functools
import re
import struct
import unicodedata

from quire.kernels.document import Document
from quire.kernels.syntax import END, Name, Reader, Ref, Str, Stream, Word, decode_text

# fixed values: glyph names of the Latin encodings that are not single letters
_NAMES = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿", "multiply": "×", "divide": "÷",
    "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "germandbls": "ß", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "Lslash": "Ł", "lslash": "ł", "dotlessi": "ı", "florin": "ƒ", "Euro": "€", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›", "endash": "–", "emdash": "—", "trademark": "™", "fraction": "⁄", "minus": "−", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "circumflex": "ˆ", "tilde": "˜", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "hungarumlaut": "˝", "ogonek": "˛", "nbspace": " ", "sfthyphen": "-",
}
# fixed values: glyph names of accents, with Unicode's combining marks in the order of their code points
_ACCENTS = {"grave": "\u0300", "acute": "\u0301", "circumflex": "\u0302", "tilde": "\u0303", "macron": "\u0304", "breve": "\u0306", "dotaccent": "\u0307", "dieresis": "\u0308", "ring": "\u030a", "hungarumlaut": "\u030b", "caron": "\u030c", "cedilla": "\u0327", "ogonek": "\u0328"}
_GREEK = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi Omicron Pi Rho Sigma Tau Upsilon Phi Chi Psi Omega".split()


def glyph_text(name: str) -> str | None:
    """Text of a glyph by its name."""
    base = name.split(".", 1)[0]
    if not base:
        return None
    if "_" in base and base not in _NAMES:
        parts = [glyph_text(p) for p in base.split("_")]
        return "".join(parts) if all(parts) else None
    if base in _NAMES:
        return _NAMES[base]
    if len(base) == 1:
        return base
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", base):
        return "".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4))
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", base):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else None
    for accent, mark in _ACCENTS.items():
        if base.endswith(accent) and len(base) == len(accent) + 1:
            return unicodedata.normalize("NFC", base[0] + mark)
    if base.capitalize() in _GREEK:
        i = _GREEK.index(base.capitalize())
        code = 0x391 + i + (i >= 17)
        return chr(code if base[0].isupper() else code + 32)
    if m := re.fullmatch(r"afii100(\d\d)", base):
        n = int(m[1])
        return "Ё" if n == 23 else "ё" if n == 71 else chr(0x410 + n - 17 - (n > 23)) if 17 <= n <= 49 else chr(0x430 + n - 65 - (n > 71)) if 65 <= n <= 97 else None
    return None


# fixed values: the format's standard encoding where it differs from ASCII
def _standard() -> list[str | None]:
    t: list[str | None] = [chr(i) if 32 <= i < 127 else None for i in range(256)]
    t[0x27], t[0x60] = "’", "‘"
    for start, chars in ((0xA1, "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ"), (0xB1, "–†‡·"), (0xB6, "¶•‚„”»…‰"), (0xBF, "¿"), (0xC1, "`´ˆ˜¯˘˙¨"), (0xCA, "˚¸"), (0xCD, "˝˛ˇ—"), (0xE1, "Æ"), (0xE3, "ª"), (0xE8, "ŁØŒº"), (0xF1, "æ"), (0xF5, "ı"), (0xF8, "łøœß")):
        for i, c in enumerate(chars):
            t[start + i] = c
    return t


ENCODINGS: dict[str, list[str | None]] = {
    "StandardEncoding": _standard(),
    "WinAnsiEncoding": [bytes([i]).decode("cp1252", "ignore") or "•" if i >= 32 else None for i in range(256)],
    "MacRomanEncoding": [bytes([i]).decode("mac_roman") if i >= 32 else None for i in range(256)],
}
# fixed values: Helvetica's widths for codes 32 to 126
_HELVETICA = "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
_WIDTHS = dict(enumerate(map(int, _HELVETICA.split()), 32))
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_DROP = re.compile("[\u0000-\u0008\u000b\u000e-\u001f\u007f-\u009f​-‏⁠﻿-­]")


@functools.lru_cache(1 << 14)
def clean_code(s: str) -> str:
    """``clean`` for what a single code stands for, of which there are few."""
    return clean(s)


def clean(s: str) -> str:
    s = re.sub(r"\s", " ", s)
    s = _DROP.sub("", s)
    return s if s.isascii() else "".join(_LIGATURES.get(c, c) for c in s)


class CMap:
    """Code to text or to character number: single codes and ranges, which are never expanded."""

    def __init__(self, data: bytes = b""):
        self.single: dict[tuple[int, int], object] = {}
        self.ranges: list[tuple[int, int, int, object]] = []
        self.spaces: list[tuple[int, int, int]] = []
        r, stack = Reader(data), []
        while (t := r.next()) is not END:
            if not isinstance(t, Word):
                stack.append(t)
                continue
            if t == "endcodespacerange":
                for a, b in zip(stack[::2], stack[1::2]):
                    if isinstance(a, Str) and isinstance(b, Str):
                        self.spaces.append((len(a.data), int.from_bytes(a.data, "big"), int.from_bytes(b.data, "big")))
            elif t in ("endbfchar", "endcidchar"):
                for a, b in zip(stack[::2], stack[1::2]):
                    if isinstance(a, Str):
                        self.single[len(a.data), int.from_bytes(a.data, "big")] = self._dest(b)
            elif t in ("endbfrange", "endcidrange"):
                for a, b, c in zip(stack[::3], stack[1::3], stack[2::3]):
                    if isinstance(a, Str) and isinstance(b, Str):
                        low, high = int.from_bytes(a.data, "big"), int.from_bytes(b.data, "big")
                        if isinstance(c, list):
                            for i, x in enumerate(c[: max(0, high - low + 1)]):
                                self.single[len(a.data), low + i] = self._dest(x)
                        else:
                            self.ranges.append((len(a.data), low, high, self._dest(c)))
            stack = []

    @staticmethod
    def _dest(v):
        if isinstance(v, Str):
            return v.data.decode("utf-16-be", "replace") if len(v.data) > 1 else v.data.decode("latin-1")
        return glyph_text(v) if isinstance(v, Name) else v if isinstance(v, int) else None

    def lookup(self, size: int, code: int):
        if (size, code) in self.single:
            return self.single[size, code]
        for n, low, high, dest in self.ranges:
            if n == size and low <= code <= high and dest is not None:
                if isinstance(dest, int):
                    return dest + code - low
                last = ord(dest[-1]) + code - low if dest else 0
                return dest[:-1] + chr(last) if dest and last < 0x110000 else dest
        return None

    def size(self, data: bytes, at: int, default: int) -> int:
        for n, low, high in sorted(self.spaces):
            part = data[at : at + n]
            if len(part) == n and all(a <= c <= b for a, c, b in zip(low.to_bytes(n, "big"), part, high.to_bytes(n, "big"))):
                return n
        return self.spaces and min(n for n, _, _ in self.spaces) or default


class Font:
    """codes(data) gives (code, size, text, width in text space, is a one-byte blank)."""

    def __init__(self, doc: Document, v):
        d = doc.dict(v)
        self.doc, self.dict = doc, d
        self.vertical = False
        self.known: dict[tuple[int, int], tuple[str, float]] = {}
        self._tables = None
        self.pairs: tuple[dict[int, str], dict[int, float], set[int]] = ({}, {}, set())  # two-byte codes: texts, widths, those not for a run
        self.composite = doc.get(d.get("Subtype")) == "Type0"
        u = doc.get(d.get("ToUnicode"))
        self.unicode = CMap(doc.decoded(u) or b"") if isinstance(u, Stream) else None
        self.identity = isinstance(u, Name) and u.startswith("Identity")  # codes are UTF-16 units
        self.scale = 0.001
        if self.composite:
            self._composite()
        else:
            self._simple()

    def _simple(self) -> None:
        doc, d = self.doc, self.dict
        e = doc.get(d.get("Encoding"))
        base = doc.get(e.get("BaseEncoding")) if isinstance(e, dict) else e
        table = list(ENCODINGS.get(str(base), ENCODINGS["StandardEncoding"]))
        told = self.identity or self.unicode and (self.unicode.single or self.unicode.ranges)
        if str(base) not in ENCODINGS and not told and doc.get(d.get("Subtype")) != "TrueType":
            table = self._built_in() or table
        if isinstance(e, dict):
            code = 0
            for x in doc.list(e.get("Differences")):
                x = doc.get(x)
                if isinstance(x, int):
                    code = x
                elif isinstance(x, Name):
                    if 0 <= code < 256:
                        m = re.fullmatch(r"(?:g|cid|c|G)(\d+)", x)
                        table[code] = glyph_text(x) or (chr(int(m[1])) if m and 32 <= int(m[1]) < 0x3000 else None)
                    code += 1
        self.table = table
        first = doc.get(d.get("FirstChar"))
        widths = [doc.get(w) for w in doc.list(d.get("Widths"))]
        self.widths = {first + i: w for i, w in enumerate(widths) if isinstance(w, (int, float))} if isinstance(first, int) else {}
        matrix = [doc.get(x) for x in doc.list(d.get("FontMatrix"))]
        if doc.get(d.get("Subtype")) == "Type3" and len(matrix) == 6 and isinstance(matrix[0], (int, float)) and matrix[0]:
            self.scale = abs(matrix[0])
        missing = doc.get(doc.dict(d.get("FontDescriptor")).get("MissingWidth"))
        self.missing = missing if isinstance(missing, (int, float)) else 0
        name = str(doc.get(d.get("BaseFont")) or "")
        self.fixed = 600 if "Courier" in name else None

    def _built_in(self) -> list[str | None] | None:
        """The encoding in the readable part of an embedded Type1 program."""
        doc, d = self.doc, self.dict
        program = doc.get(doc.dict(d.get("FontDescriptor")).get("FontFile"))
        if not isinstance(program, Stream) or re.search("symbol|dingbat|wingding|webding|marlett", str(doc.get(d.get("BaseFont")) or "").lower()):
            return None
        length = doc.get(program.dict.get("Length1"))
        data = (doc.decoded(program) or b"")[: min(length if isinstance(length, int) and length > 0 else 1 << 16, 1 << 17)]
        names = {int(m[1]): m[2].decode("latin-1") for m in re.finditer(rb"dup\s+(\d+)\s*/([^\s/\[\]{}()<>%]+)\s+put", data) if len(m[1]) < 4 and int(m[1]) < 256}
        return [glyph_text(names[c]) if c in names else None for c in range(256)] if names else None

    def _composite(self) -> None:
        doc, d = self.doc, self.dict
        e = doc.get(d.get("Encoding"))
        self.encoding = CMap(doc.decoded(e) or b"") if isinstance(e, Stream) else None
        name = str(e) if isinstance(e, Name) else ""
        self.vertical = name.endswith("-V")
        self.codec = next((c for k, c in (("RKSJ", "cp932"), ("UTF16", "utf-16-be"), ("UCS2", "utf-16-be"), ("GBK", "gbk"), ("GB-", "gb2312"), ("B5", "big5"), ("KSC", "cp949"), ("EUC", "euc_jp")) if k in name), None)
        child = doc.dict((doc.list(d.get("DescendantFonts")) or [None])[0])
        dw = doc.get(child.get("DW"))
        self.missing = dw if isinstance(dw, (int, float)) else 1000
        self.widths = {}
        w, i = [doc.get(x) for x in doc.list(child.get("W"))], 0
        self.spans: list[tuple[int, int, float]] = []
        while i < len(w):
            if i + 1 < len(w) and isinstance(w[i + 1], list):
                for j, x in enumerate(w[i + 1]):
                    self.widths[w[i] + j] = doc.get(x)
                i += 2
            elif i + 2 < len(w):
                self.spans.append((w[i], w[i + 1], w[i + 2]))
                i += 3
            else:
                break

    def _code(self, code: int, size: int) -> tuple[str, float]:
        text = self.unicode.lookup(size, code) if self.unicode else None
        if self.identity:
            text = "" if 0xD800 <= code & 0xFFFF < 0xE000 else chr(code & 0xFFFF)
        if text is None and self.unicode and not self.composite:
            text = self.unicode.lookup(2, code)
        if not isinstance(text, str):
            text = None
        if not self.composite:
            if text is None:
                text = self.table[code] if code < 256 else None
            width = self.widths.get(code)
            if width is None:
                width = self.fixed if self.fixed is not None else self.missing if self.widths else _WIDTHS.get(ord(text[0]) if text else 0, 556)
            return clean_code(text or ""), width * self.scale
        cid = self.encoding.lookup(size, code) if self.encoding else code
        if text is None and self.codec:
            text = code.to_bytes(size, "big").decode(self.codec, "ignore")
        width = self.widths.get(cid) if isinstance(cid, int) else None
        if width is None and isinstance(cid, int):
            width = next((w for a, b, w in self.spans if a <= cid <= b), None)
        return clean_code(text or ""), (width if isinstance(width, (int, float)) else self.missing) * 0.001

    def tables(self):
        """Of a simple font: see ``_simple_run``."""
        if self._tables is None:
            plain = not (self.unicode or self.identity or self.widths)  # then fonts of one encoding are the same
            self._tables = _builtin_run(tuple(self.table), self.fixed, self.scale) if plain else _simple_run([self._code(c, 1) for c in range(256)])
        return self._tables

    def run(self, data: bytes):
        """Glyphs that all move on, without spacing of their own: (first text, the others' text, first width, last width, sum
        of widths, first code, last code); None where they have to be looked at one by one."""
        if not self.composite:
            texts_, widths, wide, mapping, _ = self.tables()
            if len(data) < 3 or data.translate(None, wide):
                return None
            rest = codecs.charmap_decode(data[1:], "ignore", mapping)[0] if mapping is not None else "".join(map(texts_.__getitem__, data[1:]))
            return texts_[data[0]], rest, widths[data[0]], widths[data[-1]], sum(map(widths.__getitem__, data)), data[0], data[-1]
        if self.vertical or self.encoding or self.codec not in (None, "utf-16-be") or len(data) < 6 or len(data) % 2:
            return None
        codes = struct.unpack(f">{len(data) // 2}H", data)
        texts_, widths, odd = self.pairs
        for code in set(codes).difference(texts_):
            text, width = texts_[code], widths[code] = self._code(code, 2)
            if width <= 0.1 or len(text) > 1 and " " in text or self.identity and 0xD800 <= code < 0xE000:
                odd.add(code)
        if odd and not odd.isdisjoint(codes):
            return None
        return texts_[codes[0]], "".join(map(texts_.__getitem__, codes[1:])), widths[codes[0]], widths[codes[-1]], sum(map(widths.__getitem__, codes)), codes[0], codes[-1]

    def codes(self, data: bytes):
        at = 0
        while at < len(data):
            if not self.composite:
                size = 1
            elif self.encoding:
                size = self.encoding.size(data, at, 2)
            elif self.codec and self.codec != "utf-16-be":
                size = 1 if data[at] < 0x80 or self.codec == "cp932" and 0xA0 <= data[at] <= 0xDF else 2
            else:
                size = 2
            code = int.from_bytes(data[at : at + size], "big")
            at += size
            found = self.known.get((code, size))
            if found is None:
                found = self.known[code, size] = self._code(code, size)
            if self.identity and size == 2 and 0xD800 <= code < 0xDC00:  # half of a character: the next code is the other
                found = clean(data[at - 2 : at + 2].decode("utf-16-be", "ignore")), found[1]
            yield code, *found, size == 1 and code == 32


def _simple_run(found: list[tuple[str, float]]):
    """Texts and widths of all codes, the codes that move on, the texts as a decoding table if each is a character or none, and
    the least width of those that move on."""
    texts_, widths = [t for t, _ in found], [w for _, w in found]
    mapping = "".join(t or "\ufffe" for t in texts_) if all(len(t) < 2 and t != "\ufffe" for t in texts_) else None
    wide = bytes(c for c in range(256) if widths[c] > 0.1)
    return texts_, widths, wide, mapping, min((widths[c] for c in wide), default=0.0)


@functools.lru_cache(256)
def _builtin_run(table: tuple, fixed: float | None, scale: float):
    return _simple_run([(clean_code(t or ""), (fixed if fixed is not None else _WIDTHS.get(ord(t[0]) if t else 0, 556)) * scale) for t in table])


def multiply(a: tuple, b: tuple) -> tuple:
    """Matrix a applied first, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
_BETWEEN = rb"\0\t\n\f\r "
_ARRAY = re.compile(rb"[%b]*+\[((?:[%b]*+(?:\([^()\\\r]*+\)|[+-]?(?:\d++\.?\d*+|\.\d++)(?=[%b()<>\[\]{}/%%])))*+[%b]*+)\][%b]*+TJ(?=[%b()<>\[\]{}/%%]|\Z)" % ((_BETWEEN,) * 6))
_ITEM = re.compile(rb"\(([^()]*)\)|([-+.\d]+)")
TOKENS, CHARACTERS, FORMS = 10_000_000, 4_000_000, 12


class TextPage:
    """Glyphs in drawing order to text: geometry asks for blanks and line feeds between them."""

    def __init__(self, doc: Document, fonts: dict):
        self.doc, self.fonts = doc, fonts
        self.out: list[str] = []
        self.size = self.tokens = 0
        self.want = ""  # separator asked for: "", blank or line feed
        self.last = None  # (x, y) start, (x, y) end, direction, em, glyph
        self.frame_of = self.frame_is = None
        self.actual: list = []  # open marked content: [replacement or None, shown]

    def separator(self, s: str) -> None:
        if self.out and (s == "\n" or not self.want):
            self.want = s

    def emit(self, s: str) -> None:
        if self.want and self.out:
            self.out.append(self.want)
        self.want = ""
        self.out.append(s)
        self.size += len(s)

    def frame(self, m: tuple, em: float, vertical: bool) -> tuple:
        """Direction, its length, and the em along and across it: the same for the glyphs of a run."""
        key = (*m[:4], em, vertical)
        if key != self.frame_of:
            dx, dy = (-m[2], -m[3]) if vertical else (m[0], m[1])
            norm = (dx * dx + dy * dy) ** 0.5 or 1.0
            perp = abs(em) * ((m[0] ** 2 + m[1] ** 2) ** 0.5 if vertical else (m[2] ** 2 + m[3] ** 2) ** 0.5) or 1.0
            self.frame_of, self.frame_is = key, (norm, dx / norm, dy / norm, abs(em) * norm or 1.0, perp)
        return self.frame_is

    def glyph(self, text: str, m: tuple, advance: float, em: float, vertical: bool, code) -> None:
        x, y = m[4], m[5]
        norm, ux, uy, along, perp = self.frame(m, em, vertical)
        end = (x + ux * advance * norm, y + uy * advance * norm)
        if self.last:
            (sx, sy), (ex, ey), (vx, vy), size, glyph = self.last
            if glyph == code and ((x - sx) ** 2 + (y - sy) ** 2) ** 0.5 < 0.1 * along and ((x - ex) ** 2 + (y - ey) ** 2) ** 0.5 > 1e-6 * along:
                return  # drawn twice for boldness
            gx, gy = x - ex, y - ey
            if ux * vx + uy * vy < 0.9 or abs(gx * -uy + gy * ux) > 0.8 * perp:
                self.separator("\n")
            elif abs(gx * ux + gy * uy) > 0.15 * min(along, size):
                self.separator(" ")
        self.last = ((x, y), end, (ux, uy), along, code)
        marked = next((a for a in self.actual if a[0] is not None), None) if self.actual else None
        if marked is not None:
            if not marked[1]:
                marked[1] = True
                self.plain(marked[0])
            return
        self.plain(text)

    def inside(self, text: str) -> None:
        """Text of glyphs that follow without a gap."""
        if not text:
            return
        if text[0] == " ":
            self.separator(" ")
        body = text.strip(" ")
        if body:
            if "  " in body:
                body = " ".join(filter(None, body.split(" ")))
            self.emit(body)
            self.size -= body.count(" ")
            if text[-1] == " ":
                self.separator(" ")

    def remember(self, m: tuple, advance: float, em: float, code) -> None:
        norm, ux, uy, along, _ = self.frame(m, em, False)
        self.last = ((m[4], m[5]), (m[4] + ux * advance * norm, m[5] + uy * advance * norm), (ux, uy), along, code)

    def plain(self, text: str) -> None:
        if not text:
            return
        if text.isspace():
            self.separator(" ")
        elif text[0] == " " or text[-1] == " ":
            if text[0] == " ":
                self.separator(" ")
            self.emit(text.strip())
            if text[-1] == " ":
                self.separator(" ")
        else:
            self.emit(text)

    def run(self, data: bytes, resources, ctm: tuple = UNIT, depth: int = 0, active: frozenset = frozenset()) -> None:
        doc = self.doc
        res = doc.dict(resources)
        fonts = doc.dict(res.get("Font"))
        r, args = Reader(data), []
        state = {"ctm": ctm, "font": None, "size": 0.0, "tc": 0.0, "tw": 0.0, "tz": 1.0, "tl": 0.0, "ts": 0.0}
        stack: list[dict] = []
        tm = line = UNIT
        floor = len(self.actual)

        def nums(n: int) -> list[float]:
            v = [float(x) for x in args if isinstance(x, (int, float)) and not isinstance(x, bool)][-n:]
            return [0.0] * (n - len(v)) + v

        def show(s: bytes) -> None:
            nonlocal tm
            f = state["font"]
            if f is None:
                return
            size, tz, ts, c = state["size"], state["tz"], state["ts"], state["ctm"]
            # places as multiply() gives them for (tz, 0, 0, 1, 0, ts), tm and ctm
            t0, t1, t2, t3, e, y = tm
            m0, m1, m2, m3 = (t0, t1, t2, t3) if c == UNIT else multiply(tm, c)[:4]
            turned = (tz * m0, tz * m1, m2, m3)
            if not state["tc"] and (not state["tw"] or f.composite) and size > 0 and tz > 0 and not self.actual and (found := f.run(s)):
                # glyphs follow each other: only the first can ask for a separator by its place
                text, rest, first, last, total, code, end = found
                self.glyph(text, (*turned, ts * m2 + (e * c[0] + y * c[2] + c[4]), ts * m3 + (e * c[1] + y * c[3] + c[5])), first * size, size, False, (id(f), code))
                self.inside(rest)
                total *= size * tz
                before = total - last * size * tz
                tm = (t0, t1, t2, t3, total * t0 + e, total * t1 + y)
                e, y = before * t0 + e, before * t1 + y
                self.remember((*turned, ts * m2 + (e * c[0] + y * c[2] + c[4]), ts * m3 + (e * c[1] + y * c[3] + c[5])), last * size, size, (id(f), end))
                return
            for code, text, width, blank in f.codes(s):
                step = width * size + state["tc"] + (state["tw"] if blank else 0.0)
                self.glyph(text, (*turned, ts * m2 + (e * c[0] + y * c[2] + c[4]), ts * m3 + (e * c[1] + y * c[3] + c[5])), width * size, size, f.vertical, (id(f), code))
                if f.vertical:
                    e, y = e - step * t2, y - step * t3
                else:
                    e, y = step * tz * t0 + e, step * tz * t1 + y
            tm = (t0, t1, t2, t3, e, y)

        def line_of(items: list[tuple[bytes, bytes]]) -> bool:
            """An array whose glyphs all move on, drawn in one go; False where strings have to be shown one by one."""
            nonlocal tm
            f, size, tz, c = state["font"], state["size"], state["tz"], state["ctm"]
            if f is None or f.composite or len(items) < 3 or state["tc"] or state["tw"] or state["ts"] or size <= 0 or tz <= 0 or self.actual:
                return False
            strings = [string for string, _ in items if string]
            texts_, widths, wide, mapping, least = f.tables()
            if mapping is None or not strings or b"".join(strings).translate(None, wide):
                return False
            scale, parts, gap, apart, total = size * tz, [], 0.0, {}, 0.0
            t0, t1, t2, t3, e, y = tm
            for string, number in items:
                if number:
                    d = -float(number) / 1000 * size * tz
                    gap += d
                    e, y = d * t0 + e, d * t1 + y
                    continue
                if not string:
                    continue
                if parts and gap:
                    blank = apart.get(gap)
                    if blank is None:
                        far = gap / scale
                        # close to the bounds rounding would tell, and a step back could draw a glyph twice
                        if abs(abs(far) - 0.15) < 1e-6 or far < 0.1 + 1e-6 - least:
                            return False
                        blank = apart[gap] = abs(far) > 0.15
                    if blank:
                        parts.append(" ")
                gap = 0.0
                if not parts:
                    began = e, y
                last = e, y
                parts.append(codecs.charmap_decode(string, "ignore", mapping)[0])
                total = sum(map(widths.__getitem__, string)) * scale
                e, y = total * t0 + e, total * t1 + y
            head, tail = strings[0][0], strings[-1][-1]
            m0, m1, m2, m3 = (t0, t1, t2, t3) if c == UNIT else multiply(tm, c)[:4]
            turned = (tz * m0, tz * m1, m2, m3)

            def at(e: float, y: float) -> tuple:
                return (*turned, e * c[0] + y * c[2] + c[4], e * c[1] + y * c[3] + c[5])

            tm = (t0, t1, t2, t3, e, y)
            self.glyph(texts_[head], at(*began), widths[head] * size, size, False, (id(f), head))
            self.inside("".join(parts)[len(texts_[head]) :])
            own = widths[tail] * scale
            before = len(strings[-1]) > 1 and sum(map(widths.__getitem__, strings[-1])) * scale - own or 0.0
            self.remember(at(before * t0 + last[0], before * t1 + last[1]), widths[tail] * size, size, (id(f), tail))
            return True

        def move(x: float, y: float) -> None:
            nonlocal tm, line
            tm = line = multiply((1, 0, 0, 1, x, y), line)

        def back(x: float) -> None:
            """Between strings of an array, in thousandths of the font size."""
            nonlocal tm
            d, (t0, t1, t2, t3, e, y) = -x / 1000 * state["size"], tm
            if state["font"] is not None and state["font"].vertical:
                tm = (t0, t1, t2, t3, d * t2 + e, d * t3 + y)
            else:
                d *= state["tz"]
                tm = (t0, t1, t2, t3, d * t0 + e, d * t1 + y)

        while self.size < CHARACTERS and self.tokens < TOKENS:
            if (m := _ARRAY.match(data, r.pos)) is not None:  # strings without escapes and numbers
                r.pos = m.end()
                self.tokens += 2
                items = _ITEM.findall(m[1])
                for string, number in () if line_of(items) else items:
                    if number:
                        back(float(number))
                    else:
                        show(string)
                args = []
                continue
            t = r.next()
            self.tokens += 1
            if t is END:
                break
            if not isinstance(t, Word):
                args.append(t)
                continue
            if t == "Tj":
                if args and isinstance(args[-1], Str):
                    show(args[-1].data)
            elif t == "TJ":
                for x in args[-1] if args and isinstance(args[-1], list) else []:
                    if isinstance(x, Str):
                        show(x.data)
                    elif isinstance(x, (int, float)):
                        back(x)
            elif t in ("'", '"'):
                if t == '"' and len(args) >= 3:
                    state["tw"], state["tc"] = (float(x) if isinstance(x, (int, float)) else 0.0 for x in args[-3:-1])
                move(0, -state["tl"])
                if args and isinstance(args[-1], Str):
                    show(args[-1].data)
            elif t == "Td":
                move(*nums(2))
            elif t == "TD":
                x, y = nums(2)
                state["tl"] = -y
                move(x, y)
            elif t == "T*":
                move(0, -state["tl"])
            elif t == "Tm":
                tm = line = tuple(nums(6))
            elif t == "BT":
                tm = line = UNIT
            elif t == "Tf":
                name = next((a for a in args if isinstance(a, Name)), None)
                v = fonts.get(str(name))
                key = v.num if isinstance(v, Ref) else id(v)
                if key not in self.fonts:
                    self.fonts[key] = (Font(doc, v), v)
                state["font"], state["size"] = self.fonts[key][0], nums(1)[0]
            elif t in ("Tc", "Tw", "TL", "Ts"):
                state[t.lower()] = nums(1)[0]
            elif t == "Tz":
                state["tz"] = nums(1)[0] / 100
            elif t == "cm":
                state["ctm"] = multiply(tuple(nums(6)), state["ctm"])
            elif t == "q":
                if len(stack) < 1024:
                    stack.append(dict(state))
            elif t == "Q":
                if stack:
                    state = stack.pop()
            elif t in ("BDC", "BMC"):
                p = args[-1] if t == "BDC" and args else None
                if isinstance(p, Name):
                    p = doc.get(doc.dict(res.get("Properties")).get(str(p)))
                v = doc.get(p.get("ActualText")) if isinstance(p, dict) else None
                self.actual.append([clean(decode_text(v.data)) if isinstance(v, Str) else None, False])
            elif t == "EMC":
                if len(self.actual) > floor:
                    text, shown = self.actual.pop()
                    if text and not shown and not any(a[0] is not None for a in self.actual):
                        self.plain(text)
            elif t == "Do":
                name = next((a for a in args if isinstance(a, Name)), None)
                v = doc.dict(res.get("XObject")).get(str(name))
                s = doc.get(v)
                key = v.num if isinstance(v, Ref) else id(s)
                if isinstance(s, Stream) and s.dict.get("Subtype") == "Form" and depth < FORMS and key not in active:
                    m = [doc.get(x) for x in doc.list(s.dict.get("Matrix"))]
                    m = tuple(map(float, m)) if len(m) == 6 and all(isinstance(x, (int, float)) for x in m) else UNIT
                    self.run(doc.decoded(s) or b"", s.dict.get("Resources", resources), multiply(m, state["ctm"]), depth + 1, active | {key})
            elif t == "BI":
                self._skip_image(r)
            args = []
        del self.actual[floor:]

    @staticmethod
    def _skip_image(r: Reader) -> None:
        while (t := r.next()) is not END and t != "ID":
            pass
        m = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|\Z)").search(r.data, r.pos)
        r.pos = m.end() if m else r.end


def page_text(doc: Document, page: dict, fonts: dict | None = None) -> str:
    t = TextPage(doc, {} if fonts is None else fonts)
    t.run(doc.content(page["dict"].get("Contents")), page.get("Resources"))
    return "".join(t.out)


def texts(doc: Document, wanted: list[int] | None = None) -> list[dict]:
    """page_index and text of the pages, or of those wanted, in document order."""
    doc.readable()
    fonts: dict = {}
    return [{"page_index": p["index"], "text": page_text(doc, p, fonts)} for p in doc.pages() if wanted is None or p["index"] in wanted]
