"""A PDF file as numbered objects: index, repair, point lookup, stream data, page tree. No Spark here.

``Document`` never fails on damage: a broken index is rebuilt by a scan of the whole file, and what was done is told in
``repaired`` and ``warnings``. Errors that remain (no object at all, wrong password) are exceptions of this module.
"""

from __future__ import annotations

import re

from quire.kernels import filters
from quire.kernels.syntax import END, Name, Reader, Ref, Str, Stream, Word

OBJECTS, SECTIONS, HOPS, TREE_DEPTH, OBJSTM_BYTES = 8_388_608, 4_096, 16, 256, 32 << 20
FREE, OFFSET, PACKED = "free", "offset", "packed"
LETTER = [0, 0, 612, 792]
_OBJ = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![A-Za-z])")
_ENTRY = re.compile(rb"[\0\t\n\f\r ]*(\d{1,12})[\0\t\n\f\r ]+(\d{1,7})[\0\t\n\f\r ]+([nf])")


class PdfError(Exception):
    pass


class PdfFormatError(PdfError):
    pass


class PdfEncryptedError(PdfError):
    pass


class PdfPasswordError(PdfError):
    pass


def integer(v) -> int | None:
    return int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer() else None


class Document:
    def __init__(self, data: bytes, password: str | None = None):
        self.data = data
        self.warnings: list[str] = []
        self.repaired = False
        self.index: dict[int, tuple[str, int, int]] = {}  # num -> kind, offset or container, gen or place
        self.sections: dict[int, int] = {}  # num -> age of the section that told it, newest 0
        self.trailer: dict = {}
        self.security = None
        self.first_page = 0  # of a part of a file
        self._cache: dict[int, object] = {}
        self._packed: dict[int, tuple[bytes, list[tuple[int, int]]]] = {}
        head = re.search(rb"%PDF-(\d\.\d)", data[:1024])
        self.header, self.shift = (head[1].decode(), head.start()) if head else ("1.4", 0)
        try:
            self._load_index()
            bad = self._misplaced()
        except (PdfFormatError, ValueError, RecursionError):
            self.index, self.trailer, bad = {}, {}, [-1]
        if bad:
            self._rescan(bad)
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            self._rescan([-1])
        if not self.index:
            raise PdfFormatError("no objects found")
        self.encrypted = isinstance(self.get(self.trailer.get("Encrypt")), dict)
        if self.encrypted and password is not None:
            from quire.kernels.crypto import authenticate

            self.security = authenticate(self, password)
            if self.security is None:
                raise PdfPasswordError("wrong password")
            self._cache.clear()
            self._packed.clear()

    @classmethod
    def part(cls, data: bytes, index: dict[int, int], first_page: int, pages: list[int], fields: list[int]) -> Document:
        """A piece of a file with what the file's index, page tree and form have of it: offsets in ``data`` by object number,
        pages and their place in the file, fields. Objects of other pieces read as null."""
        self = cls.__new__(cls)
        self.data, self.warnings, self.repaired, self.header, self.shift = data, [], False, "1.7", 0
        self.index, self.sections = {num: (OFFSET, at, 0) for num, at in index.items()}, dict.fromkeys(index, 0)
        self.trailer = {"Root": {"Pages": {"Kids": list(map(Ref, pages))}, "AcroForm": {"Fields": list(map(Ref, fields))}}}
        self.security, self.encrypted, self.first_page = None, False, first_page
        self._cache, self._packed = {}, {}
        return self

    # -- the index
    def _load_index(self) -> None:
        at = -1
        for size in (2048, 65536, 1 << 20):
            at = self.data.rfind(b"startxref", max(0, len(self.data) - size))
            if at >= 0:
                break
        start = Reader(self.data, at + 9).value() if at >= 0 else None
        if not isinstance(start, int):
            raise PdfFormatError("no startxref")
        seen: set[int] = set()
        trailers: list[dict] = []
        todo = [start]
        while todo and len(seen) < SECTIONS:
            offset = todo.pop(0)
            if offset in seen or not 0 <= offset < len(self.data):
                if not trailers:
                    raise PdfFormatError("bad startxref")
                continue
            seen.add(offset)
            age = len(trailers)
            trailer, entries = self._section(offset + self.shift)
            packed: dict[int, tuple] = {}
            if isinstance(trailer.get("XRefStm"), int):  # told before free entries of the table, after those in use
                try:
                    packed = self._section(trailer["XRefStm"] + self.shift)[1]
                except PdfFormatError:
                    self.warnings.append("broken XRefStm")
            for source in ({n: e for n, e in entries.items() if e[0] != FREE}, packed, entries):
                for num, entry in source.items():
                    if num not in self.index and num < OBJECTS:
                        self.index[num] = entry
                        self.sections[num] = age
            trailers.append(trailer)
            if isinstance(trailer.get("Prev"), (int, float)):
                todo.append(int(trailer["Prev"]))
        for t in trailers:
            for k, v in t.items():
                if k not in ("Prev", "XRefStm", "W", "Index", "Length", "Filter", "DecodeParms", "Type", "Size"):
                    self.trailer.setdefault(k, v)

    def _section(self, offset: int) -> tuple[dict, dict[int, tuple]]:
        r = Reader(self.data, offset)
        first = r.next()
        if isinstance(first, Word) and first == "xref":
            return self._table(r)
        num, _, word = first, r.next(), r.next()
        if not isinstance(num, int) or word != "obj":
            raise PdfFormatError("no xref section")
        obj = self._read_at(offset, None)[1]
        if not isinstance(obj, Stream) or obj.dict.get("Type") != "XRef":
            raise PdfFormatError("no xref stream")
        return obj.dict, self._stream_entries(obj)

    def _table(self, r: Reader) -> tuple[dict, dict[int, tuple]]:
        entries: dict[int, tuple] = {}
        while True:
            start = r.next()
            if not isinstance(start, int):
                break
            count = r.next()
            if not isinstance(count, int):
                raise PdfFormatError("broken xref table")
            for i in range(count):
                m = _ENTRY.match(self.data, r.pos)
                if not m:
                    break
                r.pos = m.end()
                offset, gen, kind = int(m[1]), int(m[2]), m[3]
                if i == 0 and start == 1 and kind == b"f" and gen == 65535 and offset == 0:
                    start = 0  # a table that begins one too high
                entries[start + i] = (OFFSET, offset + self.shift, gen) if kind == b"n" else (FREE, offset, gen)
        if start != "trailer":
            raise PdfFormatError("no trailer")
        trailer = r.value()
        if not isinstance(trailer, dict):
            raise PdfFormatError("no trailer")
        return trailer, entries

    def _stream_entries(self, obj: Stream) -> dict[int, tuple]:
        data = self.decoded(obj) or b""
        widths = obj.dict.get("W")
        if not isinstance(widths, list) or len(widths) < 3 or not all(isinstance(w, int) and 0 <= w <= 8 for w in widths[:3]):
            raise PdfFormatError("broken xref stream")
        a, b, c = widths[:3]
        size = sum(widths)
        index = obj.dict.get("Index")
        if not isinstance(index, list):
            index = [0, integer(obj.dict.get("Size")) or 0]
        entries, at = {}, 0
        for start, count in zip(index[::2], index[1::2]):
            for num in range(start, start + count):
                if at + size > len(data):
                    break
                kind = int.from_bytes(data[at : at + a], "big") if a else 1
                x, y = int.from_bytes(data[at + a : at + a + b], "big"), int.from_bytes(data[at + a + b : at + a + b + c], "big")
                at += size
                if kind == 0:
                    entries[num] = (FREE, x, y)
                elif kind == 1:
                    entries[num] = (OFFSET, x + self.shift, y)
                elif kind == 2:
                    entries[num] = (PACKED, x, y)
        return entries

    def _misplaced(self) -> list[int]:
        bad = []
        for num, (kind, offset, _) in self.index.items():
            if kind == OFFSET:
                m = _OBJ.match(self.data, _skip(self.data, offset))
                if not m or int(m[1]) != num:
                    bad.append(num)
        return bad

    def _rescan(self, bad: list[int]) -> None:
        """Find objects by scanning the file; the last definition of a number wins."""
        found: dict[int, tuple[str, int, int]] = {}
        at = 0
        streams: list[int] = []
        root = encrypt = None
        while True:
            m = _OBJ.search(self.data, at)
            if not m:
                break
            num, gen = int(m[1]), int(m[2])
            at = m.end()
            if num >= OBJECTS:
                continue
            found[num] = (OFFSET, m.start(), gen)
            try:
                _, obj, end = self._read_at(m.start(), None, found)
            except PdfFormatError:
                continue
            d = obj.dict if isinstance(obj, Stream) else obj
            if isinstance(obj, Stream):
                at = max(at, end)
            if isinstance(d, dict):
                if d.get("Type") == "Catalog":
                    root = Ref(num, gen)
                if d.get("Type") == "ObjStm":
                    streams.append(num)
                if "Filter" in d and "O" in d and "U" in d:
                    encrypt = Ref(num, gen)
        if bad != [-1] and self.index:  # only what was told wrong is moved
            moved = False
            for num in bad:
                if num in found:
                    self.index[num] = found[num]
                else:
                    self.index.pop(num)
                moved = True
            self.repaired = self.repaired or moved
            self._cache.clear()
            return
        self.repaired = True
        self.warnings.append("index rebuilt")
        self.index = found
        self._cache.clear()
        self._packed.clear()
        trailer: dict = {}
        for m in re.finditer(rb"trailer", self.data):
            t = Reader(self.data, m.end()).value()
            if isinstance(t, dict):
                trailer |= {k: v for k, v in t.items() if k in ("Root", "Info", "ID", "Encrypt")}
        for num in list(found):
            obj = self.object(num)
            if isinstance(obj, Stream) and obj.dict.get("Type") == "XRef":
                trailer |= {k: v for k, v in obj.dict.items() if k in ("Root", "Info", "ID", "Encrypt")}
        self.trailer = trailer
        for num in streams:
            for place, (member, _) in enumerate(self._members(num)[1]):
                if member not in found or found[member][1] < found[num][1]:
                    self.index[member] = (PACKED, num, place)
                    self._cache.pop(member, None)
                    obj = self.object(member)
                    if isinstance(obj, dict) and obj.get("Type") == "Catalog":
                        root = Ref(member)
        if not isinstance(self.get(self.trailer.get("Root")), dict) and root:
            self.trailer["Root"] = root
        if encrypt and "Encrypt" not in self.trailer:
            self.trailer["Encrypt"] = encrypt

    # -- objects
    def _read_at(self, offset: int, num: int | None, lengths: dict | None = None) -> tuple[int, object, int]:
        """(number, value, end) of the object at an offset."""
        m = _OBJ.match(self.data, _skip(self.data, offset))
        if not m or num is not None and int(m[1]) != num:
            raise PdfFormatError("no object here")
        r = Reader(self.data, m.end())
        value = r.value()
        if not isinstance(value, dict):
            return int(m[1]), value, r.pos
        pos = r.pos
        if r.next() != "stream":
            return int(m[1]), value, pos
        start = r.pos
        if self.data[start : start + 2] == b"\r\n":
            start += 2
        elif self.data[start : start + 1] in (b"\n", b"\r"):
            start += 1
        length = value.get("Length")
        if isinstance(length, Ref):
            length = self.get(length) if lengths is None or length.num in (lengths or {}) and self.index else None
        end = start + length if isinstance(length, int) and length >= 0 else -1
        if end < start or end > len(self.data) or not re.match(rb"[\0\t\n\f\r ]*endstream", self.data[end : end + 32]):
            found = self.data.find(b"endstream", start)
            stop = found if found >= 0 else len(self.data)
            end = stop
            if self.data[end - 2 : end] == b"\r\n":
                end -= 2
            elif end > start and self.data[end - 1 : end] in (b"\n", b"\r"):
                end -= 1
        return int(m[1]), Stream(value, self.data[start:end]), end

    def _members(self, num: int) -> tuple[bytes, list[tuple[int, int]]]:
        if num not in self._packed:
            obj = self.object(num)
            data, members = b"", []
            if isinstance(obj, Stream):
                data = self.decoded(obj, OBJSTM_BYTES) or b""
                first, n = integer(self.get(obj.dict.get("First"))) or 0, integer(self.get(obj.dict.get("N"))) or 0
                r = Reader(data, 0, first)
                for _ in range(n):
                    a, b = r.next(), r.next()
                    if not isinstance(a, int) or not isinstance(b, int):
                        break
                    members.append((a, first + b))
            self._packed[num] = (data, members)
        return self._packed[num]

    def object(self, num: int):
        """The value of an object by number; null where there is none."""
        if num in self._cache:
            return self._cache[num]
        self._cache[num] = None  # a circle reads as null
        kind, a, b = self.index.get(num, (FREE, 0, 0))
        value = None
        if kind == OFFSET:
            try:
                value = self._read_at(a, num)[1]
            except PdfFormatError:
                value = None
            if self.security is not None and value is not None:
                value = self.security.decrypt_object(self, num, b, value)
        elif kind == PACKED and self.index.get(a, (FREE,))[0] == OFFSET:
            data, members = self._members(a)
            at = members[b][1] if b < len(members) and members[b][0] == num else next((o for n, o in members if n == num), None)
            if at is not None:
                value = Reader(data, at).value()
        self._cache[num] = value
        return value

    def get(self, v):
        """Follow references."""
        for _ in range(HOPS):
            if not isinstance(v, Ref):
                return v
            v = self.object(v.num)
        return None if isinstance(v, Ref) else v

    def dict(self, v) -> dict:
        v = self.get(v)
        return v.dict if isinstance(v, Stream) else v if isinstance(v, dict) else {}

    def list(self, v) -> list:
        v = self.get(v)
        return v if isinstance(v, list) else []

    def filters_of(self, s: Stream) -> tuple[list[str], list[dict]]:
        f, p = self.get(s.dict.get("Filter", s.dict.get("F"))), self.get(s.dict.get("DecodeParms", s.dict.get("DP")))
        names = [str(self.get(x)) for x in (f if isinstance(f, list) else [f] if isinstance(f, Name) else [])]
        parms = [{k: self.get(v) for k, v in self.dict(x).items()} for x in (p if isinstance(p, list) else [p])]
        return names, parms

    def decode_image(self, s: Stream, limit: int = filters.LARGEST) -> tuple[bytes, str | None] | None:
        return filters.decode(s.data, *self.filters_of(s), limit)

    def decoded(self, s: Stream, limit: int = filters.LARGEST) -> bytes | None:
        """Data of a stream; None where a filter is unknown or leaves an image."""
        got = self.decode_image(s, limit)
        return got[0] if got and got[1] is None else None

    # -- structure
    @property
    def catalog(self) -> dict:
        return self.dict(self.trailer.get("Root"))

    def pages(self) -> list[dict]:
        """Pages in order: index, num, dict, and what they inherit."""
        out, stack, seen = [], [(self.catalog.get("Pages"), {}, 0)], set()
        while stack:
            ref, inherited, depth = stack.pop()
            if isinstance(ref, Ref):
                if ref.num in seen:
                    continue
                seen.add(ref.num)
            d = self.get(ref)
            if not isinstance(d, dict) or depth > TREE_DEPTH:
                continue
            now = inherited | {k: d[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in d}
            kids = self.get(d.get("Kids"))
            if isinstance(kids, list) and d.get("Type") != "Page":
                stack += [(k, now, depth + 1) for k in reversed(kids)]
            else:
                out.append({"index": self.first_page + len(out), "num": ref.num if isinstance(ref, Ref) else None, "dict": d, **now})
        return out

    def box(self, v) -> list[float] | None:
        v = [self.get(x) for x in self.list(v)]
        if len(v) != 4 or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
            return None
        return [min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])]

    def content(self, v, limit: int = 64 << 20) -> bytes:
        """Content streams joined with line feeds."""
        v = self.get(v)
        parts, size = [], 0
        for s in v if isinstance(v, list) else [v]:
            s = self.get(s)
            if isinstance(s, Stream) and size < limit:
                parts.append(self.decoded(s, limit - size) or b"")
                size += len(parts[-1])
        return b"\n".join(parts)

    def readable(self) -> None:
        if self.encrypted and self.security is None:
            raise PdfEncryptedError("document is encrypted")

    def tree(self, root, key: str) -> list[tuple]:
        """Leaves of a name or number tree, in order."""
        out, stack, seen = [], [(root, 0)], set()
        while stack and len(seen) < 1_048_576:
            ref, depth = stack.pop()
            if isinstance(ref, Ref):
                if ref.num in seen:
                    continue
                seen.add(ref.num)
            d = self.dict(ref)
            leaves = self.list(d.get(key))
            for k, v in zip(leaves[::2], leaves[1::2]):
                k = self.get(k)
                out.append((k.data if isinstance(k, Str) else k, v))
            if depth < 64:
                stack += [(k, depth + 1) for k in reversed(self.list(d.get("Kids")))]
        return out

    def reachable(self, roots: list | None = None, skip: set[int] = frozenset()) -> set[int]:
        """Numbers of the objects that the trailer, or ``roots``, lead to."""
        todo = list(roots if roots is not None else [self.trailer.get(k) for k in ("Root", "Info", "Encrypt")])
        seen: set[int] = set()
        while todo:
            v = todo.pop()
            if isinstance(v, Ref):
                if v.num not in seen and v.num not in skip and self.index.get(v.num, (FREE,))[0] != FREE:
                    seen.add(v.num)
                    todo.append(self.object(v.num))
            elif isinstance(v, Stream):
                todo.extend(v.dict.values())
            elif isinstance(v, dict):
                todo.extend(v.values())
            elif isinstance(v, list):
                todo.extend(v)
        return seen

    def live(self) -> list[int]:
        """Numbers in use, containers of other objects and index streams left out."""
        out = []
        for num, (kind, _, _) in sorted(self.index.items()):
            if kind != FREE and num:
                v = self.object(num)
                if not (isinstance(v, Stream) and v.dict.get("Type") in ("ObjStm", "XRef")):
                    out.append(num)
        return out


def _skip(data: bytes, at: int) -> int:
    while at < len(data) and data[at] in b"\0\t\n\f\r ":
        at += 1
    return at


__all__ = ["Document", "END", "PdfError", "PdfEncryptedError", "PdfFormatError", "PdfPasswordError", "integer"]
