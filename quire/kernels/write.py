"""Writing PDF files: all objects, then an index as a table or a stream; objects may be packed in object streams."""

from __future__ import annotations

import zlib

from quire.kernels.syntax import Name, Ref, Stream, serialize


def write(objects: dict[int, object], trailer: dict, *, version: str = "1.7", xref: str = "table", packed: set[int] = frozenset(), gens: dict[int, int] | None = None) -> bytes:
    """A file of ``objects``; with xref='stream' the numbers in ``packed`` go to one object stream."""
    gens = gens or {}
    out = bytearray(b"%PDF-" + version.encode() + b"\n%\xe2\xe3\xcf\xd3\n")
    entries: dict[int, tuple[int, int, int]] = {0: (0, 0, 65535)}
    top = max(objects, default=0)
    packed = {n for n in packed if n in objects and not isinstance(objects[n], Stream)} if xref == "stream" else set()
    for num in sorted(objects):
        if num in packed:
            continue
        entries[num] = (1, len(out), gens.get(num, 0))
        out += b"%d %d obj\n" % (num, gens.get(num, 0)) + serialize(objects[num]) + b"\nendobj\n"
    if packed:
        top += 1
        heads, bodies = [], bytearray()
        for place, num in enumerate(sorted(packed)):
            heads.append(b"%d %d" % (num, len(bodies)))
            bodies += serialize(objects[num]) + b"\n"
            entries[num] = (2, top, place)
        head = b" ".join(heads) + b"\n"
        entries[top] = (1, len(out), 0)
        stream = Stream({"Type": Name("ObjStm"), "N": len(packed), "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + bytes(bodies)))
        out += b"%d 0 obj\n" % top + serialize(stream) + b"\nendobj\n"
    start = len(out)
    if xref == "stream":
        top += 1
        entries[top] = (1, start, 0)
        rows = b"".join(bytes([k]) + a.to_bytes(5, "big") + b.to_bytes(2, "big") for k, a, b in (entries.get(i, (0, 0, 65535)) for i in range(top + 1)))
        d = {"Type": Name("XRef"), "Size": top + 1, "W": [1, 5, 2], "Filter": Name("FlateDecode")} | trailer
        out += b"%d 0 obj\n" % top + serialize(Stream(d, zlib.compress(rows))) + b"\nendobj\n"
    else:
        free = [i for i in range(top + 1) if entries.get(i, (0,))[0] == 0]
        after = dict(zip(free, free[1:] + [0]))
        out += b"xref\n0 %d\n" % (top + 1)
        for i in range(top + 1):
            kind, a, b = entries.get(i) or (0, 0, 65535 if i == 0 else 1)
            out += b"%010d %05d %s \n" % ((a, b, b"n") if kind else (after[i], 65535 if i == 0 else b if b != 65535 else 1, b"f"))
        out += b"trailer\n" + serialize({"Size": top + 1} | trailer) + b"\n"
    out += b"startxref\n%d\n%%%%EOF\n" % start
    return bytes(out)


def update(data: bytes, objects: dict[int, object], trailer: dict, prev: int, size: int, at: int = 0) -> bytes:
    """An incremental update appended to a file, of which ``at`` bytes come before ``data``."""
    out = bytearray(data)
    offsets = {}
    for num in sorted(objects):
        offsets[num] = at + len(out)
        out += b"%d 0 obj\n" % num + serialize(objects[num]) + b"\nendobj\n"
    start = at + len(out)
    out += b"xref\n"
    for num in sorted(offsets):
        out += b"%d 1\n%010d 00000 n \n" % (num, offsets[num])
    out += b"trailer\n" + serialize({"Size": max([size, *(n + 1 for n in objects)]), "Prev": prev} | trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start
    return bytes(out)


class Builder:
    """Objects under construction: catalog, flat page tree, shared Helvetica in WinAnsi."""

    def __init__(self):
        self.objects: dict[int, object] = {}
        self.top = 0
        self.catalog: dict = {"Type": Name("Catalog")}
        self.root = self.add(self.catalog)
        self.tree: dict = {"Type": Name("Pages"), "Kids": [], "Count": 0}
        self.catalog["Pages"] = self.add(self.tree)
        self.font = self.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")})
        self.trailer: dict = {"Root": self.root}

    def add(self, value) -> Ref:
        self.top = num = self.top + 1
        self.objects[num] = value
        return Ref(num)

    def page(self, content: bytes = b"", *, width: float = 595, height: float = 842, filters: list[str] = (), extra: dict | None = None, resources: dict | None = None) -> Ref:
        from quire.kernels import filters as f

        for name in reversed(filters):
            content = {"FlateDecode": zlib.compress, "ASCII85Decode": f.encode_ascii85, "ASCIIHexDecode": lambda d: d.hex().encode() + b">", "RunLengthDecode": f.encode_run_length, "LZWDecode": f.encode_lzw}[name](content)
        d: dict = {"Filter": [Name(x) for x in filters]} if filters else {}
        stream = self.add(Stream(d, content))
        page = {"Type": Name("Page"), "Parent": self.catalog["Pages"], "MediaBox": [0, 0, width, height], "Resources": {"Font": {"F1": self.font}} | (resources or {}), "Contents": stream} | (extra or {})
        ref = self.add(page)
        self.tree["Kids"].append(ref)
        self.tree["Count"] += 1
        return ref

    def build(self, **options) -> bytes:
        return write(self.objects, self.trailer, **options)
