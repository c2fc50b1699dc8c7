"""What a document tells: information, pages, outline, links, form fields, attachments and images, as plain rows."""

from __future__ import annotations

import datetime as dt
import hashlib
import html
import math
import re

from quire.kernels.document import Document, integer
from quire.kernels.syntax import Name, Ref, Str, Stream, decode_text, text_of, uri_of

_DATE = re.compile(r"\s*(?:D:)?(\d{4})(?:(\d\d)(?:(\d\d)(?:(\d\d)(?:(\d\d)(?:(\d\d))?)?)?)?)?\s*(?:([Zz+\-])(?:(\d\d)'?(?:(\d\d)'?)?)?)?.*\Z", re.S)
_ISO = re.compile(r"\s*(\d{4})-(\d\d)(?:-(\d\d))?(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.\d+)?)?)?\s*(?:([Zz+\-])(?:(\d\d):?(\d\d)?)?)?\s*\Z")
STANDARD = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Trapped")


def parse_date(s: str | None) -> dt.datetime | None:
    """A document date or an ISO 8601 date, as UTC; null where it is none."""
    m = s and (_ISO.match(s) or _DATE.match(s))
    if not m:
        return None
    y, mo, d, h, mi, sec = (int(x) if x else None for x in m.groups()[:6])
    try:
        at = dt.datetime(y, mo or 1, d or 1, h or 0, mi or 0, sec or 0)
    except ValueError:
        return None
    if m[7] in ("+", "-"):
        shift = dt.timedelta(hours=int(m[8] or 0), minutes=int(m[9] or 0))
        try:
            at = at - shift if m[7] == "+" else at + shift
        except OverflowError:
            return None
    return at


def xmp_property(xmp: str, name: str) -> str | None:
    """A property of an XMP packet, as element or attribute; lists are joined, the first alternative is taken."""
    q = re.escape(name)
    m = re.search(rf"<{q}(?:\s[^>]*)?>(.*?)</{q}\s*>", xmp, re.S)
    if m:
        body = m[1]
        items = re.findall(r"<rdf:li(?:\s[^>]*)?>(.*?)</rdf:li\s*>", body, re.S)
        if items:
            items = [html.unescape(re.sub(r"<[^>]*>", "", i)).strip() for i in items]
            return items[0] if "<rdf:Alt" in body else ", ".join(items)
        return html.unescape(re.sub(r"<[^>]*>", "", body)).strip() or None
    m = re.search(rf"\s{q}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", xmp)
    return html.unescape(m[1] if m[1] is not None else m[2]) if m else None


def roman(n: int) -> str:
    out = ""
    for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += s * (n // v)
        n %= v
    return out


def label(style: str | None, n: int) -> str:
    if style is None:
        return ""
    if style == "D" or n > 5000 or n < 1:
        return str(n)
    if style in "Rr":
        return roman(n).upper() if style == "R" else roman(n)
    letter = chr((n - 1) % 26 + ord("A")) * ((n - 1) // 26 + 1)
    return letter if style == "A" else letter.lower() if style == "a" else str(n)


def page_labels(doc: Document, count: int) -> list[str | None]:
    """Label of each page by the last range that starts at or before it; none before the first range."""
    ranges = sorted(((k, doc.dict(v)) for k, v in doc.tree(doc.catalog.get("PageLabels"), "Nums") if isinstance(k, int)), key=lambda x: x[0])
    out: list[str | None] = [None] * count
    for (start, d), stop in zip(ranges, [k for k, _ in ranges[1:]] + [count]):
        style = doc.get(d.get("S"))
        first = integer(doc.get(d.get("St"))) or 1
        for i in range(max(0, start), min(stop, count)):
            out[i] = (text_of(doc.get(d.get("P"))) or "") + label(str(style) if isinstance(style, Name) else None, first + i - start)
    return out


def pages(doc: Document) -> list[dict]:
    found = doc.pages()
    labels = page_labels(doc, len(found))
    out = []
    for p in found:
        media = doc.box(p.get("MediaBox")) or [0, 0, 612, 792]
        crop = doc.box(p.get("CropBox"))
        box = media
        if crop:
            both = [max(crop[0], media[0]), max(crop[1], media[1]), min(crop[2], media[2]), min(crop[3], media[3])]
            box = both if both[2] > both[0] and both[3] > both[1] else media
        rotate = doc.get(p.get("Rotate"))
        rotate = int(math.floor(rotate / 90 + 0.5)) * 90 % 360 if isinstance(rotate, (int, float)) and not isinstance(rotate, bool) else 0
        out.append({"page_index": p["index"], "num": p["num"], "width": float(box[2] - box[0]), "height": float(box[3] - box[1]), "rotate": rotate, "label": labels[p["index"]], "media_box": [float(x) for x in media], "crop_box": [float(x) for x in crop] if crop else None})
    return out


def info(doc: Document) -> dict:
    catalog = doc.catalog
    locked = doc.encrypted and doc.security is None
    d = {} if locked else doc.dict(doc.trailer.get("Info"))
    meta = doc.get(catalog.get("Metadata"))
    xmp = None
    if isinstance(meta, Stream) and not locked:
        raw = doc.decoded(meta, 16 << 20)
        xmp = raw.decode("utf-8", "replace") if raw is not None else None

    def text(key: str, prop: str) -> str | None:
        v = text_of(doc.get(d.get(key)))
        return v if v else xmp_property(xmp, prop) if xmp else None

    version = doc.header
    own = doc.get(catalog.get("Version"))
    if isinstance(own, Name) and re.fullmatch(r"\d\.\d", own) and own > version:
        version = str(own)
    form = doc.dict(catalog.get("AcroForm"))
    fields_ = [] if locked else fields(doc)
    names, found = doc.dict(catalog.get("Names")), doc.pages()
    actions = [catalog.get("OpenAction"), *doc.dict(catalog.get("AA")).values()]
    return {
        "version": version, "page_count": len(found), "title": text("Title", "dc:title"), "author": text("Author", "dc:creator"), "subject": text("Subject", "dc:description"),
        "keywords": text("Keywords", "pdf:Keywords"), "creator": text("Creator", "xmp:CreatorTool"), "producer": text("Producer", "pdf:Producer"),
        "creation_date": parse_date(text("CreationDate", "xmp:CreateDate")), "mod_date": parse_date(text("ModDate", "xmp:ModifyDate")),
        "custom": {k: t for k, v in d.items() if k not in STANDARD and (t := text_of(doc.get(v))) is not None},
        "language": text_of(doc.get(catalog.get("Lang"))) if not locked else None, "metadata": xmp, "encrypted": doc.encrypted,
        "tagged": doc.get(doc.dict(catalog.get("MarkInfo")).get("Marked")) is True, "has_forms": bool(doc.list(form.get("Fields"))) or "XFA" in form,
        "has_javascript": "JavaScript" in names or any(doc.dict(a).get("S") == "JavaScript" for a in actions),
        "signed": any(f["type"] == "signature" and f["signed"] for f in fields_) or bool((integer(doc.get(form.get("SigFlags"))) or 0) & 1 and any(f["type"] == "signature" and f["signed"] for f in fields_)),
        "attachments": 0 if locked else len(attachments(doc, found)), "repaired": doc.repaired, "warnings": list(doc.warnings),
    }


class Targets:
    """Destinations and actions to a page index or an address."""

    def __init__(self, doc: Document):
        self.doc = doc
        self.page_of = {p["num"]: p["index"] for p in doc.pages() if p["num"] is not None}
        self.count = len(doc.pages())
        self.tree: dict[bytes, object] = {}
        for k, v in doc.tree(doc.dict(doc.catalog.get("Names")).get("Dests"), "Names"):
            if isinstance(k, bytes):
                self.tree.setdefault(k, v)
        self.old = doc.dict(doc.catalog.get("Dests"))

    def page(self, dest, depth: int = 0) -> int | None:
        dest = self.doc.get(dest)
        if depth > 4:
            return None
        if isinstance(dest, dict):
            return self.page(dest.get("D"), depth + 1)
        if isinstance(dest, Name):
            found = self.old.get(str(dest))
            return self.page(found if found is not None else self.tree.get(dest.encode("latin-1")), depth + 1)
        if isinstance(dest, Str):
            found = self.tree.get(dest.data)
            return self.page(found if found is not None else self.old.get(dest.data.decode("latin-1")), depth + 1)
        if isinstance(dest, list) and dest:
            if isinstance(dest[0], Ref):
                return self.page_of.get(dest[0].num)
            n = integer(dest[0])
            return n if n is not None and 0 <= n < self.count else None
        return None

    def of(self, d: dict) -> tuple[int | None, str | None]:
        if d.get("Dest") is not None:
            return self.page(d["Dest"]), None
        a = self.doc.dict(d.get("A"))
        kind = self.doc.get(a.get("S"))
        if kind == "GoTo":
            return self.page(a.get("D")), None
        if kind == "URI" and isinstance(self.doc.get(a.get("URI")), Str):
            return None, uri_of(self.doc.get(a["URI"]).data)
        return None, None


def outline(doc: Document, most: int = 100_000, deepest: int = 64) -> list[dict]:
    doc.readable()
    targets, out, seen = Targets(doc), [], set()
    stack = [(doc.dict(doc.catalog.get("Outlines")).get("First"), ())]
    counters: dict[tuple, int] = {}
    while stack and len(out) < most:
        ref, parent = stack.pop()
        if isinstance(ref, Ref):
            if ref.num in seen:
                continue
            seen.add(ref.num)
        d = doc.get(ref)
        if not isinstance(d, dict):
            continue
        place = counters.get(parent, 0)
        counters[parent] = place + 1
        path = (*parent, place)
        page, url = targets.of(d)
        count = doc.get(d.get("Count"))
        out.append({"path": list(path), "depth": len(path), "title": text_of(doc.get(d.get("Title"))) or "", "page_index": page, "url": url, "open": isinstance(count, (int, float)) and count > 0})
        if "Next" in d:
            stack.append((d["Next"], parent))
        if "First" in d and len(path) < deepest:
            stack.append((d["First"], path))
    return sorted(out, key=lambda r: r["path"])


def links(doc: Document) -> list[dict]:
    doc.readable()
    targets, out = Targets(doc), []
    for p in doc.pages():
        for a in doc.list(p["dict"].get("Annots")):
            d = doc.dict(a)
            rect = doc.box(d.get("Rect"))
            if d.get("Subtype") != "Link" or rect is None:
                continue
            page, url = targets.of(d)
            if page is not None or url is not None:
                out.append({"page_index": p["index"], "rect": [float(x) for x in rect], "url": url, "target_page_index": page})
    return out


def _type(kind, flags: int) -> str:
    if kind == "Btn":
        return "button" if flags & 1 << 16 else "radio" if flags & 1 << 15 else "checkbox"
    if kind == "Ch":
        return "combo" if flags & 1 << 17 else "list"
    return {"Tx": "text", "Sig": "signature"}.get(str(kind), "unknown")


def fields(doc: Document) -> list[dict]:
    """Terminal fields, with what they inherit."""
    doc.readable()
    out, seen = [], set()
    stack = [(k, {}, "", 0) for k in reversed(doc.list(doc.dict(doc.catalog.get("AcroForm")).get("Fields")))]
    while stack and len(seen) < 262_144:
        ref, inherited, prefix, depth = stack.pop()
        if isinstance(ref, Ref):
            if ref.num in seen:
                continue
            seen.add(ref.num)
        d = doc.get(ref)
        if not isinstance(d, dict) or depth > 64:
            continue
        part = text_of(doc.get(d.get("T")))
        name = prefix if part is None else f"{prefix}.{part}" if prefix else part
        now = inherited | {k: d[k] for k in ("FT", "Ff", "V", "DV", "Opt") if k in d}
        kids = [k for k in doc.list(d.get("Kids")) if "T" in doc.dict(k) or "Kids" in doc.dict(k)]
        if kids:
            stack += [(k, now, name, depth + 1) for k in reversed(kids)]
            continue
        kind, flags = doc.get(now.get("FT")), integer(doc.get(now.get("Ff"))) or 0
        if kind is None:
            continue
        type_ = _type(kind, flags)

        def values(v) -> list[str] | None:
            v = doc.get(v)
            if type_ == "signature" or v is None:
                return None
            if isinstance(v, Stream):
                raw = doc.decoded(v)
                return [decode_text(raw)] if raw is not None else None
            many = [text_of(doc.get(x)) for x in v] if isinstance(v, list) else [text_of(v)]
            return [x for x in many if x is not None] or None

        options, labels = [], []
        for o in doc.list(now.get("Opt")):
            o = doc.get(o)
            pair = [text_of(doc.get(x)) for x in o] if isinstance(o, list) else [text_of(o)]
            if pair and pair[0] is not None:
                options.append(pair[0])
                labels.append(pair[-1] if pair[-1] is not None else pair[0])
        out.append({"name": name, "type": type_, "value": values(now.get("V")), "is_multi": type_ in ("combo", "list") and bool(flags & 1 << 21), "default_value": values(now.get("DV")), "options": options or None, "option_labels": labels or None, "signed": type_ == "signature" and bool(doc.dict(now.get("V"))), "flags": flags, "read_only": bool(flags & 1), "required": bool(flags & 2)})
    return out


def attachments(doc: Document, found: list[dict] | None = None) -> list[dict]:
    """Embedded files of the name tree, then of annotations; each stream once."""
    doc.readable()
    specs = [(text_of(Str(k)) if isinstance(k, bytes) else None, v, None) for k, v in doc.tree(doc.dict(doc.catalog.get("Names")).get("EmbeddedFiles"), "Names")]
    for p in doc.pages() if found is None else found:
        for a in doc.list(p["dict"].get("Annots")):
            d = doc.dict(a)
            if d.get("Subtype") == "FileAttachment":
                specs.append((None, d.get("FS"), p["index"]))
    out, seen = [], set()
    for key, spec, page in specs:
        fs = doc.dict(spec)
        ef = doc.dict(fs.get("EF"))
        ref = next((ef[k] for k in ("UF", "F", "DOS", "Mac", "Unix") if isinstance(doc.get(ef.get(k)), Stream)), None)
        filename = next((t for k in ("UF", "F", "DOS", "Mac", "Unix") if (t := text_of(doc.get(fs.get(k))))), None)
        if ref is None or isinstance(ref, Ref) and ref.num in seen:
            continue
        if isinstance(ref, Ref):
            seen.add(ref.num)
        s = doc.get(ref)
        params = doc.dict(s.dict.get("Params"))
        mime, rel = doc.get(s.dict.get("Subtype")), doc.get(fs.get("AFRelationship"))
        out.append({"ord": len(out), "name": key or filename or "", "filename": filename, "description": text_of(doc.get(fs.get("Desc"))), "size": integer(doc.get(params.get("Size"))), "mime_type": str(mime) if isinstance(mime, Name) else None, "created": parse_date(text_of(doc.get(params.get("CreationDate")))), "modified": parse_date(text_of(doc.get(params.get("ModDate")))), "relationship": str(rel) if isinstance(rel, Name) else None, "page_index": page, "stream_num": ref.num if isinstance(ref, Ref) else None})
    return out


def attachment(doc: Document, num: int) -> bytes | None:
    s = doc.object(num)
    return doc.decoded(s) if isinstance(s, Stream) else None


def color_space(doc: Document, v, depth: int = 0) -> str | None:
    v = doc.get(v)
    if isinstance(v, Name):
        return {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}.get(v, str(v))
    if not isinstance(v, list) or not v or depth > 4:
        return None
    head = doc.get(v[0])
    if head == "ICCBased":
        return f"ICCBased({ {1: 'Gray', 3: 'RGB', 4: 'CMYK'}.get(doc.dict(v[1] if len(v) > 1 else None).get('N'), '?')})"
    if head in ("Indexed", "I") and len(v) > 1:
        return f"Indexed({color_space(doc, v[1], depth + 1)})"
    if head == "Separation" and len(v) > 2:
        return f"Separation({color_space(doc, v[2], depth + 1)})"
    if head == "DeviceN" and len(v) > 2:
        return f"DeviceN({color_space(doc, v[2], depth + 1)})"
    return str(head) if isinstance(head, Name) else None


def images(doc: Document) -> list[dict]:
    """Image objects that pages reach through resources, forms, patterns and appearances, by first use."""
    doc.readable()
    use: dict[int, list[int]] = {}
    for p in doc.pages():
        todo, seen = [("res", p.get("Resources"))], set()
        for a in doc.list(p["dict"].get("Annots")):
            for v in doc.dict(doc.dict(a).get("AP")).values():
                todo += [("x", x) for x in ([v] if isinstance(doc.get(v), Stream) else doc.dict(v).values())]
        while todo:
            what, v = todo.pop(0)
            if isinstance(v, Ref):
                if (what, v.num) in seen:
                    continue
                seen.add((what, v.num))
            d = doc.get(v)
            if what == "res":
                r = doc.dict(v)
                todo += [("x", x) for x in doc.dict(r.get("XObject")).values()] + [("x", x) for x in doc.dict(r.get("Pattern")).values()]
            elif isinstance(d, Stream):
                if d.dict.get("Subtype") == "Image":
                    if isinstance(v, Ref) and p["index"] not in use.setdefault(v.num, []):
                        use[v.num].append(p["index"])
                elif "Resources" in d.dict:
                    todo.append(("res", d.dict["Resources"]))
    out = []
    for num, on in use.items():
        s = doc.object(num)
        d = s.dict
        mask = doc.get(d.get("ImageMask")) is True
        out.append({"num": num, "pages": on, "width": integer(doc.get(d.get("Width"))), "height": integer(doc.get(d.get("Height"))), "bits_per_component": 1 if mask else integer(doc.get(d.get("BitsPerComponent"))), "color_space": color_space(doc, d.get("ColorSpace")), "filters": doc.filters_of(s)[0], "encoded_bytes": len(s.data), "image_mask": mask, "has_soft_mask": isinstance(doc.get(d.get("SMask")), Stream)})
    return out


def extract_image(doc: Document, num: int) -> dict | None:
    """The file as stored (jpeg, jpx), or 8-bit gray or RGB pixels."""
    s = doc.object(num)
    got = doc.decode_image(s) if isinstance(s, Stream) else None
    if got is None:
        return None
    data, codec = got
    w, h = integer(doc.get(s.dict.get("Width"))), integer(doc.get(s.dict.get("Height")))
    if codec in ("jpeg", "jpx"):
        return {"kind": codec, "data": data, "width": w, "height": h, "components": None}
    if codec == "ccitt" and w and h:
        from quire.kernels import ccitt

        parms = doc.filters_of(s)[1]
        p = parms[-1] if parms else {}
        columns = integer(p.get("Columns", 1728)) or 1728
        if columns == w and w * h <= 1 << 28:
            data = ccitt.decode(data, k=integer(p.get("K", 0)) or 0, columns=columns, rows=h, black_is_1=p.get("BlackIs1") is True, align=p.get("EncodedByteAlign") is True, end_of_block=p.get("EndOfBlock") is not False)
            codec = None
    if codec or not w or not h:
        return None
    bits = 1 if doc.get(s.dict.get("ImageMask")) is True else integer(doc.get(s.dict.get("BitsPerComponent"))) or 8
    from quire.kernels.image import pixels

    got = pixels(doc, s.dict, data, w, h, bits)
    return got and {"kind": "pixels", "data": got[0], "width": w, "height": h, "components": got[1]}


def objects(doc: Document) -> list[dict]:
    """Every live object: number, kind, offset or container, its syntax and size."""
    from quire.kernels.syntax import serialize

    out = []
    for num in sorted(doc.index):
        kind, a, b = doc.index[num]
        if kind == "free":
            continue
        v = doc.object(num)
        d = v.dict if isinstance(v, Stream) else v if isinstance(v, dict) else {}
        type_ = doc.get(d.get("Type"))
        out.append({"num": num, "gen": b if kind == "offset" else 0, "stored": kind, "place": a, "type": str(type_) if isinstance(type_, Name) else None, "is_stream": isinstance(v, Stream), "stream_bytes": len(v.data) if isinstance(v, Stream) else None, "value": serialize(d if isinstance(v, Stream) else v).decode("latin-1"), "refs": sorted({r for r in _refs(v)})})
    return out


def _refs(v):
    if isinstance(v, Ref):
        yield v.num
    elif isinstance(v, Stream):
        yield from _refs(v.dict)
    elif isinstance(v, dict):
        for x in v.values():
            yield from _refs(x)
    elif isinstance(v, list):
        for x in v:
            yield from _refs(x)


def digest(data: bytes) -> str:
    return hashlib.md5(data).hexdigest()
