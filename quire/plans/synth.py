"""Documents made of table rows, for queries over tables that hold no PDF."""

from __future__ import annotations

import zlib

from quire.kernels.syntax import Name, Ref, Str, Stream, encode_text, serialize
from quire.kernels.write import Builder, write

LINES = 50


def lines_of(text: str | None) -> list[str]:
    return [w for line in (text or "").split("\n") if (w := " ".join(line.split()))]


def _literal(s: str) -> bytes:
    return b"(" + s.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def page_content(lines: list[str], how: str = "plain") -> bytes:
    out = [b"BT /F1 10 Tf 14 TL 40 800 Td"]
    for line in lines:
        if how == "gaps":  # words set apart by displacement, no blank drawn
            out.append(b"[" + _literal(line).replace(b" ", b") -400 (") + b"] TJ T*")
        elif how == "actual":  # what is drawn is not what is meant
            out.append(b"/Span << /ActualText " + serialize(encode_text(line)) + b" >> BDC (x) Tj EMC T*")
        elif how == "type0":
            out.append(b"<" + line.encode("utf-16-be").hex().encode() + b"> Tj T*")
        else:
            out.append(_literal(line) + b" Tj T*")
    out.append(b"ET")
    return b"\n".join(out)


def _identity_cmap() -> bytes:
    return b"/CMapName /U def 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"


def text_builder(text: str | None, how: str = "plain", filters: tuple[str, ...] = ()) -> Builder:
    b = Builder()
    lines = lines_of(text)
    if how == "type0":
        cmap = b.add(Stream({}, _identity_cmap()))
        child = b.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("U"), "DW": 500})
        b.objects[b.font.num] = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("U"), "Encoding": Name("Identity-H"), "DescendantFonts": [child], "ToUnicode": cmap}
    for at in range(0, max(1, len(lines)), LINES):
        content = page_content(lines[at : at + LINES], how)
        if how == "form":
            form = b.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 595, 842], "Resources": {"Font": {"F1": b.font}}}, content))
            b.page(b"q /X1 Do Q", resources={"XObject": {"X1": form}})
        else:
            b.page(content, filters=list(filters))
    return b


def text_pdf(text: str | None, how: str = "plain", filters: tuple[str, ...] = (), **options) -> bytes:
    return text_builder(text, how, filters).build(**options)


def encrypted(b: Builder, method: str, user: str, owner: str) -> bytes:
    from quire.kernels.crypto import encrypt

    return write(*encrypt(b.objects, b.trailer, method, user, owner))


def info_pdf(r: dict) -> bytes:
    b = text_builder(r["text"])
    b.trailer["Info"] = b.add({"Title": encode_text(f"Document {r['doc_id']}"), "Author": encode_text(r["source"] or ""), "Subject": encode_text(r["lang"] or "")})
    b.catalog["Lang"] = encode_text(r["lang"] or "")
    return b.build()


def dates_pdf(r: dict) -> bytes:
    b = Builder()
    b.page()
    b.trailer["Info"] = b.add({"CreationDate": Str(r["created"].encode()), "ModDate": Str(r["modified"].encode())})
    return b.build()


def geometry_pdf(r: dict) -> bytes:
    b = Builder()
    for row in r["rows"]:
        b.page(extra={"MediaBox": [0, 0, row["w"], row["h"]], "CropBox": [row["x"], row["y"], row["w"] + 5, row["h"] - 5], "Rotate": row["r"]})
    return b.build()


def labels_pdf(r: dict) -> bytes:
    b = Builder()
    nums: list = []
    for i, n in enumerate(r["nations"]):
        b.page()
        if i % 5 == 0:
            nums += [i, {"S": Name("DrRaA"[i // 5 % 5]), "P": encode_text(n["n_name"][:2] + "-"), "St": n["n_nationkey"] + 1}]
    b.catalog["PageLabels"] = {"Nums": nums}
    return b.build()


def outline_pdf(r: dict) -> bytes:
    """Bookmarks of a region: its nations, each to a page of its own."""
    b = Builder()
    nations = r["nations"]
    pages = [b.page() for _ in range(len(nations) + 1)]
    root = b.add({})
    top = b.add({})
    items = [b.add({}) for _ in nations]
    b.objects[root.num] |= {"Type": Name("Outlines"), "First": top, "Last": top, "Count": 1}
    b.objects[top.num] |= {"Title": encode_text(r["r_name"]), "Parent": root, "Dest": [pages[0], Name("Fit")], "Count": len(items)} | ({"First": items[0], "Last": items[-1]} if items else {})
    for i, (ref, n) in enumerate(zip(items, nations)):
        b.objects[ref.num] |= {"Title": encode_text(n["n_name"]), "Parent": top, "Dest": Str(n["n_name"].encode())} | ({"Next": items[i + 1]} if i + 1 < len(items) else {}) | ({"Prev": items[i - 1]} if i else {})
    b.catalog["Outlines"] = root
    names = sorted((n["n_name"].encode(), pages[i + 1]) for i, n in enumerate(nations))
    b.catalog["Names"] = {"Dests": {"Names": [x for k, p in names for x in (Str(k), [p, Name("Fit")])]}}
    return b.build()


def link_pdf(r: dict) -> bytes:
    b = Builder()
    first = b.page()
    uri = b.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [10, 30, 110, 20], "A": {"S": Name("URI"), "URI": Str((r["url"] or "").encode())}})
    goto = b.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [0, 0, 5, 5], "A": {"S": Name("GoTo"), "D": [first, Name("Fit")]}})
    b.page(extra={"Annots": [uri, goto]})
    return b.build()


def form_pdf(r: dict) -> bytes:
    """Fields of a customer: a parent that lends its type, texts, a choice."""
    b = Builder()
    b.page()
    parent = b.add({"T": encode_text("customer"), "FT": Name("Tx"), "Ff": 2})
    name = b.add({"T": encode_text("name"), "Parent": parent, "V": encode_text(r["c_name"])})
    key = b.add({"T": encode_text("key"), "Parent": parent, "V": encode_text(str(r["c_custkey"])), "Ff": 1})
    b.objects[parent.num]["Kids"] = [name, key]
    segment = b.add({"T": encode_text("segment"), "FT": Name("Ch"), "Ff": 1 << 17, "V": encode_text(r["c_mktsegment"]), "Opt": [encode_text(r["c_mktsegment"]), encode_text("OTHER")]})
    b.catalog["AcroForm"] = {"Fields": [parent, segment]}
    return b.build()


def attachment_pdf(r: dict) -> bytes:
    """A document's text as an attachment, listed in the name tree and by an annotation too."""
    b = Builder()
    data = (r["text"] or "").encode()
    stream = b.add(Stream({"Type": Name("EmbeddedFile"), "Subtype": Name("text/plain"), "Params": {"Size": len(data)}, "Filter": Name("FlateDecode")}, zlib.compress(data)))
    spec = b.add({"Type": Name("Filespec"), "F": encode_text(f"{r['doc_id']}.txt"), "EF": {"F": stream}, "Desc": encode_text(r["lang"] or "")})
    b.catalog["Names"] = {"EmbeddedFiles": {"Names": [Str(b"%d" % r["doc_id"]), spec]}}
    note = b.add({"Type": Name("Annot"), "Subtype": Name("FileAttachment"), "Rect": [0, 0, 9, 9], "FS": spec})
    b.page(extra={"Annots": [note]})
    return b.build()


def script_pdf(r: dict) -> bytes:
    b = text_builder(r["text"])
    script = {"S": Name("JavaScript"), "JS": Str(b"app.alert(1)")}
    b.catalog |= {"OpenAction": script, "Names": {"JavaScript": {"Names": [Str(b"a"), script]}}}
    b.trailer["Info"] = b.add({"Title": encode_text("t")})
    b.catalog["Metadata"] = b.add(Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, b"<x/>"))
    b.add({"Orphan": True})
    return b.build()


def image_pdf(r: dict) -> bytes:
    """A gray image whose rows are a vector's values, and one that is only declared."""
    b = Builder()
    data = bytes(r["pixels"])
    w = len(data)
    gray = b.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": w, "Height": 1, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8, "Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": w}}, zlib.compress(b"\x00" + data)))
    b.page(b"/I Do", resources={"XObject": {"I": gray}})
    b.page(b"/I Do", resources={"XObject": {"I": gray}})
    return b.build()


def photo_pdf(r: dict) -> bytes:
    """A smooth gray image of 200 rows, not compressed."""
    b = Builder()
    w = r["w"]
    data = bytes(x * 100 // w + y // 2 for y in range(200) for x in range(w))
    photo = b.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": w, "Height": 200, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}, data))
    b.page(b"/I Do", resources={"XObject": {"I": photo}})
    return b.build()


def updated_pdf(r: dict) -> bytes:
    """An object that later updates of the file define anew: the last value counts."""
    from quire.kernels.write import update

    b = Builder()
    b.page()
    ref = b.add({"Value": r["values"][0]})
    b.catalog["Last"] = ref
    data = bytearray(b.build())
    prev = int(data[data.rindex(b"startxref") + 9 :].split()[0])
    for v in r["values"][1:]:
        part = update(b"", {ref.num: {"Value": v}}, {"Root": b.root}, prev, max(b.objects) + 1, at=len(data))
        prev = len(data) + part.index(b"xref\n")
        data += part
    return bytes(data)


__all__ = ["Ref", "attachment_pdf", "text_builder", "text_pdf"]
