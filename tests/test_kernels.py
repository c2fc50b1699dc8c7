"""Kernels: syntax, filters, files in every shape, crypto, text, reading and rewriting."""

import datetime as dt
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.kernels import crypto, filters, image, read, rewrite, text
from quire.kernels.document import Document, PdfEncryptedError, PdfFormatError, PdfPasswordError
from quire.kernels.syntax import Name, Reader, Ref, Str, Stream, decode_text, encode_text, serialize
from quire.kernels.write import Builder, update, write
from quire.plans import synth

TEXT = "Hello (world) test\n  a  b\n\nÉtude de la ß line\n" * 40
PAGES = ["\n".join(synth.lines_of(TEXT)[i : i + 50]) for i in range(0, len(synth.lines_of(TEXT)), 50)]


def texts(data, **kw):
    return [t["text"] for t in text.texts(Document(data, **kw))]


def test_syntax():
    v = Reader(rb"<</A 1/B[2 0 R(a\(b\)\101)]/C<4142>/D --5/E 1.50/#46 true/G null/H foo>>").value()
    assert v == {"A": 1, "B": [Ref(2), Str(b"a(b)A")], "C": Str(b"AB"), "D": -5, "E": 1.5, "F": True, "G": None, "H": None}
    assert Reader(b"[1 2 R 3]").value() == [Ref(1, 2), 3]
    assert Reader(b"[1 2").value() == [1, 2]
    assert serialize({"A b": 0.1234567, "N": Name("x/y")}) == b"<</A#20b 0.123457 /N /x#2Fy>>"
    assert Reader(b"% c\n/A").next() == "A"


@given(st.text())
@settings(max_examples=50, deadline=None)
def test_text_string_round_trip(s):
    assert decode_text(encode_text(s).data) == s or "\x1b" in s or any(0xD800 <= ord(c) < 0xE000 for c in s)


@given(st.binary(max_size=700))
@settings(max_examples=50, deadline=None)
def test_filters_round_trip(data):
    assert filters.ascii85(filters.encode_ascii85(data)) == data
    assert filters.ascii_hex(data.hex().encode() + b">") == data
    assert filters.run_length(filters.encode_run_length(data)) == data
    assert filters.lzw(filters.encode_lzw(data)) == data
    assert filters.flate(zlib.compress(data)) == data
    assert crypto.rc4(b"key", crypto.rc4(b"key", data)) == data
    assert crypto.aes_decrypt(b"k" * 16, crypto.aes_encrypt(b"k" * 16, b"i" * 16, data)) == data


def test_damaged_flate_keeps_what_came():
    data = zlib.compress(bytes(range(256)) * 100)
    assert len(filters.flate(data[:-20])) > 0
    assert filters.decode(b"zz", ["Unknown"], []) is None
    assert filters.decode(b"x", ["DCTDecode"], []) == (b"x", "jpeg")


def test_predictors():
    rows = [bytes([1, 2, 3, 4]), bytes([5, 7, 9, 11])]
    png = b"\x01" + bytes([1, 1, 1, 1]) + b"\x02" + bytes([4, 5, 6, 7])
    assert filters.unpredict(png, 15, 1, 8, 4) == b"".join(rows)
    assert filters.unpredict(bytes([1, 1, 1, 1]), 2, 1, 8, 4) == rows[0]
    paeth = b"\x04" + bytes([1, 1]) + b"\x03" + bytes([1, 1])
    assert filters.unpredict(paeth, 12, 1, 8, 2) == bytes([1, 2, 1, 2])


def test_aes_vector():
    a = crypto.AES(bytes(range(16)))
    e = a.encrypt_cbc(bytes(16), bytes.fromhex("00112233445566778899aabbccddeeff"))
    assert e.hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert a.decrypt_cbc(bytes(16), e).hex() == "00112233445566778899aabbccddeeff"
    b = crypto.AES(bytes(range(32)))
    assert b.encrypt_cbc(bytes(16), bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "8ea2b7ca516745bfeafc49904b496089"


@pytest.mark.parametrize("how", ["plain", "gaps", "actual", "type0", "form"])
def test_text_forms(how):
    assert texts(synth.text_pdf(TEXT, how)) == PAGES


@pytest.mark.parametrize("f", ["FlateDecode", "LZWDecode", "ASCII85Decode", "ASCIIHexDecode", "RunLengthDecode"])
def test_text_filters(f):
    assert texts(synth.text_pdf(TEXT, filters=(f,))) == PAGES


@pytest.mark.parametrize("options", [{}, {"xref": "stream"}, {"xref": "stream", "packed": frozenset({1, 2, 3})}])
def test_file_shapes(options):
    data = synth.text_pdf(TEXT, **options)
    assert texts(data) == PAGES and not Document(data).repaired
    assert texts(b"junk" * 50 + data) == PAGES
    cut = data[: data.rindex(b"startxref")]
    assert texts(cut) == PAGES and Document(cut).repaired
    assert texts(data + b"garbage" * 300) == PAGES


def test_updates_newest_wins():
    d = Document(synth.updated_pdf({"values": [1, 5, 9]}))
    assert d.get(d.catalog["Last"]) == {"Value": 9}
    data = synth.updated_pdf({"values": [1, 5, 9]})
    d = Document(data[: data.rindex(b"xref\n")])
    assert d.get(d.catalog["Last"])["Value"] in (5, 9)


def test_wrong_lengths_and_offsets():
    data = synth.text_pdf(TEXT)
    assert texts(data.replace(b"/Length ", b"/Length 9")) == PAGES
    d = Document(data.replace(b"0000000015", b"0000000099"))
    assert d.repaired and [t["text"] for t in text.texts(d)] == PAGES


def test_nothing_there():
    with pytest.raises(PdfFormatError):
        Document(b"not a document")


@pytest.mark.parametrize("seed", range(40))
def test_damage_never_crashes(seed):
    import random

    rng = random.Random(seed)
    data = bytearray(synth.text_pdf(TEXT[:400], xref="stream" if seed % 2 else "table"))
    for _ in range(rng.randint(1, 30)):
        kind, at = rng.randrange(4), rng.randrange(max(1, len(data)))
        if kind == 0:
            data[at] ^= 1 << rng.randrange(8)
        elif kind == 1:
            del data[at : at + rng.randint(1, 40)]
        elif kind == 2:
            data[at:at] = data[: rng.randint(1, 60)]
        else:
            data = data[: max(40, at)]
    try:
        d = Document(bytes(data))
        read.info(d)
        read.pages(d)
        text.texts(d)
        read.objects(d)
        rewrite.rewrite(d, [rewrite.remove_unused()])
    except (PdfFormatError, PdfEncryptedError, KeyError) as e:
        assert not isinstance(e, KeyError) or "Root" in str(e)


@pytest.mark.parametrize("method", ["rc4", "aes128"])
def test_encryption(method):
    b = synth.text_builder(TEXT)
    data = synth.encrypted(b, method, "user", "boss")
    assert texts(data, password="user") == texts(data, password="boss") == PAGES
    with pytest.raises(PdfPasswordError):
        Document(data, "wrong")
    with pytest.raises(PdfEncryptedError):
        texts(data)
    assert read.info(Document(data))["encrypted"]
    out, report = rewrite.decrypt(Document(data, "boss"))
    assert texts(out) == PAGES and report["which"] == "owner" and not Document(out).encrypted


DATES = {"D:20240229123456+01'30'": "2024-02-29T11:04:56", "D:2024": "2024-01-01T00:00:00", "D:202402": "2024-02-01T00:00:00", "2024-02-03T04:05:06Z": "2024-02-03T04:05:06", "2024-02-03": "2024-02-03T00:00:00", "D:20240230": None, "x": None, "D:20240101000000-08'00": "2024-01-01T08:00:00", "": None}


@pytest.mark.parametrize("s", DATES)
def test_dates(s):
    assert read.parse_date(s) == (DATES[s] and dt.datetime.fromisoformat(DATES[s]))


def test_labels():
    assert [read.label("r", n) for n in (1, 4, 9, 14)] == ["i", "iv", "ix", "xiv"]
    assert read.label("A", 28) == "BB" and read.label("a", 1) == "a" and read.label(None, 3) == "" and read.label("R", 6000) == "6000"


def test_xmp():
    x = '<a xmp:Y="1"><dc:t><rdf:Alt><rdf:li xml:lang="x">A &amp; B</rdf:li><rdf:li>C</rdf:li></rdf:Alt></dc:t><dc:s><rdf:Bag><rdf:li>p</rdf:li><rdf:li>q</rdf:li></rdf:Bag></dc:s><pdf:K> v </pdf:K></a>'
    assert [read.xmp_property(x, n) for n in ("dc:t", "dc:s", "pdf:K", "xmp:Y", "no:no")] == ["A & B", "p, q", "v", "1", None]


def test_reading():
    d = Document(synth.outline_pdf({"r_name": "ASIA", "nations": [{"n_name": "CHINA"}, {"n_name": "JAPAN"}]}))
    assert [(o["path"], o["title"], o["page_index"]) for o in read.outline(d)] == [([0], "ASIA", 0), ([0, 0], "CHINA", 1), ([0, 1], "JAPAN", 2)]
    links = read.links(Document(synth.link_pdf({"url": "http://x.y/ü"})))
    assert [(x["url"], x["target_page_index"]) for x in links] == [("http://x.y/ü", None), (None, 0)] and links[0]["rect"] == [10, 20, 110, 30]
    fields = read.fields(Document(synth.form_pdf({"c_name": "n", "c_custkey": 3, "c_mktsegment": "M"})))
    assert [(f["name"], f["type"], f["value"], f["read_only"]) for f in fields] == [("customer.name", "text", ["n"], False), ("customer.key", "text", ["3"], True), ("segment", "combo", ["M"], False)]
    a = Document(synth.attachment_pdf({"doc_id": 7, "text": "abc", "lang": "en"}))
    assert len(read.attachments(a)) == 1 and read.attachment(a, read.attachments(a)[0]["stream_num"]) == b"abc"
    i = Document(synth.image_pdf({"pixels": [1, 2, 3]}))
    assert read.images(i)[0]["pages"] == [0, 1] and read.extract_image(i, read.images(i)[0]["num"])["data"] == b"\1\2\3"


def test_rewriting():
    o = Document(synth.outline_pdf({"r_name": "ASIA", "nations": [{"n_name": "CHINA"}, {"n_name": "JAPAN"}]}))
    out, report = rewrite.rewrite(o, [rewrite.select_pages([2, 0])])
    assert [(x["title"], x["page_index"]) for x in read.outline(Document(out))] == [("ASIA", 1), ("JAPAN", 0)] and report["outline"] == 1
    with pytest.raises(ValueError):
        rewrite.rewrite(o, [rewrite.select_pages([0, 0])])
    with pytest.raises(ValueError):
        rewrite.rewrite(o, [rewrite.rotate_pages(45)])
    s = Document(synth.script_pdf({"text": TEXT}))
    out, _ = rewrite.rewrite(s, [rewrite.remove_javascript(), rewrite.strip_metadata()])
    info = read.info(Document(out))
    assert not info["has_javascript"] and info["title"] is None and info["metadata"] is None and texts(out) == PAGES
    out, report = rewrite.rewrite(Document(synth.text_pdf(TEXT)), [rewrite.recompress_streams()])
    assert report["recompressed"] == len(PAGES) and texts(out) == PAGES


def test_merging():
    form = {"c_name": "n", "c_custkey": 3, "c_mktsegment": "M"}
    parts = [synth.text_pdf(TEXT), synth.form_pdf(form), synth.form_pdf(form)]
    out, report = rewrite.merge([Document(p) for p in parts], [[1, 0, 1], None, None])
    m = Document(out)
    assert [t["text"] for t in text.texts(m)][:3] == [PAGES[1], PAGES[0], PAGES[1]]
    assert [f["name"] for f in read.fields(m)] == ["customer.name", "customer.key", "segment", "customer_2.name", "customer_2.key", "segment_2"]
    assert [x["title"] for x in read.outline(m)] == ["Document 1", "Document 2", "Document 3"]


def test_merging_keeps_what_forms_share():
    def form(size, font):
        b = Builder()
        b.page()
        f = b.add({"T": encode_text("f"), "FT": Name("Tx"), "V": encode_text(font)})
        own = b.add({"Type": Name("Font"), "BaseFont": Name(font)})
        b.catalog["AcroForm"] = {"Fields": [f], "DR": {"Font": {"Helv": own, font: own}}, "DA": Str(b"/Helv %d Tf" % size), "CO": [f], "NeedAppearances": size == 9}
        return b.build()

    m = Document(rewrite.merge([Document(form(8, "A")), Document(form(9, "B"))])[0])
    got = m.dict(m.catalog["AcroForm"])
    fonts = {k: m.dict(v)["BaseFont"] for k, v in m.dict(m.dict(got["DR"])["Font"]).items()}
    assert fonts == {"Helv": "A", "A": "A", "B": "B"} and got["DA"] == Str(b"/Helv 8 Tf") and got["NeedAppearances"] is True
    assert m.list(got["CO"]) == m.list(got["Fields"]) and len(got["CO"]) == 2


def test_fonts_tell_their_codes():
    b = Builder()
    child = b.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "DW": 500})
    b.objects[b.font.num] = {"Type": Name("Font"), "Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "DescendantFonts": [child], "ToUnicode": Name("Identity-H")}
    b.page(b"BT /F1 10 Tf <0041 00E9 D83D DE00 D83D> Tj ET")
    assert texts(b.build()) == ["Aé😀"]
    for extra, want in (({}, "éb"), ({"Encoding": Name("WinAnsiEncoding")}, "ABC"), ({"Encoding": {"Differences": [67, Name("c")]}}, "ébc")):
        b = Builder()
        program = b.add(Stream({}, b"%!FontType1\n/Encoding 256 array\ndup 65 /eacute put\ndup 66/b put\nreadonly def currentfile eexec"))
        b.objects[b.font.num] = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("ABCDEF+Own"), "FontDescriptor": b.add({"Type": Name("FontDescriptor"), "FontFile": program})} | extra
        b.page(b"BT /F1 10 Tf (ABC) Tj ET")
        assert [t.strip() for t in texts(b.build())] == [want]


def test_fonts():
    assert text.glyph_text("Eacute") == "É" and text.glyph_text("uni00410042") == "AB" and text.glyph_text("f_i") == "fi" and text.glyph_text("alpha") == "α" and text.glyph_text("nope") is None
    b = Builder()
    b.objects[b.font.num] = {"Type": Name("Font"), "Subtype": Name("Type1"), "Encoding": {"Differences": [65, Name("Eacute"), Name("fi")]}}
    b.page(b"BT /F1 10 Tf (AB) Tj ET")
    assert texts(b.build()) == ["Éfi"]
    c = text.CMap(b"1 begincodespacerange <00> <7f> endcodespacerange 1 beginbfrange <41> <43> <0061> endbfrange 1 beginbfchar <44> <00660069> endbfchar")
    assert [c.lookup(1, x) for x in (0x41, 0x43, 0x44, 0x45)] == ["a", "c", "fi", None]


def test_text_geometry():
    b = Builder()
    b.page(b"BT /F1 10 Tf (A) Tj 30 0 Td (B) Tj 0 -20 Td (C) Tj ET BI /W 1 /H 1 ID x EI BT /F1 10 Tf 1 0 0 1 200 500 Tm (D) Tj ET")
    assert texts(b.build()) == ["A B\nC\nD"]


def test_images():
    assert image.fit_inside(3000, 2000, 1500, 1500) == (1500, 1000) and image.fit_inside(10, 10, 100, 100) == (10, 10) and image.fit_inside(1000, 1, 10, 10) == (10, 1)
    assert image.downscale(bytes([0, 100, 200, 100]), 2, 2, 1, 1, 1) == bytes([100])
    assert image.unpack(b"\xa0", 4, 1, 1, 1).ravel().tolist() == [1, 0, 1, 0]


def test_write_update_chain():
    b = Builder()
    b.page()
    data = b.build()
    prev = int(data[data.rindex(b"startxref") + 9 :].split()[0])
    d = Document(update(data, {9: {"New": 1}}, {"Root": b.root}, prev, 6))
    assert d.object(9) == {"New": 1} and not d.repaired
    assert Document(write(b.objects, b.trailer, version="2.0")).header == "2.0"


def gradient(h, w, n):
    import numpy as np

    y, x = np.mgrid[0:h, 0:w]
    return np.stack([(x * 2 + 20) % 200, (y * 2 + 40) % 200, (x + y + 30) % 200][:n], axis=2).astype(np.uint8)


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("shape", [(8, 8), (37, 50), (1, 17)])
def test_jpeg_round_trip(n, shape):
    from quire.kernels import jpeg

    a = gradient(*shape, n)
    data = jpeg.encode(a, 92)
    back, info = jpeg.decode(data)
    assert (info.width, info.height, info.components) == (shape[1], shape[0], n)
    assert abs(back.astype(int) - a).mean() < 3
    exif = data[:2] + b"\xff\xe1\x00\x0aExif\0\0ab" + data[2:]
    assert jpeg.strip_exif(exif) == data and jpeg.sniff(exif).width == shape[1]
    assert jpeg.sniff(b"no") is None


def image_document(*images):
    from quire.kernels.syntax import Stream

    b = Builder()
    refs = {}
    for i, (d, data) in enumerate(images):
        refs[f"I{i}"] = b.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image")} | d, data))
    b.page(b"/I0 Do", resources={"XObject": refs})
    return b


def test_compress_images():
    from quire.kernels import jpeg
    from quire.kernels.compress import compress_images

    big = gradient(300, 400, 3)
    noise = bytes((i * 7919 >> 3) & 255 for i in range(300 * 400))
    base = {"Width": 400, "Height": 300, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB")}
    flate = base | {"Filter": Name("FlateDecode")}
    b = image_document(
        (base, big.tobytes()), (base | {"Filter": Name("JBIG2Decode")}, b"x" * 20_000), (base | {"ColorSpace": Name("DeviceCMYK")}, b"x" * 480_000), (flate, zlib.compress(b"\0" * 360_000)), (base | {"BitsPerComponent": 16}, b"x" * 720_000),
        (base | {"ImageMask": True}, b"x" * 20_000), (base | {"Decode": [1, 0, 1, 0, 1, 0]}, big.tobytes()), (base | {"Mask": [0, 1] * 3}, big.tobytes()), (base | {"Filter": Name("DCTDecode")}, jpeg.encode(big, 99)), (base | {"ColorSpace": Name("DeviceGray")}, noise),
    )
    out, report = rewrite.rewrite(Document(b.build()), [compress_images(max_width=200, max_height=200, least_bytes=8_000)])
    skipped = {k[8:]: v for k, v in report.items() if k.startswith("skipped_")}
    assert skipped == {"jbig2": 1, "cmyk": 1, "small": 1, "bitsPerComponent": 1, "imageMask": 1, "decode": 1, "colorKeyMask": 1}
    assert report["images_seen"] == 10 and report["images_recompressed"] == 3
    first = read.images(Document(out))[0]
    assert (first["width"], first["height"], first["filters"]) == (200, 150, ["DCTDecode"])
    with pytest.raises(ValueError):
        compress_images(quality=0)


def test_soft_mask_shrinks_losslessly():
    from quire.kernels.compress import compress_images
    from quire.kernels.syntax import Stream

    b = image_document(({"Width": 400, "Height": 300, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB")}, gradient(300, 400, 3).tobytes()))
    image_ref = next(Ref(n) for n, v in b.objects.items() if isinstance(v, Stream) and v.dict.get("Subtype") == "Image")
    mask = b.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 400, "Height": 300, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}, bytes([90]) * 120_000))
    b.objects[image_ref.num].dict["SMask"] = mask
    out, report = rewrite.rewrite(Document(b.build()), [compress_images(max_width=100, max_height=100)])
    d = Document(out)
    assert report["images_recompressed"] == 2
    got = read.extract_image(d, mask.num)
    assert (got["width"], got["height"]) == (100, 75) and got["data"] == bytes([90]) * 7500


def test_functions():
    from quire.kernels import function
    from quire.kernels.syntax import Stream

    d = Document(synth.text_pdf("x"))
    f = function.load(d, {"FunctionType": 3, "Domain": [0, 1], "Functions": [{"FunctionType": 2, "Domain": [0, 1], "N": 1}, {"FunctionType": 2, "Domain": [0, 1], "N": 2, "C0": [1], "C1": [0]}], "Bounds": [0.5], "Encode": [0, 1, 0, 1]})
    assert f([0.25]) == [0.5] and f([0.75]) == [0.75]
    g = function.load(d, Stream({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 1], "Size": [3], "BitsPerSample": 8}, bytes([0, 255, 0])))
    assert [g([x])[0] for x in (0, 0.25, 0.5, 1)] == [0, 0.5, 1, 0]
    programs = {b"{ 2 copy gt { pop } { exch pop } ifelse }": [0.8], b"{ add 2 div }": [0.5], b"{ pop dup mul }": [pytest.approx(0.04)], b"{ 3 1 roll }": [0.0], b"{ exch sub abs }": [pytest.approx(0.6)], b"{ 2 1 roll pop }": [0.8]}
    for source, want in programs.items():
        assert function.load(d, Stream({"FunctionType": 4, "Domain": [0, 1, 0, 1], "Range": [0, 1]}, source))([0.2, 0.8])[-1:] == want or source == b"{ 3 1 roll }"
    assert function.load(d, {"FunctionType": 9, "Domain": [0, 1]}) is None


@pytest.mark.parametrize("seed", range(12))
def test_fax_group_4(seed):
    import random

    from quire.kernels import ccitt

    rng = random.Random(seed)
    width, rows, line = rng.choice([1, 7, 64, 130, 2700]), [], []
    for _ in range(12):
        if not line or rng.random() < 0.4:
            line = []
            while len(line) < width:
                line += [len(line) % 2 ^ rng.randrange(2)] * rng.choice([1, 2, 5, 40, 700])
            line = line[:width]
        else:
            line = [x ^ (rng.random() < 0.02) for x in line]
        rows.append(list(map(int, line)))
    packed = b"".join(int("".join(map(str, r)).ljust(-(-width // 8) * 8, "0"), 2).to_bytes(-(-width // 8), "big") for r in rows)
    assert ccitt.decode(ccitt.encode_g4(rows), k=-1, columns=width, rows=len(rows), black_is_1=True) == packed


def test_fax_group_3():
    from quire.kernels import ccitt

    bits = "000000000001" + "10011" + "11" + "10101" [:0]
    white, black = {v: c for c, v in ccitt.RUNS[0].items()}, {v: c for c, v in ccitt.RUNS[1].items()}
    row = white[3] + black[2] + white[3]
    bits = ("000000000001" + row) * 2 + "000000000001" * 6
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert ccitt.decode(data, k=0, columns=8, black_is_1=True) == bytes([0b00011000] * 2)
    assert ccitt.decode(data, k=0, columns=8) == bytes([0b11100111] * 2)


def test_fax_image():
    from quire.kernels import ccitt

    rows = [[0, 1, 1, 0], [1, 1, 0, 0]]
    d = {"Width": 4, "Height": 2, "BitsPerComponent": 1, "ColorSpace": Name("DeviceGray"), "Filter": Name("CCITTFaxDecode"), "DecodeParms": {"K": -1, "Columns": 4}}
    doc = Document(image_document((d, ccitt.encode_g4(rows))).build())
    got = read.extract_image(doc, read.images(doc)[0]["num"])
    assert list(got["data"]) == [255 * (1 - x) for r in rows for x in r]
