"""Scalar functions as Column expressions: dates, labels, ranges, boxes, text and image eligibility. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.kernels.syntax import PDFDOC


def pdf_date(s: Column) -> Column:
    """``D:YYYYMMDDHHmmSS+HH'mm'`` (later parts may be missing) or ISO 8601, as UTC; null where it is no date."""
    iso = r"^\s*(\d{4})-(\d\d)(?:-(\d\d))?(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.\d+)?)?)?\s*(?:([Zz+\-])(?:(\d\d):?(\d\d)?)?)?\s*$"
    own = r"^\s*(?:D:)?(\d{4})(?:(\d\d)(?:(\d\d)(?:(\d\d)(?:(\d\d)(?:(\d\d))?)?)?)?)?\s*(?:([Zz+\-])(?:(\d\d)'?(?:(\d\d)'?)?)?)?"

    # each pattern is matched once: its groups as a list behind a mark
    mark = "\ue000"
    groups = mark + "".join(f"|${i}" for i in range(1, 10))
    found = F.split(F.when(s.rlike(iso), F.regexp_replace(s, iso, groups)).otherwise(F.regexp_replace(s, own + r"[\s\S]*$", groups)), "\\|")

    def build(parts: Column) -> Column:
        part = lambda i, default: F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(default))
        at = F.try_make_timestamp_ntz(part(1, 0), part(2, 1), part(3, 1), part(4, 0), part(5, 0), part(6, 0).cast("decimal(8,6)"))
        sign = F.get(parts, F.lit(7))
        minutes = (part(8, 0) * 60 + part(9, 0)) * F.when(sign == "+", -1).when(sign == "-", 1).otherwise(0)
        return F.when((F.get(parts, F.lit(0)) == mark) & (F.size(parts) == 10), at + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0)))

    return F.transform(F.array(found), build)[0]


def roman(n: Column) -> Column:
    """Lower-case Roman numeral of 1 to 5000."""
    table = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
    parts, left = [], n
    for value, sign in table:
        parts.append(F.repeat(F.lit(sign), F.floor(left / value).cast("int")))
        left = left % value
    return F.concat(*parts)


def page_label(style: Column, prefix: Column, n: Column) -> Column:
    """Label of the n-th page of a range: style D, R, r, A, a, or null for the prefix alone."""
    letters = F.repeat(F.char(F.lit(65) + (n - 1) % 26), F.floor((n - 1) / 26).cast("int") + 1)
    number = F.when(style.isNull(), F.lit("")).when((style == "D") | (n > 5000), n.cast("string")).when(style == "r", roman(n)).when(style == "R", F.upper(roman(n))).when(style == "A", letters).when(style == "a", F.lower(letters)).otherwise(n.cast("string"))
    return F.concat(F.coalesce(prefix, F.lit("")), number)


def page_ranges(spec: Column, count: Column, *, backwards: bool = False) -> Column:
    """``1-3,5,7-`` to page indices from 0; null where it is no range list. ``backwards`` also takes 5-2; blank is all."""

    def one(p: Column) -> Column:
        a, b = F.regexp_extract(p, r"^\s*(\d*)", 1), F.regexp_extract(p, r"-\s*(\d*)\s*$", 1)
        low = F.when(a == "", F.lit(1)).otherwise(a.cast("int"))
        high = F.when(~F.contains(p, F.lit("-")), low).when(b == "", count).otherwise(b.cast("int"))
        good = p.rlike(r"^\s*(\d+|\d+\s*-\s*\d*|-\s*\d+)\s*$") & (low >= 1) & (high >= 1) & (low <= count) & (high <= count)
        if not backwards:
            good = good & (low <= high)
        return F.when(good, F.sequence(low - 1, high - 1))

    parts = F.transform(F.split(F.regexp_replace(spec, "\\s*(?:–|to)\\s*", "-"), ","), one)
    found = F.when(~F.exists(parts, lambda x: x.isNull()), F.flatten(parts))
    return F.when(F.trim(spec) == "", F.sequence(F.lit(0), count - 1)).otherwise(found) if backwards else found


def fit_inside(width: Column, height: Column, most_width, most_height) -> Column:
    """(width, height) that fits and keeps the aspect: never larger, halves up, at least 1."""
    s = F.least(F.lit(1.0), most_width / width, most_height / height)
    side = lambda x: F.greatest(F.lit(1), F.floor(x * s + 0.5)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def rotation(r: Column) -> Column:
    return F.pmod(r, F.lit(360))


def page_box(media: Column, crop: Column) -> Column:
    """Crop box cut to the media box; the media box where there is none or they don't meet."""
    m = [F.least(media[0], media[2]), F.least(media[1], media[3]), F.greatest(media[0], media[2]), F.greatest(media[1], media[3])]
    c = [F.greatest(F.least(crop[0], crop[2]), m[0]), F.greatest(F.least(crop[1], crop[3]), m[1]), F.least(F.greatest(crop[0], crop[2]), m[2]), F.least(F.greatest(crop[1], crop[3]), m[3])]
    return F.when(crop.isNotNull() & (c[2] > c[0]) & (c[3] > c[1]), F.array(*c)).otherwise(F.array(*m))


def xmp_property(xmp: Column, name: str) -> Column:
    """A simple element or attribute of an XMP packet, unescaped."""
    element = F.regexp_extract(xmp, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>", 1)
    items = F.regexp_extract_all(element, F.lit(r"(?s)<rdf:li(?:\s[^>]*)?>(.*?)</rdf:li\s*>"), F.lit(1))
    joined = F.when(F.contains(element, F.lit("<rdf:Alt")), items[0]).otherwise(F.array_join(items, ", "))
    attribute = F.regexp_extract(xmp, rf"\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    found = F.when(F.size(items) > 0, joined).when(element != "", F.trim(F.regexp_replace(element, "<[^>]*>", ""))).when(attribute != "", attribute)
    return unescape_xml(found)


def unescape_xml(s: Column) -> Column:
    """The five named entities and numeric ones, each once: what an entity gives is not read again."""

    def one(piece: Column) -> Column:
        entity = F.regexp_extract(piece, "^&(#[xX][0-9A-Fa-f]{1,6}|#[0-9]{1,7}|lt|gt|quot|apos|amp);", 1)
        code = F.when(F.lower(entity).startswith("#x"), F.conv(F.substr(entity, F.lit(3)), 16, 10)).when(entity.startswith("#"), F.substr(entity, F.lit(2))).cast("int")
        known = F.when(entity == "lt", "<").when(entity == "gt", ">").when(entity == "quot", '"').when(entity == "apos", "'").when(entity == "amp", "&")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.coalesce(known, F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        return F.when(char.isNull(), piece).otherwise(F.concat(char, F.substr(piece, F.length(entity) + 3)))

    return F.array_join(F.transform(F.split(s, "(?=&)"), one), "")


def decode_text(b: Column) -> Column:
    """Text strings in UTF-16 or UTF-8 by their mark; others in PDFDocEncoding."""
    head = F.hex(F.substring(b, 1, 3))
    utf16 = F.decode(F.substr(b, F.lit(3)), "UTF-16BE")
    little = F.decode(F.substr(b, F.lit(3)), "UTF-16LE")
    own = F.translate(F.decode(b, "ISO-8859-1"), "".join(map(chr, PDFDOC)), "".join(PDFDOC.values()))
    return F.when(head.startswith("FEFF"), utf16).when(head.startswith("FFFE"), little).when(head == "EFBBBF", F.decode(F.substr(b, F.lit(4)), "UTF-8")).otherwise(own)


def encode_text(s: Column) -> Column:
    """Syntax of a text string: a literal for ASCII, else hexadecimal UTF-16."""
    literal = F.concat(F.lit("("), F.regexp_replace(s, r"([\\()])", r"\\$1"), F.lit(")"))
    return F.when(s.rlike("^[ -~]*$"), literal).otherwise(F.concat(F.lit("<FEFF"), F.hex(F.encode(s, "UTF-16BE")), F.lit(">")))


def clean_text(s: Column) -> Column:
    """White space to blanks, controls and invisible characters out, ligatures apart."""
    s = F.regexp_replace(s, r"\s", " ")
    s = F.regexp_replace(s, "[\\x00-\\x1f\\x7f-\\x9f\\u200b-\\u200f\\u2060\\ufeff\\ue000-\\uf8ff\\u00ad]", "")
    for one, two in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        s = F.replace(s, F.lit(one), F.lit(two))
    return s


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Plain conversion of components from 0 to 1."""
    side = lambda x: F.floor(255 * (1 - x) * (1 - k) + 0.5).cast("int")
    return F.array(side(c), side(m), side(y))


def skip_reason(image: Column, *, least_bytes: int = 16384) -> Column:
    """Why an image row is not recompressed, null if it may be. The first reason that holds counts."""
    f = F.coalesce(image["filters"], F.array())
    cs = F.coalesce(image["color_space"], F.lit(""))
    last = F.element_at(f, F.lit(-1))
    known = F.forall(f, lambda x: x.isin("FlateDecode", "Fl", "DCTDecode", "DCT", "LZWDecode", "LZW", "ASCII85Decode", "A85", "ASCIIHexDecode", "AHx", "RunLengthDecode", "RL"))
    return (
        F.when(F.coalesce(image["image_mask"], F.lit(False)), "imageMask")
        .when((F.size(f) > 0) & (last == "JBIG2Decode"), "jbig2")
        .when((F.size(f) > 0) & last.isin("CCITTFaxDecode", "CCF"), "ccitt")
        .when((F.size(f) > 0) & (last == "JPXDecode"), "jpx")
        .when(~known, "filter")
        .when(image["encoded_bytes"] < least_bytes, "small")
        .when(F.coalesce(image["bits_per_component"], F.lit(0)) != 8, "bitsPerComponent")
        .when(image["width"].isNull() | image["height"].isNull() | (image["width"] < 1) | (image["height"] < 1), "dimensions")
        .when(cs == "", "noColorSpace")
        .when(cs.startswith("Indexed"), "indexed")
        .when(cs.startswith("Separation"), "separation")
        .when(cs.startswith("DeviceN"), "deviceN")
        .when(cs.isin("DeviceCMYK", "ICCBased(CMYK)"), "cmyk")
        .when(cs == "Lab", "lab")
        .when(~cs.isin("DeviceGray", "DeviceRGB", "ICCBased(Gray)", "ICCBased(RGB)", "CalGray"), "colorSpace")
        .when(image["width"].cast("long") * image["height"] > (1 << 29), "tooLarge")
    )
