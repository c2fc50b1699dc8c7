"""Recompressing images: which may be, why others may not, and the plugin that does it."""

from __future__ import annotations

import zlib

import numpy as np

from quire.kernels import image, jpeg
from quire.kernels.document import integer
from quire.kernels.filters import SHORT
from quire.kernels.rewrite import Edit, Plugin
from quire.kernels.syntax import Name, Ref, Stream

SAMPLES = 1 << 29
#: filters that end in another image codec, with the reason they give
OTHER = {"JBIG2Decode": "jbig2", "CCITTFaxDecode": "ccitt", "JPXDecode": "jpx"}


def components(edit: Edit, v) -> int | str:
    """1 or 3 for a gray or RGB color space, else the reason."""
    v = edit.get(v)
    if v is None:
        return "noColorSpace"
    head = edit.get(v[0]) if isinstance(v, list) and v else v
    head = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}.get(str(head), str(head))
    if head in ("DeviceGray", "CalGray"):
        return 1
    if head == "DeviceRGB":
        return 3
    if head == "ICCBased" and isinstance(v, list) and len(v) > 1:
        n = edit.get(edit.dict(v[1]).get("N"))
        return n if n in (1, 3) else "cmyk" if n == 4 else "colorSpace"
    return {"DeviceCMYK": "cmyk", "Indexed": "indexed", "Separation": "separation", "DeviceN": "deviceN", "Lab": "lab"}.get(head, "colorSpace")


def reason(edit: Edit, s: Stream, least_bytes: int, is_mask: bool) -> str | None:
    """Why an image is left as it is; None if it may be recompressed. The first reason that holds counts."""
    d = s.dict
    if edit.get(d.get("ImageMask")) is True:
        return "imageMask"
    if "F" in d:
        return "external"
    f = edit.get(d.get("Filter"))
    names = [SHORT.get(n, n) for n in (str(edit.get(x)) for x in (f if isinstance(f, list) else [f] if f is not None else []))]
    names = ["DCTDecode" if n == "DCT" else "CCITTFaxDecode" if n == "CCF" else n for n in names]
    found = next((OTHER[n] for n in names if n in OTHER), None)
    if found:
        return found
    if names not in ([], ["FlateDecode"], ["DCTDecode"], ["FlateDecode", "DCTDecode"]):
        return "filter"
    if len(s.data) < least_bytes:
        return "small"
    if edit.get(d.get("BitsPerComponent")) != 8:
        return "bitsPerComponent"
    w, h = integer(edit.get(d.get("Width"))), integer(edit.get(d.get("Height")))
    if not w or not h or w < 1 or h < 1:
        return "malformed"
    n = components(edit, d.get("ColorSpace"))
    if is_mask and (n != 1 or "DCTDecode" in names):
        return "softMask"
    if isinstance(n, str):
        return n
    if w * h * n > SAMPLES:
        return "tooLarge"
    decode = edit.get(d.get("Decode"))
    if decode is not None and [edit.get(x) for x in edit.list(decode)] != [0, 1] * n:
        return "decode"
    if isinstance(edit.get(d.get("Mask")), list):
        return "colorKeyMask"
    if is_mask and "Matte" in d or "Matte" in edit.dict(d.get("SMask")):
        return "matte"
    if "DCTDecode" in names:
        raw = edit.doc.decode_image(s)
        info = jpeg.sniff(raw[0]) if raw else None
        if info is None:
            return "jpegInvalid"
        if info.components == 4:
            return "cmyk"
        if info.bits != 8 or info.sof not in (0, 1):
            return "jpegUnsupported"
        if (info.components, info.width, info.height) != (n, w, h):
            return "jpegMismatch"
        if n == 3 and (info.adobe == 0 or info.adobe is None and info.rgb_ids):
            return "jpegTransform"
    else:
        parms = edit.doc.filters_of(s)[1]
        p = parms[0] if parms else {}
        if p.get("Predictor", 1) not in (1, 2, *range(10, 16)) or p.get("Predictor", 1) > 1 and (p.get("Colors", 1) != n or p.get("Columns", 1) != w or p.get("BitsPerComponent", 8) != 8):
            return "predictor"
    return None


def compress_images(*, max_width: int = 1600, max_height: int = 1600, quality: float = 0.75, least_bytes: int = 16_384, ratio: float = 0.95, preserve_gray: bool = True) -> Plugin:
    """Recompress images as JPEG, no larger than a box, where it saves; soft masks shrink with them, losslessly.

    The report counts ``images_seen``, ``images_recompressed``, ``bytes_saved`` and ``skipped_<reason>``.
    """
    if max_width < 1 or max_height < 1 or not 0 < quality <= 1 or ratio <= 0:
        raise ValueError("sizes must be 1 or more, quality in (0, 1], ratio above 0")

    def run(edit: Edit) -> None:
        found = {n: v for n, v in edit.objects.items() if isinstance(v, Stream) and edit.get(v.dict.get("Subtype")) == "Image"}
        masks = {v.dict["SMask"].num for v in found.values() if isinstance(v.dict.get("SMask"), Ref)}
        for num, s in found.items():
            edit.report["images_seen"] += 1
            why = reason(edit, s, least_bytes, num in masks)
            if why is None:
                why = _one(edit, num, s, num in masks)
            if why:
                edit.report[f"skipped_{why}"] += 1
            else:
                edit.report["images_recompressed"] += 1

    def _one(edit: Edit, num: int, s: Stream, is_mask: bool) -> str | None:
        d = s.dict
        w, h, n = integer(edit.get(d["Width"])), integer(edit.get(d["Height"])), components(edit, d.get("ColorSpace"))
        got = edit.doc.decode_image(s)
        if got is None:
            return "error"
        data, codec = got
        if codec == "jpeg":
            try:
                decoded = jpeg.decode(data)
            except (ValueError, IndexError, KeyError):
                decoded = None
            if decoded is None:
                return "error"
            samples = decoded[0]
        elif len(data) < w * h * n:
            return "error"
        else:
            samples = np.frombuffer(data[: w * h * n], np.uint8).reshape(h, w, n)
        to = image.fit_inside(w, h, max_width, max_height)
        if to != (w, h):
            samples = np.frombuffer(image.downscale(samples.tobytes(), w, h, n, *to), np.uint8).reshape(to[1], to[0], n)
        if is_mask:
            rows = np.diff(samples.reshape(to[1], to[0]), axis=0, prepend=np.zeros((1, to[0]), np.uint8))
            new = zlib.compress(np.hstack([np.full((to[1], 1), 2, np.uint8), rows.astype(np.uint8)]).tobytes(), 9)
            extra = {"Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 15, "Columns": to[0]}}
        else:
            if not preserve_gray and n == 1:
                samples, n = np.repeat(samples, 3, axis=2), 3
            new = jpeg.encode(samples, max(1, round(quality * 100)))
            extra = {"Filter": Name("DCTDecode")}
        if len(new) > len(s.data) * ratio:
            return "noGain"
        kept = {k: v for k, v in d.items() if k not in ("Decode", "DL", "DecodeParms", "Filter", "Length")}
        kept |= {"Width": to[0], "Height": to[1], "ColorSpace": Name("DeviceGray" if n == 1 else "DeviceRGB")} | extra
        edit.report["bytes_saved"] += len(s.data) - len(new)
        edit.put(Ref(num), Stream(kept, new))
        return None

    return run
