"""Rewrites of a document: plugins edit a table of its objects, and what is left is written as a new file.

A plugin is a callable ``plugin(edit)``. ``Edit`` holds the objects by number, the trailer and what was done; plugins run in
order and each sees what the ones before left. Object streams are written out as plain objects.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterable

from quire.kernels.document import Document, PdfEncryptedError, integer
from quire.kernels.read import Targets, label, page_labels
from quire.kernels.syntax import Name, Ref, Str, Stream, serialize, text_of
from quire.kernels.write import write


class Edit:
    def __init__(self, doc: Document):
        doc.readable()
        self.doc = doc
        self.objects: dict[int, object] = {n: doc.object(n) for n in doc.live()}
        self.top = max(self.objects, default=0)
        self.gens = {n: doc.index[n][2] for n in self.objects if doc.index[n][0] == "offset"}
        self.trailer = {k: doc.trailer[k] for k in ("Root", "Info") if isinstance(doc.trailer.get(k), Ref)}
        ids = doc.list(doc.trailer.get("ID"))
        if len(ids) == 2 and all(isinstance(doc.get(x), Str) for x in ids):
            self.trailer["ID"] = [doc.get(x) for x in ids]
        if "Encrypt" in doc.trailer and doc.security is None:
            raise PdfEncryptedError("document is encrypted")
        self.report: Counter = Counter()
        self.warnings: list[str] = []

    def get(self, v):
        for _ in range(16):
            if not isinstance(v, Ref):
                return v
            v = self.objects.get(v.num)
        return None

    def dict(self, v) -> dict:
        v = self.get(v)
        return v.dict if isinstance(v, Stream) else v if isinstance(v, dict) else {}

    def list(self, v) -> list:
        v = self.get(v)
        return v if isinstance(v, list) else []

    @property
    def catalog(self) -> dict:
        return self.dict(self.trailer.get("Root"))

    def put(self, ref, value) -> None:
        """Replace what a reference leads to."""
        while isinstance(self.objects.get(ref.num), Ref):
            ref = self.objects[ref.num]
        self.objects[ref.num] = value
        self.report["rewritten"] += 1

    def set(self, ref, **entries) -> None:
        """Set or (None) remove entries of a dictionary, keeping the order of the others."""
        v = self.get(ref)
        d = dict(self.dict(ref))
        for k, x in entries.items():
            if x is None:
                d.pop(k, None)
            else:
                d[k] = x
        self.put(ref, Stream(d, v.data) if isinstance(v, Stream) else d)

    def root(self, **entries) -> None:
        self.set(self.trailer["Root"], **entries)

    def add(self, value) -> Ref:
        self.top = num = self.top + 1
        self.objects[num] = value
        return Ref(num)

    def drop(self, num: int) -> None:
        if self.objects.pop(num, None) is not None:
            self.report["dropped"] += 1

    def pages(self) -> list[tuple[Ref, dict]]:
        out, stack, seen = [], [(self.catalog.get("Pages"), {})], set()
        while stack:
            ref, inherited = stack.pop()
            if not isinstance(ref, Ref) or ref.num in seen:
                continue
            seen.add(ref.num)
            d = self.dict(ref)
            now = inherited | {k: d[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in d}
            if isinstance(self.get(d.get("Kids")), list) and d.get("Type") != "Page":
                stack += [(k, now) for k in reversed(self.list(d["Kids"]))]
            elif d:
                out.append((ref, now))
        return out

    def reachable(self) -> set[int]:
        todo, seen = list(self.trailer.values()), set()
        while todo:
            v = todo.pop()
            if isinstance(v, Ref):
                if v.num in self.objects and v.num not in seen:
                    seen.add(v.num)
                    todo.append(self.objects[v.num])
            elif isinstance(v, Stream):
                todo.extend(v.dict.values())
            elif isinstance(v, dict):
                todo.extend(v.values())
            elif isinstance(v, list):
                todo.extend(v)
        return seen

    def bytes(self) -> bytes:
        self.report["objects"] = len(self.objects)
        return write(self.objects, self.trailer, version=max(self.doc.header, "1.4"), gens={n: g for n, g in self.gens.items() if n in self.objects})


Plugin = Callable[[Edit], None]


def rewrite(doc: Document, plugins: list[Plugin]) -> tuple[bytes, dict]:
    edit = Edit(doc)
    for plugin in plugins:
        plugin(edit)
    out = edit.bytes()
    return out, dict(edit.report) | {"bytes_in": len(doc.data), "bytes_out": len(out), "warnings": edit.warnings + doc.warnings}


def _each_dict(edit: Edit):
    """(number, value, dict) of every object that is a dictionary or a stream."""
    for num, v in list(edit.objects.items()):
        if isinstance(v, (dict, Stream)):
            yield num, v, v.dict if isinstance(v, Stream) else v


def strip_metadata(deep: bool = True) -> Plugin:
    """Information, XMP packets, private application data and thumbnails."""

    def run(edit: Edit) -> None:
        edit.trailer.pop("Info", None)
        for num, v, d in _each_dict(edit):
            gone = [k for k in ("PieceInfo", "LastModified", "Thumb") if k in d]
            if "Metadata" in d and (deep or d.get("Type") == "Catalog"):
                gone.append("Metadata")
            if gone:
                edit.report["metadata"] += len(gone)
                edit.set(Ref(num), **dict.fromkeys(gone))
        remove_unused()(edit)

    return run


def remove_javascript() -> Plugin:
    """Scripts in the name tree, in actions and what follows them, and in javascript: addresses."""

    def script(edit: Edit, a) -> bool:
        d = edit.dict(a)
        kind = edit.get(d.get("S"))
        uri = edit.get(d.get("URI"))
        return kind == "JavaScript" or kind == "URI" and isinstance(uri, Str) and uri.data.strip().lower().startswith(b"javascript:")

    def clean(edit: Edit, a, depth: int = 0):
        """The action without scripts; None where nothing is left."""
        v = edit.get(a)
        if isinstance(v, list):
            kept = [x for x in (clean(edit, x, depth + 1) for x in v) if x is not None]
            return kept or None
        if not isinstance(v, dict) or depth > 64:
            return a
        following = clean(edit, v["Next"], depth + 1) if "Next" in v else None
        if script(edit, v):
            edit.report["scripts"] += 1
            return following
        out = dict(v)
        if edit.get(v.get("S")) == "Rendition" and "JS" in out:
            out.pop("JS")
            edit.report["scripts"] += 1
        if "Next" in v:
            if following is None:
                out.pop("Next")
            else:
                out["Next"] = following
        if out == v:
            return a
        if isinstance(a, Ref):
            edit.put(a, out)
            return a
        return out

    def run(edit: Edit) -> None:
        names = edit.dict(edit.catalog.get("Names"))
        if "JavaScript" in names:
            edit.report["scripts"] += 1
            left = {k: v for k, v in names.items() if k != "JavaScript"}
            if isinstance(edit.catalog.get("Names"), Ref):
                edit.put(edit.catalog["Names"], left)
            else:
                edit.root(Names=left or None)
        for num, _, d in _each_dict(edit):
            changes = {}
            for key in ("OpenAction", "A", "PA"):
                if key in d and isinstance(edit.get(d[key]), dict):
                    new = clean(edit, d[key])
                    if new != d[key]:
                        changes[key] = new
            aa = edit.get(d.get("AA"))
            if isinstance(aa, dict):
                kept = {k: x for k, x in ((k, clean(edit, v)) for k, v in aa.items()) if x is not None}
                if kept != aa:
                    changes["AA"] = kept or None
            if "CO" in d and "Fields" in d:
                changes["CO"] = None
            if changes:
                edit.set(Ref(num), **changes)
        remove_unused()(edit)

    return run


def remove_attachments() -> Plugin:
    """Embedded files, attachment annotations with their popups, associated files and the collection."""

    def run(edit: Edit) -> None:
        names = edit.dict(edit.catalog.get("Names"))
        if "EmbeddedFiles" in names:
            edit.report["attachments"] += 1
            left = {k: v for k, v in names.items() if k != "EmbeddedFiles"}
            if isinstance(edit.catalog.get("Names"), Ref):
                edit.put(edit.catalog["Names"], left)
            else:
                edit.root(Names=left or None)
        if "Collection" in edit.catalog:
            edit.root(Collection=None)
        for ref, _ in edit.pages():
            annots = edit.list(edit.dict(ref).get("Annots"))
            bad = {a.num for a in annots if isinstance(a, Ref) and edit.dict(a).get("Subtype") == "FileAttachment"}
            kept = [a for a in annots if not (edit.dict(a).get("Subtype") == "FileAttachment" or isinstance(p := edit.dict(a).get("Parent"), Ref) and edit.dict(a).get("Subtype") == "Popup" and p.num in bad)]
            if len(kept) < len(annots):
                edit.report["attachments"] += len(bad)
                edit.set(ref, Annots=kept or None)
        for num, _, d in _each_dict(edit):
            if "AF" in d:
                edit.set(Ref(num), AF=None)
        remove_unused()(edit)

    return run


def rotate_pages(degrees) -> Plugin:
    """Turn pages by degrees (a multiple of 90), or by a function of page index and present rotation."""

    def run(edit: Edit) -> None:
        for i, (ref, inherited) in enumerate(edit.pages()):
            now = edit.get(inherited.get("Rotate"))
            now = int((now / 90) // 1 * 90) % 360 if isinstance(now, (int, float)) else 0
            turn = degrees(i, now) if callable(degrees) else degrees
            if turn % 90:
                raise ValueError("rotation must be a multiple of 90")
            if turn % 360:
                edit.set(ref, Rotate=(now + turn) % 360)

    return run


def select_pages(wanted: list[int]) -> Plugin:
    """Keep the pages wanted, in that order, each once; outlines, names, links, fields and labels follow."""

    def run(edit: Edit) -> None:
        found = edit.pages()
        if len(set(wanted)) < len(wanted):
            raise ValueError("a page is selected twice")
        if not wanted or not all(0 <= i < len(found) for i in wanted):
            raise ValueError("no such page")
        targets = Targets(edit.doc)
        old_labels = page_labels(edit.doc, len(found)) if "PageLabels" in edit.catalog else None
        kept_nums = {found[i][0].num for i in wanted}
        dead = {i for i in range(len(found)) if i not in set(wanted)}
        tree = {"Type": Name("Pages"), "Kids": [found[i][0] for i in wanted], "Count": len(wanted)}
        root = edit.add(tree)
        for i in wanted:
            ref, inherited = found[i]
            edit.set(ref, Parent=root, **{k: v for k, v in inherited.items() if k not in edit.dict(ref)})

        def gone(d: dict) -> bool:
            page, _ = targets.of(d)
            return page in dead

        for i in wanted:
            ref = found[i][0]
            annots = edit.list(edit.dict(ref).get("Annots"))
            kept = [a for a in annots if not (edit.dict(a).get("Subtype") == "Link" and gone(edit.dict(a)))]
            if len(kept) < len(annots):
                edit.report["links"] += len(annots) - len(kept)
                edit.set(ref, Annots=kept or None)
        changes: dict = {"Pages": root, "StructTreeRoot": None}
        if "OpenAction" in edit.catalog:
            a = edit.get(edit.catalog["OpenAction"])
            if gone({"Dest": a} if isinstance(a, list) else {"A": a}):
                changes["OpenAction"] = None
        names = edit.dict(edit.catalog.get("Names"))
        if "Dests" in names:
            live = [(k, v) for k, v in edit.doc.tree(names["Dests"], "Names") if targets.page(v) not in dead]
            changes["Names"] = {k: v for k, v in names.items() if k != "Dests"} | ({"Dests": {"Names": [x for k, v in live for x in (Str(k) if isinstance(k, bytes) else k, v)]}} if live else {})
        if "Dests" in edit.catalog:
            changes["Dests"] = {k: v for k, v in edit.dict(edit.catalog["Dests"]).items() if targets.page(v) not in dead}
        if old_labels is not None:
            nums: list = []
            for pos, i in enumerate(wanted):
                nums += [pos, {"P": Str((old_labels[i] if old_labels[i] is not None else str(i + 1)).encode("latin-1", "replace"))}]
            changes["PageLabels"] = {"Nums": _runs(edit, wanted, nums)}
        edit.root(**changes)
        if "Outlines" in edit.catalog:
            _prune_outline(edit, gone)
        form = edit.catalog.get("AcroForm")
        if form is not None:
            widgets = {a.num for i in dead for a in edit.list(edit.dict(found[i][0]).get("Annots")) if isinstance(a, Ref)}
            kept = [f for f in (_prune_field(edit, f, widgets, kept_nums, 0) for f in edit.list(edit.dict(form).get("Fields"))) if f is not None]
            new = dict(edit.dict(form)) | {"Fields": kept}
            if isinstance(form, Ref):
                edit.put(form, new)
            else:
                edit.root(AcroForm=new)
        edit.report["pages"] = len(wanted)
        remove_unused()(edit)

    return run


def _runs(edit: Edit, wanted: list[int], plain: list) -> list:
    """Label ranges for the new order: runs of one old range with consecutive numbers stay ranges."""
    ranges = sorted((k, edit.dict(v)) for k, v in edit.doc.tree(edit.doc.catalog.get("PageLabels"), "Nums") if isinstance(k, int))
    out: list = []
    before = None
    for pos, i in enumerate(wanted):
        start, d = next(((k, v) for k, v in reversed(ranges) if k <= i), (0, {"S": Name("D")}))
        first = integer(edit.get(d.get("St"))) or 1
        key = (start, first + i - start)
        if before != (start, key[1] - 1):
            out += [pos, {k: v for k, v in d.items() if k != "St"} | {"St": key[1]}]
        before = key
    return out or plain


def _prune_outline(edit: Edit, gone) -> None:
    root = edit.catalog["Outlines"]

    def children(ref) -> list:
        out, at, seen = [], edit.dict(ref).get("First"), set()
        while isinstance(at, Ref) and at.num not in seen:
            seen.add(at.num)
            out.append(at)
            at = edit.dict(at).get("Next")
        return out

    def walk(ref, depth: int) -> tuple[list, int]:
        kept, total = [], 0
        for child in children(ref) if depth < 64 else []:
            d = edit.dict(child)
            below, n = walk(child, depth + 1)
            if gone(d) and not below:
                edit.report["outline"] += 1
                continue
            kept.append(child)
            is_open = isinstance(edit.get(d.get("Count")), (int, float)) and edit.get(d["Count"]) > 0
            changes: dict = {"Parent": ref, "First": below[0] if below else None, "Last": below[-1] if below else None, "Count": (n if is_open else -n) if below else None}
            if gone(d):
                changes |= {"Dest": None, "A": None}
            edit.set(child, **changes)
            total += 1 + (n if is_open else 0)
        for i, child in enumerate(kept):
            edit.set(child, Prev=kept[i - 1] if i else None, Next=kept[i + 1] if i + 1 < len(kept) else None)
        return kept, total

    if isinstance(root, Ref):
        kept, n = walk(root, 0)
        if kept:
            edit.set(root, First=kept[0], Last=kept[-1], Count=n)
        else:
            edit.root(Outlines=None)


def _prune_field(edit: Edit, ref, widgets: set[int], pages: set[int], depth: int):
    d = edit.dict(ref)
    kids = edit.list(d.get("Kids"))
    if kids and depth < 64:
        kept = [k for k in (_prune_field(edit, k, widgets, pages, depth + 1) for k in kids) if k is not None]
        if not kept:
            return None
        if len(kept) < len(kids) and isinstance(ref, Ref):
            edit.set(ref, Kids=kept)
        return ref
    on = d.get("P")
    if isinstance(ref, Ref) and ref.num in widgets or isinstance(on, Ref) and d.get("Subtype") == "Widget" and on.num not in pages:
        edit.report["fields"] += 1
        return None
    return ref


def remove_unused() -> Plugin:
    """Objects that the trailer doesn't lead to."""

    def run(edit: Edit) -> None:
        live = edit.reachable()
        for num in [n for n in edit.objects if n not in live]:
            edit.drop(num)

    return run


def recompress_streams(least_saving: int = 21) -> Plugin:
    """Deflate streams that have no filter, where that is smaller."""

    def run(edit: Edit) -> None:
        for num, v, d in _each_dict(edit):
            if not isinstance(v, Stream) or d.get("Type") in ("XRef", "ObjStm", "Metadata") or edit.get(d.get("Filter")) not in (None, []) or "F" in d:
                continue
            small = zlib.compress(v.data, 9)
            if len(small) + least_saving < len(v.data):
                edit.report["recompressed"] += 1
                edit.report["bytes_saved"] += len(v.data) - len(small)
                edit.put(Ref(num), Stream({k: x for k, x in d.items() if k not in ("DecodeParms", "DL")} | {"Filter": Name("FlateDecode")}, small))

    return run


def repair_streams() -> Plugin:
    """Right lengths and stream ends: every stream is written anew from the data that was found."""

    def run(edit: Edit) -> None:
        for _, v, d in _each_dict(edit):
            if isinstance(v, Stream) and edit.get(d.get("Length")) != len(v.data):
                edit.report["repaired_streams"] += 1

    return run


def decrypt(doc: Document) -> tuple[bytes, dict]:
    """An unencrypted copy of a document that was opened with its password."""
    security = doc.security
    if security is None:
        raise PdfEncryptedError("document is not open with a password") if doc.encrypted else ValueError("document is not encrypted")
    edit = Edit(doc)
    if security.encrypt_num is not None:
        edit.drop(security.encrypt_num)
    for num, v, d in _each_dict(edit):
        names, _ = doc.filters_of(v) if isinstance(v, Stream) else ([], [])
        if "Crypt" in names:
            kept = [Name(n) for n in names if n != "Crypt"]
            edit.set(Ref(num), Filter=kept or None, DecodeParms=None)
    out = edit.bytes()
    return out, {"method": security.method, "which": security.which, "bytes_out": len(out)}


class Fragment:
    """What a document adds to a merged file: objects by their numbers there, and what the file's own objects have to tell."""

    def __init__(self, base: int):
        self.base, self.used = base, 0
        self.objects: dict[int, object] = {}
        self.pages: list[Ref] = []
        self.item: Ref | None = None  # of the outline
        self.names: list[str | None] = []  # fields as they were called
        self.fields: list[Ref] = []
        self.resources: dict[str, dict] = {}
        self.look, self.need = None, False
        self.computed: list[Ref] = []
        self.layers: list = []
        self.off: list = []
        self.labels: list[str | None] | None = None

    def fresh(self, value=None) -> Ref:
        num = self.base + self.used
        self.used += 1
        self.objects[num] = value
        return Ref(num)


CATALOG, TREE, OUTLINES, FIRST = 1, 2, 3, 4  # numbers in a merged file: its own objects, then those of the documents


def fragment(doc: Document, i: int, wanted: list[int] | None, base: int, rename: Callable[[int, str | None], str | None], keep: Callable[[str, str], bool]) -> Fragment:
    """Document ``i`` of a merged file, its numbers from ``base`` on. ``rename`` gives a field's name in the file by its place
    and own name, ``keep`` tells whether a resource of the form is the first of its name."""
    doc.readable()
    out = Fragment(base)
    found = doc.pages()
    chosen = wanted if wanted is not None else range(len(found))
    if not all(0 <= p < len(found) for p in chosen):
        raise ValueError("no such page")
    targets = Targets(doc)
    number: dict[int, int] = {}
    page_nums = {p["num"] for p in found}
    copies: dict[int, Ref] = {}  # page index -> its first copy
    todo: list[int] = []

    def moved(v):
        """A value with its references renumbered; destinations become explicit."""
        if isinstance(v, Ref):
            if v.num in page_nums:
                return copies.get(targets.page_of[v.num])
            if v.num not in number:
                number[v.num] = out.fresh().num
                todo.append(v.num)
            return Ref(number[v.num])
        if isinstance(v, list):
            return [moved(x) for x in v]
        if isinstance(v, dict):
            new = {k: moved(x) for k, x in v.items() if k not in ("Parent", "StructParent", "StructParents")}
            if "Dest" in v:
                page = targets.page(v["Dest"])
                if page in copies:
                    new["Dest"] = [copies[page], Name("Fit")]
                else:
                    new.pop("Dest")
            if v.get("S") == "GoTo":
                page = targets.page(v.get("D"))
                new["D"] = [copies[page], Name("Fit")] if page in copies else None
            return new
        if isinstance(v, Stream):
            return Stream(moved(v.dict), v.data)
        return v

    if chosen:
        out.item = out.fresh()
    for p in chosen:
        ref = out.fresh()
        copies.setdefault(p, ref)
        out.pages.append(ref)
    for p, ref in zip(chosen, out.pages):
        d = {k: v for k, v in found[p]["dict"].items() if k not in ("Parent", "B")}
        d = {k: found[p][k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in found[p]} | d
        out.objects[ref.num] = moved(d) | {"Type": Name("Page"), "Parent": Ref(TREE)}
    form = doc.dict(doc.catalog.get("AcroForm"))
    own_fields = doc.list(form.get("Fields"))
    called: list[tuple[Ref, str]] = []
    for f in own_fields:
        name = text_of(doc.get(doc.dict(f).get("T")))
        new = moved(f)
        if new is None:
            continue
        new = new if isinstance(new, Ref) else out.fresh(new)
        free = rename(len(out.fields), name)
        if free != name:
            called.append((new, free))
        out.names.append(name)
        out.fields.append(new)
    for kind, own in doc.dict(form.get("DR")).items():
        own = doc.get(own)
        if isinstance(own, dict):
            out.resources[kind] = {k: moved(x) for k, x in own.items() if keep(kind, k)}
    out.look = a if isinstance(a := doc.get(form.get("DA")), Str) else None
    out.need = doc.get(form.get("NeedAppearances")) is True
    oc = doc.dict(doc.catalog.get("OCProperties"))
    out.layers = [moved(x) for x in doc.list(oc.get("OCGs"))]
    out.off = [moved(x) for x in doc.list(doc.dict(oc.get("D")).get("OFF"))]
    if chosen:
        top = doc.dict(doc.catalog.get("Outlines"))
        title = text_of(doc.get(doc.dict(doc.trailer.get("Info")).get("Title"))) or f"Document {i + 1}"
        item = {"Title": title, "Dest": [out.pages[0], Name("Fit")], "Parent": Ref(OUTLINES)}
        first, seen, kids = top.get("First"), set(), []
        while isinstance(first, Ref) and first.num not in seen:
            seen.add(first.num)
            kids.append(first)
            first = doc.dict(first).get("Next")
        if kids:
            item |= {"First": moved(kids[0]), "Last": moved(kids[-1]), "Count": -len(kids)}
        out.objects[out.item.num] = item
    while todo:
        num = todo.pop()
        out.objects[number[num]] = moved(doc.object(num))
    out.computed = [Ref(number[x.num]) for x in doc.list(form.get("CO")) if isinstance(x, Ref) and x.num in number]
    below: set[int] = set()
    for f in own_fields:
        for x in doc.list(doc.dict(f).get("Kids")) if isinstance(f, Ref) and f.num in number else []:
            if isinstance(x, Ref) and x.num in number and x.num not in below and isinstance(out.objects[number[x.num]], dict):
                below.add(x.num)
                out.objects[number[x.num]]["Parent"] = Ref(number[f.num])
    for ref, name in called:
        if isinstance(out.objects[ref.num], dict):
            out.objects[ref.num]["T"] = name
    if "PageLabels" in doc.catalog:
        own = page_labels(doc, len(found))
        out.labels = [own[p] for p in chosen]
    return out


class FreeNames:
    """Names of fields that are not taken yet: name, name_2, name_3. Where the search for a name ended is remembered."""

    def __init__(self):
        self.taken: set[str] = set()
        self.after: dict[str, int] = {}

    def of(self, name: str | None) -> str | None:
        free = name
        if free in self.taken:
            n = self.after.get(name, 2)
            while (free := f"{name}_{n}") in self.taken:
                n += 1
            self.after[name] = n + 1
        if free is not None:
            self.taken.add(free)
        return free


def header() -> bytes:
    return write({}, {})[: write({}, {}).index(b"xref")]


def closing(start: int, offsets: array, pages: list[Ref], items: list[Ref], fields: list[Ref], resources: dict, look, need: bool, computed: list[Ref], layers: list, off: list, labels: list[tuple[int, str | None]]) -> tuple[bytes, dict[int, int]]:
    """The end of a merged file that begins at the byte ``start``: its own objects and the index; and where those objects are.
    ``offsets`` has a place for each number; those that are 0 are free."""
    catalog: dict = {"Type": Name("Catalog"), "Pages": Ref(TREE)}
    own: dict[int, object] = {CATALOG: catalog, TREE: {"Type": Name("Pages"), "Kids": pages, "Count": len(pages)}}
    if items:
        own[OUTLINES] = {"Type": Name("Outlines"), "First": items[0], "Last": items[-1], "Count": len(items)}
        catalog["Outlines"] = Ref(OUTLINES)
    if fields:
        catalog["AcroForm"] = {"Fields": fields} | ({"DR": resources} if resources else {}) | ({"DA": look} if look else {}) | ({"NeedAppearances": True} if need else {}) | ({"CO": computed} if computed else {})
    if layers:
        catalog["OCProperties"] = {"OCGs": layers, "D": {"Order": layers, "OFF": off}}
    if labels:
        catalog["PageLabels"] = {"Nums": [x for j, text in labels for x in (j, {"P": text if text is not None else str(j + 1)})]}
    out, mine = bytearray(), {}
    for num, value in own.items():
        mine[num] = len(out)
        out += b"%d 0 obj\n" % num + serialize(value) + b"\nendobj\n"
    at = start + len(out)
    for num, x in mine.items():
        offsets[num] = start + x
    out += b"xref\n0 %d\n0000000000 65535 f \n" % len(offsets)
    for first in range(1, len(offsets), 4096):
        out += b"".join([b"%010d 00000 n \n" % x if x else b"0000000000 00001 f \n" for x in offsets[first : first + 4096]])
    out += b"trailer\n" + serialize({"Size": len(offsets), "Root": Ref(CATALOG)}) + b"\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out), mine


def merge(documents: Iterable[Document], pages: list[list[int] | None] | None = None) -> tuple[bytes, dict]:
    """One document of the pages of several, in order; pages may repeat. Outlines, forms, layers and destinations follow.
    A document's objects are written before the next one is taken."""
    out, offsets = bytearray(header()), array("Q", bytes(8 * FIRST))
    all_pages, fields, computed, layers, off, labels = [], [], [], [], [], []
    resources: dict[str, dict] = {}
    look, need, base = None, False, FIRST
    items: list[tuple[Ref, dict]] = []
    names, report = FreeNames(), Counter()

    def put(num: int, value) -> None:
        if num >= len(offsets):
            offsets.frombytes(bytes(8 * (num + 1 - len(offsets))))
        offsets[num] = len(out)
        out.extend(b"%d 0 obj\n" % num + serialize(value) + b"\nendobj\n")

    def rename(_, name: str | None) -> str | None:
        free = names.of(name)
        if free != name:
            report["renamed_fields"] += 1
        return free

    for i, doc in enumerate(documents):
        f = fragment(doc, i, pages[i] if pages else None, base, rename, lambda kind, k: k not in resources.get(kind, {}))
        base += f.used
        if f.item is not None:
            items.append((f.item, f.objects.pop(f.item.num)))
        for num, value in f.objects.items():
            put(num, value)
        if f.labels is not None:
            labels += [(len(all_pages) + j, text) for j, text in enumerate(f.labels)]
        for kind, own in f.resources.items():
            resources.setdefault(kind, {}).update(own)
        look, need = look or f.look, need or f.need
        all_pages += f.pages
        fields += f.fields
        computed += f.computed
        layers += f.layers
        off += f.off
        report["inputs"] += 1
        report["pages"] += len(f.pages)
    for j, (ref, item) in enumerate(items):
        put(ref.num, item | ({"Prev": items[j - 1][0]} if j else {}) | ({"Next": items[j + 1][0]} if j + 1 < len(items) else {}))
    if fields:
        report["fields"] = len(fields)
    out += closing(len(out), offsets, all_pages, [ref for ref, _ in items], fields, resources, look, need, computed, layers, off, labels)[0]
    return bytes(out), dict(report) | {"bytes_out": len(out)}


__all__ = ["Edit", "FreeNames", "closing", "decrypt", "fragment", "header", "label", "merge", "recompress_streams", "remove_attachments", "remove_javascript", "remove_unused", "repair_streams", "rewrite", "rotate_pages", "select_pages", "strip_metadata"]
