"""Work that must not grow faster than the input: counted, not timed, where that can be."""

import time
import types

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from quire.kernels import filters, text
from quire.kernels.document import Document
from quire.operators import rewrites, tables
from quire.plans import synth
from quire.sources import pdf

WORDS = " ".join(f"word{i}" for i in range(300))


class Rows:
    """Stands for a DataFrame: gives the function that mapInArrow would run."""

    def __init__(self, ddl: str):
        self.schema = T.StructType.fromDDL(ddl)
        self.columns = self.schema.names

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def documents(n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"id": list(range(n)), "content": [synth.text_pdf(f"a{i}") if i != 3 else None for i in range(n)]}, schema=pa.schema([("id", pa.int64()), ("content", pa.binary())]))


@pytest.mark.parametrize("how", ["type0", "gaps"])
def test_a_line_is_drawn_in_one_go(monkeypatch, how):
    """glyphs of composite fonts and of arrays were looked at one by one."""
    drawn = []
    glyph = text.TextPage.glyph
    monkeypatch.setattr(text.TextPage, "glyph", lambda self, *a: drawn.append(a) or glyph(self, *a))
    lines = [WORDS] * 20
    assert text.texts(Document(synth.text_pdf("\n".join(lines), how))) == [{"page_index": 0, "text": "\n".join(lines)}]
    assert len(drawn) <= 2 * len(lines)


def test_lzw_is_not_decoded_by_the_byte():
    """2 MB took about 3 seconds, and 0.1 since."""
    data = WORDS.encode() * 1000
    began = time.process_time()
    assert filters.lzw(filters.encode_lzw(data)) == data
    assert time.process_time() - began < 1.5


def test_lzw_with_entries_of_its_table():
    codes, widths = [256, 65, 258, 259, 66, 260, 257], [9] * 7
    bits = "".join(f"{c:0{w}b}" for c, w in zip(codes, widths))
    assert filters.lzw(int(bits.ljust(64, "0"), 2).to_bytes(8, "big")) == b"A" + b"AA" + b"AAA" + b"B" + b"AAAB"


@pytest.mark.parametrize(("data", "want"), [(b"zz87cURDZ~>", b"\0" * 8 + b"Hello"), (b"87czURDZ~>", b"Hello"), (b"<~87cUR DZ\nz~>", b"Hello"), (b"", b"")])
def test_ascii85_zeros(data, want):
    assert filters.ascii85(data) == want


def test_rows_of_many_documents_are_a_batch(spark):
    """each document's rows were a batch of their own."""
    keys = "id bigint, content binary"
    found = list(tables.table(Rows(keys), "text")([documents(500)]))
    assert len(found) == 1 and found[0].num_rows == 499 and found[0].column("id").to_pylist()[2:4] == [2, 4] and found[0].column("text")[3].as_py() == "a4"
    found = list(rewrites.rewrite(Rows(keys), [rewrites.remove_unused()])([documents(500)]))
    assert len(found) == 1 and found[0].num_rows == 499 and found[0].column("id").to_pylist()[2:4] == [2, 4]


def test_made_documents_come_in_small_batches(spark):
    """a whole batch of rows became documents at once."""
    rows = pa.RecordBatch.from_pydict({"id": list(range(40))})
    alive = types.SimpleNamespace(now=0)

    def build(r):
        alive.now += 1
        return bytes([r["id"]]) * (1 << 20)

    made = []
    for batch in pdf.from_rows(Rows("id bigint"), build, ["id"])([rows]):
        made.append((batch.num_rows, alive.now))
        alive.now = 0
        assert [c[:1] for c in batch.column("content").to_pylist()] == [bytes([i]) for i in batch.column("id").to_pylist()]
    assert sum(n for n, _ in made) == 40 and max(n for _, n in made) <= 4


def test_documents_of_many_pages_are_built_in_one_pass():
    """the number of each new object was sought among all others."""
    from quire.kernels.write import Builder

    class Counted(dict):
        seen = 0

        def __iter__(self):
            Counted.seen += len(self)
            return super().__iter__()

    b = Builder()
    b.objects = Counted(b.objects)
    for _ in range(200):
        b.page()
    assert Counted.seen <= len(b.objects) == 403


def test_names_of_many_fields():
    """each name was sought from its beginning."""
    from quire.kernels.rewrite import FreeNames

    class Counted(set):
        asked = 0

        def __contains__(self, x):
            Counted.asked += 1
            return super().__contains__(x)

    names = FreeNames()
    names.taken = Counted()
    assert [names.of(x) for x in ("a", "a", "a_2", "a", None, None)] == ["a", "a_2", "a_2_2", "a_3", None, None]
    assert [names.of("b") for _ in range(1000)] == ["b", *(f"b_{i}" for i in range(2, 1001))] and Counted.asked < 3000


def merged_set() -> list[tuple]:
    from quire.kernels.syntax import Name, Ref, Str, encode_text
    from quire.kernels.write import Builder

    def form(size, font):
        b = Builder()
        page = b.page()
        f = b.add({"T": encode_text("f"), "FT": Name("Tx"), "V": encode_text(font)})
        own = b.add({"Type": Name("Font"), "BaseFont": Name(font)})
        b.catalog["AcroForm"] = {"Fields": [f, {"T": encode_text("direct"), "FT": Name("Tx"), "V": encode_text("d")}], "DR": {"Font": {"Helv": own, font: own}}, "DA": Str(b"/Helv %d Tf" % size), "CO": [f], "NeedAppearances": size == 9}
        b.catalog["OCProperties"] = {"OCGs": [b.add({"Type": Name("OCG")})], "D": {"OFF": []}}
        b.catalog["PageLabels"] = {"Nums": [0, {"S": Name("r"), "P": encode_text(font)}]}
        b.catalog["Outlines"] = b.add({"First": (item := b.add({"Title": encode_text(font), "Dest": [page, Name("Fit")]})), "Last": item})
        assert isinstance(item, Ref)
        return b.build()

    empty = Builder().build()
    return [("g", 0, empty), ("g", 3, form(8, "A")), ("g", 1, synth.text_pdf("\n".join(f"line {i}" for i in range(120)))), ("g", 4, None), ("g", 2, empty), ("g", 5, form(9, "B")), ("g", 6, synth.form_pdf({"c_name": "é", "c_custkey": 3, "c_mktsegment": "M"})), ("h", 1, b"junk"), ("h", 2, synth.text_pdf("x")), (None, 1, synth.text_pdf("y"))]


def test_parts_of_a_merged_file(spark):
    """a group was merged and read in one task, its documents and objects all held at once."""
    from quire import engine
    from quire.kernels import read, rewrite

    docs = spark.createDataFrame(merged_set(), "g string, o int, content binary").repartition(3)
    parts = engine.merge_parts(docs, by=["g"], order="o")
    rows = sorted((r for r in parts.collect() if r.error is None), key=lambda r: r.part)
    assert [(r.g, r.content, r.error) for r in parts.where("error is not null").collect()] == [("h", None, "PdfFormatError: no objects found")]
    whole = {g: b"".join(r.content for r in rows if r.g == g) for g in ("g", None)}
    want = {g: rewrite.merge([Document(c) for k, _, c in sorted(merged_set(), key=lambda r: r[1]) if k == g and c is not None])[0] for g in ("g", None)}
    for g in whole:
        mine, theirs = Document(whole[g]), Document(want[g])
        assert not mine.repaired and not mine.warnings and not theirs.repaired
        for kind in ("text", "fields", "outline", "pages"):
            a, b = ([{k: v for k, v in r.items() if k != "num"} for r in tables.rows_of(kind, d)] for d in (mine, theirs))
            assert a == b and (a or kind == "fields"), kind
    mine, theirs = Document(whole["g"]), Document(want["g"])
    assert {"Ai", "Bi"} <= {r["label"] for r in read.pages(mine)}
    got, had = (d.dict(d.catalog["AcroForm"]) for d in (mine, theirs))
    assert {k: mine.dict(v)["BaseFont"] for k, v in mine.dict(mine.dict(got["DR"])["Font"]).items()} == {"Helv": "A", "A": "A", "B": "B"}
    assert got["DA"] == had["DA"] and got["NeedAppearances"] is True and len(got["CO"]) == 2 and len(mine.dict(mine.catalog["OCProperties"])["OCGs"]) == 2
    by_part = sorted((r.page_index, r.text) for r in engine.text(parts, parts=True).where("g = 'g'").collect())
    assert by_part == [(r["page_index"], r["text"]) for r in text.texts(mine)]
    assert sorted((r.name, r.value) for r in engine.fields(parts, parts=True).where("g = 'g'").collect()) == sorted((r["name"], r["value"]) for r in read.fields(mine))
    assert max(len(r.content) for r in rows) < len(whole["g"]) / 2


def test_parts_with_chosen_pages(spark):
    from quire import engine

    docs = spark.createDataFrame([(1, 1, synth.text_pdf("\n".join(f"a {i}" for i in range(120))), [2, 0, 2]), (1, 2, synth.text_pdf("b"), None), (1, 3, None, [7]), (1, 4, synth.text_pdf("c"), [])], "g int, o int, content binary, p array<int>")
    found = [r.text.split("\n")[0] for r in engine.text(engine.merge_parts(docs, by=["g"], order="o", pages_col="p"), parts=True).orderBy("page_index").collect()]
    assert found == ["a 100", "a 0", "a 100", "b"]
    assert [r.text.split("\n")[0] for r in engine.text(engine.merge(docs, by=["g"], order="o", pages_col="p").select("g", "content")).orderBy("page_index").collect()] == found


def test_values_of_documents_are_small():
    """a document of many pages holds several of them a page; each had a dictionary."""
    from quire.kernels.syntax import Ref, Str, Stream

    assert not any(hasattr(x, "__dict__") for x in (Ref(1), Str(b""), Stream({})))
