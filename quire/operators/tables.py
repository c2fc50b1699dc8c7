"""Tables of document collections: a row source (key columns and a ``content`` binary column) to rows of fixed schemas.

Every operator is one pass over the documents in Arrow batches; a document is opened in the task that holds it and nothing
is shuffled. A damaged document is repaired as far as it goes; one that can't be read gives a row with ``error`` and nulls
(mode PERMISSIVE), no row (DROPMALFORMED) or fails the query (FAILFAST). A null content gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SCHEMAS: dict[str, str] = {
    "info": "version string, page_count int, title string, author string, subject string, keywords string, creator string, producer string, creation_date timestamp_ntz, mod_date timestamp_ntz, custom map<string,string>, language string, metadata string, encrypted boolean, tagged boolean, has_forms boolean, has_javascript boolean, signed boolean, attachments int, repaired boolean, warnings array<string>",
    "pages": "page_index int, num int, width double, height double, rotate int, label string, media_box array<double>, crop_box array<double>",
    "text": "page_index int, text string",
    "all_text": "text string",
    "checked_text": "page_index int, text string, repaired boolean",
    "outline": "path array<int>, depth int, title string, page_index int, url string, open boolean",
    "links": "page_index int, rect array<double>, url string, target_page_index int",
    "fields": "name string, type string, value array<string>, is_multi boolean, default_value array<string>, options array<string>, option_labels array<string>, signed boolean, flags int, read_only boolean, required boolean",
    "attachments": "ord int, name string, filename string, description string, size bigint, mime_type string, created timestamp_ntz, modified timestamp_ntz, relationship string, page_index int, stream_num int",
    "attachment_data": "ord int, name string, data binary",
    "images": "num int, pages array<int>, width int, height int, bits_per_component int, color_space string, filters array<string>, encoded_bytes bigint, image_mask boolean, has_soft_mask boolean",
    "image_data": "num int, kind string, width int, height int, components int, data binary",
    "objects": "num int, gen int, stored string, place bigint, type string, is_stream boolean, stream_bytes bigint, value string, refs array<int>",
    "xref": "num int, type string, a bigint, b int, section int",
}


PART_INDEX = ["nums", "offsets", "first_page", "page_nums", "field_nums"]
PART = ("part", "error", *PART_INDEX)
ROWS, BYTES = 1024, 4 << 20  # of a batch that is given back


def _batch(rows: list[dict], owners: list[int], batch: pa.RecordBatch, keys: list[str], arrow: pa.Schema, names: list[str]) -> pa.RecordBatch:
    """Rows with the keys of the documents (places in ``batch``) that they are of."""
    of = pa.array(owners, pa.int32())
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keys), *(pa.array([r.get(f.name) for r in rows], f.type) for f in arrow)], names=names)


def rows_of(kind: str, doc, **options) -> list[dict]:
    """Rows of one open document."""
    from quire.kernels import read, text

    if kind == "info":
        return [read.info(doc)]
    if kind == "text":
        return text.texts(doc, options.get("pages"))
    if kind == "all_text":
        found = text.texts(doc, options.get("pages"))
        return [{"text": "\f".join(p["text"] for p in found)}] if found else []
    if kind == "checked_text":
        return [p | {"repaired": doc.repaired} for p in text.texts(doc, options.get("pages"))]
    if kind == "attachment_data":
        return [{"ord": a["ord"], "name": a["name"], "data": read.attachment(doc, a["stream_num"])} for a in read.attachments(doc) if a["stream_num"] is not None]
    if kind == "image_data":
        return [{"num": i["num"]} | got for i in read.images(doc) if (got := read.extract_image(doc, i["num"])) is not None]
    if kind == "xref":
        return [{"num": n, "type": k, "a": a, "b": b, "section": doc.sections.get(n)} for n, (k, a, b) in sorted(doc.index.items())]
    return getattr(read, kind)(doc)


def table(docs: DataFrame, kind: str, *, keys: list[str] | None = None, password: str | None = None, password_col: str | None = None, mode: str = "PERMISSIVE", parts: bool = False, **options) -> DataFrame:
    """Rows of ``kind`` of each document, with the document's key columns (all but content by default) and ``error``. With
    ``parts``, rows of ``docs`` are pieces of files as ``merge_parts`` gives them, and each is read by itself (text and fields)."""
    if parts and kind not in ("text", "fields"):
        raise ValueError(f"not read from parts: {kind}")
    keys = keys if keys is not None else [c for c in docs.columns if c not in ("content", password_col, *(PART if parts else ()))]
    chosen = docs.select(*keys, "content", *([password_col] if password_col else []), *(PART_INDEX if parts else []))
    own = T.StructType.fromDDL(SCHEMAS[kind])
    schema = T.StructType([*(docs.schema[k] for k in keys), *own.fields, T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(T.StructType([*own.fields, schema["error"]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.kernels.document import Document, PdfError

        for batch in batches:
            content = batch.column("content")
            pws = batch.column(password_col) if password_col else None
            index = [batch.column(c) for c in PART_INDEX] if parts else []
            rows, owners, size = [], [], 0
            for i in range(batch.num_rows):
                if not content[i].is_valid:
                    continue
                pw = pws[i].as_py() if password_col else password
                try:
                    if parts:
                        nums, offsets, *more = (c[i].as_py() for c in index)
                        doc = Document.part(content[i].as_py(), dict(zip(nums, offsets)), *more)
                    else:
                        doc = Document(content[i].as_py(), pw)
                    found = rows_of(kind, doc, **options)
                except (PdfError, RecursionError, ValueError, OverflowError) as e:
                    if mode == "FAILFAST":
                        raise
                    found = [{"error": f"{type(e).__name__}: {e}"}] if mode == "PERMISSIVE" else []
                for r in found:  # rows of many documents to a batch, and many batches of a large one
                    rows.append(r)
                    owners.append(i)
                    size += sum(len(v) for v in r.values() if isinstance(v, (str, bytes)))
                    if len(rows) >= ROWS or size >= BYTES:
                        yield _batch(rows, owners, batch, keys, arrow, schema.names)
                        rows, owners, size = [], [], 0
            if rows:
                yield _batch(rows, owners, batch, keys, arrow, schema.names)

    return chosen.mapInArrow(run, schema)


def info(docs: DataFrame, **options) -> DataFrame:
    return table(docs, "info", **options)


def pages(docs: DataFrame, **options) -> DataFrame:
    return table(docs, "pages", **options)


def text(docs: DataFrame, *, pages: list[int] | None = None, repaired: bool = False, **options) -> DataFrame:
    """Text of pages; with ``repaired`` also whether the document's index had to be mended."""
    return table(docs, "checked_text" if repaired else "text", pages=pages, **options)


def all_text(docs: DataFrame, **options) -> DataFrame:
    """One row a document: its pages joined with form feeds."""
    found = table(docs, "all_text", **options)
    return found.select(*found.columns[:-2], F.coalesce("text", F.lit("")).alias("text"))


def outline(docs: DataFrame, **options) -> DataFrame:
    return table(docs, "outline", **options)


def links(docs: DataFrame, **options) -> DataFrame:
    return table(docs, "links", **options)


def fields(docs: DataFrame, **options) -> DataFrame:
    return table(docs, "fields", **options)


def attachments(docs: DataFrame, *, data: bool = False, **options) -> DataFrame:
    return table(docs, "attachment_data" if data else "attachments", **options)


def images(docs: DataFrame, *, data: bool = False, **options) -> DataFrame:
    return table(docs, "image_data" if data else "images", **options)


def objects(docs: DataFrame, **options) -> DataFrame:
    return table(docs, "objects", **options)


def xref(docs: DataFrame, **options) -> DataFrame:
    return table(docs, "xref", **options)


def reachable(objects_: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and numbers of objects that the roots lead to, as joins: a frontier is followed until none is new.

    For documents of millions of objects; smaller ones are walked in their task (remove_unused).
    """
    from quire.plans.scratch import write_table

    edges = write_table(objects_.select(*keys, F.col("num").alias("src"), F.explode("refs").alias("num")), "edges")
    seen = write_table(roots.select(*keys, "num").distinct(), "reached")
    frontier = seen
    while True:
        step = edges.join(frontier.withColumnRenamed("num", "src"), [*keys, "src"]).select(*keys, "num").distinct()
        frontier = write_table(step.join(seen, [*keys, "num"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen.join(objects_.select(*keys, "num").distinct(), [*keys, "num"], "left_semi")
        seen = seen.unionByName(frontier)
